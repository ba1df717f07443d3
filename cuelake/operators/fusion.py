"""Fusing ranked lanes: reciprocal ranks, their variants, and what a fused list owes to which lane."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RRF = 60


def buckets(lanes: DataFrame, keys: list[str]) -> DataFrame:
    """First appearance of each bucket in each lane: ``(*keys, lane, thumbnail, rank, score, ts, end, text, skipped)``.

    ``lanes`` has ``(*keys, lane, rank, thumbnail, score, ts, end, text)``. A bucket votes once a lane, by its best raw
    rank; later rows of the bucket use up their ranks and are listed in ``skipped``.
    """
    rest = F.struct("rank", "score", "ts", "end", "text")
    g = lanes.groupBy(*keys, "lane", "thumbnail").agg(F.min(rest).alias("f"), F.array_sort(F.collect_list("rank")).alias("r"))
    return g.select(*keys, "lane", "thumbnail", "f.*", F.slice("r", 2, F.greatest(F.size("r") - 1, F.lit(0))).alias("skipped"))


def fuse(lanes: DataFrame, keys: list[str], constant: int = RRF) -> DataFrame:
    """Reciprocal-rank fusion: one row a bucket, ``score`` = sum over lanes of 1/(constant + rank), with ``fused_rank``.

    The fields come from the visual lane, but a speech row sets text, time and end. Order: score descending, time, then
    buckets as they first came (visual before speech, by rank). No lane rows, no rows.
    """
    b = buckets(lanes, keys)
    v, s = F.col("lane") == "visual", F.col("lane") == "speech"
    pick = lambda c: F.coalesce(F.max(F.when(s, F.col(c))), F.max(F.when(v, F.col(c))))
    g = b.groupBy(*keys, "thumbnail").agg(
        F.sum(1 / (constant + F.col("rank"))).alias("score"), pick("ts").alias("ts"), F.max(F.when(s, F.col("end"))).alias("end"), F.max(F.when(s, F.col("text"))).alias("text"),
        F.max(F.when(v, F.col("rank"))).alias("visual_rank"), F.max(F.when(s, F.col("rank"))).alias("speech_rank"),
    )
    g = g.withColumn("modality", F.concat_ws("+", F.when(F.col("visual_rank").isNotNull(), "visual"), F.when(F.col("speech_rank").isNotNull(), "speech")))
    order = [F.desc(F.round("score", 12)), "ts", F.col("visual_rank").isNull(), F.coalesce("visual_rank", "speech_rank")]
    return g.withColumn("fused_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("bigint"))


def contributions(lanes: DataFrame, keys: list[str]) -> DataFrame:
    """Long form of a fusion: a row a bucket and lane, with what each way of counting gives its rank.

    ``rrf`` 1/(60+r); ``normalized60`` and ``normalized10`` 1/(c+r) stretched so that the first rank gives 1 and the one
    past the last gives 0; ``percentile`` (n-r+1)/n.
    """
    n = F.max("rank").over(W.partitionBy(*keys, "lane"))
    b = buckets(lanes.withColumn("_n", n), [*keys, "_n"]).withColumnRenamed("_n", "n")
    raw = lambda c: 1 / (c + F.col("rank"))
    stretched = lambda c: (raw(c) - 1 / (c + F.col("n") + 1)) / (F.lit(1 / (c + 1)) - 1 / (c + F.col("n") + 1))
    return b.withColumns({"rrf": raw(RRF), "normalized60": stretched(60), "normalized10": stretched(10), "percentile": (F.col("n") - F.col("rank") + 1) / F.col("n")})


def capped(total: Column, greatest: Column, lanes: Column, cap: float | None) -> Column:
    """A sum of contributions, at most ``cap`` times the greatest of them if several lanes agree."""
    return total if cap is None else F.when(lanes > 1, F.least(total, cap * greatest)).otherwise(total)


#: Variants of fusion: name, way of counting, cap for agreeing lanes.
VARIANTS = [("baseline_rrf60", "rrf", None), ("cap_1_75", "rrf", 1.75), ("cap_1_50", "rrf", 1.5), ("cap_1_25", "rrf", 1.25), ("normalized_rrf60", "normalized60", None), ("normalized_rrf10", "normalized10", None), ("normalized_percentile", "percentile", None)]


def variants(lanes: DataFrame, keys: list[str], k: int) -> DataFrame:
    """``(*keys, variant, thumbnail, score, rank)``: the k best buckets under every variant, in one plan."""
    c = contributions(lanes, keys)
    g = c.groupBy(*keys, "thumbnail").agg(
        *(f(m).alias(f"{n}_{m}") for m in ("rrf", "normalized60", "normalized10", "percentile") for n, f in (("sum", F.sum), ("max", F.max))), F.count("*").alias("lanes"),
        F.coalesce(F.max(F.when(F.col("lane") == "speech", F.col("ts"))), F.max("ts")).alias("ts"),
        F.max(F.when(F.col("lane") == "visual", F.col("rank"))).alias("vr"), F.max("rank").alias("any"),
    )
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("variant"), capped(F.col(f"sum_{m}"), F.col(f"max_{m}"), F.col("lanes"), cap).alias("score")) for n, m, cap in VARIANTS)))
    g = g.select(*keys, "thumbnail", "ts", "vr", "any", each.alias("x")).select(*keys, "x.variant", "thumbnail", "ts", "vr", "any", "x.score")
    r = F.row_number().over(W.partitionBy(*keys, "variant").orderBy(F.desc(F.round("score", 12)), "ts", F.col("vr").isNull(), F.coalesce("vr", "any")))
    return g.withColumn("rank", r.cast("bigint")).where(F.col("rank") <= k).drop("vr", "any")


def depth(lane: str, keys: list[str]) -> Column:
    """Position of a bucket among the distinct buckets of a lane, from 1; null if the lane lacks it."""
    c = F.col(f"{lane}_rank")
    return F.when(c.isNotNull(), F.dense_rank().over(W.partitionBy(*keys, c.isNull()).orderBy(c)))


def _within(n: int) -> Column:
    return F.coalesce(F.col("_v") <= n, F.lit(False)) | F.coalesce(F.col("_s") <= n, F.lit(False))


def _ordered(fused: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    r = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return fused.withColumn("rank", r.cast("bigint")).where(F.col("rank") <= k).drop("_v", "_s")


def quota(fused: DataFrame, keys: list[str], q: int, k: int) -> DataFrame:
    """The first q buckets of each lane, in fused order, then the rest in fused order: k rows with ``rank``."""
    d = fused.withColumns({"_v": depth("visual", keys), "_s": depth("speech", keys)})
    return _ordered(d, keys, [~_within(q), "fused_rank"], k)


def interleaved(fused: DataFrame, keys: list[str], start: str, k: int) -> DataFrame:
    """Takes turns between the lanes' buckets from ``start`` on; a bucket comes at its first turn."""
    second = "speech" if start == "visual" else "visual"
    turn = F.least(depth(start, keys) * 2, depth(second, keys) * 2 + 1)
    return _ordered(fused.withColumn("_v", turn), keys, ["_v"], k)


def preserved(fused: DataFrame, keys: list[str], protected: int, k: int) -> DataFrame:
    """The first ``protected`` buckets of each lane come first, by their better raw rank; then the rest in fused order."""
    d = fused.withColumns({"_v": depth("visual", keys), "_s": depth("speech", keys)})
    safe = _within(protected)
    return _ordered(d, keys, [~safe, F.when(safe, F.least("visual_rank", "speech_rank")), "fused_rank", "ts", "thumbnail"], k)


def blended(df: DataFrame, keys: list[str], score: str, extra: str, weight: float, minmax: bool, ties: list[str]) -> DataFrame:
    """Adds ``blend`` and ``rank``: score + weight*extra, or (1-weight)*minmax(score) + weight*extra.

    A list whose scores are all equal counts as 1. Without any ``extra`` the order stays that of the score.
    """
    w = W.partitionBy(*keys)
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    base = F.when(hi > lo, (F.col(score) - lo) / (hi - lo)).otherwise(1.0) if minmax else F.col(score)
    add = F.coalesce(F.col(extra), F.lit(0.0))
    mixed = (1 - weight) * base + weight * add if minmax else base + weight * add
    df = df.withColumn("blend", F.when(F.count(extra).over(w) == 0, F.col(score)).otherwise(mixed))
    return df.withColumn("rank", F.row_number().over(w.orderBy(F.desc(F.round("blend", 9)), *ties)).cast("bigint"))


def rescored(df: DataFrame, keys: list[str], score: str, old: str, out: str = "rank") -> DataFrame:
    """Ranks by an external score; ties and missing scores keep the old order, missing ones last."""
    r = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc_nulls_last(F.round(score, 9)), old))
    return df.withColumn(out, r.cast("bigint"))
