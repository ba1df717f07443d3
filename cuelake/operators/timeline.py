"""Operators along media time: nearest frames, windows, greedy choices and relations of spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Seconds of media time that one task looks at together.
BLOCK_S = 256.0


def nearest(points: DataFrame, frames: DataFrame, group: str, at: str, ts: str, carried: list[str], block: float = BLOCK_S) -> DataFrame:
    """``points`` with the ``carried`` columns of the nearest frame of the same group; a tie goes to the earlier frame.

    A two-sided as-of join without comparing pairs. Times, each once however many points have it, and frames are laid on
    one time line and cut into blocks; each time takes the last frame up to it and the first after it. A block also gets
    the last frame of the blocks before it and the first of those behind. Points of a group without frames, and points
    and frames without a time, carry nulls or take no part.
    """
    frame = F.struct(F.col(ts).cast("double").alias("t"), *(F.col(c) for c in carried))
    b = lambda c: F.floor(F.col(c) / block).cast("bigint")
    known = lambda df, c: df.where(F.abs(F.col(c)) < float("inf"))
    f = known(frames, ts).select(group, b(ts).alias("_b"), F.col(ts).cast("double").alias("_t"), F.lit(0).alias("_side"), frame.alias("_f"))
    p = known(points, at).select(group, b(at).alias("_b"), F.col(at).cast("double").alias("_t")).distinct().select("*", F.lit(1).alias("_side"), F.lit(None).cast(f.schema["_f"].dataType).alias("_f"))
    line = f.unionByName(p)
    ends = line.groupBy(group, "_b").agg(F.min_by("_f", F.when(F.col("_side") == 0, F.col("_t"))).alias("_first"), F.max_by("_f", F.when(F.col("_side") == 0, F.col("_t"))).alias("_last"), F.max("_side").alias("_asked"))
    w = W.partitionBy(group).orderBy("_b")
    around = F.array(F.last("_last", True).over(w.rowsBetween(W.unboundedPreceding, -1)), F.first("_first", True).over(w.rowsBetween(1, W.unboundedFollowing)))
    extra = ends.select(group, "_b", "_asked", around.alias("_a")).where("_asked = 1").select(group, "_b", F.explode("_a").alias("_f")).where(F.col("_f").isNotNull())
    line = line.unionByName(extra.select(group, "_b", F.col("_f.t").alias("_t"), F.lit(0).alias("_side"), "_f"))
    before = W.partitionBy(group, "_b").orderBy("_t", "_side").rowsBetween(W.unboundedPreceding, 0)
    after = W.partitionBy(group, "_b").orderBy(F.desc("_t"), F.desc("_side")).rowsBetween(W.unboundedPreceding, 0)
    line = line.withColumns({"_l": F.last("_f", True).over(before), "_r": F.last("_f", True).over(after)}).where("_side = 1")
    left = F.col("_r").isNull() | (F.col("_l").isNotNull() & (F.col("_t") - F.col("_l.t") <= F.col("_r.t") - F.col("_t")))
    found = line.select(group, F.col("_t").alias("_at"), F.when(left, F.col("_l")).otherwise(F.col("_r")).alias("_n"))
    out = points.withColumn("_at", F.col(at).cast("double")).join(found, [group, "_at"], "left")
    return out.select(*points.columns, *(F.col(f"_n.{c}").alias(c) for c in carried))


def overlapping(a: DataFrame, b: DataFrame, on: list[str], span: tuple[str, str], other: tuple[str, str], block: float = 32.0) -> DataFrame:
    """Rows of ``a`` and ``b`` of the same ``on`` whose closed spans share a point, each pair once.

    Spans lie in the blocks of time that they touch, and only those of one block meet, so that a medium with many spans
    on both sides is spread along its time. Spans without finite ends, or that end before they start, meet nothing.
    """
    def dealt(df: DataFrame, s: str, e: str, name: str) -> DataFrame:
        at = lambda c: F.floor(F.col(c) / block).cast("bigint")
        df = df.where((F.abs(F.col(s)) < float("inf")) & (F.abs(F.col(e)) < float("inf")) & (F.col(s) <= F.col(e)))
        return df.withColumn(name, at(s)).withColumn("_b", F.explode(F.sequence(at(s), at(e))))

    j = dealt(a, *span, "_fa").join(dealt(b, *other, "_fb"), [*on, "_b"]).where(F.col("_b") == F.greatest("_fa", "_fb"))
    return j.where(overlap_closed(F.col(span[0]), F.col(span[1]), F.col(other[0]), F.col(other[1]))).drop("_b", "_fa", "_fb")


def inside(t: Column, s: Column, e: Column) -> Column:
    """Point in a half-open span."""
    return (t >= s) & (t < e)


def inside_closed(t: Column, s: Column, e: Column) -> Column:
    return t.between(s, e)


def overlap_closed(s: Column, e: Column, s2: Column, e2: Column) -> Column:
    """Spans that share a point; a missing end is the start."""
    return (s <= F.coalesce(e2, s2)) & (F.coalesce(e, s) >= s2)


def spaced(values: Column, gap: Column | float, strictly: bool = False) -> Column:
    """Of an array in order of preference, those kept greedily: at least (strictly: more than) ``gap`` from all kept.

    The array is a bounded list, such as the candidates of one query.
    """
    near = (lambda x, y: F.abs(x - y) <= gap) if strictly else (lambda x, y: F.abs(x - y) < gap)
    return F.aggregate(values, F.array().cast("array<double>"), lambda kept, x: F.when(F.exists(kept, lambda y: near(x, y)), kept).otherwise(F.concat(kept, F.array(x))))


def regions(values: Column, reach: float) -> Column:
    """How many regions sorted times form: one begins where a time lies more than ``reach`` past the last one's first."""
    first = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("double").alias("a"))
    step = lambda acc, x: F.when(acc.a.isNull() | (x - acc.a > reach), F.struct((acc.n + 1).alias("n"), x.alias("a"))).otherwise(acc)
    return F.aggregate(F.array_sort(values), first, step, lambda acc: acc.n)


def sampled(df: DataFrame, group: str, ts: str, interval: float) -> DataFrame:
    """Adds ``selected``: the first time of each group and each time at least ``interval`` after the last selected.

    Folded over the sorted times of one medium.
    """
    times = df.groupBy(group).agg(F.array_sort(F.collect_list(ts)).alias("_ts"))
    step = lambda acc, x: F.when(acc.last.isNull() | (x - acc.last >= interval), F.struct(x.alias("last"), F.concat(acc.kept, F.array(x)).alias("kept"))).otherwise(acc)
    start = F.struct(F.lit(None).cast("double").alias("last"), F.array().cast("array<double>").alias("kept"))
    kept = times.select(group, F.explode(F.aggregate("_ts", start, step, lambda a: a.kept)).alias(ts)).withColumn("selected", F.lit(True))
    return df.join(kept, [group, ts], "left").withColumn("selected", F.coalesce("selected", F.lit(False)))


def sliding_windows(media: DataFrame, key: str, duration: str, length: float, stride: float, samples: int) -> DataFrame:
    """``(key, n, start, end, samples)``: windows every ``stride`` until one reaches the end; samples lie mid-bin."""
    d = F.col(duration)
    w = media.where(d > 0).select(key, d.alias("_d"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(d / stride).cast("bigint") - 1)).alias("n"))
    w = w.withColumns({"start": F.col("n") * stride, "end": F.least(F.col("n") * stride + length, "_d")})
    w = w.where((F.col("n") == 0) | ((F.col("n") - 1) * stride + length < F.col("_d")))
    at = F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda i: F.col("start") + (i + 0.5) * (F.col("end") - F.col("start")) / samples)
    return w.select(key, "n", "start", "end", at.alias("samples"))


def merged_windows(points: DataFrame, keys: list[str], at: str, radius: float, duration: str) -> DataFrame:
    """``(*keys, start, end)``: windows of ``radius`` around points, clipped to the medium and merged where they touch."""
    w = points.select(*keys, F.greatest(F.col(at) - radius, F.lit(0.0)).alias("s"), F.least(F.col(at) + radius, F.col(duration)).alias("e"))
    o = W.partitionBy(*keys).orderBy("s", "e")
    before = F.max("e").over(o.rowsBetween(W.unboundedPreceding, -1))
    w = w.withColumn("new", (before.isNull() | (F.col("s") > before)).cast("int")).withColumn("k", F.sum("new").over(o.rowsBetween(W.unboundedPreceding, 0)))
    return w.groupBy(*keys, "k").agg(F.min("s").alias("start"), F.max("e").alias("end")).drop("k")


def grid(windows: DataFrame, keys: list[str], step: float) -> DataFrame:
    """``(*keys, ts)``: multiples of ``step`` inside any window, ends included, each once."""
    lo, hi = F.ceil(F.col("start") / step).cast("bigint"), F.floor(F.col("end") / step).cast("bigint")
    return windows.where(lo <= hi).select(*keys, F.explode(F.sequence(lo, hi)).alias("n")).select(*keys, (F.col("n") * step).alias("ts")).distinct()


def neighbours_within(df: DataFrame, keys: list[str], at: str, ident: str, reach: float) -> DataFrame:
    """Pairs ``(*keys, a, b, gap)`` of rows of one bounded list that lie within ``reach``, a before b.

    Buckets of ``reach`` make it an equi-join: a row meets those of its own bucket and the next.
    """
    b = F.floor(F.col(at) / reach).cast("bigint")
    left = df.select(*keys, F.col(ident).alias("a"), F.col(at).alias("_x"), F.explode(F.array(b - 1, b, b + 1)).alias("_b"))
    right = df.select(*keys, F.col(ident).alias("b"), F.col(at).alias("_y"), b.alias("_b"))
    return left.join(right, [*keys, "_b"]).where((F.col("a") < F.col("b")) & (F.abs(F.col("_x") - F.col("_y")) <= reach)).select(*keys, "a", "b", F.abs(F.col("_x") - F.col("_y")).alias("gap"))
