"""Features of candidates and lists of candidates, and the linear models applied to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuelake.operators.vectors import dot, norm


#: What candidate_features adds, and list_features gives, in this order.
CANDIDATE = ["score_z", "score_minmax", "reciprocal_rank", "log_rank", "gap_from_top", "gap_from_previous", "gap_to_next", "top_two_gap", "list_mean", "list_std", "list_range", "temporal_support_10s", "nearest_time_gap", "top_frame_cosine", "list_centroid_cosine"]
LIST = ["best_score", "top_two_gap", "top_five_gap", "mean", "std", "range", "entropy", "temporal_support_10s", "top_frame_centroid_cosine", "positive_tail_fraction", "candidate_count_log"]
#: Seconds within which another candidate supports one.
SUPPORT_S = 10.05


def candidate_features(df: DataFrame, keys: list[str], score: str, rank: str, ts: str | None = None, vector: str | None = None) -> DataFrame:
    """Adds the features CANDIDATE of each candidate of a bounded list ranked by descending score.

    Deviations are population ones; without spread z and minmax are 0. The first candidate has no gap to a previous one
    and the last none to a next one: 0, as is the nearest gap of a lone candidate. Features of time and of vectors are
    null without their columns; ``vector`` holds unit vectors.
    """
    w, o = W.partitionBy(*keys), W.partitionBy(*keys).orderBy(rank)
    s, r = F.col(score), F.col(rank)
    sd, lo, hi, mean = F.stddev_pop(score).over(w), F.min(score).over(w), F.max(score).over(w), F.avg(score).over(w)
    second = F.max(F.when(r == 2, s)).over(w)
    out = {
        "score_z": F.when(hi == lo, 0.0).otherwise((s - mean) / F.greatest(sd, F.lit(1e-12))), "score_minmax": (s - lo) / F.greatest(hi - lo, F.lit(1e-12)),
        "reciprocal_rank": 1 / r, "log_rank": 1 / F.log2(r + 1), "gap_from_top": hi - s, "gap_from_previous": F.coalesce(F.lag(score).over(o) - s, F.lit(0.0)),
        "gap_to_next": F.coalesce(s - F.lead(score).over(o), F.lit(0.0)), "top_two_gap": F.coalesce(hi - second, F.lit(0.0)), "list_mean": mean, "list_std": sd, "list_range": hi - lo,
    }
    null = F.lit(None).cast("double")
    if ts:
        others = F.transform(F.filter(F.collect_list(F.struct(r.alias("r"), F.col(ts).alias("t"))).over(w), lambda x: x.r != r), lambda x: F.abs(x.t - F.col(ts)))
        near = F.size(F.filter(others, lambda x: x <= SUPPORT_S))
        out |= {"temporal_support_10s": near / F.greatest(F.size(others), F.lit(1)), "nearest_time_gap": F.coalesce(F.array_min(others), F.lit(0.0))}
    else:
        out |= {"temporal_support_10s": null, "nearest_time_gap": null}
    if vector:
        first = F.max_by(vector, F.when(r == 1, 1)).over(w)
        n = F.count("*").over(w)
        total = F.aggregate(F.collect_list(vector).over(w), F.transform(F.col(vector), lambda x: F.lit(0.0)), lambda a, v: F.zip_with(a, v, lambda x, y: x + y.cast("double")))
        df = df.withColumns({"_first": first, "_mid": F.transform(total, lambda x: x / n)})
        out |= {"top_frame_cosine": dot(F.col(vector), F.col("_first")), "list_centroid_cosine": dot(F.col(vector), F.col("_mid")) / F.greatest(norm(F.col("_mid")), F.lit(1e-12))}
    else:
        out |= {"top_frame_cosine": null, "list_centroid_cosine": null}
    return df.withColumns(out).drop("_first", "_mid")


def list_features(df: DataFrame, keys: list[str], score: str, rank: str, ts: str | None = None, vector: str | None = None) -> DataFrame:
    """``(*keys, *LIST)`` of each list: its scores, the entropy of their softmax, and how its best candidate stands in it.

    Gaps are to the second and the fifth (or last) score; the entropy is divided by max(ln n, 1); the tail is the share
    of scores at or above mean plus deviation.
    """
    d = candidate_features(df, keys, score, rank, ts, vector)
    w = W.partitionBy(*keys)
    e = F.exp(F.col(score) - F.max(score).over(w))
    d = d.withColumn("_p", e / F.sum(e).over(w))
    s, r = F.col(score), F.col(rank)
    entropy = (F.lit(0.0) - F.sum(F.col("_p") * F.log(F.col("_p") + 1e-15))) / F.greatest(F.log(F.count("*").cast("double")), F.lit(1.0))
    at_first = lambda c: F.max(F.when(r == 1, F.col(c)))
    return d.groupBy(*keys).agg(
        F.max(score).alias("best_score"), F.max("top_two_gap").alias("top_two_gap"), (F.max(score) - F.min(F.when(r <= 5, s))).alias("top_five_gap"), F.avg(score).alias("mean"),
        F.stddev_pop(score).alias("std"), (F.max(score) - F.min(score)).alias("range"), entropy.alias("entropy"), at_first("temporal_support_10s").alias("temporal_support_10s"),
        at_first("list_centroid_cosine").alias("top_frame_centroid_cosine"), F.avg((s >= F.col("list_mean") + F.col("list_std")).cast("int")).alias("positive_tail_fraction"),
        F.log1p(F.count("*").cast("double")).alias("candidate_count_log"),
    )


def visual_evidence(df: DataFrame, keys: list[str], score: str, rank: str, ts: str) -> DataFrame:
    """``(*keys, ...)``: eight features of the best results of each query, from its first five scores and ten times.

    The strength is 1 minus the entropy of the softmax at temperature 0.02 over ln n (n at least 2). Times within 10 s
    of the first support it; times kept greedily 15 s apart are separate.
    """
    from cuelake.operators.timeline import spaced

    r, s = F.col(rank), F.col(score)
    g = df.where(r <= 10).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(r.alias("r"), s.alias("s"), F.col(ts).alias("t")))).alias("l"))
    five, times = F.transform(F.slice("l", 1, 5), lambda x: x.s), F.transform("l", lambda x: x.t)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)
    g = g.withColumns({"a": five, "t": times}).withColumns({"n": F.size("a"), "mean": total(F.col("a")) / F.size("a"), "e": F.transform("a", lambda x: F.exp((x - F.array_max("a")) / 0.02))})
    g = g.withColumn("p", F.transform("e", lambda x: x / total(F.col("e"))))
    entropy = F.lit(0.0) - total(F.transform("p", lambda x: x * F.log(x + 1e-12)))
    a = F.col("a")
    return g.select(
        *keys, a[0].alias("top1"), (a[0] - F.element_at(a, F.least(F.col("n"), F.lit(2)))).alias("margin_1_2"), (a[0] - F.element_at(a, -1)).alias("margin_1_5"), F.col("mean").alias("mean_5"),
        F.sqrt(total(F.transform("a", lambda x: (x - F.col("mean")) * (x - F.col("mean")))) / F.col("n")).alias("std_5"), (1 - entropy / F.log(F.greatest(F.lit(2), F.col("n")).cast("double"))).alias("entropy_strength"),
        (F.size(F.filter("t", lambda x: F.abs(x - F.col("t")[0]) <= 10)) / F.size("t")).alias("temporal_support"), (F.size(spaced(F.col("t"), 15.0)) / F.size("t")).alias("separated_support"),
    )


def speech_evidence(hits: DataFrame, queries: DataFrame, docs: DataFrame, corpus: str, query: str, doc: str) -> DataFrame:
    """``(query, ...)``: eight features of what is said, from ranked positive BM25 ``hits``.

    ``queries`` and ``docs`` have ``tokens``. Coverage is the share of a query's distinct terms found in the corpus, or
    in the best document; long terms have six letters or more, and without any their coverage is that of all. A phrase
    overlaps if two neighbouring distinct terms stand side by side in one document.
    """
    q = queries.select(corpus, query, F.array_distinct("tokens").alias("terms"))
    t = q.select(corpus, query, F.explode("terms").alias("term"))
    known = docs.select(corpus, F.explode("tokens").alias("term")).join(t.select(corpus, "term").distinct(), [corpus, "term"], "left_semi").distinct().withColumn("hit", F.lit(1))
    cov = t.join(known, [corpus, "term"], "left").groupBy(query).agg(F.count("hit").alias("covered"), F.count("*").alias("n"), F.count(F.when(F.length("term") >= 6, 1)).alias("long"), F.count(F.when(F.length("term") >= 6, F.col("hit"))).alias("long_hit"))
    pair = lambda a: F.when(F.size(a) > 1, F.transform(F.sequence(F.lit(1), F.size(a) - 1), lambda i: F.concat_ws(" ", F.element_at(a, i), F.element_at(a, i + 1)))).otherwise(F.array().cast("array<string>"))
    asked = q.select(corpus, query, F.explode(pair(F.col("terms"))).alias("pair"))
    said = docs.select(corpus, F.explode(pair(F.col("tokens"))).alias("pair")).join(asked.select(corpus, "pair").distinct(), [corpus, "pair"], "left_semi").distinct()
    phrase = asked.join(said, [corpus, "pair"]).select(query).distinct().withColumn("phrase", F.lit(1.0))
    s, r = F.col("score"), F.col("rank")
    per = hits.groupBy(query).agg(F.max("score").alias("top1"), (F.max("score") - F.coalesce(F.max(F.when(r == 2, s)), F.lit(0.0))).alias("margin_1_2"), F.log1p(F.count("*").cast("double")).alias("matching_segments"), (F.max("score") / F.sum("score")).alias("evidence_concentration"))
    best = hits.where(r == 1).select(corpus, query, doc).join(docs.select(corpus, doc, "tokens"), [corpus, doc]).join(q.select(query, "terms"), query)
    best = best.select(query, F.size(F.array_intersect("terms", "tokens")).alias("top_hit"))
    j = q.select(query).join(cov, query, "left").join(per, query, "left").join(best, query, "left").join(phrase, query, "left")
    n = F.greatest(F.coalesce("n", F.lit(0)), F.lit(1))
    z = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return j.select(query, z("top1").alias("top1"), z("margin_1_2").alias("margin_1_2"), (z("covered") / n).alias("query_coverage"), (z("top_hit") / n).alias("top_segment_coverage"), z("matching_segments").alias("matching_segments"), z("evidence_concentration").alias("evidence_concentration"), z("phrase").alias("phrase_overlap"), F.when(F.col("long") > 0, F.col("long_hit") / F.col("long")).otherwise(z("covered") / n).alias("technical_coverage"))


def robust_z(df: DataFrame, keys: list[str], score: str) -> DataFrame:
    """Adds ``robust_z``: distance from the median in interquartile ranges (at least 1e-9)."""
    q = df.groupBy(*keys).agg(F.percentile(score, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"))
    j = df.join(q, keys)
    return j.withColumn("robust_z", (F.col(score) - F.col("_q")[1]) / F.greatest(F.col("_q")[2] - F.col("_q")[0], F.lit(1e-9))).drop("_q")


def linear(features: list[Column], mean: list[float], scale: list[float], weights: list[float], bias: float = 0.0) -> Column:
    total = F.lit(bias)
    for x, m, s, w in zip(features, mean, scale, weights):
        total = total + (x - m) / s * w
    return total


def logistic(features: list[Column], mean: list[float], scale: list[float], weights: list[float], bias: float = 0.0) -> Column:
    """Probability of a standardised logistic model; the exponent is held within ±40."""
    z = F.greatest(F.least(linear(features, mean, scale, weights, bias), F.lit(40.0)), F.lit(-40.0))
    return 1 / (1 + F.exp(-z))


def softmax(logits: list[Column], names: list[str]) -> tuple[Column, Column, Column]:
    """Probabilities as an array, the first greatest class and its probability."""
    most = F.greatest(*logits)
    e = [F.exp(x - most) for x in logits]
    total = sum(e[1:], e[0])
    probs = F.array(*(x / total for x in e))
    best = F.lit(names[-1])
    for x, n in list(zip(logits, names))[-2::-1]:
        best = F.when(x == most, n).otherwise(best)
    return probs, best, 1 / total
