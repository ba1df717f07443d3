"""Thresholds, rules and small models fitted to labelled scores, and gates that compare figures."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuelake.operators.blocks import ordered_total


def above_negatives(df: DataFrame, keys: list[str], score: str, negative: Column) -> DataFrame:
    """``(*keys, cutoff)``: the greatest score of a negative. What passes lies strictly above it."""
    return df.where(negative).groupBy(*keys).agg(F.max(score).alias("cutoff"))


def bounded_alarms(best: DataFrame, score: str, share: float, none: float = float("-inf")) -> DataFrame:
    """One row ``cutoff``: with it, at most ``share`` of the negative queries have a score strictly above.

    ``best`` has the best score of each negative query. ``floor(share * n)`` may pass; the cutoff is the score next in
    order, ``none`` if there is no such query. Only the counts of distinct scores are ordered.
    """
    c = best.where(F.col(score).isNotNull()).groupBy(score).agg(F.count("*").alias("m"))
    c = ordered_total(c, [], score, {"upto": "m"}, descending=True).crossJoin(F.broadcast(c.agg(F.sum("m").alias("n"))))
    allowed = F.floor(F.lit(share) * F.col("n"))
    return c.agg(F.coalesce(F.max(F.when(F.col("upto") > allowed, F.col(score))), F.lit(none)).alias("cutoff"))


def midpoints(df: DataFrame, x: str) -> DataFrame:
    """``(threshold)``: midpoints between neighbouring distinct values, and one step beyond either end.

    Neighbours are found by rank: ranks are totals over ranges, and value i meets value i+1 by equality.
    """
    v = df.where(F.col(x).isNotNull()).select(x).distinct().withColumn("n", F.lit(1))
    r = ordered_total(v, [], x, {"r": "n"})
    mid = r.join(r.select((F.col("r") - 1).alias("r"), F.col(x).alias("next")), "r").select(((F.col(x) + F.col("next")) / 2).alias("threshold"))
    ends = v.agg((F.min(x) - 1e-9).alias("a"), (F.max(x) + 1e-9).alias("b")).where("a IS NOT NULL").select(F.explode(F.array("a", "b")).alias("threshold"))
    return mid.unionByName(ends)


def threshold_rates(df: DataFrame, x: str, positive: str) -> DataFrame:
    """``(value, accepted_positive, accepted_negative, positives, negatives)`` if all at or above each value are accepted.

    One ordered pass over the counts of distinct values instead of one pass for each threshold.
    """
    c = df.where(F.col(x).isNotNull()).groupBy(F.col(x).alias("value")).agg(F.sum(F.col(positive).cast("bigint")).alias("p"), F.count("*").alias("m"))
    c = c.withColumn("q", F.col("m") - F.col("p"))
    every = c.agg(F.sum("p").alias("positives"), F.sum("q").alias("negatives"))
    t = ordered_total(c, [], "value", {"accepted_positive": "p", "accepted_negative": "q"}, descending=True)
    return t.crossJoin(F.broadcast(every)).select("value", "accepted_positive", "accepted_negative", "positives", "negatives")


def best_threshold(df: DataFrame, x: str, positive: str, alarms: float) -> DataFrame:
    """The threshold that loses fewest positives with a false-alarm rate of at most ``alarms``; then fewer alarms, then the higher."""
    r = threshold_rates(df, x, positive)
    pfa = 1 - F.col("accepted_positive") / F.greatest("positives", F.lit(1))
    far = F.col("accepted_negative") / F.greatest("negatives", F.lit(1))
    ok = r.select("value", pfa.alias("false_abstention"), far.alias("false_alarm")).where(F.col("false_alarm") <= alarms)
    return ok.orderBy("false_abstention", "false_alarm", F.desc("value")).limit(1).withColumnRenamed("value", "threshold")


def newton_logistic(df: DataFrame, features: list[str], label: str, l2: float = 1.0, steps: int = 100, balanced: bool = False) -> dict:
    """An L2 logistic model by Newton steps: each step is one aggregation of its normal equations over all rows.

    The driver gets d*(d+1)/2 + d sums a step, d the number of features and one, however many rows there are. Features
    are standardised (scale 1 for those without spread); the bias isn't penalised. ``balanced`` weighs both classes
    alike. Rows with a null feature or label are left out; without rows of both classes, weights stay 0.
    """
    df = df.select(*(F.col(f).cast("double").alias(f"_x{i}") for i, f in enumerate(features)), F.col(label).cast("double").alias("_y")).dropna()
    d = len(features)
    stats = df.agg(*(f(f"_x{i}").alias(f"{n}{i}") for i in range(d) for n, f in (("m", F.avg), ("s", F.stddev_pop))), F.sum("_y").alias("p"), F.count("*").alias("n")).first()
    mean, scale = [stats[f"m{i}"] or 0.0 for i in range(d)], [stats[f"s{i}"] or 1.0 for i in range(d)]
    model = {"mean": mean, "scale": scale, "weights": [0.0] * d, "bias": 0.0}
    n, p = stats["n"], stats["p"] or 0
    if not n or p in (0, n):
        return model
    weight = F.when(F.col("_y") == 1, n / (2 * p)).otherwise(n / (2 * (n - p))) if balanced else F.lit(1.0)
    x = [F.lit(1.0), *((F.col(f"_x{i}") - mean[i]) / scale[i] for i in range(d))]
    beta, penalty = np.zeros(d + 1), l2 * np.eye(d + 1)
    penalty[0, 0] = 0
    for _ in range(steps):
        z = sum((float(b) * c for b, c in zip(beta[1:], x[1:])), F.lit(float(beta[0])))
        q = 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(40.0)), F.lit(-40.0))))
        h = weight * q * (1 - q)
        sums = df.agg(*(F.sum(weight * (F.col("_y") - q) * c).alias(f"g{i}") for i, c in enumerate(x)), *(F.sum(h * x[i] * x[j]).alias(f"h{i}_{j}") for i in range(d + 1) for j in range(i, d + 1))).first()
        grad = np.array([sums[f"g{i}"] for i in range(d + 1)]) - penalty @ beta
        hess = np.array([[sums[f"h{min(i, j)}_{max(i, j)}"] for j in range(d + 1)] for i in range(d + 1)]) + penalty
        move = np.linalg.solve(hess + 1e-9 * np.eye(d + 1), grad)
        beta = beta + move
        if np.abs(move).max() < 1e-10:
            break
    return model | {"weights": beta[1:].tolist(), "bias": float(beta[0])}


def softmax_fit(x: np.ndarray, y: np.ndarray, classes: int, steps: int = 2000, rate: float = 0.08, l2: float = 0.01, balanced: bool = True, standard: bool = True, decay: bool = False) -> dict:
    """A softmax model by full-batch descent over a bounded, labelled sample whose first feature is the bias.

    All but the bias are standardised (``standard``) and penalised by l2/n; classes weigh alike (``balanced``); the step
    shrinks with the root of its number (``decay``).
    """
    n, d = x.shape
    mean, scale = (x.mean(0), x.std(0)) if standard else (np.zeros(d), np.ones(d))
    mean[0], scale[0] = 0.0, 1.0
    scale[scale < 1e-12] = 1.0
    z, t = (x - mean) / scale, np.eye(classes)[y]
    sample = n / (classes * np.maximum(np.bincount(y, minlength=classes), 1)[y]) if balanced else np.ones(n)
    w = np.zeros((d, classes))
    for i in range(steps):
        s = z @ w
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        grad = z.T @ ((p - t) * sample[:, None]) / n
        grad[1:] += l2 * w[1:] / n
        w -= rate / (np.sqrt(i + 1) if decay else 1) * grad
    return {"mean": mean.tolist(), "scale": scale.tolist(), "weights": w.tolist()}


def softmax_fit_sparse(row: np.ndarray, col: np.ndarray, value: np.ndarray, d: int, y: np.ndarray, classes: int, steps: int, rate: float, l2: float) -> np.ndarray:
    """``softmax_fit`` without balance and standard and with decay, over the entries of a sparse matrix; weights of d features by classes.

    Entries are sorted by row, and each row has one: that of the bias, column 0.
    """
    n, w, t = len(y), np.zeros((d, classes)), np.eye(classes)[y]
    starts = np.searchsorted(row, np.arange(n))
    for i in range(steps):
        s = np.stack([np.add.reduceat(value * w[:, k][col], starts) for k in range(classes)], 1)
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        miss = p - t
        grad = np.stack([np.bincount(col, value * miss[:, k][row], d) for k in range(classes)], 1) / n
        grad[1:] += l2 * w[1:] / n
        w -= rate / np.sqrt(i + 1) * grad
    return w


def rule_search(points: list[tuple[float, float, int, int]], names: tuple[str, str], alarms: float) -> tuple | None:
    """``(feature, threshold, feature_2, threshold_2, pfa, far)``, the best rule of one feature or two at any midpoints.

    ``points`` are ``(x, y, positives, negatives)``; a rule accepts what lies at or above its thresholds. Of the rules with
    a false-alarm rate of at most ``alarms``, the one that loses fewest positives; then fewer alarms, one feature before
    two, the first name, the higher thresholds. Exhaustive: for each threshold of x, in descending order, the rows at or
    above it stand in Fenwick trees over y, where the best threshold of y is a descent. A null lies above no threshold.
    """
    pos, neg = sum(p[2] for p in points), sum(p[3] for p in points)
    most = max((k for k in range(max(0, int(alarms * neg) - 1), int(alarms * neg) + 2) if k / max(neg, 1) <= alarms), default=0)
    some = [[p for p in points if p[i] is not None] for i in (0, 1)]
    if not some[0] or not some[1]:
        return None
    values = [sorted({p[i] for p in some[i]}, reverse=True) for i in (0, 1)]

    def threshold(i: int, k: int) -> float:
        """Of feature ``i``, the one that the ``k`` greatest distinct values pass."""
        v = values[i]
        return v[0] + 1e-9 if k == 0 else v[-1] - 1e-9 if k == len(v) else (v[k - 1] + v[k]) / 2

    best: list[tuple] = []

    def offer(p: int, m: int, two: int, name: str, *rule) -> None:
        if m <= most and (not best or (-p, m, two, name) < best[0][:4]):
            best[:] = [(-p, m, two, name, *rule)]

    for i in (0, 1):
        at: dict[float, list[int]] = {}
        for x in some[i]:
            c = at.setdefault(x[i], [0, 0])
            c[0], c[1] = c[0] + x[2], c[1] + x[3]
        p = m = 0
        offer(0, 0, 0, names[i], threshold(i, 0), None, None)
        for k, v in enumerate(values[i], 1):
            p, m = p + at[v][0], m + at[v][1]
            offer(p, m, 0, names[i], threshold(i, k), None, None)
    size = len(values[1])
    place, trees, top = {v: k for k, v in enumerate(values[1], 1)}, ([0] * (size + 1), [0] * (size + 1)), 1 << size.bit_length()

    def furthest(tree: list[int], limit: int) -> int:
        """The greatest k whose first k places hold at most ``limit``."""
        k, step = 0, top
        while step:
            if k + step <= size and tree[k + step] <= limit:
                k += step
                limit -= tree[k]
            step >>= 1
        return k

    def upto(tree: list[int], k: int) -> int:
        s = 0
        while k:
            s += tree[k]
            k &= k - 1
        return s

    rows: dict[float, list[tuple]] = {}
    for p in points:
        if p[0] is not None and p[1] is not None:
            rows.setdefault(p[0], []).append(p)
    for i, v in enumerate(values[0], 1):
        for _, y, *n in rows.get(v, ()):
            for tree, c in zip(trees, n):
                k = place[y]
                while c and k <= size:
                    tree[k] += c
                    k += k & -k
        p = upto(trees[0], furthest(trees[1], most))
        k = furthest(trees[0], p - 1) + 1 if p else 0
        offer(p, upto(trees[1], k), 1, names[0], threshold(0, i), names[1], threshold(1, k))
    p, m, _, name, a, second, b = best[0]
    return name, a, second, b, 1 + p / max(pos, 1), m / max(neg, 1)


def regressions(base: DataFrame, new: DataFrame, key: str, metrics: dict[str, int], tolerance: float) -> DataFrame:
    """``(key, metric, base, new)`` where a figure got worse by more than ``tolerance``.

    ``metrics`` gives +1 for figures that should be high and -1 for those that should be low. A figure that is missing
    on the new side counts as worse.
    """
    names = list(metrics)
    a = base.unpivot([key], names, "metric", "base")
    b = new.unpivot([key], names, "metric", "new")
    sign = F.create_map(*(F.lit(v) for kv in metrics.items() for v in kv))[F.col("metric")]
    worse = F.col("new").isNull() | ((F.col("base") - F.col("new")) * sign > tolerance)
    return a.join(b, [key, "metric"], "left").where(F.col("base").isNotNull() & worse).select(key, "metric", "base", "new")


def temporal_trials(candidates: DataFrame, intervals: DataFrame, keys: list[str], support: list[float], change: list[float]) -> DataFrame:
    """``(*keys, support_weight, change_weight, first)``: the first relevant rank of each list for every pair of weights.

    Lists ``(*keys, rank, ts, score_z, temporal_support_10s, change)``, bounded by their depth, are reordered by the
    weighted sum; equal ones keep their order. Lists without a hit give no row.
    """
    weights = F.array(*(F.struct(F.lit(float(a)).alias("support_weight"), F.lit(float(b)).alias("change_weight")) for a in support for b in change))
    x = candidates.select(*keys, "rank", "ts", "score_z", "temporal_support_10s", "change", F.inline(weights))
    total = F.round(F.col("score_z") + F.col("support_weight") * F.col("temporal_support_10s") + F.col("change_weight") * F.col("change"), 6)
    x = x.withColumn("pos", F.row_number().over(W.partitionBy(*keys, "support_weight", "change_weight").orderBy(F.desc(total), "rank")))
    hit = x.join(intervals.select(*keys, "s", "e"), keys).where(F.col("ts").between(F.col("s"), F.col("e")))
    return hit.groupBy(*keys, "support_weight", "change_weight").agg(F.min("pos").alias("first"))


def trial_scores(first: DataFrame, trial: list[str], rank: str, depth: int, *more: Column) -> DataFrame:
    """``(*trial, r5, r1, mrr, ...)``: numbers of lists that hit at ``depth`` and at 1, and the sum of reciprocal ranks."""
    r = F.col(rank)
    return first.groupBy(*trial).agg(F.count(F.when(r <= depth, 1)).alias("r5"), F.count(F.when(r == 1, 1)).alias("r1"), F.sum(F.when(r <= depth, 1 / r).otherwise(0.0)).alias("mrr"), *more)


def best_trial(trials: DataFrame, figures: list[str], settings: list[str]) -> DataFrame:
    """The trial of the highest figures, in their order; of equal ones that whose settings are nearest to 0."""
    return trials.orderBy(*(F.desc(F.round(c, 9)) for c in figures), *(F.abs(c) for c in settings), *settings).limit(1)


def accepted(mode: Column, score: Column, evidence: Column, threshold: float | None) -> Column:
    """Whether a result passes a visual cutoff: all do in speech search or without a cutoff, a hybrid one also if its
    ``evidence``, a map of scores by lane, has speech."""
    if threshold is None:
        return F.lit(True)
    backed = F.coalesce(F.map_contains_key(evidence, "speech"), F.lit(False)) | (F.coalesce(F.try_element_at(evidence, F.lit("visual")), F.lit(float("-inf"))) >= threshold)
    return F.when(mode == "speech", True).when(mode == "visual", F.coalesce(score >= threshold, F.lit(False))).otherwise(backed)
