"""Scoring rankings against relevance intervals, decisions against labels, and runs against each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuelake.operators.blocks import ordered_total


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is 0 or null."""
    return F.try_divide(a.cast("double"), b)


def share(condition: Column) -> Column:
    """Aggregate: the share of rows where a condition holds; an unknown condition doesn't hold."""
    return F.avg(F.coalesce(condition, F.lit(False)).cast("double"))


def interval_scores(results: DataFrame, intervals: DataFrame, queries: DataFrame, key: str, k: int) -> DataFrame:
    """``(key, recall, precision, reciprocal_rank, returned)`` of each query at depth k.

    A result scores for the first half-open interval that holds it. ``recall`` = matched intervals / intervals, null
    without intervals; ``precision`` = matched intervals / k; the reciprocal rank is that of the first hit, 0 without
    one and null without intervals. Queries without results score 0.
    """
    top = results.where(F.col("rank") <= k)
    hits = top.join(intervals, key).where((F.col("ts") >= F.col("s")) & (F.col("ts") < F.col("e")))
    hits = hits.groupBy(key, "rank").agg(F.min("ord").alias("ord"))
    per = hits.groupBy(key).agg(F.countDistinct("ord").alias("matched"), F.min("rank").alias("first"))
    n = intervals.groupBy(key).agg(F.count("*").alias("n"))
    returned = top.groupBy(key).agg(F.count("*").alias("returned"))
    q = queries.select(key).distinct().join(n, key, "left").join(per, key, "left").join(returned, key, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    has = zero("n") > 0
    return q.select(
        key, F.when(has, zero("matched") / F.col("n")).alias("recall"), (zero("matched") / k).alias("precision"),
        F.when(has, F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("reciprocal_rank"), zero("returned").alias("returned"),
    )


def first_ranks(results: DataFrame, intervals: DataFrame, queries: DataFrame, key: str) -> DataFrame:
    """``(key, first_rank)``: rank of the first result within a closed interval, null for a miss."""
    hit = results.join(intervals, key).where(F.col("ts").between(F.col("s"), F.col("e"))).groupBy(key).agg(F.min("rank").alias("first_rank"))
    return queries.select(key).distinct().join(hit, key, "left")


def recalls(rank: str, depths: list[int], mrr: int) -> list[Column]:
    """Aggregates over first ranks: n, R@k for each depth, MRR@mrr; a missing rank is a miss."""
    r = F.col(rank)
    return [F.count("*").alias("n"), *(F.round(share(r <= k), 6).alias(f"r_at_{k}") for k in depths), F.round(F.avg(F.when(r <= mrr, 1 / r).otherwise(0.0)), 6).alias(f"mrr_at_{mrr}")]


def grouped(df: DataFrame, keys: list[str], aggregates: list[Column]) -> DataFrame:
    """One row for all and one for each value of each key: grouping sets, ``(by, value, *aggregates)``, in one pass.

    A null value of a key is shown as ``(null)``.
    """
    shown = df.select("*", *(F.coalesce(F.col(c).cast("string"), F.lit("(null)")).alias(f"_g_{c}") for c in keys))
    named = [f"_g_{c}" for c in keys]
    out = shown.groupingSets([[], *([F.col(c)] for c in named)], *named).agg(F.grouping_id(*named).alias("_id"), *aggregates)
    n = len(keys)
    by = F.lit("all")
    for i, c in enumerate(keys):
        by = F.when(F.col("_id") == (2**n - 1) - 2 ** (n - 1 - i), c).otherwise(by)
    rest = [c for c in out.columns if c != "_id" and c not in named]
    return out.select(by.alias("by"), F.coalesce(*named, F.lit("all")).alias("value"), *rest)


def quantiles(df: DataFrame, keys: list[str], x: str, at: dict[str, tuple[str, float]]) -> DataFrame:
    """``(*keys, *at)``: exact quantiles ``{name: (kind, p)}`` of each group, by totals of distinct values, without gathering it.

    ``linear`` lies between the values around index p*(n-1), counted from 0; ``nearest`` is the value at rank ceil(p*n);
    ``floor`` that at index int(p*n), the last one at most. Nulls take no part.
    """
    c = df.where(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count("*").alias("_m"))
    t = ordered_total(c, keys, x, {"_upto": "_m"})
    n = c.groupBy(*keys).agg(F.sum("_m").alias("_n"))
    t = t.join(n, keys) if keys else t.crossJoin(F.broadcast(n))
    value = lambda i: F.max(F.when((F.col("_upto") > i) & (F.col("_upto") - F.col("_m") <= i), F.col(x)))
    out = []
    for name, (kind, p) in at.items():
        if kind == "linear":
            h = (F.col("_n") - 1) * p
            part = F.max(h - F.floor(h))
            low, high = value(F.floor(h)), value(F.ceil(h))
            out.append((low * (1 - part) + high * part).alias(name))
        else:
            i = F.ceil(F.col("_n") * p) - 1 if kind == "nearest" else F.floor(F.col("_n") * p)
            out.append(value(F.greatest(F.least(i, F.col("_n") - 1), F.lit(0))).alias(name))
    return t.groupBy(*keys).agg(*out)


def auc(df: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """``(*keys, positives, negatives, auc)`` by the rank-sum formula; ties count one half. Null without both classes.

    Equal scores are counted together first, and distinct ones are ordered by ranges over all tasks.
    """
    c = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*keys, score).agg(F.sum(F.col(label).cast("bigint")).alias("p"), F.count("*").alias("m"))
    c = ordered_total(c.withColumn("neg", F.col("m") - F.col("p")), keys, score, {"upto": "neg"}).withColumn("below", F.col("upto") - F.col("neg"))
    pos, neg = F.sum("p"), F.sum(F.col("m") - F.col("p"))
    wins = F.sum(F.col("p") * (F.col("below") + (F.col("m") - F.col("p")) / 2))
    return c.groupBy(*keys).agg(pos.alias("positives"), neg.alias("negatives"), F.try_divide(wins, (pos * neg).cast("double")).alias("auc"))


def confusion(df: DataFrame, truth: str, said: str) -> DataFrame:
    """``(truth, said, n)``: the long form of a confusion matrix."""
    return df.groupBy(F.col(truth).alias("truth"), F.col(said).alias("said")).agg(F.count("*").alias("n"))


def per_class(df: DataFrame, truth: str, said: str) -> DataFrame:
    """``(class, support, precision, recall, f1)``; 0 where a ratio has nothing below the line."""
    c = confusion(df, truth, said)
    t = c.groupBy(F.col("truth").alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("truth") == F.col("said"), F.col("n")).otherwise(0)).alias("hit"))
    s = c.groupBy(F.col("said").alias("class")).agg(F.sum("n").alias("claimed"))
    z = lambda x: F.coalesce(x, F.lit(0.0))
    j = t.join(s, "class", "full").select("class", F.coalesce("support", F.lit(0)).alias("support"), z(ratio(F.col("hit"), F.col("claimed"))).alias("precision"), z(ratio(F.col("hit"), F.col("support"))).alias("recall"))
    p, r = F.col("precision"), F.col("recall")
    return j.withColumn("f1", z(ratio(2 * p * r, p + r)))


def change_class(before: Column, after: Column, k: int) -> Column:
    """What a new ranking does to a query, from the first relevant rank before and after (null: none)."""
    b, a = F.coalesce(before <= k, F.lit(False)), F.coalesce(after <= k, F.lit(False))
    return F.when(~b & a, "RECOVERY").when(b & ~a, "REGRESSION").when(b & a & (before != after), "NEUTRAL").otherwise("UNCHANGED")


def touches(t: Column, end: Column, s: Column, e: Column) -> Column:
    """A result from ``t`` to ``end`` (a missing end is ``t``) shares a point with the span."""
    return (t <= e) & (F.coalesce(end, t) >= s)


def preservation(lanes: DataFrame, fused: DataFrame, intervals: DataFrame, required: DataFrame, key: str, depth: int = 5) -> DataFrame:
    """``(key, eligible, relevant_rank, irrelevant_consensus)`` of each query of ``required``, (key, lane) rows.

    Eligible: every required lane has evidence within an interval among its first ``depth``. ``relevant_rank`` is the
    first fused rank within ``depth`` that has; a query that is eligible and has none was displaced. Irrelevant
    consensus: displaced, and the first fused result is one that both lanes brought.
    """
    spans = intervals.select(key, "s", "e")
    seen = lanes.where(F.col("rank") <= depth).join(spans, key).where(touches(F.col("ts"), F.col("end"), F.col("s"), F.col("e"))).select(key, "lane").distinct()
    need = required.select(key, "lane").distinct().join(seen.withColumn("_seen", F.lit(True)), [key, "lane"], "left").groupBy(key).agg(F.bool_and(F.coalesce("_seen", F.lit(False))).alias("eligible"))
    top = fused.where(F.col("fused_rank") <= depth)
    rank = top.join(spans, key).where(touches(F.col("ts"), F.col("end"), F.col("s"), F.col("e"))).groupBy(key).agg(F.min("fused_rank").alias("relevant_rank"))
    both = top.where("fused_rank = 1").select(key, (F.col("visual_rank").isNotNull() & F.col("speech_rank").isNotNull()).alias("_both"))
    j = need.join(rank, key, "left").join(both, key, "left")
    return j.select(key, "eligible", "relevant_rank", (F.col("eligible") & F.col("relevant_rank").isNull() & F.coalesce("_both", F.lit(False))).alias("irrelevant_consensus"))


def best_evidence(lanes: DataFrame, intervals: DataFrame, key: str) -> DataFrame:
    """``(key, lane, rank)``: the first rank of each lane within an interval."""
    j = lanes.join(intervals.select(key, "s", "e"), key).where(touches(F.col("ts"), F.col("end"), F.col("s"), F.col("e")))
    return j.groupBy(key, "lane").agg(F.min("rank").alias("rank"))


def demotions(lanes: DataFrame, fused: DataFrame, intervals: DataFrame, key: str, depth: int = 5) -> DataFrame:
    """``(key, lane, rank, fused_rank)``: a lane's best evidence within ``depth`` that fusion put beyond it."""
    b = best_evidence(lanes, intervals, key).where(F.col("rank") <= depth)
    sides = F.inline(F.array(*(F.struct(F.lit(x).alias("lane"), F.col(f"{x}_rank").alias("rank")) for x in ("visual", "speech"))))
    return b.join(fused.where(F.col("fused_rank") > depth).select(key, "fused_rank", sides), [key, "lane", "rank"]).select(key, "lane", "rank", "fused_rank")


def recall_or_ranking(lanes: DataFrame, fused: DataFrame, intervals: DataFrame, required: DataFrame, key: str, depth: int = 5) -> DataFrame:
    """``(key, outcome)``: whether fusion shows evidence within ``depth``, only ranks it too low, or a required lane never had it."""
    seen = best_evidence(lanes, intervals, key).select(key, "lane", F.lit(True).alias("_seen"))
    need = required.select(key, "lane").distinct().join(seen, [key, "lane"], "left").groupBy(key).agg(F.bool_and(F.coalesce("_seen", F.lit(False))).alias("_all"))
    top = fused.where(F.col("fused_rank") <= depth).join(intervals.select(key, "s", "e"), key).where(touches(F.col("ts"), F.col("end"), F.col("s"), F.col("e"))).select(key).distinct().withColumn("_top", F.lit(True))
    out = F.when(F.col("_top"), "success").when(F.col("_all"), "ranking_failure").otherwise("candidate_recall_failure")
    return need.join(top, key, "left").select(key, out.alias("outcome"))


#: Figures of question answering: (section, metric, rows that count, rows below the line), over the columns of scope_report.
_SCOPE = [
    ("scope_gate", "supported_question_recall", "supported AND allowed", "supported"), ("scope_gate", "supported_question_precision", "supported AND allowed", "allowed"),
    ("scope_gate", "false_scope_rejection_rate", "supported AND NOT allowed", "supported"), ("scope_gate", "out_of_scope_rejection_rate", "NOT supported AND NOT allowed", "NOT supported"),
    ("scope_gate", "unsafe_generation_rate", "NOT supported AND generated", "NOT supported"),
    ("core_qa", "evidence_recall_at_5", "core AND evidence", "core"), ("core_qa", "answer_correctness", "core AND answered AND correct", "core"), ("core_qa", "grounded_answer_rate", "core AND answered AND grounded", "core AND answered"),
    ("core_qa", "citation_recall", "core AND citations > 0", "core"), ("core_qa", "core_user_success_rate", "core AND answered AND correct AND grounded AND citations > 0", "core"), ("core_qa", "false_abstention_rate", "core AND NOT answered", "core"),
    ("unanswerable", "correct_abstention_rate", "hard AND NOT answered", "hard"), ("unanswerable", "false_answer_rate", "hard AND answered", "hard"),
]


def scope_report(reviews: DataFrame) -> DataFrame:
    """``(section, metric, value)`` over reviewed answers; a rate of nothing is 0.

    Columns: ``supported`` (the question is in scope), ``answerable``, ``allowed`` (the gate let it through),
    ``generated``, ``answered``, ``correct``, ``grounded``, ``evidence`` (retrieved within five), ``citations``,
    ``valid_citations``. Unknown flags count as false. Core questions are in scope and answerable, hard ones in scope only.
    """
    flags = ["supported", "answerable", "allowed", "generated", "answered", "correct", "grounded", "evidence"]
    r = reviews.select(*(F.coalesce(F.col(c), F.lit(False)).alias(c) for c in flags), F.coalesce("citations", F.lit(0)).alias("citations"), F.coalesce("valid_citations", F.lit(0)).alias("valid_citations"))
    r = r.withColumns({"core": F.col("supported") & F.col("answerable"), "hard": F.col("supported") & ~F.col("answerable")})
    n = lambda c: F.count(F.when(F.expr(c), 1))
    rows = [F.struct(F.lit(s).alias("section"), F.lit(m).alias("metric"), F.coalesce(ratio(n(a), n(b)), F.lit(0.0)).alias("value")) for s, m, a, b in _SCOPE]
    valid = F.coalesce(ratio(F.sum(F.when(F.col("core"), F.col("valid_citations"))), F.sum(F.when(F.col("core"), F.col("citations")))), F.lit(0.0))
    return r.agg(F.array(*rows, F.struct(F.lit("core_qa").alias("section"), F.lit("citation_precision").alias("metric"), valid.alias("value"))).alias("x")).select(F.inline("x"))


def evidence_classes(assessed: DataFrame, step: str, kind: str, seen: list[str]) -> DataFrame:
    """``(step, class, events, share, recall)``: classes of evidence of each sampling step; ``recall`` is the share of ``seen`` classes."""
    n = assessed.groupBy(step).agg(F.count("*").alias("_n"), share(F.col(kind).isin(seen)).alias("recall"))
    c = assessed.groupBy(step, F.col(kind).alias("class")).agg(F.count("*").alias("events"))
    return c.join(n, step).select(step, "class", "events", (F.col("events") / F.col("_n")).alias("share"), "recall")


def detector_recall(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Over frames verified as ``visibility`` = visible: how many, those ``detected``, and mean confidence and box area of hits."""
    hit = F.coalesce(F.col("detected"), F.lit(False))
    v = rows.where("visibility = 'visible'").groupBy(*keys)
    return v.agg(F.count("*").alias("visible"), F.count(F.when(hit, 1)).alias("detected"), share(hit).alias("recall"), F.avg(F.when(hit, F.col("confidence"))).alias("mean_confidence"), F.avg(F.when(hit, F.col("area"))).alias("mean_area"))


def cost_rollup(usage: DataFrame, keys: list[str], input_price: float, output_price: float, hours: Column) -> DataFrame:
    """Tokens and cost (prices are for a million tokens) of calls ``(input_tokens, output_tokens)``, for each call and hour of media."""
    t = lambda c: F.coalesce(F.sum(F.coalesce(F.col(c), F.lit(0))), F.lit(0))
    g = usage.groupBy(*keys).agg(F.count("*").alias("calls"), t("input_tokens").alias("input_tokens"), t("output_tokens").alias("output_tokens"), hours.alias("_hours"))
    cost = (F.col("input_tokens") * input_price + F.col("output_tokens") * output_price) / 1_000_000
    return g.withColumn("cost", cost).select(*keys, "calls", "input_tokens", "output_tokens", "cost", ratio(F.col("cost"), F.col("calls")).alias("cost_per_call"), ratio(F.col("cost"), F.col("_hours")).alias("cost_per_hour"))


def audit(lines: DataFrame, reviewed: DataFrame, keys: list[str], text: str, verdict: str, false: str) -> DataFrame:
    """One row: reviewed lines, false ones, their rate, and what makes the audit void: lines not reviewed, reviews without
    a line, and reviews of another text. The rate is null while one of these isn't 0."""
    a = lines.select(*keys, F.col(text).alias("_a"), F.lit(True).alias("_l"))
    b = reviewed.select(*keys, F.col(text).alias("_b"), F.col(verdict).alias("_v"), F.lit(True).alias("_r"))
    j = a.join(b, keys, "full")
    n = lambda c: F.count(F.when(c, 1))
    g = j.agg(n(F.col("_r")).alias("reviewed"), n(F.col("_v") == false).alias("false_lines"), n(F.col("_r").isNull()).alias("missing"), n(F.col("_l").isNull()).alias("unknown"), n(F.col("_l") & F.col("_r") & ~F.col("_a").eqNullSafe(F.col("_b"))).alias("changed"))
    return g.withColumn("false_rate", F.when(F.col("missing") + F.col("unknown") + F.col("changed") == 0, ratio(F.col("false_lines"), F.col("reviewed"))))
