"""Features, thresholds, rules and models over the test tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuelake.operators import calibrate as cb
from cuelake.operators import fusion, search
from cuelake.operators import features as ft
from cuelake.operators import vectors
from cuelake.operators.text import SQL_TOKENS, sql_bm25, tokens
from cuelake.plans.common import Registry
from cuelake.plans.evaluation import CAL, KEY, LABELLED, POS, RES, VIEWS, calibrated, labelled, results
from cuelake.plans.retrieval import LANE_VIEWS, with_lanes
from cuelake.sources import views

query = Registry()
QUERIES, SQL = query.queries, query.sql

BEST = f"WITH {RES}, best AS (SELECT r.query_id, q.query_type, q.{POS} AS positive, max(r.score) AS score FROM res r JOIN qry q USING (query_id) GROUP BY ALL)"


def best(spark, d):
    """The best score of each query that has candidates, and whether it has an answer."""
    q = views.queries(spark, d).select(KEY, "query_type", F.expr(POS).alias("positive"))
    return results(spark, d).join(q, KEY).groupBy(KEY, "query_type", "positive").agg(F.max("score").alias("score"))


@query("c01_above_negatives", VIEWS, BEST + " SELECT max(score) AS cutoff FROM best WHERE NOT positive")
def above_negatives(spark, d):
    return cb.above_negatives(best(spark, d), [], "score", ~F.col("positive"))


@query("c02_bounded_alarms", VIEWS, BEST + ", r AS (SELECT score, row_number() OVER (ORDER BY score DESC) AS i, count(*) OVER () AS n FROM best WHERE NOT positive) SELECT coalesce(max(score) FILTER (i = CAST(floor(0.1e0 * n) AS BIGINT) + 1), '-inf'::DOUBLE) AS cutoff FROM r")
def bounded_alarms(spark, d):
    return cb.bounded_alarms(best(spark, d).where("NOT positive"), "score", 0.1)


RATES = """, c AS (SELECT score AS value, count(*) FILTER (positive) AS p, count(*) AS m FROM best GROUP BY 1),
r AS (SELECT value, sum(p) OVER w AS ap, sum(m - p) OVER w AS an, sum(p) OVER () AS pos, sum(m - p) OVER () AS neg FROM c WINDOW w AS (ORDER BY value DESC ROWS UNBOUNDED PRECEDING)),
t AS (SELECT value, 1 - ap / CAST(greatest(pos, 1) AS DOUBLE) AS pfa, an / CAST(greatest(neg, 1) AS DOUBLE) AS far FROM r)"""


@query("c03_best_threshold", VIEWS, BEST + RATES + " SELECT value AS threshold, round(pfa, 6) AS false_abstention, round(far, 6) AS false_alarm FROM t WHERE far <= 0.1e0 ORDER BY pfa, far, value DESC LIMIT 1")
def best_threshold(spark, d):
    t = cb.best_threshold(best(spark, d), "score", "positive", 0.1)
    return t.select("threshold", F.round("false_abstention", 6).alias("false_abstention"), F.round("false_alarm", 6).alias("false_alarm"))


@query("c03_rates", VIEWS, BEST + RATES + " SELECT value, round(pfa, 6) AS false_abstention, round(far, 6) AS false_alarm FROM t")
def rates(spark, d):
    r = cb.threshold_rates(best(spark, d), "score", "positive")
    return r.select("value", F.round(1 - F.col("accepted_positive") / F.greatest("positives", F.lit(1)), 6).alias("false_abstention"), F.round(F.col("accepted_negative") / F.greatest("negatives", F.lit(1)), 6).alias("false_alarm"))


@query("c04_midpoints", VIEWS, BEST + ", v AS (SELECT DISTINCT score FROM best) SELECT round(threshold, 9) AS threshold FROM (SELECT (score + lead(score) OVER (ORDER BY score)) / 2 AS threshold FROM v UNION ALL SELECT min(score) - 1e-9 FROM v UNION ALL SELECT max(score) + 1e-9 FROM v) x WHERE threshold IS NOT NULL")
def midpoints(spark, d):
    return cb.midpoints(best(spark, d), "score").select(F.round("threshold", 9).alias("threshold"))


#: A grid of thresholds for rules of one and two features; fixed in number, so rules meet rows in a bounded product.
GRID = [i / 10 for i in range(0, 11)]
FEATS = f"WITH {RES}, x AS (SELECT query_id, max(score) AS best, max(score) - coalesce(max(score) FILTER (rank = 2), max(score)) AS margin FROM res GROUP BY 1), f AS (SELECT x.*, q.{POS} AS positive FROM x JOIN qry q USING (query_id))"


def feats(spark, d):
    x = results(spark, d).groupBy(KEY).agg(F.max("score").alias("best"), (F.max("score") - F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("score"))), F.max("score"))).alias("margin"))
    return x.join(views.queries(spark, d).select(KEY, F.expr(POS).alias("positive")), KEY)


RULES = f", g AS (SELECT unnest({GRID}::DOUBLE[]) AS t), u AS (SELECT a.t AS a, b.t / 10 AS b FROM g a, g b), r AS (SELECT a, b, count(*) FILTER (positive AND best >= a AND margin >= b) AS ap, count(*) FILTER (NOT positive AND best >= a AND margin >= b) AS an, count(*) FILTER (positive) AS p, count(*) FILTER (NOT positive) AS n FROM f, u GROUP BY ALL), e AS (SELECT a, b, 1 - ap / CAST(greatest(p, 1) AS DOUBLE) AS pfa, an / CAST(greatest(n, 1) AS DOUBLE) AS far FROM r)"


def rule_errors(spark, d):
    """Errors of every rule ``best >= a and margin >= b`` of the grid, counted in one pass with map-side sums."""
    f = feats(spark, d)
    u = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b / 10).alias("b")) for a in GRID for b in GRID)))
    x = f.select("positive", "best", "margin", u.alias("u")).select("positive", "u.*", ((F.col("best") >= F.col("u.a")) & (F.col("margin") >= F.col("u.b"))).alias("yes"))
    n = lambda c: F.count(F.when(c, 1))
    p, yes = F.col("positive"), F.col("yes")
    g = x.groupBy("a", "b").agg((1 - n(p & yes) / F.greatest(n(p), F.lit(1))).alias("pfa"), (n(~p & yes) / F.greatest(n(~p), F.lit(1))).alias("far"))
    return g


@query("c05_rule_search", VIEWS, FEATS + RULES + " SELECT a, b, round(pfa, 6) AS pfa, round(far, 6) AS far FROM e WHERE far <= 0.5e0 ORDER BY pfa, far, a DESC, b DESC LIMIT 1")
def rule_search(spark, d):
    """The best rule of a fixed grid of thresholds, which the SQL can compare; c05_rule_search_whole is exhaustive."""
    e = rule_errors(spark, d).where("far <= 0.5").orderBy("pfa", "far", F.desc("a"), F.desc("b")).limit(1)
    return e.select("a", "b", F.round("pfa", 6).alias("pfa"), F.round("far", 6).alias("far"))


@query("c05_rule_search_whole")
def rule_search_whole(spark, d):
    """The best rule of best, margin or both over all midpoints of their values, with at most half false alarms.

    Rows are counted by distinct pair of values first; one task then searches the pairs in n log n steps.
    """
    g = feats(spark, d).groupBy("margin", "best").agg(F.sum(F.col("positive").cast("bigint")).alias("p"), F.sum((~F.col("positive")).cast("bigint")).alias("n"))

    def run(batches):
        rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))]
        found = cb.rule_search([(x, y, p or 0, n or 0) for x, y, p, n in rows], ("best", "margin"), 0.5) if rows else None
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(found, (pa.string(), pa.float64()) * 2 + (pa.float64(),) * 2)], ["feature", "threshold", "feature_2", "threshold_2", "pfa", "far"])

    out = g.select("best", "margin", "p", "n").repartition(1).mapInArrow(run, "feature string, threshold double, feature_2 string, threshold_2 double, pfa double, far double")
    return out.withColumns({c: F.round(c, 6) for c in ("pfa", "far")})


@query("c06_apply_rule", VIEWS, FEATS + " SELECT query_id, best >= 0.3e0 AND margin >= 0.01e0 AS accepted FROM f")
def apply_rule(spark, d):
    return feats(spark, d).select(KEY, ((F.col("best") >= 0.3) & (F.col("margin") >= 0.01)).alias("accepted"))


@query("c07_distribution", VIEWS, FEATS + " SELECT positive, count(*) AS n, round(avg(best), 6) AS mean, round(stddev_pop(best), 6) AS std, round(min(margin), 6) AS least_margin, round(max(margin), 6) AS most_margin FROM f GROUP BY 1")
def distribution(spark, d):
    return feats(spark, d).groupBy("positive").agg(F.count("*").alias("n"), F.round(F.avg("best"), 6).alias("mean"), F.round(F.stddev_pop("best"), 6).alias("std"), F.round(F.min("margin"), 6).alias("least_margin"), F.round(F.max("margin"), 6).alias("most_margin"))


@query("c08_logistic")
def logistic(spark, d):
    """A logistic model of relevance from score and rank, fitted and applied."""
    return _fit(spark, d, False)


@query("c09_balanced_logistic")
def balanced_logistic(spark, d):
    return _fit(spark, d, True)


def _fit(spark, d, balanced):
    x = labelled(spark, d).withColumn("inverse_rank", 1 / F.col("rank"))
    m = cb.newton_logistic(x, ["score", "inverse_rank"], "y", balanced=balanced)
    return spark.createDataFrame([(n, float(w)) for n, w in zip(["bias", "score", "inverse_rank"], [m["bias"], *m["weights"]])], "feature string, weight double")


@query("c13_leave_one_out", VIEWS, BEST + """, g AS (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS t), folds AS (SELECT DISTINCT query_type AS fold FROM best),
s AS (SELECT f.fold, g.t, avg(CAST((b.score >= g.t) = b.positive AS INT)) AS acc FROM folds f, g, best b WHERE b.query_type <> f.fold GROUP BY ALL),
p AS (SELECT fold, t FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY round(acc, 9) DESC, t) AS r FROM s) x WHERE r = 1)
SELECT p.fold, CAST(p.t AS DOUBLE) AS threshold, round(avg(CAST((b.score >= p.t) = b.positive AS INT)), 6) AS accuracy FROM p JOIN best b ON b.query_type = p.fold GROUP BY ALL""")
def leave_one_out(spark, d):
    """For each held-out type, the threshold that does best on the others, and how it does on the one left out.

    Hits of each type and threshold are counted once; a fold's figure is the total less its own.
    """
    b = best(spark, d).withColumn("t", F.explode(F.array(*(F.lit(i / 10) for i in range(1, 10)))))
    per = b.groupBy("query_type", "t").agg(F.sum(((F.col("score") >= F.col("t")) == F.col("positive")).cast("int")).alias("hit"), F.count("*").alias("n"))
    w = W.partitionBy("t")
    other = per.withColumns({"oh": F.sum("hit").over(w) - F.col("hit"), "on": F.sum("n").over(w) - F.col("n")})
    r = F.row_number().over(W.partitionBy("query_type").orderBy(F.desc(F.round(F.col("oh") / F.col("on"), 9)), "t"))
    return other.withColumn("r", r).where("r = 1").select(F.col("query_type").alias("fold"), F.col("t").alias("threshold"), F.round(F.col("hit") / F.col("n"), 6).alias("accuracy"))


GATES = f"{CAL}, m AS (SELECT avg(CASE WHEN positive THEN CAST(accepted AND coalesce(first_rank <= 5, false) AS INT) END) AS recall, avg(CASE WHEN positive THEN 1 - CAST(accepted AS INT) END) AS fab, avg(CASE WHEN NOT positive THEN CAST(accepted AS INT) END) AS far FROM cal)"


@query("c17_gates", VIEWS, GATES + " SELECT 'recall' AS gate, round(recall, 6) AS value, recall >= 0.5 AS passed FROM m UNION ALL SELECT 'false_abstention', round(fab, 6), fab <= 0.5 FROM m UNION ALL SELECT 'false_alarm', round(far, 6), far <= 0.1 FROM m")
def gates(spark, d):
    """One row a gate: its figure and whether it passes."""
    yes, pos = F.col("accepted"), F.col("positive")
    m = calibrated(spark, d).agg(
        F.avg(F.when(pos, (yes & F.coalesce(F.col("first_rank") <= 5, F.lit(False))).cast("int"))).alias("recall"), F.avg(F.when(pos, 1 - yes.cast("int"))).alias("fab"), F.avg(F.when(~pos, yes.cast("int"))).alias("far"))
    g = lambda n, c, ok: F.struct(F.lit(n).alias("gate"), F.round(c, 6).alias("value"), ok.alias("passed"))
    return m.select(F.inline(F.array(g("recall", "recall", F.col("recall") >= 0.5), g("false_abstention", "fab", F.col("fab") <= 0.5), g("false_alarm", "far", F.col("far") <= 0.1))))


@query("c18_regressions", VIEWS, f"""WITH {RES}, a AS (SELECT query_type AS k, avg(score) AS mean_score, max(score) - min(score) AS spread FROM res JOIN qry USING (query_id) WHERE rank <= 5 GROUP BY 1), b AS (SELECT query_type AS k, avg(score) AS mean_score, max(score) - min(score) AS spread FROM res JOIN qry USING (query_id) WHERE rank <= 10 GROUP BY 1)
SELECT k, 'mean_score' AS metric, round(a.mean_score, 6) AS base, round(b.mean_score, 6) AS new FROM a JOIN b USING (k) WHERE a.mean_score - b.mean_score > 0.001 UNION ALL SELECT k, 'spread', round(a.spread, 6), round(b.spread, 6) FROM a JOIN b USING (k) WHERE b.spread - a.spread > 0.001""")
def regressions(spark, d):
    r = results(spark, d).join(views.queries(spark, d).select(KEY, F.col("query_type").alias("k")), KEY)
    side = lambda n: r.where(F.col("rank") <= n).groupBy("k").agg(F.avg("score").alias("mean_score"), (F.max("score") - F.min("score")).alias("spread"))
    x = cb.regressions(side(5), side(10), "k", {"mean_score": 1, "spread": -1}, 0.001)
    return x.select("k", "metric", F.round("base", 6).alias("base"), F.round("new", 6).alias("new"))


@query("c19_accepted_results", LANE_VIEWS, with_lanes(", md AS (SELECT query_id, unnest(evaluation_modes) AS mode FROM qry), al AS (SELECT query_id, lane AS mode, rank, CASE WHEN lane = 'visual' THEN score END AS visual, lane = 'speech' AS spoken FROM lanes UNION ALL SELECT f.query_id, 'hybrid', fused_rank, v.score, f.speech_rank IS NOT NULL FROM fused f LEFT JOIN (SELECT query_id, rank, score FROM lanes WHERE lane = 'visual') v ON v.query_id = f.query_id AND v.rank = f.visual_rank) SELECT DISTINCT query_id, mode, rank FROM al JOIN md USING (query_id, mode) WHERE spoken OR visual >= 0.3e0"))
def accepted_results(spark, d):
    """Results of each way that a query is evaluated in: speech rows all pass, visual ones by cutoff, fused ones that speech backs or whose visual evidence passes."""
    lanes = search.lanes(spark, d)
    visual = lanes.where("lane = 'visual'").select(KEY, F.col("rank").alias("visual_rank"), F.col("score").alias("v"))
    one = lanes.select(KEY, F.col("lane").alias("mode"), "rank", "score", F.create_map("lane", "score").alias("evidence"))
    f = fusion.fuse(lanes, [KEY]).join(visual, [KEY, "visual_rank"], "left")
    ev = F.map_filter(F.create_map(F.lit("visual"), F.col("v"), F.lit("speech"), F.when(F.col("speech_rank").isNotNull(), 1.0)), lambda k, x: x.isNotNull())
    both = f.select(KEY, F.lit("hybrid").alias("mode"), F.col("fused_rank").alias("rank"), "score", ev.alias("evidence"))
    modes = views.queries(spark, d).select(KEY, F.explode("evaluation_modes").alias("mode"))
    x = one.unionByName(both).join(modes, [KEY, "mode"])
    return x.where(cb.accepted(F.col("mode"), F.col("score"), F.col("evidence"), 0.3)).select(KEY, "mode", "rank").distinct()


CF = f"""WITH {RES}, en AS (SELECT vec_id AS en, CAST(embedding AS DOUBLE[]) AS v, count(*) OVER () AS c FROM embeddings), r20 AS (SELECT r.*, p.candidate_id FROM res r JOIN pool p USING (query_id, video_id, rank) WHERE r.rank <= 20),
f AS (SELECT query_id, video_id, rank, ts, score, v, avg(score) OVER w AS m, stddev_pop(score) OVER w AS sd, min(score) OVER w AS lo, max(score) OVER w AS hi, max(score) FILTER (rank = 2) OVER w AS sec, count(*) OVER w AS n, lag(score) OVER o AS bef, lead(score) OVER o AS nxt FROM r20 JOIN en ON en.en = candidate_id % en.c WINDOW w AS (PARTITION BY query_id), o AS (PARTITION BY query_id ORDER BY rank))"""
CV = """, tm AS (SELECT a.query_id, a.rank, count(b.rank) FILTER (abs(a.ts - b.ts) <= 10.05e0) / CAST(greatest(count(b.rank), 1) AS DOUBLE) AS support, coalesce(min(abs(a.ts - b.ts)), 0) AS nearest FROM f a LEFT JOIN f b ON a.query_id = b.query_id AND a.rank <> b.rank GROUP BY ALL),
pr AS (SELECT a.query_id, a.rank, sum(list_dot_product(a.v, b.v)) AS total, sum(list_dot_product(a.v, b.v)) FILTER (b.rank = 1) AS first FROM f a JOIN f b ON a.query_id = b.query_id GROUP BY ALL),
cn AS (SELECT query_id, sqrt(sum(total)) AS len FROM pr GROUP BY 1)"""
KEYED = [KEY, "video_id"]


def twenty(spark, d):
    """The 20 best candidates of each query in its own video, with vectors that stand for their frames."""
    from cuelake.plans.questions import embedded

    return embedded(views.own_pool(spark, d, 20), spark, d, F.col("candidate_id"))


_CSQL = {
    "score_z": "(score - m) / greatest(sd, 1e-12)", "score_minmax": "(score - lo) / greatest(hi - lo, 1e-12)", "reciprocal_rank": "1e0 / rank", "log_rank": "1e0 / log2(rank + 1)", "gap_from_top": "hi - score",
    "gap_from_previous": "coalesce(bef - score, 0)", "gap_to_next": "coalesce(score - nxt, 0)", "top_two_gap": "coalesce(hi - sec, 0)", "list_mean": "m", "list_std": "sd", "list_range": "hi - lo",
    "temporal_support_10s": "support", "nearest_time_gap": "nearest", "top_frame_cosine": "first", "list_centroid_cosine": "total / greatest(len, 1e-12)",
}
TIGHT = {"list_mean", "mean"}


def rounded(columns):
    """Rounded for comparison; adding 0 makes a negative zero a zero."""
    return [(F.round(c, 9 if c in TIGHT else 6) + F.lit(0.0)).alias(c) for c in columns]


def temporal_trials(spark, d):
    """``(support, change, query_id, first)``: first relevant rank of each query when z plus weighted support and change orders its 20 best."""
    x = ft.candidate_features(twenty(spark, d), [KEY], "score", "rank", "ts").select(KEY, "rank", "ts", "score", "score_z", "temporal_support_10s")
    return cb.temporal_trials(x.join(changes(spark, d), [KEY, "rank"]), views.intervals(spark, d), [KEY], SUPPORT, CHANGE)


def changes(spark, d):
    """How much the frame behind each candidate differs from the next one; vectors stand for frames by id."""
    from cuelake.plans.questions import embedded

    p = results(spark, d).where("rank <= 20").select(KEY, "rank", "candidate_id")
    a = embedded(p, spark, d, F.col("candidate_id")).withColumnRenamed("embedding", "a")
    b = embedded(a, spark, d, F.col("candidate_id") + 1)
    return b.select(KEY, "rank", (1 - vectors.dot(F.col("a"), F.col("embedding"))).alias("change"))


SUPPORT, CHANGE = [-0.5, -0.25, 0.0, 0.25, 0.5], [-1.0, -0.5, 0.0, 0.5, 1.0]
TRIALS = CF + """, cg AS (SELECT r.query_id, r.rank, 1 - list_dot_product(a.v, b.v) AS change FROM r20 r JOIN en a ON a.en = r.candidate_id % a.c JOIN en b ON b.en = (r.candidate_id + 1) % b.c),
sp AS (SELECT a.query_id, a.rank, count(b.rank) FILTER (abs(a.ts - b.ts) <= 10.05e0) / CAST(greatest(count(b.rank), 1) AS DOUBLE) AS support FROM f a LEFT JOIN f b ON a.query_id = b.query_id AND a.rank <> b.rank GROUP BY ALL),
sw AS (SELECT unnest([-0.5e0, -0.25e0, 0e0, 0.25e0, 0.5e0]) AS sw), cw AS (SELECT unnest([-1e0, -0.5e0, 0e0, 0.5e0, 1e0]) AS cw),
o AS (SELECT f.query_id, sw, cw, f.ts, row_number() OVER (PARTITION BY f.query_id, sw, cw ORDER BY round((score - m) / greatest(sd, 1e-12) + sw * support + cw * change, 6) DESC, f.rank) AS pos FROM f JOIN sp USING (query_id, rank) JOIN cg USING (query_id, rank), sw, cw),
h AS (SELECT o.query_id, sw, cw, min(pos) AS first FROM o JOIN ivl i ON i.query_id = o.query_id AND o.ts BETWEEN i.s AND i.e GROUP BY ALL),
tr AS (SELECT sw AS support_weight, cw AS change_weight, count(*) FILTER (first <= 5) AS r5, count(*) FILTER (first = 1) AS r1, sum(CASE WHEN first <= 5 THEN 1e0 / first ELSE 0 END) AS mrr FROM h GROUP BY ALL)"""


@query("c14_weight_grid", VIEWS, TRIALS + " SELECT support_weight, change_weight, r5, r1, round(mrr, 6) AS mrr FROM tr ORDER BY r5 DESC, r1 DESC, round(mrr, 9) DESC, abs(support_weight), abs(change_weight), support_weight, change_weight LIMIT 1")
def weight_grid(spark, d):
    """Weights of temporal support and visual change by which reranking finds most: hits at 5, at 1, reciprocal ranks, then the weights nearest to 0."""
    t = cb.trial_scores(temporal_trials(spark, d), ["support_weight", "change_weight"], "first", 5)
    return cb.best_trial(t, ["r5", "r1", "mrr"], ["support_weight", "change_weight"]).select("support_weight", "change_weight", "r5", "r1", F.round("mrr", 6).alias("mrr"))


FALL = [0.0, 0.45, 0.55, 0.65, 0.75]


def _fall_sql():
    from cuelake.plans.retrieval import LANES
    from cuelake.plans.routing import FEATS, LOGITS

    rest = LANES + ", "
    return FEATS + LOGITS + ", " + rest + """rt AS (SELECT query_id, CASE WHEN z0 >= greatest(z1, z2) THEN 'visual' WHEN z1 >= z2 THEN 'speech' ELSE 'hybrid' END AS route, 1 / (exp(z0 - greatest(z0, z1, z2)) + exp(z1 - greatest(z0, z1, z2)) + exp(z2 - greatest(z0, z1, z2))) AS sure FROM l WHERE form = 0),
fi AS (SELECT query_id, lane AS route, min(rank) AS first FROM (SELECT query_id, lane, rank, ts FROM lanes UNION ALL SELECT query_id, 'hybrid', fused_rank, ts FROM fused) x JOIN ivl i USING (query_id) WHERE x.ts BETWEEN i.s AND i.e GROUP BY ALL),
th AS (SELECT unnest([0e0, 0.45e0, 0.55e0, 0.65e0, 0.75e0]) AS threshold), ch AS (SELECT q.query_id, threshold, CASE WHEN round(sure, 9) < threshold THEN 'hybrid' ELSE route END AS route, CASE q.modality_requirement WHEN 'temporal' THEN 'visual' ELSE q.modality_requirement END AS target FROM qry q JOIN rt USING (query_id), th WHERE """ + POS + """),
tr AS (SELECT threshold, count(*) FILTER (first <= 5) AS r5, count(*) FILTER (first = 1) AS r1, sum(CASE WHEN first <= 5 THEN 1e0 / first ELSE 0 END) AS mrr, count(*) FILTER (route = target) AS right_routes FROM ch LEFT JOIN fi USING (query_id, route) GROUP BY 1)
SELECT threshold, r5, r1, round(mrr, 6) AS mrr, right_routes FROM tr ORDER BY r5 DESC, r1 DESC, round(mrr, 9) DESC, right_routes DESC, threshold LIMIT 1"""


@query("c15_fallback_threshold", LANE_VIEWS + " ivl", _fall_sql())
def fallback_threshold(spark, d):
    """The confidence below which a query is searched both ways: most found at 5, at 1, reciprocal ranks, then routes that are right, then the least."""
    from cuelake.operators import routing as rt

    lanes = search.lanes(spark, d)
    both = lanes.select(KEY, F.col("lane").alias("route"), "rank", "ts").unionByName(fusion.fuse(lanes, [KEY]).select(KEY, F.lit("hybrid").alias("route"), F.col("fused_rank").alias("rank"), "ts"))
    first = both.join(views.intervals(spark, d), KEY).where(F.col("ts").between(F.col("s"), F.col("e"))).groupBy(KEY, "route").agg(F.min("rank").alias("first"))
    route, sure = rt.route(rt.route_features(F.col("query_text")))
    m = F.col("modality_requirement")
    q = views.queries(spark, d).where(POS).select(KEY, route.alias("said"), F.round(sure, 9).alias("sure"), F.when(m == "temporal", "visual").otherwise(m).alias("target"))
    q = q.withColumn("threshold", F.explode(F.array(*map(F.lit, FALL)))).withColumn("route", F.when(F.col("sure") < F.col("threshold"), "hybrid").otherwise(F.col("said")))
    t = cb.trial_scores(q.join(first, [KEY, "route"], "left"), ["threshold"], "first", 5, F.count(F.when(F.col("route") == F.col("target"), 1)).alias("right_routes"))
    return cb.best_trial(t, ["r5", "r1", "mrr", "right_routes"], ["threshold"]).select("threshold", "r5", "r1", F.round("mrr", 6).alias("mrr"), "right_routes")


@query("c16_choice", VIEWS + " vid", f"WITH {RES}, cfg AS (SELECT * FROM (VALUES ('4/2/8', 2e0, 8), ('8/4/8', 4e0, 8)) t(config, grid, frames)), w AS (SELECT DISTINCT config, r.query_id, r.rank, round(r.ts / grid) * grid AS ts FROM res r, cfg WHERE r.rank <= 10), f AS (SELECT config, w.query_id, min(w.rank) AS first FROM w JOIN ivl i ON i.query_id = w.query_id AND w.ts BETWEEN i.s AND i.e GROUP BY ALL), cost AS (SELECT config, sum(floor(duration_s / grid) * frames) AS cost FROM (SELECT video_id, max(duration_s) AS duration_s FROM vid WHERE isfinite(duration_s) GROUP BY 1) v, cfg GROUP BY 1), t AS (SELECT c.config, count(*) FILTER (first <= 5) AS r5, count(*) FILTER (first <= 5 AND query_type = 'ACTION_TEMPORAL') AS temporal_r5 FROM cfg c LEFT JOIN f USING (config) LEFT JOIN qry USING (query_id) GROUP BY 1) SELECT config, r5, temporal_r5, cost FROM t JOIN cost USING (config) ORDER BY r5 DESC, temporal_r5 DESC, cost, config LIMIT 1")
def choice(spark, d):
    """Of two configurations (window, stride, frames) the one of most hits at 5, then among queries of time, then of least cost.

    A configuration snaps the times of candidates to its stride; its cost is the number of frames it encodes.
    """
    c = spark.createDataFrame([("4/2/8", 2.0, 8), ("8/4/8", 4.0, 8)], "config string, grid double, frames int")
    w = results(spark, d).where("rank <= 10").crossJoin(F.broadcast(c)).withColumn("ts", F.round(F.col("ts") / F.col("grid")) * F.col("grid"))
    first = w.join(views.intervals(spark, d), KEY).where(F.col("ts").between(F.col("s"), F.col("e"))).groupBy("config", KEY).agg(F.min("rank").alias("first"))
    v = views.videos(spark, d).where(F.abs("duration_s") < float("inf")).groupBy("video_id").agg(F.max("duration_s").alias("duration_s"))
    cost = v.crossJoin(F.broadcast(c)).groupBy("config").agg(F.sum(F.floor(F.col("duration_s") / F.col("grid")) * F.col("frames")).cast("double").alias("cost"))
    j = first.join(views.queries(spark, d).select(KEY, "query_type"), KEY)
    n = lambda x: F.count(F.when(x, 1))
    top = F.col("first") <= 5
    t = j.groupBy("config").agg(n(top).alias("r5"), n(top & (F.col("query_type") == "ACTION_TEMPORAL")).alias("temporal_r5"))
    t = c.select("config").join(t, "config", "left").na.fill(0).join(cost, "config")
    return t.orderBy(F.desc("r5"), F.desc("temporal_r5"), "cost", "config").limit(1)


@query("m01_candidate_features", VIEWS, CF + CV + " SELECT query_id, rank, " + ", ".join(f"round({e}, {9 if c in TIGHT else 6}) + 0e0 AS {c}" for c, e in _CSQL.items()) + " FROM f JOIN tm USING (query_id, rank) JOIN pr USING (query_id, rank) JOIN cn USING (query_id) WHERE sd > 1e-6 OR n = 1")
def candidate_features(spark, d):
    """Lists of one, and those with spread, which the SQL can compare; m01_candidate_features_whole has all."""
    x = ft.candidate_features(twenty(spark, d), [KEY], "score", "rank", "ts", "embedding")
    n = F.count("*").over(W.partitionBy(KEY))
    return x.withColumn("n", n).where((F.col("list_std") > 1e-6) | (F.col("n") == 1)).select(KEY, "rank", *rounded(ft.CANDIDATE))


@query("m01_candidate_features_whole")
def candidate_features_whole(spark, d):
    """The features of all candidates, those of lists without spread too."""
    x = ft.candidate_features(twenty(spark, d), [KEY], "score", "rank", "ts", "embedding")
    return x.select(KEY, "rank", *rounded(ft.CANDIDATE))


@query("m02_list_features", VIEWS, CF + CV + """, p AS (SELECT *, exp(score - hi) / sum(exp(score - hi)) OVER (PARTITION BY query_id) AS p FROM f)
SELECT query_id, round(max(score), 6) AS best_score, round(coalesce(max(hi - sec), 0), 6) AS top_two_gap, round(max(score) - min(score) FILTER (rank <= 5), 6) AS top_five_gap, round(max(m), 9) AS mean, round(max(sd), 6) AS std, round(max(hi - lo), 6) AS range, round((0e0 - sum(p * ln(p + 1e-15))) / greatest(ln(count(*)), 1), 6) AS entropy,
round(max(support) FILTER (rank = 1), 6) AS temporal_support_10s, round(max(total / greatest(len, 1e-12)) FILTER (rank = 1), 6) AS top_frame_centroid_cosine, round(avg(CAST(score >= m + sd AS INT)), 6) AS positive_tail_fraction, round(ln(1 + count(*)), 6) AS candidate_count_log
FROM p JOIN tm USING (query_id, rank) JOIN pr USING (query_id, rank) JOIN cn USING (query_id) WHERE n > 2 GROUP BY query_id""")
def list_features(spark, d):
    """Lists of three and more candidates, which the SQL can compare; m02_list_features_whole has all."""
    x = twenty(spark, d).withColumn("n", F.count("*").over(W.partitionBy(KEY))).where("n > 2")
    return ft.list_features(x, [KEY], "score", "rank", "ts", "embedding").select(KEY, *rounded(ft.LIST))


@query("m02_list_features_whole")
def list_features_whole(spark, d):
    """The features of all lists, those of one and two candidates too."""
    return ft.list_features(twenty(spark, d), [KEY], "score", "rank", "ts", "embedding").select(KEY, *rounded(ft.LIST))


@query("m03_inference", VIEWS, f"WITH {RES} SELECT query_id, rank, round(1 / (1 + exp(-greatest(least(-1e0 + (score - 0.2e0) / 0.5e0 * 1.5e0 + (1e0 / rank - 0.1e0) / 0.3e0 * 0.7e0, 40), -40))), 9) AS p FROM res WHERE rank <= 20")
def inference(spark, d):
    p = ft.logistic([F.col("score"), 1 / F.col("rank")], [0.2, 0.1], [0.5, 0.3], [1.5, 0.7], -1.0)
    return results(spark, d).where("rank <= 20").select(KEY, "rank", F.round(p, 9).alias("p"))


@query("f11_learned_rerank", VIEWS, CF + ", p AS (SELECT query_id, rank, score, 1 / (1 + exp(-(-1e0 + (score - 0.2e0) / 0.5e0 * 1.5e0 + (1e0 / rank - 0.1e0) / 0.3e0 * -0.7e0))) AS p FROM f) SELECT query_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY round(p, 9) DESC, score DESC, rank) AS new_rank FROM p")
def learned_rerank(spark, d):
    p = ft.logistic([F.col("score"), 1 / F.col("rank")], [0.2, 0.1], [0.5, 0.3], [1.5, -0.7], -1.0)
    x = results(spark, d).where("rank <= 20").withColumn("p", p)
    r = F.row_number().over(W.partitionBy(KEY).orderBy(F.desc(F.round("p", 9)), F.desc("score"), "rank"))
    return x.select(KEY, "rank", r.cast("bigint").alias("new_rank"))


SUP = f", s AS (SELECT a.query_id, a.rank, count(b.rank) FILTER (abs(a.ts - b.ts) <= 10.05e0) / CAST(greatest(count(b.rank), 1) AS DOUBLE) AS support FROM res a LEFT JOIN res b ON a.query_id = b.query_id AND a.rank <> b.rank AND b.rank <= 20 WHERE a.rank <= 20 GROUP BY ALL)"


@query("f12_temporal_rerank", VIEWS, CF + SUP + " SELECT query_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY round((score - m) / greatest(sd, 1e-12) + 0.5e0 * support, 6) DESC, rank) AS new_rank FROM f JOIN s USING (query_id, rank)")
def temporal_rerank(spark, d):
    """z of the score plus the share of the list's other candidates near in time."""
    x = ft.candidate_features(results(spark, d).where("rank <= 20"), [KEY], "score", "rank", "ts")
    r = F.row_number().over(W.partitionBy(KEY).orderBy(F.desc(F.round(F.col("score_z") + 0.5 * F.col("temporal_support_10s"), 6)), "rank"))
    return x.select(KEY, "rank", r.cast("bigint").alias("new_rank"))


@query("m04_light_features", VIEWS, CF + " SELECT query_id, rank, round(score, 6) AS score, round(1e0 / rank, 6) AS reciprocal_rank, round(hi - score, 6) AS gap_from_top, round(coalesce(hi - sec, 0), 6) AS top_two_gap, round(m, 9) AS list_mean, round(sd, 6) AS list_std, round(hi - lo, 6) AS list_range FROM f")
def light_features(spark, d):
    x = ft.candidate_features(results(spark, d).where("rank <= 20"), [KEY], "score", "rank")
    return x.select(KEY, "rank", *rounded(["score", "reciprocal_rank", "gap_from_top", "top_two_gap", "list_mean", "list_std", "list_range"]))


@query("m05_robust_z", VIEWS, f"""WITH {RES}, q AS (SELECT query_id, median(score) AS m, quantile_cont(score, 0.75) - quantile_cont(score, 0.25) AS iqr FROM res WHERE rank <= 20 GROUP BY 1), x AS (SELECT *, max(score) OVER (PARTITION BY query_id) - score AS top, coalesce(score - lead(score) OVER (PARTITION BY query_id ORDER BY rank), 0) AS nxt FROM res WHERE rank <= 20)
SELECT query_id, rank, round(score, 6) AS raw_score, round(1e0 / rank, 6) AS reciprocal_rank, round(top, 6) AS margin_to_top, round(nxt, 6) AS margin_to_next, round((score - m) / greatest(iqr, 1e-9), 7) AS robust_z, round(ln(1 + len(regexp_extract_all(lower(replace(query_text, 'İ', 'i' || chr(775))), '[\\p{{L}}\\p{{N}}_]+'))), 6) AS log_query_tokens FROM x JOIN q USING (query_id) JOIN qry USING (query_id) WHERE iqr > 1e-6""")
def robust_z(spark, d):
    """The six features that scores are calibrated on; lists without spread are left out of the comparison: m05_robust_z_whole has all."""
    x = results(spark, d).where("rank <= 20")
    spread = x.groupBy(KEY).agg((F.percentile("score", 0.75) - F.percentile("score", 0.25)).alias("i")).where("i > 1e-6")
    return robust_z_whole(spark, d).join(spread, KEY, "left_semi")


@query("m05_robust_z_whole")
def robust_z_whole(spark, d):
    """The six features of all lists; a quartile range below 1e-9 counts as that."""
    x = results(spark, d).where("rank <= 20")
    n = F.size(F.regexp_extract_all(F.lower("query_text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
    q = views.queries(spark, d).select(KEY, F.round(F.log1p(n.cast("double")), 6).alias("log_query_tokens"))
    y = ft.candidate_features(ft.robust_z(x, [KEY], "score"), [KEY], "score", "rank").join(q, KEY)
    r6 = lambda c, a: F.round(c, 6).alias(a)
    return y.select(KEY, "rank", r6("score", "raw_score"), r6("reciprocal_rank", "reciprocal_rank"), r6("gap_from_top", "margin_to_top"), r6("gap_to_next", "margin_to_next"), F.round("robust_z", 7).alias("robust_z"), "log_query_tokens")


@query("m06_agreement", LANE_VIEWS, with_lanes(" SELECT query_id, thumbnail, bool_or(lane = 'visual') AS visual_present, bool_or(lane = 'speech') AS speech_present, count(*) = 2 AS cross_modal_present, CASE WHEN count(*) = 2 THEN round(max(ts) - min(ts), 6) END AS temporal_distance_seconds FROM buckets GROUP BY ALL"))
def agreement(spark, d):
    """Whether the lanes agree on a bucket, and how far apart in time their rows lie if both have it."""
    b = fusion.buckets(search.lanes(spark, d), [KEY])
    both = F.count("*") == 2
    return b.groupBy(KEY, "thumbnail").agg(F.bool_or(F.col("lane") == "visual").alias("visual_present"), F.bool_or(F.col("lane") == "speech").alias("speech_present"), both.alias("cross_modal_present"), F.when(both, F.round(F.max("ts") - F.min("ts"), 6)).alias("temporal_distance_seconds"))


@query("m07_visual_evidence", VIEWS, f"""WITH RECURSIVE {RES}, t AS (SELECT * FROM res WHERE rank <= 10), a AS (SELECT query_id, list(score ORDER BY rank)[1:5] AS a, list(ts ORDER BY rank) AS t FROM t GROUP BY 1),
e AS (SELECT *, list_transform(a, lambda x: exp((x - list_max(a)) / 0.02e0)) AS e FROM a), p AS (SELECT *, list_transform(e, lambda x: x / list_sum(e)) AS p FROM e),
g AS (SELECT query_id, 1 AS i, [t[1]] AS kept FROM a UNION ALL SELECT g.query_id, g.i + 1, CASE WHEN len(list_filter(kept, lambda y: abs(y - a.t[g.i + 1]) < 15)) > 0 THEN kept ELSE list_append(kept, a.t[g.i + 1]) END FROM g JOIN a USING (query_id) WHERE g.i < len(a.t)), k AS (SELECT query_id, max(len(kept)) AS kept FROM g GROUP BY 1)
SELECT query_id, round(a[1], 6) AS top1, round(a[1] - a[least(2, len(a))], 6) AS margin_1_2, round(a[1] - a[len(a)], 6) AS margin_1_5, round(list_avg(a), 9) AS mean_5, round(list_stddev_pop(a), 6) AS std_5, round(1 - (0e0 - list_sum(list_transform(p, lambda x: x * ln(x + 1e-12)))) / ln(greatest(2, len(a))), 6) AS entropy_strength,
round(len(list_filter(t, lambda x: abs(x - t[1]) <= 10)) / CAST(len(t) AS DOUBLE), 6) AS temporal_support, round(kept / CAST(len(t) AS DOUBLE), 6) AS separated_support FROM p JOIN k USING (query_id)""")
def visual_evidence(spark, d):
    x = ft.visual_evidence(results(spark, d), [KEY], "score", "rank", "ts")
    return x.select(KEY, *(F.round(c, 9 if c == "mean_5" else 6).alias(c) for c in x.columns if c != KEY))


@query("m08_speech_evidence", "seg qry", f"""WITH docs AS (SELECT video_id, segment_id, {SQL_TOKENS.format('text')} AS tokens FROM seg), asked AS (SELECT video_id, query_id, {SQL_TOKENS.format('query_text')} AS tokens FROM qry), {sql_bm25('docs', 'asked', 'video_id', 'segment_id', 'query_id')},
r AS (SELECT *, round(score, 9) AS sc, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, segment_id) AS rank FROM bm25 WHERE round(score, 9) > 0), per AS (SELECT query_id, max(sc) AS top1, max(sc) - coalesce(max(sc) FILTER (rank = 2), 0) AS margin, ln(1 + count(*)) AS matching, max(sc) / sum(sc) AS conc FROM r GROUP BY 1),
t AS (SELECT video_id, query_id, unnest(list_distinct(tokens)) AS term FROM asked), kn AS (SELECT DISTINCT video_id, unnest(tokens) AS term FROM docs), cov AS (SELECT t.query_id, count(kn.term) AS covered, count(*) AS n, count(*) FILTER (len(t.term) >= 6) AS long, count(kn.term) FILTER (len(t.term) >= 6) AS long_hit FROM t LEFT JOIN kn ON kn.video_id = t.video_id AND kn.term = t.term GROUP BY 1),
ot AS (SELECT video_id, query_id, list(term ORDER BY pos) AS ts FROM (SELECT video_id, query_id, term, min(pos) AS pos FROM (SELECT video_id, query_id, unnest(tokens) AS term, generate_subscripts(tokens, 1) AS pos FROM asked) x GROUP BY ALL) y GROUP BY ALL),
ap AS (SELECT video_id, query_id, unnest(list_transform(generate_series(1, len(ts) - 1), lambda i: ts[i] || ' ' || ts[i + 1])) AS pair FROM ot), dp AS (SELECT DISTINCT video_id, unnest(list_transform(generate_series(1, len(tokens) - 1), lambda i: tokens[i] || ' ' || tokens[i + 1])) AS pair FROM docs), ph AS (SELECT DISTINCT query_id FROM ap JOIN dp USING (video_id, pair)),
b AS (SELECT r.query_id, len(list_intersect(list_distinct(a.tokens), d.tokens)) AS top_hit FROM r JOIN docs d USING (video_id, segment_id) JOIN asked a USING (query_id) WHERE rank = 1)
SELECT q.query_id, round(coalesce(top1, 0), 6) AS top1, round(coalesce(margin, 0), 6) AS margin_1_2, round(coalesce(covered, 0) / CAST(greatest(coalesce(n, 0), 1) AS DOUBLE), 6) AS query_coverage, round(coalesce(top_hit, 0) / CAST(greatest(coalesce(n, 0), 1) AS DOUBLE), 6) AS top_segment_coverage, round(coalesce(matching, 0), 6) AS matching_segments, round(coalesce(conc, 0), 6) AS evidence_concentration,
CAST(ph.query_id IS NOT NULL AS DOUBLE) AS phrase_overlap, round(CASE WHEN long > 0 THEN long_hit / CAST(long AS DOUBLE) ELSE coalesce(covered, 0) / CAST(greatest(coalesce(n, 0), 1) AS DOUBLE) END, 6) AS technical_coverage FROM qry q LEFT JOIN per USING (query_id) LEFT JOIN cov USING (query_id) LEFT JOIN b USING (query_id) LEFT JOIN ph USING (query_id)""")
def speech_evidence(spark, d):
    from cuelake.plans.questions import lexical

    s = views.segments(spark, d)
    docs = s.select("video_id", "segment_id", tokens(F.col("text")).alias("tokens"))
    asked = views.queries(spark, d).select("video_id", KEY, tokens(F.col("query_text")).alias("tokens"))
    x = ft.speech_evidence(lexical(spark, d, s, "segment_id"), asked, docs, "video_id", KEY, "segment_id")
    return x.select(KEY, *(F.round(c, 6).alias(c) for c in x.columns if c != KEY))


@query("m10_training_matrix", VIEWS + " vid", LABELLED + " SELECT l.query_id, l.rank, l.score, l.y FROM lab l JOIN qry q USING (query_id) JOIN (SELECT DISTINCT video_id, split FROM vid) v ON v.video_id = q.video_id WHERE v.split = 'calibration'")
def training_matrix(spark, d):
    """Labelled rows to fit on: of the calibration split only, and the plan fails on any other."""
    v = views.videos(spark, d).select("video_id", "split").distinct().where("split = 'calibration'")
    x = labelled(spark, d).join(views.queries(spark, d).select(KEY, "video_id"), KEY).join(v, "video_id")
    guard = F.assert_true(F.col("split") == "calibration", "a row of another split")
    return x.where(guard.isNull()).select(KEY, "rank", "score", "y")


@query("k14_next_above", VIEWS, BEST + " SELECT count(*) FILTER (score > c) AS accepted FROM best, (SELECT max(score) AS c FROM best WHERE NOT positive) x")
def next_above(spark, d):
    """Strictly above the greatest negative: the same as at or above the next greater double."""
    b = best(spark, d)
    return b.crossJoin(F.broadcast(cb.above_negatives(b, [], "score", ~F.col("positive")))).agg(F.count(F.when(F.col("score") > F.col("cutoff"), 1)).alias("accepted"))
