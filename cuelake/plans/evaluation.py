"""Metrics, grouped summaries and comparisons over the test tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuelake.operators import fusion, metrics, search
from cuelake.plans.common import Registry
from cuelake.plans.retrieval import LANE_VIEWS, with_lanes
from cuelake.sources import views
from cuelake.sources.tables import load

query = Registry()
QUERIES, SQL = query.queries, query.sql

KEY = "query_id"
POS = "query_type <> 'NEGATIVE'"
RES = "res AS (SELECT p.query_id, p.video_id, p.ts, p.score, p.rank FROM pool p JOIN qry q USING (query_id, video_id))"
FIRST = f"WITH {RES}, hit AS (SELECT r.query_id, min(r.rank) AS first_rank FROM res r JOIN ivl i ON i.query_id = r.query_id AND r.ts BETWEEN i.s AND i.e GROUP BY 1), fr AS (SELECT q.query_id, q.video_id, q.query_type, q.modality_requirement, h.first_rank FROM qry q LEFT JOIN hit h USING (query_id) WHERE {POS})"
VIEWS = "qry ivl cand pool"
FVIEWS = LANE_VIEWS + " ivl"


def results(spark, d):
    return views.own_pool(spark, d)


def positives(spark, d):
    return views.queries(spark, d).where(POS)


def first(spark, d):
    q = positives(spark, d)
    r = metrics.first_ranks(results(spark, d), views.intervals(spark, d), q, KEY)
    return q.select("query_id", "video_id", "query_type", "modality_requirement").join(r, KEY)


@query("a01_interval_metrics", VIEWS, f"""WITH {RES}, hits AS (SELECT r.query_id, r.rank, min(i.ord) AS ord FROM res r JOIN ivl i ON i.query_id = r.query_id AND r.ts >= i.s AND r.ts < i.e WHERE r.rank <= 5 GROUP BY ALL),
per AS (SELECT query_id, count(DISTINCT ord) AS m, min(rank) AS f FROM hits GROUP BY 1), n AS (SELECT query_id, count(*) AS n FROM ivl GROUP BY 1), ret AS (SELECT query_id, count(*) AS r FROM res WHERE rank <= 5 GROUP BY 1)
SELECT q.query_id, round(CASE WHEN n.n > 0 THEN coalesce(m, 0) / CAST(n.n AS DOUBLE) END, 6) AS recall, round(coalesce(m, 0) / 5e0, 6) AS precision, round(CASE WHEN n.n > 0 THEN coalesce(1e0 / f, 0) END, 6) AS reciprocal_rank, coalesce(r, 0) AS returned
FROM qry q LEFT JOIN n USING (query_id) LEFT JOIN per USING (query_id) LEFT JOIN ret USING (query_id)""")
def interval_metrics(spark, d):
    m = metrics.interval_scores(results(spark, d), views.intervals(spark, d), views.queries(spark, d), KEY, 5)
    return m.select(KEY, *(F.round(c, 6).alias(c) for c in ("recall", "precision", "reciprocal_rank")), F.col("returned").cast("bigint").alias("returned"))


@query("a02_first_rank", VIEWS, FIRST + " SELECT query_id, first_rank FROM fr")
def first_rank(spark, d):
    return first(spark, d).select(KEY, "first_rank")


_R = "count(*) AS n, " + ", ".join(f"round(avg(CASE WHEN first_rank <= {k} THEN 1e0 ELSE 0 END), 6) AS r_at_{k}" for k in (1, 3, 5, 10)) + ", round(avg(CASE WHEN first_rank <= 5 THEN 1e0 / first_rank ELSE 0 END), 6) AS mrr_at_5"


@query("a03_recall_mrr", VIEWS, FIRST + f" SELECT {_R} FROM fr")
def recall_mrr(spark, d):
    return first(spark, d).agg(*metrics.recalls("first_rank", [1, 3, 5, 10], 5))


def _sets(cols, agg, frm):
    return " UNION ALL ".join([f"SELECT 'all' AS by, 'all' AS value, {agg} FROM {frm}", *(f"SELECT '{c}', coalesce(CAST({c} AS VARCHAR), '(null)'), {agg} FROM {frm} GROUP BY {c}" for c in cols)])


@query("a04_grouped_summary", VIEWS, FIRST + " " + _sets(["query_type", "modality_requirement"], _R, "fr"))
def grouped_summary(spark, d):
    return metrics.grouped(first(spark, d), ["query_type", "modality_requirement"], metrics.recalls("first_rank", [1, 3, 5, 10], 5))


CAL = f"{FIRST}, cut AS (SELECT max(r.score) AS c FROM res r JOIN qry q USING (query_id) WHERE NOT ({POS})), best AS (SELECT query_id, max(score) AS s FROM res GROUP BY 1), cal AS (SELECT q.query_id, q.query_type, q.{POS} AS positive, f.first_rank, coalesce(b.s > c, false) AS accepted FROM qry q CROSS JOIN cut LEFT JOIN best b USING (query_id) LEFT JOIN fr f USING (query_id))"


def calibrated(spark, d):
    """Queries with whether their best score passes the cutoff above the best negative."""
    q = views.queries(spark, d).withColumn("positive", F.expr(POS))
    r = results(spark, d)
    best = r.groupBy(KEY).agg(F.max("score").alias("s"))
    cut = r.join(q.where("NOT positive").select(KEY), KEY).agg(F.max("score").alias("c"))
    j = q.select(KEY, "query_type", "positive").join(best, KEY, "left").crossJoin(F.broadcast(cut)).join(first(spark, d).select(KEY, "first_rank"), KEY, "left")
    return j.withColumn("accepted", F.coalesce(F.col("s") > F.col("c"), F.lit(False)))


_CALS = "count(*) AS n, round(avg(CASE WHEN positive THEN CAST(accepted AND coalesce(first_rank <= 5, false) AS INT) END), 6) AS recall_at_5, round(avg(CASE WHEN positive THEN 1 - CAST(accepted AS INT) END), 6) AS false_abstention, round(avg(CASE WHEN NOT positive THEN CAST(accepted AS INT) END), 6) AS false_alarm"


def _cal_aggs():
    yes = F.col("accepted")
    return [
        F.count("*").alias("n"), F.round(F.avg(F.when(F.col("positive"), (yes & F.coalesce(F.col("first_rank") <= 5, F.lit(False))).cast("int"))), 6).alias("recall_at_5"),
        F.round(F.avg(F.when(F.col("positive"), 1 - yes.cast("int"))), 6).alias("false_abstention"), F.round(F.avg(F.when(~F.col("positive"), yes.cast("int"))), 6).alias("false_alarm"),
    ]


@query("a05_calibrated_summary", VIEWS, f"{CAL} SELECT {_CALS} FROM cal")
def calibrated_summary(spark, d):
    return calibrated(spark, d).agg(*_cal_aggs())


@query("a06_report", VIEWS, FIRST + ", x AS (SELECT *, unnest([1, 3, 5]) AS k FROM fr) SELECT CAST(k AS INT) AS k, \"by\", value, n, recall FROM (" + " UNION ALL ".join(f"SELECT k, '{by}' AS by, {v} AS value, count(*) AS n, round(avg(CASE WHEN first_rank <= k THEN 1e0 ELSE 0 END), 6) AS recall FROM x GROUP BY ALL" for by, v in (("all", "'all'"), ("query_type", "query_type"), ("video_id", "video_id"))) + ") y")
def report(spark, d):
    """Recall by depth, over all and by type and video, in one pass of grouping sets."""
    x = first(spark, d).withColumn("k", F.explode(F.array(F.lit(1), F.lit(3), F.lit(5))))
    aggs = [F.count("*").alias("n"), F.round(metrics.share(F.col("first_rank") <= F.col("k")), 6).alias("recall")]
    g = x.groupingSets([[F.col("k")], [F.col("k"), F.col("query_type")], [F.col("k"), F.col("video_id")]], "k", "query_type", "video_id").agg(F.grouping("query_type").alias("a"), F.grouping("video_id").alias("b"), *aggs)
    by = F.when(F.col("a") == 0, "query_type").when(F.col("b") == 0, "video_id").otherwise("all")
    return g.select("k", by.alias("by"), F.coalesce("query_type", "video_id", F.lit("all")).alias("value"), "n", "recall")


@query("a07_failures", VIEWS, FIRST + f", n AS (SELECT query_id, count(*) AS c FROM res GROUP BY 1) SELECT query_id, CASE WHEN coalesce(c, 0) = 0 THEN 'no_candidates' WHEN first_rank IS NULL THEN 'retrieval' ELSE 'ranking' END AS component FROM fr LEFT JOIN n USING (query_id) WHERE first_rank IS NULL OR first_rank > 5")
def failures(spark, d):
    n = results(spark, d).groupBy(KEY).agg(F.count("*").alias("c"))
    f = first(spark, d).join(n, KEY, "left").where(F.col("first_rank").isNull() | (F.col("first_rank") > 5))
    return f.select(KEY, F.when(F.col("c").isNull(), "no_candidates").when(F.col("first_rank").isNull(), "retrieval").otherwise("ranking").alias("component"))


@query("a08_run_summary", VIEWS, f"WITH {RES} SELECT count(DISTINCT query_id) AS queries, count(DISTINCT video_id) AS videos, count(*) AS results, round(avg(score), 6) AS mean_score, round(median(score), 6) AS median_score FROM res")
def run_summary(spark, d):
    r = results(spark, d)
    one = r.agg(F.countDistinct(KEY).alias("queries"), F.countDistinct("video_id").alias("videos"), F.count("*").alias("results"), F.round(F.avg("score"), 6).alias("mean_score"))
    return one.crossJoin(F.broadcast(metrics.quantiles(r, [], "score", {"median_score": ("linear", 0.5)}))).withColumn("median_score", F.round("median_score", 6))


#: A routed class beside the required one, as a classifier would give it.
ROUTED = "CASE WHEN query_type = 'SPEECH' THEN 'speech' WHEN query_type IN ('OBJECT', 'SCENE') THEN 'visual' ELSE 'hybrid' END"
ROUTE = f"WITH r AS (SELECT query_id, query_type, {ROUTED} AS said, modality_requirement AS truth FROM qry WHERE modality_requirement IS NOT NULL)"


def routed(spark, d):
    q = views.queries(spark, d).where("modality_requirement IS NOT NULL")
    return q.select(KEY, "query_type", F.expr(ROUTED).alias("said"), F.col("modality_requirement").alias("truth"))


@query("a09_confusion", "qry", ROUTE + " SELECT truth, said, count(*) AS n FROM r GROUP BY ALL")
def confusion(spark, d):
    return metrics.confusion(routed(spark, d), "truth", "said")


@query("a09_per_class", "qry", ROUTE + """, t AS (SELECT truth AS class, count(*) AS support, count(*) FILTER (said = truth) AS hit FROM r GROUP BY 1), s AS (SELECT said AS class, count(*) AS claimed FROM r GROUP BY 1),
j AS (SELECT coalesce(t.class, s.class) AS class, coalesce(support, 0) AS support, coalesce(hit / CAST(claimed AS DOUBLE), 0) AS p, coalesce(hit / CAST(support AS DOUBLE), 0) AS r FROM t FULL JOIN s ON t.class = s.class)
SELECT class, support, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM j""")
def per_class(spark, d):
    return metrics.per_class(routed(spark, d), "truth", "said").select("class", "support", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query("a10_slices", "qry", ROUTE + """, x AS (SELECT truth, said, unnest(list_filter([CASE WHEN query_type = 'NEGATIVE' THEN 'negative' END, CASE WHEN query_type LIKE '%O%' THEN 'has_o' END, 'all'], lambda s: s IS NOT NULL)) AS slice FROM r)
SELECT slice, count(*) AS n, round(avg(CAST(said = truth AS INT)), 6) AS accuracy FROM x GROUP BY 1""")
def slices(spark, d):
    flags = F.array_compact(F.array(F.when(F.col("query_type") == "NEGATIVE", "negative"), F.when(F.col("query_type").contains("O"), "has_o"), F.lit("all")))
    x = routed(spark, d).select("truth", "said", F.explode(flags).alias("slice"))
    return x.groupBy("slice").agg(F.count("*").alias("n"), F.round(metrics.share(F.col("said") == F.col("truth")), 6).alias("accuracy"))


LABELLED = f"WITH {RES}, lab AS (SELECT r.query_id, r.rank, r.score, bool_or(i.ord IS NOT NULL) AS y FROM res r LEFT JOIN ivl i ON i.query_id = r.query_id AND r.ts BETWEEN i.s AND i.e GROUP BY ALL)"


def labelled(spark, d):
    """Candidates of a query's own video, labelled by whether one of its intervals holds them."""
    i = views.intervals(spark, d).withColumnRenamed(KEY, "q")
    on = (F.col("q") == F.col(KEY)) & F.col("ts").between(F.col("s"), F.col("e"))
    return results(spark, d).join(i, on, "left").groupBy(KEY, "rank", "score").agg(F.bool_or(F.col("ord").isNotNull()).alias("y"))


@query("a11_auc", VIEWS, LABELLED + """, c AS (SELECT score, count(*) FILTER (y) AS p, count(*) AS m FROM lab GROUP BY 1), b AS (SELECT *, coalesce(sum(m - p) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c)
SELECT CAST(sum(p) AS BIGINT) AS positives, CAST(sum(m - p) AS BIGINT) AS negatives, round(sum(p * (below + (m - p) / 2e0)) / CAST(sum(p) * sum(m - p) AS DOUBLE), 6) AS auc FROM b""")
def auc(spark, d):
    return metrics.auc(labelled(spark, d), [], "score", "y").select("positives", "negatives", F.round("auc", 6).alias("auc"))


@query("a12_brier", VIEWS, LABELLED + " SELECT round(avg(pow(1 / (1 + exp(-score)) - CAST(y AS INT), 2)), 9) AS brier FROM lab")
def brier(spark, d):
    return labelled(spark, d).agg(F.round(F.avg(F.pow(1 / (1 + F.exp(-F.col("score"))) - F.col("y").cast("int"), F.lit(2))), 9).alias("brier"))


_PROFILE = "count(*) AS n, min(score) AS least, round(quantile_cont(score, 0.25), 6) AS q25, round(median(score), 6) AS median, round(quantile_cont(score, 0.75), 6) AS q75, max(score) AS most, round(avg(score), 6) AS mean"


def profile(df, keys, c="score"):
    """Number, least, quartiles, most and mean of each group."""
    q = metrics.quantiles(df, keys, c, {"q25": ("linear", 0.25), "median": ("linear", 0.5), "q75": ("linear", 0.75)})
    n = df.groupBy(*keys).agg(F.count("*").alias("n"), F.min(c).alias("least"), F.max(c).alias("most"), F.round(F.avg(c), 6).alias("mean"))
    return n.join(q, keys).withColumns({x: F.round(x, 6) for x in ("q25", "median", "q75")})


@query("a13_quantiles", VIEWS, LABELLED + f" SELECT y, {_PROFILE} FROM lab GROUP BY y")
def quantiles(spark, d):
    return profile(labelled(spark, d), ["y"])


@query("a14_score_analysis", VIEWS, LABELLED + f" SELECT y, CASE WHEN len(query_text) < 70 THEN 'short' WHEN len(query_text) < 100 THEN 'medium' ELSE 'long' END AS length, {_PROFILE} FROM lab JOIN qry USING (query_id) GROUP BY ALL")
def score_analysis(spark, d):
    q = views.queries(spark, d).select(KEY, F.when(F.length("query_text") < 70, "short").when(F.length("query_text") < 100, "medium").otherwise("long").alias("length"))
    return profile(labelled(spark, d).join(q, KEY), ["y", "length"])


@query("a15_no_match", VIEWS, CAL + " SELECT query_type, count(*) AS n, round(avg(CASE WHEN NOT positive THEN CAST(accepted AS INT) END), 6) AS false_alarm, round(avg(CASE WHEN positive THEN 1 - CAST(accepted AS INT) END), 6) AS false_abstention, round(count(*) FILTER (accepted AND positive) / CAST(nullif(count(*) FILTER (accepted), 0) AS DOUBLE), 6) AS accepted_precision FROM cal GROUP BY 1")
def no_match(spark, d):
    yes, pos = F.col("accepted"), F.col("positive")
    n = lambda c: F.count(F.when(c, 1))
    return calibrated(spark, d).groupBy("query_type").agg(F.count("*").alias("n"), F.round(F.avg(F.when(~pos, yes.cast("int"))), 6).alias("false_alarm"), F.round(F.avg(F.when(pos, 1 - yes.cast("int"))), 6).alias("false_abstention"), F.round(metrics.ratio(n(yes & pos), n(yes)), 6).alias("accepted_precision"))


_RATE = lambda a, b: f"round({a} / CAST(greatest({b}, 1) AS DOUBLE), 6)"
_N = lambda c: f"count(*) FILTER ({c})"


@query("a16_decisions", VIEWS, CAL + f" SELECT query_type, {_N('positive')} AS positives, {_N('NOT positive')} AS negatives, {_RATE(_N('accepted AND positive'), _N('positive'))} AS accepted_positive_rate, {_RATE(_N('accepted AND NOT positive'), _N('NOT positive'))} AS false_accept_rate, {_RATE(_N('accepted AND positive'), _N('accepted'))} AS accept_precision, {_RATE(_N('accepted'), 'count(*)')} AS coverage FROM cal GROUP BY 1")
def decisions(spark, d):
    """Rates of decisions; a rate of nothing is 0. Abstention and rejection rates are 1 less these."""
    yes, pos = F.col("accepted"), F.col("positive")
    n = lambda c: F.count(F.when(c, 1))
    r = lambda a, b, name: F.round(a / F.greatest(b, F.lit(1)), 6).alias(name)
    return calibrated(spark, d).groupBy("query_type").agg(n(pos).alias("positives"), n(~pos).alias("negatives"), r(n(yes & pos), n(pos), "accepted_positive_rate"), r(n(yes & ~pos), n(~pos), "false_accept_rate"), r(n(yes & pos), n(yes), "accept_precision"), r(n(yes), F.count("*"), "coverage"))


@query("a17_oracle_recall", VIEWS, FIRST + ", x AS (SELECT *, unnest([1, 3, 5, 20, 50]) AS depth FROM fr) SELECT CAST(depth AS INT) AS depth, round(avg(CASE WHEN first_rank <= depth THEN 1e0 ELSE 0 END), 6) AS recall FROM x GROUP BY 1")
def oracle_recall(spark, d):
    x = first(spark, d).withColumn("depth", F.explode(F.array(*map(F.lit, (1, 3, 5, 20, 50)))))
    return x.groupBy("depth").agg(F.round(metrics.share(F.col("first_rank") <= F.col("depth")), 6).alias("recall"))


@query("a18_failure_buckets", VIEWS, CAL + " SELECT bucket, count(*) AS n, list(query_id ORDER BY query_id)[1:5] AS examples FROM (SELECT query_id, CASE WHEN positive AND NOT accepted THEN 'false_abstention' WHEN NOT positive AND accepted THEN 'false_alarm' WHEN positive AND first_rank IS NULL THEN 'missed' WHEN positive AND first_rank > 5 THEN 'low' ELSE 'fine' END AS bucket FROM cal) x GROUP BY 1")
def failure_buckets(spark, d):
    """Numbers of each kind of failure, with the first five ids as examples."""
    p, yes, r = F.col("positive"), F.col("accepted"), F.col("first_rank")
    b = F.when(p & ~yes, "false_abstention").when(~p & yes, "false_alarm").when(p & r.isNull(), "missed").when(p & (r > 5), "low").otherwise("fine")
    x = calibrated(spark, d).select(KEY, b.alias("bucket"))
    n = x.groupBy("bucket").agg(F.count("*").alias("n"))
    few = x.withColumn("i", F.row_number().over(W.partitionBy("bucket").orderBy(KEY))).where("i <= 5").groupBy("bucket").agg(F.array_sort(F.collect_list(KEY)).alias("examples"))
    return n.join(few, "bucket")


RANKS = ", vr AS (SELECT f.query_id, min(fused_rank) AS fused, min(visual_rank) AS visual, min(speech_rank) AS speech FROM fused f JOIN ivl i ON i.query_id = f.query_id AND f.ts BETWEEN i.s AND i.e GROUP BY 1), cmp AS (SELECT q.query_id, q.query_type, v.visual AS before, v.fused AS after FROM qry q LEFT JOIN vr v USING (query_id) WHERE " + POS + ")"


def compared(spark, d):
    """First relevant rank of each query in the visual lane and after fusion."""
    f = fusion.fuse(search.lanes(spark, d), [KEY]).join(views.intervals(spark, d), KEY).where(F.col("ts").between(F.col("s"), F.col("e")))
    r = f.groupBy(KEY).agg(F.min("visual_rank").alias("before"), F.min("fused_rank").alias("after"))
    return positives(spark, d).select(KEY, "query_type").join(r, KEY, "left")


CLASS = "CASE WHEN NOT b AND a THEN 'RECOVERY' WHEN b AND NOT a THEN 'REGRESSION' WHEN a AND b AND before <> after THEN 'NEUTRAL' ELSE 'UNCHANGED' END"
CMP = RANKS + f", cls AS (SELECT *, {CLASS} AS change FROM (SELECT *, coalesce(before <= 5, false) AS b, coalesce(after <= 5, false) AS a FROM cmp) x)"


@query("j20_oracle_path", FVIEWS, with_lanes(""", m AS (SELECT query_id, lane AS mode, thumbnail FROM lanes WHERE rank = 1 UNION ALL SELECT query_id, 'hybrid', thumbnail FROM fused WHERE fused_rank = 1)
SELECT m.query_id, m.mode, m.thumbnail FROM m JOIN qry q ON q.query_id = m.query_id AND q.modality_requirement = m.mode"""))
def oracle_path(spark, d):
    """The first result of the way of searching that each query requires."""
    lanes = search.lanes(spark, d)
    one = lanes.where("rank = 1").select(KEY, F.col("lane").alias("mode"), "thumbnail")
    both = fusion.fuse(lanes, [KEY]).where("fused_rank = 1").select(KEY, F.lit("hybrid").alias("mode"), "thumbnail")
    q = views.queries(spark, d).select(KEY, F.col("modality_requirement").alias("mode"))
    return one.unionByName(both).join(q, [KEY, "mode"])


@query("a20_paired_change", FVIEWS, with_lanes(CMP + " SELECT change, count(*) AS n FROM cls GROUP BY 1"))
def paired_change(spark, d):
    return compared(spark, d).groupBy(metrics.change_class(F.col("before"), F.col("after"), 5).alias("change")).agg(F.count("*").alias("n"))


@query("a21_rescued_broken", FVIEWS, with_lanes(CMP + " SELECT query_type, count(*) FILTER (change = 'RECOVERY') AS rescued, count(*) FILTER (change = 'REGRESSION') AS broken, count(*) FILTER (a AND b) AS unchanged_hit, count(*) FILTER (NOT a AND NOT b) AS unchanged_miss, round(count(*) FILTER (a AND b) / CAST(nullif(count(*) FILTER (b), 0) AS DOUBLE), 6) AS retention FROM cls GROUP BY 1"))
def rescued_broken(spark, d):
    x = compared(spark, d).withColumns({"b": F.coalesce(F.col("before") <= 5, F.lit(False)), "a": F.coalesce(F.col("after") <= 5, F.lit(False))})
    n = lambda c: F.count(F.when(c, 1))
    a, b = F.col("a"), F.col("b")
    return x.groupBy("query_type").agg(n(~b & a).alias("rescued"), n(b & ~a).alias("broken"), n(a & b).alias("unchanged_hit"), n(~a & ~b).alias("unchanged_miss"), F.round(metrics.ratio(n(a & b), n(b)), 6).alias("retention"))


NEED = "nd AS (SELECT query_id, query_type, unnest(CASE modality_requirement WHEN 'visual' THEN ['visual'] WHEN 'temporal' THEN ['visual'] WHEN 'speech' THEN ['speech'] WHEN 'hybrid' THEN ['visual', 'speech'] END) AS lane FROM qry WHERE " + POS + ")"
TOUCH = "{0}.ts <= i.e AND coalesce({0}.\"end\", {0}.ts) >= i.s"
BESTE = "be AS (SELECT l.query_id, lane, min(rank) AS rank FROM lanes l JOIN ivl i ON i.query_id = l.query_id AND " + TOUCH.format("l") + " GROUP BY ALL)"


def required(spark, d):
    """The lanes that each query with an answer needs."""
    m = F.col("modality_requirement")
    need = F.when(m.isin("visual", "temporal"), F.array(F.lit("visual"))).when(m == "speech", F.array(F.lit("speech"))).when(m == "hybrid", F.array(F.lit("visual"), F.lit("speech")))
    return positives(spark, d).select(KEY, "query_type", F.explode(need).alias("lane"))


@query("a19_preservation", FVIEWS, with_lanes(f""", {NEED}, sn AS (SELECT DISTINCT l.query_id, lane FROM lanes l JOIN ivl i ON i.query_id = l.query_id AND {TOUCH.format('l')} WHERE l.rank <= 5),
el AS (SELECT n.query_id, n.query_type, bool_and(s.lane IS NOT NULL) AS eligible FROM nd n LEFT JOIN sn s USING (query_id, lane) GROUP BY ALL),
rk AS (SELECT f.query_id, min(fused_rank) AS r FROM fused f JOIN ivl i ON i.query_id = f.query_id AND {TOUCH.format('f')} WHERE fused_rank <= 5 GROUP BY 1),
bt AS (SELECT query_id, visual_rank IS NOT NULL AND speech_rank IS NOT NULL AS both_lanes FROM fused WHERE fused_rank = 1)
SELECT query_type, count(*) AS n, count(*) FILTER (eligible) AS eligible, count(*) FILTER (eligible AND r IS NULL) AS displaced, round(count(*) FILTER (eligible AND r IS NULL) / CAST(nullif(count(*) FILTER (eligible), 0) AS DOUBLE), 6) AS displacement_rate, count(*) FILTER (eligible AND r IS NULL AND coalesce(both_lanes, false)) AS irrelevant_consensus
FROM el LEFT JOIN rk USING (query_id) LEFT JOIN bt USING (query_id) GROUP BY 1"""))
def preservation(spark, d):
    """Queries whose required lanes have evidence among their first five, those where fusion lost it, and where both lanes agreed on something else."""
    lanes, need = search.lanes(spark, d), required(spark, d)
    p = metrics.preservation(lanes, fusion.fuse(lanes, [KEY]), views.intervals(spark, d), need, KEY).join(need.select(KEY, "query_type").distinct(), KEY)
    n = lambda c: F.count(F.when(c, 1))
    e = F.col("eligible")
    lost = e & F.col("relevant_rank").isNull()
    return p.groupBy("query_type").agg(F.count("*").alias("n"), n(e).alias("eligible"), n(lost).alias("displaced"), F.round(metrics.ratio(n(lost), n(e)), 6).alias("displacement_rate"), n(F.col("irrelevant_consensus")).alias("irrelevant_consensus"))


@query("a22_demotions", FVIEWS, with_lanes(f", {BESTE} SELECT b.query_id, b.lane, b.rank, f.fused_rank FROM be b JOIN fused f ON f.query_id = b.query_id AND CASE b.lane WHEN 'visual' THEN f.visual_rank ELSE f.speech_rank END = b.rank WHERE b.rank <= 5 AND f.fused_rank > 5"))
def demotions(spark, d):
    """Evidence that a lane has among its first five and fusion puts beyond them."""
    lanes = search.lanes(spark, d)
    return metrics.demotions(lanes, fusion.fuse(lanes, [KEY]), views.intervals(spark, d), KEY)


@query("a22_recall_or_ranking", FVIEWS, with_lanes(f""", {NEED}, {BESTE}, al AS (SELECT n.query_id, n.query_type, bool_and(b.rank IS NOT NULL) AS every FROM nd n LEFT JOIN be b USING (query_id, lane) GROUP BY ALL),
tp AS (SELECT DISTINCT f.query_id FROM fused f JOIN ivl i ON i.query_id = f.query_id AND {TOUCH.format('f')} WHERE fused_rank <= 5)
SELECT query_type, CASE WHEN t.query_id IS NOT NULL THEN 'success' WHEN every THEN 'ranking_failure' ELSE 'candidate_recall_failure' END AS outcome, count(*) AS n FROM al LEFT JOIN tp t USING (query_id) GROUP BY ALL"""))
def recall_or_ranking(spark, d):
    """Whether a miss of fusion is one of ranking or of a lane that never had the evidence."""
    lanes, need = search.lanes(spark, d), required(spark, d)
    r = metrics.recall_or_ranking(lanes, fusion.fuse(lanes, [KEY]), views.intervals(spark, d), need, KEY)
    return r.join(need.select(KEY, "query_type").distinct(), KEY).groupBy("query_type", "outcome").agg(F.count("*").alias("n"))


@query("a22_top_slots", FVIEWS, with_lanes(" SELECT fused_rank, modality, count(*) AS n FROM fused WHERE fused_rank <= 5 GROUP BY ALL"))
def top_slots(spark, d):
    return fusion.fuse(search.lanes(spark, d), [KEY]).where("fused_rank <= 5").groupBy("fused_rank", "modality").agg(F.count("*").alias("n"))


@query("a23_trace_flags", FVIEWS, with_lanes(""", t AS (SELECT query_id, max(score) AS best, bool_or(fused_rank = 1 AND modality = 'visual+speech' AND least(visual_rank, speech_rank) > 5) AS weak_consensus,
  bool_or(fused_rank = 1 AND coalesce(visual_rank, 99) > 1 AND coalesce(speech_rank, 99) > 1) AS rank_reversal, count(*) FILTER (fused_rank <= 5) AS n, max(ts) FILTER (fused_rank <= 5) - min(ts) FILTER (fused_rank <= 5) AS span FROM fused GROUP BY 1)
SELECT query_id, weak_consensus, rank_reversal, n > 1 AND span <= 15 AS cluster, CASE WHEN weak_consensus THEN 'weak_consensus' WHEN rank_reversal THEN 'rank_reversal' WHEN n > 1 AND span <= 15 THEN 'duplicate_cluster' ELSE 'none' END AS mechanism FROM t"""))
def trace_flags(spark, d):
    f = fusion.fuse(search.lanes(spark, d), [KEY])
    one, top = F.col("fused_rank") == 1, F.col("fused_rank") <= 5
    far = lambda c: F.coalesce(F.col(c), F.lit(99)) > 1
    both = F.col("visual_rank").isNotNull() & F.col("speech_rank").isNotNull()
    t = f.groupBy(KEY).agg(
        F.bool_or(one & both & (F.least("visual_rank", "speech_rank") > 5)).alias("weak_consensus"), F.bool_or(one & far("visual_rank") & far("speech_rank")).alias("rank_reversal"),
        ((F.count(F.when(top, 1)) > 1) & (F.max(F.when(top, F.col("ts"))) - F.min(F.when(top, F.col("ts"))) <= 15)).alias("cluster"),
    )
    return t.withColumn("mechanism", F.when(F.col("weak_consensus"), "weak_consensus").when(F.col("rank_reversal"), "rank_reversal").when(F.col("cluster"), "duplicate_cluster").otherwise("none"))


@query("a24_category_deltas", FVIEWS, with_lanes(CMP + """, s AS (SELECT query_type, avg(CAST(b AS INT)) AS before_rate, avg(CAST(a AS INT)) AS after_rate FROM cls GROUP BY 1)
SELECT query_type, 'before' AS state, round(before_rate, 6) AS rate, round(after_rate - before_rate, 6) AS delta FROM s UNION ALL SELECT query_type, 'after', round(after_rate, 6), round(after_rate - before_rate, 6) FROM s"""))
def category_deltas(spark, d):
    s = compared(spark, d).groupBy("query_type").agg(metrics.share(F.col("before") <= 5).alias("before"), metrics.share(F.col("after") <= 5).alias("after"))
    long = s.withColumn("delta", F.round(F.col("after") - F.col("before"), 6)).unpivot(["query_type", "delta"], ["before", "after"], "state", "rate")
    return long.withColumn("rate", F.round("rate", 6))


@query("a25_acceptance", "", """WITH e AS (SELECT event_type, user_id % 3 AS verdict, value FROM events WHERE value IS NOT NULL), x AS (SELECT *, CASE verdict WHEN 0 THEN 'PASS' WHEN 1 THEN 'PARTIAL' ELSE 'FAIL' END AS usefulness FROM e)
SELECT "by", val AS value, n, useful, median, p95 FROM (SELECT 'all' AS "by", 'all' AS val, count(*) AS n, round(avg(CASE WHEN usefulness <> 'FAIL' THEN 1e0 ELSE 0 END), 6) AS useful, quantile_disc(x.value, 0.5) AS median, quantile_disc(x.value, 0.95) AS p95 FROM x
UNION ALL SELECT 'event_type', event_type, count(*), round(avg(CASE WHEN usefulness <> 'FAIL' THEN 1e0 ELSE 0 END), 6), quantile_disc(x.value, 0.5), quantile_disc(x.value, 0.95) FROM x GROUP BY event_type) y""")
def acceptance(spark, d):
    """Useful rate and nearest-rank latency percentiles, over all and by slice; events stand for observed searches."""
    e = load(spark, d, "events").where(F.col("value").isNotNull()).select("event_type", "value", (F.col("user_id") % 3).alias("verdict"))
    x = e.select("event_type", F.col("value").alias("latency"), F.when(F.col("verdict") == 0, "PASS").when(F.col("verdict") == 1, "PARTIAL").otherwise("FAIL").alias("usefulness"))
    g = metrics.grouped(x, ["event_type"], [F.count("*").alias("n"), F.round(metrics.share(F.col("usefulness") != "FAIL"), 6).alias("useful")])
    cell = lambda by, v: F.struct(F.lit(by).alias("by"), v.alias("value"))
    each = x.select("latency", F.inline(F.array(cell("all", F.lit("all")), cell("event_type", F.coalesce("event_type", F.lit("(null)"))))))
    return g.join(metrics.quantiles(each, ["by", "value"], "latency", {"median": ("nearest", 0.5), "p95": ("nearest", 0.95)}), ["by", "value"])


@query("k12_percentiles", "", """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, quantile_disc(value, 0.95) AS nearest, round(quantile_cont(value, 0.95), 6) AS linear, max(value) FILTER (i = least(CAST(floor(n * 0.95) AS BIGINT), n - 1)) AS floor_index FROM r GROUP BY 1""")
def percentiles(spark, d):
    """Three definitions of a percentile side by side."""
    e = load(spark, d, "events").where(F.col("value").isNotNull())
    q = metrics.quantiles(e, ["event_type"], "value", {"nearest": ("nearest", 0.95), "linear": ("linear", 0.95), "floor_index": ("floor", 0.95)})
    return q.withColumn("linear", F.round("linear", 6))


@query("a26_package_metrics", "qry ivl fine", """WITH f AS (SELECT q.query_id, i.ord, bool_or(u.unit_id IS NOT NULL) AS hit FROM qry q JOIN ivl i USING (query_id) LEFT JOIN fine u ON u.video_id = q.video_id AND u.start_seconds <= i.e AND u.end_seconds >= i.s GROUP BY ALL)
SELECT query_id, bool_or(hit) AS any_fact, bool_and(hit) AS all_facts, round(avg(CAST(hit AS INT)), 6) AS completeness FROM f GROUP BY 1""")
def package_metrics(spark, d):
    from cuelake.plans.moments import any_of

    return any_of(spark, d).groupBy(KEY).agg(F.bool_or("hit").alias("any_fact"), F.bool_and("hit").alias("all_facts"), F.round(F.avg(F.col("hit").cast("int")), 6).alias("completeness"))


REV = f"""{FIRST}, rv AS (SELECT x.form, q.query_id, x.form = 0 AS supported, q.{POS} AS answerable, s.scope = 'SUPPORTED_CORE' AS allowed, f.first_rank, n.n FROM sc x JOIN qry q USING (query_id) JOIN sc s ON s.query_id = x.query_id AND s.form = x.form LEFT JOIN fr f ON f.query_id = q.query_id LEFT JOIN (SELECT query_id, count(*) FILTER (rank <= 3) AS n FROM res GROUP BY 1) n ON n.query_id = q.query_id),
r AS (SELECT coalesce(supported, false) AS supported, coalesce(answerable, false) AS answerable, allowed, allowed AS generated, allowed AND n > 0 AS answered, coalesce(first_rank <= 3, false) AS correct, coalesce(first_rank <= 10, false) AS grounded, coalesce(first_rank <= 5, false) AS evidence, CASE WHEN allowed THEN coalesce(n, 0) ELSE 0 END AS citations FROM rv),
z AS (SELECT *, coalesce(answered, false) AS a, supported AND answerable AS core, supported AND NOT answerable AS hard, CASE WHEN grounded THEN citations ELSE 0 END AS valid FROM r)"""


def reviews(spark, d):
    """Every form of every query as a question: its first form is in scope, the gate decides, and the best candidates are its citations."""
    from cuelake.operators import routing as rt
    from cuelake.plans.routing import questions

    n = results(spark, d).groupBy(KEY).agg(F.count(F.when(F.col("rank") <= 3, 1)).alias("n"))
    q = questions(spark, d).select(KEY, "form", (rt.scope(F.col("q")) == "SUPPORTED_CORE").alias("allowed"))
    q = q.join(views.queries(spark, d).select(KEY, F.expr(POS).alias("answerable")), KEY).join(first(spark, d).select(KEY, "first_rank"), KEY, "left").join(n, KEY, "left")
    r, ok = F.col("first_rank"), F.col("allowed")
    cited = F.when(ok, F.col("n")).otherwise(0)
    return q.select((F.col("form") == 0).alias("supported"), "answerable", "allowed", ok.alias("generated"), (ok & (F.col("n") > 0)).alias("answered"), (r <= 3).alias("correct"), (r <= 10).alias("grounded"), (r <= 5).alias("evidence"), cited.alias("citations"), F.when(r <= 10, cited).otherwise(0).alias("valid_citations"))


def _scope_sql():
    from cuelake.operators import routing as rt
    from cuelake.plans.routing import SCOPE_SQL

    rate = lambda a, b: f"coalesce(count(*) FILTER ({a}) / CAST(nullif(count(*) FILTER ({b}), 0) AS DOUBLE), 0)"
    rows = [(s, m, rate(a.replace("answered", "a"), b.replace("answered", "a"))) for s, m, a, b in metrics._SCOPE]
    rows.append(("core_qa", "citation_precision", "coalesce(sum(valid) FILTER (core) / CAST(nullif(sum(citations) FILTER (core), 0) AS DOUBLE), 0)"))
    return SCOPE_SQL.rsplit(" SELECT query_id", 1)[0] + ", sc AS (SELECT query_id" + SCOPE_SQL.rsplit(" SELECT query_id", 1)[1] + "), " + REV.removeprefix("WITH ") + " ".join(("" if i == 0 else "UNION ALL") + f" SELECT '{s}' AS section, '{m}' AS metric, round({e}, 6) AS value FROM z" for i, (s, m, e) in enumerate(rows))


@query("a28_scope_metrics", VIEWS, _scope_sql())
def scope_metrics(spark, d):
    return metrics.scope_report(reviews(spark, d)).select("section", "metric", F.round("value", 6).alias("value"))


@query("a28_video_rates", "qry ivl cand pool", FIRST + " SELECT q.video_id, count(*) FILTER (q.expected_presence) AS answerable, count(*) FILTER (q.expected_presence AND first_rank <= 5) AS success, round(count(*) FILTER (q.expected_presence AND first_rank <= 5) / CAST(nullif(count(*) FILTER (q.expected_presence), 0) AS DOUBLE), 6) AS rate FROM qry q LEFT JOIN fr USING (query_id) GROUP BY 1")
def video_rates(spark, d):
    """Answerable questions of each video and those that find their evidence among five."""
    x = views.queries(spark, d).select(KEY, "video_id", "expected_presence").join(first(spark, d).select(KEY, "first_rank"), KEY, "left")
    n = lambda c: F.count(F.when(c, 1))
    hit = F.col("expected_presence") & (F.col("first_rank") <= 5)
    return x.groupBy("video_id").agg(n(F.col("expected_presence")).alias("answerable"), n(hit).alias("success"), F.round(metrics.ratio(n(hit), n(F.col("expected_presence"))), 6).alias("rate"))


@query("a31_sampling_recall", "qry ivl", """WITH a AS (SELECT CAST(step AS INT) AS step, CASE WHEN ceil((s + 0.5e0) / step) * step <= e - 0.5e0 THEN 'A_visible' WHEN ceil(s / step) * step <= e THEN 'C_partial' ELSE 'B_between_frames' END AS class FROM (SELECT *, unnest([1, 2, 5]) AS step FROM ivl) x),
n AS (SELECT step, count(*) AS n, avg(CAST(class <> 'B_between_frames' AS INT)) AS recall FROM a GROUP BY 1) SELECT step, class, count(*) AS events, round(count(*) / CAST(any_value(n) AS DOUBLE), 6) AS share, round(any_value(recall), 6) AS recall FROM a JOIN n USING (step) GROUP BY ALL""")
def sampling_recall(spark, d):
    """Evidence of each interval in frames sampled every 1, 2 and 5 s: well inside it, within half a second of an end, or none."""
    x = views.intervals(spark, d).withColumn("step", F.explode(F.array(F.lit(1), F.lit(2), F.lit(5))))
    at = lambda c: F.ceil(c / F.col("step")) * F.col("step")
    kind = F.when(at(F.col("s") + 0.5) <= F.col("e") - 0.5, "A_visible").when(at(F.col("s")) <= F.col("e"), "C_partial").otherwise("B_between_frames")
    out = metrics.evidence_classes(x.withColumn("kind", kind), "step", "kind", ["A_visible", "C_partial"])
    return out.select("step", "class", "events", F.round("share", 6).alias("share"), F.round("recall", 6).alias("recall"))


@query("a31_detector_recall", VIEWS, f"WITH {RES}, v AS (SELECT q.query_type, r.score, r.rank FROM res r JOIN qry q USING (query_id) WHERE EXISTS (SELECT 1 FROM ivl i WHERE i.query_id = r.query_id AND r.ts BETWEEN i.s AND i.e)) SELECT query_type, count(*) AS visible, count(*) FILTER (score >= 0.2) AS detected, round(avg(CAST(score >= 0.2 AS INT)), 6) AS recall, round(avg(score) FILTER (score >= 0.2), 6) AS mean_confidence, round(avg(1e0 / rank) FILTER (score >= 0.2), 6) AS mean_area FROM v GROUP BY 1")
def detector_recall(spark, d):
    """Candidates as detections: those within an interval are verified as visible, a score of 0.2 detects, and a box is the smaller the later its rank."""
    r = results(spark, d).select(KEY, "rank", "ts", "score")
    seen = r.join(views.intervals(spark, d), KEY).where(F.col("ts").between(F.col("s"), F.col("e"))).select(KEY, "rank").distinct().withColumn("visibility", F.lit("visible"))
    x = r.join(seen, [KEY, "rank"], "left").join(views.queries(spark, d).select(KEY, "query_type"), KEY)
    x = x.withColumns({"detected": F.col("score") >= 0.2, "confidence": F.col("score"), "area": 1 / F.col("rank")})
    return metrics.detector_recall(x, ["query_type"]).select("query_type", "visible", "detected", *(F.round(c, 6).alias(c) for c in ("recall", "mean_confidence", "mean_area")))


@query("a32_resources", "vid seg", "SELECT v.video_domain, count(DISTINCT v.video_id) AS videos, round(sum(n) / (sum(d) / 60e0), 6) AS segments_per_minute FROM (SELECT video_id, max(video_domain) AS video_domain, max(duration_s) AS d FROM vid GROUP BY 1) v JOIN (SELECT video_id, count(*) AS n FROM seg GROUP BY 1) s USING (video_id) GROUP BY 1")
def resources(spark, d):
    v = views.videos(spark, d).groupBy("video_id").agg(F.max("video_domain").alias("video_domain"), F.max("duration_s").alias("d"))
    s = views.segments(spark, d).groupBy("video_id").agg(F.count("*").alias("n"))
    return v.join(s, "video_id").groupBy("video_domain").agg(F.countDistinct("video_id").alias("videos"), F.round(F.sum("n") / (F.sum("d") / 60), 6).alias("segments_per_minute"))


@query("a33_historical", FVIEWS, with_lanes(CMP + " SELECT v.split, count(*) AS n, round(avg(CAST(b AS INT)), 6) AS before_rate, round(avg(CAST(a AS INT)), 6) AS after_rate FROM cls c JOIN qry q USING (query_id) JOIN (SELECT DISTINCT video_id, split FROM vid) v ON v.video_id = q.video_id GROUP BY 1"))
def historical(spark, d):
    v = views.videos(spark, d).select("video_id", "split").distinct()
    x = compared(spark, d).join(views.queries(spark, d).select(KEY, "video_id"), KEY).join(v, "video_id")
    return x.groupBy("split").agg(F.count("*").alias("n"), F.round(metrics.share(F.col("before") <= 5), 6).alias("before_rate"), F.round(metrics.share(F.col("after") <= 5), 6).alias("after_rate"))


@query("a34_tokens", "fine vid", "WITH v AS (SELECT video_id, max(duration_s) / 3600 AS h, max(video_domain) AS video_domain FROM vid GROUP BY 1), u AS (SELECT video_id, (len(text) + 3) // 4 AS i, CASE WHEN len(text) > 200 THEN len(text) // 8 END AS o FROM fine), c AS (SELECT video_id, count(*) AS calls, sum(i) AS i, coalesce(sum(o), 0) AS o FROM u GROUP BY 1) SELECT video_id, calls, CAST(i AS BIGINT) AS input_tokens, CAST(o AS BIGINT) AS output_tokens, round((i * 0.75e0 + o * 4.5e0) / 1000000, 13) AS cost, round((i * 0.75e0 + o * 4.5e0) / 1000000 / calls, 13) AS cost_per_call, round((i * 0.75e0 + o * 4.5e0) / 1000000 / h, 13) AS cost_per_hour FROM c JOIN v USING (video_id)")
def token_rollup(spark, d):
    """Units as calls: a quarter of their characters, rounded up, as tokens in, half as many out of the longer ones, at 0.75 and 4.50 a million."""
    n = F.length("text")
    u = views.units(spark, d, "fine").select("video_id", F.floor((n + 3) / 4).alias("input_tokens"), F.when(n > 200, F.floor(n / 8)).alias("output_tokens"))
    v = views.videos(spark, d).groupBy("video_id").agg((F.max("duration_s") / 3600).alias("h"))
    c = metrics.cost_rollup(u.join(v, "video_id"), ["video_id"], 0.75, 4.5, F.max("h"))
    return c.select("video_id", "calls", "input_tokens", "output_tokens", *(F.round(x, 13).alias(x) for x in ("cost", "cost_per_call", "cost_per_hour")))


AUD = "au AS (SELECT DISTINCT s.video_id, s.segment_id, s.text, CASE WHEN regexp_matches(s.text, '[[:alpha:]]') THEN 'text' ELSE 'false_non_text' END AS verdict FROM segments s WHERE s.video_id IN (SELECT video_id FROM vid WHERE split = 'heldout') AND s.text IS NOT NULL AND s.video_id IS NOT NULL)"


@query("a35_audit_rate", "seg vid", f"WITH {AUD}, li AS (SELECT video_id, segment_id, text FROM seg WHERE video_id IN (SELECT video_id FROM vid WHERE split = 'heldout')), j AS (SELECT l.text AS a, u.text AS b, verdict, l.segment_id IS NOT NULL AS l, u.segment_id IS NOT NULL AS r FROM li l FULL JOIN au u USING (video_id, segment_id)) SELECT *, CASE WHEN missing + unknown + changed = 0 THEN round(false_lines / CAST(nullif(reviewed, 0) AS DOUBLE), 6) END AS false_rate FROM (SELECT count(*) FILTER (r) AS reviewed, count(*) FILTER (verdict = 'false_non_text') AS false_lines, count(*) FILTER (NOT r) AS missing, count(*) FILTER (NOT l) AS unknown, count(*) FILTER (l AND r AND a <> b) AS changed FROM j) x")
def audit_rate(spark, d):
    """An audit of all delivered segments of the heldout videos against the valid ones: reviews of faulty rows make it void."""
    held = views.videos(spark, d).where("split = 'heldout'").select("video_id").distinct()
    s = load(spark, d, "segments").where(F.col("text").isNotNull() & F.col("video_id").isNotNull()).select("video_id", "segment_id", "text").distinct().join(held, "video_id", "left_semi")
    s = s.withColumn("verdict", F.when(F.col("text").rlike(r"[A-Za-z]"), "text").otherwise("false_non_text"))
    out = metrics.audit(views.segments(spark, d).select("video_id", "segment_id", "text").join(held, "video_id", "left_semi"), s, ["video_id", "segment_id"], "text", "verdict", "false_non_text")
    return out.withColumn("false_rate", F.round("false_rate", 6))


@query("s21_csv_rows", VIEWS, FIRST + " SELECT concat_ws(',', query_id, query_type, coalesce(CAST(first_rank AS VARCHAR), '')) AS line FROM fr")
def csv_rows(spark, d):
    """Report lines as the CSV sink writes them; see sources.files.write_csv."""
    return first(spark, d).select(F.concat_ws(",", KEY, "query_type", F.coalesce(F.col("first_rank").cast("string"), F.lit(""))).alias("line"))
