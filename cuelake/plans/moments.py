"""Operators along media time over the test tables: joins by span, windows, greedy choices, scenes."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuelake.operators import evidence as ev
from cuelake.operators import metrics
from cuelake.operators import timeline as tl
from cuelake.operators import vectors
from cuelake.operators.text import overlapping_sets, tokens, topic_terms, SQL_TOKENS, SQL_FOLD, TOPIC_STOP
from cuelake.plans.common import Registry
from cuelake.sources import views
from cuelake.sources.tables import load

query = Registry()
QUERIES, SQL = query.queries, query.sql

#: The ten best candidates of each query in its own video.
TEN = "ten AS (SELECT p.* FROM pool p JOIN qry q USING (query_id, video_id) WHERE p.rank <= 10)"


def ten(spark, d, k=10):
    return views.own_pool(spark, d, k)


def by_list(df, keys=("query_id", "video_id"), order="ts"):
    """One array of times for each list of candidates: bounded by the pool's size."""
    return df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("ts").alias("t")))), lambda x: x.t).alias("times"))


@query("j05_section_units", "fine ctx", """SELECT c.video_id, c.unit_id, count(*) AS fine_units FROM (SELECT video_id, unit_id, unnest(fine_ids) AS fine_id FROM ctx) c
SEMI JOIN fine f ON c.video_id = f.video_id AND c.fine_id = f.unit_id GROUP BY ALL""")
def section_units(spark, d):
    """The fine units that context units name, if they exist."""
    named = views.units(spark, d, "context").select("video_id", "unit_id", F.explode("fine_ids").alias("fine_id"))
    fine = views.units(spark, d, "fine").select("video_id", F.col("unit_id").alias("fine_id"))
    return named.join(fine, ["video_id", "fine_id"], "left_semi").groupBy("video_id", "unit_id").agg(F.count("*").alias("fine_units"))


@query("j04_evidence_lookup", "fine ctx", """SELECT c.video_id, c.unit_id, c.fine_id, f.unit_id IS NOT NULL AS known FROM (SELECT video_id, unit_id, unnest(fine_ids) AS fine_id FROM ctx) c
LEFT JOIN fine f ON c.video_id = f.video_id AND c.fine_id = f.unit_id""")
def evidence_lookup(spark, d):
    """Ids and whether they are known: unknown ones are errors that the caller decides on."""
    named = views.units(spark, d, "context").select("video_id", "unit_id", F.explode("fine_ids").alias("fine_id"))
    fine = views.units(spark, d, "fine").select("video_id", F.col("unit_id").alias("fine_id"), F.lit(True).alias("known"))
    return named.join(fine, ["video_id", "fine_id"], "left").withColumn("known", F.coalesce("known", F.lit(False)))


@query("j06_inside_half_open", "qry ivl cand pool", f"""WITH {TEN} SELECT t.query_id, t.rank, min(i.ord) AS ord FROM ten t JOIN ivl i ON t.query_id = i.query_id AND i.s <= t.ts AND t.ts < i.e GROUP BY ALL""")
def inside_half_open(spark, d):
    """Candidates in a relevance interval, credited to the first that holds them."""
    j = ten(spark, d).join(views.intervals(spark, d), "query_id").where(tl.inside(F.col("ts"), F.col("s"), F.col("e")))
    return j.groupBy("query_id", "rank").agg(F.min("ord").alias("ord"))


@query("j07_inside_closed", "qry ivl cand pool", f"WITH {TEN} SELECT t.query_id, min(t.rank) AS first_rank FROM ten t JOIN ivl i ON t.query_id = i.query_id AND t.ts BETWEEN i.s AND i.e GROUP BY ALL")
def inside_closed(spark, d):
    j = ten(spark, d).join(views.intervals(spark, d), "query_id").where(tl.inside_closed(F.col("ts"), F.col("s"), F.col("e")))
    return j.groupBy("query_id").agg(F.min("rank").alias("first_rank"))


@query("j08_overlap", "qry ivl seg", "SELECT q.query_id, s.segment_id FROM qry q JOIN ivl i USING (query_id) JOIN seg s ON s.video_id = q.video_id AND s.start_s <= i.e AND s.end_s >= i.s GROUP BY ALL")
def overlap(spark, d):
    """Segments of a query's video that share a point with one of its intervals."""
    q = views.queries(spark, d).select("query_id", "video_id").join(views.intervals(spark, d), "query_id")
    j = tl.overlapping(q, views.segments(spark, d), ["video_id"], ("s", "e"), ("start_s", "end_s"))
    return j.select("query_id", "segment_id").distinct()


@query("j09_all_of", "qry ivl seg cand pool", f"""WITH {TEN}, v AS (SELECT DISTINCT t.query_id, 'visual' AS m FROM ten t JOIN ivl i ON t.query_id = i.query_id AND t.ts BETWEEN i.s AND i.e),
s AS (SELECT DISTINCT q.query_id, 'speech' AS m FROM qry q JOIN ivl i USING (query_id) JOIN seg g ON g.video_id = q.video_id AND g.start_s <= i.e AND g.end_s >= i.s),
need AS (SELECT query_id, unnest(CASE modality_requirement WHEN 'visual' THEN ['visual'] WHEN 'speech' THEN ['speech'] ELSE ['visual', 'speech'] END) AS m FROM qry WHERE modality_requirement IS NOT NULL),
have AS (SELECT * FROM v UNION ALL SELECT * FROM s)
SELECT n.query_id, count(*) AS needed, count(h.m) AS met, count(*) = count(h.m) AS relevant FROM need n LEFT JOIN have h USING (query_id, m) GROUP BY n.query_id""")
def all_of(spark, d):
    """Relational division: relevant if every required modality has an overlap."""
    v = inside_closed(spark, d).select("query_id", F.lit("visual").alias("m"))
    s = overlap(spark, d).select("query_id", F.lit("speech").alias("m")).distinct()
    need = F.when(F.col("modality_requirement") == "visual", F.array(F.lit("visual"))).when(F.col("modality_requirement") == "speech", F.array(F.lit("speech"))).otherwise(F.array(F.lit("visual"), F.lit("speech")))
    n = views.queries(spark, d).where(F.col("modality_requirement").isNotNull()).select("query_id", F.explode(need).alias("m"))
    j = n.join(v.unionByName(s).withColumn("hit", F.lit(1)), ["query_id", "m"], "left")
    return j.groupBy("query_id").agg(F.count("*").alias("needed"), F.count("hit").alias("met"), (F.count("*") == F.count("hit")).alias("relevant"))


@query("j10_any_of", "qry ivl fine", "SELECT q.query_id, i.ord, bool_or(u.unit_id IS NOT NULL) AS hit FROM qry q JOIN ivl i USING (query_id) LEFT JOIN fine u ON u.video_id = q.video_id AND u.start_seconds <= i.e AND u.end_seconds >= i.s GROUP BY ALL")
def any_of(spark, d):
    """Whether any unit overlaps an expected interval, interval by interval."""
    q = views.queries(spark, d).select("query_id", "video_id").join(views.intervals(spark, d), "query_id")
    u = views.units(spark, d, "fine").select("video_id", "start_seconds", "end_seconds")
    hit = tl.overlapping(q, u, ["video_id"], ("s", "e"), ("start_seconds", "end_seconds")).select("query_id", "ord").distinct().withColumn("hit", F.lit(True))
    return q.select("query_id", "ord").join(hit, ["query_id", "ord"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


@query("j11_neighbours", "fine", """SELECT video_id, unit_id, lag(unit_id) OVER w AS before, lead(unit_id) OVER w AS after, lead(start_seconds) OVER w - start_seconds AS step
FROM fine WINDOW w AS (PARTITION BY video_id ORDER BY start_seconds, unit_id)""")
def neighbours(spark, d):
    w = W.partitionBy("video_id").orderBy("start_seconds", "unit_id")
    return views.units(spark, d, "fine").select("video_id", "unit_id", F.lag("unit_id").over(w).alias("before"), F.lead("unit_id").over(w).alias("after"), (F.lead("start_seconds").over(w) - F.col("start_seconds")).alias("step"))


WINDOWS = f"""WITH {TEN}, dur AS (SELECT video_id, max(duration_s) AS duration FROM vid GROUP BY 1),
w AS (SELECT query_id, video_id, greatest(ts - 4e0, 0e0) AS s, least(ts + 4e0, duration) AS e FROM ten JOIN dur USING (video_id) WHERE rank <= 5),
r AS (SELECT *, max(e) OVER (PARTITION BY query_id, video_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m, row_number() OVER (PARTITION BY query_id, video_id ORDER BY s, e) AS n FROM w),
k AS (SELECT *, sum(CASE WHEN m IS NULL OR s > m THEN 1 ELSE 0 END) OVER (PARTITION BY query_id, video_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS k FROM r),
win AS (SELECT query_id, video_id, k, min(s) AS start, max(e) AS "end" FROM k GROUP BY ALL)"""


def local_windows(spark, d):
    dur = views.videos(spark, d).groupBy("video_id").agg(F.max("duration_s").alias("duration"))
    return tl.merged_windows(ten(spark, d, 5).join(dur, "video_id"), ["query_id", "video_id"], "ts", 4.0, "duration")


query("t07_local_windows", "qry vid cand pool", WINDOWS + ' SELECT query_id, video_id, start, "end" FROM win')(local_windows)


@query("t08_secondary_grid", "qry vid cand pool", WINDOWS + ", g AS (SELECT query_id, video_id, unnest(generate_series(CAST(ceil(start / 2e0) AS BIGINT), CAST(floor(\"end\" / 2e0) AS BIGINT))) * 2e0 AS ts FROM win) SELECT DISTINCT query_id, video_id, ts FROM g")
def secondary_grid(spark, d):
    return tl.grid(local_windows(spark, d), ["query_id", "video_id"], 2.0)


@query("j12_window_members", "qry vid frm cand pool", WINDOWS + ' SELECT DISTINCT w.query_id, f.frame_idx FROM win w JOIN frm f ON f.video_id = w.video_id AND f.ts BETWEEN w.start AND w."end"')
def window_members(spark, d):
    """Frames inside any merged window of a query: its grid of frame times, met by equality."""
    g = tl.grid(local_windows(spark, d), ["query_id", "video_id"], views.FRAME_S)
    return g.join(views.frames(spark, d), ["video_id", "ts"]).select("query_id", "frame_idx")


@query("j13_near_semi", "qry ivl cand pool", f"WITH {TEN} SELECT t.query_id, t.rank FROM ten t SEMI JOIN ivl i ON t.query_id = i.query_id AND (abs(t.ts - i.s) <= 0.56e0 OR abs(t.ts - i.e) <= 0.56e0)")
def near_semi(spark, d):
    """Candidates within a tolerance of some observed time."""
    i = views.intervals(spark, d).select(F.col("query_id").alias("q"), "s", "e")
    on = (F.col("q") == F.col("query_id")) & ((F.abs(F.col("ts") - F.col("s")) <= 0.56) | (F.abs(F.col("ts") - F.col("e")) <= 0.56))
    return ten(spark, d).join(i, on, "left_semi").select("query_id", "rank")


@query("j14_near_anti", "seg frm", "SELECT segment_id FROM seg s ANTI JOIN frm f ON f.video_id = s.video_id AND abs(f.ts - s.start_s) <= 0.25e0")
def near_anti(spark, d):
    """Segments whose start has no frame within 0.25 s: buckets of the tolerance make the range an equi-join."""
    near = F.floor(F.col("start_s") / 0.25).cast("bigint")
    s = views.segments(spark, d).select("segment_id", "video_id", "start_s")
    b = s.withColumn("b", F.explode(F.array(near - 1, near, near + 1)))
    f = views.frames(spark, d).select("video_id", "ts", F.floor(F.col("ts") / 0.25).cast("bigint").alias("b"))
    hit = b.join(f, ["video_id", "b"]).where(F.abs(F.col("ts") - F.col("start_s")) <= 0.25).select("segment_id").distinct()
    return s.join(hit, "segment_id", "left_anti").select("segment_id")


TWO = "t AS (SELECT query_id, video_id, split, list_distinct(tokens) AS tokens FROM (SELECT query_id, video_id, " + SQL_TOKENS.format("query_text") + " AS tokens FROM qry) a JOIN (SELECT DISTINCT video_id, split FROM vid) USING (video_id))"


@query("j15_jaccard_pairs", "qry vid", f"""WITH {TWO}, p AS (SELECT a.query_id AS left_id, b.query_id AS right_id, len(list_intersect(a.tokens, b.tokens)) AS common, len(a.tokens) + len(b.tokens) AS n
FROM t a JOIN t b ON a.split = 'train' AND b.split = 'heldout') SELECT left_id, right_id, round(CASE WHEN n = 0 THEN 1 ELSE common / CAST(n - common AS DOUBLE) END, 6) AS jaccard FROM p WHERE CASE WHEN n = 0 THEN true ELSE common >= 0.8e0 * (n - common) END""")
def jaccard_pairs(spark, d):
    """Pairs of a train and a held-out query whose words overlap by 0.8 or more, by an inverted index of prefixes."""
    v = views.videos(spark, d).select("video_id", "split").distinct()
    q = views.queries(spark, d).select("query_id", "video_id", F.array_distinct(tokens(F.col("query_text"))).alias("tokens")).join(v, "video_id")
    q = q.where(F.col("split").isin("train", "heldout")).select("query_id", "split", "tokens")
    return overlapping_sets(q.where("split = 'train'").select(F.col("query_id").alias("left_id"), "tokens"), q.where("split = 'heldout'").select(F.col("query_id").alias("right_id"), "tokens"))


@query("j16_paired", "qry cand pool", f"""WITH {TEN}, a AS (SELECT query_id, min(ts) FILTER (rank = 1) AS base FROM ten GROUP BY 1), b AS (SELECT query_id, min(ts) FILTER (rank = 2) AS other FROM ten WHERE rank > 1 GROUP BY 1)
SELECT coalesce(a.query_id, b.query_id) AS query_id, base, other, CASE WHEN a.query_id IS NULL THEN 'missing_base' WHEN b.query_id IS NULL THEN 'missing_other' ELSE 'paired' END AS state FROM a FULL JOIN b ON a.query_id = b.query_id""")
def paired(spark, d):
    """Baseline and candidate side by side; what one of them lacks is reported, not dropped."""
    t = ten(spark, d)
    a = t.groupBy("query_id").agg(F.min(F.when(F.col("rank") == 1, F.col("ts"))).alias("base")).withColumn("_a", F.lit(1))
    b = t.where("rank > 1").groupBy("query_id").agg(F.min(F.when(F.col("rank") == 2, F.col("ts"))).alias("other")).withColumn("_b", F.lit(1))
    state = F.when(F.col("_a").isNull(), "missing_base").when(F.col("_b").isNull(), "missing_other").otherwise("paired")
    return a.join(b, "query_id", "full").select("query_id", "base", "other", state.alias("state"))


@query("j17_exactly_once", "qry", "SELECT query_id, count(*) AS n FROM (SELECT query_id, video_id FROM (SELECT DISTINCT query_id, video_id FROM coarse_candidates) c SEMI JOIN qry q USING (query_id, video_id) UNION ALL SELECT query_id, video_id FROM qry) x GROUP BY ALL HAVING count(*) <> 2")
def exactly_once(spark, d):
    """Queries that were not observed exactly once in their own video."""
    q = views.queries(spark, d).select("query_id", "video_id")
    c = load(spark, d, "coarse_candidates").select("query_id", "video_id").distinct().join(q, ["query_id", "video_id"], "left_semi")
    return c.unionByName(q).groupBy("query_id").agg(F.count("*").alias("n")).where("n <> 2")


#: Seconds by which sampled times may be off.
OFF = 0.05


@query("j19_pairs_within", "qry cand pool", f"WITH {TEN}, " + "nx AS (" + " UNION ALL ".join(f"SELECT query_id, candidate_id AS x, lead(candidate_id, {k}) OVER w AS y, lead(ts, {k}) OVER w - ts AS gap FROM ten WINDOW w AS (PARTITION BY query_id ORDER BY ts, candidate_id)" for k in range(1, 10)) + ") SELECT query_id, least(x, y) AS a, greatest(x, y) AS b, round(gap, 6) AS gap FROM nx WHERE gap <= 10.05e0")
def pairs_within(spark, d):
    return tl.neighbours_within(ten(spark, d), ["query_id"], "ts", "candidate_id", 10 + OFF).withColumn("gap", F.round("gap", 6))


TENV = ", en AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, count(*) OVER () AS c FROM embeddings), tv AS (SELECT t.*, en.v FROM ten t JOIN en ON en.vec_id = t.candidate_id % en.c)"


@query("t16_redundancy", "qry cand pool", f"""WITH {TEN}{TENV}, pr AS (SELECT a.query_id, a.candidate_id AS a, b.candidate_id AS b, abs(a.ts - b.ts) AS gap, list_dot_product(a.v, b.v) AS cosine FROM tv a JOIN tv b ON a.query_id = b.query_id AND a.candidate_id < b.candidate_id),
g AS (SELECT query_id, ts - lag(ts) OVER (PARTITION BY query_id ORDER BY ts) AS gap FROM ten), gs AS (SELECT query_id, list(round(gap, 6) ORDER BY gap) FILTER (gap IS NOT NULL) AS gaps FROM g GROUP BY 1),
rg AS (SELECT query_id, list_reduce(list_prepend(NULL, list_transform(list(ts ORDER BY ts), lambda x: {{'n': 0, 'a': x}})), lambda acc, x: CASE WHEN acc IS NULL THEN {{'n': 1, 'a': x.a}} WHEN x.a - acc.a > 5.05e0 THEN {{'n': acc.n + 1, 'a': x.a}} ELSE acc END).n AS regions FROM ten GROUP BY 1),
c AS (SELECT query_id, count(*) AS n, max(score) - min(score) AS spread FROM ten GROUP BY 1),
w AS (SELECT query_id, """ + ", ".join(f"count(*) FILTER (gap <= {r} + 0.05e0) AS w{r}, len(list_distinct(list_concat(coalesce(list(a) FILTER (gap <= {r} + 0.05e0), []), coalesce(list(b) FILTER (gap <= {r} + 0.05e0), [])))) AS n{r}" for r in (1, 2, 5, 10)) + """, count(*) FILTER (round(cosine, 9) >= 0.98e0) AS same FROM pr GROUP BY 1)
SELECT c.query_id, """ + ", ".join(f"coalesce(w{r}, 0) AS pairs_{r}, coalesce(n{r}, 0) AS near_{r}" for r in (1, 2, 5, 10)) + """, coalesce(gaps, []) AS gaps, regions, round(spread, 6) AS spread, coalesce(same, 0) AS duplicates, round(CASE WHEN n > 1 THEN coalesce(same, 0) / (n * (n - 1) / 2e0) ELSE 0 END, 6) AS duplicate_rate FROM c JOIN rg USING (query_id) LEFT JOIN gs USING (query_id) LEFT JOIN w USING (query_id)""")
def redundancy(spark, d):
    """How much the ten best candidates of a query repeat each other; vectors stand for frames by id."""
    from cuelake.plans.questions import embedded

    t = embedded(ten(spark, d), spark, d, F.col("candidate_id"))
    r = ev.redundancy(t, ["query_id"], "ts", "score", "candidate_id", "embedding", OFF)
    return r.withColumns({"gaps": F.transform("gaps", lambda x: F.round(x, 6)), "spread": F.round("spread", 6), "duplicate_rate": F.round("duplicate_rate", 6)})


@query("t01_sliding_windows", "vid", """WITH m AS (SELECT video_id, max(duration_s) AS d FROM vid WHERE duration_s > 0 GROUP BY 1), w AS (SELECT video_id, d, unnest(generate_series(0, CAST(ceil(d / 4e0) AS BIGINT) - 1)) AS n FROM m)
SELECT video_id, n, n * 4e0 AS start, least(n * 4e0 + 8e0, d) AS "end", list_transform([0, 1, 2, 3], lambda i: round(n * 4e0 + (i + 0.5e0) * (least(n * 4e0 + 8e0, d) - n * 4e0) / 4, 6)) AS samples FROM w WHERE n = 0 OR (n - 1) * 4e0 + 8e0 < d""")
def sliding_windows(spark, d):
    m = views.videos(spark, d).groupBy("video_id").agg(F.max("duration_s").alias("d"))
    return tl.sliding_windows(m, "video_id", "d", 8.0, 4.0, 4).withColumn("samples", F.transform("samples", lambda x: F.round(x, 6)))


SAMPLING = """SELECT video_id, frame_idx * 5e0 AS ts FROM frm WHERE frame_idx % 3 = 0"""


@query("s13_frame_sampling", "frm", SAMPLING)
@query("t02_greedy_sampling", "frm", SAMPLING)
def greedy_sampling(spark, d):
    """Frames at least 12 s after the one selected before, from the first on: every third of a 5 s grid."""
    f = tl.sampled(views.frames(spark, d).select("video_id", "ts"), "video_id", "ts", 12.0)
    return f.where("selected").select("video_id", "ts")


GREEDY = """, f AS (SELECT query_id, rank, [ts] AS kept FROM ten WHERE rank = 1 UNION ALL
SELECT f.query_id, f.rank + 1, CASE WHEN len(list_filter(f.kept, lambda y: {0})) > 0 THEN f.kept ELSE list_append(f.kept, t.ts) END FROM f JOIN ten t ON t.query_id = f.query_id AND t.rank = f.rank + 1)
SELECT query_id, arg_max(kept, rank) AS kept FROM f GROUP BY 1"""
T_REC = f"WITH RECURSIVE {TEN}"


@query("t06_diversify", "qry cand pool", T_REC + GREEDY.format("abs(y - t.ts) < 6e0"))
def diversify(spark, d):
    """Candidates in rank order, each kept if at least 6 s from all kept."""
    return by_list(ten(spark, d), order="rank").select("query_id", tl.spaced(F.col("times"), 6.0).alias("kept"))


@query("t09_temporal_nms", "qry cand pool", T_REC + GREEDY.format("abs(y - t.ts) <= 2.05e0"))
def temporal_nms(spark, d):
    """Suppression along time: a candidate within radius + 0.05 s of a kept one is dropped."""
    return by_list(ten(spark, d), order="rank").select("query_id", tl.spaced(F.col("times"), 2.05, strictly=True).alias("kept"))


@query("t15_regions", "qry cand pool", T_REC + """, o AS (SELECT query_id, ts, row_number() OVER (PARTITION BY query_id ORDER BY ts, candidate_id) AS i FROM ten),
f AS (SELECT query_id, i, ts AS a, 1 AS n FROM o WHERE i = 1 UNION ALL SELECT f.query_id, f.i + 1, CASE WHEN o.ts - f.a > 5.05e0 THEN o.ts ELSE f.a END, f.n + CASE WHEN o.ts - f.a > 5.05e0 THEN 1 ELSE 0 END FROM f JOIN o ON o.query_id = f.query_id AND o.i = f.i + 1)
SELECT query_id, max(n) AS regions FROM f GROUP BY 1""")
def region_counts(spark, d):
    return by_list(ten(spark, d)).select("query_id", tl.regions(F.col("times"), 5.05).cast("int").alias("regions"))


@query("t14_represented", "qry vid cand pool", f"WITH {TEN}, dur AS (SELECT video_id, max(duration_s) AS duration FROM vid GROUP BY 1) SELECT query_id, rank, greatest(ts - 2.5e0, 0) AS s, least(ts + 2.5e0, duration) AS e FROM ten JOIN dur USING (video_id)")
def represented(spark, d):
    dur = views.videos(spark, d).groupBy("video_id").agg(F.max("duration_s").alias("duration"))
    return ten(spark, d).join(dur, "video_id").select("query_id", "rank", F.greatest(F.col("ts") - 2.5, F.lit(0.0)).alias("s"), F.least(F.col("ts") + 2.5, "duration").alias("e"))


@query("t17_diversity_summary", "qry cand pool", T_REC + """, f5 AS (SELECT * FROM ten WHERE rank <= 5), o AS (SELECT query_id, ts, row_number() OVER (PARTITION BY query_id ORDER BY ts, candidate_id) AS i FROM f5),
f AS (SELECT query_id, i, ts AS a, 1 AS n FROM o WHERE i = 1 UNION ALL SELECT f.query_id, f.i + 1, CASE WHEN o.ts - f.a > 5.05e0 THEN o.ts ELSE f.a END, f.n + CASE WHEN o.ts - f.a > 5.05e0 THEN 1 ELSE 0 END FROM f JOIN o ON o.query_id = f.query_id AND o.i = f.i + 1),
r AS (SELECT query_id, max(n) AS regions FROM f GROUP BY 1), g AS (SELECT query_id, coalesce(min(gap), 0) AS least FROM (SELECT query_id, ts - lag(ts) OVER (PARTITION BY query_id ORDER BY i) AS gap FROM o) x GROUP BY 1),
c AS (SELECT a.query_id, avg(CAST(EXISTS (SELECT 1 FROM f5 b WHERE b.query_id = a.query_id AND b.rank <> a.rank AND abs(b.ts - a.ts) <= 5.05e0) AS INT)) AS crowded FROM f5 a GROUP BY 1)
SELECT count(*) AS n, round(avg(regions), 6) AS mean_regions, round(median(least), 6) AS median_least_gap, round(avg(crowded), 6) AS mean_crowding FROM r JOIN g USING (query_id) JOIN c USING (query_id)""")
def diversity_summary(spark, d):
    """How spread out the five best candidates are: regions, least gaps, and the share that has another within 5 s."""
    l = by_list(ten(spark, d, 5), keys=["query_id"])
    t = F.col("times")
    gaps = F.when(F.size(t) > 1, F.zip_with(F.slice(t, 2, 5), F.slice(t, F.lit(1), F.size(t) - 1), lambda a, b: a - b))
    crowded = F.size(F.filter(t, lambda x: F.size(F.filter(t, lambda y: F.abs(x - y) <= 5 + OFF)) > 1)) / F.size(t)
    x = l.select(tl.regions(t, 5 + OFF).alias("r"), F.coalesce(F.array_min(gaps), F.lit(0.0)).alias("g"), crowded.alias("c"))
    one = x.agg(F.count("*").alias("n"), F.round(F.avg("r"), 6).alias("mean_regions"), F.round(F.avg("c"), 6).alias("mean_crowding"))
    return one.crossJoin(F.broadcast(metrics.quantiles(x, [], "g", {"median_least_gap": ("linear", 0.5)}))).withColumn("median_least_gap", F.round("median_least_gap", 6))


EMB = "e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), c AS (SELECT vec_id, label, 1 - list_dot_product(v, lag(v) OVER w) AS back, 1 - list_dot_product(v, lead(v) OVER w) AS ahead FROM e WINDOW w AS (PARTITION BY label ORDER BY vec_id))"


@query("t24_adjacent_change", "", f"WITH {EMB} SELECT vec_id, round(coalesce(greatest(back, ahead), 0), 6) AS change FROM c")
def adjacent_change(spark, d):
    return vectors.adjacent_change(load(spark, d, "embeddings"), "label", "vec_id", "embedding").select("vec_id", F.round("change", 6).alias("change"))


@query("t12_scenes", "", f"WITH {EMB} SELECT vec_id, label, sum(CASE WHEN back >= 0.7e0 THEN 1 ELSE 0 END) OVER (PARTITION BY label ORDER BY vec_id ROWS UNBOUNDED PRECEDING) AS scene FROM c")
def scenes(spark, d):
    return vectors.scenes(load(spark, d, "embeddings"), "label", "vec_id", "embedding", 0.7).select("vec_id", "label", "scene")


@query("t13_best_of_scene", "", f"""WITH {EMB}, s AS (SELECT vec_id, label, sum(CASE WHEN back >= 0.7e0 THEN 1 ELSE 0 END) OVER (PARTITION BY label ORDER BY vec_id ROWS UNBOUNDED PRECEDING) AS scene, vec_id * 37 % 101 AS score FROM c),
b AS (SELECT *, row_number() OVER (PARTITION BY label, scene ORDER BY score DESC, vec_id) AS r FROM s) SELECT label, scene, vec_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM b WHERE r = 1) x WHERE rank <= 5""")
def best_of_scene(spark, d):
    """The best frame of each scene, then the five best scenes of a video; the score comes from the id."""
    s = scenes(spark, d).withColumn("score", F.col("vec_id") * 37 % 101)
    best = s.withColumn("r", F.row_number().over(W.partitionBy("label", "scene").orderBy(F.desc("score"), "vec_id"))).where("r = 1")
    best = best.withColumn("rank", F.row_number().over(W.partitionBy("label").orderBy(F.desc("score"), "vec_id")).cast("bigint"))
    return best.where("rank <= 5").select("label", "scene", "vec_id", "rank")


@query("s24_multiscale_frames", "", f"WITH {EMB} SELECT vec_id, label, vec_id % 5 = 0 AS base FROM c WHERE vec_id % 5 = 0 OR (coalesce(greatest(back, ahead), 0) >= 0.9e0 AND vec_id % 5 BETWEEN 2 AND 3)")
def multiscale_frames(spark, d):
    """Base frames, and frames between them that change much and have no base frame next to them."""
    c = vectors.adjacent_change(load(spark, d, "embeddings"), "label", "vec_id", "embedding")
    base = F.col("vec_id") % 5 == 0
    return c.where(base | ((F.col("change") >= 0.9) & (F.col("vec_id") % 5).between(2, 3))).select("vec_id", "label", base.alias("base"))


@query("t25_support", "qry cand pool", f"""WITH {TEN} SELECT a.query_id, a.rank, round(count(b.rank) FILTER (abs(a.ts - b.ts) <= 10.05e0) / CAST(greatest(count(b.rank), 1) AS DOUBLE), 6) AS support, round(min(abs(a.ts - b.ts)), 6) AS nearest
FROM ten a LEFT JOIN ten b ON a.query_id = b.query_id AND a.rank <> b.rank GROUP BY ALL""")
def support(spark, d):
    """Share of a list's other candidates within 10.05 s, and the gap to the nearest: inside the bounded list itself."""
    t = ten(spark, d)
    lists = t.groupBy("query_id").agg(F.collect_list(F.struct("rank", "ts")).alias("l"))
    j = t.join(lists, "query_id").withColumn("o", F.transform(F.filter("l", lambda x: x["rank"] != F.col("rank")), lambda x: F.abs(x.ts - F.col("ts"))))
    share = F.size(F.filter("o", lambda x: x <= 10.05)) / F.greatest(F.size("o"), F.lit(1))
    return j.select("query_id", "rank", F.round(share, 6).alias("support"), F.round(F.array_min("o"), 6).alias("nearest"))


@query("t05_context_groups", "fine", """WITH p AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY start_seconds, unit_id) - 1 AS pos FROM fine)
SELECT video_id, pos // 3 AS section, list(unit_id ORDER BY pos) AS fine_ids, min(start_seconds) AS start_seconds, max_by(end_seconds, pos) AS end_seconds, len(string_agg(text, ' ' ORDER BY pos)) AS characters FROM p GROUP BY ALL""")
def context_groups(spark, d):
    """Sections of three fine units each, in order."""
    pos = F.row_number().over(W.partitionBy("video_id").orderBy("start_seconds", "unit_id")) - 1
    u = views.units(spark, d, "fine").withColumn("pos", pos.cast("bigint"))
    g = u.groupBy("video_id", F.floor(F.col("pos") / 3).cast("bigint").alias("section")).agg(F.array_sort(F.collect_list(F.struct("pos", "unit_id", "text"))).alias("m"), F.min("start_seconds").alias("start_seconds"), F.max_by("end_seconds", "pos").alias("end_seconds"))
    return g.select("video_id", "section", F.transform("m", lambda x: x.unit_id).alias("fine_ids"), "start_seconds", "end_seconds", F.length(F.array_join(F.transform("m", lambda x: x.text), " ")).cast("bigint").alias("characters"))


@query("t21_topic_terms", "ctx", f"""WITH w AS (SELECT video_id, unit_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM (SELECT video_id, unit_id, regexp_extract_all({SQL_FOLD.format('text')}, '[a-z][a-z0-9''-]{{2,}}') AS ws FROM ctx) x),
c AS (SELECT video_id, unit_id, w, count(*) AS n, min(pos) AS first FROM w WHERE w NOT IN ({', '.join(f"'{x}'" for x in TOPIC_STOP)}) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY video_id, unit_id ORDER BY n DESC, first, w) AS r FROM c)
SELECT video_id, unit_id, list(w ORDER BY r) AS terms FROM r WHERE r <= 8 GROUP BY ALL""")
def topics(spark, d):
    return topic_terms(views.units(spark, d, "context"), ["video_id", "unit_id"], "text")


@query("g10_interval_order", "qry ivl", "SELECT query_id, ord FROM (SELECT *, lag(e) OVER (PARTITION BY query_id ORDER BY ord) AS before FROM ivl) x WHERE before > s")
def interval_order(spark, d):
    """Intervals that begin before the one listed ahead of them ends."""
    w = W.partitionBy("query_id").orderBy("ord")
    return views.intervals(spark, d).withColumn("before", F.lag("e").over(w)).where(F.col("before") > F.col("s")).select("query_id", "ord")
