"""Scans, joins, retrieval and fusion."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuelake.operators import fusion, search, vectors
from cuelake.operators.blocks import ordered_total
from cuelake.plans.common import Registry
from cuelake.operators.text import SQL_TOKENS, sql_bm25, tokens
from cuelake.sources import files, views
from cuelake.sources.tables import load
from cuelake.storage import shared_path

query = Registry()
QUERIES, SQL = query.queries, query.sql

SPOKEN = f"""docs AS (SELECT video_id, segment_id, {SQL_TOKENS.format('text')} AS tokens FROM seg),
asked AS (SELECT video_id, query_id, {SQL_TOKENS.format('query_text')} AS tokens FROM qry),
{sql_bm25('docs', 'asked', 'video_id', 'segment_id', 'query_id')},
spoken AS (SELECT * FROM (SELECT b.video_id, b.query_id, b.segment_id, round(b.score, 9) AS score, s.start_s, s.end_s, s.text,
    row_number() OVER (PARTITION BY b.query_id ORDER BY round(b.score, 9) DESC, s.start_s, b.segment_id) AS rank
  FROM bm25 b JOIN seg s ON b.segment_id = s.segment_id WHERE round(b.score, 9) > 0) x WHERE rank <= 50)"""
NEAREST = """near AS (SELECT p.*, (SELECT arg_min(thumbnail, abs(f.ts - p.start_s) * 1e6 + f.frame_idx * 1e-6) FROM frm f
  WHERE f.video_id = p.video_id AND f.ts BETWEEN p.start_s - 6 AND p.start_s + 6) AS close,
  (SELECT arg_max(thumbnail, f.ts) FROM frm f WHERE f.video_id = p.video_id) AS last FROM spoken p)"""
SLANE = f"{SPOKEN}, {NEAREST}, slane AS (SELECT * EXCLUDE (close, last), coalesce(close, last) AS thumbnail FROM near)"
LANES = f"""{SLANE}, lanes AS (
  SELECT query_id, 'visual' AS lane, rank, thumbnail, score, ts, CAST(NULL AS DOUBLE) AS "end", CAST(NULL AS VARCHAR) AS text FROM vlane
  UNION ALL SELECT query_id, 'speech', rank, thumbnail, score, start_s, end_s, text FROM slane WHERE thumbnail IS NOT NULL),
buckets AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, lane, thumbnail ORDER BY rank) AS nth FROM lanes) x WHERE nth = 1),
merged AS (SELECT query_id, thumbnail, sum(1e0 / (60 + rank)) AS score, coalesce(max(ts) FILTER (lane = 'speech'), max(ts)) AS ts, max("end") AS "end", max(text) AS text,
    max(rank) FILTER (lane = 'visual') AS visual_rank, max(rank) FILTER (lane = 'speech') AS speech_rank FROM buckets GROUP BY ALL),
fused AS (SELECT *, CASE WHEN visual_rank IS NULL THEN 'speech' WHEN speech_rank IS NULL THEN 'visual' ELSE 'visual+speech' END AS modality,
    row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, ts, visual_rank IS NULL, coalesce(visual_rank, speech_rank)) AS fused_rank FROM merged)"""
LANE_VIEWS = "seg qry vid frm cand pool vlane"


def with_lanes(body: str) -> str:
    return f"WITH {LANES} {body}"


@query("s01_segment_scan", "seg", "SELECT video_id, segment_id, start_s, row_number() OVER (PARTITION BY video_id ORDER BY start_s, segment_id) AS pos FROM seg")
def segment_scan(spark, d):
    w = W.partitionBy("video_id").orderBy("start_s", "segment_id")
    return views.segments(spark, d).select("video_id", "segment_id", "start_s", F.row_number().over(w).cast("bigint").alias("pos"))


@query("s02_ready_lookup", "vid seg", "SELECT v.video_id, count(s.segment_id) AS segments, count(s.segment_id) > 0 AS ready FROM vid v LEFT JOIN seg s USING (video_id) GROUP BY ALL")
def ready_lookup(spark, d):
    n = views.segments(spark, d).groupBy("video_id").agg(F.count("*").alias("segments"))
    v = views.videos(spark, d).select("video_id").distinct().join(n, "video_id", "left").withColumn("segments", F.coalesce("segments", F.lit(0)))
    return v.withColumn("ready", F.col("segments") > 0)


@query("s03_literal_search", "seg", "SELECT segment_id, video_id, start_s FROM seg WHERE contains(lower(text), lower(trim(' The Copper 100% ')) [1:10])")
def literal_search(spark, d):
    """Literal text, whatever letter case; signs like % and _ mean themselves."""
    return views.segments(spark, d).where(F.contains(F.lower("text"), F.left(F.lower(F.trim(F.lit(" The Copper 100% "))), F.lit(10)))).select("segment_id", "video_id", "start_s")


@query("s15_segment_normalise", "vid", """SELECT DISTINCT s.segment_id, s.start_s, least(s.end_s, v.duration_s) AS end_s
FROM segments s JOIN (SELECT video_id, max(duration_s) AS duration_s FROM vid GROUP BY 1) v USING (video_id)
WHERE isfinite(s.start_s) AND isfinite(s.end_s) AND s.start_s <= s.end_s AND s.start_s < v.duration_s AND s.segment_id IS NOT NULL""")
def segment_normalise(spark, d):
    """Segments inside their medium: unknown, reversed and late ones left out, ends clipped to the duration."""
    v = views.videos(spark, d).groupBy("video_id").agg(F.max("duration_s").alias("duration_s"))
    s = load(spark, d, "segments").where(views.finite("start_s", "end_s") & (F.col("start_s") <= F.col("end_s")) & F.col("segment_id").isNotNull())
    s = s.join(v, "video_id").where(F.col("start_s") < F.col("duration_s"))
    return s.select("segment_id", "start_s", F.least("end_s", "duration_s").alias("end_s")).distinct()


@query("s05_listing", "vid", "SELECT video_id, max(v.added_at) AS added_at, row_number() OVER (ORDER BY max(v.added_at) DESC, video_id) AS pos FROM videos v WHERE video_id IS NOT NULL GROUP BY video_id")
def listing(spark, d):
    """All videos, those added last first; positions are totals over ranges of the sorted table."""
    v = load(spark, d, "videos").where(F.col("video_id").isNotNull()).groupBy("video_id").agg(F.max("added_at").alias("added_at"))
    v = v.withColumn("order", F.struct(-F.coalesce(F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', added_at)"), F.lit(-(1 << 62))), F.col("video_id"))).withColumn("one", F.lit(1).cast("bigint"))
    return ordered_total(v, [], "order", {"pos": "one"}).select("video_id", "added_at", "pos")


@query("s06_manifest_overlay", "vid", """SELECT video_id, coalesce(arg_max(license_name, added_at), 'unlicensed') AS license_name, coalesce(arg_max(split, added_at), 'none') AS split
FROM videos WHERE video_id IS NOT NULL GROUP BY video_id""")
def manifest_overlay(spark, d):
    """Later deliveries lie over earlier ones, field by field; what none of them knows gets a default."""
    v = load(spark, d, "videos").where(F.col("video_id").isNotNull())
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("added_at")))
    return v.groupBy("video_id").agg(F.coalesce(last("license_name"), F.lit("unlicensed")).alias("license_name"), F.coalesce(last("split"), F.lit("none")).alias("split"))


@query("s14_replaced_groups", "seg vid", "WITH h AS (SELECT DISTINCT video_id FROM vid WHERE split = 'heldout'), o AS (SELECT DISTINCT video_id FROM vid WHERE split = 'train') SELECT segment_id, 'heldout' AS split, upper(left(text, 1)) AS first FROM seg WHERE video_id IN (SELECT video_id FROM h) AND start_s >= 10 UNION ALL SELECT segment_id, 'train', left(text, 1) FROM seg WHERE video_id IN (SELECT video_id FROM o)")
def replaced_groups(spark, d):
    """Transcripts written by split, then one split written anew: its old rows are gone, those of the other stay."""
    v = views.videos(spark, d).where(F.col("split").isin("train", "heldout")).select("video_id", "split").distinct()
    s = views.segments(spark, d).join(v, "video_id").select("segment_id", "start_s", F.left("text", F.lit(1)).alias("first"), "split")
    path = shared_path(spark, "groups")
    files.replace_groups(s, path, "split")
    files.replace_groups(s.where("split = 'heldout' AND start_s >= 10").withColumn("first", F.upper("first")), path, "split")
    return spark.read.parquet(path).select("segment_id", F.col("split").cast("string").alias("split"), "first")


@query("s17_index_artifact", "", "SELECT vec_id, len(embedding) AS width FROM embeddings")
def index_artifact(spark, d):
    """A semantic index written with the model, revision and schema it was made with, and read for just these."""
    e = load(spark, d, "embeddings").select("vec_id", F.size("embedding").cast("bigint").alias("width"))
    path = shared_path(spark, "index")
    files.save_artifact(e, path, model="m", revision="r1", schema="2")
    return files.load_artifact(spark, path, model="m", revision="r1", schema="2")


@query("s11_duplicates", "vid", "SELECT source_sha256, count(*) AS n, min(video_id) AS first FROM vid WHERE source_sha256 IS NOT NULL AND NOT regexp_full_match(source_sha256, '0*') GROUP BY 1 HAVING count(*) > 1")
def duplicates(spark, d):
    v = views.videos(spark, d).where(F.col("source_sha256").isNotNull() & ~F.col("source_sha256").rlike("^0*$"))
    return v.groupBy("source_sha256").agg(F.count("*").alias("n"), F.min("video_id").alias("first")).where("n > 1")


@query("j01_frame_embedding", "", """WITH f AS (SELECT label AS video, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_idx, vec_id FROM embeddings)
SELECT f.video, f.frame_idx, f.frame_idx * 5e0 AS ts, f.vec_id, round(sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))), 6) AS length FROM f JOIN embeddings e USING (vec_id)""")
def frame_embedding(spark, d):
    """Row i of a matrix belongs to frame i: an equi-join on video and position."""
    e = load(spark, d, "embeddings")
    pos = (F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1).cast("bigint")
    f = e.select(F.col("label").alias("video"), pos.alias("frame_idx"), "vec_id")
    return f.join(e.select("vec_id", F.round(vectors.norm(F.col("embedding")), 6).alias("length")), "vec_id").withColumn("ts", F.col("frame_idx") * 5.0)


@query("j02_nearest_frame", "seg qry vid frm", f"WITH {SLANE.replace('spoken AS (', 'unused AS (', 1).replace(NEAREST, 'spoken AS (SELECT video_id, segment_id, start_s FROM seg), ' + NEAREST)} SELECT video_id, segment_id, thumbnail FROM slane")
def nearest_frame(spark, d):
    from cuelake.operators.timeline import nearest

    s = views.segments(spark, d).select("video_id", "segment_id", "start_s")
    return nearest(s, views.frames(spark, d), "video_id", "start_s", "ts", ["thumbnail"]).select("video_id", "segment_id", "thumbnail")


@query("r01_tokens", "qry", f"SELECT query_id, {SQL_TOKENS.format('query_text')} AS tokens FROM qry")
def query_tokens(spark, d):
    return views.queries(spark, d).select("query_id", tokens(F.col("query_text")).alias("tokens"))


@query("r02_bm25", "seg qry", f"WITH {SPOKEN} SELECT query_id, segment_id, round(score, 6) AS score FROM bm25")
def bm25_scores(spark, d):
    from cuelake.operators.text import bm25

    docs = views.segments(spark, d).select("video_id", "segment_id", tokens(F.col("text")).alias("tokens"))
    asked = views.queries(spark, d).select("video_id", "query_id", tokens(F.col("query_text")).alias("tokens"))
    return bm25(docs, asked, ["video_id"], "segment_id", "query_id").select("query_id", "segment_id", F.round("score", 6).alias("score"))


@query("r03_speech", "seg qry vid frm", f"WITH {SLANE} SELECT query_id, rank, segment_id, round(score, 6) AS score, thumbnail FROM slane")
def speech(spark, d):
    return search.speech_lane(spark, d).select("query_id", "rank", "segment_id", F.round("score", 6).alias("score"), "thumbnail")


@query("r04_normalise", "", "SELECT vec_id, list_transform(embedding, lambda x: round(CAST(x AS DOUBLE) / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6)) AS unit FROM embeddings")
def normalise(spark, d):
    return load(spark, d, "embeddings").select("vec_id", F.transform(vectors.normalized(F.col("embedding")), lambda x: F.round(x, 6)).alias("unit"))


TOPK = """SELECT query_id, vec_id, round(score, 6) AS score, rank FROM (
  SELECT q.vec_id AS query_id, e.vec_id, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 9) AS score,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 9) DESC, e.vec_id) AS rank
  FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0) x WHERE rank <= 10"""


@query("r05_top_k", "", TOPK)
def top_k(spark, d):
    """Exact nearest neighbours: every vector whose id is divisible by 20 against all."""
    e = load(spark, d, "embeddings")
    q = e.where(F.col("vec_id") % 20 == 0).withColumnRenamed("vec_id", "query_id")
    return vectors.top_k(e, q, "vec_id", "query_id", "embedding", 10).withColumn("score", F.round("score", 6))


@query("r06_visual_calibrated", LANE_VIEWS, """WITH cut AS (SELECT max(p.score) AS c FROM pool p JOIN qry q USING (query_id) WHERE q.query_type = 'NEGATIVE' AND p.video_id = q.video_id),
top AS (SELECT * FROM vlane WHERE rank <= 10)
SELECT t.query_id, count(*) AS returned, count(*) FILTER (t.score > c) AS accepted, count(*) FILTER (t.score > c) = 0 AS abstained FROM top t, cut GROUP BY t.query_id""")
def visual_calibrated(spark, d):
    """A cutoff above the best negative, applied after the top k: a query none of whose results pass abstains."""
    neg = views.queries(spark, d).where("query_type = 'NEGATIVE'").select("query_id", "video_id")
    cut = views.pool(spark, d).join(neg, ["query_id", "video_id"]).agg(F.max("score").alias("c"))
    top = views.visual_lane(spark, d).where("rank <= 10").crossJoin(F.broadcast(cut))
    n = F.count(F.when(F.col("score") > F.col("c"), 1))
    return top.groupBy("query_id").agg(F.count("*").alias("returned"), n.alias("accepted"), (n == 0).alias("abstained"))


@query("r08_fuse", LANE_VIEWS, with_lanes("SELECT query_id, thumbnail, round(score, 9) AS score, modality, fused_rank FROM fused"))
def fuse_all(spark, d):
    return fusion.fuse(search.lanes(spark, d), ["query_id"]).select("query_id", "thumbnail", F.round("score", 9).alias("score"), "modality", "fused_rank")


@query("j03_bucket_outer", LANE_VIEWS, with_lanes(" SELECT query_id, thumbnail, visual_rank, speech_rank FROM merged"))
def bucket_outer(spark, d):
    """Both lanes side by side on the bucket that they share; where one has none, its rank is null."""
    b = fusion.buckets(search.lanes(spark, d), ["query_id"])
    side = lambda x: b.where(F.col("lane") == x).select("query_id", "thumbnail", F.col("rank").alias(f"{x}_rank"))
    return side("visual").join(side("speech"), ["query_id", "thumbnail"], "full")


@query("r09_search_hybrid", LANE_VIEWS, with_lanes("SELECT query_id, fused_rank, thumbnail, ts, \"end\", text, round(score, 9) AS score, modality FROM fused WHERE fused_rank <= 8"))
def search_hybrid(spark, d):
    return search.search(spark, d).select("query_id", "fused_rank", "thumbnail", "ts", "end", "text", F.round("score", 9).alias("score"), "modality")


@query("r09_search_speech", "seg qry vid frm", f"WITH {SLANE} SELECT query_id, rank, thumbnail, start_s AS ts, round(score, 6) AS score FROM slane WHERE rank <= 8 AND thumbnail IS NOT NULL")
def search_speech(spark, d):
    return search.search(spark, d, "speech").select("query_id", "rank", "thumbnail", "ts", F.round("score", 6).alias("score"))


@query("r09_search_visual", LANE_VIEWS, "SELECT query_id, rank, thumbnail, ts, score FROM vlane WHERE rank <= 8")
def search_visual(spark, d):
    return search.search(spark, d, "visual").select("query_id", "rank", "thumbnail", "ts", "score")


@query("r19_raw_pool", "cand", "SELECT query_id, video_id, candidate_id, rank FROM cand WHERE rank <= 20")
def raw_pool(spark, d):
    return views.pool(spark, d, 20).select("query_id", "video_id", "candidate_id", "rank")


@query("r20_stable_search", "cand", "SELECT query_id, video_id, candidate_id, row_number() OVER (PARTITION BY query_id, video_id ORDER BY round(score, 3) DESC, ts, candidate_id) AS rank FROM cand")
def stable_search(spark, d):
    """Every candidate in a stable order, none suppressed."""
    w = W.partitionBy("query_id", "video_id").orderBy(F.desc(F.round("score", 3)), "ts", "candidate_id")
    return views.candidates(spark, d).select("query_id", "video_id", "candidate_id", F.row_number().over(w).cast("bigint").alias("rank"))


@query("f01_trace", LANE_VIEWS, with_lanes(""", n AS (SELECT query_id, lane, thumbnail, list_sort(list(rank) FILTER (nth > 1)) AS skipped FROM (SELECT *, row_number() OVER (PARTITION BY query_id, lane, thumbnail ORDER BY rank) AS nth FROM lanes) x GROUP BY ALL)
SELECT b.query_id, b.thumbnail, b.lane, b.rank, coalesce(n.skipped, []) AS skipped, round(1e0 / (60 + b.rank), 9) AS contribution, f.fused_rank, f.fused_rank - b.rank AS displacement
FROM buckets b JOIN fused f USING (query_id, thumbnail) JOIN n USING (query_id, lane, thumbnail)""").replace(") , n AS", "), n AS"))
def trace(spark, d):
    lanes = search.lanes(spark, d)
    f = fusion.fuse(lanes, ["query_id"]).select("query_id", "thumbnail", "fused_rank")
    b = fusion.buckets(lanes, ["query_id"]).join(f, ["query_id", "thumbnail"])
    return b.select("query_id", "thumbnail", "lane", "rank", "skipped", F.round(1 / (60 + F.col("rank")), 9).alias("contribution"), "fused_rank", (F.col("fused_rank") - F.col("rank")).alias("displacement"))


CONTRIB = """, c AS (SELECT b.query_id, b.thumbnail, b.lane, b.ts, b.rank, n.n, 1e0 / (60 + rank) AS rrf, (1e0 / (60 + rank) - 1e0 / (61 + n)) / (1e0 / 61 - 1e0 / (61 + n)) AS normalized60, (1e0 / (10 + rank) - 1e0 / (11 + n)) / (1e0 / 11 - 1e0 / (11 + n)) AS normalized10, (n - rank + 1) / CAST(n AS DOUBLE) AS percentile
  FROM buckets b JOIN (SELECT query_id, lane, max(rank) AS n FROM lanes GROUP BY ALL) n USING (query_id, lane))"""


@query("f02_contributions", LANE_VIEWS, with_lanes(CONTRIB + " SELECT query_id, thumbnail, lane, round(rrf, 9) AS rrf, round(normalized60, 9) AS normalized60, round(normalized10, 9) AS normalized10, round(percentile, 9) AS percentile FROM c"))
def contributions(spark, d):
    c = fusion.contributions(search.lanes(spark, d), ["query_id"])
    return c.select("query_id", "thumbnail", "lane", *(F.round(x, 9).alias(x) for x in ("rrf", "normalized60", "normalized10", "percentile")))


@query("f03_cap", LANE_VIEWS, with_lanes(CONTRIB + " SELECT query_id, thumbnail, round(CASE WHEN count(*) > 1 THEN least(sum(rrf), 1.5e0 * max(rrf)) ELSE sum(rrf) END, 9) AS score FROM c GROUP BY ALL"))
def cap(spark, d):
    g = fusion.contributions(search.lanes(spark, d), ["query_id"]).groupBy("query_id", "thumbnail").agg(F.sum("rrf").alias("s"), F.max("rrf").alias("m"), F.count("*").alias("n"))
    return g.select("query_id", "thumbnail", F.round(fusion.capped(F.col("s"), F.col("m"), F.col("n"), 1.5), 9).alias("score"))


_V = " UNION ALL ".join(
    f"SELECT query_id, '{n}' AS variant, thumbnail, coalesce(max(ts) FILTER (lane = 'speech'), max(ts)) AS ts, max(rank) FILTER (lane = 'visual') AS vr, max(rank) AS any_rank, " + (f"CASE WHEN count(*) > 1 THEN least(sum({m}), {c}e0 * max({m})) ELSE sum({m}) END" if c else f"sum({m})") + " AS score FROM c GROUP BY query_id, thumbnail"
    for n, m, c in fusion.VARIANTS
)


@query("f04_variants", LANE_VIEWS, with_lanes(CONTRIB + f", v AS ({_V}) SELECT query_id, variant, thumbnail, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, variant ORDER BY round(score, 12) DESC, ts, vr IS NULL, coalesce(vr, any_rank)) AS rank FROM v) x WHERE rank <= 5"))
def variants(spark, d):
    return fusion.variants(search.lanes(spark, d), ["query_id"], 5).select("query_id", "variant", "thumbnail", "rank")


DEPTH = """, dp AS (SELECT *, CASE WHEN visual_rank IS NOT NULL THEN dense_rank() OVER (PARTITION BY query_id, visual_rank IS NULL ORDER BY visual_rank) END AS vd, CASE WHEN speech_rank IS NOT NULL THEN dense_rank() OVER (PARTITION BY query_id, speech_rank IS NULL ORDER BY speech_rank) END AS sd FROM fused)"""


@query("f05_quota", LANE_VIEWS, with_lanes(DEPTH + """ SELECT query_id, thumbnail, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN coalesce(vd <= 1, false) OR coalesce(sd <= 1, false) THEN 0 ELSE 1 END, fused_rank) AS rank FROM dp) x WHERE rank <= 5"""))
def quota(spark, d):
    return fusion.quota(fusion.fuse(search.lanes(spark, d), ["query_id"]), ["query_id"], 1, 5).select("query_id", "thumbnail", "rank")


@query("f06_interleave", LANE_VIEWS, with_lanes(DEPTH + " SELECT query_id, thumbnail, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY least(2 * vd, 2 * sd + 1)) AS rank FROM dp) x WHERE rank <= 5"))
def interleave(spark, d):
    return fusion.interleaved(fusion.fuse(search.lanes(spark, d), ["query_id"]), ["query_id"], "visual", 5).select("query_id", "thumbnail", "rank")


@query("f07_preserve", LANE_VIEWS, with_lanes(DEPTH + """, p AS (SELECT *, coalesce(vd <= 2, false) OR coalesce(sd <= 2, false) AS safe FROM dp)
SELECT query_id, thumbnail, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY NOT safe, CASE WHEN safe THEN least(visual_rank, speech_rank) END, fused_rank, ts, thumbnail) AS rank FROM p) x WHERE rank <= 5"""))
def preserve(spark, d):
    return fusion.preserved(fusion.fuse(search.lanes(spark, d), ["query_id"]), ["query_id"], 2, 5).select("query_id", "thumbnail", "rank")


#: Another score beside that of the candidates, as a detector would give it: for most candidates, from their id.
EXTRA = "CASE WHEN candidate_id % 4 > 0 THEN (candidate_id * 37 % 101) / 100e0 END"


def extra():
    return F.when(F.col("candidate_id") % 4 > 0, (F.col("candidate_id") * 37 % 101) / F.lit(100.0))


@query("f08_additive", "cand pool", f"SELECT query_id, video_id, candidate_id, row_number() OVER (PARTITION BY query_id, video_id ORDER BY round(CASE WHEN n = 0 THEN score ELSE score + 0.2e0 * coalesce(x, 0) END, 9) DESC, rank) AS new_rank FROM (SELECT *, {EXTRA} AS x, count({EXTRA}) OVER (PARTITION BY query_id, video_id) AS n FROM pool) y")
def additive(spark, d):
    p = views.pool(spark, d).withColumns({"x": extra(), "old": F.col("rank")})
    return fusion.blended(p, ["query_id", "video_id"], "score", "x", 0.2, False, ["old"]).select("query_id", "video_id", "candidate_id", F.col("rank").alias("new_rank"))


@query("f09_minmax_blend", "cand pool", f"""SELECT query_id, video_id, candidate_id, row_number() OVER (PARTITION BY query_id, video_id ORDER BY round(CASE WHEN n = 0 THEN score ELSE 0.7e0 * CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1 END + 0.3e0 * coalesce(x, 0) END, 9) DESC, rank) AS new_rank
FROM (SELECT *, {EXTRA} AS x, count({EXTRA}) OVER w AS n, min(score) OVER w AS lo, max(score) OVER w AS hi FROM pool WINDOW w AS (PARTITION BY query_id, video_id)) y""")
def minmax_blend(spark, d):
    p = views.pool(spark, d).withColumns({"x": extra(), "old": F.col("rank")})
    return fusion.blended(p, ["query_id", "video_id"], "score", "x", 0.3, True, ["old"]).select("query_id", "video_id", "candidate_id", F.col("rank").alias("new_rank"))


@query("f10_external_rerank", "cand pool", f"SELECT query_id, video_id, candidate_id, row_number() OVER (PARTITION BY query_id, video_id ORDER BY {EXTRA} DESC NULLS LAST, rank) AS new_rank FROM pool WHERE rank <= 5")
def external_rerank(spark, d):
    p = views.pool(spark, d, 5).withColumn("x", extra())
    return fusion.rescored(p, ["query_id", "video_id"], "x", "rank", "new_rank").select("query_id", "video_id", "candidate_id", "new_rank")
