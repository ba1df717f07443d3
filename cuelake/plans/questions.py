"""Evidence, memory and answers over the test tables. Vectors of units and queries are rows of the embeddings table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuelake.operators import evidence as ev
from cuelake.operators import timeline as tl
from cuelake.operators import routing as rt
from cuelake.operators import vectors
from cuelake.operators.routing import requested_count, temporal_relation
from cuelake.operators.text import SQL_FOLD, SQL_TOKENS, TOPIC_STOP, bm25, sql_bm25, stems, tokens, topic_terms
from cuelake.plans.common import Registry
from cuelake.plans.moments import TEN, ten
from cuelake.plans.routing import SCOPE_SQL, TRTOKENS
from cuelake.sources import views
from cuelake.sources.tables import load
from cuelake.storage import materialize

query = Registry()
QUERIES, SQL = query.queries, query.sql
KEY = ["video_id", "query_id"]


def embedded(df: DataFrame, spark, d, number) -> DataFrame:
    """Adds the embedding whose id is ``number`` modulo their count; ids run from 0."""
    e = load(spark, d, "embeddings").select(F.col("vec_id").alias("_n"), "embedding")
    n = F.broadcast(e.agg(F.count("*").alias("_c")))
    return df.crossJoin(n).withColumn("_n", F.pmod(number, F.col("_c"))).drop("_c").join(e, "_n").drop("_n")


def digits(c):
    return F.right(c, F.lit(9)).cast("bigint")


def unit_number():
    return F.regexp_extract("unit_id", r"(\d+)", 1).cast("bigint") * 37 + digits("video_id")


def asked(spark, d):
    return views.queries(spark, d).select("video_id", "query_id", "query_text")


ENUM = "en AS (SELECT vec_id AS n, CAST(embedding AS DOUBLE[]) AS v, count(*) OVER () AS c FROM embeddings)"
UV = "{0}v AS (SELECT u.video_id, u.unit_id, v FROM {0} u JOIN en ON en.n = (CAST(regexp_extract(u.unit_id, '(\\d+)', 1) AS BIGINT) * 37 + CAST(right(u.video_id, 9) AS BIGINT)) % en.c)"
QV = "qv AS (SELECT q.video_id, q.query_id, v FROM qry q JOIN en ON en.n = CAST(right(q.query_id, 9) AS BIGINT) % en.c)"
HITS = "{0}h AS (SELECT video_id, query_id, unit_id, score, rank FROM (SELECT q.video_id, q.query_id, u.unit_id, round(list_dot_product(q.v, u.v), 9) AS score, row_number() OVER (PARTITION BY q.query_id ORDER BY round(list_dot_product(q.v, u.v), 9) DESC, u.unit_id) AS rank FROM qv q JOIN {0}v u USING (video_id)) x WHERE rank <= {1})"
LEX = f"docs AS (SELECT video_id, unit_id, {SQL_TOKENS.format('text')} AS tokens FROM fine), asked AS (SELECT video_id, query_id, {SQL_TOKENS.format('query_text')} AS tokens FROM qry), {sql_bm25('docs', 'asked', 'video_id', 'unit_id', 'query_id')}, lex AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, unit_id) AS rank FROM bm25 WHERE round(score, 9) > 0)"


def semantic(spark, d, level, k):
    """The k nearest units of each query in its own video."""
    u = embedded(views.units(spark, d, level), spark, d, unit_number())
    q = embedded(asked(spark, d), spark, d, digits("query_id"))
    return vectors.top_k(u, q, "unit_id", "query_id", "embedding", k, ["video_id"])


def lexical(spark, d, docs, ident="unit_id", text="text"):
    """BM25 ranks of documents within their video, positive ones only."""
    x = docs.select("video_id", ident, tokens(F.col(text)).alias("tokens"))
    a = asked(spark, d).select("video_id", "query_id", tokens(F.col("query_text")).alias("tokens"))
    s = bm25(x, a, ["video_id"], ident, "query_id").withColumn("score", F.round("score", 9)).where("score > 0")
    return s.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), ident)).cast("bigint"))


@query("r10_semantic_units", "fine qry", f"WITH {ENUM}, {UV.format('fine')}, {QV}, {HITS.format('fine', 20)} SELECT query_id, unit_id, rank, round(score, 6) AS score FROM fineh")
def semantic_units(spark, d):
    return semantic(spark, d, "fine", 20).select("query_id", "unit_id", "rank", F.round("score", 6).alias("score"))


TVEC = f"{TEN}, {ENUM}, tv AS (SELECT t.query_id, t.rank, t.ts, t.score, t.candidate_id, en.v FROM ten t JOIN en ON en.n = t.candidate_id % en.c)"
MMR = "m AS (SELECT query_id, 1 AS step, candidate_id, [candidate_id] AS ids, [v] AS vs FROM {0} WHERE first UNION ALL SELECT query_id, step, candidate_id, ids, vs FROM (SELECT m.query_id, m.step + 1 AS step, t.candidate_id, list_append(m.ids, t.candidate_id) AS ids, list_append(m.vs, t.v) AS vs, row_number() OVER (PARTITION BY m.query_id ORDER BY round(0.7e0 * t.score - (1e0 - 0.7e0) * list_max(list_transform(m.vs, lambda w: list_dot_product(w, t.v))), 9) DESC, t.score DESC, t.ts, t.rank) AS r FROM m JOIN {0} t ON t.query_id = m.query_id AND NOT list_contains(m.ids, t.candidate_id) WHERE m.step < 5) x WHERE r = 1)"
SPACED = "sp AS (SELECT query_id, 1 AS i, [ts] AS kept FROM ten WHERE rank = 1 UNION ALL SELECT s.query_id, s.i + 1, CASE WHEN len(list_filter(kept, lambda y: abs(y - t.ts) <= 2.05e0)) > 0 THEN kept ELSE list_append(kept, t.ts) END FROM sp s JOIN ten t ON t.query_id = s.query_id AND t.rank = s.i + 1), kp AS (SELECT query_id, arg_max(kept, i) AS kept FROM sp GROUP BY 1)"
STEMSQL = "list_distinct(list_transform(list_filter(regexp_extract_all(" + SQL_FOLD.format("{0}") + ", '[a-z0-9]+'), lambda t: t NOT IN ('a', 'an', 'and', 'are', 'does', 'explaining', 'in', 'is', 'it', 'of', 'says', 'saying', 'speaker', 'that', 'the', 'to', 'video')), lambda t: CASE WHEN ends_with(t, 'ies') AND len(t) > 4 THEN left(t, len(t) - 3) || 'y' WHEN ends_with(t, 'ing') AND len(t) > 5 THEN left(t, len(t) - 3) WHEN ends_with(t, 'ed') AND len(t) > 4 THEN left(t, len(t) - 2) WHEN ends_with(t, 's') AND len(t) > 3 THEN left(t, len(t) - 1) ELSE t END))"
SECTIONS = f"""WITH RECURSIVE {ENUM}, {UV.format('fine')}, un AS (SELECT f.video_id, f.unit_id, f.start_seconds AS s, f.end_seconds AS e, f.text, row_number() OVER w AS i, lag(f.end_seconds) OVER w AS pe, list_dot_product(v, lag(v) OVER w) AS near FROM fine f JOIN finev USING (video_id, unit_id) WINDOW w AS (PARTITION BY f.video_id ORDER BY f.start_seconds, f.unit_id)),
wk AS (SELECT video_id, i, 1 AS k, s AS first FROM un WHERE i = 1 UNION ALL SELECT video_id, i, CASE WHEN brk THEN k + 1 ELSE k END, CASE WHEN brk THEN s ELSE first END FROM (SELECT u.video_id, u.i, u.s, g.k, g.first, u.e - g.first > 180 OR (u.pe - g.first >= 35 AND (u.s - u.pe >= 3 OR u.near < 0.4e0)) AS brk FROM wk g JOIN un u ON u.video_id = g.video_id AND u.i = g.i + 1) x),
sk AS (SELECT video_id, k, min(s) AS s, arg_max(e, i) AS e, arg_min(s, i) AS fs FROM wk JOIN un USING (video_id, i) GROUP BY ALL), mk AS (SELECT video_id, max(k) AS k FROM sk GROUP BY 1),
mg AS (SELECT m.video_id, m.k FROM mk m JOIN sk l ON l.video_id = m.video_id AND l.k = m.k JOIN sk p ON p.video_id = m.video_id AND p.k = m.k - 1 WHERE l.e - l.fs < 35 AND l.e - p.fs <= 180),
sc AS (SELECT w.video_id, w.i, CASE WHEN g.k IS NOT NULL THEN w.k - 1 ELSE w.k END AS k, u.unit_id, u.s, u.e, u.text FROM wk w JOIN un u USING (video_id, i) LEFT JOIN mg g ON g.video_id = w.video_id AND g.k = w.k)"""
SECID = "'S' || lpad(CAST(k AS VARCHAR), CAST(greatest(4, len(CAST(k AS VARCHAR))) AS INT), '0')"


HYB = f"""WITH {ENUM}, {UV.format('fine')}, {UV.format('ctx')}, {QV}, {HITS.format('fine', 20)}, {HITS.format('ctx', 5)}, {LEX},
votes AS (SELECT query_id, video_id, unit_id, 1e0 / (20 + rank) AS s FROM fineh UNION ALL SELECT h.query_id, h.video_id, unnest(c.fine_ids), 1e0 / (20 + h.rank) FROM ctxh h JOIN ctx c USING (video_id, unit_id) UNION ALL SELECT query_id, video_id, unit_id, 0.5e0 / (20 + rank) FROM lex WHERE rank <= 10),
hyb AS (SELECT v.query_id, v.video_id, v.unit_id, sum(s) AS score FROM votes v GROUP BY ALL),
hr AS (SELECT h.*, f.start_seconds, f.text, f.segment_ids, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, f.start_seconds, h.unit_id) AS rank FROM hyb h JOIN fine f USING (video_id, unit_id))"""


def hybrid(spark, d):
    f = semantic(spark, d, "fine", 20).select(*KEY, "unit_id", (1 / (20 + F.col("rank"))).alias("s"))
    c = semantic(spark, d, "context", 5).join(views.units(spark, d, "context").select("video_id", "unit_id", "fine_ids"), ["video_id", "unit_id"])
    c = c.select(*KEY, F.explode("fine_ids").alias("unit_id"), (1 / (20 + F.col("rank"))).alias("s"))
    fine = views.units(spark, d, "fine")
    x = lexical(spark, d, fine).where("rank <= 10").select(*KEY, "unit_id", (0.5 / (20 + F.col("rank"))).alias("s"))
    h = f.unionByName(c).unionByName(x).groupBy(*KEY, "unit_id").agg(F.sum("s").alias("score")).join(fine, ["video_id", "unit_id"])
    return h.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "start_seconds", "unit_id")).cast("bigint"))


@query("r12_hybrid_candidates", "fine ctx qry", HYB + " SELECT query_id, unit_id, rank, round(score, 9) AS score FROM hr")
def hybrid_candidates(spark, d):
    return hybrid(spark, d).select("query_id", "unit_id", "rank", F.round("score", 9).alias("score"))


PACKED = HYB.replace("WITH ", "WITH RECURSIVE ", 1) + """, f AS (SELECT query_id, 0::BIGINT AS rank, []::VARCHAR[] AS ids, 0::BIGINT AS used, []::BIGINT[][] AS seen FROM (SELECT DISTINCT query_id FROM hr) x UNION ALL
SELECT f.query_id, h.rank, CASE WHEN ok THEN list_append(ids, h.unit_id) ELSE ids END, CASE WHEN ok THEN used + len(h.text) ELSE used END, CASE WHEN ok THEN list_append(seen, list_sort(h.segment_ids)) ELSE seen END
FROM f JOIN hr h ON h.query_id = f.query_id AND h.rank = f.rank + 1, LATERAL (SELECT len(ids) < 5 AND used + len(h.text) <= 3600 AND NOT list_contains(seen, list_sort(h.segment_ids)) AS ok) o)"""


@query("r13_budgeted_package", "fine ctx qry", PACKED + " SELECT query_id, arg_max(ids, rank) AS selected, max(used) AS characters FROM f GROUP BY 1")
def budgeted_package(spark, d):
    return ev.packages(hybrid(spark, d), ["query_id"], "unit_id")


CHUNKS = """WITH RECURSIVE p AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY start_s, segment_id) AS i, sum(len(text) + 1) OVER (PARTITION BY video_id ORDER BY start_s, segment_id ROWS UNBOUNDED PRECEDING) AS c, count(*) OVER (PARTITION BY video_id) AS n FROM seg),
e AS (SELECT a.video_id, a.i, a.n, coalesce(min(b.i), a.n + 1) AS j FROM p a LEFT JOIN p b ON b.video_id = a.video_id AND b.i > a.i AND b.i <= a.i + 60 AND (b.c - a.c + len(a.text) > 900 OR b.end_s - a.start_s > 45) GROUP BY a.video_id, a.i, a.n),
k AS (SELECT video_id, i, j, n, 1 AS k FROM e WHERE i = 1 UNION ALL SELECT e.video_id, e.i, e.j, e.n, k.k + 1 FROM k JOIN e ON e.video_id = k.video_id AND e.i = k.i + greatest(1, k.j - k.i - 1) WHERE k.j <= k.n)
"""


@query("t03_chunks", "seg", CHUNKS + """SELECT video_id, 'E' || lpad(CAST(k AS VARCHAR), CAST(greatest(3, len(CAST(k AS VARCHAR))) AS INT), '0') AS unit_id, j - i AS segments FROM k""")
def chunks(spark, d):
    return ev.chunks(views.segments(spark, d)).select("video_id", "unit_id", F.size("segment_ids").cast("bigint").alias("segments"))


@query("t04_fine_units", "seg", """WITH RECURSIVE p AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY start_s, segment_id) AS i, sum(len(trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))) + 1) OVER (PARTITION BY video_id ORDER BY start_s, segment_id ROWS UNBOUNDED PRECEDING) AS c, len(trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))) AS l, count(*) OVER (PARTITION BY video_id) AS n FROM seg),
e AS (SELECT a.video_id, a.i, a.n, coalesce(min(b.i), a.n + 1) AS j FROM p a LEFT JOIN p b ON b.video_id = a.video_id AND b.i > a.i AND b.i <= a.i + 60 AND (b.c - a.c + a.l > 600 OR b.end_s - a.start_s > 30) GROUP BY a.video_id, a.i, a.n),
k AS (SELECT video_id, i, j, n, 1 AS k FROM e WHERE i = 1 UNION ALL SELECT e.video_id, e.i, e.j, e.n, k.k + 1 FROM k JOIN e ON e.video_id = k.video_id AND e.i = k.j WHERE k.j <= k.n)
SELECT video_id, 'F' || lpad(CAST(k AS VARCHAR), CAST(greatest(4, len(CAST(k AS VARCHAR))) AS INT), '0') AS unit_id, j - i AS segments FROM k""")
def fine_units(spark, d):
    return ev.fine_units(views.segments(spark, d)).select("video_id", "unit_id", F.size("segment_ids").cast("bigint").alias("segments"))


@query("r14_chunk_evidence", "seg qry", CHUNKS + f""", docs AS (SELECT k.video_id, 'E' || lpad(CAST(k AS VARCHAR), CAST(greatest(3, len(CAST(k AS VARCHAR))) AS INT), '0') AS unit_id, {SQL_TOKENS.format("string_agg(p.text, ' ' ORDER BY p.i)")} AS tokens FROM k JOIN p ON p.video_id = k.video_id AND p.i >= k.i AND p.i < k.j GROUP BY k.video_id, k.k), asked AS (SELECT video_id, query_id, {SQL_TOKENS.format('query_text')} AS tokens FROM qry), {sql_bm25('docs', 'asked', 'video_id', 'unit_id', 'query_id')}, lex AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, unit_id) AS rank FROM bm25 WHERE round(score, 9) > 0) SELECT query_id, unit_id, rank, round(score, 6) AS score FROM lex WHERE rank <= 5""")
def chunk_evidence(spark, d):
    """The best chunks of each query's video, equal scores in their order."""
    x = lexical(spark, d, ev.chunks(views.segments(spark, d)))
    return x.where("rank <= 5").select("query_id", "unit_id", "rank", F.round("score", 6).alias("score"))


def memory(spark, d):
    """Sections of all videos, built once: retrieval looks at them from three sides."""
    return materialize(_memory(spark, d), "sections")


def _memory(spark, d):
    return ev.sections(embedded(views.units(spark, d, "fine"), spark, d, unit_number()))


@query("t19_sections", "fine", SECTIONS + f" SELECT video_id, {SECID} AS section_id, arg_min(s, i) AS start_seconds, arg_max(e, i) AS end_seconds, count(*) AS units FROM sc GROUP BY video_id, k")
def sections(spark, d):
    return _memory(spark, d).select("video_id", "section_id", "start_seconds", "end_seconds", F.size("fine_ids").cast("bigint").alias("units"))


@query("t20_summaries")
def summaries(spark, d):
    return _memory(spark, d).select("video_id", "section_id", "summary", "summary_ids")


@query("t21_section_topics", "fine", SECTIONS + f""", tx AS (SELECT video_id, {SECID} AS section_id, string_agg(text, ' ' ORDER BY i) AS text FROM sc GROUP BY video_id, k), ws AS (SELECT video_id, section_id, unnest(regexp_extract_all({SQL_FOLD.format('text')}, '[a-z][a-z0-9''-]{{2,}}')) AS w, generate_subscripts(regexp_extract_all({SQL_FOLD.format('text')}, '[a-z][a-z0-9''-]{{2,}}'), 1) AS pos FROM tx), cn AS (SELECT video_id, section_id, w, count(*) AS n, min(pos) AS first FROM ws WHERE w NOT IN ({', '.join(repr(w) for w in TOPIC_STOP)}) GROUP BY ALL), rk AS (SELECT *, row_number() OVER (PARTITION BY video_id, section_id ORDER BY n DESC, first, w) AS r FROM cn) SELECT video_id, section_id, list(w ORDER BY r) AS terms FROM rk WHERE r <= 8 GROUP BY ALL""")
def section_topics(spark, d):
    return topic_terms(_memory(spark, d), ["video_id", "section_id"], "text")


@query("r15_memory_retrieval")
def memory_retrieval(spark, d):
    """Three best sections, then the fine units in them by likeness and words, then a package in order of time.

    Word statistics are those of the selected sections' units only, one corpus a query.
    """
    s = memory(spark, d)
    sv = embedded(s.select("video_id", F.col("section_id").alias("unit_id")), spark, d, unit_number())
    q = embedded(asked(spark, d), spark, d, digits("query_id"))
    top = vectors.top_k(sv, q, "unit_id", "query_id", "embedding", 3, ["video_id"]).select(*KEY, F.col("unit_id").alias("section_id"))
    fine = views.units(spark, d, "fine")
    allowed = top.join(s.select("video_id", "section_id", F.explode("fine_ids").alias("unit_id")), ["video_id", "section_id"]).select(*KEY, "unit_id")
    cand = materialize(allowed.join(fine, ["video_id", "unit_id"]), "candidates")
    docs = cand.select("query_id", "unit_id", tokens(F.col("text")).alias("tokens"))
    a = asked(spark, d).select("query_id", F.col("query_id").alias("q"), tokens(F.col("query_text")).alias("tokens"))
    lex = bm25(docs, a, ["query_id"], "unit_id", "q").withColumn("score", F.round("score", 9)).where("score > 0")
    lex = lex.withColumn("lr", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "unit_id"))).where("lr <= 12").select("query_id", "unit_id", "lr")
    j = embedded(cand, spark, d, unit_number()).join(q.select("query_id", F.col("embedding").alias("qv")), "query_id").join(lex, ["query_id", "unit_id"], "left")
    j = j.withColumn("score", vectors.dot(F.col("embedding"), F.col("qv")) + F.coalesce(0.10 / F.col("lr"), F.lit(0.0)))
    r = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "start_seconds", "unit_id"))
    return ev.packages(j.withColumn("rank", r).where("rank <= 12"), ["query_id"], "unit_id", dedup=False)


def screens(spark, d):
    """Segments as frames of recognised screen text."""
    return views.segments(spark, d).select("video_id", F.col("segment_id").cast("string").alias("frame_id"), F.col("start_s").alias("ts"), "text", (F.col("segment_id") % 100 / 100).alias("confidence"))


@query("t18_screen_merge")
def screen_merge(spark, d):
    return ev.merged_screens(screens(spark, d)).select("video_id", "evidence_id", "start_seconds", "end_seconds", F.round("confidence", 6).alias("confidence"), F.size("frame_ids").alias("frames"))


@query("r16_screen_search")
def screen_search(spark, d):
    x = lexical(spark, d, materialize(ev.merged_screens(screens(spark, d)), "screens"), "evidence_id")
    return x.where("rank <= 5").select("query_id", "evidence_id", "rank", F.round("score", 6).alias("score"))


@query("n06_screen_text")
def screen_text(spark, d):
    clean = F.pandas_udf(lambda s: s.map(ev.screen_terms), T.StringType())
    return views.segments(spark, d).select("segment_id", clean("text").alias("terms"))


@query("n07_likeness")
def likeness(spark, d):
    """How like each segment is to the one before it."""
    w = W.partitionBy("video_id").orderBy("start_s", "segment_id")

    @F.pandas_udf(T.DoubleType())
    def like(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([round(ev.likeness(x, y), 6) if x is not None else None for x, y in zip(a, b)], dtype="float64")

    s = views.segments(spark, d).withColumn("before", F.lag("text").over(w)).where(F.col("before").isNotNull())
    return s.select("segment_id", like("before", "text").alias("likeness"))


@query("r17_semantic_speech", "fine qry vid frm", f"WITH {ENUM}, {UV.format('fine')}, {QV}, {HITS.format('fine', 8)} SELECT h.query_id, h.rank, h.unit_id, f.video_id || '/' || lpad(CAST(greatest(least(CAST(ceil(f.start_seconds / 5e0 - 0.5e0) AS BIGINT), l.last), 0) + 1 AS VARCHAR), 6, '0') AS thumbnail FROM fineh h JOIN fine f USING (video_id, unit_id) JOIN (SELECT video_id, max(frame_idx) AS last FROM frm GROUP BY 1) l USING (video_id)")
def semantic_speech(spark, d):
    """Units by likeness of meaning, with the frame nearest to their start."""
    h = semantic(spark, d, "fine", 8).join(views.units(spark, d, "fine").select("video_id", "unit_id", "start_seconds"), ["video_id", "unit_id"])
    return views.on_frames(h, spark, d, "start_seconds").select("query_id", "rank", "unit_id", "thumbnail")


@query("r18_turkish_bm25", "seg qry", f"WITH docs AS {TRTOKENS.format('seg', 'text')}, asked AS {TRTOKENS.format('qry', 'query_text')}, {sql_bm25('docs', 'asked', 'video_id', 'segment_id', 'query_id')} SELECT query_id, segment_id, round(score, 6) AS score FROM bm25")
def turkish_bm25(spark, d):
    """BM25 over the tokens of Turkish search."""
    stemmed = lambda c: rt.turkish_tokens(rt.turkish_lower(F.col(c)))
    docs = views.segments(spark, d).select("video_id", "segment_id", stemmed("text").alias("tokens"))
    a = asked(spark, d).select("video_id", "query_id", stemmed("query_text").alias("tokens"))
    return bm25(docs, a, ["video_id"], "segment_id", "query_id").select("query_id", "segment_id", F.round("score", 6).alias("score"))


SEC = f"""WITH {TEN}, five AS (SELECT * FROM ten WHERE rank <= 5), dense AS (SELECT f.video_id, q.query_id, f.frame_idx, f.ts, max(t.score) AS coarse, min(abs(f.ts - t.ts)) AS gap FROM five t JOIN qry q ON q.query_id = t.query_id JOIN frm f ON f.video_id = t.video_id AND f.ts BETWEEN t.ts - 10 AND t.ts + 10 GROUP BY ALL)"""


@query("r23_bounded_secondary", "qry vid frm cand pool", SEC + " SELECT query_id, frame_idx, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY coarse DESC, gap, frame_idx) AS rank FROM dense) x WHERE rank <= 5")
def bounded_secondary(spark, d):
    """Frames around the best candidates, ordered by the best coarse score near them, then by how near that is."""
    t = ten(spark, d, 5).withColumn("n", F.explode(F.sequence(F.ceil((F.col("ts") - 10) / 5).cast("bigint"), F.floor((F.col("ts") + 10) / 5).cast("bigint"))))
    f = t.join(views.frames(spark, d).select("video_id", F.col("frame_idx").alias("n"), F.col("ts").alias("fts")), ["video_id", "n"])
    g = f.groupBy("query_id", F.col("n").alias("frame_idx")).agg(F.max("score").alias("coarse"), F.min(F.abs(F.col("fts") - F.col("ts"))).alias("gap"))
    r = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("coarse"), "gap", "frame_idx"))
    return g.withColumn("rank", r.cast("bigint")).where("rank <= 5").select("query_id", "frame_idx", "rank")


def listed(spark, d):
    return embedded(ten(spark, d), spark, d, F.col("candidate_id"))


@query("t10_mmr", "qry cand pool", f"WITH RECURSIVE {TVEC}, fr AS (SELECT *, rank = 1 AS first FROM tv), {MMR.format('fr')} SELECT query_id, candidate_id, CAST(step AS BIGINT) AS rank FROM m")
def mmr(spark, d):
    return ev.diversified(listed(spark, d), ["query_id"], 0.7, 5)


@query("t11_nms_then_mmr", "qry cand pool", f"WITH RECURSIVE {TVEC}, {SPACED}, k1 AS (SELECT t.*, row_number() OVER (PARTITION BY t.query_id, t.ts ORDER BY t.rank) AS nth FROM tv t JOIN kp USING (query_id) WHERE list_contains(kept, t.ts)), fr AS (SELECT *, rank = min(rank) OVER (PARTITION BY query_id) AS first FROM k1 WHERE nth = 1), {MMR.format('fr')} SELECT query_id, candidate_id, CAST(step AS BIGINT) AS rank FROM m")
def nms_then_mmr(spark, d):
    kept = ten(spark, d).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("rank").alias("o"), F.col("ts").alias("t")))), lambda x: x.t).alias("times")).select("query_id", tl.spaced(F.col("times"), 2.05, strictly=True).alias("kept"))
    first = W.partitionBy("query_id", "ts").orderBy("rank")
    x = listed(spark, d).join(kept, "query_id").where(F.array_contains("kept", F.col("ts"))).withColumn("i", F.row_number().over(first)).where("i = 1")
    return ev.diversified(x.drop("i", "kept"), ["query_id"], 0.7, 5)


@query("f13_base_preserving", "qry cand pool", f"WITH RECURSIVE {TEN}, sp AS (SELECT query_id, 2 AS i, list(ts ORDER BY rank) FILTER (rank <= 2) AS kept FROM ten GROUP BY 1 UNION ALL SELECT s.query_id, s.i + 1, CASE WHEN len(kept) >= 5 OR len(list_filter(kept, lambda y: abs(y - t.ts) <= 2.05e0)) > 0 THEN kept ELSE list_append(kept, t.ts) END FROM sp s JOIN ten t ON t.query_id = s.query_id AND t.rank = s.i + 1) SELECT query_id, arg_max(kept, i) AS kept FROM sp GROUP BY 1")
def base_preserving(spark, d):
    """The first two candidates stay; the rest of the pool joins where it lies farther than 2.05 s from all chosen."""
    t = ten(spark, d).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("rank").alias("o"), F.col("ts").alias("t")))), lambda x: x.t).alias("times"))
    base, rest = F.slice("times", 1, 2), F.slice("times", 3, 10)
    step = lambda acc, x: F.when((F.size(acc) >= 5) | F.exists(acc, lambda y: F.abs(y - x) <= 2.05), acc).otherwise(F.array_append(acc, x))
    return t.select("query_id", F.aggregate(rest, base, step).alias("kept"))


ANCHOR = f"""sg AS (SELECT *, lead(text) OVER w AS t2, lead(end_s) OVER w AS e2, lead(segment_id) OVER w AS i2 FROM seg WINDOW w AS (PARTITION BY video_id ORDER BY start_s, segment_id)),
ac AS (SELECT video_id, 'T' || lpad(CAST(segment_id AS VARCHAR), 7, '0') AS unit_id, 1 AS parts, start_s, trim(text) AS text FROM sg UNION ALL SELECT video_id, 'T' || lpad(CAST(segment_id AS VARCHAR), 7, '0') || '-' || lpad(CAST(i2 AS VARCHAR), 7, '0'), 2, start_s, trim(text) || ' ' || trim(t2) FROM sg WHERE i2 IS NOT NULL),
docs AS (SELECT video_id, unit_id, {SQL_TOKENS.format('text')} AS tokens FROM ac), asked AS (SELECT video_id, query_id, {SQL_TOKENS.format('query_text')} AS tokens FROM qry), {sql_bm25('docs', 'asked', 'video_id', 'unit_id', 'query_id')}"""


@query("t22_anchor", "seg qry", f"WITH {ANCHOR}, st AS (SELECT video_id, unit_id, parts, start_s, {STEMSQL.format('text')} AS s FROM ac), qs AS (SELECT query_id, {STEMSQL.format('query_text')} AS q FROM qry) SELECT query_id, unit_id, CAST(shared AS INT) AS shared FROM (SELECT b.query_id, b.unit_id, len(list_intersect(st.s, qs.q)) AS shared, row_number() OVER (PARTITION BY b.query_id ORDER BY len(list_intersect(st.s, qs.q)) DESC, round(b.score, 9) DESC, parts, start_s, b.unit_id) AS r FROM bm25 b JOIN st USING (video_id, unit_id) JOIN qs USING (query_id) WHERE round(b.score, 9) > 0) x WHERE r = 1")
def anchor(spark, d):
    """The segment or pair of neighbours that covers most of a phrase's stems; then by BM25, fewer parts, earlier."""
    c = ev.anchor_candidates(views.segments(spark, d))
    x = lexical(spark, d, c).join(c.select("video_id", "unit_id", "parts", "start_s", stems(F.col("text")).alias("s")), ["video_id", "unit_id"])
    x = x.join(asked(spark, d).select("query_id", stems(F.col("query_text")).alias("qs")), "query_id").withColumn("shared", F.size(F.array_intersect("s", "qs")))
    r = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("shared"), F.desc("score"), "parts", "start_s", "unit_id"))
    return x.withColumn("r", r).where("r = 1").select("query_id", "unit_id", "shared")


@query("t22_anchor_scores", "seg qry", f"WITH {ANCHOR} SELECT query_id, unit_id, round(score, 9) AS score FROM bm25 WHERE round(score, 9) > 0")
def anchor_scores(spark, d):
    return lexical(spark, d, ev.anchor_candidates(views.segments(spark, d))).select("query_id", "unit_id", "score")


@query("n05_stems", "qry", """SELECT query_id, list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(replace(lower(replace(query_text, 'İ', 'i' || chr(775))), 'ß', 'ss'), '[a-z0-9]+'), lambda t: t NOT IN ('a', 'an', 'and', 'are', 'does', 'explaining', 'in', 'is', 'it', 'of', 'says', 'saying', 'speaker', 'that', 'the', 'to', 'video')),
lambda t: CASE WHEN ends_with(t, 'ies') AND len(t) > 4 THEN left(t, len(t) - 3) || 'y' WHEN ends_with(t, 'ing') AND len(t) > 5 THEN left(t, len(t) - 3) WHEN ends_with(t, 'ed') AND len(t) > 4 THEN left(t, len(t) - 2) WHEN ends_with(t, 's') AND len(t) > 3 THEN left(t, len(t) - 1) ELSE t END))) AS stems FROM qry""")
def query_stems(spark, d):
    return views.queries(spark, d).select("query_id", F.array_sort(stems(F.col("query_text"))).alias("stems"))


@query("t23_expansion")
def expansion(spark, d):
    """Packages of each query with the neighbours of their units, within limits of number, characters and distance."""
    fine = views.units(spark, d, "fine")
    w = W.partitionBy("video_id").orderBy("start_seconds", "unit_id")
    cell = F.struct(F.col("unit_id").alias("id"), F.col("start_seconds").alias("start"), F.col("end_seconds").alias("end"), "text")
    n = fine.select("video_id", "unit_id", cell.alias("me")).withColumns({"before": F.lag("me").over(W.partitionBy("video_id").orderBy("me.start", "unit_id")), "after": F.lead("me").over(W.partitionBy("video_id").orderBy("me.start", "unit_id"))})
    p = hybrid(spark, d).where("rank <= 3").select(*KEY, "unit_id", "rank").join(n, ["video_id", "unit_id"])

    def step(g: pd.DataFrame) -> pd.DataFrame:
        base = list(g["me"])
        out = ev.expanded(base, {m["id"]: (b, a) for m, b, a in zip(g["me"], g["before"], g["after"])})
        return pd.DataFrame([(g["query_id"].iloc[0], [x["id"] for x in out], len(out) - len(base))], columns=["query_id", "units", "added"])

    return ev.folded_by(p, ["query_id"], ["rank"], step, "query_id string, units array<string>, added bigint")


def generated(spark, d):
    """Answers as a generator would return them, made of the queries' packages: good ones and each kind of bad one."""
    p = ev.packages(hybrid(spark, d), ["query_id"], "unit_id").join(asked(spark, d), "query_id").where(F.size("selected") > 0)
    k = digits("query_id") % 6
    claim = lambda t, ids: F.struct(t.alias("text"), ids.alias("evidence_ids"))
    one = F.slice("selected", 1, 1)
    claims = F.when(k == 1, F.array(claim(F.lit("A"), F.array(F.lit("F9999"))))).when(k == 2, F.array(claim(F.lit("A"), one), claim(F.lit(" a "), one))).when(k == 3, F.array().cast("array<struct<text:string,evidence_ids:array<string>>>")).otherwise(F.array(claim(F.lit("A"), one)))
    return p.select("query_id", F.col("selected").alias("known_ids"), (k != 4).alias("answerable"), F.lit("Something is said.").alias("answer"), one.alias("evidence_ids"), claims.alias("claims"), F.when(k == 5, F.array(F.lit("the date"))).otherwise(F.array().cast("array<string>")).alias("gaps"), requested_count(F.col("query_text")).alias("requested_count"), temporal_relation(F.col("query_text")).isNotNull().alias("temporal"))


ANSWER = """, g AS (SELECT f.query_id, arg_max(ids, rank) AS sel FROM f GROUP BY 1), a AS (SELECT g.query_id, sel, CAST(right(g.query_id, 9) AS BIGINT) % 6 AS k, regexp_matches(lower(q.query_text), '\\b(?:prior to|before|after|following|then|next|previously|later)\\b') AS temporal, regexp_matches(lower(q.query_text), '\\b(?:what|which|name|list|give|identify)\\s+(?:\\d+|one|two|three|four|five|six|seven|eight)\\b') AS counted FROM g JOIN qry q USING (query_id) WHERE len(sel) > 0)
SELECT query_id, CASE WHEN k = 1 THEN 'unknown_citation' WHEN k IN (2, 3, 4, 5) OR temporal OR counted THEN 'abstain' ELSE 'answer' END AS verdict, CASE WHEN k = 0 AND NOT temporal AND NOT counted THEN sel[1:1] ELSE [] END AS citations FROM a"""


@query("n01_resolve", "fine ctx qry", PACKED + ANSWER)
def resolve(spark, d):
    return ev.resolved_answer(generated(spark, d)).select("query_id", "verdict", "citations")


@query("n04_ask", "fine ctx qry", PACKED + ANSWER.replace("SELECT query_id, CASE WHEN k = 1", ", an AS (SELECT query_id, CASE WHEN k = 1", 1) + ") SELECT q.query_id, CASE WHEN sc.scope <> 'SUPPORTED_CORE' THEN 'out_of_scope' WHEN verdict IS NULL THEN 'no_evidence' ELSE verdict END AS outcome, CAST(CASE WHEN sc.scope = 'SUPPORTED_CORE' AND verdict = 'answer' THEN len(citations) ELSE 0 END AS INT) AS citations FROM qry q JOIN (" + SCOPE_SQL + ") sc ON sc.query_id = q.query_id AND sc.form = 0 LEFT JOIN an ON an.query_id = q.query_id")
def ask(spark, d):
    """The whole way of a question: scope, evidence, answer, citations; abstaining where one of them fails."""
    from cuelake.operators.routing import scope

    q = asked(spark, d).withColumn("scope", scope(F.col("query_text")))
    a = ev.resolved_answer(generated(spark, d)).select("query_id", "verdict", "citations")
    j = q.join(a, "query_id", "left")
    out = F.when(F.col("scope") != "SUPPORTED_CORE", "out_of_scope").when(F.col("verdict").isNull(), "no_evidence").otherwise(F.col("verdict"))
    return j.select("query_id", out.alias("outcome"), F.when(out == "answer", F.size("citations")).otherwise(0).alias("citations"))


@query("n02_evidence_text", "fine ctx qry", HYB + " SELECT query_id, string_agg(unit_id || ': ' || text, chr(10) || chr(10) ORDER BY rank) AS evidence FROM hr WHERE rank <= 3 GROUP BY 1")
def evidence_text(spark, d):
    """The evidence of each query as the text that is sent along with it."""
    h = hybrid(spark, d).where("rank <= 3")
    g = h.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.concat_ws(": ", "unit_id", "text").alias("t")))).alias("l"))
    return g.select("query_id", F.array_join(F.transform("l", lambda x: x.t), "\n\n").alias("evidence"))


@query("a27_structured_summary")
def structured_summary(spark, d):
    e = expansion(spark, d)
    return e.agg(F.count("*").alias("n"), F.round(F.avg((F.col("added") > 0).cast("int")), 6).alias("expanded_share"), F.round(F.avg(F.size("units")), 6).alias("mean_units"))


@query("a29_edit_accuracy", "seg", """WITH p AS (SELECT video_id, text, lag(text) OVER (PARTITION BY video_id ORDER BY start_s, segment_id) AS prev FROM seg WHERE len(text) <= 400)
SELECT video_id, round(greatest(0, 1 - sum(levenshtein(prev, text)) / CAST(greatest(1, sum(len(prev))) AS DOUBLE)), 6) AS accuracy FROM p WHERE prev IS NOT NULL AND regexp_full_match(prev || text, '[ -~]*') GROUP BY 1""")
def edit_accuracy(spark, d):
    """Character accuracy of each short segment as a reading of the one before, summed by video.

    Only segments of up to 400 characters and pairs in ASCII, which the SQL can compare; a29_edit_accuracy_whole has all.
    """
    w = W.partitionBy("video_id").orderBy("start_s", "segment_id")
    p = views.segments(spark, d).where(F.length("text") <= 400).withColumn("prev", F.lag("text").over(w)).where("prev IS NOT NULL").where(F.concat("prev", "text").rlike(r"^[ -~]*$"))
    return p.groupBy("video_id").agg(F.round(F.greatest(F.lit(0.0), 1 - F.sum(F.levenshtein("prev", "text")) / F.greatest(F.lit(1), F.sum(F.length("prev")))), 6).alias("accuracy"))


@query("a29_edit_accuracy_whole")
def edit_accuracy_whole(spark, d):
    """As a29_edit_accuracy, over all segments and whole texts in any letters; without SQL, as DuckDB's levenshtein counts bytes."""
    w = W.partitionBy("video_id").orderBy("start_s", "segment_id")
    p = views.segments(spark, d).withColumn("prev", F.lag("text").over(w)).where("prev IS NOT NULL")
    p = p.repartition(4 * spark.sparkContext.defaultParallelism, "video_id", "segment_id")
    return p.groupBy("video_id").agg(F.round(F.greatest(F.lit(0.0), 1 - F.sum(F.levenshtein("prev", "text")) / F.greatest(F.lit(1), F.sum(F.length("prev")))), 6).alias("accuracy"))


#: Queries and context units of one video that one row of ``a29_best_window`` compares.
QUERIES_A_ROW, UNITS_A_ROW = 16, 64


@query("a29_best_window")
def best_window(spark, d):
    """The run of lines of any context unit of its video that is most like a query's first words; of equals, the first unit's.

    Queries of a video meet its units in rows of some of both, so runs are made ready once for several queries, the best
    run so far cuts the search in all units, and the work of a video with many of both is spread.
    """
    u = views.units(spark, d, "context").where(F.col("video_id").isNotNull()).select("video_id", "unit_id", F.when(F.col("text").isNull(), F.array().cast("array<string>")).otherwise(F.split("text", r"(?<=[.!?]) ")).alias("lines"))

    def parts(df: DataFrame, key: str, value: str, most: int, name: str) -> DataFrame:
        n = df.groupBy("video_id").agg(F.ceil(F.count("*") / most).alias("n"))
        p = df.join(n, "video_id").select("video_id", F.pmod(F.xxhash64(key), F.col("n")).alias(f"{name}_part"), F.struct(key, value).alias("x"))
        return p.groupBy("video_id", f"{name}_part").agg(F.array_sort(F.collect_list("x")).alias(name))

    kind = pa.schema([("query_id", pa.string()), ("unit_id", pa.string()), ("window", pa.string()), ("likeness", pa.float64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for queries, units in zip(b.column(0), b.column(1)):
                us = units.as_py()
                windows = ev.Windows([x["lines"] for x in us])
                for q in queries.as_py():
                    k, window, like = windows.best(q["query_text"])
                    out.append({"query_id": q["query_id"], "unit_id": us[k]["unit_id"], "window": window, "likeness": like})
            yield pa.RecordBatch.from_pylist(out, kind)

    j = parts(asked(spark, d).where(F.col("video_id").isNotNull()), "query_id", "query_text", QUERIES_A_ROW, "queries").join(parts(u, "unit_id", "lines", UNITS_A_ROW, "units"), "video_id")
    j = j.repartition(4 * spark.sparkContext.defaultParallelism, "video_id", "queries_part", "units_part").select("queries", "units")
    j = j.mapInArrow(find, "query_id string, unit_id string, window string, likeness double")
    best = F.min_by(F.struct("window", "likeness"), F.struct(-F.col("likeness"), "unit_id"))
    return j.groupBy("query_id").agg(best.alias("w")).select("query_id", "w.window", F.round("w.likeness", 6).alias("likeness"))


@query("a29_time_error", "qry ivl cand pool", f"WITH {TEN} SELECT t.query_id, round(min(CASE WHEN t.ts BETWEEN i.s AND i.e THEN 0 ELSE least(abs(t.ts - i.s), abs(t.ts - i.e)) END), 6) AS error FROM ten t JOIN ivl i USING (query_id) WHERE t.rank = 1 GROUP BY 1")
def time_error(spark, d):
    """How far the best candidate lies from the nearest interval."""
    j = ten(spark, d, 1).join(views.intervals(spark, d), "query_id")
    e = F.when(F.col("ts").between(F.col("s"), F.col("e")), 0.0).otherwise(F.least(F.abs(F.col("ts") - F.col("s")), F.abs(F.col("ts") - F.col("e"))))
    return j.groupBy("query_id").agg(F.round(F.min(e), 6).alias("error"))


@query("a30_screen_rollup")
def screen_rollup(spark, d):
    """Queries as targets: the segments within their intervals are the frames that show them, their words are sought in the merged spans."""
    from cuelake.plans.moments import overlap

    frames = screens(spark, d)
    spans = materialize(ev.merged_screens(frames), "spans")
    shown = overlap(spark, d).select("query_id", F.col("segment_id").cast("string").alias("frame_id")).join(frames.select("frame_id", "ts", "text"), "frame_id")
    shown = shown.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("ts", "frame_id", "text"))).alias("l"))
    spots = views.intervals(spark, d).groupBy("query_id").agg(F.array_sort(F.collect_list(F.array("s", "e"))).alias("intervals"))
    q = asked(spark, d).join(spots, "query_id").join(shown, "query_id", "left")
    targets = q.select(F.col("query_id").alias("target_id"), F.col("query_text").alias("reference"), F.transform("l", lambda x: x.frame_id).alias("frame_ids"), F.transform("l", lambda x: x.text).alias("lines"), "intervals")
    found = lexical(spark, d, spans, "evidence_id").where("rank <= 5").join(spans.select("video_id", "evidence_id", "start_seconds", "frame_ids"), ["video_id", "evidence_id"])
    minutes = views.videos(spark, d).where(F.abs("duration_s") < float("inf")).groupBy("video_id").agg(F.max("duration_s").alias("s")).agg(F.sum("s") / 60).first()[0] or 0.0
    r = ev.screen_report(targets, found.withColumnRenamed("query_id", "target_id"), frames, spans, minutes)
    return r.select("metric", F.round("value", 6).alias("value"))


BOX = """WITH RECURSIVE det AS (SELECT video_id || '/' || CAST(CAST(floor(ts / 60) AS BIGINT) AS VARCHAR) AS frame_id, 'class' || CAST(candidate_id % 3 AS VARCHAR) AS class, score, CAST(candidate_id * 7 % 50 AS DOUBLE) AS x1, CAST(candidate_id * 13 % 40 AS DOUBLE) AS y1 FROM pool WHERE rank <= 20),
o AS (SELECT *, row_number() OVER (PARTITION BY frame_id, class ORDER BY score DESC, x1, y1) AS i FROM det),
k AS (SELECT frame_id, class, i, [{'x': x1, 'y': y1}] AS kept FROM o WHERE i = 1 UNION ALL SELECT k.frame_id, k.class, o.i, CASE WHEN len(list_filter(k.kept, lambda b: greatest(30 - abs(b.x - o.x1), 0) * greatest(25 - abs(b.y - o.y1), 0) / (1500 - greatest(30 - abs(b.x - o.x1), 0) * greatest(25 - abs(b.y - o.y1), 0)) > 0.45)) > 0 THEN k.kept ELSE list_append(k.kept, {'x': o.x1, 'y': o.y1}) END
  FROM k JOIN o ON o.frame_id = k.frame_id AND o.class = k.class AND o.i = k.i + 1)"""


@query("m11_box_suppression", "cand pool", BOX + " SELECT frame_id, class, CAST(len(arg_max(kept, i)) AS BIGINT) AS kept, 0.075::DOUBLE AS area_ratio FROM k GROUP BY ALL")
def box_suppression(spark, d):
    """Detections made of the candidates: a box each, some of them nearly the same."""
    c = views.pool(spark, d, 20)
    x, y = F.col("candidate_id") * 7 % 50, F.col("candidate_id") * 13 % 40
    det = c.select(F.concat_ws("/", "video_id", F.floor(F.col("ts") / 60).cast("string")).alias("frame_id"), F.concat(F.lit("class"), (F.col("candidate_id") % 3).cast("string")).alias("class"), F.col("score").alias("confidence"), x.cast("double").alias("x1"), y.cast("double").alias("y1"), (x + 30).cast("double").alias("x2"), (y + 25).cast("double").alias("y2"))
    kept = ev.detections_kept(det)
    return kept.groupBy("frame_id", "class").agg(F.count("*").alias("kept"), F.round(F.max((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")) / 10000), 6).alias("area_ratio"))


@query("c10_softmax_router")
def softmax_router(spark, d):
    """A router fitted on a bounded sample, at most 5,000 labelled queries in order of their hash, and applied to all.

    The bound is the sample of labels; features, routes and figures cover every query.
    """
    import numpy as np

    from cuelake.operators.calibrate import softmax_fit
    from cuelake.operators.routing import ROUTES, linear, route_features, softmax

    q = views.queries(spark, d).where(F.col("modality_requirement").isin(*ROUTES))
    f = q.select("query_id", "modality_requirement", F.array(*(c.cast("double") for c in route_features(F.col("query_text")))).alias("x"))
    rows = f.orderBy(F.xxhash64("query_id"), "query_id").limit(5000).select("x", "modality_requirement").collect()
    x, y = np.array([r.x for r in rows]).reshape(len(rows), -1), np.array([ROUTES.index(r.modality_requirement) for r in rows])
    if not len(rows):
        return f.select(F.col("modality_requirement").alias("truth"), F.lit("hybrid").alias("said"), F.lit(0).cast("bigint").alias("n"))
    m = softmax_fit(x, y, 3)
    logits = [linear([F.col("x")[i] for i in range(x.shape[1])], m["mean"], m["scale"], [w[k] for w in m["weights"]]) for k in range(3)]
    return f.withColumn("said", softmax(logits, ROUTES)[1]).groupBy(F.col("modality_requirement").alias("truth"), "said").agg(F.count("*").alias("n"))


@query("c12_tfidf_classifier")
def tfidf_classifier(spark, d):
    """A classifier over 5,000 terms of words and 8,000 of characters, fitted with a shrinking step on at most 5,000 labelled queries in order of their hash.

    Applied to every query by a join on terms; rows stay sparse there and in the fit.
    """
    import numpy as np

    from cuelake.operators.calibrate import softmax_fit_sparse
    from cuelake.operators.routing import ROUTES
    from cuelake.operators.text import tf_idf
    from cuelake.plans.routing import CHAR_TERMS, WORD_TERMS, char_terms, word_terms

    mark = lambda kind, v: v.withColumn("term", F.concat(F.lit(kind), "term"))
    v = mark("w:", tf_idf(word_terms(spark, d), "query_id", WORD_TERMS)).unionByName(mark("c:", tf_idf(char_terms(spark, d), "query_id", CHAR_TERMS)))
    v = materialize(v, "tfidf")
    labels = views.queries(spark, d).where(F.col("modality_requirement").isin(*ROUTES)).select("query_id", "modality_requirement")
    sample = labels.orderBy(F.xxhash64("query_id"), "query_id").limit(5000)
    rows = sample.join(v.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("term", "value"))).alias("x")), "query_id")
    table = rows.select("modality_requirement", "x.term", "x.value").toArrow()
    y = np.array([ROUTES.index(r) for r in table["modality_requirement"].to_pylist()], int)
    coded = table["term"].combine_chunks().flatten().dictionary_encode()
    terms, sizes = coded.dictionary.to_pylist(), table["term"].combine_chunks().value_lengths().to_numpy()
    n = len(y)
    row, col, value = np.repeat(np.arange(n), sizes), coded.indices.to_numpy() + 1, table["value"].combine_chunks().flatten().to_numpy()
    at = np.cumsum(np.concatenate([[0], sizes[:-1]])).astype(int) if n else []
    row, col, value = np.insert(row, at, np.arange(n)), np.insert(col, at, 0), np.insert(value, at, 1.0)
    w = softmax_fit_sparse(row, col, value, len(terms) + 1, y, 3, 450, 0.8, 0.05) if n else np.zeros((1, 3))
    model = spark.createDataFrame([(t, x) for t, x in zip(terms, w[1:].tolist())], "term string, w array<double>")
    score = v.join(F.broadcast(model), "term").groupBy("query_id").agg(*(F.sum(F.col("value") * F.col("w")[k]).alias(f"z{k}") for k in range(3)))
    z = [F.round(F.coalesce(F.col(f"z{k}"), F.lit(0.0)) + float(w[0][k]), 9) for k in range(3)]
    said = F.when(z[0] >= F.greatest(z[1], z[2]), ROUTES[0]).when(z[1] >= z[2], ROUTES[1]).otherwise(ROUTES[2])
    return labels.join(score, "query_id", "left").groupBy(F.col("modality_requirement").alias("truth"), said.alias("said")).agg(F.count("*").alias("n"))
