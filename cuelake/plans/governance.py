"""Validation, leakage, fingerprints and the job queue over the test tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuelake.operators import governance as gv
from cuelake.operators import jobs as jb
from cuelake.operators import vectors
from cuelake.operators.text import SQL_TOKENS, jaccard, tokens
from cuelake.plans.common import Registry
from cuelake.sources import views
from cuelake.sources.tables import load

query = Registry()
QUERIES, SQL = query.queries, query.sql

#: Addresses made of the pages of the videos, in the forms that the rules tell apart.
FORMS = ["{}", "HTTP://WWW.Media.Example./a_b/{n}.MP4?x=1#top", "https://youtu.be/{n}", "https://www.youtube.com/watch?v={n}&t=3", "https://youtube.com/shorts/{n}/x", "ftp://media.example/{n}", "https://user:pw@media.example/{n}", "http://192.168.0.7/{n}.mp4", "http://localhost:8080/{n}", "https://web.archive.org/web/2020/https://media.example/A_b%20c/{n}"]


def urls(spark, d):
    v = views.videos(spark, d).where(F.col("page_url").isNotNull()).select("video_id", "page_url").distinct()
    n = F.right("video_id", F.lit(9))
    form = lambda f: F.col("page_url") if f == "{}" else F.concat(F.lit(f.split("{n}")[0]), n, F.lit(f.split("{n}")[1]))
    return v.select("video_id", F.inline(F.array(*(F.struct(F.lit(i).alias("form"), form(f).alias("url")) for i, f in enumerate(FORMS)))))


URLS = "u AS (" + " UNION ALL ".join(f"SELECT video_id, {i} AS form, " + ("page_url" if f == "{}" else f"'{f.split('{n}')[0]}' || right(video_id, 9) || '{f.split('{n}')[1]}'") + " AS url FROM (SELECT DISTINCT video_id, page_url FROM vid WHERE page_url IS NOT NULL) x" for i, f in enumerate(FORMS)) + ")"
PARTS = URLS + r""", p AS (SELECT *, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) AS scheme, regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1) AS authority, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path, nullif(regexp_extract(url, '\?([^#]*)', 1), '') AS query FROM u),
h AS (SELECT *, contains(authority, '@') AS cred, regexp_replace(lower(regexp_replace(regexp_replace(authority, '^.*@', ''), ':\d+$', '')), '\.$', '') AS host, regexp_extract(authority, ':(\d+)$', 1) AS port FROM p),
w AS (SELECT *, CASE WHEN scheme NOT IN ('http', 'https') THEN 'scheme' WHEN cred THEN 'credentials' WHEN host = '' THEN 'host' WHEN host IN ('localhost', 'metadata.google.internal', '169.254.169.254') OR ends_with(host, '.localhost') THEN 'local'
  WHEN regexp_matches(host, '^(?:10|127|0)\.\d+\.\d+\.\d+$|^192\.168\.|^169\.254\.') THEN 'private' END AS why FROM h)"""


@query("v01_url_policy", "vid", f"WITH {PARTS} SELECT video_id, form, why, CASE WHEN why IS NULL THEN scheme || '://' || host || CASE WHEN port <> '' THEN ':' || port ELSE '' END || coalesce(nullif(path, ''), '/') || coalesce('?' || query, '') END AS normal FROM w")
def url_policy(spark, d):
    normal, why = gv.normalized_url(F.col("url"))
    return urls(spark, d).select("video_id", "form", why.alias("why"), normal.alias("normal"))


YT = "('youtu.be', 'youtube.com', 'www.youtube.com', 'm.youtube.com')"


@query("v02_provider", "vid", f"WITH {PARTS} SELECT video_id, form, CASE WHEN host IN {YT} THEN 'youtube' WHEN lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) IN ('mp4', 'webm', 'mov', 'mkv', 'avi') THEN 'direct' END AS provider FROM h")
def provider(spark, d):
    return urls(spark, d).select("video_id", "form", gv.provider(F.col("url")).alias("provider"))


VID = f"CASE WHEN host IN {YT} THEN CASE WHEN host = 'youtu.be' THEN split_part(ltrim(path, '/'), '/', 1) WHEN starts_with(path, '/shorts/') THEN split_part(path, '/', 3) ELSE regexp_extract(query, '(?:^|&)v=([^&]*)', 1) END END"


@query("v03_video_id", "vid", f"WITH {PARTS}, i AS (SELECT video_id, form, {VID} AS id FROM h) SELECT video_id, form, CASE WHEN regexp_full_match(id, '[A-Za-z0-9_-]{{6,20}}') THEN id END AS id FROM i")
def video_id(spark, d):
    return urls(spark, d).select("video_id", "form", gv.video_id_of(F.col("url")).alias("id"))


@query("v04_url_hash", "vid", f"WITH {URLS} SELECT video_id, form, sha256(url) AS id FROM u")
def url_hash(spark, d):
    return urls(spark, d).select("video_id", "form", F.sha2("url", 256).alias("id"))


@query("v05_safe_name", "vid", f"WITH {PARTS} SELECT video_id, form, coalesce(nullif(left(trim(regexp_replace(regexp_extract(url_decode(path), '([^/]*)/*$', 1), '[^A-Za-z0-9._ -]+', '_', 'g'), ' ._'), 160), ''), 'video') AS name FROM h")
def safe_name(spark, d):
    return urls(spark, d).select("video_id", "form", gv.safe_name(F.coalesce(F.try_parse_url("url", F.lit("PATH")), F.lit("")), "video").alias("name"))


@query("v06_media_limits", "vid", "SELECT video_id, regexp_matches(lower(path), '\\.(mp4|webm|mov|mkv|avi)$') AS known_type, duration_s > 0 AND duration_s <= 14400 AS length_ok FROM vid")
def media_limits(spark, d):
    return views.videos(spark, d).select("video_id", F.lower("path").rlike(r"\.(mp4|webm|mov|mkv|avi)$").alias("known_type"), ((F.col("duration_s") > 0) & (F.col("duration_s") <= 14400)).alias("length_ok"))


@query("v07_frame_names", "frm", "SELECT video_id, count(*) FILTER (regexp_full_match(split_part(thumbnail, '/', 2) || '.jpg', '[0-9]{6}\\.jpg')) AS valid, count(*) AS n FROM frm GROUP BY 1")
def frame_names(spark, d):
    name = F.concat(F.split_part("thumbnail", F.lit("/"), F.lit(2)), F.lit(".jpg"))
    return views.frames(spark, d).groupBy("video_id").agg(F.count(F.when(name.rlike(r"^[0-9]{6}\.jpg$"), 1)).alias("valid"), F.count("*").alias("n"))


UUID = "regexp_replace(md5(video_id), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5')"


@query("v08_uuid", "vid", f"SELECT DISTINCT video_id, {UUID} AS uuid, true AS valid FROM vid")
def uuid(spark, d):
    """Identifiers in capitals made canonical, and whether they are well formed."""
    raw = F.upper(F.regexp_replace(F.md5("video_id"), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))
    v = views.videos(spark, d).select("video_id", F.lower(raw).alias("uuid")).distinct()
    return v.withColumn("valid", F.col("uuid").rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"))


@query("v09_query_bounds", "qry", "SELECT query_id, rule FROM (SELECT query_id, unnest(list_filter([CASE WHEN len(query_text) BETWEEN 1 AND 90 THEN NULL ELSE 'length' END, CASE WHEN len(trim(query_text)) > 0 THEN NULL ELSE 'blank' END, CASE WHEN modality_requirement IN ('visual', 'speech', 'hybrid') THEN NULL ELSE 'mode' END], lambda x: x IS NOT NULL)) AS rule FROM qry) x")
def query_bounds(spark, d):
    t = F.col("query_text")
    return gv.violations(views.queries(spark, d), "query_id", {"length": F.length(t).between(1, 90), "blank": F.length(F.trim(t)) > 0, "mode": F.col("modality_requirement").isin("visual", "speech", "hybrid")})


@query("v10_vector_validity", "", "SELECT vec_id, len(embedding) > 0 AND list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) > 0 AND isfinite(list_sum(embedding)) AS valid FROM embeddings")
def vector_validity(spark, d):
    return load(spark, d, "embeddings").select("vec_id", vectors.valid(F.col("embedding")).alias("valid"))


@query("v11_source_key", "vid", "WITH " + URLS + r""", i AS (SELECT video_id, form, CASE WHEN regexp_matches(url, '^https?://web\.archive\.org/.*?/(https?:.*)$') THEN regexp_extract(url, '^https?://web\.archive\.org/.*?/(https?:.*)$', 1) ELSE url END AS url FROM u),
p AS (SELECT *, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)), '^www\.', '') AS host, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path, nullif(regexp_extract(url, '[?&]v=([^&#]*)', 1), '') AS v FROM i)
SELECT video_id, form, CASE WHEN host = 'youtu.be' THEN 'youtube:' || trim(path, '/') WHEN host IN ('youtube.com', 'm.youtube.com') AND v IS NOT NULL THEN 'youtube:' || v ELSE host || lower(replace(url_decode(path), '_', ' ')) END AS source_key FROM p""")
def source_key(spark, d):
    return urls(spark, d).select("video_id", "form", gv.source_key(F.col("url")).alias("source_key"))


@query("v12_judgements", "", "SELECT event_id, rule FROM (SELECT event_id, unnest(list_filter([CASE WHEN event_type IN ('view', 'click', 'purchase') THEN NULL ELSE 'verdict' END, CASE WHEN value >= 1 THEN NULL ELSE 'latency' END, CASE WHEN CAST(user_id % 2 = 0 AS INT) <= CAST(user_id % 3 <> 1 AS INT) THEN NULL ELSE 'monotone' END], lambda x: x IS NOT NULL)) AS rule FROM events) x")
def judgements(spark, d):
    """Known verdicts, latencies that can be, and a hit at 1 that is also one at 3; events stand for judgements."""
    at1, at3 = (F.col("user_id") % 2 == 0).cast("int"), (F.col("user_id") % 3 != 1).cast("int")
    return gv.violations(load(spark, d, "events"), "event_id", {"verdict": F.col("event_type").isin("view", "click", "purchase"), "latency": F.col("value") >= 1, "monotone": at1 <= at3})


GATE = "art AS (SELECT q.query_id, annotation_version AS visual_model, query_type AS revision, CASE WHEN expected_presence THEN 5e0 ELSE 1e0 END AS sampling_interval, modality_requirement AS mode, c.threshold FROM qry q LEFT JOIN (SELECT query_id, max(score) AS threshold FROM coarse_candidates WHERE NOT isnan(score) GROUP BY 1) c USING (query_id))"
GATES = {"visual_model": "2.0.0", "revision": "SCENE", "sampling_interval": 5.0, "mode": "visual"}


@query("v13_artifact_gate", "qry", f"WITH {GATE} SELECT query_id, rule FROM (SELECT query_id, unnest(list_filter([" + ", ".join(f"CASE WHEN {k} = {v!r} THEN NULL ELSE '{k}' END" for k, v in GATES.items()) + ", CASE WHEN isfinite(threshold) THEN NULL ELSE 'finite' END, CASE WHEN threshold BETWEEN -1 AND 1.001 THEN NULL ELSE 'range' END], lambda x: x IS NOT NULL)) AS rule FROM art) x")
def artifact_gate(spark, d):
    """One calibration artifact for each query: its best raw score as threshold, its fields as what it was made for."""
    c = load(spark, d, "coarse_candidates").where(~F.isnan("score")).groupBy("query_id").agg(F.max("score").alias("threshold"))
    a = views.queries(spark, d).join(c, "query_id", "left").select("query_id", F.col("annotation_version").alias("visual_model"), F.col("query_type").alias("revision"), F.when(F.col("expected_presence"), 5.0).otherwise(1.0).alias("sampling_interval"), F.col("modality_requirement").alias("mode"), "threshold")
    return gv.incompatible(a, "query_id", GATES, "threshold")


@query("v14_question_checks", "qry", "SELECT query_id, len(trim(query_text)) > 0 AND len(query_text) <= 500 AS ok FROM qry")
def question_checks(spark, d):
    return views.queries(spark, d).select("query_id", ((F.length(F.trim("query_text")) > 0) & (F.length("query_text") <= 500)).alias("ok"))


@query("v16_pruned", "cand", "SELECT query_id, candidate_id, round(score, 3) AS score FROM cand WHERE rank <= 3")
def pruned(spark, d):
    """Results as they are shown: only what is shown is read."""
    return views.pool(spark, d, 3).select("query_id", "candidate_id", F.round("score", 3).alias("score"))


@query("g01_disjointness", "vid", "SELECT what, value FROM (SELECT 'source_group' AS what, source_group AS value, split FROM vid UNION ALL SELECT 'source_sha256', source_sha256, split FROM vid UNION ALL SELECT 'video_id', video_id, split FROM vid) x WHERE value IS NOT NULL AND split IN ('calibration', 'heldout') GROUP BY ALL HAVING count(DISTINCT split) = 2")
def disjointness(spark, d):
    return gv.shared(views.videos(spark, d), "split", "calibration", "heldout", ["source_group", "source_sha256", "video_id"])


CATEGORIES = ["STATIC_OBJECT", "SCENE", "HUMAN_ACTION", "OBJECT_INTERACTION", "TEMPORAL_EVENT", "SMALL_OBJECT_DETAIL", "MULTIPLE_SIMILAR_MOMENTS"]
GROUPS = {"actions": (["HUMAN_ACTION", "TEMPORAL_EVENT"], 15), "interactions": (["OBJECT_INTERACTION"], 10)}
CATEGORY = "CASE WHEN query_type = 'OBJECT' THEN 'STATIC_OBJECT' WHEN query_type = 'SCENE' THEN 'SCENE' WHEN query_type = 'ACTION_TEMPORAL' THEN CASE WHEN modality_requirement = 'temporal' THEN 'TEMPORAL_EVENT' ELSE 'HUMAN_ACTION' END WHEN query_type = 'COMPOSITIONAL' THEN 'OBJECT_INTERACTION' WHEN query_type = 'SPEECH' THEN 'SMALL_OBJECT_DETAIL' END"
DIFFICULTY = "CASE WHEN length(query_text) < 60 THEN 'easy' WHEN length(query_text) < 90 THEN 'medium' WHEN length(query_text) < 140 THEN 'hard' END"
MAN = f"""src AS (SELECT split AS manifest, video_id AS source_id, page_url AS key, lower(source_sha256) AS sha, duration_s, license_name FROM (SELECT DISTINCT video_id, page_url, source_sha256, duration_s, license_name, split FROM vid) x WHERE split IN ('calibration', 'heldout')),
exc AS (SELECT DISTINCT page_url AS key, lower(source_sha256) AS sha FROM vid WHERE split = 'train'),
ask AS (SELECT s.split AS manifest, q.query_id, q.video_id AS source_id, {CATEGORY} AS category, q.query_text AS text, {DIFFICULTY} AS difficulty, q.relevant_intervals AS intervals, q.modality_requirement IS NOT NULL AS audited FROM qry q JOIN (SELECT DISTINCT video_id, split FROM vid) s USING (video_id) WHERE s.split IN ('calibration', 'heldout')),
sm AS (SELECT manifest, count(*) AS n, max(duration_s) AS long FROM src GROUP BY 1), qm AS (SELECT manifest, count(*) AS n FROM ask GROUP BY 1),
al AS (SELECT coalesce(sm.manifest, qm.manifest) AS manifest, coalesce(sm.n, 0) AS s, coalesce(qm.n, 0) AS q, coalesce(long, 0) AS long FROM sm FULL JOIN qm USING (manifest)),
cat AS (SELECT unnest({CATEGORIES!r}) AS c), cc AS (SELECT al.manifest, c, (SELECT count(*) FROM ask WHERE ask.manifest = al.manifest AND category = c) AS n FROM al, cat),
kn AS (SELECT manifest, source_id, max(duration_s) AS d FROM src GROUP BY ALL), an AS (SELECT manifest, source_id, count(*) AS n FROM ask GROUP BY ALL)"""


@query("g02_manifest", "vid qry", f"""WITH {MAN}
SELECT manifest, 'few_sources' AS rule, NULL::VARCHAR AS subject FROM al WHERE s < 5 UNION ALL SELECT manifest, 'few_queries', NULL FROM al WHERE q < 60 UNION ALL SELECT manifest, 'no_long_source', NULL FROM al WHERE long < 1200
UNION ALL SELECT manifest, 'few_actions', NULL FROM cc WHERE c IN ('HUMAN_ACTION', 'TEMPORAL_EVENT') GROUP BY manifest HAVING sum(n) < 15 UNION ALL SELECT manifest, 'few_interactions', NULL FROM cc WHERE c = 'OBJECT_INTERACTION' AND n < 10
UNION ALL SELECT manifest, 'category_missing', c FROM cc WHERE n = 0
UNION ALL SELECT manifest, 'duplicate_source', source_id FROM src GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT manifest, 'duplicate_media', sha FROM src WHERE sha IS NOT NULL GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT manifest, 'duplicate_query', query_id FROM ask GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT manifest, 'duplicate_address', key FROM src WHERE key IS NOT NULL GROUP BY ALL HAVING count(DISTINCT source_id) > 1
UNION ALL SELECT DISTINCT manifest, 'leaked_address', key FROM src WHERE key IN (SELECT key FROM exc WHERE key IS NOT NULL) UNION ALL SELECT DISTINCT manifest, 'leaked_media', sha FROM src WHERE sha IN (SELECT sha FROM exc WHERE sha IS NOT NULL)
UNION ALL SELECT manifest, 'source_incomplete', source_id FROM src WHERE NOT coalesce(len(trim(license_name)) > 0 AND duration_s > 0 AND isfinite(duration_s), false)
UNION ALL SELECT kn.manifest, 'few_queries_of_source', kn.source_id FROM kn LEFT JOIN an USING (manifest, source_id) WHERE coalesce(n, 0) < 8 UNION ALL SELECT manifest, 'unknown_source', source_id FROM an ANTI JOIN kn USING (manifest, source_id)
UNION ALL SELECT manifest, 'category', query_id FROM ask WHERE category IS NULL UNION ALL SELECT manifest, 'query', query_id FROM ask WHERE NOT coalesce(len(trim(text)) > 0 AND difficulty IS NOT NULL, false) UNION ALL SELECT manifest, 'audit', query_id FROM ask WHERE NOT audited
UNION ALL SELECT manifest, 'intervals', query_id FROM ask LEFT JOIN kn USING (manifest, source_id) WHERE NOT coalesce(len(intervals) > 0 AND len(list_filter(intervals, lambda i: coalesce(len(i) = 2 AND isfinite(i[1]) AND isfinite(i[2]) AND i[1] >= 0 AND i[1] <= i[2] AND i[2] <= d, false))) = len(intervals), false)""")
def manifest(spark, d):
    """The splits calibration and heldout as manifests; sources of the training split may not occur in them."""
    v = views.videos(spark, d).select("video_id", "page_url", F.lower("source_sha256").alias("sha256"), "duration_s", F.col("license_name").alias("license"), "split").distinct()
    mine = v.where(F.col("split").isin("calibration", "heldout"))
    keys = F.array_compact(F.array("page_url"))
    sources = mine.select(F.col("split").alias("manifest"), F.col("video_id").alias("source_id"), keys.alias("keys"), "sha256", "duration_s", "license")
    q = views.queries(spark, d).join(mine.select("video_id", F.col("split").alias("manifest")).distinct(), "video_id")
    asked = q.select("manifest", "query_id", F.col("video_id").alias("source_id"), F.expr(CATEGORY).alias("category"), F.col("query_text").alias("text"), F.expr(DIFFICULTY).alias("difficulty"), F.col("relevant_intervals").alias("intervals"), F.col("modality_requirement").isNotNull().alias("audited"))
    return gv.manifest_faults(sources, asked, v.where("split = 'train'").select(keys.alias("keys"), "sha256"), CATEGORIES, GROUPS)


@query("g03_freeze", "vid qry", "SELECT query_id, CASE WHEN split IS NULL THEN 'missing' ELSE 'changed' END AS state FROM qry JOIN (SELECT DISTINCT video_id, split FROM vid) s USING (video_id) WHERE split IS NULL OR sha256(query_text) <> sha256(trim(regexp_replace(query_text, '\\s+', ' ', 'g')))")
def freeze(spark, d):
    """Texts frozen as delivered against those of videos with a split, white space made single."""
    v = views.videos(spark, d).where("split IS NOT NULL").select("video_id").distinct()
    q = views.queries(spark, d)
    now = q.join(v, "video_id").select("query_id", F.sha2(F.btrim(F.regexp_replace("query_text", r"\s+", " ")), 256).alias("digest"))
    return gv.frozen_faults(q.select("query_id", F.sha2("query_text", 256).alias("digest")), now, "query_id", "digest")


BLOCKS = "".join(f", h{i + 1} AS (SELECT video_id, sum(rows) AS rows, {o} AS o, sha256(string_agg(h, '' ORDER BY o, h)) AS h FROM h{i} GROUP BY video_id{g})" for i, (o, g) in enumerate([("o // 65536", ", o // 65536")] * 2 + [("0", "")]))


@query("g04_fingerprints", "seg", f"WITH h0 AS (SELECT video_id, 1 AS rows, segment_id AS o, sha256(CAST(segment_id AS VARCHAR) || chr(31) || CAST(CAST(round(start_s * 1000) AS BIGINT) AS VARCHAR) || chr(31) || CAST(CAST(round(end_s * 1000) AS BIGINT) AS VARCHAR) || chr(31) || trim(text)) AS h FROM seg){BLOCKS} SELECT video_id, CAST(rows AS BIGINT) AS rows, h AS fingerprint FROM h3")
def fingerprints(spark, d):
    """A transcript's fingerprint changes with any of its segments, bounds to the millisecond."""
    ms = lambda c: F.round(F.col(c) * 1000).cast("bigint")
    return gv.fingerprint(views.segments(spark, d), ["video_id"], "segment_id", [F.col("segment_id"), ms("start_s"), ms("end_s"), F.trim("text")])


QT = f"t AS (SELECT query_id, split, list_distinct({SQL_TOKENS.format('query_text')}) AS ts, query_text FROM qry JOIN (SELECT DISTINCT video_id, split FROM vid) USING (video_id))"


@query("g05_exact_leakage", "qry vid", "WITH x AS (SELECT lower(trim(query_text)) AS text, split, count(*) AS n FROM qry JOIN (SELECT DISTINCT video_id, split FROM vid) USING (video_id) GROUP BY ALL) SELECT a.text, a.n AS train, b.n AS heldout FROM x a JOIN x b ON a.text = b.text AND a.split = 'train' AND b.split = 'heldout'")
def exact_leakage(spark, d):
    v = views.videos(spark, d).select("video_id", "split").distinct()
    x = views.queries(spark, d).join(v, "video_id").groupBy(F.lower(F.trim("query_text")).alias("text"), "split").agg(F.count("*").alias("n"))
    side = lambda s: x.where(F.col("split") == s).select("text", F.col("n").alias(s))
    return side("train").join(side("heldout"), "text")


ROUTE = "CASE modality_requirement WHEN 'temporal' THEN 'visual' ELSE modality_requirement END"


@query("g06_dataset_checks", "qry vid", f"""WITH s AS (SELECT DISTINCT video_id AS source_id, split FROM vid), r AS (SELECT query_id, video_id AS source_id, split, query_text AS text, {ROUTE} AS route FROM qry JOIN (SELECT DISTINCT video_id, split FROM vid) v USING (video_id)),
p AS (SELECT DISTINCT lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS f FROM r WHERE split = 'heldout'), h AS (SELECT source_id, min(split) AS lo, max(split) AS hi FROM s GROUP BY 1), sp AS (SELECT unnest(['train', 'calibration', 'heldout']) AS x),
c AS (SELECT split, count(*) FILTER (route = 'visual') AS a, count(*) FILTER (route = 'speech') AS b, count(*) FILTER (route = 'hybrid') AS c FROM r GROUP BY 1)
SELECT 'few_sources' AS rule, NULL::VARCHAR AS subject FROM (SELECT count(DISTINCT source_id) AS n FROM s) x WHERE n < 9 UNION ALL SELECT 'few_queries', NULL FROM (SELECT count(*) AS n FROM r) x WHERE n < 300 UNION ALL SELECT 'split_without_sources', x FROM sp WHERE x NOT IN (SELECT split FROM s WHERE split IS NOT NULL)
UNION ALL SELECT 'source_in_two_splits', source_id FROM h WHERE lo <> hi UNION ALL SELECT 'split_of_source', query_id FROM r LEFT JOIN h USING (source_id) WHERE NOT coalesce(split = lo AND lo = hi, false)
UNION ALL SELECT 'unbalanced', split FROM c WHERE greatest(a, b, c) - least(a, b, c) > 1 OR least(a, b, c) = 0 UNION ALL SELECT 'duplicate_id', query_id FROM r GROUP BY query_id HAVING count(*) > 1 UNION ALL SELECT 'duplicate_text', text FROM r GROUP BY text HAVING count(*) > 1
UNION ALL SELECT 'schema', query_id FROM r WHERE NOT coalesce(route IN ('visual', 'speech', 'hybrid') AND split IN ('train', 'calibration', 'heldout'), false) UNION ALL SELECT 'protected', query_id FROM r WHERE split = 'train' AND lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) IN (SELECT f FROM p)""")
def dataset_checks(spark, d):
    """All queries as a dataset for routing; the requests of the heldout split may not occur in training."""
    v = views.videos(spark, d).select("video_id", "split").distinct()
    r = views.queries(spark, d).join(v, "video_id").select("query_id", F.col("video_id").alias("source_id"), "split", F.col("query_text").alias("text"), F.expr(ROUTE).alias("route"))
    sources, splits, routes = v.withColumnRenamed("video_id", "source_id"), ["train", "calibration", "heldout"], ["visual", "speech", "hybrid"]
    out = gv.dataset_faults(sources, r, r.limit(0), splits, routes)
    leaks = gv.dataset_faults(sources, r.where("split = 'train'"), r.where("split = 'heldout'"), splits, routes)
    return out.unionByName(leaks.where("rule = 'protected'"))


@query("g07_remaining", "qry", "WITH done AS (SELECT query_id, CASE WHEN created_at > '2026-02-01' THEN query_text ELSE upper(query_text) END AS query_text FROM qry WHERE query_type <> 'SCENE') SELECT q.query_id, CASE WHEN d.query_id IS NULL THEN 'new' ELSE 'changed' END AS state FROM qry q LEFT JOIN done d USING (query_id) WHERE d.query_id IS NULL OR q.query_text IS DISTINCT FROM d.query_text")
def remaining(spark, d):
    """Work left to do: what is not done, and what changed since; the record of done work is made up of the queries."""
    q = views.queries(spark, d)
    done = q.where("query_type <> 'SCENE'").select("query_id", F.when(F.col("created_at") > F.to_timestamp(F.lit("2026-02-01")), F.col("query_text")).otherwise(F.upper("query_text")).alias("query_text"))
    return gv.remaining(q.select("query_id", "query_text"), done, "query_id")


@query("g08_diagnostic", "vid qry", "SELECT q.query_id FROM qry q SEMI JOIN (SELECT video_id FROM vid WHERE duration_s <= 360) v USING (video_id) WHERE q.modality_requirement = 'visual'")
def diagnostic(spark, d):
    short = views.videos(spark, d).where("duration_s <= 360").select("video_id")
    return views.queries(spark, d).where("modality_requirement = 'visual'").join(short, "video_id", "left_semi").select("query_id")


@query("g09_ordered_dedup", "ctx", "WITH u AS (SELECT video_id, unit_id, unnest(segment_ids) AS s, generate_subscripts(segment_ids, 1) AS pos FROM ctx), f AS (SELECT video_id, unit_id, s % 7 AS k, min(pos) AS first, max_by(s, pos) AS last FROM u GROUP BY ALL) SELECT video_id, unit_id, list(k ORDER BY first) AS keys, list(last ORDER BY first) AS last_values FROM f GROUP BY ALL")
def ordered_dedup(spark, d):
    """Keys in order of first appearance, each with the value it was given last."""
    u = views.units(spark, d, "context").select("video_id", "unit_id", F.posexplode("segment_ids").alias("pos", "s"))
    f = u.groupBy("video_id", "unit_id", (F.col("s") % 7).alias("k")).agg(F.min("pos").alias("first"), F.max_by("s", "pos").alias("last"))
    g = f.groupBy("video_id", "unit_id").agg(F.array_sort(F.collect_list(F.struct("first", "k", "last"))).alias("l"))
    return g.select("video_id", "unit_id", F.transform("l", lambda x: x.k).alias("keys"), F.transform("l", lambda x: x["last"]).alias("last_values"))


KIND = "CASE event_type WHEN 'view' THEN 'acquire' WHEN 'click' THEN 'ingest' WHEN 'signup' THEN 'speech' WHEN 'purchase' THEN 'visual' ELSE 'ingest' END"
JOB = f"job AS (SELECT event_id AS job_id, user_id, {KIND} AS kind, event_type = 'error' AS bad, event_id % 4 AS attempts, event_id % 3 > 0 AS retryable, epoch(ts) AS t0, value FROM events)"
JOBS = JOB + ", j AS (SELECT *, CASE WHEN NOT bad THEN 'ready' WHEN retryable AND attempts < 3 THEN 'queued' ELSE 'failed' END AS status, t0 + pow(2, attempts) AS available_at FROM job)"


def jobs(spark, d):
    """Jobs made of events: one attempt each, which fails at an error."""
    e = load(spark, d, "events")
    j = e.select(F.col("event_id").alias("job_id"), "user_id", F.expr(KIND).alias("kind"), F.when(F.col("event_type") == "error", "failed here").alias("error"), (F.col("event_id") % 4).alias("attempts"), (F.col("event_id") % 3 > 0).alias("retryable"), (F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)") / 1e6).alias("at"), "value")
    status = jb.retried(F.lit("running"), F.col("error"), F.col("retryable"), F.col("attempts"))
    return j.withColumns({"status": status, "available_at": jb.backoff(F.col("at"), F.col("attempts"))})


@query("w03_retry", "", f"WITH {JOBS} SELECT job_id, status, round(available_at, 6) AS available_at FROM j")
def retry(spark, d):
    return jobs(spark, d).select("job_id", "status", F.round("available_at", 6).alias("available_at"))


QUEUE = 2


@query("w01_enqueue", "", f"""WITH RECURSIVE {JOBS}, r AS (SELECT user_id, kind, job_id, t0, t0 + 3600 * coalesce(value, 0) AS until, row_number() OVER (PARTITION BY user_id ORDER BY t0, job_id) AS i FROM j),
f AS (SELECT user_id, i, job_id, 'accepted' AS verdict, [{{'k': kind, 'u': until}}] AS active FROM r WHERE i = 1 UNION ALL
SELECT user_id, i, job_id, v, CASE WHEN v = 'accepted' AND until > t0 THEN list_append(act, {{'k': kind, 'u': until}}) ELSE act END FROM (
  SELECT *, CASE WHEN len(act) >= {QUEUE} THEN 'full' WHEN len(list_filter(act, lambda a: a.k = kind)) > 0 THEN 'active' ELSE 'accepted' END AS v FROM (
    SELECT r.*, list_filter(f.active, lambda a: a.u > r.t0) AS act FROM f JOIN r ON r.user_id = f.user_id AND r.i = f.i + 1) x) y)
SELECT job_id, verdict FROM f""")
def enqueue(spark, d):
    """Requests to one queue for each user, two jobs long; each job takes an hour for each unit of value."""
    j = jobs(spark, d).select("user_id", "kind", "job_id", "at", (F.col("at") + 3600 * F.coalesce("value", F.lit(0.0))).alias("until"))
    return jb.enqueued(j, ["user_id"], ["kind"], "at", "until", "job_id", QUEUE).select("job_id", "verdict")


@query("w02_claim", "", f"WITH {JOBS} SELECT job_id FROM j WHERE status = 'queued' AND available_at <= (SELECT max(t0) - 86400 FROM job) ORDER BY available_at, job_id LIMIT 20")
def claim(spark, d):
    j = jobs(spark, d)
    now = j.agg((F.max("at") - 86400).alias("now"))
    return jb.claimable(j.crossJoin(F.broadcast(now)), F.col("now"), 20).select("job_id")


@query("w04_latest", "", f"WITH {JOBS}, l AS (SELECT *, row_number() OVER (PARTITION BY user_id, kind ORDER BY t0 DESC, job_id DESC) AS r FROM j) SELECT user_id, kind, job_id, CASE WHEN status IN ('queued', 'running') THEN 'processing' WHEN status = 'failed' THEN 'failed' END AS state, CASE kind WHEN 'acquire' THEN 'fetching' WHEN 'ingest' THEN 'preparing_video' WHEN 'speech' THEN 'transcribing' ELSE 'indexing' END AS stage FROM l WHERE r = 1")
def latest(spark, d):
    state, stage = jb.stage(F.col("kind"), F.col("status"))
    return jb.latest(jobs(spark, d), ["user_id", "kind"], "at", "job_id").select("user_id", "kind", "job_id", state.alias("state"), stage.alias("stage"))


@query("w05_recent", "", f"WITH {JOBS} SELECT job_id, kind, status FROM j ORDER BY t0 DESC, job_id DESC LIMIT 100")
def recent(spark, d):
    return jobs(spark, d).orderBy(F.desc("at"), F.desc("job_id")).limit(100).select("job_id", "kind", "status")


@query("w06_manual_retry", "", f"WITH {JOBS} SELECT job_id, CASE WHEN status <> 'failed' THEN 'not_failed' WHEN NOT retryable THEN 'not_retryable' ELSE 'queued' END AS verdict FROM j")
def manual_retry(spark, d):
    return jobs(spark, d).select("job_id", jb.retry_verdict(F.col("status"), F.col("retryable")).alias("verdict"))


@query("w07_chaining", "", f"WITH {JOBS} SELECT job_id, 'ingest' AS next_kind FROM j WHERE kind = 'acquire' AND status = 'ready'")
def chaining(spark, d):
    """A fetched medium is prepared next."""
    return jobs(spark, d).where("kind = 'acquire' AND status = 'ready'").select("job_id", F.lit("ingest").alias("next_kind"))


@query("w08_recovery", "", f"WITH {JOBS}, n AS (SELECT max(t0) - 86400 AS now FROM job) SELECT job_id, CASE WHEN retryable AND attempts < 3 THEN 'queued' ELSE 'failed' END AS status FROM j, n WHERE t0 <= now AND now < t0 + 3600 * value")
def recovery(spark, d):
    """Jobs that were running a day before the log's end, when their worker went away; they take an hour for each unit of value."""
    j = jobs(spark, d)
    now = j.agg((F.max("at") - 86400).alias("now"))
    running = (F.col("at") <= F.col("now")) & (F.col("now") < F.col("at") + 3600 * F.col("value"))
    return jb.recovered(j.crossJoin(F.broadcast(now)).withColumn("status", F.when(running, "running").otherwise(F.col("status"))))


@query("w09_deadlines", "", f"WITH {JOBS} SELECT kind, count(*) FILTER (value * 60 > CASE kind WHEN 'ingest' THEN 1800 WHEN 'speech' THEN 7200 ELSE 3600 END) AS overdue, count(*) AS n FROM j GROUP BY 1")
def deadlines(spark, d):
    late = jb.overdue(F.col("kind"), F.lit(0.0), F.col("value") * 60)
    return jobs(spark, d).groupBy("kind").agg(F.count(F.when(late, 1)).alias("overdue"), F.count("*").alias("n"))


CACHE = "c AS (SELECT user_id, event_type, max(ts) AS last, max(value) * 1000 AS bytes FROM events GROUP BY ALL), r AS (SELECT *, sum(bytes) OVER (PARTITION BY user_id ORDER BY last DESC, event_type ROWS UNBOUNDED PRECEDING) AS total FROM c)"


@query("s23_bounded_cache", "", f"WITH {CACHE} SELECT user_id, event_type, total <= 500000 AS kept FROM r")
def bounded_cache(spark, d):
    """What a cache bounded in bytes still holds: the most recently used as long as their sum fits."""
    c = load(spark, d, "events").groupBy("user_id", "event_type").agg(F.max("ts").alias("last"), (F.max("value") * 1000).alias("bytes"))
    return jb.running(c, ["user_id"], [F.desc("last"), "event_type"], "bytes", "total").select("user_id", "event_type", (F.col("total") <= 500000).alias("kept"))


@query("x01_event_windows", "", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts IS NOT NULL GROUP BY ALL")
def event_windows(spark, d):
    """Extension: tumbling windows over event time, as the streaming form computes them."""
    w = F.window("ts", "1 hour")
    return load(spark, d, "events").groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


@query("x02_sessions", "", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def sessions(spark, d):
    """Extension: sessions that end after six hours without an event."""
    w = F.session_window("ts", "6 hours")
    return load(spark, d, "events").groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")
