"""Media, requests and calls over the test tables; models and servers are stand-ins whose answers follow from their input."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from cuelake.operators import ingest as ig
from cuelake.operators import vectors
from cuelake.plans.common import Registry
from cuelake.plans.governance import urls
from cuelake.sources import views
from cuelake.sources.tables import load

query = Registry()
QUERIES, SQL = query.queries, query.sql

N = "CAST(right(video_id, 9) AS BIGINT)"
FPS = f"CASE {N} % 5 WHEN 0 THEN 25e0 WHEN 1 THEN 30e0 WHEN 2 THEN 0e0 WHEN 3 THEN 50e0 END"


@query("s12_probe", "vid", f"WITH p AS (SELECT DISTINCT video_id, {FPS} AS fps, floor(duration_s * 25) AS frames, CASE WHEN {N} % 7 = 0 THEN 7680 ELSE 1920 END AS width, 1080 + 2160 * ({N} % 2) AS height FROM vid), g AS (SELECT *, coalesce(isfinite(fps) AND fps > 0 AND isfinite(frames) AND frames > 0, false) AS ok FROM p) SELECT video_id, CASE WHEN ok THEN round(frames / fps, 6) END AS duration, 'avc1' AS codec, CASE WHEN NOT ok THEN 'no_stream' WHEN frames / fps > 3600 THEN 'too_long' WHEN width * height > 8294400 THEN 'too_large' END AS refused FROM g")
def probe(spark, d):
    """What probing tells of each medium; rates and sizes come from its number."""
    n = F.expr(N)
    v = views.videos(spark, d).select("video_id", F.expr(FPS).alias("fps"), F.floor(F.col("duration_s") * 25).alias("frames"), F.when(n % 7 == 0, 7680).otherwise(1920).alias("width"), (1080 + 2160 * (n % 2)).alias("height"), F.lit(0x31637661).alias("fourcc")).distinct()
    return ig.probed(v, "fps", "frames", "width", "height", "fourcc").select("video_id", F.round("duration", 6).alias("duration"), "codec", "refused")


UP = [
    "CASE event_id % 6 WHEN 0 THEN 'a.mp4' WHEN 1 THEN 'B.MOV' WHEN 2 THEN 'c.tar.gz' WHEN 3 THEN 'd' WHEN 4 THEN 'e.webm' ELSE '.mkv' END AS name",
    "CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'many' WHEN 2 THEN '2000000000' ELSE CAST(event_id % 7 * 100000000 AS STRING) END AS declared",
    'CASE WHEN event_id % 11 = 0 THEN 0 ELSE event_id % 13 * 100000000 END AS size',
    '900000000 AS free',
]


@query("s08_upload_status", "", f"WITH u AS (SELECT event_id, {', '.join(UP)} FROM events), n AS (SELECT *, lower(regexp_extract(name, '[^/]\\.([^./]+)$', 1)) IN ('mp4', 'webm', 'mov', 'mkv', 'avi') AS known, TRY_CAST(declared AS BIGINT) AS b FROM u) SELECT event_id, CAST(CASE WHEN NOT known THEN 415 WHEN declared IS NOT NULL AND b IS NULL THEN 400 WHEN b > 1073741824 THEN 413 WHEN coalesce(b + floor(b * 0.25e0), 0) > free THEN 507 WHEN size > 1073741824 THEN 413 WHEN floor(size * 0.25e0) > free - size THEN 507 WHEN size = 0 THEN 400 ELSE 200 END AS INT) AS status FROM n")
def upload_status(spark, d):
    """Events as uploads to a disk of 900 MB."""
    u = load(spark, d, "events").selectExpr("event_id", *UP)
    return u.select("event_id", ig.upload_status(F.col("name"), F.col("declared"), F.col("size"), F.col("free")).alias("status"))


@query("s09_followed")
def followed(spark, d):
    """Downloads of pages in all forms of addresses, whose servers redirect by the video's number."""
    n = F.expr(N)
    a = lambda s, to, b: F.struct(F.lit(s).alias("status"), to.cast("string").alias("location"), F.lit(b).cast("bigint").alias("bytes"))
    none = F.lit(None)
    chain = F.when(n % 4 == 0, F.array(a(200, none, 10))).when(n % 4 == 1, F.array(a(302, F.lit("/moved/x.mp4"), 0), a(301, F.lit("y.mp4"), 0), a(200, none, 5))).when(n % 4 == 2, F.array(a(302, F.lit("http://127.0.0.1/x"), 0), a(200, none, 5))).otherwise(F.array(a(503, none, 0)))
    return urls(spark, d).select("video_id", "form", ig.followed(F.col("url"), chain).alias("x")).select("video_id", "form", "x.url", "x.outcome")


ACC = [
    "CASE event_id % 4 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' WHEN 2 THEN 'OPTIONS' ELSE 'DELETE' END AS method",
    "CASE WHEN event_id % 9 = 0 THEN '/health' ELSE '/videos' END AS path",
    "CASE event_id % 3 WHEN 0 THEN 'https://app.example' WHEN 1 THEN 'https://other.example' END AS origin",
]


@query("v15_access", "", f"WITH r AS (SELECT event_id, {', '.join(ACC)}, CASE event_id % 5 WHEN 0 THEN 'Bearer secret' WHEN 1 THEN 'Basic ' || to_base64(encode('operator:secret')) WHEN 2 THEN 'Basic ' || to_base64(encode('operator:wrong')) WHEN 3 THEN 'Basic !!' END AS authorization FROM events) SELECT event_id, CAST(CASE WHEN method IN ('POST', 'DELETE') AND origin = 'https://other.example' THEN 403 WHEN path <> '/health' AND method <> 'OPTIONS' AND NOT coalesce(event_id % 5 IN (0, 1), false) THEN 401 ELSE 200 END AS INT) AS status FROM r")
def access(spark, d):
    """Events as requests with right, wrong and broken credentials, or none."""
    k = F.col("event_id") % 5
    auth = lambda x: F.concat(F.lit("Basic "), F.base64(F.lit(x).cast("binary")))
    given = F.when(k == 0, "Bearer secret").when(k == 1, auth("operator:secret")).when(k == 2, auth("operator:wrong")).when(k == 3, "Basic !!")
    r = load(spark, d, "events").select("event_id", *map(F.expr, ACC), given.alias("authorization"))
    return r.select("event_id", ig.access_status(F.col("method"), F.col("path"), F.col("origin"), F.col("authorization"), ["https://app.example"], "operator", "secret").alias("status"))


@query("w10_leftovers", "vid", f"SELECT DISTINCT video_id, name FROM (SELECT video_id, unnest(['manifest.json', 'frames.tmp', 'source.mp4.part', 'source.mp4']) AS name FROM vid WHERE {N} % 3 <> 0) x WHERE ends_with(name, '.tmp') OR ends_with(name, '.part')")
def leftovers(spark, d):
    """What broken jobs left behind; a third of the media is being worked on."""
    v = views.videos(spark, d).select("video_id").distinct()
    files = v.withColumn("name", F.explode(F.array(*map(F.lit, ("manifest.json", "frames.tmp", "source.mp4.part", "source.mp4")))))
    return ig.leftovers(files, v.where(F.expr(N) % 3 == 0), "video_id", "name")


def _provider(text: str, attempt: int):
    kind = len(text) % 7
    if kind == 0:
        return None, None
    if kind == 1 and attempt == 0:
        return 429, None
    return (500, None) if kind == 2 else (404, None) if kind == 3 else (200, text[:5])


@query("n03_called", "qry", "SELECT query_id, CAST(CASE len(query_text) % 7 WHEN 0 THEN 504 WHEN 2 THEN 502 WHEN 3 THEN 502 ELSE 200 END AS INT) AS status, CASE WHEN len(query_text) % 7 NOT IN (0, 2, 3) THEN left(query_text, 5) END AS body, CAST(CASE len(query_text) % 7 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 1 END AS INT) AS attempts FROM qry WHERE query_text IS NOT NULL")
def called(spark, d):
    """Calls to a provider that times out, is busy once, breaks, refuses or answers, by the length of the request."""
    q = views.queries(spark, d).where(F.col("query_text").isNotNull()).select("query_id", "query_text")
    return ig.called(q, "query_text", _provider, 2).select("query_id", "status", "body", "attempts")


UNIT = "sqrt(CAST(len(query_text) AS DOUBLE) * len(query_text) + (len(query_text) % 5) * (len(query_text) % 5) + 1)"


@query("r07_encoded", "qry", f"SELECT query_id, round(len(query_text) / {UNIT}, 5) AS a, round((len(query_text) % 5) / {UNIT}, 5) AS b FROM qry WHERE query_text IS NOT NULL")
def encoded(spark, d):
    """Unit vectors of a stand-in model, batch by batch."""
    q = views.queries(spark, d).where(F.col("query_text").isNotNull()).select("query_id", "query_text")
    e = vectors.encode(q, "query_text", lambda ts: np.array([[len(t), len(t) % 5, 1] for t in ts], np.float32), unit=True)
    return e.select("query_id", *(F.round(F.get("embedding", F.lit(i)), 5).alias(c) for i, c in enumerate("ab")))


NEXT = "SELECT a.vec_id, CAST(a.embedding AS DOUBLE[]) AS v, CAST(b.embedding AS DOUBLE[]) AS w FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"


def neighbours(spark, d):
    e = load(spark, d, "embeddings").select("vec_id", "embedding")
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")


@query("r11_mean_pooled", "", f"WITH p AS ({NEXT}), m AS (SELECT vec_id, list_transform(range(1, len(v) + 1), lambda i: CASE WHEN vec_id % 2 = 1 THEN (v[i] + w[i]) / 2 ELSE v[i] END) AS m FROM p) SELECT vec_id, round(m[1] / sqrt(list_dot_product(m, m)), 6) AS first, round(m[2] / sqrt(list_dot_product(m, m)), 6) AS second FROM m")
def mean_pooled(spark, d):
    """Two vectors as tokens of which the second is masked for every other one."""
    m = vectors.mean_pooled(F.array("embedding", "other"), F.array(F.lit(1).cast("bigint"), F.col("vec_id") % 2))
    return neighbours(spark, d).select("vec_id", m.alias("m")).select("vec_id", F.round(F.get("m", F.lit(0)), 6).alias("first"), F.round(F.get("m", F.lit(1)), 6).alias("second"))


@query("r21_conditioned_score", "", f"WITH p AS ({NEXT}), c AS (SELECT vec_id, v, list_transform(range(1, len(w) + 1), lambda i: w[i] + v[i] * 0.1e0) AS c FROM p) SELECT vec_id, round(list_dot_product(v, c) / sqrt(list_dot_product(c, c)), 6) AS score FROM c")
def conditioned_score(spark, d):
    """A vector as a clip, the next one as a text that a tenth of the clip was added to."""
    prompt = F.transform("embedding", lambda x: x.cast("double") * 0.1)
    return neighbours(spark, d).select("vec_id", F.round(vectors.conditioned_score(F.col("embedding"), F.col("other"), prompt), 6).alias("score"))


@query("r22_pair_scores", "qry", "SELECT query_id, round(len(query_text) / CAST(len(query_text) + len(video_id) AS DOUBLE), 6) AS score FROM qry WHERE query_text IS NOT NULL")
def pair_scores(spark, d):
    """Scores of pairs by a stand-in model: the share that the first has of both lengths."""
    q = views.queries(spark, d).where(F.col("query_text").isNotNull()).select("query_id", "video_id", "query_text")
    s = vectors.pair_scores(q, "query_text", "video_id", lambda x, y: np.array([len(a) / (len(a) + len(b)) for a, b in zip(x, y)]))
    return s.select("query_id", F.round("score", 6).alias("score"))
