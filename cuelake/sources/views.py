"""The tables as the operators take them: one row for each key, faulty bounds left out.

Each view is a function of (spark, directory); VIEWS holds the same in SQL for the comparison.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuelake.sources.tables import load

#: Seconds between sampled frames.
FRAME_S = 5.0


def finite(*columns: str) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & (F.abs(c) < float("inf"))
    return out


def plain_split(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"[\s_-]", ""))


def segments(spark: SparkSession, d: str) -> DataFrame:
    """``(video_id, segment_id, start_s, end_s, text)`` with 0 <= start <= end and a text."""
    s = load(spark, d, "segments").select("video_id", "segment_id", "start_s", "end_s", "text")
    return s.where(finite("start_s", "end_s") & (F.col("start_s") >= 0) & (F.col("start_s") <= F.col("end_s")) & F.col("text").isNotNull() & F.col("video_id").isNotNull()).dropDuplicates(["segment_id"])


def videos(spark: SparkSession, d: str) -> DataFrame:
    v = load(spark, d, "videos").where(F.col("video_id").isNotNull()).drop("added_at").distinct()
    return v.withColumn("split", plain_split(F.col("split")))


def queries(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "queries").where(F.col("query_id").isNotNull()).dropDuplicates(["query_id"])


def intervals(spark: SparkSession, d: str) -> DataFrame:
    """``(query_id, ord, s, e)``: relevance intervals with finite bounds, start not negative, end after start."""
    q = queries(spark, d).select("query_id", F.posexplode("relevant_intervals").alias("ord", "i")).where(F.size("i") == 2)
    q = q.select("query_id", F.col("ord").cast("bigint").alias("ord"), F.get("i", F.lit(0)).alias("s"), F.get("i", F.lit(1)).alias("e"))
    return q.where(finite("s", "e") & (F.col("s") >= 0) & (F.col("e") > F.col("s")))


def frames(spark: SparkSession, d: str) -> DataFrame:
    """``(video_id, frame_idx, ts, thumbnail)``: one frame every FRAME_S seconds of every video."""
    v = videos(spark, d).where(finite("duration_s") & (F.col("duration_s") >= 0)).groupBy("video_id").agg(F.max("duration_s").alias("duration_s"))
    last = F.floor(F.col("duration_s") / FRAME_S).cast("bigint")
    f = v.select("video_id", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("frame_idx"))
    return f.select("video_id", "frame_idx", (F.col("frame_idx") * FRAME_S).alias("ts"), thumbnail(F.col("video_id"), F.col("frame_idx")).alias("thumbnail"))


def thumbnail(video: Column, idx: Column) -> Column:
    return F.concat(video, F.lit("/"), F.lpad((idx + 1).cast("string"), 6, "0"))


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "coarse_candidates").select("query_id", "video_id", "candidate_id", F.col("timestamp_s").alias("ts"), "score")
    return c.where(finite("ts", "score") & (F.col("ts") >= 0) & F.col("candidate_id").isNotNull())


def _ranked(c: DataFrame) -> DataFrame:
    w = W.partitionBy("query_id", "video_id").orderBy(F.desc("score"), "ts", "candidate_id")
    return c.distinct().withColumn("rank", F.row_number().over(w).cast("bigint"))


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """``(query_id, video_id, candidate_id, ts, score, rank)``: visual candidates, best first, stable on ties."""
    return _ranked(_candidates(spark, d))


def pool(spark: SparkSession, d: str, k: int = 50) -> DataFrame:
    """The best k candidates of each query and video."""
    return candidates(spark, d).where(F.col("rank") <= k)


def own_pool(spark: SparkSession, d: str, k: int = 50) -> DataFrame:
    """The pool of each query in its own video; candidates of other videos are left out before any is ranked."""
    own = queries(spark, d).select("query_id", "video_id")
    return _ranked(_candidates(spark, d).join(own, ["query_id", "video_id"], "left_semi")).where(F.col("rank") <= k)


def on_frames(points: DataFrame, spark: SparkSession, d: str, at: str) -> DataFrame:
    """Adds the thumbnail of the frame nearest to ``at``; halves go to the earlier frame, null without frames.

    Frames lie every FRAME_S seconds, so the nearest one is found by arithmetic from a medium's length.
    """
    v = videos(spark, d).where(finite("duration_s") & (F.col("duration_s") >= 0)).groupBy("video_id").agg(F.floor(F.max("duration_s") / FRAME_S).cast("bigint").alias("_last"))
    idx = F.greatest(F.least(F.ceil(F.col(at) / FRAME_S - 0.5).cast("bigint"), F.col("_last")), F.lit(0).cast("bigint"))
    return points.join(v, "video_id", "left").withColumn("thumbnail", F.when(F.col("_last").isNotNull(), thumbnail(F.col("video_id"), idx))).drop("_last")


def visual_lane(spark: SparkSession, d: str, k: int = 50) -> DataFrame:
    """The pool of each query in its own video, with the nearest frame's thumbnail; halves go to the earlier frame."""
    p = on_frames(own_pool(spark, d, k), spark, d, "ts").where(F.col("thumbnail").isNotNull())
    return p.select("query_id", "video_id", "rank", "ts", "score", "thumbnail")


def units(spark: SparkSession, d: str, level: str) -> DataFrame:
    u = load(spark, d, "transcript_units").where(F.col("unit_level") == level)
    return u.select("video_id", "unit_id", "start_seconds", "end_seconds", "text", "segment_ids", "fine_ids").dropDuplicates(["video_id", "unit_id"])


VIEWS = {
    "seg": """SELECT DISTINCT video_id, segment_id, start_s, end_s, text FROM segments
  WHERE isfinite(start_s) AND isfinite(end_s) AND start_s >= 0 AND start_s <= end_s AND text IS NOT NULL AND video_id IS NOT NULL""",
    "vid": """SELECT DISTINCT video_id, path, video_domain, lower(regexp_replace(split, '[\\s_-]', '', 'g')) AS split, source_group, page_url, license_name, source_sha256, duration_s
  FROM videos WHERE video_id IS NOT NULL""",
    "qry": "SELECT DISTINCT ON (query_id) * FROM queries WHERE query_id IS NOT NULL",
    "ivl": """SELECT query_id, ord, i[1] AS s, i[2] AS e FROM (SELECT query_id, unnest(relevant_intervals) AS i, generate_subscripts(relevant_intervals, 1) - 1 AS ord FROM qry) x
  WHERE len(i) = 2 AND isfinite(i[1]) AND isfinite(i[2]) AND i[1] >= 0 AND i[2] > i[1]""",
    "frm": """SELECT video_id, frame_idx, frame_idx * 5e0 AS ts, video_id || '/' || lpad(CAST(frame_idx + 1 AS VARCHAR), 6, '0') AS thumbnail
  FROM (SELECT video_id, unnest(generate_series(0, CAST(floor(max(duration_s) / 5e0) AS BIGINT))) AS frame_idx FROM vid WHERE isfinite(duration_s) AND duration_s >= 0 GROUP BY video_id) x""",
    "cand": """SELECT *, row_number() OVER (PARTITION BY query_id, video_id ORDER BY score DESC, ts, candidate_id) AS rank FROM (
    SELECT DISTINCT query_id, video_id, candidate_id, timestamp_s AS ts, score FROM coarse_candidates WHERE isfinite(timestamp_s) AND isfinite(score) AND timestamp_s >= 0 AND candidate_id IS NOT NULL) x""",
    "pool": "SELECT * FROM cand WHERE rank <= 50",
    "vlane": """SELECT p.query_id, p.video_id, p.rank, p.ts, p.score, p.video_id || '/' || lpad(CAST(greatest(least(CAST(ceil(p.ts / 5e0 - 0.5e0) AS BIGINT), l.last), 0) + 1 AS VARCHAR), 6, '0') AS thumbnail
  FROM pool p JOIN qry q ON p.query_id = q.query_id AND p.video_id = q.video_id JOIN (SELECT video_id, max(frame_idx) AS last FROM frm GROUP BY video_id) l ON p.video_id = l.video_id""",
    "fine": "SELECT DISTINCT ON (video_id, unit_id) video_id, unit_id, start_seconds, end_seconds, text, segment_ids, fine_ids FROM transcript_units WHERE unit_level = 'fine'",
    "ctx": "SELECT DISTINCT ON (video_id, unit_id) video_id, unit_id, start_seconds, end_seconds, text, segment_ids, fine_ids FROM transcript_units WHERE unit_level = 'context'",
}
_NEEDS = {"ivl": ["qry"], "frm": ["vid"], "pool": ["cand"], "vlane": ["vid", "frm", "qry", "cand", "pool"]}


def with_views(names: str, body: str) -> str:
    """``body`` behind the views it names (separated by blanks) and those they need; body may start with its own CTEs."""
    order: list[str] = []

    def add(n: str) -> None:
        for x in _NEEDS.get(n, []):
            add(x)
        if n not in order:
            order.append(n)

    for n in names.split():
        add(n)
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({VIEWS[n]})" for n in order)
    body = body.strip()
    if not ctes:
        return body
    recursive = "RECURSIVE " if body.upper().startswith("WITH RECURSIVE ") else ""
    if body.upper().startswith("WITH "):
        return f"WITH {recursive}{ctes},\n{body[5 + len(recursive):]}"
    return f"WITH {ctes}\n{body}"
