"""Problem 1: periods and gaps of every video and every query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.operators.intervals import counting, spans
from cuelake.sources.tables import load


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["entity_kind", "entity_id"]
    s = load(spark, sf_dir, "segments").select(F.lit("video").alias("entity_kind"), F.col("video_id").alias("entity_id"), "start_s", "end_s")
    q = load(spark, sf_dir, "queries").select(F.lit("query").alias("entity_kind"), F.col("query_id").alias("entity_id"), F.explode("relevant_intervals").alias("i"))
    pairs = q.where(F.size("i") == 2).select(*keys, F.get("i", F.lit(0)).alias("start_s"), F.get("i", F.lit(1)).alias("end_s"))
    return spans(counting(s.unionByName(pairs), keys, F.col("start_s"), F.col("end_s")), keys)


FOUND_SQL = """
WITH raw AS (
  SELECT 'video' AS entity_kind, video_id AS entity_id, start_s AS a, end_s AS b FROM segments
  UNION ALL
  SELECT 'query', query_id, i[1], i[2] FROM (SELECT query_id, unnest(relevant_intervals) AS i FROM queries) x WHERE len(i) = 2
), ms AS (
  SELECT entity_kind, entity_id, TRY_CAST(round(a * 1000) AS BIGINT) AS s, TRY_CAST(round(b * 1000) AS BIGINT) AS e FROM raw
  WHERE entity_id IS NOT NULL AND abs(a) <= 9.2e15 AND abs(b) <= 9.2e15
), ok AS (SELECT DISTINCT * FROM ms WHERE s >= 0 AND e > s
), reach AS (
  SELECT *, max(e) OVER (PARTITION BY entity_kind, entity_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM ok
), isle AS (
  SELECT *, sum(CASE WHEN m IS NULL OR s > m THEN 1 ELSE 0 END) OVER (PARTITION BY entity_kind, entity_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM reach
), period AS (
  SELECT entity_kind, entity_id, k, min(s) AS start_ms, max(e) AS end_ms FROM isle GROUP BY ALL
), gap AS (
  SELECT entity_kind, entity_id, lag(end_ms) OVER (PARTITION BY entity_kind, entity_id ORDER BY k) AS start_ms, start_ms AS end_ms FROM period
)
SELECT entity_kind, entity_id, 'period' AS span_kind, start_ms, end_ms FROM period
UNION ALL
SELECT entity_kind, entity_id, 'gap', start_ms, end_ms FROM gap WHERE start_ms IS NOT NULL
"""

QUERIES = {"p1_found": found}
SQL = {"p1_found": FOUND_SQL}
