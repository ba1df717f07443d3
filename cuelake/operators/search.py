"""Searching many videos for many queries in one plan: what is said, what is seen, and both."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuelake.operators.fusion import fuse
from cuelake.operators.text import bm25, tokens
from cuelake.sources import views

LANE = 50


def spoken(spark: SparkSession, d: str, k: int = LANE) -> DataFrame:
    """``(query_id, video_id, segment_id, score, rank, start_s, end_s, text)``: best segments of each query's own video.

    BM25 with the video as the corpus; equal scores by start, then segment.
    """
    s = views.segments(spark, d)
    docs = s.select("video_id", "segment_id", tokens(F.col("text")).alias("tokens"))
    asked = views.queries(spark, d).select("video_id", "query_id", tokens(F.col("query_text")).alias("tokens"))
    hits = bm25(docs, asked, ["video_id"], "segment_id", "query_id").withColumn("score", F.round("score", 9)).where("score > 0")
    hits = hits.join(s.select("segment_id", "start_s", "end_s", "text"), "segment_id")
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "start_s", "segment_id")
    return hits.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)


def speech_lane(spark: SparkSession, d: str, k: int = LANE) -> DataFrame:
    return views.on_frames(spoken(spark, d, k), spark, d, "start_s")


def lanes(spark: SparkSession, d: str) -> DataFrame:
    """Both lanes of every query in its own video, in the form that fusion takes."""
    v = views.visual_lane(spark, d).select("query_id", F.lit("visual").alias("lane"), "rank", "thumbnail", "score", "ts", F.lit(None).cast("double").alias("end"), F.lit(None).cast("string").alias("text"))
    s = speech_lane(spark, d).where(F.col("thumbnail").isNotNull())
    return v.unionByName(s.select("query_id", F.lit("speech").alias("lane"), "rank", "thumbnail", "score", F.col("start_s").alias("ts"), F.col("end_s").alias("end"), "text"))


def search(spark: SparkSession, d: str, mode: str = "hybrid", k: int = 8) -> DataFrame:
    """Results of every query: ``visual`` and ``speech`` are the lanes themselves, ``hybrid`` fuses whatever lanes there are."""
    both = lanes(spark, d)
    if mode in ("visual", "speech"):
        return both.where((F.col("lane") == mode) & (F.col("rank") <= k))
    return fuse(both, ["query_id"]).where(F.col("fused_rank") <= k)
