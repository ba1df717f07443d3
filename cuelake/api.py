"""What callers use: the library's questions to a directory of tables, each a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.operators import governance, jobs, search as searching
from cuelake.operators.evidence import resolved_answer
from cuelake.operators.routing import requested_count, scope, temporal_relation
from cuelake.sources import views

MODES = ("auto", "visual", "speech", "hybrid")


def videos(spark: SparkSession, directory: str) -> DataFrame:
    return views.videos(spark, directory)


def search(spark: SparkSession, directory: str, mode: str = "hybrid", k: int = 8) -> DataFrame:
    """Results of all queries, each in its own video. ``auto`` means ``hybrid`` unless routes are resolved by the caller."""
    if mode not in MODES or not 1 <= k <= 50:
        raise ValueError(f"mode must be one of {MODES} and k from 1 to 50")
    return searching.search(spark, directory, "hybrid" if mode == "auto" else mode, k)


def search_transcript(segments: DataFrame, text: str) -> DataFrame:
    """Segments that contain ``text`` literally, whatever the letter case."""
    return segments.where(F.contains(F.lower("text"), F.lower(F.trim(F.lit(text))))).orderBy("video_id", "start_s")


def validate_urls(df: DataFrame, url: str) -> DataFrame:
    """Adds the normal form, the reason of a refusal, the provider and its id of each address."""
    normal, why = governance.normalized_url(F.col(url))
    return df.withColumns({"normal_url": normal, "refused": why, "provider": governance.provider(F.col(url)), "external_id": governance.external_id(F.col(url))})


def ask(questions: DataFrame, generated: DataFrame) -> DataFrame:
    """Outcomes of questions ``(query_id, query_text)`` given generated answers: out of scope, no evidence, abstain or answer."""
    q = questions.select("query_id", "query_text", scope(F.col("query_text")).alias("scope"))
    g = generated.join(q.select("query_id", requested_count(F.col("query_text")).alias("requested_count"), temporal_relation(F.col("query_text")).isNotNull().alias("temporal")), "query_id")
    a = resolved_answer(g).select("query_id", "verdict", "citations", "answer")
    j = q.join(a, "query_id", "left")
    out = F.when(F.col("scope") != "SUPPORTED_CORE", "out_of_scope").when(F.col("verdict").isNull(), "no_evidence").otherwise(F.col("verdict"))
    return j.select("query_id", out.alias("outcome"), F.when(out == "answer", F.col("answer")).alias("answer"), F.when(out == "answer", F.col("citations")).alias("citations"))


def jobs_view(log: DataFrame) -> DataFrame:
    """The latest job of each video and kind with its state and stage."""
    state, stage = jobs.stage(F.col("kind"), F.col("status"))
    return jobs.latest(log, ["video_id", "kind"], "created_at", "job_id").withColumns({"state": state, "stage": stage})
