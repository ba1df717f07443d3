"""Problem 2: cutting texts over a size limit at natural boundaries, with overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.sources.tables import load

LIMIT, OVERLAP = 900, 90


def core_pattern(limit: int = LIMIT, overlap: int = OVERLAP) -> str:
    """A regular expression whose successive matches cut a text into cores without leaving a character out.

    A core and its overlap together stay within ``limit``. Alternatives stand in the order of their boundaries'
    strength; each is greedy, so it takes the last such boundary within reach. Boundaries stronger than white space
    must lie in the second half, or a heading would make a piece of its own. The last alternative takes a run without
    white space whole, or its first ``limit`` characters.
    """
    reach, half = limit - overlap, (limit - overlap) // 2
    least = lambda tail: f".{{{half},{reach - tail}}}"
    return "(?s)" + "|".join([
        f".{{1,{reach}}}\\z",
        least(4) + r"(?:\r?\n){2}",
        least(1) + r"\n",
        least(3) + r"[.!?…。？！][\"'”’)\]]?[ \t]",
        least(2) + r"[,;:][ \t]",
        f".{{0,{reach - 1}}}[ \\t\\n\\r]",
        f"[^ \\t\\n\\r]{{1,{limit}}}",
    ])


def cores(text: Column, limit: int = LIMIT, overlap: int = OVERLAP) -> Column:
    """The cores of ``text`` in order; their concatenation is ``text``. A text within ``limit`` is its own core."""
    whole = F.when(F.length(text) > 0, F.array(text)).otherwise(F.array().cast("array<string>"))
    return F.when(F.length(text) > limit, F.regexp_extract_all(text, F.lit(core_pattern(limit, overlap)), F.lit(0))).otherwise(whole)


def _carried(before: Column, core: Column, limit: int, overlap: int) -> Column:
    tail = F.right(before, F.least(F.lit(overlap), F.lit(limit) - F.length(core)))
    word = F.regexp_extract(tail, r"(?s)^[^ \t\n\r]*[ \t\n\r]+(.+)$", 1)
    return F.when((F.length(tail) == F.length(before)) | (F.length(word) == 0), tail).otherwise(word)


def split_oversized(df: DataFrame, text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Adds ``pieces`` (array of piece_no, overlap, text) and ``cut_kind`` (``whole``, ``natural`` or ``forced``).

    Each piece has at most ``limit`` characters (code points) and starts with up to ``overlap`` characters of the one
    before it, from the start of a word on if one starts there; without its overlap it continues exactly where the one
    before it ended. A text within the limit is one piece; null and empty texts have no pieces and are ``whole``.
    ``forced``: some cut parts two characters neither of which is white space (space, tab, line feed, carriage return).
    Rows stay as they are and repeated rows stay repeated; the plan has neither a shuffle nor Python.
    """
    df = df.withColumn("_cores", cores(F.col(text), limit, overlap))
    c = F.col("_cores")
    made = F.transform(c, lambda x, i: F.struct((i + 1).alias("piece_no"), x.alias("core"), F.when(i == 0, F.lit("")).otherwise(_carried(F.try_element_at(c, F.greatest(i, F.lit(1))), x, limit, overlap)).alias("lead")))
    df = df.withColumn("_made", made)
    pieces = F.transform("_made", lambda p: F.struct(p.piece_no.alias("piece_no"), F.length(p.lead).alias("overlap"), F.concat(p.lead, p.core).alias("text")))
    white = F.array(*map(F.lit, " \t\n\r"))
    inside = lambda x, i: (i > 0) & ~F.array_contains(white, F.substring(x, 1, 1)) & ~F.array_contains(white, F.right(F.try_element_at(c, F.greatest(i, F.lit(1))), F.lit(1)))
    forced = F.exists(F.transform(c, inside), lambda x: x)
    kind = F.when(F.size(c) < 2, "whole").when(forced, "forced").otherwise("natural")
    return df.withColumns({"pieces": pieces, "cut_kind": kind}).drop("_cores", "_made")


def oversized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts over the limit of both tables, not yet freed of repeated rows."""
    s = load(spark, sf_dir, "segments").select(F.lit("segment").alias("item_kind"), "video_id", F.col("segment_id").cast("string").alias("item_id"), "text")
    u = load(spark, sf_dir, "transcript_units").select(F.lit("unit").alias("item_kind"), "video_id", F.col("unit_id").alias("item_id"), "text")
    return s.unionByName(u).where(F.length("text") > LIMIT)


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = split_oversized(oversized(spark, sf_dir), "text")
    return df.select("item_kind", "video_id", "item_id", "cut_kind").distinct()


def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every oversized text; of the repeated rows of a key, which are equal, one is taken."""
    df = oversized(spark, sf_dir).dropDuplicates(["item_kind", "video_id", "item_id"])
    df = split_oversized(df, "text").select("item_kind", "video_id", "item_id", F.inline_outer("pieces"))  # inline would make the optimizer cut every text twice, to drop those without pieces
    return df.withColumnRenamed("text", "piece")


QUERIES = {"p2_found": found, "p2_pieces": pieces}
SQL = {
    "p2_found": """
SELECT DISTINCT item_kind, video_id, item_id, CASE WHEN regexp_matches(text, '[^ \\t\\n\\r]{901}') THEN 'forced' ELSE 'natural' END AS cut_kind
FROM (SELECT 'segment' AS item_kind, video_id, CAST(segment_id AS VARCHAR) AS item_id, text FROM segments
      UNION ALL SELECT 'unit', video_id, unit_id, text FROM transcript_units) x
WHERE length(text) > 900
""",
    "p2_pieces": f"""
WITH t AS (
  SELECT DISTINCT ON (item_kind, video_id, item_id) item_kind, video_id, item_id, regexp_extract_all(text, '{core_pattern().replace("'", "''")}') AS cores
  FROM (SELECT 'segment' AS item_kind, video_id, CAST(segment_id AS VARCHAR) AS item_id, text FROM segments UNION ALL SELECT 'unit', video_id, unit_id, text FROM transcript_units) x
  WHERE length(text) > {LIMIT}
), p AS (SELECT *, unnest(generate_series(1, len(cores))) AS n FROM t
), c AS (SELECT *, cores[n] AS core, CASE WHEN n > 1 THEN cores[n - 1] ELSE '' END AS prev FROM p
), b AS (SELECT *, CASE WHEN n > 1 THEN right(prev, least({OVERLAP}, {LIMIT} - length(core))) ELSE '' END AS tail FROM c
), w AS (SELECT *, regexp_extract(tail, '(?s)^[^ \\t\\n\\r]*[ \\t\\n\\r]+(.+)$', 1) AS word FROM b
), l AS (SELECT *, CASE WHEN length(tail) = length(prev) OR length(word) = 0 THEN tail ELSE word END AS lead FROM w)
SELECT item_kind, video_id, item_id, CAST(n AS INT) AS piece_no, CAST(length(lead) AS INT) AS overlap, lead || core AS piece FROM l
""",
}
