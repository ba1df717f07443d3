"""Problem 3: the same request in an evaluation split and in the training split."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuelake.llm.components import group_name, split_name
from cuelake.llm.requests import Speller, gram_hash, ngrams, rarest, readings, slips_only, variants, words
from cuelake.sources.tables import load
from cuelake.storage import materialize

#: A word is established if at least ESTABLISHED_LEAST texts and this share of all texts have it. Texts are short, so
#: these are few; of longer texts' words, the ESTABLISHED_MOST most frequent. The only words broadcast.
ESTABLISHED_LEAST, ESTABLISHED_SHARE, ESTABLISHED_MOST = 3, 0.001, 100_000
#: Members of one class of equal texts that one task expands into pairs.
MEMBERS_A_TASK = 5_000
#: Pairs that one word n-gram may bring together before doubtful words join the key, and pairs that one task then compares.
PAIRS_A_GRAM, PAIRS_A_TASK = 10_000, 1_000_000
EVALUATION = ["calibration", "heldout"]
_READING = pa.list_(pa.struct([("key", pa.int64()), ("grams", pa.list_(pa.int64())), ("whole", pa.int64()), ("doubtful", pa.list_(pa.string()))]))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _words(texts: pd.Series) -> pd.Series:
    return texts.map(words)


def established_words(texts: DataFrame, ws: str) -> dict[str, int]:
    """How many texts have each established word, counted over all texts; a word counts once in a text."""
    least = max(ESTABLISHED_LEAST, ESTABLISHED_SHARE * texts.count())
    counts = texts.select(F.explode(F.array_distinct(ws)).alias("w")).groupBy("w").count().where(F.col("count") >= least)
    return {r["w"]: r["count"] for r in counts.orderBy(F.desc("count"), "w").limit(ESTABLISHED_MOST).collect()}


_speller: dict[str, Speller] = {}


def _spell(name: str, established: Broadcast) -> Speller:
    """The worker's speller: built once for all batches and tasks of a query."""
    if name not in _speller:
        _speller.clear()
        _speller[name] = Speller(established.value)
    return _speller[name]


def readings_of(df: DataFrame, ws: str, established: dict[str, int]) -> DataFrame:
    """One row for each reading of the words ``ws``, which it replaces.

    ``grams`` are the hashes of the word n-grams of the reading's sure words (five words), ``key`` is that of the rarest,
    ``whole`` that of all of them, and ``doubtful`` the words that may hide a slip.
    """
    rest = [c for c in df.columns if c != ws]
    name, known = uuid.uuid4().hex, df.sparkSession.sparkContext.broadcast(established)
    kind = "array<struct<key: bigint, grams: array<bigint>, whole: bigint, doubtful: array<string>>>"

    def made(w: list[str], speller: Speller) -> list[dict]:
        out = []
        for r in readings(w, speller):
            grams = ngrams(r.sure)
            out.append({"key": gram_hash(rarest(grams, speller.logs)), "grams": sorted(set(map(gram_hash, grams))), "whole": gram_hash(r.sure), "doubtful": r.doubtful})
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speller = _spell(name, known)
        for b in batches:
            out = pa.array([made(w, speller) for w in b.column(len(rest)).to_pylist()], _READING)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], out], [*rest, "r"])

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in rest)
    return df.select(*rest, ws).mapInArrow(run, f"{schema}, r {kind}").select(*rest, F.inline("r"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _variants(doubtful: pd.Series) -> pd.Series:
    return doubtful.map(lambda ws: sorted({v for w in ws for v in variants(w)}) or [""])


@F.pandas_udf(T.BooleanType())
def _slips(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([x is None or slips_only(list(x), list(y)) for x, y in zip(a, b)], dtype=bool)


def _sided(side: str) -> Column:
    return F.count(F.when(F.col("side") == side, 1))


def brought_together(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose ``keys`` both sides have, with ``pairs``, the number of pairs these bring together."""
    both = rows.groupBy(*keys).agg(_sided("e").alias("_e"), _sided("t").alias("_t")).where("_e > 0 AND _t > 0")
    return rows.join(both.select(*keys, (F.col("_e") * F.col("_t")).alias("pairs")), keys)


def same_requests(evaluation: DataFrame, training: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Classes of texts of the same words on both sides that make the same request, and the members of all classes.

    First table: ``(eval_class, train_class, eval_n, train_n, containment)``; second: ``(side, key, class)``. Copies of
    a text are one class however many there are. Word n-gram hashes of evaluation and training requests are partitioned
    by hash: a request is sought by the rarest n-gram of its sure words. Of each hit, containment is the share of the
    evaluation request's n-grams and doubtful words that the training request has; only doubtful words may be missing,
    and each must then be a slip of its counterpart: another word, number, name or negation makes another request.
    An n-gram that brings more than PAIRS_A_GRAM pairs together is joined by all sure words and by what is left of a
    doubtful word when letters are dropped, which words within the allowed edits share; what is still hot is salted.
    Rows with a null key or without a word (null, empty, blank) have no class.
    """
    both = evaluation.select(F.lit("e").alias("side"), key, text).unionByName(training.select(F.lit("t").alias("side"), key, text))
    both = both.where(F.col(key).isNotNull() & F.col(text).isNotNull()).distinct().select("side", key, _words(text).alias("words"))
    both = materialize(both.where(F.size("words") > 0).withColumn("class", F.array_join("words", " ")), "records")
    established = established_words(both, "words")
    classes = both.groupBy("side", "class").agg(F.first("words").alias("words"), F.count("*").alias("n"))
    rows = materialize(readings_of(classes, "words", established), "readings")

    hits = materialize(brought_together(rows, ["key"]), "grams")
    light = hits.where(F.col("pairs") <= PAIRS_A_GRAM).withColumn("salt", F.lit(0))
    hot = hits.where(F.col("pairs") > PAIRS_A_GRAM).drop("pairs").withColumn("variant", F.explode(_variants("doubtful")))
    hot = brought_together(hot.withColumn("key", F.xxhash64("whole", "variant")), ["key"])
    salts = F.ceil(F.col("pairs") / PAIRS_A_TASK).cast("int")
    mine = F.when(F.col("side") == "e", F.array(F.pmod(F.xxhash64("class"), salts).cast("int"))).otherwise(F.sequence(F.lit(0), salts - 1))
    keyed = light.select(*rows.columns, "salt").unionByName(hot.withColumn("salt", F.explode(mine)).select(*rows.columns, "salt"))

    def side(s: str, name: str) -> DataFrame:
        return keyed.where(F.col("side") == s).select("key", "salt", *(F.col(c).alias(f"{name}_{c}") for c in ("class", "n", "grams", "whole", "doubtful")))

    d, o = F.col("eval_doubtful"), F.col("train_doubtful")
    hit = F.size(F.array_intersect("eval_grams", "train_grams"))
    met = side("e", "eval").join(side("t", "train"), ["key", "salt"]).where((hit == F.size("eval_grams")) & (F.col("eval_whole") == F.col("train_whole")) & (F.size(d) == F.size(o)))
    met = met.where((F.size(d) != 1) | (F.levenshtein(F.get(d, F.lit(0)), F.get(o, F.lit(0)), 4) >= 0))
    met = met.where(_slips(F.when(d != o, d), o)).withColumn("containment", (hit + F.size(F.array_intersect(d, o))) / (F.size("eval_grams") + F.size(F.array_distinct(d))))
    out = met.groupBy("eval_class", "train_class").agg(F.first("eval_n").alias("eval_n"), F.first("train_n").alias("train_n"), F.max("containment").alias("containment"))
    return materialize(out, "hits"), both.select("side", key, "class")


def pairs(hits: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """``(eval_key, train_key, containment)`` for all members of overlapping classes.

    Large classes are dealt out to as many tasks as they need: their members carry a salt, and the other side is
    repeated for each salt.
    """
    salts = lambda n: F.ceil(F.col(n) / MEMBERS_A_TASK).cast("int")
    mine = lambda s, name, n: members.where(F.col("side") == s).select(F.col(key).alias(f"{name}_key"), F.col("class").alias(f"{name}_class")).join(hits.select(f"{name}_class", salts(n).alias("k")).distinct(), f"{name}_class").withColumn(f"{name}_salt", F.pmod(F.xxhash64(f"{name}_key"), F.col("k")).cast("int")).drop("k")
    out = hits.withColumn("eval_salt", F.explode(F.sequence(F.lit(0), salts("eval_n") - 1))).withColumn("train_salt", F.explode(F.sequence(F.lit(0), salts("train_n") - 1)))
    out = out.join(mine("e", "eval", "eval_n"), ["eval_class", "eval_salt"]).join(mine("t", "train", "train_n"), ["train_class", "train_salt"])
    return out.select("eval_key", "train_key", "containment")


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = load(spark, sf_dir, "videos").select("video_id", split_name(F.col("split")).alias("split"), group_name(F.col("source_group")).alias("source_group")).distinct()
    q = load(spark, sf_dir, "queries").select("query_id", "video_id", "query_text").distinct().join(v, "video_id")
    return q.where(F.col("split").isin(EVALUATION)), q.where(F.col("split") == "train")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits, members = same_requests(*_sides(spark, sf_dir), "query_id", "query_text")
    p = pairs(hits, members, "query_id")
    return p.select(F.least("eval_key", "train_key").alias("query_a"), F.greatest("eval_key", "train_key").alias("query_b"))


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps of each evaluation split and source_group (its compared form): pairs, and queries that have any."""
    evaluation, training = _sides(spark, sf_dir)
    hits, members = same_requests(evaluation, training, "query_id", "query_text")
    per = members.where("side = 'e'").join(hits.groupBy(F.col("eval_class").alias("class")).agg(F.sum("train_n").alias("n")), "class")
    per = per.join(evaluation.select("query_id", "split", "source_group"), "query_id")
    return per.groupBy("split", "source_group").agg(F.sum("n").alias("pairs"), F.count("*").alias("queries"))


def faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must not be, ``(fault, id)``: texts of the same words on both sides whose queries don't come out, pairs within one side or twice."""
    evaluation, training = _sides(spark, sf_dir)
    hits, members = same_requests(evaluation, training, "query_id", "query_text")
    own = members.groupBy("class").agg(_sided("e").alias("e"), _sided("t").alias("t")).where("e > 0 AND t > 0")
    lost = own.join(hits.where("eval_class = train_class"), own["class"] == hits["eval_class"], "left_anti").select(F.lit("lost").alias("fault"), F.col("class").alias("id"))
    p = pairs(hits, members, "query_id")
    twice = p.groupBy("eval_key", "train_key").count().where("count > 1").select(F.lit("twice").alias("fault"), F.col("eval_key").alias("id"))
    side = p.join(evaluation.select(F.col("query_id").alias("eval_key")), "eval_key", "left_anti").select(F.lit("side").alias("fault"), F.col("eval_key").alias("id"))
    return lost.unionByName(twice).unionByName(side)


QUERIES = {"p3_found": found, "p3_counts": counts, "p3_faults": faults}
SQL = {"p3_faults": "SELECT '' AS fault, '' AS id WHERE false"}
