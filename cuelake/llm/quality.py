"""Problem 8: statistics of every text, how far out they lie in its language, and what kind of text it is."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuelake.llm.bpe import spread
from cuelake.llm.shape import ended, lean, shape, solid, words_of
from cuelake.sources.tables import load
from cuelake.storage import materialize

#: How many words of a language count as common, at most, and in what share of its texts each of them must stand.
COMMON, COMMON_SHARE = 40, 0.1
#: How many languages have such a list, at most: those of most texts.
LANGUAGES = 1000
#: A language of fewer texts has no list of common words.
LIST_TEXTS = 20
#: A language of fewer texts is ranked among the texts of no known language; if those are fewer, each counts as an outlier.
RANKED_TEXTS = 100
#: Ranked tables of up to so many rows are broadcast, larger ones joined by shuffle with salted keys.
BROADCAST_ROWS, SALTS = 300_000, 16
STATS = ["word_count", "mean_word_length", "symbol_share", "end_share", "common_share"]
#: Shares of a text's characters on lines that are items, rows, or neither these nor sentences.
SHAPES = ["list_share", "table_share", "junk_share"]
#: All that is ranked.
RANKED = [*STATS, *SHAPES]
#: Statistics are whole numbers of these units: texts that differ by less rank alike.
UNITS = {"word_count": 1, "mean_word_length": 100, **dict.fromkeys(("symbol_share", "end_share", "common_share", *SHAPES, "lean"), 1000)}
#: Labelled texts that the weights of a kind's evidence are fitted to, at most, and the ridge of the fit.
EXAMPLES_MOST, RIDGE = 1000, 1.0
#: Shares of a text that isn't prose by its lines, in units of lean, between which its score weighs in.
DOUBT = (200, 800)
_NAMES = ["lang", *RANKED, "lean", "other_kind"]
_SCHEMA = "lang string, " + ", ".join(f"{s} bigint" for s in (*RANKED, "lean")) + ", other_kind string"


def language(lang: Column) -> Column:
    """The main language of a tag such as ``en-US``, in small letters; ``und`` for null, blank and ``und``."""
    main = F.lower(F.trim(F.split(lang, "[-_]")[0]))
    return F.when(F.length(main) > 0, main).otherwise("und")


def common_words(df: DataFrame, text: str, lang: str) -> dict[str, list[str]]:
    """The words that stand in most texts of each language: at most COMMON for a language, so a bounded answer.

    Counted over all texts. A word counts once for each text, before any shuffle, so that a text of one word repeated
    carries no weight. Languages of fewer than LIST_TEXTS texts, those beyond LANGUAGES and ``und`` have no list.
    """
    known = df.where((F.col(lang) != "und") & F.col(text).isNotNull())
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{M}\p{N}]+(?:['’][\p{L}\p{M}]+)*"), F.lit(0)))
    counts = known.select(lang, F.explode(words).alias("w")).groupBy(lang, "w").count()
    top = counts.withColumn("r", F.row_number().over(W.partitionBy(lang).orderBy(F.desc("count"), "w"))).where(F.col("r") <= COMMON)
    sizes = known.groupBy(lang).agg(F.count("*").alias("n")).where(F.col("n") >= LIST_TEXTS).orderBy(F.desc("n"), lang).limit(LANGUAGES)
    kept = top.join(sizes, lang).where(F.col("count") >= COMMON_SHARE * F.col("n"))
    out: dict[str, list[str]] = {}
    for r in kept.select(lang, "w").collect():
        out.setdefault(r[0], []).append(r[1])
    return out


def sharer(lists: dict[str, list[str]]) -> Callable[[list[str]], float]:
    """The share of common words among some words, in the language whose list knows most of them."""
    knows = _knower(lists)
    return lambda words: max(knows(words), default=0) / len(words) if words else 0.0


def _knower(lists: dict[str, list[str]]) -> Callable[[list[str]], list[int]]:
    """How many of some words each list knows."""
    bits: dict[str, int] = {}
    for k, ws in enumerate(lists.values()):
        for w in ws:
            bits[w] = bits.get(w, 0) | 1 << k

    def knows(words: list[str]) -> list[int]:
        got = Counter(map(bits.get, words))
        del got[None]
        return [sum([n for m, n in got.items() if m >> k & 1]) for k in range(len(lists))]

    return knows


def measure(text: str | None, share: Callable[[list[str]], float]) -> tuple:
    """Statistics of one text in whole UNITS, how far it leans from prose, and to which kind; nulls for a null, empty or blank text."""
    if text is None or not text.strip():
        return (None,) * (len(RANKED) + 2)
    words = words_of(text)
    lines = [x for x in text.splitlines() if x.strip()]
    dense = sum(map(len, text.split()))
    made = shape(text, share, words)
    all_ = sum(made[k] for k in ("prose", "list", "table", "junk"))
    other, away = lean(made)
    values = {
        "word_count": len(words),
        "mean_word_length": sum(map(len, words)) / len(words) if words else 0.0,
        "symbol_share": 1 - solid(text) / dense,
        "end_share": sum(map(ended, lines)) / len(lines),
        "common_share": share(words),
        **{f"{k}_share": made[k] / all_ if all_ else 0.0 for k in ("list", "table", "junk")},
        "lean": away,
    }
    return (*(round(v * UNITS[s]) for s, v in values.items()), other)


def features(df: DataFrame, key: str, text: str, lang: str, lists: dict[str, list[str]], guess: bool = False) -> DataFrame:
    """``(key, lang, *RANKED and lean in units, other_kind)`` of every row of ``df``, in one pass over the texts.

    With ``guess`` the language of a text is that whose list knows most of its words.
    """
    df = df.select(key, text, language(F.col(lang)).alias("lang"))
    names = list(lists)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share, knows = sharer(lists), _knower(lists)
        for b in batches:
            texts = b.column(1).to_pylist()
            made = list(zip(*(measure(t, share) for t in texts))) or [()] * (len(RANKED) + 2)
            langs = b.column(2)
            if guess and names:
                known = [knows(words_of(t or "")) for t in texts]
                langs = pa.array([names[k.index(max(k))] if any(k) else "und" for k in known], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), langs, *(pa.array(m, pa.int64()) for m in made[:-1]), pa.array(made[-1], pa.string())], [key, *_NAMES])

    kind = df.schema[key].dataType.simpleString()
    return spread(df, 3).mapInArrow(run, f"`{key}` {kind}, {_SCHEMA}")


def ranked(long: DataFrame) -> DataFrame:
    """``(group, stat, value, n, upto, all)``: rank of each value among all of its group and statistic.

    Equal values are counted before they move. The distinct ones are sorted by ranges over all partitions; a partition's
    running count goes on from the offset that the partitions before it leave. Ranks are exact, and no task holds more
    than its range.
    """
    counts = long.groupBy("group", "stat", "value").agg(F.count("*").alias("n"))
    parts = materialize(counts.repartitionByRange("group", "stat", "value").withColumn("part", F.spark_partition_id()), "ranges")
    sums = parts.groupBy("group", "stat", "part").agg(F.sum("n").alias("s"))
    g = W.partitionBy("group", "stat")
    before = F.coalesce(F.sum("s").over(g.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select("group", "stat", "part", before.alias("before"), F.sum("s").over(g).alias("all"))
    here = F.sum("n").over(W.partitionBy("group", "stat", "part").orderBy("value").rowsBetween(W.unboundedPreceding, 0))
    out = parts.withColumn("upto", here).join(offsets, ["group", "stat", "part"]).withColumn("upto", F.col("upto") + F.col("before"))
    return out.select("group", "stat", "value", "n", "upto", "all")


def surprise(least: Column, most: Column, all_: Column) -> Column:
    """-ln of the two-sided tail probability of a value that ``least`` of ``all_`` values don't exceed and ``most`` reach."""
    return -F.log(F.least(F.lit(1.0), 2 * F.least(least, most) / all_))


def _long(feats: DataFrame, stats: list[str], *keep: str) -> DataFrame:
    some = feats.where(F.col(stats[0]).isNotNull())
    return some.select(*keep, F.inline(F.array(*(F.struct(F.lit(s).alias("stat"), F.col(s).alias("value")) for s in stats))))


def outlier_scores(feats: DataFrame, key: str, stats: list[str] = RANKED, examples: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Adds ``outlier_score``: the sum over the statistics of -ln of their tail probability in the row's language.

    0 means ordinary in all. Rows without statistics (null, empty and blank texts) have a null score and take no part
    in the ranks. Languages of fewer than RANKED_TEXTS texts are ranked together with ``und``; if all those are still
    fewer, their ranks say nothing and their score is infinite. ``examples``, at most EXAMPLES_MOST rows, are scored
    among the rows of ``feats`` without being counted; those of an unranked language get no row.
    """
    some = feats.where(F.col(stats[0]).isNotNull())
    sizes = some.groupBy("lang").agg(F.count("*").alias("size"))
    group = F.when((F.col("size") >= RANKED_TEXTS) & (F.col("lang") != "und"), F.col("lang")).otherwise("und")
    sizes = materialize(sizes.withColumn("group", group).select("lang", "group", F.sum("size").over(W.partitionBy("group")).alias("size")), "languages")
    feats = feats.join(sizes, "lang", "left")
    ranks = materialize(ranked(_long(feats, stats, key, "group")), "ranks")
    mine = ranks.select("group", "stat", "value", surprise(F.col("upto"), F.col("all") - F.col("upto") + F.col("n"), F.col("all")).alias("s"))
    if ranks.count() <= BROADCAST_ROWS:
        for s in stats:
            feats = feats.join(F.broadcast(mine.where(F.col("stat") == s).select("group", F.col("value").alias(s), F.col("s").alias(f"_{s}"))), ["group", s], "left")
        scored = feats
    else:
        salted = mine.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = _long(feats, stats, key, "group").withColumn("salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int")).join(salted, ["group", "stat", "value", "salt"])
        scored = feats.join(found.groupBy(key).agg(*(F.max(F.when(F.col("stat") == s, F.col("s"))).alias(f"_{s}") for s in stats)), key, "left")
    total = reduce(lambda a, b: a + b, (F.col(f"_{s}") for s in stats))
    small = (F.col("size") < RANKED_TEXTS) & F.col(stats[0]).isNotNull()
    scored = scored.withColumn("outlier_score", F.when(small, float("inf")).otherwise(total)).drop("group", "size", *(f"_{s}" for s in stats))
    if examples is None:
        return scored, None
    asked = _long(examples.join(sizes.where(F.col("size") >= RANKED_TEXTS), "lang"), stats, "example_id", "group")
    asked = F.broadcast(asked.select("example_id", F.col("group").alias("_g"), F.col("stat").alias("_s"), F.col("value").alias("_v")))
    met = ranks.join(asked, (F.col("group") == F.col("_g")) & (F.col("stat") == F.col("_s"))).groupBy("example_id", "stat").agg(
        F.coalesce(F.max(F.when(F.col("value") <= F.col("_v"), F.col("upto"))), F.lit(0)).alias("least"),
        F.max("all").alias("all"), F.coalesce(F.max(F.when(F.col("value") < F.col("_v"), F.col("upto"))), F.lit(0)).alias("below"))
    one = surprise(F.greatest("least", F.lit(1)), F.greatest(F.col("all") - F.col("below"), F.lit(1)), F.col("all"))
    return scored, met.groupBy("example_id").agg(F.sum(one).alias("outlier_score"))


def away(lean: Column) -> Column:
    """How a text's lines speak against prose, as log odds."""
    return F.log((lean + 1) / (UNITS["lean"] + 1 - lean))


def weigh(rows: list[tuple[float, float, bool]]) -> tuple[float, float, float]:
    """Weights of lines and score, and the score midway between labelled texts that are prose and that aren't.

    A ridge logistic model without bias, by Newton steps: a text half of whose lines are prose and whose score lies
    midway is undecided. Without labelled texts of both sides lines alone decide.
    """
    y = np.array([r[2] for r in rows], float)
    if len(rows) == 0 or y.min() == y.max():
        return 1.0, 0.0, 0.0
    x = np.array([r[:2] for r in rows], float)
    midway = (x[y == 1, 1].mean() + x[y == 0, 1].mean()) / 2
    x[:, 1] -= midway
    scale = np.sqrt((x**2).mean(0))
    scale[scale == 0] = 1.0
    z, w = x / scale, np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        w = w + np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + RIDGE * np.eye(2), z.T @ (y - p) - RIDGE * w)
    return float(w[0] / scale[0]), float(w[1] / scale[1]), float(midway)


def text_quality(df: DataFrame, key: str, text: str, lang: str, labelled: DataFrame | None = None) -> DataFrame:
    """One row for each row of ``df``: ``key``, the statistics, ``outlier_score`` and ``text_kind``.

    ``text_kind`` is prose, list, table or junk; null, as all statistics, for null, empty and blank texts. The lines of
    a text (shape.py) say what it is if it isn't prose. Whether it isn't, its lines and, where they leave it in DOUBT, its
    outlier score say together: a logistic model of both, fitted to ``labelled`` texts (text, text_kind; at most
    EXAMPLES_MOST are used). Many copies of a list, which are ordinary in their language, don't pass for prose. In languages of few texts scores say nothing. ``key`` must be unique; repeated texts are ranked as often as
    they occur.
    """
    lists = common_words(df.select(F.col(text), language(F.col(lang)).alias("_l")), text, "_l")
    feats, given = materialize(features(df, key, text, lang, lists), "features"), None
    if labelled is not None:
        some = labelled.where(F.col("text_kind").isNotNull() & F.col("text").isNotNull()).select("text", "text_kind").orderBy(F.xxhash64("text"), "text", "text_kind").limit(EXAMPLES_MOST)
        given = materialize(some.withColumn("example_id", F.monotonically_increasing_id()), "examples")
        known = features(given.withColumn("lang", F.lit(None).cast("string")), "example_id", "text", "lang", lists, guess=True)
        given = materialize(known.join(given.select("example_id", "text_kind"), "example_id").where(F.col("lean").isNotNull()), "measured")
    scored, examples = outlier_scores(feats, key, examples=given)
    rows = [] if examples is None else given.join(examples, "example_id").select(away(F.col("lean")).alias("x"), "outlier_score", (F.col("text_kind") != "prose").alias("y")).collect()
    lines, score, midway = weigh([tuple(r) for r in rows])
    tells = F.when((F.col("outlier_score") < float("inf")) & F.col("lean").between(*DOUBT), F.col("outlier_score") - midway).otherwise(0.0)
    other = F.col("other_kind").isNotNull() & (lines * away(F.col("lean")) + score * tells > 0)
    kind = F.when(F.col("lean").isNull(), None).when(other, F.col("other_kind")).otherwise("prose")
    return scored.select(key, *((F.col(s) / UNITS[s]).alias(s) if UNITS[s] > 1 else s for s in STATS), "outlier_score", kind.alias("text_kind"))


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_quality(load(spark, sf_dir, "documents"), "doc_id", "text", "lang", load(spark, sf_dir, "quality_examples"))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats(spark, sf_dir).where(F.col("text_kind") != "prose").select("doc_id", "text_kind")


QUERIES = {"p8_found": found, "p8_stats": stats}
SQL: dict[str, str] = {}
