"""Tokens, BM25, TF-IDF and set similarity over columns and tables of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuelake.storage import materialize

#: The words that searching ignores.
STOP = ["a", "an", "the", "is", "are", "where", "when", "does", "find", "show", "in", "of"]
K1, B = 1.2, 0.75


def folded(text: Column) -> Column:
    """Small letters; letters that become two letters when folded do so in every engine alike."""
    return F.replace(F.lower(F.replace(text, F.lit("İ"), F.lit("i̇"))), F.lit("ß"), F.lit("ss"))


def tokens(text: Column, stop: list[str] = STOP) -> Column:
    """Runs of letters, digits and underscores without the stop words; null for null."""
    found = F.regexp_extract_all(folded(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(stop)) if stop else found


def bm25(docs: DataFrame, queries: DataFrame, corpus: list[str], doc: str, query: str) -> DataFrame:
    """``(*corpus, query, doc, score)`` of every document with a positive score, over columns ``tokens``.

    ``docs`` is ``(*corpus, doc, tokens)``, ``queries`` is ``(*corpus, query, tokens)``; statistics are taken over the
    documents of one corpus. Terms of a query count once. Only tokens that some query of the corpus has are counted, so
    what is shuffled grows with the hits. An empty query or corpus has no hits.
    """
    asked = queries.select(*corpus, query, F.explode(F.array_distinct("tokens")).alias("term"))
    wanted = asked.select(*corpus, "term").distinct()
    sizes = docs.select(*corpus, doc, F.size("tokens").alias("len"))
    stats = sizes.groupBy(*corpus).agg(F.count("*").alias("n"), F.avg("len").alias("avg"))
    stats = stats.withColumn("avg", F.when(F.col("avg") > 0, F.col("avg")).otherwise(1.0))
    tf = docs.select(*corpus, doc, F.size("tokens").alias("len"), F.explode("tokens").alias("term")).join(wanted, [*corpus, "term"], "left_semi")
    tf = tf.groupBy(*corpus, doc, "len", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy(*corpus, "term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = df.join(stats, corpus).select(*corpus, "term", "avg", idf.alias("idf"))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg")))
    scored = tf.join(weights, [*corpus, "term"]).select(*corpus, doc, "term", part.alias("part"))
    return asked.join(scored, [*corpus, "term"]).groupBy(*corpus, query, doc).agg(F.sum("part").alias("score")).where(F.col("score") > 0)


def tf_idf(docs: DataFrame, doc: str, vocabulary: int, least_df: int = 2) -> DataFrame:
    """``(doc, term, value)``: L2-normalised binary TF-IDF over ``terms``, the ``vocabulary`` most frequent of at least ``least_df``.

    A term counts once in a document, so its weight is its inverse document frequency ``ln((1+n)/(1+df))+1`` alone.
    """
    n = docs.agg(F.count("*").alias("n"))
    terms = docs.select(doc, F.explode(F.array_distinct("terms")).alias("term"))
    df = terms.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= least_df)
    top = df.orderBy(F.desc("df"), "term").limit(vocabulary)
    weighted = top.crossJoin(F.broadcast(n)).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    x = terms.join(weighted, "term")
    return x.withColumn("value", F.col("idf") / F.sqrt(F.sum(F.col("idf") * F.col("idf")).over(W.partitionBy(doc)))).select(doc, "term", "value")


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; two empty ones are equal."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / both)


#: The overlap that counts, words that a key of ``overlapping_sets`` has, and words of a set up to which it has keys of so many: they grow as their power.
OVERLAP, KEY_WORDS, SHORT_SET = 0.8, 3, 40


def overlapping_sets(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(left_id, right_id, jaccard)`` of sets ``tokens`` whose overlap is OVERLAP or more; two empty sets are equal.

    Words are ordered by rarity. Two sets of that overlap have the first k of their common words among the first
    n - ceil(OVERLAP * n) + k of the n words of each, so sets are joined by each k of those words. A pair comes out only
    where the key is its first k common words, that is, once: pairs are neither shuffled nor made distinct. Keys have
    KEY_WORDS words, as few sets share that many, or all words of a set that has no more; a set of over SHORT_SET words
    and those that may overlap with it have keys of one word for each other.
    """
    both = left.select(F.lit(True).alias("first"), F.col("left_id").alias("id"), "tokens").unionByName(right.select(F.lit(False).alias("first"), F.col("right_id").alias("id"), "tokens"))
    both = materialize(both.where(F.col("tokens").isNotNull()), "sets")
    each = both.select("first", "id", F.explode("tokens").alias("w"))
    ranked = each.join(each.groupBy("w").count(), "w").groupBy("first", "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("count", "w"))), lambda x: x.w).alias("words"))
    ranked = ranked.unionByName(both.where(F.size("tokens") == 0).select("first", "id", F.col("tokens").alias("words")))

    n = F.size("words")
    head = lambda k: F.slice("words", F.lit(1), n - F.ceil(n * F.lit(OVERLAP)).cast("int") + k)
    after = lambda ws, i: F.slice(ws, i + 2, F.size(ws))

    def runs(ws: Column, k: int) -> Column:
        """All choices of k words in their order."""
        if k == 1:
            return F.transform(ws, lambda w: F.array(w))
        return F.flatten(F.transform(ws, lambda w, i: F.transform(runs(after(ws, i), k - 1), lambda rest: F.concat(F.array(w), rest))))

    key = lambda ws: F.xxhash64(ws)
    keys = lambda k: F.array_distinct(F.transform(runs(head(k), k), key))
    short = F.when(n <= KEY_WORDS, F.array(key(F.col("words")))).when(n <= SHORT_SET, keys(KEY_WORDS))
    long = F.when(n >= F.ceil(F.lit(OVERLAP) * (SHORT_SET + 1)), keys(1))
    made = ranked.select("first", "id", "words", short.alias("short"), long.alias("long"))
    made = made.select("first", "id", "words", F.explode(F.array(F.struct(F.lit(False).alias("long"), F.col("short").alias("keys")), F.struct(F.lit(True).alias("long"), F.col("long").alias("keys")))).alias("x"))
    made = materialize(made.select("first", "id", "words", "x.long", F.explode("x.keys").alias("key")), "keys")
    a = made.where("first").select("long", "key", F.col("id").alias("left_id"), F.col("words").alias("x"))
    b = made.where("NOT first").select("long", "key", F.col("id").alias("right_id"), F.col("words").alias("y"))
    near = F.least(F.size("x"), F.size("y")) >= F.lit(OVERLAP) * F.greatest(F.size("x"), F.size("y"))
    j = a.join(b, ["long", "key"]).where(near).withColumn("both", F.array_intersect("x", "y"))
    size = F.size("x") + F.size("y") - F.size("both")
    longer = F.greatest(F.size("x"), F.size("y")) > SHORT_SET
    common = F.slice("both", F.lit(1), F.when(F.col("long"), 1).otherwise(KEY_WORDS))
    j = j.where((F.size("both") >= F.lit(OVERLAP) * size) & (F.col("long") == longer) & (key(common) == F.col("key")))
    return j.select("left_id", "right_id", F.round(F.when(size == 0, 1.0).otherwise(F.size("both") / size), 6).alias("jaccard"))


#: Words without meaning in an anchor of time.
ANCHOR_STOP = ["a", "an", "and", "are", "does", "explaining", "in", "is", "it", "of", "says", "saying", "speaker", "that", "the", "to", "video"]


def stems(text: Column) -> Column:
    """Distinct ASCII words without ANCHOR_STOP, by light suffix rules: -ies to -y, then -ing, -ed and -s off long words."""
    ws = F.filter(F.regexp_extract_all(folded(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: ~t.isin(ANCHOR_STOP))
    cut = lambda t, k: F.left(t, F.length(t) - k)

    def stem(t: Column) -> Column:
        n = F.length(t)
        out = F.when(t.endswith("ies") & (n > 4), F.concat(cut(t, F.lit(3)), F.lit("y")))
        return out.when(t.endswith("ing") & (n > 5), cut(t, F.lit(3))).when(t.endswith("ed") & (n > 4), cut(t, F.lit(2))).when(t.endswith("s") & (n > 3), cut(t, F.lit(1))).otherwise(t)

    return F.array_distinct(F.transform(ws, stem))


#: Words that name no topic.
TOPIC_STOP = """the and for that with this from have are was were will would could should into about your you they their them but not
what when where which who how why can has had its our there here then than also just some more very does did because been being these those""".split()


def topic_terms(texts: DataFrame, keys: list[str], text: str, limit: int = 8) -> DataFrame:
    """``(*keys, terms)``: the most frequent words of each text; ties by first position, then by the word."""
    found = F.regexp_extract_all(folded(F.col(text)), F.lit("[a-z][a-z0-9'-]{2,}"), F.lit(0))
    words = texts.select(*keys, F.posexplode(found).alias("pos", "w")).where(~F.col("w").isin(TOPIC_STOP))
    counts = words.groupBy(*keys, "w").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    top = counts.withColumn("r", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("n"), "first", "w"))).where(F.col("r") <= limit)
    return top.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "w"))), lambda x: x.w).alias("terms"))


#: SQL for DuckDB: the same tokens.
SQL_FOLD = "replace(lower(replace({0}, 'İ', 'i' || chr(775))), 'ß', 'ss')"
SQL_TOKENS = "list_filter(regexp_extract_all(" + SQL_FOLD + ", '[\\p{{L}}\\p{{N}}_]+'), lambda t: t NOT IN (" + ", ".join(f"'{w}'" for w in STOP) + "))"


def sql_bm25(docs: str, queries: str, corpus: str, doc: str, query: str, name: str = "bm25") -> str:
    """CTEs that end in ``name(corpus, query, doc, score)``; ``docs`` and ``queries`` name CTEs with a list ``tokens``."""
    p = name
    return f"""
{p}_a AS (SELECT {corpus}, {query}, unnest(list_distinct(tokens)) AS term FROM {queries}),
{p}_w AS (SELECT DISTINCT {corpus}, term FROM {p}_a),
{p}_l AS (SELECT {corpus}, {doc}, len(tokens) AS len, tokens FROM {docs}),
{p}_s AS (SELECT {corpus}, count(*) AS n, CASE WHEN avg(len) > 0 THEN avg(len) ELSE 1 END AS avg FROM {p}_l GROUP BY ALL),
{p}_t AS (SELECT {corpus}, {doc}, len, term, count(*) AS tf FROM (SELECT {corpus}, {doc}, len, unnest(tokens) AS term FROM {p}_l) x SEMI JOIN {p}_w USING ({corpus}, term) GROUP BY ALL),
{p}_d AS (SELECT {corpus}, term, count(*) AS df FROM {p}_t GROUP BY ALL),
{p}_i AS (SELECT {corpus}, term, avg, ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) AS idf FROM {p}_d JOIN {p}_s USING ({corpus})),
{p} AS (SELECT {corpus}, {query}, {doc}, sum(idf * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * len / avg))) AS score
  FROM {p}_a JOIN {p}_t USING ({corpus}, term) JOIN {p}_i USING ({corpus}, term) GROUP BY ALL)"""
