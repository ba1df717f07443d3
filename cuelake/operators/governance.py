"""Checks that return their violations as rows, fingerprints, and what may leak from one split into another."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOSTS = ["youtu.be", "youtube.com", "www.youtube.com", "m.youtube.com"]
#: Hosts that no server may be sent to.
BLOCKED = ["localhost", "metadata.google.internal", "169.254.169.254"]
MEDIA = ["mp4", "webm", "mov", "mkv", "avi"]


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """``(key, rule)`` for every rule that a row breaks; a rule that can't be decided counts as broken."""
    each = F.array(*(F.when(F.coalesce(ok, F.lit(False)), None).otherwise(F.lit(name)) for name, ok in rules.items()))
    return df.select(F.col(key), F.explode(F.array_compact(each)).alias("rule"))


def shared(df: DataFrame, split: str, a: str, b: str, columns: list[str]) -> DataFrame:
    """``(what, value)``: values of ``columns`` that occur in both splits; nothing when they are disjoint. Nulls are no value."""
    long = df.where(F.col(split).isin(a, b)).select(split, F.explode(F.create_map(*(x for c in columns for x in (F.lit(c), F.col(c).cast("string"))))).alias("what", "value"))
    sides = long.where(F.col("value").isNotNull()).groupBy("what", "value").agg(F.min(split).alias("lo"), F.max(split).alias("hi"))
    return sides.where("lo <> hi").select("what", "value")


def normalized_url(url: Column) -> tuple[Column, Column]:
    """A URL in its normal form, and why it may not be fetched (null if it may).

    Scheme and host in small letters without a trailing point, path at least ``/``, no fragment. Only http and https,
    no credentials, no local, private or reserved address given as a number. Names aren't looked up.
    """
    u = F.btrim(url)
    at = lambda part: F.try_parse_url(u, F.lit(part))
    scheme, info = F.lower(at("PROTOCOL")), at("USERINFO")
    host = F.regexp_replace(F.lower(at("HOST")), r"\.$", "")
    port = F.regexp_extract(at("AUTHORITY"), r":(\d+)$", 1)
    private = host.rlike(r"^(?:10|127|0)\.\d+\.\d+\.\d+$|^192\.168\.|^169\.254\.|^172\.(?:1[6-9]|2\d|3[01])\.|^100\.(?:6[4-9]|[7-9]\d|1[01]\d|12[0-7])\.|^(?:22[4-9]|2[3-5]\d)\.|^\[(?:::1?|f[cd]|fe[89ab])")
    why = (
        F.when(scheme.isNull() | ~scheme.isin("http", "https"), "scheme").when(info.isNotNull(), "credentials").when(host.isNull() | (host == ""), "host")
        .when(host.isin(BLOCKED) | host.endswith(".localhost"), "local").when(private, "private")
    )
    path, query = F.nullif(at("PATH"), F.lit("")), at("QUERY")
    normal = F.concat(scheme, F.lit("://"), host, F.when(port != "", F.concat(F.lit(":"), port)).otherwise(""), F.coalesce(path, F.lit("/")), F.coalesce(F.concat(F.lit("?"), query), F.lit("")))
    return F.when(why.isNull(), normal), why


def video_id_of(url: Column) -> Column:
    """The video id in a link to the known video hosts; null for others and for malformed ids."""
    host, path = F.lower(F.try_parse_url(url, F.lit("HOST"))), F.try_parse_url(url, F.lit("PATH"))
    got = F.when(host == "youtu.be", F.split_part(F.ltrim(path, F.lit("/")), F.lit("/"), F.lit(1))).when(path.startswith("/shorts/"), F.split_part(path, F.lit("/"), F.lit(3))).otherwise(F.try_parse_url(url, F.lit("QUERY"), F.lit("v")))
    return F.when(host.isin(HOSTS) & got.rlike(r"^[A-Za-z0-9_-]{6,20}$"), got)


def provider(url: Column) -> Column:
    """The first provider that takes a URL: video hosts, then direct media by its ending."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    ending = F.lower(F.regexp_extract(F.try_parse_url(url, F.lit("PATH")), r"\.([A-Za-z0-9]+)$", 1))
    return F.when(host.isin(HOSTS), "youtube").when(ending.isin(MEDIA), "direct")


def external_id(url: Column) -> Column:
    return F.when(provider(url) == "youtube", video_id_of(url)).otherwise(F.sha2(url, 256))


def safe_name(value: Column, fallback: str) -> Column:
    """The last part of a path, decoded, of letters, digits, points, underscores, blanks and hyphens, 160 at most."""
    last = F.regexp_extract(F.try_url_decode(F.replace(value, F.lit("+"), F.lit("%2B"))), r"([^/]*)/*$", 1)
    clean = F.btrim(F.regexp_replace(last, "[^A-Za-z0-9._ -]+", "_"), F.lit(" ._"))
    return F.coalesce(F.nullif(F.left(clean, F.lit(160)), F.lit("")), F.lit(fallback))


def source_key(url: Column) -> Column:
    """Where a medium comes from, whatever way its address is written: one key for mirrors, archives and short links."""
    inner = F.regexp_extract(url, r"^https?://web\.archive\.org/.*?/(https?:.*)$", 1)
    u = F.when(inner != "", inner).otherwise(url)
    host = F.regexp_replace(F.lower(F.try_parse_url(u, F.lit("AUTHORITY"))), r"^www\.", "")
    path, v = F.coalesce(F.try_parse_url(u, F.lit("PATH")), F.lit("")), F.try_parse_url(u, F.lit("QUERY"), F.lit("v"))
    plain = F.concat(host, F.lower(F.replace(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), F.lit("_"), F.lit(" "))))
    return F.when(host == "youtu.be", F.concat(F.lit("youtube:"), F.btrim(path, F.lit("/")))).when(host.isin("youtube.com", "m.youtube.com") & v.isNotNull(), F.concat(F.lit("youtube:"), v)).otherwise(plain)


#: Rows whose hashes are hashed together.
BLOCK = 1 << 16


def fingerprint(df: DataFrame, keys: list[str], order: str, fields: list[Column]) -> DataFrame:
    """``(*keys, rows, fingerprint)``: SHA-256 over a group's rows in the order of the bigint ``order``, ties by content.

    Each row is hashed where it lies. The hashes of a block of BLOCK successive orders are hashed together, then the
    blocks of BLOCK blocks, then these, so that no group, however large, is brought together.
    """
    row = F.sha2(F.concat_ws("\x1f", *(F.coalesce(f.cast("string"), F.lit("\x00")) for f in fields)), 256)
    at = F.col(order).cast("bigint")
    out = df.select(*keys, at.alias("_o"), row.alias("_h"), F.lit(1).cast("bigint").alias("rows"))
    for _ in range(2):
        block = F.floor(F.col("_o") / BLOCK).cast("bigint")
        out = _hashed(out, [*keys, block.alias("_b")]).withColumnRenamed("_b", "_o")
    return _hashed(out, keys).select(*keys, "rows", F.col("_h").alias("fingerprint"))


def _hashed(df: DataFrame, keys: list) -> DataFrame:
    g = df.groupBy(*keys).agg(F.sum("rows").alias("rows"), F.array_sort(F.collect_list(F.struct("_o", "_h"))).alias("l"))
    return g.withColumn("_h", F.sha2(F.array_join(F.transform("l", lambda x: x["_h"]), ""), 256)).drop("l")


def remaining(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows of ``todo`` that aren't done, or whose content changed since: ``(key, state)``."""
    same = [c for c in todo.columns if c != key]
    d = done.select(key, *(F.col(c).alias(f"_d_{c}") for c in same), F.lit(True).alias("_done"))
    j = todo.join(d, key, "left")
    changed = F.lit(False)
    for c in same:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"_d_{c}"))
    return j.select(key, F.when(F.col("_done").isNull(), "new").when(changed, "changed").otherwise("done").alias("state")).where("state <> 'done'")


def incompatible(artifacts: DataFrame, key: str, expected: dict[str, object], threshold: str) -> DataFrame:
    """``(key, rule)``: why a calibration artifact may not be used: ``expected`` fields that differ or are missing, a
    threshold that isn't a finite number, or one that no cosine reaches."""
    t = F.col(threshold)
    rules = {name: F.col(name) == F.lit(value) for name, value in expected.items()}
    return violations(artifacts, key, {**rules, "finite": F.abs(t) < float("inf"), "range": t.between(-1, 1.001)})


def frozen_faults(expected: DataFrame, present: DataFrame, key: str, digest: str) -> DataFrame:
    """``(key, state)``: what a freeze lists that is ``missing`` or ``changed`` now. Keys are unique on both sides."""
    j = expected.join(present.select(key, F.col(digest).alias("_now"), F.lit(True).alias("_there")), key, "left")
    state = F.when(F.col("_there").isNull(), "missing").when(~F.col(digest).eqNullSafe(F.col("_now")), "changed")
    return j.select(key, state.alias("state")).where("state IS NOT NULL")


class ManifestLimits(NamedTuple):
    """What a manifest of sources and queries must have at least."""

    sources: int = 5
    queries: int = 60
    queries_a_source: int = 8
    longest_s: float = 1200.0


def _many(df: DataFrame, keys: list[str], subject: str, rule: str, most: int = 1) -> DataFrame:
    """Values of ``subject`` that more than ``most`` rows of one manifest have."""
    n = df.where(F.col(subject).isNotNull()).groupBy(*keys, subject).count().where(F.col("count") > most)
    return n.select(*keys, F.lit(rule).alias("rule"), F.col(subject).cast("string").alias("subject"))


def manifest_faults(sources: DataFrame, queries: DataFrame, excluded: DataFrame, categories: list[str], groups: dict[str, tuple[list[str], int]], limits: ManifestLimits = ManifestLimits()) -> DataFrame:
    """``(manifest, rule, subject)`` for each rule that a manifest breaks; a manifest without a row is valid.

    ``sources``: manifest, source_id, keys (its addresses in canonical form), sha256, duration_s, license. ``queries``:
    manifest, query_id, source_id, category, text, difficulty, intervals, audited. ``excluded``: keys, sha256 of
    sources that may not occur. ``groups`` name sets of categories that need a number of queries together. Each rule is
    one aggregate or join; subjects are null where a rule concerns the whole manifest. Repeated rows count as repeats.
    """
    m = ["manifest"]
    whole = lambda df, rule, bad: df.where(bad).select("manifest", F.lit(rule).alias("rule"), F.lit(None).cast("string").alias("subject"))
    each = lambda df, key, rules: violations(df.select("manifest", key, *(ok.alias(f"_{name}") for name, ok in rules.items())).withColumn("_k", F.struct("manifest", key)), "_k", {n: F.col(f"_{n}") for n in rules}).select("_k.manifest", "rule", F.col(f"_k.{key}").cast("string").alias("subject"))
    addresses = sources.select("manifest", "source_id", F.explode(F.array_distinct("keys")).alias("key"))
    kinds = [F.count(F.when(F.col("category") == c, 1)).alias(f"_c{i}") for i, c in enumerate(categories)]
    s = sources.groupBy("manifest").agg(F.count("*").alias("_s"), F.max(F.when(F.col("duration_s") < float("inf"), F.col("duration_s"))).alias("_long"))
    q = queries.groupBy("manifest").agg(F.count("*").alias("_q"), *kinds)
    all_ = s.join(q, "manifest", "full").na.fill(0)
    of = lambda names: sum((F.col(f"_c{categories.index(c)}") for c in names), F.lit(0))
    out = [
        whole(all_, "few_sources", F.col("_s") < limits.sources), whole(all_, "few_queries", F.col("_q") < limits.queries), whole(all_, "no_long_source", ~F.coalesce(F.col("_long") >= limits.longest_s, F.lit(False))),
        *(whole(all_, f"few_{name}", of(names) < least) for name, (names, least) in groups.items()),
        *(all_.where(F.col(f"_c{i}") == 0).select("manifest", F.lit("category_missing").alias("rule"), F.lit(c).alias("subject")) for i, c in enumerate(categories)),
        _many(sources, m, "source_id", "duplicate_source"), _many(sources, m, "sha256", "duplicate_media"), _many(queries, m, "query_id", "duplicate_query"),
        _many(addresses.select("manifest", "key", "source_id").distinct(), m, "key", "duplicate_address"),
        addresses.join(excluded.select(F.explode("keys").alias("key")).distinct(), "key", "left_semi").select("manifest", F.lit("leaked_address").alias("rule"), F.col("key").alias("subject")).distinct(),
        sources.join(excluded.select("sha256").distinct(), "sha256", "left_semi").select("manifest", F.lit("leaked_media").alias("rule"), F.col("sha256").alias("subject")).distinct(),
        each(sources, "source_id", {"source_incomplete": (F.length(F.trim("license")) > 0) & (F.col("duration_s") > 0) & (F.col("duration_s") < float("inf"))}),
    ]
    known = sources.select("manifest", "source_id", "duration_s").groupBy("manifest", "source_id").agg(F.max("duration_s").alias("_d"))
    asked = queries.groupBy("manifest", "source_id").agg(F.count("*").alias("_n"))
    out.append(known.join(asked, ["manifest", "source_id"], "left").where(F.coalesce("_n", F.lit(0)) < limits.queries_a_source).select("manifest", F.lit("few_queries_of_source").alias("rule"), F.col("source_id").alias("subject")))
    out.append(asked.join(known, ["manifest", "source_id"], "left_anti").select("manifest", F.lit("unknown_source").alias("rule"), F.col("source_id").alias("subject")))
    sound = lambda i: (F.size(i) == 2) & (F.abs(F.get(i, F.lit(0))) < float("inf")) & (F.get(i, F.lit(0)) >= 0) & (F.get(i, F.lit(0)) <= F.get(i, F.lit(1))) & (F.get(i, F.lit(1)) <= F.col("_d"))
    rules = {
        "category": F.col("category").isin(categories), "query": (F.length(F.trim("text")) > 0) & F.col("difficulty").isin("easy", "medium", "hard"),
        "intervals": (F.size("intervals") > 0) & F.forall("intervals", lambda i: F.coalesce(sound(i), F.lit(False))), "audit": F.col("audited"),
    }
    out.append(each(queries.join(known, ["manifest", "source_id"], "left"), "query_id", rules))
    return reduce(DataFrame.unionByName, out)


def dataset_faults(sources: DataFrame, queries: DataFrame, protected: DataFrame, splits: list[str], routes: list[str], least_sources: int = 9, least_queries: int = 300) -> DataFrame:
    """``(rule, subject)`` for each rule that a dataset for routing breaks.

    ``sources``: source_id, split. ``queries``: query_id, source_id, split, text, route. ``protected``: text of
    requests that may not occur, compared without case and outer white space. Each split needs sources and queries of
    every route, in numbers that differ by one at most; texts and ids are unique, a source lies in one split, and its
    queries lie there too.
    """
    note = lambda df, rule, subject: df.select(F.lit(rule).alias("rule"), subject.cast("string").alias("subject"))
    fold = lambda c: F.lower(F.btrim(F.regexp_replace(c, r"\s+", " ")))
    nil = F.lit(None)
    counts = queries.groupBy("split").agg(*(F.count(F.when(F.col("route") == r, 1)).alias(r) for r in routes))
    each = F.array(*map(F.col, routes))
    has = sources.agg(*(F.count(F.when(F.col("split") == x, 1)).alias(f"_{i}") for i, x in enumerate(splits)), F.countDistinct("source_id").alias("n"))
    home = sources.groupBy("source_id").agg(F.min("split").alias("_lo"), F.max("split").alias("_hi"))
    out = [
        note(has.where(F.col("n") < least_sources), "few_sources", nil), note(queries.agg(F.count("*").alias("n")).where(F.col("n") < least_queries), "few_queries", nil),
        *(note(has.where(F.col(f"_{i}") == 0), "split_without_sources", F.lit(x)) for i, x in enumerate(splits)),
        note(home.where("_lo != _hi"), "source_in_two_splits", F.col("source_id")),
        note(queries.join(home, "source_id", "left").where(~F.coalesce((F.col("split") == F.col("_lo")) & (F.col("_lo") == F.col("_hi")), F.lit(False))), "split_of_source", F.col("query_id")),
        note(counts.where((F.array_max(each) - F.array_min(each) > 1) | (F.array_min(each) == 0)), "unbalanced", F.col("split")),
        note(queries.groupBy("query_id").count().where("count > 1"), "duplicate_id", F.col("query_id")), note(queries.groupBy("text").count().where("count > 1"), "duplicate_text", F.col("text")),
        note(queries.where(~F.coalesce(F.col("route").isin(routes) & F.col("split").isin(splits), F.lit(False))), "schema", F.col("query_id")),
        note(queries.withColumn("_f", fold(F.col("text"))).join(protected.select(fold(F.col("text")).alias("_f")).distinct(), "_f", "left_semi"), "protected", F.col("query_id")),
    ]
    return reduce(DataFrame.unionByName, out)
