"""Problem 4: splits that keep tied records together."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuelake.operators.blocks import hot_keys, skew_join
from cuelake.sources.tables import load
from cuelake.storage import materialize

#: What stands in source_group for "none".
NO_GROUP = ["", "unspecified", "unknown", "n/a"]
#: Splits that a table of targets may name.
SPLITS_MOST = 1000


@F.pandas_udf(T.StringType())
def _folded(s: pd.Series) -> pd.Series:
    nfc = lambda x: unicodedata.normalize("NFC", x)
    return s.map(lambda x: None if x is None else nfc(nfc(x).casefold()))


def group_name(c: Column) -> Column:
    """A name as it is compared: letter case, Unicode form, outer white space and the marks between words don't matter.

    Null for null, blank and the values of NO_GROUP.
    """
    name = F.trim(F.regexp_replace(_folded(c), r"[\s _-]+", " "))
    return F.when(~name.isin(NO_GROUP), name)


def file_hash(c: Column) -> Column:
    """A checksum in small letters; null for null, blank and all zeros."""
    h = F.lower(F.trim(c))
    return F.when(~h.rlike("^0*$"), h)


def split_name(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"[\s_-]", ""))


def neighbours(edges: DataFrame) -> DataFrame:
    """Adjacency ``(n, m)`` in both directions, without loops and repeats, from edges ``(a, b)``."""
    both = edges.select(F.col("a").alias("n"), F.col("b").alias("m")).unionByName(edges.select(F.col("b").alias("n"), F.col("a").alias("m")))
    return both.where("n != m").distinct()


def _priority(c: str) -> Column:
    return F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("n"))


def components(edges: DataFrame) -> DataFrame:
    """``(n, component)`` for every node of the edges ``(a, b)``: the smallest node of its component.

    Frontier breadth-first search: adjacency is hash-partitioned by node; every node whose hash is the least among its
    neighbours is a seed, and all seeds expand at once, hop by hop. A node that several seeds reach in one hop takes the
    least. Where regions touch, their seeds collide; the pairs of colliding seeds make a smaller graph, which is solved
    in the same way until no seeds collide, and its answer renames the seeds. Nothing but the counts of rows that decide
    whether to go on reaches the driver. Nodes are never null: rows with a null end are dropped; loops make their node a
    component of its own; an empty table gives none.
    """
    edges = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull()).select("a", "b")
    nodes = materialize(edges.select(F.col("a").alias("n")).unionByName(edges.select(F.col("b").alias("n"))).distinct(), "nodes")
    seeds = _seed_of(materialize(neighbours(edges), "adjacency"))
    named = nodes.join(seeds, "n", "left").withColumn("seed", F.coalesce("seed", "n"))
    least = named.groupBy("seed").agg(F.min("n").alias("component"))
    return named.join(least, "seed").select("n", "component")


def _seed_of(near: DataFrame) -> DataFrame:
    """``(n, seed)``: one seed for each component of the adjacency ``near``."""
    if near.isEmpty():
        return near.select("n", F.col("m").alias("seed"))
    least = near.groupBy("n").agg(F.min(_priority("m")).alias("best"))
    seen = materialize(least.where(_priority("n") < F.col("best")).select("n", F.col("n").alias("seed")), "seen")
    frontier, hot = seen, hot_keys(near, ["n"])
    while True:
        reached = skew_join(near, frontier, ["n"], hot).select(F.col("m").alias("n"), "seed").groupBy("n").agg(F.min_by("seed", F.xxhash64("seed")).alias("seed"))
        frontier = materialize(reached.join(seen, "n", "left_anti"), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    to = seen.select(F.col("n").alias("m"), F.col("seed").alias("b"))
    touching = skew_join(near.where("n < m"), seen.withColumnRenamed("seed", "a"), ["n"], hot)
    touching = skew_join(touching, to, ["m"], None if hot is None else hot.withColumnRenamed("n", "m")).where("a != b").select("a", "b").distinct()
    above = _seed_of(materialize(neighbours(touching), "collisions")).select(F.col("n").alias("seed"), F.col("seed").alias("top"))
    return materialize(seen.join(above, "seed", "left").select("n", F.coalesce("top", "seed").alias("seed")), "seeds")


def tied(df: DataFrame, key: str, ties: list[str]) -> DataFrame:
    """``(key, set_id)`` for every key of ``df``: keys are tied if some tie column has the same value; ties chain.

    ``set_id`` is the smallest key of the set. A null tie ties nothing, a null key is dropped, repeated keys count once
    with the ties of all their rows. Each value of a tie is a node of its own beside the keys, so a value that a third
    of all keys share costs one edge a key and no pair; values of a single key are left out of the graph. Values, nodes
    and sets that many rows share are joined where these rows lie (``skew_join``).
    """
    df = df.where(F.col(key).isNotNull())
    links = df.select(F.concat(F.lit("k"), F.col(key).cast("string")).alias("a"), F.explode(F.array(*(F.concat(F.lit(f"{i}:"), F.col(t)) for i, t in enumerate(ties)))).alias("b")).where(F.col("b").isNotNull()).distinct()
    links = materialize(links, "links")
    alone = links.groupBy("b").agg(F.count("*").alias("c"), F.min("a").alias("a")).where("c = 1").select("a", "b")
    links = links.join(alone, ["a", "b"], "left_anti")
    # keys with one shared value hang on it; only those with several tie values together
    of = materialize(links.groupBy("a").agg(F.min("b").alias("hub"), F.max("b").alias("last")), "hubs")
    hubs = links.join(of.where("hub != last"), "a").select(F.col("hub").alias("a"), "b")
    hub = components(hubs).select(F.col("n").alias("hub"), F.col("component").alias("top"))
    sets = skew_join(of, hub, ["hub"], hot_keys(of, ["hub"]), "left").select(F.substr("a", F.lit(2)).alias("_k"), F.coalesce("top", "hub").alias("_set"))
    keys = df.select(F.col(key), F.col(key).cast("string").alias("_k")).distinct().join(sets, "_k", "left")
    keys = keys.withColumn("_set", F.coalesce("_set", F.concat(F.lit("k"), "_k")))
    keys = materialize(keys, "keys")
    first = keys.groupBy("_set").agg(F.min(key).alias("set_id"))
    return skew_join(keys, first, ["_set"], hot_keys(keys, ["_set"])).select(key, "set_id")


def assign(sets: DataFrame, key: str, targets: DataFrame) -> DataFrame:
    """Adds ``assigned`` to ``(key, set_id)``: all keys of a set in one split, in the proportions of ``targets``.

    Sets follow each other in the order of their hash. The split whose share of the keys the middle of a set falls into
    takes it, so a share is missed by half a set at most. More than SPLITS_MOST splits are refused. Running counts go over blocks of the hash, two levels of 4,096
    each, so no task orders all sets. ``targets`` (split_name, proportion) has a few rows; proportions need not sum to 1.
    """
    share = targets.where(F.col("proportion") > 0).orderBy("split_name").limit(SPLITS_MOST + 1).collect()
    if len(share) > SPLITS_MOST:
        raise ValueError(f"more than {SPLITS_MOST} splits")
    h = F.xxhash64("set_id")
    sizes = sets.groupBy("set_id").agg(F.count("*").alias("size")).withColumns({"h": h, "x": F.shiftrightunsigned(h, 52), "y": F.shiftrightunsigned(h, 40).bitwiseAND(4095)})
    before = lambda part, order: F.coalesce(F.sum("s").over(W.partitionBy(*part).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ys = sizes.groupBy("x", "y").agg(F.sum("size").alias("s"))
    xs = ys.groupBy("x").agg(F.sum("s").alias("s"))
    xs = xs.select("x", before([], "x").alias("ox"), F.sum("s").over(W.partitionBy()).alias("all"))
    ys = ys.select("x", "y", before(["x"], "y").alias("oy")).join(F.broadcast(xs), "x")
    inside = F.coalesce(F.sum("size").over(W.partitionBy("x", "y").orderBy("h", "set_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    at = (F.col("ox") + F.col("oy") + F.col("before") + F.col("size") / 2) / F.col("all")
    total, upto, pick = sum(r.proportion for r in share), 0.0, None
    for r in share[:-1]:
        upto += r.proportion / total
        pick = F.when(F.col("at") < upto, r.split_name) if pick is None else pick.when(F.col("at") < upto, r.split_name)
    last = F.lit(share[-1].split_name) if share else F.lit(None).cast("string")
    placed = sizes.withColumn("before", inside).join(ys, ["x", "y"]).withColumn("at", at)
    placed = placed.select("set_id", (pick.otherwise(last) if pick is not None else last).alias("assigned"))
    return skew_join(sets, placed, ["set_id"], hot_keys(sets, ["set_id"])).select(key, "set_id", "assigned")


def _ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = load(spark, sf_dir, "videos")
    v = v.select("video_id", group_name(F.col("source_group")).alias("g"), file_hash(F.col("source_sha256")).alias("f"), split_name(F.col("split")).alias("split"))
    return materialize(v.where(F.col("video_id").isNotNull()).distinct(), "videos")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Videos of sets whose splits today differ."""
    v = _ties(spark, sf_dir)
    sets = materialize(tied(v, "video_id", ["g", "f"]), "sets")
    splits = v.join(sets, "video_id").groupBy("set_id").agg(F.min("split").alias("lo"), F.max("split").alias("hi"))
    return sets.join(splits.where("lo != hi"), "set_id").select("video_id", "set_id")


def assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = materialize(tied(_ties(spark, sf_dir), "video_id", ["g", "f"]), "sets")
    return assign(sets, "video_id", load(spark, sf_dir, "split_targets"))


def faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must not be, ``(fault, id)``: a tie value or set in two splits, a video without a split or with two."""
    v = _ties(spark, sf_dir)
    a = materialize(assign(materialize(tied(v, "video_id", ["g", "f"]), "sets"), "video_id", load(spark, sf_dir, "split_targets")), "assigned")
    out = v.select("video_id").distinct().join(a.groupBy("video_id").count().where("count = 1"), "video_id", "left_anti").select(F.lit("not one split").alias("fault"), F.col("video_id").alias("id"))
    for name, x in (("set", a.select(F.col("set_id").alias("id"), "assigned")), *((t, v.join(a, "video_id").where(F.col(t).isNotNull()).select(F.col(t).alias("id"), "assigned")) for t in ("g", "f"))):
        two = x.groupBy("id").agg(F.min("assigned").alias("lo"), F.max("assigned").alias("hi")).where("lo != hi")
        out = out.unionByName(two.select(F.lit(f"{name} in two splits").alias("fault"), "id"))
    return out


QUERIES = {"p4_found": found, "p4_assigned": assigned, "p4_faults": faults}
SQL = {
    "p4_faults": "SELECT '' AS fault, '' AS id WHERE false",
    "p4_found": """
WITH RECURSIVE v AS (
  SELECT DISTINCT video_id, lower(regexp_replace(split, '[\\s_-]', '', 'g')) AS split, lower(trim(source_sha256)) AS f,
         trim(regexp_replace(nfc_normalize(lower(nfc_normalize(source_group))), '[\\s\u00a0_-]+', ' ', 'g')) AS g
  FROM videos WHERE video_id IS NOT NULL
), link AS (
  SELECT DISTINCT video_id, 'g' || g AS k FROM v WHERE g NOT IN ('', 'unspecified', 'unknown', 'n/a')
  UNION SELECT DISTINCT video_id, 'f' || f FROM v WHERE NOT regexp_full_match(f, '0*')
), reach AS (
  SELECT a.video_id AS a, b.video_id AS b FROM link a JOIN link b USING (k)
  UNION
  SELECT r.a, y.video_id FROM reach r JOIN link x ON r.b = x.video_id JOIN link y ON x.k = y.k
), sets AS (SELECT a AS video_id, min(b) AS set_id FROM reach GROUP BY a),
mixed AS (SELECT set_id FROM sets JOIN v USING (video_id) GROUP BY set_id HAVING count(DISTINCT split) > 1)
SELECT video_id, set_id FROM sets JOIN mixed USING (set_id)
""",
}
