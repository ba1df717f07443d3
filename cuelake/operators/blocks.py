"""Running totals over groups of any size.

A window over a whole group sorts that group in one task. Here a group is cut into blocks of its order key: totals run
inside each block, and blocks and blocks of blocks pass on their sums. With BITS = 20 no window sees more than 2**20
distinct keys of a group below 2**40, however hot the group is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuelake.storage import materialize

BITS = 20
#: A key of more rows is hot; of more hot keys than HOT_KEYS the hottest are treated as such, so that they can be broadcast.
HOT_ROWS, HOT_KEYS = 1_000_000, 10_000


def hot_keys(df: DataFrame, on: list[str]) -> DataFrame | None:
    """The values of ``on`` that more than HOT_ROWS rows share, HOT_KEYS at most; None if there are none."""
    counts = df.groupBy(*on).agg(F.count("*").alias("_n")).where(F.col("_n") > HOT_ROWS)
    hot = materialize(counts.orderBy(F.desc("_n")).limit(HOT_KEYS).select(*on), "hot")
    return None if hot.isEmpty() else hot


def skew_join(left: DataFrame, right: DataFrame, on: list[str], hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """``left`` joined (inner or left) with ``right``, which has one row for each value of ``on`` that many rows of ``left`` may share.

    Rows of ``hot`` values stay where they are: their counterparts, at most HOT_KEYS rows, are broadcast.
    """
    if hot is None:
        return left.join(right, on, how)
    few = right.join(F.broadcast(hot), on, "left_semi")
    rest = left.join(F.broadcast(hot), on, "left_anti").join(right, on, how)
    return rest.unionByName(left.join(F.broadcast(hot), on, "left_semi").join(F.broadcast(few), on, how))


def running_total(df: DataFrame, keys: list[str], order: str, weight: str, out: str, ties: list[str] = []) -> DataFrame:
    """Adds ``out``, the sum of ``weight`` over the rows of the same ``keys`` with the same or a smaller ``order``.

    ``order`` is a bigint and not negative; rows with a null order are dropped. Rows of the same keys and order are
    taken one after the other, by ``ties``.
    """
    df = df.where(F.col(order).isNotNull()).withColumn("_rt_b", F.shiftright(order, BITS))
    sums = df.groupBy(*keys, "_rt_b").agg(F.sum(weight).alias("_rt_w")).withColumn("_rt_bb", F.shiftright("_rt_b", BITS))
    before = (W.unboundedPreceding, -1)
    upper = sums.groupBy(*keys, "_rt_bb").agg(F.sum("_rt_w").alias("_rt_u"))
    upper = upper.select(*keys, "_rt_bb", F.coalesce(F.sum("_rt_u").over(_win(keys, "_rt_bb", before)), F.lit(0)).alias("_rt_2"))
    lower = F.coalesce(F.sum("_rt_w").over(_win([*keys, "_rt_bb"], "_rt_b", before)), F.lit(0))
    offsets = sums.withColumn("_rt_1", lower).join(upper, [*keys, "_rt_bb"]).select(*keys, "_rt_b", (F.col("_rt_1") + F.col("_rt_2")).alias("_rt_o"))
    inside = F.sum(weight).over(W.partitionBy(*keys, "_rt_b").orderBy(order, *ties).rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn(out, inside).join(offsets, [*keys, "_rt_b"]).withColumn(out, F.col(out) + F.col("_rt_o")).drop("_rt_b", "_rt_o")


def _win(keys: list[str], order: str, frame: tuple[int, int]):
    return W.partitionBy(*keys).orderBy(order).rowsBetween(*frame)


def ordered_total(df: DataFrame, keys: list[str], order: str, totals: dict[str, str], descending: bool = False) -> DataFrame:
    """Adds running totals ``{name: weight}`` for an order key of any type; each (keys, order) occurs once.

    The table is sorted by ranges over all tasks; a task totals its range only, and the sums of the ranges before it,
    one row a task and group, are added. The sorted table is written first, so that every reader sees the same ranges.
    Rows with a null order are dropped.
    """
    by = F.desc(order) if descending else F.asc(order)
    parts = df.where(F.col(order).isNotNull()).repartitionByRange(*keys, by).withColumn("_rt_p", F.spark_partition_id())
    parts = materialize(parts, "ranges")
    sums = parts.groupBy(*keys, "_rt_p").agg(*(F.sum(w).alias(f"_rt_{n}") for n, w in totals.items()))
    before = lambda n: F.coalesce(F.sum(f"_rt_{n}").over(_win(keys, "_rt_p", (W.unboundedPreceding, -1))), F.lit(0))
    offsets = sums.select(*keys, "_rt_p", *(before(n).alias(f"_rt_{n}") for n in totals))
    inside = W.partitionBy(*keys, "_rt_p").orderBy(by).rowsBetween(W.unboundedPreceding, 0)
    out = parts.withColumns({n: F.sum(w).over(inside) for n, w in totals.items()}).join(offsets, [*keys, "_rt_p"])
    return out.withColumns({n: F.col(n) + F.col(f"_rt_{n}") for n in totals}).drop("_rt_p", *(f"_rt_{n}" for n in totals))
