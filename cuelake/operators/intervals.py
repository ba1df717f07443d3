"""Overlapping and gapped intervals: continuous periods and the gaps between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.operators.blocks import BITS, running_total
from cuelake.storage import materialize

#: Seconds beyond which a bound cannot be held as whole milliseconds in a bigint.
MAX_S = 9.2e15


def to_ms(seconds: Column) -> Column:
    """Seconds as whole milliseconds, halves away from zero; null for null, NaN, infinity and beyond MAX_S."""
    return F.when(F.abs(seconds) <= MAX_S, F.round(seconds * 1000).cast("bigint"))


def counting(df: DataFrame, keys: list[str], start: Column, end: Column) -> DataFrame:
    """Rows ``(*keys, s, e)`` of the intervals that count: known bounds, start not negative, end after start.

    Rows with a null key belong to no entity and are dropped. Other columns of ``df`` are not carried along.
    """
    iv = df.select(*keys, to_ms(start).alias("s"), to_ms(end).alias("e"))
    for k in keys:
        iv = iv.where(F.col(k).isNotNull())
    return iv.where((F.col("s") >= 0) & (F.col("e") > F.col("s")))


def block_periods(iv: DataFrame, keys: list[str]) -> DataFrame:
    """``(*keys, s, e)``: the periods of the intervals of each entity and block of 2**BITS ms of starts.

    Starts occur once, so a block holds at most 2**BITS intervals, and as a rule a few hundred. Its starts and its ends
    are sorted independently as arrays; where start i+1 lies past end i, one period ends and the next begins.
    """
    g = iv.groupBy(*keys, F.shiftright("s", BITS).alias("_b")).agg(F.array_sort(F.collect_list("s")).alias("_s"), F.array_sort(F.collect_list("e")).alias("_e"))
    n = F.size("_s")
    none = F.array().cast("array<int>")
    cut = F.filter(F.when(n > 1, F.sequence(F.lit(0), n - 2)).otherwise(none), lambda i: F.get("_s", i + 1) > F.get("_e", i))
    g = g.withColumn("_c", cut)
    s = F.concat(F.slice("_s", 1, 1), F.transform("_c", lambda i: F.get("_s", i + 1)))
    e = F.concat(F.transform("_c", lambda i: F.get("_e", i)), F.slice("_e", -1, 1))
    return g.select(*keys, F.explode_outer(F.arrays_zip(s.alias("s"), e.alias("e"))).alias("p")).select(*keys, "p.s", "p.e")


def spans(iv: DataFrame, keys: list[str]) -> DataFrame:
    """Periods and gaps of each entity: ``(*keys, span_kind, start_ms, end_ms)`` from ``(*keys, s, e)``.

    Starts and ends are ranked independently. If the i-th end lies before the (i+1)-th start, exactly i intervals have
    begun and all of them have ended: a gap. The k-th period starts where gap k-1 ends and ends where gap k starts.
    Intervals that meet in a point form one period. Nothing comes out of an empty table; repeated rows change nothing.

    No group is ever sorted in one task: of the intervals with one start only the longest is kept while still on the
    map side, those that start within one block of time become that block's periods, and ranks of what is left are
    running totals over blocks (see blocks.py).
    """
    iv = materialize(block_periods(iv.groupBy(*keys, "s").agg(F.max("e").alias("e")), keys), "intervals")
    starts = running_total(iv.select(*keys, "s", F.lit(1).alias("n")), keys, "s", "n", "rank")
    ends = running_total(iv.groupBy(*keys, "e").agg(F.count("*").alias("n")), keys, "e", "n", "done")
    a = starts.select(*keys, (F.col("rank") - 1).alias("done"), "s")
    gaps = ends.select(*keys, "done", "e").join(a, [*keys, "done"]).where("s > e").select(*keys, F.col("e").alias("g"), "s")
    gaps = materialize(running_total(gaps.withColumn("n", F.lit(1)), keys, "g", "n", "k"), "gaps")
    outer = iv.groupBy(*keys).agg(F.min("s").alias("first"), F.max("e").alias("last"))
    count = gaps.groupBy(*keys).agg(F.max("k").alias("k"))
    outer = outer.join(count, keys, "left").withColumn("k", F.coalesce("k", F.lit(0)))
    none = F.lit(None).cast("bigint")
    marks = (
        gaps.select(*keys, "k", none.alias("s"), F.col("g").alias("e"))
        .unionByName(gaps.select(*keys, (F.col("k") + 1).alias("k"), "s", none.alias("e")))
        .unionByName(outer.select(*keys, F.lit(1).cast("bigint").alias("k"), F.col("first").alias("s"), none.alias("e")))
        .unionByName(outer.select(*keys, (F.col("k") + 1).alias("k"), none.alias("s"), F.col("last").alias("e")))
    )
    periods = marks.groupBy(*keys, "k").agg(F.max("s").alias("start_ms"), F.max("e").alias("end_ms"))
    columns = [*keys, "span_kind", "start_ms", "end_ms"]
    found = gaps.select(*keys, F.lit("gap").alias("span_kind"), F.col("g").alias("start_ms"), F.col("s").alias("end_ms"))
    return periods.withColumn("span_kind", F.lit("period")).select(columns).unionByName(found.select(columns))
