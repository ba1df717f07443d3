"""Problem 7: filling containers of fixed capacity by minimum bin slack."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.llm.bpe import count_tokens
from cuelake.operators.blocks import running_total
from cuelake.sources.tables import load
from cuelake.storage import materialize

CAPACITY = 2048


class Fill(NamedTuple):
    """``times`` equal containers: how many items of each size each of them holds."""

    sizes: dict[int, int]
    times: int


def fullest(room: int, counts: dict[int, int]) -> dict[int, int]:
    """A combination of the available sizes whose sum comes as near to ``room`` as possible without passing it.

    Bit s of ``reached`` says that some combination sums to s. Sizes are added in descending order, each in doubling
    batches up to its number, until ``room`` itself is reached or none is left; then the way back is traced.
    """
    mask, reached, steps = (1 << room + 1) - 1, 1, []
    for size in sorted((s for s in counts if s <= room and counts[s]), reverse=True):
        left, batch = min(counts[size], room // size), 1
        while left and not reached >> room & 1:
            batch = min(batch, left)
            steps.append((size, batch, reached))
            reached |= reached << size * batch & mask
            left -= batch
            batch *= 2
        if reached >> room & 1:
            break
    at, used = reached.bit_length() - 1, {}
    for size, batch, before in reversed(steps):
        if not before >> at & 1:
            at -= size * batch
            used[size] = used.get(size, 0) + batch
    return used


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Fill]:
    """Containers for ``counts`` items of each size from 1 to ``capacity``, by minimum bin slack.

    The largest item left opens a container and the fullest combination for the rest of it is removed with it. As long
    as all its sizes last, the next container would be filled alike, so one search serves them all; each search uses up
    a size to below what it takes, so their number depends on ``capacity`` and not on the number of items.
    """
    left = {s: n for s, n in counts.items() if n > 0}
    assert all(1 <= s <= capacity for s in left)
    out = []
    while left:
        seed = max(left)
        used = fullest(capacity - seed, {**left, seed: left[seed] - 1})
        used[seed] = used.get(seed, 0) + 1
        times = min(left[s] // n for s, n in used.items())
        out.append(Fill(used, times))
        for s, n in used.items():
            left[s] -= n * times
            if not left[s]:
                del left[s]
    return out


def _slots(fills: list[Fill]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the items of each size go: (size, first rank) packed in one sorted key, first container, items in each."""
    rows, given, container = [], {}, 0
    for f in fills:
        for s, n in f.sizes.items():
            rows.append((s << 44 | given.get(s, 0), container, n))
            given[s] = given.get(s, 0) + n * f.times
        container += f.times
    rows.sort()
    return tuple(np.array(x, np.int64) for x in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 3


def cut(df: DataFrame, key: str, size: str, capacity: int = CAPACITY) -> DataFrame:
    """Items ``(key, piece_no, offset, size)``: one of each row, or, if it exceeds ``capacity``, full ones and a rest."""
    n = F.ceil(F.col(size) / capacity).cast("bigint")
    df = df.where((F.col(size) > 0) & F.col(key).isNotNull())
    df = df.select(key, F.col(size).cast("bigint").alias("_all"), F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)).alias("piece_no"))
    offset = F.col("piece_no") * capacity
    return df.select(key, "piece_no", offset.alias("offset"), F.least(F.lit(capacity), F.col("_all") - offset).alias("size"))


def pack(df: DataFrame, key: str, size: str, capacity: int = CAPACITY) -> DataFrame:
    """Rows ``(key, piece_no, offset, size, container_id)``: every item of ``df`` in a container of ``capacity``.

    ``key`` is unique. An item is cut only if it alone exceeds the capacity: into full containers and a rest, which is
    packed like other items. Rows of no or unknown size or key need no container and give no row; an empty table gives
    none. Only the number of items of each size goes to the driver, ``capacity`` numbers at most. Items of one size are
    interchangeable; their ranks are running totals over blocks of hashed keys, so a size that a third of all items
    have is ranked by many tasks.
    """
    items = cut(df, key, size, capacity)
    counts = {r["size"]: r["count"] for r in items.groupBy("size").count().collect()}
    keys, first, each = _slots(plan(counts, capacity))

    @F.pandas_udf("bigint")
    def place(size: pd.Series, rank: pd.Series) -> pd.Series:
        at = np.searchsorted(keys, (size.to_numpy() << 44) | rank.to_numpy(), "right") - 1
        return pd.Series(first[at] + (rank.to_numpy() - (keys[at] & (1 << 44) - 1)) // each[at])

    spread = F.pmod(F.xxhash64(key, "piece_no"), F.lit(1 << 40))
    ranked = running_total(items.withColumns({"_o": spread, "_n": F.lit(1)}), ["size"], "_o", "_n", "_r", [key, "piece_no"])
    return ranked.select(key, "piece_no", "offset", "size", place(F.col("size"), F.col("_r") - 1).alias("container_id"))


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document, counted once and kept: packing needs them twice."""
    return materialize(count_tokens(load(spark, sf_dir, "documents").select("doc_id", "text"), "text"), "tokens")


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(token_counts(spark, sf_dir), "doc_id", "n_tokens")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that had to be cut: those that lie in more than one container. Each piece but the last fills its own."""
    each = packed(spark, sf_dir).groupBy("doc_id").agg(F.min("container_id").alias("lo"), F.max("container_id").alias("hi"))
    return each.where("lo < hi").select("doc_id")


def fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are: their number, the least number that could hold all tokens, and the unused share."""
    each = packed(spark, sf_dir).groupBy("container_id").agg(F.sum("size").alias("used"))
    n, used = F.count("*"), F.sum("used")
    return each.agg(n.alias("containers"), F.ceil(used / CAPACITY).cast("bigint").alias("least"), (1 - used / (n * CAPACITY)).alias("unused_share"), F.max("used").alias("fullest"))


def faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must not be, ``(fault, id)``: containers too full, and documents that lost tokens, have a piece twice or were cut without need."""
    tokens = token_counts(spark, sf_dir)
    p = materialize(pack(tokens, "doc_id", "n_tokens"), "packed")
    full = p.groupBy(F.col("container_id").alias("id")).agg(F.sum("size").alias("s")).where(F.col("s") > CAPACITY).select(F.lit("too full").alias("fault"), "id")
    each = p.groupBy("doc_id").agg(F.sum("size").alias("s"), F.count("*").alias("n"), F.countDistinct("piece_no").alias("d"))
    whole = tokens.join(each, "doc_id", "left").where((F.coalesce("s", F.lit(0)) != F.col("n_tokens")) | (F.col("n") != F.col("d")) | (F.col("n") > F.ceil(F.col("n_tokens") / CAPACITY)))
    return full.unionByName(whole.select(F.lit("not whole").alias("fault"), F.col("doc_id").alias("id")))


QUERIES = {"p7_found": found, "p7_pack": packed, "p7_fill": fill, "p7_faults": faults}
SQL = {"p7_faults": "SELECT '' AS fault, CAST(0 AS BIGINT) AS id WHERE false"}
