"""Dense vectors: normalising, inner products, exact nearest neighbours and what changes from one frame to the next."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuelake.operators.blocks import hot_keys, skew_join
from cuelake.storage import materialize


def dot(a: Column, b: Column) -> Column:
    """Inner product in double; null where lengths differ or a part is null."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def valid(v: Column) -> Column:
    """Whether a vector has parts, all finite, and a length above zero."""
    return F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))) & (norm(v) > 0), F.lit(False))


def normalized(v: Column) -> Column:
    """The unit vector; null for a vector that isn't valid."""
    n = norm(v)
    return F.when(valid(v), F.transform(v, lambda x: x.cast("double") / n))


def mean_vector(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """``(*keys, centroid)``: the mean of the vectors of each group, part by part, without gathering them."""
    parts = df.select(*keys, F.posexplode(vector).alias("i", "x")).groupBy(*keys, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return parts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda p: p.m).alias("centroid"))


def _dealt(items: DataFrame, queries: DataFrame, key: str, query: str, group: list[str], block: int) -> tuple[DataFrame, DataFrame, int]:
    """Both sides with ``_i`` and ``_q``, the blocks of items and of queries that meet, and how many rows a side has at most.

    The number of blocks comes from each group's own size: all but large groups are one block of each.
    """
    deal = lambda c, m: F.pmod(F.xxhash64(c), m).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), m - 1))
    blocks = lambda c: F.greatest(F.ceil(F.col(c) / block), F.lit(1)).cast("int")
    if not group:
        counts = [df.count() for df in (items, queries)]
        tasks = items.sparkSession.sparkContext.defaultParallelism
        ni, nq = F.lit(max(tasks, -(-counts[0] // block))), F.lit(max(1, -(-counts[1] // block)))
        return items.select("*", deal(key, ni).alias("_i"), every(nq).alias("_q")), queries.select("*", deal(query, nq).alias("_q"), every(ni).alias("_i")), max(counts)
    n = items.select(*group, F.lit(1).alias("i"), F.lit(0).alias("q")).unionByName(queries.select(*group, F.lit(0).alias("i"), F.lit(1).alias("q")))
    n = materialize(n.groupBy(*group).agg(F.sum("i").alias("i"), F.sum("q").alias("q")), "groups")
    large = n.where((F.col("i") > block) | (F.col("q") > block)).select(*group, blocks("i").alias("_ni"), blocks("q").alias("_nq"))
    rows = max(n.agg(F.sum("i"), F.sum("q")).na.fill(0).first())
    if large.isEmpty():
        one = {"_i": F.lit(0), "_q": F.lit(0)}
        return items.withColumns(one), queries.withColumns(one), rows
    a, b = (skew_join(df, large, group, hot_keys(df, group), "left").na.fill(1, ["_ni", "_nq"]) for df in (items, queries))
    a = a.withColumn("_i", deal(key, F.col("_ni"))).withColumn("_q", every(F.col("_nq"))).drop("_ni", "_nq")
    return a, b.withColumn("_q", deal(query, F.col("_nq"))).withColumn("_i", every(F.col("_ni"))).drop("_ni", "_nq"), rows


def _matrix(t: pa.Table, width: int) -> np.ndarray:
    return t["_v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def top_k(items: DataFrame, queries: DataFrame, key: str, query: str, vector: str, k: int, group: list[str] = [], block: int = 4096) -> DataFrame:
    """``(*group, query, key, score, rank)``: exact inner products of query vectors with all items (of the same group).

    Each block of items meets each block of queries of its group in one matrix product, which hands on k rows a query:
    no side is broadcast or collected, and no product is of more than a block of each. A group of up to a block of
    items and queries is moved once, and many such groups share a call. Scores are sums of products in double, rounded
    to 9 places before ranking so that the order of summation can't reorder ties; ties go to the smaller key. Vectors
    that aren't valid take no part, nor do those of another length than the query's or in a null group; keys are unique.
    """
    clean = lambda df, c: reduce(lambda d, g: d.where(F.col(g).isNotNull()), group, df.where(valid(F.col(vector)) & F.col(c).isNotNull())).select(*group, c, F.col(vector).cast("array<double>").alias("_v"))
    items, queries = clean(items, key), clean(queries, query)
    a, b, rows = _dealt(items, queries, key, query, group, block)
    tasks = items.sparkSession.sparkContext.defaultParallelism
    calls = max(2 * tasks, -(-rows // block))
    schema = T.StructType([*(items.schema[g] for g in group), queries.schema[query], items.schema[key], T.StructField("score", T.DoubleType())])
    by = [*group, "_i", "_q"]

    def codes(x: pa.Table, q: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        out = np.zeros(x.num_rows + q.num_rows, np.int64)
        for c in [*by, None]:
            parts = [t[c] if c else pc.list_value_length(t["_v"]) for t in (x, q)]
            d = pa.chunked_array([ch for p in parts for ch in p.chunks], parts[0].type).combine_chunks().dictionary_encode()
            d = d.chunk(0) if isinstance(d, pa.ChunkedArray) else d
            out = np.unique(out * max(1, len(d.dictionary)) + d.indices.to_numpy(), return_inverse=True)[1]
        return out[: x.num_rows], out[x.num_rows :]

    def meet(x: pa.Table, q: pa.Table) -> pa.Table:
        got: list[tuple] = []
        if x.num_rows and q.num_rows:
            x = x.sort_by(key)
            cx, cq = codes(x, q)
            ox, oq = np.argsort(cx, kind="stable"), np.argsort(cq, kind="stable")
            cx, cq = cx[ox], cq[oq]
            for c in np.intersect1d(cx, cq):
                ix, iq = (o[np.searchsorted(v, c) : np.searchsorted(v, c, "right")] for o, v in ((ox, cx), (oq, cq)))
                mx, mq = x.take(pa.array(ix)), q.take(pa.array(iq))
                width = len(mx["_v"][0])
                s = np.round(_matrix(mq, width) @ _matrix(mx, width).T, 9)
                top = np.argsort(-s, axis=1, kind="stable")[:, :k]
                got.append((ix[top].ravel(), np.repeat(iq, top.shape[1]), np.take_along_axis(s, top, 1).ravel()))
        at, of, scores = (np.concatenate(p) for p in zip(*got)) if got else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        at, of = pa.array(at), pa.array(of)
        return pa.Table.from_arrays([*(x[g].take(at) for g in group), q[query].take(of), x[key].take(at), pa.array(scores)], [*group, query, key, "score"])

    call = F.pmod(F.xxhash64(*by), F.lit(calls)).cast("int").alias("_p")
    near = a.select("*", call).groupBy("_p").cogroup(b.select("*", call).groupBy("_p")).applyInArrow(meet, schema)
    w = W.partitionBy(*group, query).orderBy(F.desc("score"), key)
    return near.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)


def encode(df: DataFrame, text: str, model: Callable[[list[str]], np.ndarray], out: str = "embedding", unit: bool = False) -> DataFrame:
    """Adds the vectors that ``model`` gives for a batch of texts or of names of images; null for null. The boundary for neural encoders.

    ``unit`` makes them unit vectors; one without a length or with a part that isn't finite is null then.
    """

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(texts):
        known = texts.notna()
        made = iter(model(list(texts[known]))) if known.any() else iter(())
        return pd.Series([np.asarray(next(made), np.float64).tolist() if k else None for k in known], dtype=object)

    df = df.withColumn(out, run(text))
    return df.withColumn(out, normalized(F.col(out))) if unit else df


def mean_pooled(tokens: Column, mask: Column) -> Column:
    """The unit vector of the mean of those token vectors whose mask is above 0; null if there are none or it has no length."""
    kept = F.filter(F.arrays_zip(tokens.alias("v"), mask.alias("m")), lambda t: t.m > 0)
    zero = F.transform(F.get(kept, F.lit(0)).v, lambda _: F.lit(0.0))
    total = F.aggregate(kept, zero, lambda acc, t: F.zip_with(acc, t.v, lambda a, x: a + x.cast("double")))
    return normalized(F.transform(total, lambda x: x / F.size(kept)))


def conditioned_score(visual: Column, text: Column, prompt: Column) -> Column:
    """Inner product of a clip's unit vector with a text vector that the clip's ``prompt``, made by a model, was added to."""
    return dot(visual, normalized(F.zip_with(text, prompt, lambda a, b: a.cast("double") + b.cast("double"))))


def pair_scores(df: DataFrame, a: str, b: str, model: Callable[[list, list], np.ndarray], out: str = "score") -> DataFrame:
    """Adds what ``model`` gives for batches of pairs, such as images and texts; null where a side is null or the score isn't finite."""

    @F.pandas_udf(T.DoubleType())
    def run(x, y):
        known = x.notna() & y.notna()
        made = iter(np.asarray(model(list(x[known]), list(y[known])), np.float64)) if known.any() else iter(())
        got = [next(made) if k else None for k in known]
        return pd.Series([v if v is not None and np.isfinite(v) else None for v in got], dtype="float64")

    return df.withColumn(out, run(a, b))


def adjacent_change(df: DataFrame, group: str, order: str, vector: str) -> DataFrame:
    """Adds ``change``: the greater cosine distance to the frame before and the one after, 0 for a lone frame."""
    w = W.partitionBy(group).orderBy(order)
    at = lambda f: 1 - dot(F.col(vector), f(vector).over(w))
    return df.withColumn("change", F.coalesce(F.greatest(at(F.lag), at(F.lead)), F.lit(0.0)))


def scenes(df: DataFrame, group: str, order: str, vector: str, threshold: float) -> DataFrame:
    """Adds ``scene``, counted from 0: a cosine distance to the frame before of at least ``threshold`` starts one."""
    w = W.partitionBy(group).orderBy(order)
    new = F.coalesce((1 - dot(F.col(vector), F.lag(vector).over(w)) >= threshold).cast("int"), F.lit(0))
    return df.withColumn("_new", new).withColumn("scene", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_new")
