"""Problem 5: the N highest-scoring items of every group, by row groups whose statistics tell what can be skipped."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuelake.sources.tables import load
from cuelake.storage import materialize, shared_path

#: Rows of a row group of the clustered copy, at most: few enough that a hot group has many to skip.
ROW_GROUP_ROWS = 16_384
#: Row groups that a task reads, about.
READS_A_TASK = 16


def cluster(df: DataFrame, groups: list[str], score: str, ties: list[str], key: str, recluster: bool = False) -> str:
    """Writes the rows clustered by group to the shared folder and returns the path.

    Each task sorts its own split by group and descending score; a table delivered group by group, as search results
    are, is then clustered as a whole without a shuffle, and a hot group lies in as many files as it came in. Tables in
    random order are first dealt out by group and a salt (``recluster``). The copy can be read for any n.
    """
    df = df.select(*groups, key, score, *ties)
    if recluster:
        df = df.repartition(*groups, F.pmod(F.xxhash64(key), F.lit(16)))
    path = shared_path(df.sparkSession, "clustered")
    df = df.sortWithinPartitions(F.xxhash64(*groups), *groups, F.desc(score), *ties, key)
    df.write.option("parquet.block.row.count.limit", ROW_GROUP_ROWS).option("parquet.page.size", 64 << 10).parquet(path)
    return path


def _open(path: str) -> pq.ParquetFile:
    if path.startswith("file:"):
        return pq.ParquetFile("/" + path[5:].lstrip("/"))
    from pyarrow.fs import FileSystem

    fs, inner = FileSystem.from_uri(path)
    return pq.ParquetFile(fs.open_input_file(inner))


def _same(column: pq.ColumnChunkMetaData, rows: int) -> tuple[bool, object]:
    """Whether a column chunk's statistics show one value only, and that value; null is a value."""
    s = column.statistics
    if s is None or not s.has_null_count:
        return False, None
    if s.null_count == rows:
        return True, None
    return s.null_count == 0 and s.has_min_max and s.min == s.max, s.max if s.has_min_max else None


def row_groups(spark: SparkSession, path: str, groups: list[str], score: str, types: T.StructType) -> DataFrame:
    """``(path, row_group, most, single, *groups)`` from the footers of clustered files.

    ``most`` is a row group's maximum score; ``groups`` are the values of its only group if it is ``single``, else null.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for p in b.column(0).to_pylist():
                meta = _open(p).metadata
                for r in range(meta.num_row_groups):
                    g = meta.row_group(r)
                    at = {g.column(i).path_in_schema: g.column(i) for i in range(g.num_columns)}
                    one = [_same(at[c], g.num_rows) for c in groups]
                    single, s = all(x for x, _ in one), at[score].statistics
                    rows.append((p, r, float(s.max) if s and s.has_min_max else float("inf"), single, *(v if single else None for _, v in one)))
            kinds = [pa.string(), pa.int32(), pa.float64(), pa.bool_(), *arrow]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], k) for i, k in enumerate(kinds)], ["path", "row_group", "most", "single", *groups])

    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("row_group", T.IntegerType()), T.StructField("most", T.DoubleType()), T.StructField("single", T.BooleanType()), *types])
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = [to_arrow_type(f.dataType) for f in types]
    return materialize(files.mapInArrow(run, schema), "footers")


def best_rows(table: pa.Table, groups: list[str], score: str, key: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the rows of the n best distinct keys of each group, and their ranks from 0.

    Rows come clustered by group, then by descending score, ties and key, so repeated rows are neighbours.
    """
    rows = table.num_rows
    first = np.zeros(rows, bool)
    first[:1] = True
    for g in groups:
        d = pc.dictionary_encode(table[g].combine_chunks(), null_encoding="encode")
        code = (d.chunk(0) if isinstance(d, pa.ChunkedArray) else d).indices.to_numpy(zero_copy_only=False)
        first[1:] |= code[1:] != code[:-1]
    fresh = first.copy()
    for c in (key, score):
        x = pc.dictionary_encode(table[c].combine_chunks())
        x = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x).indices.to_numpy(zero_copy_only=False)
        fresh[1:] |= x[1:] != x[:-1]
    seen = np.cumsum(fresh)
    rank = seen - seen[first][np.cumsum(first) - 1]
    top = np.flatnonzero(fresh & (rank < n))
    return top, rank[top]


def read_best(reads: DataFrame, groups: list[str], score: str, ties: list[str], key: str, n: int, schema: T.StructType) -> DataFrame:
    """The n best rows of each group in each of the row groups ``(path, row_group)``, with ``_rank`` from 0 in theirs."""
    columns = [*groups, key, score, *ties]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted: dict[str, list[int]] = defaultdict(list)
        for b in batches:
            for p, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                wanted[p].append(r)
        for p, rs in wanted.items():
            f = _open(p)
            for r in rs:
                t = f.read_row_group(r, columns).select(columns)
                top, rank = best_rows(t, groups, score, key, n)
                yield from t.take(pa.array(top)).append_column("_rank", pa.array(rank, pa.int32())).to_batches()

    return reads.select("path", "row_group").mapInArrow(run, T.StructType([*schema, T.StructField("_rank", T.IntegerType())]))


def needed(footers: DataFrame, groups: list[str], score: str, ties: list[str], key: str, n: int, schema: T.StructType) -> DataFrame:
    """The row groups that can hold one of the n best of a group.

    Of each group that fills row groups, the one of the highest maximum is read first, whichever file it lies in; its
    n-th score is a bound that all files share. Row groups of that group whose maximum lies strictly below are skipped;
    equal scores are read, as ties decide among them. Row groups of several groups hold the ends of these groups and
    are read.
    """
    single = footers.where("single")
    lead = single.groupBy(*groups).agg(F.max(F.struct("most", "path", "row_group")).alias("x"), F.count("*").alias("c")).where("c > 1")
    bounds = read_best(lead.select("x.path", "x.row_group"), groups, score, ties, key, n, schema).where(F.col("_rank") == n - 1)
    bounds = bounds.groupBy(*groups).agg(F.max(score).alias("_nth")).withColumnsRenamed({g: f"_b_{g}" for g in groups})
    same = F.lit(True)
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"_b_{g}"))
    return footers.join(bounds, F.col("single") & same, "left").where(F.col("_nth").isNull() | (F.col("most") >= F.col("_nth"))).select("path", "row_group", "most")


def top_n(df: DataFrame, groups: list[str], score: str, ties: list[str], key: str, n: int, recluster: bool = False) -> DataFrame:
    """The ``n`` rows of highest ``score`` of each group, equal scores by ``ties`` and then ``key`` ascending, with ``rank``.

    Rows count if their key is known and score and ties are finite; rows equal in key, score and ties count once. A
    null group value is a value like any other. Smaller groups give all their rows, an empty table gives none. Columns
    beside those named are not carried along. A task hands on at most n rows of a group and row group, so no group,
    however hot, is gathered in one place.
    """
    near, _, _ = _plan(df, groups, score, ties, key, n, recluster)
    w = W.partitionBy(*groups).orderBy(F.desc(score), *ties, key)
    return near.drop("_rank").withColumn("rank", F.dense_rank().over(w)).where(F.col("rank") <= n).dropDuplicates([*groups, "rank"])


def _plan(df: DataFrame, groups: list[str], score: str, ties: list[str], key: str, n: int, recluster: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The best rows by row group, all row groups, and those that are read."""
    clean = df.where(F.col(key).isNotNull())
    for c in (score, *ties):
        clean = clean.where(F.abs(c) < float("inf"))
    schema = clean.select(*groups, key, score, *ties).schema
    path = cluster(clean, groups, score, ties, key, recluster)
    footers = row_groups(df.sparkSession, path, groups, score, T.StructType([schema[g] for g in groups]))
    reads = materialize(needed(footers, groups, score, ties, key, n, schema), "reads")
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-reads.count() // READS_A_TASK))
    dealt = reads.repartition(tasks, "path", "row_group").sortWithinPartitions("path", F.desc("most"))
    return read_best(dealt, groups, score, ties, key, n, schema), footers, reads


def _candidates(spark: SparkSession, sf_dir: str) -> tuple:
    return load(spark, sf_dir, "coarse_candidates"), ["query_id", "video_id"], "score", ["timestamp_s"], "candidate_id", 5


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_n(*_candidates(spark, sf_dir)).select("query_id", "video_id", "candidate_id")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many row groups the clustered copy has and how many of them p5_found reads."""
    _, footers, read = _plan(*_candidates(spark, sf_dir), False)
    return footers.agg(F.count("*").alias("row_groups")).crossJoin(F.broadcast(read.agg(F.count("*").alias("read"))))


QUERIES = {"p5_found": found, "p5_reads": reads}
SQL = {
    "p5_found": """
SELECT query_id, video_id, candidate_id FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, video_id ORDER BY score DESC, timestamp_s, candidate_id) AS r
  FROM (SELECT DISTINCT query_id, video_id, candidate_id, score, timestamp_s FROM coarse_candidates
        WHERE isfinite(score) AND isfinite(timestamp_s) AND candidate_id IS NOT NULL) x) y
WHERE r <= 5
""",
}
