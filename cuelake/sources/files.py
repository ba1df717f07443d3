"""Files in and out: manifests, listings, artifacts that know what they were made of, dense matrices, reports."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MANIFEST = """video_id string, filename string, status string, source_url string, split string, source_group string,
media struct<duration:double, fps:double, width:int, height:int, codec:string>,
frames array<struct<timestamp:double, thumbnail:string>>, queries array<struct<query_id:string, query_text:string, query_type:string, expected_presence:boolean, relevant_intervals:array<array<double>>>>"""


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """One row for each JSON manifest below ``path``; the schema is fixed, unknown fields are ignored, missing ones null."""
    return spark.read.schema(MANIFEST).option("multiLine", True).option("recursiveFileLookup", True).json(path)


def write_manifests(df: DataFrame, path: str) -> None:
    """Replaces the manifests of the videos in ``df`` and leaves others alone. Written aside and committed as a whole."""
    df.withColumn("video", F.col("video_id")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("video").json(path)


def manifest_frames(manifests: DataFrame) -> DataFrame:
    """``(video_id, frame_idx, ts, thumbnail)`` of manifests, in their order."""
    return manifests.select("video_id", F.posexplode("frames").alias("frame_idx", "f")).select("video_id", F.col("frame_idx").cast("bigint").alias("frame_idx"), F.col("f.timestamp").alias("ts"), "f.thumbnail")


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``(path, modified, bytes)`` of files, last modified first; contents aren't read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return f.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes")).orderBy(F.desc("modified"), "path")


def replace_groups(df: DataFrame, path: str, key: str) -> None:
    """Writes Parquet by ``key`` and replaces only the groups that ``df`` has, each as a whole."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def save_artifact(df: DataFrame, path: str, **identity: str) -> None:
    """Writes Parquet with what it was made of (model, revision, fingerprint and the like) beside every row group."""
    df.select("*", *(F.lit(v).alias(f"_id_{k}") for k, v in identity.items())).write.mode("overwrite").parquet(path)


def load_artifact(spark: SparkSession, path: str, **identity: str) -> DataFrame:
    """Reads an artifact; fails while it runs if a row was made of anything else, and here if a mark is missing."""
    df = spark.read.parquet(path)
    for k, v in identity.items():
        df = df.where(F.assert_true(F.col(f"_id_{k}") == v, F.lit(f"{k} of {path} is stale")).isNull())
    return df.drop(*(c for c in df.columns if c.startswith("_id_")))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def markdown(df: DataFrame, title: str = "", digits: int = 3, most: int = 1000) -> str:
    """A small table, such as a summary, as Markdown text: headings, numbers aligned right and rounded, null as a dash.

    A report is written by the driver: at most ``most`` rows are taken, and what lies beyond is said in a last line.
    """
    rows = df.limit(most + 1).collect()
    numeric = {f.name for f in df.schema if isinstance(f.dataType, T.NumericType)}

    def cell(v) -> str:
        if v is None:
            return "—"
        if isinstance(v, float):
            return f"{v:.{digits}f}"
        return str(v).replace("|", "\\|").replace("\n", " ")

    out = [f"## {title}", ""] if title else []
    out += ["| " + " | ".join(c.replace("|", "\\|") for c in df.columns) + " |", "| " + " | ".join("---:" if c in numeric else "---" for c in df.columns) + " |"]
    out += ["| " + " | ".join(cell(v) for v in r) + " |" for r in rows[:most]]
    return "\n".join([*out, *(["", f"More than {most} rows."] if len(rows) > most else [])]) + "\n"


class _Rows(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class _NpyReader(DataSourceReader):
    def __init__(self, path: str, rows: int):
        self.path, self.rows = path, rows

    def partitions(self) -> list[InputPartition]:
        import glob

        import numpy as np

        out = []
        for p in sorted(glob.glob(self.path)):
            n = np.load(p, mmap_mode="r").shape[0]
            out += [_Rows(p, i, min(n, i + self.rows)) for i in range(0, n, self.rows)]
        return out

    def read(self, partition: _Rows) -> Iterator[tuple]:
        import numpy as np

        m = np.load(partition.path, mmap_mode="r")
        for i in range(partition.start, partition.end):
            yield partition.path, i, m[i].astype("float32").tolist()


class NpySource(DataSource):
    """Dense matrices in .npy files as rows ``(path, frame_idx, embedding)``: ``format("npy").load("dir/*.npy")``.

    Files are mapped, not loaded, and cut into ranges of ``rows`` rows, one for each task.
    """

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField("path", T.StringType()), T.StructField("frame_idx", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _NpyReader(self.options["path"], int(self.options.get("rows", 100_000)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NpySource)
