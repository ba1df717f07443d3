"""Problem 6: token ids of whole texts by a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import os
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from cuelake.sources.tables import load

#: Where the vocabulary files lie; on a cluster, a folder that every executor has.
TOKENIZERS = os.environ.get("CUELAKE_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: how the vocabulary's texts were cut into words before merging.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words whose ids a Python worker keeps; at that many it starts over.
CACHED = 400_000


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: the leftmost pair of least rank is merged until no pair has a rank.

    Leaf i of a segment tree holds the rank of the pair that starts at byte i and the tree's root the leftmost least
    one. A merge changes three leaves: the merged pair's, its dead right half's, and its live left neighbour's. A word
    of n bytes thus takes O(n log n) steps, also if it is one run of a million bytes.
    """
    n = len(word)
    if n == 1:
        return [ranks[word]]
    size = 1 << (n - 1).bit_length()
    none = 1 << 62
    tree = [none] * (2 * size)
    get = ranks.get
    for i in range(n - 1):
        r = get(word[i : i + 2])
        if r is not None:
            tree[size + i] = r << 32 | i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    right, left = list(range(1, n + 1)), list(range(-1, n - 1))
    part = [word[i : i + 1] for i in range(n)]

    def put(i: int, value: int) -> None:
        i += size
        tree[i] = value
        while i > 1:
            a, b = tree[i], tree[i ^ 1]
            if b < a:
                a = b
            i >>= 1
            if tree[i] == a:
                return
            tree[i] = a

    while (least := tree[1]) != none:
        i = least & 0xFFFFFFFF
        j = right[i]
        part[i] += part[j]
        k = right[i] = right[j]
        put(j, none)
        r = None
        if k < n:
            left[k] = i
            r = get(part[i] + part[k])
        put(i, none if r is None else r << 32 | i)
        h = left[i]
        if h >= 0:
            r = get(part[h] + part[i])
            put(h, none if r is None else r << 32 | h)
    out, i = [], 0
    while i < n:
        out.append(ranks[part[i]])
        i = right[i]
    return out


class Encoder:
    """Encodes texts; strings that look like special tokens are ordinary text."""

    def __init__(self, path: str):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.words = regex.compile(WORD).findall
        self.kept: dict[str, list[int]] = {}

    def of_word(self, w: str) -> list[int]:
        ids = self.kept.get(w)
        if ids is None:
            ids = merge(w.encode(), self.ranks)
            if len(self.kept) >= CACHED:
                self.kept.clear()
            if len(w) < 200:
                self.kept[w] = ids
        return ids

    def encode_to(self, out: array, text: str) -> None:
        kept, extend, of_word = self.kept.get, out.extend, self.of_word
        for w in self.words(text):
            extend(kept(w) or of_word(w))

    def encode(self, text: str | None) -> list[int]:
        out = array("i")
        if text:
            self.encode_to(out, text)
        return out.tolist()

    def count(self, text: str | None) -> int:
        kept, of_word = self.kept.get, self.of_word
        return sum([len(kept(w) or of_word(w)) for w in self.words(text)]) if text else 0


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary file and Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def spread(df: DataFrame, tasks: int = 1) -> DataFrame:
    """``df`` in at least ``tasks`` partitions a core, for work in Python on texts: a few large files would keep most idle.

    A table that already comes in as many splits is left as it is, without a shuffle.
    """
    want = tasks * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df


def _map(df: DataFrame, text: str, out: str, kind: T.DataType, make, path: str) -> DataFrame:
    rest = [c for c in df.columns if c not in (text, out)]
    schema = T.StructType([*(df.schema[c] for c in rest), T.StructField(out, kind, False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            made = make(enc, b.column(b.schema.get_field_index(text)))
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in rest), made], [*rest, out])

    return spread(df.select(*rest, text)).mapInArrow(run, schema)


def _ids(enc: Encoder, texts: pa.Array) -> pa.Array:
    flat, ends = array("i"), array("i", [0])
    for t in texts:
        t = t.as_py()
        if t:
            enc.encode_to(flat, t)
        ends.append(len(flat))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))


def _sizes(enc: Encoder, texts: pa.Array) -> pa.Array:
    return pa.array([enc.count(t.as_py()) for t in texts], pa.int64())


def encode(df: DataFrame, text: str, out: str = "ids", path: str | None = None) -> DataFrame:
    """Replaces the string column ``text`` by ``out``, its token ids; empty and null texts give an empty list.

    ``path`` names the vocabulary file, ranks of byte strings in base64. Whole texts are encoded, of any length; no row
    is left out or added; their order isn't kept. A column that is already called ``out`` is replaced.
    """
    return _map(df, text, out, T.ArrayType(T.IntegerType(), False), _ids, path or f"{TOKENIZERS}/{VOCABULARY}")


def count_tokens(df: DataFrame, text: str, out: str = "n_tokens", path: str | None = None) -> DataFrame:
    """Replaces ``text`` by its number of tokens, 0 for empty and null texts."""
    return _map(df, text, out, T.LongType(), _sizes, path or f"{TOKENIZERS}/{VOCABULARY}")


def ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(load(spark, sf_dir, "documents").select("doc_id", "text"), "text")


QUERIES = {"p6_ids": ids}
SQL: dict[str, str] = {}
