import base64
import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cuelake.llm import bpe

PATH = f"{bpe.TOKENIZERS}/{bpe.VOCABULARY}"
ENC = bpe.Encoder(PATH)
PUBLIC = tiktoken.Encoding("own", pat_str=bpe.WORD, mergeable_ranks=ENC.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text_equals_public_encoder(text):
    assert ENC.encode(text) == PUBLIC.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.text("abe th'=-\n\t 0éıŞ", max_size=200))
def test_repetitive_text_equals_public_encoder(text):
    assert ENC.encode(text) == PUBLIC.encode_ordinary(text)


def test_every_word_of_the_vocabulary_and_long_runs():
    for w in random.Random(3).sample(sorted(ENC.ranks), 4000):
        try:
            t = w.decode()
        except UnicodeDecodeError:
            continue
        assert ENC.encode(t) == PUBLIC.encode_ordinary(t)
    rng = random.Random(1)
    for t in ("=" * 30_001, "ab" * 20_000, "".join(rng.choice("acgt") for _ in range(50_000)), "a" * 99_999, "<|endoftext|>" * 50, " " * 3000):
        assert ENC.encode(t) == PUBLIC.encode_ordinary(t)


def test_two_libraries_agree(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{bpe.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = {r.doc_id: r.ids for r in bpe.encode(docs, "text").collect()}
    want = t.encode_batch(list(texts.values()), add_special_tokens=False)
    assert got == {k: w.ids for k, w in zip(texts, want)}


def test_nulls_repeats_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, " ")], "k int, text string").withColumn("ids", F.lit("old"))
    got = sorted((tuple(r) for r in bpe.encode(df, "text").collect()), key=lambda r: r[0] or 9)
    assert got == [(1, []), (2, []), (3, ENC.encode("a b")), (3, ENC.encode("a b")), (None, ENC.encode(" "))]
    assert sorted(r.n_tokens for r in bpe.count_tokens(df.select("k", "text"), "text").collect()) == [0, 0, 1, 2, 2]
    assert bpe.encode(df.limit(0), "text").count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_multi_50k.tiktoken"])
def test_other_vocabularies(name):
    with open(f"{bpe.TOKENIZERS}/{name}", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    other = tiktoken.Encoding("other", pat_str=bpe.WORD, mergeable_ranks=ranks, special_tokens={})
    t = "Önce bahçede duruyor, sonra çay içiyor. Nach einer Pause. 你好 🙂"
    assert bpe.Encoder(f"{bpe.TOKENIZERS}/{name}").encode(t) == other.encode_ordinary(t)
