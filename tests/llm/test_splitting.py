import random

import pytest
from pyspark.sql import functions as F

from cuelake.llm.splitting import split_oversized

WORDS = ["a", "moment", "später.", "şey,", "naïve;", "🇹🇷", "x" * 40, "end!\n", "para.\n\n", "tab\t", "cr\r\n\r\n", " ", "word word"]


def texts():
    rng = random.Random(7)
    out = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 700))) for _ in range(40)]
    out += ["y" * k for k in (899, 900, 901, 1801)] + ["a " + "y" * k + " b" for k in (811, 850, 900, 901, 2000)]
    out += [" " * 1000, "\n" * 950, "s. " * 400 + "z" * 890, "🙂" * 905, "d" * 120 + " " + "e" * 850, "", "q" * 500_000]
    return out


def runs(t):
    best = n = 0
    for ch in t:
        n = 0 if ch in " \t\n\r" else n + 1
        best = max(best, n)
    return best


def test_pieces_cover_and_carry(spark):
    data = texts()
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(data)], "id int, text string, piece string")
    for r in split_oversized(df, "text").collect():
        t = data[r.id]
        assert len(r.pieces) == (0 if not t else len(r.pieces))
        assert "".join(p.text[p.overlap:] for p in r.pieces) == t
        assert [p.piece_no for p in r.pieces] == list(range(1, len(r.pieces) + 1))
        for a, b in zip(r.pieces, r.pieces[1:]):
            assert b.overlap <= 90 and a.text.endswith(b.text[: b.overlap])
        assert all(0 < len(p.text) <= 900 for p in r.pieces)
        assert r.cut_kind == ("whole" if len(t) <= 900 else "forced" if runs(t) > 900 else "natural")


def test_overlap_at_natural_cuts(spark):
    t = "One two three four. " * 100
    (r,) = split_oversized(spark.createDataFrame([(t,)], "text string"), "text").collect()
    assert all(p.overlap > 40 and p.text[0].isalpha() for p in r.pieces[1:])
    assert all(p.text.endswith(". ") for p in r.pieces)


@pytest.mark.parametrize("limit,overlap", [(20, 0), (50, 10)])
def test_other_limits_and_nulls(spark, limit, overlap):
    df = spark.createDataFrame([(None,), ("",), ("abc def ghi " * 20,), ("abc def ghi " * 20,)], "text string")
    got = split_oversized(df, "text", limit, overlap).collect()
    assert [len(r.pieces) for r in got[:2]] == [0, 0] and got[2].pieces == got[3].pieces
    assert all(len(p.text) <= limit for p in got[2].pieces)
    assert split_oversized(df.limit(0), "text").count() == 0


def test_no_shuffle_and_no_repeated_regex(spark):
    df = split_oversized(spark.createDataFrame([("a",)], "text string"), "text").select(F.inline_outer("pieces"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and plan.count("regexp_extract_all") == 1
