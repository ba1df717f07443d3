import random

from pyspark.sql import functions as F

from cuelake.operators import blocks, intervals
from cuelake.operators.intervals import counting, spans


def brute(rows):
    out = set()
    for k in {r[0] for r in rows}:
        merged = []
        for s, e in sorted((s, e) for i, s, e in rows if i == k):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out |= {(k, "period", s, e) for s, e in merged}
        out |= {(k, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:])}
    return out


def run(spark, rows):
    iv = spark.createDataFrame(rows, "id string, s bigint, e bigint")
    return {tuple(r) for r in spans(iv, ["id"]).select("id", "span_kind", "start_ms", "end_ms").collect()}


def test_spans_equal_brute_force(spark):
    rng = random.Random(4)
    rows = [(rng.choice("abcd"), s, s + rng.randint(1, 40)) for s in (rng.randint(0, 900) for _ in range(160))]
    rows += rows[:20] + [("e", 5, 9)] + [("f", 0, 3), ("f", 3, 4)]
    assert run(spark, rows) == brute(rows)


def test_blocks_smaller_than_groups(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BITS", 3)
    monkeypatch.setattr(intervals, "BITS", 3)
    rng = random.Random(5)
    rows = [("hot", s, s + rng.randint(1, 9)) for s in (rng.randint(0, 4000) for _ in range(300))]
    assert run(spark, rows) == brute(rows)


def test_faulty_bounds_and_empty(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("a", 0.0004, 1.0), ("a", 1.0, 2.0), ("a", nan, 3.0), ("a", 0.0, inf), ("a", None, 9.0), ("a", -1.0, 9.0), ("a", 5.0, 5.0004), ("a", 7.0, 6.0), (None, 1.0, 2.0), ("b", 1e300, 2e300), ("b", 1.0, 1e18)]
    df = spark.createDataFrame(rows, "id string, s double, e double")
    got = counting(df.withColumn("done", F.lit("clash")), ["id"], F.col("s"), F.col("e")).collect()
    assert sorted(map(tuple, got)) == [("a", 0, 1000), ("a", 1000, 2000)]
    assert spans(counting(df.limit(0), ["id"], F.col("s"), F.col("e")), ["id"]).count() == 0


def test_skew_join(spark, monkeypatch):
    monkeypatch.setattr(blocks, "HOT_ROWS", 10)
    left = spark.range(200).selectExpr("if(id % 3 = 0, 'hot', concat('k', id % 60)) k", "id")
    right = left.select("k").distinct().where("k != 'k1'").selectExpr("k", "hash(k) v")
    assert blocks.hot_keys(left.where("k != 'hot'"), ["k"]) is None
    hot = blocks.hot_keys(left, ["k"])
    assert [r.k for r in hot.collect()] == ["hot"]
    want = sorted(map(tuple, left.join(right, ["k"]).collect()))
    assert sorted(map(tuple, blocks.skew_join(left, right, ["k"], hot).collect())) == want
    assert sorted(map(tuple, blocks.skew_join(left, right, ["k"], None).collect())) == want
    outer = sorted(map(tuple, left.join(right.where("k != 'hot'"), ["k"], "left").collect()), key=repr)
    assert sorted(map(tuple, blocks.skew_join(left, right.where("k != 'hot'"), ["k"], hot, "left").collect()), key=repr) == outer
    monkeypatch.setattr(blocks, "HOT_ROWS", 1_000_000)
    assert blocks.hot_keys(left, ["k"]) is None
