import random

from pyspark.sql import functions as F

from cuelake.operators import timeline as tl


def kept(spark, values, gap, strictly=False):
    df = spark.createDataFrame([(values,)], "v array<double>")
    return df.select(tl.spaced(F.col("v"), gap, strictly)).first()[0]


def test_greedy_golden(spark):
    assert kept(spark, [25.0, 27.0, 27.0, 70.0, 110.0], 2.05, True) == [25.0, 70.0, 110.0]
    assert kept(spark, [25.0, 27.0, 27.0, 70.0, 110.0], 1.05, True) == [25.0, 27.0, 70.0, 110.0]
    assert kept(spark, [10.01, 12.012], 2.05, True) == [10.01]
    assert kept(spark, [10.0, 11.0, 20.0, 30.0], 6.0) == [10.0, 20.0, 30.0]
    assert kept(spark, [], 6.0) == []


def test_greedy_against_brute_force(spark):
    rng = random.Random(3)
    lists = [[float(rng.randint(0, 60)) for _ in range(rng.randint(0, 25))] for _ in range(50)]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(lists)], "i int, v array<double>").select("i", tl.spaced(F.col("v"), 4.0).alias("k"), tl.regions(F.col("v"), 5.0).alias("r")).collect()
    for r in got:
        want, anchor, n = [], None, 0
        for x in lists[r.i]:
            if all(abs(x - y) >= 4 for y in want):
                want.append(x)
        for x in sorted(lists[r.i]):
            if anchor is None or x - anchor > 5:
                anchor, n = x, n + 1
        assert r.k == want and r.r == n


def test_nearest_against_brute_force(spark):
    rng = random.Random(4)
    frames = [(v, i, float(t), f"{v}{i}") for v in "ab" for i, t in enumerate(sorted(rng.sample(range(100), 9)))]
    points = [(rng.choice("abc"), i, rng.choice([5.5, 50.0, rng.uniform(-10, 120)])) for i in range(80)] + [("a", 99, None)]
    f = spark.createDataFrame(frames, "v string, i int, ts double, thumb string")
    p = spark.createDataFrame(points, "v string, id int, at double")
    got = {r.id: r.thumb for r in tl.nearest(p, f, "v", "at", "ts", ["thumb"]).collect()}
    assert len(got) == len(points)
    for v, i, at in points:
        mine = [x for x in frames if x[0] == v]
        if at is not None:
            assert got[i] == (min(mine, key=lambda x: (abs(x[2] - at), x[1]))[3] if mine else None)


def test_windows(spark):
    w = tl.merged_windows(spark.createDataFrame([("q", 1.0, 10.0), ("q", 9.0, 10.0), ("r", 1.0, 30.0), ("r", 20.0, 30.0)], "q string, ts double, d double"), ["q"], "ts", 4.0, "d")
    assert sorted(map(tuple, w.collect())) == [("q", 0.0, 10.0), ("r", 0.0, 5.0), ("r", 16.0, 24.0)]
    g = {(r.q, r.ts) for r in tl.grid(w, ["q"], 5.0).collect()}
    assert g == {("q", 0.0), ("q", 5.0), ("q", 10.0), ("r", 0.0), ("r", 5.0), ("r", 20.0)}
    m = spark.createDataFrame([("a", 10.0), ("b", 3.0), ("c", 0.0), ("d", None)], "k string, d double")
    rows = tl.sliding_windows(m, "k", "d", 4.0, 2.0, 2).orderBy("k", "n").collect()
    assert [(r.k, r.start, r.end) for r in rows] == [("a", 0.0, 4.0), ("a", 2.0, 6.0), ("a", 4.0, 8.0), ("a", 6.0, 10.0), ("b", 0.0, 3.0)]
    assert rows[0].samples == [1.0, 3.0]


def test_sampling_and_relations(spark):
    s = tl.sampled(spark.createDataFrame([("v", float(t)) for t in (1, 2, 9, 10, 30)], "v string, ts double"), "v", "ts", 5.0)
    assert [r.ts for r in s.where("selected").orderBy("ts").collect()] == [1.0, 9.0, 30.0]
    r = spark.createDataFrame([(5.0, 0.0, 5.0, None)], "t double, s double, e double, n double")
    got = r.select(tl.inside(F.col("t"), F.col("s"), F.col("e")), tl.inside_closed(F.col("t"), F.col("s"), F.col("e")), tl.overlap_closed(F.col("t"), F.col("n"), F.col("s"), F.col("e"))).first()
    assert tuple(got) == (False, True, True)
    p = spark.createDataFrame([("q", 1, 0.0), ("q", 2, 10.0), ("q", 3, 10.1), ("q", 4, 31.0)], "q string, id int, ts double")
    assert {(x.a, x.b) for x in tl.neighbours_within(p, ["q"], "ts", "id", 10.0).collect()} == {(1, 2), (2, 3)}


def test_nearest_equals_brute_force_across_blocks(spark):
    rng = random.Random(7)
    frames = [(rng.choice("ab"), float(rng.choice([0, 3, 700, 701, 5000, rng.randint(0, 2000)])), i) for i in range(60)]
    frames = list({(g, t): (g, t, i) for g, t, i in frames}.values()) + [("a", None, 998), ("a", float("nan"), 999)]
    points = [(rng.choice("abc"), float(rng.choice([0, 350.5, 4000, rng.randint(0, 6000)])), i) for i in range(200)] + [("a", None, 900), ("a", float("inf"), 901), (None, 1.0, 902)]
    f = spark.createDataFrame(frames, "g string, ts double, n int")
    p = spark.createDataFrame(points, "g string, at double, i int").withColumn("_b", F.lit(1))
    got = {r.i: r.n for r in tl.nearest(p, f, "g", "at", "ts", ["n"]).collect()}
    want = {}
    for g, at, i in points:
        mine = sorted((abs(t - at), t, n) for h, t, n in frames if h == g and t is not None and t == t) if at is not None and at < float("inf") else []
        want[i] = mine[0][2] if mine else None
    assert got == want


def test_overlapping_equals_brute_force(spark):
    rng = random.Random(9)
    mk = lambda k: [(rng.choice("xy"), i, s := float(rng.randint(0, 500)), s + rng.choice([0, 1, 32, 200])) for i in range(k)]
    a, b = mk(80), mk(80)
    odd = [("x", 900, None, 5.0), ("x", 901, 9.0, 5.0), ("x", 902, float("nan"), 5.0), (None, 903, 0.0, 900.0)]
    da, db = (spark.createDataFrame(r + odd, f"g string, {n} int, {n}s double, {n}e double") for r, n in ((a, "i"), (b, "k")))
    rows = tl.overlapping(da, db, ["g"], ("is", "ie"), ("ks", "ke")).select("i", "k").collect()
    got = {tuple(r) for r in rows}
    assert len(rows) == len(got) == sum(1 for _ in got) and got == {(i, k) for g, i, s, e in a for h, k, s2, e2 in b if g == h and s <= e2 and e >= s2}
