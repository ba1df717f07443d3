import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cuelake.llm.packing import fullest, pack, plan


def best_sum(room, counts):
    sums = {0}
    for s, n in counts.items():
        for _ in range(n):
            sums |= {x + s for x in sums if x + s <= room}
    return max(sums)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 60), st.dictionaries(st.integers(1, 30), st.integers(0, 5), max_size=8))
def test_fullest_equals_brute_force(room, counts):
    used = fullest(room, counts)
    assert all(n <= counts[s] for s, n in used.items())
    assert sum(s * n for s, n in used.items()) == best_sum(room, counts)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(0, 200), max_size=20))
def test_plan_places_all_within_capacity(counts):
    fills = plan(counts, 50)
    placed = {}
    for f in fills:
        assert f.times > 0 and sum(s * n for s, n in f.sizes.items()) <= 50
        for s, n in f.sizes.items():
            placed[s] = placed.get(s, 0) + n * f.times
    assert placed == {s: n for s, n in counts.items() if n}


def test_plan_leaves_little_unused():
    rng = random.Random(2)
    counts = {}
    for _ in range(20_000):
        s = min(2048, int(rng.lognormvariate(5.3, 0.9)) + 1)
        counts[s] = counts.get(s, 0) + 1
    fills = plan(counts)
    total = sum(s * n for s, n in counts.items())
    assert sum(f.times for f in fills) <= -(-total // 2048) + 1 and len(fills) < 4096


def test_pack(spark):
    rng = random.Random(9)
    sizes = [rng.choice([0, None, 1, 3, 7, 7, 7, 11, 40, 100, 101, 250, 1000]) for _ in range(700)]
    df = spark.createDataFrame([*enumerate(sizes), (None, 5)], "k bigint, n bigint").withColumn("size", F.lit("clash"))
    got = pack(df.select("k", "n"), "k", "n", 100).collect()
    per = {}
    for r in got:
        per.setdefault(r.container_id, []).append(r)
        assert r.size <= 100 and r.offset == 100 * r.piece_no
    assert all(sum(r.size for r in v) <= 100 for v in per.values())
    assert sorted(per) == list(range(len(per)))
    back = {}
    for r in got:
        back[r.k] = back.get(r.k, 0) + r.size
    assert back == {k: n for k, n in enumerate(sizes) if n}
    assert all(len({r.piece_no for r in got if r.k == k}) == -(-n // 100) for k, n in back.items())
    assert len(per) - -(-sum(back.values()) // 100) <= 1
    assert pack(df.select("k", "n").limit(0), "k", "n", 100).count() == 0


def test_found_places_all_documents(spark):
    from cuelake.llm import packing

    d = "/root/testdata/sf0.001"
    df = packing.found(spark, d)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "place(" in plan and "container_id" in plan
    long = packing.token_counts(spark, d).where(f"n_tokens > {packing.CAPACITY}")
    assert {r.doc_id for r in df.collect()} == {r.doc_id for r in long.collect()}
    assert packing.faults(spark, d).count() == 0
