import random

from pyspark.sql import functions as F

from cuelake.llm import topn
from cuelake.llm.topn import _plan, top_n

NAN, INF = float("nan"), float("inf")


def brute(rows, n):
    out, groups = set(), {}
    for q, v, i, t, s in rows:
        if i is not None and s is not None and t is not None and abs(s) < INF and abs(t) < INF:
            groups.setdefault((q, v), set()).add((-s, t, i))
    for (q, v), g in groups.items():
        out |= {(q, v, i, r) for r, (_, _, i) in enumerate(sorted(g)[:n], 1)}
    return out


def rows(k, hot=0.5):
    rng = random.Random(k)
    out = []
    for i in range(k):
        q = "hot" if rng.random() < hot else rng.choice(["a", "b", "c", None])
        out.append((q, rng.choice(["u", "v"]) if q != "hot" else "u", i, rng.choice([1.0, 2.0, NAN, None, INF, 3.0, 4.0]), rng.choice([0.1, 0.2, 0.9, NAN, None, INF, -INF, 0.5])))
    return out + out[: k // 4]


SCHEMA = "q string, v string, id bigint, t double, s double"


def run(df, n, **kw):
    return {(r.q, r.v, r.id, r["rank"]) for r in top_n(df, ["q", "v"], "s", ["t"], "id", n, **kw).collect()}


def test_equals_brute_force_with_ties_and_repeats(spark):
    data = rows(900) + [(None, None, None, 1.0, 1.0)]
    df = spark.createDataFrame(data, SCHEMA).withColumn("_extra", F.lit(1)).withColumn("rank", F.lit("clash"))
    for n in (1, 5, 40):
        assert run(df, n) == brute(data, n)
    assert run(df, 5, recluster=True) == brute(data, 5)
    assert run(df.limit(0), 5) == set()


def test_shared_hashes_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(topn.F, "xxhash64", lambda *c: F.lit(7).cast("bigint"))
    data = rows(300)
    path_df = spark.createDataFrame(data, SCHEMA)
    assert run(path_df, 3) == brute(data, 3)


def test_hot_row_groups_are_skipped_across_files(spark, monkeypatch):
    monkeypatch.setattr(topn, "ROW_GROUP_ROWS", 1000)
    hot = spark.range(0, 60_000, 1, 4).selectExpr("'hot' q", "cast(null as string) v", "id", "double(id % 97) t", "double(pmod(hash(id), 100000)) s")
    few = spark.range(0, 50, 1, 4).selectExpr("concat('g', id % 9) q", "'u' v", "id + 100000 id", "1.0D t", "double(id % 3) s")
    df = hot.unionByName(few).coalesce(4)
    near, footers, reads = _plan(df, ["q", "v"], "s", ["t"], "id", 5, False)
    assert footers.where("single and q = 'hot'").count() >= 40
    assert reads.count() <= footers.where("not single").count() + footers.where("single and q != 'hot'").count() + 8
    data = [tuple(r) for r in df.collect()]
    assert run(df, 5) == brute(data, 5) and near.count() < 500


def test_ties_at_the_bound_are_read(spark, monkeypatch):
    monkeypatch.setattr(topn, "ROW_GROUP_ROWS", 1000)
    df = spark.range(30_000).selectExpr("'hot' q", "'u' v", "id", "double(30000 - id) t", "1.0D s").coalesce(1)
    assert run(df, 3) == {("hot", "u", 29999 - k, k + 1) for k in range(3)}
    assert _plan(df, ["q", "v"], "s", ["t"], "id", 3, False)[2].count() == 30


def test_group_columns_of_other_types(spark):
    df = spark.createDataFrame([(1, 2**53 + 1, 7, 1.0, 0.5), (None, 2**53 + 1, 8, 1.0, 0.5), (1, 2**53, 9, 1.0, 0.4), (1, None, 10, 1.0, 0.4)], "q int, v bigint, id bigint, t double, s double")
    assert run(df, 1) == {(1, 2**53 + 1, 7, 1), (None, 2**53 + 1, 8, 1), (1, 2**53, 9, 1), (1, None, 10, 1)}
