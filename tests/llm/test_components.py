import random
import unicodedata

from pyspark.sql import functions as F

from cuelake.llm.components import assign, components, file_hash, found, group_name, split_name, tied
from cuelake.operators import blocks


def brute(pairs):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {x: root(x) for x in up}


def run(spark, pairs):
    return {r.n: r.component for r in components(spark.createDataFrame(pairs, "a string, b string")).collect()}


def test_components_equal_union_find(spark):
    rng = random.Random(8)
    pairs = [(f"n{rng.randint(0, 80)}", f"n{rng.randint(0, 80)}") for _ in range(60)]
    pairs += pairs[:5] + [("loop", "loop")]
    assert run(spark, pairs) == brute(pairs)


def test_hot_values(spark, monkeypatch):
    monkeypatch.setattr(blocks, "HOT_ROWS", 20)
    test_long_chain_and_hub(spark)
    test_tied_and_assigned(spark)


def test_long_chain_and_hub(spark):
    pairs = [(f"c{i:03}", f"c{i + 1:03}") for i in range(120)] + [("hub", f"leaf{i}") for i in range(500)]
    assert run(spark, pairs) == brute(pairs)
    assert run(spark, [(None, "x")]) == {}


def test_names(spark):
    nfd = unicodedata.normalize("NFD", "Zékra  Forel")
    rows = [("zékra-forel",), (nfd,), (" ZÉKRA__forel ",), ("Unknown ",), ("N/A",), (" ",), (None,), ("unspecified",)]
    got = [r[0] for r in spark.createDataFrame(rows, "g string").select(group_name(F.col("g"))).collect()]
    assert got == ["zékra forel"] * 3 + [None] * 5
    hashes = spark.createDataFrame([("AB",), ("ab ",), ("000",), (None,), ("",)], "h string")
    assert [r[0] for r in hashes.select(file_hash(F.col("h"))).collect()] == ["ab", "ab", None, None, None]
    assert [r[0] for r in spark.createDataFrame([(" Held-Out",), ("held_out",), (None,)], "s string").select(split_name(F.col("s"))).collect()] == ["heldout", "heldout", None]


def records(k):
    rng = random.Random(k)
    return [(f"v{i:04}", rng.choice(["hot", None, f"g{rng.randint(0, 60)}"]) if i % 3 else "hot", rng.choice([None, f"s{rng.randint(0, 300)}"])) for i in range(k)]


def test_tied_and_assigned(spark):
    data = records(400)
    df = spark.createDataFrame(data + data[:30] + [(None, "hot", "s1")], "id string, g string, f string").withColumns({"n": F.lit(1), "a": F.lit("clash")})
    sets = tied(df, "id", ["g", "f"])
    got = {r.id: r.set_id for r in sets.collect()}
    links = [(("k", i), (t, v)) for i, g, f in data for t, v in (("g", g), ("f", f)) if v]
    roots = brute(links)
    want = {}
    for i, g, f in data:
        want.setdefault(roots.get(("k", i), i), []).append(i)
    assert got == {i: min(v) for v in want.values() for i in v}
    targets = spark.createDataFrame([("train", 0.7), ("validation", 0.15), ("test", 0.15), ("off", 0.0)], "split_name string, proportion double")
    out = assign(sets, "id", targets).collect()
    assert len(out) == 400 and len({(r.set_id, r.assigned) for r in out}) == len(want)
    assert tied(df.limit(0), "id", ["g", "f"]).count() == 0
    assert assign(tied(df.limit(0), "id", ["g", "f"]), "id", targets).count() == 0


def test_proportions(spark):
    sets = spark.range(5000).selectExpr("id", "string(id div 3) set_id")
    targets = spark.createDataFrame([("train", 0.7), ("validation", 0.15), ("test", 0.15)], "split_name string, proportion double")
    share = {r.assigned: r["count"] / 5000 for r in assign(sets, "id", targets).groupBy("assigned").count().collect()}
    assert abs(share["train"] - 0.7) < 0.002 and abs(share["test"] - 0.15) < 0.002


def test_found_against_brute_force(spark):
    d = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{d}/videos.parquet").select("video_id", "source_group", "source_sha256", "split").distinct().collect()

    def norm(g):
        g = " ".join((unicodedata.normalize("NFC", g).casefold() if g else "").replace("-", " ").replace("_", " ").split())
        return None if g in ("", "unspecified", "unknown", "n/a") else unicodedata.normalize("NFC", g)

    links = []
    for r in rows:
        s = (r.source_sha256 or "").lower().strip()
        links += [(("k", r.video_id), t) for t in ((("g", norm(r.source_group)) if norm(r.source_group) else None), (("s", s) if s.strip("0") else None)) if t]
    roots, sets = brute(links), {}
    for r in rows:
        sets.setdefault(roots.get(("k", r.video_id), r.video_id), []).append(r)
    want = set()
    for v in sets.values():
        if len({(r.split or "").lower().replace("-", "").replace("_", "").replace(" ", "") for r in v if r.split}) > 1:
            want |= {(r.video_id, min(x.video_id for x in v)) for r in v}
    assert {tuple(r) for r in found(spark, d).select("video_id", "set_id").collect()} == want and want
