import math
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from cuelake.operators import routing as rt
from cuelake.operators import text as tx
from cuelake.operators.fusion import VARIANTS, fuse, interleaved, preserved, quota, rescored, variants
from cuelake.operators.text import STOP, bm25, jaccard, stems, tf_idf, tokens, topic_terms
from cuelake.operators.vectors import adjacent_change, encode, mean_vector, normalized, scenes, top_k, valid


def words(t):
    return [w for w in re.findall(r"\w+", t.casefold()) if w not in STOP]


def test_tokens_equal_python(spark):
    texts = ["Élan naïve Straße", "İSTANBUL'da ısı", "The a_b 12 FIND", "", "日本 語"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(tokens(F.col("t"))).collect()
    assert [r[0] for r in got] == [words(t) for t in texts]


def test_bm25_equals_definition(spark):
    rng = random.Random(1)
    docs = {("v1", i): " ".join(rng.choice("red lamp box old the map of".split()) for _ in range(rng.randint(0, 9))) for i in range(20)}
    docs |= {("v2", i): "red red lamp" for i in range(3)}
    asked = {("v1", "q1"): "red old RED box", ("v1", "q2"): "the of", ("v2", "q3"): "lamp nothing", ("v3", "q4"): "red"}
    d = spark.createDataFrame([(*k, t) for k, t in docs.items()], "c string, d int, t string").select("c", "d", tokens(F.col("t")).alias("tokens"))
    q = spark.createDataFrame([(*k, t) for k, t in asked.items()], "c string, q string, t string").select("c", "q", tokens(F.col("t")).alias("tokens"))
    got = {(r.q, r.d): r.score for r in bm25(d, q, ["c"], "d", "q").collect()}
    want = {}
    for (c, q_), text in asked.items():
        mine = {i: words(t) for (v, i), t in docs.items() if v == c}
        avg = (sum(map(len, mine.values())) / max(1, len(mine))) or 1
        for i, ws in mine.items():
            s = 0.0
            for term in set(words(text)):
                df = sum(term in x for x in mine.values())
                tf = ws.count(term)
                s += math.log(1 + (len(mine) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ws) / avg))
            if s > 0:
                want[q_, i] = s
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert bm25(d.limit(0), q, ["c"], "d", "q").count() == 0


def test_sets_stems_topics(spark):
    df = spark.createDataFrame([([], [], "Stories saying boxes ended a sing"), (["a", "b"], ["b", "c"], "")], "a array<string>, b array<string>, t string")
    r = df.select(jaccard(F.col("a"), F.col("b")).alias("j"), stems(F.col("t")).alias("s")).collect()
    assert [x.j for x in r] == [1.0, 1 / 3] and r[0].s == ["story", "boxe", "end", "sing"] and r[1].s == []
    t = spark.createDataFrame([(1, "lamp map lamp the and with map zoo"), (2, None)], "k int, t string")
    assert [(x.k, x.terms) for x in topic_terms(t, ["k"], "t", 2).collect()] == [(1, ["lamp", "map"])]


def test_tf_idf(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["a", "c"]), (3, ["b", "a"])], "d int, terms array<string>")
    got = {(r.d, r.term): r.value for r in tf_idf(docs, "d", 10).collect()}
    ia, ib = math.log(4 / 4) + 1, math.log(4 / 3) + 1
    n = math.hypot(ia, ib)
    assert got.keys() == {(1, "a"), (1, "b"), (2, "a"), (3, "a"), (3, "b")} and abs(got[1, "b"] - ib / n) < 1e-12 and got[2, "a"] == 1.0


def test_vectors(spark):
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(60)] + [(90, [0.0] * 4), (91, None), (92, [float("nan")] * 4), (93, [])]
    df = spark.createDataFrame(rows, "id bigint, v array<float>")
    assert {r.id for r in df.where(valid(F.col("v"))).collect()} == set(range(60))
    assert all(abs(sum(x * x for x in r.u) - 1) < 1e-6 for r in df.select(normalized(F.col("v")).alias("u")).collect() if r.u)
    vec = {r.id: list(r.v) for r in df.collect() if r.id < 60}
    q = df.where("id % 20 = 0").withColumnRenamed("id", "q")
    got = {}
    for r in top_k(df, q, "id", "q", "v", 5, block=7).collect():
        got.setdefault(r.q, {})[r["rank"]] = r.id
    for k, ranks in got.items():
        want = sorted(vec, key=lambda i: (-round(sum(a * b for a, b in zip(vec[i], vec[k])), 9), i))[:5]
        assert [ranks[i] for i in range(1, 6)] == want
    assert set(got) == {0, 20, 40} and top_k(df.limit(0), q, "id", "q", "v", 5).count() == 0
    m = mean_vector(spark.createDataFrame([(1, [1.0, 3.0]), (1, [3.0, 5.0])], "g int, v array<double>"), ["g"], "v").first()
    assert m.centroid == [2.0, 4.0]


def test_scenes_and_change(spark):
    df = spark.createDataFrame([("a", 1, [1.0, 0.0]), ("a", 2, [1.0, 0.0]), ("a", 3, [0.0, 1.0]), ("b", 1, [1.0, 0.0])], "g string, o int, v array<double>")
    assert [r.scene for r in scenes(df, "g", "o", "v", 0.5).orderBy("g", "o").collect()] == [0, 0, 1, 0]
    assert [r.change for r in adjacent_change(df, "g", "o", "v").orderBy("g", "o").collect()] == [0.0, 1.0, 1.0, 0.0]


def test_encoder_boundary(spark):
    import numpy as np

    df = encode(spark.createDataFrame([("ab",), (None,), ("",)], "t string"), "t", lambda ts: np.array([[len(t), 1] for t in ts], float))
    assert [r.embedding for r in df.collect()] == [[2.0, 1.0], None, [0.0, 1.0]]


LANES = [
    ("q", "visual", 1, "a", 0.9, 10.0, None, None), ("q", "visual", 2, "b", 0.8, 20.0, None, None), ("q", "visual", 3, "c", 0.7, 30.0, None, None),
    ("q", "speech", 1, "b", 5.0, 21.0, 25.0, "said"), ("q", "speech", 2, "b", 4.0, 22.0, 26.0, "again"), ("q", "speech", 3, "d", 3.0, 40.0, 44.0, "last"),
]
SCHEMA = "query_id string, lane string, rank bigint, thumbnail string, score double, ts double, end double, text string"


def test_fusion_golden(spark):
    f = fuse(spark.createDataFrame(LANES, SCHEMA), ["query_id"]).orderBy("fused_rank").collect()
    assert [r.thumbnail for r in f] == ["b", "a", "c", "d"]
    assert abs(f[0].score - (1 / 62 + 1 / 61)) < 1e-12 and f[0].ts == 21.0 and f[0].text == "said" and f[0].modality == "visual+speech"
    assert abs(f[3].score - 1 / 63) < 1e-12 and f[1].modality == "visual" and f[1].end is None
    assert fuse(spark.createDataFrame([], SCHEMA), ["query_id"]).count() == 0


def test_selection_variants(spark):
    fused = fuse(spark.createDataFrame(LANES, SCHEMA), ["query_id"])
    order = lambda df: [r.thumbnail for r in df.orderBy("rank").collect()]
    assert order(quota(fused, ["query_id"], 1, 2)) == ["b", "a"]
    assert order(quota(fused, ["query_id"], 2, 4)) == ["b", "a", "d", "c"]
    assert order(interleaved(fused, ["query_id"], "visual", 4)) == ["a", "b", "d", "c"]
    assert order(preserved(fused, ["query_id"], 1, 4)) == ["b", "a", "c", "d"]
    assert {r.thumbnail for r in quota(fused, ["query_id"], 1, 2).collect()} == {r.thumbnail for r in preserved(fused, ["query_id"], 1, 2).collect()}
    v = variants(spark.createDataFrame(LANES, SCHEMA), ["query_id"], 4).collect()
    assert {r.variant for r in v} == {n for n, _, _ in VARIANTS}
    assert [r.thumbnail for r in sorted((r for r in v if r.variant == "baseline_rrf60"), key=lambda r: r["rank"])] == ["b", "a", "c", "d"]
    x = spark.createDataFrame([("q", 1, 0.1), ("q", 2, 0.9), ("q", 3, None), ("q", 4, 0.9)], "query_id string, rank bigint, s double")
    assert [r["rank"] for r in rescored(x, ["query_id"], "s", "rank", "new").orderBy("new").collect()] == [2, 4, 1, 3]


def turkish(spark, text, language=None):
    low = rt.turkish_lower(F.col("t"))
    r, why = rt.turkish_route(rt.turkish_counts(F.col("t"), low))
    df = spark.createDataFrame([(text, language)], "t string, l string")
    return df.select(low.alias("low"), rt.turkish_words(F.col("t")).alias("words"), r.alias("route"), why.alias("why"), rt.adapted_visual(low).alias("visual"), rt.adapted_speech(low, F.col("l")).alias("speech"), F.array(*rt.turkish_features(F.col("t"), low)).alias("f")).first()


def test_turkish_requests(spark):
    assert turkish(spark, unicodedata.normalize("NFD", "İSTANBUL IŞIK")).low == "istanbul ışık"
    mixed = turkish(spark, "Python'dan ve API'yi anlattığı yer")
    assert mixed.words[:2] == ["python'dan", "ve"] and mixed.visual == "python ve api"
    assert turkish(spark, "veritabanını açıkladığı kısmı bul").route == "SPEECH"
    assert turkish(spark, "ekranda ayarlar menüsünün açık olduğu bölüm").route == "VISUAL"
    both = turkish(spark, "dashboard'u gösterirken API'yi anlattığı yer")
    assert both.route == "HYBRID" and both.why == ["turkish_speech_intent", "visual_context"]
    assert turkish(spark, "model kısmı").why == ["ambiguous"]
    assert turkish(spark, "Python'dan bahsettiği yeri bul", "en").speech == turkish(spark, "Python'dan bahsettiği yeri bul", "tr").speech == "python"
    assert "screen" in turkish(spark, "ekrandaki mavi kutuyu göster").visual
    assert turkish(spark, "Where does she explain the API?").low == "where does she explain the api?"
    # a name in capitals keeps its i, a single capital doesn't; digits and marks may follow, letters may not
    assert turkish(spark, "HTTP/II I APIs C++ .NETI").low == "http/ii ı apıs c++ .neti"


def test_turkish_features(spark):
    f = turkish(spark, "Bul: ekran'da adamı anlatırken API?").f
    assert f == [1.0, math.log(6), 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 0.0, 1.0, 1.0, 0.0]
    assert turkish(spark, "hangi bölüm").f[13] == 1.0
    empty = turkish(spark, "")
    assert empty.words == [] and empty.visual == "" and empty.route == "HYBRID" and turkish(spark, None).low is None


def test_top_k_by_group_equals_brute_force(spark):
    rng = random.Random(6)
    vec = lambda w=3: [float(rng.randint(-2, 2)) or 1.0 for _ in range(w)]
    items = [(rng.choice(["hot", "hot", "a", "b", "c"]), i, vec()) for i in range(120)] + [("a", 500, vec(2)), ("a", 501, None), ("a", 502, [0.0, 0.0, 0.0]), (None, 503, vec()), ("a", None, vec())]
    queries = [(rng.choice(["hot", "a", "b", "none"]), 1000 + i, vec()) for i in range(40)] + [("a", 2000, vec(2)), (None, 2001, vec())]
    di = spark.createDataFrame(items, "g string, id int, v array<double>").withColumns({"_i": F.lit(5), "rank": F.lit(0)})
    dq = spark.createDataFrame(queries, "g string, q int, v array<double>")
    want = set()
    for g, q, v in queries:
        mine = sorted((-round(sum(x * y for x, y in zip(v, w)), 9), i) for h, i, w in items if h == g and g and i is not None and w and any(w) and len(w) == len(v))
        want |= {(g, q, i, -s, r) for r, (s, i) in enumerate(mine[:5], 1)}
    for block in (4096, 7):
        got = {(r.g, r.q, r.id, r.score + 0.0, r["rank"]) for r in top_k(di, dq, "id", "q", "v", 5, ["g"], block=block).collect()}
        assert got == want
    assert top_k(di.limit(0), dq, "id", "q", "v", 5, ["g"]).count() == top_k(di, dq.limit(0), "id", "q", "v", 5, ["g"]).count() == 0


@pytest.mark.parametrize("key_words,short", [(3, 40), (1, 40), (3, 6), (2, 0)])
def test_overlapping_sets(spark, monkeypatch, key_words, short):
    monkeypatch.setattr(tx, "KEY_WORDS", key_words)
    monkeypatch.setattr(tx, "SHORT_SET", short)
    rng, names = random.Random(5), "abcdefghijklmnop"
    sets = [rng.sample(names, rng.randint(0, 14)) for _ in range(40)] + [list(names), list(names[:-1]), list(names[:5]), list(names[:4]), ["a"], ["a"], ["b", "a"], [], None]
    sets += [rng.sample(x, len(x)) for x in sets[:20]]
    mk = lambda name: spark.createDataFrame([(i, s) for i, s in enumerate(sets)], f"{name} int, tokens array<string>")
    want = {}
    for i, x in enumerate(sets):
        for k, y in enumerate(sets):
            if x is not None and y is not None and (not x and not y or 5 * len({*x} & {*y}) >= 4 * len({*x} | {*y})):
                want[i, k] = round(len({*x} & {*y}) / len({*x} | {*y}), 6) if x else 1.0
    df = tx.overlapping_sets(mk("left_id"), mk("right_id"))
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(want) and {(i, k): v for i, k, v in got} == want
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "dropDuplicates" not in plan and "Aggregate" not in plan  # pairs are not shuffled once more to be distinct
