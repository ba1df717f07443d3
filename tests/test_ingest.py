import base64

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuelake.operators import ingest as ig
from cuelake.operators import vectors as vc


def test_probe(spark):
    nan = float("nan")
    rows = [(1, 25.0, 250.0, 1920.0, 1080.0), (2, 0.0, 250.0, 1.0, 1.0), (3, 25.0, nan, 1.0, 1.0), (4, None, 1.0, 1.0, 1.0), (5, 1.0, 4000.0, 1.0, 1.0), (6, 25.0, 250.0, 7680.0, 4320.0), (7, 25.0, float("inf"), 1.0, 1.0)]
    df = spark.createDataFrame(rows, "i int, fps double, n double, w double, h double").withColumn("cc", F.lit(0x31637661))
    got = {r.i: (r.duration, r.codec, r.refused) for r in ig.probed(df, "fps", "n", "w", "h", "cc").collect()}
    assert got == {1: (10.0, "avc1", None), 2: (None, "avc1", "no_stream"), 3: (None, "avc1", "no_stream"), 4: (None, "avc1", "no_stream"), 5: (4000.0, "avc1", "too_long"), 6: (10.0, "avc1", "too_large"), 7: (None, "avc1", "no_stream")}


@pytest.mark.parametrize("name,declared,size,free,status", [
    ("a.MP4", None, 10, 100, 200), ("a.txt", None, 10, 100, 415), (".mp4", None, 10, 100, 415), ("a/b.c.mkv", "10", 10, 100, 200), ("a.mp4", "ten", 10, 100, 400), ("a.mp4", str(2 << 30), 10, 1 << 40, 413),
    ("a.mp4", "90", 10, 100, 507), ("a.mp4", "-5", 10, 100, 200), ("a.mp4", None, 2 << 30, 1 << 40, 413), ("a.mp4", None, 85, 100, 507), ("a.mp4", None, 0, 100, 400), ("a.mp4", None, None, 100, 400),
])
def test_upload_status(spark, name, declared, size, free, status):
    df = spark.createDataFrame([(name, declared, size, free)], "n string, d string, s bigint, f bigint")
    assert df.select(ig.upload_status(F.col("n"), F.col("d"), F.col("s"), F.col("f"))).first()[0] == status


@pytest.mark.parametrize("location,want", [("https://b.example/x", "https://b.example/x"), ("//c.example/y?z=1", "https://c.example/y?z=1"), ("/root", "https://a.example/root"), ("side.mp4", "https://a.example/p/q/side.mp4")])
def test_joined(spark, location, want):
    df = spark.createDataFrame([("https://a.example/p/q/r.mp4?s=1", location)], "b string, l string")
    assert df.select(ig.joined(F.col("b"), F.col("l"))).first()[0] == want


@pytest.mark.parametrize("answers,url,outcome", [
    ([(200, None, 5)], "https://a.example/x/v.mp4", "fetched"), ([(302, "w.mp4", 0), (200, None, 5)], "https://a.example/x/w.mp4", "fetched"), ([(302, "http://10.0.0.1/v", 0), (200, None, 5)], "http://10.0.0.1/v", "refused"),
    ([(302, None, 0)], "https://a.example/x/v.mp4", "no_location"), ([(503, None, 0)], "https://a.example/x/v.mp4", "unavailable"), ([(429, None, 0)], "https://a.example/x/v.mp4", "unavailable"), ([(404, None, 0)], "https://a.example/x/v.mp4", "inaccessible"),
    ([(200, None, 2 << 30)], "https://a.example/x/v.mp4", "too_large"), ([(200, None, 0)], "https://a.example/x/v.mp4", "empty"), ([], "https://a.example/x/v.mp4", "no_answer"), ([(301, "v.mp4", 0)] * 6 + [(200, None, 5)], "https://a.example/x/v.mp4", "redirect_limit"),
    ([(301, "v.mp4", 0)] * 5 + [(200, None, 5)], "https://a.example/x/v.mp4", "fetched"),
])
def test_followed(spark, answers, url, outcome):
    df = spark.createDataFrame([("https://a.example/x/v.mp4", answers)], "u string, a array<struct<status:int,location:string,bytes:bigint>>")
    r = df.select(ig.followed(F.col("u"), F.col("a")).alias("x")).select("x.*").first()
    assert (r.url, r.outcome) == (url, outcome)


def test_access(spark):
    basic = lambda t: "Basic " + base64.b64encode(t).decode()
    cases = [
        ("GET", "/v", None, "Bearer s", 200), ("GET", "/v", None, "Bearer x", 401), ("GET", "/v", None, None, 401), ("GET", "/health", None, None, 200), ("OPTIONS", "/v", "https://bad", None, 200), ("POST", "/v", "https://bad", "Bearer s", 403),
        ("POST", "/v", "https://ok", "Bearer s", 200), ("POST", "/v", "", "Bearer s", 200), ("GET", "/v", "https://bad", "Bearer s", 200), ("GET", "/v", None, basic(b"u:s"), 200), ("GET", "/v", None, basic(b"u:t"), 401), ("GET", "/v", None, basic(b"w:s"), 401),
        ("GET", "/v", None, "Basic %%", 401), ("GET", "/v", None, basic(b"\xff\xfe"), 401), ("GET", "/v", None, "Digest s", 401),
    ]
    df = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(cases)], "i int, m string, p string, o string, a string")
    run = lambda token: [r[0] for r in df.orderBy("i").select(ig.access_status(F.col("m"), F.col("p"), F.col("o"), F.col("a"), ["https://ok"], "u", token)).collect()]
    assert run("s") == [c[4] for c in cases]
    assert set(run("")) == {200, 403}


def test_called(spark):
    def send(text, attempt):
        return {"late": (None, None), "busy": (429, None) if attempt < 2 else (200, "ok"), "down": (503, None), "bad": (400, None)}.get(text, (201, text))

    df = spark.createDataFrame([("late",), ("busy",), ("down",), ("bad",), ("hello",), (None,)], "t string").withColumn("status", F.lit("clash"))
    got = {r.t: (r.status, r.body, r.attempts) for r in ig.called(df, "t", send, 2).collect()}
    assert got == {"late": (504, None, 3), "busy": (200, "ok", 3), "down": (502, None, 3), "bad": (502, None, 1), "hello": (200, "hello", 1), None: (None, None, 0)}
    assert ig.called(df.limit(0), "t", send).count() == 0


def test_leftovers(spark):
    f = spark.createDataFrame([("a", "x.part"), ("a", "x.mp4"), ("b", "frames.tmp"), ("c", "part")], "v string, n string")
    assert {tuple(r) for r in ig.leftovers(f, spark.createDataFrame([("b",), (None,)], "v string"), "v", "n").collect()} == {("a", "x.part")}


def test_model_boundaries(spark):
    df = spark.createDataFrame([(1, "abc", "x"), (2, None, "y"), (3, "zero", None)], "i int, t string, u string")
    model = lambda ts: np.array([[0.0, 0.0] if t == "zero" else [3.0, 4.0] for t in ts])
    e = {r.i: r.embedding for r in vc.encode(df, "t", model, unit=True).collect()}
    assert e[1] == pytest.approx([0.6, 0.8]) and e[2] is None and e[3] is None
    s = {r.i: r.score for r in vc.pair_scores(df, "t", "u", lambda a, b: np.array([len(x) + len(y) if x != "abc" else np.nan for x, y in zip(a, b)])).collect()}
    assert s == {1: None, 2: None, 3: None}
    m = spark.createDataFrame([([[3.0, 0.0], [0.0, 4.0], [9.0, 9.0]], [1, 1, 0]), ([[1.0, 1.0]], [0]), (None, None)], "v array<array<double>>, m array<int>")
    got = [r[0] for r in m.select(vc.mean_pooled(F.col("v"), F.col("m"))).collect()]
    assert got[0] == pytest.approx([0.6, 0.8]) and got[1:] == [None, None]
    c = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0], [2.0, 3.0])], "v array<double>, t array<double>, p array<double>")
    assert c.select(vc.conditioned_score(F.col("v"), F.col("t"), F.col("p"))).first()[0] == pytest.approx(0.6)
