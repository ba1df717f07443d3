import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuelake import api, storage
from cuelake.operators import governance as gv
from cuelake.operators import jobs as jb
from cuelake.operators import routing as rt
from cuelake.sources import files
from cuelake.streaming import events as se


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(make(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("url,normal,why", [
    (" HTTPS://Media.Example.:8443/a?b=1#c ", "https://media.example:8443/a?b=1", None), ("http://media.example", "http://media.example/", None), ("ftp://x/y", None, "scheme"),
    ("https://u@x/y", None, "credentials"), ("http://localhost/x", None, "local"), ("http://a.localhost/x", None, "local"), ("http://10.1.2.3/x", None, "private"),
    ("http://172.20.0.1/x", None, "private"), ("http://169.254.169.254/x", None, "local"), ("not a url", None, "scheme"), (None, None, "scheme"),
])
def test_urls(spark, url, normal, why):
    r = api.validate_urls(spark.createDataFrame([(url,)], "u string"), "u").first()
    assert (r.normal_url, r.refused) == (normal, why)


def test_ids_and_names(spark):
    ids = {"https://youtu.be/abcdef1/x": "abcdef1", "https://www.youtube.com/watch?t=1&v=abc_DEF-1": "abc_DEF-1", "https://youtube.com/shorts/abcdefg/": "abcdefg", "https://youtu.be/ab": None, "https://x.example/watch?v=abcdefg": None}
    assert {u: one(spark, u, gv.video_id_of) for u in ids} == ids
    names = {"a/b%20c.mp4": "b c.mp4", "../../x": "x", "%2F..%2F": "fallback", "ü?.webm": "webm", "a+b.mp4": "a_b.mp4", "": "fallback"}
    assert {u: one(spark, u, lambda c: gv.safe_name(c, "fallback")) for u in names} == names
    keys = {"https://www.Media.example/A_b%20c?x=1": "media.example/a b c", "https://web.archive.org/web/2020/https://youtu.be/abc": "youtube:abc", "https://m.youtube.com/watch?v=Q": "youtube:Q"}
    assert {u: one(spark, u, gv.source_key) for u in keys} == keys


def test_violations_shared_remaining(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, None, 5)], "k int, s string, n int")
    assert {tuple(r) for r in gv.violations(df, "k", {"s": F.col("s") == "a", "n": F.col("n") < 3}).collect()} == {(2, "s"), (2, "n")}
    sp = spark.createDataFrame([("x", "g", None), ("y", "g", "h"), ("y", "k", "h")], "split string, g string, h string")
    assert {tuple(r) for r in gv.shared(sp, "split", "x", "y", ["g", "h"]).collect()} == {("g", "g")}
    done = spark.createDataFrame([(1, "a", 1), (2, None, 6)], "k int, s string, n int")
    todo = df.unionByName(spark.createDataFrame([(3, "c", 3)], "k int, s string, n int"))
    assert {tuple(r) for r in gv.remaining(todo, done, "k").collect()} == {(2, "changed"), (3, "new")}


def test_fingerprint_changes_with_any_field(spark, monkeypatch):
    f = lambda rs: gv.fingerprint(spark.createDataFrame(rs, "v string, i bigint, t string"), ["v"], "i", [F.col("i"), F.col("t")]).first()
    for block in (gv.BLOCK, 2):
        monkeypatch.setattr(gv, "BLOCK", block)
        rows = [("v", 1, "a"), ("v", 2, None), ("v", 7, "c"), ("v", -3, "d"), ("v", 40, "e")]
        assert f(rows) == f(rows[::-1]) and f(rows).rows == 5
        others = [rows[:-1] + [("v", 40, "x")], rows[:-1] + [("v", 41, "e")], rows[:1] + [("v", 2, "")] + rows[2:], rows[:4], rows + rows[:1]]
        assert len({f(rows).fingerprint, *(f(o).fingerprint for o in others)}) == 6


def test_artifact_gate(spark):
    nan = float("nan")
    rows = [(1, "m", 5.0, 0.2), (2, "x", 5.0, 0.2), (3, None, 5.0, 0.2), (4, "m", 1.0, 2.0), (5, "m", 5.0, nan), (6, "m", 5.0, None), (7, "m", 5.0, float("inf"))]
    got = gv.incompatible(spark.createDataFrame(rows, "k int, model string, step double, t double"), "k", {"model": "m", "step": 5.0}, "t")
    assert {tuple(r) for r in got.collect()} == {(2, "model"), (3, "model"), (4, "step"), (4, "range"), (5, "finite"), (5, "range"), (6, "finite"), (6, "range"), (7, "finite"), (7, "range")}


def test_frozen_faults(spark):
    mk = lambda rows: spark.createDataFrame(rows, "k string, h string")
    got = gv.frozen_faults(mk([("a", "1"), ("b", "2"), ("c", "3"), ("d", None)]), mk([("a", "1"), ("b", "x"), ("d", None), ("e", "5")]), "k", "h")
    assert {tuple(r) for r in got.collect()} == {("b", "changed"), ("c", "missing")}


def manifest(spark, sources=(), queries=(), excluded=()):
    s = spark.createDataFrame(list(sources), "manifest string, source_id string, keys array<string>, sha256 string, duration_s double, license string")
    q = spark.createDataFrame(list(queries), "manifest string, query_id string, source_id string, category string, text string, difficulty string, intervals array<array<double>>, audited boolean")
    e = spark.createDataFrame(list(excluded), "keys array<string>, sha256 string")
    return {(r.rule, r.subject) for r in gv.manifest_faults(s, q, e, ["A", "B"], {"a": (["A"], 3)}, gv.ManifestLimits(2, 4, 2, 100.0)).collect()}


def test_manifest_faults(spark):
    sources = [("m", "s1", ["u1"], "h1", 120.0, "CC0"), ("m", "s2", ["u2", "u3"], "h2", 50.0, "CC0")]
    queries = [("m", f"q{i}", f"s{i % 2 + 1}", "AAAB"[i], "text", "easy", [[0.0, 10.0]], True) for i in range(4)]
    assert manifest(spark, sources, queries) == set()
    assert manifest(spark, sources, queries, [(["u3"], None), ([], "h1")]) == {("leaked_address", "u3"), ("leaked_media", "h1")}
    assert manifest(spark, sources[:1], queries[:1]) >= {("few_sources", None), ("few_queries", None), ("few_a", None), ("category_missing", "B"), ("few_queries_of_source", "s1")}
    bad = [("m", "s3", ["u1"], "h1", float("nan"), " "), ("m", "s1", None, None, 1.0, None)]
    assert manifest(spark, sources + bad, queries) == {("duplicate_source", "s1"), ("duplicate_media", "h1"), ("duplicate_address", "u1"), ("source_incomplete", "s3"), ("source_incomplete", "s1"), ("few_queries_of_source", "s3")}
    wrong = [("m", "q0", "s9", "C", " ", "easy", [[0.0, 1.0]], None), ("m", "q7", "s2", "A", "t", None, [[5.0, 60.0]], True), ("m", "q8", "s2", "A", "t", "hard", [], True), ("m", "q9", "s2", "A", "t", "hard", [[2.0, 1.0], [0.0]], True)]
    assert manifest(spark, sources, queries + wrong) == {("duplicate_query", "q0"), ("unknown_source", "s9"), ("category", "q0"), ("query", "q0"), ("audit", "q0"), ("intervals", "q0"), ("query", "q7"), ("intervals", "q7"), ("intervals", "q8"), ("intervals", "q9")}
    assert manifest(spark) == set()


def test_dataset_faults(spark):
    def run(sources, queries, protected=()):
        s = spark.createDataFrame(list(sources), "source_id string, split string")
        q = spark.createDataFrame(list(queries), "query_id string, source_id string, split string, text string, route string")
        p = spark.createDataFrame([(x,) for x in protected], "text string")
        return {tuple(r) for r in gv.dataset_faults(s, q, p, ["a", "b"], ["x", "y"], 2, 4).collect()}

    sources = [("s1", "a"), ("s2", "b")]
    queries = [(f"q{i}", f"s{i // 2 + 1}", "aabb"[i], f"text {i}", "xyxy"[i]) for i in range(4)]
    assert run(sources, queries) == set()
    assert run(sources, queries, [" TEXT  1"]) == {("protected", "q1")}
    assert run(sources[:1], queries[:2]) == {("few_sources", None), ("few_queries", None), ("split_without_sources", "b")}
    got = run([*sources, ("s2", "a")], [*queries, ("q0", "s1", "a", "text 0", "z"), ("q9", "s1", "b", None, "x"), ("q8", "s1", "b", "t", "x")])
    assert got == {("source_in_two_splits", "s2"), ("split_of_source", "q2"), ("split_of_source", "q3"), ("split_of_source", "q9"), ("split_of_source", "q8"), ("duplicate_id", "q0"), ("duplicate_text", "text 0"), ("schema", "q0"), ("unbalanced", "b")}


def test_question_rules(spark):
    scopes = {"What are three reasons?": "SUPPORTED_CORE", "Name three reasons": "EXPLICIT_LIST_COUNT", "What happened before the break?": "TEMPORAL_ORDERING", "What was the last step": "TEMPORAL_ORDERING", "Summarise the whole  video": "LONG_RANGE_COMPOSITIONAL", "What does the error message say?": "OCR_DEPENDENT", "Which colour is it": "VISUAL_ONLY", "Why does it matter?": "SUPPORTED_CORE"}
    assert {q: one(spark, q, rt.scope) for q in scopes} == scopes
    assert one(spark, "What happens prior to the lamp going out. ?", rt.temporal_anchor) == "the lamp going out"
    assert (one(spark, "then what", rt.temporal_relation), one(spark, "previously on", rt.temporal_relation), one(spark, "now", rt.temporal_relation)) == ("AFTER", "BEFORE", None)
    assert [one(spark, q, rt.requested_count) for q in ("give 12 tips", "which two", "two of which")] == [12, 2, None]
    assert one(spark, "The cyclist with a mobile phone and a phone", rt.object_aliases) == ["mobile phone", "cyclist"]
    assert [one(spark, w, rt.turkish_stem) for w in ("kitaplardan'da", 'evde', 'bavulu', 'eli')] == ['kitap', 'evde', 'bavul', 'eli']
    assert one(spark, "IŞIK İyi’dir", rt.turkish_words) == ["ışık", "iyi'dir"]
    assert one(spark, 'when does the narrator explain "old maps" on screen?', lambda c: F.array(*(x.cast("double") for x in rt.route_features(c))))[:7] == [1.0, 1.0, pytest.approx(np.log1p(9)), 1.0, 0.0, 0.0, 1.0]


def test_job_rules(spark):
    df = spark.createDataFrame([(None, None, 1), ("x", True, 1), ("x", None, 2), ("x", True, 3), ("x", False, 1)], "e string, r boolean, a int")
    assert [r[0] for r in df.select(jb.retried(F.lit("running"), F.col("e"), F.col("r"), F.col("a"))).collect()] == ["ready", "queued", "queued", "failed", "failed"]
    v = spark.createDataFrame([(None, None), ("ready", None), ("failed", False), ("failed", None)], "s string, r boolean")
    assert [r[0] for r in v.select(jb.retry_verdict(F.col("s"), F.col("r"))).collect()] == ["not_found", "not_failed", "not_retryable", "queued"]
    log = spark.createDataFrame([("v", "speech", "queued", 1.0, "a"), ("v", "speech", "failed", 2.0, "b"), ("v", "visual", "ready", 1.0, "c")], "video_id string, kind string, status string, created_at double, job_id string")
    assert {(r.kind, r.job_id, r.state, r.stage) for r in api.jobs_view(log).collect()} == {("speech", "b", "failed", "transcribing"), ("visual", "c", None, "indexing")}


def test_enqueued_equals_a_queue(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.choice("xyz"), i, float(rng.randint(0, 40)), rng.choice([None, float("nan"), 0.0, 5.0, 30.0])) for i in range(300)]
    rows = [(q, k, i, t, None if d is None else t + d) for q, k, i, t, d in rows] + [("a", "x", 999, None, 3.0), (None, None, 1000, 1.0, 9.0)]
    want = {}
    for queue in ("a", "b", None):
        active = []
        for q, k, i, t, u in sorted((r for r in rows if r[0] == queue), key=lambda r: (r[3] is not None, r[3] or 0, r[2])):
            active = [(x, e) for x, e in active if t is None or e > t]
            want[i] = "full" if len(active) >= 2 else "active" if k in [x for x, _ in active] else "accepted"
            if want[i] == "accepted" and t is not None and u is not None and u > t:
                active.append((k, u))
    df = spark.createDataFrame(rows, "q string, k string, id int, at double, until double").withColumn("extra", F.lit(1))
    got = {r.id: r.verdict for r in jb.enqueued(df, ["q"], ["k"], "at", "until", "id", 2).collect()}
    assert got == want and set(want.values()) == {"full", "active", "accepted"}


def test_recovery(spark):
    df = spark.createDataFrame([(1, "running", True, 1), (2, "running", True, 3), (3, "running", None, 0), (4, "running", False, 0), (5, "queued", True, 0)], "job_id int, status string, retryable boolean, attempts int")
    assert {tuple(r) for r in jb.recovered(df).collect()} == {(1, "queued"), (2, "failed"), (3, "queued"), (4, "failed")}


def test_job_stream(spark, tmp_path):
    steps = [("k", "enqueue", 0.0), ("k", "enqueue", 1.0), ("k", "claim", 2.0), ("k", "fail", 3.0), ("k", "claim", 4.0), ("k", "claim", 5.0), ("k", "done", 6.0), ("w", "claim", 1.0)]
    state = None
    for _, e, at in steps[:-1]:
        state = se.advance(state, e, at)
    assert state == ("ready", 2, 5.0, 1)
    for i, part in enumerate((steps[:3], steps[3:])):
        spark.createDataFrame(part, "active_key string, event string, at double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("active_key string, event string, at double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = se.job_states(stream).writeStream.outputMode("update").format("memory").queryName("jobs_out").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    rows = spark.sql("SELECT * FROM jobs_out WHERE active_key = 'k'").collect()
    assert ("ready", 2, 5.0, 1) in {(r.status, r.attempts, r.available_at, r.refused) for r in rows}


def test_window_streams_equal_batch(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    schema = spark.read.parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).schema
    spark.read.parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "ev"))
    for name, make in (("wins", se.windowed), ("sess", se.sessions)):
        stream = make(spark.readStream.schema(schema).parquet(str(tmp_path / "ev")))
        q = stream.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        got, want = spark.table(name), make(spark.read.schema(schema).parquet(str(tmp_path / "ev")))
        assert got.count() > 0 and got.select("start", "n").exceptAll(want.select("start", "n")).count() == 0


def test_files(spark, tmp_path):
    m = spark.createDataFrame([("v1", "a.mp4", [(0.0, "t/1"), (5.0, "t/2")]), ("v2", "b.mp4", [])], "video_id string, filename string, frames array<struct<timestamp:double,thumbnail:string>>")
    p = str(tmp_path / "manifests")
    files.write_manifests(m, p)
    files.write_manifests(m.where("video_id = 'v1'").withColumn("filename", F.lit("new.mp4")), p)
    got = files.read_manifests(spark, p)
    assert {(r.video_id, r.filename, r.status) for r in got.collect()} == {("v1", "new.mp4", None), ("v2", "b.mp4", None)}
    assert [(r.frame_idx, r.ts) for r in files.manifest_frames(got).orderBy("frame_idx").collect()] == [(0, 0.0), (1, 5.0)]
    assert files.listing(spark, p, "*.json").count() >= 2
    a = str(tmp_path / "artifact")
    files.save_artifact(m.select("video_id"), a, model="m", revision="1")
    assert files.load_artifact(spark, a, model="m", revision="1").columns == ["video_id"]
    with pytest.raises(Exception, match="stale"):
        files.load_artifact(spark, a, model="m", revision="2").collect()
    t = str(tmp_path / "t")
    files.replace_groups(spark.createDataFrame([("a", 1), ("b", 1)], "g string, n int"), t, "g")
    files.replace_groups(spark.createDataFrame([("a", 2)], "g string, n int"), t, "g")
    assert {tuple(r) for r in spark.read.parquet(t).select("g", "n").collect()} == {("a", 2), ("b", 1)}
    np.save(tmp_path / "x.npy", np.arange(12, dtype="float32").reshape(6, 2))
    files.register(spark)
    rows = spark.read.format("npy").option("rows", 4).load(str(tmp_path / "*.npy")).orderBy("frame_idx").collect()
    assert [list(r.embedding) for r in rows] == [[2.0 * i, 2.0 * i + 1] for i in range(6)]
    files.write_csv(m.select("video_id"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2


def test_api(spark):
    d = "/root/testdata/sf0.001"
    assert api.videos(spark, d).count() > 0 and api.search(spark, d, "auto", 3).count() > 0
    with pytest.raises(ValueError):
        api.search(spark, d, "other")
    s = spark.createDataFrame([("v", 1.0, "100% sure"), ("v", 0.0, "1000 sure")], "video_id string, start_s double, text string")
    assert [r.text for r in api.search_transcript(s, " 100% ").collect()] == ["100% sure"]


def test_markdown(spark):
    df = spark.createDataFrame([("a|b", 1, 0.5), ("c\nd", None, None)], "name string, n int, x double")
    assert files.markdown(df, "Report") == "## Report\n\n| name | n | x |\n| --- | ---: | ---: |\n| a\\|b | 1 | 0.500 |\n| c d | — | — |\n"
    assert files.markdown(df, most=1).endswith("More than 1 rows.\n") and files.markdown(df.limit(0)).count("\n") == 2


def test_intermediate_tables_can_be_deleted(spark):
    df = storage.materialize(spark.range(3), "t")
    folder = os.path.dirname(os.path.dirname(df.inputFiles()[0].removeprefix("file://")))
    assert df.count() == 3 and os.path.isdir(folder)
    storage.clean(spark)
    assert not os.path.exists(folder)
    assert storage.materialize(spark.range(2), "t").count() == 2
