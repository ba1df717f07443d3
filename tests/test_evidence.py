import random
import re
from difflib import SequenceMatcher

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cuelake.operators import evidence as ev


def seg(rows):
    return [("v", i, float(s), float(e), t) for i, (s, e, t) in enumerate(rows, 1)]


SCHEMA = "video_id string, segment_id bigint, start_s double, end_s double, text string"


def test_chunks_golden(spark):
    df = spark.createDataFrame(seg([(0, 8, "one"), (8, 16, "two"), (40, 50, "three")]), SCHEMA)
    c = ev.chunks(df).orderBy("unit_id").collect()
    assert [list(r.segment_ids) for r in c] == [[1, 2], [2, 3]] and (c[0].end_seconds, c[0].unit_id, c[0].text) == (16.0, "E001", "one two")
    assert ev.chunks(df.limit(0)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 50), st.integers(0, 700)), max_size=25))
def test_bounds_cover_and_hold(parts):
    start, at = [], 0.0
    for gap, length, _ in parts:
        at += gap
        start.append(at)
        at += length
    end = [s + p[1] for s, p in zip(start, parts)]
    chars = [p[2] for p in parts]
    for bounds, seconds, most, share in ((ev.chunk_bounds, 45, 900, 1), (ev.unit_bounds, 30, 600, 0)):
        got = list(bounds(np.array(start), np.array(end), np.array(chars)))
        assert sorted({k for i, j in got for k in range(i, j)}) == list(range(len(parts)))
        for i, j in got:
            fits = end[j - 1] - start[i] <= seconds and sum(chars[i:j]) + j - i - 1 <= most
            assert j == i + 1 or fits
        for (_, j), (i, _) in zip(got, got[1:]):
            assert j - i in (0, share)


def test_sections():
    # four units over 120 s with a pause and a change of topic
    g = ev.section_groups(np.array([0.0, 20, 45, 70]), np.array([20.0, 40, 65, 120]), np.array([1, 0.9, 0.9, 0.1]))
    assert g == [[0, 1], [2, 3]] or g == [[0, 1], [2], [3]]
    assert ev.section_groups(np.array([0.0, 100, 190]), np.array([100.0, 190, 195]), np.array([1, 1, 1.0])) == [[0], [1, 2]]
    assert ev.section_groups(np.zeros(0), np.zeros(0), np.zeros(0)) == []
    assert ev.summary_of(["a" * 500, "b" * 500], np.eye(2)) == [0]
    assert ev.summary_of(["a", "b", "c"], np.array([[1.0, 0], [0.9, 0.1], [0, 1]])) == [0, 1]


def test_budget(spark):
    rows = [("q", 1, "a", "x" * 3000, [1, 2]), ("q", 2, "b", "x" * 700, [3]), ("q", 3, "c", "x" * 10, [2, 1]), ("q", 4, "d", "x" * 600, [4]), ("q", 5, "e", "", [5])]
    df = spark.createDataFrame(rows, "q string, rank int, id string, text string, segment_ids array<bigint>")
    r = ev.packages(df, ["q"], "id").first()
    assert list(r.selected) == ["a", "d", "e"] and r.characters == 3600
    assert list(ev.packages(df, ["q"], "id", dedup=False).first().selected) == ["a", "c", "e"]


def test_mmr_against_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(20):
        n = 8
        s, t, v = np.sort(rng.uniform(size=n))[::-1], rng.permutation(n).astype(float), rng.normal(size=(n, 3))
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        got = ev.mmr(s, t, v, 0.6, 4)
        want = [0]
        while len(want) < 4:
            want.append(max((i for i in range(n) if i not in want), key=lambda i: 0.6 * s[i] - 0.4 * max(v[i] @ v[j] for j in want)))
        assert got == want


def test_screens(spark):
    f = [("v", "f1", 0.0, "Error  code\n42", 0.8), ("v", "f2", 5.0, "Error code 42!", 0.6), ("v", "f3", 20.0, "Error code 42", None), ("v", "f4", 21.0, " ", 0.1), ("v", "f5", 22.0, "other", float("nan"))]
    got = ev.merged_screens(spark.createDataFrame(f, "video_id string, frame_id string, ts double, text string, confidence double")).orderBy("evidence_id").collect()
    assert [(r.start_seconds, r.end_seconds, list(r.frame_ids)) for r in got] == [(0.0, 5.0, ["f1", "f2"]), (20.0, 20.0, ["f3"]), (22.0, 22.0, ["f5"])]
    assert abs(got[0].confidence - 0.7) < 1e-12 and got[1].confidence is None and got[2].confidence is None
    assert ev.screen_text("ﬁne­ \t text﻿") == "fine text" and ev.screen_terms("a_b --no-cache x.y") == "a b --no-cache x.y"
    assert ev.likeness("", "a") == 0.0 and ev.likeness("abc", "abcd") == 0.75
    assert ev.best_window("two three", ["one", "two", "three", "four"]) == ("two three", 1.0) and ev.best_window("", ["a"]) == ("", 0.0)


def test_boxes(spark):
    rng = random.Random(5)
    rows = [(f"f{rng.randint(0, 3)}", "c", round(rng.random(), 6), *(lambda x, y: (x, y, x + 10.0, y + 10.0))(float(rng.randint(0, 15)), float(rng.randint(0, 15)))) for _ in range(60)]
    df = spark.createDataFrame(rows, "frame_id string, class string, confidence double, x1 double, y1 double, x2 double, y2 double")
    got = {tuple(r) for r in ev.detections_kept(df).collect()}

    def iou(a, b):
        w = max(0, min(a[5], b[5]) - max(a[3], b[3])) * max(0, min(a[6], b[6]) - max(a[4], b[4]))
        return w / (200 - w)

    want = set()
    for f in {r[0] for r in rows}:
        kept = []
        for r in sorted((r for r in rows if r[0] == f), key=lambda r: (-r[2], r[3], r[4])):
            if all(iou(r, k) <= 0.45 for k in kept):
                kept.append(r)
        want |= set(kept)
    assert got == want


def test_anchor_pairs_and_expansion(spark):
    a = ev.anchor_candidates(spark.createDataFrame(seg([(0, 1, " a "), (1, 2, "b")]), SCHEMA)).orderBy("unit_id").collect()
    assert [(r.unit_id, r.parts, r.text) for r in a] == [("T0000001", 1, "a"), ("T0000001-0000002", 2, "a b"), ("T0000002", 1, "b")]
    u = lambda i, s: {"id": i, "start": s, "end": s + 10, "text": "x" * 100}
    base = [u("b", 100)]
    assert [x["id"] for x in ev.expanded(base, {"b": (u("a", 90), u("c", 110))})] == ["b", "a", "c"]
    assert [x["id"] for x in ev.expanded(base, {"b": (u("a", 0), None)})] == ["b"]
    assert [x["id"] for x in ev.expanded(base, {"b": (u("a", 90), u("c", 110))}, most_added=1)] == ["b", "a"]
    assert [x["id"] for x in ev.expanded(base, {"b": (u("a", 90), u("c", 110))}, chars=250)] == ["b", "a"]


@pytest.mark.parametrize("change,verdict", [
    ({}, "answer"), ({"answerable": False}, "abstain"), ({"answer": "  "}, "abstain"), ({"claims": []}, "abstain"), ({"gaps": ["x"]}, "abstain"),
    ({"evidence_ids": ["E1", "E2"]}, "abstain"), ({"evidence_ids": ["E9"]}, "unknown_citation"), ({"requested_count": 2}, "abstain"), ({"temporal": True}, "abstain"),
    ({"claims": [("Same", ["E1"]), (" same ", ["E1"])]}, "abstain"), ({"claims": [("A", ["E8"])]}, "unknown_citation"),
])
def test_answer_contract(spark, change, verdict):
    row = {"answerable": True, "answer": "It is.", "evidence_ids": ["E1"], "claims": [("It is", ["E1"])], "gaps": [], "requested_count": None, "temporal": False, "known_ids": ["E1", "E2"]} | change
    schema = "answerable boolean, answer string, evidence_ids array<string>, claims array<struct<text:string,evidence_ids:array<string>>>, gaps array<string>, requested_count int, temporal boolean, known_ids array<string>"
    r = ev.resolved_answer(spark.createDataFrame([tuple(row.values())], schema)).first()
    assert r.verdict == verdict and list(r.citations) == (["E1"] if verdict == "answer" else [])


def test_best_window_searches_all_units_of_a_video(spark):
    from cuelake.plans.questions import best_window
    from cuelake.sources import views

    d, lines = "/root/testdata/sf0.001", re.compile(r"(?<=[.!?]) ")
    units = {}
    for r in views.units(spark, d, "context").orderBy("unit_id").collect():
        units.setdefault(r.video_id, []).append(lines.split(r.text))
    want = {}
    for q in views.queries(spark, d).collect():
        if q.video_id in units:
            text, like = max((ev.best_window(q.query_text, u) for u in units[q.video_id]), key=lambda w: w[1])
            want[q.query_id] = (text, round(like, 6))
    assert {r.query_id: (r.window, r.likeness) for r in best_window(spark, d).collect()} == want


def test_windows_equal_sequence_matcher():
    rng, alphabets = random.Random(4), ["ab ", "abc -'.", "abcdefghij  ", "etaoinshrdlu kvxz   ", "é\u0301ıİß_a \xad\ufeffﬁ"]
    for _ in range(300):
        letters = rng.choice(alphabets)
        units = [["".join(rng.choice(letters) for _ in range(rng.choice([0, 3, 30, 90, 150]))) for _ in range(rng.randint(0, 9))] for _ in range(3)]
        windows = ev.Windows(units)
        for size in (0, 5, 40, 90, 260):
            want = ev.screen_terms(reference := "".join(rng.choice(letters) for _ in range(size)))
            runs = [(u, " ".join(x[i:j])) for u, x in enumerate(units) for i in range(len(x)) for j in range(i + 1, min(len(x), i + 8) + 1)] if want else []
            best = max(((SequenceMatcher(None, want, ev.screen_terms(t)).ratio(), -k) for k, (_, t) in enumerate(runs)), default=(0.0, 0))
            assert windows.best(reference) == ((*runs[-best[1]], best[0]) if best[0] else (0, "", 0.0))


def test_best_window_in_parts(spark, monkeypatch):
    from cuelake.plans import questions

    d = "/root/testdata/sf0.001"
    whole = sorted(map(tuple, questions.best_window(spark, d).collect()))
    monkeypatch.setattr(questions, "QUERIES_A_ROW", 1)
    monkeypatch.setattr(questions, "UNITS_A_ROW", 2)
    assert whole and sorted(map(tuple, questions.best_window(spark, d).collect())) == whole


def test_edit_accuracy_of_whole_texts(spark, monkeypatch):
    from cuelake.plans import questions

    rng, data = random.Random(2), []
    for v in "ab":
        for i in range(6):
            data.append((v, f"s{i}", float(i), float(i + 1), "".join(rng.choices("ağ ß日x", k=rng.choice([0, 5, 700])))))
    monkeypatch.setattr(questions.views, "segments", lambda s, d: s.createDataFrame(data, "video_id string, segment_id string, start_s double, end_s double, text string"))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    want = {}
    for v in "ab":
        t = [r[4] for r in data if r[0] == v]
        want[v] = round(max(0.0, 1 - sum(map(distance, t, t[1:])) / max(1, sum(map(len, t[:-1])))), 6)
    assert {r.video_id: r.accuracy for r in questions.edit_accuracy_whole(spark, "").collect()} == want


def test_redundancy(spark):
    rows = [("q", 0.0, 1.0, 1, [1.0, 0.0]), ("q", 0.5, 3.0, 2, [2.0, 0.0]), ("q", 9.0, None, 3, [0.0, 1.0]), ("q", None, 2.0, 4, None), ("one", 4.0, 1.0, 5, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "q string, ts double, s double, id int, v array<double>")
    got = {r.q: r for r in ev.redundancy(df, ["q"], "ts", "s", "id", "v", 0.05).collect()}
    r = got["q"]
    assert (r.pairs_1, r.near_1, r.pairs_5, r.pairs_10, r.near_10, r.regions, r.spread, r.duplicates, list(r.gaps)) == (1, 2, 1, 3, 3, 2, 2.0, 1, [0.5, 8.5])
    assert r.duplicate_rate == 1 / 6 and (got["one"].pairs_10, got["one"].regions, got["one"].duplicate_rate, list(got["one"].gaps)) == (0, 1, 0.0, [])


def test_screen_report(spark):
    targets = spark.createDataFrame([("t1", "Copper kettle", ["f1"], ["copper kettle"], [[0.0, 10.0]]), ("t2", "Old map", ["f2"], ["something else"], [[50.0, 60.0]]), ("t3", "Gone", [], [], [[5.0, 6.0]]), ("t4", None, None, None, None)], "target_id string, reference string, frame_ids array<string>, lines array<string>, intervals array<array<double>>")
    results = spark.createDataFrame([("t1", 1, 12.0, ["f1", "f9"]), ("t2", 1, 0.0, ["f8"]), ("t2", 3, 55.0, ["f2"])], "target_id string, rank int, start_seconds double, frame_ids array<string>")
    frames = spark.createDataFrame([("copper kettle",), ("copper kettle",), (" ",), (None,), ("map",)], "text string")
    spans = spark.createDataFrame([("v", "ocr-00001", "copper kettle"), ("v", "ocr-00002", "Copper  kettle")], "video_id string, evidence_id string, text string")
    got = {r.metric: r.value for r in ev.screen_report(targets, results, frames, spans, 2.0).collect()}
    assert (got["targets"], got["visible_targets"], got["sampling_coverage"], got["detection_recall_visible"]) == (4, 2, 0.5, 0.5)
    assert (got["retrieval_at_1_all"], got["retrieval_at_1_visible"], got["retrieval_at_3_all"], got["retrieval_at_3_visible"]) == (0.25, 0.5, 0.5, 1.0)
    assert got["median_timestamp_error"] == 2.0 and got["raw_duplicate_rate"] == pytest.approx(1 / 3) and got["residual_duplicate_rate"] == 0.5
    assert got["index_bytes"] == 27 and got["index_bytes_per_minute"] == 13.5 and 0 < got["text_accuracy_visible"] < 1
