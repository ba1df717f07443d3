import numpy as np
import pytest
from pyspark.sql import functions as F

from cuelake.operators import calibrate as cb
from cuelake.operators import features as ft
from cuelake.operators import metrics


def test_interval_scores_golden(spark):
    res = spark.createDataFrame([("a", 1.0, 1), ("a", 2.0, 2), ("a", 8.0, 3), ("b", 5.0, 1)], "q string, ts double, rank int")
    iv = spark.createDataFrame([("a", 0, 0.0, 3.0), ("a", 1, 7.0, 9.0), ("b", 0, 0.0, 5.0)], "q string, ord int, s double, e double")
    qs = spark.createDataFrame([("a",), ("b",), ("none",)], "q string")
    got = {r.q: r for r in metrics.interval_scores(res, iv, qs, "q", 3).collect()}
    assert (got["a"].recall, round(got["a"].precision, 9), got["a"].reciprocal_rank) == (1.0, round(2 / 3, 9), 1.0)
    assert (got["b"].recall, got["b"].reciprocal_rank) == (0.0, 0.0)
    assert got["none"].recall is None and got["none"].returned == 0 and got["none"].precision == 0.0
    assert {r.q: r.first_rank for r in metrics.first_ranks(res, iv, qs, "q").collect()} == {"a": 1, "b": 1, "none": None}


def test_grouped_and_percentiles(spark):
    df = spark.createDataFrame([("x", 1), ("x", 4), (None, 2), ("y", None)], "g string, r int")
    got = {(r.by, r.value): (r.n, r.r_at_1, r.mrr_at_5) for r in metrics.grouped(df, ["g"], metrics.recalls("r", [1], 5)).collect()}
    assert got == {("all", "all"): (4, 0.25, round((1 + 0.25 + 0.5) / 4, 6)), ("g", "x"): (2, 0.5, 0.625), ("g", "(null)"): (1, 0.0, 0.5), ("g", "y"): (1, 0.0, 0.0)}
    v = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 4)], "g string, x double")
    got = metrics.quantiles(v, ["g"], "x", {"near": ("nearest", 0.5), "low": ("floor", 0.5), "mid": ("linear", 0.5)}).first()
    assert (got.near, got.low, got.mid) == (2.0, 3.0, 2.5)


def test_auc_and_classes(spark):
    rows = [(0.1, False), (0.4, True), (0.4, False), (0.9, True), (None, True)]
    r = metrics.auc(spark.createDataFrame(rows, "s double, y boolean"), [], "s", "y").first()
    assert (r.positives, r.negatives, r.auc) == (2, 2, 3.5 / 4)
    assert metrics.auc(spark.createDataFrame([(1.0, True)], "s double, y boolean"), [], "s", "y").first().auc is None
    c = {r["class"]: (r.support, r.precision, r.recall) for r in metrics.per_class(spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "c")], "t string, s string"), "t", "s").collect()}
    assert c == {"a": (2, 1.0, 0.5), "b": (1, 0.0, 0.0), "c": (0, 0.0, 0.0)}


def test_change_classes(spark):
    rows = [(None, 1), (1, 9), (1, 2), (3, 3), (None, None), (1, None)]
    got = spark.createDataFrame(rows, "b int, a int").select(metrics.change_class(F.col("b"), F.col("a"), 5).alias("c")).collect()
    assert [r.c for r in got] == ["RECOVERY", "REGRESSION", "NEUTRAL", "UNCHANGED", "UNCHANGED", "REGRESSION"]


def test_thresholds(spark):
    neg = spark.createDataFrame([(float(x),) for x in range(20)], "s double")
    assert cb.bounded_alarms(neg, "s", 0.1).first().cutoff == 17.0
    assert cb.bounded_alarms(neg.limit(0), "s", 0.1).first().cutoff == float("-inf")
    assert sorted(r.threshold for r in cb.midpoints(neg.where("s < 2"), "s").collect()) == [-1e-9, 0.5, 1 + 1e-9]
    rows = [(s, p) for s, p in [(0.9, True), (0.8, True), (0.7, False), (0.6, True), (0.1, False)] + [(0.05, False)] * 8]
    b = cb.best_threshold(spark.createDataFrame(rows, "s double, p boolean"), "s", "p", 0.1).first()
    assert (b.threshold, b.false_abstention, round(b.false_alarm, 3)) == (0.6, 0.0, 0.1)


def test_newton_equals_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 2)) * [1, 5]
    y = (x @ [1.0, 0.3] + rng.normal(size=300) > 0).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y)] + [(None, 1.0, 1)], "a double, b double, y int")
    m = cb.newton_logistic(df, ["a", "b"], "y")
    z = np.c_[np.ones(300), (x - x.mean(0)) / x.std(0)]
    w, pen = np.zeros(3), np.diag([0.0, 1.0, 1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        w += np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + pen, z.T @ (y - p) - pen @ w)
    assert np.allclose([m["bias"], *m["weights"]], w, atol=1e-6)
    assert cb.newton_logistic(df.where("y = 1"), ["a"], "y")["weights"] == [0.0]
    p = df.na.drop().select(ft.logistic([F.col("a"), F.col("b")], m["mean"], m["scale"], m["weights"], m["bias"]).alias("p")).collect()
    assert all(0 < r.p < 1 for r in p)


def test_softmax_and_features(spark):
    m = cb.softmax_fit(np.array([[1, 1.0, 0], [1, 0, 1.0], [1, 1, 0.1], [1, 0.1, 1]]), np.array([0, 1, 0, 1]), 2, 500)
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 1.0)], "a double, b double")
    logits = [ft.linear([F.lit(1.0), F.col("a"), F.col("b")], m["mean"], m["scale"], [w[k] for w in m["weights"]]) for k in (0, 1)]
    assert [r.c for r in df.select(ft.softmax(logits, ["x", "y"])[1].alias("c")).collect()] == ["x", "y"]
    rows = [("q", 1, 0.9, 10.0, [1.0, 0.0]), ("q", 2, 0.5, 15.0, [0.0, 1.0]), ("q", 3, 0.4, 90.0, [0.6, 0.8]), ("one", 1, 0.5, 3.0, [1.0, 0.0])]
    lists = spark.createDataFrame(rows, "q string, rank int, s double, ts double, v array<double>")
    got = {(r.q, r["rank"]): r for r in ft.candidate_features(lists, ["q"], "s", "rank", "ts", "v").collect()}
    a, one = got["q", 2], got["one", 1]
    mean, sd = 0.6, np.std([0.9, 0.5, 0.4])
    mid = np.array([1.6, 1.8]) / 3
    want = [(0.5 - mean) / sd, 0.2, 0.5, 1 / np.log2(3), 0.4, 0.4, 0.1, 0.4, mean, sd, 0.5, 0.5, 5.0, 0.0, mid[1] / np.linalg.norm(mid)]
    assert np.allclose([a[c] for c in ft.CANDIDATE], want)
    assert [one[c] for c in ("score_z", "score_minmax", "gap_from_previous", "gap_to_next", "top_two_gap", "temporal_support_10s", "nearest_time_gap")] == [0.0] * 7
    lf = {r.q: r for r in ft.list_features(lists, ["q"], "s", "rank", "ts", "v").collect()}
    p = np.exp([0, -0.4, -0.5]) / np.exp([0, -0.4, -0.5]).sum()
    assert np.allclose([lf["q"][c] for c in ft.LIST], [0.9, 0.4, 0.5, mean, sd, 0.5, -(p * np.log(p)).sum() / np.log(3), 0.5, mid[0] / np.linalg.norm(mid), 1 / 3, np.log(4)], atol=1e-6)
    ve = {r.q: r for r in ft.visual_evidence(lists, ["q"], "s", "rank", "ts").collect()}
    assert np.allclose([ve["q"][c] for c in ("top1", "margin_1_2", "margin_1_5", "temporal_support", "separated_support")], [0.9, 0.4, 0.5, 2 / 3, 2 / 3])
    assert (ve["one"].margin_1_2, ve["one"].std_5, ve["one"].separated_support) == (0.0, 0.0, 1.0)


def test_regressions(spark):
    a = spark.createDataFrame([("x", 0.5, 1.0), ("y", 0.5, 1.0)], "k string, recall double, far double")
    b = spark.createDataFrame([("x", 0.49, 2.0)], "k string, recall double, far double")
    got = {(r.k, r.metric) for r in cb.regressions(a, b, "k", {"recall": 1, "far": -1}, 0.02).collect()}
    assert got == {("x", "far"), ("y", "recall"), ("y", "far")}


def test_features_of_lists_without_spread(spark, monkeypatch):
    from cuelake.plans import calibration as c

    lists = {"one": [0.3], "two": [0.5, 0.1], "same": [0.1, 0.1, 0.1], "flat": [0.9, 0.2, 0.2, 0.2, 0.2, 0.1], "wide": [0.9, 0.6, 0.1]}
    data = [(q, "v", i + 1, 10.0 * i, s, [1.0, 0.0]) for q, x in lists.items() for i, s in enumerate(x)]
    rows = spark.createDataFrame(data, "query_id string, video_id string, rank int, ts double, score double, embedding array<double>")
    monkeypatch.setattr(c, "twenty", lambda s, d: rows)
    monkeypatch.setattr(c, "results", lambda s, d: rows)
    monkeypatch.setattr(c.views, "queries", lambda s, d: s.createDataFrame([(q, "a b") for q in lists], "query_id string, query_text string"))
    got = {(r.query_id, r["rank"]): r for r in c.candidate_features_whole(spark, "").collect()}
    per = {r.query_id: r for r in c.list_features_whole(spark, "").collect()}
    robust = {(r.query_id, r["rank"]): r for r in c.robust_z_whole(spark, "").collect()}
    assert set(got) == set(robust) == {(q, i + 1) for q, x in lists.items() for i in range(len(x))} and set(per) == set(lists)
    for q, x in lists.items():
        spread, quart = max(x) - min(x), np.percentile(x, 75) - np.percentile(x, 25)
        p = np.exp(np.array(x) - max(x)) / np.exp(np.array(x) - max(x)).sum()
        assert abs(per[q].entropy + (p * np.log(p + 1e-15)).sum() / max(np.log(len(x)), 1)) < 1e-5
        assert abs(per[q].range - spread) < 1e-6 and abs(per[q].std - np.std(x)) < 1e-6 and per[q].best_score == max(x)
        for i, s in enumerate(x):
            r = got[q, i + 1]
            assert abs(r.score_z - ((s - np.mean(x)) / np.std(x) if spread else 0)) < 1e-5
            assert abs(r.score_minmax - ((s - min(x)) / spread if spread else 0)) < 1e-5
            want = (s - np.median(x)) / max(quart, 1e-9)
            assert abs(robust[q, i + 1].robust_z - want) <= 1e-6 * max(1, abs(want))


def test_rule_search_equals_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(60):
        n = int(rng.integers(1, 25))
        points = [(float(x), float(y), int(p), int(m)) for x, y, p, m in zip(rng.integers(-4, 5, n) / 7, rng.integers(0, 6, n) / 90, rng.integers(0, 3, n), rng.integers(0, 3, n))]
        pos, neg = max(1, sum(p[2] for p in points)), max(1, sum(p[3] for p in points))
        cuts = [[v[0] - 1e-9, *((a + b) / 2 for a, b in zip(v, v[1:])), v[-1] + 1e-9] for v in (sorted({p[i] for p in points}) for i in (0, 1))]
        rules = [("best", a, None, None) for a in cuts[0]] + [("margin", b, None, None) for b in cuts[1]] + [("best", a, "margin", b) for a in cuts[0] for b in cuts[1]]
        least = None
        for f, a, g, b in rules:
            got = [p for p in points if p[f == "margin"] >= a and (g is None or p[1] >= b)]
            e = (1 - sum(p[2] for p in got) / pos, sum(p[3] for p in got) / neg, g is not None, f, -a, -(b or 0))
            if e[1] <= 0.5 and (least is None or e[:2] < least[:2] and abs(e[0] - least[0]) + abs(e[1] - least[1]) > 1e-12 or np.allclose(e[:2], least[:2], atol=1e-12) and e[2:] < least[2:]):
                least, rule = e, (f, a, g, b)
        f, a, g, b, pfa, far = cb.rule_search(points, ("best", "margin"), 0.5)
        assert (f, a, g, b) == rule and abs(pfa - least[0]) < 1e-9 and abs(far - least[1]) < 1e-9


def test_exhaustive_rules_beat_the_grid(spark):
    from cuelake.plans import calibration as c

    grid, rule = c.rule_search(spark, "/root/testdata/sf0.01").first(), c.rule_search_whole(spark, "/root/testdata/sf0.01").first()
    assert rule.far <= 0.5 and rule.pfa < grid.pfa


def test_sparse_fit_equals_dense_fit():
    rng = np.random.default_rng(1)
    x = np.where(rng.random((40, 12)) < 0.3, rng.random((40, 12)), 0.0)
    x[:, 0], y = 1, rng.integers(0, 3, 40)
    row, col = np.nonzero(x)
    got = cb.softmax_fit_sparse(row, col, x[row, col], 12, y, 3, 450, 0.8, 0.05)
    assert np.allclose(got, cb.softmax_fit(x, y, 3, 450, 0.8, 0.05, balanced=False, standard=False, decay=True)["weights"], atol=1e-9)


def test_vocabularies_hold_words_and_characters(spark, monkeypatch):
    from cuelake.plans import questions, routing

    d, sizes = "/root/testdata/sf0.01", []
    terms = {r.term for r in routing.tfidf_whole(spark, d).select("term").distinct().collect()}
    df = routing.word_terms(spark, d).select(F.explode(F.array_distinct("terms")).alias("t")).groupBy("t").count().where("count >= 2").count()
    assert len(terms) == min(5000, df) > 512
    assert routing.tfidf_predict_whole(spark, d).count() >= routing.tfidf_predict(spark, d).count()
    fit = cb.softmax_fit_sparse
    monkeypatch.setattr(cb, "softmax_fit_sparse", lambda *a: sizes.append(a[3]) or fit(*a[:6], 5, *a[7:]))
    assert questions.tfidf_classifier(spark, d).count() and sizes[0] > 5000


def test_preservation_and_demotions(spark):
    lanes = spark.createDataFrame([("q", "visual", 1, "a", 5.0, None), ("q", "visual", 2, "b", 50.0, None), ("q", "speech", 1, "a", 4.0, 6.0), ("q", "speech", 3, "c", 48.0, 51.0), ("r", "visual", 9, "x", 50.0, None)], "query_id string, lane string, rank int, thumbnail string, ts double, `end` double")
    fused = spark.createDataFrame([("q", "a", 5.0, 6.0, 1, 1, 1), ("q", "b", 50.0, None, 2, None, 6), ("q", "c", 48.0, 51.0, None, 3, 7), ("r", "x", 50.0, None, 9, None, 1)], "query_id string, thumbnail string, ts double, `end` double, visual_rank int, speech_rank int, fused_rank int")
    spans = spark.createDataFrame([("q", 49.0, 52.0), ("r", 49.0, 52.0)], "query_id string, s double, e double")
    need = spark.createDataFrame([("q", "visual"), ("q", "speech"), ("r", "visual"), ("s", "speech")], "query_id string, lane string")
    p = {r.query_id: (r.eligible, r.relevant_rank, r.irrelevant_consensus) for r in metrics.preservation(lanes, fused, spans, need, "query_id").collect()}
    assert p == {"q": (True, None, True), "r": (False, 1, False), "s": (False, None, False)}
    assert {tuple(r) for r in metrics.demotions(lanes, fused, spans, "query_id").collect()} == {("q", "visual", 2, 6), ("q", "speech", 3, 7)}
    assert {tuple(r) for r in metrics.recall_or_ranking(lanes, fused, spans, need, "query_id").collect()} == {("q", "ranking_failure"), ("r", "success"), ("s", "candidate_recall_failure")}


def test_scope_report(spark):
    t, f, n = True, False, None
    rows = [(t, t, t, t, t, t, t, t, 2, 1), (t, t, f, f, f, f, f, f, 0, 0), (t, f, t, t, t, n, n, n, 1, 1), (f, t, t, t, t, t, t, t, 1, 1), (f, n, f, f, f, n, n, n, None, None)]
    df = spark.createDataFrame(rows, "supported boolean, answerable boolean, allowed boolean, generated boolean, answered boolean, correct boolean, grounded boolean, evidence boolean, citations int, valid_citations int")
    got = {r.metric: r.value for r in metrics.scope_report(df).collect()}
    assert got["supported_question_recall"] == pytest.approx(2 / 3) and got["supported_question_precision"] == pytest.approx(2 / 3) and got["unsafe_generation_rate"] == 0.5
    assert got["core_user_success_rate"] == 0.5 and got["citation_precision"] == 0.5 and got["false_abstention_rate"] == 0.5 and got["false_answer_rate"] == 1.0
    assert all(r.value == 0.0 for r in metrics.scope_report(df.limit(0)).collect())


def test_audit(spark):
    lines = spark.createDataFrame([("v", 1, "a"), ("v", 2, "b")], "v string, i int, t string")
    mk = lambda rows: spark.createDataFrame(rows, "v string, i int, t string, verdict string")
    run = lambda rows: tuple(metrics.audit(lines, mk(rows), ["v", "i"], "t", "verdict", "no").first())
    assert run([("v", 1, "a", "no"), ("v", 2, "b", "yes")]) == (2, 1, 0, 0, 0, 0.5)
    assert run([("v", 1, "x", "no"), ("v", 3, "b", "yes")]) == (2, 1, 1, 1, 1, None)


def test_detector_classes_and_cost(spark):
    rows = spark.createDataFrame([("a", "visible", True, 0.5, 0.1), ("a", "visible", None, 0.9, 0.9), ("a", "hidden", True, 0.1, 0.1)], "k string, visibility string, detected boolean, confidence double, area double")
    assert tuple(metrics.detector_recall(rows, ["k"]).first()) == ("a", 2, 1, 0.5, 0.5, 0.1)
    seen = spark.createDataFrame([(1, "A"), (1, "B"), (2, "B")], "step int, kind string")
    assert {tuple(r) for r in metrics.evidence_classes(seen, "step", "kind", ["A"]).collect()} == {(1, "A", 1, 0.5, 0.5), (1, "B", 1, 0.5, 0.5), (2, "B", 1, 1.0, 0.0)}
    usage = spark.createDataFrame([("a", 1_000_000, None, 2.0), ("a", 0, 2_000_000, 2.0)], "k string, input_tokens bigint, output_tokens bigint, h double")
    assert tuple(metrics.cost_rollup(usage, ["k"], 0.5, 2.0, F.max("h")).first()) == ("a", 2, 1_000_000, 2_000_000, 4.5, 2.25, 2.25)


def test_trials_and_acceptance(spark):
    c = spark.createDataFrame([("q", 1, 0.0, 1.0, 0.0, 0.0), ("q", 2, 50.0, 0.5, 1.0, 0.0), ("r", 1, 0.0, 1.0, 0.0, 0.0)], "q string, rank int, ts double, score_z double, temporal_support_10s double, change double")
    spans = spark.createDataFrame([("q", 49.0, 51.0)], "q string, s double, e double")
    first = cb.temporal_trials(c, spans, ["q"], [0.0, 1.0], [0.0, 0.5])
    assert {(r.support_weight, r.change_weight): r["first"] for r in first.collect()} == {(0.0, 0.0): 2, (0.0, 0.5): 2, (1.0, 0.0): 1, (1.0, 0.5): 1}
    t = cb.trial_scores(first, ["support_weight", "change_weight"], "first", 5)
    best = cb.best_trial(t, ["r5", "r1", "mrr"], ["support_weight", "change_weight"]).first()
    assert (best.support_weight, best.change_weight, best.r5, best.r1, best.mrr) == (1.0, 0.0, 1, 1, 1.0)
    rows = [("speech", None, None), ("visual", 0.5, None), ("visual", 0.1, {"speech": 1.0}), ("hybrid", 0.0, {"speech": 0.1}), ("hybrid", 0.9, {"visual": 0.2}), ("hybrid", 0.0, {"visual": 0.4}), ("hybrid", 0.9, None), ("visual", None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, mode string, score double, evidence map<string,double>")
    ok = cb.accepted(F.col("mode"), F.col("score"), F.col("evidence"), 0.3)
    assert [r.ok for r in df.select("i", ok.alias("ok")).orderBy("i").collect()] == [True, True, False, True, False, True, False, False]
    assert all(r[0] for r in df.select(cb.accepted(F.col("mode"), F.col("score"), F.col("evidence"), None)).collect())


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(3)
    rows = [(g, None if i % 13 == 0 else float(x)) for g, n in (("a", 500), ("b", 1), ("c", 2)) for i, x in enumerate(rng.integers(0, 40, n), 1)]
    df = spark.createDataFrame(rows, "g string, x double")
    ps = (0.0, 0.1, 0.25, 0.5, 0.9, 1.0)
    got = {r.g: r for r in metrics.quantiles(df, ["g"], "x", {f"q{i}": ("linear", p) for i, p in enumerate(ps)} | {f"n{i}": ("nearest", p) for i, p in enumerate(ps)}).collect()}
    for g in "abc":
        x = np.array([v for h, v in rows if h == g and v is not None])
        assert [got[g][f"q{i}"] for i in range(6)] == pytest.approx(list(np.quantile(x, ps)))
        assert [got[g][f"n{i}"] for i in range(6)] == [sorted(x)[max(0, int(np.ceil(p * len(x))) - 1)] for p in ps]
    assert metrics.quantiles(df.limit(0), ["g"], "x", {"p": ("linear", 0.5)}).count() == 0
