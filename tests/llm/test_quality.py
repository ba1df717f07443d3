import math
import random

import pytest
from pyspark.sql import functions as F

from cuelake.llm import quality
from cuelake.llm.quality import STATS, common_words, language, measure, outlier_scores, sharer, text_quality, weigh
from cuelake.llm.shape import ended, items_of, kind_of, repeats, rows, shape


def brute(rows, stats):
    out = {}
    for k, group in {r[0]: r[1] for r in rows}.items():
        mine = next(r for r in rows if r[0] == k)
        if mine[2] is None:
            out[k] = None
            continue
        score = 0.0
        for i in range(len(stats)):
            xs = [r[2 + i] for r in rows if r[1] == group and r[2] is not None]
            le, ge = sum(x <= mine[2 + i] for x in xs), sum(x >= mine[2 + i] for x in xs)
            score -= math.log(min(1.0, 2 * min(le, ge) / len(xs)))
        out[k] = score
    return out


@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_scores_equal_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(quality, "BROADCAST_ROWS", broadcast)
    rng = random.Random(3)
    data = [(i, rng.choice(["en", "en", "tr", "und"]), rng.randint(0, 9), rng.choice([0, 0, 0, 5]), rng.randint(0, 10**6)) for i in range(900)]
    data += [(1000 + i, "en", None, None, None) for i in range(3)]
    df = spark.createDataFrame(data, "k bigint, lang string, a bigint, b bigint, c bigint")
    got = {r.k: r.outlier_score for r in outlier_scores(df, "k", ["a", "b", "c"])[0].collect()}
    want = brute(data, "abc")
    assert got.keys() == want.keys()
    assert all((got[k] is None) == (want[k] is None) and (want[k] is None or abs(got[k] - want[k]) < 1e-9) for k in want)


def test_small_languages_are_pooled_and_never_ordinary_by_default(spark):
    data = [(i, "en" if i < 150 else f"x{i}", i % 7) for i in range(160)]
    df = spark.createDataFrame(data, "k bigint, lang string, a bigint")
    got = {r.k: r.outlier_score for r in outlier_scores(df, "k", ["a"])[0].collect()}
    assert all(math.isinf(got[k]) for k in range(150, 160)) and not any(math.isinf(got[k]) for k in range(150))


def test_language(spark):
    df = spark.createDataFrame([(x,) for x in ("en-US", "EN", " tr_TR", None, "", "und", "  ")], "l string")
    assert [r[0] for r in df.select(language(F.col("l"))).collect()] == ["en", "en", "tr", "und", "und", "und", "und"]


def test_labelled_examples(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text", language(F.col("lang")).alias("lang"))
    share = sharer(common_words(docs, "text", "lang"))
    wrong = [(r.text_kind, r.text[:80]) for r in spark.read.parquet("/root/testdata/sf0.1/quality_examples.parquet").collect() if kind_of(shape(r.text, share)) != r.text_kind]
    assert wrong == []


def test_measures():
    share = sharer({"en": ["the", "of", "a"], "tr": ["ve", "bir", "a"]})
    assert measure("The end of it.\nA - list", share) == (6, 250, 118, 500, 500, 364, 0, 0, 0, None)
    assert share(["ve", "bir", "the"]) == 2 / 3 and share([]) == 0.0
    for blank in (None, "", " \n\t"):
        assert measure(blank, share) == (None,) * 10
    assert measure("!!!", share) == (0, 0, 1000, 1000, 0, 0, 0, 1000, 1000, "junk")


@pytest.mark.parametrize("text,kind", [
    ("so we open the box and then we look at the map and of course it is quite old", "prose"),
    ("Host: Yes, it is.\nGuest: And is it new?\nHost: It is not.", "prose"),
    ("we look at the old\nmap and then at the\nother one of the two", "prose"),
    ("a\tb\t1\nc\td\t2\ne\tf\t3", "table"),
    ("red #green lamp #blue #the old map #grey", "list"),
    ("One sentence comes first.\n- red\n- green", "list"),
    ("buy now " * 80, "junk"),
    ("x" * 500, "junk"),
])
def test_shapes(text, kind):
    share = sharer({"en": "the of and a is it we at then not".split()})
    assert kind_of(shape(text, share)) == kind


def test_parts():
    assert rows(["a | 1 | 2", "b | 2 | 3", "text"]) == {0, 1} and rows([]) == set()
    assert repeats("a b c".split() * 9) == 1.0 and repeats(["a"]) == 0.0


def test_whole_operator_on_edge_cases(spark):
    data = [(i, "This is the first of the two. It is not the last." if i % 2 else "We look at the map and at the box. And then we go.", "en") for i in range(130)]
    data += [(200, None, None), (201, "", "en"), (202, " ", "und"), (203, "ab " * 100_000, "en"), (204, "- one\n- two\n- three", "en-GB")]
    df = spark.createDataFrame(data, "doc_id bigint, text string, lang string").withColumn("group", F.lit(1)).withColumn("p", F.lit(2))
    got = {r.doc_id: r for r in text_quality(df, "doc_id", "text", "lang").collect()}
    assert len(got) == len(data)
    assert [got[k].text_kind for k in (200, 201, 202, 203, 204)] == [None, None, None, "junk", "list"]
    assert {got[k].text_kind for k in range(130)} == {"prose"}
    assert text_quality(df.limit(0), "doc_id", "text", "lang").count() == 0
    assert set(STATS) < set(got[1].asDict())


@pytest.mark.parametrize("text,kind", [("- one\n- two\n- three", "list"), ("a\tb\t1\nc\td\t2\ne\tf\t3", "table"), ("buy now " * 80, "junk")])
def test_copies_that_are_ordinary_keep_their_kind(spark, text, kind):
    data = [(i, text if i < 90 else f"This is the number {i} of the two. It is not the last.", "en") for i in range(150)]
    got = {r.doc_id: r for r in text_quality(spark.createDataFrame(data, "doc_id bigint, text string, lang string"), "doc_id", "text", "lang").collect()}
    assert got[0].outlier_score < 0.7
    assert {got[k].text_kind for k in range(90)} == {kind} and {got[k].text_kind for k in range(90, 150)} == {"prose"}


def test_repeats_equals_brute_force():
    rng = random.Random(5)
    for i in range(300):
        passage = rng.choices("the a of we to it box map old new".split()[: rng.randint(1, 10)], k=rng.randint(1, 40))
        words = passage * rng.randint(1, 12) + passage[: rng.randint(0, len(passage))]
        words = [rng.choice("xyz") if rng.random() < (i % 4) / 20 else w for w in words]
        n = len(words)
        want = max((sum(a == b for a, b in zip(words, words[p:])) / (n - p) for p in range(1, n // 3 + 1)), default=0.0)
        assert repeats(words) == pytest.approx(want if want > 0.8 and n >= 6 else 0.0)


def test_a_frequent_middle_word_hides_no_repetition():
    passage = "the man of the house and the dog of the yard saw the cat by the door while the rain fell on the roof of the barn".split()
    passage = passage[1:] + passage[:1]
    for turn in range(len(passage)):
        words = (passage[turn:] + passage[:turn]) * 20
        assert repeats(words) == 1.0
        assert kind_of(shape(" ".join(words), sharer({"en": ["the", "of", "and", "by", "on"]}))) == "junk"


def test_marks_behind_many_others_part_a_list():
    assert items_of("=" * 101 + "&" * 9_900 + " red lamp # blue lamp # old map # new map # grey box") > 3
    line = "/".join(["~ ^"] * 200) + " red lamp one two three four five six seven" * 60
    assert items_of(line) == 0
    assert items_of("".join("$^~&"[i % 4] for i in range(100)) + " red" + "; one two" * 10_000) > 10_000


def test_tables_of_several_kinds_in_one_text():
    tables = ["a\tb\t1\nc\td\t2\ne\tf\t3", "| x | 1 | 2 | 3 |\n| y | 2 | - | 4 |\n| z | 3 | 5 % | 1 |", "k;1;2\nl;2;n/a\nm;3;4"]
    text = "\n\n".join(t + "\nThen we look at the next of them." for t in tables)
    made = shape(text, sharer({"en": "the of and a is it we at then not".split()}))
    assert made["rows"] == 9 and made["sentences"] == 3 and made["items"] == made["junk"] == 0


def test_a_heading_is_no_list():
    made = shape("# Old maps: a box\n\nWe look at the map.", sharer({"en": "the of and a is it we at then not".split()}))
    assert made["items"] == 1 and kind_of(made) == "prose"


@pytest.mark.parametrize("text", ["A b.", 'He said "no."', "Is it? [E12]", "It is (so.)", "Yes.] ", "Look…»"])
def test_ends(text):
    assert ended(text) and not ended(text.rstrip() + " x") and not ended("x [E12]") and not ended("x. [E 12]") and not ended("x. [" + "e" * 13 + "]")
    assert not ended("") and not ended('"') and ended("a." + ")" * 500)


def test_weights():
    assert weigh([]) == weigh([(1.0, 2.0, True)] * 3) == (1.0, 0.0, 0.0)
    lines, score, midway = weigh([(6.0, 9.0, True), (5.0, 7.0, True), (-6.0, 2.0, False), (-5.0, 4.0, False)])
    assert lines > 0 and score > 0 and midway == 5.5


def test_scores_decide_where_lines_are_in_doubt(spark, monkeypatch):
    half = "- red lamp of old\n- blue box of old\nWe look at the map then. It is not a box."
    data = [(i, f"This is the number {i} of the two. It is not the last.", "en") for i in range(150)] + [(200, half, "en")]
    df = spark.createDataFrame(data, "doc_id bigint, text string, lang string")
    labelled = spark.createDataFrame([(f"We look at the map {i}. It is not a box.", "prose") for i in range(5)] + [(f"- one\n- two\n- {i}", "list") for i in range(5)], "text string, text_kind string")
    got = {r.doc_id: r for r in text_quality(df, "doc_id", "text", "lang", labelled).collect()}
    assert got[200].text_kind == "list" and got[0].text_kind == "prose" and got[200].outlier_score > got[0].outlier_score
    alone = {r.doc_id: r.text_kind for r in text_quality(df, "doc_id", "text", "lang").collect()}
    assert alone[200] == "prose"
    assert text_quality(df, "doc_id", "text", "lang", labelled.limit(0)).count() == len(data)


def test_labelled_texts_are_scored_like_equal_ones(spark):
    rng = random.Random(4)
    data = [(i, "en", rng.randint(0, 9), rng.randint(0, 99)) for i in range(300)]
    df = spark.createDataFrame(data, "k bigint, lang string, a bigint, b bigint")
    scored, examples = outlier_scores(df, "k", ["a", "b"], df.limit(20).withColumnRenamed("k", "example_id"))
    want = {r.k: r.outlier_score for r in scored.collect()}
    got = {r.example_id: r.outlier_score for r in examples.collect()}
    assert len(got) == 20 and all(abs(want[k] - got[k]) < 1e-9 for k in got)


def test_ordinals_end_no_sentence():
    share = sharer({"tr": "ve bir geldi çünkü".split()})
    made = shape("Sonuç 15. sırada geldi, çünkü görüntü açık ve bir atölyede.\n1. derslikte\n2. kapıda\n3. evde", share)
    assert made["sentences"] == 1 and made["items"] == 3 and kind_of(made) == "list"
    assert shape("It is 15. We go on.", sharer({"en": ["it", "is", "we", "on"]}))["sentences"] == 2
