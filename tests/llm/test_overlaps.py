import pytest
from pyspark.sql import functions as F

from cuelake.llm import overlaps
from cuelake.llm.overlaps import pairs, same_requests
from cuelake.llm.requests import READINGS, Speller, distance, ngrams, rarest, readings, slips_only, variants, words

BASE = "Find the baker in an apron carrying a golden ladder in the waiting room before the Memokepan parade, take 89."
SAME = [
    "IN THE WAITING ROOM BEFORE THE MEMOKEPAN PARADE, JUMP TO THE BAKER IN AN APRON CARRYING A GOLDEN LADDER, TAKE 89",
    "um find the the bakr in an apron carrying golden lader in the waiting room before the Memokpean parade take eighty-nine",
    "In the wait​ing room before the Memokepan parade, show the baker in an apron carrying a goldenladder, take 89.",
]
OTHER = [
    BASE.replace("89", "98"), BASE.replace("golden", "silver"), BASE.replace("baker", "nurse"), BASE.replace("Memokepan", "Dofabregan"),
    BASE.replace("carrying", "not carrying"), BASE.replace(", take 89", ""), BASE.replace("waiting room", "kitchen"), BASE.replace("apron", "apron with nobody else around"),
]
FILLER = ["the baker in an apron carrying a golden ladder", "nurse silver kitchen waiting room before during parade take not with nobody else around"] * 6


@pytest.fixture(scope="module")
def speller():
    counts = {}
    for t in FILLER:
        for w in set(words(t)):
            counts[w] = counts.get(w, 0) + 1
    return Speller(counts)


def same(a, b, speller):
    return any(x.sure == y.sure and slips_only(x.doubtful, y.doubtful) for x in readings(words(a), speller) for y in readings(words(b), speller))


def test_same_and_other_requests(speller):
    for t in SAME:
        assert same(BASE, t, speller), t
    for t in OTHER:
        assert not same(BASE, t, speller), t


@pytest.mark.parametrize("a,b", [
    ("kettle marlowen", "kettle mralowne"), ("kettle abcdefgh", "kettle abxdefyh"), ("kettle zorvath", "kettle zovraht"), ("kettle zorvan mikkel", "kettle zovran mikkle"),
    ("kettle zorvan mikkel", "mikkle kettle zovran"), ("the saddle zorvathkettle", "saddle kettle zorvath"),
])
def test_slips_in_names(a, b):
    speller = Speller({"kettle": 9, "saddle": 9})
    assert same(a, b, speller) and not same(a, b + " 7", speller)
    x, y = ([r for r in readings(words(t), speller) if r.doubtful] for t in (a, b))
    assert any(set().union(*map(variants, r.doubtful)) & set().union(*map(variants, q.doubtful)) for r in x for q in y)


def test_a_slip_may_stand_for_several_words():
    speller = Speller({"lighting": 5, "lifting": 9, "stage": 9, "climber": 9, "take": 9})
    for t in ("stage lighting", "stage lifting"):
        assert same(t, "stage ligting", speller)
    assert not same("stage lighting", "stage lifting", speller) and same("climber", "cimer", speller)
    many = readings(["ligting"] * 12 + ["stage"], speller)
    assert 1 < len(many) <= READINGS and all("stage" in r.sure for r in many)


@pytest.mark.parametrize("a,b", [("Find the dancer on stage", "Find thedancar on stage"), ("Find the dancer on stage", "Find thedaancer on stage"), ("dancer kettle", "dacnerkettle"), ("Bul: dancer stage", "Lüttfen bul dancer stage")])
def test_slips_in_run_together_and_rare_introducing_words(a, b):
    speller = Speller({"the": 20, "on": 20, "find": 20, "bul": 9, "dancer": 9, "kettle": 9, "stage": 9})
    assert same(a, b, speller) and not same(a.replace("dancer", "farmer"), b, speller)


def test_grams():
    assert ngrams(["a", "b"]) == [("a", "b")] and ngrams([]) == [()] and len(ngrams(list("abcdefg"))) == 3
    assert rarest(ngrams(list("abcdef")), {"b": 0.0, "f": 1.6}) == tuple("abcde")
    assert slips_only(["marlowen", "mralowne"], ["mralowne", "marlowen"]) and not slips_only(["marlowen"], []) and slips_only([], [])


def test_words():
    assert words("Şu anı bul: İKİ  kız—25. bölümde") == ["su", "ani", "bul", "2", "kiz", "25", "bolumde"]
    assert words("take twenty-five, take 025, TAKE twenty") == ["take", "25", "take", "25", "take", "20"]
    assert words(None) == words(" ​") == [] and words("th​e sailor's hat") == ["the", "sailor", "hat"]


def test_distance():
    assert [distance(a, b, 2) for a, b in (("ab", "ba"), ("abc", "abd"), ("abc", "abcd"), ("abcdef", "uvwxyz"), ("", ""))] == [1, 1, 1, 3, 0]


@pytest.mark.parametrize("task,gram,pair", [(5_000, 10_000, 1_000_000), (2, 0, 1)])
def test_operator(spark, monkeypatch, task, gram, pair):
    monkeypatch.setattr(overlaps, "MEMBERS_A_TASK", task)
    monkeypatch.setattr(overlaps, "PAIRS_A_GRAM", gram)
    monkeypatch.setattr(overlaps, "PAIRS_A_TASK", pair)
    e = [(f"e{i}", t) for i, t in enumerate([BASE, *SAME, *OTHER])] + [("x", None), ("y", ""), (None, BASE), ("z", " "), ("only", "find the"), ("slip", "golden marlowen")]
    t = [(f"t{i}", BASE) for i in range(7)] + [("u0", None), ("u1", ""), ("far", "something else entirely"), ("only2", "Find  the?"), ("slip2", "golden mralowne"), ("name2", "golden mralowfe")] + [(f"f{i}", t) for i, t in enumerate(FILLER)]
    mk = lambda rows: spark.createDataFrame(rows + rows[:2], "id string, text string").withColumns({"side": F.lit(0), "class": F.lit("clash"), "n": F.lit(2)})
    hits, members = same_requests(mk(e), mk(t), "id", "text")
    got = {(r.eval_key, r.train_key) for r in pairs(hits, members, "id").collect()}
    assert got == {(f"e{i}", f"t{k}") for i in range(4) for k in range(7)} | {("only", "only2"), ("slip", "slip2")}
    assert pairs(hits, members, "id").count() == len(got)
    share = {r.eval_key: r.containment for r in pairs(hits, members, "id").collect()}
    assert share == {"e0": 1.0, "e1": 1.0, "e2": 1.0, "e3": 1.0, "only": 1.0, "slip": 0.5}
    hits, members = same_requests(mk(e).limit(0), mk(t), "id", "text")
    assert pairs(hits, members, "id").count() == 0


def test_found_finds_equal_texts(spark):
    d = "/root/testdata/sf0.01"
    got = {tuple(r) for r in overlaps.found(spark, d).select("query_a", "query_b").collect()}
    q = spark.read.parquet(f"{d}/queries.parquet").select("query_id", "video_id", "query_text").distinct()
    v = spark.read.parquet(f"{d}/videos.parquet").selectExpr("video_id", "regexp_replace(lower(split), '[ _-]', '') s").distinct()
    rows = q.join(v, "video_id").collect()
    equal = {tuple(sorted((a.query_id, b.query_id))) for a in rows if a.s == "train" for b in rows if b.s in ("calibration", "heldout") and a.query_text.lower() == b.query_text.lower()}
    assert equal and equal <= got
    assert all(a < b for a, b in got)
    n = sum(r.pairs for r in overlaps.counts(spark, d).collect())
    assert n == len(got)
