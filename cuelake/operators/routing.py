"""Which search a question needs: text features, a frozen linear model, rules, and what a question asks for."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuelake.operators.features import linear, softmax

ROUTES = ["visual", "speech", "hybrid"]
#: Word lists of the route features.
LEXICONS = {
    "speech": """say says said mention mentions mentioned explain explains explained discuss discusses talk talks describe describes hear spoken""".split(),
    "visual": "appear appears visible screen shown showing slide diagram interface page card timeline image picture frame display displayed".split(),
    "color": "red blue green yellow white black orange colored".split(),
    "spatial": "left right above below behind beside inside outside".split(),
    "action": "enter entering leave leaving holding walking crossing".split(),
    "abstract": "concept topic idea abstraction engineering science instructions process method reason overview".split(),
    "object": "person woman man dog cat bicycle bike bus car ball phone speaker screen dashboard keyboard editor table heading slide diagram map button control".split(),
}
#: Means, scales and weights (visual, speech, hybrid) of the 18 route features, in their order.
MEAN = [0.0, 0.0, 2.1687334583803306, 0.3333333333333333, 0.3055555555555556, 0.3611111111111111, 0.6388888888888888, 0.75, 0.1111111111111111,
        0.0, 0.0, 0.1388888888888889, 0.6111111111111112, 0.3333333333333333, 0.08333333333333333, 0.05555555555555555, 0.6388888888888888, 0.3055555555555556]
SCALE = [1.0, 1.0, 0.2838637533794, 0.4714045207910316, 0.46064233199380544, 0.4803226796052939, 0.4803226796052939, 0.7216878364870323, 0.3142696805273545,
         1.0, 1.0, 0.4185144214810935, 0.590563656263036, 0.4714045207910317, 0.2763853991962834, 0.22906142364542562, 0.4803226796052939, 0.4606423319938055]
WEIGHTS = [
    [-0.27696432762617273, 0.24483029770861078, 0.032134029917561424], [0.0, 0.0, 0.0], [-0.6727933248521384, -0.8090403414305384, 1.4818336662826745],
    [-0.27566989573514816, 0.10930448072649379, 0.1663654150086532], [0.23695774471542605, -0.1508011969517976, -0.08615654776362786],
    [0.043302696018697795, 0.03734736966592767, -0.08065006568462553], [-1.7521347069722693, 1.7523435030731551, -0.0002087961008892823],
    [0.31617204046499886, -0.6328598534658948, 0.3166878130008923], [0.6302494975319695, -0.408406725607253, -0.22184277192471794], [0.0, 0.0, 0.0], [0.0, 0.0, 0.0],
    [-0.04698576266498705, -0.007063795248822869, 0.054049557913809984], [0.6468794512629515, -0.7753167584479342, 0.12843730718498422],
    [-0.9265578492133707, -1.1478970706826657, 2.074454919896049], [0.14165333158885504, -0.19173633484116265, 0.05008300325230606],
    [-0.14384770123443955, 0.2705317139739102, -0.12668401273947055], [-0.04330269601869779, -0.03734736966592767, 0.08065006568462554],
    [-0.6639744880910022, 0.3246159868513763, 0.3393585012396236],
]


def words(q: Column) -> Column:
    return F.regexp_extract_all(F.lower(q), F.lit(r"[a-z0-9]+(?:'[a-z]+)?"), F.lit(0))


def count_in(tokens: Column, lexicon: list[str]) -> Column:
    return F.size(F.filter(tokens, lambda t: t.isin(lexicon))).cast("double")


def has(tokens: Column, *any_of: str) -> Column:
    return F.arrays_overlap(tokens, F.array(*map(F.lit, any_of)))


def route_features(q: Column) -> list[Column]:
    """The 18 features of a question, as doubles."""
    t = words(q)
    first = F.coalesce(F.get(t, F.lit(0)), F.lit(""))
    n = {k: count_in(t, v) for k, v in LEXICONS.items()}
    flag = lambda c: c.cast("double")
    return [
        F.lit(1.0), flag(q.rlike("['\"]\\S.+?['\"]")), F.log1p(F.size(t).cast("double")), flag(first == "when"), flag(first == "where"), flag(first == "find"),
        n["speech"], n["visual"], n["color"], n["spatial"], n["action"], n["abstract"], n["object"], flag(has(t, "while")),
        flag(has(t, "screen") & has(t, "on", "shown")), flag(has(t, "narrator", "lecturer", "presenter", "speaker") & (n["speech"] > 0)),
        flag(F.contains(q, F.lit("?"))), flag((n["speech"] > 0) & (n["visual"] > 0)),
    ]


def route(features: list[Column], fallback: float = 0.0) -> tuple[Column, Column]:
    """Route and confidence of the frozen model; below ``fallback`` the route is hybrid."""
    logits = [linear(features, MEAN, SCALE, [w[k] for w in WEIGHTS]) for k in range(len(ROUTES))]
    _, best, sure = softmax(logits, ROUTES)
    return F.when(sure < fallback, "hybrid").otherwise(best), sure


def heuristic_route(q: Column) -> Column:
    t = words(q)
    inn = lambda *names: F.arrays_overlap(t, F.array(*(F.lit(w) for n in names for w in LEXICONS[n])))
    speech, visual = inn("speech"), inn("visual", "color", "spatial")
    return F.when(speech & (has(t, "while") | visual), "HYBRID").when(speech, "SPEECH").when(visual | inn("object", "action"), "VISUAL").otherwise("HYBRID")


def resolved(mode: Column, q_route: Column, enabled: bool) -> Column:
    return F.when(mode != "auto", mode).when(F.lit(not enabled), "hybrid").otherwise(q_route)


#: Number words that a question may ask for, and words of order in time.
NUMBER = dict(zip("one two three four five six seven eight".split(), range(1, 9)))
TEMPORAL = ["prior to", "before", "after", "following", "then", "next", "previously", "later"]


#: The pattern of a requested number, and those of relations that a question may ask for.
COUNTED = r"\b(?:what|which|name|list|give|identify)\s+(\d+|" + "|".join(NUMBER) + r")\b"
RELATIONS = {
    "cause_or_reason": r"\b(?:why|cause|causes|reason|reasons)\b", "comparison": r"\b(?:compare|comparison|difference|differ)\b",
    "definition_or_fact": r"\b(?:define|definition|what (?:is|are|does))\b", "list": r"\b(?:list|approaches|reasons|steps)\b",
}


def _chain(pairs, default):
    out = F.when(pairs[0][0], pairs[0][1])
    for c, v in pairs[1:]:
        out = out.when(c, v)
    return out.otherwise(default)


def requested_count(q: Column) -> Column:
    """The number that a question asks for, in digits or in words up to eight; null without."""
    found = F.regexp_extract(F.lower(q), COUNTED, 1)
    return F.when(found.rlike(r"^\d+$"), F.try_to_number(found, F.lit("999999999")).cast("int")).otherwise(_chain([(found == w, n) for w, n in NUMBER.items()], None))


def temporal_term(q: Column) -> Column:
    return _chain([(F.lower(q).rlike(rf"\b{w}\b"), w) for w in TEMPORAL], None)


def temporal_relation(q: Column) -> Column:
    t = temporal_term(q)
    return F.when(t.isin("before", "previously", "prior to"), "BEFORE").when(t.isNotNull(), "AFTER")


def temporal_anchor(q: Column) -> Column:
    """What follows the word of time, up to a question mark or the end, without blanks and points around it."""
    low = F.lower(q)
    got = _chain([(low.rlike(rf"\b{w}\b"), F.regexp_extract(low, rf"\b{w}\b\s+(.+?)(?:\?|$)", 1)) for w in TEMPORAL], None)
    return F.nullif(F.btrim(got, F.lit(" .")), F.lit(""))


def relation_types(q: Column) -> Column:
    low = F.lower(q)
    said = {name: low.rlike(pattern) for name, pattern in RELATIONS.items()}
    said["list"] = said["list"] | requested_count(q).isNotNull()
    said["temporal"] = temporal_relation(q).isNotNull()
    return F.array_compact(F.array(*(F.when(c, name) for name, c in said.items())))


#: What lies outside the questions that can be answered, by the first pattern that matches.
SCOPES = [
    ("TEMPORAL_ORDERING", r"\b(?:first|last)\s+(?:thing|step|event)\b"),
    ("LONG_RANGE_COMPOSITIONAL", r"\b(?:entire|whole)\s+video\b|\bthroughout\s+the\s+video\b|\b(?:compare|connect)\b.*\b(?:beginning|start)\b.*\b(?:end|ending)\b|\b(?:all|every)\s+(?:argument|topic|point|claim)s?\b"),
    ("OCR_DEPENDENT", r"\b(?:what does|what do)\b.*\b(?:slide|screen|caption|label|button|error message|code)\b.*\b(?:say|read|show)\b|\btext on (?:the )?screen\b|\b(?:read|transcribe)\s+(?:the\s+)?(?:slide|screen|caption)\b"),
    ("VISUAL_ONLY", r"\b(?:what|which)\s+(?:color|colour)\b|\bwhat (?:is|are) (?:visible|shown)\b|\b(?:wearing|look like|on screen|in the image|in the frame|in the diagram|visual object)\b"),
]


def scope(q: Column) -> Column:
    low = F.btrim(F.regexp_replace(F.lower(q), r"\s+", " "))
    pairs = [(requested_count(q).isNotNull() | low.rlike(r"\b(?:list|enumerate)\b"), "EXPLICIT_LIST_COUNT"), (temporal_relation(q).isNotNull() & low.rlike(r"^(?:what|which|who|where|when)\b"), "TEMPORAL_ORDERING")]
    return _chain([*pairs, *((low.rlike(p), n) for n, p in SCOPES)], "SUPPORTED_CORE")


#: Object names and the classes a detector would know them by; groups are joined by "and", classes by "or".
ALIASES = [
    ("mobile phone", [["cell phone"]]), ("cellphone", [["cell phone"]]), ("smartphone", [["cell phone"]]), ("phone", [["cell phone"]]),
    ("sports ball", [["sports ball"]]), ("ball", [["sports ball"]]), ("bicycle", [["bicycle"]]), ("bike", [["bicycle"]]), ("cyclist", [["person"], ["bicycle"]]),
    ("backpack", [["backpack"]]), ("bag", [["backpack", "handbag"]]), ("bottle", [["bottle"]]), ("cup", [["cup"]]), ("city bus", [["bus"]]), ("bus", [["bus"]]),
    ("car", [["car"]]), ("dog", [["dog"]]), ("airplane", [["airplane"]]), ("aeroplane", [["airplane"]]), ("table", [["dining table"]]), ("pedestrian", [["person"]]),
    ("children", [["person"]]), ("child", [["person"]]), ("woman", [["person"]]), ("man", [["person"]]), ("person", [["person"]]), ("speaker", [["person"]]), ("jumper", [["person"]]),
]


def object_aliases(q: Column) -> Column:
    """Aliases that a question names, in list order; one that lies in another that was taken is left out."""
    padded = F.concat(F.lit(" "), F.btrim(F.regexp_replace(F.regexp_replace(F.lower(q), r"[^\p{L}\p{N}_\s]", " "), r"\s+", " ")), F.lit(" "))
    named = F.filter(F.array(*(F.lit(a) for a, _ in ALIASES)), lambda a: F.contains(padded, F.concat(F.lit(" "), a, F.lit(" "))))
    return F.aggregate(named, F.array().cast("array<string>"), lambda acc, a: F.when(F.exists(acc, lambda b: F.contains(a, b) | F.contains(b, a)), acc).otherwise(F.array_append(acc, a)))


def class_groups(aliases: Column) -> Column:
    """The distinct class groups that aliases stand for."""
    table = F.create_map(*(x for a, g in ALIASES for x in (F.lit(a), F.array(*(F.array(*map(F.lit, c)) for c in g)))))
    return F.array_distinct(F.flatten(F.transform(aliases, lambda a: F.try_element_at(table, a))))


#: Turkish case endings, the longer ones first.
TURKISH_SUFFIXES = "lerinden larından lerden lardan inde ında unda ünde den dan ten tan nin nın nun nün yi yı yu yü i ı u ü".split()
#: Roots of Turkish words that ask for speech and for pictures, things that are seen, words that join both
#: kinds of request, and roots that only carry a request.
SPEECH_ROOTS = ["anlat", "açıkla", "bahset", "konuş", "söyle", "duy", "dedi", "ifade"]
VISUAL_ROOTS = ["gör", "göster", "ekran", "slayt", "çizim", "şema", "fotoğraf", "görüntü", "sayfa", "buton", "panel", "kutu", "arka", "ön", "yan"]
VISUAL_OBJECTS = ["adam", "kadın", "kişi", "insan", "telefon", "pencere", "logo", "dünya", "el", "kask", "mağara", "araç", "taş", "tren", "takvim"]
CONNECTORS = ["anlatırken", "bahsederken", "konuşurken", "söylerken", "gösterirken", "ekrandayken"]
STOP_ROOTS = ["an", "anlat", "açıkla", "bahset", "bölüm", "bul", "göster", "gör", "kısım", "konuş", "nerede", "söyle", "yer"]
#: Words for a part of a video, which say nothing of what is in it.
PART_WORDS = ["kısım", "bölüm", "yer"]
#: Turkish words and the English ones that images are described by.
TURKISH_ENGLISH = {
    "açık": "open", "adam": "man", "akım": "current", "arka": "background", "başlık": "title", "beyaz": "white", "buz": "ice", "buton": "button",
    "çalışma": "work", "çeviri": "translation", "dijital": "digital", "dil": "language", "dünya": "world", "ekran": "screen", "fotoğraf": "photo",
    "görüntü": "image", "harita": "map", "insan": "person", "iki": "two", "işlemci": "processor", "kadın": "woman", "kanun": "law", "kategori": "category",
    "kırmızı": "red", "kutu": "box", "lisans": "license", "madde": "article", "mavi": "blue", "mühendislik": "engineering", "pencere": "window",
    "programlama": "programming", "sarı": "yellow", "sayfa": "page", "siyah": "black", "slayt": "slide", "soyutlama": "abstraction", "şema": "diagram",
    "takvim": "calendar", "telefon": "phone", "tren": "train", "yükle": "upload", "yükleme": "upload",
}
_WORD_CHARS = r"\p{L}\p{N}_"
#: Names in capitals, letters that aren't capitals, and single capitals.
_NAME = rf"(?<![{_WORD_CHARS}])[A-Z][A-Z0-9+#.]+(?![{_WORD_CHARS}])"
_PIECES = rf"{_NAME}|[^A-Z]+|[A-Z]"


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None else unicodedata.normalize("NFC", x))


def composed(text: Column) -> Column:
    """Composed Unicode form. Texts without a character from U+0300 on have it already and don't go through Python."""
    return F.coalesce(_nfc(F.when(text.rlike(r"[^\x{0}-\x{2FF}]"), text)), text)


def turkish_lower(text: Column) -> Column:
    """Small letters by Turkish rules for I and İ, but for names in capitals; composed form, apostrophes alike, white space single."""
    plain = F.translate(composed(text), "’‘", "''")
    small = lambda t: F.lower(F.translate(t, "Iİ", "ıi"))
    pieces = F.transform(F.regexp_extract_all(plain, F.lit(_PIECES), F.lit(0)), lambda p: F.when(p.rlike(r"^[A-Z][A-Z0-9+#.]+$"), F.lower(p)).otherwise(small(p)))
    low = F.when(plain.rlike(_NAME), F.array_join(pieces, "")).otherwise(small(plain))
    return F.btrim(F.regexp_replace(low, r"(?U)\s+", " "))


def turkish_words(text: Column) -> Column:
    return words_of(turkish_lower(text))


def words_of(low: Column) -> Column:
    return F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}]+(?:'[\p{L}\p{N}]+)?"), F.lit(0))


def base_token(token: Column) -> Column:
    return F.split_part(token, F.lit("'"), F.lit(1))


def turkish_stem(token: Column) -> Column:
    """The part before an apostrophe without the first listed ending that leaves four letters.

    Of endings that end alike the longer are listed first, so the first one is the longest: the shortest start of four
    letters or more that one of them completes.
    """
    return F.regexp_replace(base_token(token), "^(.{4,}?)(?:" + "|".join(TURKISH_SUFFIXES) + ")$", "$1")


def _rooted(token: Column, roots: list[str]) -> Column:
    """Whether a token, and so its part before an apostrophe, begins with a root."""
    return token.rlike("^(?:" + "|".join(roots) + ")")


def root_count(tokens: Column, roots: list[str]) -> Column:
    return F.size(F.filter(tokens, lambda t: _rooted(t, roots)))


def turkish_counts(text: Column, low: Column) -> dict[str, Column]:
    """What Turkish routing looks at, of a text and its ``turkish_lower`` form: numbers of roots, connectors and plain technical words."""
    t = words_of(low)
    raw = F.regexp_extract_all(text, F.lit(r"(?U)\S+"), F.lit(0))
    return {
        "tokens": F.size(t), "speech": root_count(t, SPEECH_ROOTS), "visual": root_count(t, VISUAL_ROOTS), "objects": root_count(t, VISUAL_OBJECTS),
        "connectors": reduce(lambda a, b: a + b, (F.contains(low, F.lit(c)).cast("int") for c in CONNECTORS)),
        "technical": F.size(F.filter(raw, lambda w: w.rlike(r"^[a-zA-Z0-9+#.]+(?:'[A-Za-z]+)?$"))),
    }


def turkish_features(text: Column, low: Column) -> list[Column]:
    """The 14 features of a Turkish request, as doubles."""
    n, t = turkish_counts(text, low), words_of(low)
    first = base_token(F.coalesce(F.get(t, F.lit(0)), F.lit("")))
    seen = n["visual"] + n["objects"] > 0
    part = F.exists(t, lambda w: base_token(w).isin(PART_WORDS)) & (n["speech"] == 0) & ~seen
    out = [
        F.lit(1), F.log1p(n["tokens"].cast("double")), n["speech"], n["visual"], n["objects"], n["connectors"], (n["speech"] > 0) & seen, (n["speech"] > 0) & (n["connectors"] > 0),
        F.contains(text, F.lit("?")), first.startswith("bul"), first.startswith("göster"), F.contains(low, F.lit("'")), n["technical"], part,
    ]
    return [c.cast("double") for c in out]


def turkish_route(counts: dict[str, Column]) -> tuple[Column, Column]:
    """Route by rule, and its reasons: speech with a connector needs both, speech or things seen alone one search."""
    says = counts["speech"] > 0
    seen = counts["visual"] + counts["objects"] > 0
    both = says & (counts["connectors"] > 0)
    r = lambda *x: F.array(*map(F.lit, x))
    route = F.when(both, "HYBRID").when(says, "SPEECH").when(seen, "VISUAL").otherwise("HYBRID")
    return route, F.when(both, r("turkish_speech_intent", "visual_context")).when(says, r("turkish_speech_intent")).when(seen, r("turkish_visual_intent")).otherwise(r("ambiguous"))


def turkish_tokens(low: Column) -> Column:
    """Stemmed words of a ``turkish_lower`` text without those that only carry a request: the tokens of Turkish search."""
    return F.transform(F.filter(words_of(low), lambda t: ~_rooted(t, STOP_ROOTS)), turkish_stem)


def _english(token: Column) -> Column:
    base = base_token(token)
    table = F.create_map(*(F.lit(x) for kv in TURKISH_ENGLISH.items() for x in kv))
    starts = [(base.startswith(k), v) for k, v in TURKISH_ENGLISH.items() if len(k) >= 4]
    return F.coalesce(F.try_element_at(table, base), _chain(starts, None), F.when(base.rlike(r"^[a-z0-9+#.]+$"), base))


def adapted_visual(low: Column) -> Column:
    """A ``turkish_lower`` request in English words for image search: listed and plain technical words; the request itself if none is left."""
    kept = F.filter(words_of(low), lambda t: ~_rooted(t, STOP_ROOTS))
    return F.coalesce(F.nullif(F.array_join(F.array_compact(F.transform(kept, _english)), " "), F.lit("")), low)


def adapted_speech(low: Column, language: Column) -> Column:
    """For English transcripts the English words, else the tokens of Turkish search."""
    return F.when(language.eqNullSafe(F.lit("en")), adapted_visual(low)).otherwise(F.array_join(turkish_tokens(low), " "))
