"""Routing, scope and text classification over the test tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuelake.operators import routing as rt
from cuelake.operators.text import tf_idf
from cuelake.plans.common import Registry
from cuelake.sources import views
from cuelake.sources.tables import load

query = Registry()
QUERIES, SQL = query.queries, query.sql

#: The queries' texts, and questions made of them: each form of question over each text.
FORMS = ["{}", "What happens before {}?", "Name three things about {}", "What color is the lamp when {}", "List the steps after {}?", "Why does {} matter?", "Compare the beginning and the end of {}", "What does the slide say in {}"]
QS = "qs AS (" + " UNION ALL ".join("SELECT query_id, " + str(i) + " AS form, " + " || ".join(x for x in (f"'{a}'" if a else "", "query_text", f"'{b}'" if b else "") if x) + " AS q FROM qry" for i, (a, b) in enumerate(f.split("{}") for f in FORMS)) + ")"


def questions(spark, d):
    q = views.queries(spark, d).select("query_id", "query_text")
    made = F.array(*(F.struct(F.lit(i).alias("form"), F.concat(F.lit(a), F.col("query_text"), F.lit(b)).alias("q")) for i, (a, b) in enumerate(f.split("{}") for f in FORMS)))
    return q.select("query_id", F.inline(made))


def lst(words):
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def cnt(lex):
    return f"CAST(len(list_filter(t, lambda x: x IN ({', '.join(repr(w) for w in rt.LEXICONS[lex])}))) AS DOUBLE)"


FEATURES = ["1e0", "CAST(regexp_matches(q, '[''\"]\\S.+?[''\"]') AS INT)", "ln(1 + len(t))", "CAST(coalesce(t[1], '') = 'when' AS INT)", "CAST(coalesce(t[1], '') = 'where' AS INT)", "CAST(coalesce(t[1], '') = 'find' AS INT)",
            *(cnt(x) for x in ("speech", "visual", "color", "spatial", "action", "abstract", "object")), "CAST(list_contains(t, 'while') AS INT)", "CAST(list_contains(t, 'screen') AND list_has_any(t, ['on', 'shown']) AS INT)",
            f"CAST(list_has_any(t, ['narrator', 'lecturer', 'presenter', 'speaker']) AND {cnt('speech')} > 0 AS INT)", "CAST(contains(q, '?') AS INT)", f"CAST({cnt('speech')} > 0 AND {cnt('visual')} > 0 AS INT)"]
FEATS = f"WITH {QS}, w AS (SELECT *, regexp_extract_all(lower(replace(q, 'İ', 'i' || chr(775))), '[a-z0-9]+(?:''[a-z]+)?') AS t FROM qs), x AS (SELECT query_id, form, q, t, " + ", ".join(f"CAST({e} AS DOUBLE) AS f{i}" for i, e in enumerate(FEATURES)) + " FROM w)"
LOGITS = ", l AS (SELECT query_id, form, " + ", ".join("(" + " + ".join(f"(f{i} - {m!r}) / {s!r} * ({w[k]!r})" for i, (m, s, w) in enumerate(zip(rt.MEAN, rt.SCALE, rt.WEIGHTS))) + f") AS z{k}" for k in range(3)) + " FROM x)"


@query("q01_words", "qry", f"WITH {QS} SELECT query_id, form, regexp_extract_all(lower(replace(q, 'İ', 'i' || chr(775))), '[a-z0-9]+(?:''[a-z]+)?') AS words FROM qs")
def words(spark, d):
    return questions(spark, d).select("query_id", "form", rt.words(F.col("q")).alias("words"))


@query("q02_features", "qry", FEATS + " SELECT query_id, form, [" + ", ".join(f"round(f{i}, 6)" for i in range(18)) + "] AS features FROM x")
def features(spark, d):
    return questions(spark, d).select("query_id", "form", F.array(*(F.round(c.cast("double"), 6) for c in rt.route_features(F.col("q")))).alias("features"))


@query("q03_route", "qry", FEATS + LOGITS + " SELECT query_id, form, CASE WHEN z0 >= greatest(z1, z2) THEN 'visual' WHEN z1 >= z2 THEN 'speech' ELSE 'hybrid' END AS route, round(1 / (exp(z0 - greatest(z0, z1, z2)) + exp(z1 - greatest(z0, z1, z2)) + exp(z2 - greatest(z0, z1, z2))), 6) AS confidence FROM l")
def route(spark, d):
    r, sure = rt.route(rt.route_features(F.col("q")))
    return questions(spark, d).select("query_id", "form", r.alias("route"), F.round(sure, 6).alias("confidence"))


@query("q04_mode", "qry", f"WITH {QS} SELECT query_id, form, CASE form WHEN 0 THEN 'visual' WHEN 1 THEN 'speech' ELSE 'hybrid' END AS mode FROM qs")
def mode(spark, d):
    """An explicit mode holds; with routing switched off, auto means hybrid."""
    asked = F.when(F.col("form") == 0, "visual").when(F.col("form") == 1, "speech").otherwise("auto")
    return questions(spark, d).select("query_id", "form", rt.resolved(asked, F.lit("visual"), False).alias("mode"))


HEUR = "CASE WHEN s AND (list_contains(t, 'while') OR v) THEN 'HYBRID' WHEN s THEN 'SPEECH' WHEN v OR o THEN 'VISUAL' ELSE 'HYBRID' END"


@query("q05_heuristic", "qry", FEATS + f", h AS (SELECT *, f6 > 0 AS s, f7 + f8 + f9 > 0 AS v, f12 + f10 > 0 AS o FROM x) SELECT query_id, form, {HEUR} AS route FROM h")
def heuristic(spark, d):
    return questions(spark, d).select("query_id", "form", rt.heuristic_route(F.col("q")).alias("route"))


@query("q06_target", "qry", "SELECT query_id, CASE modality_requirement WHEN 'visual' THEN 'VISUAL' WHEN 'speech' THEN 'SPEECH' WHEN 'hybrid' THEN 'HYBRID' WHEN 'temporal' THEN 'VISUAL' END AS target FROM qry")
def target(spark, d):
    m = F.create_map(*(F.lit(x) for kv in {"visual": "VISUAL", "speech": "SPEECH", "hybrid": "HYBRID", "temporal": "VISUAL"}.items() for x in kv))
    return views.queries(spark, d).select("query_id", F.try_element_at(m, F.col("modality_requirement")).alias("target"))


COUNT = "regexp_extract(lower(replace(q, 'İ', 'i' || chr(775))), '\\b(?:what|which|name|list|give|identify)\\s+(\\d+|one|two|three|four|five|six|seven|eight)\\b', 1)"
TERM = "CASE " + " ".join(f"WHEN regexp_matches(lower(replace(q, 'İ', 'i' || chr(775))), '\\b{w}\\b') THEN '{w}'" for w in rt.TEMPORAL) + " END"
CONS = f"""WITH {QS}, a AS (SELECT *, {COUNT} AS cw, {TERM} AS term FROM qs),
c AS (SELECT *, CASE WHEN regexp_full_match(cw, '\\d+') THEN CAST(cw AS INT) ELSE CASE cw {' '.join(f"WHEN '{w}' THEN {n}" for w, n in rt.NUMBER.items())} END END AS n, CASE WHEN term IN ('before', 'previously', 'prior to') THEN 'BEFORE' WHEN term IS NOT NULL THEN 'AFTER' END AS rel FROM a)"""


@query("q09_constraints", "qry", CONS + r""" SELECT query_id, form, n AS requested_count, rel AS temporal_relation, CASE term """ + " ".join(f"WHEN '{w}' THEN nullif(trim(regexp_extract(lower(replace(q, 'İ', 'i' || chr(775))), '\\b{w}\\b\\s+(.+?)(?:\\?|$)', 1), ' .'), '')" for w in rt.TEMPORAL) + r""" END AS temporal_anchor,
list_filter([CASE WHEN regexp_matches(lower(replace(q, 'İ', 'i' || chr(775))), '\b(?:why|cause|causes|reason|reasons)\b') THEN 'cause_or_reason' END, CASE WHEN regexp_matches(lower(replace(q, 'İ', 'i' || chr(775))), '\b(?:compare|comparison|difference|differ)\b') THEN 'comparison' END,
CASE WHEN regexp_matches(lower(replace(q, 'İ', 'i' || chr(775))), '\b(?:define|definition|what (?:is|are|does))\b') THEN 'definition_or_fact' END, CASE WHEN n IS NOT NULL OR regexp_matches(lower(replace(q, 'İ', 'i' || chr(775))), '\b(?:list|approaches|reasons|steps)\b') THEN 'list' END, CASE WHEN rel IS NOT NULL THEN 'temporal' END], lambda x: x IS NOT NULL) AS relations FROM c""")
def constraints(spark, d):
    q = F.col("q")
    return questions(spark, d).select("query_id", "form", rt.requested_count(q).alias("requested_count"), rt.temporal_relation(q).alias("temporal_relation"), rt.temporal_anchor(q).alias("temporal_anchor"), rt.relation_types(q).alias("relations"))


SCOPE_SQL = CONS + r", s AS (SELECT *, trim(regexp_replace(lower(replace(q, 'İ', 'i' || chr(775))), '\s+', ' ', 'g')) AS low FROM c) SELECT query_id, form, CASE WHEN n IS NOT NULL OR regexp_matches(low, '\b(?:list|enumerate)\b') THEN 'EXPLICIT_LIST_COUNT' WHEN rel IS NOT NULL AND regexp_matches(low, '^(?:what|which|who|where|when)\b') THEN 'TEMPORAL_ORDERING' " + " ".join(f"WHEN regexp_matches(low, '{p}') THEN '{n}'" for n, p in rt.SCOPES) + " ELSE 'SUPPORTED_CORE' END AS scope FROM s"


@query("q08_scope", "qry", SCOPE_SQL)
def scope(spark, d):
    return questions(spark, d).select("query_id", "form", rt.scope(F.col("q")).alias("scope"))


#: SQL of Turkish words: pieces of word characters, +, # and points; those all in capitals are names.
TRL = """(SELECT *, trim(regexp_replace(array_to_string(list_transform(regexp_extract_all(replace(replace(nfc_normalize({1}), '’', ''''), '‘', ''''), '[\\p{{L}}\\p{{N}}_+#.]+|[^\\p{{L}}\\p{{N}}_+#.]+'),
  lambda p: CASE WHEN regexp_matches(p, '^[+#.]*[A-Z][A-Z0-9+#.]+$') THEN lower(p) ELSE lower(translate(p, 'Iİ', 'ıi')) END), ''), '[\\s\\x0b\\x{{85}}\\p{{Z}}]+', ' ', 'g')) AS low FROM {0})"""
TRW = "w AS (SELECT *, regexp_extract_all(low, '[\\p{L}\\p{N}]+(?:''[\\p{L}\\p{N}]+)?') AS ws FROM " + TRL.format("qry", "query_text") + " tl)"


def rooted(roots):
    return " OR ".join(f"starts_with(split_part(t, '''', 1), {r!r})" for r in roots)


def starts(roots):
    return f"len(list_filter(ws, lambda t: {rooted(roots)}))"


TECH = "len(list_filter(string_split_regex(query_text, '[\\s\\x0b\\x{85}\\p{Z}]+'), lambda r: regexp_full_match(r, '[a-zA-Z0-9+#.]+(?:''[A-Za-z]+)?')))"
TRC = f"c AS (SELECT query_id, query_text, low, ws, {starts(rt.SPEECH_ROOTS)} AS s, {starts(rt.VISUAL_ROOTS)} AS v, {starts(rt.VISUAL_OBJECTS)} AS o, {' + '.join(f'CAST(contains(low, {c!r}) AS INT)' for c in rt.CONNECTORS)} AS c, coalesce(split_part(ws[1], '''', 1), '') AS f1, {TECH} AS tech FROM w)"
TRFEATS = ["1", "ln(1 + len(ws))", "s", "v", "o", "c", "CAST(s > 0 AND v + o > 0 AS INT)", "CAST(s > 0 AND c > 0 AS INT)", "CAST(contains(query_text, '?') AS INT)", "CAST(starts_with(f1, 'bul') AS INT)", "CAST(starts_with(f1, 'göster') AS INT)", "CAST(contains(low, '''') AS INT)", "tech",
           f"CAST(s = 0 AND v + o = 0 AND len(list_filter(ws, lambda t: split_part(t, '''', 1) IN ({', '.join(map(repr, rt.PART_WORDS))}))) > 0 AS INT)"]


def turkish(spark, d):
    return views.queries(spark, d).select("query_id", "video_id", "query_text", rt.turkish_lower(F.col("query_text")).alias("low"))


@query("q10_turkish_words", "qry", f"WITH {TRW} SELECT query_id, low, ws AS words FROM w")
def turkish_words(spark, d):
    return turkish(spark, d).select("query_id", "low", rt.words_of(F.col("low")).alias("words"))


@query("q11_turkish_features", "qry", f"WITH {TRW}, {TRC} SELECT query_id, [" + ", ".join(f"round(CAST({e} AS DOUBLE), 6)" for e in TRFEATS) + "] AS features FROM c")
def turkish_features(spark, d):
    f = rt.turkish_features(F.col("query_text"), F.col("low"))
    return turkish(spark, d).select("query_id", F.array(*(F.round(c, 6) for c in f)).alias("features"))


@query("q11_turkish_route", "qry", f"WITH {TRW}, {TRC} SELECT query_id, CASE WHEN s > 0 AND c > 0 THEN 'HYBRID' WHEN s > 0 THEN 'SPEECH' WHEN v + o > 0 THEN 'VISUAL' ELSE 'HYBRID' END AS route, CASE WHEN s > 0 AND c > 0 THEN ['turkish_speech_intent', 'visual_context'] WHEN s > 0 THEN ['turkish_speech_intent'] WHEN v + o > 0 THEN ['turkish_visual_intent'] ELSE ['ambiguous'] END AS reasons FROM c")
def turkish_route(spark, d):
    t = turkish(spark, d)
    r, why = rt.turkish_route(rt.turkish_counts(F.col("query_text"), F.col("low")))
    return t.select("query_id", r.alias("route"), why.alias("reasons"))


STEM = "CASE " + " ".join(f"WHEN len(b) >= {len(x) + 4} AND ends_with(b, '{x}') THEN left(b, len(b) - {len(x)})" for x in rt.TURKISH_SUFFIXES) + " ELSE b END"
BASES = f"list_transform(list_filter(ws, lambda t: NOT ({rooted(rt.STOP_ROOTS)})), lambda t: split_part(t, '''', 1))"
ENGLISH = "CASE " + " ".join(f"WHEN b = {k!r} THEN {v!r}" for k, v in rt.TURKISH_ENGLISH.items()) + " " + " ".join(f"WHEN starts_with(b, {k!r}) THEN {v!r}" for k, v in rt.TURKISH_ENGLISH.items() if len(k) >= 4) + " WHEN regexp_full_match(b, '[a-z0-9+#.]+') THEN b END"
VISUAL = f"coalesce(nullif(array_to_string(list_filter(list_transform({BASES}, lambda b: {ENGLISH}), lambda x: x IS NOT NULL), ' '), ''), low)"
TRTOKENS = "(SELECT *, list_transform(" + BASES + ", lambda b: " + STEM + ") AS tokens FROM (SELECT *, regexp_extract_all(low, '[\\p{{L}}\\p{{N}}]+(?:''[\\p{{L}}\\p{{N}}]+)?') AS ws FROM " + TRL + " tl) tw)"


@query("q12_turkish_stems", "qry", f"WITH {TRW} SELECT query_id, list_transform({BASES}, lambda b: {STEM}) AS stems FROM w")
def turkish_stems(spark, d):
    """Words without the ones that carry the request, stemmed: the tokens of Turkish search."""
    return turkish(spark, d).select("query_id", rt.turkish_tokens(F.col("low")).alias("stems"))


@query("q12_turkish_adapted", "qry", f"WITH {TRW}, l AS (SELECT DISTINCT video_id FROM documents WHERE video_id IS NOT NULL AND lower(split_part(replace(lang, '_', '-'), '-', 1)) = 'en') SELECT query_id, {VISUAL} AS visual, CASE WHEN video_id IN (SELECT video_id FROM l) THEN {VISUAL} ELSE array_to_string(list_transform({BASES}, lambda b: {STEM}), ' ') END AS speech FROM w")
def turkish_adapted(spark, d):
    """Requests as image search and as transcript search take them; a video with an English document has an English transcript."""
    en = load(spark, d, "documents").where(F.lower(F.split_part(F.replace("lang", F.lit("_"), F.lit("-")), F.lit("-"), F.lit(1))) == "en").select("video_id", F.lit("en").alias("language"))
    q = turkish(spark, d).join(en.where(F.col("video_id").isNotNull()).distinct(), "video_id", "left")
    return q.select("query_id", rt.adapted_visual(F.col("low")).alias("visual"), rt.adapted_speech(F.col("low"), F.col("language")).alias("speech"))


GRAMS = "g AS (SELECT query_id, list_distinct(flatten(list_transform([3, 4, 5], lambda n: CASE WHEN len(s) >= n THEN list_transform(generate_series(1, len(s) - n + 1), lambda i: s[i:i + n - 1]) ELSE [] END))) AS gs FROM (SELECT query_id, ' ' || array_to_string(regexp_extract_all(lower(replace(query_text, 'İ', 'i' || chr(775))), '[a-z0-9]+'), ' ') || ' ' AS s FROM qry) x)"


def char_grams(q):
    return grams(F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(F.lower(q), F.lit("[a-z0-9]+"), F.lit(0)), " "), F.lit(" ")))


def grams(s):
    """The distinct runs of 3 to 5 characters."""
    n = lambda k: F.when(F.length(s) >= k, F.transform(F.sequence(F.lit(1), F.length(s) - k + 1), lambda i: F.substring(s, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(n(3), n(4), n(5)))


@query("q13_ngram_vocabulary", "qry", f"WITH {GRAMS}, t AS (SELECT unnest(gs) AS gram FROM g) SELECT gram, count(*) AS df FROM t GROUP BY 1 HAVING count(*) >= 2 ORDER BY df DESC, gram LIMIT 768")
def ngram_vocabulary(spark, d):
    """The 768 character n-grams (3 to 5) that most queries have, of those that two or more have."""
    g = views.queries(spark, d).select(F.explode(char_grams(F.col("query_text"))).alias("gram"))
    return g.groupBy("gram").agg(F.count("*").alias("df")).where("df >= 2").orderBy(F.desc("df"), "gram").limit(768)


TF = """ts AS (SELECT query_id, list_distinct(list_concat(ws, list_transform(generate_series(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1]))) AS terms FROM (SELECT query_id, regexp_extract_all(lower(replace(query_text, 'İ', 'i' || chr(775))), '[a-z0-9]+(?:''[a-z]+)?') AS ws FROM qry) x),
tt AS (SELECT query_id, unnest(terms) AS term FROM ts), n AS (SELECT count(*) AS n FROM ts), df AS (SELECT term, count(*) AS df FROM tt GROUP BY 1 HAVING count(*) >= 2 ORDER BY df DESC, term LIMIT 512),
iw AS (SELECT term, ln((1 + n) / CAST(1 + df AS DOUBLE)) + 1 AS idf FROM df, n), tv AS (SELECT query_id, term, idf / sqrt(sum(idf * idf) OVER (PARTITION BY query_id)) AS value FROM tt JOIN iw USING (term))"""


def word_terms(spark, d):
    ws = rt.words(F.col("query_text"))
    pairs = F.when(F.size(ws) > 1, F.transform(F.sequence(F.lit(1), F.size(ws) - 1), lambda i: F.concat_ws(" ", F.element_at(ws, i), F.element_at(ws, i + 1)))).otherwise(F.array().cast("array<string>"))
    return views.queries(spark, d).select("query_id", F.concat(ws, pairs).alias("terms"))


def char_terms(spark, d):
    return views.queries(spark, d).select("query_id", grams(F.concat(F.lit(" "), F.array_join(rt.words(F.col("query_text")), " "), F.lit(" "))).alias("terms"))


#: Sizes of the vocabularies of words and pairs, and of runs of characters.
WORD_TERMS, CHAR_TERMS = 5000, 8000


@query("c11_tf_idf_whole")
def tfidf_whole(spark, d):
    return tf_idf(word_terms(spark, d), "query_id", WORD_TERMS).withColumn("value", F.round("value", 6))


@query("q07_tfidf_predict_whole")
def tfidf_predict_whole(spark, d):
    """As q07_tfidf_predict, over the whole vocabulary of words."""
    return predicted(spark, d, WORD_TERMS)


@query("c11_tf_idf", "qry", f"WITH {TF} SELECT query_id, term, round(value, 6) AS value FROM tv")
def tfidf(spark, d):
    """The 512 most frequent terms, as in the SQL; c11_tf_idf_whole has 5,000."""
    return tf_idf(word_terms(spark, d), "query_id", 512).withColumn("value", F.round("value", 6))


@query("q07_tfidf_predict", "qry", f"WITH {TF}, wt AS (SELECT term, (len(term) % 7 - 3) / 3e0 AS a, (ascii(term) % 5 - 2) / 2e0 AS b FROM iw), s AS (SELECT query_id, sum(value * a) AS a, sum(value * b) AS b FROM tv JOIN wt USING (term) GROUP BY 1) SELECT query_id, CASE WHEN round(a, 9) >= round(greatest(b, 0), 9) THEN 'visual' WHEN round(b, 9) >= 0 THEN 'speech' ELSE 'hybrid' END AS route FROM s")
def tfidf_predict(spark, d):
    """A sparse linear model applied by a join on terms; its weights here come from the terms' letters.

    Over the 512 most frequent terms, as in the SQL; q07_tfidf_predict_whole has 5,000.
    """
    return predicted(spark, d, 512)


def predicted(spark, d, vocabulary):
    v = tf_idf(word_terms(spark, d), "query_id", vocabulary)
    a, b = (F.length("term") % 7 - 3) / 3.0, (F.ascii("term") % 5 - 2) / 2.0
    s = v.groupBy("query_id").agg(F.sum(F.col("value") * a).alias("a"), F.sum(F.col("value") * b).alias("b"))
    r = lambda c: F.round(c, 9)
    return s.select("query_id", F.when(r("a") >= r(F.greatest("b", F.lit(0.0))), "visual").when(r("b") >= 0, "speech").otherwise("hybrid").alias("route"))


ALIAS = "a AS (SELECT query_id, list_filter([" + ", ".join(f"'{a}'" for a, _ in rt.ALIASES) + "], lambda x: contains(' ' || trim(regexp_replace(regexp_replace(lower(replace(query_text, 'İ', 'i' || chr(775))), '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) || ' ', ' ' || x || ' ')) AS named FROM qry)"
TAKEN = "t AS (SELECT query_id, list_filter(named, lambda x, i: len(list_filter(named[1:i - 1], lambda y: contains(x, y) OR contains(y, x))) = 0) AS aliases FROM a)"


@query("q14_object_aliases", "qry", f"WITH {ALIAS}, {TAKEN} SELECT query_id, aliases FROM t")
def object_aliases(spark, d):
    return views.queries(spark, d).select("query_id", rt.object_aliases(F.col("query_text")).alias("aliases"))


@query("q15_tags", "qry", "SELECT query_id, CASE WHEN len(tags) = 0 THEN ['direct_intent'] ELSE tags END AS tags FROM (SELECT query_id, list_filter([CASE WHEN ends_with(query_text, '?') THEN 'natural_question' END, CASE WHEN len(regexp_extract_all(lower(replace(query_text, 'İ', 'i' || chr(775))), '[a-z0-9]+')) >= 14 THEN 'long_query' END, CASE WHEN modality_requirement = 'hybrid' THEN 'mixed_modality' END], lambda x: x IS NOT NULL) AS tags FROM qry) x")
def tags(spark, d):
    t = F.array_compact(F.array(F.when(F.col("query_text").endswith("?"), "natural_question"), F.when(F.size(F.regexp_extract_all(F.lower("query_text"), F.lit("[a-z0-9]+"), F.lit(0))) >= 14, "long_query"), F.when(F.col("modality_requirement") == "hybrid", "mixed_modality")))
    return views.queries(spark, d).select("query_id", F.when(F.size(t) == 0, F.array(F.lit("direct_intent"))).otherwise(t).alias("tags"))


@query("q16_router_failures", "qry", FEATS + f", h AS (SELECT *, f6 > 0 AS s, f7 + f8 + f9 > 0 AS v, f12 + f10 > 0 AS o FROM x WHERE form = 0), r AS (SELECT h.query_id, {HEUR} AS route, upper(CASE modality_requirement WHEN 'temporal' THEN 'visual' ELSE modality_requirement END) AS target FROM h JOIN qry USING (query_id) WHERE modality_requirement IS NOT NULL) SELECT target, route, count(*) AS n FROM r WHERE target <> route GROUP BY ALL")
def router_failures(spark, d):
    """Which routes were taken for which, where they differ."""
    r = heuristic(spark, d).where("form = 0").join(target(spark, d), "query_id")
    return r.where(F.col("target") != F.col("route")).groupBy("target", "route").agg(F.count("*").alias("n"))


DET = """det AS (SELECT query_id, list_distinct(aliases) AS aliases, (abs(hash_id) % 97) / 97e0 AS confidence FROM t JOIN (SELECT query_id, CAST(right(query_id, 9) AS BIGINT) * 31 AS hash_id FROM qry) h USING (query_id))"""


@query("m09_object_presence", "qry", f"WITH {ALIAS}, {TAKEN}, {DET} SELECT query_id, len(aliases) > 0 AS enabled, CASE WHEN len(aliases) > 0 THEN round(list_min(list_transform(aliases, lambda a: (ascii(a) * 7 % 10) / 10e0 * confidence)), 6) ELSE 0 END AS object_confidence FROM det")
def object_presence(spark, d):
    """The least over required groups of the best detection in each: detections here come from ids and names."""
    a = views.queries(spark, d).select("query_id", rt.object_aliases(F.col("query_text")).alias("aliases"), ((F.right("query_id", F.lit(9)).cast("bigint") * 31 % 97) / 97.0).alias("c"))
    best = F.array_min(F.transform("aliases", lambda x: (F.ascii(x) * 7 % 10) / 10.0 * F.col("c")))
    return a.select("query_id", (F.size("aliases") > 0).alias("enabled"), F.coalesce(F.round(best, 6), F.lit(0.0)).alias("object_confidence"))


@query("j18_class_groups", "qry", f"WITH {ALIAS}, {TAKEN}, u AS (SELECT query_id, unnest(aliases) AS alias FROM t) SELECT query_id, count(DISTINCT grp) AS groups FROM (SELECT query_id, unnest(CASE alias " + " ".join(f"WHEN '{a}' THEN {lst(['|'.join(c) for c in g])}" for a, g in rt.ALIASES) + " END) AS grp FROM u) x GROUP BY 1")
def class_groups(spark, d):
    """How many distinct class groups a query requires."""
    a = views.queries(spark, d).select("query_id", rt.class_groups(rt.object_aliases(F.col("query_text"))).alias("g"))
    return a.where(F.size("g") > 0).select("query_id", F.size("g").cast("bigint").alias("groups"))
