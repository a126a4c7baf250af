"""Registered queries of readers, routing, model reports and small column functions, with their DuckDB counterparts.

Readers run on literal lines, since the shared tables hold no such files; what can run
on whole tables does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rupaka.functions import text as x
from rupaka.functions.features import FIELDS, merged, shown as shown_features
from rupaka.operators import decisions, disambiguate as dis, gender, nouns, verbs
from rupaka.plans.registry import frame, query, table, values
from rupaka.sources import lexicons, rules, sinks

# ── lines of files ──

#: Lines without white space at either end, comments and empty lines left out, cut at commas.
CUT = "c AS (SELECT line_no, list_transform(string_split(trim(line), ','), lambda x: trim(x)) AS f FROM l WHERE trim(line) <> '' AND NOT prefix(trim(line), '//'))"


def lines(spark: SparkSession, rows: list) -> DataFrame:
    return frame(spark, "line_no int, line string", rows)


ENTRIES = list(enumerate(["घर,घर,noun", "//रात,<रात,noun", "घर,क्रोध,noun", "चल,x,verb", ",घर,noun", "a,b", " <आशा> , आशा , noun ", "a,b,c,d", "", "घर,घर,noun"], 1))


@query("noun_entries", f"""WITH {values('l', 'line_no, line', ENTRIES)},
p AS (SELECT line_no, list_transform(string_split(ltrim(trim(line), '/'), ','), lambda x: rtrim(ltrim(trim(x), '<'), '>')) AS f FROM l)
SELECT line_no::INT AS line_no, f[1] AS word, f[2] AS paradigm FROM p WHERE len(f) = 3 AND f[3] = 'noun'""")
def noun_entries(spark, sf_dir):
    """All noun entries of a raw lexicon, repeated and empty words too."""
    return lexicons.noun_entries(lines(spark, ENTRIES))


FORMS = list(enumerate(["ली, ले", "गया,जा", "// comment", "ली, दे", "alone", " की , कर, more", "", "गया, जा"], 1))


@query("irregular_loading", f"WITH {values('l', 'line_no, line', FORMS)}, {CUT} SELECT f[1] AS surface, arg_max(f[2], line_no) AS lemma FROM c WHERE len(f) >= 2 GROUP BY 1")
def irregular_loading(spark, sf_dir):
    return rules.load_irregular(lines(spark, FORMS))


READINGS = list(enumerate(["verb, ता, ASP:imp, G:M", "verb, ता, ASP:imp, G:F, G:M", "noun, ा, G:M", "copula, था, T : past", "verb, ते", "verb, ते, odd", "verb, ते, a:b:c, N:P", "// verb, x, G:M"], 1))


@query("suffix_analysis_loading", f"""WITH {values('l', 'line_no, line', READINGS)}, {CUT},
p AS (SELECT line_no, f[2] AS morpheme, unnest(f[3:]) AS pair, generate_subscripts(f[3:], 1) AS i FROM c WHERE f[1] IN ('verb', 'copula') AND len(f) >= 3),
g AS (SELECT line_no, morpheme, trim(string_split(pair, ':')[1]) AS name, arg_max(trim(string_split(pair, ':')[2]), i) AS value FROM p WHERE len(string_split(pair, ':')) = 2 GROUP BY ALL)
SELECT morpheme, (dense_rank() OVER (PARTITION BY morpheme ORDER BY line_no) - 1)::INT AS reading, name, value FROM g""")
def suffix_analysis_loading(spark, sf_dir):
    """The readings of each morpheme in file order, a row for each feature; of repeated features the last counts."""
    read = rules.load_suffix_analysis(lines(spark, READINGS))
    return read.select("morpheme", F.posexplode("readings").alias("reading", "r")).select("morpheme", "reading", F.explode("r").alias("name", "value"))


ROOTS = list(enumerate(["कर", " रह ", "// no", "", "कर", "जा"], 1))


@query("aux_verb_loading", f"WITH {values('l', 'line_no, line', ROOTS)} SELECT DISTINCT trim(line) AS root FROM l WHERE trim(line) <> '' AND NOT prefix(trim(line), '//')")
def aux_verb_loading(spark, sf_dir):
    return rules.load_aux_verbs(lines(spark, ROOTS))


MIXED = list(enumerate(["noun, ा, ी", "verb, या,", "noun, ियाँ, ी", "copula, है,", "noun, ा, ी", "noun, े, nil"], 1))


@query("rule_paradigms", f"""WITH {values('l', 'line_no, line', MIXED)}, {CUT}, k AS (SELECT f[1] AS paradigm, f[2] AS suffix, f[3] AS add_back, min(line_no) AS seen FROM c WHERE f[1] = 'noun' AND lower(f[3]) <> 'nil' GROUP BY ALL)
SELECT (row_number() OVER (ORDER BY length(suffix) DESC, seen))::INT AS rule_ord, paradigm, suffix, add_back FROM k""")
def rule_paradigms(spark, sf_dir):
    """Suffix rules of a paradigm that isn't among the default ones."""
    return rules.load_suffix_rules(lines(spark, MIXED).withColumn("file_ord", F.lit(0)), ("noun",))


# ── predicted classes ──

SPLIT = r"[\s\x0b\x1c-\x1f\x{85}\pZ]+"
TYPES = f"types AS (SELECT DISTINCT lang, word FROM (SELECT lang, unnest(string_split_regex(text, '{SPLIT}')) AS word FROM documents) WHERE word <> '')"


def types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("lang", F.explode(x.tokens("text")).alias("word")).distinct()


@query("training_words", f"""WITH {TYPES}, w AS (SELECT DISTINCT word FROM types UNION ALL SELECT unnest(['घर', 'रात', 'लड़की', 'सड़क', 'माला', 'पेड़'])),
c AS (SELECT word, length(word) % 3 AS k FROM w)
SELECT replace(replace(nfc_normalize(word), 'ड़', 'ड'), 'ढ़', 'ढ') AS word, CASE k WHEN 0 THEN 'M' ELSE 'F' END AS label FROM c WHERE k < 2 AND right(word, 1) NOT IN ('ा', 'ी')""")
def training_words(spark, sf_dir):
    """All words of the documents, with classes by their length: those of the two consonant-final classes that end in a consonant."""
    own = frame(spark, "word string", [(w,) for w in ["घर", "रात", "लड़की", "सड़क", "माला", "पेड़"]])
    w = types(spark, sf_dir).select("word").distinct().union(own).withColumn("k", F.length("word") % 3)
    return lexicons.training_words(w.select("word", F.when(F.col("k") == 0, "M2").when(F.col("k") == 1, "F3").otherwise("M1").alias("paradigm_class")))


CLASSES = [(c,) for c in "M1 M2 M3 M4 F1 F2 F3 F4 F5 UNK".split()] + [(None,)]


@query("class_genders", f"WITH {values('c', 'paradigm', CLASSES)}, g AS (SELECT paradigm, CASE paradigm WHEN 'M2' THEN 'M' WHEN 'F3' THEN 'F' END AS gender FROM c) SELECT paradigm, gender, CASE WHEN gender = 'M' THEN 'M2' ELSE 'F3' END AS assigned FROM g")
def class_genders(spark, sf_dir):
    said = frame(spark, "paradigm string", CLASSES).withColumn("gender", gender.gender_of(F.col("paradigm")))
    return said.withColumn("assigned", gender.class_of(F.col("gender")))


PROBABILITY = "(35 + 10 * (length(word) % 7)) / 100.0"


@query("complete_lexicon", f"""WITH {TYPES}, old AS (SELECT DISTINCT word FROM types WHERE lang = 'en'), new AS (SELECT DISTINCT word FROM types WHERE lang <> 'en')
SELECT word, 'M2' AS paradigm_class, 'certain' AS confidence, '' AS probability, 0 AS block FROM old
UNION ALL SELECT word, 'F3', 'predicted_high', format('{{:.4f}}', ({PROBABILITY})::DOUBLE), 1 FROM new WHERE word NOT IN (SELECT word FROM old)""")
def complete_lexicon(spark, sf_dir):
    """The words of one language as the lexicon there is, those of the others as predicted: an entry that exists is kept."""
    w = types(spark, sf_dir)
    old = w.filter("lang = 'en'").select("word").distinct().select("word", F.lit("M2").alias("paradigm_class"), F.lit("certain").alias("confidence"))
    p = ((35 + 10 * (F.length("word") % 7)) / F.lit(100.0)).alias("probability")
    new = w.filter("lang <> 'en'").select("word").distinct().select("word", F.lit("F3").alias("paradigm_class"), F.lit("predicted_high").alias("confidence"), p)
    return sinks.complete_lexicon(old, new)


@query("routed_predictions", """WITH p AS (SELECT vec_id::VARCHAR AS word, 1 / (1 + exp(-4 * embedding[1]::DOUBLE)) AS m FROM embeddings),
q AS (SELECT word, CASE WHEN m >= 0.5 THEN 'M2' ELSE 'F3' END AS paradigm_class, greatest(m, 1 - m) AS p FROM p),
r AS (SELECT *, CASE WHEN p >= 0.8 THEN 'high' WHEN p >= 0.65 THEN 'medium' WHEN p >= 0.55 THEN 'low' ELSE 'abstain' END AS tier FROM q)
SELECT word, paradigm_class, 'predicted_' || tier AS confidence, format('{:.4f}', p) AS probability, CASE WHEN tier IN ('high', 'medium') THEN 'predicted' WHEN tier = 'low' THEN 'review' ELSE 'abstain' END AS route FROM r""")
def routed_predictions(spark, sf_dir):
    """What goes to which of the three lists, for probabilities taken from all vectors."""
    m = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("word"), (1 / (1 + F.exp(-4 * F.get("embedding", F.lit(0)).cast("double")))).alias("m"))
    p = m.withColumn("gender", F.when(F.col("m") >= 0.5, "M").otherwise("F")).withColumn("probability", F.greatest("m", 1 - F.col("m")))
    return sinks.routed(p.select("word", gender.class_of(F.col("gender")).alias("paradigm_class"), gender.tier(F.col("probability")).alias("tier"), "probability"))


@query("confusion_report", """WITH p AS (SELECT CASE WHEN quality = 1 THEN 'M' ELSE 'F' END AS label, CASE WHEN toxic = 0 THEN 'M' ELSE 'F' END AS said FROM labels),
l AS (SELECT label, count(*) FILTER (label = said) AS hit, count(*) AS support FROM p GROUP BY 1), s AS (SELECT said AS label, count(*) AS asked FROM p GROUP BY 1),
r AS (SELECT label, hit / nullif(asked, 0) AS precision, hit / support AS recall, support FROM l LEFT JOIN s USING (label))
SELECT label, round(precision, 9) AS precision, round(recall, 9) AS recall, round(2 * precision * recall / nullif(precision + recall, 0), 9) AS f1, support::BIGINT AS support FROM r""")
def confusion_report(spark, sf_dir):
    """The report of one label of the documents as a prediction of another."""
    p = table(spark, sf_dir, "labels").select(F.when(F.col("quality") == 1, "M").otherwise("F").alias("label"), F.when(F.col("toxic") == 0, "M").otherwise("F").alias("said"))
    r = gender.report(p.groupBy("label").pivot("said", ["M", "F"]).count().na.fill(0))
    return r.select("label", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")), "support")


@query("fold_spread", """WITH a AS (SELECT doc_id % 5 AS fold, avg((quality <> toxic)::INT) AS accuracy FROM labels GROUP BY 1)
SELECT round(avg(accuracy), 9) AS mean, round(stddev_pop(accuracy), 9) AS std, round(min(accuracy), 9) AS least, round(max(accuracy), 9) AS most FROM a""")
def fold_spread(spark, sf_dir):
    a = table(spark, sf_dir, "labels").groupBy((F.col("doc_id") % 5).alias("fold")).agg(F.avg((F.col("quality") != F.col("toxic")).cast("int")).alias("accuracy"))
    return gender.spread(a).select(*(F.round(c, 9).alias(c) for c in ("mean", "std", "least", "most")))


@query("fold_sizes", f"""WITH {TYPES}, w AS (SELECT word, CASE WHEN min(lang) = 'de' THEN 'M' ELSE 'F' END AS label FROM types GROUP BY word), c AS (SELECT label, count(*) AS n FROM w GROUP BY 1)
SELECT label, fold::INT AS fold, (n // 5 + CASE WHEN fold BETWEEN 1 AND n % 5 THEN 1 ELSE 0 END)::BIGINT AS n FROM c, range(5) AS r(fold)""")
def fold_sizes(spark, sf_dir):
    """Every label is dealt out evenly over the folds."""
    w = types(spark, sf_dir).groupBy("word").agg(F.when(F.min("lang") == "de", "M").otherwise("F").alias("label"))
    return gender.folds(w).groupBy("label", "fold").agg(F.count("*").alias("n"))


# ── candidates ──

MOODS = [("a", "nahi", "x", "IMP"), ("a", "nahi", "y", None), ("b", "mat", "x", "IMP"), ("b", "mat", "y", "finite"), ("c", "nahi", "x", "IMP"), ("d", "mat", "y", None), ("e", None, "x", "IMP"), ("e", None, "y", None)]


def verb_structs(**given: str) -> Column:
    """Verb candidates as the disambiguator has them: what isn't given is null."""
    names = [f.split(":")[0] for f in dis.VERBS[len("array<struct<") : -2].split(",")]
    return F.array_sort(F.collect_list(F.struct(*((F.col(given[n]) if n in given else F.lit(None)).alias(n) for n in names)))).cast(dis.VERBS)


@query("verb_negation_filter", f"""WITH {values('c', 'tok, negation, lemma, mood', MOODS)}, k AS (SELECT *, coalesce(CASE negation WHEN 'nahi' THEN mood IS DISTINCT FROM 'IMP' WHEN 'mat' THEN mood IS NOT DISTINCT FROM 'IMP' END, false) AS kept FROM c),
q AS (SELECT *, bool_or(kept) OVER (PARTITION BY tok) AS any_kept FROM k)
SELECT tok, lemma, mood, CASE WHEN NOT any_kept THEN '' WHEN negation = 'nahi' THEN 'verb:negation(नहीं)→¬IMP' ELSE 'verb:negation(मत)→IMP' END AS label FROM q WHERE kept OR NOT any_kept""")
def verb_negation_filter(spark, sf_dir):
    """Negation narrows verb candidates by their mood, unless it would leave none."""
    c = frame(spark, "tok string, negation string, lemma string, mood string", MOODS).groupBy("tok", "negation").agg(verb_structs(lemma="lemma", mood="mood").alias("verbs"))
    kept, label = dis.filtered_verbs(F.col("verbs"), F.col("negation"))
    return c.select("tok", F.explode(kept).alias("v"), F.array_join(label, ",").alias("label")).select("tok", "v.lemma", "v.mood", "label")


ALIKE = [("a", "x", "M", "S", None, None, "1", None), ("a", "x", "M", "S", None, None, "2", "imperative"), ("b", "x", "M", "S", "perfective", None, None, None), ("b", "x", "M", "S", None, "future", None, None), ("c", "x", None, None, None, None, None, None), ("d", "x", "M", "S", None, None, None, None), ("d", "y", "M", "S", None, None, None, None)]


@query("verb_ambiguity", f"WITH {values('c', 'tok, lemma, gender, number, aspect, tense, person, mood', ALIKE)} SELECT tok, count(DISTINCT (lemma, coalesce(gender, ''), coalesce(number, ''), coalesce(aspect, ''), coalesce(tense, ''))) > 1 AS ambiguous FROM c GROUP BY tok")
def verb_ambiguity(spark, sf_dir):
    """Verb readings that differ in person or mood only are one."""
    names = "lemma gender number aspect tense person mood".split()
    c = frame(spark, ", ".join(f"{n} string" for n in ["tok", *names]), ALIKE).groupBy("tok").agg(verb_structs(**{n: n for n in names}).alias("verbs"))
    return c.select("tok", dis.ambiguous(F.array().cast(dis.NOUNS), F.col("verbs")).alias("ambiguous"))


UNKNOWN = [(w, g) for w in "माला लड़के रोटी शान्ति आलू ऋतु घर abc".split() for g in "MF"]


@query("synthesized_candidates", f"""WITH {values('w', 'token, gender', UNKNOWN)}
SELECT token, gender, number, kase AS "case", CASE right(token, 1) WHEN 'ा' THEN CASE gender WHEN 'M' THEN 'M1' ELSE 'F2' END WHEN 'े' THEN CASE gender WHEN 'M' THEN 'M1' ELSE 'F1' END WHEN 'ी' THEN CASE gender WHEN 'M' THEN 'M3' ELSE 'F1' END
WHEN 'ि' THEN CASE gender WHEN 'M' THEN 'M3' ELSE 'F4' END WHEN 'ू' THEN CASE gender WHEN 'M' THEN 'M4' ELSE 'F5' END WHEN 'ु' THEN CASE gender WHEN 'M' THEN 'M4' ELSE 'F5' END ELSE CASE gender WHEN 'M' THEN 'M2' ELSE 'F3' END END AS paradigm,
'predicted' AS confidence, 'gender_model' AS source FROM w, (VALUES ('SG'), ('PL')) AS n(number), (VALUES ('DIR'), ('OBL')) AS k(kase)""")
def synthesized_candidates(spark, sf_dir):
    """Candidates of words outside the lexicon, from a predicted gender and the word's ending."""
    w = frame(spark, "token string, gender string", UNKNOWN)
    c = w.select("token", F.explode(dis.synthesized(F.col("token"), F.col("gender"))).alias("c"))
    return c.select("token", "c.gender", "c.number", "c.case", "c.paradigm", "c.confidence", "c.source")


@query("verb_lexicon_gate", f"WITH {values('v', 'surface, lemma, irregular', [('खाया', 'खा', False), ('गया', 'जा', True)])} SELECT * FROM v")
def verb_lexicon_gate(spark, sf_dir):
    """With a lexicon of verbs, lemmas found by rules must be in it; irregular forms need not."""
    w = frame(spark, "word string", [("खाया",), ("गया",), ("बोलती",)])
    return verbs.analyze_verbs(w, verb_lexicon=frame(spark, "lemma string", [("खा",)])).select("surface", "lemma", "irregular")


# ── features and lines ──

BUNDLES = [
    (1, "perfective", None, None, "participle", None, "S", "M", None, None, None, "imperative", None, "2", "P", None, "O"),
    (2, None, "future", None, "finite", "1", None, None, None, None, None, None, None, None, None, None, None),
    (3, None, None, None, None, None, None, None, None, "imperfective", "present", None, "participle", "3", "S", "F", None),
]


@query("merged_features", f"""WITH {values('b', ', '.join(['k', *(f'l_{f}' for f in FIELDS), *(f'r_{f}' for f in FIELDS)]), BUNDLES)}, m AS (SELECT k, {', '.join(f'coalesce(r_{f}, l_{f}) AS m_{f}' for f in FIELDS)} FROM b)
SELECT k, {', '.join(f'm_{f} AS "{f}"' for f in FIELDS)}, concat_ws(', ', {', '.join(f"'{f}=' || m_{f}" for f in FIELDS)}) AS line FROM m""")
def merged_features(spark, sf_dir):
    """Two bundles as one, what the right one states counts; and the stated fields as text."""
    b = frame(spark, ", ".join(["k int", *(f"l_{f} string" for f in FIELDS), *(f"r_{f} string" for f in FIELDS)]), BUNDLES)
    side = lambda s: F.struct(*(F.col(f"{s}_{f}").alias(f) for f in FIELDS))
    m = b.select("k", side("l").alias("l"), side("r").alias("r")).select("k", merged(F.col("l"), F.col("r")).alias("m"))
    return m.select("k", *(F.col(f"m.{f}").alias(f) for f in FIELDS), shown_features(F.col("m")).alias("line"))


NOUN_LINES = [("लड़के", 1, "लड़का", "M", "PL", "DIR", "M1", "certain"), ("लड़के", 2, "लड़का", "M", "SG", "OBL", "M1", "certain"), ("रात", 1, "रात", "F", "SG", "DIR", "F3", "heuristic")]


@query("noun_lines", f"WITH {values('a', 'surface, ord, lemma, gender, number, kase, paradigm, confidence', NOUN_LINES)} SELECT surface, ord, lemma || '  ' || gender || ' ' || number || ' ' || kase || '  class=' || paradigm || '  ' || confidence AS line FROM a")
def noun_lines(spark, sf_dir):
    return nouns.shown(frame(spark, "surface string, ord int, lemma string, gender string, number string, case string, paradigm string, confidence string", NOUN_LINES))


VERB_LINES = [("खाया", 1, "खा", "या", "perfective", None, None, "participle", None, "S", "M", None, "low"), ("जाऊंगा", 1, "जा", "ऊंगा", None, "future", None, "finite", "1", "S", "M", None, "medium")]


@query("verb_lines", f"""WITH {values('a', 'surface, ord, lemma, suffix, ' + ', '.join(f'f_{f}' for f in FIELDS) + ', confidence', VERB_LINES)}
SELECT surface, ord, concat_ws(' ', lemma, '+' || suffix, '[' || concat_ws(', ', {', '.join(f"'{f}=' || f_{f}" for f in FIELDS)}) || ']', confidence) AS line FROM a""")
def verb_lines(spark, sf_dir):
    return verbs.shown(frame(spark, "surface string, ord int, lemma string, suffix string, " + ", ".join(f"{f} string" for f in FIELDS) + ", confidence string", VERB_LINES))


# ── decision lists ──

TURNS = [({0: "user", 1: "assistant"}, "answered"), ({-1: "user", 0: "assistant"}, "answer"), ({0: "user"}, "open"), ({0: "system", 2: "assistant"}, "opening")]


@query("decision_list", """WITH t AS (SELECT conv_id, turn, min(role) AS tag FROM conversations GROUP BY ALL),
w AS (SELECT *, lag(tag) OVER o AS before, lead(tag) OVER o AS after, lead(tag, 2) OVER o AS later FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id AS sent_id, turn AS pos, CASE WHEN tag = 'user' AND after = 'assistant' THEN 'answered' WHEN before = 'user' AND tag = 'assistant' THEN 'answer' WHEN tag = 'user' THEN 'open' WHEN tag = 'system' AND later = 'assistant' THEN 'opening' ELSE 'other' END AS decision,
(CASE WHEN tag = 'user' AND after = 'assistant' THEN 0 WHEN before = 'user' AND tag = 'assistant' THEN 1 WHEN tag = 'user' THEN 2 WHEN tag = 'system' AND later = 'assistant' THEN 3 ELSE 4 END)::INT AS rule_ord FROM w""")
def decision_list(spark, sf_dir):
    """The first rule that matches the roles around a turn, over all conversations."""
    t = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("sent_id"), F.col("turn").alias("pos")).agg(F.min("role").alias("tag"))
    return decisions.decide(t, TURNS, "other").select("sent_id", "pos", "decision", "rule_ord")
