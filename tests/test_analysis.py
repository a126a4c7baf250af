from pyspark.sql import functions as F

from rupaka.functions.features import FIELDS, suffix_readings
from rupaka.operators import bigram, disambiguate as dis, evaluate as ev, nouns, verbs
from rupaka.plans.catalogue import LEXICON, hindi_lexicon
from rupaka.sources import rules

#: Suffix: what it states.
GOLDEN = {
    "या": "perfective participle M S", "एगा": "future finite M S", "ोगी": "future finite F S 2", "ये": "subjunctive finite M P", "ता": "imperfective participle M S",
    "ुया": "perfective participle M S", "ुंगी": "future finite F S", "ो": "imperative finite 2", "ीं": "perfective participle F P", "जिये": "imperative finite 2 M P",
    "ने": "infinitive M S O", "ें": "subjunctive finite S", "ए": "perfective participle M P",
}


def test_suffix_features(spark):
    df = spark.createDataFrame([(s,) for s in GOLDEN], "suffix string").select("suffix", F.get(suffix_readings(F.col("suffix")), F.lit(0)).alias("f"))
    for r in df.collect():
        assert sorted(str(r.f[k]) for k in FIELDS if r.f[k]) == sorted(GOLDEN[r.suffix].split()), r


def test_all_readings_on_demand(spark):
    r = verbs.with_features(rules.verb_rules(spark, [("ए", ""), ("या", "")]), all_readings=True)
    assert sorted((x.suffix, x.reading) for x in r.collect()) == [("ए", 0), ("ए", 1), ("ए", 2), ("या", 0)]


def words(spark, text):
    return spark.createDataFrame([(w,) for w in text.split()], "word string")


def test_noun_goldens(spark):
    rows = nouns.analyze_nouns(words(spark, "लड़कियों लड़के घर रातें कवि"), hindi_lexicon(spark)).orderBy("surface", "ord").collect()
    of = lambda w: [(r.lemma, r.gender, r.number, r.case, r.paradigm, r.confidence) for r in rows if r.surface == w]
    assert of("लड़कियों") == [("लड़की", "F", "PL", "OBL", "F1", "certain")]
    assert of("लड़के") == [("लड़का", "M", "PL", "DIR", "M1", "certain"), ("लड़का", "M", "SG", "OBL", "M1", "certain")]
    assert [x[2:4] for x in of("घर")] == [("SG", "DIR"), ("PL", "DIR"), ("SG", "OBL")]
    assert of("रातें") == [("रात", "F", "PL", "DIR", "F3", "certain")] and of("कवि") == []


def test_verb_goldens(spark):
    rows = verbs.analyze_verbs(words(spark, "खाया गया रे")).orderBy("surface", "ord").collect()
    first = {r.surface: r for r in rows if r.ord == 1}
    assert (first["खाया"].lemma, first["खाया"].suffix, first["खाया"].aspect) == ("खा", "या", "perfective")
    assert first["गया"].lemma == "जा" and first["गया"].irregular and first["गया"].confidence == "high"
    assert "रे" not in first
    gated = verbs.analyze_verbs(words(spark, "खाया गया"), verb_lexicon=spark.createDataFrame([("खा",)], "lemma string"))
    assert sorted((r.surface, r.lemma) for r in gated.collect()) == [("खाया", "खा"), ("गया", "जा")]


def test_endswith_join_is_the_equi_join(spark):
    w, r = words(spark, "abs as s stations en en oping"), spark.createDataFrame([("s",), ("",), ("ing",), ("ations",)], "suffix string")
    got = nouns.suffix_matches(w, r, "word", "suffix").groupBy("word", "suffix").count()
    want = w.join(r, F.col("word").endswith(F.col("suffix"))).groupBy("word", "suffix").count()
    assert sorted(got.collect()) == sorted(want.collect())
    plan = nouns.suffix_matches(w, r, "word", "suffix")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan


def sentence(spark, text, **how):
    df = dis.disambiguate(spark.createDataFrame([(1, text)], "sent_id long, text string"), hindi_lexicon(spark), **how)
    return {r.token: r for r in df.collect()}


def test_signals_and_scores(spark):
    s = sentence(spark, "लड़की ने खाना खाया")
    assert s["लड़की"].signals_applied == ["postposition→OBL"] and [c.case for c in s["लड़की"].noun_candidates] == ["OBL"] and not s["लड़की"].ambiguous
    assert s["खाना"].signals_applied == ["verb_agreement→MSG"] and [c.number for c in s["खाना"].noun_candidates] == ["SG"]
    s = sentence(spark, "राम का घर भी के साथ नहीं गया")
    assert s["घर"].signals_applied[:3] == ["genitive→M", "postposition→OBL", "quantifier→SG"] and not s["घर"].verb_candidates and "verb:negation(नहीं)→¬IMP" not in s["घर"].signals_applied
    assert s["गया"].signals_applied == ["verb:negation(नहीं)→¬IMP"]
    s = sentence(spark, "मत जाओ")
    assert s["जाओ"].signals_applied == []


def test_coordination_runs_in_order(spark):
    s = sentence(spark, "घर और रात और लड़कों में")
    # the first conjunction sees two uncertain nouns; the second narrows the one in the middle
    assert len(s["घर"].noun_candidates) == 3 and [c.case for c in s["रात"].noun_candidates] == ["OBL"]
    s = sentence(spark, "लड़कों और घर और रात")
    assert {c.case for c in s["रात"].noun_candidates} == {"OBL"} and s["रात"].signals_applied[-1] == "coordination→OBL"


def test_gender_model_and_bigram_state(spark):
    g = spark.createDataFrame([("अनजान", "F")], "word string, gender string")
    s = sentence(spark, "अनजान", genders=g)
    assert [(c.number, c.case, c.paradigm, c.source) for c in s["अनजान"].noun_candidates] == [(n, c, "F3", "gender_model") for n in ("SG", "PL") for c in ("DIR", "OBL")]
    two = hindi_lexicon(spark).union(spark.createDataFrame([("माल", "माल", "M2", "certain")], "norm string, display string, paradigm string, confidence string"))
    model = bigram.scores(spark.createDataFrame([("M2", "F3", 5), ("M2", "M2", 1)], "prev string, curr string, n long"))
    df = spark.createDataFrame([(1, "घर माल"), (2, "घर रात")], "sent_id long, text string")
    with_model = {(r.sent_id, r.token): r for r in dis.disambiguate(df, two, bigrams=model).collect()}
    without = {(r.sent_id, r.token): r for r in dis.disambiguate(df, two).collect()}
    assert with_model[1, "माल"].noun_candidates == without[1, "माल"].noun_candidates  # one class, so the prior changes nothing
    assert abs(sum(p for p in model["M2"][0].values()) - 1) < 1e-9
    empty = {(r.sent_id, r.token): r for r in dis.disambiguate(df, two, bigrams={}).collect()}
    assert empty == without


def test_resolved_and_empty(spark):
    df = dis.disambiguate(spark.createDataFrame([(1, "लड़कियों"), (2, ""), (3, None)], "sent_id long, text string"), hindi_lexicon(spark))
    (r,) = dis.resolved(df).collect()
    assert r.has_analysis and r.resolved_noun.lemma == "लड़की" and r.resolved_verb is None
    assert dis.disambiguate(spark.createDataFrame([], "sent_id long, text string"), hindi_lexicon(spark)).count() == 0


def test_evaluation_of_nouns_and_verbs(spark):
    gold = spark.createDataFrame([("घर", "घर", "M", "SG", "DIR", "f", 1), ("रातें", "रात", "F", "PL", "OBL", "f", 2), ("कुछ", "कुछ", None, None, None, "f", 3), ("लड़के", "लड़की", None, None, None, "f", 4), ("कवि", "कवि", None, None, None, "f", 5)], "surface string, lemma string, gender string, number string, case string, file string, line_no int")
    a = nouns.analyze_nouns(gold.select(F.col("surface").alias("word")), hindi_lexicon(spark))
    e = {r.surface: r for r in ev.evaluated_nouns(gold, a, hindi_lexicon(spark)).collect()}
    assert e["घर"].full_ok and e["घर"].failure_type is None and e["घर"].paradigm == "M2"
    assert [e[w].failure_type for w in ("रातें", "कुछ", "लड़के", "कवि")] == ["wrong_features", "no_analysis", "wrong_lemma", "no_analysis"]
    vg = spark.createDataFrame([("खाया", "खा", "perfective", None, None, "M", "S", None, "VM", "f", 1), ("गया", "गा", None, None, None, None, None, None, "VM", "f", 2)], "surface string, lemma string, aspect string, tense string, mood string, gender string, number string, person string, cpos string, file string, line_no int")
    v = {r.surface: r for r in ev.evaluated_verbs(vg, verbs.analyze_verbs(vg.select(F.col("surface").alias("word")))).collect()}
    assert v["खाया"].full_ok and v["खाया"].vtype == "participle" and v["गया"].failure_type == "wrong_lemma" and v["गया"].confidence == "high"


def test_lexicon_has_every_class():
    assert {p for _, p in LEXICON} == {"M1", "M2", "M3", "M4", "F1", "F2", "F3", "F4", "F5"}


def test_one_sentence_through_the_public_names(spark):
    from rupaka import api

    rows = api.disambiguate_sentence(spark, "लड़कियों ने", hindi_lexicon(spark)).collect()
    assert [r.token for r in rows] == ["लड़कियों", "ने"] and all(hasattr(api, n) for n in api.__all__)


def test_the_first_rule_decides(spark):
    from rupaka.operators.decisions import decide

    t = spark.createDataFrame([(1, k, g) for k, g in enumerate("NN VM NN JJ NN".split())], "sent_id int, pos int, tag string")
    got = decide(t, [({-1: "VM"}, "a"), ({0: "NN", 1: "VM"}, "b"), ({0: "NN"}, "c")], "d").orderBy("pos").collect()
    assert [(r.decision, r.rule_ord) for r in got] == [("b", 1), ("d", 3), ("a", 0), ("d", 3), ("c", 2)]
