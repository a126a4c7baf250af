from pyspark.sql import functions as F

from rupaka.operators import disambiguate as dis, evaluate as ev, gender
from rupaka.plans.catalogue import hindi_lexicon
from rupaka.plans import evaluation
from rupaka.sources import lexicons, rules, sinks, treebank
from rupaka.streaming import sentences


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_lexicon_files(spark, tmp_path):
    p = put(tmp_path / "lex.tsv", "word\tparadigm_class\tconfidence\nखिड़की\tF1\tcertain\nखिडकी\tF1\theuristic\nघर\tM2\tcertain\n")
    rows = {r.norm: r for r in lexicons.load_lexicon(spark, p).collect()}
    assert set(rows) == {"खिडकी", "घर"} and rows["खिडकी"].confidence == "heuristic"
    raw = put(tmp_path / "raw", "//घर,<घर>,noun\nरात,रात,noun\nचल,x,verb\nघर,क्रोध,noun\n\n")
    lines = lexicons.numbered_lines(spark, raw)
    assert {(r.word, r.paradigm) for r in lexicons.parsed_lexicon(lines).collect()} == {("घर", "क्रोध"), ("रात", "रात")}
    assert [(r.paradigm, r.n) for r in lexicons.class_histogram(lexicons.noun_entries(lines)).collect()] == [("क्रोध", 1), ("घर", 1), ("रात", 1)]
    t = spark.createDataFrame([("घर", "M2"), ("रात", "F3"), ("आशा", "F2"), ("माला", "M2")], "word string, paradigm_class string")
    assert sorted(tuple(r) for r in lexicons.training_words(t).collect()) == [("घर", "M"), ("रात", "F")]


def test_rule_files(spark, tmp_path):
    a = put(tmp_path / "SUFFIX", "// x\nverb, या$, P:3, N:S, bad\ncopula, हो, T:p\nnoun, ा, G:M\nverb, या$, P:1,P:2\n")
    got = {r.morpheme: r.readings for r in rules.load_suffix_analysis(rules.read_lines(spark, a)).collect()}
    assert got == {"या$": [{"P": "3", "N": "S"}, {"P": "2"}], "हो": [{"T": "p"}]}
    b = put(tmp_path / "AUX", "ले\n// no\n\nदे\nले\n")
    assert {r.root for r in rules.load_aux_verbs(rules.read_lines(spark, b)).collect()} == {"ले", "दे"}
    c = put(tmp_path / "IRR", "// c\nली, ले\nगया, जा\nली, दे\nx\n")
    assert {(r.surface, r.lemma) for r in rules.load_irregular(rules.read_lines(spark, c)).collect()} == {("ली", "दे"), ("गया", "जा")}
    assert rules.term_sets(spark).filter("kind = 'postposition'").count() == 48
    assert rules.noun_rules(spark).count() == 36 and rules.verb_rules(spark).count() == 64 and rules.irregular_verbs(spark).count() == 37


def test_treebank_discovery(spark, tmp_path):
    line = "1\tघर\tघर\tn\tNN\tgen-m|num-sg|case-d\t0\troot\t_\t_\n"
    put(tmp_path / "a/x.dat", line + "\n")
    put(tmp_path / "a/b/y.dat", line)
    put(tmp_path / "a/b/z.txt", line)
    gold, skipped = treebank.gold_nouns(treebank.treebank_lines(spark, str(tmp_path / "a")))
    assert gold.count() == 2 and skipped.first().skipped == 0
    assert treebank.gold_nouns(treebank.treebank_lines(spark, str(tmp_path / "a/b/z.txt")))[0].count() == 1


def test_sinks(spark, tmp_path):
    p = spark.createDataFrame([("ख", "M2", "high", 0.9), ("क", "F3", "low", 0.6), ("ग", "F3", "abstain", 0.5)], "word string, paradigm_class string, tier string, probability double")
    sinks.write_tiers(p, str(tmp_path / "out"))
    assert [tuple(r) for r in lexicons.read_tsv(spark, str(tmp_path / "out/predicted")).collect()] == [("ख", "M2", "predicted_high", "0.9000")]
    old = spark.createDataFrame([("क", "M2", "certain")], "word string, paradigm_class string, confidence string")
    full = sinks.complete_lexicon(old, p.select("word", "paradigm_class", F.col("tier").alias("confidence"), "probability")).orderBy("block", "word").collect()
    assert [(r.word, r.probability) for r in full] == [("क", ""), ("ख", "0.9000"), ("ग", "0.5000")]
    text = ["**RULE FILE**", "IF    word_minus_1 = verb", "  AND word_plus_2 = noun", "THEN  curr_word = verb_aux  [0 466 33]", "ELSE", "IF word_minus_1 = pnoun", "THEN  curr_word = pnoun  [1 0 0]", "ELSE", "(DEFAULT) curr_word = verb  [0 0 424]"]
    lines = spark.createDataFrame([(f, k, x) for f in ("/a.b/101.ord", "/a.b/21.ord") for k, x in enumerate(text, 1)], "file string, line_no int, line string")
    want = ["[(-1 verb) AND (+2 noun)] THEN verb_aux VECTOR [0 466 33]", "[(-1 pnoun)] THEN pnoun VECTOR [1 0 0]", "[(DEFAULT)] THEN verb VECTOR [0 0 424]"]
    assert [r.value for r in sinks.reformatted_rules(lines).orderBy("file", "line_no").collect()] == [f"{i} {v}" for i in (101, 21) for v in want]
    errors = spark.createDataFrame([("a", "b", "no_analysis", "f", 3)], "surface string, gold_lemma string, failure_type string, file string, line_no int").withColumn("analyses", F.array().cast("array<struct<lemma:string>>"))
    assert "[no_analysis] a  gold b (M2)  predicted -  f:3" in sinks.error_sample(errors, F.lit("M2")).first().value


def test_gender_predictor(spark):
    m = [("क" + a + "न", "M") for a in "कखगघचछजझटठडढतथदध"] + [("ल" + a + "त", "F") for a in "कखगघचछजझटठडढतथदध"]
    df = spark.createDataFrame(m, "word string, label string")
    model = gender.fit(df)
    out = {r.word: r for r in gender.predict(model, spark.createDataFrame([("कपन",), ("लपत",)], "word string")).collect()}
    assert out["कपन"].gender == "M" and out["कपन"].paradigm_class == "M2" and out["लपत"].gender == "F" and out["कपन"].tier in ("high", "medium")
    top = gender.top_features(model).filter("label = 'M'").collect()
    assert top[0].rank == 1 and any(r.ending.endswith("न") for r in top[:5])
    accuracy, confusion = gender.cross_validated(df, 3)
    s = gender.spread(accuracy).first()
    assert s.mean > 0.9 and s.least <= s.mean <= s.most and {r.label for r in gender.report(confusion).collect()} == {"M", "F"}
    n = gender.summary(gender.predict(model, df)).agg(F.sum("n"), F.sum("share")).first()
    assert n[0] == len(m) and abs(n[1] - 1) < 1e-9


def test_samples_and_comparison(spark):
    errors = spark.createDataFrame([("A" if i < 300 else "B" if i < 390 else "C", i) for i in range(400)], "paradigm string, i int")
    got = {r.paradigm: r["count"] for r in ev.stratified_sample(errors, "paradigm", 40, "i").groupBy("paradigm").count().collect()}
    assert got == {"A": 30, "B": 9, "C": 1}
    assert ev.stratified_sample(errors, "paradigm", 400, "i").count() == 400


def test_stream_equals_batch(spark, tmp_path):
    put(tmp_path / "in/a.txt", "लड़की ने खाना खाया\n\nघर और रात\n")
    got = []
    q = sentences.start(sentences.sentence_stream(spark, str(tmp_path / "in")), hindi_lexicon(spark), lambda df, _: got.extend(dis.shown(df).collect()), str(tmp_path / "cp"))
    q.awaitTermination(120)
    want = dis.shown(dis.disambiguate(spark.createDataFrame([(1, "लड़की ने खाना खाया"), (2, "घर और रात")], "sent_id long, text string"), hindi_lexicon(spark))).collect()
    assert sorted((r.pos, r.line) for r in got) == sorted((r.pos, r.line) for r in want)


def test_without_the_corpus_operators(spark, monkeypatch):
    import importlib
    import sys

    import __spark_entry__ as e

    with monkeypatch.context() as m:
        m.setitem(sys.modules, "corpus_pipeline", None)
        importlib.reload(e)
        assert "suffix_analysis" in e.queries() and not any(k.startswith("op") for k in e.queries())
    importlib.reload(e)
    assert e.entry(spark).count() > 0


def test_folder_names_with_dots_and_reports(spark, tmp_path):
    """From a treebank folder to error lists, under two lexicons."""
    bank = [
        "1\tघर\tघर\tn\tNN\tgen-m|num-sg|case-d\t0\troot\t_\t_", "2\tरातों\tरात\tn\tNN\tgen-f|num-pl|case-o\t1\tx\t_\t_", "3\tफल\tफल\tn\tNN\tgen-m\t1\tx\t_\t_", "4\tकम\tकम\tn\tNN", "",
        "1\tगया\tजा\tv\tVM\tgen-m|num-sg|tam-yA\t0\troot\t_\t_",
    ]
    put(tmp_path / "bank-0.05/a.b/x.dat", "\n".join(bank) + "\n")
    put(tmp_path / "one.tsv", "word\tparadigm_class\nघर\tM2\nरात\tM2\n")
    put(tmp_path / "two.tsv", "word\tparadigm_class\nघर\tM2\nरात\tF3\n")
    one, two, compared = evaluation.evaluate_nouns(spark, str(tmp_path / "bank-0.05"), str(tmp_path / "one.tsv"), str(tmp_path / "two.tsv"))
    assert {r.failure_type: r.n for r in one.failures.collect()} == {"no_analysis": 1, "wrong_features": 1}
    assert {r.metric: (round(r.a, 6), round(r.b, 6)) for r in compared.collect()} == {"coverage": (0.666667, 0.666667), "lemma": (0.666667, 0.666667), "full": (0.333333, 0.666667)}
    rows = {r.surface: r for r in one.errors.collect()}
    assert one.errors.columns == ["surface", "gold_lemma", "gold_gender", "gold_number", "gold_case", "paradigm", "confidence", "failure_type", "n_predicted", "pred_lemmas", "file", "line_no"]
    assert rows["रातों"].pred_lemmas == "रात" and rows["रातों"].gold_gender == "F" and rows["फल"].paradigm == "OOV" and one.skipped.first().skipped == 1
    assert any("[wrong_features] रातों  gold रात (M2)  predicted रात" in r.value for r in one.sample(5, "paradigm", "paradigm").collect())
    two.write(str(tmp_path / "out"))
    assert [r.surface for r in lexicons.read_tsv(spark, str(tmp_path / "out/errors")).collect()] == ["फल"]
    verbs = evaluation.evaluate_verbs(spark, str(tmp_path / "bank-0.05"))
    assert [(r.total, r.full_ok) for r in verbs.metrics.filter("dim = 'all'").collect()] == [(1, 1)] and verbs.errors.count() == 0
    assert verbs.errors.columns[:9] == ["surface", "gold_lemma", "gold_asp", "gold_ten", "gold_mood", "gold_gen", "gold_num", "gold_per", "vtype"]
