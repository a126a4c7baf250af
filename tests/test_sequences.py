"""Term automata, carried state and coordination against brute force."""

import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rupaka.operators import context, disambiguate as dis, scan
from rupaka.operators.terms import Automaton, Terms, chosen, marked, marked_by_join, runs
from rupaka.plans import catalogue, sequences


def test_automaton():
    rng = random.Random(1)
    for _ in range(200):
        terms = list(dict.fromkeys(tuple(rng.choice("abc") for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(1, 12))))
        words = [rng.choice("abcd") for _ in range(rng.randrange(40))]
        want = [(-len(t), k, i) for k, t in enumerate(terms) for i in range(len(words)) if tuple(words[i : i + len(t)]) == t]
        hits = Automaton(terms).hits(words)
        assert sorted(hits) == sorted(want)
        free, marks = [None] * len(words), chosen(hits, len(words))
        for length, k, i in sorted(want):
            if not any(free[i : i - length]):
                free[i : i - length] = [(k, j == 0) for j in range(-length)]
        assert [m and (m["term"], m["starts"]) for m in marks] == free


def test_automaton_is_linear():
    words = ["a"] * 200_000
    began = time.time()
    found = chosen(Automaton([tuple("a" * n) for n in range(1, 6)]).hits(words), len(words))
    assert sum(m["starts"] for m in found) == 40_000 and time.time() - began < 20


def test_marks_two_ways(spark):
    rng = random.Random(2)
    compounds = ["a b", "b a b", "c", "a b c a", "c c c c c", "b c"]
    rows = [(i, " ".join(rng.choice("abcx") for _ in range(rng.randrange(30)))) for i in range(40)] + [(100, None), (101, ""), (102, "  ")]
    s = spark.createDataFrame(rows, "sent_id long, text string")
    one = marked(s, Terms([(c, "compound", None, None) for c in compounds] + [("a", "clitic", None, None), (None, "compound", None, None)]))
    table = spark.createDataFrame(list(enumerate(compounds)), "ord int, term string")
    other = marked_by_join(s, table, 5)
    assert sorted(map(tuple, one.collect()), key=repr) == sorted(map(tuple, other.collect()), key=repr)
    assert one.filter("starts").count() > 50


def test_term_tables(spark):
    rows = [("x  y", "compound", None, None, 2), ("x", "genitive", "F", None, 1), ("x", "plural", None, None, 3), (None, "clitic", None, None, 0)]
    t = Terms.read(spark.createDataFrame(rows, "term string, kind string, value string, number string, ord int"))
    assert t.compounds == ["x y"] and [tuple(r) for r in t.roles(spark).collect()] == [("x", False, False, False, False, True, "F", "PL", None)]
    with pytest.raises(ValueError):
        Terms.read(spark.range(9).select(F.lit("a b c").alias("term"), F.lit("compound").alias("kind")), most=20)
    assert Terms.read(spark.createDataFrame([], "term string, kind string")).rows == []


@pytest.mark.parametrize("levels", [0, 1, 2])
def test_scan(spark, monkeypatch, levels):
    monkeypatch.setattr(scan, "SEGMENT", 7)
    rng = random.Random(levels)
    rows = [(k, i, [rng.randrange(4) for _ in range(4)], f"{k}{i}") for k in ("p", None, "q") for i in range(1 if k == "q" else 150)]
    out = scan.scanned(spark.createDataFrame(rows, "key string, i int, m array<int>, payload string"), ["key"], "i", "m", 4, start=2, levels=levels)
    got = {(r.key, r.i): (r.state, r.payload) for r in out.collect()}
    state = {}
    for k, i, m, payload in rows:
        assert got[k, i] == (state.get(k, 2), payload)
        state[k] = m[state.get(k, 2)]
    assert len(got) == len(rows)


def fold(words):
    """The coordination rule, one conjunction after the other. words: (cases, clitic, conjunction)."""
    cases, passed = [list(c) for c, *_ in words], [0] * len(words)
    bears = [bool(c) and not clitic for c, clitic, _ in words]
    for i, (_, _, conjunction) in enumerate(words):
        left = next((j for j in range(i - 1, -1, -1) if bears[j]), None)
        right = next((j for j in range(i + 1, len(words)) if bears[j]), None)
        if conjunction and left is not None and right is not None:
            for a, b in ((left, right), (right, left)):
                if len(set(cases[a])) == 1 and len(set(cases[b])) > 1:
                    if cases[a][0] in cases[b]:
                        cases[b] = [c for c in cases[b] if c == cases[a][0]]
                        passed[b] += 1
                    break
    return list(zip(cases, passed))


CANDIDATES = "array<struct<lemma:string,case:string>>"


def coordinated(spark, sentences, **kw):
    rows = [(s, i, [{"lemma": "x", "case": c} for c in cases], [], clitic, conj) for s, words in enumerate(sentences) for i, (cases, clitic, conj) in enumerate(words)]
    df = spark.createDataFrame(rows, f"sent_id int, pos int, noun_candidates {CANDIDATES}, signals_applied array<string>, clitic boolean, conjunction boolean")
    return dis.coordinated(df, ["sent_id"], cases=("DIR", "OBL", "VOC"), **kw)


@pytest.mark.parametrize("levels", [0, 2])
def test_coordination(spark, monkeypatch, levels):
    monkeypatch.setattr(scan, "SEGMENT", 5)
    rng = random.Random(7)
    choices = [[], [], ["DIR"], ["OBL"], ["DIR", "OBL"], ["OBL", "DIR", "OBL"], ["VOC", "DIR"], ["DIR", "DIR"], ["VOC"]]
    sentences = [[(rng.choice(choices), rng.random() < 0.2, rng.random() < 0.4) for _ in range(rng.randrange(1, 40))] for _ in range(120)]
    got = {(r.sent_id, r.pos): ([c["case"] for c in r.noun_candidates], len(r.signals_applied)) for r in coordinated(spark, sentences, levels=levels).collect()}
    want = {(s, i): x for s, words in enumerate(sentences) for i, x in enumerate(fold(words))}
    assert got == want and sum(n for _, n in want.values()) > 150


def test_coordination_of_a_long_text(spark):
    """100,000 tokens: a certain word passes its case through all of them."""
    n = 100_000
    case = F.when(F.col("pos") == 0, F.array(F.lit("OBL"))).when(F.col("pos") % 2 == 0, F.array(F.lit("DIR"), F.lit("OBL"))).otherwise(F.array().cast("array<string>"))
    df = spark.range(n).select(F.lit(1).alias("sent_id"), F.col("id").cast("int").alias("pos"), case.alias("cases"))
    df = df.withColumn("noun_candidates", F.transform("cases", lambda c: F.struct(F.lit("x").alias("lemma"), c.alias("case")))).drop("cases")
    df = df.withColumn("signals_applied", F.array().cast("array<string>")).withColumn("clitic", F.lit(False)).withColumn("conjunction", F.col("pos") % 2 == 1)
    out = dis.coordinated(df, ["sent_id"])
    assert out.filter("size(signals_applied) = 1 and size(noun_candidates) = 1").count() == n // 2 - 1
    assert out.filter("size(noun_candidates) > 1").count() == 0


def test_scan_shuffles_rows_once(spark):
    """The rows' segments serve for the combined maps and for the states."""
    rows = spark.range(500).select((F.col("id") % 3).alias("key"), F.col("id").alias("i"), F.array(F.lit(1), F.lit(0)).alias("m"), F.lit("p").alias("payload"))
    out = scan.scanned(rows, ["key"], "i", "m", 2, levels=1)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan


def test_counted_states(spark):
    rng = random.Random(9)
    rows = [(k, [rng.choice([None, [rng.randrange(3) for _ in range(3)]]) for _ in range(rng.randrange(1, 40))]) for k in range(60)] + [(60, [[1, 2, 0]] * 100_000)]
    out = spark.createDataFrame(rows, "k int, m array<array<int>>").select("k", scan.counted(F.col("m"), 3, 1).alias("c"))
    got = {r.k: (r.c.state, r.c.counts) for r in out.collect()}
    for k, steps in rows:
        state, counts = 1, [0, 0, 0]
        for step in steps:
            counts[state] += 1
            state = state if step is None else step[state]
        assert got[k] == (state, counts)


def test_class_state_of_documents_shuffles_no_words(spark, sf):
    plan = sequences.class_state_documents(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" not in plan


def test_signals_of_turns_sort_no_tokens(spark, sf):
    plan = sequences.signals_turns(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan and "Window" not in plan


@pytest.mark.parametrize("compounds", [True, False])
def test_signals_within_rows(spark, compounds):
    """Within rows as by windows, with long, empty and null texts, on every kind of term."""
    rng = random.Random(11)
    rows = [r for r in sequences.LATIN if compounds or r[1] != "compound"]
    words = sorted({w for r in sequences.LATIN for w in r[0].split()}) + ["sing", "cats", "ended", "x", "y"]
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(60)))) for i in range(150)]
    texts += [(1000, None), (1001, ""), (1002, " "), (1003, "x"), (1004, " ".join(rng.choice(words) for _ in range(70_000))), (1005, "of the sing")]
    s = spark.createDataFrame(texts, "sent_id long, text string").coalesce(1)
    read = lambda *r: F.array(*(F.struct(F.lit(g).alias("gender"), F.lit(n).alias("number")) for g, n in r)).cast("array<struct<gender:string,number:string>>")
    verbs = lambda w: F.when(w.endswith("ing"), read((None, "S"), ("F", "P"), ("M", "S"))).when(w.endswith("ed"), read(("M", "S"))).otherwise(read())
    want = context.signals(marked(s, Terms(rows)).withColumn("verb_candidates", verbs(F.col("token"))), Terms(rows))
    got = context.signals_of(s, verbs, Terms(rows))
    assert sorted(got.columns) == sorted(want.columns)
    want, got = (sorted(map(tuple, df.select(sorted(want.columns)).collect()), key=repr) for df in (want, got))
    assert got == want and len(got) > 70_000


def test_signals_of_repeated_keys(spark):
    """Two texts of one key don't signal to each other."""
    s = spark.createDataFrame([(1, "x of"), (1, "y it"), (1, "x of")], "sent_id long, text string")
    got = context.signals_of(s, lambda w: F.array().cast("array<struct<gender:string,number:string>>"), Terms(sequences.LATIN))
    assert sorted((r.token, r.pos, r.oblique, r.negation) for r in got.collect()) == [("it", 1, False, "nahi"), ("of", 1, False, None), ("of", 1, False, None), ("x", 0, True, None), ("x", 0, True, None), ("y", 0, False, "nahi")]


def test_runs():
    sizes = [3, 0, 4, 100, 0, 1, 9, 2]
    a = pa.array([list(range(n)) if n else None for n in sizes])
    assert runs(a, 10) == [(0, 3), (3, 1), (4, 3), (7, 1)] and runs(a.slice(2, 2), 10) == [(0, 1), (1, 1)] and runs(a[:0], 10) == [(0, 1)]


@pytest.mark.parametrize("name", ["context_prev_next", "nearest_marker_right", "negation_scope"])
def test_neighbours_in_turns_shuffle_no_tokens(spark, sf, name):
    plan = catalogue.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and ("Exchange" not in plan or "Generate" not in plan)


def test_nearest(spark):
    rng = random.Random(3)
    rows = [(i, [rng.random() < 0.2 for _ in range(rng.randrange(30))]) for i in range(80)] + [(100, None), (101, []), (102, [False]), (103, [True]), (104, [i % 1000 == 7 for i in range(70_000)])]
    df = spark.createDataFrame(rows, "k int, m array<boolean>").coalesce(1)
    got = {r.k: r.near for r in df.select("k", context.nearest(F.col("m")).alias("near")).collect()}
    for k, m in rows:
        before, after, last = [], [], None
        for i, x in enumerate(m or []):
            before.append(last)
            last = i if x else last
        last = None
        for i in range(len(m or []) - 1, -1, -1):
            after.append(last)
            last = i if m[i] else last
        assert (got[k] is None) == (m is None) and [(p.before, p.after) for p in got[k] or []] == list(zip(before, after[::-1]))
