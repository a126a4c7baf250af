from collections import Counter

import corpus_pipeline as cp
from rupaka.llm import op5_pieces
from rupaka.llm.common import written
from tests.llm.test_op2_minhash import closure
from tests.llm.test_op6_pii import plain


def test_stages_against_brute_force(spark, sf):
    raw = cp.table(spark, sf, "documents")
    first = written(cp.identify(spark, raw, sf))
    assert first.columns == raw.columns
    before = {r.doc_id: r for r in raw.collect()}
    texts = {r.doc_id: r.text for r in first.collect()}
    lost = [r for i, r in before.items() if i not in texts]
    assert not any(c.isalpha() for r in lost for c in r.text or ""), [r.text for r in lost if r.text][:3]

    second = written(cp.deduplicate(spark, first, sf))
    sets = {}
    for i, t in texts.items():
        w = t.encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    roots = closure(sets, links)
    assert {r.doc_id for r in second.collect()} == {i for i, c in roots.items() if i == c}

    third = written(cp.redact(spark, second, sf))
    for r in third.collect():
        t, old = r.text, texts[r.doc_id]
        spans = plain(old)
        assert (t == old) or spans or "[IBAN]" in t or "[LOCAL_PHONE]" in t
        assert r.n_chars == len(t) and not any(k == "email" for k, _, _ in plain(t))

    fourth = written(cp.mix(spark, third, sf))
    copies = Counter(r.doc_id for r in fourth.collect())
    assert set(copies) == {r.doc_id for r in third.collect()} and max(copies.values()) <= 5

    fifth = cp.encode(spark, fourth, sf).collect()
    by_id = {r.doc_id: r.text for r in third.collect()}
    assert sum(copies.values()) == len(fifth) and all(r.lossless and op5_pieces.decode_ids(r.ids) == by_id[r.doc_id] for r in fifth)


def test_edges(spark, sf):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame([(1, None, "en", None, None), (2, "", None, "a", 0), (3, "the thing is", "en", None, 12), (4, "the thing is", "en", "a", 12), (6, "die sache ist das", "de", "a", 9), (7, "die sache", "de", "b", 9)], schema)
    docs = df
    for _, stage in cp.STAGES[:-1]:
        docs = written(stage(spark, docs, sf))
        assert docs.columns == df.columns
    assert {r.doc_id for r in cp.encode(spark, docs, sf).collect()} >= {3}
    docs = df.limit(0)
    for _, stage in cp.STAGES[:-1]:
        docs = written(stage(spark, docs, sf))
    assert cp.encode(spark, docs, sf).count() == 0


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_near_dedup_keeps_rows_without_id_and_one_of_repeated_rows(spark, sf):
    a, b, c = ("alpha beta gamma delta epsilon zeta", "one two three four five six", "red green blue black white grey")
    data = [(None, a, "en", "s", 1), (None, a, "en", "s", 1), (None, b, "en", None, 1), (3, a, "en", "s", 1), (5, a, "en", "s", 1), (5, b, "en", "s", 1)]
    data += [(7, c, "en", "s", 2), (7, c, "en", "s", 1), (7, c, "en", "s", 1), (8, c, "en", "s", 1), (8, c, "en", "s", 1)]
    out = Counter((r.doc_id, r.text, r.n_chars) for r in cp.deduplicate(spark, spark.createDataFrame(data, SCHEMA), sf).select("doc_id", "text", "n_chars").collect())
    assert out == {(None, a, 1): 2, (None, b, 1): 1, (3, a, 1): 1, (5, a, 1): 1, (5, b, 1): 1, (7, c, 1): 1}


def test_mix_counts_repeated_rows_once_each_and_keeps_rows_without_id(spark, sf):
    text = "w " * 50
    data = [(1, text, "en", "a", 100)] * 5 + [(None, text, "en", "a", 100), (None, "x", "en", None, 1), (2, None, None, None, None)]
    data += [(i, text, "de", "a", 100) for i in range(10, 20)]
    docs = spark.createDataFrame(data, SCHEMA)
    out = cp.mix(spark, docs, sf)
    assert out.columns == docs.columns
    got, given = Counter(map(tuple, out.collect())), Counter(data)
    assert set(got) == set(given) and all(n <= got[r] <= 5 * n for r, n in given.items())
    assert got[1, text, "en", "a", 100] <= 10  # the largest source has one pass and a part of another at most


def test_language_id_loses_only_texts_without_letters(spark, sf):
    raw = cp.table(spark, sf, "documents")
    # a word that four languages share alike has a posterior of a quarter in each
    same = [(i, "the same words", lang, "s", 14) for i, lang in enumerate("abcd" * 10, 10**9)]
    for docs in (raw, spark.createDataFrame(same + [(1, "12 !", "a", "s", 4), (None, "", "a", "s", 0)], SCHEMA)):
        got = Counter((r.doc_id, r.text) for r in cp.identify(spark, docs, sf).collect())
        lost = Counter((r.doc_id, r.text) for r in docs.collect()) - got
        assert not [t for _, t in lost if t and any(c.isalpha() for c in t)]
