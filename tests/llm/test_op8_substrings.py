import random

import pytest

from rupaka.llm import op8_substrings as op8
from tests.llm.common import same


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_against_sql(spark, folder):
    d = f"/root/testdata/{folder}"
    same(op8.op8_substring_dedup(spark, d), op8.SQL, d)


def brute(docs, window):
    first, out = {}, {}
    words = {i: (t or "").split() for i, t in docs}
    for i in sorted(words):
        for p in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][p : p + window]), i)
    for i, w in words.items():
        gone = {q for p in range(len(w) - window + 1) if first[tuple(w[p : p + window])] < i for q in range(p, p + window)}
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def test_random_passages(spark):
    r = random.Random(3)
    word = lambda: r.choice("abcdefghij")
    passages = [[word() for _ in range(r.randrange(5, 40))] for _ in range(12)]
    docs = []
    for i in range(300):
        t = []
        for _ in range(r.randrange(8)):
            t += r.choice(passages) if r.random() < 0.7 else [word() for _ in range(r.randrange(9))]
        docs.append((i, " ".join(t)))
    docs += [(300, None), (301, ""), (302, " ".join(passages[0] * 9)), (303, " ".join(passages[0] * 9))]
    df = spark.createDataFrame([(i, t, 1, "s") for i, t in docs], "doc_id long, text string, anchor int, spans string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in op8.without_spans(df, op8.duplicate_spans(df, 12, 5), 12).collect()}
    assert got == brute(docs, 12)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert op8.without_spans(df, op8.duplicate_spans(df)).collect() == []


def test_factors_rebuild_texts(spark):
    """The factors cover a text in order; each is literal or stands in an earlier document at the place given, and no longer stretch starts there."""
    r = random.Random(9)
    source = [[f"w{r.randrange(400)}" for _ in range(300)] for _ in range(6)]
    docs = [(i, s) for i, s in enumerate(source)]
    for i in range(6, 60):
        t = []
        for _ in range(r.randrange(1, 5)):
            s = r.choice(docs)[1]
            a = r.randrange(len(s))
            t += s[a : a + r.randrange(10, 150)] + [f"x{r.random()}"] * r.randrange(3)
        docs.append((i, t))
    df = spark.createDataFrame([(i, " ".join(t), 0) for i, t in docs], "doc_id long, text string, ref int")
    words, n_refs, after_factor = dict(docs), 0, 0
    out = op8.without_spans(df, op8.duplicate_spans(df, 20, 8), 20).collect()
    want = brute([(i, " ".join(t)) for i, t in docs], 20)
    for d in out:
        assert (d.n_words, d.n_removed, d.kept) == want[d.doc_id]
        assert [f.start for f in d.factors] == [0, *(f.end for f in d.factors)][: len(d.factors)] and (not d.factors or d.factors[-1].end == d.n_words)
        rebuilt = []
        for f in d.factors:
            own = words[d.doc_id][f.start : f.end]
            rebuilt += own if f.ref is None else words[f.ref][f.ref_start : f.ref_start + f.end - f.start]
            n_refs += f.ref is not None
            after_factor += f.ref is not None and f.end - f.start < 20
            assert f.ref is None or f.ref < d.doc_id
        assert rebuilt == words[d.doc_id]
    assert n_refs > 80 and after_factor > 0


def test_greedy_parse():
    found = op8.stretches([(0, 3, 1, 10), (3, 2, 1, 13), (4, 4, 2, 50), (30, 1, 3, 0), (99, 9, 3, 7)], 40, 5)
    assert found == [(0, 9, 1, 10), (4, 12, 2, 50), (30, 35, 3, 0)]
    assert op8.parsed(found, 40) == [(0, 9, 1, 10), (9, 12, 2, 55), (12, 30, None, None), (30, 35, 3, 0), (35, 40, None, None)]
    assert op8.covered(found) == [(0, 12), (30, 35)] and op8.parsed([], 0) == [] and op8.parsed([], 2) == [(0, 2, None, None)]


def test_nulls_repeats_and_long_texts(spark):
    long = " ".join(f"w{k * k % 9973}" for k in range(120_000))
    other = " ".join(["q"] * 30 + [f"w{k * k % 9973}" for k in range(5000, 5200)])
    rows = [(1, long, "a"), (2, other, "b"), (2, other, "b"), (None, other, "c"), (3, None, "d"), (4, other, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = op8.without_spans(df, op8.duplicate_spans(df)).collect()
    by = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in got)
    assert by == [(0, 230, 0), (1, 120_000, 0), (2, 230, 200), (2, 230, 200), (3, 0, 0), (4, 230, 230)]
