import random

import pytest

from rupaka.llm import op2_minhash as op2
from rupaka.llm.common import Bitmap
from rupaka.llm.components import components
from tests.llm.common import same


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_against_sql(spark, folder):
    d = f"/root/testdata/{folder}"
    same(op2.op2_minhash_dedup(spark, d), op2.SQL, d)


def closure(nodes, links):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components(spark):
    r = random.Random(5)
    links = [(r.randrange(400), r.randrange(400)) for _ in range(250)] + [(k, k + 1) for k in range(1000, 1060)] + [(7, 7)]
    links = [(a, b) for a, b in links if a != b]
    got = {x.node: x.component for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == closure({x for p in links for x in p}, links)


def test_chains_of_edits(spark):
    """A family in which most links are not with its smallest member."""
    r = random.Random(8)
    base = [f"w{k}" for k in range(120)]
    docs, texts = [], [base]
    for i in range(120):
        t = list(r.choice(texts))
        for _ in range(r.randrange(1, 6)):
            t[r.randrange(len(t))] = f"x{r.random()}"
        texts.append(t)
    docs = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(500, None), (501, ""), (502, "One"), (503, "one"), (504, "two")]
    sets = {i: {" ".join(w[k : k + 2]) for k in range(max(1, len(w) - 1))} if (w := (t or "").lower().split()) else set() for i, t in docs}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    df = spark.createDataFrame([(i, t, 0, "k") for i, t in docs], "doc_id long, text string, component_id int, keys string")
    got = {x.doc_id: x for x in op2.near_duplicates(df, shingle=2).collect()}
    assert {i: x.component_id for i, x in got.items()} == closure(sets, links)
    assert all(x.n_shingles == len(sets[i]) and x.kept == (x.component_id == i) for i, x in got.items())


def test_empty_table(spark):
    assert op2.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def linked(docs, percent=80):
    sets = {i: {" ".join(w[k : k + 2]) for k in range(max(1, len(w) - 1))} if (w := (t or "").lower().split()) else set() for i, t in docs}
    return sets, [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]


def test_large_family_around_a_text_that_is_not_its_smallest(spark):
    """Copies that differ from each other but not from their text: the text has a larger id than most, so no bucket's smallest member is the centre."""
    r = random.Random(4)
    text = [f"w{k}" for k in range(200)]
    docs = []
    for i in range(400):
        t = list(text)
        for k in r.sample(range(0, 200, 2), 9):  # every change takes two shingles: 0.83 to the text, 0.69 to others
            t[k] = f"x{i}.{k}"
        docs.append((i, " ".join(t)))
    docs.append((1000, " ".join(text)))
    sets, links = linked(docs)
    assert len(links) < 800 and set(closure(sets, links).values()) == {0}
    got = {x.doc_id: x.component_id for x in op2.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), shingle=2).collect()}
    assert got == closure(sets, links)


def test_null_and_repeated_ids_and_a_long_text(spark):
    long = " ".join(f"w{k * k % 10007}.{k // 3}" for k in range(150_000))
    same_, other = "one two three four five six", "seven eight nine ten eleven twelve"
    rows = [(5, same_), (None, same_), (None, None), (3, same_), (3, same_), (7, other), (9, long), (11, long + " end"), (12, ""), (12, "")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, key string, c int")
    got = sorted(((x.doc_id or 0, x.n_shingles, x.component_id or 0, x.kept) for x in op2.near_duplicates(df, shingle=2).collect()))
    n = len(set(zip(long.split(), long.split()[1:])))
    assert got == sorted([(5, 5, 3, False), (0, 5, 0, True), (0, 0, 0, True), (3, 5, 3, True), (3, 5, 3, True), (7, 5, 7, True), (9, n, 9, True), (11, n + 1, 9, False), (12, 0, 12, True), (12, 0, 12, True)])


def test_bitmap(spark):
    ids = spark.createDataFrame([(i,) for i in [1, -5, 1 << 60, 77]], "i long")
    df = spark.range(-100, 100).union(spark.createDataFrame([(1 << 60,), (None,)], "id long"))
    got = {r.id for r in Bitmap(ids, "i").marked(df, "id").filter("marked").collect()}
    assert got == {1, -5, 1 << 60, 77}
    assert Bitmap(ids.limit(0), "i").marked(df, "id").filter("marked").count() == 0


def test_one_id_with_several_texts(spark):
    """Each text of an id is a class of its own, and what is like the second one isn't lost."""
    a, b = (" ".join(f"{c}{i}" for i in range(100)) for c in "ab")
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (3, b + " y"), (7, b.upper()), (1, a)]
    out = op2.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2)
    got = sorted((r.doc_id, r.component_id, r.kept) for r in out.collect())
    assert got == [(1, 1, True)] * 3 + [(2, 1, False), (3, 1, False), (3, 1, False), (7, 1, False)]


def test_recall_on_many_documents(spark):
    """Every component of sf0.1 is the exact SQL's."""
    same(op2.op2_minhash_dedup(spark, "/root/testdata/sf0.1"), op2.SQL, "/root/testdata/sf0.1")
