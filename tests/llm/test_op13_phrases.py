import random
import re
from collections import Counter

import numpy as np

from rupaka.llm import op13_phrases as op
from tests.llm.common import same


def brute(rows, least=10, first=2000, share=50):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = tuple(re.findall(r"[^\x20\x09]+", piece))
            n[lang] += len(w)
            f.update((lang, w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    out = []
    for (lang, w), a in f.items():
        if len(w) > 1 and a >= least:
            if len(w) == 2 and any(100 * b >= share * a for (m, x), b in triples(f, least) if m == lang and w in (x[:2], x[1:])):
                continue
            score, _, l, r = min((1_000_000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            out.append((lang, " ".join(w), a, l, r, n[lang], score))
    out.sort(key=lambda x: (x[0], -x[6], -x[2], x[1].encode()))
    ranks = Counter()
    ranked = []
    for x in out:
        ranks[x[0]] += 1
        if ranks[x[0]] <= first:
            ranked.append((x[0], ranks[x[0]], *x[1:]))
    return ranked


def triples(f, least):
    return [(k, a) for k, a in f.items() if len(k[1]) == 3 and a >= least]


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_query(spark):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        same(op.op13_phrases(spark, sf), op.SQL, sf)


def test_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    words = ["a", "B", "b", "cé", "\x00", "\xa0x", "\x85", "d\x1ce", "𝄞", "ff"]
    signs = [" ", " ", " ", "\t", "  ", ". ", "\n", "\r\n", ",", "?!"]
    rows = [(rng.choice(["x", "y", None, "und", ""]), "".join(rng.choice(words) + rng.choice(signs) for _ in range(rng.randrange(60)))) for _ in range(60)]
    rows += [("x", None), ("x", ""), (None, None), ("x", " . \n"), ("long", "one two three " * 400 + "w" * 5000 + " one two")]
    rows += [("x", "same text again")] * 12 + [("y", "x y x y")] * 3  # words named like languages
    docs = spark.createDataFrame([(*r, 1, "c") for r in rows], "lang string, text string, n long, word string")
    want = sorted(brute(rows, least=4))
    assert len(want) > 100
    assert got(op.phrases(docs, least=4)) == want
    for name, value in (("CHUNK", 7), ("WORDS", 20), ("DISTINCT", 3)):  # cuts everywhere
        monkeypatch.setattr(op, name, value)
    assert got(op.phrases(docs, least=4, first=7, share=80)) == sorted(brute(rows, 4, 7, 80))


def test_empty(spark):
    assert got(op.phrases(spark.createDataFrame([], "lang string, text string"))) == []
    assert got(op.phrases(spark.createDataFrame([(None, None), ("a", "x")], "lang string, text string"))) == []


def test_keys():
    rng = np.random.default_rng(3)
    a, b, c = (rng.integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(3))
    assert (op.unmix(op.mix(a)) == a).all()
    assert (op.unpacked(op.pair_keys(a, b), [b]) == a).all()
    assert (op.unpacked(op.mix(op.mix(op.mix(a) + b * op.MIX) + c * op.MIX), [b, c]) == a).all()


def test_keys_that_share_their_first_word(spark):
    rows = [(5, 1, 3), (5, 2, 4), (5, 1, 7), (9, 1, 1), (5, 2, 6), (-4, 3, 12), (-4, 2, 9), (-4, 3, 1)]
    out = op.counted_keys(spark.createDataFrame(rows * 50, "k1 long, k2 long, n long"), 2, 51).collect()
    assert sorted((r.key, r.id2, r.n) for r in out) == [(-4, 2, 450), (-4, 3, 650), (5, 1, 500), (5, 2, 500)]


def test_ids_that_clash(spark, monkeypatch):
    """A seed under which two words share an id is given up."""
    real = op.ids_of

    def weak(words, lang, seed):
        out = real(words, lang, seed)
        return np.where(out == 0, out, np.uint64(7)) if seed == 0 else out

    monkeypatch.setattr(op, "ids_of", weak)
    rows = [("x", "one two three")] * 12
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert got(op.phrases(docs)) == sorted(brute(rows))
