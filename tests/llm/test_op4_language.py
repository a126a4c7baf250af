import zlib

import numpy as np

from rupaka.llm import op4_language as op4
from rupaka.llm.lattice import lattice


def every_split(word, p, ids, lat):
    """The sum over all segmentations, one by one."""
    if not word:
        return 1.0
    total = 0.0
    for k in range(1, min(len(word), lat.longest) + 1):
        q = p[ids[word[:k]]] if word[:k] in ids else (op4.UNKNOWN if k == 1 else 0.0)
        if q:
            total += q * every_split(word[k:], p, ids, lat)
    return total


def uses(word, p, ids, lat):
    """Probability-weighted piece counts over all segmentations, one by one."""
    if not word:
        return 1.0, {}
    total, counts = 0.0, {}
    for k in range(1, min(len(word), lat.longest) + 1):
        i = ids.get(word[:k], -1)
        q = p[i] if i >= 0 else (op4.UNKNOWN if k == 1 else 0.0)
        if q:
            t, c = uses(word[k:], p, ids, lat)
            total += q * t
            for j, x in c.items():
                counts[j] = counts.get(j, 0) + q * x
            if i >= 0:
                counts[i] = counts.get(i, 0) + q * t
    return total, counts


def test_forward_and_expectations_sum_over_all_segmentations():
    lat = lattice(op4.MODEL)
    ids = {p: i for i, p in lat.pieces.items()}
    rng = np.random.default_rng(1)
    p = np.vstack([rng.random((lat.size, 2)) ** 4, np.zeros((1, 2))])
    words = [" the", " a", " éèê", " xяz", " thing", " ﷽q", " onhereti", " \U0001f600s"]
    got = op4.forward(lat, words, p)
    want = np.log([[every_split(w, p[:, k], ids, lat) for k in range(2)] for w in words])
    assert np.allclose(got, want)
    n = np.arange(1, len(words) + 1).astype(float)
    e = op4.expected(lat, words, n, p[:, 0])
    direct = np.zeros(lat.size)
    for w, c in zip(words, n):
        t, counts = uses(w, p[:, 0], ids, lat)
        for i, x in counts.items():
            direct[i] += c * x / t
    assert np.allclose(e, direct)
    assert np.isfinite(op4.forward(lat, [" " + "ab" * 3000, " " + "я" * 500], p)).all()


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in op4.table(spark, d, "documents").select("doc_id", "lang").collect()}
    out = op4.op4_language_id(spark, d).collect()
    assert len(out) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in out)
    asked = [r for r in out if r.held_out and truth[r.doc_id]]
    right = sum(r.lang_pred == truth[r.doc_id] for r in asked) / len(asked)
    print("held-out accuracy", right)
    assert right >= 0.95


def test_edges(spark):
    train = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([("the thing is that", "en"), ("die sache ist das", "de")] * 5)], "doc_id long, text string, lang string")
    m = op4.fit(train)
    df = spark.createDataFrame([(1, None, 0.5, "x"), (2, "", 0.5, "x"), (3, "123 ²!", 0.5, "x"), (4, "The thing", 0.5, "x"), (4, "The thing", 0.5, "x"), (None, "die sache " * 2000, 0.5, "x")], "doc_id long, text string, score double, lang_pred string")
    got = sorted(((r.doc_id or 0, r.lang_pred) for r in op4.predict(df, m).collect()))
    assert got == [(0, "de"), (1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en")]
    nothing = op4.fit(train.limit(0))
    assert nothing.langs == [] and {r.lang_pred for r in op4.predict(df, nothing).collect()} == {"und"}
    assert op4.predict(df.limit(0), m).count() == 0


def test_sample_is_bounded_per_language(spark):
    rows = [(i, "the thing is that", "en") for i in range(400)] + [(500 + i, t, "de") for i, t in enumerate([None, "", "12", "die sache ist das", "das ist die sache"])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert op4.fit(df, most=3).langs == ["de", "en"]
    n = {(r.lang, r.word): r.n for r in op4.sample_words(df, 3).collect()}
    assert n["en", " thing"] == 3 and n["de", " sache"] == 2
    assert {(r.lang, r.word): r.n for r in op4.sample_words(df, 300).collect()}["en", " thing"] == 300
