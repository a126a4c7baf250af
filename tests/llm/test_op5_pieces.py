import random
from collections import Counter

import numpy as np

from rupaka.llm import op5_pieces as op5
from rupaka.llm.lattice import lattice

TEXTS = ["", " ", "  ", "a", " a", "a ", "a\nb\n\n c", "▁", " ▁▁ a▁b", "日本 語﷽ 😀x", "\x00\t\r", "é̀ and", "x" * 5000, " " * 70 + "q", "the thing " * 500]


def test_lossless_and_pieces_of_the_vocabulary():
    r = random.Random(2)
    texts = TEXTS + ["".join(r.choice(" ab▁\n\té.<日😀the") for _ in range(r.randrange(60))) for _ in range(2000)]
    out = op5.encode_texts(list(range(len(texts))), texts)
    assert [op5.decode_ids(x.tolist()) for x in out] == texts
    assert all(((x >= 0) & (x < lattice(op5.MODEL).size)).all() for x in out)
    alone = [op5.encode_texts([i], [t])[0] for i, t in enumerate(texts[:60])]
    assert all((a == b).all() for a, b in zip(alone, out))


def segmentations(word, w, ids, longest):
    if not word:
        yield (), 1.0
    for k in range(1, min(len(word), longest) + 1):
        i = ids.get(word[:k])
        if i is not None:
            for rest, p in segmentations(word[k:], w, ids, longest):
                yield (i, *rest), p * w[i]


def test_frequencies_follow_the_lattice():
    lat, w = lattice(op5.MODEL), op5.weights(op5.MODEL, 1.0)
    ids = {p: i for i, p in lat.pieces.items()}
    want = dict(segmentations(" then", w, ids, lat.longest))
    total = sum(want.values())
    n = 20000
    got = Counter(tuple(x.tolist()) for x in op5.encode_texts(list(range(n)), ["then"] * n))
    assert set(got) <= set(want)
    for s, p in want.items():
        p /= total
        assert abs(got[s] / n - p) < 5 * np.sqrt(p * (1 - p) / n) + 1e-3


def test_query_and_edges(spark, sf):
    out = op5.op5_sampled_pieces(spark, sf)
    rows = sorted(out.collect())
    assert len(rows) == 200 and all(r.lossless for r in rows)
    df = spark.createDataFrame([(1, None, 3), (2, "", 3), (3, "ab c", 3), (3, "ab c", 3), (None, "q", 3)], "doc_id long, text string, ids int")
    e = op5.decode(op5.encode(df)).collect()
    assert sorted((r.doc_id or 0, r.ids is None, r.decoded) for r in e) == [(0, False, "q"), (1, True, None), (2, False, ""), (3, False, "ab c"), (3, False, "ab c")]
    assert len({tuple(r.ids) for r in e if r.doc_id == 3}) == 1
    assert op5.decode(op5.encode(df.limit(0))).count() == 0
    docs = op5.table(spark, sf, "documents")
    assert sorted(op5.encode(docs.repartition(7)).select("doc_id", "ids").collect()) == sorted(op5.encode(docs).select("doc_id", "ids").collect())
