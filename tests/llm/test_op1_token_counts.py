import random

import sentencepiece

from rupaka.llm import op1_token_counts as op1

TEXTS = ["", None, " ", "  ", "a ", " a", "  a  b ", "▁", "a▁b", "▁▁a", "a\nb", "\n", "a\t b", "<s> hi </s>", "日本語 テスト", "x" * 5000, "ab" * 9000 + " c", "é̀  z\xa0q", ". . .", "  " * 50 + "q", "." * 10000, " \n  \n"]


def library(texts):
    sp = sentencepiece.SentencePieceProcessor(model_file=op1.vocabulary_path(op1.MODEL))
    return [len(x) for x in sp.encode([t or "" for t in texts], num_threads=1)]


def test_counts_are_the_library_s():
    r = random.Random(1)
    texts = TEXTS + ["".join(r.choice(" ab▁\n\té.<日") for _ in range(r.randrange(40))) for _ in range(3000)] + ["".join(r.choice("abct.é,日the") for _ in range(20000)) for _ in range(5)]
    assert op1.counter(op1.vocabulary_path(op1.MODEL)).counts(texts) == library(texts)


def test_query(spark, sf):
    texts = {r.doc_id: r.text for r in op1.table(spark, sf, "documents").collect()}
    out = op1.op1_token_counts(spark, sf).collect()
    assert len(out) == len(texts)
    want = dict(zip(texts, library(texts.values())))
    assert all((r.n_tokens, r.n_bytes, r.over_limit) == (want[r.doc_id], len(texts[r.doc_id].encode()), want[r.doc_id] > 4096) for r in out)


def test_edges(spark):
    df = spark.createDataFrame([(1, None, 5), (1, "a", 6), (1, "a", 6), (None, "b", 7)], "doc_id long, text string, n_tokens long")
    assert sorted((r.doc_id or 0, r.n_tokens) for r in op1.token_counts(df).collect()) == [(0, 1), (1, 0), (1, 1), (1, 1)]
    assert op1.token_counts(df.limit(0)).collect() == []
