import re
import unicodedata
from collections import Counter

from rupaka.plans import catalogue


def grams(texts):
    words = {unicodedata.normalize("NFC", w).lower() for t in texts for w in re.split(r"[\s\x1c-\x1f\x85]+", t or "") if w}
    n = Counter()
    for w in words:
        r = "".join(reversed(re.findall("(?s).[़्]*", w)))
        n.update({r[i : i + k] for k in range(1, 5) for i in range(len(r) - k + 1)})
    return {g: k for g, k in n.items() if k >= 2}


def test_all_words_of_documents(spark, sf):
    got = {r.gram: r.n for r in catalogue.ngram_features(spark, sf).collect()}
    want = grams(r.text for r in catalogue.table(spark, sf, "documents").select("text").collect())
    assert got == want and any(ord(c) > 127 for g in got for c in g)


def test_devanagari_words(spark, tmp_path):
    texts = ["लड़की लड़के पढ़ो", "कर्म धर्म été Été", None, ""]
    rows = [(i, t, "hi", "s") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.gram: r.n for r in catalogue.ngram_features(spark, str(tmp_path)).collect()}
    assert got == grams(texts) and got["मर्"] == 2


def test_classifier_predicts_every_word_of_one_language(spark, sf):
    langs = {}
    for r in catalogue.table(spark, sf, "documents").filter("lang in ('en', 'de')").select("lang", "text").collect():
        for w in re.split(r"[\s\x1c-\x1f\x85]+", r.text or ""):
            if w:
                langs.setdefault(unicodedata.normalize("NFC", w), set()).add(r.lang)
    out = catalogue.char_ngram_classifier(spark, sf).collect()
    assert sum(r.n for r in out) == sum(len(k) == 1 for k in langs.values())
    assert abs(sum(r.share for r in out) - 1) < 1e-9
