import random
import re
import unicodedata

from pyspark.sql import functions as F

from rupaka.functions import normal, text as x
from rupaka.plans import normal as plans


def strings(n):
    """Strings of letters, marks, parts of composed characters and characters that composition replaces."""
    rng = random.Random(4)
    marks = [chr(p) for p in range(0x110000) if unicodedata.combining(chr(p))]
    parts = [c for p in range(0x110000) if (d := unicodedata.decomposition(chr(p))) and not d.startswith("<") for c in [chr(p), *(chr(int(x, 16)) for x in d.split(" "))]]
    jamo = [chr(p) for p in (*range(0x1100, 0x1113), *range(0x1161, 0x1176), *range(0x11A8, 0x11C3), 0xAC00, 0xAC01)]
    pools = [marks, parts, jamo, list("abcéक𝄞")]
    return ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randrange(9))) for _ in range(n)]


def test_composed(spark):
    words = [w for w in strings(6000) if not re.search(r"\s", w)] + ["", None]
    df = spark.createDataFrame([(i, w, "x") for i, w in enumerate(words)], "i int, token string, _other string")
    got = {r.i: r.token for r in normal.composed(df).collect()}
    assert got == {i: None if w is None else unicodedata.normalize("NFC", w) for i, w in enumerate(words)}


def test_all_single_characters_and_pairs_with_a_mark():
    """The pattern names every character that composed text can't hold or that may join another."""
    cls = re.compile("[" + re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", normal.doubtful()) + "]")
    for p in range(0x110000):
        c = chr(p)
        if not 0xD800 <= p < 0xE000 and not cls.search(c):
            assert unicodedata.normalize("NFC", c) == c and unicodedata.normalize("NFC", "a" + c) == "a" + c and unicodedata.combining(c) == 0


def test_clusters(spark):
    words = strings(3000) + ["", None]

    def brute(w):
        out = []
        for c in w:
            if out and unicodedata.combining(c):
                out[-1] += c
            else:
                out.append(c)
        return out

    df = spark.createDataFrame(list(enumerate(words)), "i int, w string").select("i", x.graphemes("w").alias("c"), x.reversed_graphemes("w").alias("r"))
    for r in df.collect():
        want = None if words[r.i] is None else brute(words[r.i])
        assert r.c == want and r.r == (None if want is None else "".join(reversed(want)))


def test_tokenized(spark):
    df = spark.createDataFrame([(1, "e\u0301 b\u2000\u0301c"), (2, None), (3, " ")], "k int, text string")
    assert sorted(tuple(r) for r in normal.tokenized(df, "k").collect()) == [(1, 0, "é"), (1, 1, "b"), (1, 2, "\u0301c")]
    assert normal.tokenized(df.limit(0), "k").agg(F.count("*")).first()[0] == 0


def test_words_are_composed_where_they_stand(spark):
    """No shuffle, null and empty texts, several texts of one id, and the words of texts of which some may change."""
    rows = [(1, "é b é"), (1, "é x"), (2, None), (3, " "), (4, "a b a"), (5, "अ́ क़ ậ")]
    df = spark.createDataFrame(rows, "k int, text string")
    out = normal.words(df, "k")
    assert sorted(tuple(r) for r in out.collect() if r.k != 2) == [(1, ["é", "b", "é"]), (1, ["é", "x"]), (3, []), (4, ["a", "b", "a"]), (5, [unicodedata.normalize("NFC", w) for w in rows[5][1].split()])]
    for d in (out, normal.tokenized(df, "k"), normal.composed(df, "text")):
        assert "Exchange" not in d._jdf.queryExecution().executedPlan().toString()


def test_distinct_composed_words_of_a_repeated_id(spark, tmp_path):
    spark.createDataFrame([(1, "é b é"), (1, "é x"), (2, None), (3, "a a")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(tuple(r) for r in plans.nfc_tokens(spark, str(tmp_path)).collect()) == [(1, 5, 3), (3, 2, 1)]


def test_distinct_words_are_shuffled_once(spark, sf):
    """Once to be distinct, and not again to be composed."""
    plan = plans.nfc_documents(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
