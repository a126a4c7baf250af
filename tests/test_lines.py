"""Line numbers and the order of rows of files that are read in several splits."""

import random

from pyspark.sql import functions as F

from rupaka.operators import bigram, vocabulary
from rupaka.plans import sequences
from rupaka.sources import lexicons


def test_ordered_lines(spark, tmp_path):
    rng = random.Random(3)
    want = {}
    for name, ends in (("a", "\n"), ("b", "\r\n"), ("c", "\n"), ("d", "\n")):
        lines = ["".join(rng.choice("xyé ") for _ in range(rng.randrange(120))) for _ in range({"c": 1, "d": 0}.get(name, 1500))]
        if name == "a":
            lines[700] = "w" * 30_000  # a line over several splits
        (tmp_path / f"{name}.txt").write_bytes(ends.join(lines).encode() + (ends.encode() if name == "a" else b""))
        want |= {(name, k): line for k, line in enumerate(lines, 1)}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        df = lexicons.ordered_lines(spark, str(tmp_path))
        rows = df.collect()
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {(r.file[-5], r.line_no): r.line for r in rows} == want
    assert [(r.file[-5], r.line_no) for r in sorted(rows, key=lambda r: r.n)] == sorted(want) and {r.n for r in rows} == set(range(1, len(want) + 1))


def test_last_entry_of_a_lexicon_in_splits(spark, tmp_path):
    rng = random.Random(4)
    rows = [(f"w{rng.randrange(300)}", rng.choice(["M1", "M2", "F1", "F2"])) for _ in range(4000)]
    path = tmp_path / "lexicon.tsv"
    path.write_text("word\tparadigm_class\n" + "".join(f"{w}\t{c}\n" for w, c in rows))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        got = {r.norm: r.paradigm for r in lexicons.load_lexicon(spark, str(path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == dict(rows)


def test_sparse_model_is_the_full_one(spark):
    rng = random.Random(5)
    pairs = spark.createDataFrame([(rng.choice("abcd"), rng.choice("abcde")) for _ in range(60)], "prev string, curr string")
    counts = pairs.groupBy("prev", "curr").agg(F.count("*").alias("n"))
    full = {(r.prev, r.curr): r.p for r in bigram.bigram_model(counts).collect()}
    asked = [(p, c) for p in ["a", "b", "c", "d", "e", "z", None] for c in ["a", "e", "z", None]] * 2
    out = bigram.scored(spark.createDataFrame(asked, "prev string, curr string"), bigram.sparse_model(counts)).collect()
    known = {p for p, _ in full}
    assert len(out) == len(asked)
    for r in out:
        if (r.prev, r.curr) in full:
            assert abs(r.p - full[r.prev, r.curr]) < 1e-12
        elif r.prev in known and r.curr is not None:
            assert 0 < r.p < min(p for (a, _), p in full.items() if a == r.prev) + 1e-12 and not r.seen
        else:
            assert r.p == 0.0 and not r.seen


def test_dense_ids(spark):
    rng = random.Random(6)
    values = [rng.choice("abcé𝄞") * rng.randrange(1, 5) + str(rng.randrange(40)) for _ in range(900)] + ["hot"] * 400
    rows = spark.createDataFrame([(k % 97, v) for k, v in enumerate(values)], "item int, value string").distinct()
    known = vocabulary.dictionary(rows, "value", 3).collect()
    count = {}
    for r in rows.collect():
        count.setdefault(r.value, set()).add(r.item)
    want = sorted((v for v, k in count.items() if len(k) >= 3), key=str.encode)
    assert {(r.value, r.n, r.id) for r in known} == {(v, len(count[v]), i) for i, v in enumerate(want)}
    ids = {r.item: r.ids for r in vocabulary.encoded(rows, "item", "value", vocabulary.dictionary(rows, "value", 3)).collect()}
    assert ids == {k: [i for i, v in enumerate(want) if k in count[v]] for k in {r.item for r in rows.collect()}}
    assert vocabulary.dictionary(rows.limit(0), "value").collect() == []


def test_lines_are_not_shuffled_for_their_numbers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x\ny\n" * 50)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with files that are large by their statistics
    try:
        plan = lexicons.ordered_lines(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_lines_of_repeated_documents_take_turns(spark, tmp_path):
    rows = [(2, "c d", "x"), (1, "a b", "y"), (1, "e", "y"), (3, None, "x")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.word: r.last_line for r in sequences.lexicon_of_lines(spark, str(tmp_path)).collect()}
    assert {got["a"], got["e"]} == {1, 2} and (got["b"], got["c"], got["d"]) == (3, 4, 5)


def test_pairs_of_a_sparse_model_meet_no_join(spark):
    """Words counted without the pairs give the same model, and the pairs' own table is only counted."""
    texts = spark.createDataFrame([(1, "a b a c"), (2, "z"), (3, "b a"), (4, None)], "k int, text string")
    counts = sequences.neighbours(texts, "k").groupBy("prev", "curr").agg(F.count("*").alias("n"))
    words = sequences.begun(texts)
    assert sorted(map(tuple, words.collect())) == [("a", 2), ("b", 2), ("c", 0)]
    asked = spark.createDataFrame([(p, c) for p in "abcz" for c in "abcz"], "prev string, curr string")
    one, other = (sorted(map(tuple, bigram.scored(asked, bigram.sparse_model(counts, words=w)).collect())) for w in (words, None))
    assert one == other and len(one) == 16
    assert [(s, round(p, 9)) for a, b, s, p in one if (a, b) in (("b", "a"), ("c", "a"))] == [(True, round(2.1 / 2.3, 9)), (False, 0.0)]
    assert "Join" not in bigram.sparse_model(counts)[0]._jdf.queryExecution().executedPlan().toString()
