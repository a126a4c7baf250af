"""One call from words to predictions, and lists written in one job."""

import os

import pytest
from pyspark.sql import functions as F

from rupaka.plans.predictor import predicted_lexicon
from rupaka.sources import sinks

ROWS = [(f"w{k}", c, t, p) for k, (c, t, p) in enumerate([("M2", "high", 0.91), ("F3", "medium", 0.7), ("M2", "low", 0.6), ("F3", "abstain", 0.51)] * 30)]


def test_routes(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "word string, paradigm_class string, tier string, probability double")
    folder = f"{tmp_path}/lists"
    for _ in range(2):  # the second time what is there is replaced
        sinks.write_routes(df, folder)
        got = sorted(map(tuple, sinks.read_routes(spark, folder).collect()))
        assert got == sorted(map(tuple, sinks.routed(df).collect())) and os.listdir(tmp_path) == ["lists"]
    assert sorted(d for d in os.listdir(folder) if "=" in d) == ["route=abstain", "route=predicted", "route=review"]
    for d in ("abstain", "predicted", "review"):
        files = sorted(f for f in os.listdir(f"{folder}/route={d}") if f.endswith(".csv"))
        words = [line.split("\t")[0] for f in files for line in open(f"{folder}/route={d}/{f}").read().splitlines()[1:]]
        assert words == sorted(words)


def test_failed_write_keeps_what_was_there(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "word string, paradigm_class string, tier string, probability double")
    sinks.write_routes(df, f"{tmp_path}/lists")
    with pytest.raises(Exception):
        sinks.write_routes(df.withColumn("probability", F.raise_error(F.lit("no")).cast("double")), f"{tmp_path}/lists")
    assert sinks.read_routes(spark, f"{tmp_path}/lists").count() == len(ROWS) and os.listdir(tmp_path) == ["lists"]


def test_one_call(spark, tmp_path):
    stems = [a + b for a in "कखगचछजटडतदनप" for b in ("म", "र", "ल", "व", "श")]
    known = [(s + "न", "M2") for s in stems] + [(s + "त", "F3") for s in stems] + [("लड़का", "M1")]
    merged = [(s + "स" + e, "ex_noun") for s in stems[:6] for e in ("न", "त")] + [("कमन", "ex_noun"), ("लड़की", "ex_noun"), ("पढ़न", "ex_noun"), ("पढन", "ex_noun")]
    out = predicted_lexicon(spark.createDataFrame(known, "word string, paradigm string"), spark.createDataFrame(merged, "word string, paradigm_class string"), f"{tmp_path}/lists", folds=2, most=3)
    said = {r.word: r for r in out.predictions.collect()}
    assert set(said) == {s + "स" + e for s in stems[:6] for e in ("न", "त")} | {"पढन"} and said["पढन"].clash
    assert all(r.gender == ("M" if w.endswith("न") else "F") for w, r in said.items())
    sure = {w for w, r in said.items() if r.tier in ("high", "medium")}
    assert {(r.word, r.block) for r in out.lexicon.collect()} == {(w, 0) for w, _ in known} | {(w, 1) for w in sure}
    assert sinks.read_routes(spark, f"{tmp_path}/lists").count() == len(said)
    assert out.accuracy.count() == 2 and out.spread.first().mean > 0.9 and out.report.count() == 2 and out.endings.count() == 6
