import math

import pytest

from rupaka.llm import op3_mixing as m
from tests.llm.common import same


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_against_sql(spark, folder):
    d = f"/root/testdata/{folder}"
    same(m.op3_mixing(spark, d), m.SQL, d)


def rows(spark, data, **how):
    df = spark.createDataFrame(data, "doc_id long, source string, text string, weight string, block string")
    return {r.doc_id: r for r in m.mix(df, **how).collect()}


def test_weights_budget_and_limit(spark):
    data = [(i, "a" if i < 900 else "b", "w " * 10, "x", "y") for i in range(1000)]
    out = rows(spark, data, evenness=1.0)
    mixed = {s: sum(r.n_copies * r.n_tokens for r in out.values() if r.source == s) for s in "ab"}
    assert abs(mixed["a"] - 6000) <= 10 and abs(mixed["b"] - 4000) <= 10  # b meets its limit of 4 passes before equal weights
    out = rows(spark, data, evenness=0.5, budget=0)
    assert min(r.n_copies for r in out.values()) == 1
    w = {r.source: r.weight for r in out.values()}
    plain, h = -(0.9 * math.log(0.9) + 0.1 * math.log(0.1)), -sum(x * math.log(x) for x in w.values())
    assert abs(h - (plain + 0.5 * (math.log(2) - plain))) < 1e-3


def test_edges(spark):
    out = rows(spark, [(1, None, None, "", ""), (2, None, "", "", ""), (3, "s", "one two", "", ""), (3, "s", "one two", "", ""), (None, "s", "x", "", "")])
    assert out[1].n_copies >= 1 and out[3].n_copies >= 1 and out[1].source == m.NO_SOURCE
    assert rows(spark, []) == {}


def test_more_sources_than_are_broadcast(spark, monkeypatch):
    data = [(i, None if i % 50 == 0 else "a" if i % 3 else f"s{i % 40}", None if i % 7 == 0 else "w " * (1 + i % 11), "x", "y") for i in range(2000)]
    whole = rows(spark, data, evenness=0.5)
    monkeypatch.setattr(m, "FEW_SOURCES", 3)
    assert rows(spark, data, evenness=0.5) == whole and len({r.source for r in whole.values()}) > 3


def test_a_source_without_tokens(spark):
    out = rows(spark, [(i, "empty" if i % 2 else "s", "" if i % 2 else "one two three", "", "") for i in range(400)])
    assert {r.n_copies for r in out.values() if r.source == "empty"} == {1} and {r.block for r in out.values() if r.source == "empty"} == {0}
    assert len(out) == 400
