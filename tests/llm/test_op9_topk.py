import numpy as np
import pytest

from rupaka.llm import op9_topk as op9
from tests.llm.common import same


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.1"])
def test_against_sql(spark, folder):
    d = f"/root/testdata/{folder}"
    same(op9.op9_exact_topk(spark, d), op9.SQL, d)


def brute(rows, k=10):
    fine = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in fine:
        if q % 100 == 0:
            s = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in fine if i != q and len(w) == len(v))[:k]
            out += [(q, n, i, -x) for n, (x, i) in enumerate(s, 1)]
    return sorted(out)


def test_ties_nulls_dimensions_and_clusters(spark):
    r = np.random.default_rng(4)
    centres = r.normal(size=(6, 8)) * 3
    rows = [(i, (centres[i % 6] + r.normal(size=8) * 0.1).astype(np.float32).tolist()) for i in range(3000)]
    rows += [(i, [1.0] * 8) for i in range(3000, 6000)]
    rows += [(6000, None), (6100, [1.0, None] * 4), (6200, [float("nan")] * 8), (6300, [float("inf")] * 8), (6400, [1.0, 2.0]), (6500, [3.0, -1.0]), (6600, []), (None, [1.0] * 8), (6700, [0.0] * 8), (6800, [3e6] * 8), (6900, [-3e6] * 8)]
    df = spark.createDataFrame([(i, v, 1, 0.5) for i, v in rows], "vec_id long, embedding array<float>, cell int, far double")
    got = sorted(tuple(x) for x in op9.top_k(df, lambda i: i % 100 == 0).collect())
    assert got == brute(rows)


def test_empty_table(spark):
    assert op9.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), lambda i: i % 100 == 0).collect() == []
