import numpy as np

from rupaka.llm import op11_pq as op
from tests.llm.common import same


def brute(rows, least=0.9):
    fine = [i for i, (vid, v) in enumerate(rows) if vid is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    comp, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for dim in {len(rows[i][1]) for i in fine}:
        at = [i for i in fine if len(rows[i][1]) == dim]
        x = np.array([rows[i][1] for i in at], float)
        x /= np.abs(x).max(1)[:, None]
        x /= np.sqrt((x * x).sum(1))[:, None]
        s = x @ x.T >= least
        for k, i in enumerate(at):
            links[i] = int(s[k].sum()) - 1
            for j in np.flatnonzero(s[k]):
                a, b = find(i), find(at[j])
                comp[max(a, b)] = min(a, b)
    best = {}
    for i in range(len(rows)):
        if rows[i][0] is not None:
            best[find(i)] = min(best.get(find(i), rows[i][0]), rows[i][0])
    return sorted(((vid, links[i], best.get(find(i)), vid is None or vid == best[find(i)]) for i, (vid, _) in enumerate(rows)), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, "x") for i, v in rows], "vec_id long, embedding array<double>, node int, gid string")


def got(df):
    return sorted((tuple(r) for r in df.select("vec_id", "n_links", "component_id", "kept").collect()), key=repr)


def test_query(spark):
    same(op.op11_embedding_dedup(spark, "/root/testdata/sf0.01"), op.SQL, "/root/testdata/sf0.01")


def spread(rng, n, dim, groups, noise):
    """Random vectors, and groups of near copies of some of them: every degree of similarity."""
    x = list(rng.normal(size=(n, dim)))
    for size, far in zip(groups, noise):
        base = rng.normal(size=dim)
        x += [base + far * rng.normal(size=dim) * rng.random() for _ in range(size)]
    return x


def test_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(11)
    x = spread(rng, 400, 32, (300, 200, 100, 60), (0.05, 0.4, 0.6, 0.9))
    x += [x[0]] * 40 + [x[1] * 3, x[1] * 1e200, x[2] * 1e-200]
    rows = [(7 * i % 100_003, v) for i, v in enumerate(x)]
    rows += [(None, x[0]), (-5, None), (-6, []), (-7, [0.0] * 32), (-8, [float("nan")] * 32), (-9, [float("inf")] + [1.0] * 31), (-10, [None] + [1.0] * 31)]
    rows += [(-20, x[3][:8]), (-21, x[3][:8] * 2), (-22, [1.0]), (-23, [2.0]), (-24, [-1.0]), (-25, list(x[4]) + [0.0] * 9), (-26, list(x[4]) + [1e-3] * 9)]
    rows += [(-30, x[5]), (-30, x[5]), (-30, -x[5])]  # one id, several rows
    want = brute(rows)
    assert sum(n > 0 for _, n, *_ in want) > 400
    assert got(op.near_vectors(frame(spark, rows), reach=1.0)) == want
    for name, value in (("LIST", 16), ("ASKERS", 64), ("MEMBERS", 3), ("PAIRED", 5)):  # blocks everywhere
        monkeypatch.setattr(op, name, value)
    assert got(op.near_vectors(frame(spark, rows), reach=1.0)) == want


def test_recall(spark):
    """The default reach, on groups of all degrees of similarity among vectors without clusters."""
    rng = np.random.default_rng(12)
    rows = list(enumerate(spread(rng, 1500, 64, (20,) * 40, tuple(np.linspace(0.05, 0.8, 40)))))
    want, found = brute(rows), got(op.near_vectors(frame(spark, rows)))
    true, here = (sum(n for _, n, *_ in x) for x in (want, found))
    assert true > 5000 and all(a[1] <= b[1] for a, b in zip(found, want))
    assert here >= 0.99 * true, (here, true)


def test_empty(spark):
    assert got(op.near_vectors(frame(spark, []))) == []
    assert got(op.near_vectors(frame(spark, [(1, None), (None, None)]))) == [(1, 0, 1, True), (None, 0, None, True)]
