"""Every registered query against its SQL on DuckDB, as rows in any order."""

import duckdb
import pytest

from rupaka.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(rows):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf, duck, name):
    df = catalogue.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = plain(tuple(r) for r in df.select(*cols).collect())
    assert got
    if name in catalogue.ORACLES:
        rel = duck.sql(catalogue.ORACLES[name])
        assert sorted(rel.columns) == cols
        want = plain(rel.project(", ".join(f'"{c}"' for c in cols)).fetchall())
        wrong = next(((a, b) for a, b in zip(got, want) if a != b), None)
        assert len(got) == len(want) and wrong is None, (len(got), len(want), wrong)
