"""What the driver does with a query and its SQL: the same rows, whatever their order."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def rows_of(rows, columns):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows), key=repr), list(columns)


def same(df, sql, sf):
    cols = sorted(df.columns)
    rel = duck(sf).sql(sql)
    assert sorted(rel.columns) == cols
    got, want = [tuple(r) for r in df.select(*cols).collect()], rel.project(", ".join(cols)).fetchall()
    a, b = rows_of(got, cols), rows_of(want, cols)
    assert len(a[0]) == len(b[0])
    assert a == b, next((x, y) for x, y in zip(a[0], b[0]) if x != y)
