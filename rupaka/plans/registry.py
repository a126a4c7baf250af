"""Where queries register, and what they are written with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rupaka.sources import rules

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def values(name: str, columns: str, rows: list) -> str:
    """A literal table of a WITH clause."""
    one = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float, bool)) else "'" + v.replace("'", "''") + "'"
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + ")"


def frame(spark: SparkSession, columns: str, rows: list) -> DataFrame:
    return rules.literal(spark, rows, columns)
