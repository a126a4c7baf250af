"""State that is carried along ordered rows, over sequences of any length.

A row's step is a map from states to states, an array in which entry s is the state that
follows s. Maps combine, so a sequence is cut into segments: each segment's maps are
combined into one, the combined maps give the state in which each segment begins (in
segments of segments, ``levels`` deep), and then all segments run side by side. With
``levels`` L a sequence may have SEGMENT ** (L + 1) rows, and no task holds more than
SEGMENT of them at once; with 0 a sequence is one segment, which suits sentences.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

SEGMENT = 4096


def run(maps: pa.Array, starts: pa.Array) -> pa.Array:
    """The state before each step."""
    out = []
    for steps, state in zip(maps.to_pylist(), starts.to_pylist()):
        states = []
        for step in steps:
            states.append(state)
            state = step[state]
        out.append(states)
    return pa.array(out, pa.list_(pa.int32()))


run.__annotations__ = {"maps": pa.Array, "starts": pa.Array, "return": pa.Array}


def combined(items: Column, step: str, size: int) -> Column:
    """One map for all steps, in their order."""
    same = F.sequence(F.lit(0), F.lit(size - 1))
    return F.aggregate(items, same, lambda acc, x: F.transform(acc, lambda s: F.get(x[step], s)))


def counted(steps: Column, size: int, start: int = 0) -> Column:
    """Of a sequence that is in one row: state, the state at the end, and counts, how many of its steps each of ``size`` states stands before.

    steps: an array of maps; null keeps the state. Nothing is shuffled or left in memory but the state and the counts.
    """
    begin = F.struct(F.lit(start).alias("state"), F.array_repeat(F.lit(0).cast("long"), size).alias("counts"))

    def after(acc: Column, step: Column) -> Column:
        met = F.transform(acc.counts, lambda n, s: n + F.when(s == acc.state, 1).otherwise(0))
        return F.struct(F.coalesce(F.get(step, acc.state), acc.state).alias("state"), met.alias("counts"))

    return F.aggregate(steps, begin, after)


def scanned(rows: DataFrame, keys: list[str], at: str, step: str, size: int, start: int = 0, levels: int = 2, state: str = "state") -> DataFrame:
    """rows and ``state``, the state before each row.

    keys: the columns of a sequence (nulls are values); at: the row's place in it, a number from 0,
    unique and without large gaps; step: array<int> of ``size`` states; start: the state before the first row.
    """
    others = [c for c in rows.columns if c not in keys]
    listed = lambda df, by, cols: df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(at, *(c for c in cols if c != at)))).alias("_items"))
    if levels == 0:
        parts = listed(rows, keys, others).withColumn("_entry", F.lit(start))
    else:
        part = f"_seg{levels}"
        # never null, so that no filter tells the two uses of the listed rows apart: they are shuffled once
        seg = F.coalesce((F.col(at) / SEGMENT).cast("long"), F.lit(0)).alias(part)
        whole = listed(rows.select("*", seg), [*keys, part], others)
        maps = whole.select(*keys, part, combined(F.col("_items"), step, size).alias("_map"))
        entry = scanned(maps, keys, part, "_map", size, start, levels - 1, "_entry")
        entry = entry.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col(part).alias("_own"), "_entry")
        same = (F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys))
        parts = whole.join(entry, reduce(lambda a, b: a & b, same, F.col(part) == F.col("_own")))
    states = F.arrow_udf(run, "array<int>")(F.transform("_items", lambda x: x[step]), F.col("_entry"))
    parts = parts.select(*keys, "_items", states.alias("_states"))
    each = F.explode(F.arrays_zip("_items", "_states")).alias("_x")
    return parts.select(*keys, each).select(*keys, *(F.col(f"_x._items.{c}").alias(c) for c in others), F.col("_x._states").alias(state)).select(*rows.columns, state)
