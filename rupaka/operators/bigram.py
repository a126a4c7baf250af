"""A smoothed bigram model of noun classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

ALPHA = 0.1


def bigram_counts(sequences: DataFrame, partition: list[str], order: list[str], value: str, unknown: str | None = "UNK") -> DataFrame:
    """prev, curr, n: pairs of neighbours within a sequence; a pair with an unknown member is dropped, not bridged."""
    nxt = F.lead(value).over(Window.partitionBy(*partition).orderBy(*order))
    pairs = sequences.select(F.col(value).alias("prev"), nxt.alias("curr")).filter(F.col("prev").isNotNull() & F.col("curr").isNotNull())
    if unknown is not None:
        pairs = pairs.filter((F.col("prev") != unknown) & (F.col("curr") != unknown))
    return pairs.groupBy("prev", "curr").agg(F.count("*").alias("n"))


def vocabulary_size(counts: DataFrame) -> int:
    return counts.select(F.explode(F.array("prev", "curr")).alias("v")).agg(F.countDistinct("v")).first()[0]


def bigram_model(counts: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """prev, curr, n, p for every class after every class seen before another: (n + alpha) / (sum of n + alpha * classes)."""
    # the classes are a closed, small set, and the model has a row for each pair of them
    classes = sorted(r.v for r in counts.select(F.explode(F.array("prev", "curr")).alias("v")).distinct().collect())
    if not classes:
        return counts.withColumn("p", F.lit(0.0))
    rows = counts.groupBy("prev").agg(F.sum("n").alias("total"))
    grid = rows.select("prev", "total", F.lit(len(classes)).alias("v"), F.explode(F.array(*map(F.lit, classes))).alias("curr"))
    n = F.coalesce("n", F.lit(0))
    return grid.join(counts, ["prev", "curr"], "left").select("prev", "curr", n.alias("n"), ((n + alpha) / (F.col("total") + alpha * F.col("v"))).alias("p"))


def scores(counts: DataFrame, alpha: float = ALPHA) -> dict:
    """The model for scoring sentences: {prev: ({curr: p}, p of others)}. Its size is the square of the number of classes."""
    v = vocabulary_size(counts)
    out: dict = {}
    for r in counts.collect():
        out.setdefault(r.prev, {})[r.curr] = r.n
    return {prev: ({c: (n + alpha) / (sum(row.values()) + alpha * v) for c, n in row.items()}, alpha / (sum(row.values()) + alpha * v)) for prev, row in out.items()}


def sparse_model(counts: DataFrame, alpha: float = ALPHA, words: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The model as two tables whose size is that of what was seen: (prev, curr, part) and (prev, whole, p_other). A pair's probability is part / whole, p_other is that of whatever wasn't seen after prev.

    words: (prev, total), every word of a pair and how many pairs it begins (0: none), for callers who
    can count it without the pairs.
    """
    if words is None:
        ends = F.array(F.struct("prev", "n"), F.struct(F.col("curr").alias("prev"), F.lit(0).cast("long").alias("n")))
        words = counts.select(F.explode(ends).alias("w")).groupBy("w.prev").agg(F.sum("w.n").alias("total"))
    whole = F.col("total") + alpha * words.agg(F.count("total")).scalar()
    seen = counts.select("prev", "curr", (F.col("n") + alpha).alias("part"))
    return seen, words.filter("total > 0").select("prev", whole.alias("whole"), (alpha / whole).alias("p_other"))


def scored(pairs: DataFrame, model: tuple[DataFrame, DataFrame]) -> DataFrame:
    """pairs (prev, curr and other columns) with seen and p; 0 after a predecessor that the model doesn't have.

    Each distinct pair is looked up once, so a frequent predecessor costs a row for each word after it. The
    model's pairs stay where they were counted: only those asked for go on to their predecessors.
    """
    seen, others = model
    types = pairs.select("prev", "curr").filter("prev is not null and curr is not null").distinct()
    found = types.join(seen, ["prev", "curr"], "left").join(others, "prev", "left")
    found = found.select(F.col("prev").alias("_prev"), F.col("curr").alias("_curr"), F.col("part").isNotNull().alias("seen"), F.coalesce(F.col("part") / F.col("whole"), "p_other", F.lit(0.0)).alias("p"))
    joined = pairs.join(found, (F.col("prev") == F.col("_prev")) & (F.col("curr") == F.col("_curr")), "left").drop("_prev", "_curr")
    return joined.withColumn("seen", F.coalesce("seen", F.lit(False))).withColumn("p", F.coalesce("p", F.lit(0.0)))
