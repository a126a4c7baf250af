"""Dictionaries without a cap and without the driver: dense ids of values, and rows of ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from rupaka.functions.text import ngrams, reversed_graphemes
from rupaka.sources.shared import new_path


def numbered(df: DataFrame, *order: str, name: str = "id") -> DataFrame:
    """df and ``name``, each row's place (from 0) in the order of some columns.

    The rows are written to the shared folder in ranges; the rows of every file are counted, and
    prefix sums of the counts say where a file begins. No task sees more than a range.
    """
    spark = df.sparkSession
    path = new_path(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(n, *order).sortWithinPartitions(*order).write.parquet(path)
    rows = spark.read.schema(df.schema).parquet(path).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    files = rows.groupBy(F.col("_file").alias("_own")).agg(F.count("*").alias("_n"))
    # a row for each file
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_own").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = files.select("_own", before.alias("_begin"))
    return rows.join(F.broadcast(begins), F.col("_file") == F.col("_own")).select(*df.columns, (F.col("_begin") + F.col("_row")).alias(name))


def gram_rows(words: DataFrame, low: int = 1, high: int = 4) -> DataFrame:
    """word, gram for each distinct n-gram of each distinct reversed word of (word)."""
    w = words.select("word").filter("word is not null").distinct()
    return w.select("word", F.explode(F.array_distinct(ngrams(reversed_graphemes("word"), low, high))).alias("gram"))


def dictionary(rows: DataFrame, value: str, least: int = 1) -> DataFrame:
    """value, n, id: the values in ``least`` rows or more, in how many they are, and dense ids in order of the values. rows: one for each value of each item."""
    return numbered(rows.groupBy(value).agg(F.count("*").alias("n")).filter(F.col("n") >= least), value)


def encoded(rows: DataFrame, item: str, value: str, known: DataFrame) -> DataFrame:
    """item, ids: the sorted ids of an item's values that the dictionary has; an item without any has an empty array. A frequent value's rows are split by Spark, since the join is two plain shuffles."""
    ids = rows.select(item, F.col(value).alias("_value")).join(known.select(F.col(value).alias("_known"), "id"), F.col("_value") == F.col("_known"), "left")
    return ids.groupBy(item).agg(F.sort_array(F.collect_list("id")).alias("ids"))
