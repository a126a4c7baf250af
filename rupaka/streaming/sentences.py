"""Disambiguation over a stream. Sentences are independent, so a stream needs no state: every micro-batch is a table of sentences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from rupaka.operators.disambiguate import disambiguate


def sentence_stream(spark: SparkSession, folder: str) -> DataFrame:
    """sent_id, text: the lines of text files as they arrive; an id is a hash of the file, the text and its place in the file."""
    lines = spark.readStream.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\r\n|\n")).alias("line", "text"))
    return lines.filter(F.trim("text") != "").select(F.xxhash64("file", "line", "text").alias("sent_id"), "text")


def start(stream: DataFrame, lexicon: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, **how) -> StreamingQuery:
    """Starts a query that gives each micro-batch's results to write(results, batch_id); how: see disambiguate()."""

    def batch(df: DataFrame, batch_id: int) -> None:
        write(disambiguate(df, lexicon, **how), batch_id)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
