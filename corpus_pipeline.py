"""A corpus pipeline of five stages, each one of the operators in rupaka.llm.

A stage takes (spark, docs, sf_dir) and returns a table with the columns of
``documents``; the last returns piece ids. Every stage's result is written as
Parquet and read again. Tables without rows pass through; null texts go in the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rupaka.llm import op2_minhash, op3_mixing, op4_language, op5_pieces, op6_pii
from rupaka.llm.common import Bitmap, table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with letters, however close their languages are; ``lang`` becomes the predicted one."""
    known = docs.filter(~op4_language.held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    found = op4_language.predict(docs, op4_language.fit(known), keep=("text", "source", "n_chars"))
    kept = found.filter(F.col("lang_pred") != op4_language.NONE)
    return kept.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near duplicates (five words, similarity 0.8).

    Rows without an id are all kept. Of the rows that repeat one id and text one is kept,
    the smallest by its other columns. An id with several texts isn't one document: it
    keeps one row for each of them, whatever its class.

    Only rows whose id may go (by a bitmap) are shuffled; all others pass where they are.
    """
    found = op2_minhash.near_duplicates(docs).filter("doc_id is not null")
    ids = found.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("kept").alias("kept"))
    going = written(ids.filter("n > 1 or not kept").select(F.col("doc_id").alias("id"), (F.col("n") > 1).alias("repeated"), "kept"))
    marked = Bitmap(going, "id").marked(docs.select(*COLUMNS), "doc_id")
    doubtful = marked.filter("marked").select(*COLUMNS)
    out = marked.filter("not marked").select(*COLUMNS).union(doubtful.join(going, F.col("doc_id") == F.col("id"), "left_anti"))
    if going.filter("repeated").isEmpty():
        return out
    rows = doubtful.join(going.filter("repeated"), F.col("doc_id") == F.col("id"))
    first = rows.groupBy("doc_id", "text").agg(F.min(F.struct("lang", "source", "n_chars")).alias("r"), F.max("kept").alias("kept"))
    texts = first.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias("several"))
    kept = first.join(texts, F.col("doc_id") == F.col("several"), "left").filter("kept or several is not null")
    return out.union(kept.select("doc_id", "text", "r.lang", "r.source", "r.n_chars").select(*COLUMNS))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    found = op6_pii.find_pii(docs, keep=("lang", "source"))
    clean = found.withColumn("text", op6_pii.redacted(F.col("text"), F.col("spans")))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix has it: the smallest budget under which every source stays whole, so none is lost and small sources repeat."""
    given = docs.withColumn("given", F.col("source"))  # mix() names the sources of rows without one
    mixed = op3_mixing.mix(given, evenness=0.25, budget=0, keep=("text", "lang", "given", "n_chars"))
    each = mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), "n_copies").cast("int"))))
    return each.withColumn("source", F.col("given")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_pieces, lossless: sampled piece ids of every row and whether they decode to its text. The row key is doc_id, so the mix's copies of a document have the same pieces."""
    out = op5_pieces.round_trip(docs)
    return out.select("doc_id", "ids", F.size("ids").cast("long").alias("n_pieces"), F.coalesce("lossless", F.lit(True)).alias("lossless"))


STAGES = [("language_id", identify), ("near_dedup", deduplicate), ("pii", redact), ("mixing", mix), ("pieces", encode)]

#: Language scores, MinHash candidates and sampled pieces are beyond SQL; the tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of all stages applied to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    *stages, (_, last) = STAGES
    for _, stage in stages:
        docs = written(stage(spark, docs, sf_dir))
    return last(spark, docs, sf_dir)
