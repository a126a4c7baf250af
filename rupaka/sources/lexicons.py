"""Readers of lexicons. Files are read line by line with their line numbers, since the last of repeated entries counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from rupaka.functions.text import consonant_final, nfc, normalized, stripped


def numbered_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """file_ord, file, line_no (from 1), line of text files, in the order given. Files are taken whole: rule files and treebank files are small, and there may be many."""
    parts = []
    for k, p in enumerate(paths):
        whole = spark.read.text(p, wholetext=True).select(F.lit(k).alias("file_ord"), F.col("_metadata.file_name").alias("file"), F.posexplode(F.split("value", "\r\n|\n|\r")).alias("i", "line"))
        parts.append(whole.select("file_ord", "file", (F.col("i") + 1).alias("line_no"), "line"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def raw_entries(lines: DataFrame) -> DataFrame:
    """line_no, word, paradigm, pos of lexicon lines ``<word>,<class>,<pos>``; slashes in front are dropped, lines with other than three fields too."""
    line = F.regexp_replace(stripped("line"), "^/+", "")
    f = F.transform(F.split(line, ","), lambda x: F.regexp_replace(stripped(x), "^<+|>+$", ""))
    return lines.filter(line != "").withColumn("f", f).filter(F.size("f") == 3).select("line_no", F.get("f", F.lit(0)).alias("word"), F.get("f", F.lit(1)).alias("paradigm"), F.get("f", F.lit(2)).alias("pos"))


def latest(df: DataFrame, key: str, order: Column | str) -> DataFrame:
    """Of the rows of each key the last in order."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, *(F.col(f"r.{c}").alias(c) for c in rest))


def parsed_lexicon(lines: DataFrame) -> DataFrame:
    """word, paradigm: the nouns of a raw lexicon, the last entry of each word."""
    return latest(raw_entries(lines).filter((F.col("pos") == "noun") & (F.col("word") != "")), "word", "line_no").select("word", "paradigm")


def noun_entries(lines: DataFrame) -> DataFrame:
    """line_no, word, paradigm of all noun entries, repeated and empty words too."""
    return raw_entries(lines).filter("pos = 'noun'").select("line_no", "word", "paradigm")


def class_histogram(entries: DataFrame) -> DataFrame:
    """paradigm, n: entries of each class, the most frequent first."""
    return entries.groupBy("paradigm").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "paradigm")


def read_tsv(spark: SparkSession, path: str, comment: str | None = None) -> DataFrame:
    how = {"sep": "\t", "header": True, "quote": "", "comment": comment} if comment else {"sep": "\t", "header": True, "quote": ""}
    return spark.read.options(**how).csv(path)


def file_order() -> Column:
    """The order of rows of a scan as their files have it: file, split of the file, place in the split. The rows must come straight from the scan."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))


def ordered_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """file, line_no (from 1), n (the line's number over all files, in order of their paths), line of text files of any size.

    Files are read in splits. The lines of every split are counted, and prefix sums of the
    counts say with which number a split begins; no line is shuffled for its number.
    """
    raw = spark.read.text(list(paths)).select(file_order().alias("at"), F.col("value").alias("line")).select("at.*", "line")
    splits = raw.groupBy("file", "block").agg(F.min("row").alias("first"), F.count("*").alias("lines"))
    so_far = lambda w: F.coalesce(F.sum("lines").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a row for each split
    begins = splits.select(F.col("file").alias("_file"), F.col("block").alias("_block"), "first", so_far(Window.partitionBy("file").orderBy("block")).alias("in_file"), so_far(Window.orderBy("file", "block")).alias("in_all"))
    at = F.col("row") - F.col("first") + 1
    # few and small, so they go to the lines; without the hint all lines are shuffled before Spark knows that
    joined = raw.join(F.broadcast(begins), (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block")))
    return joined.select("file", (F.col("in_file") + at).alias("line_no"), (F.col("in_all") + at).alias("n"), "line")


def keyed_lexicon(rows: DataFrame, order: str | Column | None = None) -> DataFrame:
    """norm, display, paradigm, confidence from rows word, paradigm_class[, confidence]; of words with one normal form the last in ``order`` counts.

    Without ``order`` rows count as they come. A missing confidence column means that all are certain.
    """
    confidence = F.col("confidence") if "confidence" in rows.columns else F.lit("certain")
    at = F.monotonically_increasing_id() if order is None else F.col(order) if isinstance(order, str) else order
    df = rows.select(normalized("word").alias("norm"), nfc("word").alias("display"), F.col("paradigm_class").alias("paradigm"), confidence.alias("confidence"), at.alias("at"))
    return latest(df, "norm", "at").select("norm", "display", "paradigm", "confidence")


def load_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """keyed_lexicon() of a file or folder; the last of repeated words is the one furthest down, in the last file by its path."""
    return keyed_lexicon(read_tsv(spark, path), file_order())


def training_words(rows: DataFrame) -> DataFrame:
    """word, label (M or F): consonant-final words of the two consonant-final classes."""
    label = F.when(F.col("paradigm_class") == "M2", "M").when(F.col("paradigm_class") == "F3", "F")
    return rows.select(normalized("word").alias("word"), label.alias("label")).filter(F.col("label").isNotNull() & consonant_final("word"))


def excluded_words(merged: DataFrame, classified: DataFrame) -> DataFrame:
    """word, originals, clash: consonant-final words of class ex_noun that aren't classified yet, one row for each normal form."""
    new = merged.filter("paradigm_class = 'ex_noun'").select("word", normalized("word").alias("norm"))
    known = classified.select(normalized("word").alias("norm"))
    grouped = new.join(known, "norm", "left_anti").filter(consonant_final("norm")).groupBy("norm").agg(F.sort_array(F.collect_set("word")).alias("originals"))
    return grouped.select(F.col("norm").alias("word"), "originals", (F.size("originals") > 1).alias("clash"))
