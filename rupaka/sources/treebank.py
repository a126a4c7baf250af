"""Treebank files: ten tab-separated columns a token, an empty line after each sentence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from rupaka.functions import tables as t
from rupaka.functions.text import SPACES, cases, feature_map, nfc, normalized, stripped


def treebank_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no, line of all ``.dat`` files below a folder, or of a single file with any name."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    single = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isFile()
    reader = spark.read if single else spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.dat")
    whole = reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\r\n|\n|\r")).alias("i", "line"))
    return whole.select("file", (F.col("i") + 1).alias("line_no"), "line")


def class_sequences(lines: DataFrame, lexicon: DataFrame, tag: str = "NN") -> DataFrame:
    """file, sent_id, line_no, paradigm: the noun classes of each sentence in order.

    A class comes from the lexicon, else from gender where a case is given, else it is UNK.
    """
    w = Window.partitionBy("file").orderBy("line_no")
    sent = F.sum(F.when(stripped("line") == "", 1).otherwise(0)).over(w)
    f = lines.withColumn("sent_id", sent).filter((stripped("line") != "") & ~F.col("line").startswith("#")).withColumn("f", F.split("line", "\t"))
    f = f.filter((F.size("f") >= 6) & (F.get("f", F.lit(4)) == tag))
    f = f.select("file", "sent_id", "line_no", normalized(stripped(F.get("f", F.lit(2)))).alias("norm"), feature_map(F.get("f", F.lit(5)), strict=False).alias("m"))
    by_case = F.when(F.col("m")["case"].isin("d", "o"), F.when(F.col("m")["gen"] == "m", "M2").when(F.col("m")["gen"] == "f", "F3"))
    found = f.join(lexicon.select("norm", F.col("paradigm").alias("known")), "norm", "left")
    return found.select("file", "sent_id", "line_no", F.coalesce("known", by_case, F.lit("UNK")).alias("paradigm"))


def _gold(lines: DataFrame, tags: tuple[str, ...]) -> DataFrame:
    f = lines.filter((stripped("line") != "") & ~stripped("line").startswith("#")).withColumn("f", F.filter(F.split("line", SPACES), lambda x: x != ""))
    return f.filter((F.size("f") >= 5) & F.get("f", F.lit(4)).isin(*tags)).select(
        "file", "line_no", F.get("f", F.lit(4)).alias("cpos"), nfc(F.get("f", F.lit(1))).alias("surface"), nfc(F.get("f", F.lit(2))).alias("lemma"),
        ((F.size("f") == 5) | F.get("f", F.lit(2)).isin("_", "")).alias("skipped"), feature_map(F.get("f", F.lit(5))).alias("m"),
    )


def noun_features(m: Column) -> dict[str, Column]:
    case = m["case"]
    return {
        "gender": cases(m["gen"], {"m": "M", "f": "F"}),
        "number": cases(m["num"], {"sg": "SG", "pl": "PL"}),
        "case": F.when(case == "d", "DIR").when(case.startswith("o"), "OBL"),
    }


def verb_features(m: Column) -> dict[str, Column]:
    tam = lambda field: cases(m["tam"], {k: v for k, (f, v) in t.TAM.items() if f == field})
    return {
        "aspect": tam("aspect"), "tense": tam("tense"), "mood": tam("mood"), "gender": cases(m["gen"], {"m": "M", "f": "F"}),
        "number": cases(m["num"], {"sg": "S", "pl": "P"}), "person": cases(m["pers"], {p + h: p for p in "123" for h in ("", "h")}),
    }


def gold_nouns(lines: DataFrame, tag: str = "NN") -> tuple[DataFrame, DataFrame]:
    """Gold tokens (file, line_no, surface, lemma, gender, number, case), and a row with the number of tokens skipped for want of a lemma."""
    g = _gold(lines, (tag,))
    f = noun_features(F.col("m"))
    return g.filter("not skipped").select("file", "line_no", "surface", "lemma", *(c.alias(k) for k, c in f.items())), g.agg(F.count_if("skipped").alias("skipped"))


def gold_verbs(lines: DataFrame, tags: tuple[str, ...] = ("VM", "VAUX")) -> tuple[DataFrame, DataFrame]:
    """Gold tokens (file, line_no, cpos, surface, lemma, aspect, tense, mood, gender, number, person), and the number skipped."""
    g = _gold(lines, tags)
    f = verb_features(F.col("m"))
    return g.filter("not skipped").select("file", "line_no", "cpos", "surface", "lemma", *(c.alias(k) for k, c in f.items())), g.agg(F.count_if("skipped").alias("skipped"))
