"""Writers of lexicons, error lists and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from rupaka.functions.text import percent


def write_tsv(df: DataFrame, path: str, *order: str, mode: str = "overwrite") -> None:
    """A tab-separated table with a header, sorted over all of it (part files hold consecutive ranges)."""
    (df.orderBy(*order) if order else df).write.mode(mode).options(sep="\t", header=True, emptyValue="", quote="").csv(path)


def write_lines(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    lines.write.mode(mode).text(path)


def routed(predictions: DataFrame) -> DataFrame:
    """word, paradigm_class, confidence, probability, route of predictions: predicted (high and medium), review (low) or abstain (the rest)."""
    route = F.when(F.col("tier").isin("high", "medium"), "predicted").when(F.col("tier") == "low", "review").otherwise("abstain")
    return predictions.select("word", "paradigm_class", F.concat(F.lit("predicted_"), "tier").alias("confidence"), F.format_string("%.4f", "probability").alias("probability"), route.alias("route"))


def write_tiers(predictions: DataFrame, folder: str) -> None:
    """A table for each route of routed(), sorted by word. The predictions are evaluated once for each: write them down first where that is dear."""
    for name in ("predicted", "review", "abstain"):
        write_tsv(routed(predictions).filter(F.col("route") == name).drop("route"), f"{folder}/{name}", "word")


def complete_lexicon(existing: DataFrame, predicted: DataFrame) -> DataFrame:
    """word, paradigm_class, confidence, probability, block: the existing entries (block 0), then predicted ones for words not among them (block 1)."""
    old = existing.select("word", "paradigm_class", "confidence", F.lit("").alias("probability"), F.lit(0).alias("block"))
    new = predicted.join(existing.select("word"), "word", "left_anti")
    return old.unionByName(new.select("word", "paradigm_class", "confidence", F.format_string("%.4f", "probability").alias("probability"), F.lit(1).alias("block")))


#: The error lists' names of what gold tokens state.
GOLD_NOUN = {"lemma": "gold_lemma", "gender": "gold_gender", "number": "gold_number", "case": "gold_case"}
GOLD_VERB = {"lemma": "gold_lemma", "aspect": "gold_asp", "tense": "gold_ten", "mood": "gold_mood", "gender": "gold_gen", "number": "gold_num", "person": "gold_per"}


def _error_rows(errors: DataFrame, gold: dict[str, str], *others: str) -> DataFrame:
    lemmas = F.array_join(F.transform("analyses", lambda x: x.lemma), "|")
    errors = errors.withColumnsRenamed({k: v for k, v in gold.items() if v not in errors.columns})
    return errors.select("surface", *gold.values(), *others, "failure_type", F.size("analyses").alias("n_predicted"), lemmas.alias("pred_lemmas"), "file", "line_no")


def noun_error_rows(errors: DataFrame) -> DataFrame:
    """The flat columns of a noun error list, from evaluated nouns that failed."""
    return _error_rows(errors, GOLD_NOUN, "paradigm", "confidence")


def verb_error_rows(errors: DataFrame) -> DataFrame:
    """The flat columns of a verb error list, from evaluated verbs that failed."""
    return _error_rows(errors, GOLD_VERB, "vtype", "confidence", "cpos")


def error_sample(errors: DataFrame, label: Column) -> DataFrame:
    """value: readable lines, an error each with its first three predictions."""
    first = F.array_join(F.transform(F.slice("analyses", 1, 3), lambda x: x.lemma), ", ")
    lemma = "gold_lemma" if "gold_lemma" in errors.columns else "lemma"
    said = F.when(first == "", "-").otherwise(first)
    return errors.select(F.format_string("[%s] %s  gold %s (%s)  predicted %s  %s:%s", "failure_type", "surface", lemma, label, said, "file", F.col("line_no").cast("string")).alias("value"))


def metric_report(metrics: DataFrame) -> DataFrame:
    """Shares beside the counts of dim, value, total, covered, lemma_ok, full_ok."""
    return metrics.select("*", percent("covered", "total").alias("coverage"), percent("lemma_ok", "total").alias("lemma_share"), percent("full_ok", "total").alias("full_share"))


def reformatted_rules(lines: DataFrame) -> DataFrame:
    """file, line_no, value: learned rules, several lines each, as one line ``ASID [(-1 TAG) AND (+2 TAG)] THEN TAG VECTOR [n ...]``.

    lines: file, line_no, line. ASID is the file's name without folders and ending; a context
    word ``T_minus_1`` gives the sign and the number. ``(DEFAULT)`` lines are rules of their
    own; what stands before the first rule of a file, and ELSE lines, are left out.
    """
    w = F.filter(F.split(F.col("line"), r"[\s]+"), lambda x: x != "")
    word, tag = F.get(w, F.lit(0)), F.get(w, F.lit(3))
    context = F.split(F.get(w, F.lit(1)), "_")
    sign = F.when(F.get(context, F.lit(1)) == "plus", "+").when(F.get(context, F.lit(1)) == "minus", "-").otherwise(F.get(context, F.lit(1)))
    read = lines.select("file", "line_no", word.alias("word"), tag.alias("tag"), F.concat(F.lit("("), sign, F.coalesce(F.get(context, F.lit(2)), F.lit("")), F.lit(" "), tag, F.lit(")")).alias("part"), F.regexp_extract("line", r"(\[[^\]]*\])", 1).alias("vector"))
    # files are small and many: a rule is found within its file
    begun = F.sum(F.when(F.col("word").isin("IF", "(DEFAULT)"), 1).otherwise(0)).over(Window.partitionBy("file").orderBy("line_no"))
    rules = read.withColumn("rule", begun).filter((F.col("rule") > 0) & F.col("word").isin("IF", "AND", "THEN", "(DEFAULT)"))
    lines_of = F.array_sort(F.collect_list(F.struct("line_no", "word", "tag", "part", "vector")))
    one = rules.groupBy("file", "rule").agg(lines_of.alias("x")).withColumn("first", F.get("x", F.lit(0))).withColumn("then", F.try_element_at(F.filter("x", lambda l: l.word.isin("THEN", "(DEFAULT)")), F.lit(1)))
    when = F.array_join(F.transform(F.filter("x", lambda l: l.word.isin("IF", "AND")), lambda l: l.part), " AND ")
    when = F.when(F.col("first.word") == "IF", when).otherwise("(DEFAULT)")
    asid = F.regexp_extract("file", r"([0-9A-Za-z]*)\.[^./]*$", 1)
    value = F.concat(asid, F.lit(" ["), when, F.lit("] THEN "), F.col("then.tag"), F.lit(" VECTOR "), F.col("then.vector"))
    return one.filter("then is not null").select("file", F.col("first.line_no").alias("line_no"), value.alias("value"))


def replaced(spark: SparkSession, folder: str, write) -> None:
    """Calls write(path) with a path beside ``folder``, which takes the folder's place when all is written; if it fails, the old folder stays."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    new, old = (f"{folder.rstrip('/')}-{kind}-{uuid.uuid4().hex}" for kind in ("new", "old"))
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        write(new)
        if fs.exists(path(folder)):
            fs.rename(path(folder), path(old))
        if not fs.rename(path(new), path(folder)):
            raise OSError(f"{new} can't be renamed to {folder}")
    finally:
        fs.delete(path(new), True)
        fs.delete(path(old), True)


def write_routes(predictions: DataFrame, folder: str) -> None:
    """The three routes of routed() as one table parted by route, in one job, each sorted by word over its part files. What is in the folder is replaced when the job has ended."""
    rows = routed(predictions).repartitionByRange("route", "word").sortWithinPartitions("route", "word")
    how = {"sep": "\t", "header": True, "emptyValue": "", "quote": ""}
    replaced(predictions.sparkSession, folder, lambda path: rows.write.partitionBy("route").options(**how).csv(path))


def read_routes(spark: SparkSession, folder: str) -> DataFrame:
    """What write_routes() wrote."""
    schema = "word string, paradigm_class string, confidence string, probability string, route string"
    return spark.read.options(sep="\t", header=True, quote="").schema(schema).csv(folder)
