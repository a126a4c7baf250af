"""Rule tables: literals as DataFrames, and readers of rule files."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from rupaka.functions import tables as t
from rupaka.functions.text import stripped
from rupaka.sources.lexicons import latest, numbered_lines


def literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table as a local relation of the plan: no task runs to make it, and its size is known to the planner."""
    kind = StructType.fromDDL(schema)
    fields = to_arrow_schema(kind)
    columns = list(zip(*rows)) if rows else [[]] * len(fields)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)], schema=fields), kind)


def noun_rules(spark: SparkSession, paradigms: dict | None = None) -> DataFrame:
    """class_ord, rule_ord, paradigm, strip, add, gender, number, case."""
    rows = [(i, j, p, *r) for i, (p, rules) in enumerate((paradigms or t.NOUN_PARADIGMS).items()) for j, r in enumerate(rules)]
    return literal(spark, rows, "class_ord int, rule_ord int, paradigm string, strip string, add string, gender string, number string, case string")


def verb_rules(spark: SparkSession, rules: list[tuple[str, str]] | None = None, paradigm: str = "verb") -> DataFrame:
    """rule_ord, paradigm, suffix, add_back."""
    return literal(spark, [(k, paradigm, *r) for k, r in enumerate(rules or t.VERB_RULES, 1)], "rule_ord int, paradigm string, suffix string, add_back string")


def irregular_verbs(spark: SparkSession, forms: dict | None = None) -> DataFrame:
    """surface, lemma."""
    return literal(spark, [(s, lemma) for lemma, forms in (forms or t.IRREGULAR).items() for s in forms.split()], "surface string, lemma string")


def stem_flags(spark: SparkSession, flags: list[tuple[str, str]] | None = None) -> DataFrame:
    """morpheme, flag, file_ord."""
    return literal(spark, [(m, f, k) for k, (m, f) in enumerate(t.STEM_FLAGS if flags is None else flags)], "morpheme string, flag string, file_ord int")


def auxiliaries(spark: SparkSession, roots: str | None = None) -> DataFrame:
    """root."""
    return literal(spark, [(r,) for r in (t.AUXILIARIES if roots is None else roots).split()], "root string")


def term_sets(spark: SparkSession) -> DataFrame:
    """kind, term, gender, number, tag of the closed word classes."""
    rows = [(k, w, None, n, None) for k, words, n in (("clitic", t.CLITICS, None), ("postposition", t.POSTPOSITIONS, None), ("oblique", t.OBLIQUE_POSTPOSITIONS, None), ("quantifier", t.SINGULAR_QUANTIFIERS, "SG"), ("quantifier", t.PLURAL_QUANTIFIERS, "PL")) for w in words.split()]
    rows += [("genitive", w, g, n, None) for w, (g, n) in t.GENITIVES.items()] + [("negation", w, None, None, tag) for w, tag in t.NEGATIONS.items()]
    return literal(spark, rows, "kind string, term string, gender string, number string, tag string")


def _content(lines: DataFrame) -> DataFrame:
    return lines.withColumn("line", stripped("line")).filter((F.col("line") != "") & ~F.col("line").startswith("//"))


def _fields(lines: DataFrame, sep: str = ",") -> DataFrame:
    return _content(lines).withColumn("f", F.transform(F.split("line", sep), stripped))


def load_irregular(lines: DataFrame) -> DataFrame:
    """surface, lemma of lines ``surface, lemma``; the last of repeated forms counts."""
    f = _fields(lines).filter(F.size("f") >= 2)
    return latest(f.select(F.get("f", F.lit(0)).alias("surface"), F.get("f", F.lit(1)).alias("lemma"), "line_no"), "surface", "line_no").select("surface", "lemma")


def load_suffix_rules(lines: DataFrame, paradigms: tuple[str, ...] = ("verb", "copula")) -> DataFrame:
    """rule_ord, paradigm, suffix, add_back of lines ``paradigm, suffix, add_back, ...``, longest suffix first, then in file order.

    Rules of other paradigms, without a suffix, or with an add-back that is no ending are left out; of repeated rules the first counts.
    """
    f = _fields(lines).filter(F.size("f") >= 3).select(F.get("f", F.lit(0)).alias("paradigm"), F.get("f", F.lit(1)).alias("suffix"), F.get("f", F.lit(2)).alias("add_back"), "file_ord", "line_no")
    good = f.filter(F.col("paradigm").isin(*paradigms) & ~F.col("add_back").isin("ै", "ो") & (F.col("suffix") != "") & (F.lower("add_back") != "nil"))
    first = good.groupBy("paradigm", "suffix", "add_back").agg(F.min(F.struct("file_ord", "line_no")).alias("seen"))
    # a rule table is small enough for one order over all of it
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc(F.length("suffix")), "seen")
    return first.select(F.row_number().over(order).alias("rule_ord"), "paradigm", "suffix", "add_back")


def load_suffix_analysis(lines: DataFrame, paradigms: tuple[str, ...] = ("verb", "copula")) -> DataFrame:
    """morpheme, readings (array of maps, in file order) of lines ``paradigm, morpheme, K:V, ...``."""
    f = _fields(lines).filter((F.size("f") >= 3) & F.get("f", F.lit(0)).isin(*paradigms))
    pairs = F.filter(F.transform(F.slice("f", 3, F.size("f")), lambda x: F.split(x, ":")), lambda x: F.size(x) == 2)
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i - 1, F.lit(0))), lambda q: stripped(F.get(q, F.lit(0))) == stripped(F.get(p, F.lit(0)))))
    feats = F.map_from_entries(F.transform(last, lambda p: F.struct(stripped(F.get(p, F.lit(0))).alias("k"), stripped(F.get(p, F.lit(1))).alias("v"))))
    f = f.select(F.get("f", F.lit(1)).alias("morpheme"), feats.alias("feats"), "line_no").filter(F.size("feats") > 0)
    return f.groupBy("morpheme").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", F.map_entries("feats").alias("e")))), lambda x: F.map_from_entries(x.e)).alias("readings"))


def load_aux_verbs(lines: DataFrame) -> DataFrame:
    """root: the distinct lines."""
    return _content(lines).select(F.col("line").alias("root")).distinct()


def load_flag_map(lines: DataFrame, section: str = "#verb") -> DataFrame:
    """morpheme, flag, file_ord (the line) of one section of lines ``morpheme TAB flag``; the last of repeated morphemes counts, in the place of the first."""
    w = Window.partitionBy("file").orderBy("line_no")
    marked = _content(lines).withColumn("section", F.last(F.when(F.col("line").startswith("#"), F.col("line")), ignorenulls=True).over(w))
    f = marked.filter((F.col("section") == section) & ~F.col("line").startswith("#")).withColumn("f", F.split("line", "\t")).filter(F.size("f") == 2)
    f = f.select(stripped(F.get("f", F.lit(0))).alias("morpheme"), stripped(F.get("f", F.lit(1))).alias("flag"), "line_no")
    return f.groupBy("morpheme").agg(F.max_by("flag", "line_no").alias("flag"), F.min("line_no").alias("file_ord"))


def read_lines(spark: SparkSession, *paths: str) -> DataFrame:
    return numbered_lines(spark, *paths)
