"""Building a lexicon: merge two sources, resolve conflicts, map labels to classes, classify the rest by ending."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rupaka.functions import tables as t
from rupaka.functions.text import cases, last_char, normalized

UNSPECIFIC = "ex_noun"
#: Two classes between which the newer source decides without a note.
SWAPPED = ("रात", "घर")


def conflicts(old: DataFrame, new: DataFrame) -> DataFrame:
    """word, class_old, class_new: words that both lexicons (word, paradigm) have, with different classes."""
    both = old.select("word", F.col("paradigm").alias("class_old")).join(new.select("word", F.col("paradigm").alias("class_new")), "word")
    return both.filter("class_old != class_new")


def merged_right(old: DataFrame, new: DataFrame) -> DataFrame:
    """The union of two lexicons, in which the newer one counts."""
    both = old.select("word", F.col("paradigm").alias("a")).join(new.select("word", F.col("paradigm").alias("b")), "word", "full_outer")
    return both.select("word", F.coalesce("b", "a").alias("paradigm"))


def resolved(old: DataFrame, new: DataFrame, unspecific: str = UNSPECIFIC, swapped: tuple[str, str] = SWAPPED) -> DataFrame:
    """word, paradigm, logged, class_old, class_new over both lexicons.

    A class that only one has, or that both have, counts; a specific one beats the
    unspecific one; else the newer counts, and the conflict is logged unless it is between the two swapped classes.
    """
    a, b = F.col("class_old"), F.col("class_new")
    both = old.select("word", F.col("paradigm").alias("class_old")).join(new.select("word", F.col("paradigm").alias("class_new")), "word", "full_outer")
    paradigm = F.when(a.isNull(), b).when(b.isNull(), a).when(a == b, a).when(a == unspecific, b).when(b == unspecific, a).otherwise(b)
    differ = a.isNotNull() & b.isNotNull() & (a != b) & (a != unspecific) & (b != unspecific)
    pair = F.array_sort(F.array(a, b)) == F.array_sort(F.array(*map(F.lit, swapped)))
    return both.select("word", paradigm.alias("paradigm"), (F.coalesce(differ & ~pair, F.lit(False))).alias("logged"), "class_old", "class_new")


def conflict_log(resolution: DataFrame) -> DataFrame:
    return resolution.filter("logged").select("word", "class_old", "class_new")


def pattern_count(log: DataFrame, first: str, second: str) -> DataFrame:
    """n: conflicts between two classes, in either order."""
    return log.agg(F.count_if(F.array_sort(F.array("class_old", "class_new")) == F.array_sort(F.array(F.lit(first), F.lit(second)))).alias("n"))


def overlap(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row: n_old, n_new, n_both, only_old, only_new, n_conflicts, n_union."""
    both = old.select("word", F.col("paradigm").alias("a")).join(new.select("word", F.col("paradigm").alias("b")), "word", "full_outer")
    a, b = F.col("a").isNotNull(), F.col("b").isNotNull()
    of = {"n_old": a, "n_new": b, "n_both": a & b, "only_old": a & ~b, "only_new": b & ~a, "n_conflicts": a & b & (F.col("a") != F.col("b")), "n_union": a | b}
    return both.agg(*(F.count_if(c).alias(n) for n, c in of.items()))


def mapped_class(label: Column, fixes: dict | None = None, exemplars: dict | None = None) -> Column:
    """The formal class of a label, after repairing it: by its exemplar word, else UNKNOWN."""
    fixes = t.LABEL_FIXES if fixes is None else fixes
    fixed = label
    if fixes:
        fixed = F.coalesce(cases(label, fixes), label)
    return cases(fixed, {w: c for c, words in (exemplars or t.EXEMPLARS).items() for w in words.split()}, "UNKNOWN")


def classified(merged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The final lexicon (word, paradigm_class, confidence) and what has no class (word, label, mapped)."""
    m = merged.select("word", F.col("paradigm").alias("label"), mapped_class(F.col("paradigm")).alias("mapped"))
    skip = F.col("mapped").isin("UNKNOWN", "IRREG")
    return m.filter(~skip).select("word", F.col("mapped").alias("paradigm_class"), F.lit("certain").alias("confidence")), m.filter(skip)


def heuristic_class(word: Column) -> Column:
    """A class from a vowel ending; null for other endings."""
    return cases(last_char(word), t.HEURISTIC_CLASSES)


def expanded(final: DataFrame, merged: DataFrame, unspecific: str = UNSPECIFIC) -> DataFrame:
    """final, and with confidence ``heuristic`` the unspecific words of ``merged`` with a vowel ending that it lacks; of words with one normal form the least."""
    new = merged.filter(F.col("paradigm") == unspecific).select(normalized("word").alias("norm"), "word").withColumn("paradigm_class", heuristic_class(F.col("norm"))).filter("paradigm_class is not null")
    new = new.join(final.select(F.col("word").alias("norm")), "norm", "left_anti").groupBy("norm").agg(F.min_by("paradigm_class", "word").alias("paradigm_class"))
    return final.select("word", "paradigm_class", "confidence").union(new.select("norm", "paradigm_class", F.lit("heuristic")))


def final_chars(words: DataFrame, most: int = 20) -> DataFrame:
    """char, code, n: the most frequent last characters, with their code point in hexadecimal."""
    n = words.filter(F.length("word") > 0).groupBy(last_char("word").alias("char")).agg(F.count("*").alias("n"))
    return n.orderBy(F.desc("n"), "char").limit(most).select("char", F.lower(F.hex(F.ascii("char"))).alias("code"), "n")
