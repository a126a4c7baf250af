"""Noun analysis: every (lemma, features) that suffix rules and a lexicon allow for a surface form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rupaka.functions import tables as t
from rupaka.functions.text import col, endings, normalized, restored
from rupaka.sources.rules import noun_rules

def longest(rules: DataFrame, suffix: str) -> Column:
    """The length of the rules' longest suffix, as a subquery of the plan: nothing runs before the query does."""
    return rules.agg(F.coalesce(F.max(F.length(suffix)), F.lit(0))).scalar()


def suffix_matches(words: DataFrame, rules: DataFrame, word: str, suffix: str, shortest: int = 0, most: int | None = None) -> DataFrame:
    """words x rules where the word ends in the rule's suffix, as an equi-join on the word's endings, of ``most`` characters at most where that is known.

    Small rule tables are broadcast by the planner, by their size.
    """
    table = rules.select(F.col(suffix).alias("_suffix"), "*")
    sized = words.withColumn("_most", longest(rules, suffix) if most is None else F.lit(most))
    exploded = sized.withColumn("_suffix", F.explode(endings(word, F.col("_most"), shortest))).drop("_most")
    return exploded.join(table, "_suffix").drop("_suffix")


def analyze_nouns(words: DataFrame, lexicon: DataFrame, rules: DataFrame | None = None, word: str = "word") -> DataFrame:
    """surface, ord, lemma, gender, number, case, paradigm, confidence: the analyses of each distinct word, in rule order (ord from 1).

    lexicon: norm, display, paradigm, confidence. Of analyses that agree in lemma,
    gender, number and case the first counts. Null words have none.
    """
    most = max(len(r[0]) for rs in t.NOUN_PARADIGMS.values() for r in rs) if rules is None else None
    rules = noun_rules(words.sparkSession) if rules is None else rules
    w = words.select(col(word).alias("surface")).distinct().withColumn("_norm", normalized("surface"))
    hits = suffix_matches(w, rules, "_norm", "strip", most=most).withColumn("norm", restored("_norm", "strip", "add"))
    found = hits.join(lexicon.select("norm", "paradigm", F.col("display").alias("lemma"), "confidence"), ["norm", "paradigm"])
    key = ["surface", "lemma", "gender", "number", "case"]
    first = found.groupBy(*key).agg(F.min(F.struct("class_ord", "rule_ord", "paradigm", "confidence")).alias("r"))
    # the readings of one word are few; their order is an array's
    rows = first.groupBy("surface").agg(F.array_sort(F.collect_list(F.struct("r.class_ord", "r.rule_ord", "lemma", "gender", "number", "case", "r.paradigm", "r.confidence"))).alias("a"))
    out = rows.select("surface", F.posexplode("a").alias("i", "x"))
    return out.select("surface", (F.col("i") + 1).alias("ord"), *(F.col(f"x.{c}").alias(c) for c in ("lemma", "gender", "number", "case", "paradigm", "confidence")))


CANDIDATE = ("lemma", "gender", "number", "case", "paradigm", "confidence")


def noun_candidates(analyses: DataFrame) -> DataFrame:
    """surface, noun_candidates: the analyses of each word as one array."""
    s = F.array_sort(F.collect_list(F.struct("ord", *CANDIDATE)))
    return analyses.groupBy("surface").agg(F.transform(s, lambda x: F.struct(*(x[c].alias(c) for c in CANDIDATE), F.lit("lexicon").alias("source"))).alias("noun_candidates"))


def shown(analyses: DataFrame) -> DataFrame:
    """surface, line: readable analyses."""
    return analyses.select("surface", "ord", F.format_string("%s  %s %s %s  class=%s  %s", "lemma", "gender", "number", "case", "paradigm", "confidence").alias("line"))
