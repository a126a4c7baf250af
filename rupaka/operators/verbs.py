"""Verb analysis: irregular forms, suffix rules, features of the suffix, auxiliaries in the lemma."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rupaka.functions import tables as t
from rupaka.functions.features import FIELDS, irregular_features, shown as shown_features, suffix_readings
from rupaka.functions.text import beginnings, col, endings, nfc, restored, stripped
from rupaka.operators.nouns import longest, suffix_matches
from rupaka.sources import rules


def with_features(table: DataFrame, flags: list[tuple[str, str]] | None = None, all_readings: bool = False) -> DataFrame:
    """Rules with ``features`` and ``reading``. Of a suffix's readings the first is kept, or, on demand, all."""
    r = table.withColumn("_r", suffix_readings(stripped(nfc("suffix")), flags))
    if all_readings:
        return r.select("*", F.posexplode("_r").alias("reading", "features")).drop("_r")
    return r.withColumn("features", F.get("_r", F.lit(0))).withColumn("reading", F.lit(0)).drop("_r")


def detect_aux(lemmas: DataFrame, stem_flags: DataFrame | None, aux: DataFrame | None) -> DataFrame:
    """lemma, auxiliary, aux_flag: the longest flagged morpheme that begins or ends a lemma, else the longest auxiliary that ends it.

    stem_flags: morpheme, flag, file_ord; aux: root; by default the engine's own lists. Equally long ones go by file order, auxiliaries by their text.
    """
    given = stem_flags is not None or aux is not None
    stem_flags = rules.stem_flags(lemmas.sparkSession) if stem_flags is None else stem_flags
    aux = rules.auxiliaries(lemmas.sparkSession) if aux is None else aux
    known = stem_flags.select("morpheme", "flag", F.lit(0).alias("tier"), F.col("file_ord").cast("int").alias("at"), F.lit(True).alias("front")).union(aux.select("root", F.lit("aux"), F.lit(1), F.lit(0), F.lit(False)))
    most = longest(known, "morpheme") if given else max(map(len, [*t.AUXILIARIES.split(), *(m for m, _ in t.STEM_FLAGS)]))
    w = lemmas.select("lemma").distinct().withColumn("most", F.lit(most) if isinstance(most, int) else most)
    part = lambda a, front: w.select("lemma", F.explode(a).alias("morpheme"), F.lit(front).alias("begins"))
    parts = part(endings("lemma", F.col("most"), 1), False).union(part(beginnings("lemma", F.col("most")), True))
    hits = parts.join(known, "morpheme").filter("front or not begins")
    best = F.min_by(F.struct("morpheme", "flag"), F.struct("tier", -F.length("morpheme"), "at", "morpheme"))
    return hits.groupBy("lemma").agg(best.alias("b")).select("lemma", F.col("b.morpheme").alias("auxiliary"), F.col("b.flag").alias("aux_flag"))


def analyze_verbs(
    words: DataFrame,
    suffix_rules: DataFrame | None = None,
    irregular: DataFrame | None = None,
    stem_flags: DataFrame | None = None,
    aux: DataFrame | None = None,
    verb_lexicon: DataFrame | None = None,
    flags: list[tuple[str, str]] | None = None,
    all_readings: bool = False,
    word: str = "word",
    with_aux: bool = True,
) -> DataFrame:
    """surface, ord, lemma, suffix, paradigm, the eight features, irregular, auxiliary, aux_flag, confidence of each distinct word.

    Order: irregular forms, then by confidence (medium from three characters of suffix on, else low), then rule order. Lemmas have at least two
    characters and, if verb_lexicon (lemma) is given, are in it; irregular ones need neither. Without ``with_aux`` auxiliaries aren't looked for, and their columns are null.
    """
    spark = words.sparkSession
    most = max(len(s) for s, _ in t.VERB_RULES) if suffix_rules is None else None
    suffix_rules = rules.verb_rules(spark) if suffix_rules is None else suffix_rules
    irregular = rules.irregular_verbs(spark) if irregular is None else irregular
    w = words.select(col(word).alias("surface")).distinct().withColumn("_w", stripped(nfc("surface")))
    known = irregular.select(F.col("surface").alias("_w"), "lemma")
    whole = w.join(known, "_w").select("surface", "lemma", F.lit("(irregular)").alias("suffix"), F.lit("verb").alias("paradigm"), irregular_features(F.col("_w")).alias("features"), F.lit(True).alias("irregular"), F.lit("high").alias("confidence"), F.lit(0).alias("rule_ord"), F.lit(0).alias("reading"))
    hits = suffix_matches(w, with_features(suffix_rules, flags, all_readings), "_w", "suffix", 1, most).withColumn("lemma", restored("_w", "suffix", "add_back")).filter(F.length("lemma") >= 2)
    if verb_lexicon is not None:
        hits = hits.join(verb_lexicon.select("lemma").distinct(), "lemma", "left_semi")
    ruled = hits.select("surface", "lemma", "suffix", "paradigm", "features", F.lit(False).alias("irregular"), F.when(F.length("suffix") >= 3, "medium").otherwise("low").alias("confidence"), "rule_ord", "reading")
    every = whole.union(ruled)
    if with_aux:
        every = every.join(detect_aux(every, stem_flags, aux), "lemma", "left")
    else:
        every = every.withColumn("auxiliary", F.lit(None).cast("string")).withColumn("aux_flag", F.lit(None).cast("string"))
    rank = F.when(F.col("confidence") == "high", 0).when(F.col("confidence") == "medium", 1).otherwise(2)
    cols = ("lemma", "suffix", "paradigm", "features", "irregular", "auxiliary", "aux_flag", "confidence")
    # of one lemma, suffix and paradigm with equal features the first counts
    first = every.groupBy("surface", "lemma", "suffix", "paradigm", "features").agg(F.min(F.struct(rank.alias("rank"), "rule_ord", "reading", "irregular", "auxiliary", "aux_flag", "confidence")).alias("r"))
    rows = first.groupBy("surface").agg(F.array_sort(F.collect_list(F.struct("r.rank", "r.rule_ord", "r.reading", "lemma", "suffix", "paradigm", "features", "r.irregular", "r.auxiliary", "r.aux_flag", "r.confidence"))).alias("a"))
    out = rows.select("surface", F.posexplode("a").alias("i", "x")).select("surface", (F.col("i") + 1).alias("ord"), *(F.col(f"x.{c}").alias(c) for c in cols))
    return out.select("surface", "ord", "lemma", "suffix", "paradigm", *(F.col(f"features.{f}").alias(f) for f in FIELDS), "irregular", "auxiliary", "aux_flag", "confidence")


CANDIDATE = ("lemma", "suffix", "paradigm", "gender", "number", "person", "aspect", "tense", "mood", "verbal_type", "confidence", "irregular")


def verb_candidates(analyses: DataFrame) -> DataFrame:
    """surface, verb_candidates: the analyses of each word as one array."""
    s = F.array_sort(F.collect_list(F.struct("ord", *CANDIDATE)))
    return analyses.groupBy("surface").agg(F.transform(s, lambda x: F.struct(*(x[c].alias(c) for c in CANDIDATE))).alias("verb_candidates"))


def shown(analyses: DataFrame) -> DataFrame:
    """surface, ord, line: readable analyses."""
    features = shown_features(F.struct(*FIELDS))
    return analyses.select("surface", "ord", F.concat_ws(" ", "lemma", F.concat(F.lit("+"), "suffix"), F.concat(F.lit("["), features, F.lit("]")), "confidence").alias("line"))
