"""Evaluation against gold tokens: any-match correctness, failure classes, rollups, stratified samples, comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rupaka.functions.features import FIELDS
from rupaka.functions.text import nfc, normalized
from rupaka.operators.nouns import CANDIDATE

OUT = "OOV"
NOUN_FIELDS = ("gender", "number", "case")
VERB_FIELDS = ("aspect", "tense", "mood", "gender", "number", "person")


def agrees(gold: Column, said: Column) -> Column:
    """A gold value that is null asks for nothing."""
    return gold.isNull() | gold.eqNullSafe(said)


def same_lemma(said: Column, gold: Column, loose: bool) -> Column:
    exact = nfc(said) == nfc(gold)
    return exact | (normalized(said) == normalized(gold)) if loose else exact


def matched(tokens: DataFrame, fields: tuple[str, ...], loose: bool) -> DataFrame:
    """Adds has_analysis, lemma_ok and full_ok to gold tokens with analyses (array of structs): whether any analysis matches."""
    lemma = lambda a: same_lemma(a.lemma, F.col("lemma"), loose)

    def full(a: Column) -> Column:
        out = lemma(a)
        for f in fields:
            out = out & agrees(F.col(f), a[f])
        return out

    return tokens.select("*", (F.size("analyses") > 0).alias("has_analysis"), F.exists("analyses", lemma).alias("lemma_ok"), F.exists("analyses", full).alias("full_ok"))


def failure(in_lexicon: Column | None = None) -> Column:
    """Why a token failed, by the first that applies; null if it didn't."""
    out = F.when(F.col("full_ok"), F.lit(None).cast("string")).when(~F.col("has_analysis"), "no_analysis")
    if in_lexicon is not None:
        out = out.when(~in_lexicon, "oov")
    return out.when(~F.col("lemma_ok"), "wrong_lemma").otherwise("wrong_features")


def evaluated_nouns(gold: DataFrame, analyses: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Gold nouns with analyses, match flags, the gold lemma's paradigm and confidence (OOV if it has none) and failure_type. analyses: of the distinct surfaces."""
    a = analyses.groupBy("surface").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", *CANDIDATE))), lambda x: F.struct(*(x[c].alias(c) for c in CANDIDATE))).alias("analyses"))
    empty = F.array().cast("array<struct<" + ",".join(f"{c}:string" for c in CANDIDATE) + ">>")
    t = matched(gold.join(a, "surface", "left").withColumn("analyses", F.coalesce("analyses", empty)), NOUN_FIELDS, True)
    t = t.withColumn("norm", normalized("lemma")).join(lexicon.select("norm", "paradigm", "confidence"), "norm", "left").drop("norm")
    t = t.withColumn("in_lexicon", F.col("paradigm").isNotNull()).withColumn("paradigm", F.coalesce("paradigm", F.lit(OUT))).withColumn("confidence", F.coalesce("confidence", F.lit(OUT)))
    return t.withColumn("failure_type", failure(F.col("in_lexicon")))


def best_type(analyses: Column) -> Column:
    """The most telling verbal type of an analysis list."""
    kinds = F.transform(analyses, lambda a: a.verbal_type)
    out = F.when(F.size(analyses) == 0, "none")
    for k in ("finite", "participle", "infinitive"):
        out = out.when(F.array_contains(kinds, k), k)
    return out.otherwise("unknown")


def best_confidence(analyses: Column) -> Column:
    out = F.when(F.size(analyses) == 0, "none")
    for k in ("high", "medium", "low"):
        out = out.when(F.array_contains(F.transform(analyses, lambda a: a.confidence), k), k)
    return out


def evaluated_verbs(gold: DataFrame, analyses: DataFrame) -> DataFrame:
    """Gold verbs with analyses, match flags, vtype, confidence and failure_type."""
    cols = tuple(dict.fromkeys(("lemma", *FIELDS, "confidence")))
    a = analyses.groupBy("surface").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", *cols))), lambda x: F.struct(*(x[c].alias(c) for c in cols))).alias("analyses"))
    empty = F.array().cast("array<struct<" + ",".join(f"{c}:string" for c in cols) + ">>")
    t = matched(gold.join(a, "surface", "left").withColumn("analyses", F.coalesce("analyses", empty)), VERB_FIELDS, False)
    t = t.withColumn("vtype", best_type(F.col("analyses"))).withColumn("confidence", best_confidence(F.col("analyses")))
    return t.withColumn("failure_type", failure())


def rollup(tokens: DataFrame, *dims: str) -> DataFrame:
    """dim, value, total, covered, lemma_ok, lemma_only, full_ok: over all tokens (dim ``all``) and by each dimension, in one pass."""
    flag = lambda c: F.count_if(c)
    sets = [[]] + [[F.col(d)] for d in dims]
    g = tokens.groupingSets(sets, *map(F.col, dims)) if dims else tokens.groupBy()
    bits = F.grouping_id(*map(F.col, dims)) if dims else F.lit(0)
    out = g.agg(
        bits.alias("g"), F.count("*").alias("total"), flag(F.col("has_analysis")).alias("covered"), flag(F.col("lemma_ok")).alias("lemma_ok"),
        flag(F.col("lemma_ok") & ~F.col("full_ok")).alias("lemma_only"), flag(F.col("full_ok")).alias("full_ok"),
    )
    whole = (1 << len(dims)) - 1
    name, value = F.when(F.col("g") == whole, "all"), F.when(F.col("g") == whole, "all")
    for k, d in enumerate(dims):
        name, value = name.when(F.col("g") == whole - (1 << (len(dims) - 1 - k)), d), value.when(F.col("g") == whole - (1 << (len(dims) - 1 - k)), F.col(d))
    return out.select(name.alias("dim"), value.alias("value"), "total", "covered", "lemma_ok", "lemma_only", "full_ok")


def failures(tokens: DataFrame) -> DataFrame:
    """failure_type, n."""
    return tokens.filter("failure_type is not null").groupBy("failure_type").agg(F.count("*").alias("n"))


def quotas(errors: DataFrame, stratum: str, n: int) -> DataFrame:
    """stratum, cnt, quota: the share of n, rounded half to even, 1 at least."""
    by = errors.groupBy(F.col(stratum).alias("stratum")).agg(F.count("*").alias("cnt"))
    total = F.sum("cnt").over(Window.partitionBy(F.lit(0)))
    return by.select("stratum", "cnt", F.greatest(F.lit(1), F.bround(F.lit(n) * (F.col("cnt") / total)).cast("int")).cast("long").alias("quota"))


def stratified_sample(errors: DataFrame, stratum: str, n: int, *key: str, seed: int = 42) -> DataFrame:
    """Up to n errors, each stratum by its quota, members chosen by a hash of their key; all of them if there are no more than n."""
    total = errors.count()
    if total <= n:
        return errors
    q = quotas(errors, stratum, n)
    # each task keeps a stratum's n best at most, so a hot stratum doesn't meet in one task as a whole
    order = F.xxhash64(F.lit(seed), *map(F.col, key))
    ranked = errors.withColumn("_o", order).withColumn("_salt", F.pmod(F.col("_o"), F.lit(64)))
    part = Window.partitionBy(stratum, "_salt").orderBy("_o", *key)
    ranked = ranked.withColumn("_r", F.row_number().over(part)).filter(F.col("_r") <= n)
    ranked = ranked.withColumn("_r", F.row_number().over(Window.partitionBy(stratum).orderBy("_o", *key)))
    some = ranked.join(F.broadcast(q), F.col(stratum).eqNullSafe(F.col("stratum"))).filter(F.col("_r") <= F.col("quota"))
    return some.orderBy(F.xxhash64(F.lit(seed + 1), F.col("_o")), *key).limit(n).drop("_o", "_salt", "_r", "stratum", "cnt", "quota")


def compared(first: DataFrame, second: DataFrame) -> DataFrame:
    """metric, a, b, delta: shares of two evaluations (rollups, their row for all tokens)."""
    parts = lambda df, n: df.filter("dim = 'all'").select(F.explode(F.map_from_arrays(F.array(*map(F.lit, ("coverage", "lemma", "full"))), F.array(*(F.try_divide(F.col(c), F.col("total")) for c in ("covered", "lemma_ok", "full_ok"))))).alias("metric", n))
    return parts(first, "a").join(parts(second, "b"), "metric").select("metric", "a", "b", (F.col("b") - F.col("a")).alias("delta"))


def distribution(tokens: DataFrame, column: str) -> DataFrame:
    return tokens.groupBy(column).agg(F.count("*").alias("n"))


