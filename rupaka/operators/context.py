"""Signals that the words around a token give, as window columns over its sentence.

Clitics are transparent: neighbours are the nearest other tokens. Windows shuffle and sort the
tokens; of sentences whose words are still in one row, signals_of() reads the signals
within the row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from rupaka.functions.text import tokens as words_of
from rupaka.operators.terms import Terms, marks_of, opened, runs


def sentence() -> WindowSpec:
    return Window.partitionBy("sent_id").orderBy("pos")


def whole() -> WindowSpec:
    return sentence().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def previous(condition: Column, value: Column) -> Column:
    """The value at the nearest token before that meets the condition."""
    return F.last(F.when(condition, value), ignorenulls=True).over(sentence().rowsBetween(Window.unboundedPreceding, -1))


def following(condition: Column, value: Column) -> Column:
    """The value at the nearest token after that meets the condition. Backwards, since a frame that ends at the last row is read anew for every row."""
    backwards = Window.partitionBy("sent_id").orderBy(F.col("pos").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return F.last(F.when(condition, value), ignorenulls=True).over(backwards)


def anywhere(value: Column) -> Column:
    """The first value of a sentence that isn't null."""
    return F.first(value, ignorenulls=True).over(whole())


def compounds(df: DataFrame, pairs: list[str], triples: list[str]) -> DataFrame:
    """Adds starts_compound and in_compound. Three-word terms come first; a two-word one may not use their words."""
    joined = lambda n: F.concat_ws(" ", "token", *(F.lead("token", k).over(sentence()) for k in range(1, n)))
    df = df.withColumn("_three", joined(3).isin(*triples) if triples else F.lit(False))
    at = lambda c, k: F.coalesce(F.lag(c, k).over(sentence()), F.lit(False))
    df = df.withColumn("_in3", F.col("_three") | at("_three", 1) | at("_three", 2))
    free = ~F.col("_in3") & ~F.coalesce(F.lead("_in3").over(sentence()), F.lit(True))
    df = df.withColumn("_two", (joined(2).isin(*pairs) & free) if pairs else F.lit(False))
    df = df.withColumn("starts_compound", F.col("_three") | F.col("_two")).withColumn("in_compound", F.col("_in3") | F.col("_two") | at("_two", 1))
    return df.drop("_three", "_in3", "_two")


def agreeing(candidates: Column) -> Column:
    """(gender, number) of the first verb candidate that has both."""
    pairs = F.filter(candidates, lambda c: c.gender.isNotNull() & c.number.isin("S", "P"))
    return F.get(F.transform(pairs, lambda c: F.struct(c.gender.alias("gender"), F.when(c.number == "S", "SG").otherwise("PL").alias("number"))), F.lit(0))


def signals(tokens: DataFrame, terms: Terms | None = None) -> DataFrame:
    """Adds oblique, gender_signal, number_signal, negation, agreement to sent_id, pos, token, starts, term, verb_candidates.

    terms: the term table, by default the engine's own; starts, term: as terms.marked() gives
    them for its compounds. agreement: (gender, number) of the first agreeing reading of
    the nearest verb to the right. Words of compounds signal nothing by themselves.
    """
    roles = (terms or Terms.hindi()).roles(tokens.sparkSession)
    df = tokens.join(roles.withColumnRenamed("token", "_word"), F.col("token") == F.col("_word"), "left").drop("_word")
    df = df.withColumnRenamed("oblique", "_obliging")
    has = lambda role: F.coalesce(role, F.lit(False))
    free, content = F.col("term").isNull(), ~has("clitic")
    after = following(content, F.struct(F.col("starts").alias("compound"), (free & has("_obliging")).alias("simple")))
    before = previous(content, F.struct(F.when(free, F.col("gives_gender")).alias("gender"), F.when(free, F.col("gives_number")).alias("number")))
    df = df.withColumn("_pair", F.when(free, agreeing(F.col("verb_candidates"))))
    df = df.withColumn("_after", after).withColumn("_before", before)
    oblique = content & (has("_after.compound") | (has("_after.simple") & ~has("postposition")))
    df = df.withColumn("negation", anywhere(F.when(free, F.col("negates")))).withColumn("oblique", oblique)
    df = df.withColumn("gender_signal", F.when(content, F.col("_before.gender"))).withColumn("number_signal", F.when(content, F.col("_before.number")))
    return df.withColumn("agreement", following(F.col("_pair").isNotNull(), F.col("_pair"))).drop("_pair", "_after", "_before", "gives_gender", "gives_number", "negates", "genitive", "_obliging")


PAIR = pa.struct([("gender", pa.string()), ("number", pa.string())])
#: What signals_of() knows of a token, besides the token.
READ = pa.struct([("term", pa.int32()), ("starts", pa.bool_()), ("clitic", pa.bool_()), ("postposition", pa.bool_()), ("conjunction", pa.bool_()), ("negation", pa.string()), ("oblique", pa.bool_()), ("gender_signal", pa.string()), ("number_signal", pa.string()), ("agreement", PAIR)])
READS = "array<struct<term:int,starts:boolean,clitic:boolean,postposition:boolean,conjunction:boolean,negation:string,oblique:boolean,gender_signal:string,number_signal:string,agreement:struct<gender:string,number:string>>>"


class Nearest:
    """Places of the nearest tokens of a batch that meet a condition, within the sentences that begin and end at ``ends``; null where there is none."""

    def __init__(self, ends: np.ndarray):
        self.own = np.arange(ends[-1])
        self.begins, self.ends = (np.repeat(e, np.diff(ends)) for e in (ends[:-1], ends[1:]))

    def before(self, meets: pa.Array) -> pa.Array:
        last = np.maximum.accumulate(np.where(meets, self.own, -1))
        last = np.concatenate([[-1], last])[: len(self.own)]
        return pa.array(last, mask=last < self.begins)

    def after(self, meets: pa.Array) -> pa.Array:
        return self._from(meets, self.own + 1)

    def first(self, meets: pa.Array) -> pa.Array:
        """The first of the sentence."""
        return self._from(meets, self.begins)

    def _from(self, meets: pa.Array, place: np.ndarray) -> pa.Array:
        n = len(self.own)
        following = np.minimum.accumulate(np.where(meets, self.own, n)[::-1])[::-1]
        following = np.concatenate([following, [n]])[place]
        return pa.array(following, mask=following >= self.ends)


def nearest(meets: Column) -> Column:
    """For each item of an array of booleans the places of the nearest true ones before and after it, null where there are none: previous() and following() of words that are in one row."""

    def one(a: pa.Array) -> pa.Array:
        flat, ends = opened(a)
        near, found = Nearest(ends), flat.to_numpy(zero_copy_only=False)
        # places of the batch become places of their row
        own = lambda at: pc.subtract(at, pa.array(near.begins)).cast(pa.int32())
        places = pa.StructArray.from_arrays([own(near.before(found)), own(near.after(found))], names=["before", "after"])
        return pa.ListArray.from_arrays(pa.array(ends), places, mask=a.is_null())

    def run(a: pa.Array) -> pa.Array:
        return pa.concat_arrays([one(a.slice(*r)) for r in runs(a)])

    run.__annotations__ = {"a": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<struct<before:int,after:int>>")(meets)


def reading(words: Column, pairs: Column, terms: Terms) -> Column:
    """READS of the words of a row; pairs: the agreeing reading of each word, or null."""
    automaton, single = terms.automaton, {c: terms.single[c].combine_chunks() for c in terms.single.column_names}

    def one(words: pa.Array, pairs: pa.Array) -> pa.Array:
        flat, ends = opened(words)
        verbs, near = pairs.flatten(), Nearest(ends)
        term, starts = marks_of(automaton, flat, ends)
        at = pc.index_in(flat, value_set=single["token"].cast(flat.type))
        role = {c: single[c].take(at) for c in single if c != "token"}
        has = lambda a: pc.fill_null(a, False)
        when = lambda condition, a: pc.if_else(condition, a, pa.scalar(None, a.type))
        starts, free, content = has(starts), term.is_null(), pc.invert(has(role["clitic"]))
        meets = lambda a: a.to_numpy(zero_copy_only=False)
        left, right = near.before(meets(content)), near.after(meets(content))
        simple = pc.and_(free, has(role["oblique"]))
        oblique = pc.or_(has(starts.take(right)), pc.and_(has(simple.take(right)), pc.invert(has(role["postposition"]))))
        negates = when(free, role["negates"])
        signal = lambda c: when(content, when(free, role[c]).take(left))
        agreement = verbs.take(near.after(meets(pc.and_(free, verbs.is_valid()))))
        columns = [term, starts, role["clitic"], role["postposition"], role["conjunction"], negates.take(near.first(meets(negates.is_valid()))), pc.and_(content, oblique), signal("gives_gender"), signal("gives_number"), agreement.cast(PAIR)]
        return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(columns, fields=list(READ)), mask=words.is_null())

    def run(words: pa.Array, pairs: pa.Array) -> pa.Array:
        return pa.concat_arrays([one(words.slice(*r), pairs.slice(*r)) for r in runs(words)])

    run.__annotations__ = {"words": pa.Array, "pairs": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, READS)(words, pairs)


def signals_of(sentences: DataFrame, verbs, terms: Terms | None = None, text: str = "text", key: str = "sent_id") -> DataFrame:
    """signals() of the tokens of (key, text), read within each sentence's row: no token is shuffled or sorted, and rows with one key are sentences of their own.

    verbs: a word's verb candidates, a function from a column to a column of built-in functions.
    """
    s = sentences.select(F.col(key), words_of(text).alias("_ts")).filter(F.size("_ts") > 0)
    # which readings agree doesn't depend on other words
    s = s.withColumn("_read", reading(F.col("_ts"), F.transform("_ts", lambda w: agreeing(verbs(w))), terms or Terms.hindi()))
    s = s.select(key, F.posexplode(F.arrays_zip("_ts", "_read")).alias("pos", "_x")).select(key, "pos", F.col("_x._ts").alias("token"), "_x._read.*")
    return s.withColumn("verb_candidates", verbs(F.col("token")))
