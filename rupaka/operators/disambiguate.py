"""Sentence disambiguation: analyse distinct words, join back, read the context, score, propagate.

Without a bigram model every token is scored on its own columns. The model's state
(the last class that was certain) and coordination run through a sentence in order,
as steps from states to states (see scan). By default a sentence is one segment; with
``levels`` texts of any length run in segments side by side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from rupaka.functions import tables as t
from rupaka.functions.text import cases, last_char, tokens
from rupaka.operators import context
from rupaka.operators.nouns import CANDIDATE as NOUN, analyze_nouns, noun_candidates
from rupaka.operators.scan import scanned
from rupaka.operators.terms import Terms, marked
from rupaka.operators.verbs import CANDIDATE as VERB, analyze_verbs, verb_candidates

NOUNS = "array<struct<" + ",".join(f"{c}:string" for c in (*NOUN, "source")) + ">>"
VERBS = "array<struct<" + ",".join(f"{c}:string" for c in VERB[:-1]) + ",irregular:boolean>>"


def tokenized(sentences: DataFrame, text: str = "text") -> DataFrame:
    """sent_id, pos (from 0), token."""
    return sentences.select("sent_id", F.posexplode(tokens(text)).alias("pos", "token"))


def synthesized(token: Column, gender: Column, endings: dict | None = None, others: tuple[str, str] = ("M2", "F3")) -> Column:
    """The candidates of a word outside the lexicon whose gender a model predicts. endings: last character to (class if M, class if F); others: the classes of all other words."""
    endings = t.ENDING_CLASSES if endings is None else endings
    pair = lambda k: cases(last_char(token), {e: p[k] for e, p in endings.items()}, others[k])
    paradigm = F.when(gender == "M", pair(0)).otherwise(pair(1))
    one = lambda n, c: F.struct(token.alias("lemma"), gender.alias("gender"), F.lit(n).alias("number"), F.lit(c).alias("case"), paradigm.alias("paradigm"), F.lit("predicted").alias("confidence"), F.lit("gender_model").alias("source"))
    return F.array(*(one(n, c) for n in ("SG", "PL") for c in ("DIR", "OBL")))


def candidates(toks: DataFrame, lexicon: DataFrame, genders: DataFrame | None = None, noun_rules: DataFrame | None = None, **verbs) -> DataFrame:
    """Adds noun_candidates and verb_candidates to rows with a token. Every distinct word is analysed once.

    genders: word, gender (M or F) predicted for words; verbs: rule tables of analyze_verbs().
    """
    words = toks.select(F.col("token").alias("word")).distinct()
    nouns = noun_candidates(analyze_nouns(words, lexicon, noun_rules))
    kinds = words.join(nouns.withColumnRenamed("surface", "word"), "word", "left").join(verb_candidates(analyze_verbs(words, **({"with_aux": False} | verbs))).withColumnRenamed("surface", "word"), "word", "left")
    kinds = kinds.withColumn("noun_candidates", F.coalesce("noun_candidates", F.array().cast(NOUNS))).withColumn("verb_candidates", F.coalesce("verb_candidates", F.array().cast(VERBS)))
    if genders is not None:
        kinds = kinds.join(genders.select("word", "gender").filter(F.col("gender").isin("M", "F")), "word", "left")
        new = (F.size("noun_candidates") == 0) & F.col("gender").isNotNull()
        kinds = kinds.withColumn("noun_candidates", F.when(new, synthesized(F.col("word"), F.col("gender"))).otherwise(F.col("noun_candidates"))).drop("gender")
    return toks.join(kinds.withColumnRenamed("word", "token"), "token", "left")


def base_score(c: Column, s) -> Column:
    """A noun candidate's score from the signals s (a function from names to columns), summed in a fixed order."""
    gender = F.when(s("gender_signal").isNull(), 0.0).when(c.gender == s("gender_signal"), 8.0).otherwise(-8.0)
    case = F.when(~s("oblique"), 0.0).when(c["case"] == "OBL", 4.0).otherwise(-4.0)
    number = F.when(c.number == s("number_signal"), 2.0).otherwise(0.0)
    verb = F.when(~s("oblique") & (c["case"] == "DIR") & (c.gender == s("agreement").gender) & (c.number == s("agreement").number), 1.0).otherwise(0.0)
    return gender + case + number + verb


def labels(nouns: Column, s) -> Column:
    """Names of the signals that exist for a token with noun candidates."""
    direct = F.exists(nouns, lambda c: c["case"] == "DIR")
    every = F.array(
        F.concat(F.lit("genitive→"), s("gender_signal")),
        F.when(s("oblique"), F.lit("postposition→OBL")),
        F.concat(F.lit("quantifier→"), s("number_signal")),
        F.when(~s("oblique") & direct, F.concat(F.lit("verb_agreement→"), s("agreement").gender, s("agreement").number)),
    )
    return F.when(F.size(nouns) > 0, F.array_compact(every)).otherwise(F.array().cast("array<string>"))


def let(value: Column, f) -> Column:
    """f(value), with ``value`` computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def best(nouns: Column, score) -> Column:
    """The candidates tied at the highest score; all of them if every score is 0."""

    def tied(scores: Column) -> Column:
        top = F.array_max(scores)
        return F.when(F.forall(scores, lambda s: s == 0.0), nouns).otherwise(F.filter(nouns, lambda c, i: F.get(scores, i) == top))

    return F.when(F.size(nouns) > 0, let(F.transform(nouns, score), tied)).otherwise(nouns)


def prior(previous: Column, paradigm: Column, model: dict) -> Column:
    """The bigram probability; 0 after a class that never stands before another, or none."""
    if not model:
        return F.lit(0.0)
    pairs = F.create_map(*[F.lit(x) for prev, (known, _) in model.items() for curr, p in known.items() for x in (f"{prev}\t{curr}", float(p))]) if any(k for k, _ in model.values()) else F.create_map().cast("map<string,double>")
    others = F.create_map(*[F.lit(x) for prev, (_, other) in model.items() for x in (prev, float(other))])
    return F.coalesce(F.try_element_at(pairs, F.concat(previous, F.lit("\t"), paradigm)), F.try_element_at(others, previous), F.lit(0.0))


def filtered_verbs(verbs: Column, negation: Column) -> tuple[Column, Column]:
    """Verb candidates and labels under negation. The filter asks for a mood written ``IMP``, which the analysis never uses."""
    kept = F.when(negation == "nahi", F.filter(verbs, lambda c: ~c.mood.eqNullSafe(F.lit("IMP")))).when(negation == "mat", F.filter(verbs, lambda c: c.mood.eqNullSafe(F.lit("IMP"))))
    label = F.when(F.size(kept) > 0, F.when(negation == "nahi", "verb:negation(नहीं)→¬IMP").otherwise("verb:negation(मत)→IMP"))
    return F.when(F.size(kept) > 0, kept).otherwise(verbs), F.array_compact(F.array(label))


def ambiguous(nouns: Column, verbs: Column) -> Column:
    noun = F.size(F.array_distinct(F.transform(nouns, lambda c: F.struct(c.lemma, c.gender, c.number, c["case"])))) > 1
    null = lambda x: F.coalesce(x, F.lit(""))
    verb = F.size(F.array_distinct(F.transform(verbs, lambda c: F.struct(c.lemma, null(c.gender).alias("g"), null(c.number).alias("n"), null(c.aspect).alias("a"), null(c.tense).alias("t"))))) > 1
    return noun | verb


def _only(values: Column) -> Column:
    """The one distinct value of an array; null if there are several or none."""
    d = F.array_distinct(values)
    return F.when(F.size(d) == 1, F.get(d, F.lit(0)))


def class_states(model: dict) -> Column:
    """The classes that may be in force: null, and those that the model has as predecessors. Others give nothing to what follows, so they count as null."""
    return F.array(*(F.lit(c).cast("string") for c in (None, *sorted(model))))


def best_under(previous: Column, model: dict, score) -> Column:
    """The best of noun_candidates after a class; score: a function from a candidate to what it scores without the model."""
    return best(F.col("noun_candidates"), lambda c: score(c) + prior(previous, c.paradigm, model) * 2.0)


def class_step(model: dict, score) -> Column:
    """For every class that may be in force, by its place in class_states(), the one after a row: that of the best candidates if they have one class, else the same."""
    states = class_states(model)

    def after(prev: Column, i: Column) -> Column:
        only = _only(F.transform(best_under(prev, model, score), lambda c: c.paradigm))
        return F.when(only.isNull(), i).otherwise(F.greatest(F.lit(0), F.array_position(states, only).cast("int") - 1))

    return F.when(F.size("noun_candidates") > 0, F.transform(states, after)).otherwise(F.sequence(F.lit(0), F.lit(len(model))))


def with_class_state(tokens: DataFrame, model: dict, score, keys: list[str], at: str = "pos", levels: int = 2) -> DataFrame:
    """Narrows noun_candidates under a bigram model, one row after the other, and adds ``previous``: the class in force before the row."""
    steps = tokens.withColumn("_step", class_step(model, score))
    out = scanned(steps, keys, at, "_step", len(model) + 1, 0, levels, "_state").withColumn("previous", F.get(class_states(model), F.col("_state")))
    return out.withColumn("noun_candidates", best_under(F.col("previous"), model, score)).drop("_step", "_state")


def coordinated(tokens: DataFrame, keys: list[str], at: str = "pos", cases: tuple[str, ...] = ("DIR", "OBL"), levels: int = 2) -> DataFrame:
    """Passes a certain case across each conjunction to an uncertain neighbour, from left to right.

    Rows have noun_candidates, signals_applied, clitic and conjunction. A conjunction's neighbours are the
    nearest words on either side that have noun candidates and are no clitics. If one has one
    case and the other several, the other keeps its candidates of that case (if it has any),
    which later conjunctions see. One pass: the state is the case, if there is but one, of
    the last two such words; what a word passes back is read from the word after it.
    cases: the names of all cases.
    """
    n = len(cases) + 1
    named = F.array(*map(F.lit, cases))
    before = lambda by: Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    ahead = lambda c: F.last(c, ignorenulls=True).over(before(F.col(at)))
    behind = lambda c: F.last(c, ignorenulls=True).over(before(F.col(at).desc()))
    bearing = F.coalesce(~F.col("clitic"), F.lit(True)) & (F.size("noun_candidates") > 0)
    df = tokens.withColumn("_bears", bearing).withColumn("_and", F.coalesce("conjunction", F.lit(False)))
    df = df.withColumn("_cases", F.when(F.col("_bears"), F.array_distinct(F.transform("noun_candidates", lambda c: c["case"]))))
    df = df.withColumn("_ands", F.count_if(F.col("_and") & ~F.col("_bears")).over(Window.partitionBy(*keys).orderBy(at)))
    df = df.withColumn("_one", ahead(F.when(F.col("_bears"), F.struct("_cases", "_and", "_ands"))))
    df = df.withColumn("_two", ahead(F.when(F.col("_bears"), F.struct("_one._cases"))))
    single = F.when(F.size("_cases") == 1, F.array_position(named, F.get("_cases", F.lit(0))).cast("int")).otherwise(0)
    df = df.withColumn("_own", F.coalesce(single, F.lit(0)))

    def pair(left: Column, left_cases: Column, right: Column) -> tuple[Column, Column]:
        """The single cases (0: several) of two neighbours after a conjunction."""
        may = lambda k, own: (F.size(own) > 1) & F.array_contains(own, F.get(named, k - 1))
        to_right = (left > 0) & (right == 0) & F.coalesce(may(left, F.col("_cases")), F.lit(False))
        to_left = (right > 0) & (left == 0) & F.coalesce(may(right, left_cases), F.lit(False))
        return F.when(to_left, right).otherwise(left), F.when(to_right, left).otherwise(right)

    def met(state: Column) -> Column:
        """The single cases of the word before the last, the last word and this one, after the conjunctions between them. A conjunction that bears a case itself joins its own neighbours."""
        two, one = (state / n).cast("int"), state % n
        over = F.coalesce(F.col("_one._and"), F.lit(False))
        between = F.col("_one").isNotNull() & (F.col("_ands") > F.coalesce("_one._ands", F.lit(0)))

        def second(x: Column) -> Column:
            first, own = pair(one, F.col("_one._cases"), x.own)
            return F.struct(x.two.alias("two"), F.when(between, first).otherwise(one).alias("one"), F.when(between, own).otherwise(x.own).alias("own"))

        first, own = pair(two, F.col("_two._cases"), F.col("_own"))
        return let(F.struct(F.when(over, first).otherwise(two).alias("two"), F.when(over, own).otherwise(F.col("_own")).alias("own")), second)

    states = F.sequence(F.lit(0), F.lit(n * n - 1))
    step = F.when(F.col("_bears"), F.transform(states, lambda s: let(met(s), lambda x: x.one * n + x.own))).otherwise(states)
    df = scanned(df.withColumn("_step", step), keys, at, "_step", n * n, 0, levels, "_state")
    df = df.withColumn("_met", F.when(F.col("_bears"), met(F.col("_state"))))
    df = df.withColumn("_next", behind(F.col("_met"))).withColumn("_last", behind(F.when(F.col("_bears"), F.struct("_next.two"))))
    final = F.greatest(F.col("_met.own"), F.coalesce("_next.one", F.lit(0)), F.coalesce("_last.two", F.lit(0)))
    to = F.when(F.col("_bears") & (F.size("_cases") > 1) & (final > 0), F.get(named, final - 1))
    df = df.withColumn("_to", to)
    df = df.withColumn("noun_candidates", F.when(F.col("_to").isNull(), F.col("noun_candidates")).otherwise(F.filter("noun_candidates", lambda c: c["case"] == F.col("_to"))))
    return df.withColumn("signals_applied", F.when(F.col("_to").isNull(), F.col("signals_applied")).otherwise(F.concat("signals_applied", F.array(F.concat(F.lit("coordination→"), "_to"))))).select(*tokens.columns)


def disambiguate(sentences: DataFrame, lexicon: DataFrame, genders: DataFrame | None = None, bigrams: dict | None = None, text: str = "text", terms: Terms | None = None, levels: int = 0, **rules) -> DataFrame:
    """sent_id, pos, token, noun_candidates, verb_candidates, ambiguous, signals_applied for every token of (sent_id, text).

    genders: predicted word, gender for words outside the lexicon; bigrams: what
    bigram.scores() gives; terms: a term table, by default the engine's own; levels: see scan;
    rules: rule tables of candidates(). Sentences that are null or empty have no tokens.
    """
    terms = terms or Terms.hindi()
    df = context.signals(candidates(marked(sentences, terms, text), lexicon, genders, **rules), terms)
    own = lambda n: F.col(n)
    verbs, verb_labels = filtered_verbs(F.col("verb_candidates"), F.col("negation"))
    df = df.withColumn("signals_applied", F.concat(labels(F.col("noun_candidates"), own), verb_labels)).withColumn("verb_candidates", verbs)
    score = lambda c: base_score(c, own)
    if not bigrams:
        df = df.withColumn("noun_candidates", best(F.col("noun_candidates"), score))
    else:
        df = with_class_state(df, bigrams, score, ["sent_id"], levels=levels)
    df = coordinated(df, ["sent_id"], levels=levels)
    return df.select("sent_id", "pos", "token", "noun_candidates", "verb_candidates", ambiguous(F.col("noun_candidates"), F.col("verb_candidates")).alias("ambiguous"), "signals_applied")


def resolved(results: DataFrame) -> DataFrame:
    """Adds has_analysis, resolved_noun and resolved_verb (the reading, where there is only one)."""
    only = lambda c: F.when(F.size(c) == 1, F.get(F.col(c), F.lit(0)))
    return results.select("*", ((F.size("noun_candidates") > 0) | (F.size("verb_candidates") > 0)).alias("has_analysis"), only("noun_candidates").alias("resolved_noun"), only("verb_candidates").alias("resolved_verb"))


def shown(results: DataFrame) -> DataFrame:
    """sent_id, pos, line: readable results."""
    nouns = F.array_join(F.transform("noun_candidates", lambda c: F.concat_ws("/", c.lemma, c.gender, c.number, c["case"], c.paradigm)), ", ")
    verbs = F.array_join(F.transform("verb_candidates", lambda c: F.concat_ws("/", c.lemma, c.suffix, c.gender, c.number, c.aspect, c.tense, c.mood)), ", ")
    mark = F.when(F.col("ambiguous"), "?").when((F.size("noun_candidates") == 0) & (F.size("verb_candidates") == 0), "-").otherwise("=")
    return results.select("sent_id", "pos", F.concat_ws(" ", mark, "token", F.concat(F.lit("N["), nouns, F.lit("]")), F.concat(F.lit("V["), verbs, F.lit("]")), F.concat(F.lit("{"), F.array_join("signals_applied", ", "), F.lit("}"))).alias("line"))


def disambiguate_sentence(spark: SparkSession, sentence: str, lexicon: DataFrame, **how) -> DataFrame:
    """disambiguate() of one sentence, in order."""
    return disambiguate(spark.createDataFrame([(0, sentence)], "sent_id long, text string"), lexicon, **how).orderBy("pos").drop("sent_id")
