"""Term tables: what single words signal, and terms of several words, found by an automaton.

A table has the columns term, kind, and, where the kind needs them, value and number:

| kind | meaning | value | number |
|-|-|-|-|
| clitic | transparent for its neighbours | | |
| postposition | never a noun itself | | |
| oblique | puts the word before it in the oblique case | | |
| genitive | agrees with the word after it | its gender | its number or null |
| singular, plural | number of the word after it | | |
| negation | negates the sentence | a name | |
| conjunction | joins two words of one case | | |
| compound | a postposition of any number of words | | |

Terms of several words are found in one pass over a sentence's tokens (Aho-Corasick over
tokens). Where matches overlap, longer terms go first, then those earlier in the table,
then those further left. The automaton goes to every task, so it has a bound, MOST words;
of a larger table the sentence's n-grams are joined with the terms instead.
"""

from __future__ import annotations

from collections import deque
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rupaka.functions import tables as t
from rupaka.functions.text import tokens

#: Words of all terms together up to which they become an automaton.
MOST = 1 << 18
COLUMNS = ("term", "kind", "value", "number")
ROLES = ("clitic", "postposition", "oblique", "conjunction")
ROLE_SCHEMA = "token string, " + ", ".join(f"{r} boolean" for r in ROLES) + ", genitive boolean, gives_gender string, gives_number string, negates string"


class Automaton:
    """Finds all occurrences of token sequences; terms are given in table order."""

    def __init__(self, terms: list[tuple[str, ...]]):
        self.step: list[dict[str, int]] = [{}]
        self.out: list[tuple[tuple[int, int], ...]] = [()]  # (length, place in the table) of the terms that end here
        for ord_, term in enumerate(terms):
            node = 0
            for word in term:
                if word not in self.step[node]:
                    self.step[node][word] = len(self.step)
                    self.step.append({})
                    self.out.append(())
                node = self.step[node][word]
            if term and not self.out[node]:
                self.out[node] = ((len(term), ord_),)
        self.fail = [0] * len(self.step)
        waiting = deque(self.step[0].values())
        while waiting:
            node = waiting.popleft()
            for word, child in self.step[node].items():
                self.fail[child] = self.after(self.fail[node], word)
                self.out[child] += self.out[self.fail[child]]
                waiting.append(child)

    def after(self, node: int, word: str) -> int:
        while node and word not in self.step[node]:
            node = self.fail[node]
        return self.step[node].get(word, 0)

    def hits(self, words: list[str]) -> list[tuple[int, int, int]]:
        """(-length, place in the table, position): sorted, this is the order in which matches win."""
        node, out = 0, []
        for i, word in enumerate(words):
            node = self.after(node, word)
            out += [(-n, ord_, i - n + 1) for n, ord_ in self.out[node]]
        return out


def chosen(hits: list[tuple[int, int, int]], n: int) -> list[dict | None]:
    """For each of n tokens the term it belongs to: matches win in sorted order where their words are still free."""
    out: list[dict | None] = [None] * n
    for length, ord_, at in sorted(hits):
        if not any(out[at : at - length]):
            out[at : at - length] = [{"term": ord_, "starts": k == 0} for k in range(-length)]
    return out


def opened(a: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The items of a batch of arrays, one after the other, and where each array begins and the last ends."""
    sizes = pc.fill_null(pc.list_value_length(a), 0).to_numpy(zero_copy_only=False)
    return a.flatten(), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)


def runs(a: pa.Array, most: int = 1 << 16) -> list[tuple[int, int]]:
    """(begin, count) of runs of a batch's arrays with ``most`` items at most, or one longer array, so that what Python holds doesn't follow the batch."""
    ends, out, begin = opened(a)[1], [], 0
    while begin < len(a) or not out:
        end = max(begin + 1, int(np.searchsorted(ends, ends[begin] + most, "right")) - 1)
        out.append((begin, end - begin))
        begin = end
    return out


def marks_of(automaton: Automaton, flat: pa.Array, ends: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """For each token of a batch the compound it belongs to and whether it starts it; both are null elsewhere."""
    words, marks = flat.to_numpy(zero_copy_only=False).tolist(), []
    for i, j in zip(ends[:-1].tolist(), ends[1:].tolist()):
        marks += chosen(automaton.hits(words[i:j]), j - i)
    return pa.array([m and m["term"] for m in marks], pa.int32()), pa.array([m and m["starts"] for m in marks], pa.bool_())


MARK = pa.list_(pa.struct([("term", pa.int32()), ("starts", pa.bool_())]))
MARKS = "array<struct<term:int,starts:boolean>>"


class Terms:
    """A term table that can be used again and again; rows: (term, kind, value, number)."""

    def __init__(self, rows: list[tuple]):
        self.rows = [(" ".join(r[0].split()), r[1], r[2], r[3]) for r in rows if r[0] and r[0].split()]

    @classmethod
    def read(cls, table: DataFrame, most: int = MOST) -> Terms:
        """The terms of a table, in order of its column ``ord`` if it has one, else of kind and text. A larger table than ``most`` words isn't for this class, but for marked_by_join()."""
        order = ["ord"] if "ord" in table.columns else ["kind", "term"]
        have = table.filter("term is not null").select(*order, *(c if c in table.columns else F.lit(None).cast("string").alias(c) for c in COLUMNS if c not in order))
        if have.select(F.coalesce(F.sum(F.size(F.split("term", " "))), F.lit(0)).alias("n")).first().n > most:
            raise ValueError(f"the terms have more than {most} words")
        return cls([tuple(r[c] for c in COLUMNS) for r in have.orderBy(*order).collect()])

    @classmethod
    def hindi(cls) -> Terms:
        """The engine's own table."""
        named = {"clitic": t.CLITICS, "postposition": t.POSTPOSITIONS, "oblique": t.OBLIQUE_POSTPOSITIONS, "singular": t.SINGULAR_QUANTIFIERS, "plural": t.PLURAL_QUANTIFIERS}
        rows = [(w, kind, None, None) for kind, words in named.items() for w in words.split()]
        rows += [(w, "genitive", *v) for w, v in t.GENITIVES.items()] + [(w, "negation", v, None) for w, v in t.NEGATIONS.items()] + [(t.CONJUNCTION, "conjunction", None, None)]
        pairs = [f"{a} {b}" for a, bs in t.COMPOUNDS.items() for b in bs.split()]
        return cls(rows + [(c, "compound", None, None) for c in (*t.LONG_COMPOUNDS, *pairs)])

    @cached_property
    def compounds(self) -> list[str]:
        return list(dict.fromkeys(r[0] for r in self.rows if r[1] == "compound"))

    @cached_property
    def automaton(self) -> Automaton:
        return Automaton([tuple(c.split(" ")) for c in self.compounds])

    def marks(self, words: Column | str) -> Column:
        """For each token of an array the compound (its place in the table) it belongs to and whether it starts it; null elsewhere."""
        automaton = self.automaton

        def one(a: pa.Array) -> pa.Array:
            flat, ends = opened(a)
            term, starts = marks_of(automaton, flat, ends)
            return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([term, starts], fields=list(MARK.value_type), mask=term.is_null()), mask=a.is_null())

        def run(a: pa.Array) -> pa.Array:
            return pa.concat_arrays([one(a.slice(*r)) for r in runs(a)])

        run.__annotations__ = {"a": pa.Array, "return": pa.Array}
        return F.arrow_udf(run, MARKS)(words)

    def of(self, kind: str) -> list[str]:
        return list(dict.fromkeys(r[0] for r in self.rows if r[1] == kind))

    @cached_property
    def single(self) -> pa.Table:
        """A row for each single word: ROLE_SCHEMA. Of several entries of one kind the first counts; quantifiers go before genitives, singular before plural."""
        words: dict[str, dict] = {}
        for term, kind, value, number in self.rows:
            if kind != "compound":
                words.setdefault(term, {}).setdefault(kind, (value, number))
        rows = []
        for w, k in words.items():
            gender, number = k.get("genitive", (None, None))
            number = "SG" if "singular" in k else "PL" if "plural" in k else number
            rows.append((w, *(r in k for r in ROLES), "genitive" in k, gender, number, k.get("negation", (None,))[0]))
        return pa.Table.from_pylist([dict(zip(ROLE_NAMES, r)) for r in rows], ROLE_ARROW)

    def roles(self, spark: SparkSession) -> DataFrame:
        """A row for each single word, as ``single`` has them."""
        return spark.createDataFrame(self.single)


ROLE_NAMES = ("token", *ROLES, "genitive", "gives_gender", "gives_number", "negates")
ROLE_ARROW = pa.schema([(c, pa.bool_() if c in (*ROLES, "genitive") else pa.string()) for c in ROLE_NAMES])


def marked(sentences: DataFrame, terms: Terms, text: str = "text", key: str = "sent_id") -> DataFrame:
    """key, pos (from 0), token, term (the compound a token belongs to, by its place in the table) and starts, of (key, text)."""
    s = sentences.select(key, tokens(text).alias("_ts"))
    s = s.withColumn("_marks", terms.marks("_ts")) if terms.compounds else s.withColumn("_marks", F.array().cast(MARKS))
    return exploded(s, key)


def exploded(s: DataFrame, key: str) -> DataFrame:
    each = F.transform("_ts", lambda w, i: F.struct(w.alias("token"), F.get("_marks", i).alias("mark")))
    return s.select(key, F.posexplode(each).alias("pos", "_x")).select(key, "pos", "_x.token", "_x.mark.term", F.coalesce("_x.mark.starts", F.lit(False)).alias("starts"))


def marked_by_join(sentences: DataFrame, compounds: DataFrame, longest: int, text: str = "text", key: str = "sent_id") -> DataFrame:
    """marked() for a table of any size: n-grams of up to ``longest`` words meet the terms in a join. compounds: term (its words joined by one space), ord; keys of sentences must be unique."""
    s = sentences.select(key, tokens(text).alias("_ts"))
    grams = s.select(key, F.explode(F.sequence(F.lit(1), F.lit(longest))).alias("n"), "_ts").filter(F.size("_ts") >= F.col("n"))
    places = F.sequence(F.lit(0), F.size("_ts") - F.col("n"))
    grams = grams.select(key, "n", F.explode(F.transform(places, lambda i: F.struct(i.alias("at"), F.array_join(F.slice("_ts", i + 1, F.col("n")), " ").alias("term")))).alias("g"))
    first = compounds.groupBy("term").agg(F.min("ord").alias("ord"))
    hits = grams.select(key, "n", "g.at", "g.term").join(first, "term").groupBy(F.col(key).alias("_key")).agg(F.collect_list(F.struct((-F.col("n")).alias("n"), "ord", "at")).alias("_hits"))

    def run(hits: pa.Array, sizes: pa.Array) -> pa.Array:
        rows = zip(hits.to_pylist(), sizes.to_pylist())
        return pa.array([chosen([(h["n"], h["ord"], h["at"]) for h in found or ()], n) for found, n in rows], MARK)

    run.__annotations__ = {"hits": pa.Array, "sizes": pa.Array, "return": pa.Array}
    s = s.join(hits, F.col(key) == F.col("_key"), "left").filter("_ts is not null")
    return exploded(s.withColumn("_marks", F.arrow_udf(run, MARKS)("_hits", F.size("_ts"))), key)
