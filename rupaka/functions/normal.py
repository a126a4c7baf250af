"""The composed normal form for all scripts.

What isn't composed yet can be told from its characters: only words with a character that
is a mark of some combining class, joins the character before it, or never stands in
composed text can change. Those are few in most texts, so they are found by a pattern and
composed in Arrow batches, each distinct word of a batch once, where they stand.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rupaka.functions.text import BEYOND, SPACES, as_class


@lru_cache(maxsize=1)
def doubtful() -> str:
    """The characters without which a text is composed: marks, second parts of composed characters, and what composition replaces."""
    found = {p for p in range(sys.maxunicode + 1) if unicodedata.combining(chr(p))}
    for p in range(sys.maxunicode + 1):
        parts = unicodedata.decomposition(chr(p))
        if parts and not parts.startswith("<"):
            whole = unicodedata.normalize("NFC", chr(p))
            if whole != chr(p):
                found.add(p)
            elif " " in parts:
                found.add(int(parts.split(" ")[1], 16))
    vowels, finals = range(0x1161, 0x1176), range(0x11A8, 0x11C3)  # of syllables that are composed by rule
    return as_class(sorted(found.union(vowels, finals)))


def may_change(c: Column | str) -> Column:
    """Whether a text has a character that composition may change. All of them are beyond U+02FF, and the test for that is fast."""
    c = F.col(c) if isinstance(c, str) else c
    return c.rlike(f"(?={BEYOND})[{doubtful()}]")


def composed_words(words: pa.Array) -> pa.Array:
    """In normal form, each distinct word of the batch once; nulls stay."""
    known = words.dictionary_encode()
    whole = pa.array([unicodedata.normalize("NFC", w) for w in known.dictionary.to_pylist()], pa.string())
    return whole.take(known.indices)


def composed_lists(lists: pa.Array) -> pa.Array:
    """composed_words() of the words of arrays; null arrays stay."""
    sizes = lists.value_lengths().to_pylist()
    offsets = [0, *accumulate(n or 0 for n in sizes)]
    offsets = [None if n is None else o for n, o in zip(sizes, offsets)] + offsets[-1:]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), composed_words(lists.flatten()))


def composed(df: DataFrame, word: str = "token") -> DataFrame:
    """df with the column ``word`` in composed normal form. Only words that may change leave the JVM; no row is shuffled."""
    whole = F.arrow_udf(composed_words, "string")(F.when(may_change(word), F.col(word)))
    return df.withColumn(word, F.coalesce(whole, word))


def words(texts: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """keys, words: the words of each text of any script, composed, as an array; null for null. Texts without a character that composition may change are composed already."""
    df = texts.select(*keys, F.array_remove(F.split(text, SPACES), "").alias("words"), may_change(text).alias("_may"))
    whole = F.arrow_udf(composed_lists, "array<string>")(F.when(F.col("_may"), F.col("words")))
    return df.withColumn("words", F.coalesce(whole, "words")).drop("_may")


def tokenized(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, pos (from 0), token: the words of texts of any script, composed. Spaces that composition would change are spaces before it as well."""
    return words(texts, key, text=text).select(key, F.posexplode("words").alias("pos", "token"))
