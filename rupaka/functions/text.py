"""Column expressions over words and sentences. All are built-in functions; lengths and positions are code points."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, functions as F

from rupaka.functions import tables

#: What separates tokens: every Unicode space and the four information separators.
SPACES = r"[\s\x1c-\x1f\x85\p{Z}]+"
#: A character that may be a mark; the test for one is slow.
BEYOND = r"[^\x00-\x{2ff}]"
NUKTA, VIRAMA = "़", "्"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nfc(c: Column | str) -> Column:
    """The composed normal form of Devanagari text; other scripts are taken to be composed already."""
    c = col(c)
    for k, base in enumerate("कखगजडढफय"):  # composed letters that the normal form takes apart
        c = F.replace(c, F.lit(chr(0x0958 + k)), F.lit(base + NUKTA))
    c = F.replace(c, F.lit(VIRAMA + NUKTA), F.lit(NUKTA + VIRAMA))
    for base, whole in ("नऩ", "रऱ", "ळऴ"):
        c = F.replace(c, F.lit(base + NUKTA), F.lit(whole))
    return c


def normalized(c: Column | str) -> Column:
    """Composed, and without the dot below two letters that are often written without it."""
    c = nfc(c)
    for base in "डढ":
        c = F.replace(c, F.lit(base + NUKTA), F.lit(base))
    return c


def stripped(c: Column | str) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(col(c), rf"^{SPACES}|{SPACES}$", "")


def tokens(c: Column | str) -> Column:
    """The words of a sentence, composed; null for null. A text is composed as a whole, and only where it has Devanagari."""
    c = col(c)
    return F.array_remove(F.split(F.when(c.rlike("[\u0900-\u097f]"), nfc(c)).otherwise(c), SPACES), "")


def endings(c: Column | str, longest: Column | int, shortest: int = 0) -> Column:
    """The endings of ``shortest`` to ``longest`` characters, at most the whole word: the equi-join form of endswith."""
    c = col(c)
    top = F.least(F.lit(longest), F.length(c))
    return F.when(top >= shortest, F.transform(F.sequence(F.lit(shortest), top), lambda n: F.right(c, n)))


def beginnings(c: Column | str, longest: Column | int) -> Column:
    c = col(c)
    top = F.least(F.lit(longest), F.length(c))
    return F.when(top >= 1, F.transform(F.sequence(F.lit(1), top), lambda n: F.left(c, n)))


def restored(word: Column | str, suffix: Column | str, add: Column | str) -> Column:
    """The word without its suffix and with the lemma's own ending."""
    word, suffix = col(word), col(suffix)
    return F.concat(F.left(word, F.length(word) - F.length(suffix)), col(add))


def last_char(c: Column | str) -> Column:
    return F.right(col(c), F.lit(1))


def consonant_final(c: Column | str) -> Column:
    """Whether a word ends in none of the vowel signs and letters; false if it is empty."""
    c = col(c)
    return (F.length(c) > 0) & ~last_char(c).isin(*dict.fromkeys(tables.VOWEL_FINALS))


def as_class(points: list[int]) -> str:
    """A character class of sorted code points, as ranges."""
    ranges: list[list[int]] = []
    for p in points:
        if ranges and ranges[-1][1] == p - 1:
            ranges[-1][1] = p
        else:
            ranges.append([p, p])
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges)


@lru_cache(maxsize=1)
def marks() -> str:
    """The characters of a combining class other than 0."""
    return as_class([p for p in range(sys.maxunicode + 1) if unicodedata.combining(chr(p))])


def graphemes(c: Column | str) -> Column:
    """Characters, each with all marks of a combining class other than 0 that follow it; vowel signs have class 0 and stand alone."""
    return F.regexp_extract_all(col(c), F.lit(f"(?s).(?:(?={BEYOND})[{marks()}])*"), F.lit(0))


def reversed_graphemes(c: Column | str) -> Column:
    c = col(c)
    return F.when(c.rlike(BEYOND), F.array_join(F.reverse(graphemes(c)), "")).otherwise(F.reverse(c))


def ngrams(c: Column | str, low: int = 1, high: int = 4) -> Column:
    """All character n-grams of a lower-cased word, by length, then position."""
    c = F.lower(col(c))
    # a match ahead of every position is native work; beyond the basic plane a position may lie within a character
    plain = F.concat(*(F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in range(low, high + 1)))
    sizes = F.sequence(F.lit(low), F.least(F.lit(high), F.length(c)))
    every = F.flatten(F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substr(c, i, n))))
    return F.when(F.length(c) < low, F.array().cast("array<string>")).when(c.rlike(r"[\x{10000}-\x{10ffff}]"), every).otherwise(plain)


def feature_map(c: Column | str, strict: bool = True) -> Column:
    """``key-value|key-value`` as a map; values may hold dashes, of repeated keys the last counts.

    strict: parts are stripped, and the text ``_`` has no features.
    """
    c = col(c)
    parts = F.split(c, r"\|")
    if strict:
        parts = F.transform(parts, stripped)
    parts = F.filter(parts, lambda p: F.instr(p, "-") > 0)
    pairs = F.transform(parts, lambda p: F.struct(F.substring_index(p, "-", 1).alias("k"), F.substr(p, F.instr(p, "-") + 1).alias("v")))
    # the last of repeated keys, whatever the session's rule for repeated map keys is
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i - 1, F.lit(0))), lambda y: y.k == x.k))
    out = F.map_from_entries(last)
    empty = F.create_map().cast("map<string,string>")
    return F.when(c.isNull() | (stripped(c) == "_"), empty).otherwise(out) if strict else F.coalesce(out, empty)


def cases(c: Column, mapping: dict, default: object = None) -> Column:
    """A CASE over equal values."""
    out = None
    for k, v in mapping.items():
        out = F.when(c == k, F.lit(v)) if out is None else out.when(c == k, F.lit(v))
    return out.otherwise(F.lit(default)) if out is not None else F.lit(default)


def percent(part: Column | str, whole: Column | str) -> Column:
    """``12.3%``, or N/A of nothing."""
    part, whole = col(part), col(whole)
    return F.when(whole > 0, F.format_string("%.1f%%", 100.0 * part / whole)).otherwise("N/A")
