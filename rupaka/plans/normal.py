"""Queries over the composed normal form and clusters of all words of the documents."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import DataFrame, SparkSession, functions as F

from rupaka.functions import normal, text as x
from rupaka.plans.registry import query, table

WORDS = r"list_filter(string_split_regex(text, '[\s\x0b\x1c-\x1f\x{85}\pZ]+'), lambda t: t <> '')"

#: Marks of several classes and scripts, a vowel sign and a jamo that join what stands before them, and letters that composition replaces.
SEEDS = ["\u0301", "\u0327", "\u0323", "\u0308", "\u093c", "\u094d", "\u0345", "\u3099", "\u05bc", "\u0651", "\u0f71", "\u09be", "\u1161", "\u0958", "\u212b", "\u0302", "\u031b"]
PICK = f"[{', '.join(repr(s) for s in SEEDS)}]"

SEEDED = f"""d AS (SELECT DISTINCT unnest({WORDS}) AS w FROM documents),
s AS (SELECT w, {PICK}[1 + length(w) % {len(SEEDS)}] AS a, {PICK}[1 + unicode(w) % {len(SEEDS)}] AS b, {PICK}[1 + unicode(right(w, 1)) % {len(SEEDS)}] AS c FROM d),
seeded AS (SELECT w, left(w, 1) || a || b || c || substr(w, 2) || c || a AS word FROM s)"""


def seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct word of the documents, with marks after its first letter and at its end, chosen by its length and letters and in no order."""
    d = table(spark, sf_dir, "documents").select(F.explode(F.array_remove(F.split("text", normal.SPACES), "")).alias("w")).distinct()
    picks = F.array(*map(F.lit, SEEDS))
    pick = lambda n: F.get(picks, (n % len(SEEDS)).cast("int"))
    point = lambda c: F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("long")
    a, b, c = pick(F.length("w")), pick(point(F.left("w", F.lit(1)))), pick(point(F.right("w", F.lit(1))))
    return d.select("w", F.concat(F.left("w", F.lit(1)), a, b, c, F.substr("w", F.lit(2)), c, a).alias("word"))


@query("nfc_documents", f"WITH {SEEDED} SELECT w, nfc_normalize(word) AS composed, nfc_normalize(word) <> word AS changed FROM seeded")
def nfc_documents(spark, sf_dir):
    """The normal form of all words of the documents, seeded with marks."""
    out = normal.composed(seeded(spark, sf_dir).withColumn("composed", F.col("word")), "composed")
    return out.select("w", "composed", (F.col("composed") != F.col("word")).alias("changed"))


@query("nfc_tokens", f"WITH t AS (SELECT doc_id, {WORDS} AS ts FROM documents), u AS (SELECT doc_id, unnest(ts) AS w FROM t) SELECT doc_id, count(*)::BIGINT AS n, count(DISTINCT nfc_normalize(w))::BIGINT AS n_types FROM u GROUP BY doc_id")
def nfc_tokens(spark, sf_dir):
    """Composed words of all documents. A text's words are made distinct in its row; several texts of one id meet by their distinct words."""
    out = normal.words(table(spark, sf_dir, "documents"), "doc_id").filter(F.size("words") > 0)
    out = out.select("doc_id", F.size("words").cast("long").alias("n"), F.array_distinct("words").alias("types"))
    types = F.array_distinct(F.flatten(F.collect_list("types")))
    return out.groupBy("doc_id").agg(F.sum("n").alias("n"), F.size(types).cast("long").alias("n_types"))


#: The classes of the seeds and of what they compose to, from the character database.
CLASSES = ", ".join(f"({p}, {unicodedata.combining(chr(p))})" for p in range(sys.maxunicode + 1) if unicodedata.combining(chr(p)))


@query("clusters_documents", f"""WITH {SEEDED}, cls(p, class) AS (VALUES {CLASSES}), l AS (SELECT w, word, string_split(word, '') AS cs FROM seeded),
u AS (SELECT w, generate_subscripts(cs, 1) AS i, unnest(cs) AS c FROM l),
m AS (SELECT w, i, c, i = 1 OR class IS NULL AS first FROM u LEFT JOIN cls ON p = unicode(c)),
g AS (SELECT *, sum(first::INT) OVER (PARTITION BY w ORDER BY i) AS k FROM m)
SELECT w, count(DISTINCT k)::BIGINT AS n, string_agg(c, '' ORDER BY k DESC, i) AS turned FROM g GROUP BY w""")
def clusters_documents(spark, sf_dir):
    """Clusters of the same words: how many, and the word with their order turned round."""
    return seeded(spark, sf_dir).select("w", F.size(x.graphemes("word")).cast("long").alias("n"), x.reversed_graphemes("word").alias("turned"))
