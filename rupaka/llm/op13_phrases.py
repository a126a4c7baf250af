r"""Phrase collocation mining over packed word ids.

1. Dictionary: words are counted per language, and each gets an 8-byte id, a seeded hash
   of language and word. Ids are verified to be unique; if two words share one, the next
   seed is tried. So texts are encoded where they stand, without a join of all words.
2. Texts are encoded; pieces break at words that are not frequent, since a frequent
   phrase holds frequent words only. Which are comes as a bitmap of a bounded size:
   words it lets through by chance only make rows that are counted and dropped.
3. Word ids of a run of words are packed into fixed-width keys of two or three 64-bit
   words, counted within the task first. A key's first word is a bijective mix of
   its ids, so keys spread evenly: ranges of it, equal in width, part the keys (no
   sampling pass), Spark sorts every range by that one long, which is its radix sort, and
   runs of equal keys are added up as they pass by.
4. Three-word keys are made only where both word pairs are frequent (a bitmap again).
5. Scores join the counts of the parts; the first phrases of a language are taken in
   salted parts, then over the parts' winners.

No text and no word leaves its task uncounted; every table between steps is written to the
shared folder. Nothing but the two bitmaps (4 to 32 MB at most) passes the driver.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from xxhash import xxh3_64_intdigest

from rupaka.llm.common import MIX, Scratch, mix, released, small_batches, table, written

#: Bytes of a text that are split at once, words that a task packs at once, distinct words it counts at once.
CHUNK, WORDS, DISTINCT = 1 << 20, 1 << 20, 1 << 18
#: Bits of a bitmap: 16 for each entry, within these bounds.
BITS = (1 << 20, 1 << 28)
#: Salted parts of a language while its first phrases are found.
PARTS = 16
UNKNOWN = "und"

#: 0xFF, which no UTF-8 text holds, ends a piece; words end at spaces. A-Z lower-cased.
SIGNS = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"\xff" * 10 + b" ")
END = re.compile(b"[ \xff]")
C1, C2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB  # the factors of mix()


def unmix(h: np.ndarray) -> np.ndarray:
    """The inverse of mix()."""
    back = lambda x, s: x ^ (x >> np.uint64(s)) ^ (x >> np.uint64(2 * s))
    h = back(h, 31) * np.uint64(pow(C2, -1, 1 << 64))
    return back(back(h, 27) * np.uint64(pow(C1, -1, 1 << 64)), 30)


def chunks(text: str | None) -> Iterator[list[bytes]]:
    r"""A text's words, and b"\xff" where a piece ends, in lists that a delimiter bounds; a long text isn't split as a whole."""
    data, at = (text or "").encode().translate(SIGNS), 0
    while at < len(data):
        end = END.search(data, at + CHUNK) if len(data) - at > CHUNK else None
        stop = end.start() if end else len(data)
        yield data[at:stop].replace(b"\xff", b" \xff ").split()
        at = stop


def ids_of(words: list[bytes], lang: str, seed: int) -> np.ndarray:
    """The ids of words of a language; 0 where a piece ends."""
    h = np.fromiter(map(partial(xxh3_64_intdigest, seed=seed), words), np.uint64, len(words))
    out = mix(h ^ np.uint64(xxh3_64_intdigest(b"\xff" + lang.encode(), seed)))
    out[h == np.uint64(xxh3_64_intdigest(b"\xff", seed))] = 0
    return out


def counted_words(docs: DataFrame, seed: int) -> DataFrame:
    """lang, word, id, n: the words of every language, counted within a task up to DISTINCT words at a time. docs: lang, text."""
    schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("id", pa.int64()), ("n", pa.int64())])

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, words in held.items():
                words.pop(b"\xff", None)
                if words:
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words)), pa.array([w.decode() for w in words]), pa.array(ids_of(list(words), lang, seed).view(np.int64)), pa.array(words.values(), pa.int64())], schema=schema)
            held.clear()

        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text")):
                for words in chunks(text.as_py()):
                    held.setdefault(lang, Counter()).update(words)
                    if sum(map(len, held.values())) > DISTINCT:
                        yield from out()
        yield from out()

    each = docs.mapInArrow(run, "lang string, word string, id long, n long")
    return each.groupBy("lang", "word", "id").agg(F.sum("n").alias("n"))


def dictionary(docs: DataFrame, kept: Scratch) -> tuple[DataFrame, int]:
    """lang, word, id, n of all words, and the seed whose ids are unique."""
    for seed in range(16):
        words = kept(counted_words(docs, seed))
        if words.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1 or id = 0").isEmpty():
            return words, seed
    raise RuntimeError("words share ids under 16 seeds")


def bitmap(keys: DataFrame, count: int, kept: Scratch) -> np.ndarray:
    """The set of the longs in ``key`` by their lowest bits, built on the cluster in buckets of 4 KB; the array is bounded by BITS."""
    bits = max(BITS[0], min(BITS[1], 1 << (16 * count).bit_length()))
    spot = F.col("key").bitwiseAND(F.lit(bits - 1)) + 1
    parts = keys.select(F.bitmap_bucket_number(spot).alias("bucket"), F.bitmap_bit_position(spot).alias("bit"))
    out = np.zeros(bits // 8, np.uint8)
    for r in kept(parts.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))).toLocalIterator():
        out[(r.bucket - 1) * 4096 : r.bucket * 4096] = np.frombuffer(r.bits, np.uint8)
    return out


def held(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    spot = keys & np.uint64(8 * len(bits) - 1)
    return (bits[spot >> np.uint64(3)] >> (spot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(mix(a) + b * MIX)


def runs(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes and how often each is there."""
    codes.sort()
    starts = np.flatnonzero(np.diff(codes, prepend=codes[:1] + np.uint64(1))) if len(codes) else np.empty(0, int)
    return codes[starts], np.diff(starts, append=len(codes))


def packed(stream: np.ndarray, size: int, words: np.ndarray, pairs: np.ndarray | None) -> tuple[list[np.ndarray], np.ndarray]:
    """The keys (64-bit words) of the n-grams of ``size`` in a stream of ids, 0 between pieces, and their counts."""
    stream = np.where(held(words, stream), stream, np.uint64(0))
    known, local = np.unique(stream, return_inverse=True)
    local, k = local.astype(np.uint64), np.uint64(len(known))
    ok = stream != 0
    fine, codes = ok[:-1] & ok[1:], local[:-1] * k + local[1:]
    if size == 3:
        both = fine.copy()
        both[fine] = held(pairs, pair_keys(stream[:-1][fine], stream[1:][fine]))
        fine, codes = both[:-1] & both[1:], codes[:-1] * k + local[2:]
    codes, n = runs(codes[fine])
    parts = []
    for _ in range(size):
        parts.insert(0, known[(codes % k).astype(np.int64)])
        codes = codes // k
    first, *rest = parts
    for x in rest:
        first = mix(first) + x * MIX
    return [mix(first), *rest], n


def unpacked(first: np.ndarray, rest: list[np.ndarray]) -> np.ndarray:
    """The first word's id, from a key."""
    out = unmix(first)
    for x in reversed(rest):
        out = unmix(out - x * MIX)
    return out


def packed_rows(docs: DataFrame, size: int, seed: int, words: np.ndarray, pairs: np.ndarray | None) -> DataFrame:
    """k1..k<size>, n: the packed n-grams of all texts, counted within a task up to WORDS words at a time."""
    spark, names = docs.sparkSession, [f"k{i + 1}" for i in range(size)]
    schema = pa.schema([(c, pa.int64()) for c in (*names, "n")])
    shared = spark.sparkContext.broadcast((words, pairs))

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []

        def out(carried: int) -> Iterator[pa.RecordBatch]:
            stream = np.concatenate(parts) if parts else np.empty(0, np.uint64)
            parts[:] = [stream[-carried:]] if carried else []
            if len(stream) >= size:
                keys, n = packed(stream, size, *shared.value)
                for i in range(0, len(n), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(k[i : i + (1 << 16)].view(np.int64)) for k in keys] + [pa.array(n[i : i + (1 << 16)].astype(np.int64))], schema=schema)

        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text")):
                parts.append(np.zeros(1, np.uint64))
                for some in chunks(text.as_py()):
                    parts.append(ids_of(some, lang, seed))
                    if sum(map(len, parts)) > WORDS:
                        yield from out(size - 1)  # the text may go on: n-grams across the cut need its last words
        yield from out(0)

    return docs.mapInArrow(run, ", ".join(f"{c} long" for c in (*names, "n")))


def counted_keys(rows: DataFrame, size: int, least: int) -> DataFrame:
    """key (its first word), id1..id<size>, n: the keys of packed rows that add up to ``least`` or more."""
    names = [f"k{i + 1}" for i in range(size)]
    schema = pa.schema([("key", pa.int64()), *((f"id{i + 1}", pa.int64()) for i in range(size)), ("n", pa.int64())])

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[np.ndarray] | None = None  # the last first-word's keys so far

        def out(cols: list[np.ndarray]) -> pa.RecordBatch:
            *keys, n = (c[cols[-1] >= least] for c in cols)
            first, *rest = (k.view(np.uint64) for k in keys)
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (first, unpacked(first, rest), *rest)] + [pa.array(n)], schema=schema)

        for b in batches:
            cols = [np.asarray(b.column(c)) for c in (*names, "n")]
            if not len(cols[0]):
                continue
            if open_ is not None:
                cols = [np.concatenate(x) for x in zip(open_, cols)]
            changed = [np.diff(c) != 0 for c in cols[:-1]]
            if (~changed[0] & np.any(changed[1:], axis=0)).any():  # keys that share their first word
                order = np.lexsort(cols[-2::-1])
                cols = [c[order] for c in cols]
                changed = [np.diff(c) != 0 for c in cols[:-1]]
            starts = np.concatenate([[0], np.flatnonzero(np.any(changed, axis=0)) + 1])
            cols = [c[starts] for c in cols[:-1]] + [np.add.reduceat(cols[-1], starts)]
            last = int(np.searchsorted(cols[0], cols[0][-1]))
            open_ = [c[last:] for c in cols]
            yield out([c[:last] for c in cols])
        if open_ is not None:
            yield out(open_)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    width = F.shiftright((F.shiftright("k1", 32) + F.lit(1 << 31)) * F.lit(n).cast("long"), 32)  # the range of k1, of n equal ones
    ranged = rows.repartitionById(n, width.cast("int")).sortWithinPartitions("k1")
    return ranged.mapInArrow(run, ", ".join(f"{f.name} long" for f in schema))


def scored(words: DataFrame, pairs: DataFrame, triples: DataFrame, share: int) -> DataFrame:
    """lang, phrase, a, l, r, score of the candidates that no longer one stands for. words: lang, word, id, n."""
    w = lambda k: words.select(F.col("id").alias(f"w{k}"), F.col("word").alias(f"word{k}"), F.col("n").alias(f"n{k}"), F.col("lang").alias(f"lang{k}"))
    p = lambda k: pairs.select(F.col("id1").alias(f"p{k}"), F.col("id2").alias(f"q{k}"), F.col("n").alias(f"pair{k}"))
    whole = lambda c: F.col(c).cast("decimal(38,0)")
    score = lambda l, r: F.call_function("div", F.lit(1_000_000).cast("decimal(38,0)") * whole("n") * whole("n"), whole(l) * whole(r))
    parts = triples.select("id1", "id2", "n").union(triples.select("id2", "id3", "n"))
    longer = parts.groupBy(F.col("id1").alias("x"), F.col("id2").alias("y")).agg(F.max("n").alias("longer"))
    two = pairs.join(longer, (F.col("id1") == F.col("x")) & (F.col("id2") == F.col("y")), "left")
    two = two.filter(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("n")))
    two = two.join(w(1), F.col("id1") == F.col("w1")).join(w(2), F.col("id2") == F.col("w2"))
    two = two.select(F.col("lang1").alias("lang"), F.concat_ws(" ", "word1", "word2").alias("phrase"), F.col("n").alias("a"), F.col("n1").alias("l"), F.col("n2").alias("r"), score("n1", "n2").alias("score"))
    three = triples.join(p(1), (F.col("id1") == F.col("p1")) & (F.col("id2") == F.col("q1"))).join(p(2), (F.col("id2") == F.col("p2")) & (F.col("id3") == F.col("q2")))
    for k in (1, 2, 3):
        three = three.join(w(k), F.col(f"id{k}") == F.col(f"w{k}"))
    cuts = F.least(*(F.struct(score(l, r).alias("score"), F.lit(k).alias("k"), F.col(l).alias("l"), F.col(r).alias("r")) for k, (l, r) in enumerate((("n1", "pair2"), ("pair1", "n3")))))
    three = three.withColumn("cut", cuts).select(F.col("lang1").alias("lang"), F.concat_ws(" ", "word1", "word2", "word3").alias("phrase"), F.col("n").alias("a"), "cut.l", "cut.r", "cut.score")
    return two.union(three)


def phrases(docs: DataFrame, least: int = 10, first: int = 2000, share: int = 50, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first phrases of two or three words.

    a, l and r are the counts of phrase, first and second part at the cut that scores
    lowest, n counts the language's words, score is floor(1,000,000 a a / (l r)), exact for
    counts below 10 ** 15. Phrases under ``least`` occurrences are no candidates; one that
    lies in a longer candidate with at least ``share`` percent of its count is dropped. Null
    texts are empty, null languages ``und``. Repeated rows count as often as they are there.
    Texts without pairs of words, and tables without rows, give none. Runs when called; the
    result is a table in the shared folder.
    """
    spark = docs.sparkSession
    small_batches(spark)
    d = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).cast("string").alias("text"))
    with Scratch(spark) as kept:
        every, seed = dictionary(d, kept)
        words = kept(every.filter(F.col("n") >= least))
        bits = bitmap(words.select(F.col("id").alias("key")), words.count(), kept)
        pairs = kept(counted_keys(packed_rows(d, 2, seed, bits, None), 2, least))
        both = bitmap(pairs.select("key"), pairs.count(), kept)
        triples = kept(counted_keys(packed_rows(d, 3, seed, bits, both), 3, least))
        best = lambda *by: Window.partitionBy(*by).orderBy(F.desc("score"), F.desc("a"), "phrase")
        found = scored(words, pairs, triples, share).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
        found = found.withColumn("rank", F.row_number().over(best("lang", "part"))).filter(F.col("rank") <= first)
        found = found.withColumn("rank", F.row_number().over(best("lang"))).filter(F.col("rank") <= first)
        totals = every.groupBy("lang").agg(F.sum("n").alias("n"))
        return written(found.join(totals, "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score")))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS p FROM d),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, 1 AS k, unnest(w) AS g FROM w
      UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w WHERE len(w) > 1
      UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM w WHERE len(w) > 2),
f AS (SELECT lang, k, g, count(*) AS f FROM g GROUP BY ALL),
t AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, g AS phrase, f AS a, string_split(g, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
cuts AS (SELECT lang, k, phrase, a, w, unnest(range(1, k)) AS cut FROM c),
s AS (SELECT c.lang, c.k, phrase, a, cut, x.f AS l, y.f AS r, ((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f))::BIGINT AS score
      FROM cuts c JOIN f x ON x.lang = c.lang AND x.g = array_to_string(w[1:cut], ' ') AND x.k = cut
                  JOIN f y ON y.lang = c.lang AND y.g = array_to_string(w[cut + 1:], ' ') AND y.k = c.k - cut),
lowest AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, k, phrase ORDER BY score, cut) = 1),
inside AS (SELECT lang, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase, a AS longer FROM c WHERE k = 3),
most AS (SELECT lang, phrase, max(longer) AS longer FROM inside GROUP BY ALL),
kept AS (SELECT l.* FROM lowest l LEFT JOIN most m ON l.k = 2 AND m.lang = l.lang AND m.phrase = l.phrase WHERE longer IS NULL OR 100 * longer < 50 * a),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT r.lang, rank, phrase, a, l, r, n, score FROM r JOIN t ON t.lang = r.lang WHERE rank <= 2000
"""

QUERIES = {"op13_phrases": op13_phrases}
ORACLES = {"op13_phrases": SQL}
