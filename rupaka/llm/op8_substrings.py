r"""Substring dedup: relative Lempel-Ziv parsing against every indexed reference block.

The reference is the corpus itself, in order of doc_id. Texts are cut by content:
of every window of ``WINDOW`` words the least of its ``GRAM``-word hashes is the
anchor, and consecutive windows with one anchor form a block. Equal passages are cut
into equal blocks wherever they stand, so one index, spread over the cluster by the
anchor, holds every reference block once, with the first document that has it and its
place there.

A document is looked up in that index: blocks that an earlier document holds as a whole
are found as a whole; in blocks whose anchor the reference has but whose whole it has
not, single windows are looked up, each in the index of such windows, so that factors end
exactly where the reference ends. Matches that go on at the same place of one reference
document are one stretch. The parse is greedy: from each place on, the longest stretch
is the next factor (reference document, offset, length), and words without a stretch
are literal. Stretches have at least ``WINDOW`` words; a factor that begins inside of one,
at the boundary of the factor before, counts with the whole stretch, so the union of all
stretches are the duplicate spans.

Exact copies, hot passages and hot documents cost rows in proportion to their
words: an anchor's blocks meet in aggregations with partial sums and in joins that
Spark can split, never as pairs. No text is compared with all others.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from rupaka.llm.common import Bitmap, Scratch, id_text, released, table, window_hashes, word_hashes, written

WINDOW, GRAM = 50, 25


def blocks_of(h: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, block hash, first window and number of windows of each block of a document's word hashes."""
    n = len(h) - window + 1
    if n <= 0:
        none = np.empty(0, np.int64)
        return none.view(np.uint64), none.view(np.uint64), none, none
    g, width = window_hashes(h, gram), window - gram + 1
    at = np.empty(n, np.int64)
    for i in range(0, n, 1 << 16):  # in parts, so that long texts take little memory
        v = np.lib.stride_tricks.sliding_window_view(g[i : min(n, i + (1 << 16)) + width - 1], width)
        at[i : i + len(v)] = v.argmin(axis=1) + np.arange(i, i + len(v))
    start = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    count = np.diff(np.r_[start, n])
    w = window_hashes(h, window)
    # the first and the last window cover the block
    block = window_hashes(np.stack([w[start], w[start + count - 1], count.astype(np.uint64)], 1).ravel(), 3)[::3]
    return g[at[start]], block, start, count


def _flat(rows: Iterator[tuple[int, list[np.ndarray]]], schema: pa.Schema, most: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Arrays of each document, with its id in front, as batches of about ``most`` rows."""
    group, size = [], 0

    def batch() -> pa.RecordBatch:
        ids = np.repeat(np.array([i for i, _ in group], np.int64), [len(a[0]) for _, a in group])
        cols = [np.concatenate([a[k] for _, a in group]) for k in range(len(group[0][1]))]
        cols = [c.view(np.int64) if c.dtype == np.uint64 else c for c in cols]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([ids, *cols], schema.types)], schema=schema)

    for i, arrays in rows:
        if len(arrays[0]):
            group.append((i, arrays))
            size += len(arrays[0])
        if size >= most:
            yield batch()
            group, size = [], 0
    if group:
        yield batch()


def reference_blocks(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, anchor, block, start, n: the blocks of (doc_id, text); start counts words, n windows."""
    schema = pa.schema([("doc_id", pa.int64()), ("anchor", pa.int64()), ("block", pa.int64()), ("start", pa.int32()), ("n", pa.int32())])

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                for i, t in zip(b.column("doc_id").to_pylist(), b.column("text")):
                    yield i, list(blocks_of(word_hashes((t.as_py() or "").encode()), window, gram))

        yield from _flat(rows(), schema)

    return docs.mapInArrow(run, "doc_id long, anchor long, block long, start int, n int")


def _windows(docs: DataFrame, window: int) -> DataFrame:
    """doc_id, anchor, hashed, start: the single windows of ``open`` (array of anchor, start, n) of (doc_id, text, open)."""
    schema = pa.schema([("doc_id", pa.int64()), ("anchor", pa.int64()), ("hashed", pa.int64()), ("start", pa.int32())])

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                for i, t, o in zip(b.column("doc_id").to_pylist(), b.column("text"), b.column("open")):
                    w = window_hashes(word_hashes((t.as_py() or "").encode()), window)
                    anchor, start, n = (np.asarray(o.values.field(k)) for k in range(3))
                    at = np.repeat(start - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                    yield i, [np.repeat(anchor, n), w[at], at.astype(np.int32)]

        yield from _flat(rows(), schema)

    return docs.mapInArrow(run, "doc_id long, anchor long, hashed long, start int")


def duplicate_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``spans``: array of (start, n, ref, ref_start), runs of n windows from word ``start`` on that the smallest document ref with them has from word ref_start on; ref < doc_id.

    Documents without such windows give no row. Ids must be unique and not null:
    rows with a null id have no place in the order, are no reference and give no spans; rows
    that share an id count as one document. Null texts and texts of fewer than
    ``window`` words have no windows.
    """
    d = id_text(docs, id_col, text_col).filter(F.col("doc_id").isNotNull())
    with Scratch(d.sparkSession) as kept:
        blocks = kept(reference_blocks(d, window, gram))
        index = blocks.groupBy("anchor", "block").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        kinds = index.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("first").alias("a_first"), F.max("last").alias("a_last")).filter("a_first < a_last")
        kinds = kept(kinds.select(F.col("anchor").alias("shared"), (F.col("kinds") > 1).alias("several")))
        index = kept(index.join(kinds, F.col("anchor") == F.col("shared")).select("anchor", "block", "first", (F.col("first") < F.col("last")).alias("again"), "several"))
        found = blocks.join(index, ["anchor", "block"]).filter("again or several")
        found = kept(found.select("doc_id", "anchor", F.col("block").alias("hashed"), "start", "n", "first", "again", "several"))
        whole = _placed(found.filter("again"), kept)
        edges = found.filter("several and doc_id = first").groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "start", "n")).alias("open"))
        edges = kept(edges.withColumnRenamed("doc_id", "e_id"))
        single = kept(_windows(d.join(edges, F.col("doc_id") == F.col("e_id")).select("doc_id", "text", "open"), window))
        firsts = single.groupBy("anchor", "hashed").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last")
        firsts = kept(firsts.select(F.col("anchor").alias("f_anchor"), F.col("hashed").alias("f_hashed"), "first"))
        hit = kept(single.join(firsts, (F.col("anchor") == F.col("f_anchor")) & (F.col("hashed") == F.col("f_hashed"))).select("doc_id", "anchor", "hashed", "start", F.lit(1).alias("n"), "first"))
        part = _placed(hit, kept)
        # written, so that what led to the spans is gone from disk before texts are shuffled again
        return written(whole.union(part).groupBy("doc_id").agg(F.collect_list(F.struct("start", "n", "ref", "ref_start")).alias("spans")))


def _placed(found: DataFrame, kept: Scratch) -> DataFrame:
    """doc_id, start, n, ref, ref_start: the rows of found (doc_id, anchor, hashed, start, n, first) in later documents, with the place that the first document has them at first."""
    places = found.filter("doc_id = first").groupBy("anchor", "hashed").agg(F.min("start").alias("ref_start"))
    places = kept(places.withColumnsRenamed({"anchor": "p_anchor", "hashed": "p_hashed"}))
    later = found.filter("first < doc_id").join(places, (F.col("anchor") == F.col("p_anchor")) & (F.col("hashed") == F.col("p_hashed")))
    return later.select("doc_id", "start", "n", F.col("first").alias("ref"), "ref_start")


def stretches(spans: list[tuple[int, int, int, int]], n_words: int, window: int) -> list[tuple[int, int, int, int]]:
    """First word, end, reference document and place there of the longest stretches of runs (start, n, ref, ref_start) of n windows that go on in one reference document, by first word."""
    out: list[tuple[int, int, int, int]] = []
    for ref, shift, start, n in sorted((ref, at - start, start, n) for start, n, ref, at in spans if start + n + window - 1 <= n_words):
        end = start + n + window - 1
        if out and out[-1][2] == ref and out[-1][3] - out[-1][0] == shift and start <= out[-1][1] - window + 1:
            out[-1] = (out[-1][0], max(end, out[-1][1]), ref, out[-1][3])
        else:
            out.append((start, end, ref, start + shift))
    return sorted(out)


def parsed(found: list[tuple[int, int, int, int]], n_words: int) -> list[tuple[int, int, int | None, int | None]]:
    """The greedy parse of a document by its stretches: (first word, end, ref, place there) of each factor, ref None for literal words. The factors cover all words in order."""
    out: list[tuple[int, int, int | None, int | None]] = []
    ahead: list[tuple[int, int, int, int]] = []
    at = k = 0
    while at < n_words:
        while k < len(found) and found[k][0] <= at:
            start, end, ref, place = found[k]
            heapq.heappush(ahead, (-end, ref, place - start, start))
            k += 1
        while ahead and -ahead[0][0] <= at:
            heapq.heappop(ahead)
        if ahead:
            end, ref, shift, _ = ahead[0]
            out.append((at, -end, ref, at + shift))
            at = -end
        else:
            end = found[k][0] if k < len(found) else n_words
            out.append((at, end, None, None))
            at = end
    return out


def covered(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int]]:
    """First word and end of the unions of stretches."""
    out: list[tuple[int, int]] = []
    for start, end, *_ in found:
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def without_spans(docs: DataFrame, spans: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one space), cut and factors, for every row of docs.

    cut: array of first word and end of each duplicate span. factors: array of (start, end,
    ref, ref_start), the whole parse; ref is the reference document, null for literal words, and
    ref_start the word there that the factor starts with. Rows that share an id should share
    their text; spans that a row's text is too short for are left out.
    """
    d = id_text(docs, id_col, text_col)
    # texts that surely have no spans pass where they are; only the others are shuffled
    marked = Bitmap(spans, "doc_id").marked(d, "doc_id")
    own = spans.select(F.col("doc_id").alias("s_id"), "spans")
    joined = marked.filter("marked").join(own, F.col("doc_id") == F.col("s_id"), "left").select("doc_id", "text", "spans")
    rows = marked.filter("not marked").select("doc_id", "text", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans")).union(joined)
    cut_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    factor = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("ref", pa.int64()), ("ref_start", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("cut", cut_type), ("factors", factor)])

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, t, s in zip(b.column("doc_id").to_pylist(), b.column("text"), b.column("spans")):
                words = (t.as_py() or "").encode().split()
                runs = list(zip(*(np.asarray(s.values.field(k)).tolist() for k in range(4)))) if s.is_valid else []
                found = stretches(runs, len(words), window)
                cut = covered(found)
                kept = [w for a, z in zip([0, *(z for _, z in cut)], [*(a for a, _ in cut), len(words)]) for w in words[a:z]]
                parse = [dict(zip(("start", "end", "ref", "ref_start"), f)) for f in parsed(found, len(words))]
                out.append((i, len(words), len(words) - len(kept), b" ".join(kept).decode(), [{"start": a, "end": z} for a, z in cut], parse))
            yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(zip(*out) if out else [[]] * 6, schema.types)], schema=schema)

    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string, cut array<struct<start:long,end:long>>, factors array<struct<start:long,end:long,ref:long,ref_start:long>>")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return without_spans(docs, duplicate_spans(docs)).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM p),
f AS (SELECT h, min(doc_id) AS first FROM h GROUP BY h),
dup AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM h JOIN f USING (h) WHERE first < doc_id),
gone AS (SELECT doc_id, list(j) AS js FROM dup GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(js), 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN js IS NULL THEN w ELSE list_filter(w, lambda x, k: NOT list_contains(js, k)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)
"""

QUERIES = {"op8_substring_dedup": op8_substring_dedup}
ORACLES = {"op8_substring_dedup": SQL}
