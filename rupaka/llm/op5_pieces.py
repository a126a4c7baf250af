"""SentencePiece encoding and decoding: forward filtering, backward sampling over the piece lattice.

Pieces of the public vocabulary have fixed weights by their merge rank. Forward
sums over the lattice of a word give, at each end, the probabilities of the pieces
that end there; going backwards from the word's end and drawing a piece each time
samples segmentations exactly by their probability. The draws are hashes of a seed,
the row's key, the word's place and the step, so a row's segmentation does not depend
on partitions, batches or retries. Lattices are built once for the distinct words of
a batch and sampled for all its words together.

Spaces stand in the pieces; characters without a piece (line ends, a literal mark of
the vocabulary) become byte pieces. So decoding gives back every text exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from xxhash import xxh3_64_intdigest

from rupaka.llm.common import mix, MIX, released, small_batches, table
from rupaka.llm.lattice import Lattice, lattice
from rupaka.llm.op1_token_counts import MODEL, by_bytes

#: Words with the spaces before them, spaces at the end, single line ends: no piece goes past one of these.
CHUNK = re.compile(r" *[^ \n]+| +|\n")
#: Characters of a word; a longer one counts as several words, which bounds the lattice. UTF-8 bytes of the texts whose distinct words share lattices.
WIDEST, GROUP = 1024, 2 << 20
#: Weight of a character written as bytes.
BYTES = 1e-12
SEED = 5


@lru_cache(maxsize=4)
def weights(model: str, smoothing: float) -> np.ndarray:
    """Piece weights, (rank + 100) ** -smoothing, and a last 0 for what is no piece. smoothing: 0 takes all segmentations as equal, more favours few pieces."""
    lat = lattice(model)
    w = np.zeros(lat.size + 1)
    for rank, i in enumerate(sorted(lat.pieces)):
        w[i] = (rank + 100.0) ** -smoothing
    # single characters come last in the vocabulary; they count as average pieces
    middle = (len(lat.pieces) / 2 + 100.0) ** -smoothing
    for i, p in lat.pieces.items():
        if len(p) == 1:
            w[i] = max(w[i], middle)
    return w


def uniform(key: np.ndarray, step: int) -> np.ndarray:
    """A number in [0, 1) for each key and step."""
    at = np.uint64(step * int(MIX) & 0xFFFFFFFFFFFFFFFF)
    return (mix(key + at) >> np.uint64(11)).astype(float) * 2.0**-53


def _sampled(lat: Lattice, w: np.ndarray, words: list[str], word: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sampled pieces of each occurrence, one after the other, and how many each has. word: the index into words, key: the random key of each occurrence."""
    order = np.argsort(word, kind="stable")
    first = np.searchsorted(word[order], np.arange(len(words) + 1))
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    used = np.zeros(len(word), np.int64)
    for members, codes in lat.by_length(words):
        n, width = codes.shape
        alpha = [np.ones(n)]
        shape = (width, n, min(lat.longest, width))
        upto, ids = np.full(shape, 2.0), np.full(shape, -1, np.int32)
        for end, found in enumerate(lat.matched(codes), 1):
            total = np.zeros(n)
            for k, f in enumerate(found):
                if f is None:  # no piece of this length ends here in any word
                    upto[end - 1, :, k] = total
                    continue
                if k == 0:
                    f = np.where(f < 0, lat.size + codes[:, end - 1].astype(np.int64), f)
                    total = total + np.where(f < lat.size, w[np.minimum(f, lat.size)], BYTES) * alpha[-1]
                else:
                    total = total + w[f] * alpha[-1 - k]
                upto[end - 1, :, k], ids[end - 1, :, k] = total, f
            upto[end - 1, :, : len(found)] /= total[:, None]
            upto[end - 1, :, len(found) - 1] = 1.0
            alpha = [a / total for a in alpha[-lat.longest :]] + [np.ones(n)]
        mine = np.concatenate([order[first[m] : first[m + 1]] for m in members]) if n else order[:0]
        row = np.repeat(np.arange(n), first[members + 1] - first[members])
        at = np.full(len(mine), width)
        step = 0
        while len(mine):
            k = (upto[at - 1, row] <= uniform(key[mine], step)[:, None]).sum(axis=1)
            steps.append((mine, ids[at - 1, row, k]))
            used[mine] += 1
            at, step = at - k - 1, step + 1
            on = at > 0
            mine, row, at = mine[on], row[on], at[on]
    end = np.cumsum(used)
    out = np.empty(end[-1] if len(end) else 0, np.int64)
    back = end - 1
    for who, piece in steps:  # the last piece of a word was drawn first
        out[back[who]] = piece
        back[who] -= 1
    return out, used


def chunks(text: str) -> list[str]:
    """The words of a text with the spaces before them, a space put in front, none wider than WIDEST."""
    found = CHUNK.findall(" " + text) if text else []
    if found and max(map(len, found)) > WIDEST:
        found = [w[i : i + WIDEST] for w in found for i in range(0, len(w), WIDEST)]
    return found


def encode_texts(keys: list, texts: list[str], model: str = MODEL, smoothing: float = 1.0, seed: int = SEED) -> list[np.ndarray]:
    """Sampled piece ids of each text."""
    lat, w = lattice(model), weights(model, smoothing)
    split = [chunks(t) for t in texts]
    words = list(set().union(*split)) if split else []
    known = dict(zip(words, range(len(words))))
    sizes = np.array([len(s) for s in split], np.int64)
    word = np.fromiter(map(known.__getitem__, chain.from_iterable(split)), np.int64, sizes.sum())
    row = np.array([xxh3_64_intdigest(str(k), seed) for k in keys], np.uint64)
    place = np.arange(len(word)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    ids, used = _sampled(lat, w, words, word, mix(np.repeat(row, sizes) + place.astype(np.uint64) * MIX))
    bounds = np.cumsum(np.r_[0, used])[np.cumsum(np.r_[0, sizes])]
    ids, bounds = _as_bytes(lat, ids, bounds)
    return [ids[a:b].astype(np.int32) for a, b in zip(bounds[:-1], bounds[1:])]


def _as_bytes(lat: Lattice, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids from the vocabulary's size on stand for characters without a piece; they become the byte pieces of their UTF-8 form."""
    at = np.flatnonzero(ids >= lat.size)
    if not len(at):
        return ids, bounds
    char = ids[at] - lat.size
    size = 1 + (char >= 0x80) + (char >= 0x800) + (char >= 0x10000)
    repeat = np.ones(len(ids), np.int64)
    repeat[at] = size
    end = np.cumsum(np.r_[0, repeat])
    out = np.repeat(ids, repeat)
    for k in range(4):  # the k-th of n bytes holds six bits, the first what is left above its mark
        some = size > k
        n, c = size[some], char[some]
        low = (c >> (6 * (n - 1 - k))) & 0x3F | 0x80
        lead = np.where(n == 1, c, (c >> (6 * (n - 1))) | np.array([0, 0, 0xC0, 0xE0, 0xF0])[n])
        out[end[at[some]] + k] = lat.bytes_at + (lead if k == 0 else low)
    return out, end[bounds]


@lru_cache(maxsize=2)
def _piece_bytes(model: str) -> list[bytes]:
    lat = lattice(model)
    return [bytes([i - lat.bytes_at]) if lat.bytes_at <= i < lat.bytes_at + 256 else lat.pieces.get(i, "").encode() for i in range(lat.size)]


def decode_ids(ids: list[int], model: str = MODEL) -> str:
    """The text of piece ids; the space in front that encoding adds is taken off. Bytes that aren't UTF-8 become U+FFFD."""
    table_ = _piece_bytes(model)
    return b"".join(map(table_.__getitem__, ids)).decode("utf-8", "replace").removeprefix(" ")


_KEYED = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])


def _encoded(batches: Iterator[pa.RecordBatch], model: str, smoothing: float, seed: int) -> Iterator[tuple[pa.Array, pa.Array, list]]:
    """Ids, texts and sampled pieces (None for null texts) of groups of rows of about GROUP bytes, whatever the batches' sizes."""

    def group(rows: list[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array, list]]:
        table_ = pa.Table.from_batches(rows, _KEYED).combine_chunks()
        keys, texts = (table_.column(k).combine_chunks() for k in range(2))
        at = 0
        for part in by_bytes(texts, GROUP):
            ids, given = keys.slice(at, len(part)), part.to_pylist()
            at += len(part)
            found = encode_texts(ids.to_pylist(), [t or "" for t in given], model, smoothing, seed)
            yield ids, part, [None if t is None else x for t, x in zip(given, found)]

    waiting, size = [], 0
    for b in batches:
        waiting.append(pa.RecordBatch.from_arrays([b.column(n).cast(_KEYED.field(n).type) for n in _KEYED.names], schema=_KEYED))
        size += waiting[-1].nbytes
        if size >= GROUP:
            yield from group(waiting)
            waiting, size = [], 0
    if waiting:
        yield from group(waiting)


def _asked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def encode(docs: DataFrame, model: str = MODEL, smoothing: float = 1.0, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, ids (array of piece ids) for every row of docs.

    The row's key is its id: rows with equal id and text get equal pieces, equal
    texts with different ids needn't. Null texts have null ids, empty ones none. A word
    of more than WIDEST characters is sampled as several words.
    """
    schema = pa.schema([*_KEYED, ("ids", pa.list_(pa.int32()))])

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts, ids in _encoded(batches, model, smoothing, seed):
            yield pa.RecordBatch.from_arrays([keys, texts, pa.array(ids, schema.types[2])], schema=schema)

    return _asked(docs, id_col, text_col).mapInArrow(run, "doc_id long, text string, ids array<int>")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """Adds ``decoded`` to (doc_id, text, ids); null ids decode to null."""
    schema = pa.schema([*_KEYED, ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [None if not x.is_valid else decode_ids(np.asarray(x.values).tolist(), model) for x in b.column("ids")]
            yield pa.RecordBatch.from_arrays([*(b.column(c).cast(t) for c, t in zip(("doc_id", "text", "ids"), schema.types)), pa.array(text, pa.string())], schema=schema)

    return encoded.select("doc_id", "text", "ids").mapInArrow(run, "doc_id long, text string, ids array<int>, decoded string")


def round_trip(docs: DataFrame, model: str = MODEL, smoothing: float = 1.0, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, decoded, lossless (whether ids decode to the text; null if it is null): encode() and decode() in one worker, so that a text crosses once."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string()), ("lossless", pa.bool_())])

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts, ids in _encoded(batches, model, smoothing, seed):
            decoded = pa.array([None if x is None else decode_ids(x.tolist(), model) for x in ids], pa.string())
            yield pa.RecordBatch.from_arrays([keys, pa.array(ids, schema.types[1]), decoded, pc.equal(decoded, texts)], schema=schema)

    return _asked(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, decoded string, lossless boolean")


def op5_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents")).select(
        "doc_id",
        F.when(F.col("ids").isNotNull(), F.size("ids")).cast("long").alias("n_pieces"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.coalesce("lossless", F.lit(True)).alias("lossless"),
    )


QUERIES = {"op5_sampled_pieces": op5_sampled_pieces}
ORACLES: dict[str, str] = {}
