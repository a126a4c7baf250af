"""Token counts: batch encoding in Arrow functions that return lengths only.

A text is cut at safe boundaries, where no vocabulary piece can span the cut, so
the counts of the parts add up to the count of the whole. The first kind of
boundary is before a run of spaces; parts longer than ``LONG`` are cut again
between two characters that are adjacent in no piece. Words repeat, so the counts
of parts seen before are looked up and only new ones reach the library, in batches
of about ``BATCH`` bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from rupaka.llm.common import id_text, table

MODEL = "piece_bpe_32k.model"
#: Bytes in one call of the library; characters beyond which a part is cut again; parts remembered by one worker, and their characters at most.
BATCH, LONG, REMEMBERED, SHORT = 1 << 20, 1 << 12, 400_000, 64
SPACE = "▁"


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceCounter:
    """Counts of SentencePiece tokens, as the library's own encode() gives them."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size()) if not (self.sp.is_control(i) or self.sp.is_byte(i) or self.sp.is_unknown(i))]
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("the vocabulary has pieces that go on past a space; parts can't be cut there")
        if len(self.sp.encode("\n")) != 2:
            raise ValueError("the vocabulary joins line ends to other characters")
        self.joined = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        self.known: dict[str, int] = {"": 1}  # a lone space

    def cut(self, part: str) -> list[str]:
        """``part`` in pieces of about LONG characters, cut only between characters that no piece joins."""
        out, start, n = [], 0, len(part)
        while n - start > LONG:
            at = start + LONG
            while at < n and part[at - 1 : at + 1] in self.joined:
                at += 1
            out.append(part[start:at])
            start = at
        return [*out, part[start:]] if start < n or not out else out

    def _encode(self, parts: list[str]) -> list[int]:
        out: list[int] = []
        batch: list[str] = []
        size = 0
        for p in parts:
            batch.append(p)
            size += len(p)
            if size >= BATCH:
                out += map(len, self.sp.encode(batch, num_threads=1))
                batch, size = [], 0
        return out + list(map(len, self.sp.encode(batch, num_threads=1))) if batch else out

    def learn(self, parts: set[str]) -> None:
        new = [p for p in parts if p not in self.known]
        short = [p for p in new if len(p) <= LONG]
        self.known.update(zip(short, self._encode(short)))
        for p in (p for p in new if len(p) > LONG):
            first, *rest = self.cut(p.replace(SPACE, " "))
            # a line end in front keeps the library's own leading space off the later pieces
            self.known[p] = self._encode([first])[0] + sum(self._encode(["\n" + r for r in rest])) - 2 * len(rest)

    def counts(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text. Between calls parts of up to SHORT characters are remembered, so what a worker holds is bounded."""
        split = []
        for t in texts:
            t = (t or "").replace(SPACE, " ")
            if not t:
                split.append([])
            elif "  " in t or t[0] == " ":
                # the library puts a space in front; a run of k spaces and its word is encoded as k - 1 spaces and the word
                split.append([p[1:] for p in re.findall(" +[^ ]*|[^ ]+", " " + t)])
            else:
                split.append(t.split(" "))
        if len(self.known) > REMEMBERED:
            self.known = {"": 1}
        parts = set().union(*split)
        self.learn(parts)
        known = self.known
        out = [sum(map(known.__getitem__, parts)) for parts in split]
        for p in parts:
            if len(p) > SHORT:
                del known[p]
        return out


@lru_cache(maxsize=2)
def counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def by_bytes(texts: pa.Array, most: int = 8 << 20) -> Iterator[pa.Array]:
    """The texts in order, in groups of about ``most`` UTF-8 bytes; a longer text is a group of its own."""
    end = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64))
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(end, (end[start - 1] if start else 0) + most, "right")))
        yield texts.slice(start, stop - start)
        start = stop


def token_counts(docs: DataFrame, model: str = MODEL, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs``.

    model: a file name of the public vocabularies, or a path. Null and empty texts
    have 0 bytes and 0 tokens. Repeated rows give repeated results; other columns
    are not looked at. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model if "/" in model else vocabulary_path(model))
        for b in batches:
            texts = b.column("text")
            tokens = [n for g in by_bytes(texts) for n in count.counts(g.to_pylist())]
            sizes = pc.fill_null(pc.binary_length(texts).cast(pa.int64()), 0)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), sizes, pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


QUERIES = {"op1_token_counts": op1_token_counts}
ORACLES: dict[str, str] = {}
