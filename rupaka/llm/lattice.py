"""The piece lattice of words: which vocabulary pieces span which characters, for many words of one length at once."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from rupaka.llm.op1_token_counts import SPACE, vocabulary_path

#: Characters (in all words together) that are worked on at once.
PART = 1 << 17
STEP = np.uint64(0x9E3779B97F4A7C15)
#: Bits of a hash that its first place in the table is looked up by.
SLOT = 20
SHIFT = np.uint64(64 - SLOT)


class Lattice:
    """A public SentencePiece vocabulary. A space stands for the vocabulary's own mark, so that a literal mark in a text stays apart."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = sp.get_piece_size()
        self.bytes_at = sp.piece_to_id("<0x00>")
        if not sp.is_byte(self.bytes_at) or sp.id_to_piece(self.bytes_at + 255) != "<0xFF>":
            raise ValueError("the vocabulary has no pieces for single bytes")
        plain = [i for i in range(self.size) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.pieces = {i: sp.id_to_piece(i).replace(SPACE, " ") for i in plain}
        if any(" " in p.lstrip(" ") or "\n" in p for p in self.pieces.values()):
            raise ValueError("the vocabulary has pieces that go on past a space or a line end")
        self.longest = max(map(len, self.pieces.values()))
        ids = np.array(plain, np.int64)
        hashes = np.array([self._hash(np.array([list(map(ord, p))], np.uint64), 0, len(p))[0] for p in self.pieces.values()], np.uint64)
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("two pieces have one hash")
        # beginnings of pieces that are no pieces themselves have -1
        begun = {p[:k] for p in self.pieces.values() for k in range(1, len(p))} - set(self.pieces.values())
        more = np.array([self._hash(np.array([list(map(ord, p))], np.uint64), 0, len(p))[0] for p in begun], np.uint64)
        hashes, ids = np.concatenate([hashes, more]), np.concatenate([ids, np.full(len(more), -1)])
        order = np.argsort(hashes, kind="stable")
        # a hash's first SLOT bits lead to the first of the few that begin with them
        self.hashes, self.ids = np.append(hashes[order], np.uint64(0xFFFFFFFFFFFFFFFF)), np.append(ids[order], -1)
        starts = (self.hashes[:-1] >> SHIFT).astype(np.int64)
        self.slots = np.searchsorted(starts, np.arange(1 << SLOT)).astype(np.int32)
        self.crowd = int(np.bincount(starts).max())

    def _find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each hash its place in ``hashes`` and whether it is there."""
        at = self.slots[h >> SHIFT]
        for _ in range(self.crowd - 1):
            at = at + ((self.hashes[at] < h) & (at < len(self.hashes) - 1))
        return at, self.hashes[at] == h

    @staticmethod
    def _hash(codes: np.ndarray, start: int, n: int) -> np.ndarray:
        h = np.zeros(len(codes), np.uint64)
        for k in range(start, start + n):
            h = Lattice._next(h, codes[:, k])
        return h

    @staticmethod
    def _next(h: np.ndarray, code: np.ndarray) -> np.ndarray:
        h = (h + code + np.uint64(1)) * STEP
        return h ^ (h >> np.uint64(29))

    def matched(self, codes: np.ndarray) -> Iterator[list[np.ndarray | None]]:
        """For each end 1, 2, ... the ids of the pieces of 1, 2, ... characters that end there; -1 where there is none, None in place of nothing but -1. codes: words of one length, a row each.

        Spans that no piece begins with aren't followed any further.
        """
        n, width = codes.shape
        open_: list[tuple[np.ndarray, np.ndarray]] = []  # rows and hashes of the spans from each of the last positions
        for end in range(1, width + 1):
            code = codes[:, end - 1].astype(np.uint64)
            spans = [(rows, self._next(h, code[rows])) for rows, h in open_[-(self.longest - 1) :]] + [(np.arange(n), self._next(np.zeros(n, np.uint64), code))]
            open_, found = [], []
            for rows, h in spans:
                at, on = self._find(h)
                rows, h, ids = rows[on], h[on], self.ids[at[on]]
                open_.append((rows, h))
                whole = None
                if (ids >= 0).any() or len(spans) == len(found) + 1:
                    whole = np.full(n, -1)
                    whole[rows] = ids
                found.append(whole)
            yield found[::-1]

    def by_length(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Indexes and character codes of the words of each length, in parts of bounded size."""
        groups: dict[int, list[int]] = defaultdict(list)
        for k, w in enumerate(words):
            groups[len(w)].append(k)
        for width, members in groups.items():
            some = max(1, PART // max(1, width))
            for i in range(0, len(members), some):
                part = members[i : i + some]
                text = "".join(words[k] for k in part)
                codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(part), width)
                yield np.array(part, np.int64), codes


@lru_cache(maxsize=2)
def lattice(model: str) -> Lattice:
    return Lattice(model if "/" in model else vocabulary_path(model))
