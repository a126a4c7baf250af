"""The queries of the corpus operators and, where SQL can express them, their DuckDB counterparts."""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "op1_token_counts",
    "op2_minhash",
    "op3_mixing",
    "op4_language",
    "op5_pieces",
    "op6_pii",
    "op7_media",
    "op8_substrings",
    "op9_topk",
    "op10_chat",
    "op11_pq",
    "op12_fim",
    "op13_phrases",
)


def _collected(what: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out |= getattr(import_module(f"rupaka.llm.{m}"), what)
    return out


def queries() -> dict:
    return _collected("QUERIES")


def oracles() -> dict:
    return _collected("ORACLES")
