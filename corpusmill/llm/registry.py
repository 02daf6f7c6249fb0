"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from corpusmill.llm import bpe, chat, mixing, neardup, pii, quality, secrets, sharding, topk, urls

MODULES = (neardup, quality, urls, sharding, bpe, secrets, chat, topk, mixing, pii)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLES.items()}
