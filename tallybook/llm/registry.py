"""The queries of this subpackage and their SQL, gathered for the entry module."""

from __future__ import annotations

from tallybook.llm import bpe, codes, language, licenses, matroska, minhash, mixing, neighbours, quality, sharding, spelling, suffixes, toxicity

_MODULES = [minhash, language, matroska, bpe, neighbours, sharding, suffixes, toxicity, quality, mixing, licenses, codes, spelling]


def queries() -> dict:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for module in _MODULES for name, sql in getattr(module, "ORACLES", {}).items()}
