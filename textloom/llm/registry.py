"""The queries of this subpackage and the SQL of those that SQL can say."""

from __future__ import annotations

from importlib import import_module

MODULES = ("warc", "rollup", "pieces", "fingerprint", "quality", "packing", "language", "jaccard", "licenses", "substrings")


def _gather(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        out |= getattr(import_module(f"textloom.llm.{module}"), name, {})
    return out


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("ORACLE_SQL")
