"""Operators for building training corpora. Nothing else in the library imports this subpackage.

registry() gathers the queries and the SQL of its modules.
"""

from __future__ import annotations

from importlib import import_module

MODULES = ("toxicity", "bpe_codec", "quality_rank", "mixing", "jaccard_join", "license_scan", "quality_rules", "warc", "token_counts", "bm25", "byte_bpe", "spelling", "versions")


def registry() -> tuple[dict, dict]:
    queries, sql = {}, {}
    for name in MODULES:
        module = import_module(f"{__name__}.{name}")
        queries |= module.QUERIES
        sql |= module.SQL
    return queries, sql
