"""Operators of a training-data pipeline. Nothing outside this subpackage imports it."""

from __future__ import annotations

import importlib

MODULES = ("bpe", "token_count", "exact_dedup", "simhash", "secrets", "toxicity", "token_store", "decontaminate", "warc", "suffix_dedup")


def queries() -> dict:
    return {k: f for m in MODULES for k, f in importlib.import_module(f"{__name__}.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in getattr(importlib.import_module(f"{__name__}.{m}"), "ORACLES", {}).items()}
