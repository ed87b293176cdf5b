"""Registered queries of the localization engine."""

from . import audit, engine, library, texts

FLAGSHIP = "O01_all_issues"
_MODULES = (engine, library, audit, texts)


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.ORACLES.items()}
