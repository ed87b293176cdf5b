"""Suppression comments in source code."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

_TOKEN = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|<!--.*?(?:-->|\Z)|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`""", re.S)
# fixed values: rules, and other names for them
_RULES = ("missing-key", "unused-key", "duplicate-key", "untranslated-text")
_RULE_NAMES = {
    "unusedKey": "unused-key", "missingKey": "missing-key", "duplicateKey": "duplicate-key", "untranslatedText": "untranslated-text", "untranslated": "untranslated-text",
    "hardcoded": "untranslated-text", "unused": "unused-key", "missing": "missing-key", "duplicate": "duplicate-key",
}


def directives(text: str, marker: str) -> Iterator[tuple[int, str, list[str]]]:
    """(line, kind, rules) of the suppression comments of a file; strings don't count. Unknown rules are left out; a comment that
    names nothing else does nothing."""
    comments = "".join(m[0] if m[0][:2] in ("//", "/*", "<!") else re.sub(r"[^\n]", " ", m[0]) for m in re.finditer(rf"{_TOKEN.pattern}|[^\"'`/<]+|.", text, re.S))
    for m in re.finditer(rf"{re.escape(marker)}-(ignore-next-line|ignore|disable|enable)\b([^*\n]*)", comments):
        given = [r for r in re.split(r"[\s,]+", m[2].replace("-->", " ").split("--")[0].strip()) if r]
        rules = [r for r in (_RULE_NAMES.get(g, g) for g in given) if r in _RULES]
        if rules or not given:
            yield comments.count("\n", 0, m.start()) + 1, {"ignore-next-line": "ignore-next"}.get(m[1], m[1]), list(dict.fromkeys(rules))


def extract_directives(files: DataFrame, marker: str) -> DataFrame:
    """Suppression comments of files (rel_path, text), as ``policy.suppressed`` takes them."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(p, *d) for p, t in zip(part["rel_path"], part["text"]) for d in directives(t or "", marker)]
            yield pd.DataFrame(rows, columns=["rel_path", "line", "kind", "rules"])

    return files.select("rel_path", "text").mapInPandas(run, "rel_path string, line bigint, kind string, rules array<string>")
