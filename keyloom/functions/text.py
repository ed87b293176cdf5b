"""Texts of user interfaces, confidences and keys, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as source languages understand it; for use inside a class.
WS = r"\t-\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
LETTER = r"A-Za-z\x{C0}-\x{24F}"
# fixed values: shapes that aren't prose
TECHNICAL = (
    r"^&([a-zA-Z]+|#[0-9]+|#x[0-9a-fA-F]+);$",
    r"(?i)^(https?:|mailto:|tel:|/|\./|\.\./|#|[a-z]+://)",
    r"(?i)^[A-Z0-9_.-]+\.[A-Z0-9_.-]+$",
    r"^#[0-9a-fA-F]{3,8}$",
    r"^[0-9]+([.,][0-9]+)?(px|rem|em|%|vh|vw)?$",
    r"^[A-Z][A-Z0-9_]{2,}$",
    r"^[a-z]+([A-Z][a-z0-9]+)+$",
    r"^[a-z][a-z0-9]*(-[a-z0-9]+)+$",
    r"(?i)^[A-Za-z0-9_./\\-]+\.(png|jpe?g|gif|svg|webp|ico|json|js|ts|tsx|css|scss)$",
    r"(?i)^[a-z0-9]+([._-][a-z0-9]+)+$",
)


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{WS}]+|[{WS}]+$", "")


def collapse(text: Column) -> Column:
    """White space collapsed and trimmed; null if nothing is left."""
    return F.nullif(trimmed(F.regexp_replace(text, f"[{WS}]+", " ")), F.lit(""))


def score_literal(text: Column) -> Column:
    """How likely a literal is copy for readers: null, 0.55, 0.7 or 0.85."""
    # trimmed once, by a variable: named many times it would be many times computed
    return F.get(F.transform(F.array(trimmed(text)), _score), F.lit(0))


def _score(t: Column) -> Column:
    technical = F.lit(False)
    for shape in TECHNICAL:
        technical = technical | t.rlike(shape)
    none = (F.length(t) < 2) | technical | ~t.rlike(f"[{LETTER}].*[{LETTER}]|[{LETTER}][^{LETTER}]*[{LETTER}]")
    return (
        F.when(none, F.lit(None).cast("double"))
        .when(t.rlike(f"[{WS}.!?:,]"), 0.85)
        .when(t.rlike(f"^[A-Z][a-z]+([{WS}]|$)") | (F.length(t) >= 4), 0.7)
        .otherwise(0.55)
    )


def truncate(text: Column, most: int) -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most - 1), F.lit("…")))


def round_half_up(x: Column, digits: int) -> Column:
    return F.floor(x * F.lit(float(10**digits)) + 0.5) / F.lit(float(10**digits))


def noisy_or(weight: Column) -> Column:
    """Aggregate: combined evidence of independent weights, clamped to [0, 1] and rounded to three digits."""
    return round_half_up(1 - F.product(1 - F.least(F.lit(1.0), F.greatest(F.lit(0.0), weight))), 3)


def key_path(key: Column) -> Column:
    return F.split(key, "\\.")


def coerce_severity(value: Column) -> Column:
    """error, warning, info or off of the aliases that configurations use."""
    low = F.lower(value)
    return F.when(low.isin("error", "2", "true"), "error").when(low.isin("warn", "warning", "1"), "warning").when(low == "info", "info").when(low.isin("off", "0", "false"), "off")


def string_ratio(kind: Column) -> Column:
    """Aggregate: the share of leaves that are strings; zero of none."""
    return F.coalesce(F.avg(F.when(kind == "string", 1.0).otherwise(0.0)), F.lit(0.0))
