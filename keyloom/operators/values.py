"""Sets of values that an expression may have: struct<values, incomplete, confidence, circular>, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import round_half_up

#: Values that a set holds at most.
MOST = 64
KIND = "struct<values:array<string>,incomplete:boolean,confidence:double,circular:boolean>"


def _round(x: Column) -> Column:
    return round_half_up(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)), 2)


def from_values(values: Column, incomplete: Column, confidence: Column, circular: Column, most: int = MOST) -> Column:
    """Distinct, sorted, without the empty string; what is over ``most`` is left out and the set is incomplete."""
    held = F.array_sort(F.array_distinct(F.filter(values, lambda x: x != "")))
    over = F.size(held) > most
    clipped = F.slice(held, 1, most)
    part = incomplete | over
    sure = F.when(over, F.least(confidence, F.lit(0.45))).otherwise(confidence)
    sure = F.when(part & (F.size(clipped) > 1), F.least(sure, F.lit(0.65))).otherwise(sure)
    return F.struct(clipped.alias("values"), part.alias("incomplete"), _round(sure).alias("confidence"), circular.alias("circular"))


def singleton(value: Column, confidence: float = 1.0) -> Column:
    return F.struct(F.array(value).alias("values"), F.lit(False).alias("incomplete"), F.lit(confidence).alias("confidence"), F.lit(False).alias("circular"))


def union(sets: Column, most: int = MOST) -> Column:
    """Of an array of sets: all values, as sure as the least sure, and 0.7 at most if there are several."""
    least = F.array_min(F.transform(sets, lambda s: s["confidence"]))
    sure = F.when(F.size(sets) > 1, F.least(least, F.lit(0.7))).otherwise(least)
    out = from_values(F.flatten(F.transform(sets, lambda s: s["values"])), F.exists(sets, lambda s: s["incomplete"]), sure, F.exists(sets, lambda s: s["circular"]), most)
    none = F.struct(F.array().cast("array<string>").alias("values"), F.lit(True).alias("incomplete"), F.lit(0.0).alias("confidence"), F.lit(False).alias("circular"))
    return F.when(F.size(sets) > 0, out).otherwise(none)


def concat(left: Column, right: Column, most: int = MOST) -> Column:
    """Each value of the left before each of the right: the first ``most`` of them, by the left first, before they are sorted."""
    product = F.size(left["values"]) * F.size(right["values"])
    each = F.slice(F.flatten(F.transform(left["values"], lambda a: F.transform(right["values"], lambda b: F.concat(a, b)))), 1, most)
    cut = product > most
    part = left["incomplete"] | right["incomplete"] | cut
    sure = F.least(left["confidence"], right["confidence"], F.lit(0.95))
    sure = F.when(part, F.least(sure, F.when(cut, 0.5).otherwise(0.75))).otherwise(sure)
    sure = F.when((F.size(left["values"]) > 1) | (F.size(right["values"]) > 1), F.least(sure, F.lit(0.8))).otherwise(sure)
    none = F.struct(F.array().cast("array<string>").alias("values"), F.lit(True).alias("incomplete"), F.lit(0.0).alias("confidence"), F.lit(False).alias("circular"))
    return F.when(product == 0, none).otherwise(from_values(each, part, sure, left["circular"] | right["circular"], most))
