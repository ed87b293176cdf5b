"""Lookups of an editor: definitions, hover and completion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .matching import present


def locale_rank(preferred: list[str]) -> Column:
    """Place among the preferred locales; others after them, none last."""
    at = F.array_position(F.array(*map(F.lit, preferred)), F.col("locale")) - 1 if preferred else F.lit(-1)
    return F.when(F.coalesce("locale", F.lit("")) == "", len(preferred) + 1).when(at >= 0, at).otherwise(len(preferred))


def lookup(requests: DataFrame, definitions: DataFrame, preferred: list[str]) -> DataFrame:
    """Definitions of each request (req, key, namespace), ranked; keys without a namespace step in where the named one is unknown."""
    exact = requests.alias("r").join(
        definitions.alias("d"), (F.col("r.key") == F.col("d.key")) & F.nullif("r.namespace", F.lit("")).eqNullSafe(F.nullif("d.namespace", F.lit("")))
    ).select("r.req", "d.*")
    rest = requests.where(present().isNotNull()).join(exact.select("req").distinct(), "req", "left_anti")
    plain = definitions.where(present().isNull())
    fallback = rest.alias("r").join(plain.alias("d"), F.col("r.key") == F.col("d.key")).select("r.req", "d.*")
    rank = Window.partitionBy("req").orderBy(locale_rank(preferred), "rel_path", "line", "ord")
    return exact.union(fallback).withColumn("rank", F.row_number().over(rank))


def hover(requests: DataFrame, definitions: DataFrame, preferred: list[str]) -> DataFrame:
    """The first definition in each locale of each request, in rank order."""
    found = lookup(requests, definitions, preferred)
    return found.groupBy("req", F.coalesce("locale", F.lit("*")).alias("at_locale")).agg(F.min_by(F.struct("value", "rel_path", "line"), "rank").alias("d"), F.min("rank").alias("rank")).select(
        "req", F.col("at_locale").alias("locale"), "d.value", "d.rel_path", "d.line", F.row_number().over(Window.partitionBy("req").orderBy("rank")).alias("rank")
    )


def completions(definitions: DataFrame, prefix: str, namespaces: list[str], preferred: list[str], limit: int = 200) -> DataFrame:
    """Keys with a prefix, of the namespaces or of none: the first ``limit`` in catalog order, then sorted by label."""
    facts = definitions.where(F.col("key").startswith(prefix))
    if namespaces:
        facts = facts.where(present().isNull() | F.col("namespace").isin(*namespaces))
    best = F.min_by("value", F.struct(locale_rank(preferred), "rel_path", "line", "ord"))
    each = facts.groupBy(present().alias("namespace"), "key").agg(F.min("ord").alias("ord"), best.alias("detail"))
    return each.orderBy("ord").limit(limit).select("key", "namespace", "detail").orderBy("key", "namespace")
