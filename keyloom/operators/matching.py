"""Which definitions satisfy which usages, as equi-joins on (key, namespace).

A definition without a namespace matches by key alone. One with a namespace
matches a usage that resolves to it, or to another namespace it is
registered under.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class MatchOptions:
    match_namespace: bool = True
    default_ns: str | None = None
    fallback_ns: tuple[str, ...] = field(default=())
    strict_locale: bool = False
    default_locale: str | None = None
    min_confidence: float = 0.0


def present(name: str = "namespace") -> Column:
    """The namespace, with the empty string as none."""
    return F.nullif(F.col(name), F.lit(""))


def resolve_namespaces(options: MatchOptions) -> Column:
    """Namespaces that a usage may mean, in order: its own, else the default; then the fallbacks."""
    own = F.filter(F.array_distinct(F.concat(F.array("namespace"), F.coalesce("namespaces", F.array().cast("array<string>")))), lambda n: n.isNotNull() & (n != ""))
    default = F.array(F.lit(options.default_ns)) if options.default_ns else F.array().cast("array<string>")
    found = F.when(F.size(own) > 0, own).otherwise(default)
    if not options.fallback_ns:
        return found
    return F.when(F.size(found) > 0, F.array_distinct(F.concat(found, F.array(*map(F.lit, options.fallback_ns))))).otherwise(found)


def logical_key(options: MatchOptions) -> Column:
    """Locale-independent identity: namespace and key, or the key alone."""
    if not options.match_namespace:
        return F.col("key")
    return F.when(present().isNotNull(), F.concat_ws("\0", "namespace", "key")).otherwise(F.col("key"))


def full_key() -> Column:
    return F.concat_ws("::", F.coalesce("locale", F.lit("*")), F.coalesce("namespace", F.lit("*")), "key")


def confident(facts: DataFrame, options: MatchOptions) -> DataFrame:
    """Facts of at least the least confidence; a missing one counts as 1."""
    return facts.where(F.coalesce("confidence", F.lit(1.0)) >= options.min_confidence)


def in_scope(definitions: DataFrame, options: MatchOptions) -> DataFrame:
    """With a strict locale: definitions of the default locale or of none."""
    if not (options.strict_locale and options.default_locale):
        return definitions
    return definitions.where(F.coalesce("locale", F.lit("")).isin("", options.default_locale))


def probes(definitions: DataFrame) -> DataFrame:
    """(key, ns): what usages are looked up by; ns is null for definitions that match by key alone."""
    own = definitions.select("key", present().alias("ns"))
    more = definitions.where(present().isNotNull() & F.col("namespaces").isNotNull()).select("key", F.explode("namespaces").alias("ns"))
    return own.union(more.where("ns <> ''")).distinct()


def shared_origins(definitions: DataFrame) -> DataFrame:
    """(rel_path, line, column, key, siblings): sites whose key is registered under two or more namespaces."""
    site = ["rel_path", "line", "column", "key"]
    named = definitions.where(present().isNotNull())
    each = named.select(*site, F.explode(F.concat(F.array("namespace"), F.coalesce("namespaces", F.array().cast("array<string>")))).alias("ns"))
    return each.groupBy(*site).agg(F.collect_set("ns").alias("siblings")).where(F.size("siblings") >= 2)


def group_probes(definitions: DataFrame, options: MatchOptions, origins: DataFrame | None = None) -> DataFrame:
    """(ns_group, key, ns): for each logical group, all (key, ns) by which a usage counts for it; unused-only siblings included."""
    if not options.match_namespace:
        return definitions.select(F.lit(None).cast("string").alias("ns_group"), "key", F.lit(None).cast("string").alias("ns")).distinct()
    named = definitions.where(present().isNotNull())
    plain = definitions.where(present().isNull()).select(F.lit(None).cast("string").alias("ns_group"), "key", F.lit(None).cast("string").alias("ns"))
    own = named.select(F.col("namespace").alias("ns_group"), "key", F.explode(F.concat(F.array("namespace"), F.coalesce("namespaces", F.array().cast("array<string>")))).alias("ns"))
    site = ["rel_path", "line", "column", "key"]
    shared = named.select(F.col("namespace").alias("ns_group"), *site).join(shared_origins(definitions) if origins is None else origins, site).select("ns_group", "key", F.explode("siblings").alias("ns"))
    return plain.union(own).union(shared).distinct()


def used_groups(definitions: DataFrame, usages: DataFrame, options: MatchOptions, origins: DataFrame | None = None) -> DataFrame:
    """(ns_group, key) of the logical groups that some usage refers to; usages may be folded already (key, all)."""
    pairs = usages if "all" in usages.columns else usages.select("key", resolve_namespaces(options).alias("all"))
    pairs = pairs.select("key", "all").distinct()
    wanted = pairs.select("key", F.explode("all").alias("ns")).union(pairs.select("key", F.lit(None).cast("string"))).distinct()
    hit = group_probes(definitions, options, origins).alias("p").join(wanted.alias("a"), (F.col("p.key") == F.col("a.key")) & F.col("p.ns").eqNullSafe(F.col("a.ns")), "left_semi")
    return hit.select("ns_group", "key").distinct()
