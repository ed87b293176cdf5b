"""Cross-locale coverage: the presence of every key in every compared locale.

One long table of the winning definition for each (namespace, key, locale) answers all
questions; keys meet locales by arrays of compared locales, not by a grid join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_NS = "*"


def round_half_up(x: Column, digits: int) -> Column:
    return F.floor(x * F.lit(float(10**digits)) + 0.5) / F.lit(float(10**digits))


def merged(definitions: DataFrame, min_confidence: float = 0.0) -> DataFrame:
    """The winner for each (ns, key, locale): the highest confidence, of equal ones the first in catalog order."""
    facts = definitions.where((F.col("confidence") >= min_confidence) & (F.coalesce("locale", F.lit("")) != ""))
    best = F.max_by(F.struct("rel_path", "line", "column", "confidence"), F.struct(F.col("confidence"), -F.col("ord"))).alias("d")
    return facts.groupBy(F.coalesce("namespace", F.lit(DEFAULT_NS)).alias("ns"), "key", "locale").agg(best).select("ns", "key", "locale", "d.*")


def duplicate_diagnostics(definitions: DataFrame, min_confidence: float = 0.0) -> DataFrame:
    """Definitions that meet a winner so far in another file, in catalog order."""
    facts = definitions.where((F.col("confidence") >= min_confidence) & (F.coalesce("locale", F.lit("")) != ""))
    before = Window.partitionBy(F.coalesce("namespace", F.lit(DEFAULT_NS)), "key", "locale").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    winner = F.max_by("rel_path", F.struct("confidence", -F.col("ord"))).over(before)
    found = facts.withColumn("winner", winner).where("winner is not null and winner <> rel_path")
    return found.select(
        "ord", F.concat(F.lit('Duplicate definition of "'), "key", F.lit('" for locale "'), "locale", F.lit('" in '), "winner", F.lit(" and "), "rel_path").alias("message")
    )


def keys(model: DataFrame, base: str, locales: list[str]) -> DataFrame:
    """Key coverage: present, missing and extra locales, ratio and confidence of every key in a compared locale."""
    held = model.where(F.col("locale").isin(*locales)).groupBy("ns", "key").agg(
        F.collect_set("locale").alias("present"), F.max("confidence").alias("confidence"),
        F.max_by(F.struct("rel_path", "line", "column"), F.col("locale") == base).alias("base_at"),
    )
    compared = F.array(*map(F.lit, locales))
    present = F.filter(compared, lambda x: F.array_contains("present", x))
    in_base = F.array_contains("present", base)
    missing = F.when(in_base, F.filter(compared, lambda x: ~F.array_contains("present", x))).otherwise(F.array(F.lit(base)))
    extra = F.when(in_base, F.array().cast("array<string>")).otherwise(present)
    return held.select(
        "ns", "key", in_base.alias("in_base"), present.alias("present"), missing.alias("missing"), extra.alias("extra"),
        (F.size("present") / F.lit(len(locales))).alias("coverage"),
        F.when(F.col("confidence") == 0, F.lit(1.0)).otherwise(F.col("confidence")).alias("confidence"), "base_at",
    )


def by_locale(covered: DataFrame, locales: list[str]) -> DataFrame:
    """For each compared locale: base keys present, base keys, ratio and extra keys. One row a locale."""
    each = [
        F.struct(F.lit(x).alias("locale"), F.count_if(F.col("in_base") & F.array_contains("present", x)).alias("present_count"), F.count_if(F.array_contains("extra", x)).alias("extra_count"))
        for x in locales
    ]
    one = covered.agg(F.count_if("in_base").alias("base_key_count"), F.array(*each).alias("each"))
    rows = one.select("base_key_count", F.explode("each").alias("e")).select("e.locale", "e.present_count", "base_key_count", "e.extra_count")
    ratio = F.when(F.col("base_key_count") == 0, F.lit(1.0)).otherwise(round_half_up(F.col("present_count") / F.col("base_key_count"), 4))
    return rows.withColumn("coverage", ratio)


def by_namespace(covered: DataFrame, locales: list[str]) -> DataFrame:
    n = len(locales)
    out = covered.groupBy("ns").agg(
        F.count("*").alias("key_count"), F.count_if(F.col("in_base") & (F.size("missing") > 0)).alias("missing_count"), F.count_if(~F.col("in_base")).alias("extra_count"),
        F.count_if("in_base").alias("base"), F.sum(F.when(F.col("in_base"), F.size("present")).otherwise(0)).alias("cells"),
    )
    ratio = F.when(F.col("base") == 0, F.lit(1.0)).otherwise(round_half_up(F.col("cells") / (F.col("base") * n), 4))
    return out.select(F.when(F.col("ns") == DEFAULT_NS, "(default)").otherwise(F.col("ns")).alias("namespace"), "key_count", "missing_count", "extra_count", ratio.alias("coverage"))


def overall(covered: DataFrame, locales: list[str]) -> DataFrame:
    n = len(locales)
    out = covered.agg(
        F.count("*").alias("total_keys"), F.count_if(F.col("in_base") & (F.size("missing") > 0)).alias("missing_count"), F.count_if(~F.col("in_base")).alias("extra_count"),
        F.count_if("in_base").alias("base"), F.coalesce(F.sum(F.when(F.col("in_base"), F.size("present")).otherwise(0)), F.lit(0)).alias("cells"),
    )
    percent = F.when(F.col("base") == 0, F.lit(100.0)).otherwise(round_half_up(F.col("cells") / (F.col("base") * n) * 100, 2))
    return out.select("total_keys", F.lit(n).cast("long").alias("compared_locales"), "missing_count", "extra_count", percent.alias("coverage_percent"))


def issues(model: DataFrame, covered: DataFrame, base: str) -> DataFrame:
    """One row for each key and locale that lacks it, and for each key and locale that has it while the base has not."""
    ns = F.when(F.col("ns") == DEFAULT_NS, F.lit(None)).otherwise(F.col("ns"))
    lacking = covered.where("in_base").select("ns", "key", F.explode("missing").alias("locale"), "base_at", "confidence")
    quoted = lambda label: F.when(F.col("ns") != DEFAULT_NS, F.concat(F.lit(f'{label}(namespace "' if label == " " else f'{label} "'), "ns", F.lit('")' if label == " " else '"'))).otherwise("")
    a = lacking.select(
        F.lit("missing-translation").alias("type"), "key", "locale", ns.alias("namespace"), F.col("base_at.rel_path").alias("rel_path"), F.col("base_at.line").alias("line"), "confidence",
        F.concat(F.lit('Add key "'), "key", F.lit('"'), quoted(" "), F.lit(' to locale "'), "locale", F.lit('" (defined in '), F.col("base_at.rel_path"), F.lit(")")).alias("suggestion"),
    )
    more = covered.where("not in_base").select("ns", "key", F.explode("extra").alias("locale"), "confidence")
    at = model.select("ns", "key", "locale", "rel_path", "line")
    b = more.join(at, ["ns", "key", "locale"]).select(
        F.lit("extra-translation").alias("type"), "key", "locale", ns.alias("namespace"), "rel_path", "line", "confidence",
        F.concat(F.lit('Remove key "'), "key", F.lit('"'), quoted(" in namespace"), F.lit(f' or add it to base locale "{base}"')).alias("suggestion"),
    )
    return a.union(b)


def key_tree(model: DataFrame) -> DataFrame:
    """(ns, path, depth, is_leaf, leaf_count): every prefix of every key, cut at dots."""
    parts = model.select("ns", "key").distinct().withColumn("parts", F.split("key", "\\."))
    nodes = parts.select("ns", "key", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("depth"), "parts")
    nodes = nodes.withColumn("path", F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "."))
    return nodes.groupBy("ns", "path", "depth").agg(F.max(F.col("depth") == F.size("parts")).alias("is_leaf"), F.count("*").alias("leaf_count"))


def complete(covered: DataFrame) -> DataFrame:
    """(ns, key) of the keys that every compared locale has."""
    return covered.where("coverage = 1").select("ns", "key")


def merged_catalogs(parts: list[DataFrame], min_confidence: float = 0.0) -> DataFrame:
    """The winners over the catalogs of several packages; each package's order follows that of the ones before it."""
    out = None
    for k, part in enumerate(parts):
        part = part.withColumn("ord", F.struct(F.lit(k).alias("package"), F.col("ord").alias("ord")))
        out = part if out is None else out.unionByName(part)
    facts = out.where((F.col("confidence") >= min_confidence) & (F.coalesce("locale", F.lit("")) != ""))
    best = F.max_by(F.struct("rel_path", "line", "column", "confidence"), F.struct("confidence", (-F.col("ord.package")).alias("p"), (-F.col("ord.ord")).alias("o"))).alias("d")
    return facts.groupBy(F.coalesce("namespace", F.lit(DEFAULT_NS)).alias("ns"), "key", "locale").agg(best).select("ns", "key", "locale", "d.*")


def distinct_sources(definitions: DataFrame) -> DataFrame:
    """(locale, namespace, print, rel_path, copies): sources of one locale and namespace that hold the same keys are one; the
    first path stands for them."""
    keys = F.md5(F.array_join(F.array_sort(F.collect_list("key")), ",")).alias("print")
    each = definitions.groupBy("rel_path", F.coalesce("locale", F.lit("*")).alias("locale"), F.coalesce("namespace", F.lit("*")).alias("namespace")).agg(keys)
    return each.groupBy("locale", "namespace", "print").agg(F.min("rel_path").alias("rel_path"), F.count("*").alias("copies"))
