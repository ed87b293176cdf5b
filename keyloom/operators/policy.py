"""What is reported: globs, ignore lists, severities, suppression comments and the exit code."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def glob_regex(pattern: str) -> str:
    """The regular expression of a glob: ``*`` and ``?`` stay inside a segment, ``**`` spans segments."""
    if pattern in ("**", "**/*"):
        return "^.*$"
    segments = pattern.split("/")
    out = []
    for i, segment in enumerate(segments):
        last = i == len(segments) - 1
        if segment == "**":
            out.append((".*" if i == 0 else "(?:/.*)?") if last else ("(?:.*/)?" if i == 0 or segments[i - 1] == "**" else "/(?:.*/)?"))
        else:
            slash = "/" if i > 0 and segments[i - 1] != "**" else ""
            out.append(slash + "".join({"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)) for c in segment))
    return f"^{''.join(out)}$"


def glob_match(value: Column, pattern: str, basename_fallback: bool = False) -> Column:
    """Whether a POSIX path or a key matches; a pattern with a wildcard and no slash may match the base name."""
    pattern = pattern.strip()
    if not pattern:
        return F.lit(False)
    path = F.regexp_replace(F.regexp_replace(value, r"\\", "/"), r"^\./", "")
    hit = path.rlike(glob_regex(pattern))
    if basename_fallback and "/" not in pattern and re.search(r"[*?]", pattern):
        hit = hit | F.substring_index(path, "/", -1).rlike(glob_regex(pattern))
    return hit


def first_glob(value: Column, patterns: list[str], basename_fallback: bool = False) -> Column:
    """The first pattern that matches, or null."""
    return F.coalesce(*[F.when(glob_match(value, p, basename_fallback), F.lit(p)) for p in patterns], F.lit(None).cast("string"))


def explain_file(value: Column, ignore: list[str], exclude: list[str], include: list[str]) -> tuple[Column, Column]:
    """(kind, pattern) that decides on a file: ignore before exclude before include; what nothing includes is left out."""
    i, e, n = (first_glob(value, ps, True) for ps in (ignore, exclude, include or ["**/*"]))
    kind = F.when(i.isNotNull(), "ignoreFiles").when(e.isNotNull(), "exclude").when(n.isNotNull(), "include").otherwise("not-included")
    return kind, F.coalesce(i, e, n)


def key_candidates(key: Column) -> Column:
    """What ignored keys are held against: the key, what follows its last colon, and the last segment of that."""
    local = F.substring_index(key, ":", -1)
    return F.array_distinct(F.array(key, local, F.substring_index(local, ".", -1)))


def ignored_key(key: Column, patterns: list[str]) -> Column:
    return F.exists(key_candidates(key), lambda k: F.coalesce(*[F.when(glob_match(k, p), F.lit(True)) for p in patterns], F.lit(False)))


def filter_facts(
    facts: DataFrame, ignore_files: list[str], exclude: list[str], include: list[str], locales: list[str] | None = None, namespaces: list[str] | None = None,
    ignore_locales: list[str] | None = None, ignore_namespaces: list[str] | None = None,
) -> DataFrame:
    """Facts of included files; rows without a locale or namespace pass those filters. Definitions, usages, dynamic usages and literals
    go through the same one: a filter on a column that they haven't got doesn't apply. Keys are never filtered here."""
    kind, _ = explain_file(F.col("rel_path"), ignore_files, exclude, include)
    out = facts.where(kind == "include")
    for name, allowed, ignored in (("locale", locales, ignore_locales), ("namespace", namespaces, ignore_namespaces)):
        if name not in facts.columns:
            continue
        if allowed:
            out = out.where((F.coalesce(F.col(name), F.lit("")) == "") | F.col(name).isin(*allowed))
        if ignored:
            out = out.where(F.col(name).isNull() | first_glob(F.col(name), ignored).isNull())
    return out


def without_ignored_keys(issues: DataFrame, patterns: list[str]) -> DataFrame:
    """Ignored keys are not reported as unused; other issues about them stay."""
    return issues.where(~((F.col("type") == "unused-key") & ignored_key(F.col("key"), patterns))) if patterns else issues


def severities(issues: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Severities by rule; ``off`` drops, and softened unused keys go one step down."""
    given = F.coalesce(*[F.when(F.col("type") == k, F.lit(v)) for k, v in rules.items()], F.col("severity"))
    soft = F.when(given == "error", "warning").otherwise("info")
    out = issues.withColumn("severity", F.when(given == "off", "off").when((F.col("type") == "unused-key") & (F.coalesce("reason", F.lit("")) == "dynamic-usage"), soft).otherwise(given))
    return out.where("severity <> 'off'")


def suppressed(issues: DataFrame, directives: DataFrame) -> DataFrame:
    """Adds ``suppressed``: the last region comment at or before the issue's line disables its rule, or a line comment ignores it.

    An as-of join without a join of all pairs: events and issues of a file and rule go through one window in the
    order of lines. Directives: rel_path, line, kind (disable, enable, ignore, ignore-next), rules (empty: all)."""
    each = directives.select("rel_path", "line", "kind", "rules")
    rules = F.array(*[F.lit(r) for r in ("missing-key", "duplicate-key", "unused-key", "untranslated-text")])
    event = each.select("rel_path", "line", "kind", F.explode(F.when(F.size("rules") == 0, rules).otherwise(F.col("rules"))).alias("type"))
    # of a line's region comments disable goes before enable, so the latter stays
    region = event.where("kind in ('disable', 'enable')").groupBy("rel_path", "type", "line").agg(F.max("kind").alias("kind"))
    # only the first comment of a kind on a line counts
    lines = each.where("kind in ('ignore', 'ignore-next')").groupBy("rel_path", "line", "kind").agg(F.min("rules").alias("rules"))
    lines = lines.select("rel_path", (F.col("line") + F.when(F.col("kind") == "ignore-next", 1).otherwise(0)).alias("line"), F.explode(F.when(F.size("rules") == 0, rules).otherwise(F.col("rules"))).alias("type"))
    lines = lines.distinct().withColumn("by_line", F.lit(True))

    from pyspark.sql import Window

    tagged = issues.select("*", F.lit(1).alias("_at"), F.lit(None).cast("string").alias("_kind"))
    marks = region.select(*[F.col(c) if c in ("rel_path", "type", "line") else F.lit(None).cast(t).alias(c) for c, t in issues.dtypes], F.lit(0).alias("_at"), F.col("kind").alias("_kind"))
    order = Window.partitionBy("rel_path", "type").orderBy("line", "_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = tagged.unionByName(marks).withColumn("_last", F.last("_kind", ignorenulls=True).over(order)).where("_at = 1").drop("_at", "_kind")
    out = seen.join(lines, ["rel_path", "line", "type"], "left")
    return out.select(*issues.columns, (F.coalesce(F.col("_last") == "disable", F.lit(False)) | F.col("by_line").isNotNull()).alias("suppressed"))


def exit_code(issues: DataFrame, missing_translations: DataFrame | None = None, exit_on_error: bool = True, fail_on_warning: bool = False) -> DataFrame:
    """One row: errors, warnings and the exit code. Translations that are missing in a locale (column missing_count of the
    coverage) count as warnings."""
    out = issues.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    if missing_translations is not None:
        lacking = missing_translations.agg(F.lit(0).cast("long").alias("errors"), F.coalesce(F.sum("missing_count"), F.lit(0)).cast("long").alias("warnings"))
        out = out.union(lacking).agg(F.sum("errors").alias("errors"), F.sum("warnings").alias("warnings"))
    bad = ((F.col("errors") > 0) & F.lit(exit_on_error)) | ((F.col("warnings") > 0) & F.lit(fail_on_warning))
    return out.withColumn("exit_code", F.when(bad, 1).otherwise(0).cast("long"))
