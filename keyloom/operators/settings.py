"""Settings merged from fragments, ignore rules in order, and bindings in scope."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .policy import glob_regex


def merge(fragments: DataFrame) -> DataFrame:
    """(field, value, source, conflicts): the value of the highest priority for each field, of equal ones the first;
    fragments: field, value, source, priority, ord. Conflicts are the other values that were given."""
    best = F.max_by(F.struct("value", "source"), F.struct("priority", -F.col("ord"))).alias("w")
    held = fragments.where("value is not null").groupBy("field").agg(best, F.collect_set("value").alias("all"))
    return held.select("field", "w.value", "w.source", (F.size("all") - 1).cast("long").alias("conflicts"))


def merge_lists(fragments: DataFrame) -> DataFrame:
    """(field, values, only_first, only_second): list settings united, in the order of their fragments from the highest priority;
    and what only one of the first two lists holds, which is a conflict. Fragments: field, values, priority, ord."""
    ranked = fragments.where(F.size("values") > 0).groupBy("field").agg(F.array_sort(F.collect_list(F.struct((-F.col("priority")).alias("p"), "ord", "values"))).alias("all"))
    lists = F.transform("all", lambda x: x["values"])
    first, second = F.get(lists, F.lit(0)), F.get(lists, F.lit(1))
    apart = lambda a, b: F.when(F.size("all") > 1, F.array_except(a, b)).otherwise(F.array().cast("array<string>"))
    return ranked.select("field", F.array_distinct(F.flatten(lists)).alias("values"), apart(first, second).alias("only_first"), apart(second, first).alias("only_second"))


# fixed values: kinds of sources of settings, from the weakest, and names of configuration files
SOURCES = ("defaults", "package-json", "config-file", "package-config", "cli")


def override(fragments: DataFrame) -> DataFrame:
    """(field, value, source): a later kind of source overrides an earlier one, whole lists included; of one kind package.json gives way
    to a file of its own, else the last path counts. Fragments: field, value, source, path."""
    rank = F.array_position(F.array(*map(F.lit, SOURCES)), F.col("source"))
    own = F.when(F.substring_index(F.coalesce("path", F.lit("")), "/", -1) == "package.json", 0).otherwise(1)
    best = F.max_by(F.struct("value", "source"), F.struct(rank, own, F.coalesce("path", F.lit("")))).alias("w")
    return fragments.where("value is not null").groupBy("field").agg(best).select("field", "w.value", "w.source")


def ignore_verdict(path: Column, rules: list[str]) -> Column:
    """What ignore rules in order say of a path: the last rule that matches it or a folder above it decides; null if none does."""
    out = F.lit(None).cast("boolean")
    for rule in rules:
        rule = rule.strip()
        if not rule or rule.startswith("#"):
            continue
        keep, rule = rule.startswith("!"), rule.removeprefix("!")
        folder, rule = rule.endswith("/"), rule.rstrip("/")
        anchored = "/" in rule
        body = glob_regex(rule.removeprefix("/"))[1:-1]
        pattern = ("^" if anchored else "^(?:.*/)?") + body + ("/" if folder else "(?:/|$)")
        out = F.when(path.rlike(pattern), F.lit(not keep)).otherwise(out)
    return out


def gitignored(path: Column, rules: list[str]) -> Column:
    """Whether ignore rules in order leave a path out."""
    return F.coalesce(ignore_verdict(path, rules), F.lit(False))


def layered_ignored(path: Column, layers: dict[str, list[str]]) -> Column:
    """Whether the ignore rules of folders leave a path out: those of the nearest folder that say anything decide. Layers: rules by
    folder, the empty one for the root."""
    verdicts = []
    for folder in sorted(layers, key=lambda f: -len(f.split("/")) if f else 0):
        below = path if not folder else path.substr(F.lit(len(folder) + 2), F.length(path))
        inside = F.lit(True) if not folder else F.startswith(path, F.lit(folder + "/"))
        verdicts.append(F.when(inside, ignore_verdict(below, layers[folder])))
    return F.coalesce(*verdicts, F.lit(False))


def split_inline(key: Column) -> tuple[Column, Column]:
    """(namespace, key) of ``ns:key`` in code; addresses and times are keys as they are. (``resolve.inline_namespace`` is
    that of the settings, with a separator of their own.)"""
    inline = key.rlike(r"(?s)^[^:]+:.+$") & ~key.contains("://") & ~key.rlike(r"^[0-9]+:[0-9]+")
    return F.when(inline, F.substring_index(key, ":", 1)), F.when(inline, F.regexp_replace(key, "^[^:]*:", "")).otherwise(key)


def binding_at(uses: DataFrame, bindings: DataFrame) -> DataFrame:
    """Each use (use_id, file, name, pos) with the latest binding (binding_id, file, name, decl_pos, scope_end) whose scope holds it.

    Uses and bindings of a name in a file go through one sweep in the order of positions, with a stack of open scopes: each is seen
    once, and no pairs are made."""
    none = F.lit(None).cast("long")
    b = bindings.select("file", "name", F.col("decl_pos").cast("long").alias("at"), F.lit(0).alias("role"), F.col("binding_id").cast("long").alias("id"), F.col("scope_end").cast("long").alias("until"))
    u = uses.select("file", "name", F.col("pos").cast("long").alias("at"), F.lit(1).alias("role"), F.col("use_id").cast("long").alias("id"), none.alias("until"))
    dealt = b.union(u).repartition("file", "name").sortWithinPartitions("file", "name", "at", "role", "id")

    def sweep(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, open_ = None, []
        for part in parts:
            out = []
            for file, name, at, role, i, until in zip(*(part[c].tolist() for c in ("file", "name", "at", "role", "id", "until"))):
                if (file, name) != last:
                    last, open_ = (file, name), []
                if not role:
                    open_.append((i, until))
                    continue
                while open_ and open_[-1][1] < at:
                    open_.pop()  # positions only grow: it holds no later use either
                out.append((i, open_[-1][0] if open_ else None))
            yield pd.DataFrame(out, columns=["use_id", "binding_id"]).astype({"use_id": "int64", "binding_id": "Int64"})

    return dealt.mapInPandas(sweep, "use_id bigint, binding_id bigint")
