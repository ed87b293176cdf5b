"""Modules: import paths, exported symbols through re-exports, and what nobody imports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut

# fixed values: what an import without an extension may mean, in order
ENDINGS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.js")
EXTENSION = r"\.[cm]?[jt]sx?$"
#: Hops of a chain of re-exports.
DEEPEST = 16
#: The most that a symbol found by ``export *`` may claim.
STAR = 0.85


def normal(path: Column) -> Column:
    """A path without ``.``, ``..`` and empty segments."""
    # shortened once, by a variable
    return F.get(F.transform(F.array(F.regexp_replace(path, r"/(\.?/)+", "/")), _normal), F.lit(0))


def _normal(short: Column) -> Column:
    keep = F.aggregate(
        F.split(short, "/"), F.array().cast("array<string>"),
        lambda acc, s: F.when((s == "") | (s == "."), acc).when((s == "..") & (F.size(acc) > 0), F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(F.concat(acc, F.array(s))),
    )
    return F.when(~short.rlike(r"(^|/)\.{0,2}(/|$)"), short).otherwise(F.array_join(keep, "/"))


def joined(folder: Column, spec: Column) -> Column:
    return normal(F.concat_ws("/", folder, spec))


def star_match(spec: Column, pattern: str) -> Column:
    """What a pattern's ``*`` stands for in an import; the empty string without one; null if it doesn't match."""
    if "*" not in pattern:
        return F.when(spec == pattern, "")
    before, after = pattern.split("*", 1)
    fits = F.startswith(spec, F.lit(before)) & F.endswith(spec, F.lit(after)) & (F.length(spec) >= len(before) + len(after))
    return F.when(fits, spec.substr(F.lit(len(before) + 1), F.length(spec) - len(before) - len(after)))


def mapped(spec: Column, paths: dict[str, list[str]], base: str = "") -> Column:
    """Paths that configured patterns give an import, of the longest pattern first; without any pattern, below the base."""
    if not paths:
        return F.when(F.startswith(spec, F.lit(".")), F.array().cast("array<string>")).otherwise(F.array(joined(F.lit(base), spec)))
    each = []
    for pattern in sorted(paths, key=lambda p: -len(p)):
        star = star_match(spec, pattern)
        targets = F.array(*[joined(F.lit(base), F.concat(F.lit(t.split("*", 1)[0]), star, F.lit(t.split("*", 1)[1])) if "*" in t else F.lit(t)) for t in paths[pattern]])
        each.append(F.when(star.isNotNull(), targets).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.concat(*each))


def meant_by(path: Column) -> Column:
    """The paths (stem, whole, place) of imports that may mean a file, with the place of their ending; one with an extension (whole) means itself."""
    none = F.lit(None).cast("struct<stem: string, whole: boolean, place: int>")
    short = [F.when(F.endswith(path, F.lit(e)), F.struct(path.substr(F.lit(1), F.length(path) - len(e)).alias("stem"), F.lit(False).alias("whole"), F.lit(k).alias("place"))).otherwise(none) for k, e in enumerate(ENDINGS)]
    itself = F.when(path.rlike(EXTENSION), F.struct(path.alias("stem"), F.lit(True).alias("whole"), F.lit(0).alias("place"))).otherwise(none)
    return F.array_compact(F.array(itself, *short))


def resolved(imports: DataFrame, files: DataFrame, paths: dict[str, list[str]] | None = None, base: str = "") -> DataFrame:
    """Adds ``target``: the file that an import (rel_path, spec) means, or null; files: rel_path.

    Files are exploded to the paths that mean them, which meet those of imports by equality; the first one that exists counts."""
    folder = F.regexp_replace("rel_path", r"[^/]*$", "")
    local = F.array(joined(folder, F.col("spec")))
    bases = F.when(F.startswith("spec", F.lit(".")), local).otherwise(mapped(F.col("spec"), paths or {}, base) if paths is not None else F.array().cast("array<string>"))
    pairs = imports.select("rel_path", "spec").distinct()
    every = pairs.select("rel_path", "spec", F.posexplode(bases).alias("rank", "stem")).withColumn("whole", F.col("stem").rlike(EXTENSION))
    known = files.select(F.col("rel_path").alias("target")).select("target", F.inline(meant_by(F.col("target"))))
    found = every.join(known, ["stem", "whole"])
    best = found.groupBy("rel_path", "spec").agg(F.min_by("target", F.struct("rank", "place")).alias("target"))
    return imports.join(best, ["rel_path", "spec"], "left")


def export_index(exports: DataFrame) -> DataFrame:
    """The export that a name (rel_path, name) means: a local one before a default, before a re-export; with the number of local ones.

    Exports: rel_path, name, kind (local, default, re-export, star), target (file), target_name."""
    order = F.when(F.col("kind") == "local", 0).when(F.col("kind") == "default", 1).otherwise(2)
    named = exports.where("kind <> 'star'")
    best = F.min_by(F.struct("kind", "target", "target_name"), F.struct(order, F.coalesce("target", F.lit("")), F.coalesce("target_name", F.lit("")))).alias("e")
    return named.groupBy("rel_path", "name").agg(best, F.count_if(F.col("kind").isin("local", "default")).alias("locals")).select("rel_path", "name", "e.*", "locals")


def follow(requests: DataFrame, exports: DataFrame, depth: int = DEEPEST) -> DataFrame:
    """(req, rel_path, name, confidence, state): where a symbol (req, rel_path, name) is defined, through re-exports and ``export *``.

    A round moves all open requests one hop. State: found, ambiguous (two local exports of the name, or several files by
    ``export *``), circular (a file and name met again, or too deep), unresolved."""
    index = cut(export_index(exports))
    stars = exports.where("kind = 'star'").select(F.col("rel_path").alias("_file"), F.col("target").alias("_star"))
    open_ = requests.select("req", "rel_path", "name", F.lit(1.0).alias("confidence"), F.array(F.concat_ws("#", "rel_path", "name")).alias("seen"))
    ended = None
    for hop in range(depth + 1):
        at = open_.alias("o").join(index.alias("i"), ["rel_path", "name"], "left").select("o.req", "rel_path", "name", "o.confidence", "o.seen", "i.kind", "i.target", "i.target_name", "i.locals")
        at = cut(at)
        state = F.when(F.col("locals") > 1, "ambiguous").when(F.col("kind").isin("local", "default"), "found")
        done = at.where(state.isNotNull()).select("req", "rel_path", "name", "confidence", state.alias("state"))
        ended = done if ended is None else ended.union(done)
        via = at.where("kind = 're-export'").select("req", F.col("target").alias("rel_path"), F.col("target_name").alias("name"), "confidence", "seen")
        bare = at.where("kind is null and name <> 'default'")
        starred = bare.join(stars, bare.rel_path == stars._file).select("req", F.col("_star").alias("rel_path"), "name", F.least("confidence", F.lit(STAR)).alias("confidence"), "seen")
        more = cut(via.union(starred).withColumn("id", F.concat_ws("#", "rel_path", "name")))
        if more.isEmpty():
            break
        ended = ended.union(more.where(F.array_contains("seen", F.col("id")) | F.lit(hop == depth)).select("req", "rel_path", "name", F.lit(0.0).alias("confidence"), F.lit("circular").alias("state")))
        open_ = more.where(~F.array_contains("seen", F.col("id"))).select("req", "rel_path", "name", "confidence", F.concat("seen", F.array("id")).alias("seen"))
        if hop == depth or open_.isEmpty():
            break
    # of several branches a cycle counts first, then one file for all that were found
    best = F.max_by(F.struct("rel_path", "name", "confidence"), F.struct("confidence", F.col("name"))).alias("b")
    files = ended.groupBy("req").agg(best, F.countDistinct(F.when(F.col("state") == "found", F.col("rel_path"))).alias("files"), F.max(F.col("state") == "circular").alias("loop"), F.max(F.col("state") == "ambiguous").alias("twice"))
    verdict = F.when(F.col("loop"), "circular").when(F.col("twice") | (F.col("files") > 1), "ambiguous").when(F.col("files") == 1, "found").otherwise("unresolved")
    out = requests.select("req").join(files, "req", "left").withColumn("state", F.coalesce(verdict, F.lit("unresolved")))
    ok = F.col("state") == "found"
    return out.select("req", F.when(ok, F.col("b.rel_path")).alias("rel_path"), F.when(ok, F.col("b.name")).alias("name"), F.when(ok, F.col("b.confidence")).otherwise(0.0).alias("confidence"), "state")


def unused_exports(exports: DataFrame, imports: DataFrame) -> DataFrame:
    """(rel_path, name): exports that no import (target, name) names; ``*`` imports all of a file."""
    named = exports.where("kind <> 'star'").select("rel_path", "name").distinct()
    whole = imports.where("name = '*'").select(F.col("target").alias("rel_path")).distinct()
    used = imports.select(F.col("target").alias("rel_path"), "name").distinct()
    return named.join(whole, "rel_path", "left_anti").join(used, ["rel_path", "name"], "left_anti")


def extended(configs: DataFrame, depth: int = 8) -> DataFrame:
    """(rel_path, field, value): settings of configurations (rel_path, parent, fields map) with what they inherit; the nearest wins."""
    held = cut(configs.select("rel_path", "parent", "fields"))
    walk = held.select("rel_path", F.lit(0).alias("hop"), "parent", "fields")
    every, up = walk, held.select(F.col("rel_path").alias("_at"), F.col("parent").alias("_next"), F.col("fields").alias("_fields"))
    for hop in range(1, depth + 1):
        walk = cut(walk.join(up, F.col("parent") == F.col("_at")).select("rel_path", F.lit(hop).alias("hop"), F.col("_next").alias("parent"), F.col("_fields").alias("fields")))
        if walk.isEmpty():
            break
        every = every.union(walk)
    each = every.select("rel_path", "hop", F.explode("fields").alias("field", "value"))
    return each.groupBy("rel_path", "field").agg(F.min_by("value", "hop").alias("value"))


def attributed(sources: DataFrame, registrations: DataFrame) -> DataFrame:
    """Sources (rel_path, locale, namespace, confidence) with what code registers them as (rel_path, at_file, locale, namespace, confidence).

    Of several registrations the one of the source's own locale counts, else the first in order; all namespaces are kept."""
    order = Window.partitionBy("rel_path").orderBy("at_file", "namespace", F.coalesce("locale", F.lit("")))
    reg = registrations.withColumn("rel_path", F.lower("rel_path")).dropDuplicates(["rel_path", "locale", "namespace"])
    reg = reg.withColumn("_place", F.row_number().over(order)).select(F.col("rel_path").alias("_low"), F.col("locale").alias("_locale"), F.col("namespace").alias("_ns"), F.col("confidence").alias("_sure"), "_place")
    met = sources.withColumn("_low", F.lower("rel_path")).join(reg, "_low", "left")
    own = F.when(F.col("_locale") == F.col("locale"), 0).otherwise(1)
    keys = ["rel_path", "locale", "namespace", "confidence"]
    best = met.groupBy(*keys).agg(
        F.min_by(F.struct("_locale", "_ns", "_sure"), F.struct(own, "_place")).alias("r"),
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("_place", "_ns"))), lambda x: x["_ns"])).alias("all"),
    )
    hit = F.col("r._ns").isNotNull()
    return best.select(
        "rel_path", F.when(hit, F.coalesce("r._locale", "locale")).otherwise(F.col("locale")).alias("locale"), F.when(hit, F.col("r._ns")).otherwise(F.col("namespace")).alias("namespace"),
        F.when(hit & (F.size("all") > 1), F.col("all")).alias("namespaces"), F.when(hit, F.greatest("confidence", "r._sure")).otherwise(F.col("confidence")).alias("confidence"),
    )
