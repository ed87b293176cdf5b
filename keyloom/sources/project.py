"""Files of a project, and the facts in them."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import files as kinds
from ..operators import policy, settings
from . import code, extract

# fixed values: folders that are never read
SKIPPED = r"(^|/)(node_modules|dist|build|coverage|out|\.[^/]+)/"
#: Files that hold suppression comments.
CODE = r"(?i)\.([cm]?[jt]sx?|vue|svelte|astro|html)$"


def listed(spark: SparkSession, root: str, ignore: list[str] | None = None) -> DataFrame:
    """(rel_path, language, role, size, state, content) of the files below a folder. Hidden, skipped and ignored ones are left out, by the
    .gitignore files of its folders as well; too large ones are listed without their content."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = F.regexp_replace(F.lit(root.rstrip("/")), r"^[a-z]+:/+", "/")
    found = found.withColumns({"clean": F.regexp_replace("path", r"^[a-z]+:/+", "/"), "base": base}).withColumn("rel_path", F.expr("substring(clean, length(base) + 2)"))
    path = F.col("rel_path")
    kept = found.where(~F.concat(F.lit("/"), path).rlike(SKIPPED))
    rules = kept_rules(spark, root, kept)
    if rules:
        kept = kept.where(~settings.layered_ignored(path, rules))
    for pattern in ignore or []:
        kept = kept.where(~policy.glob_match(path, pattern, True))
    language = F.when(kinds.extension(path).isin("mts", "cts"), "typescript").when(kinds.extension(path) == "html", "html").when(kinds.extension(path) == "jsonc", "json").otherwise(kinds.language(path))
    limit = F.when(language.isin("json", "yaml"), kinds.LIMITS["sources"]).otherwise(kinds.LIMITS["usages"])
    state = F.when(F.col("length") > limit, "skipped-too-large").otherwise("available")
    return kept.select("rel_path", language.alias("language"), kinds.role(path).alias("role"), F.col("length").alias("size"), state.alias("state"), F.when(F.col("length") <= limit, F.col("content")).alias("content"))


def kept_rules(spark: SparkSession, root: str, kept: DataFrame) -> dict[str, list[str]]:
    """The ignore rules of the project's folders, by folder; Spark's own listing leaves such files out, so each folder is asked."""
    folders = {""}
    for r in kept.select(F.regexp_replace("rel_path", r"/?[^/]*$", "").alias("f")).distinct().collect():
        steps = r["f"].split("/") if r["f"] else []
        folders |= {"/".join(steps[: k + 1]) for k in range(len(steps))}
    jvm, conf, out = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), {}
    store = jvm.org.apache.hadoop.fs.Path(root).getFileSystem(conf)
    for folder in sorted(folders):
        at = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{folder + '/' if folder else ''}.gitignore")
        if store.exists(at):
            stream = store.open(at)
            try:
                out[folder] = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split("\n")
            finally:
                stream.close()
    return out


def links(root: str, follow: str = "never") -> list[tuple[str, str, str]]:
    """(rel_path, target, state) of the symbolic links below a local folder. States: skipped (links are never followed), escaped (the target
    lies outside the root), repeated (the target, a folder above the link or one reached before, would be read again), broken, followed.

    ``follow``: never, within-root, or follow-once, which reads no target twice."""
    base = os.path.realpath(root)
    out, seen = [], set()
    for folder, names, files in os.walk(base):
        names[:] = sorted(n for n in names if not re.search(SKIPPED, f"/{n}/"))
        for name in sorted(names + files):
            at = os.path.join(folder, name)
            if not os.path.islink(at):
                continue
            target, rel = os.path.realpath(at), os.path.relpath(at, base)
            inside = target == base or target.startswith(base + os.sep)
            if follow == "never":
                state = "skipped"
            elif not os.path.exists(at):
                state = "broken"
            elif not inside:
                state = "escaped"
            elif os.path.commonpath([target, at]) == target or (follow == "follow-once" and target in seen):
                state = "repeated"
            else:
                state = "followed"
                seen.add(target)
            out.append((rel.replace(os.sep, "/"), os.path.relpath(target, base).replace(os.sep, "/") if inside else target, state))
    return out


def scan(spark: SparkSession, root: str, ignore: list[str] | None = None) -> DataFrame:
    """(rel_path, language, role, size, text) of the files that are read; large and binary ones are left out."""
    body = F.decode("content", "UTF-8")
    found = listed(spark, root, ignore).where("state = 'available'").withColumn("text", body)
    return found.where(F.instr("text", "\0") == 0).select("rel_path", "language", "role", "size", "text")


def definitions(files: DataFrame) -> DataFrame:
    """Definition facts of the catalogs among the files."""
    return extract.definitions(extract.facts(files.where("role <> 'generated'"), kinds=extract.OF_DEFINITIONS), files)


def usages(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Static and dynamic usage facts of the code among the files."""
    return extract.usages(extract.facts(files.where("role <> 'generated'"), kinds=extract.OF_USAGES), files)


def directives(files: DataFrame, marker: str) -> DataFrame:
    return code.extract_directives(files.where(F.col("rel_path").rlike(CODE)), marker)
