"""The audit of a project folder, from files to reported issues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import coverage, issues, policy
from ..operators.matching import MatchOptions
from ..sources import configs, extract, project
from ..storage import cut


def facts(spark: SparkSession, root: str, ignore: list[str] | None = None, paths: dict[str, list[str]] | None = None) -> dict[str, DataFrame]:
    """definitions, usages, dynamic, literals and files of a project. Files are read and parsed once."""
    files = cut(project.scan(spark, root, ignore).where("role <> 'generated'"))
    paths = paths if paths is not None else configs.paths_of(files)
    found = cut(extract.facts(files))
    static, dynamic = extract.usages(found, files, paths)
    return {"files": files, "definitions": cut(extract.definitions(found, files, paths)), "usages": cut(static), "dynamic": cut(dynamic), "literals": cut(extract.literals(found)), "facts": found}


def check(
    spark: SparkSession, root: str, options: MatchOptions | None = None, rules: dict[str, str] | None = None, ignore: list[str] | None = None, marker: str = "keyloom",
    ignore_keys: list[str] | None = None, paths: dict[str, list[str]] | None = None, literals: bool = True, folder: str = "",
) -> DataFrame:
    """Issues of a project below ``root``; comments that begin with the marker suppress some. With a folder those of it.

    Options that aren't given are those of the project's configuration file, and of the setup of its library."""
    got = facts(spark, root, ignore, paths)
    own = configs.audit_options(got["files"])
    if options is None:
        known = configs.settings_of(configs.fragments(got["files"].where("language in ('javascript', 'typescript')")))
        options = MatchOptions(default_ns=known.default_ns, fallback_ns=known.fallback_ns, min_confidence=own.get("minConfidence", 0.0))
    rules, ignore_keys = rules or own.get("rules"), ignore_keys or own.get("ignoreKeys")
    for name in ("definitions", "usages", "dynamic", "literals"):
        got[name] = policy.filter_facts(got[name], own.get("ignoreFiles", []), own.get("exclude", []), own.get("include", []), None, None, own.get("ignoreLocales"), own.get("ignoreNamespaces"))
    found = cut(issues.analyze(got["definitions"], got["usages"], got["dynamic"], got["literals"] if literals else None, options))
    if folder:
        found = cut(issues.in_folder(found, got["definitions"], folder, options))
    found = policy.without_ignored_keys(found, ignore_keys or [])
    found = policy.suppressed(found, project.directives(got["files"], marker)).where("not suppressed").drop("suppressed")
    return issues.ordered(policy.severities(found, rules) if rules else found)


def coverage_of(spark: SparkSession, root: str, base: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(key coverage, coverage issues) of a project; the base is the one asked for, else English, else the first locale."""
    definitions = facts(spark, root)["definitions"]
    model = coverage.merged(definitions)
    locales = [r.locale for r in model.select("locale").distinct().orderBy("locale").collect()]  # as many as languages
    base = base or next((x for x in ("en", "en-US", "en-GB") if x in locales), locales[0] if locales else "en")
    covered = coverage.keys(model, base, locales if base in locales else [base, *locales])
    return covered, coverage.issues(model, covered, base)


