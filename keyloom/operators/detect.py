"""Which libraries, frameworks and package managers a project uses, by evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import noisy_or, round_half_up

# fixed values: (weaker, stronger, the stronger's least confidence, the most the weaker may keep)
LIBRARY_RULES = (("i18next", ("react-i18next", "next-i18next"), 0.45, 0.45), ("formatjs", ("react-intl",), 0.45, 0.4), ("vue-i18n", ("nuxt-i18n",), 0.45, 0.45))
FRAMEWORK_RULES = (("react", ("nextjs", "expo", "cra", "react-native"), 0.5, 0.55), ("react-native", ("expo",), 0.5, 0.5), ("vue", ("nuxt",), 0.5, 0.5))
# fixed values: lock files of package managers with their weights, and other files that hint at them
LOCK_FILES = {"package-lock.json": ("npm", 0.9), "npm-shrinkwrap.json": ("npm", 0.9), "pnpm-lock.yaml": ("pnpm", 0.95), "yarn.lock": ("yarn", 0.95), "bun.lockb": ("bun", 0.95), "bun.lock": ("bun", 0.95)}
HINT_FILES = {"pnpm-workspace.yaml": ("pnpm", 0.95), ".yarnrc.yml": ("yarn", 0.95), "bunfig.toml": ("bun", 0.95)}
HINT_SHARE, FIELD_WEIGHT = 0.45, 0.75


def scored(evidence: DataFrame) -> DataFrame:
    """(project, id, confidence) of evidence (project, id, weight)."""
    return evidence.groupBy("project", "id").agg(noisy_or(F.col("weight")).alias("confidence"))


def demoted(items: DataFrame, rules: tuple) -> DataFrame:
    """What underlies something stronger in the same project is capped; items: project, id, confidence."""
    held = F.map_from_entries(F.collect_list(F.struct("id", "confidence")).over(Window.partitionBy("project")))  # as many as libraries
    out, cap = items.withColumn("_all", held), F.lit(1.0)
    for weak, strong, least, most in rules:
        over = F.greatest(*[F.coalesce(F.try_element_at("_all", F.lit(s)), F.lit(0.0)) for s in strong], F.lit(0.0)) >= least
        cap = F.when((F.col("id") == weak) & over, most).otherwise(cap)
    return out.withColumn("confidence", F.least("confidence", cap)).drop("_all")


def primary(items: DataFrame) -> DataFrame:
    """(project, id, confidence) of the surest of each project; of equally sure ones the first by name."""
    rank = Window.partitionBy("project").orderBy(F.desc("confidence"), "id")
    return items.withColumn("_rank", F.row_number().over(rank)).where("_rank = 1").drop("_rank")


def package_managers(files: DataFrame, manifests: DataFrame) -> DataFrame:
    """(project, id, confidence): by files (project, name) and the manager field of manifests (project, package_manager)."""
    weight = F.lit(None).cast("double")
    manager = F.lit(None).cast("string")
    for name, (m, w) in {**LOCK_FILES, **{k: (m, w * HINT_SHARE) for k, (m, w) in HINT_FILES.items()}}.items():
        weight = F.when(F.col("name") == name, w).otherwise(weight)
        manager = F.when(F.col("name") == name, m).otherwise(manager)
    by_file = files.select("project", "name").distinct().select("project", manager.alias("id"), weight.alias("weight")).where("id is not null")
    field = F.lower(F.substring_index("package_manager", "@", 1))
    by_field = manifests.select("project", field.alias("id"), F.lit(FIELD_WEIGHT).alias("weight")).where(F.col("id").isin("npm", "pnpm", "yarn", "bun"))
    return scored(by_file.union(by_field))


def languages(files: DataFrame) -> DataFrame:
    """(project, id, confidence): a language is as sure as its share of a project's script files; files: project, language."""
    held = files.where(F.col("language").isin("javascript", "typescript", "vue", "svelte", "astro")).groupBy("project", "language").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("project"))
    return held.select("project", F.col("language").alias("id"), round_half_up(0.5 + share / 2, 3).alias("confidence"))
