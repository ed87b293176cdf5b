"""What a file is, whether it is read, and how likely it holds a catalog, as column expressions and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import locales
from .policy import glob_match

# fixed values: extensions by language, names of configuration files, folders of generated files
SCRIPTS = ("js", "jsx", "mjs", "cjs", "ts", "tsx", "mts", "cts")
DATA = ("json", "yaml", "yml")
MIXED = {"vue": "vue", "svelte": "svelte", "astro": "astro", "mdx": "markdown-mdx"}
CONFIG_NAMES = ("package.json", "tsconfig.json", "jsconfig.json", "pnpm-workspace.yaml", "lerna.json", "nx.json", "turbo.json", "angular.json")
GENERATED = ("dist", "build", "out", "coverage", "generated", ".next", ".nuxt", ".output", ".turbo")
GENERATED_PATH = r"(?i)(^|/)(\.next|\.nuxt|\.output|dist|build|out|coverage|generated|__generated__|\.turbo)(/|$)"
RESOURCE_NAME = r"(?i)(^|/)(i18n|locale|locales|messages|translations|translation)(\.[a-z0-9_-]+)?\.(json|ya?ml|jsx?|tsx?|mjs|cjs|mts|cts)$"
PUBLIC = r"(?i)(^|/)public/(locales?|messages|i18n)/"
TEST_PATH = r"(?i)(^|/)(__tests__|__mocks__|__fixtures__)(/|$)|\.(test|spec|stories)\.[cm]?[jt]sx?$"
# fixed values: the largest files that the scanner, catalogs and code readers take
LIMITS = {"scanner": 10 * 1024 * 1024, "sources": 2_000_000, "usages": 1_500_000}


def posix(path: Column) -> Column:
    """Forward slashes, without a leading ``./``."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^\./", "")


def relative(path: Column, root: str) -> Column:
    """The path below a root; null outside it."""
    path, root = posix(path), root.replace("\\", "/").rstrip("/")
    return F.when(path == root, "").when(path.startswith(root + "/"), path.substr(F.lit(len(root) + 2), F.length(path)))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """What follows the last dot of the base name, in lower case; a leading dot begins no extension."""
    base = base_name(path)
    return F.when(base.rlike(r"^.+\."), F.lower(F.substring_index(base, ".", -1))).otherwise("")


def language(path: Column) -> Column:
    ext = extension(path)
    out = F.when(ext.isin("js", "jsx", "mjs", "cjs"), "javascript").when(ext.isin("ts", "tsx"), "typescript")
    for e, name in MIXED.items():
        out = out.when(ext == e, name)
    return out.when(ext == "json", "json").when(ext.isin("yaml", "yml"), "yaml").otherwise("unknown")


def domain(path: Column) -> Column:
    """script, mixed (markup with script) or resource."""
    ext = extension(path)
    return F.when(ext.isin("js", "jsx", "mjs", "cjs", "ts", "tsx"), "script").when(ext.isin(*MIXED), "mixed").otherwise("resource")


def role(path: Column) -> Column:
    """config, generated, resource, source or unknown: the first that fits."""
    base, kind = base_name(path), language(path)
    generated = F.exists(F.split(path, "/"), lambda s: s.isin(*GENERATED))
    return (
        F.when(base.isin(*CONFIG_NAMES) | base.contains(".config.") | base.startswith("tsconfig"), "config")
        .when(generated, "generated")
        .when(kind.isin("json", "yaml"), "resource")
        .when(kind != "unknown", "source")
        .otherwise("unknown")
    )


def format_of(path: Column, guess: bool = False) -> Column:
    """The format of a catalog; a guess also knows JSON with comments, and no module variants of TypeScript."""
    low = F.lower(path)
    json = low.endswith(".json") | (low.endswith(".jsonc") if guess else F.lit(False))
    script = low.rlike(r"\.tsx?$" if guess else r"\.([cm]?ts|tsx)$")
    return F.when(json, "json").when(low.rlike(r"\.ya?ml$"), "yaml").when(script, "typescript").otherwise("javascript")


def content_state(size: Column, limit: int = LIMITS["scanner"]) -> Column:
    return F.when(size > limit, "skipped-too-large").otherwise("available")


def scan_errors(files: DataFrame, limit: int) -> DataFrame:
    """(class, n): errors of a scan by class; files: rel_path, size, and error (null, or a class that reading gave)."""
    kind = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("size") > limit, "TooLarge")
    return files.select(kind.alias("class")).where("class is not null").groupBy("class").agg(F.count("*").alias("n"))


def resolve_conflicts(files: DataFrame) -> DataFrame:
    """Adds ``state`` (kept, case-collision, duplicate-locator) and ``canonical``; files: ord, rel_path, inode, size, mtime.

    Of paths that differ by case alone the first stays. Of files of one inode with equal size and time the first
    stays; from the first that differs on, the inode says nothing, and files stay."""
    by_case = Window.partitionBy(F.lower("rel_path")).orderBy("ord")
    first = F.first("rel_path").over(by_case)
    files = files.withColumn("_first", first).withColumn("_lost", F.col("rel_path") != F.col("_first"))
    by_inode = Window.partitionBy("inode", "_lost").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    origin = F.first(F.struct("rel_path", "size", "mtime")).over(by_inode)
    differs = (F.col("size") != F.col("_origin.size")) | (F.col("mtime") != F.col("_origin.mtime"))
    files = files.withColumn("_origin", origin).withColumn("_broken", F.max(differs).over(by_inode))
    linked = F.col("inode").isNotNull() & ~F.col("_lost") & ~F.col("_broken") & (F.col("rel_path") != F.col("_origin.rel_path"))
    state = F.when(F.col("_lost"), "case-collision").when(linked, "duplicate-locator").otherwise("kept")
    canonical = F.when(F.col("_lost"), F.col("_first")).when(linked, F.col("_origin.rel_path")).otherwise(F.col("rel_path"))
    return files.withColumns({"state": state, "canonical": canonical}).drop("_first", "_lost", "_origin", "_broken")


def hard_links(files: DataFrame) -> DataFrame:
    """(inode, paths, n): inodes that two or more paths lead to."""
    found = files.where("inode is not null").groupBy("inode").agg(F.sort_array(F.collect_set("rel_path")).alias("paths"))
    return found.select("inode", "paths", F.size("paths").cast("long").alias("n")).where("n > 1")


def included(path: Column, globs: list[str]) -> Column:
    """Whether a file matches an include pattern; none means all."""
    return F.coalesce(*[F.when(glob_match(path, g), F.lit(True)) for g in globs], F.lit(False)) if globs else F.lit(True)


def may_hold(folder: Column, globs: list[str]) -> Column:
    """Whether a folder has to be entered, because an include pattern may match below it."""

    def pattern(glob: str) -> str:
        parts = glob.rstrip("/").split("/")
        deep = "**" in parts
        out = "(?:/.*)?" if deep else ""
        for part in reversed(parts[: parts.index("**")] if deep else parts):
            name = "".join({"*": "[^/]*", "?": "[^/]"}.get(c, "\\" + c if c in r".^$+{}[]()|\\" else c) for c in part)
            out = f"(?:/{name}{out})?"
        return f"^{out}$"

    if not globs:
        return F.lit(True)
    path = F.when(folder == "", "").otherwise(F.concat(F.lit("/"), folder))
    return F.coalesce(*[F.when(F.lit(True) if g.startswith("**") else path.rlike(pattern(g)), F.lit(True)) for g in globs], F.lit(False))


def catalog_score(path: Column) -> Column:
    """How much a path looks like a catalog's: null below 15, and for files that can't be one."""
    ext, base = extension(path), base_name(path)
    no = path.endswith(".d.ts") | (role(path) == "generated") | path.rlike(GENERATED_PATH) | base.isin("package.json", "tsconfig.json", "jsconfig.json")
    in_folder, data, script = path.rlike(locales.FOLDERS), ext.isin(*DATA), ext.isin(*SCRIPTS)
    stem = F.regexp_replace(base, r"(?i)\.(json|ya?ml)$", "")
    last = F.substring_index(stem, ".", -1)
    whole = locales.looks_like_locale(stem, in_folder)
    score = F.when(in_folder, 50).otherwise(0) + F.when(path.rlike(RESOURCE_NAME), 40).otherwise(0)
    score += F.when(data & whole, 35).when(data & (last != "") & locales.looks_like_locale(last, in_folder), 30).otherwise(0)
    score += F.when((score > 0) & data, 10).otherwise(0) + F.when((score > 0) & script, 5).otherwise(0)
    score = F.when((score == 0) & data & path.rlike(PUBLIC), 45).otherwise(score)
    return F.when(~no & (data | script) & (score >= 15), score)


def top_candidates(files: DataFrame, most: int) -> DataFrame:
    """(rel_path, score) of the likeliest catalogs, the best first."""
    scored = files.select("rel_path", catalog_score(F.col("rel_path")).alias("score")).where("score is not null")
    return scored.orderBy(F.desc("score"), "rel_path").limit(most)


def selected(files: DataFrame, most: int) -> DataFrame:
    """The first ``most`` files, in the order of ``ord``, that may hold usages."""
    path = F.col("rel_path")
    code = extension(path).isin(*SCRIPTS, "vue", "svelte", "astro", "html")
    return files.where(code & (role(path) != "generated") & ~path.rlike(r"(?i)(^|/)(\.next|\.nuxt|dist|build|out|coverage|generated)(/|$)")).orderBy("ord").limit(most)


def test_like(path: Column) -> Column:
    return path.rlike(TEST_PATH)


# fixed values: names of sources that tell most about a project
PRIORITY_NAMES = ("i18n.ts", "i18n.js", "i18next.ts", "i18next.js", "main.ts", "main.tsx", "main.js", "app.tsx", "app.vue", "app.ts", "index.tsx", "index.ts", "index.js", "_app.tsx", "layout.tsx")


def source_priority(path: Column) -> Column:
    """Which sources are looked at first to tell libraries."""
    return (
        F.when(F.lower(base_name(path)).isin(*PRIORITY_NAMES), 100).otherwise(0)
        + F.when(path.rlike(r"(?i)(^|/)(i18n|locale|locales|lang|messages)(/|$)"), 40).otherwise(0)
        + F.when(path.rlike(r"(?i)(^|/)(app|pages|src)(/|$)"), 10).otherwise(0)
        - F.when(path.contains("node_modules"), 1000).otherwise(0)
    )


def workspace_roots(folders: DataFrame, manifests: list[tuple[str, list[str]]]) -> DataFrame:
    """(manager, root): the packages of a workspace, by the first manifest (manager, patterns) of the fixed order that has any
    pattern; the project itself if none has. Folders: path."""
    order = ("pnpm", "npm", "lerna", "nx", "turbo")
    named = sorted((m for m in manifests if m[1]), key=lambda m: order.index(m[0]))
    if not named:
        return folders.sparkSession.createDataFrame([("unknown", "")], "manager string, root string")
    manager, patterns = named[0]
    hit = F.coalesce(*[F.when(glob_match(F.col("path"), p.replace("\\", "/").rstrip("/")), F.lit(True)) for p in patterns], F.lit(False))
    return folders.where(hit).select(F.lit(manager).alias("manager"), F.col("path").alias("root")).distinct()


def overlaid(disk: DataFrame, unsaved: DataFrame) -> DataFrame:
    """(rel_path, text): files as an editor sees them; unsaved documents win, also where there is no file."""
    top = unsaved.select("rel_path", F.col("text").alias("_new"), F.lit(True).alias("_open"))
    return disk.join(top, "rel_path", "full").select("rel_path", F.when(F.col("_open"), F.col("_new")).otherwise(F.col("text")).alias("text"))
