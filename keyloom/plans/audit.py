"""Queries of files, settings, resolvers, modules, reports and the editor, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import locales, text
from ..operators import coverage, detect, editor, files, graph, issues, matching, modules, policy, resolve, settings, values
from ..sources import sinks
from ..streaming import edits
from . import engine, facts
from .library import _PATHS, _in, _looks, _paths, _sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_BASE, _EXT = "regexp_replace(path, '^.*/', '')", "lower(regexp_extract(regexp_replace(path, '^.*/', ''), '^.+\\.([^.]*)$', 1))"
_LANGUAGE = f"""CASE WHEN {_EXT} IN ('js', 'jsx', 'mjs', 'cjs') THEN 'javascript' WHEN {_EXT} IN ('ts', 'tsx') THEN 'typescript' WHEN {_EXT} IN ('vue', 'svelte', 'astro') THEN {_EXT}
  WHEN {_EXT} = 'mdx' THEN 'markdown-mdx' WHEN {_EXT} = 'json' THEN 'json' WHEN {_EXT} IN ('yaml', 'yml') THEN 'yaml' ELSE 'unknown' END"""
_TREE = (
    """WITH t AS (SELECT p_partkey AS ord, CASE p_partkey % 9 WHEN 0 THEN 'dist/' WHEN 1 THEN 'src/locales/' WHEN 2 THEN 'public/messages/' WHEN 3 THEN 'apps/web/' WHEN 4 THEN 'src/__tests__/' WHEN 5 THEN '.next/x/' ELSE 'src/' END
  || (['en', 'i18n', 'tsconfig.base', 'Menu', 'home.de', 'vite.config', 'types.d', '.hidden', 'package'])[(p_partkey % 9 + p_size) % 9 + 1] || '.' || (['json', 'ts', 'tsx', 'yml', 'vue', 'js', 'mdx', 'html', 'txt', 'YAML'])[p_size % 10 + 1] AS path, p_size AS size FROM part) """
)


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ord, rel_path, size): paths of a project, from ``part``."""
    folder = "case p_partkey % 9 when 0 then 'dist/' when 1 then 'src/locales/' when 2 then 'public/messages/' when 3 then 'apps/web/' when 4 then 'src/__tests__/' when 5 then '.next/x/' else 'src/' end"
    stem = "element_at(array('en', 'i18n', 'tsconfig.base', 'Menu', 'home.de', 'vite.config', 'types.d', '.hidden', 'package'), cast((p_partkey % 9 + p_size) % 9 as int) + 1)"
    ext = "element_at(array('json', 'ts', 'tsx', 'yml', 'vue', 'js', 'mdx', 'html', 'txt', 'YAML'), cast(p_size % 10 as int) + 1)"
    p = facts.load(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("ord"), F.expr(f"concat({folder}, {stem}, '.', {ext})").alias("rel_path"), F.col("p_size").alias("size"))


# ---- files

_ROLE = f"""CASE WHEN {_BASE} IN {_in(files.CONFIG_NAMES)} OR contains({_BASE}, '.config.') OR starts_with({_BASE}, 'tsconfig') THEN 'config'
  WHEN list_has_any(string_split(path, '/'), {list(files.GENERATED)}) THEN 'generated' WHEN {_EXT} IN ('json', 'yaml', 'yml') THEN 'resource'
  WHEN {_EXT} IN ('js', 'jsx', 'mjs', 'cjs', 'ts', 'tsx', 'vue', 'svelte', 'astro', 'mdx') THEN 'source' ELSE 'unknown' END"""


@query(
    _TREE + f"""SELECT ord, path AS rel_path, {_EXT} AS extension, {_LANGUAGE} AS language,
  CASE WHEN {_EXT} IN ('js', 'jsx', 'mjs', 'cjs', 'ts', 'tsx') THEN 'script' WHEN {_EXT} IN ('vue', 'svelte', 'astro', 'mdx') THEN 'mixed' ELSE 'resource' END AS domain, {_ROLE} AS role FROM t"""
)
def S05_S06_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("rel_path")
    return _tree(spark, sf_dir).select("ord", "rel_path", files.extension(p).alias("extension"), files.language(p).alias("language"), files.domain(p).alias("domain"), files.role(p).alias("role"))


_LINKS = """WITH f AS (SELECT o_orderkey AS ord, 'src/' || (o_orderkey // 2) || CASE WHEN o_orderkey % 6 = 1 THEN '/APP.ts' WHEN o_orderkey % 2 = 1 THEN '/other.ts' ELSE '/app.ts' END AS rel_path,
  CASE WHEN o_custkey % 5 <> 0 THEN o_custkey % 200 END AS inode, CAST(o_custkey % 2 + o_orderkey % 17 // 16 AS BIGINT) AS size, CAST(o_custkey % 3 AS BIGINT) AS mtime FROM orders)"""


def _linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = facts.load(spark, sf_dir, "orders")
    path = "concat('src/', o_orderkey div 2, case when o_orderkey % 6 = 1 then '/APP.ts' when o_orderkey % 2 = 1 then '/other.ts' else '/app.ts' end)"
    return o.select(
        F.col("o_orderkey").alias("ord"), F.expr(path).alias("rel_path"), F.expr("case when o_custkey % 5 <> 0 then o_custkey % 200 end").alias("inode"),
        F.expr("o_custkey % 2 + (o_orderkey % 17) div 16").alias("size"), F.expr("o_custkey % 3").alias("mtime"),
    )


@query(
    _LINKS + """, c AS (SELECT *, first_value(rel_path) OVER (PARTITION BY lower(rel_path) ORDER BY ord) AS head FROM f), k AS (SELECT *, head <> rel_path AS lost FROM c),
w AS (SELECT *, first_value(ROW(rel_path, size, mtime)) OVER q AS origin FROM k WINDOW q AS (PARTITION BY inode, lost ORDER BY ord)),
b AS (SELECT *, max(origin[2] <> size OR origin[3] <> mtime) OVER (PARTITION BY inode, lost ORDER BY ord ROWS UNBOUNDED PRECEDING) AS broken FROM w)
SELECT ord, rel_path, CASE WHEN lost THEN 'case-collision' WHEN inode IS NOT NULL AND NOT broken AND origin[1] <> rel_path THEN 'duplicate-locator' ELSE 'kept' END AS state,
  CASE WHEN lost THEN head WHEN inode IS NOT NULL AND NOT broken THEN origin[1] ELSE rel_path END AS canonical FROM b"""
)
def S03_file_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.resolve_conflicts(_linked(spark, sf_dir)).select("ord", "rel_path", "state", "canonical")


@query(_LINKS + " SELECT inode, array_to_string(list_sort(list(DISTINCT rel_path)), '|') AS paths, count(DISTINCT rel_path) AS n FROM f WHERE inode IS NOT NULL GROUP BY inode HAVING n > 1")
def A19_hard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.hard_links(_linked(spark, sf_dir)).withColumn("paths", F.array_join("paths", "|"))


@query("SELECT doc_id, CASE WHEN n_chars > 4000 THEN 'skipped-too-large' ELSE 'available' END AS state FROM documents")
def S08_content_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.load(spark, sf_dir, "documents").select("doc_id", files.content_state(F.col("n_chars"), 4000).alias("state"))


@query("SELECT CASE WHEN doc_id % 50 = 0 THEN 'NotFound' WHEN doc_id % 50 = 1 THEN 'PermissionDenied' ELSE 'TooLarge' END AS class, count(*) AS n FROM documents WHERE doc_id % 50 < 2 OR n_chars > 4000 GROUP BY class")
def A18_scan_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = facts.load(spark, sf_dir, "documents")
    error = F.when(F.col("doc_id") % 50 == 0, "NotFound").when(F.col("doc_id") % 50 == 1, "PermissionDenied")
    return files.scan_errors(d.select(F.col("doc_id").alias("rel_path"), F.col("n_chars").alias("size"), error.alias("error")), 4000)


@query(
    """WITH d AS (SELECT DISTINCT 'packages/' || lower(p_brand) AS path FROM part UNION SELECT DISTINCT 'packages/' || lower(p_brand) || '/src' FROM part UNION SELECT DISTINCT 'apps/' || (p_size % 7) FROM part)
SELECT 'pnpm' AS manager, path AS root FROM d WHERE regexp_matches(path, '^packages/[^/]*$') OR path = 'apps/3'"""
)
def S07_workspaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = facts.load(spark, sf_dir, "part")
    brand = F.concat(F.lit("packages/"), F.lower("p_brand"))
    folders = p.select(brand.alias("path")).union(p.select(F.concat(brand, F.lit("/src")))).union(p.select(F.concat(F.lit("apps/"), (F.col("p_size") % 7).cast("string")))).distinct()
    return files.workspace_roots(folders, [("npm", ["apps/*"]), ("pnpm", ["packages/*", "apps/3/"]), ("lerna", [])])


@query(
    _TREE + """SELECT DISTINCT folder, folder = '' OR folder = 'src' OR folder LIKE 'src/%' OR folder = 'apps' OR regexp_matches(folder, '^apps/[^/]*$') AS entered,
  regexp_matches(path, '^src/(?:.*/)?[^/]*\\.ts$') OR regexp_matches(path, '^apps/[^/]*/[^/]*\\.tsx$') AS included, path AS rel_path
FROM (SELECT path, unnest(['', split_part(path, '/', 1), regexp_replace(path, '/[^/]*$', '')]) AS folder FROM t)"""
)
def F09_include_globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    globs = ["src/**/*.ts", "apps/*/*.tsx"]
    path = F.col("rel_path")
    folders = F.explode(F.array(F.lit(""), F.split_part(path, F.lit("/"), F.lit(1)), F.regexp_replace(path, "/[^/]*$", "")))
    rows = _tree(spark, sf_dir).select("rel_path", folders.alias("folder"))
    return rows.select("folder", files.may_hold(F.col("folder"), globs).alias("entered"), files.included(path, globs).alias("included"), "rel_path").distinct()


_SCORED = f"""{_TREE}, n AS (SELECT DISTINCT path, {_EXT} AS ext, {_BASE} AS base, {_ROLE} AS role, regexp_matches(path, {_sql(locales.FOLDERS)}) AS loose FROM t),
s AS (SELECT *, regexp_replace(base, '(?i)\\.(json|ya?ml)$', '') AS stem FROM n), l AS (SELECT *, string_split(stem, '.')[-1] AS last FROM s),
a AS (SELECT *, ext IN {_in(files.DATA)} AS data, ext IN {_in(files.SCRIPTS)} AS script FROM l),
b AS (SELECT *, (CASE WHEN loose THEN 50 ELSE 0 END) + (CASE WHEN regexp_matches(path, {_sql(files.RESOURCE_NAME)}) THEN 40 ELSE 0 END)
  + (CASE WHEN data AND {_looks('stem', 'loose')} THEN 35 WHEN data AND {_looks('last', 'loose')} THEN 30 ELSE 0 END) AS x FROM a),
c AS (SELECT *, CASE WHEN x = 0 AND data AND regexp_matches(path, {_sql(files.PUBLIC)}) THEN 45 ELSE x + CASE WHEN x > 0 AND data THEN 10 WHEN x > 0 AND script THEN 5 ELSE 0 END END AS score FROM b
  WHERE (data OR script) AND NOT ends_with(path, '.d.ts') AND role <> 'generated' AND NOT regexp_matches(path, {_sql(files.GENERATED_PATH)}) AND base NOT IN ('package.json', 'tsconfig.json', 'jsconfig.json'))
"""


@query(_SCORED.replace("WITH t AS", "WITH t AS", 1) + "SELECT path AS rel_path, score FROM c WHERE score >= 15")
def F14_catalog_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = files.catalog_score(F.col("rel_path")).alias("score")
    return _tree(spark, sf_dir).select("rel_path").distinct().select("rel_path", score).where("score is not null")


@query(_SCORED + "SELECT path AS rel_path, score FROM c WHERE score >= 15 ORDER BY score DESC, path LIMIT 20")
def O04_top_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.top_candidates(_tree(spark, sf_dir).select("rel_path").distinct(), 20)


@query(
    _TREE + f"""SELECT ord, path AS rel_path FROM t WHERE {_EXT} IN ('js', 'jsx', 'mjs', 'cjs', 'ts', 'tsx', 'mts', 'cts', 'vue', 'svelte', 'astro', 'html') AND {_ROLE} <> 'generated'
  AND NOT regexp_matches(path, '(?i)(^|/)(\\.next|\\.nuxt|dist|build|out|coverage|generated)(/|$)') ORDER BY ord LIMIT 100"""
)
def F15_selected_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.selected(_tree(spark, sf_dir), 100).select("ord", "rel_path")


@query(_TREE + f"SELECT ord, regexp_matches(path, {_sql(files.TEST_PATH)}) AS test_like FROM t")
def F16_test_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(spark, sf_dir).select("ord", files.test_like(F.col("rel_path")).alias("test_like"))


@query(
    _TREE + f"""SELECT path AS rel_path, CAST(CASE WHEN lower({_BASE}) IN {_in(files.PRIORITY_NAMES)} THEN 100 ELSE 0 END + CASE WHEN regexp_matches(path, '(?i)(^|/)(i18n|locale|locales|lang|messages)(/|$)') THEN 40 ELSE 0 END
  + CASE WHEN regexp_matches(path, '(?i)(^|/)(app|pages|src)(/|$)') THEN 10 ELSE 0 END AS INTEGER) AS score, ord FROM t ORDER BY score DESC, ord LIMIT 30"""
)
def O07_source_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _tree(spark, sf_dir).select("rel_path", files.source_priority(F.col("rel_path")).alias("score"), "ord")
    return scored.orderBy(F.desc("score"), "ord").limit(30)


@query(
    _TREE + """SELECT ord, CASE WHEN regexp_matches(lower(path), '\\.json$') THEN 'json' WHEN regexp_matches(lower(path), '\\.ya?ml$') THEN 'yaml' WHEN regexp_matches(lower(path), '\\.([cm]?ts|tsx)$') THEN 'typescript' ELSE 'javascript' END AS format FROM t"""
)
def C10_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(spark, sf_dir).select("ord", files.format_of(F.col("rel_path")).alias("format"))


@query(_TREE + "SELECT ord, path AS rel_path FROM t")
def C34_relative_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("C:\\work\\"), F.replace("rel_path", F.lit("/"), F.lit("\\")))
    return _tree(spark, sf_dir).select("ord", files.relative(path, "C:/work/").alias("rel_path"))


@query(
    """WITH d AS (SELECT 'f' || doc_id AS rel_path, text FROM documents), o AS (SELECT 'f' || (doc_id * 2) AS rel_path, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'unsaved ' || doc_id END AS text FROM documents)
SELECT rel_path, CASE WHEN o.rel_path IS NOT NULL THEN o.text ELSE d.text END AS text FROM d FULL JOIN o USING (rel_path)"""
)
def S18_J07_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = facts.load(spark, sf_dir, "documents")
    disk = d.select(F.concat(F.lit("f"), "doc_id").alias("rel_path"), "text")
    unsaved = d.select(F.concat(F.lit("f"), (F.col("doc_id") * 2).cast("string")).alias("rel_path"), F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("unsaved "), "doc_id")).alias("text"))
    return files.overlaid(disk, unsaved)


# ---- functions


@query(
    f"""WITH k AS (SELECT DISTINCT c_mktsegment || CASE WHEN c_custkey % 3 = 0 THEN '.x' WHEN c_custkey % 3 = 1 THEN '' ELSE '-' || c_nationkey END AS key FROM customer UNION SELECT unnest(['en', 'de-AT', 'a/b', '9x', '', 'zz-ZZ']))
SELECT key, key <> '' AND NOT {_looks('key', 'true')} AND NOT contains(key, '.') AND NOT contains(key, '/') AND regexp_matches(key, '^[A-Za-z][A-Za-z0-9_-]*$') AS named FROM k"""
)
def C09_namespace_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = facts.load(spark, sf_dir, "customer")
    more = spark.createDataFrame([(x,) for x in ("en", "de-AT", "a/b", "9x", "", "zz-ZZ")], "key string")
    tail = F.when(F.col("c_custkey") % 3 == 0, ".x").when(F.col("c_custkey") % 3 == 1, "").otherwise(F.concat(F.lit("-"), F.col("c_nationkey").cast("string")))
    k = c.select(F.concat("c_mktsegment", tail).alias("key")).union(more).distinct()
    return k.select("key", locales.looks_like_namespace(F.col("key")).alias("named"))


@query(
    f"""WITH m AS (SELECT c_nationkey AS id, list(DISTINCT CASE c_custkey % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'de-AT' WHEN 2 THEN 'name' || (c_custkey % 8) ELSE 'x' || c_nationkey END) AS keys FROM customer WHERE c_custkey % 7 <> c_nationkey % 7 GROUP BY ALL)
SELECT id, len([k FOR k IN keys IF {_looks('k', 'true')}]) / len(keys) >= 0.6 AND (len([k FOR k IN keys IF lower(k) IN {_in(locales.WELL_KNOWN)}]) >= 1 OR len([k FOR k IN keys IF {_looks('k', 'true')}]) >= 2) AS locale_map FROM m"""
)
def C07_locale_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = facts.load(spark, sf_dir, "customer").where("c_custkey % 7 <> c_nationkey % 7")
    key = F.expr("case c_custkey % 4 when 0 then 'en' when 1 then 'de-AT' when 2 then concat('name', c_custkey % 8) else concat('x', c_nationkey) end")
    keys = c.groupBy(F.col("c_nationkey").alias("id")).agg(F.collect_set(key).alias("keys"))
    return keys.select("id", locales.looks_like_locale_map(F.col("keys")).alias("locale_map"))


@query("SELECT o_custkey % 50 AS file, avg(CASE WHEN o_orderkey % 5 < 3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS ratio FROM orders GROUP BY file")
def C12_string_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = facts.load(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("file"), F.when(F.col("o_orderkey") % 5 < 3, "string").otherwise("number").alias("value_kind"))
    return o.groupBy("file").agg(text.string_ratio(F.col("value_kind")).alias("ratio"))


@query(f"WITH {facts.DEFINITIONS} SELECT ord, len(string_split(key, '.'))::INTEGER AS depth, string_split(key, '.')[-1] AS last FROM definitions")
def C13_key_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = text.key_path(F.col("key"))
    return facts.definitions(spark, sf_dir).select("ord", F.size(path).alias("depth"), F.element_at(path, -1).alias("last"))


@query(_PATHS + "SELECT DISTINCT t, lower(replace(trim(t), '_', '-')) AS token FROM (SELECT ' ' || unnest(parts) || ' ' AS t FROM s)")
def C22_locale_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _paths(spark, sf_dir).select(F.explode(F.split("path", "/")).alias("t")).select(F.concat(F.lit(" "), "t", F.lit(" ")).alias("t")).distinct()
    return t.select("t", resolve.locale_token(F.col("t")).alias("token"))


@query(
    f"""WITH {facts.DEFINITIONS} SELECT ord, CASE WHEN namespace IS NULL THEN key ELSE namespace || ':' || key END AS shown, string_split(key, '.')[-1] AS last,
  CAST(strpos(substr('  ' || key || ' = "' || key || '"', line % 5 + 1), '"' || key || '"') + line % 5 AS INTEGER) AS low FROM definitions"""
)
def C26_displayed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("key")
    line = F.concat(F.lit("  "), key, F.lit(' = "'), key, F.lit('"'))
    low, _ = editor.key_on_line(line, (F.col("line") % 5).cast("int"), key)
    return facts.definitions(spark, sf_dir).select("ord", editor.display_key(key, F.col("namespace")).alias("shown"), editor.last_segment(key).alias("last"), low.cast("int").alias("low"))


@query(
    """WITH p AS (SELECT doc_id, text, CAST(doc_id % 90 AS INTEGER) AS o FROM documents), h AS (SELECT doc_id, left(text, o) AS head FROM p)
SELECT doc_id, CAST(len(string_split(head, chr(10))) - 1 AS INTEGER) AS line, CAST(length(string_split(head, chr(10))[-1]) AS INTEGER) AS character FROM h WHERE NOT contains(head, chr(13))"""
)
def C25_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = facts.load(spark, sf_dir, "documents").select("doc_id", "text", (F.col("doc_id") % 90).cast("int").alias("o"))
    line, character = editor.position(F.col("text"), F.col("o"))
    return d.where(~F.left("text", "o").contains("\r")).select("doc_id", line.alias("line"), character.alias("character"))


# ---- resolvers

SETTINGS = resolve.Settings(
    default_ns="common", fallback_ns=("shared", " "), confidence=0.8, default_locale="en", supported=("en", "de", "pt-BR"), inheritance={"de-AT": "de", "de": "en", "en": "de", "pt-BR": "pt", "fr": "FR", "es-mx": "es"}
)
_ASKED = f"""WITH {facts.USAGES}, q AS (SELECT line, "column", CASE line % 6 WHEN 0 THEN 'menu:' || key WHEN 1 THEN key || ':' ELSE key END AS key, confidence,
  CASE WHEN line % 5 = 0 THEN ['opt' || (line % 3), ' second '] END AS o, CASE WHEN line % 4 = 0 THEN ['home'] WHEN line % 4 = 1 THEN ['  '] END AS c, CASE WHEN line % 7 = 0 THEN '.pre.' WHEN line % 7 = 1 THEN ' ' END AS prefix FROM usages)"""


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = facts.usages(spark, sf_dir)
    return u.select(
        "line", "column", F.expr("case line % 6 when 0 then concat('menu:', key) when 1 then concat(key, ':') else key end").alias("key"), "confidence",
        F.expr("case when line % 5 = 0 then array(concat('opt', line % 3), ' second ') end").alias("options_ns"), F.expr("case when line % 4 = 0 then array('home') when line % 4 = 1 then array('  ') end").alias("call_ns"),
        F.expr("case when line % 7 = 0 then '.pre.' when line % 7 = 1 then ' ' end").alias("key_prefix"),
    )


@query(
    _ASKED + """, m AS (SELECT *, regexp_matches(key, '^menu:.+') AS inline FROM q)
SELECT line, "column", CASE WHEN o IS NOT NULL THEN o[1] WHEN c = ['home'] THEN 'home' WHEN inline THEN 'menu' ELSE 'common' END AS r_namespace,
  CASE WHEN o IS NOT NULL THEN o[1] || '|second|shared' WHEN c = ['home'] THEN 'home|shared' WHEN inline THEN 'menu|shared' ELSE 'common|shared' END AS r_namespaces,
  CASE WHEN prefix = '.pre.' THEN 'pre.' ELSE '' END || CASE WHEN o IS NULL AND c IS DISTINCT FROM ['home'] AND inline THEN substr(key, 6) ELSE key END AS r_key,
  CASE WHEN o IS NOT NULL THEN 'options' WHEN c = ['home'] OR inline THEN 'call-site' ELSE 'defaultNS' END AS r_source,
  floor(least(confidence, CASE WHEN o IS NOT NULL THEN 0.95 WHEN c = ['home'] THEN 0.92 WHEN inline THEN 0.9 ELSE 0.8 END::DOUBLE, CASE WHEN prefix = '.pre.' THEN 0.93 ELSE 1 END::DOUBLE) * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS r_confidence FROM m"""
)
def C18_i18next_namespaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = resolve.resolve_i18next(_asked(spark, sf_dir), SETTINGS)
    return got.select("line", "column", "r_namespace", F.array_join("r_namespaces", "|").alias("r_namespaces"), "r_key", "r_source", "r_confidence")


@query(
    _ASKED + """SELECT line, "column", CASE WHEN c = ['home'] THEN 'home' END AS r_namespace, CASE WHEN c = ['home'] THEN 'home.' ELSE '' END || CASE WHEN prefix = '.pre.' THEN 'pre.' ELSE '' END || key AS r_key,
  CASE WHEN c = ['home'] THEN 'call-site' WHEN prefix = '.pre.' THEN 'key-prefix' ELSE 'unknown' END AS r_source,
  floor(least(confidence, CASE WHEN c = ['home'] OR prefix = '.pre.' THEN 0.94 ELSE 0.7 END::DOUBLE) * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS r_confidence FROM q"""
)
def C19_next_intl_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.resolve_next_intl(_asked(spark, sf_dir), SETTINGS).select("line", "column", "r_namespace", "r_key", "r_source", "r_confidence")


@query(
    """WITH u AS (SELECT o_orderkey AS id, (['de_AT', 'DE', 'pt_br', 'fr', '', 'es-mx', 'sv', NULL])[o_orderkey % 8 + 1] AS locale, CASE WHEN o_custkey % 3 <> 0 THEN o_custkey % 10 / 10::DOUBLE END AS confidence FROM orders),
l AS (SELECT *, coalesce(lower(replace(nullif(locale, ''), '_', '-')), 'en') AS l_locale, CASE WHEN nullif(locale, '') IS NULL THEN 'default-locale' ELSE 'call-site' END AS l_source FROM u)
SELECT id, l_locale, l_source, CASE l_locale WHEN 'de-at' THEN 'de-at|de|en' WHEN 'de' THEN 'de|en' WHEN 'en' THEN 'en|de' WHEN 'pt-br' THEN 'pt-br|pt' WHEN 'es-mx' THEN 'es-mx|es' ELSE l_locale END AS l_chain,
  CASE WHEN l_locale IN ('fr', 'es-mx', 'sv') THEN least(0.6, c) ELSE c END AS l_confidence
FROM (SELECT *, floor(least(coalesce(confidence, 1.0::DOUBLE), CASE l_source WHEN 'call-site' THEN 0.95 ELSE 0.8 END::DOUBLE) * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS c FROM l)"""
)
def C21_locales(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = facts.load(spark, sf_dir, "orders")
    u = o.select(
        F.col("o_orderkey").alias("id"), F.expr("element_at(array('de_AT', 'DE', 'pt_br', 'fr', '', 'es-mx', 'sv', null), cast(o_orderkey % 8 as int) + 1)").alias("locale"),
        F.expr("case when o_custkey % 3 <> 0 then (o_custkey % 10) / 10D end").alias("confidence"),
    )
    return resolve.resolve_locale(u, SETTINGS).select("id", "l_locale", "l_source", F.array_join("l_chain", "|").alias("l_chain"), "l_confidence")


@query(
    """WITH RECURSIVE p AS (SELECT c_custkey AS child, CASE WHEN c_custkey % 100 = 7 THEN c_custkey * 2 ELSE c_custkey // 2 END AS parent FROM customer WHERE c_custkey > 1),
w(child, chain, here, n) AS (SELECT child, [child], child, 0 FROM p UNION ALL SELECT w.child, list_append(w.chain, p.parent), p.parent, n + 1 FROM w JOIN p ON p.child = w.here AND NOT list_contains(w.chain, p.parent) WHERE n < 8)
SELECT child, array_to_string(chain, '>') AS chain FROM w QUALIFY row_number() OVER (PARTITION BY child ORDER BY n DESC) = 1"""
)
def G06_inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = facts.load(spark, sf_dir, "customer").where("c_custkey > 1").select(F.col("c_custkey").alias("child"), F.expr("case when c_custkey % 100 = 7 then c_custkey * 2 else c_custkey div 2 end").alias("parent"))
    return resolve.inheritance_chains(c).select("child", F.array_join("chain", ">").alias("chain"))


# ---- settings and value sets


@query(
    """WITH f AS (SELECT c_nationkey AS field, ['v' || (c_custkey % 3), 'v' || (c_custkey % 5), 'w' || (c_custkey % 2)] AS l, c_acctbal AS priority, c_custkey AS ord FROM customer WHERE c_custkey % 4 <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY priority DESC, ord) AS n FROM f),
v AS (SELECT field, x, min(ROW(n, i)) AS place FROM (SELECT field, n, unnest(l) AS x, unnest([1, 2, 3]) AS i FROM r) GROUP BY ALL),
t AS (SELECT a.field, a.l AS a, b.l AS b FROM r a LEFT JOIN r b ON b.field = a.field AND b.n = 2 WHERE a.n = 1)
SELECT field, (SELECT string_agg(x, '|' ORDER BY place) FROM v WHERE v.field = t.field) AS merged, coalesce(array_to_string(list_sort(list_distinct([x FOR x IN a IF b IS NOT NULL AND NOT list_contains(b, x)])), '|'), '') AS only_first,
  coalesce(array_to_string(list_sort(list_distinct([x FOR x IN b IF NOT list_contains(a, x)])), '|'), '') AS only_second FROM t"""
)
def A14_U04_merged_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = facts.load(spark, sf_dir, "customer").where("c_custkey % 4 <> 0")
    f = c.select(
        F.col("c_nationkey").alias("field"), F.expr("array(concat('v', c_custkey % 3), concat('v', c_custkey % 5), concat('w', c_custkey % 2))").alias("values"), F.col("c_acctbal").alias("priority"), F.col("c_custkey").alias("ord"),
    )
    line = lambda name: F.array_join(F.array_sort(name), "|").alias(name)
    return settings.merge_lists(f).select("field", F.array_join("values", "|").alias("merged"), line("only_first"), line("only_second"))


@query(
    """WITH f AS (SELECT 'k' || (c_custkey % 40) AS field, c_name AS value, (['defaults', 'package-json', 'config-file', 'package-config', 'cli'])[c_nationkey % 5 + 1] AS source, CASE WHEN c_custkey % 3 = 0 THEN 'p/package.json' ELSE 'p/' || c_custkey END AS path, c_nationkey % 5 AS rank FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 40 = c_custkey)
SELECT field, value, source FROM f QUALIFY row_number() OVER (PARTITION BY field ORDER BY rank DESC, CASE WHEN path LIKE '%/package.json' THEN 0 ELSE 1 END DESC, path DESC) = 1"""
)
def J16_config_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = facts.load(spark, sf_dir, "customer").where("c_custkey % 3 <> 0 or c_custkey % 40 = c_custkey")
    f = c.select(
        F.expr("concat('k', c_custkey % 40)").alias("field"), F.col("c_name").alias("value"), F.element_at(F.array(*map(F.lit, settings.SOURCES)), (F.col("c_nationkey") % 5 + 1).cast("int")).alias("source"),
        F.expr("case when c_custkey % 3 = 0 then 'p/package.json' else concat('p/', c_custkey) end").alias("path"),
    )
    return settings.override(f)


_SETS = """WITH p AS (SELECT p_partkey AS id, [x FOR x IN list_sort(list_distinct(['a' || (p_size % 3), 'b' || (p_partkey % 4), CASE WHEN p_size % 5 = 0 THEN '' ELSE 'c' END])) IF x <> ''] AS l,
  [x FOR x IN list_sort(list_distinct(['.x' || (p_partkey % 2), CASE WHEN p_partkey % 6 = 0 THEN '.x0' ELSE '.y' END, '.z' || (p_size % 2)])) IF x <> ''] AS r, p_size % 7 = 0 AS part, 0.5::DOUBLE + (p_partkey % 6) / 10::DOUBLE AS sure, p_partkey % 11 = 0 AS loop FROM part),
s AS (SELECT id, l, r, part, loop, floor(CASE WHEN part AND len(l) > 1 THEN least(sure, 0.65::DOUBLE) ELSE sure END * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS cl FROM p) """


def _sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = facts.load(spark, sf_dir, "part")
    left = F.expr("array(concat('a', p_size % 3), concat('b', p_partkey % 4), case when p_size % 5 = 0 then '' else 'c' end)")
    right = F.expr("array(concat('.x', p_partkey % 2), case when p_partkey % 6 = 0 then '.x0' else '.y' end, concat('.z', p_size % 2))")
    sure = F.expr("0.5D + (p_partkey % 6) / 10D")
    return p.select(
        F.col("p_partkey").alias("id"), values.from_values(left, F.col("p_size") % 7 == 0, sure, F.col("p_partkey") % 11 == 0).alias("l"), values.from_values(right, F.lit(False), F.lit(1.0), F.lit(False)).alias("r"),
    )


@query(
    _SETS + """, u AS (SELECT *, list_sort(list_distinct(l || r)) AS v, least(cl, 0.7::DOUBLE) AS c FROM s)
SELECT id, array_to_string(v, '|') AS vals, part AS incomplete, CASE WHEN part THEN least(c, 0.65::DOUBLE) ELSE c END AS confidence, loop AS circular FROM u"""
)
def A15_value_unions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _sets(spark, sf_dir).select("id", values.union(F.array("l", "r")).alias("s"))
    return s.select("id", F.array_join("s.values", "|").alias("vals"), "s.incomplete", "s.confidence", "s.circular")


@query(
    _SETS + """, x AS (SELECT *, flatten([[a || b FOR b IN r] FOR a IN l]) AS every FROM s), c AS (SELECT *, list_sort(list_distinct(every[1:4])) AS v, len(every) > 4 AS cut FROM x),
d AS (SELECT *, least(cl, 0.95::DOUBLE, CASE WHEN part OR cut THEN CASE WHEN cut THEN 0.5::DOUBLE ELSE 0.75::DOUBLE END ELSE 1 END, CASE WHEN len(l) > 1 OR len(r) > 1 THEN 0.8::DOUBLE ELSE 1 END) AS sure FROM c)
SELECT id, array_to_string(v, '|') AS vals, part OR cut AS incomplete, CASE WHEN (part OR cut) AND len(v) > 1 THEN least(sure, 0.65::DOUBLE) ELSE sure END AS confidence, loop AS circular FROM d"""
)
def A15_value_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _sets(spark, sf_dir).select("id", values.concat(F.col("l"), F.col("r"), 4).alias("s"))
    return s.select("id", F.array_join("s.values", "|").alias("vals"), "s.incomplete", "s.confidence", "s.circular")


# ---- detection

_EVIDENCE = """WITH e AS (SELECT o_custkey % 60 AS project, (['i18next', 'react-i18next', 'formatjs', 'react-intl', 'vue-i18n', 'nuxt-i18n'])[o_orderkey % 7 + 1] AS id, (o_orderkey % 4 + 1) / 10::DOUBLE AS weight FROM orders WHERE o_orderkey % 7 < 6 AND o_orderkey % 5 = o_custkey % 5),
s AS (SELECT project, id, floor((1 - product(1 - weight)) * 1000.0::DOUBLE + 0.5::DOUBLE) / 1000.0::DOUBLE AS confidence FROM e GROUP BY ALL),
x AS (SELECT s.project, s.id, CASE WHEN s.id = 'i18next' AND EXISTS (SELECT 1 FROM s t WHERE t.project = s.project AND t.id = 'react-i18next' AND t.confidence >= 0.45) THEN least(s.confidence, 0.45::DOUBLE)
  WHEN s.id = 'formatjs' AND EXISTS (SELECT 1 FROM s t WHERE t.project = s.project AND t.id = 'react-intl' AND t.confidence >= 0.45) THEN least(s.confidence, 0.4::DOUBLE)
  WHEN s.id = 'vue-i18n' AND EXISTS (SELECT 1 FROM s t WHERE t.project = s.project AND t.id = 'nuxt-i18n' AND t.confidence >= 0.45) THEN least(s.confidence, 0.45::DOUBLE) ELSE s.confidence END AS confidence FROM s) """


def _libraries(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = facts.load(spark, sf_dir, "orders").where("o_orderkey % 7 < 6 and o_orderkey % 5 = o_custkey % 5")
    e = o.select(
        F.expr("o_custkey % 60").alias("project"), F.expr("element_at(array('i18next', 'react-i18next', 'formatjs', 'react-intl', 'vue-i18n', 'nuxt-i18n'), cast(o_orderkey % 7 as int) + 1)").alias("id"),
        F.expr("(o_orderkey % 4 + 1) / 10D").alias("weight"),
    )
    return detect.demoted(detect.scored(e), detect.LIBRARY_RULES)


@query(_EVIDENCE + "SELECT * FROM x")
def A13_libraries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _libraries(spark, sf_dir)


@query(_EVIDENCE + "SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY project ORDER BY confidence DESC, id) = 1")
def A13_primary_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.primary(_libraries(spark, sf_dir))


@query(
    """WITH f AS (SELECT DISTINCT c_nationkey AS project, (['package-lock.json', 'pnpm-lock.yaml', 'yarn.lock', 'pnpm-workspace.yaml', 'README.md'])[c_custkey % 5 + 1] AS name FROM customer WHERE c_custkey % 3 = c_nationkey % 3),
e AS (SELECT project, CASE name WHEN 'package-lock.json' THEN 'npm' WHEN 'yarn.lock' THEN 'yarn' WHEN 'README.md' THEN NULL ELSE 'pnpm' END AS id, CASE name WHEN 'package-lock.json' THEN 0.9 WHEN 'pnpm-workspace.yaml' THEN 0.95 * 0.45 ELSE 0.95 END::DOUBLE AS weight FROM f
  UNION ALL SELECT n_nationkey, (['npm', 'yarn', 'pnpm', 'other'])[n_nationkey % 4 + 1], 0.75::DOUBLE FROM nation)
SELECT project, id, floor((1 - product(1 - weight)) * 1000.0::DOUBLE + 0.5::DOUBLE) / 1000.0::DOUBLE AS confidence FROM e WHERE id IN ('npm', 'yarn', 'pnpm') GROUP BY ALL"""
)
def A13b_package_managers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = facts.load(spark, sf_dir, "customer").where("c_custkey % 3 = c_nationkey % 3")
    names = c.select(F.col("c_nationkey").alias("project"), F.expr("element_at(array('package-lock.json', 'pnpm-lock.yaml', 'yarn.lock', 'pnpm-workspace.yaml', 'README.md'), cast(c_custkey % 5 as int) + 1)").alias("name"))
    n = facts.load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("project"), F.expr("concat(element_at(array('npm', 'Yarn', 'pnpm', 'other'), n_nationkey % 4 + 1), '@9.1')").alias("package_manager"))
    return detect.package_managers(names, n)


# ---- modules

_EXPORTS = """WITH x AS (SELECT c_custkey AS id, 'm' || (c_custkey % 300) AS rel_path, 's' || (c_custkey % 7) AS name, (['local', 're-export', 'star', 'default'])[c_nationkey % 4 + 1] AS kind, 'm' || ((c_custkey % 300) // 2) AS target, 's' || (c_custkey % 5) AS target_name FROM customer WHERE c_custkey % 300 > 1) """


def _exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = facts.load(spark, sf_dir, "customer").where("c_custkey % 300 > 1")
    return c.select(
        F.expr("concat('m', c_custkey % 300)").alias("rel_path"), F.expr("concat('s', c_custkey % 7)").alias("name"), F.expr("element_at(array('local', 're-export', 'star', 'default'), c_nationkey % 4 + 1)").alias("kind"),
        F.expr("concat('m', (c_custkey % 300) div 2)").alias("target"), F.expr("concat('s', c_custkey % 5)").alias("target_name"),
    )


@query(
    """WITH RECURSIVE """ + _EXPORTS.removeprefix("WITH ") + """, n AS (SELECT rel_path, name, count(*) FILTER (kind IN ('local', 'default')) AS locals, arg_min(ROW(kind, target, target_name), ROW(CASE kind WHEN 'local' THEN 0 WHEN 'default' THEN 1 ELSE 2 END, target, target_name)) AS e FROM x WHERE kind <> 'star' GROUP BY ALL),
stars AS (SELECT DISTINCT rel_path, target FROM x WHERE kind = 'star'), q AS (SELECT DISTINCT 'm' || (o_custkey % 300) || '#s' || (o_orderkey % 8) AS req, 'm' || (o_custkey % 300) AS f, 's' || (o_orderkey % 8) AS s FROM orders),
w(req, f, s, c) AS (SELECT req, f, s, 1.0::DOUBLE FROM q UNION
  SELECT w.req, coalesce(n.e[2], st.target), coalesce(n.e[3], w.s), CASE WHEN n.e IS NULL THEN least(w.c, 0.85::DOUBLE) ELSE w.c END FROM w LEFT JOIN n ON n.rel_path = w.f AND n.name = w.s
    LEFT JOIN stars st ON n.e IS NULL AND st.rel_path = w.f WHERE (n.e IS NULL AND st.target IS NOT NULL) OR (n.locals = 0)),
d AS (SELECT w.*, n.locals FROM w JOIN n ON n.rel_path = w.f AND n.name = w.s WHERE n.locals > 0),
g AS (SELECT req, bool_or(locals > 1) AS twice, count(DISTINCT f) FILTER (locals = 1) AS files, max(ROW(c, s, f)) AS b FROM d GROUP BY req),
v AS (SELECT q.req, CASE WHEN g.req IS NULL THEN 'unresolved' WHEN twice OR files > 1 THEN 'ambiguous' ELSE 'found' END AS state, b FROM q LEFT JOIN g USING (req))
SELECT req, state, CASE WHEN state = 'found' THEN b[3] END AS rel_path, CASE WHEN state = 'found' THEN b[2] END AS name, CASE WHEN state = 'found' THEN b[1] ELSE 0.0::DOUBLE END AS confidence FROM v"""
)
def J10_G04_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = facts.load(spark, sf_dir, "orders")
    q = o.select(F.expr("concat('m', o_custkey % 300)").alias("rel_path"), F.expr("concat('s', o_orderkey % 8)").alias("name")).distinct()
    x = _exports(spark, sf_dir)
    stars = x.where("kind = 'star'").select("rel_path", F.lit("*").alias("name"), "kind", "target", F.lit(None).cast("string").alias("target_name")).distinct()
    return modules.follow(q.select(F.concat_ws("#", "rel_path", "name").alias("req"), "rel_path", "name"), x.where("kind <> 'star'").union(stars)).select("req", "state", "rel_path", "name", "confidence")


@query(
    _EXPORTS + """, i AS (SELECT DISTINCT 'm' || (o_custkey % 300) AS target, CASE WHEN o_orderkey % 40 = 0 THEN '*' ELSE 's' || (o_orderkey % 3) END AS name FROM orders WHERE o_custkey % 4 = 0)
SELECT DISTINCT rel_path, name FROM x WHERE kind <> 'star' AND rel_path NOT IN (SELECT target FROM i WHERE name = '*') AND NOT EXISTS (SELECT 1 FROM i WHERE i.target = x.rel_path AND i.name = x.name)"""
)
def U08_unused_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = facts.load(spark, sf_dir, "orders").where("o_custkey % 4 = 0")
    i = o.select(F.expr("concat('m', o_custkey % 300)").alias("target"), F.expr("case when o_orderkey % 40 = 0 then '*' else concat('s', o_orderkey % 3) end").alias("name"))
    return modules.unused_exports(_exports(spark, sf_dir), i)


_IMPORTS = """WITH f AS (SELECT DISTINCT 'src/' || (p_size % 9) || '/m' || (p_partkey % 40) || (['.ts', '/index.ts', '.jsx', '.vue'])[p_partkey % 4 + 1] AS rel_path FROM part),
i AS (SELECT o_orderkey AS id, 'src/' || (o_custkey % 9) || '/a.ts' AS rel_path, CASE o_orderkey % 4 WHEN 0 THEN './m' || (o_custkey % 40) WHEN 1 THEN '../' || (o_orderkey % 9) || '/./m' || (o_custkey % 40) WHEN 2 THEN '@/' || (o_orderkey % 9) || '/m' || (o_custkey % 40) ELSE 'react' END AS spec FROM orders),
b AS (SELECT *, CASE o_mod WHEN 0 THEN regexp_replace(rel_path, '[^/]*$', '') || substr(spec, 3) WHEN 1 THEN 'src/' || replace(substr(spec, 4), './', '') WHEN 2 THEN 'src/' || substr(spec, 3) END AS base FROM (SELECT *, id % 4 AS o_mod FROM i))"""


@query(
    _IMPORTS + """SELECT b.id, b.spec, (SELECT min(ROW(k, base || e)) FROM (SELECT unnest(range(9)) AS k, unnest(['.ts', '.tsx', '.js', '.jsx', '.mjs', '.cjs', '/index.ts', '/index.tsx', '/index.js']) AS e) JOIN f ON f.rel_path = base || e)[2] AS target FROM b"""
)
def C35_C36_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = facts.load(spark, sf_dir, "part")
    known = p.select(F.expr("concat('src/', p_size % 9, '/m', p_partkey % 40, element_at(array('.ts', '/index.ts', '.jsx', '.vue'), cast(p_partkey % 4 as int) + 1))").alias("rel_path"))
    spec = "case o_orderkey % 4 when 0 then concat('./m', o_custkey % 40) when 1 then concat('../', o_orderkey % 9, '/./m', o_custkey % 40) when 2 then concat('@/', o_orderkey % 9, '/m', o_custkey % 40) else 'react' end"
    i = facts.load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.expr("concat('src/', o_custkey % 9, '/a.ts')").alias("rel_path"), F.expr(spec).alias("spec"))
    return modules.resolved(i, known, {"@/*": ["src/*"], "@": ["src/none"], "@/x/*": ["lib/*"]}).select("id", "spec", "target")


@query(
    """WITH RECURSIVE c AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 20 <> 1 THEN c_custkey // 3 END AS parent, 'f' || (c_custkey % 6) AS field, c_name AS value FROM customer),
w(id, hop, here) AS (SELECT id, 0, id FROM c UNION ALL SELECT w.id, hop + 1, c.parent FROM w JOIN c ON c.id = w.here WHERE c.parent IS NOT NULL AND hop < 8)
SELECT w.id AS rel_path, c.field, arg_min(c.value, w.hop) AS value FROM w JOIN c ON c.id = w.here GROUP BY ALL"""
)
def G09_extended_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = facts.load(spark, sf_dir, "customer")
    x = c.select(F.col("c_custkey").alias("rel_path"), F.expr("case when c_custkey % 20 <> 1 then c_custkey div 3 end").alias("parent"), F.expr("map(concat('f', c_custkey % 6), c_name)").alias("fields"))
    return modules.extended(x)


@query(
    """WITH s AS (SELECT DISTINCT 'loc/' || (p_partkey % 80) || '.ts' AS rel_path, CASE WHEN p_partkey % 80 % 3 = 0 THEN 'en' WHEN p_partkey % 80 % 3 = 1 THEN 'de' END AS locale, CAST(NULL AS VARCHAR) AS namespace, 0.6::DOUBLE AS confidence FROM part),
r AS (SELECT DISTINCT 'LOC/' || (s_suppkey % 60) || '.ts' AS rel_path, 'src/i' || (s_nationkey % 4) || '.ts' AS at_file, (['en', 'de', NULL])[s_nationkey % 3 + 1] AS locale, 'ns' || (s_suppkey % 4) AS namespace FROM supplier),
o AS (SELECT lower(rel_path) AS low, locale, namespace, min(at_file) AS at_file FROM r GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY low ORDER BY at_file, namespace, coalesce(locale, '')) AS place FROM o),
m AS (SELECT s.rel_path, s.locale, arg_min(ROW(p.locale, p.namespace), ROW(CASE WHEN p.locale = s.locale THEN 0 ELSE 1 END, p.place)) AS b, list_distinct(list(p.namespace)) AS all_ FROM s JOIN p ON p.low = lower(s.rel_path) GROUP BY ALL)
SELECT s.rel_path, coalesce(b[1], s.locale) AS locale, b[2] AS namespace, CASE WHEN len(all_) > 1 THEN array_to_string(list_sort(all_), '|') END AS namespaces, CASE WHEN b IS NULL THEN 0.6 ELSE 0.9 END::DOUBLE AS confidence
FROM s LEFT JOIN m ON m.rel_path = s.rel_path AND m.locale IS NOT DISTINCT FROM s.locale"""
)
def J06_attributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = facts.load(spark, sf_dir, "part").select(F.expr("p_partkey % 80").alias("k")).distinct()
    s = p.select(F.expr("concat('loc/', k, '.ts')").alias("rel_path"), F.expr("case k % 3 when 0 then 'en' when 1 then 'de' end").alias("locale"), F.lit(None).cast("string").alias("namespace"), F.lit(0.6).alias("confidence"))
    r = facts.load(spark, sf_dir, "supplier").select(
        F.expr("concat('LOC/', s_suppkey % 60, '.ts')").alias("rel_path"), F.expr("concat('src/i', s_nationkey % 4, '.ts')").alias("at_file"), F.expr("element_at(array('en', 'de', null), s_nationkey % 3 + 1)").alias("locale"),
        F.expr("concat('ns', s_suppkey % 4)").alias("namespace"), F.lit(0.9).alias("confidence"),
    )
    got = modules.attributed(s, r.orderBy("at_file"))
    return got.withColumn("namespaces", F.array_join(F.array_sort("namespaces"), "|"))


@query(
    """WITH RECURSIVE d AS (SELECT DISTINCT 'f' || c_custkey AS fn, 'ns' || c_nationkey AS ns FROM customer WHERE c_custkey % 50 = 3), n AS (SELECT 'f' || c_custkey AS fn, 'f' || (c_custkey // 2) AS from_fn FROM customer),
w(fn, ns) AS (SELECT fn, ns FROM d UNION SELECT n.fn, w.ns FROM w JOIN n ON n.from_fn = w.fn)
SELECT fn, string_agg(DISTINCT ns, '|' ORDER BY ns) AS namespaces FROM w GROUP BY fn"""
)
def J15_G05_parameter_namespaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = facts.load(spark, sf_dir, "customer")
    none = F.lit(None).cast("string")
    direct = c.where("c_custkey % 50 = 3").select(F.expr("concat('f', c_custkey)").alias("fn"), F.expr("concat('ns', c_nationkey)").alias("ns"), none.alias("from_fn"))
    nested = c.select(F.expr("concat('f', c_custkey)").alias("fn"), none.alias("ns"), F.expr("concat('f', c_custkey div 2)").alias("from_fn"))
    return graph.parameter_namespaces(direct.union(nested)).withColumn("namespaces", F.array_join("namespaces", "|"))


@query(
    f"""WITH RECURSIVE {facts.EDGES}, r(node, confidence, chain) AS (SELECT 1::BIGINT, 0.92::DOUBLE, '1' UNION ALL SELECT e.caller, least(r.confidence, e.confidence, 0.85::DOUBLE), e.caller || '>' || r.chain FROM r JOIN edges e ON e.callee = r.node AND e.caller <> e.callee)
SELECT o_orderkey AS call_id, 1::BIGINT AS target, least(0.8::DOUBLE, floor(r.confidence * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE) AS confidence, chain FROM orders JOIN r ON r.node = o_custkey"""
)
def G08_resolved_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.wrappers(facts.edges(spark, sf_dir), spark.createDataFrame([(1, 0.92)], "node bigint, confidence double"))
    calls = facts.load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("call_id"), F.col("o_custkey").alias("callee"), F.lit(0.8).alias("confidence"))
    return graph.resolve_calls(calls, found)


# ---- catalogs, policy and reports

_ALL = "SELECT * FROM missing_issues UNION ALL SELECT * FROM dup_issues UNION ALL SELECT * FROM unused_issues"


@query(f"WITH {facts.DEFINITIONS} SELECT full_key, n FROM (SELECT coalesce(locale, '*') || '::' || coalesce(namespace, '*') || '::' || key AS full_key, count(*) AS n FROM definitions GROUP BY 1) WHERE n > 1 ORDER BY n DESC, full_key LIMIT 20")
def A11_repeated_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = facts.definitions(spark, sf_dir).groupBy(matching.full_key().alias("full_key")).agg(F.count("*").alias("n")).where("n > 1")
    return d.orderBy(F.desc("n"), "full_key").limit(20)


@query(
    f"""WITH {facts.DEFINITIONS}, s AS (SELECT rel_path, coalesce(locale, '*') AS locale, coalesce(namespace, '*') AS namespace, string_agg(key, ',' ORDER BY key) AS keys FROM definitions GROUP BY ALL)
SELECT locale, namespace, md5(keys) AS print, min(rel_path) AS rel_path, count(*) AS copies FROM s GROUP BY locale, namespace, md5(keys)"""
)
def A16_inline_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.distinct_sources(facts.definitions(spark, sf_dir))


@query(
    f"""WITH {facts.DEFINITIONS}, s AS (SELECT rel_path, ord % 3 AS k, locale FROM definitions)
SELECT CASE k WHEN 0 THEN 'json' WHEN 1 THEN 'yaml' ELSE 'typescript' END AS format, CASE WHEN locale IN ('en', 'de') THEN 'file' ELSE 'embedded' END AS kind, count(*) AS keys, count(DISTINCT rel_path) AS sources FROM s GROUP BY ALL"""
)
def A10_catalog_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = F.expr("element_at(array('a.json', 'a.yml', 'a.ts'), cast(ord % 3 as int) + 1)")
    d = facts.definitions(spark, sf_dir).select(files.format_of(ext).alias("format"), F.when(F.col("locale").isin("en", "de"), "file").otherwise("embedded").alias("kind"), "rel_path")
    return d.groupBy("format", "kind").agg(F.count("*").alias("keys"), F.countDistinct("rel_path").alias("sources"))


@query(f"WITH {facts.USAGES}, u AS (SELECT library, (['function-call', 'member-call', 'jsx-attribute'])[line % 3 + 1] AS context FROM usages) SELECT library, context, count(*) AS n FROM u GROUP BY CUBE (library, context)")
def A12_usage_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = facts.usages(spark, sf_dir).select("library", F.expr("element_at(array('function-call', 'member-call', 'jsx-attribute'), cast(line % 3 as int) + 1)").alias("context"))
    return u.cube("library", "context").agg(F.count("*").alias("n"))


@query(
    f"""WITH {facts.USAGES}, {facts.LITERALS} SELECT 'usage' AS kind, count(*) AS n FROM usages WHERE NOT regexp_matches(rel_path, '^src/m1[^/]\\.tsx$') AND namespace IS DISTINCT FROM 'ns2' AND (namespace IS NULL OR namespace IN ('ns1', 'ns2', 'ns3'))
UNION ALL SELECT 'literal', count(*) FROM literals WHERE NOT regexp_matches(file, '^d1[^/]*$')"""
)
def F04_filter_usages(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = policy.filter_facts(facts.usages(spark, sf_dir), ["src/m1?.tsx"], [], [], ["en"], ["ns1", "ns2", "ns3"], ["x"], ["ns2"])
    lit = policy.filter_facts(facts.literals(spark, sf_dir).withColumnRenamed("file", "rel_path"), ["d1*"], [], [], ["en"], ["ns1"])
    return u.agg(F.count("*").alias("n")).select(F.lit("usage").alias("kind"), "n").union(lit.agg(F.count("*").alias("n")).select(F.lit("literal"), "n"))


@query(engine._SETUP + f", i AS ({_ALL}) SELECT type, key, namespace, rel_path, line FROM i WHERE NOT (type = 'unused-key' AND (regexp_matches(key, '^ECONOMY\\.[^/]*$') OR regexp_matches(regexp_replace(key, '^.*\\.', ''), '^[^/]*_bolt$')))")
def F13_ignored_unused_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = issues.analyze(*engine._facts(spark, sf_dir), None, engine.OPTIONS)
    return policy.without_ignored_keys(found, ["ECONOMY.*", "*_bolt"]).select("type", "key", "namespace", "rel_path", "line")


@query(
    engine._SETUP + f""", i AS ({_ALL}), inside AS (SELECT coalesce(locale, '*') AS l, coalesce(namespace, '*') AS ns, key, min(ROW(rel_path, line, "column", coalesce(locale, ''), coalesce(namespace, ''))) AS p FROM d GROUP BY 1, 2, 3 HAVING count(*) >= 2 AND bool_or(starts_with(rel_path, 'locales/1/')))
SELECT type, key, namespace, rel_path, line FROM i WHERE type <> 'duplicate-key' AND starts_with(rel_path, 'locales/1/') UNION ALL SELECT 'duplicate-key', key, nullif(p[5], ''), p[1], p[2] FROM inside"""
)
def F10_scan_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, u, y = engine._facts(spark, sf_dir)
    found = issues.analyze(d, u, y, None, engine.OPTIONS)
    return issues.in_folder(found, d, "locales/1/", engine.OPTIONS).select("type", "key", "namespace", "rel_path", "line")


@query(engine._SETUP + f""", i AS ({_ALL}) SELECT type, key, namespace, rel_path, line, "column", CAST(row_number() OVER (ORDER BY type, key, coalesce(namespace, ''), rel_path, line, "column") AS INTEGER) AS place FROM i QUALIFY place <= 50""")
def O02_O06_report_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = issues.analyze(*engine._facts(spark, sf_dir), None, engine.OPTIONS)
    return sinks.head(found, 50).select("type", "key", "namespace", "rel_path", "line", "column", "place")


@query(
    engine._SETUP + f""", i AS ({_ALL}) SELECT type, severity, count(*) AS n FROM i WHERE type <> 'missing-key' OR line % 2 = 0 GROUP BY CUBE (type, severity)"""
)
def U01_merged_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = engine.cut(issues.analyze(*engine._facts(spark, sf_dir), None, engine.OPTIONS))
    parts = [found.where("type <> 'missing-key'"), found.where("type = 'missing-key' and line % 2 = 0")]
    return issues.stats(issues.merged(parts))


@query(
    engine._SETUP + engine._SUPPRESSED + """, c AS (SELECT count(*) AS n FROM definitions WHERE confidence < 0.6)
SELECT (SELECT count(*) FROM s WHERE NOT suppressed) AS errors, (SELECT n FROM c) AS warnings, CASE WHEN (SELECT n FROM c) > 0 THEN 1 ELSE 0 END::BIGINT AS exit_code"""
)
def A17_exit_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, u, _ = engine._facts(spark, sf_dir)
    found = policy.suppressed(issues.missing(d, u, engine.OPTIONS), facts.directives(spark, sf_dir)).where("not suppressed")
    lacking = d.where("confidence < 0.6").agg(F.count("*").alias("missing_count"))
    return policy.exit_code(found, lacking, exit_on_error=False, fail_on_warning=True)


@query(
    engine._SETUP + f""", i AS ({_ALL}) SELECT '{{"type":"' || type || '","severity":"' || severity || '","message":"' || replace(message, '"', '\\"') || '","key":"' || key || '","location":{{"rel_path":"' || rel_path || '","line":' || line || ',"column":' || "column" || '}},"source":{{' ||
  CASE WHEN namespace IS NULL THEN '' ELSE '"namespace":"' || namespace || '"' END || '}}}}' AS value FROM i"""
)
def K02_json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.json_rows(issues.analyze(*engine._facts(spark, sf_dir), None, engine.OPTIONS))


@query(
    engine._SETUP + f""", i AS ({_ALL}) SELECT '{{"ruleId":"' || type || '","level":"' || CASE severity WHEN 'info' THEN 'note' ELSE severity END || '","message":{{"text":"' || replace(message, '"', '\\"') || '"}},"locations":[{{"physicalLocation":{{"artifactLocation":{{"uri":"' || rel_path || '"}},"region":{{"startLine":' || line || ',"startColumn":' || "column" || '}}}}}}]}}' AS value FROM i"""
)
def K03_sarif_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.sarif_results(issues.analyze(*engine._facts(spark, sf_dir), None, engine.OPTIONS))


@query(engine._SETUP + f""", i AS ({_ALL}) SELECT '| ' || severity || ' | ' || type || ' | ' || key || ' | ' || rel_path || ':' || line || ' | ' || message || ' |' AS value FROM i""")
def K04_markdown_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.markdown_rows(issues.analyze(*engine._facts(spark, sf_dir), None, engine.OPTIONS))


def _json_list(column: str) -> str:
    return f"'[' || array_to_string([chr(34) || x || chr(34) FOR x IN {column}], ',') || ']'"


@query(
    engine._COVERAGE
    + f"""SELECT '{{"key":"' || key || '",' || CASE WHEN ns = '*' THEN '' ELSE '"namespace":"' || ns || '",' END || '"baseLocale":"en","locales":' || {_json_list('present')} || ',"missingLocales":' || {_json_list('missing')} || ',"extraLocales":' || {_json_list('extra')} || '}}' AS value,
  floor(coverage * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE AS coverage FROM c"""
)
def K05_coverage_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.coverage_rows(engine._model(spark, sf_dir)[1], engine.BASE)


@query(
    engine._COVERAGE + """, x AS (SELECT 'missing-translation' AS type, ns, key, unnest(missing) AS locale FROM c WHERE in_base UNION ALL SELECT 'extra-translation', ns, key, unnest(extra) FROM c WHERE NOT in_base)
SELECT type, nullif(ns, '*') AS namespace, key, locale, CAST(row_number() OVER (ORDER BY type, CASE WHEN ns = '*' THEN '' ELSE ns END, key, locale) AS INTEGER) AS place FROM x QUALIFY place <= 25"""
)
def O03_coverage_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, covered = engine._model(spark, sf_dir)
    return sinks.coverage_head(coverage.issues(model, covered, engine.BASE), 25).select("type", "namespace", "key", "locale", "place")


@query(
    engine._SETUP + f""", i AS ({_ALL}), e AS (SELECT DISTINCT rel_path, line, "column", CASE severity WHEN 'error' THEN 1 WHEN 'warning' THEN 2 ELSE 3 END AS level, type, message FROM i)
SELECT *, CAST(row_number() OVER (PARTITION BY rel_path ORDER BY line, "column", level, type, message) AS INTEGER) AS place FROM e QUALIFY place <= 5"""
)
def O08_U06_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return editor.diagnostics(issues.analyze(*engine._facts(spark, sf_dir), None, engine.OPTIONS), 5)


@query(
    f"""WITH {facts.DEFINITIONS}, l AS (SELECT ord, line, "column" AS col, key, CASE WHEN ord % 3 = 0 THEN line + 1 END AS el, CASE WHEN ord % 3 = 0 THEN 4 END AS ec, CASE WHEN ord % 3 = 1 THEN '    "' || string_split(key, '.')[-1] || '": 1' END AS t FROM definitions)
SELECT ord, line - 1 AS start_line, CASE WHEN t IS NOT NULL AND col - 1 <= 4 THEN 5 WHEN t IS NOT NULL AND col = 6 THEN 5 ELSE col - 1 END AS start_character, CASE WHEN el IS NOT NULL THEN el - 1 ELSE line - 1 END AS end_line,
  CASE WHEN el IS NOT NULL THEN 3 WHEN t IS NOT NULL AND col <= 6 THEN 5 + length(string_split(key, '.')[-1]) ELSE col END AS end_character FROM l"""
)
def P03_editor_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = facts.definitions(spark, sf_dir).select("ord", "line", "column", "key")
    third = F.col("ord") % 3
    rows = d.withColumns(
        {"end_line": F.when(third == 0, F.col("line") + 1), "end_column": F.when(third == 0, F.lit(4)), "line_text": F.when(third == 1, F.concat(F.lit('    "'), editor.last_segment(F.col("key")), F.lit('": 1')))}
    )
    return editor.ranges(rows).select("ord", "start_line", F.col("start_character").cast("long").alias("start_character"), "end_line", F.col("end_character").cast("long").alias("end_character"))


@query(
    """WITH u AS (SELECT l_orderkey * 10 + l_linenumber AS ord, 'f' || (l_partkey % 50) AS rel_path, l_orderkey % 200 AS line, CAST(l_linenumber * 3 AS BIGINT) AS col, l_orderkey % 200 + l_linenumber % 2 AS el, CAST(l_linenumber * 3 + 4 AS BIGINT) AS ec, l_suppkey % 4 = 0 AS dynamic FROM lineitem),
c AS (SELECT o_orderkey AS cursor, 'f' || (o_custkey % 50) AS rel_path, o_orderkey % 200 AS line, o_custkey % 25 AS ch FROM orders)
SELECT c.cursor, b.ord, b.dynamic FROM c LEFT JOIN (SELECT c.cursor, u.ord, u.dynamic FROM c JOIN u ON u.rel_path = c.rel_path AND c.line BETWEEN u.line AND u.el AND NOT (c.line = u.line AND c.ch < u.col) AND NOT (c.line = u.el AND c.ch > u.ec)
  QUALIFY row_number() OVER (PARTITION BY c.cursor ORDER BY NOT u.dynamic, u.ord) = 1) b USING (cursor)"""
)
def X22_usage_at_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = facts.load(spark, sf_dir, "lineitem")
    u = li.select(
        F.expr("l_orderkey * 10 + l_linenumber").alias("ord"), F.expr("concat('f', l_partkey % 50)").alias("rel_path"), F.expr("l_orderkey % 200").alias("line"), F.expr("cast(l_linenumber * 3 as bigint)").alias("column"),
        F.expr("l_orderkey % 200 + l_linenumber % 2").alias("end_line"), F.expr("cast(l_linenumber * 3 + 4 as bigint)").alias("end_column"), F.expr("l_suppkey % 4 = 0").alias("dynamic"),
    )
    o = facts.load(spark, sf_dir, "orders")
    c = o.select(F.col("o_orderkey").alias("cursor"), F.expr("concat('f', o_custkey % 50)").alias("rel_path"), F.expr("o_orderkey % 200").alias("line"), F.expr("o_custkey % 25").alias("character"))
    return editor.usage_at(c, u)


@query(engine._COVERAGE + "SELECT ns, key FROM c WHERE coverage = 1.0")
def U07_in_all_locales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.complete(engine._model(spark, sf_dir)[1])


@query(
    engine._COVERAGE.replace(facts.DEFINITIONS.strip(), facts.DEFINITIONS.strip().replace("definitions AS", "d0 AS", 1) + ", definitions AS (SELECT * FROM d0 WHERE ord % 3 <> 0 UNION ALL SELECT ord, key, locale, 'pkg' AS namespace, namespaces, rel_path, line, \"column\", confidence, value FROM d0 WHERE ord % 3 = 0)")
    + "SELECT ns, count(*) AS keys, count(*) FILTER (in_base) AS base FROM k GROUP BY ns"
)
def U02_merged_catalogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = facts.definitions(spark, sf_dir)
    parts = [d.where("ord % 3 <> 0"), d.where("ord % 3 = 0").withColumn("namespace", F.lit("pkg"))]
    covered = coverage.keys(coverage.merged_catalogs(parts, engine.LEAST), engine.BASE, engine.LOCALES)
    return covered.groupBy("ns").agg(F.count("*").alias("keys"), F.count_if("in_base").alias("base"))


# ---- streams

_EDITS = "edits AS (SELECT 'u' || user_id AS uri, event_id AS version, ts, event_type AS kind FROM events)"


@query(
    f"""WITH {_EDITS}, k AS (SELECT *, version % 4 = 0 AS fast FROM edits), g AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= CASE WHEN was_fast THEN INTERVAL 1 SECOND ELSE INTERVAL 6 HOURS END THEN 1 ELSE 0 END) OVER (PARTITION BY uri, fast ORDER BY ts, version) AS burst
  FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY uri, fast ORDER BY ts, version) AS gap, lag(fast) OVER (PARTITION BY uri, fast ORDER BY ts, version) AS was_fast FROM k))
SELECT uri, fast AS immediate, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS edits, max(version) AS version FROM g GROUP BY uri, fast, burst"""
)
def T08_immediate_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .library import edit_log

    log = edit_log(spark, sf_dir).withColumn("immediate", F.col("version") % 4 == 0)
    return edits.bursts_by_kind(log, "6 hours", "1 second")


@query(f"WITH {_EDITS} SELECT uri, bool_or(kind = 'click') AS sources, bool_or(kind = 'view') AS usages, bool_or(kind NOT IN ('click', 'view')) AS config FROM edits GROUP BY uri")
def T04_dirty_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .library import edit_log

    flag = F.when(F.col("kind") == "click", "sources").when(F.col("kind") == "view", "usages").otherwise("config")
    return edits.dirty_scopes(edit_log(spark, sf_dir).select("uri", flag.alias("dirty")))


@query(f"WITH {_EDITS}, r AS (SELECT uri, version, version // 10 AS generation FROM edits) SELECT uri, max(generation) AS generation, arg_max(version, ROW(generation, version)) AS version, count(*) FILTER (generation < m) AS stale FROM (SELECT *, max(generation) OVER (PARTITION BY uri) AS m FROM r) GROUP BY uri")
def T02_current_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .library import edit_log

    return edits.current(edit_log(spark, sf_dir).select("uri", "version", F.expr("version div 10").alias("generation")))


@query(
    f"""WITH {facts.DEFINITIONS}, t AS (SELECT DISTINCT rel_path FROM definitions WHERE rel_path LIKE '%/f1%'), n AS (SELECT rel_path, key || '.new' AS key, locale FROM definitions WHERE rel_path LIKE '%/f1.json')
SELECT rel_path, key, locale FROM definitions WHERE rel_path NOT IN (SELECT rel_path FROM t) UNION ALL SELECT * FROM n"""
)
def T05_refreshed_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = facts.definitions(spark, sf_dir).select("rel_path", "key", "locale")
    touched = d.where("rel_path like '%/f1%'").select("rel_path")
    anew = d.where("rel_path like '%/f1.json'").withColumn("key", F.concat("key", F.lit(".new")))
    return edits.refresh(d, touched, anew)
