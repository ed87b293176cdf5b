"""Queries of scalar functions, graphs and streams, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import locales, text
from ..operators import graph, issues, matching, policy, settings
from ..sources import catalog
from ..streaming import edits
from . import engine, facts

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _in(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _looks(t: str, loose: str) -> str:
    norm = f"replace({t}, '_', '-')"
    return (
        f"({t} <> '' AND length({t}) <= 20 AND (lower({norm}) IN {_in(locales.WELL_KNOWN)} OR (lower({norm}) NOT IN {_in(locales.BANNED)} AND {loose} "
        f"AND regexp_matches({norm}, {_sql(locales.SHAPE)}) AND (contains({norm}, '-') OR length({norm}) > 3))))"
    )


_PATHS = f"""
WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '[?].*$', ''), '^https?://[^/]+/', '') AS path FROM pages
  UNION ALL SELECT -1 - p_partkey, 'src/i18n/' || ['pt_BR', 'xx-YY', 'de', 'abc', 'zh-Hant', 'index'][(p_partkey % 6) + 1] || '/' || ['common', 'home.en', 'translation', 'fr', 'messages.de-AT'][(p_partkey % 5) + 1] || ['.json', '.yaml', '.ts'][(p_partkey % 3) + 1] FROM part),
s AS (SELECT *, string_split(path, '/') AS parts, regexp_replace(string_split(path, '/')[-1], {_sql(locales.EXTENSION)}, '') AS stem, regexp_matches(path, {_sql(locales.FOLDERS)}) AS loose FROM p)
"""


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = facts.load(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", "[?].*$", ""), "^https?://[^/]+/", "").alias("path"))
    more = facts.load(spark, sf_dir, "part").select(
        (-1 - F.col("p_partkey")).alias("page_id"),
        F.expr(
            "concat('src/i18n/', element_at(array('pt_BR', 'xx-YY', 'de', 'abc', 'zh-Hant', 'index'), cast(p_partkey % 6 as int) + 1), '/', "
            "element_at(array('common', 'home.en', 'translation', 'fr', 'messages.de-AT'), cast(p_partkey % 5 as int) + 1), element_at(array('.json', '.yaml', '.ts'), cast(p_partkey % 3 as int) + 1))"
        ).alias("path"),
    )
    return pages.union(more)


@query(
    _PATHS
    + f"""SELECT page_id, path, replace([t FOR t IN list_concat([stem], list_reverse(string_split(stem, '.')), list_reverse(parts[1:len(parts) - 1])) IF {_looks('t', 'loose')}][1], '_', '-') AS locale FROM s"""
)
def C06_infer_locale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).select("page_id", "path", locales.infer_locale(F.col("path")).alias("locale"))


@query(
    _PATHS
    + f""", n AS (SELECT *, [x FOR x IN string_split(stem, '.') IF x <> ''] AS dotted, CASE WHEN len(parts) >= 2 THEN parts[len(parts) - 1] END AS parent FROM s)
SELECT page_id, path, CASE
  WHEN len(dotted) >= 2 AND {_looks('dotted[-1]', 'true')} AND NOT {_looks('dotted[1]', 'true')} AND lower(dotted[1]) NOT IN {_in(locales.IGNORED_STEMS)} THEN dotted[1]
  WHEN stem <> '' AND NOT {_looks('stem', 'true')} AND lower(stem) NOT IN {_in(locales.IGNORED_STEMS)} THEN stem
  WHEN coalesce(parent, '') <> '' AND NOT {_looks('parent', 'true')} AND lower(parent) NOT IN {_in(locales.IGNORED_STEMS)} AND {_looks('stem', 'true')} THEN parent END AS namespace FROM n"""
)
def C08_infer_namespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).select("page_id", "path", locales.infer_namespace(F.col("path")).alias("namespace"))


_TECH = " OR ".join(f"regexp_matches(t, {_sql(p)})" for p in text.TECHNICAL)
_SCORED = f"""
WITH {facts.LITERALS}, x AS (SELECT *, regexp_replace(text, '^[{text.WS}]+|[{text.WS}]+$', '', 'g') AS t FROM literals),
scored AS (SELECT *, CASE WHEN length(t) < 2 OR {_TECH} OR len(regexp_extract_all(t, '[{text.LETTER}]')) < 2 THEN NULL
  WHEN regexp_matches(t, '[{text.WS}.!?:,]') THEN 0.85::DOUBLE WHEN regexp_matches(t, '^[A-Z][a-z]+([{text.WS}]|$)') OR length(t) >= 4 THEN 0.7::DOUBLE ELSE 0.55::DOUBLE END AS score FROM x)
"""


@query(_SCORED + "SELECT file, line, score FROM scored")
def C14_score_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.literals(spark, sf_dir).select("file", "line", text.score_literal(F.col("text")).alias("score"))


@query(
    _SCORED
    + """SELECT 'untranslated-text' AS type, 'info' AS severity, 'This text has no translation: "' || CASE WHEN length(text) > 60 THEN left(text, 59) || '…' ELSE text END || '"' AS message,
  text AS key, file AS rel_path, line FROM scored WHERE score >= 0.7"""
)
def J00_untranslated_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    lit = facts.literals(spark, sf_dir).withColumn("confidence", text.score_literal(F.col("text"))).where("confidence is not null")
    lit = lit.select("text", F.col("file").alias("rel_path"), "line", F.lit(1).cast("long").alias("column"), "confidence", F.lit(None).cast("string").alias("context"), F.lit(None).cast("string").alias("attribute"))
    return issues.untranslated(lit, matching.MatchOptions(min_confidence=0.7)).select("type", "severity", "message", "key", "rel_path", "line")


@query(
    "SELECT user_id, event_type, floor((1 - product(1 - least(1.0::DOUBLE, greatest(0.0::DOUBLE, value / 400)))) * 1000.0::DOUBLE + 0.5::DOUBLE) / 1000.0::DOUBLE AS confidence FROM events GROUP BY ALL"
)
def A13_noisy_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = facts.load(spark, sf_dir, "events")
    return e.groupBy("user_id", "event_type").agg(text.noisy_or(F.col("value") / 400).alias("confidence"))


@query(
    f"""WITH RECURSIVE {facts.EDGES}, r(node, hops) AS (SELECT * FROM (VALUES (1::BIGINT, 0), (2::BIGINT, 0)) UNION
  SELECT e.caller, r.hops + 1 FROM r JOIN edges e ON e.callee = r.node AND r.hops < 4) SELECT node, min(hops) AS hops FROM r GROUP BY node"""
)
def G03_reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = facts.edges(spark, sf_dir).select(F.col("callee").alias("src"), F.col("caller").alias("dst"))
    return graph.reachable(e, spark.createDataFrame([(1,), (2,)], "node bigint"), 4)


@query(
    f"""WITH RECURSIVE {facts.EDGES}, r(node, confidence, hops) AS (SELECT 1::BIGINT, 0.92::DOUBLE, 0 UNION
  SELECT e.caller, least(r.confidence, e.confidence, 0.85::DOUBLE), r.hops + 1 FROM r JOIN edges e ON e.callee = r.node AND e.caller <> e.callee AND r.hops < 64)
SELECT node, floor(confidence * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS confidence, hops, CASE hops WHEN 0 THEN 'seed' WHEN 1 THEN 'passthrough' ELSE 'nested' END AS kind FROM r
QUALIFY row_number() OVER (PARTITION BY node ORDER BY confidence DESC, hops) = 1"""
)
def G01_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.wrappers(facts.edges(spark, sf_dir), spark.createDataFrame([(1, 0.92)], "node bigint, confidence double"))
    return found.select("node", "confidence", "hops", "kind")


@query(
    """WITH RECURSIVE b AS (SELECT c_name AS name, CASE WHEN c_custkey % 10 = 0 THEN 'seed' ELSE 'Customer#' || lpad(CAST(c_custkey // 2 AS VARCHAR), 9, '0') END AS target FROM customer),
w(name, target, hops) AS (SELECT name, target, 1 FROM b UNION ALL SELECT w.name, b.target, hops + 1 FROM w JOIN b ON b.name = w.target WHERE hops < 40)
SELECT name, target, hops, false AS circular FROM w WHERE target NOT IN (SELECT name FROM b)"""
)
def G02_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = facts.load(spark, sf_dir, "customer").select("c_custkey", "c_name")
    b = c.select(F.col("c_name").alias("name"), F.expr("case when c_custkey % 10 = 0 then 'seed' else concat('Customer#', lpad(cast(c_custkey div 2 as string), 9, '0')) end").alias("target"))
    return graph.aliases(b)


_EDITS = "edits AS (SELECT 'u' || user_id AS uri, event_id AS version, ts, event_type AS kind FROM events)"


def edit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.load(spark, sf_dir, "events").select(F.concat(F.lit("u"), "user_id").alias("uri"), F.col("event_id").alias("version"), "ts", F.col("event_type").alias("kind"))


@query(
    f"""WITH {_EDITS}, g AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= INTERVAL 6 HOURS THEN 1 ELSE 0 END) OVER (PARTITION BY uri ORDER BY ts, version) AS burst
  FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY uri ORDER BY ts, version) AS gap FROM edits))
SELECT uri, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS edits, max(version) AS version FROM g GROUP BY uri, burst"""
)
def T01_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits.bursts(edit_log(spark, sf_dir), "6 hours")


@query(f"WITH {_EDITS} SELECT uri, max(version) AS version, max_by(ts, version) AS ts, max_by(kind, version) AS kind FROM edits GROUP BY uri HAVING max_by(kind, version) <> 'close'")
def T09_latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits.latest(edit_log(spark, sf_dir))


@query(
    _PATHS.replace("s AS (", "s0 AS (")
    + r"""SELECT page_id, path, CASE WHEN regexp_matches(lower(path), '(^|/)(package\.json|tsconfig[^/]*\.json|[^/]*\.config\.[cm]?[jt]s|next\.config\.[^/]*)$') THEN 'config'
  WHEN regexp_matches(lower(path), '\.(json|ya?ml)$') THEN 'sources' WHEN regexp_matches(lower(path), '\.([cm]?[jt]sx?|vue|svelte|astro|html)$') THEN 'usages' ELSE 'none' END AS dirty FROM p"""
)
def T03_dirty_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).select("page_id", "path", edits.dirty(F.col("path")).alias("dirty"))


@query(
    engine._SETUP + engine._SUPPRESSED
    + "SELECT rel_path AS uri, count(*) FILTER (NOT suppressed) AS n FROM s GROUP BY rel_path HAVING bool_or(suppressed)"
)
def U05_published_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, u, _ = engine._facts(spark, sf_dir)
    all_ = engine.cut(policy.suppressed(issues.missing(d, u, engine.OPTIONS), facts.directives(spark, sf_dir)))
    item = F.concat_ws("|", "key", "namespace", "line", "column").alias("item")
    return edits.published(all_.select(F.col("rel_path").alias("uri"), item), all_.where("not suppressed").select(F.col("rel_path").alias("uri"), item))


@query(
    engine._SETUP + """SELECT rel_path, line, "column", key, CAST(row_number() OVER (PARTITION BY rel_path ORDER BY line, "column", key) AS INTEGER) AS place FROM missing_issues QUALIFY place <= 10"""
)
def W07_diagnostics_of_a_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    d, u, _ = engine._facts(spark, sf_dir)
    place = F.row_number().over(Window.partitionBy("rel_path").orderBy("line", "column", "key"))
    return issues.missing(d, u, engine.OPTIONS).select("rel_path", "line", "column", "key", place.alias("place")).where("place <= 10")


@query("SELECT event_id AS file_id, 'k' AS key, json_extract_string(props, '$.k') AS value, 'number' AS value_kind FROM events")
def C11_flatten_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = facts.load(spark, sf_dir, "events").select(F.col("event_id").alias("file_id"), F.col("props").alias("text"))
    return catalog.extract(e).select("file_id", "key", "value", "value_kind")


# ---- identities, scopes and settings


@query(
    f"""WITH {facts.DEFINITIONS} SELECT ord, CASE WHEN namespace IS NULL THEN key ELSE namespace || chr(0) || key END = key AS plain,
  coalesce(locale, '*') || '::' || coalesce(namespace, '*') || '::' || key AS full_key FROM definitions"""
)
def C01_C02_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = facts.definitions(spark, sf_dir)
    return d.select("ord", (matching.logical_key(engine.OPTIONS) == F.col("key")).alias("plain"), matching.full_key().alias("full_key"))


@query(
    f"""WITH {facts.USAGES} SELECT namespace, array_to_string(CASE WHEN namespace IS NULL THEN ['ns0', 'ns4'] WHEN namespace = 'ns4' THEN ['ns4'] ELSE [namespace, 'ns4'] END, '|') AS resolved, count(*) AS n FROM usages GROUP BY ALL"""
)
def C04_resolved_namespaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = F.array_join(matching.resolve_namespaces(engine.OPTIONS), "|").alias("resolved")
    return facts.usages(spark, sf_dir).select("namespace", resolved).groupBy("namespace", "resolved").agg(F.count("*").alias("n"))


@query(f"WITH {facts.DEFINITIONS} SELECT ord, key, locale FROM definitions WHERE confidence >= 0.7 AND (locale IS NULL OR locale = 'de')")
def F01_F02_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = matching.MatchOptions(strict_locale=True, default_locale="de", min_confidence=0.7)
    return matching.in_scope(matching.confident(facts.definitions(spark, sf_dir), options), options).select("ord", "key", "locale")


@query(
    f"""WITH {facts.LITERALS}, x AS (SELECT file, line, nullif(regexp_replace(regexp_replace(text, '[{text.WS}]+', ' ', 'g'), '^[{text.WS}]+|[{text.WS}]+$', '', 'g'), '') AS t FROM literals)
SELECT file, line, CASE WHEN length(t) > 120 THEN left(t, 119) || '…' ELSE t END AS display FROM x"""
)
def C15_C16_display_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.literals(spark, sf_dir).select("file", "line", text.truncate(text.collapse(F.col("text")), 120).alias("display"))


@query(
    """SELECT c_mktsegment AS field, max_by(CAST(c_nationkey AS VARCHAR), ROW(c_acctbal, -c_custkey)) AS value, max_by(c_name, ROW(c_acctbal, -c_custkey)) AS source, count(DISTINCT c_nationkey) - 1 AS conflicts
FROM customer GROUP BY c_mktsegment"""
)
def A14_merge_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = facts.load(spark, sf_dir, "customer")
    return settings.merge(c.select(F.col("c_mktsegment").alias("field"), F.col("c_nationkey").cast("string").alias("value"), F.col("c_name").alias("source"), F.col("c_acctbal").alias("priority"), F.col("c_custkey").alias("ord")))


@query(
    rf"""WITH {facts.DEFINITIONS}, p AS (SELECT DISTINCT rel_path FROM definitions)
SELECT rel_path, CASE WHEN regexp_matches(rel_path, '(^|/)f7\.json$') THEN false WHEN regexp_matches(rel_path, '^locales/2/') THEN true WHEN regexp_matches(rel_path, '(^|/)f[^/]\.json$') THEN true ELSE false END AS ignored FROM p"""
)
def F08_gitignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = ["# build", "f?.json", "locales/2/", "!f7.json"]
    return facts.definitions(spark, sf_dir).select("rel_path").distinct().select("rel_path", settings.gitignored(F.col("rel_path"), rules).alias("ignored"))


@query(
    """WITH b AS (SELECT c_custkey AS id, c_nationkey AS file, c_custkey % 3 AS name, c_custkey AS decl, c_custkey + (c_custkey % 7) * 60 AS scope_end FROM customer),
u AS (SELECT o_orderkey AS use_id, o_custkey % 25 AS file, o_orderkey % 3 AS name, o_custkey AS pos FROM orders)
SELECT use_id, max_by(b.id, ROW(b.decl, b.id)) AS binding_id FROM u LEFT JOIN b ON b.file = u.file AND b.name = u.name AND b.decl <= u.pos AND u.pos <= b.scope_end GROUP BY use_id"""
)
def J09_binding_in_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = facts.load(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("binding_id"), F.col("c_nationkey").cast("long").alias("file"), F.expr("c_custkey % 3").alias("name"), F.col("c_custkey").alias("decl_pos"), F.expr("c_custkey + (c_custkey % 7) * 60").alias("scope_end")
    )
    u = facts.load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("use_id"), F.expr("o_custkey % 25").alias("file"), F.expr("o_orderkey % 3").alias("name"), F.col("o_custkey").alias("pos"))
    return settings.binding_at(u, b)


@query(
    f"""WITH {facts.DEFINITIONS}, x AS (SELECT DISTINCT CASE WHEN ord % 3 = 0 THEN 'ns1:' || key WHEN ord % 3 = 1 THEN 'http://' || key ELSE key END AS key FROM definitions)
SELECT key, CASE WHEN key LIKE 'ns1:%' THEN 'ns1' END AS ns, CASE WHEN key LIKE 'ns1:%' THEN substr(key, 5) ELSE key END AS local FROM x"""
)
def C20_inline_namespaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.expr("case when ord % 3 = 0 then concat('ns1:', key) when ord % 3 = 1 then concat('http://', key) else key end").alias("key")
    ns, local = settings.split_inline(F.col("key"))
    return facts.definitions(spark, sf_dir).select(given).distinct().select("key", ns.alias("ns"), local.alias("local"))


@query("SELECT s, CASE WHEN lower(s) IN ('error', '2', 'true') THEN 'error' WHEN lower(s) IN ('warn', 'warning', '1') THEN 'warning' WHEN lower(s) IN ('0', 'off', 'false') THEN 'off' WHEN lower(s) = 'info' THEN 'info' END AS severity, count(*) AS n FROM (SELECT (['Error', '1', 'WARN', 'off', 'info', 'true', 'x'])[(o_orderkey % 7) + 1] AS s FROM orders) GROUP BY ALL")
def C24_severity_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = facts.load(spark, sf_dir, "orders").select(F.expr("element_at(array('Error', '1', 'WARN', 'off', 'info', 'true', 'x'), cast(o_orderkey % 7 as int) + 1)").alias("s"))
    return o.select("s", text.coerce_severity(F.col("s")).alias("severity")).groupBy("s", "severity").agg(F.count("*").alias("n"))
