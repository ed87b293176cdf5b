"""Queries of the issue engine, coverage, lookups and policy, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import coverage, issues, lookup, matching, policy
from ..storage import cut
from . import facts

OPTIONS = matching.MatchOptions(default_ns="ns0", fallback_ns=("ns4",), min_confidence=0.5)
BASE, LOCALES = "en", ["en", "de", "fr", "es"]
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# the definition of resolved namespaces under OPTIONS, and of facts above the least confidence
_SETUP = f"""
WITH {facts.DEFINITIONS}, {facts.USAGES}, {facts.DYNAMIC},
d AS (SELECT *, nullif(namespace, '') AS ns FROM definitions WHERE confidence >= 0.5),
u0 AS (SELECT *, CASE WHEN nullif(namespace, '') IS NULL THEN ['ns0', 'ns4'] WHEN namespace = 'ns4' THEN ['ns4'] ELSE [namespace, 'ns4'] END AS res FROM usages WHERE confidence >= 0.5),
u AS (SELECT * FROM u0),
y AS (SELECT *, CASE WHEN namespace IS NULL THEN ['ns0', 'ns4'] WHEN namespace = 'ns4' THEN ['ns4'] ELSE [namespace, 'ns4'] END AS res FROM dynamic_usages),
askedkeys AS (SELECT DISTINCT key FROM u),
askedns AS (SELECT DISTINCT key, unnest(res) AS ns FROM u),
probes AS (SELECT key, ns FROM d UNION SELECT key, unnest(namespaces) FROM d WHERE ns IS NOT NULL AND namespaces IS NOT NULL),
sib AS (SELECT rel_path, line, "column", key, list(DISTINCT n) AS siblings FROM (
    SELECT rel_path, line, "column", key, ns AS n FROM d WHERE ns IS NOT NULL
    UNION ALL SELECT rel_path, line, "column", key, unnest(namespaces) FROM d WHERE ns IS NOT NULL AND namespaces IS NOT NULL)
  GROUP BY ALL HAVING count(DISTINCT n) >= 2),
usedsites AS (
  SELECT ns, key FROM d WHERE ns IS NULL AND key IN (SELECT key FROM askedkeys)
  UNION SELECT d.ns, d.key FROM d JOIN askedns a ON a.key = d.key AND (a.ns = d.ns OR list_contains(d.namespaces, a.ns)) WHERE d.ns IS NOT NULL
  UNION SELECT d.ns, d.key FROM d JOIN sib s USING (rel_path, line, "column", key) JOIN askedns a ON a.key = d.key AND list_contains(s.siblings, a.ns) WHERE d.ns IS NOT NULL),
missing AS (
  SELECT first_ns, key, min(ROW(rel_path, line, "column", coalesce(namespace, ''))) AS p, count(*) AS n
  FROM (SELECT *, res[1] AS first_ns FROM u WHERE NOT suppress_unused_only
        AND key NOT IN (SELECT key FROM probes WHERE ns IS NULL)
        AND NOT EXISTS (SELECT 1 FROM probes p WHERE p.key = u.key AND p.ns IS NOT NULL AND list_contains(u.res, p.ns)))
  GROUP BY ALL),
missing_issues AS (
  SELECT 'missing-key' AS type, 'error' AS severity,
    'Missing translation key "' || key || '"' || CASE WHEN p[4] <> '' THEN ' in namespace "' || p[4] || '"' ELSE '' END || ' — used in code but not defined in translation sources.' AS message,
    key, nullif(p[4], '') AS namespace, p[1] AS rel_path, p[2] AS line, p[3] AS "column", n - 1 AS n_related, NULL::VARCHAR AS reason FROM missing),
dup AS (SELECT coalesce(locale, '*'), coalesce(namespace, '*'), key, count(*) AS n, min(ROW(rel_path, line, "column", coalesce(locale, ''), coalesce(namespace, ''))) AS p FROM d GROUP BY 1, 2, 3 HAVING count(*) >= 2),
dup_issues AS (
  SELECT 'duplicate-key' AS type, 'warning' AS severity,
    'Duplicate translation key "' || key || '" defined ' || n || ' times' || CASE WHEN p[4] <> '' THEN ' (locale "' || p[4] || '")' ELSE '' END || CASE WHEN p[5] <> '' THEN ' (namespace "' || p[5] || '")' ELSE '' END || '.' AS message,
    key, nullif(p[5], '') AS namespace, p[1] AS rel_path, p[2] AS line, p[3] AS "column", n - 1 AS n_related, NULL::VARCHAR AS reason FROM dup),
free AS (SELECT *, count(*) OVER (PARTITION BY ns, key) AS n FROM d WHERE NOT EXISTS (SELECT 1 FROM usedsites s WHERE s.key = d.key AND s.ns IS NOT DISTINCT FROM d.ns)),
hit AS (
  SELECT DISTINCT f.ns, f.key, y.ord FROM free f LEFT JOIN sib s USING (rel_path, line, "column", key)
  JOIN y ON (y.covers_namespace OR starts_with(f.key, y.prefix) OR suffix(f.key, y.suffix) OR contains(f.key, y.part))
    AND (f.ns IS NULL OR list_contains(y.res, f.ns) OR list_has_any(s.siblings, y.res))),
hits AS (SELECT ns, key, count(*) AS hits, min(ord) AS first FROM hit GROUP BY ALL),
unused_issues AS (
  SELECT 'unused-key' AS type, CASE WHEN hits > 0 THEN 'info' ELSE 'warning' END AS severity,
    CASE WHEN hits > 0 THEN 'Translation key "' || f.key || '"' || CASE WHEN f.ns IS NOT NULL THEN ' in namespace "' || f.ns || '"' ELSE '' END || ' may be unused — ' ||
        CASE WHEN y.covers_namespace THEN 'possibly covered by dynamic key lookup at ' || y.rel_path || ':' || y.line
             ELSE 'possible dynamic usage matching "' || coalesce(y.prefix, y.suffix, y.part, '…') || '" in ' || y.rel_path || ':' || y.line || CASE WHEN hits > 1 THEN ' (+' || (hits - 1) || ' other dynamic site(s))' ELSE '' END END
      ELSE 'Unused translation key "' || f.key || '"' || CASE WHEN f.ns IS NOT NULL THEN ' in namespace "' || f.ns || '"' ELSE '' END || ' — defined but never referenced.' END AS message,
    f.key, f.namespace, f.rel_path, f.line, f."column", f.n - 1 + coalesce(hits, 0) AS n_related, CASE WHEN hits > 0 THEN 'dynamic-usage' END AS reason
  FROM free f LEFT JOIN hits h ON h.key = f.key AND h.ns IS NOT DISTINCT FROM f.ns LEFT JOIN y ON y.ord = h.first)
"""


def _facts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return facts.definitions(spark, sf_dir), facts.usages(spark, sf_dir), facts.dynamic_usages(spark, sf_dir)


@query(_SETUP + "SELECT * FROM missing_issues")
def J02_missing_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, u, _ = _facts(spark, sf_dir)
    return issues.missing(d, u, OPTIONS)


@query(_SETUP + "SELECT * FROM dup_issues")
def A01_duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return issues.duplicates(facts.definitions(spark, sf_dir), OPTIONS)


@query(_SETUP + "SELECT * FROM unused_issues")
def J03_unused_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return issues.unused(*_facts(spark, sf_dir), OPTIONS)


@query(_SETUP + "SELECT ns AS ns_group, key, CAST(hits AS BIGINT) AS hits, first FROM hits")
def J05_dynamic_softening(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, u, y = _facts(spark, sf_dir)
    d, u = matching.confident(d, OPTIONS), matching.confident(u, OPTIONS)
    used = matching.used_groups(d, u, OPTIONS).alias("u")
    groups = d.select(matching.present().alias("ns_group"), "key").distinct().alias("g")
    free = groups.join(used, (F.col("g.key") == F.col("u.key")) & F.col("g.ns_group").eqNullSafe(F.col("u.ns_group")), "left_anti")
    return issues.dynamic_hits(cut(free.select("ns_group", "key")), d, y, OPTIONS)


@query(_SETUP + "SELECT DISTINCT ns AS ns_group, key FROM usedsites")
def J01_J04_used_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, u, _ = _facts(spark, sf_dir)
    return matching.used_groups(matching.confident(d, OPTIONS), matching.confident(u, OPTIONS), OPTIONS)


@query(_SETUP + "SELECT rel_path, line, \"column\", key, list_aggregate(list_sort(siblings), 'string_agg', '|') AS siblings FROM sib")
def J04_shared_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matching.shared_origins(matching.confident(facts.definitions(spark, sf_dir), OPTIONS))
    return found.withColumn("siblings", F.array_join(F.array_sort("siblings"), "|"))


@query(_SETUP + "SELECT * FROM missing_issues UNION ALL SELECT * FROM dup_issues UNION ALL SELECT * FROM unused_issues")
def O01_all_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return issues.ordered(issues.analyze(*_facts(spark, sf_dir), None, OPTIONS))


@query(_SETUP + "SELECT type, severity, count(*) AS n FROM (SELECT * FROM missing_issues UNION ALL SELECT * FROM dup_issues UNION ALL SELECT * FROM unused_issues) GROUP BY CUBE (type, severity)")
def A02_issue_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return issues.stats(issues.analyze(*_facts(spark, sf_dir), None, OPTIONS))


@query(
    _SETUP + """SELECT key, namespace, rel_path, line, "column" FROM u WHERE EXISTS (SELECT 1 FROM d WHERE d.key = u.key AND (d.ns IS NULL OR list_contains(u.res, d.ns)))"""
)
def J12_has_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, u, _ = _facts(spark, sf_dir)
    return issues.has_key(matching.confident(u, OPTIONS), matching.confident(d, OPTIONS), OPTIONS).select("key", "namespace", "rel_path", "line", "column")


@query(f"WITH {facts.USAGES} SELECT library, count(*) AS n, count(DISTINCT key) AS keys, count(DISTINCT namespace) AS namespaces FROM usages GROUP BY library")
def A12_usage_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.usages(spark, sf_dir).groupBy("library").agg(F.count("*").alias("n"), F.countDistinct("key").alias("keys"), F.countDistinct("namespace").alias("namespaces"))


@query(
    f"WITH {facts.DEFINITIONS} SELECT count(*) AS keys, count(DISTINCT locale) AS locales, count(DISTINCT namespace) AS namespaces, count(DISTINCT rel_path) AS sources, count(DISTINCT coalesce(locale, '*') || '::' || coalesce(namespace, '*') || '::' || key) AS full_keys FROM definitions"
)
def A10_catalog_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = facts.definitions(spark, sf_dir).withColumn("full", matching.full_key())
    n = lambda c: F.countDistinct(c)
    return d.agg(F.count("*").alias("keys"), n("locale").alias("locales"), n("namespace").alias("namespaces"), n("rel_path").alias("sources"), n("full").alias("full_keys"))


# ---- coverage

_COVERAGE = f"""
WITH {facts.DEFINITIONS},
f AS (SELECT *, coalesce(namespace, '*') AS ns FROM definitions WHERE confidence >= 0.6 AND coalesce(locale, '') <> ''),
m AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY ns, key, locale ORDER BY confidence DESC, ord) = 1),
k AS (SELECT ns, key, list(locale) AS present, max(confidence) AS confidence, bool_or(locale = 'en') AS in_base FROM m GROUP BY ns, key),
c AS (SELECT ns, key, in_base, [x FOR x IN ['en', 'de', 'fr', 'es'] IF list_contains(present, x)] AS present,
  CASE WHEN in_base THEN [x FOR x IN ['en', 'de', 'fr', 'es'] IF NOT list_contains(present, x)] ELSE ['en'] END AS missing,
  CASE WHEN in_base THEN [] ELSE [x FOR x IN ['en', 'de', 'fr', 'es'] IF list_contains(present, x)] END AS extra,
  len(present) / 4.0::DOUBLE AS coverage, CASE WHEN confidence = 0 THEN 1.0::DOUBLE ELSE confidence END AS confidence FROM k)
"""
LEAST = 0.6


def _model(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    model = coverage.merged(facts.definitions(spark, sf_dir), LEAST)
    return model, coverage.keys(model, BASE, LOCALES)


@query(_COVERAGE + 'SELECT ns, key, locale, rel_path, line, "column", confidence FROM m')
def A03_locale_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _model(spark, sf_dir)[0]


@query(
    _COVERAGE
    + """SELECT ord, 'Duplicate definition of "' || key || '" for locale "' || locale || '" in ' || winner || ' and ' || rel_path AS message FROM (
  SELECT *, max_by(rel_path, ROW(confidence, -ord)) OVER (PARTITION BY ns, key, locale ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS winner FROM f)
WHERE winner IS NOT NULL AND winner <> rel_path"""
)
def A04_duplicate_locale_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.duplicate_diagnostics(facts.definitions(spark, sf_dir), LEAST)


@query(
    _COVERAGE
    + "SELECT ns, key, in_base, array_to_string(present, '|') AS present, array_to_string(missing, '|') AS missing, array_to_string(extra, '|') AS extra, coverage, confidence FROM c"
)
def A05_key_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = {c: F.array_join(c, "|") for c in ("present", "missing", "extra")}
    return _model(spark, sf_dir)[1].drop("base_at").withColumns(joined)


@query(
    _COVERAGE
    + """SELECT l AS locale, count(*) FILTER (in_base AND list_contains(present, l)) AS present_count, count(*) FILTER (in_base) AS base_key_count,
  count(*) FILTER (list_contains(extra, l)) AS extra_count,
  CASE WHEN count(*) FILTER (in_base) = 0 THEN 1.0::DOUBLE ELSE floor(count(*) FILTER (in_base AND list_contains(present, l)) / (count(*) FILTER (in_base))::DOUBLE * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE END AS coverage
FROM c, unnest(['en', 'de', 'fr', 'es']) AS t(l) GROUP BY l"""
)
def A06_locale_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.by_locale(_model(spark, sf_dir)[1], LOCALES)


@query(
    _COVERAGE
    + """SELECT CASE WHEN ns = '*' THEN '(default)' ELSE ns END AS namespace, count(*) AS key_count, count(*) FILTER (in_base AND len(missing) > 0) AS missing_count, count(*) FILTER (NOT in_base) AS extra_count,
  CASE WHEN count(*) FILTER (in_base) = 0 THEN 1.0::DOUBLE ELSE floor(sum(CASE WHEN in_base THEN len(present) ELSE 0 END)::DOUBLE / (count(*) FILTER (in_base) * 4)::DOUBLE * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE END AS coverage
FROM c GROUP BY ns"""
)
def A07_namespace_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.by_namespace(_model(spark, sf_dir)[1], LOCALES)


@query(
    _COVERAGE
    + """SELECT count(*) AS total_keys, 4::BIGINT AS compared_locales, count(*) FILTER (in_base AND len(missing) > 0) AS missing_count, count(*) FILTER (NOT in_base) AS extra_count,
  floor(sum(CASE WHEN in_base THEN len(present) ELSE 0 END)::DOUBLE / (count(*) FILTER (in_base) * 4)::DOUBLE * 100::DOUBLE * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS coverage_percent FROM c"""
)
def A08_coverage_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.overall(_model(spark, sf_dir)[1], LOCALES)


@query(
    _COVERAGE
    + """SELECT 'missing-translation' AS type, c.key, l AS locale, nullif(c.ns, '*') AS namespace, m.rel_path, m.line, c.confidence,
  'Add key "' || c.key || '"' || CASE WHEN c.ns <> '*' THEN ' (namespace "' || c.ns || '")' ELSE '' END || ' to locale "' || l || '" (defined in ' || m.rel_path || ')' AS suggestion
FROM (SELECT *, unnest(missing) AS l FROM c WHERE in_base) c JOIN m ON m.ns = c.ns AND m.key = c.key AND m.locale = 'en'
UNION ALL
SELECT 'extra-translation', c.key, l, nullif(c.ns, '*'), m.rel_path, m.line, c.confidence,
  'Remove key "' || c.key || '"' || CASE WHEN c.ns <> '*' THEN ' in namespace "' || c.ns || '"' ELSE '' END || ' or add it to base locale "en"'
FROM (SELECT *, unnest(extra) AS l FROM c WHERE NOT in_base) c JOIN m ON m.ns = c.ns AND m.key = c.key AND m.locale = c.l"""
)
def A09_coverage_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, covered = _model(spark, sf_dir)
    return coverage.issues(model, covered, BASE)


@query(
    _COVERAGE
    + """SELECT ns, path, depth, bool_or(depth = n) AS is_leaf, count(*) AS leaf_count FROM (
  SELECT ns, key, len(parts) AS n, CAST(i AS INTEGER) AS depth, array_to_string(parts[1:i], '.') AS path FROM (
    SELECT ns, key, string_split(key, '.') AS parts, unnest(generate_series(1, len(string_split(key, '.')))) AS i FROM k)) GROUP BY ns, path, depth"""
)
def G07_key_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.key_tree(_model(spark, sf_dir)[0])


# ---- lookups

_LOOKUP = f"""
WITH {facts.DEFINITIONS}, {facts.USAGES}, requests AS (SELECT DISTINCT key || '@' || coalesce(namespace, '') AS req, key, namespace FROM usages),
e AS (SELECT r.req, d.* FROM requests r JOIN definitions d ON d.key = r.key AND d.namespace IS NOT DISTINCT FROM r.namespace),
x AS (SELECT * FROM e UNION ALL SELECT r.req, d.* FROM requests r JOIN definitions d ON d.key = r.key AND d.namespace IS NULL
  WHERE r.namespace IS NOT NULL AND r.req NOT IN (SELECT req FROM e)),
l AS (SELECT *, CAST(row_number() OVER (PARTITION BY req ORDER BY CASE locale WHEN 'de' THEN 0 WHEN 'en' THEN 1 ELSE 2 END, rel_path, line, ord) AS INTEGER) AS rank FROM x)
"""
PREFERRED = ["de", "en"]


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = facts.usages(spark, sf_dir).select("key", "namespace").distinct()
    return u.select(F.concat("key", F.lit("@"), F.coalesce("namespace", F.lit(""))).alias("req"), "key", "namespace")


@query(_LOOKUP + "SELECT req, ord, locale, rel_path, line, rank FROM l")
def J11_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.lookup(_requests(spark, sf_dir), facts.definitions(spark, sf_dir), PREFERRED).select("req", "ord", "locale", "rel_path", "line", "rank")


@query(
    _LOOKUP
    + "SELECT req, locale, value, rel_path, line, CAST(row_number() OVER (PARTITION BY req ORDER BY rank) AS INTEGER) AS rank FROM (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY req, locale ORDER BY rank) = 1)"
)
def W04_hover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.hover(_requests(spark, sf_dir), facts.definitions(spark, sf_dir), PREFERRED)


@query(
    f"""WITH {facts.DEFINITIONS} SELECT key, namespace, detail FROM (
  SELECT namespace, key, min(ord) AS o, arg_min(value, ROW(CASE locale WHEN 'de' THEN 0 WHEN 'en' THEN 1 ELSE 2 END, rel_path, line, ord)) AS detail
  FROM definitions WHERE starts_with(key, 'ECONOMY.') AND (namespace IS NULL OR namespace IN ('ns1', 'ns2')) GROUP BY namespace, key) ORDER BY o LIMIT 200"""
)
def O05_completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.completions(facts.definitions(spark, sf_dir), "ECONOMY.", ["ns1", "ns2"], PREFERRED)


# ---- policy


@query(
    f"""WITH {facts.DEFINITIONS}, p AS (SELECT DISTINCT rel_path FROM definitions)
SELECT rel_path, CASE WHEN i IS NOT NULL THEN 'ignoreFiles' WHEN e IS NOT NULL THEN 'exclude' WHEN n IS NOT NULL THEN 'include' ELSE 'not-included' END AS kind, coalesce(i, e, n) AS pattern FROM (
  SELECT rel_path, CASE WHEN regexp_matches(rel_path, '^(?:.*/)?f1[^/]\\.json$') THEN '**/f1?.json' END AS i,
    CASE WHEN regexp_matches(rel_path, '^locales/3(?:/.*)?$') THEN 'locales/3/**' WHEN regexp_matches(regexp_replace(rel_path, '^.*/', ''), '^f[^/]*2\\.json$') THEN 'f*2.json' END AS e,
    CASE WHEN regexp_matches(rel_path, '^locales/[^/]*/[^/]*\\.json$') AND rel_path NOT LIKE '%f0.json' THEN 'locales/*/*.json' WHEN rel_path LIKE '%/f0.json' AND rel_path LIKE 'locales/%' THEN 'locales/*/*.json' END AS n FROM p)"""
)
def F06_explain_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, pattern = policy.explain_file(F.col("rel_path"), ["**/f1?.json"], ["locales/3/**", "f*2.json"], ["locales/*/*.json"])
    return facts.definitions(spark, sf_dir).select("rel_path").distinct().select("rel_path", kind.alias("kind"), pattern.alias("pattern"))


@query(
    f"""WITH {facts.DEFINITIONS} SELECT ord, key, locale, namespace, rel_path FROM definitions
WHERE NOT regexp_matches(rel_path, '^(?:.*/)?f1[^/]\\.json$') AND rel_path NOT LIKE 'locales/3/%' AND (locale IS NULL OR locale IN ('en', 'de')) AND (namespace IS NULL OR namespace IN ('ns1', 'ns2', 'ns3'))"""
)
def F03_filter_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = policy.filter_facts(facts.definitions(spark, sf_dir), ["**/f1?.json"], ["locales/3/**"], [], ["en", "de"], ["ns1", "ns2", "ns3"])
    return d.select("ord", "key", "locale", "namespace", "rel_path")


@query(
    f"WITH {facts.DEFINITIONS} SELECT DISTINCT key, split_part(key, '.', 2) LIKE '%\\_ring' ESCAPE '\\' OR key LIKE 'PROMO.%' AND position('/' IN key) = 0 AS ignored FROM definitions"
)
def F07_ignored_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.definitions(spark, sf_dir).select("key").distinct().select("key", policy.ignored_key(F.col("key"), ["*_ring", "PROMO.*"]).alias("ignored"))


@query(
    _SETUP
    + """, i AS (SELECT * FROM missing_issues UNION ALL SELECT * FROM dup_issues UNION ALL SELECT * FROM unused_issues)
SELECT type, CASE WHEN type = 'missing-key' THEN 'warning' WHEN reason = 'dynamic-usage' THEN 'warning' ELSE 'error' END AS severity, key, rel_path, line FROM i WHERE type <> 'duplicate-key'"""
)
def F11_F12_severities(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = issues.analyze(*_facts(spark, sf_dir), None, OPTIONS)
    rules = {"missing-key": "warning", "duplicate-key": "off", "unused-key": "error"}
    return policy.severities(found, rules).select("type", "severity", "key", "rel_path", "line")


_SUPPRESSED = f"""
, {facts.DIRECTIVES}, i AS (SELECT * FROM missing_issues),
ev AS (SELECT rel_path, line, kind, unnest(CASE WHEN len(rules) = 0 THEN ['missing-key', 'unused-key'] ELSE rules END) AS type FROM directives),
reg AS (SELECT rel_path, type, line, max(kind) AS kind FROM ev WHERE kind IN ('disable', 'enable') GROUP BY ALL),
one AS (SELECT rel_path, line, kind, min(rules) AS rules FROM directives WHERE kind IN ('ignore', 'ignore-next') GROUP BY ALL),
ln AS (SELECT DISTINCT rel_path, line + CASE WHEN kind = 'ignore-next' THEN 1 ELSE 0 END AS line, unnest(CASE WHEN len(rules) = 0 THEN ['missing-key', 'unused-key'] ELSE rules END) AS type FROM one),
s AS (SELECT i.*, coalesce(r.kind = 'disable', false) OR EXISTS (SELECT 1 FROM ln WHERE ln.rel_path = i.rel_path AND ln.line = i.line AND ln.type = i.type) AS suppressed
  FROM i ASOF LEFT JOIN reg r ON r.rel_path = i.rel_path AND r.type = i.type AND i.line >= r.line)
"""


@query(_SETUP + _SUPPRESSED + 'SELECT type, key, namespace, rel_path, line, "column", suppressed FROM s')
def J08_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, u, _ = _facts(spark, sf_dir)
    return policy.suppressed(issues.missing(d, u, OPTIONS), facts.directives(spark, sf_dir)).select("type", "key", "namespace", "rel_path", "line", "column", "suppressed")


@query(_SETUP + _SUPPRESSED + "SELECT count(*) AS errors, 0::BIGINT AS warnings, CASE WHEN count(*) > 0 THEN 1 ELSE 0 END::BIGINT AS exit_code FROM s WHERE NOT suppressed")
def A17_exit_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, u, _ = _facts(spark, sf_dir)
    return policy.exit_code(policy.suppressed(issues.missing(d, u, OPTIONS), facts.directives(spark, sf_dir)).where("not suppressed"))
