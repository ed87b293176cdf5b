"""Queries of catalogs and code, on files whose texts are made from the tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import editor, issues, modules
from ..sources import catalog, code, configs, extract, sinks
from . import engine, facts

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def _files(df: DataFrame, path: str, language: str, text: str) -> DataFrame:
    """One file for each row; path and text are expressions."""
    return df.select(F.expr(path).alias("rel_path"), F.lit(language).alias("language"), F.expr(text).alias("text"))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.load(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size")


# ---- catalogs

_JSON = r"""concat('{ // note\n "a": {"b": "', p_name, '"},\n "n": ', p_size, ', "l": [true, null], "n2": 1, "n2": 2,}')"""


@query(
    """SELECT p_partkey AS file_id, v.key, CASE v.key WHEN 'a.b' THEN p_name WHEN 'n' THEN CAST(p_size AS VARCHAR) ELSE v.value END AS value, v.kind AS value_kind, v.line,
  CASE v.key WHEN 'a.b' THEN 8 WHEN 'n' THEN 2 ELSE strpos(' "n": ' || p_size || ', "l": [true, null], "n2": 1, "n2": 2,}', v.mark) + v.more END AS "column"
FROM part, (VALUES ('a.b', '', 'string', 2::BIGINT, '', 0), ('n', '', 'number', 3, '', 0), ('l[0]', 'true', 'boolean', 3, 'true', 0), ('l[1]', 'null', 'null', 3, 'null', 0), ('n2', '2', 'number', 3, '"n2": 2', 0)) AS v(key, value, kind, line, mark, more)"""
)
def S09_json_catalogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _parts(spark, sf_dir).select(F.col("p_partkey").alias("file_id"), F.expr(_JSON).alias("text"))
    return catalog.extract(files).select("file_id", "key", "value", "value_kind", "line", "column")


_YAML = r"""concat('menu:\n  open: "', p_name, '"\n  size: ', p_size, ' # note\nlist:\n  - one\n  - ', p_brand, '\nmenu.x: ~\n')"""


@query(
    """SELECT 'f' || p_partkey || '.yml' AS rel_path, v.key, CASE v.key WHEN 'menu.open' THEN p_name WHEN 'menu.size' THEN CAST(p_size AS VARCHAR) WHEN 'list[1]' THEN p_brand ELSE v.value END AS value, v.kind AS value_kind, v.line, v.col AS "column"
FROM part, (VALUES ('menu.open', '', 'string', 2::BIGINT, 3::BIGINT), ('menu.size', '', 'number', 3, 3), ('list[0]', 'one', 'string', 5, 5), ('list[1]', '', 'string', 6, 5), ('menu.x', 'null', 'null', 7, 1)) AS v(key, value, kind, line, col)"""
)
def S10_yaml_catalogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract.facts(_files(_parts(spark, sf_dir), "concat('f', p_partkey, '.yml')", "yaml", _YAML), kinds=["entry"])
    return extract.view(found, "entry").select("rel_path", "key", "value", "value_kind", "line", "column")


_SCRIPT = r"""concat('const extra = { x: "1", deep: { y: `z` } };\nexport default { title: "', p_name, '", ...extra,\n  deep: { n: ', p_size, ' }, m: { id: "mid.', p_partkey, '", defaultMessage: "D" } } as const;\nexport const messages = { en: { hi: "Hi" }, de: { hi: \'', p_brand, '\' } };')"""


@query(
    """SELECT 'f' || p_partkey || '.ts' AS rel_path, CASE v.key WHEN 'mid' THEN 'mid.' || p_partkey ELSE v.key END AS key, CASE v.value WHEN 'name' THEN p_name WHEN 'size' THEN CAST(p_size AS VARCHAR) WHEN 'brand' THEN p_brand ELSE v.value END AS value, v.locale, v.line
FROM part, (VALUES ('title', 'name', NULL, 2::BIGINT), ('x', '1', NULL, 1), ('deep.n', 'size', NULL, 3), ('mid', 'D', NULL, 3), ('hi', 'Hi', 'en', 4), ('hi', 'brand', 'de', 4)) AS v(key, value, locale, line)"""
)
def S11_script_catalogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract.facts(_files(_parts(spark, sf_dir), "concat('f', p_partkey, '.ts')", "typescript", _SCRIPT), kinds=["entry"])
    return extract.view(found, "entry").select("rel_path", "key", "value", "locale", "line")


_BASE = r"""concat('import { deep as d } from "../more/m', p_partkey % 7, '";\nexport default { shared: "', p_name, '", d, ...d };')"""
_PAGE = r"""concat('import base from "../../base/b', p_partkey, '";\nexport default { own: "', p_brand, '", box: { ...base } };')"""
_MORE = r"""concat('export const deep = { leaf: { k: "m', k, '" } };')"""


@query(
    """SELECT v.dir || CASE v.dir WHEN 'more/m' THEN p_partkey % 7 ELSE p_partkey END || '.ts' AS rel_path, v.key, CASE v.key WHEN 'own' THEN p_brand WHEN 'box.shared' THEN p_name ELSE 'm' || (p_partkey % 7) END AS value, count(*) AS n
FROM part, (VALUES ('locales/en/p', 'own'), ('base/b', 'box.shared'), ('more/m', 'box.d.leaf.k'), ('more/m', 'box.leaf.k')) AS v(dir, key) GROUP BY ALL"""
)
def S12_spreads(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _parts(spark, sf_dir)
    more = spark.range(7).withColumnRenamed("id", "k")
    files = _files(p, "concat('base/b', p_partkey, '.ts')", "typescript", _BASE).union(_files(p, "concat('locales/en/p', p_partkey, '.ts')", "typescript", _PAGE)).union(_files(more, "concat('more/m', k, '.ts')", "typescript", _MORE))
    files = extract.cut(files)
    found = extract.kept(extract.facts(files, kinds=extract.OF_DEFINITIONS))
    links = extract._links(found, files, None)
    own = extract.view(found, "entry").where("rel_path like 'locales/%'").select("rel_path", "key", "value")
    spread = extract.spread_entries(found, links).where("spread_into like 'locales/%'").select("rel_path", "key", "value")
    return own.union(spread).groupBy("rel_path", "key", "value").agg(F.count("*").alias("n"))


_INIT = r"""concat('import i18n from "i18next";\ni18n.use(x).init({ lng: "en", resources: { en: { common: { ok: "', p_name, '" }, home: { a: { b: "', p_brand, '" } } }, "pt-BR": { common: { ok: "s', p_size, '" } } } });')"""


@query(
    """SELECT 'i' || p_partkey || '.js' AS rel_path, v.locale, v.ns AS namespace, v.key, CASE v.value WHEN 'name' THEN p_name WHEN 'brand' THEN p_brand ELSE 's' || p_size END AS value
FROM part, (VALUES ('en', 'common', 'ok', 'name'), ('en', 'home', 'a.b', 'brand'), ('pt-BR', 'common', 'ok', 'size')) AS v(locale, ns, key, value)"""
)
def S13_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.facts_of_kind(_files(_parts(spark, sf_dir), "concat('i', p_partkey, '.js')", "javascript", _INIT), "entry", ["locale", "namespace", "key", "value"])


_REGISTER = r"""concat('import i18n from "./i18n";\nimport home from "./home', p_partkey, '";\ni18n.addResourceBundle("en", "ns', p_partkey % 5, '", home);\ni18n.addResource("de", "in', p_size, '", "one.key", "', p_name, '");')"""


@query(
    """SELECT 'src/home' || p_partkey || '.ts' AS rel_path, 'en' AS locale, 'ns' || (p_partkey % 5) AS namespace, 'title' AS key, p_brand AS value FROM part
UNION ALL SELECT 'src/r' || p_partkey || '.ts', 'de', 'in' || p_size, 'one.key', p_name FROM part"""
)
def S14_J06_registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _parts(spark, sf_dir)
    home = "concat('export default { title: \"', p_brand, '\" };')"
    files = extract.cut(_files(p, "concat('src/r', p_partkey, '.ts')", "typescript", _REGISTER).union(_files(p, "concat('src/home', p_partkey, '.ts')", "typescript", home)))
    return extract.definitions(extract.kept(extract.facts(files, kinds=extract.OF_DEFINITIONS)), files).select("rel_path", "locale", "namespace", "key", "value")


# ---- code

_HOOKS = r"""concat('import { useTranslation } from "react-i18next";\nexport function A({ c, x }) {\n  const { t } = useTranslation(["ns', p_partkey % 3, '", "b"], { keyPrefix: "p" });\n  const tx = t;\n  tx("', p_brand, '"); t("k", { ns: "other" }); t(c ? "yes" : \'no\'); t(`dyn.$', '{x}.end`); t("pre." + x); t(x);\n  const { t: u } = useTranslation();\n  u("in:', p_size, '"); // u("no")\n}')"""


@query(
    """SELECT 'a' || p_partkey || '.tsx' AS rel_path, CASE v.key WHEN 'brand' THEN 'p.' || p_brand WHEN 'size' THEN CAST(p_size AS VARCHAR) ELSE v.key END AS key, CASE v.ns WHEN 'n' THEN 'ns' || (p_partkey % 3) || '|b' ELSE v.ns END AS namespaces, 'react-i18next' AS library, v.sure AS confidence, v.line
FROM part, (VALUES ('brand', 'n', 0.9::DOUBLE, 5::BIGINT), ('p.k', 'other', 0.9, 5), ('p.yes', 'n', 0.9, 5), ('p.no', 'n', 0.9, 5), ('size', 'in', 0.75, 7)) AS v(key, ns, sure, line)"""
)
def X06_i18next_usages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract.facts_of_kind(_files(_parts(spark, sf_dir), "concat('a', p_partkey, '.tsx')", "typescript", _HOOKS), "usage", ["key", "namespaces", "library", "confidence", "line"])
    return found.select("rel_path", "key", F.array_join("namespaces", "|").alias("namespaces"), "library", "confidence", "line")


@query(
    """SELECT 'a' || p_partkey || '.tsx' AS rel_path, 'ns' || (p_partkey % 3) || '|b' AS namespaces, v.pre AS prefixes, v.suf AS suffixes, 0.45::DOUBLE AS confidence FROM part, (VALUES ('dyn.', '.end'), ('pre.', '')) AS v(pre, suf)"""
)
def X05_dynamic_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract.facts_of_kind(_files(_parts(spark, sf_dir), "concat('a', p_partkey, '.tsx')", "typescript", _HOOKS), "dynamic", ["namespaces", "prefixes", "suffixes", "confidence"])
    line = lambda c: F.array_join(c, "|").alias(c)
    return found.select("rel_path", line("namespaces"), line("prefixes"), line("suffixes"), "confidence")


_LIBRARIES = {
    "X07_next_intl": (r"""concat('import { useTranslations } from "next-intl";\nconst t = useTranslations("Ns', p_size, '");\nt("', p_brand, '");')""", "p_brand", "'Ns' || p_size", "next-intl", 0.92),
    "X08_react_intl": (r"""concat('import { useIntl } from "react-intl";\nconst intl = useIntl();\nintl.formatMessage({ defaultMessage: "x", id: "', p_name, '" });')""", "p_name", "''", "react-intl", 0.9),
    "X09_lingui": (r"""concat('import { msg } from "@lingui/macro";\nconst m = msg("', p_name, '");')""", "p_name", "''", "lingui", 0.8),
    "X10_vue_i18n": (r"""concat('import { useI18n } from "vue-i18n";\nconst { t } = useI18n();\nt("', p_brand, '");')""", "p_brand", "''", "vue-i18n", 0.9),
    "X11_ngx_translate": (r"""concat('import { TranslateService } from "@ngx-translate/core";\nclass C { constructor(private tr: TranslateService) {} f() { return this.tr.instant("', p_name, '"); } }')""", "p_name", "''", "ngx-translate", 0.88),
}


def _library(name: str, text: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = extract.facts_of_kind(_files(_parts(spark, sf_dir), "concat('a', p_partkey, '.ts')", "typescript", text), "usage", ["key", "namespaces", "library", "confidence"])
        return found.select("rel_path", "key", F.array_join("namespaces", "|").alias("namespaces"), "library", "confidence")

    run.__name__ = name
    QUERIES[name] = run


for _name, (_text, _key, _ns, _id, _sure) in _LIBRARIES.items():
    _library(_name, _text)
    ORACLES[_name] = f"SELECT 'a' || p_partkey || '.ts' AS rel_path, {_key} AS key, {_ns} AS namespaces, '{_id}' AS library, {_sure}::DOUBLE AS confidence FROM part"

_SHARED = r"""concat('export enum Status { A = "st.', k, '", B = "st.b" }\nexport const labels: Record<string, { text: string }> = { q: { text: "lab.', k, '" }, r: { text: "lab.r" } };\nexport function pick(x) { if (x) return "pick.one"; return `pick.two`; }')"""
_USER = r"""concat('import { useTranslation } from "react-i18next";\nimport { Status, labels, pick } from "../index', p_partkey % 5, '";\nconst own = { a: "own.a", b: "own.', p_size, '" };\nfunction F({ s, mode }: { s: string; mode: "m.on" | "m.off" }) {\n  const { t } = useTranslation("n");\n  t(Status.A); t(labels[s].text); t(pick(s)); Object.values(Status).map((v) => t(`x.$', '{v}`));\n  t(own[s]); ["l.1", "l.2"].map((i) => t(i)); t(mode); Object.keys(own).forEach((k) => t(k));\n}')"""


@query(
    """SELECT 'src/u' || p_partkey || '.tsx' AS rel_path, CASE v.key WHEN 'A' THEN 'st.' || (p_partkey % 5) WHEN 'L' THEN 'lab.' || (p_partkey % 5) WHEN 'XA' THEN 'x.st.' || (p_partkey % 5) WHEN 'O' THEN 'own.' || p_size ELSE v.key END AS key, 'n' AS namespace, 0.85::DOUBLE AS confidence, v.line
FROM part, (VALUES ('A', 6::BIGINT), ('L', 6), ('lab.r', 6), ('pick.one', 6), ('pick.two', 6), ('XA', 6), ('x.st.b', 6), ('own.a', 7), ('O', 7), ('l.1', 7), ('l.2', 7), ('m.on', 7), ('m.off', 7), ('a', 7), ('b', 7)) AS v(key, line)"""
)
def X13_X14_J14_indirect_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = _parts(spark, sf_dir), spark.range(5).withColumnRenamed("id", "k")
    files = _files(p, "concat('src/u', p_partkey, '.tsx')", "typescript", _USER).union(_files(k, "concat('lib/s', k, '.ts')", "typescript", _SHARED)).union(_files(k, "concat('index', k, '.ts')", "typescript", "concat('export * from \"./lib/s', k, '\";')"))
    files = extract.cut(files)
    static, _ = extract.usages(extract.kept(extract.facts(files, kinds=extract.OF_USAGES)), files)
    return static.select("rel_path", "key", "namespace", "confidence", "line")


_MARKUP = r"""concat('import { useTranslation } from "react-i18next";\nexport const A = () => { const { t } = useTranslation(); return <div title="Open the ', p_brand, '" className="no prose here">\n  Hello you and ', p_size, ' others {t("a.b")} <code>not this one</code><Trans>nor this</Trans>{"Click me now"} <img alt={"x"} /> &nbsp;</div>; };')"""


@query(
    """SELECT 'm' || p_partkey || '.tsx' AS rel_path, CASE v.text WHEN 'title' THEN 'Open the ' || p_brand WHEN 'hello' THEN 'Hello you and ' || p_size || ' others' ELSE v.text END AS text, v.context, v.attribute, 0.85::DOUBLE AS confidence, v.line
FROM part, (VALUES ('title', 'jsx-attribute', 'title', 2::BIGINT), ('hello', 'jsx-text', NULL, 2), ('Click me now', 'jsx-expression', NULL, 3)) AS v(text, context, attribute, line)"""
)
def X12_untranslated_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(_parts(spark, sf_dir), "concat('m', p_partkey, '.tsx')", "typescript", _MARKUP).union(_files(_parts(spark, sf_dir), "concat('m', p_partkey, '.test.tsx')", "typescript", _MARKUP))
    return extract.literals_of(files).select("rel_path", "text", "context", "attribute", "confidence", "line")


_TEMPLATE = r"""concat('<template>\n  <!-- $t("no") --><p :title="$t(\'', p_brand, '\')" v-t="\'dir.x\'">{{ t("v.', p_size, '") }} {{ $tm("nuxt") }}</p>\n  <i18n-t keypath="kp.a"/>\n</template>\n<script setup>\nimport { useI18n } from "vue-i18n";\nconst { t } = useI18n();\nt("s.a");\n</script>\n<style>.t("x"){}</style>')"""


@query(
    """SELECT 'c' || p_partkey || '.vue' AS rel_path, CASE v.key WHEN 'brand' THEN p_brand WHEN 'size' THEN 'v.' || p_size ELSE v.key END AS key, v.sure AS confidence, v.line FROM part, (VALUES ('brand', 0.85::DOUBLE, 2::BIGINT), ('dir.x', 0.8, 2), ('size', 0.75, 2), ('kp.a', 0.8, 3), ('s.a', 0.9, 8)) AS v(key, sure, line)"""
)
def C29_C33_vue_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract.facts(_files(_parts(spark, sf_dir), "concat('c', p_partkey, '.vue')", "vue", _TEMPLATE), kinds=["usage"])
    return extract.view(found, "usage").select("rel_path", "key", "confidence", "line")


_OTHERS = {
    "C30_nuxt_templates": ("vue", r"""concat('<template><b>{{ $tm("', p_brand, '") }}</b></template>')""", "p_brand", 0.8, True),
    "C31_angular_templates": ("html", r"""concat('<b translate="', p_name, '"></b><i>{{ "pipe.x" | translate }}</i>')""", "unnest([p_name, 'pipe.x'])", "unnest([0.8, 0.85])", False),
    "C32_svelte_templates": ("svelte", r"""concat('<style>t("no")</style><p>{$t("', p_brand, '")} {$_(`s.x`)}</p>')""", "unnest([p_brand, 's.x'])", 0.86, False),
}


def _template(name: str, language: str, text: str, nuxt: bool) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = extract.facts(_files(_parts(spark, sf_dir), "concat('t', p_partkey)", language, text), nuxt, kinds=["usage"])
        return extract.view(found, "usage").select("rel_path", "key", "confidence")

    run.__name__ = name
    QUERIES[name] = run


for _name, (_language, _text, _key, _sure, _nuxt) in _OTHERS.items():
    _template(_name, _language, _text, _nuxt)
    ORACLES[_name] = f"SELECT rel_path, key, CAST(confidence AS DOUBLE) AS confidence FROM (SELECT 't' || p_partkey AS rel_path, {_key} AS key, {_sure} AS confidence FROM part)"

_SYMBOLS = r"""concat('import a, { b as c } from "./x', p_size, '";\nexport { c as d, e } ; export { f as g } from "./y"; export * from "./z"; export * as ns from "./w";\nexport const e2 = 1, e3 = 2; export default function Main() {}\nconst h = (k) => t(k); function w(key) { return h(key); }')"""


@query(
    """SELECT 'e' || p_partkey || '.ts' AS rel_path, v.name, v.kind, CASE v.source WHEN 'x' THEN './x' || p_size ELSE v.source END AS source, v.other AS source_name
FROM part, (VALUES ('d', 're-export', 'x', 'b'), ('e', 'local', NULL, 'e'), ('g', 're-export', './y', 'f'), ('*', 'star', './z', NULL), ('ns', 're-export', './w', '*'), ('e2', 'local', NULL, 'e2'), ('e3', 'local', NULL, 'e3'), ('default', 'default', NULL, 'Main')) AS v(name, kind, source, other)"""
)
def X16_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract.facts(_files(_parts(spark, sf_dir), "concat('e', p_partkey, '.ts')", "typescript", _SYMBOLS), kinds=["export"])
    return extract.view(found, "export")


@query(
    """SELECT 'e' || p_partkey || '.ts' AS rel_path, v.* FROM part, (VALUES ('h', 't', 'call', true), ('w', 'h', 'call', true)) AS v(caller, callee, kind, forwards)"""
)
def X17_call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.facts_of_kind(_files(_parts(spark, sf_dir), "concat('e', p_partkey, '.ts')", "typescript", _SYMBOLS), "edge")


_COMMENTS = r"""concat('// keyloom-disable missing-key bogus\na = "keyloom-enable"; /* keyloom-enable unusedKey */\n// keyloom-ignore-next-line hardcoded, duplicate\n// keyloom-ignore no-such-rule\n// ', p_brand, ' keyloom-ignore')"""


@query(
    """SELECT 'd' || p_partkey || '.ts' AS rel_path, v.* FROM part, (VALUES (1::BIGINT, 'disable', 'missing-key'), (2, 'enable', 'unused-key'), (3, 'ignore-next', 'untranslated-text|duplicate-key'), (5, 'ignore', '')) AS v(line, kind, rules)"""
)
def X20_directives(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(_parts(spark, sf_dir), "concat('d', p_partkey, '.ts')", "typescript", _COMMENTS)
    return code.extract_directives(files, "keyloom").withColumn("rules", F.array_join("rules", "|"))


_BINDINGS = r"""concat('function usersColumns(t) { return [t("col.', p_size, '")]; }\nfunction Page() { const { t } = useTranslation("users', p_partkey % 4, '"); return usersColumns(t); }')"""


@query(
    """SELECT v.key, n AS namespaces, count(*) AS n FROM (SELECT 'col.' || p_size AS key, (SELECT string_agg(DISTINCT 'users' || (p_partkey % 4), '|') FROM part) AS n FROM part) AS v GROUP BY ALL"""
    .replace("string_agg(DISTINCT 'users' || (p_partkey % 4), '|')", "string_agg(DISTINCT 'users' || (p_partkey % 4), '|' ORDER BY 'users' || (p_partkey % 4))")
)
def J15_X14_call_site_namespaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = extract.cut(_files(_parts(spark, sf_dir), "concat('p', p_partkey, '.tsx')", "typescript", _BINDINGS))
    static, _ = extract.usages(extract.kept(extract.facts(files, kinds=extract.OF_USAGES)), files)
    names = F.coalesce(F.array_join("namespaces", "|"), F.col("namespace")).alias("namespaces")
    return static.select("key", names).groupBy("key", "namespaces").agg(F.count("*").alias("n"))


_MODULES = """WITH f AS (SELECT p_partkey AS id, 'm' || p_partkey AS rel_path, CASE WHEN p_partkey % 3 = 0 THEN './m' || (p_partkey // 2) ELSE './none' END AS spec FROM part)"""


@query(_MODULES + " SELECT f.rel_path || '.ts' AS rel_path, f.spec, g.rel_path || '.ts' AS target FROM f LEFT JOIN f g ON './' || g.rel_path = f.spec")
def J10_import_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _parts(spark, sf_dir)
    text = "concat('import x from \"', case when p_partkey % 3 = 0 then concat('./m', p_partkey div 2) else './none' end, '\";')"
    files = extract.cut(_files(p, "concat('m', p_partkey, '.ts')", "typescript", text))
    imports = extract.cut(extract.facts_of_kind(files, "import", ["source"]).withColumnRenamed("source", "spec"))
    return modules.resolved(imports, files.select("rel_path")).select("rel_path", "spec", "target")


# ---- settings, related files and constants

_SETUP = r"""concat('import i18n from "i18next";\nconst ns = ["common", "ns', p_size % 3, '"];\ni18n.use(x).init({ lng: "de_AT", defaultNS: "', lower(p_brand), '", fallbackNS: ["shared"], ns, supportedLngs: ["de", "pt_BR"], fallbackLng: { "de-AT": ["de"], default: ["en"] }, nsSeparator: false });')"""


@query(
    """SELECT 'i18n' || p_partkey || '.ts' AS rel_path, 'i18next' AS library, v.field, CASE v.vals WHEN 'brand' THEN lower(p_brand) WHEN 'ns' THEN 'common|ns' || (p_size % 3) ELSE v.vals END AS vals, 0.9::DOUBLE AS confidence
FROM part, (VALUES ('defaultNS', 'brand'), ('fallbackNS', 'shared'), ('namespaces', 'ns'), ('defaultLocale', 'de-at'), ('supportedLocales', 'de|pt-br'), ('fallbackLocales', 'en'), ('localeInheritance', 'de-at=de'), ('nsSeparator', '')) AS v(field, vals)"""
)
def S17_library_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(_parts(spark, sf_dir), "concat('i18n', p_partkey, '.ts')", "typescript", _SETUP)
    return configs.fragments(files).select("rel_path", "library", "field", F.array_join("values", "|").alias("vals"), "confidence")


_NEXT = r"""concat('module.exports = withX({ i18n: { defaultLocale: "en_US", locales: ["en_US", "l', p_size, '"] }, reactStrictMode: true });')"""


@query(
    """SELECT 'p' || p_partkey || '/next.config.js' AS rel_path, 'unknown' AS library, v.field, CASE v.field WHEN 'defaultLocale' THEN 'en-us' ELSE 'en-us|l' || p_size END AS vals, 0.88::DOUBLE AS confidence FROM part, (VALUES ('defaultLocale'), ('supportedLocales')) AS v(field)"""
)
def S17_next_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(_parts(spark, sf_dir), "concat('p', p_partkey, '/next.config.js')", "javascript", _NEXT)
    return configs.fragments(files).select("rel_path", "library", "field", F.array_join("values", "|").alias("vals"), "confidence")


_CARD = r"""concat('import { useTranslation } from "react-i18next";\nexport function Card(props) { const { t } = useTranslation("n"); return t(props.title) + t(props.own); }\nexport function Page() { const { t } = useTranslation(); const label = getRouteParam(r, "label"); return t(label); }')"""
_ITEMS = r"""concat('export const items = [{ title: "it.', p_size, '", other: "no" }];')"""


@query(
    """SELECT 'src/app/pages/g' || (p_partkey % 9) || '/c' || p_partkey || '.tsx' AS rel_path, v.key, v.namespace, count(*) AS n FROM (
  SELECT DISTINCT a.p_partkey, 'it.' || b.p_size AS key, 'n' AS namespace FROM part a JOIN (SELECT DISTINCT p_partkey % 9 AS g, p_size FROM part) b ON a.p_partkey % 9 = b.g
  UNION ALL SELECT p_partkey, 'rt.label', NULL FROM part UNION ALL SELECT p_partkey, 'cfg.title', 'n' FROM part) AS v JOIN part p USING (p_partkey) GROUP BY ALL"""
)
def X13_J17_related_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _parts(spark, sf_dir)
    one = spark.range(1)
    files = _files(p, "concat('src/app/pages/g', p_partkey % 9, '/c', p_partkey, '.tsx')", "typescript", _CARD).union(_files(p, "concat('src/app/pages/g', p_partkey % 9, '/deep/i', p_partkey, '.ts')", "typescript", _ITEMS))
    files = files.union(_files(one, "'lib/mainRoute.ts'", "typescript", "'export const route = { path: \"/\", label: \"rt.label\" };'")).union(_files(one, "'lib/navConfig.ts'", "typescript", "'export const nav = { a: { title: \"cfg.title\" } };'"))
    files = files.union(_files(one, "'lib/other.ts'", "typescript", "'export const none = { a: { title: \"never\" } };'"))
    files = extract.cut(files)
    static, _ = extract.usages(extract.kept(extract.facts(files, kinds=extract.OF_USAGES)), files)
    return static.groupBy("rel_path", "key", "namespace").agg(F.count("*").alias("n"))


_CONSTANTS = r"""concat('import { base } from "./b";\nenum E { A = "a" }\nconst one = "', p_brand, '", two = one + base, three = { k: E.A, f: two };\nlet four = one; const fn = () => three;')"""


@query("SELECT 'k' || p_partkey || '.ts' AS rel_path, v.* FROM part, (VALUES ('two', 'one'), ('two', 'base'), ('three', 'E'), ('three', 'two')) AS v(name, needs)")
def G10_constant_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.view(extract.facts(_files(_parts(spark, sf_dir), "concat('k', p_partkey, '.ts')", "typescript", _CONSTANTS), kinds=["depend"]), "depend")


@query(
    engine._SETUP + """, i AS (SELECT * FROM missing_issues UNION ALL SELECT * FROM dup_issues UNION ALL SELECT * FROM unused_issues),
e AS (SELECT DISTINCT rel_path, line, "column", CASE severity WHEN 'error' THEN 1 WHEN 'warning' THEN 2 ELSE 3 END AS level, type, message FROM i),
r AS (SELECT *, row_number() OVER (PARTITION BY rel_path ORDER BY line, "column", level, type, message) AS place FROM e QUALIFY place <= 3)
SELECT rel_path AS uri, count(*) AS n, '[' || string_agg('{"line":' || line || ',"column":' || "column" || ',"severity":' || level || ',"code":"' || type || '","message":"' || replace(message, '"', '\\"') || '"}', ',' ORDER BY place) || ']' AS value FROM r GROUP BY rel_path"""
)
def K07_published_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.published_rows(editor.diagnostics(issues.analyze(*engine._facts(spark, sf_dir), None, engine.OPTIONS), 3))
