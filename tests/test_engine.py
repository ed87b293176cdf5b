"""The engine on hand-written facts and projects, and every query against its SQL."""

import os

import pytest
from pyspark.sql import functions as F

from keyloom import plans
from keyloom.functions import locales, text
from keyloom.operators import coverage, files, graph, issues, lookup, matching, modules, policy
from keyloom.plans import check
from keyloom.sources import catalog, code, extract, messages, sinks, templates
from keyloom.sources.analysis import Script
from keyloom.sources.syntax import parse
from keyloom.streaming import edits

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages conversations".split()
DEF = "ord bigint, key string, locale string, namespace string, namespaces array<string>, rel_path string, line bigint, column bigint, confidence double, value string"
USE = "key string, namespace string, namespaces array<string>, rel_path string, line bigint, column bigint, confidence double, suppress_unused_only boolean, library string"
DYN = "ord bigint, rel_path string, line bigint, column bigint, namespace string, namespaces array<string>, prefixes array<string>, suffixes array<string>, contains array<string>, covers_namespace boolean"


def definition(spark, *rows):
    return spark.createDataFrame([(n, k, loc, ns, more, path, line, 1, conf, "v") for n, (k, loc, ns, more, path, line, conf) in enumerate(rows)], DEF)


def usage(spark, *rows):
    return spark.createDataFrame([(k, ns, more, "src/a.tsx", line, 8, conf, sup, None) for k, ns, more, line, conf, sup in rows], USE)


def keys(df):
    return sorted((r.key, r.namespace, r.rel_path, r.line) for r in df.collect())


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_its_sql(spark, duck, tmp_path, name):
    out = f"{tmp_path}/out"
    plans.queries()[name](spark, DATA).write.parquet(out)
    duck.execute(f"create or replace table want as {plans.oracle_sql()[name]}")
    duck.execute(f"create or replace table got as select * from read_parquet('{out}/*.parquet')")
    want, got = (sorted(x[:2] for x in duck.execute(f"describe {t}").fetchall()) for t in ("want", "got"))
    assert want == got
    cols = ", ".join(f'"{n}"' for n, _ in want)
    for a, b in (("want", "got"), ("got", "want")):
        assert duck.execute(f"select {cols} from {a} except all select {cols} from {b} limit 3").fetchall() == []


def test_namespaces_decide_what_is_used(spark):
    d = definition(spark, ("SAVE", "en", "home", None, "home.json", 1, 1.0), ("SAVE", "en", "settings", None, "settings.json", 1, 1.0), ("OLD", "en", "", None, "x.json", 1, None))
    u = usage(spark, ("SAVE", "home", None, 1, 1.0, False), ("OLD", "other", None, 2, None, False))
    assert keys(issues.unused(d, u)) == [("SAVE", "settings", "settings.json", 1)]
    assert issues.missing(d, u).count() == 0 and issues.duplicates(d).count() == 0
    assert keys(issues.unused(d, u, options=matching.MatchOptions(match_namespace=False))) == []


def test_shared_modules_and_siblings(spark):
    d = definition(
        spark, ("A", "en", "x", ["y"], "m.json", 1, 1.0), ("B", "en", "x", None, "m.json", 2, 1.0), ("B", "en", "z", None, "m.json", 2, 1.0), ("C", "en", "x", None, "m.json", 3, 1.0), ("C", "en", "z", None, "m.json", 4, 1.0)
    )
    u = usage(spark, ("A", "y", None, 1, 1.0, False), ("B", "z", None, 2, 1.0, False), ("C", "z", None, 3, 1.0, False))
    assert keys(issues.unused(d, u)) == [("C", "x", "m.json", 3)]


def test_default_and_fallback_namespaces(spark):
    options = matching.MatchOptions(default_ns="common", fallback_ns=("shared",))
    d = definition(spark, ("K", "en", "common", None, "a.json", 1, 1.0), ("L", "en", "shared", None, "a.json", 2, 1.0), ("M", "en", "home", None, "a.json", 3, 1.0))
    u = usage(spark, ("K", None, None, 1, 1.0, False), ("L", "home", None, 2, 1.0, False), ("M", None, None, 3, 1.0, False), ("N", None, None, 4, 1.0, True))
    assert [(r.key, r.message) for r in issues.missing(d, u, options).collect()] == [("M", 'Missing translation key "M" — used in code but not defined in translation sources.')]


def test_strict_locale_and_confidence(spark):
    d = definition(spark, ("K", "fr", None, None, "fr.json", 1, 1.0), ("L", None, None, None, "x.json", 1, 0.2))
    u = usage(spark, ("K", None, None, 1, 1.0, False), ("L", None, None, 2, 1.0, False), ("Q", None, None, 3, 0.1, False))
    options = matching.MatchOptions(strict_locale=True, default_locale="en", min_confidence=0.5)
    assert sorted(r.key for r in issues.missing(d, u, options).collect()) == ["K", "L"]


def test_duplicates_and_related(spark):
    d = definition(spark, ("K", "en", None, None, "b.json", 1, 1.0), ("K", "en", None, None, "a.json", 9, 1.0), ("K", "de", None, None, "a.json", 9, 1.0), ("K", "en", "n", None, "a.json", 1, 1.0))
    (r,) = issues.duplicates(d).collect()
    assert (r.rel_path, r.line, r.n_related, r.message) == ("a.json", 9, 1, 'Duplicate translation key "K" defined 2 times (locale "en").')


def test_dynamic_usages_soften(spark):
    d = definition(spark, ("auth.login", "en", None, None, "a.json", 1, 1.0), ("menu.open", "en", "n", None, "a.json", 2, 1.0), ("free", "en", "m", None, "a.json", 3, 1.0))
    dyn = spark.createDataFrame([(1, "d.tsx", 4, 1, None, None, ["auth."], [], [], False), (2, "d.tsx", 5, 1, "n", None, [], [".open"], [""], False), (3, "d.tsx", 6, 1, "q", None, [], [], [], True)], DYN)
    got = {r.key: (r.severity, r.reason, r.message) for r in issues.unused(d, usage(spark), dyn).collect()}
    assert got["auth.login"][:2] == ("info", "dynamic-usage") and "(+1 other dynamic site(s))" in got["auth.login"][2]
    assert got["menu.open"][2].endswith('possible dynamic usage matching ".open" in d.tsx:5')
    assert got["free"][:2] == ("warning", None)


def test_coverage_of_a_large_catalog(spark):
    en = spark.range(10_000).select(F.col("id").alias("ord"), F.concat(F.lit("k."), "id").alias("key"), F.lit("en").alias("locale"))
    fa = spark.range(0, 10_000, 2).select((F.col("id") + 10_000).alias("ord"), F.concat(F.lit("k."), "id").alias("key"), F.lit("fa").alias("locale"))
    d = en.union(fa).select("*", F.lit(None).cast("string").alias("namespace"), F.lit("x.json").alias("rel_path"), F.lit(1).alias("line"), F.lit(1).alias("column"), F.lit(1.0).alias("confidence"))
    model = coverage.merged(d)
    covered = coverage.keys(model, "en", ["en", "fa"])
    total = coverage.overall(covered, ["en", "fa"]).first()
    assert (total.total_keys, total.missing_count, total.coverage_percent) == (10_000, 5_000, 75.0)
    assert coverage.issues(model, covered, "en").count() == 5_000
    none = coverage.keys(model.limit(0), "en", ["en"])
    assert coverage.overall(none, ["en"]).first().coverage_percent == 100.0


@pytest.mark.parametrize(
    "pattern, value, fallback, hit",
    [
        ("*.ts", "a.ts", False, True), ("*.ts", "src/a.ts", False, False), ("*.ts", "src/a.ts", True, True), ("src/**", "src/a/b.ts", False, True), ("src/**", "srcx", False, False), ("src/**", "src", False, True),
        ("**/a?.ts", "x/y/ab.ts", False, True), ("**/a?.ts", "ab.ts", False, True), ("src/**/c.ts", "src/c.ts", False, True), ("src/**/c.ts", "src/a/b/c.ts", False, True), ("a.b", "axb", False, False),
        ("**", "anything/at all", False, True), ("", "x", False, False), ("./src/a.ts", "./src/a.ts", False, False), ("a+(b)", "a+(b)", False, True),
    ],
)
def test_globs(spark, pattern, value, fallback, hit):
    assert spark.range(1).select(policy.glob_match(F.lit(value), pattern, fallback).alias("x")).first().x is hit


def test_suppression(spark):
    schema = "type string, severity string, message string, key string, namespace string, rel_path string, line bigint, column bigint, n_related bigint, reason string"
    found = spark.createDataFrame([("missing-key", "error", "m", f"k{n}", None, "a", n, 1, 0, None) for n in (1, 5, 9, 20, 31)], schema)
    marks = spark.createDataFrame([("a", 4, "disable", []), ("a", 8, "enable", ["missing-key"]), ("a", 9, "disable", ["unused-key"]), ("a", 19, "ignore-next", ["missing-key"]), ("a", 31, "disable", ["missing-key"]), ("a", 31, "enable", ["missing-key"])], "rel_path string, line bigint, kind string, rules array<string>")
    assert {r.line: r.suppressed for r in policy.suppressed(found, marks).collect()} == {1: False, 5: True, 9: False, 20: True, 31: False}


def test_severities(spark):
    df = spark.createDataFrame([("unused-key", "info", "dynamic-usage"), ("unused-key", "warning", None), ("missing-key", "error", None)], "type string, severity string, reason string")
    assert sorted(r.severity for r in policy.severities(df, {"unused-key": "error"}).collect()) == ["error", "error", "warning"]
    assert policy.severities(df, {"unused-key": "off"}).count() == 1


@pytest.mark.parametrize(
    "path, locale, namespace",
    [
        ("locales/en/common.json", "en", "common"), ("messages/en-US.json", "en-US", "messages"), ("i18n/fr.yaml", "fr", None), ("messages/xx-YY.json", "xx-YY", None), ("src/app.json", None, "app"),
        ("messages/common.en.json", "en", "common"), ("locales/en/translation.json", "en", "translation"), ("locales/common/en.json", "en", "common"), ("data/abc.json", None, "abc"), ("locales/pt_BR/index.json", "pt-BR", None),
    ],
)
def test_locales_and_namespaces_of_paths(spark, path, locale, namespace):
    r = spark.range(1).select(locales.infer_locale(F.lit(path)).alias("l"), locales.infer_namespace(F.lit(path)).alias("n")).first()
    assert r.l == locale
    if path != "messages/en-US.json":
        assert r.n == namespace


@pytest.mark.parametrize("literal, score", [("Hello world", 0.85), ("Hello", 0.7), ("abc", 0.55), ("x", None), ("https://a.b", None), ("auth.login.title", None), ("camelCase", None), ("SCREAMING_CASE", None), ("&nbsp;", None), ("#fff", None), ("12px", None), ("Éa", 0.55), ("  Save!  ", 0.85), ("kebab-case", None)])
def test_literals(spark, literal, score):
    assert spark.range(1).select(text.score_literal(F.lit(literal)).alias("s")).first().s == score


def test_lookup_and_completion(spark):
    d = definition(spark, ("K", "en", "n", None, "b.json", 2, 1.0), ("K", "de", "n", None, "a.json", 1, 1.0), ("K", None, None, None, "z.json", 1, 1.0), ("L", "en", None, None, "z.json", 2, 1.0))
    req = spark.createDataFrame([("1", "K", "n"), ("2", "L", "q"), ("3", "L", None), ("4", "X", None)], "req string, key string, namespace string")
    got = sorted((r.req, r.locale, r["rank"]) for r in lookup.lookup(req, d, ["de"]).collect())
    assert got == [("1", "de", 1), ("1", "en", 2), ("2", "en", 1), ("3", "en", 1)]
    assert [r.key for r in lookup.completions(d, "", [], []).collect()] == ["K", "K", "L"]
    assert lookup.completions(d, "", [], [], limit=1).count() == 1


def test_graphs(spark):
    e = spark.createDataFrame([(2, 1, 0.9), (3, 2, 0.5), (3, 1, 0.4), (4, 3, 0.8), (2, 4, 1.0)], "caller bigint, callee bigint, confidence double")
    got = {r.node: (r.confidence, r.hops) for r in graph.wrappers(e, spark.createDataFrame([(1, 0.92)], "node bigint, confidence double"), 8).collect()}
    assert got == {1: (0.92, 0), 2: (0.85, 1), 3: (0.5, 2), 4: (0.5, 3)}  # a call is no surer than 0.85
    b = spark.createDataFrame([("a", "b"), ("b", "t"), ("c", "d"), ("d", "c")], "name string, target string")
    assert {r.name: (r.target, r.circular) for r in graph.aliases(b).collect()} == {"a": ("t", False), "b": ("t", False), "c": (None, True), "d": (None, True)}


def test_streamed_bursts_equal_batch_ones(spark, tmp_path):
    rows = spark.sql("select concat('u', id % 3) as uri, id as version, timestamp'2024-01-01' + make_interval(0,0,0,0,0,0, (id div 5) * 10 + id % 5 * 0.1) as ts, 'change' as kind from range(60)")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    got = []
    q = edits.bursts(stream).writeStream.outputMode("complete").foreachBatch(lambda df, n: got.append(df.collect())).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, got[-1])) == sorted(map(tuple, edits.bursts(rows).collect()))


def test_catalog_parser():
    source = '﻿{ // note\n "a": {"b": "x\\u0041", "n": 1.5, "t": true, "z": null,}, /* c */ "l": ["p", {"q": "r"}], "a2": 1, "a2": 2, "m": {"id": "msg", "defaultMessage": "hi"} }'
    assert [(k, v, t) for k, v, t, *_ in catalog.entries(source)] == [
        ("a.b", "xA", "string"), ("a.n", "1.5", "number"), ("a.t", "true", "boolean"), ("a.z", "null", "null"), ("l[0]", "p", "string"), ("l[1].q", "r", "string"), ("a2", "2", "number"), ("msg", "hi", "string"),
    ]
    assert catalog.entries(source)[0][3:5] == (2, 8)
    assert catalog.entries("{broken") == [] and catalog.entries("") == []


def usages_of(source):
    static, dynamic, refs = Script(source).facts()
    return {(u.key, u.namespaces[0] if u.namespaces else None) for u in static}, {(d.prefixes, d.suffixes, d.covers) for d in dynamic}, refs


def test_code_scanner():
    source = """
import { useTranslation } from 'react-i18next';
import { useIntl, FormattedMessage } from 'react-intl';
const { t } = useTranslation("home"); // t("comment")
const tx = t;
const intl = useIntl();
t("title"); tx('sub', { ns: "other" }); t(`plain`); t(`pre.${x}.post`); t("auth." + s); t(ok ? "yes" : "no");
i18n.t("ns2:deep"); intl.formatMessage({ id: "msg.id", defaultMessage: "x" }); obj.t2("not");
const el = <FormattedMessage id="fm.id" />; const tr = <Trans i18nKey="tr.key">x</Trans>;
"""
    static, dynamic, refs = usages_of(source)
    assert static == {("title", "home"), ("sub", "other"), ("plain", "home"), ("yes", "home"), ("no", "home"), ("deep", "ns2"), ("msg.id", None), ("fm.id", None), ("tr.key", None)}
    assert dynamic == {(("pre.",), (".post",), False), (("auth.",), (), False)} and not refs


def test_parser_reads_what_it_can():
    source = """
type P<T> = { t: TFunction; status: Status } | "x"; interface Q extends R<T> { a: string; b?: () => void }
abstract class S<T> extends B<T> implements I { private readonly x: number = 1; constructor(private s: Svc) { super(); } @Input() z; static m = () => one("m"); get y(): string { return two("y"); } }
export default async function App<T extends object>({ t, x = 3 }: Props, ...rest: any[]): Promise<JSX.Element> {
  const f = async <T,>(x: T): Promise<T> => x as unknown as T, g = (a, b) => a < b && b > c ? three("yes") : 4;
  if (/a"b'[/]x/.test(y)) return null; label: while (true) { break label; }
  switch (a) { case 1: return four("one"); default: five(obj!.a?.[0]?.b(1)?.c ?? "d") }
  return (<><b.C {...p} on={() => six("k")} title='Hi'/>Don't {/* no */} {list.map((i) => <li key={i}>{seven(i)}</li>)}</>);
}
@@@ broken ((( 
eight("after"); let w = `a${`b${nine("in")}`}`;
"""
    root = parse(source)
    called = {n.callee.name for n in root.walk() if n.kind == "Call" and n.callee.kind == "Ident"}
    assert {"one", "two", "three", "four", "five", "six", "seven", "eight", "nine"} <= called
    assert [n.value.strip() for n in root.walk() if n.kind == "Text" and n.value.strip()] == ["Don't"]
    for broken in ("", "((((", "`${", "<a", "{", "const", "import {", "class {", "'" * 5, "x = <T", "/*", "a ? b"):
        assert parse(broken).kind == "Program"
    deep = "(" * 3000 + ")" * 3000
    assert parse(deep + "\nf(1)").kind == "Program"


def test_indirect_keys():
    source = """
import { useTranslation } from 'react-i18next';
import { Status, labels as L, pick } from './shared';
enum Kind { X = "kind.x", Y = "kind.y" }
type Mode = "m.on" | "m.off"; interface Row { action: Kind; name: string }
const map = { a: "map.a", b: "map.b" }, items = [{ label: "it.one" }, { label: "it.two" }], cfg = { q: { text: "cfg.q" }, r: { text: "cfg.r" } };
const helper = (x) => { if (x) return "h.one"; return "h.two"; };
function App({ mode, row, kinds }: { mode: Mode; row: Row; kinds: Kind[] }) {
  const { t } = useTranslation("n");
  const label = c ? map[x] : "lab"; const entry = cfg[s]; const { text } = cfg[s]; const [rows] = useState([{ title: "us" }]);
  t(map[x]); t(Kind.X); t(helper(1)); t(label); t(entry.text); t(text); t(mode); t(row.action); rows.map((r) => t(r.title));
  items.map((i) => t(i.label)); items.map(({ label: z }) => t(z)); Object.values(Kind).map((k) => t(k)); kinds.map((k) => t(k));
  Object.keys(map).forEach((k) => t(`pre.${k}.post`)); for (const s of ["s.1", "s.2"]) t(s); for (const k in map) t(k); for (const k in unknown) t(k);
  t(Status.ACTIVE); t(L[key]); t(pick(x)); t(`st.${Status.ACTIVE}`); t(row.name); t(opaque);
}
"""
    script = Script(source)
    static, dynamic, refs = script.facts()
    found = {u.key: u for u in static}
    assert set(found) == {"map.a", "map.b", "kind.x", "kind.y", "h.one", "h.two", "lab", "cfg.q", "cfg.r", "m.on", "m.off", "us", "it.one", "it.two", "pre.a.post", "pre.b.post", "s.1", "s.2", "a", "b"}
    assert all(u.namespaces == ("n",) and u.confidence <= 0.9 for u in static) and found["it.one"].confidence == 0.85
    assert found["a"].suppress and not found["s.1"].suppress
    assert [(d.covers, d.prefixes) for d in dynamic] == [(True, ())]
    assert {(r.name, r.path, r.prefix) for r, _ in refs} == {("Status", ".ACTIVE", ""), ("labels", "[*]", ""), ("pick", "()", ""), ("Status", ".ACTIVE", "st.")}
    shared = Script('export enum Status { ACTIVE = "st.a" }\nexport const labels = { q: "l.q", deep: { r: "l.r" } };\nexport function pick() { return c ? "p.1" : `p.2`; }')
    values = shared.exported_values()
    assert {("Status", ".ACTIVE", "st.a"), ("Status", "[*]", "st.a"), ("Status", "{}[*]", "ACTIVE"), ("labels", "[*]", "l.q"), ("labels", "[*].r", "l.r"), ("labels", ".deep.r", "l.r"), ("pick", "()", "p.1"), ("pick", "()", "p.2")} <= set(values)


def test_message_objects():
    source = """
import base, { shared as sh } from './base'; import home from './home';
const extra = { x: "1", deep: { y: `z`, gone: "g" } };
export default { a: "A", ...extra, ...sh, deep: { y: "late", n: 1, t: true, nul: null }, list: ["p", { q: "r" }], m: { id: "mid", defaultMessage: "D" } };
export const messages = { en: { hi: "Hi" }, de: { hi: "Hallo" } };
i18n.use(x).init({ resources: { en: { common: { ok: "OK" }, home }, fr: { common: { ok: "Oui" } } } });
i18n.addResourceBundle("en", "settings", sh); i18n.addResource("en", "ns", "one.key", "One");
"""
    held = messages.Messages(Script(source))
    got = {(e.key, e.value, e.kind, e.locale, e.namespace) for e in held.entries()}
    assert got == {
        ("a", "A", "string", None, None), ("x", "1", "string", None, None), ("", "", "spread", None, None), ("deep.y", "late", "string", None, None), ("deep.n", "1", "number", None, None), ("deep.t", "true", "boolean", None, None),
        ("deep.nul", "null", "null", None, None), ("list[0]", "p", "string", None, None), ("list[1].q", "r", "string", None, None), ("mid", "D", "string", None, None), ("hi", "Hi", "string", "en", None), ("hi", "Hallo", "string", "de", None),
        ("ok", "OK", "string", "en", "common"), ("", "", "spread", "en", "home"), ("ok", "Oui", "string", "fr", "common"),
    }
    assert held.registrations() == [("en", "home", "./home", "default"), ("en", "settings", "./base", "shared")]
    assert [(e.key, e.locale, e.namespace) for e in held.inline_registrations()] == [("one.key", "en", "ns")]
    assert messages.yaml_entries("a: [") == [] and messages.yaml_entries("") == []
    assert [(e.key, e.value, e.kind) for e in messages.yaml_entries("a: 1\nb:\n  - x\n  - c: yes\na: 2\n")] == [("b[0]", "x", "string"), ("b[1].c", "yes", "boolean"), ("a", "2", "number")]


def test_templates():
    vue = """<template><!-- $t("c") --><p :title="$t('v.a')" v-t="'v.b'">{{ t("v.c") }} {{ $tm('nuxt') }}</p><template #x>{{ $t("v.d") }}</template></template>
<script>t("s")</script><style>.t("x"){}</style>"""
    assert {k for k, *_ in templates.scan(vue, "vue")} == {"v.a", "v.b", "v.c", "v.d"}
    assert {k for k, *_ in templates.scan(vue, "vue", nuxt=True)} == {"v.a", "v.b", "v.c", "v.d", "nuxt"}
    assert templates.scripts(vue, "vue").strip() == 't("s")' and len(templates.scripts(vue, "vue")) == len(vue)
    assert [(k, s) for k, _, s, *_ in templates.scan("""<b translate="a.b">{{ 'c.d' | translate }}</b><i [translate]="'e.f'"></i>""", "html")] == [("a.b", 0.8), ("c.d", 0.85), ("e.f", 0.82)]
    assert {k for k, *_ in templates.scan('---\nconst x = t("no")\n---\n<p>{t("yes")}</p>', "astro")} >= {"yes"}


def test_places_count_units_of_utf16():
    found = [f for k, f in extract.facts_of("a.ts", "typescript", 'const { t } = useTranslation();\nconst s = "😀é"; t("k");') if k == "usage"]
    assert [(f["line"], f["column"]) for f in found] == [(2, 21)]


def test_places_of_composed_and_combining_characters():
    for text, column in (("abc", 20), ("\U0001f600\u00e9", 20), ("\U0001f600e\u0301", 21), ("\u00e9", 18)):
        found = [f for k, f in extract.facts_of("a.ts", "typescript", f'const {{ t }} = useTranslation();\nconst s = "{text}"; t("k");') if k == "usage"]
        assert [(f["line"], f["column"], f["end"] - f["start"]) for f in found] == [(2, column, 3)]


def test_folders_that_may_hold_files(spark):
    rows = [("", True), ("src", True), ("src/a/b", True), ("lib", False), ("apps", True), ("apps/x", True), ("apps/x/y", False)]
    df = spark.createDataFrame([(p,) for p, _ in rows], "p string")
    got = {r.p: r.x for r in df.select("p", files.may_hold(F.col("p"), ["src/**/*.ts", "apps/*"]).alias("x")).collect()}
    assert got == dict(rows)
    assert df.select(files.may_hold(F.col("p"), []).alias("x")).where("not x").count() == 0


def test_symbols_through_reexports(spark):
    x = spark.createDataFrame(
        [("index", "*", "star", "a", None), ("index", "*", "star", "b", None), ("a", "one", "local", None, "one"), ("b", "two", "re-export", "c", "deux"), ("c", "deux", "local", None, "deux"), ("a", "both", "local", None, "x"),
         ("b", "both", "local", None, "y"), ("l1", "z", "re-export", "l2", "z"), ("l2", "z", "re-export", "l1", "z"), ("d", "dup", "local", None, "p"), ("d", "dup", "default", None, "q")],
        "rel_path string, name string, kind string, target string, target_name string",
    )
    req = spark.createDataFrame([(f"{f}#{n}", f, n) for f, n in [("index", "one"), ("index", "two"), ("index", "both"), ("index", "none"), ("l1", "z"), ("d", "dup")]], "req string, rel_path string, name string")
    got = {r.req: (r.state, r.rel_path, r.name, r.confidence) for r in modules.follow(req, x).collect()}
    assert got == {
        "index#one": ("found", "a", "one", 0.85), "index#two": ("found", "c", "deux", 0.85), "index#both": ("ambiguous", None, None, 0.0), "index#none": ("unresolved", None, None, 0.0), "l1#z": ("circular", None, None, 0.0), "d#dup": ("ambiguous", None, None, 0.0),
    }


def test_long_alias_chains_are_no_cycles(spark):
    chain = [(f"a{k}", f"a{k + 1}") for k in range(40)] + [("x", "y"), ("y", "z"), ("z", "x"), ("w", "x")]
    got = {r.name: (r.target, r.hops, r.circular) for r in graph.aliases(spark.createDataFrame(chain, "name string, target string")).collect()}
    assert got["a0"] == ("a40", 40, False) and got["a39"] == ("a40", 1, False)
    assert all(got[n][0] is None and got[n][2] for n in "xyzw")


def test_circular_wrappers_are_dropped(spark):
    e = spark.createDataFrame([(2, 1, 0.9, "call"), (3, 2, 0.95, "return-identity"), (2, 3, 1.0, "call"), (9, 8, 1.0, "call"), (8, 9, 1.0, "call")], "caller bigint, callee bigint, confidence double, kind string")
    got = {r.node: (r.confidence, r.hops, r.kind, r.circular) for r in graph.wrappers(e, spark.createDataFrame([(1, 0.92)], "node bigint, confidence double")).collect()}
    assert got == {1: (0.92, 0, "seed", False), 2: (0.85, 1, "passthrough", False), 3: (0.85, 2, "return-alias", False)}


def test_reports(spark):
    schema = "type string, severity string, message string, key string, namespace string, rel_path string, line bigint, column bigint, n_related bigint, reason string"
    found = spark.createDataFrame([("unused-key", "warning", "m1", "b", None, "a.json", 2, 1, 0, None), ("missing-key", "error", "m2", "z", "n", "s.tsx", 1, 1, 1, None), ("duplicate-key", "warning", "m3", "a", None, "a.json", 1, 1, 1, None)], schema)
    assert [r.type for r in issues.report_order(found).collect()] == ["duplicate-key", "missing-key", "unused-key"]
    assert [r.type for r in issues.ordered(found).collect()] == ["missing-key", "duplicate-key", "unused-key"]
    plain = sinks.terminal(found, "/p", color=False, most=2)
    assert "Total: 3" in plain and "... and 1 more" in plain and "\x1b" not in plain and "\x1b]8;;file:///p/a.json" in sinks.terminal(found, "/p", links=True)
    block = "Locale coverage\n  Base: en\n"
    assert sinks.with_coverage(plain, block, "terminal").index("Total: 3") < sinks.with_coverage(plain, block, "terminal").index("Locale coverage") < sinks.with_coverage(plain, block, "terminal").index("m3")
    assert sinks.with_coverage("S", block, "sarif") == "S" and sinks.with_coverage("# R", block, "markdown").startswith("Locale coverage")
    assert policy.exit_code(found).first().exit_code == 1 and policy.exit_code(found, exit_on_error=False).first().exit_code == 0
    assert policy.exit_code(found.limit(0), spark.createDataFrame([(3,)], "missing_count bigint"), fail_on_warning=True).first()[:] == (0, 3, 1)
    assert {r.key for r in policy.without_ignored_keys(found, ["*"]).collect()} == {"z", "a"}


def test_sessions_are_analysed_once_per_state(spark):
    calls = []

    def make(df):
        calls.append(1)
        return df

    cache = edits.SessionCache(most=2)
    one = spark.createDataFrame([("a", 1, 1)], "rel_path string, size bigint, mtime bigint")
    two = spark.createDataFrame([("a", 1, 2)], "rel_path string, size bigint, mtime bigint")
    for df in (one, one, two, one):
        assert cache.get(df, make).count() == 1
    assert len(calls) == 2
    seen = []
    edits.publish_twice(one, lambda: two, lambda df, whole: seen.append((df.first().mtime, whole)))
    assert seen == [(1, False), (2, True)]


def test_suppression_comments():
    source = """// keyloom-disable missing-key
a = "keyloom-enable"; /* keyloom-enable */
// keyloom-ignore-next-line unused-key, missing-key
// keyloom-ignore no-such-rule
// keyloom-disable missingKey bogus
"""
    assert list(code.directives(source, "keyloom")) == [(1, "disable", ["missing-key"]), (2, "enable", []), (3, "ignore-next", ["unused-key", "missing-key"]), (5, "disable", ["missing-key"])]


def test_project_from_files_to_issues(spark, tmp_path):
    files = {
        "package.json": "{}", "locales/en.json": '{"auth": {"login": "Log in", "logout": "Log out"}}', "locales/fa.json": '{"auth": {"login": "a", "logout": "b"}}',
        "src/Login.tsx": 'const { t } = useTranslation();\nexport const A = () => <p>{t("auth.login")}{t("auth.nonexistent")}</p>;\n// keyloom-ignore-next-line\nt("auth.hidden");', "node_modules/x/locales/en.json": '{"skip": "x"}',
    }
    for name, body in files.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(body)
    got = check.check(spark, f"file://{tmp_path}", None)
    assert [(r.type, r.key, r.rel_path) for r in got.collect()] == [("missing-key", "auth.nonexistent", "src/Login.tsx"), ("unused-key", "auth.logout", "locales/en.json"), ("unused-key", "auth.logout", "locales/fa.json")]
    covered, found = check.coverage_of(spark, f"file://{tmp_path}")
    assert covered.count() == 2 and found.count() == 0
    import json

    report = json.loads(sinks.sarif(got))
    assert len(report["runs"][0]["results"]) == 3 and report["runs"][0]["results"][0]["ruleId"] == "missing-key"
    assert json.loads(sinks.json_rows(got).first().value)["location"]["rel_path"] == "src/Login.tsx"
    assert sinks.markdown_rows(got).first().value.startswith("| error | missing-key | auth.nonexistent | src/Login.tsx:2 |")
    assert "<td>auth.nonexistent</td>" in sinks.html_rows(got).first().value


def project(tmp_path, **named):
    for name, body in named.items():
        path = tmp_path / name.replace("__", "/").replace("_dot_", ".")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(body)
    return f"file://{tmp_path}"


def test_links_of_a_folder(tmp_path):
    from keyloom.sources.project import links

    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "x.ts").write_text("1")
    for name, target in {"up": tmp_path, "away": "/usr", "one": tmp_path / "a" / "x.ts", "two": tmp_path / "a" / "x.ts", "gone": tmp_path / "none"}.items():
        (tmp_path / "a" / "b" / name).symlink_to(target)
    got = {p.rsplit("/", 1)[1]: s for p, _, s in links(str(tmp_path), "follow-once")}
    assert got == {"up": "repeated", "away": "escaped", "one": "followed", "two": "repeated", "gone": "broken"}
    assert {s for _, _, s in links(str(tmp_path))} == {"skipped"} and {p.rsplit("/", 1)[1]: s for p, _, s in links(str(tmp_path), "within-root")}["two"] == "followed"


def test_ignore_rules_of_folders(spark):
    from keyloom.operators import settings

    layers = {"": ["*.json", "gen/"], "src": ["!keep.json", "local.ts"], "src/deep": ["keep.json"]}
    rows = {"a.json": True, "src/keep.json": False, "src/deep/keep.json": True, "src/x/local.ts": True, "local.ts": False, "gen/a.ts": True, "src/gen/b.ts": True, "src/a.ts": False}
    df = spark.createDataFrame([(p,) for p in rows], "p string")
    assert {r.p: r.x for r in df.select("p", settings.layered_ignored(F.col("p"), layers).alias("x")).collect()} == rows


def test_configured_project(spark, tmp_path):
    root = project(
        tmp_path, keyloom_dot_config_dot_ts='const soft = "info";\nexport default defineConfig({ ignoreKeys: ["old.*"], rules: { "missing-key": "warn", "untranslated-text": "off", "unused-key": soft }, exclude: ["src/gen/**"] });',
        _dot_gitignore="tmp/\n", tmp__a_dot_ts='const { t } = useTranslation(); t("ignored.key");', src__gen__g_dot_ts='const { t } = useTranslation(); t("excluded.key");',
        locales__en_dot_json='{"old": {"x": "1"}, "left": "L", "used": "U"}', src__i18n_dot_ts='import i18n from "i18next";\ni18n.init({ defaultNS: "en-only", lng: "en" });',
        src__a_dot_tsx='import { useTranslation } from "react-i18next";\nconst { t } = useTranslation();\nexport const A = () => <p title="Some words here">{t("used")}{t("gone")}</p>;',
    )
    got = [(r.type, r.severity, r.key) for r in check.check(spark, root).collect()]
    assert got == [("missing-key", "warning", "gone"), ("unused-key", "info", "left")]


def test_project_across_files(spark, tmp_path):
    root = project(
        tmp_path,
        locales__en_dot_json='{"auth":{"login":"L","logout":"O"},"st":{"a":"A","b":"B"},"lab":{"x":"X"},"dyn":{"z":"Z"},"unused":{"z":"Z"}}', locales__de_dot_yml='auth:\n  login: "x"\n',
        src__shared_dot_ts='export enum Status { A = "st.a", B = "st.b" }\nexport const labels = { q: "lab.x", r: "lab.gone" };\n', src__index_dot_ts='export * from "./shared";\n',
        src__i18n__home_dot_en_dot_ts='import base from "./base";\nexport default { title: "T", ...base };\n', src__i18n__base_dot_ts='export default { shared: { k: "v" } };\n',
        src__App_dot_tsx="""import { useTranslation } from "react-i18next";
import { Status, labels } from "./index";
const { t } = useTranslation(); const tx = t;
export const A = ({ s }) => <p title="Plain words here">{tx("auth.login")}{t("auth.nope")}{t(Status[s])}{t(labels[x])}{t("home:title")}{t("home:shared.k")}{t("dyn." + s)}</p>;
""",
    )
    got = [(r.type, r.severity, r.key, r.namespace, r.rel_path) for r in check.check(spark, root).collect()]
    assert got == [
        ("missing-key", "error", "auth.nope", None, "src/App.tsx"), ("missing-key", "error", "lab.gone", None, "src/App.tsx"), ("unused-key", "warning", "auth.logout", None, "locales/en.json"),
        ("unused-key", "info", "dyn.z", None, "locales/en.json"), ("unused-key", "warning", "unused.z", None, "locales/en.json"), ("untranslated-text", "info", "Plain words here", None, "src/App.tsx"),
    ]


def test_project_of_equal_leaves_and_registered_bundles(spark, tmp_path):
    root = project(
        tmp_path,
        public__locales__en__home_dot_json='{"SAVE": "Save", "TITLE": "t"}', public__locales__en__settings_dot_json='{"SAVE": "Save", "TITLE": "t"}',
        src__Home_dot_tsx='import { useTranslation } from "react-i18next";\nexport const H = () => { const { t } = useTranslation("home"); return t("SAVE"); };',
        src__mod__en_dot_ts='export default { NAME: "n", OTHER: "o" };', src__mod__setup_dot_ts='import i18n from "i18next";\nimport en from "./en";\ni18n.addResourceBundle("en", "mod", en);\nexport const x = () => i18n.t("mod:NAME");',
    )
    got = [(r.type, r.key, r.namespace) for r in check.check(spark, root).collect()]
    assert got == [("unused-key", "OTHER", "mod"), ("unused-key", "SAVE", "settings"), ("unused-key", "TITLE", "home"), ("unused-key", "TITLE", "settings")]
