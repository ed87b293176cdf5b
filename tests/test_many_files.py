"""Tables of many small files: reading them is spread, batched, and does what is asked for only."""

import json

from pyspark.sql import functions as F

from keyloom.sources import extract

TEXTS = [
    'import { useTranslation } from "react-i18next";\nimport { Status as S } from "./s";\nexport function A({ c, x }) { const { t } = useTranslation("n"); t(S.A); t(`a.${x}`); t(x.title); return <p title="Open it">Read me {t("k")}</p>; }\nexport { B } from "./b";\nconst one = "1", two = one + S;',
    'import base from "./base";\nexport default { own: "x", box: { ...base } };\nimport i18n from "i18next";\ni18n.addResourceBundle("en", "ns", base); i18n.addResource("de", "in", "one.key", "v");',
    'function w(t) { return t("col"); }\nfunction P() { const { t } = useTranslation("u"); return w(t); }\nexport const items = [{ title: "it" }];',
    "const broken = {{ ( 'x' \n t(", "",
]


def test_each_kind_of_facts_is_the_same_alone():
    for language in ("typescript", "vue"):
        for body in TEXTS:
            whole = list(extract.facts_of("a", language, body))
            for kind in extract.SCHEMAS:
                assert list(extract.facts_of("a", language, body, kinds=[kind])) == [x for x in whole if x[0] == kind]


def test_small_files_are_dealt_to_all_cores_and_sent_in_batches(spark):
    files = spark.range(0, 4000, 1, 1).select(F.concat(F.lit("f"), "id", F.lit(".ts")).alias("rel_path"), F.lit("typescript").alias("language"), F.concat(F.lit("export const a"), "id", F.lit(' = "x";')).alias("text"))
    found = extract.facts(files, kinds=["export"])
    tasks = {r.p: r.n for r in found.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()}
    assert sum(tasks.values()) == 4000
    assert len(tasks) >= 2 * spark.sparkContext.defaultParallelism and max(tasks.values()) < 800
    assert found.select("rel_path").distinct().count() == 4000


def test_copies_of_a_file_are_read_once(monkeypatch):
    calls = []
    real = extract.facts_of
    monkeypatch.setattr(extract, "facts_of", lambda *a: (calls.append(1), real(*a))[1])
    monkeypatch.setattr(extract, "_memo", {})
    for kinds in (None, frozenset(["export"])):
        got = [extract._remembered("typescript", TEXTS[0], False, kinds) for _ in range(3)]
        assert got[0] == got[1] == got[2] == [(k, json.dumps(d)) for k, d in real("", "typescript", TEXTS[0], False, kinds)]
    assert len(calls) == 2


def test_a_worker_forgets_what_it_remembers(monkeypatch):
    monkeypatch.setattr(extract, "_memo", {})
    monkeypatch.setattr(extract, "_held", 0)
    monkeypatch.setattr(extract, "_KEPT", 1 << 16)
    for i in range(2000):
        body = f'export const a{i} = "x";'
        assert [json.loads(d)["name"] for k, d in extract._remembered("typescript", body, False, frozenset(["export"]))] == [f"a{i}"]
        assert extract._held <= 1 << 16
    assert len(extract._memo) < 1000
    long = "export const b = 1;\n" + "// long\n" * 200
    assert extract._remembered("typescript", long, False, None) and not any(k[1] == long for k in extract._memo)


def test_cursors_of_a_crowded_line_meet_no_pairs_and_equal_brute_force(spark):
    import random

    from keyloom.operators import editor

    r = random.Random(5)
    usages = [(i, f"f{r.randrange(2)}", a, r.choice([1, 5, 9, None]), a + r.choice([0, 0, 1, 3, -1]), r.choice([3, 8, 12, None]), r.choice([True, False])) for i, a in ((i, r.randrange(6)) for i in range(60))]
    usages += [(100 + i, "big", 1, i, 1, i + 3, i % 3 == 0) for i in range(3000)]
    cursors = [(i, f"f{r.randrange(3)}", r.randrange(9), r.choice([0, 1, 2, 5, 8, 9, 11, None])) for i in range(300)]
    cursors += [(1000 + i, "big", 1, i) for i in range(3000)] + [(7, "f0", 2, 5), (None, "f0", 2, 5)]
    u = spark.createDataFrame(usages, "ord bigint, rel_path string, line bigint, column bigint, end_line bigint, end_column bigint, dynamic boolean")
    c = spark.createDataFrame(cursors, "cursor bigint, rel_path string, line bigint, character bigint")

    def holds(p, line, ch, x):
        _, q, a, ac, b, bc, _ = x
        if p != q or not a <= line <= b:
            return False
        return not (line == a and (ch is None or ac is None or ch < ac)) and not (line == b and (ch is None or bc is None or ch > bc))

    near = lambda p: usages[:60] if p != "big" else usages[60:]
    best = {}
    for i, p, line, ch in cursors:
        found = [(not x[6], x[0]) for x in (near(p) if p != "big" else usages[60 + max(0, ch - 4) : 60 + ch + 1]) if holds(p, line, ch, x)]
        best.setdefault(i, []).extend(found if i is not None else [])
    want = sorted(((i, *((lambda m: (m[1], not m[0]))(min(best[i])) if best[i] else (None, None))) for i, *_ in cursors), key=str)
    got = editor.usage_at(c, u)
    assert sorted((tuple(x) for x in got.collect()), key=str) == want
    assert "sweep" in got._jdf.queryExecution().toString()


def test_the_tree_of_a_file_is_freed_without_the_collector():
    import gc

    from keyloom.sources.syntax import Node

    def nodes() -> int:
        return sum(type(x) is Node for x in gc.get_objects())

    gc.collect()
    gc.disable()
    try:
        others = nodes()
        for language in ("typescript", "vue"):
            for body in TEXTS:
                for kinds in (None, extract.OF_DEFINITIONS, ["literal"]):
                    list(extract.facts_of("a", language, body, kinds=kinds))
        assert nodes() == others
    finally:
        gc.enable()


def test_views_of_kept_facts_read_their_kind_only(spark):
    files = spark.createDataFrame([(f"f{i}.ts", "typescript", body) for i, body in enumerate(TEXTS)], "rel_path string, language string, text string")
    found = extract.facts(files)
    held = extract.kept(found)
    assert held.dtypes == found.dtypes and sorted(held.collect()) == sorted(found.collect())
    plan = extract.view(held, "export")._jdf.queryExecution().executedPlan().toString()
    assert "fact=export" in plan.replace(" ", "") or "(fact#" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    none = extract.kept(found.where("rel_path = 'none'"))
    assert none.dtypes == found.dtypes and extract.view(none, "import").count() == 0


def test_imports_mean_the_first_file_that_exists_and_arent_multiplied(spark):
    import posixpath
    import random

    from keyloom.operators import modules

    r = random.Random(2)
    names = ["a", "b/a", "a/index", "a.ts", "b", "c/b/a", "x.vue", "a.test"]
    files = sorted({n + r.choice(["", ".ts", ".tsx", ".js", ".mjs", "/index.ts", "/index.js", ".d.ts", ".TS"]) for n in names * 4})
    specs = ["./a", "../a", ".//a", "././b/./a", "../../b/a", "./a.ts", "./a/", ".", "..", "./b//a", "a", "./x.vue", "./a/index", "./a.test", "./a/../a"]
    asked = [(f, s) for f in [*files, "c/b/q.ts"] for s in specs]

    def want(path, spec):
        parts = []
        for s in [*posixpath.dirname(path).split("/"), *spec.split("/")]:
            if s == ".." and parts:
                parts.pop()
            elif s not in ("", "."):
                parts.append(s)
        base = "/".join(parts)
        ends = [""] if base.endswith((".ts", ".tsx", ".js", ".jsx", ".mjs")) else modules.ENDINGS
        return next((base + e for e in ends if base + e in files), None) if spec.startswith(".") else None

    i = spark.createDataFrame(asked, "rel_path string, spec string")
    got = modules.resolved(i, spark.createDataFrame([(f,) for f in [*files, files[0]]], "rel_path string"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(((f, s, want(f, s)) for f, s in asked), key=str)
    assert "/index.tsx" not in got._jdf.queryExecution().optimizedPlan().toString().split("posexplode")[0].split("generate")[-1]
    assert i.select(F.size(modules.meant_by(F.col("rel_path"))).alias("n")).where("n > 3").count() == 0


def test_strings_of_related_files_are_found_once_a_folder(spark):
    asks = [(f"{d}c{i}.tsx", f"prop{i % 2}", i == 3, f"k{i % 2}.") for d in ("", "src/app/p/g1/", "src/app/p/g1/deep/", "src/app/p/g2/", "lib/") for i in range(4)]
    tells = [(f, f"prop{k}", f"{f}:{k}") for f in ("c0.tsx", "c1.tsx", "src/app/p/g1/x.ts", "src/app/p/g1/deep/c0.tsx", "src/app/p/g2/deep/y.ts", "src/z.ts", "navConfig.ts", "lib/routes.ts", "lib/c3.tsx") for k in range(2)]
    row = {"namespaces": [], "resolved": False, "library": "l", "confidence": 0.9, "context": "c", "suppress": False, "via": None, "line": 1, "column": 1, "start": 0, "end": 1}
    facts = [(f, "ask", json.dumps({"prop": p, "route": r, "key": k, **row})) for f, p, r, k in asks] + [(f, "told", json.dumps({"prop": p, "value": v})) for f, p, v in tells]
    got = extract.related(spark.createDataFrame(facts, "rel_path string, fact string, data string"))

    def kin(path, other):
        folder, feature = path.rpartition("/")[0], path.split("app/")[-1].rsplit("/")[:2] if "app/" in path else None
        below = folder != "" and other.startswith(folder + "/")
        return path == other or below or other == "navConfig.ts" or (feature and "app/" in other and other.split("app/")[1].split("/")[:2] == feature)

    want = {(f, k + v) for f, p, r, k in asks for o, q, v in tells if p == q and (o == "lib/routes.ts" if r else kin(f, o))}
    rows = [(x.rel_path, x.key) for x in got.collect()]
    assert set(rows) == want and len(rows) == len(want)
    assert "Aggregate" not in got._jdf.queryExecution().executedPlan().toString()


def test_facts_of_one_kind_are_sent_as_columns_and_equal_their_views(spark, monkeypatch):
    odd = ['import { useTranslation } from "react-i18next";\nconst { t } = useTranslation(); t("a\\ud83d\\ude00b"); t("\\ud83dx"); t(`é😀.${q}`); t("p" + q);', None]
    rows = [(f"f{k}.ts", language, body) for k, body in enumerate([*TEXTS, *odd] * 3) for language in ("typescript", "vue", "json", None)]
    files = spark.createDataFrame(rows, "rel_path string, language string, text string")
    whole = extract.facts(files)
    for kind in extract.SCHEMAS:
        got = extract.facts_of_kind(files, kind)
        want = extract.view(whole, kind)
        assert [(c, t) for c, t in got.dtypes] == want.dtypes
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())), kind
        assert "from_json" not in got._jdf.queryExecution().toString().lower().replace("jsontostructs", "from_json")
    few = extract.facts_of_kind(files, "usage", ["line", "key"])
    assert few.columns == ["rel_path", "line", "key"] and few.count() == extract.view(whole, "usage").count()
    assert sorted(map(str, extract.literals_of(files).collect())) == sorted(map(str, extract.literals(whole).collect()))


def test_what_a_worker_remembers_of_a_kind_stays_bounded(monkeypatch):
    import pyarrow as pa

    read, real = [], extract.facts_of
    monkeypatch.setattr(extract, "facts_of", lambda *a: (read.append(a[2]), real(*a))[1])
    monkeypatch.setattr(extract, "_store", None)
    monkeypatch.setattr(extract, "_KEPT", 1 << 16)
    monkeypatch.setattr(extract, "_ROWS", 16)
    kind = pa.struct([("name", pa.string())])

    def names(bodies):
        batch = pa.RecordBatch.from_pydict({"rel_path": [f"f{k}" for k in range(len(bodies))], "language": ["typescript"] * len(bodies), "text": bodies})
        return [x for out in extract._columns(batch, "export", kind, False) for x in zip(*(out.column(c).to_pylist() for c in ("rel_path", "name")))]

    long = "export const long = 1;\n" + "// long\n" * 200
    for low in range(0, 2000, 50):
        bodies = [f"export const a{k} = 1, b{k} = 2;" for k in range(low, low + 50) for _ in range(3)] + ["", long]
        assert names(bodies) == [(f"f{k}", f"{c}{low + k // 3}") for k in range(150) for c in "ab"] + [("f151", "long")]
        assert extract._store is None or (extract._store.held <= 1 << 16 and ("typescript", long) not in extract._store.known)
    assert len(read) < 2000 + 2 * 40 + 40


def test_literals_are_trimmed_once_for_their_score(spark):
    from keyloom.functions import text

    want = {None: 0.55, "": None, " a ": None, "Save": 0.7, " ok ": 0.55, "Open it": 0.85, "a.b": None, "no": 0.55, "MAX_SIZE": None, "camelCase": None, "12px": None, "Hello!": 0.85}
    df = spark.createDataFrame([(x,) for x in want], "x string").select("x", text.score_literal(F.col("x")).alias("s"))
    assert {r.x: r.s for r in df.collect()} == want
    assert df._jdf.queryExecution().analyzed().toString().count("regexp_replace") == 1


def test_imports_are_read_once_and_their_paths_shortened_once(spark, tmp_path):
    from keyloom.operators import modules
    from keyloom.plans import texts

    spark.range(30).selectExpr("id p_partkey", "'n' p_name", "'b' p_brand", "1 p_size").write.parquet(str(tmp_path / "part.parquet"))
    got = texts.QUERIES["J10_import_targets"](spark, str(tmp_path))
    assert "MapInArrow" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = [(f"m{k}.ts", f"./m{k // 2}" if k % 3 == 0 else "./none", f"m{k // 2}.ts" if k % 3 == 0 else None) for k in range(30)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    paths = {"a//b/./c": "a/b/c", "a/../b": "b", "../a": "../a", None: None, "": "", "a/b": "a/b"}
    df = spark.createDataFrame([(p,) for p in paths], "p string").select("p", modules.normal(F.col("p")).alias("n"))
    assert {r.p: r.n for r in df.collect()} == paths
    assert df._jdf.queryExecution().analyzed().toString().count("regexp_replace") == 1


def test_exported_objects_are_taken_apart_once(monkeypatch):
    from keyloom.sources import messages

    asked, real = [], messages.Messages.flat
    monkeypatch.setattr(messages.Messages, "flat", lambda self, node, prefix="", depth=0, *a, **k: (asked.append(node.start) if depth == 0 else None, real(self, node, prefix, depth, *a, **k))[1])
    body = 'import base from "./base";\nexport default { own: "x", box: { ...base, y: "z" } };\nexport const messages = { a: "b" };'
    got = list(extract.facts_of("a", "typescript", body, kinds=extract.OF_DEFINITIONS))
    assert len(asked) == len(set(asked)) == 2
    assert [(d["export"], d["key"]) for k, d in got if k == "object"] == [("default", "own"), ("default", "box"), ("default", "box.y"), ("messages", "a")]
    assert [d["key"] for k, d in got if k == "entry"] == ["own", "box.y", "a"] and [d["prefix"] for k, d in got if k == "spread"] == ["box"]


def test_every_line_item_is_a_usage_under_a_cursor(spark, tmp_path):
    import duckdb

    from keyloom.plans import audit

    # order keys that five doesn't divide count as well
    items = [(1, 3, 1, 1), (201, 3, 4, 1), (7, 8, 1, 2), (10, 8, 2, 2)]
    spark.createDataFrame(items, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 3), (2, 3), (7, 8), (10, 58), (12, 8)], "o_orderkey bigint, o_custkey bigint").write.parquet(f"{tmp_path}/orders.parquet")
    want = [(1, 2011, True), (2, 2011, True), (7, 72, False), (10, 102, False), (12, None, None)]
    assert sorted(tuple(x) for x in audit.X22_usage_at_cursor(spark, str(tmp_path)).collect()) == want
    duck = duckdb.connect()
    for t in ("lineitem", "orders"):
        duck.execute(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    assert sorted(duck.execute(audit.ORACLES["X22_usage_at_cursor"]).fetchall()) == want


def test_usages_are_folded_without_a_sort_of_all(spark):
    from keyloom.operators import editor

    at = ("f", 1, 2, 1, 4)
    rows = [(9, *at, False), (3, *at, None), (None, *at, True), (8, *at, True), (5, *at, False)]
    c = spark.createDataFrame([(1, "f", 1, 2)], "cursor bigint, rel_path string, line bigint, character bigint")
    u = spark.createDataFrame(rows, "ord bigint, rel_path string, line bigint, column bigint, end_line bigint, end_column bigint, dynamic boolean")
    for kinds, want in (("true", (1, 8, True)), ("ord is null or not dynamic", (1, None, True)), ("dynamic is null or not dynamic", (1, 5, False)), ("dynamic is null", (1, 3, None))):
        got = editor.usage_at(c, u.where(kinds))
        assert [tuple(x) for x in got.collect()] == [want]
        assert "SortAggregate" not in got._jdf.queryExecution().toString()
