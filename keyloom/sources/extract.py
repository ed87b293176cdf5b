"""Facts of files: every file is read and parsed once, and gives rows of all kinds.

What other files define stays a reference (``refs``, ``spreads``, ``registrations``); joins resolve it: imports meet files,
symbols are followed through re-exports, and paths into symbols meet the strings that files export.
"""

from __future__ import annotations

import json
import re
from collections.abc import Collection, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import locales, text
from ..operators import graph, modules
from ..operators.files import test_like
from ..storage import cut, cut_by
from . import catalog, code, messages, templates
from .analysis import Script

_PLACE = "line bigint, column bigint, start bigint, end bigint"
SCHEMAS = {
    "usage": f"key string, namespaces array<string>, resolved boolean, library string, confidence double, context string, suppress boolean, via string, {_PLACE}",
    "dynamic": f"namespaces array<string>, library string, confidence double, prefixes array<string>, suffixes array<string>, contains array<string>, covers boolean, {_PLACE}",
    "ref": f"source string, name string, path string, prefix string, suffix string, key string, namespaces array<string>, resolved boolean, library string, confidence double, context string, suppress boolean, via string, {_PLACE}",
    "ask": f"prop string, route boolean, key string, namespaces array<string>, resolved boolean, library string, confidence double, context string, suppress boolean, via string, {_PLACE}",
    "told": "prop string, value string",
    "depend": "name string, needs string",
    "literal": f"text string, context string, attribute string, library string, {_PLACE}",
    "import": "local string, source string, name string",
    "export": "name string, kind string, source string, source_name string",
    "value": "name string, path string, value string",
    "edge": "caller string, callee string, kind string, forwards boolean",
    "pass": "fn string, ns string, from_fn string",
    "entry": f"key string, value string, value_kind string, locale string, namespace string, format string, {_PLACE}",
    "spread": f"prefix string, locale string, namespace string, source string, name string, format string, {_PLACE}",
    "object": f"export string, key string, value string, value_kind string, source string, name string, {_PLACE}",
    "registration": "locale string, namespace string, source string, name string",
    "warning": "message string",
}
#: Kinds that ``usages`` and ``definitions`` need.
OF_USAGES = ("usage", "dynamic", "ref", "ask", "told", "import", "export", "value", "pass")
OF_DEFINITIONS = ("entry", "spread", "object", "registration", "import", "export")
#: Languages whose files hold scripts, and those that hold markup.
SCRIPTS, MARKUP = ("javascript", "typescript", "vue", "svelte", "astro", "html"), ("vue", "svelte", "astro", "html")


class _Places:
    """Lines and columns, and offsets in units of UTF-16, of a text's places."""

    def __init__(self, body: str):
        self.body, self.plain = body, body.isascii()
        self.starts = [0, *(m.end() for m in re.finditer("\n", body))]

    def units(self, a: int, b: int) -> int:
        return b - a if self.plain else len(self.body[a:b].encode("utf-16-le")) // 2

    def of(self, start: int, end: int) -> dict:
        from bisect import bisect_right

        line = bisect_right(self.starts, start)
        low = self.starts[line - 1]
        first = self.units(0, start)
        return {"line": line, "column": self.units(low, start) + 1, "start": first, "end": first + self.units(start, end)}


def facts_of(path: str, language: str, body: str, nuxt: bool = False, kinds: Collection[str] | None = None) -> Iterator[tuple[str, dict]]:
    """(kind, fields) of the facts of one file; of the kinds asked for, if they are given."""
    for kind, data in _facts_of(language, body, nuxt, frozenset(SCHEMAS if kinds is None else kinds)):
        if kinds is None or kind in kinds:
            yield kind, data


def _facts_of(language: str, body: str, nuxt: bool, kinds: frozenset[str]) -> Iterator[tuple[str, dict]]:
    """``facts_of``; what needs work of its own is left out where none of its kinds is asked for."""
    places = _Places(body)
    if language == "json":
        found, problems = catalog.read(body)
        for key, value, kind, _, _, start, end in found:
            yield "entry", {"key": key, "value": value, "value_kind": kind, "locale": None, "namespace": None, "format": "json", **places.of(start, end)}
        for problem in problems:
            yield "warning", {"message": problem}
        return
    if language == "yaml":
        for e in messages.yaml_entries(body):
            yield "entry", {"key": e.key, "value": e.value, "value_kind": e.kind, "locale": None, "namespace": None, "format": "yaml", **places.of(e.start, e.end)}
        return
    if language not in SCRIPTS:
        return
    if language in MARKUP:
        for key, library, sure, start, end, context in templates.scan(body, language, nuxt):
            ns, _, rest = key.partition(":") if library == "i18next" and re.match(r"[\w@./-]+:[^/]", key) else ("", "", key)
            yield "usage", {"key": rest, "namespaces": [ns] if ns else [], "resolved": bool(ns), "library": library, "confidence": sure, "context": context, "suppress": False, "via": None, **places.of(start, end)}
    script = Script(templates.scripts(body, language), nuxt)
    yield from _facts_in(script, language, places, kinds)
    script.release()


def _facts_in(script: Script, language: str, places: _Places, kinds: frozenset[str]) -> Iterator[tuple[str, dict]]:
    if not kinds.isdisjoint(("usage", "dynamic", "ref", "ask")):
        static, dynamic, refs = script.facts()
        for u in static:
            yield "usage", {"key": u.key, "namespaces": list(u.namespaces), "resolved": u.resolved, "library": u.library, "confidence": u.confidence, "context": u.context, "suppress": u.suppress, "via": u.via, **places.of(u.start, u.end)}
        for d in dynamic:
            yield "dynamic", {"namespaces": list(d.namespaces), "library": d.library, "confidence": d.confidence, "prefixes": list(d.prefixes), "suffixes": list(d.suffixes), "contains": list(d.contains), "covers": d.covers, **places.of(d.start, d.end)}
        for r, u in refs:
            yield "ref", {**r._asdict(), "key": u.key, "namespaces": list(u.namespaces), "resolved": u.resolved, "library": u.library, "confidence": u.confidence, "context": u.context, "suppress": u.suppress, "via": u.via, **places.of(u.start, u.end)}
        for prop, route, u in dict.fromkeys(script.asks):
            yield "ask", {"prop": prop, "route": route, "key": u.key, "namespaces": list(u.namespaces), "resolved": u.resolved, "library": u.library, "confidence": u.confidence, "context": u.context, "suppress": False, "via": u.via, **places.of(u.start, u.end)}
    if "told" in kinds:
        for prop, value in script.told():
            yield "told", {"prop": prop, "value": value}
    if "depend" in kinds:
        for name, needs in script.dependencies():
            yield "depend", {"name": name, "needs": needs}
    if "literal" in kinds:
        for literal, context, attribute, start, end in script.literals():
            yield "literal", {"text": literal, "context": context, "attribute": attribute, "library": script.library(), **places.of(start, end)}
    if "import" in kinds:
        for local, (source, name) in script.imports.items():
            yield "import", {"local": local, "source": source, "name": name}
    if "export" in kinds:
        for name, kind, source, source_name in script.exports():
            yield "export", {"name": name, "kind": kind, "source": source, "source_name": source_name}
    if "value" in kinds:
        for name, inner, value in script.exported_values():
            yield "value", {"name": name, "path": inner, "value": value}
    if "edge" in kinds:
        for caller, callee, kind, forwards in script.call_edges():
            yield "edge", {"caller": caller, "callee": callee, "kind": kind, "forwards": forwards}
    if "pass" in kinds:
        for fn, ns, from_fn in script.translator_calls():
            yield "pass", {"fn": fn, "ns": ns, "from_fn": from_fn}
    if kinds.isdisjoint(("entry", "spread", "object", "registration")):
        return
    held = messages.Messages(script)
    if not kinds.isdisjoint(("entry", "spread")):
        for e in [*held.entries(), *held.inline_registrations()]:
            if e.source is None:
                yield "entry", {"key": e.key, "value": e.value, "value_kind": e.kind, "locale": e.locale, "namespace": e.namespace, "format": language, **places.of(e.start, e.end)}
            else:
                yield "spread", {"prefix": e.key, "locale": e.locale, "namespace": e.namespace, "source": e.source, "name": e.name, "format": language, **places.of(e.start, e.end)}
    if "object" in kinds:
        for export, e in held.objects():
            yield "object", {"export": export, "key": e.key, "value": e.value, "value_kind": e.kind, "source": e.source, "name": e.name, **places.of(e.start, e.end)}
    if "registration" in kinds:
        for locale, namespace, source, name in held.registrations():
            yield "registration", {"locale": locale, "namespace": namespace, "source": source, "name": name}


def facts(files: DataFrame, nuxt: bool = False, kinds: Collection[str] | None = None) -> DataFrame:
    """(rel_path, fact, data: JSON) of files (rel_path, language, text); of the kinds asked for, if they are given.

    Files are dealt to all cores first: a table of small files is few splits, and reading scripts takes far longer than moving them."""
    spark = files.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    asked = None if kinds is None else frozenset(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for path, language, body in zip(*(batch.column(c) for c in ("rel_path", "language", "text"))):
                path = path.as_py()
                for kind, data in _remembered(language.as_py(), body.as_py() or "", nuxt, asked):
                    rows.append((path, kind, data))
                    size += len(data)
                if len(rows) >= _ROWS or size >= _CHARS:
                    yield _batch(rows)
                    rows, size = [], 0
        if rows:
            yield _batch(rows)

    dealt = files.select("rel_path", "language", "text").repartition(parts, F.xxhash64("rel_path"))
    return dealt.mapInArrow(run, "rel_path string, fact string, data string")


#: Rows and characters of a batch that a worker sends, and characters that it remembers.
_ROWS, _CHARS, _KEPT = 1 << 13, 1 << 22, 1 << 24
_memo: dict[tuple, list[tuple[str, str]]] = {}
_held = 0


def _remembered(language: str, body: str, nuxt: bool, kinds: frozenset[str] | None) -> list[tuple[str, str]]:
    """(kind, JSON) of the facts of a text. They don't depend on its path, so copies of a file are read once by a worker, while it
    remembers them: it forgets all when they get too long, and keeps no text that is long itself."""
    global _held
    key = (language, body, nuxt, kinds)
    found = _memo.get(key)
    if found is None:
        found = [(kind, json.dumps(data)) for kind, data in facts_of("", language, body, nuxt, kinds)]
        size = len(body) + sum(len(data) for _, data in found) + 64 * (1 + len(found))
        if size <= _KEPT >> 8:
            if _held + size > _KEPT:
                _memo.clear()
                _held = 0
            _memo[key] = found
            _held += size
    return found


def _batch(rows: list[tuple[str, str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, pa.string()) for column in zip(*rows)], ["rel_path", "fact", "data"])


def facts_of_kind(files: DataFrame, fact: str, columns: Collection[str] | None = None, nuxt: bool = False) -> DataFrame:
    """The facts of one kind, as ``view`` gives those of ``facts``; of its columns those asked for, if they are given.

    Workers send columns: what copies of a text say is taken from what a worker remembers, without a step for each fact."""
    spark, schema = files.sparkSession, StructType.fromDDL(SCHEMAS[fact])
    schema = StructType([schema[c] for c in (schema.names if columns is None else columns)])
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    kind = pa.struct(list(to_arrow_schema(schema)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from _columns(batch, fact, kind, nuxt)

    dealt = files.select("rel_path", "language", "text").repartition(parts, F.xxhash64("rel_path"))
    return dealt.mapInArrow(run, StructType([StructField("rel_path", StringType()), *schema.fields]))


class _Store:
    """Facts of texts, one behind the other, with the place, the number and the size of each text's: what a worker remembers of one kind.
    It forgets all when they get too long, and keeps no text that is long itself."""

    def __init__(self, fact: str, kind: pa.DataType, nuxt: bool):
        self.of, self.facts, self.known, self.held = (fact, kind, nuxt), pa.array([], kind), {}, 0


_store: _Store | None = None


def _columns(batch: pa.RecordBatch, fact: str, kind: pa.DataType, nuxt: bool) -> Iterator[pa.RecordBatch]:
    """The facts of a batch of files (rel_path, language, text)."""
    global _store
    if _store is None or _store.of != (fact, kind, nuxt):
        _store = _Store(fact, kind, nuxt)
    store = _store
    language, body = (batch.column(c).dictionary_encode("encode") for c in ("language", "text"))
    languages, bodies = language.dictionary.to_pylist(), body.dictionary.to_pylist()
    both = language.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(bodies) + body.indices.to_numpy(zero_copy_only=False)
    each, number = np.unique(both, return_inverse=True)
    keys = [(languages[k // len(bodies)], bodies[k % len(bodies)] or "") for k in each.tolist()]
    fresh: dict[tuple, list[dict]] = {key: [data for _, data in facts_of("", *key, nuxt, (fact,))] for key in keys if key not in store.known}
    size = {key: len(key[1]) + 64 + sum(64 + sum(len(str(v)) for v in data.values()) for data in found) for key, found in fresh.items()}
    short = [key for key in fresh if size[key] <= _KEPT >> 8]
    learnt, at = {}, len(store.facts)
    for key in [*short, *(fresh.keys() - set(short))]:
        learnt[key] = (at, len(fresh[key]), size[key])
        at += len(fresh[key])
    held = pa.concat_arrays([store.facts, _array([data for key in learnt for data in fresh[key]], kind)]) if fresh else store.facts
    start, count, weight = (np.array(x, np.int64)[number] for x in zip(*(learnt.get(key) or store.known[key] for key in keys)))
    if (more := sum(size[key] for key in short)) + store.held > _KEPT:
        _store = None
    elif short:
        store.known.update((key, learnt[key]) for key in short)
        store.facts, store.held = held[: len(store.facts) + sum(learnt[key][1] for key in short)], store.held + more
    rows, chars, low = np.cumsum(count), np.cumsum(weight), 0
    while low < len(count):
        done = (rows[low - 1], chars[low - 1]) if low else (0, 0)
        high = max(low + 1, int(min(np.searchsorted(rows, done[0] + _ROWS, "right"), np.searchsorted(chars, done[1] + _CHARS, "right"))))
        n, total = count[low:high], int(rows[high - 1] - done[0])
        if total:
            taken = held.take(pa.array(np.repeat(start[low:high] - (rows[low:high] - done[0] - n), n) + np.arange(total)))
            paths = batch.column("rel_path").take(pa.array(np.repeat(np.arange(low, high), n)))
            yield pa.RecordBatch.from_arrays([paths, *taken.flatten()], ["rel_path", *(f.name for f in kind)])
        low = high


def _array(found: list[dict], kind: pa.DataType) -> pa.Array:
    try:
        return pa.array(found, kind)
    except UnicodeEncodeError:  # halves of characters, as escapes may name them: pairs become one, others a question mark
        whole = lambda x: x.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "surrogatepass").encode("utf-8", "replace").decode() if isinstance(x, str) else [whole(y) for y in x] if isinstance(x, list) else x
        return pa.array([{k: whole(v) for k, v in data.items()} for data in found], kind)


def kept(found: DataFrame) -> DataFrame:
    """The facts written once; each ``view`` reads only its kind."""
    return cut_by(found, "fact")


def view(found: DataFrame, fact: str) -> DataFrame:
    """The facts of one kind, as columns."""
    return found.where(F.col("fact") == fact).select("rel_path", F.from_json("data", SCHEMAS[fact]).alias("d")).select("rel_path", "d.*")


# ---- what joins resolve


def _links(found: DataFrame, files: DataFrame, paths: dict[str, list[str]] | None) -> DataFrame:
    """(rel_path, source, target): the files that imports and re-exports mean."""
    asked = view(found, "import").select("rel_path", "source").union(view(found, "export").where("source is not null").select("rel_path", "source")).distinct()
    known = files.select("rel_path")
    return cut(modules.resolved(asked.withColumnRenamed("source", "spec"), known, paths).where("target is not null").select("rel_path", F.col("spec").alias("source"), "target"))


def exports_of(found: DataFrame, links: DataFrame) -> DataFrame:
    """Exports with the files that they come from, as ``modules.follow`` takes them."""
    e = view(found, "export")
    return e.join(links, ["rel_path", "source"], "left").select("rel_path", "name", "kind", "target", F.col("source_name").alias("target_name"))


def symbols(found: DataFrame, links: DataFrame, asked: DataFrame) -> DataFrame:
    """(file, name, at, as): where symbols (file, name) that imports ask for are defined."""
    req = F.concat_ws("#", "file", "name")
    got = modules.follow(asked.select(req.alias("req"), F.col("file").alias("rel_path"), "name").distinct(), exports_of(found, links)).where("state = 'found'")
    return asked.distinct().join(got.select("req", F.col("rel_path").alias("at"), F.col("name").alias("as")), req == F.col("req")).select("file", "name", "at", "as")


ROUTES = r"(?i)Route\.[cm]?[jt]sx?$|routesConfig\.[cm]?[jt]sx?$|(^|/)routes\.[cm]?[jt]sx?$"
SHARED = r"(^|/)app-configs/|(?i)Config\.[cm]?[jt]sx?$"


def related(found: DataFrame) -> DataFrame:
    """Usages, some of them repeated, of telling properties (``ask``), with the strings (``told``) of related files: the same file, files below its folder, files
    of its feature (the two folders below ``app``), and shared configurations; routes' properties with those of route files.

    Each file has a few tokens of kinship, and meets others by them: an equi-join. What a file wants follows from its folder, so the
    strings are found once for each folder and property; files of no folder have themselves instead."""
    path = F.col("rel_path")
    folder = F.regexp_replace(path, r"/?[^/]*$", "")
    feature = F.nullif(F.regexp_extract(path, r"(?:^|/)app/([^/]+/[^/]+)/", 1), F.lit(""))
    none = F.array().cast("array<string>")
    some = lambda c, x: F.when(c, F.array(x)).otherwise(none)
    steps = F.split(folder, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.concat(F.lit("d:"), F.array_join(F.slice(steps, F.lit(1), k), "/")))
    told = view(found, "told")
    own = F.concat(above, F.array(F.concat(F.lit("p:"), path)), some(feature.isNotNull(), F.concat(F.lit("f:"), feature)), some(path.rlike(SHARED), F.lit("c:")), some(path.rlike(ROUTES), F.lit("r:")))
    told = told.select("prop", "value", F.explode(own).alias("token")).distinct()
    ask = view(found, "ask")
    group = F.when(F.col("route"), F.lit("r:")).otherwise(F.concat(F.when(folder != "", F.lit("d:")).otherwise(F.lit("p:")), F.when(folder != "", folder).otherwise(path)))
    # a file's own strings have its folder's token as well
    wanted = F.array_compact(F.array(F.col("group"), F.when(~F.col("route"), F.lit("c:")), F.when(~F.col("route"), F.concat(F.lit("f:"), feature))))
    ask = ask.withColumn("group", group)
    heard = ask.select("prop", "group", F.explode(wanted).alias("token")).distinct().join(told, ["prop", "token"])
    met = ask.join(cut(heard.select("prop", "group", "value").distinct()), ["prop", "group"])
    return met.withColumn("key", F.when(F.col("key") != "", F.concat("key", "value")).otherwise(F.col("value"))).drop("group", "value", "prop", "route")


def usages(found: DataFrame, files: DataFrame, paths: dict[str, list[str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """Static and dynamic usage facts. References meet the strings that other files export; parameters get the namespaces of their calls."""
    links = _links(found, files, paths)
    own = view(found, "usage")
    refs = view(found, "ref").join(links, ["rel_path", "source"])
    asked = refs.select(F.col("target").alias("file"), "name")
    where = cut(symbols(found, links, asked))
    value = view(found, "value").select(F.col("rel_path").alias("at"), F.col("name").alias("as"), "path", "value")
    met = refs.join(where, (refs.target == where.file) & (refs.name == where.name)).drop(where.name).join(value, ["at", "as", "path"])
    whole = F.concat("prefix", "value", "suffix")
    foreign = met.withColumn("key", F.when(F.col("key") != "", F.concat("key", whole)).otherwise(whole)).select(*own.columns)
    every = own.union(foreign).union(related(found).select(*own.columns))
    bound = cut(graph.parameter_namespaces(view(found, "pass").select("fn", "ns", "from_fn")))
    every = every.repartition("rel_path").join(bound.select(F.col("fn").alias("via"), F.col("namespaces").alias("_more")), "via", "left")
    names = F.when(F.size("namespaces") > 0, F.col("namespaces")).otherwise(F.coalesce("_more", F.array().cast("array<string>")))
    every = every.withColumn("_names", names)
    static = every.select(
        "key", F.get("_names", F.lit(0)).alias("namespace"), F.when(F.size("_names") > 1, F.col("_names")).alias("namespaces"), "rel_path", "line", "column", "confidence", F.col("suppress").alias("suppress_unused_only"), "library", "context", "start", "end",
    )
    static = static.dropDuplicates(["rel_path", "start", "end", "key", "library"])
    d = view(found, "dynamic")
    dynamic = d.select(
        F.xxhash64("rel_path", "start").alias("ord"), "rel_path", "line", "column", F.get("namespaces", F.lit(0)).alias("namespace"), F.when(F.size("namespaces") > 1, F.col("namespaces")).alias("namespaces"),
        "prefixes", "suffixes", "contains", F.col("covers").alias("covers_namespace"),
    )
    return static, dynamic


def literals(found: DataFrame) -> DataFrame:
    """Literals that may be copy, with their score; those of tests are left out."""
    return scored(view(found, "literal").where(~test_like(F.col("rel_path"))))


def literals_of(files: DataFrame) -> DataFrame:
    """``literals`` of files of which nothing else is asked: tests needn't be read."""
    return scored(facts_of_kind(files.where(~test_like(F.col("rel_path"))), "literal", ["text", "line", "column", "context", "attribute"]))


def scored(lit: DataFrame) -> DataFrame:
    scored = lit.withColumn("confidence", text.score_literal(F.col("text"))).where("confidence is not null")
    return scored.select(text.truncate(F.col("text"), 120).alias("text"), "rel_path", "line", "column", "confidence", "context", "attribute")


def spread_entries(found: DataFrame, links: DataFrame, rounds: int = 4) -> DataFrame:
    """Entries that spreads of imported objects give, through at most ``rounds`` files; each keeps the file it stands in."""
    objects = cut(view(found, "object"))
    todo = view(found, "spread").join(links, ["rel_path", "source"]).select("rel_path", "prefix", "locale", "namespace", "format", F.col("target").alias("file"), "name")
    out = None
    for _ in range(rounds):
        todo = cut(todo)
        if todo.isEmpty():
            break
        where = symbols(found, links, todo.select("file", "name"))
        met = todo.join(where, ["file", "name"]).join(objects.withColumnsRenamed({"rel_path": "at", "export": "as", "source": "_source", "name": "_name"}), ["at", "as"])
        path = F.concat_ws(".", F.nullif("prefix", F.lit("")), F.nullif("key", F.lit("")))
        leaves = met.where("_source is null").select(F.col("at").alias("rel_path"), path.alias("key"), "value", "value_kind", "locale", "namespace", "format", "line", "column", "start", "end", F.col("rel_path").alias("spread_into"))
        out = leaves if out is None else out.union(leaves)
        more = met.where("_source is not null").select("rel_path", path.alias("prefix"), "locale", "namespace", "format", "at", "_source", "_name")
        todo = more.join(links.withColumnsRenamed({"rel_path": "at", "source": "_source"}), ["at", "_source"]).select("rel_path", "prefix", "locale", "namespace", "format", F.col("target").alias("file"), F.col("_name").alias("name"))
    if out is None:
        return view(found, "entry").limit(0).withColumn("spread_into", F.lit(None).cast("string"))
    return out


def definitions(found: DataFrame, files: DataFrame, paths: dict[str, list[str]] | None = None) -> DataFrame:
    """Definition facts of all catalogs: JSON and YAML files of a locale, message objects in scripts with what they spread, and
    what code registers, under the locale and namespaces that it says."""
    links = _links(found, files, paths)
    columns = ["rel_path", "key", "value", "value_kind", "locale", "namespace", "format", "line", "column", "start", "end"]
    own = view(found, "entry").select(*columns, F.col("rel_path").alias("of"))
    spread = spread_entries(found, links).select(*columns, F.col("spread_into").alias("of"))
    every = own.union(spread)
    registered = view(found, "registration").join(links, ["rel_path", "source"])
    where = symbols(found, links, registered.select(F.col("target").alias("file"), "name"))
    at = registered.join(where, (registered.target == where.file) & (registered.name == where.name)).select(
        F.col("at").alias("rel_path"), registered.rel_path.alias("at_file"), "locale", "namespace", F.lit(0.9).alias("confidence")
    )
    of = F.col("of")
    path_locale, path_ns = locales.infer_locale(of), locales.infer_namespace(of)
    sources = every.select("of").distinct().select(F.col("of").alias("rel_path"), path_locale.alias("locale"), path_ns.alias("namespace"), F.lit(0.9).alias("confidence"))
    by_file = modules.attributed(sources, at).withColumnsRenamed({"rel_path": "of", "locale": "_locale", "namespace": "_ns", "namespaces": "_all", "confidence": "_sure"})
    met = every.join(by_file, "of", "left")
    registered_files = at.select(F.col("rel_path").alias("of")).distinct().withColumn("_known", F.lit(True))
    met = met.join(registered_files, "of", "left")
    # a data file counts if its path names a locale; a script's objects if anything does
    locale = F.coalesce("locale", "_locale")
    kept = met.where(locale.isNotNull() | F.col("_known"))
    return kept.select(
        F.xxhash64("rel_path", "start", "key", locale).alias("ord"), "key", locale.alias("locale"), F.coalesce("namespace", "_ns").alias("namespace"), F.when(F.col("namespace").isNull(), F.col("_all")).alias("namespaces"),
        "rel_path", "line", "column", F.col("_sure").alias("confidence"), "value", "format", "start", "end",
    ).dropDuplicates(["rel_path", "start", "key", "locale", "namespace"])


def directives(files: DataFrame, marker: str) -> DataFrame:
    return code.extract_directives(files, marker)
