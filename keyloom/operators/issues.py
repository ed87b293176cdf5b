"""Issue finders: missing, unused and duplicate keys and untranslated text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import cut
from .matching import MatchOptions, confident, in_scope, present, probes, resolve_namespaces, shared_origins, used_groups

SEVERITIES = {"missing-key": "error", "duplicate-key": "warning", "unused-key": "warning", "untranslated-text": "info"}
#: Order of reports of the engine.
TYPE_ORDER = ("missing-key", "duplicate-key", "unused-key", "untranslated-text")
COLUMNS = ["type", "severity", "message", "key", "namespace", "rel_path", "line", "column", "n_related", "reason"]


def _quoted(label: str, value: Column) -> Column:
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f'{label} "'), value, F.lit('"'))).otherwise("")


def _issue(df: DataFrame, kind: str, message: Column, related: Column, reason: Column | None = None, severity: Column | None = None, **columns: Column) -> DataFrame:
    held = {c: columns.get(c, F.col(c)) for c in ("key", "namespace", "rel_path", "line", "column")}
    return df.select(
        F.lit(kind).alias("type"),
        (severity if severity is not None else F.lit(SEVERITIES[kind])).alias("severity"),
        message.alias("message"),
        *[c.alias(n) for n, c in held.items()],
        related.cast("long").alias("n_related"),
        (reason if reason is not None else F.lit(None).cast("string")).alias("reason"),
    )


def under(path: Column, folder: str) -> Column:
    """Whether a path is a folder or lies below it; the empty folder holds all."""
    folder = folder.replace("\\", "/").rstrip("/")
    path = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.lit(True) if not folder else (path == folder) | F.startswith(path, F.lit(folder + "/"))


def duplicates(definitions: DataFrame, options: MatchOptions = MatchOptions(), folder: str = "") -> DataFrame:
    """Keys defined twice or more in one locale and namespace; the first in path order is reported. With a folder
    those with any of their sites in it."""
    facts = confident(definitions, options)
    first = F.min(F.struct("rel_path", "line", "column", F.coalesce("locale", F.lit("")).alias("l"), F.coalesce("namespace", F.lit("")).alias("n"), "key", "locale", "namespace"))
    group = [F.coalesce("locale", F.lit("*")).alias("g_locale"), F.coalesce("namespace", F.lit("*")).alias("g_ns"), "key"]
    found = facts.groupBy(*group).agg(first.alias("p"), F.count("*").alias("times"), F.max(under(F.col("rel_path"), folder)).alias("inside"))
    found = found.where("times >= 2 and inside").select("times", "p.*")
    message = F.concat(
        F.lit('Duplicate translation key "'), "key", F.lit('" defined '), F.col("times").cast("string"), F.lit(" times"),
        F.when(F.col("l") != "", F.concat(F.lit(' (locale "'), "l", F.lit('")'))).otherwise(""),
        F.when(F.coalesce("namespace", F.lit("")) != "", F.concat(F.lit(' (namespace "'), "namespace", F.lit('")'))).otherwise(""), F.lit("."),
    )
    return _issue(found, "duplicate-key", message, F.col("times") - 1)


def fold_usages(usages: DataFrame, options: MatchOptions = MatchOptions()) -> DataFrame:
    """(key, all, p, n): one row for each key and list of resolved namespaces, with the first of the usages that may be reported as
    missing and their number. All that finders ask of usages is decided on these rows."""
    if "all" in usages.columns:
        return usages
    counts = ~F.coalesce("suppress_unused_only", F.lit(False))
    primary = F.struct("rel_path", "line", "column", F.coalesce("namespace", F.lit("")).alias("n"), "namespace")
    facts = confident(usages, options).withColumn("all", resolve_namespaces(options))
    return facts.groupBy("key", "all").agg(F.min(F.when(counts, primary)).alias("p"), F.count_if(counts).alias("n"))


def missing(definitions: DataFrame, usages: DataFrame, options: MatchOptions = MatchOptions()) -> DataFrame:
    """Usages without a definition, by resolved namespace and key; the first in path order is reported.

    Usages are folded to distinct (key, namespaces) before they meet definitions."""
    defined = probes(in_scope(confident(definitions, options), options))
    first_ns = F.get("all", F.lit(0)) if options.match_namespace else F.lit(None).cast("string")
    folded = fold_usages(usages, options).where("n > 0")
    if options.match_namespace:
        by_key = defined.where("ns is null").select("key").distinct()
        hit = folded.select("key", "all", F.explode("all").alias("ns")).join(defined.where("ns is not null"), ["key", "ns"], "left_semi").select("key", "all").distinct()
        gone = folded.join(by_key, "key", "left_anti").join(hit, ["key", "all"], "left_anti")
    else:
        gone = folded.join(defined.select("key").distinct(), "key", "left_anti")
    groups = gone.groupBy(first_ns.alias("ns"), "key").agg(F.min("p").alias("p"), F.sum("n").alias("n")).select("key", "n", "p.rel_path", "p.line", "p.column", "p.namespace")
    message = F.concat(F.lit('Missing translation key "'), "key", F.lit('"'), _quoted(" in namespace", F.col("namespace")), F.lit(" — used in code but not defined in translation sources."))
    return _issue(groups, "missing-key", message, F.col("n") - 1)


def _tagged(kind: str) -> Column:
    return F.transform(kind, lambda f: F.struct(F.lit(kind).alias("kind"), f.alias("fragment")))


def _lengths(frags: DataFrame) -> dict[str, list[int]]:
    """The lengths that fragments of each kind have: a few numbers, as many as the longest fragment is long at most."""
    found: dict[str, list[int]] = {}
    for r in frags.select("kind", F.length("fragment").alias("n")).distinct().collect():
        found.setdefault(r["kind"], []).append(r["n"])
    return found


def dynamic_hits(groups: DataFrame, definitions: DataFrame, dynamic: DataFrame, options: MatchOptions = MatchOptions(), origins: DataFrame | None = None) -> DataFrame:
    """(ns_group, key, hits, first): for logical groups, the dynamic usages whose fragments or coverage reach them.

    Fragments are joined by equality: keys are probed at the lengths that fragments of a kind have. Usages that cover
    a namespace are folded by their namespaces first, so a key meets each list of namespaces once, not each usage."""
    if not options.match_namespace:
        raise ValueError("dynamic hits need namespaces to be matched")
    dynamic = dynamic.withColumn("all", resolve_namespaces(options))
    frags = cut(
        dynamic.select("ord", "covers_namespace", "all", F.explode(F.concat(*map(_tagged, ("prefixes", "suffixes", "contains")))).alias("f"))
        .where("not covers_namespace and length(f.fragment) > 0").select("ord", "all", "f.*")
    )
    key, n = F.col("key"), F.length("key")
    at = {"prefixes": lambda k: F.array(F.lit(1)), "suffixes": lambda k: F.array(n - k + 1), "contains": lambda k: F.sequence(F.lit(1), n - k + 1)}

    def pieces(kind: str, k: int) -> Column:
        cut_out = F.transform(at[kind](k), lambda i: F.struct(F.lit(kind).alias("kind"), key.substr(i, F.lit(k)).alias("fragment")))
        return F.when(n >= k, cut_out).otherwise(F.array().cast("array<struct<kind:string,fragment:string>>"))

    parts = [pieces(kind, k) for kind, lengths in _lengths(frags).items() for k in lengths]
    probe = F.array_distinct(F.concat(*parts)) if parts else F.array().cast("array<struct<kind:string,fragment:string>>")
    probed = groups.select("key").distinct().select("key", F.explode(probe).alias("f")).select("key", "f.*")
    by_fragment = cut(probed.join(frags, ["kind", "fragment"]).select("key", "ord", "all").distinct())
    covering = dynamic.where("covers_namespace").groupBy("all").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    covering = cut(covering.withColumn("set", F.xxhash64("all")))

    # the namespaces by which a group is reached: its own, and those of shared origins
    site = ["rel_path", "line", "column", "key"]
    defs = definitions.select(present().alias("ns_group"), *site).join(groups.withColumnRenamed("ns_group", "g"), "key").where(F.col("ns_group").eqNullSafe(F.col("g"))).drop("g")
    shared = defs.where("ns_group is not null").join(shared_origins(definitions) if origins is None else origins, site).select("ns_group", "key", F.explode("siblings").alias("ns"))
    own = groups.select("ns_group", "key", F.col("ns_group").alias("ns"))
    named = own.where("ns is not null").union(shared).distinct()
    plain = groups.where("ns_group is null")
    a = named.join(by_fragment.select("key", "ord", F.explode("all").alias("ns")), ["key", "ns"]).select("ns_group", "key", "ord")
    b = plain.join(by_fragment, "key").select("ns_group", "key", "ord")
    one = a.union(b).distinct().groupBy("ns_group", "key").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    # a group without a namespace is reached by every covering usage
    sets = named.join(covering.select("all", "n", "first", F.explode("all").alias("ns")), "ns").select("ns_group", "key", "all", "n", "first").distinct()
    total = covering.agg(F.sum("n").alias("n"), F.min("first").alias("first")).first()  # two numbers
    every = plain.select("ns_group", "key", F.lit(total["n"]).cast("long").alias("n"), F.lit(total["first"]).cast("long").alias("first")).where("n > 0")
    reached = one.union(sets.select("ns_group", "key", "n", "first")).union(every)
    return reached.groupBy("ns_group", "key").agg(F.sum("n").alias("hits"), F.min("first").alias("first"))


def unused(definitions: DataFrame, usages: DataFrame, dynamic: DataFrame | None = None, options: MatchOptions = MatchOptions()) -> DataFrame:
    """One issue for each definition site of the logical groups that no usage refers to; softened where dynamic usages may."""
    facts = confident(definitions, options)
    origins = cut(shared_origins(facts))
    used = used_groups(facts, fold_usages(usages, options), options, origins)
    group = present() if options.match_namespace else F.lit(None).cast("string")
    marked = facts.withColumn("ns_group", group)
    sizes = marked.groupBy("ns_group", "key").agg(F.count("*").alias("n"))
    free = sizes.alias("s").join(used.alias("u"), (F.col("s.key") == F.col("u.key")) & F.col("s.ns_group").eqNullSafe(F.col("u.ns_group")), "left_anti")
    if dynamic is None:
        free = free.select("ns_group", "key", "n", F.lit(0).cast("long").alias("hits"), F.lit(None).cast("long").alias("first"))
    else:
        free = cut(free.select("ns_group", "key", "n")).alias("s")
        hits = dynamic_hits(free.select("ns_group", "key"), facts, dynamic, options, origins).alias("h")
        free = free.join(hits, (F.col("s.key") == F.col("h.key")) & F.col("s.ns_group").eqNullSafe(F.col("h.ns_group")), "left").select(
            "s.ns_group", "s.key", "s.n", F.coalesce("h.hits", F.lit(0).cast("long")).alias("hits"), "h.first"
        )
    d, f = marked.alias("d"), free.alias("f")
    rows = d.join(f, (F.col("d.key") == F.col("f.key")) & F.col("d.ns_group").eqNullSafe(F.col("f.ns_group"))).select("d.*", "f.n", "f.hits", "f.first")
    where = _quoted(" in namespace", F.col("namespace"))
    plain = F.concat(F.lit('Unused translation key "'), "key", F.lit('"'), where, F.lit(" — defined but never referenced."))
    if dynamic is None:
        return _issue(rows, "unused-key", plain, F.col("n") - 1)
    site = dynamic.select(F.col("ord").alias("first"), F.col("rel_path").alias("dyn_path"), F.col("line").alias("dyn_line"), "prefixes", "suffixes", "contains", "covers_namespace")
    rows = rows.join(site, "first", "left")
    fits = lambda c, test: F.get(F.filter(c, test), F.lit(0))
    key = F.col("key")
    fragment = F.coalesce(
        fits("prefixes", lambda p: key.startswith(p)), fits("suffixes", lambda p: key.endswith(p)), fits("contains", lambda p: key.contains(p)),
        F.get("prefixes", F.lit(0)), F.get("suffixes", F.lit(0)), F.get("contains", F.lit(0)), F.lit("…"),
    )
    at = F.concat("dyn_path", F.lit(":"), F.col("dyn_line").cast("string"))
    hint = F.when(F.col("covers_namespace"), F.concat(F.lit("possibly covered by dynamic key lookup at "), at)).otherwise(
        F.concat(
            F.lit('possible dynamic usage matching "'), fragment, F.lit('" in '), at,
            F.when(F.col("hits") > 1, F.concat(F.lit(" (+"), (F.col("hits") - 1).cast("string"), F.lit(" other dynamic site(s))"))).otherwise(""),
        )
    )
    soft = F.concat(F.lit('Translation key "'), "key", F.lit('"'), where, F.lit(" may be unused — "), hint)
    is_soft = F.col("hits") > 0
    return _issue(
        rows, "unused-key", F.when(is_soft, soft).otherwise(plain), F.col("n") - 1 + F.col("hits"), F.when(is_soft, F.lit("dynamic-usage")),
        F.when(is_soft, F.lit("info")).otherwise(F.lit(SEVERITIES["unused-key"])),
    )


def untranslated(literals: DataFrame, options: MatchOptions = MatchOptions()) -> DataFrame:
    """One issue for each literal; literals: text, rel_path, line, column, confidence, context, attribute."""
    display = F.when(F.length("text") > 60, F.concat(F.substring("text", 1, 59), F.lit("…"))).otherwise(F.col("text"))
    where = F.when(F.col("attribute").isNotNull(), F.concat(F.lit(' in attribute "'), "attribute", F.lit('"'))).when(F.col("context") == "jsx-text", " in JSX text").otherwise("")
    message = F.concat(F.lit("This text has no translation"), where, F.lit(': "'), display, F.lit('"'))
    return _issue(confident(literals, options), "untranslated-text", message, F.lit(0), key=F.col("text"), namespace=F.lit(None).cast("string"))


def ordered(issues: DataFrame) -> DataFrame:
    """The engine's order of issues."""
    rank = F.array_position(F.array(*map(F.lit, TYPE_ORDER)), F.col("type"))
    severity = F.array_position(F.array(F.lit("error"), F.lit("warning"), F.lit("info")), F.col("severity"))
    return issues.orderBy(rank, "key", F.coalesce("namespace", F.lit("")), "rel_path", "line", "column", severity)


def stats(issues: DataFrame) -> DataFrame:
    """Counts by type and severity, with the totals of either."""
    return issues.cube("type", "severity").agg(F.count("*").alias("n"))


def analyze(definitions: DataFrame, usages: DataFrame, dynamic: DataFrame | None, literals: DataFrame | None, options: MatchOptions = MatchOptions()) -> DataFrame:
    """All four issue types, in one table. Definitions, folded usages and dynamic usages are computed once for all finders."""
    columns = [c for c in ("key", "locale", "namespace", "namespaces", "rel_path", "line", "column", "confidence") if c in definitions.columns]
    definitions = cut(confident(definitions, options).select(*columns))
    folded = cut(fold_usages(usages, options))
    dynamic = cut(dynamic) if dynamic is not None else None
    found = missing(definitions, folded, options).union(duplicates(definitions, options)).union(unused(definitions, folded, dynamic, options))
    return found.union(untranslated(literals, options)) if literals is not None else found


def in_folder(found: DataFrame, definitions: DataFrame, folder: str, options: MatchOptions = MatchOptions()) -> DataFrame:
    """Issues of a folder: those that lie in it, and duplicates with any of their sites in it."""
    rest = found.where((F.col("type") != "duplicate-key") & under(F.col("rel_path"), folder))
    return rest.union(duplicates(definitions, options, folder).select(*found.columns))


def report_order(found: DataFrame) -> DataFrame:
    """The order of reports: by the name of the type, key, namespace, path, line and column."""
    return found.orderBy("type", "key", F.coalesce("namespace", F.lit("")), F.replace("rel_path", F.lit("\\"), F.lit("/")), "line", "column")


def merged(parts: list[DataFrame]) -> DataFrame:
    """The issues of several packages in one table, in the order of reports; their counts are taken anew with ``stats``."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return report_order(out)


def has_key(usages: DataFrame, definitions: DataFrame, options: MatchOptions = MatchOptions()) -> DataFrame:
    """The usages that some definition satisfies."""
    resolved = usages.withColumn("all", resolve_namespaces(options))
    defined = probes(definitions.withColumn("namespaces", F.lit(None).cast("array<string>")))
    pairs = resolved.select("key", "all").distinct()
    by_key = pairs.join(defined.where("ns is null"), "key", "left_semi")
    by_ns = pairs.select("key", "all", F.explode("all").alias("ns")).join(defined.where("ns is not null"), ["key", "ns"], "left_semi").select("key", "all")
    return resolved.join(by_key.union(by_ns).distinct(), ["key", "all"], "left_semi").drop("all")
