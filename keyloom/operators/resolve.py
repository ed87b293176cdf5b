"""Namespaces, keys and locales that a usage means under a project's settings."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import round_half_up
from ..storage import cut

# fixed values: the most that each provenance may claim
CAPS = {"options": 0.95, "call-site": 0.92, "inline": 0.9, "key-prefix": 0.93, "defaultNS": 0.85, "implicit": 0.55, "next-intl": 0.94, "none": 0.7, "fallbackNS": 0.5}
LOCALE_CAPS = {"call-site": 0.95, "default-locale": 0.85, "unsupported": 0.6}
#: Steps of a chain of locales.
INHERITED = 8


@dataclass(frozen=True)
class Settings:
    default_ns: str | None = None
    fallback_ns: tuple[str, ...] = ()
    ns_separator: str = ":"
    key_separator: str = "."
    confidence: float = 1.0
    default_locale: str | None = None
    fallback_locales: tuple[str, ...] = ()
    supported: tuple[str, ...] = ()
    inheritance: dict[str, str] = field(default_factory=dict)


def names(values: Column) -> Column:
    """Trimmed, distinct, without empty ones; null if none is left."""
    held = F.array_distinct(F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != ""))
    return F.when(F.size(held) > 0, held)


def _literal(values: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def _quoted(text: str) -> str:
    return "".join("\\" + c if not c.isalnum() else c for c in text)


def join_parts(parts: list[Column], separator: str) -> Column:
    """Parts of a key joined by the separator, of which they shed their own at either end; missing and empty ones are left out."""
    sep = separator or "."
    q = _quoted(sep)
    clean = [F.regexp_replace(F.regexp_replace(F.coalesce(p, F.lit("")), f"^(?:{q})+", ""), f"(?:{q})+$", "") for p in parts]
    return F.array_join(F.filter(F.array(*clean), lambda x: x != ""), sep)


def inline_namespace(key: Column, separator: str) -> tuple[Column, Column]:
    """(namespace, rest) of a key that names its own; null if it doesn't. Messages with braces and no dot are none."""
    if not separator:
        none = F.lit(None).cast("string")
        return none, none
    at = F.instr(key, separator)
    ns, rest = key.substr(F.lit(1), at - 1), key.substr(at + len(separator), F.length(key))
    ok = (at > 1) & ns.rlike(r"^[A-Za-z0-9_.@/-]+$") & (rest != "") & ~(rest.contains("{") & ~rest.contains("."))
    return F.when(ok, ns), F.when(ok, rest)


def _capped(confidence: Column, cap: Column | float) -> Column:
    cap = cap if isinstance(cap, Column) else F.lit(cap)
    return round_half_up(F.when(confidence.isNull(), cap).otherwise(F.least(confidence, cap)), 2)


def resolve_i18next(usages: DataFrame, settings: Settings, implicit: bool = True) -> DataFrame:
    """Adds ``r_namespace, r_namespaces, r_key, r_source, r_confidence``; usages: key, options_ns and call_ns (arrays), key_prefix,
    confidence. Options go before the call site, before the key's own, before the default; the fallbacks follow any."""
    options, call = names(F.col("options_ns")), names(F.col("call_ns"))
    own, rest = inline_namespace(F.col("key"), settings.ns_separator)
    default = F.lit(settings.default_ns).cast("string") if settings.default_ns is not None else F.lit(None).cast("string")
    fallback = names(_literal(settings.fallback_ns))
    given = F.col("confidence")
    none = F.lit(None).cast("string")
    step = (
        F.when(options.isNotNull(), F.struct(F.lit("options").alias("source"), options.alias("all"), F.lit(CAPS["options"]).alias("cap")))
        .when(call.isNotNull(), F.struct(F.lit("call-site").alias("source"), call.alias("all"), F.lit(CAPS["call-site"]).alias("cap")))
        .when(own.isNotNull(), F.struct(F.lit("call-site").alias("source"), F.array(own).alias("all"), F.lit(CAPS["inline"]).alias("cap")))
        .when(default.isNotNull(), F.struct(F.lit("defaultNS").alias("source"), F.array(default).alias("all"), F.lit(min(settings.confidence or 1.0, CAPS["defaultNS"])).alias("cap")))
        .when(F.lit(implicit), F.struct(F.lit("defaultNS").alias("source"), F.array(F.lit("translation")).alias("all"), F.lit(CAPS["implicit"]).alias("cap")))
        .when(fallback.isNotNull(), F.struct(F.lit("fallbackNS").alias("source"), fallback.alias("all"), F.lit(CAPS["fallbackNS"]).alias("cap")))
        .otherwise(F.struct(F.lit("unknown").alias("source"), F.lit(None).cast("array<string>").alias("all"), F.lit(CAPS["none"]).alias("cap")))
    )
    out = usages.withColumn("_step", step)
    every = F.when(F.col("_step.all").isNotNull() & fallback.isNotNull(), F.array_distinct(F.concat(F.col("_step.all"), fallback))).otherwise(F.col("_step.all"))
    body = F.when(options.isNull() & call.isNull() & own.isNotNull(), rest).otherwise(F.col("key"))
    prefix = F.nullif(F.trim(F.coalesce("key_prefix", F.lit(""))), F.lit(""))
    sure = _capped(given, F.col("_step.cap"))
    return out.withColumns(
        {
            "r_namespace": F.get(F.col("_step.all"), F.lit(0)),
            "r_namespaces": F.when(F.size(every) > 1, every),
            "r_key": F.when(prefix.isNull(), body).otherwise(join_parts([prefix, body], settings.key_separator)),
            "r_source": F.when((F.col("_step.source") == "unknown") & prefix.isNotNull(), "key-prefix").otherwise(F.col("_step.source")),
            "r_confidence": F.when(prefix.isNull(), sure).otherwise(round_half_up(F.least(sure, F.lit(CAPS["key-prefix"])), 2)),
        }
    ).drop("_step")


def resolve_next_intl(usages: DataFrame, settings: Settings) -> DataFrame:
    """The same columns where a namespace is a prefix of the key's path, and defaults and fallbacks don't count."""
    call = names(F.col("call_ns"))
    first, prefix = F.get(call, F.lit(0)), F.nullif(F.trim(F.coalesce("key_prefix", F.lit(""))), F.lit(""))
    return usages.withColumns(
        {
            "r_namespace": first,
            "r_namespaces": F.when(F.size(call) > 1, call),
            "r_key": join_parts([first, prefix, F.col("key")], settings.key_separator),
            "r_source": F.when(first.isNotNull(), "call-site").when(prefix.isNotNull(), "key-prefix").otherwise("unknown"),
            "r_confidence": _capped(F.col("confidence"), F.when(first.isNotNull() | prefix.isNotNull(), CAPS["next-intl"]).otherwise(CAPS["none"])),
        }
    )


def locale_token(value: Column) -> Column:
    """Trimmed, with hyphens, in lower case."""
    return F.lower(F.replace(F.trim(value), F.lit("_"), F.lit("-")))


def chain_of(start: str, parents: dict[str, str], most: int = INHERITED) -> list[str]:
    """The locales that one inherits from, nearest first; a cycle ends the chain."""
    low = {}
    for k, v in parents.items():
        low.setdefault(k.lower(), v)
    out, seen, at = [], {start.lower()}, start
    for _ in range(most):
        parent = parents.get(at) or low.get(at.lower())
        if not parent or parent.lower() in seen:
            break
        seen.add(parent.lower())
        out.append(parent)
        at = parent
    return out


def resolve_locale(usages: DataFrame, settings: Settings) -> DataFrame:
    """Adds ``l_locale, l_source, l_chain, l_fallback, l_confidence``; usages: locale, confidence. The chain begins with the locale."""
    token = locale_token(F.nullif("locale", F.lit("")))
    default = F.lit(settings.default_locale).cast("string")
    given = F.col("confidence")
    cap = min(settings.confidence or 1.0, LOCALE_CAPS["default-locale"])
    out = usages.withColumn("l_locale", F.coalesce(token, F.nullif(default, F.lit(""))))
    out = out.withColumn("l_source", F.when(token.isNotNull(), "call-site").when(F.col("l_locale").isNotNull(), "default-locale").otherwise("unknown"))
    # a project names few parents: their chains are worked out beforehand
    chains = {k.lower(): chain_of(k, settings.inheritance) for k in settings.inheritance}
    known = F.create_map(*[x for k, v in chains.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))]) if chains else None
    above = F.coalesce(known[F.lower("l_locale")], F.array().cast("array<string>")) if known is not None else F.array().cast("array<string>")
    chain = F.when(F.col("l_locale").isNotNull() & F.lit(bool(chains)), F.concat(F.array("l_locale"), above))
    fallback = _literal(settings.fallback_locales) if settings.fallback_locales else F.when(F.size(above) > 0, above)
    sure = F.when(token.isNotNull(), _capped(given, LOCALE_CAPS["call-site"])).when(F.col("l_locale").isNotNull(), _capped(given, cap)).otherwise(1.0)
    low = F.lower("l_locale")
    near = [F.lit(s.lower()) for s in settings.supported]
    supported = F.coalesce(*[F.when((low == s) | F.startswith(low, F.concat(s, F.lit("-"))) | F.startswith(s, F.concat(low, F.lit("-"))), F.lit(True)) for s in near], F.lit(False)) if near else F.lit(True)
    sure = F.when(F.col("l_locale").isNotNull() & ~supported, F.least(sure, F.lit(LOCALE_CAPS["unsupported"]))).otherwise(sure)
    return out.withColumns({"l_chain": chain, "l_fallback": fallback, "l_confidence": sure})


def inheritance_chains(parents: DataFrame, most: int = INHERITED) -> DataFrame:
    """(child, chain): for a table of any size (child, parent), what each child inherits from, at most ``most`` steps, without cycles."""
    held = cut(parents.select(F.col("child").alias("_at"), F.col("parent").alias("_next")))
    walk = held.select(F.col("_at").alias("child"), F.array("_at").alias("chain"), F.col("_at").alias("at"))
    done = None
    for _ in range(most):
        step = walk.join(held, F.col("at") == F.col("_at"), "left")
        on = F.col("_next").isNotNull() & ~F.array_contains("chain", F.col("_next"))
        ended = step.where(~F.coalesce(on, F.lit(False))).select("child", "chain")
        done = ended if done is None else done.union(ended)
        walk = cut(step.where(on).select("child", F.concat("chain", F.array("_next")).alias("chain"), F.col("_next").alias("at")))
        if walk.isEmpty():
            return done
    return done.union(walk.select("child", "chain"))
