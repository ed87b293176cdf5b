"""Settings in configuration files, read from their text and never executed."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import settings as merging
from ..operators.resolve import Settings
from . import catalog
from .analysis import Script, plain, string_of
from .syntax import Node

# fixed values: priorities of libraries, and confidences of the places that settings come from
PRIORITY = {"next-intl": 6, "next-i18next": 5, "react-i18next": 4, "i18next": 3, "nuxt-i18n": 3, "vue-i18n": 2, "unknown": 0}
SURE = {"i18next": 0.9, "next-i18next": 0.92, "next-intl": 0.9, "next-config": 0.88, "vue-i18n": 0.9, "nuxt-i18n": 0.88}
HELPERS = ("defineRouting", "createMiddleware", "createNavigation", "getRequestConfig")
#: Names of the audit's own configuration files, and its key in package.json.
OWN = r"(^|/)keyloom\.config\.(ts|js|mjs|cjs|json)$"
KEY = "keyloom"
LISTS = ("ignoreKeys", "ignoreFiles", "ignoreLocales", "ignoreNamespaces", "include", "exclude")
_SCHEMA = "rel_path string, library string, field string, values array<string>, confidence double"


def static_value(script: Script, node: Node | None, depth: int = 0):
    """A literal as a value; what isn't one is left out."""
    node = plain(node)
    if node is None or depth > 20:
        return None
    if (text := string_of(node)) is not None:
        return text
    if node.kind == "Number":
        return float(node.value) if "." in node.value else int(node.value, 0)
    if node.kind == "Ident" and node.name in ("true", "false"):
        return node.name == "true"
    if node.kind == "Ident":
        d = script.declared(node.name, node.start)
        return static_value(script, d.init, depth + 1) if d is not None else None
    if node.kind == "Array":
        return [v for i in node.items if (v := static_value(script, i, depth + 1)) is not None]
    if node.kind == "Object":
        out = {}
        for p in node.props:
            if p.kind == "Property" and (k := script._key(p, 0)) is not None and (v := static_value(script, p.value, depth + 1)) is not None:
                out[k] = v
            elif p.kind == "Spread" and isinstance(v := static_value(script, p.value, depth + 1), dict):
                out.update(v)
        return out
    if node.kind == "Function":  # () => ({...})
        from .analysis import returns

        return next((v for x in returns(node) if isinstance(v := static_value(script, x, depth + 1), dict)), None)
    return None


def exported(script: Script) -> Iterator[dict]:
    """Objects of default exports and module.exports, bare or given to a function."""
    for node in script.nodes:
        value = node.default if node.kind == "Export" else node.value if node.kind == "Assign" and node.target.kind == "Member" and node.target.name == "exports" else None
        value = plain(value)
        while value is not None and value.kind == "Call" and value.args:
            value = plain(value.args[0])
        got = static_value(script, value) if value is not None else None
        if isinstance(got, dict):
            yield got


def _token(x: str) -> str:
    return x.strip().replace("_", "-").lower()


def _tokens(x) -> list[str]:
    return [_token(v) for v in ([x] if isinstance(x, str) else x if isinstance(x, list) else []) if isinstance(v, str)]


def _texts(x) -> list[str]:
    return [v for v in ([x] if isinstance(x, str) else x if isinstance(x, list) else []) if isinstance(v, str)]


def _fields(o: dict) -> dict[str, list[str]]:
    """Settings of options as i18next takes them."""
    out = {"defaultNS": _texts(o.get("defaultNS")), "fallbackNS": _texts(o.get("fallbackNS")), "namespaces": _texts(o.get("ns")), "defaultLocale": _tokens(o.get("lng")), "supportedLocales": _tokens(o.get("supportedLngs"))}
    fallback = o.get("fallbackLng")
    out["fallbackLocales"] = _tokens(fallback.get("default") if isinstance(fallback, dict) else fallback)
    if isinstance(fallback, dict):
        out["localeInheritance"] = [f"{_token(k)}={_token(v if isinstance(v, str) else v[0])}" for k, v in fallback.items() if k != "default" and v and (isinstance(v, str) or isinstance(v[0], str))]
    for name in ("keySeparator", "nsSeparator"):
        if name in o:
            out[name] = [o[name]] if isinstance(o[name], str) else [""] if o[name] is False else []
    return out


def _routing(o: dict) -> dict[str, list[str]]:
    locales = o.get("locales")
    codes = [x.get("code") if isinstance(x, dict) else x for x in locales] if isinstance(locales, list) else []
    return {"defaultLocale": _tokens(o.get("defaultLocale")), "supportedLocales": _tokens(codes)}


def fragments_of(path: str, text: str) -> Iterator[tuple[str, str, list[str], float]]:
    """(library, field, values, confidence) of the settings that a script sets up a library with."""
    script, base = Script(text), path.rsplit("/", 1)[-1]
    found: list[tuple[str, float, dict[str, list[str]]]] = []
    if base.startswith("next-i18next.config"):
        for o in exported(script):
            inner = o["i18n"] if isinstance(o.get("i18n"), dict) else {}
            fields = _fields(o)
            found.append(("next-i18next", SURE["next-i18next"], {**_routing(inner), **{k: v for k, v in fields.items() if v}}))
    elif base.startswith("next.config"):
        found += [("unknown", SURE["next-config"], _routing(o["i18n"])) for o in exported(script) if isinstance(o.get("i18n"), dict)]
    elif base.startswith("nuxt.config"):
        for o in exported(script):
            inner = o.get("i18n")
            if isinstance(inner, dict):
                found.append(("nuxt-i18n", SURE["nuxt-i18n"], {**_routing(inner), "fallbackLocales": _tokens(inner.get("fallbackLocale"))}))
    for c in script.calls:
        name = c.callee.name if c.callee.kind in ("Ident", "Member") else None
        args = [static_value(script, a) for a in c.args]
        options = next((a for a in args if isinstance(a, dict)), None)
        if options is None:
            continue
        if name in ("init", "createInstance") and (script.uses("i18next") or script.i18n):
            found.append(("react-i18next" if "react-i18next" in script.sources else "i18next", SURE["i18next"], _fields(options)))
        elif name in HELPERS:
            found.append(("next-intl", SURE["next-intl"], _routing(options)))
        elif name == "createI18n":
            fallback, messages = options.get("fallbackLocale"), options.get("messages")
            fields = {"defaultLocale": _tokens(options.get("locale")), "fallbackLocales": _tokens(fallback), "supportedLocales": _tokens(list(messages)) if isinstance(messages, dict) else []}
            if isinstance(fallback, dict):
                fields["localeInheritance"] = [f"{_token(k)}={_token(v)}" for k, v in fallback.items() if k != "default" and isinstance(v, str)]
            found.append(("vue-i18n", SURE["vue-i18n"], fields))
    for library, sure, fields in found:
        for field, values in fields.items():
            if values:
                yield library, field, values, sure


def fragments(files: DataFrame) -> DataFrame:
    """Settings fragments of scripts (rel_path, text)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(p, *f) for p, t in zip(part["rel_path"], part["text"]) if re.search(r"i18n|intl|locale", t or "") for f in fragments_of(p, t)]
            yield pd.DataFrame(rows, columns=["rel_path", "library", "field", "values", "confidence"])

    return files.select("rel_path", "text").mapInPandas(run, _SCHEMA)


def effective(found: DataFrame, preferred: str | None = None) -> DataFrame:
    """(field, values, only_first, only_second): what all fragments say; for settings of one value the first of ``values`` counts."""
    rank = F.coalesce(*[F.when(F.col("library") == k, v) for k, v in PRIORITY.items()], F.lit(0)) + F.when(F.col("library") == (preferred or ""), 10).otherwise(0)
    each = found.select("field", "values", (rank + F.col("confidence")).alias("priority"), F.col("rel_path").alias("ord"))
    return merging.merge_lists(each)


def settings_of(found: DataFrame, preferred: str | None = None) -> Settings:
    """The settings of a project: a few values."""
    held = {r["field"]: r["values"] for r in effective(found, preferred).collect()}
    one = lambda k, default=None: held[k][0] if held.get(k) else default
    return Settings(
        default_ns=one("defaultNS"), fallback_ns=tuple(held.get("fallbackNS", ())), ns_separator=one("nsSeparator", ":"), key_separator=one("keySeparator", "."), default_locale=one("defaultLocale"),
        fallback_locales=tuple(held.get("fallbackLocales", ())), supported=tuple(held.get("supportedLocales", ())), inheritance=dict(x.split("=", 1) for x in held.get("localeInheritance", ())),
    )


def own_options(path: str, text: str) -> dict:
    """The audit's options in a configuration file or package.json; nothing where they can't be read."""
    if path.endswith(".json"):
        try:
            got = json.loads(text)
        except ValueError:
            return {}
        got = got.get(KEY) if path.endswith("package.json") and isinstance(got, dict) else got
        return got if isinstance(got, dict) else {}
    return next(exported(Script(text)), {})


def audit_options(files: DataFrame) -> dict:
    """The options of a project: of its files of configuration the last by name counts for each field, before package.json.

    Only configuration files are read, a handful in any project."""
    rows = files.where(F.col("rel_path").rlike(OWN) | F.col("rel_path").rlike(r"(^|/)package\.json$")).select("rel_path", "text").collect()
    out: dict = {}
    for r in sorted(rows, key=lambda r: (not r["rel_path"].endswith("package.json"), r["rel_path"])):
        for k, v in own_options(r["rel_path"], r["text"] or "").items():
            if k in LISTS and isinstance(v, list):
                out[k] = [x for x in v if isinstance(x, str)]
            elif k == "rules" and isinstance(v, dict):
                out["rules"] = {**out.get("rules", {}), **{name: severity(x) for name, x in v.items() if severity(x)}}
            elif k in ("exitOnError", "failOnWarning") and isinstance(v, bool):
                out[k] = v
            elif k == "minConfidence" and isinstance(v, int | float) and 0 <= v <= 1:
                out[k] = float(v)
    return out


def severity(x) -> str | None:
    """As ``text.coerce_severity``, for one value."""
    low = str(x).lower()
    return {"error": "error", "2": "error", "true": "error", "warn": "warning", "warning": "warning", "1": "warning", "info": "info", "off": "off", "0": "off", "false": "off"}.get(low)


def paths_of(files: DataFrame) -> dict[str, list[str]]:
    """Path patterns of the project's tsconfig.json or jsconfig.json, below its base."""
    r = files.where("rel_path in ('tsconfig.json', 'jsconfig.json')").orderBy(F.desc("rel_path")).select("text").first()
    if r is None:
        return {}
    out: dict[str, list[str]] = {}
    base = ""
    for key, value, *_ in catalog.entries(r["text"] or ""):
        if key == "compilerOptions.baseUrl":
            base = value.strip("./")
        m = re.fullmatch(r"compilerOptions\.paths\.(.+)\[\d+\]", key)
        if m:
            out.setdefault(m[1], []).append(value)
    return {k: [f"{base}/{v.removeprefix('./')}".strip("/") for v in vs] for k, vs in out.items()}
