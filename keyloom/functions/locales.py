"""Locales and namespaces in tokens and paths, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: tokens that are locales whatever else they mean
WELL_KNOWN = (
    "en", "en-us", "en-gb", "en-au", "en-ca", "fr", "fr-fr", "fr-ca", "de", "de-de", "de-at", "de-ch", "es", "es-es", "es-mx", "it", "it-it", "pt", "pt-br", "pt-pt", "nl", "nl-nl", "pl", "pl-pl",
    "ru", "ru-ru", "ja", "ja-jp", "ko", "ko-kr", "zh", "zh-cn", "zh-tw", "zh-hans", "zh-hant", "ar", "ar-sa", "tr", "tr-tr", "sv", "sv-se", "da", "da-dk", "fi", "fi-fi", "no", "nb", "nn",
    "cs", "sk", "hu", "ro", "uk", "he", "hi", "th", "vi", "id", "ms", "fa", "el", "bg", "hr", "sr", "sl", "lt", "lv", "et", "ca", "eu", "gl",
)
# fixed values: tokens of locale shape that are never locales
BANNED = (
    "src", "app", "lib", "libs", "bin", "dev", "tmp", "var", "opt", "api", "web", "ios", "css", "jsx", "tsx", "vue", "new", "old", "max", "min", "map", "set", "get", "put", "all", "any",
    "not", "and", "for", "key", "val", "obj", "doc", "cfg", "env", "out", "dist", "build", "test", "tests", "spec", "main", "page", "pages", "node", "next", "nuxt", "vite", "public",
    "assets", "static", "shared", "common", "components", "hooks", "utils", "helpers", "types", "models", "stores", "pkg", "mod", "dir", "id", "in", "is", "as", "at", "be", "by", "do",
    "go", "if", "me", "my", "of", "ok", "on", "or", "so", "to", "up", "us", "we",
)
# fixed values: the shape of a locale, folders of locales, file name extensions and stems that are no namespace
SHAPE = r"^(?:[a-z]{2,3})(?:[_-](?:[A-Z]{2}|\d{3}|[A-Z][a-z]{3}|[a-z]{2}))?(?:[_-](?:[A-Za-z0-9]+))?$"
FOLDERS = r"(?i)(^|/)(locales?|i18n|langs?|languages|messages|translations)(/|$)"
EXTENSION = r"(?i)\.(json|ya?ml|jsx?|tsx?|mjs|cjs|mts|cts)$"
IGNORED_STEMS = ("index", "messages", "locales", "locale", "i18n", "lang", "langs", "languages")


def normalize_locale(token: Column) -> Column:
    return F.regexp_replace(token, "_", "-")


def looks_like_locale(token: Column, loose: Column | bool) -> Column:
    """Well known, or in loose mode of a locale's shape with a region or script, and not a common word."""
    norm = normalize_locale(token)
    low = F.lower(norm)
    shaped = norm.rlike(SHAPE) & (norm.contains("-") | (F.length(low) > 3))
    loose = F.lit(loose) if isinstance(loose, bool) else loose
    known = low.isin(*WELL_KNOWN)
    return (token != "") & (F.length(token) <= 20) & (known | (~low.isin(*BANNED) & loose & shaped))


def _posix(path: Column) -> Column:
    return F.regexp_replace(path, r"\\", "/")


def infer_locale(path: Column) -> Column:
    """The locale of a path: its stem, a dotted part of it from the right, or a folder from the right."""
    path = _posix(path)
    parts = F.split(path, "/")
    stem = F.regexp_replace(F.element_at(parts, -1), EXTENSION, "")
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    tokens = F.concat(F.array(stem), F.reverse(F.split(stem, "\\.")), F.reverse(folders))
    loose = path.rlike(FOLDERS)
    return normalize_locale(F.get(F.filter(tokens, lambda t: looks_like_locale(t, loose)), F.lit(0)))


def infer_namespace(path: Column) -> Column:
    """The namespace of a path: before a locale in the stem, the stem, or the folder of a locale's file."""
    parts = F.split(_posix(path), "/")
    stem = F.regexp_replace(F.element_at(parts, -1), EXTENSION, "")
    dotted = F.filter(F.split(stem, "\\."), lambda x: x != "")
    head, tail = F.get(dotted, F.lit(0)), F.try_element_at(dotted, F.lit(-1))
    ignored = lambda x: F.lower(x).isin(*IGNORED_STEMS)
    parent = F.when(F.size(parts) >= 2, F.get(parts, F.size(parts) - 2))
    is_locale = looks_like_locale(stem, True)
    return (
        F.when((F.size(dotted) >= 2) & looks_like_locale(tail, True) & ~looks_like_locale(head, True) & ~ignored(head), head)
        .when((stem != "") & ~is_locale & ~ignored(stem), stem)
        .when((F.coalesce(parent, F.lit("")) != "") & ~looks_like_locale(parent, True) & ~ignored(parent) & is_locale, parent)
    )


def looks_like_locale_map(keys: Column) -> Column:
    """Whether keys of an object are mostly locales, one of them well known or two of them shaped."""
    like = F.filter(keys, lambda k: looks_like_locale(k, True))
    known = F.filter(like, lambda k: F.lower(normalize_locale(k)).isin(*WELL_KNOWN))
    return (F.size(keys) > 0) & (F.size(like) / F.size(keys) >= 0.6) & ((F.size(known) >= 1) | (F.size(like) >= 2))


def looks_like_namespace(key: Column) -> Column:
    """An identifier, perhaps with hyphens, that is no locale."""
    return (key != "") & ~looks_like_locale(key, True) & key.rlike(r"^[A-Za-z][A-Za-z0-9_-]*$")
