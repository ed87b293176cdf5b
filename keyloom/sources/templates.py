"""Usages in markup templates: Vue and Nuxt, Svelte, Astro and Angular.

What isn't looked at is blanked at equal length, so places stay those of the file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

_KEY = r"""(?:"((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'|`((?:[^`\\$]|\\.|\$(?!\{))*)`)"""
_BEFORE = r"(?<![\w$.])"


def _call(names: str) -> str:
    return rf"{_BEFORE}(?:{names})\s*\(\s*{_KEY}\s*[,)]"


# fixed values: call and attribute shapes by framework, with their confidences
SHAPES: dict[str, list[tuple[str, float, str]]] = {
    "vue": [
        (_call(r"\$t|\$tc|\$te"), 0.85, "function-call"), (_call(r"i18n\.t|i18n\.global\.t"), 0.8, "member-call"), (_call("t|tc|te"), 0.75, "function-call"),
        (r"""\bv-t\s*=\s*["']\s*'([^']*)'\s*["']""", 0.8, "directive"), (r"""\bv-t\s*=\s*["']\s*\{[^}]*?\bpath\s*:\s*'([^']*)'""", 0.8, "directive"), (r"""<i18n(?:-t)?\b[^>]*?\b(?:keypath|path)\s*=\s*"([^"]*)\"""", 0.8, "jsx-attribute"),
    ],
    "nuxt": [(_call(r"\$tm|\$rt"), 0.8, "function-call"), (_call(r"\$td"), 0.75, "function-call")],
    "angular": [
        (rf"{_KEY}\s*\|\s*(?:translate|transloco)\b", 0.85, "pipe"), (r"""(?<![\w-])\[translate\]\s*=\s*"\s*'([^']*)'\s*\"""", 0.82, "directive"), (r"""(?<![\w\[(-])(?:translate|transloco)\s*=\s*"([^"{]+)\"""", 0.8, "directive"),
        (r"""\*transloco\s*=\s*"[^"]*\bread\s*:\s*'([^']*)'""", 0.5, "directive"),
    ],
    "svelte": [(_call(r"\$t|\$_|\$format"), 0.86, "function-call"), (_call("t"), 0.75, "function-call")],
    "astro": [(_call(r"i18next\.t"), 0.86, "member-call"), (_call(r"\$t"), 0.8, "function-call"), (_call("t"), 0.75, "function-call")],
}
LIBRARIES = {"vue": "vue-i18n", "nuxt": "vue-i18n", "angular": "ngx-translate", "svelte": "svelte-i18n", "astro": "i18next"}


def blank(text: str, pattern: str) -> str:
    """Matches as spaces; line ends stay."""
    return re.sub(pattern, lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S | re.I)


def without_comments(text: str) -> str:
    return blank(text, r"<!--.*?(?:-->|\Z)")


def without_bodies(text: str, *tags: str) -> str:
    """The text between tags, blanked; the tags stay."""
    for tag in tags:
        text = re.sub(rf"(<{tag}\b[^>]*>)(.*?)(</{tag}\s*>|\Z)", lambda m: m[1] + re.sub(r"[^\n]", " ", m[2]) + m[3], text, flags=re.S | re.I)
    return text


def regions(text: str, tag: str) -> list[tuple[int, int]]:
    """(start, end) of the bodies of top-level tags; of nested ones of the same name the outermost."""
    out, depth, begun = [], 0, 0
    for m in re.finditer(rf"<(/?){tag}\b[^>]*?(/?)>", text, re.I):
        if m[1]:
            depth -= 1
            if depth == 0:
                out.append((begun, m.start()))
            depth = max(depth, 0)
        elif not m[2]:
            if depth == 0:
                begun = m.end()
            depth += 1
    if depth > 0:
        out.append((begun, len(text)))
    return out


def only(text: str, spans: list[tuple[int, int]]) -> str:
    """The spans at their places, the rest blanked."""
    out, at = [], 0
    for a, b in spans:
        out += [re.sub(r"[^\n]", " ", text[at:a]), text[a:b]]
        at = b
    return "".join([*out, re.sub(r"[^\n]", " ", text[at:])])


def scripts(text: str, language: str) -> str:
    """The script of a file, at its places."""
    if language in ("vue", "svelte", "html"):
        return only(text, regions(text, "script"))
    if language == "astro":
        m = re.match(r"\s*---\n(.*?)\n---", text, re.S)
        return only(text, [m.span(1)] if m else [])
    return text


def markup(text: str, language: str) -> str:
    """The markup of a file, at its places: without scripts, styles and comments."""
    text = without_bodies(without_comments(text), "style")
    if language == "vue":
        return only(text, regions(text, "template"))
    return without_bodies(text, "script")


def scan(text: str, language: str, nuxt: bool = False) -> Iterator[tuple[str, str, float, int, int, str]]:
    """(key, library, confidence, start, end, context) of the usages in a template; of equal places the surest shape counts."""
    kind = "angular" if language == "html" else language
    if kind not in SHAPES:
        return
    body = markup(text, language)
    shapes = SHAPES[kind] + (SHAPES["nuxt"] if nuxt and kind == "vue" else [])
    found: dict[tuple[int, int], tuple[str, str, float, int, int, str]] = {}
    for pattern, sure, context in shapes:
        for m in re.finditer(pattern, body):
            k = next((k for k in range(1, (m.lastindex or 0) + 1) if m[k] is not None), None)
            if k is None or not m[k]:
                continue
            place = m.span(k)
            if place not in found or found[place][2] < sure:
                found[place] = (re.sub(r"\\(.)", r"\1", m[k]), LIBRARIES[kind], sure, *place, context)
    yield from (found[p] for p in sorted(found))
