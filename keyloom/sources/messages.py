"""Catalogs that aren't JSON: YAML, and message objects in scripts with their spreads and registrations."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

from ..functions.locales import BANNED, SHAPE, WELL_KNOWN
from .analysis import Script, plain, returns, string_of
from .syntax import Node

try:
    import yaml
except ImportError:  # without the parser, YAML files hold no catalogs
    yaml = None

MOST_KEYS = 50_000
#: Objects inside objects.
DEEPEST = 40
# fixed values: names of message objects and of functions that give them
NAMES = re.compile(r"(?i)^(messages?|translations?|locales?|resources|strings|dictionar(y|ies)|i18n|lang|languages?)$")
GIVERS = re.compile(r"^(getMessages|getTranslations|loadMessages|messages)$")


class Entry(NamedTuple):
    """A leaf, or with ``source`` a spread of what an import holds."""

    key: str
    value: str
    kind: str
    start: int
    end: int
    locale: str | None = None
    namespace: str | None = None
    source: str | None = None
    name: str | None = None


def like_locale(token: str) -> bool:
    """As ``locales.looks_like_locale`` in loose mode, for one token."""
    norm = token.replace("_", "-")
    low = norm.lower()
    if not token or len(token) > 20:
        return False
    return low in WELL_KNOWN or (low not in BANNED and bool(re.match(SHAPE, norm)) and ("-" in norm or len(low) > 3))


def locale_map(keys: list[str]) -> bool:
    like = [k for k in keys if like_locale(k)]
    return bool(keys) and len(like) / len(keys) >= 0.6 and (any(k.replace("_", "-").lower() in WELL_KNOWN for k in like) or len(like) >= 2)


# ---- YAML


def yaml_entries(text: str) -> list[Entry]:
    """The leaves of a YAML file; none if it can't be parsed. Of a key given twice the later value stands."""
    if yaml is None:
        return []
    try:
        root = yaml.compose(text.removeprefix("\ufeff"), Loader=yaml.SafeLoader)
    except yaml.YAMLError:
        return []
    out: dict[str, Entry] = {}

    def go(node, prefix: str, start: int, end: int, depth: int) -> None:
        if node is None or depth > DEEPEST or len(out) >= MOST_KEYS:
            return
        if isinstance(node, yaml.MappingNode):
            for key, value in node.value:
                if isinstance(key, yaml.ScalarNode):
                    go(value, f"{prefix}.{key.value}" if prefix else key.value, key.start_mark.index, key.end_mark.index, depth + 1)
        elif isinstance(node, yaml.SequenceNode):
            for i, value in enumerate(node.value):
                go(value, f"{prefix}[{i}]", value.start_mark.index, value.end_mark.index, depth + 1)
        elif prefix:
            kind = {"int": "number", "float": "number", "bool": "boolean", "null": "null"}.get(node.tag.rsplit(":", 1)[-1], "string")
            value = {"null": "null", "boolean": node.value.lower()}.get(kind, node.value)
            out.pop(prefix, None)
            out[prefix] = Entry(prefix, value, kind, start, end)

    go(root, "", 0, 0, 0)
    return list(out.values())


# ---- scripts


def _leaf(node: Node) -> tuple[str, str] | None:
    node = plain(node)
    if node is None:
        return None
    text = string_of(node)
    if text is not None:
        return text, "string"
    if node.kind == "Number":
        return node.value, "number"
    if node.kind == "Ident" and node.name in ("true", "false"):
        return node.name, "boolean"
    if node.kind == "Ident" and node.name == "null":
        return "null", "null"
    return None


class Messages:
    """The message objects of a script."""

    def __init__(self, script: Script):
        self.script = script
        self._leaves: dict[int, list[Entry]] = {}

    def initial(self, name: str, pos: int) -> Node | None:
        d = self.script.declared(name, pos) or next((d for d in self.script.variables.get(name, []) if d.init is not None), None)
        return plain(d.init) if d is not None else None

    def leaves(self, node: Node) -> list[Entry]:
        """``flat`` of an object by itself, found once: an exported one is asked for by ``entries`` and by ``objects``."""
        found = self._leaves.get(id(node))
        if found is None:
            found = self._leaves[id(node)] = list(self.flat(node))
        return found

    def flat(self, node: Node, prefix: str = "", depth: int = 0, locale: str | None = None, namespace: str | None = None) -> Iterator[Entry]:
        """Leaves of an object, spreads of this file in their place; later keys win."""
        node = plain(node)
        if node is None or depth > DEEPEST:
            return
        found: dict[str, Entry] = {}

        def put(e: Entry) -> None:
            found.pop(e.key, None)
            found[e.key if e.source is None else f"{e.key}\0{e.source}\0{e.name}"] = e

        for k, p in enumerate(node.props or node.items or []):
            if p.kind == "Spread":
                for e in self._value(plain(p.value), prefix, depth + 1, p):
                    put(e)
                continue
            if p.kind == "Property":
                key = self.script._key(p, 0)
                if key is None:
                    continue
                path, place, value = f"{prefix}.{key}" if prefix else key, (p.place, p.ended), p.value
            else:
                path, place, value = f"{prefix}[{k}]", (p.start, p.end), p
            for old in [k for k in found if k == path or k.startswith((f"{path}.", f"{path}["))]:
                del found[old]  # a key given again replaces all that the earlier one held
            for e in self._value(plain(value), path, depth + 1, None, place):
                put(e)
        for e in found.values():
            yield e._replace(locale=e.locale or locale, namespace=e.namespace or namespace)

    def _value(self, value: Node | None, path: str, depth: int, spread: Node | None, place: tuple[int, int] | None = None) -> Iterator[Entry]:
        if value is None or depth > DEEPEST:
            return
        leaf = _leaf(value)
        if leaf is not None and spread is None:
            yield Entry(path, *leaf, *place)
        elif value.kind in ("Object", "Array"):
            if place is not None and (message := self._descriptor(value)):
                yield Entry(message[0] or path, message[1], "string", *place)
            else:
                yield from self.flat(value, path, depth + 1)
        elif value.kind == "Ident":
            if value.name in self.script.imports:
                source, name = self.script.imports[value.name]
                yield Entry(path, "", "spread", value.start, value.end, source=source, name=name)
            else:
                init = self.initial(value.name, value.start)
                if init is not None and init.kind in ("Object", "Array"):
                    yield from self.flat(init, path, depth + 1)
                elif init is not None and spread is None and (leaf := _leaf(init)):
                    yield Entry(path, *leaf, *place)

    def _descriptor(self, node: Node) -> tuple[str | None, str] | None:
        """(id, message) of a message descriptor."""
        props = {p.key: p.value for p in node.props or [] if p.kind == "Property" and p.key}
        message = string_of(props.get("defaultMessage") or props.get("default"))
        if message is None or len(props) != len(node.props or []) or not set(props) <= {"id", "defaultMessage", "default", "description"}:
            return None
        return string_of(props.get("id")), message

    def targets(self) -> Iterator[tuple[Node, str]]:
        """(object, how it was found): default exports, named objects, options of a library, descriptors, and what functions give."""
        seen: set[int] = set()

        def once(node: Node | None, how: str) -> Iterator[tuple[Node, str]]:
            node = plain(node)
            if node is not None and node.kind == "Call" and node.args:
                node = plain(node.args[0])  # defineMessages({...}), Object.freeze({...})
            if node is not None and node.kind == "Ident":
                node = self.initial(node.name, node.start)
            if node is not None and node.kind == "Object" and id(node) not in seen:
                seen.add(id(node))
                yield node, how

        for node in self.script.nodes:
            if node.kind == "Export" and node.default is not None:
                yield from once(node.default, "default")
            elif node.kind == "Assign" and node.target.kind == "Member" and node.target.name == "exports":
                yield from once(node.value, "default")
            elif node.kind == "Declarator" and node.target.kind == "Ident" and node.init is not None and node.parent.parent.kind in ("Program", "Export"):
                if NAMES.match(node.target.name) or like_locale(node.target.name):
                    yield from once(node.init, "named")
            elif node.kind == "Call" and node.args:
                name = node.callee.name if node.callee.kind in ("Ident", "Member") else None
                if name in ("defineMessages", "defineI18nLocale", "defineI18nConfig"):
                    yield from once(node.args[0], "descriptors")
                if name in ("createI18n", "useI18n", "init", "createInstance"):
                    options = plain(node.args[0])
                    for p in options.props if options.kind == "Object" else []:
                        if p.kind == "Property" and p.key in ("messages", "resources"):
                            yield from once(p.value, p.key)
            elif node.kind == "Function" and node.name and GIVERS.match(node.name):
                for value in returns(node):
                    yield from once(value, "given")

    def entries(self) -> list[Entry]:
        """All leaves, each once; locale maps are taken apart, and the maps of namespaces in them."""
        out: dict[tuple, Entry] = {}
        for node, how in self.targets():
            for e in self._expanded(node, how):
                out.setdefault((e.key, e.start, e.locale, e.namespace, e.source, e.name), e)
                if len(out) >= MOST_KEYS:
                    break
        return list(out.values())

    def _expanded(self, node: Node, how: str) -> Iterator[Entry]:
        props = [(k, p) for p in node.props if p.kind == "Property" and (k := self.script._key(p, 0)) is not None]
        if how in ("default", "named", "messages", "resources") and locale_map([k for k, _ in props]):
            for locale, p in props:
                inner = self._object(p.value)
                if inner is None:
                    yield from (e._replace(locale=locale) for e in self._value(plain(p.value), "", 0, p, (p.place, p.ended)))
                    continue
                below = [(k, q) for q in inner.props if q.kind == "Property" and (k := self.script._key(q, 0)) is not None]
                spread = any(q.kind == "Spread" for q in inner.props)
                if how == "resources" and below and not spread and all(self._object(q.value) is not None or self._imported(q.value) for _, q in below):
                    for namespace, q in below:
                        yield from (e._replace(locale=locale, namespace=namespace) for e in self._value(plain(q.value), "", 0, q, (q.place, q.ended)))
                else:
                    yield from self.flat(inner, locale=locale)
            return
        yield from self.leaves(node)

    def _object(self, value: Node) -> Node | None:
        value = plain(value)
        if value is not None and value.kind == "Ident" and value.name not in self.script.imports:
            value = self.initial(value.name, value.start)
        return value if value is not None and value.kind in ("Object", "Array") else None

    def _imported(self, value: Node) -> bool:
        value = plain(value)
        return value is not None and value.kind == "Ident" and value.name in self.script.imports

    def objects(self) -> Iterator[tuple[str, Entry]]:
        """(exported name, leaf) of the objects that a file exports: what spreads and registrations elsewhere mean."""
        for name, kind, source, local in self.script.exports():
            if source is not None or kind == "star":
                continue
            node = self.initial(local, self.script.root.end) if local else None
            if node is None and kind == "default":
                node = next((plain(n.default) for n in self.script.root.body if n.kind == "Export" and n.default is not None), None)
            if node is not None and node.kind == "Call" and node.args:
                node = plain(node.args[0])
            if node is not None and node.kind == "Object":
                for e in self.leaves(node):
                    yield name, e

    def registrations(self) -> list[tuple[str | None, str, str, str]]:
        """(locale, namespace, source, name): imported resources that code registers; inline ones are among the entries."""
        out = []
        for c in self.script.calls:
            name = c.callee.name if c.callee.kind == "Member" else None
            if name in ("addResourceBundle", "addResources") and len(c.args) >= 3:
                locale, namespace = (self.script.keys(a)[0] for a in c.args[:2])
                value = plain(c.args[2])
                if namespace and value.kind == "Ident" and value.name in self.script.imports:
                    out.append((locale[0] if len(locale) == 1 else None, namespace[0], *self.script.imports[value.name]))
            elif name in ("init", "createInstance") and c.args:
                options = plain(c.args[0])
                for p in options.props if options.kind == "Object" else []:
                    resources = self._object(p.value) if p.kind == "Property" and p.key == "resources" else None
                    for q in resources.props if resources is not None else []:
                        inner = self._object(q.value) if q.kind == "Property" else None
                        for r in inner.props if inner is not None else []:
                            value = plain(r.value) if r.kind == "Property" else None
                            if value is not None and value.kind == "Ident" and value.name in self.script.imports and r.key:
                                out.append((self.script._key(q, 0), r.key, *self.script.imports[value.name]))
        return list(dict.fromkeys(out))

    def inline_registrations(self) -> list[Entry]:
        """Entries of addResource and addResourceBundle with texts in the call."""
        out = []
        for c in self.script.calls:
            name = c.callee.name if c.callee.kind == "Member" else None
            if name not in ("addResource", "addResourceBundle", "addResources") or len(c.args) < 3:
                continue
            locale, namespace = (self.script.keys(a)[0] for a in c.args[:2])
            if len(namespace) != 1:
                continue
            where = locale[0] if len(locale) == 1 else None
            if name == "addResource" and len(c.args) >= 4:
                key, leaf = string_of(c.args[2]), _leaf(c.args[3])
                if key and leaf:
                    out.append(Entry(key, *leaf, c.args[2].start, c.args[2].end, where, namespace[0]))
            elif (node := self._object(c.args[2])) is not None:
                out += self.flat(node, locale=where, namespace=namespace[0])
        return out
