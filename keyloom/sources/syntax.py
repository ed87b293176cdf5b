"""A tolerant parser of JavaScript, TypeScript and JSX.

It gives a tree of what the scanners need: strings, templates, calls, members, objects, functions, declarations,
imports, exports, enums and markup. Types are kept as text. What it can't read is skipped up to the next
statement, so a file always gives a tree.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from operator import attrgetter

_SPACE = re.compile(r"(?:\s|\ufeff|//[^\n]*|/\*.*?(?:\*/|\Z)|<!--.*?(?:-->|\Z))*", re.S)
#: Characters that neither are space nor begin a comment.
_SOLID = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_$\"'`{}()[];,>+-*%&|^!~?:=.@#")
_NAME = re.compile(r"[#@]?[A-Za-z_$\u00aa-\uffff][\w$\u00aa-\uffff]*")
_NUMBER = re.compile(r"0[xXoObB][\da-fA-F_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?")
_STRING = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'", re.S)
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_PUNCTUATION = re.compile(
    r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.@#`]"
)
#: A word as ``Parser.peek`` tells it, numbers as group 1; what else there is needs ``Parser._word``.
_WORD = re.compile(rf"[\"']|{_NAME.pattern}|(\.?[0-9])|(?!\.[^\x00-\x7f])(?:{_PUNCTUATION.pattern})")
_ARROW = re.compile(r"\s*=>")
_BINARY = {
    "??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8, ">=": 8, "instanceof": 8, "in": 8,
    "<<": 9, ">>": 9, ">>>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12,
}
_ASSIGN = {"=", "+=", "-=", "*=", "/=", "%=", "**=", "<<=", ">>=", ">>>=", "&=", "|=", "^=", "&&=", "||=", "??="}
_ESCAPES = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f", "v": "\v", "0": "\0", "\n": ""}
_MODIFIERS = {"public", "private", "protected", "readonly", "static", "abstract", "override", "declare", "async", "get", "set", "accessor"}


#: Words behind a whole expression, and names that begin another rule than an identifier's.
_ENDS = frozenset((",", ")", "]", "}", ";", ""))
_RESERVED = frozenset(("function", "class", "async", "new", "import", "typeof", "void", "delete", "await", "yield"))


def unescape(raw: str) -> str:
    if "\\" not in raw:
        return raw

    def one(m: re.Match) -> str:
        x = m[1]
        if x[0] == "u":
            return chr(int(x[2:-1] if x[1] == "{" else x[1:], 16))
        if x[0] == "x" and len(x) == 3:
            return chr(int(x[1:], 16))
        return _ESCAPES.get(x, x)

    return re.sub(r"\\(u\{[0-9a-fA-F]{1,6}\}|u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|.)", one, raw, flags=re.S)


_START = attrgetter("start")


class Node:
    """A piece of the tree; attributes that a kind hasn't got are None."""

    # what most kinds are asked for: found in the class, where __getattr__ would take far longer
    _children = _below = alias = args = arrow = attributes = body = callee = computed = content = default = found = holes = index = init = inner = items = key = left = members = method = name = names = None
    object = op = over = params = parts = props = quasi = returns = right = source = star = tag = target = test = text = type = value = word = None

    def __init__(self, kind: str, start: int, end: int, **parts):
        self.kind, self.start, self.end, self.parent = kind, start, end, None
        self.__dict__.update(parts)

    def __getattr__(self, name: str):
        if name.startswith("__"):
            raise AttributeError(name)
        return None

    def children(self) -> Iterable[Node]:
        return self._parts() if self._children is None else self._children

    def _parts(self) -> list[Node]:
        out = []
        for name, value in self.__dict__.items():
            kind = type(value)
            if kind is Node:
                if name != "parent":
                    out.append(value)
            elif kind is list:
                out += [x for x in value if type(x) is Node]
        return out

    def seal(self) -> None:
        """Tell all nodes below their parents, and keep each one's parts, also in the order that ``walk`` takes them from a stack: a
        finished tree isn't changed any more."""
        stack = [self]
        while stack:
            node = stack.pop()
            parts = node._parts()
            node._children = tuple(parts)  # no list: not taken for a part
            node._below = tuple(sorted(parts, key=_START, reverse=True)) if len(parts) > 1 else node._children
            for child in parts:
                child.parent = node
            stack += parts

    def walk(self) -> Iterator[Node]:
        """The node and all below it, in the order of the text."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            below = node._below
            stack += sorted(node._parts(), key=_START, reverse=True) if below is None else below

    def above(self) -> Iterator[Node]:
        node = self.parent
        while node is not None:
            yield node
            node = node.parent


class Unexpected(Exception):
    pass


class Parser:
    def __init__(self, text: str):
        self.text, self.at, self.n = text, 0, len(text)
        self.depth = 0
        self.words: dict[int, tuple[int, str]] = {}

    # ---- words

    def space(self) -> None:
        if self.text[self.at : self.at + 1] in _SOLID:
            return
        self.at = _SPACE.match(self.text, self.at).end()

    def peek(self) -> str:
        """The next word or mark; "" at the end, and a quote for a string. Rules ask for it many times: it is read once for a place."""
        self.at, word = self.words.get(self.at) or self._read()
        return word

    def _read(self) -> tuple[int, str]:
        """The place and the text of the next word, which are remembered."""
        since = at = self.at
        if self.text[at : at + 1] not in _SOLID:
            at = self.at = _SPACE.match(self.text, at).end()
        m = _WORD.match(self.text, at)
        known = self.words[since] = self.words[at] = (at, self._word() if m is None else m[0] if m.lastindex is None else "0")
        return known

    def _word(self) -> str:
        if self.at >= self.n:
            return ""
        c = self.text[self.at]
        if c in "\"'":
            return c
        if m := _NAME.match(self.text, self.at):
            return m[0]
        if c.isdigit() or (c == "." and self.text[self.at + 1 : self.at + 2].isdigit()):
            return "0"
        m = _PUNCTUATION.match(self.text, self.at)
        return m[0] if m else c

    def ahead(self, text: str) -> bool:
        self.at, word = self.words.get(self.at) or self._read()
        return word == text

    def take(self, text: str) -> bool:
        self.at, word = self.words.get(self.at) or self._read()
        if word != text:
            return False
        self.at += len(text)
        return True

    def expect(self, text: str) -> None:
        if not self.take(text):
            raise Unexpected(f"{text} expected at {self.at}")

    def name(self) -> str:
        self.space()
        m = _NAME.match(self.text, self.at)
        if not m:
            raise Unexpected(f"name expected at {self.at}")
        self.at = m.end()
        return m[0]

    def broken_line(self, since: int) -> bool:
        return "\n" in self.text[since : self.at]

    def trial(self, rule):
        """What a rule gives, or None where it doesn't fit: then nothing has been read."""
        at = self.at
        try:
            return rule()
        except Unexpected:
            self.at = at
            return None

    # ---- types, as text

    def skip_type(self, arrow_ends: bool = False) -> str:
        self.space()
        start, depth, operand = self.at, [], False
        while True:
            before = self.at
            word = self.peek()
            if not word:
                break
            if not depth:
                if word in (",", ")", "]", "}", "=", ";") or (word == "=>" and (arrow_ends or not operand)) or (word == "{" and operand):
                    break
                if word == ">" or (operand and self.broken_line(before) and word not in ("|", "&", ".", "[", "<", "extends", "?", ":", "=>", "is")):
                    break
                if operand and word == ":" and "?" not in self.text[start : self.at]:
                    break
            if word in ("(", "[", "{", "<"):
                depth.append({"(": ")", "[": "]", "{": "}", "<": ">"}[word])
                self.at += 1
                operand = False
                continue
            if word in (")", "]", "}") or (word[0] == ">" and depth and depth[-1] == ">"):
                if not depth:
                    break
                depth.pop()
                self.at += 1
                operand = True
                continue
            if word in ("'", '"'):
                m = _STRING.match(self.text, self.at)
                if not m:
                    raise Unexpected("string")
                self.at = m.end()
                operand = True
                continue
            if word == "`":
                self.template()
                operand = True
                continue
            if word == "0":
                self.at = _NUMBER.match(self.text, self.at).end()
                operand = True
                continue
            if operand and not depth and _NAME.match(word) and word not in ("extends", "is", "in", "keyof", "infer", "asserts", "typeof", "readonly", "unique") and before == start:
                break
            self.at += len(word)
            operand = bool(_NAME.match(word)) and word not in ("extends", "keyof", "typeof", "readonly", "infer", "is", "new", "unique", "asserts")
        if self.at == start:
            raise Unexpected("type")
        return self.text[start : self.at].strip()

    def type_arguments(self) -> str | None:
        """``<...>`` before a call; nothing is read if it is a comparison."""
        if not self.ahead("<"):
            return None
        at = self.at
        try:
            self.at += 1
            self.space()
            start = self.at
            if not self.ahead(">"):
                while True:
                    self.skip_type()
                    if not self.take(","):
                        break
            end = self.at
            self.space()
            if self.text[self.at : self.at + 1] != ">":
                raise Unexpected(">")
            self.at += 1
            if self.peek() not in ("(", "`"):
                raise Unexpected("(")
            return self.text[start:end].strip()
        except Unexpected:
            self.at = at
            return None

    def type_parameters(self) -> None:
        if self.ahead("<"):
            depth = 0
            while self.at < self.n:
                word = self.peek()
                if word == "<":
                    depth += 1
                    self.at += 1
                elif word[:1] == ">":
                    depth -= 1
                    self.at += 1
                    if not depth:
                        return
                elif word in ("'", '"'):
                    m = _STRING.match(self.text, self.at)
                    self.at = m.end() if m else self.at + 1
                elif word == "=>":
                    self.at += 2
                elif word in (";", ""):
                    raise Unexpected("type parameters")
                else:
                    self.at += len(word)

    # ---- statements

    def program(self) -> Node:
        root = Node("Program", 0, self.n, body=self.statements(""))
        root.seal()
        return root

    def statements(self, until: str) -> list[Node]:
        out: list[Node] = []
        while True:
            word = self.peek()
            if not word or (until and word == until):
                return out
            at = self.at
            try:
                if (node := self.statement()) is not None:
                    out.append(node)
            except (Unexpected, RecursionError):
                self.at = max(self.at, at)
                self.resume(at)
            if self.at <= at:
                self.at = at + 1

    def resume(self, since: int) -> None:
        """Go on behind the line in which reading failed."""
        at = self.text.find("\n", max(since, self.at))
        self.at = self.n if at < 0 else at + 1

    def block(self) -> Node:
        self.space()
        start = self.at
        self.expect("{")
        body = self.statements("}")
        self.take("}")
        return Node("Block", start, self.at, body=body)

    def statement(self) -> Node | None:
        self.space()
        start, word = self.at, self.peek()
        if word == ";":
            self.at += 1
            return None
        if word == "{":
            return self.block()
        rule = getattr(self, f"_{word}", None) if word.isalpha() and word in _STATEMENTS else None
        if rule is not None:
            found = self.trial(lambda: rule(start))
            if found is not None:
                return found
        if word[:1] == "@" and len(word) > 1:
            self.at += len(word)
            if self.ahead("("):
                self.arguments()
            return self.statement()
        value = self.expression()
        if value.kind == "Ident" and self.take(":"):
            return self.statement()  # a label
        self.take(";")
        return Node("Expression", start, self.at, value=value)

    def _declaration(self, start: int, word: str) -> Node:
        self.at += len(word)
        if self.peek() in (".", "(", "=", ",", ";", ":", ")"):
            raise Unexpected("a name as a variable")
        if word == "const" and self.ahead("enum"):
            return self._enum(start)
        found = [self.declarator()]
        while self.take(","):
            found.append(self.declarator())
        self.take(";")
        return Node("Var", start, self.at, word=word, found=found)

    def declarator(self) -> Node:
        self.space()
        start = self.at
        target = self.binding()
        self.take("!")
        kind = self.skip_type() if self.take(":") else None
        init = self.assignment() if self.take("=") else None
        return Node("Declarator", start, self.at, target=target, type=kind, init=init)

    def _const(self, start: int) -> Node:
        return self._declaration(start, "const")

    def _let(self, start: int) -> Node:
        return self._declaration(start, "let")

    def _var(self, start: int) -> Node:
        return self._declaration(start, "var")

    def _async(self, start: int) -> Node:
        self.expect("async")
        if not self.ahead("function"):
            raise Unexpected("function")
        return self._function(start)

    def _function(self, start: int) -> Node:
        self.expect("function")
        self.take("*")
        name = None if self.ahead("(") or self.ahead("<") else self.name()
        self.type_parameters()
        params = self.parameters()
        returns = self.skip_type() if self.take(":") else None
        if not self.ahead("{"):
            self.take(";")
            return Node("Function", start, self.at, name=name, params=params, body=None, returns=returns)
        body = self.block()
        return Node("Function", start, self.at, name=name, params=params, body=body, returns=returns)

    def parameters(self) -> list[Node]:
        self.expect("(")
        out = []
        while not self.ahead(")"):
            if not self.peek():
                raise Unexpected(")")
            self.space()
            start = self.at
            while self.peek()[:1] == "@" and len(self.peek()) > 1:
                self.name()
                if self.ahead("("):
                    self.arguments()
            while self.peek() in _MODIFIERS:
                at = self.at
                self.name()
                if self.peek() in (",", ")", ":", "?", "="):
                    self.at = at
                    break
            self.take("...")
            target = self.binding()
            self.take("?")
            kind = self.skip_type() if self.take(":") else None
            init = self.assignment() if self.take("=") else None
            out.append(Node("Param", start, self.at, target=target, type=kind, init=init))
            if not self.take(","):
                break
        self.expect(")")
        return out

    def binding(self) -> Node:
        self.space()
        start = self.at
        if self.take("{"):
            props = []
            while not self.ahead("}"):
                self.space()
                at = self.at
                if self.take("..."):
                    props.append(Node("BindProp", at, self.at, key=None, target=self.binding()))
                else:
                    key = self.property_name()
                    target = self.binding() if self.take(":") else Node("Ident", at, self.at, name=key if isinstance(key, str) else "")
                    init = self.assignment() if self.take("=") else None
                    props.append(Node("BindProp", at, self.at, key=key if isinstance(key, str) else None, target=target, init=init))
                if not self.take(","):
                    break
            self.expect("}")
            return Node("ObjectPattern", start, self.at, props=props)
        if self.take("["):
            items = []
            while not self.ahead("]"):
                if self.take(","):
                    items.append(Node("Hole", self.at, self.at))
                    continue
                self.take("...")
                item = self.binding()
                if self.take("="):
                    self.assignment()
                items.append(item)
                if not self.ahead("]"):
                    self.expect(",")
            self.expect("]")
            return Node("ArrayPattern", start, self.at, items=items)
        return Node("Ident", start, self.at, name=self.name())

    def _class(self, start: int) -> Node:
        self.expect("class")
        name = self.name() if self.peek() not in ("{", "extends", "implements", "<") else None
        self.type_parameters()
        if self.take("extends"):
            self.trial(self.unary)
            self.type_parameters()
        if self.take("implements"):
            self.trial(self.skip_type)
            while self.take(","):
                self.trial(self.skip_type)
        self.expect("{")
        members = []
        while not self.ahead("}") and self.peek():
            at = self.at
            try:
                if not self.take(";"):
                    members.append(self.member())
            except Unexpected:
                self.resume(at)
            if self.at <= at:
                self.at = at + 1
        self.take("}")
        return Node("Class", start, self.at, name=name, members=members)

    def member(self) -> Node:
        self.space()
        start = self.at
        while self.peek()[:1] == "@" and len(self.peek()) > 1:
            self.name()
            if self.ahead("("):
                self.arguments()
        while self.peek() in _MODIFIERS:
            at = self.at
            self.name()
            if self.peek() in ("(", "=", ":", ";", "?", "<", "}", "!"):
                self.at = at
                break
        if self.ahead("{"):
            return self.block()
        self.take("*")
        key = self.property_name()
        self.take("?")
        self.take("!")
        if self.ahead("(") or self.ahead("<"):
            self.type_parameters()
            params = self.parameters()
            if self.take(":"):
                self.skip_type()
            body = self.block() if self.ahead("{") else None
            return Node("Function", start, self.at, name=key if isinstance(key, str) else None, params=params, body=body, method=True)
        kind = self.skip_type() if self.take(":") else None
        value = self.assignment() if self.take("=") else None
        self.take(";")
        return Node("Field", start, self.at, name=key if isinstance(key, str) else None, type=kind, value=value)

    def _enum(self, start: int) -> Node:
        self.expect("enum")
        name = self.name()
        self.expect("{")
        members = []
        while not self.ahead("}") and self.peek():
            key = self.property_name()
            members.append((key, self.assignment() if self.take("=") else None))
            if not self.take(","):
                break
        self.expect("}")
        found = {k: v.value for k, v in members if isinstance(k, str) and v is not None and v.kind == "String"}
        return Node("Enum", start, self.at, name=name, members=found, names=[k for k, _ in members if isinstance(k, str)])

    def _interface(self, start: int) -> Node:
        self.expect("interface")
        name = self.name()
        self.type_parameters()
        if self.take("extends"):
            self.skip_type()
            while self.take(","):
                self.skip_type()
        self.space()
        at = self.at
        body = self.skip_type()
        return Node("Type", start, self.at, name=name, text=body, at=at)

    def _type(self, start: int) -> Node:
        self.expect("type")
        if self.peek() in ("=", ".", "(", ",", ";", ")"):
            raise Unexpected("type as a name")
        name = self.name()
        self.type_parameters()
        self.expect("=")
        self.take("|")
        self.space()
        at = self.at
        body = self.skip_type()
        self.take(";")
        return Node("Type", start, self.at, name=name, text=body, at=at)

    def _declare(self, start: int) -> Node | None:
        self.expect("declare")
        if self.peek() in ("=", ".", "(", ",", ";", ")"):
            raise Unexpected("declare as a name")
        return self.statement() or Node("Empty", start, self.at)

    def _abstract(self, start: int) -> Node:
        self.expect("abstract")
        if not self.ahead("class"):
            raise Unexpected("class")
        return self._class(start)

    def _namespace(self, start: int) -> Node:
        self.at += len(self.peek())
        if self.peek() in ("'", '"'):
            self.at = _STRING.match(self.text, self.at).end()
        else:
            self.name()
            while self.take("."):
                self.name()
        return self.block()

    _module = _namespace

    def string(self) -> str:
        self.space()
        m = _STRING.match(self.text, self.at)
        if not m:
            raise Unexpected("string")
        self.at = m.end()
        return unescape(m[0][1:-1])

    def _import(self, start: int) -> Node:
        self.expect("import")
        if self.peek() in ("(", "."):
            raise Unexpected("an expression")
        if self.peek() in ("'", '"'):
            source = self.string()
            self.take(";")
            return Node("Import", start, self.at, source=source, names=[])
        at = self.at
        if self.take("type") and self.peek() in (",", "from", "="):
            self.at = at
        names: list[tuple[str, str]] = []
        while not self.ahead("from"):
            if self.take("*"):
                self.expect("as")
                names.append(("*", self.name()))
            elif self.take("{"):
                while not self.ahead("}"):
                    names.append(self.specifier())
                    if not self.take(","):
                        break
                self.expect("}")
            else:
                names.append(("default", self.name()))
                if self.take("="):  # import x = require("y")
                    self.expression()
                    return Node("Import", start, self.at, source="", names=[])
            if not self.take(","):
                break
        self.expect("from")
        source = self.string()
        if self.peek() in ("with", "assert"):
            self.name()
            self.trial(self.primary)
        self.take(";")
        return Node("Import", start, self.at, source=source, names=names)

    def specifier(self) -> tuple[str, str]:
        """(imported or local name, other name)"""
        at = self.at
        if self.take("type") and self.peek() in (",", "}", "as"):
            self.at = at
        one = self.string() if self.peek() in ("'", '"') else self.name()
        if self.take("as"):
            return one, self.string() if self.peek() in ("'", '"') else self.name()
        return one, one

    def _export(self, start: int) -> Node:
        self.expect("export")
        if self.take("default"):
            word = self.peek()
            if word in ("function", "class", "async", "abstract", "interface"):
                inner = self.trial(lambda: getattr(self, f"_{word}")(self.at))
                if inner is not None:
                    return Node("Export", start, self.at, default=inner)
            value = self.assignment()
            self.take(";")
            return Node("Export", start, self.at, default=value)
        if self.take("*"):
            name = (self.string() if self.peek() in ("'", '"') else self.name()) if self.take("as") else None
            self.expect("from")
            source = self.string()
            self.take(";")
            return Node("Export", start, self.at, star=True, alias=name, source=source)
        at = self.at
        if self.take("type") and not self.ahead("{"):
            self.at = at
        if self.take("{"):
            names = []
            while not self.ahead("}"):
                names.append(self.specifier())
                if not self.take(","):
                    break
            self.expect("}")
            source = self.string() if self.take("from") else None
            self.take(";")
            return Node("Export", start, self.at, names=names, source=source)
        if self.take("="):
            return Node("Export", start, self.at, default=self.expression())
        inner = self.statement()
        return Node("Export", start, self.at, inner=inner)

    def _return(self, start: int) -> Node:
        self.expect("return")
        at = self.at
        word = self.peek()
        if word in (";", "}", "") or self.broken_line(at):
            self.take(";")
            return Node("Return", start, self.at)
        value = self.expression()
        self.take(";")
        return Node("Return", start, self.at, value=value)

    def _throw(self, start: int) -> Node:
        self.expect("throw")
        value = self.expression()
        self.take(";")
        return Node("Throw", start, self.at, value=value)

    def condition(self) -> Node:
        self.expect("(")
        value = self.expression()
        self.expect(")")
        return value

    def _if(self, start: int) -> Node:
        self.expect("if")
        test = self.condition()
        body = [x for x in (self.statement(),) if x]
        if self.take("else"):
            body += [x for x in (self.statement(),) if x]
        return Node("If", start, self.at, test=test, body=body)

    def _while(self, start: int) -> Node:
        self.expect("while")
        test = self.condition()
        return Node("While", start, self.at, test=test, body=[x for x in (self.statement(),) if x])

    def _do(self, start: int) -> Node:
        self.expect("do")
        body = [x for x in (self.statement(),) if x]
        self.expect("while")
        return Node("While", start, self.at, test=self.condition(), body=body)

    def _for(self, start: int) -> Node:
        self.expect("for")
        self.take("await")
        self.expect("(")
        word = self.peek()
        if word in ("const", "let", "var"):
            at = self.at

            def each() -> Node:
                self.at += len(word)
                target = self.binding()
                way = self.peek()
                if way not in ("of", "in"):
                    raise Unexpected("of")
                self.at += 2
                over = self.expression()
                self.expect(")")
                body = self.statement()
                return Node("ForEach", start, self.at, way=way, target=target, over=over, body=body)

            if (found := self.trial(each)) is not None:
                return found
            self.at = at
            first = self._declaration(at, word)
        else:
            first = None if self.ahead(";") else self.expression()
            self.take(";")
        test = None if self.ahead(";") else self.expression()
        self.take(";")
        step = None if self.ahead(")") else self.expression()
        self.expect(")")
        return Node("For", start, self.at, first=first, test=test, step=step, body=self.statement())

    def _switch(self, start: int) -> Node:
        self.expect("switch")
        over = self.condition()
        self.expect("{")
        body: list[Node] = []
        while not self.ahead("}") and self.peek():
            at = self.at
            if self.take("case"):
                body.append(self.expression())
                self.expect(":")
            elif self.take("default"):
                self.expect(":")
            elif (node := self.statement()) is not None:
                body.append(node)
            if self.at <= at:
                self.at = at + 1
        self.take("}")
        return Node("Switch", start, self.at, over=over, body=body)

    def _try(self, start: int) -> Node:
        self.expect("try")
        body = [self.block()]
        if self.take("catch"):
            if self.take("("):
                self.binding()
                if self.take(":"):
                    self.skip_type()
                self.expect(")")
            body.append(self.block())
        if self.take("finally"):
            body.append(self.block())
        return Node("Try", start, self.at, body=body)

    def _break(self, start: int) -> Node:
        self.at += len(self.peek())
        at = self.at
        if _NAME.match(self.peek()) and not self.broken_line(at):
            self.name()
        self.take(";")
        return Node("Empty", start, self.at)

    _continue = _break

    # ---- expressions

    def expression(self) -> Node:
        first = self.assignment()
        while self.take(","):
            nxt = self.assignment()
            first = Node("Comma", first.start, self.at, left=first, right=nxt)
        return first

    def assignment(self) -> Node:
        self.depth += 1
        if self.depth > 400:
            self.depth = 0
            raise Unexpected("too deep")
        try:
            # most are one string or name: they need none of the rules below
            word = self.peek()
            if word == '"' or word == "'" or (word and word not in _RESERVED and _NAME.match(word)):
                at = self.at
                node = Node("String", at, 0, value=self.string()) if word in "\"'" else Node("Ident", at, 0, name=self.name())
                node.end = self.at
                if self.peek() in _ENDS:
                    return node
                self.at = at
            arrow = self.arrow()
            if arrow is not None:
                return arrow
            left = self.conditional()
            word = self.peek()
            if word in _ASSIGN:
                self.at += len(word)
                right = self.assignment()
                return Node("Assign", left.start, self.at, op=word, target=left, value=right)
            return left
        finally:
            self.depth = max(0, self.depth - 1)

    def arrow(self) -> Node | None:
        word = self.peek()
        if not (word in ("(", "<", "async") or (word and (word[0].isalpha() or word[0] in "_$"))):
            return None
        start = self.at
        if word not in ("(", "<", "async") and not _ARROW.match(self.text, start + len(word)):
            return None

        def rule() -> Node:
            if word == "async":
                self.take("async")
                at = self.at
                if self.peek() == "=>":
                    self.at = start
                elif self.broken_line(at):
                    raise Unexpected("a line")
            if self.ahead("<"):
                self.type_parameters()
                if not self.ahead("("):
                    raise Unexpected("(")
            if self.ahead("("):
                params = self.parameters()
                returns = None
                if self.ahead(":"):
                    self.at += 1
                    returns = self.skip_type(arrow_ends=True)
            else:
                returns = None
                at = self.at
                m = _NAME.match(self.text, at)
                if not m or not _ARROW.match(self.text, m.end()):
                    raise Unexpected("=>")
                self.at = m.end()
                name = Node("Ident", at, self.at, name=m[0])
                params = [Node("Param", at, self.at, target=name)]
            self.expect("=>")
            return params, returns

        head = self.trial(rule)
        if head is None:
            return None
        params, returns = head
        body = self.block() if self.ahead("{") else self.assignment()
        return Node("Function", start, self.at, name=None, params=params, body=body, arrow=True, returns=returns)

    def conditional(self) -> Node:
        test = self.binary(0)
        if self.ahead("?"):
            self.at += 1
            yes = self.assignment()
            self.expect(":")
            no = self.assignment()
            return Node("Conditional", test.start, self.at, test=test, yes=yes, no=no)
        return test

    def binary(self, least: int) -> Node:
        left = self.unary()
        while True:
            word = self.peek()
            if word in ("as", "satisfies"):
                self.at += len(word)
                kind = "const" if self.take("const") else self.skip_type()
                left = Node("As", left.start, self.at, value=left, type=kind)
                continue
            power = _BINARY.get(word)
            if power is None or power <= least:
                return left
            self.at += len(word)
            right = self.binary(power if word != "**" else power - 1)
            left = Node("Binary", left.start, self.at, op=word, left=left, right=right)

    def unary(self) -> Node:
        self.space()
        start, word = self.at, self.peek()
        if word in ("!", "~", "+", "-", "++", "--") or word in ("typeof", "void", "delete", "await", "yield"):
            self.at += len(word)
            if word == "yield":
                self.take("*")
                if self.peek() in (")", "]", "}", ",", ";", ""):
                    return Node("Ident", start, self.at, name="yield")
            value = self.unary()
            return Node("Unary", start, self.at, op=word, value=value)
        value = self.postfix(self.primary())
        at = self.at
        if self.peek() in ("++", "--") and not self.broken_line(at):
            self.at += 2
        return value

    def postfix(self, node: Node) -> Node:
        while True:
            at = self.at
            word = self.peek()
            if word == "." or word == "?.":
                self.at += len(word)
                nxt = self.peek()
                if word == "?." and nxt == "(":
                    node = Node("Call", node.start, self.at, callee=node, args=self.arguments())
                    node.end = self.at
                elif word == "?." and nxt == "[":
                    node = self.index(node)
                else:
                    self.space()
                    place = self.at
                    name = self.name()
                    node = Node("Member", node.start, self.at, object=node, name=name, place=place)
            elif word == "(":
                args = self.arguments()
                node = Node("Call", node.start, self.at, callee=node, args=args)
            elif word == "[":
                node = self.index(node)
            elif word == "`":
                node = Node("Tagged", node.start, self.at, tag=node, quasi=self.template())
                node.end = self.at
            elif word == "!" and self.text[self.at : self.at + 2] not in ("!=",) and not self.broken_line(at):
                self.at += 1
            elif word == "<":
                kind = self.type_arguments()
                if kind is None:
                    return node
                if self.ahead("`"):
                    continue
                args = self.arguments()
                node = Node("Call", node.start, self.at, callee=node, args=args, types=kind)
            else:
                return node

    def index(self, node: Node) -> Node:
        self.expect("[")
        value = self.expression()
        self.expect("]")
        return Node("Index", node.start, self.at, object=node, index=value)

    def arguments(self) -> list[Node]:
        self.expect("(")
        out = []
        while not self.ahead(")"):
            self.space()
            start = self.at
            if self.take("..."):
                value = self.assignment()
                out.append(Node("Spread", start, self.at, value=value))
            else:
                out.append(self.assignment())
            if not self.take(","):
                break
        self.expect(")")
        return out

    def property_name(self):
        """A name, a string or number as text, or the node of a computed one."""
        word = self.peek()
        if word in ("'", '"'):
            return self.string()
        if word == "0":
            m = _NUMBER.match(self.text, self.at)
            self.at = m.end()
            return m[0]
        if word == "[":
            self.at += 1
            value = self.assignment()
            self.expect("]")
            return value.value if value.kind == "String" else value
        return self.name()

    def object(self) -> Node:
        self.space()
        start = self.at
        self.expect("{")
        props = []
        while not self.ahead("}"):
            self.space()
            at = self.at
            if self.take("..."):
                props.append(Node("Spread", at, self.at, value=self.assignment()))
            else:
                if self.peek() in ("async", "get", "set"):
                    here = self.at
                    self.at += len(self.peek())
                    if self.peek() in ("(", ":", ",", "}", "="):
                        self.at = here
                self.take("*")
                self.space()
                place = self.at
                key = self.property_name()
                ended = self.at
                if self.ahead("(") or self.ahead("<"):
                    self.type_parameters()
                    params = self.parameters()
                    if self.take(":"):
                        self.skip_type()
                    value = Node("Function", at, self.at, name=key if isinstance(key, str) else None, params=params, body=self.block(), method=True)
                    value.end = self.at
                elif self.take(":"):
                    value = self.assignment()
                else:
                    value = Node("Ident", place, self.at, name=key if isinstance(key, str) else "")
                    if self.take("="):
                        self.assignment()
                named = key if isinstance(key, str) else None
                props.append(Node("Property", at, self.at, key=named, computed=None if named is not None else key, value=value, place=place, ended=ended))
            if not self.take(","):
                break
        self.expect("}")
        return Node("Object", start, self.at, props=props)

    def primary(self) -> Node:
        self.space()
        start, word = self.at, self.peek()
        if not word:
            raise Unexpected("the end")
        if word in ("'", '"'):
            value = self.string()
            return Node("String", start, self.at, value=value)
        if word == "0":
            self.at = _NUMBER.match(self.text, self.at).end()
            return Node("Number", start, self.at, value=self.text[start : self.at])
        if word == "`":
            return self.template()
        if word == "(":
            self.at += 1
            value = self.expression()
            self.expect(")")
            return Node("Paren", start, self.at, value=value)
        if word == "[":
            self.at += 1
            items = []
            while not self.ahead("]"):
                self.space()
                at = self.at
                if self.take(","):
                    continue
                if self.take("..."):
                    items.append(Node("Spread", at, self.at, value=self.assignment()))
                else:
                    items.append(self.assignment())
                if not self.ahead("]"):
                    self.expect(",")
            self.expect("]")
            return Node("Array", start, self.at, items=items)
        if word == "{":
            return self.object()
        if word in ("/", "/="):
            m = _REGEX.match(self.text, self.at)
            if not m:
                raise Unexpected("expression")
            self.at = m.end()
            return Node("Regex", start, self.at)
        if word == "<":
            return self.markup()
        if word == "function":
            return self._function(start)
        if word == "class":
            return self._class(start)
        if word == "async":
            if (found := self.trial(lambda: self._async(start))) is not None:
                return found
        if word == "new":
            self.at += 3
            if self.take("."):
                self.name()
                return Node("Ident", start, self.at, name="new.target")
            callee = self.primary()
            while self.peek() in (".", "["):
                callee = self.index(callee) if self.ahead("[") else self._dot(callee)
            self.type_arguments()
            args = self.arguments() if self.ahead("(") else []
            return Node("New", start, self.at, callee=callee, args=args)
        if word == "import":
            self.at += 6
            return Node("Ident", start, self.at, name="import")
        name = self.name()
        return Node("Ident", start, self.at, name=name)

    def _dot(self, node: Node) -> Node:
        self.expect(".")
        name = self.name()
        return Node("Member", node.start, self.at, object=node, name=name)

    def template(self) -> Node:
        self.space()
        start = self.at
        self.at += 1
        parts, holes, raw = [], [], []
        while True:
            if self.at >= self.n:
                raise Unexpected("`")
            c = self.text[self.at]
            if c == "`":
                self.at += 1
                break
            if c == "\\":
                raw.append(self.text[self.at : self.at + 2])
                self.at += 2
            elif c == "$" and self.text[self.at + 1 : self.at + 2] == "{":
                self.at += 2
                parts.append(unescape("".join(raw)))
                raw = []
                holes.append(self.expression())
                self.expect("}")
            else:
                raw.append(c)
                self.at += 1
        parts.append(unescape("".join(raw)))
        return Node("Template", start, self.at, parts=parts, holes=holes)

    # ---- markup

    def tag_name(self) -> str:
        self.space()
        m = re.compile(r"[A-Za-z_$][\w$.:-]*").match(self.text, self.at)
        if not m:
            return ""
        self.at = m.end()
        return m[0]

    def markup(self) -> Node:
        self.space()
        start = self.at
        self.expect("<")
        tag = self.tag_name()
        if not tag and not self.ahead(">"):
            raise Unexpected("markup")
        if tag and self.ahead("<"):
            self.type_parameters()
        attributes = []
        while True:
            self.space()
            at = self.at
            if self.text.startswith("/>", at):
                self.at += 2
                return Node("Markup", start, self.at, tag=tag, attributes=attributes, content=[])
            if self.text.startswith(">", at):
                self.at += 1
                break
            if self.take("{"):
                self.expect("...")
                value = self.assignment()
                self.expect("}")
                attributes.append(Node("Spread", at, self.at, value=value))
                continue
            m = re.compile(r"[A-Za-z_$@:][\w$.:-]*").match(self.text, at)
            if not m:
                raise Unexpected("attribute")
            self.at = m.end()
            value = None
            if self.take("="):
                self.space()
                here = self.at
                c = self.text[here : here + 1]
                if c in ("'", '"'):
                    end = self.text.find(c, here + 1)
                    if end < 0:
                        raise Unexpected(c)
                    self.at = end + 1
                    value = Node("String", here, self.at, value=self.text[here + 1 : end])
                elif c == "{":
                    self.at += 1
                    inner = None if self.ahead("}") else self.expression()
                    self.expect("}")
                    value = Node("Hole", here, self.at, value=inner)
                else:
                    value = self.markup()
            attributes.append(Node("Attribute", at, self.at, name=m[0], value=value))
        content = []
        while True:
            if self.at >= self.n:
                raise Unexpected("</")
            if self.text.startswith("</", self.at):
                self.at += 2
                self.tag_name()
                self.space()
                self.expect(">")
                return Node("Markup", start, self.at, tag=tag, attributes=attributes, content=content)
            c = self.text[self.at]
            if c == "<":
                content.append(self.markup())
            elif c == "{":
                here = self.at
                self.at += 1
                inner = None if self.ahead("}") else (self._spread() if self.ahead("...") else self.expression())
                self.expect("}")
                content.append(Node("Hole", here, self.at, value=inner))
            else:
                here = self.at
                m = re.compile(r"[^<{]+").match(self.text, here)
                self.at = m.end()
                content.append(Node("Text", here, self.at, value=m[0]))

    def _spread(self) -> Node:
        start = self.at
        self.expect("...")
        return Node("Spread", start, self.at, value=self.assignment())


_STATEMENTS = {
    "const", "let", "var", "async", "function", "class", "enum", "interface", "type", "declare", "abstract", "namespace", "module", "import", "export", "return", "throw", "if", "while", "do", "for",
    "switch", "try", "break", "continue",
}


def parse(text: str) -> Node:
    """The tree of a file."""
    return Parser(text).program()
