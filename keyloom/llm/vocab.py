"""Front ends of the public BPE vocabularies: special strings, normalisation and pre-tokens.

A vocabulary is a path parameter; every Python worker loads it once. The
scanners below give the same pre-tokens as the vocabulary's own file asks for, for texts of
the characters in ``_KNOWN``: ``tests/llm`` holds each of them against the library. Tables of letters and
cases differ between versions of Unicode, so texts with any other character are
normalised and cut by the library itself.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import unicodedata

import regex

#: White space as the vocabulary files' regular expressions understand it.
_WS = r"\t-\r \x85\xa0  -     　"
#: Texts of these characters alone go to the standard scanner, whose letters and digits
#: are then those of ``LETTER`` and 0-9.
_PLAIN = re.compile("[\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f\u2010-\u2027\u2030-\u205e\u20ac]*")
#: Characters for which the general scanner is known to cut as the library does: no combining marks, no conjoining letters.
KNOWN = (
    (0x00, 0x2AF), (0x370, 0x373), (0x376, 0x377), (0x37B, 0x37D), (0x386, 0x386), (0x388, 0x38A), (0x38C, 0x38C), (0x38E, 0x3A1), (0x3A3, 0x482), (0x48A, 0x52F), (0x5D0, 0x5EA),
    (0x620, 0x64A), (0x660, 0x669), (0x2010, 0x2027), (0x2030, 0x205E), (0x20A0, 0x20BF), (0x2190, 0x21FF), (0x2500, 0x257F), (0x3000, 0x3029),
    (0x3041, 0x3096), (0x309B, 0x30FF), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3), (0xFF01, 0xFF5E), (0x1F300, 0x1F5FF), (0x1F600, 0x1F64F),
)
_KNOWN = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in KNOWN) + "]*")

_LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"

# letters come first: no other alternative begins with one, and most pre-tokens are words
_SPACED = (
    re.compile(rf" ?[{_LETTER}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[0-9]+| ?[^\s{_LETTER}0-9]+|\s+(?!\S)|\s+"),
    regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"),
)
_WORDS = (
    re.compile(rf"[{_LETTER}]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^\s{_LETTER}0-9]+"),
    regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_WS}\p{{L}}\p{{N}}]+"),
)


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b] = chr(spare)
            spare += 1
    return out


def lower(text: str) -> str:
    """Lower case, one character at a time: no rule looks at neighbours."""
    return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)


#: The longest string whose answer is remembered.
LONGEST = 200


class Memo(dict):
    """Answers of ``of`` by key. Of two generations of at most ``most`` keys the older is
    forgotten, and what is asked for again moves to the younger. Long keys are never kept."""

    def __init__(self, of, most: int, longest: int = LONGEST):
        super().__init__()
        self.of, self.most, self.longest, self.old = of, most, longest, {}

    def __missing__(self, key):
        if isinstance(key, str) and len(key) > self.longest:
            return self.of(key)
        got = self.old.get(key)
        if got is None:
            got = self.of(key)
        self[key] = got
        return got

    def all(self, keys: list[str]) -> list:
        """The answers of many keys."""
        found = list(map(self.get, keys))
        left = [k for k, got in enumerate(found) if got is None]
        asked = [keys[k] for k in left]
        answers = [self.of(key) if got is None else got for key, got in zip(asked, map(self.old.get, asked))]
        self.update(zip(asked, answers))
        for k, key, got in zip(left, asked, answers):
            found[k] = got
            if len(key) > self.longest:
                self.pop(key, None)
        return found

    def trim(self) -> None:
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()


class Vocab:
    """A vocabulary file: token bytes by id, ids by token, merge ranks and the text front end."""

    def __init__(self, path: str):
        self.path, self._library = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.token_id: dict[str, int] = model["vocab"]
        self.rank = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): k for k, m in enumerate(model["merges"])}
        self.chars = byte_chars()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = re.compile("|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) or r"(?!)")
        self.hint = next(iter(self.special), "\0")[:2]
        self.lowers = spec["normalizer"] is not None
        self._plain, self._general = _WORDS if self.lowers else _SPACED
        self._bytes = {c: b for b, c in enumerate(self.chars)}

    def normal(self, text: str) -> str | None:
        """The text as its scanner takes it; nothing if that is left to the library."""
        if not text.isascii() and not _KNOWN.fullmatch(text):
            return None
        if self.lowers:
            if not text.isascii() and not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            text = lower(text)
        return text

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens of a text without special strings, as plain text."""
        low = self.normal(text)
        if low is None:
            return self._ask(text)
        return self.cut(low)

    def cut(self, low: str) -> list[str]:
        return (self._plain if _PLAIN.fullmatch(low) else self._general).findall(low)

    def plain(self, text: str) -> bool:
        """Whether the standard scanner takes the text and its lower case: but for one letter plain texts stay plain, and are normal."""
        return "\u0130" not in text and _PLAIN.fullmatch(text) is not None

    def words(self, text: str) -> tuple[list[str], bool]:
        """Parts of a text that encode by themselves, and whether they are yet to be cut: where no pre-token has white space the
        runs between it, which are fewer than pre-tokens and fast to find."""
        if self.lowers and self.plain(text):
            return text.lower().split(), True
        low = self.normal(text)
        if low is None:
            return self._ask(text), False
        return self.cut(low), False

    def _ask(self, text: str) -> list[str]:
        """Pre-tokens by the library."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        if self._library.normalizer is not None:
            text = self._library.normalizer.normalize_str(text)
        back = self._bytes
        return [bytes([back[c] for c in piece]).decode("utf-8") for piece, _ in self._library.pre_tokenizer.pre_tokenize_str(text)]

    def segments(self, text: str) -> list[tuple[str, int]]:
        """The text cut at its special strings: (text, -1) or ("", id)."""
        if self.hint not in text:
            return [(text, -1)]
        out, at = [], 0
        for m in self._special.finditer(text):
            out.append((text[at : m.start()], -1))
            out.append(("", self.special[m[0]]))
            at = m.end()
        out.append((text[at:], -1))
        return out

    def symbols(self, piece: str) -> list[str]:
        """The characters from which the merges of a pre-token start."""
        out = [self.chars[b] for b in piece.encode("utf-8")]
        if out and self.suffix:
            out[-1] += self.suffix
        return out

    def merge(self, symbols: list[str]) -> list[str]:
        """Byte-pair merging by rank; of equal ranks the leftmost first. Time grows as n log n."""
        symbols, rank = list(symbols), self.rank
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        todo = [(r, k, p[0], p[1]) for k, p in enumerate(zip(symbols, symbols[1:])) if (r := rank.get(p)) is not None]
        heapq.heapify(todo)
        while todo:
            _, k, a, b = heapq.heappop(todo)
            follow = after[k]
            if symbols[k] != a or follow >= n or symbols[follow] != b:
                continue  # one of the two has been taken up
            symbols[k], symbols[follow] = a + b, None
            after[k] = beyond = after[follow]
            if beyond < n:
                before[beyond] = k
                if (r := rank.get((a + b, symbols[beyond]))) is not None:
                    heapq.heappush(todo, (r, k, a + b, symbols[beyond]))
            if (prior := before[k]) >= 0 and (r := rank.get((symbols[prior], a + b))) is not None:
                heapq.heappush(todo, (r, prior, symbols[prior], a + b))
        return [x for x in symbols if x is not None]


@functools.lru_cache(maxsize=4)
def vocab(path: str) -> Vocab:
    return Vocab(path)
