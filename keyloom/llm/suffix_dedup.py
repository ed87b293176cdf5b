"""Removal of repeated passages by longest-previous-factor arrays.

A byte is removed if a string of ``LENGTH`` bytes that covers it also starts in a
document with a smaller id. In a suffix array of all texts these strings are the
suffixes whose longest previous factor is at least ``LENGTH``, and the factor is
found at the previous or next suffix, in suffix order, of a smaller document.

A suffix array of a corpus doesn't fit into a task, and needn't: suffixes have to be
sorted together only if they can share ``LENGTH`` bytes. Each string of that length is
assigned an *anchor*: of the ``GRAM``-byte strings inside it the leftmost of smallest
hash. Equal strings have equal anchors at equal places, so suffixes are dealt by the
hash of their anchor, and a context of ``LENGTH`` - ``GRAM`` bytes before and
``LENGTH`` bytes from the start of an anchor holds all strings of that anchor.

1. A worker sends, for every bucket of anchors, a packed list of (anchor hash, context
   hash, smallest document) of a chunk of text. Anchors of one context are one entry, so
   a passage that a third of all documents hold costs one entry a chunk. The bucket
   decides the trivial ones by equality of 64-bit hashes: a context that an earlier document has as well is
   covered whole; a context that is the only one of its anchor, or whose anchor stands in one document, is free; a
   context that is the first of its kind, beside other contexts of the same anchor, is undecided.
2. Undecided contexts (the borders of passages) are sent as bytes. The bucket sorts
   their suffixes; the longest previous factor of a suffix is the larger of its common prefixes with the previous and the
   next suffix, in suffix order, of a smaller document (``longest_previous``). Factors of ``LENGTH`` and more
   are covered. An anchor of more than ``Sizes.hot`` contexts, the border of a very common passage, is split: its strings are
   dealt by their own hash, each once for a chunk, and compared in the same way.
3. The documents are read once more, and covered bytes are removed.

Decisions go back by files in the shared folder, one for each partition of the
scan, so texts are never exchanged. The three passes read the same partitions: splits are pinned, so
that lost or added executors don't move them, and a table that isn't a plain scan is written first. Each chunk's checksum
goes with what it sends and is compared in the later passes; the job fails if it differs.

Defined cases: null and empty texts, and texts shorter than ``LENGTH`` bytes, keep all
bytes; a null id is larger than any other; repeated rows of one id never
remove each other's bytes; matches inside a document alone remove nothing; long
texts are cut into overlapping pieces inside a worker; an empty table gives an empty
result; other columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LENGTH, GRAM = 50, 30
SIDE = LENGTH - GRAM  # bytes of context before an anchor, and after it
WIDTH = LENGTH + SIDE  # bytes of a whole context
#: Input bytes of a bucket.
BUCKET_BYTES = 4 << 20


class Sizes(NamedTuple):
    """Bytes of text of a chunk and of a piece of a long document, contexts whose suffixes are sorted at once, and contexts of an
    anchor beyond which it is split. They bound memory; results don't depend on them."""

    chunk: int = 1 << 20
    piece: int = 1 << 19
    slice: int = 10_000
    hot: int = 2_000


#: Rows of an Arrow batch: packed lists are long.
ROWS = 200
PAD = 0xFF  # isn't in UTF-8
LAST = (1 << 63) - 1  # the place of a null id

_RNG = np.random.default_rng(50)
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_SALT = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = pow(_BASE, -1, 1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Chunk:
    """Anchors of some pieces of text: for each its place, piece, hash and the hash of its context."""

    powers = inverses = np.empty(0, np.uint64)

    def __init__(self, pieces: list[tuple[int, int, bytes]]):
        """pieces: (document's place in the chunk's list, its id, bytes)."""
        self.pieces = pieces
        self.data = data = np.frombuffer(b"".join(p for _, _, p in pieces), np.uint8)
        sizes = np.array([len(p) for _, _, p in pieces], np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.ids = np.array([i for _, i, _ in pieces], np.int64)
        n = len(data)
        if n < LENGTH:
            self.at = np.empty(0, np.int64)
        else:
            if len(Chunk.powers) < n:
                Chunk.powers, Chunk.inverses = _powers(_BASE, n + (n >> 2)), _powers(_INVERSE, n + (n >> 2))
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_BYTE[data] * Chunk.powers[:n], out=sums[1:])
            grams = _mix((sums[GRAM:] - sums[: n - GRAM + 1]) * Chunk.inverses[: n - GRAM + 1])
            # leftmost smallest of each SIDE + 1 neighbours: hash above, place below
            least = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
            reach = 1
            while 2 * reach <= SIDE + 1:
                least = np.minimum(least[:-reach], least[reach:])
                reach *= 2
            rest = SIDE + 1 - reach
            if rest:
                least = np.minimum(least[: len(least) - rest], least[rest:])
            anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
            # strings that cross from one piece into the next don't count
            inside = np.zeros(n + 1, np.int64)
            whole = sizes >= LENGTH
            np.add.at(inside, self.starts[whole], 1)
            np.add.at(inside, self.ends[whole] - LENGTH + 1, -1)
            anchor = anchor[np.cumsum(inside)[: len(anchor)] > 0]
            self.at = anchor[np.concatenate([[True], anchor[1:] != anchor[:-1]])] if len(anchor) else anchor
        self.piece = np.searchsorted(self.ends, self.at, "right")
        self.low = np.maximum(self.at - SIDE, self.starts[self.piece]) if len(self.at) else self.at
        self.high = np.minimum(self.at + LENGTH, self.ends[self.piece]) if len(self.at) else self.at
        if len(self.at):
            # mixed anew: the smallest of many hashes are all small, and would meet in a few buckets
            self.hash = _mix(grams[self.at] ^ _SALT)
            context = (sums[self.high] - sums[self.low]) * Chunk.inverses[self.low]
            clipped = ((self.at - self.low) * (WIDTH + 1) + (self.high - self.at)).astype(np.uint64)
            self.context = _mix(context + _mix(clipped + np.uint64(1)))
        else:
            self.hash = self.context = np.empty(0, np.uint64)
        # entries: one for each (anchor, context), with its smallest document
        doc = self.ids[self.piece] if len(self.at) else np.empty(0, np.int64)
        self.order = order = np.lexsort((doc, self.context, self.hash))
        h, c = self.hash[order], self.context[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])]) if len(h) else np.empty(0, bool)
        self.entry = np.empty(len(h), np.int64)
        self.entry[order] = np.cumsum(new) - 1  # of each anchor
        first = order[new]
        self.e_hash, self.e_context, self.e_doc, self.e_first = self.hash[first], self.context[first], doc[first], first
        self.is_first_doc = doc == self.e_doc[self.entry] if len(h) else np.empty(0, bool)

    def checksum(self) -> int:
        """Of all bytes and ids, in their order."""
        return zlib.crc32(self.data, zlib.crc32(self.ids.tobytes()))

    def contexts(self, entry: np.ndarray) -> np.ndarray:
        """The bytes of the contexts of some entries; what a document hasn't got is ``PAD``."""
        a = self.e_first[entry]
        place = self.at[a][:, None] + np.arange(-SIDE, LENGTH)
        held = (place >= self.low[a][:, None]) & (place < self.high[a][:, None])
        return np.where(held, self.data[np.clip(place, 0, max(0, len(self.data) - 1))], PAD).astype(np.uint8)

    def strings(self, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(strings of ``LENGTH`` bytes of some entries' contexts, each once; the smallest document of each; for each place of
        each entry the string's number or -1; whether the entry's document is larger than the string's smallest)."""
        contexts = self.contexts(entry)
        views = np.lib.stride_tricks.sliding_window_view(contexts, LENGTH, axis=1)
        whole = (contexts == PAD).cumsum(axis=1)
        whole = whole[:, LENGTH - 1 :] == np.concatenate([np.zeros((len(entry), 1), int), whole[:, :SIDE]], axis=1)
        e, k = np.nonzero(whole)
        rows = np.ascontiguousarray(views[e, k]).view(f"V{LENGTH}").ravel()
        each, number = np.unique(rows, return_inverse=True)
        doc = np.full(len(each), np.iinfo(np.int64).max)
        np.minimum.at(doc, number, self.e_doc[entry[e]])
        of = np.full(whole.shape, -1, np.int64)
        of[e, k] = number
        later = np.zeros(whole.shape, bool)
        later[e, k] = self.e_doc[entry[e]] > doc[number]
        return each.view(np.uint8).reshape(-1, LENGTH), doc, of, later


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """By the upper half of the hash; inside a bucket the lower half tells anchors apart."""
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def pieces_of(text: bytes, piece: int = Sizes().piece) -> Iterator[tuple[int, bytes]]:
    """(start, bytes) of pieces that overlap so that each string of LENGTH is in one of them."""
    at = 0
    while True:
        yield at, text[at : at + piece + LENGTH - 1]
        at += piece
        if at + LENGTH - 1 >= len(text):
            return


def chunks(batches: Iterator[pa.RecordBatch], sizes: Sizes) -> Iterator[tuple[int, list[tuple[int | None, bytes]], Chunk, list[int]]]:
    """(number, documents, their pieces' chunk, start of each piece) of a partition's rows, cut by bytes alone."""
    number, docs, pieces, starts, size = 0, [], [], [], 0
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            text = t or b""
            for at, piece in pieces_of(text, sizes.piece):
                pieces.append((len(docs), LAST if i is None else i, piece))
                starts.append(at)
            docs.append((i, text))
            size += len(text) + 64
            if size >= sizes.chunk:
                yield number, docs, Chunk(pieces), starts
                number, docs, pieces, starts, size = number + 1, [], [], [], 0
    if docs:
        yield number, docs, Chunk(pieces), starts


# ---- packed lists


def _pack(*arrays: np.ndarray) -> bytes:
    return np.array([len(arrays[0])], "<u4").tobytes() + b"".join(a.tobytes() for a in arrays)


def _unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    n, at, out = int(np.frombuffer(blob, "<u4", 1)[0]), 4, []
    for kind in kinds:
        out.append(np.frombuffer(blob, kind, n, at))
        at += out[-1].nbytes
    return out


def _pack_docs(doc: np.ndarray) -> tuple[int, bytes]:
    """Differences from the smallest in as few bytes as they need."""
    least = int(doc.min())
    far = int(doc.max()) - least
    kind = "<u2" if far < 1 << 16 else "<u4" if far < 1 << 32 else "<u8"
    return least, (doc.view(np.uint64) - np.uint64(least % (1 << 64))).astype(kind).tobytes()


def _unpack_docs(least: int, blob: bytes, n: int) -> np.ndarray:
    return (np.frombuffer(blob, f"<u{len(blob) // n}").astype(np.uint64) + np.uint64(least % (1 << 64))).view(np.int64)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows of one bucket after the other, from partitions sorted by bucket."""
    held: list[tuple] = []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if held and held[-1][0] != row[0]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


# ---- first pass


def _send_entries(buckets: int, sizes: Sizes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for number, _, chunk, _ in chunks(batches, sizes):
            b, check = bucket_of(chunk.e_hash, buckets), chunk.checksum()
            cuts = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else np.empty(0, np.int64)
            rows = []
            for low, high in zip(cuts, [*cuts[1:], len(b)]):
                least, docs = _pack_docs(chunk.e_doc[low:high])
                keys = _pack(chunk.e_hash[low:high].astype("<u4"), chunk.e_context[low:high])
                rows.append((int(b[low]), part, number, least, docs, keys, check))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _SENT)], ["bucket", "part", "chunk", "least", "docs", "keys", "checksum"])

    return run


_SENT = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64())
FREE, COVERED, UNDECIDED, SPLIT = 0, 1, 2, 3


def decide(h: np.ndarray, c: np.ndarray, doc: np.ndarray, hot: int) -> np.ndarray:
    """The code of each entry of a bucket."""
    order = np.lexsort((doc, c, h))
    h, c, doc = h[order], c[order], doc[order]
    n = len(h)
    new_h = np.concatenate([[True], h[1:] != h[:-1]])
    new_c = np.concatenate([[True], new_h[1:] | (c[1:] != c[:-1])])
    cs, hs = np.flatnonzero(new_c), np.flatnonzero(new_h)
    first = doc[cs]  # smallest document of each context
    of = np.cumsum(new_c) - 1
    code = np.where(doc > first[of], COVERED, FREE).astype(np.uint8)
    # contexts beside others of the same anchor, not all first in one document
    c_of_h = np.searchsorted(cs, hs)
    low, high = np.minimum.reduceat(first, c_of_h), np.maximum.reduceat(first, c_of_h)
    sizes = np.diff(np.append(hs, n))
    mixed = np.repeat(low < high, sizes) & (code == FREE)
    code[mixed] = UNDECIDED
    code[mixed & np.repeat(np.diff(np.append(c_of_h, len(cs))) > hot, sizes)] = SPLIT
    out = np.empty(n, np.uint8)
    out[order] = code
    return out


def _decide(hot: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            keys = [_unpack(r[5], "<u4", "<u8") for r in rows]
            sizes = [len(k[0]) for k in keys]
            docs = [_unpack_docs(r[3], r[4], n) for r, n in zip(rows, sizes)]
            code = decide(np.concatenate([k[0] for k in keys]), np.concatenate([k[1] for k in keys]), np.concatenate(docs), hot)
            codes = np.split(code, np.cumsum(sizes)[:-1])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[1] for r in rows], pa.int32()),
                    pa.array([r[2] for r in rows], pa.int32()),
                    pa.array([r[0] for r in rows], pa.int32()),
                    pa.array([_pack(x)[:4] + np.packbits((x[:, None] >> np.array([0, 1], np.uint8)) & 1).tobytes() for x in codes], pa.binary()),
                    pa.array([r[6] for r in rows], pa.int64()),
                ],
                ["part", "chunk", "bucket", "codes", "checksum"],
            )

    return run


def _codes(blob: bytes) -> np.ndarray:
    n = int(np.frombuffer(blob, "<u4", 1)[0])
    bits = np.unpackbits(np.frombuffer(blob, np.uint8, offset=4))[: 2 * n].reshape(-1, 2)
    return bits[:, 0] | bits[:, 1] << 1


def _told(folder: str, part: int, columns: list[str]) -> dict[int, list[tuple]]:
    """Rows for a partition of the scan, by chunk, in the order of ``columns``."""
    t = common.read_parquet(f"{folder}/part={part}", ["chunk", *columns])
    out: dict[int, list[tuple]] = {}
    if t is not None:
        for row in zip(*(t.column(c).to_pylist() for c in ("chunk", *columns))):
            out.setdefault(row[0], []).append(row[1:])
    return {k: sorted(v) for k, v in out.items()}


_DECIDED = ["bucket", "codes", "checksum"]


def _codes_of(told: dict, number: int, chunk: Chunk) -> np.ndarray:
    got = told.get(number, ())
    codes = np.concatenate([_codes(blob) for _, blob, _ in got]) if got else np.empty(0, np.uint8)
    if len(codes) != len(chunk.e_hash) or (got and {c for _, _, c in got} != {chunk.checksum()}):
        raise RuntimeError("the partitions of the scan have changed between two passes")
    return codes


# ---- second pass

_CONTEXTS = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())


def _send_contexts(buckets: int, decided: str, sizes: Sizes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        told = _told(decided, part, _DECIDED)
        for number, _, chunk, _ in chunks(batches, sizes):
            codes, rows = _codes_of(told, number, chunk), []

            def send(kind: int, b: np.ndarray, name: np.ndarray, h: np.ndarray, doc: np.ndarray, data: np.ndarray) -> None:
                cuts = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
                for low, high in zip(cuts, [*cuts[1:], len(b)]):
                    keys = _pack(name[low:high].astype("<u4"), h[low:high].astype("<u4"), doc[low:high])
                    rows.append((int(b[low]), part, number, kind, keys, data[low:high].tobytes()))

            entry = np.flatnonzero(codes == UNDECIDED)
            if len(entry):
                h = chunk.e_hash[entry]
                send(0, bucket_of(h, buckets), entry, h, chunk.e_doc[entry], chunk.contexts(entry))
            entry = np.flatnonzero(codes == SPLIT)
            if len(entry):
                strings, doc, _, _ = chunk.strings(entry)
                h = np.array([xxhash.xxh3_64_intdigest(x.tobytes()) for x in strings], np.uint64)
                order = np.argsort(h, kind="stable")
                send(1, bucket_of(h[order], buckets), order, h[order], doc[order], strings[order])
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _CONTEXTS)], ["bucket", "part", "chunk", "kind", "keys", "contexts"])

    return run


def nearest_smaller(owner: np.ndarray, common_prefix: np.ndarray) -> np.ndarray:
    """For each suffix the common prefix with the nearest one before it, in suffix order, of a smaller owner; 0 if there is none.

    ``common_prefix``: of each suffix with the one before it. All suffixes step back at once: what lies between a suffix and
    its pointer has no smaller owner, so where the pointer hasn't one either, it may jump to that one's pointer."""
    at, size = np.arange(-1, len(owner) - 1), common_prefix.copy()
    todo = np.flatnonzero((at >= 0) & (size > 0))
    size[at < 0] = 0
    while len(todo := todo[owner[at[todo]] >= owner[todo]]):
        far = at[todo]
        size[todo], at[todo] = np.where(at[far] >= 0, np.minimum(size[todo], size[far]), 0), at[far]
        todo = todo[size[todo] > 0]
    return size


def longest_previous(contexts: np.ndarray, doc: np.ndarray, places: int = SIDE + 1) -> np.ndarray:
    """For the suffixes at the first ``places`` places of each context (that are all text for ``LENGTH`` bytes): the longest previous
    factor, up to the context's end: the longest prefix that also starts in a context of a smaller document.

    Suffixes are sorted; of all smaller documents' suffixes the nearest before and the nearest after one in this order have the
    longest common prefixes with it, which are the smallest of those of neighbours between them."""
    n, width = contexts.shape
    room = -(-width // 8) * 8
    padded = np.concatenate([contexts, np.full((n, places - 1 + room - width), PAD, np.uint8)], axis=1)
    suffixes = np.lib.stride_tricks.sliding_window_view(padded, room, axis=1)[:, :places].reshape(-1, room)
    owner = np.repeat(doc, places)
    gaps = (contexts == PAD).cumsum(axis=1)
    before = np.concatenate([np.zeros((n, 1), gaps.dtype), gaps], axis=1)[:, :places]
    whole = np.flatnonzero((gaps[:, LENGTH - 1 : LENGTH - 1 + places] == before).ravel())
    lpf = np.zeros(n * places, np.int64)
    if len(whole):
        suffixes, owner = np.ascontiguousarray(suffixes[whole]), owner[whole]
        words = suffixes.view(">u8").astype(np.uint64)
        order = np.lexsort((owner, *(words[:, k] for k in range(words.shape[1] - 1, -1, -1))))
        suffixes, owner = suffixes[order], owner[order]
        sizes = (suffixes != PAD).sum(axis=1)  # a text's end is the context's end: no gap comes before text here
        apart = suffixes[1:] != suffixes[:-1]
        same = np.where(apart.any(axis=1), apart.argmax(axis=1), room)
        same = np.concatenate([[0], np.minimum(same, np.minimum(sizes[1:], sizes[:-1]))])
        back = np.concatenate([[0], same[1:][::-1]])
        lpf[whole[order]] = np.maximum(nearest_smaller(owner, same), nearest_smaller(owner[::-1], back)[::-1])
    return lpf.reshape(n, places)


def _compare(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for every in _groups(batches):
            for kind, width in ((0, WIDTH), (1, LENGTH)):
                rows = [r for r in every if r[3] == kind]
                if not rows:
                    continue
                keys = [_unpack(r[4], "<u4", "<u4", "<i8") for r in rows]
                sizes = [len(k[0]) for k in keys]
                h, doc = np.concatenate([k[1] for k in keys]), np.concatenate([k[2] for k in keys])
                contexts = np.concatenate([np.frombuffer(r[5], np.uint8).reshape(-1, width) for r in rows])
                order = np.argsort(h, kind="stable")
                ends = np.append(np.flatnonzero(np.diff(h[order])) + 1, len(h))
                mask, places, low = np.zeros(len(h), np.uint32), width - LENGTH + 1, 0
                while low < len(h):
                    # as many whole anchors as fit into a slice, at least one
                    k = max(np.searchsorted(ends, low + most, "right") - 1, np.searchsorted(ends, low, "right"))
                    m = order[low : ends[k]]
                    mask[m] = ((longest_previous(contexts[m], doc[m], places) >= LENGTH) << np.arange(places)).sum(axis=1).astype(np.uint32)
                    low = ends[k]
                masks = np.split(mask, np.cumsum(sizes)[:-1])
                found = [(r[1], r[2], kind, _pack(k[0][x > 0].astype("<u4"), x[x > 0])) for r, k, x in zip(rows, keys, masks) if x.any()]
                if found:
                    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)], ["part", "chunk", "kind", "masks"])

    return run


# ---- third pass


def covered(chunk: Chunk, codes: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Whether each byte of the chunk is covered."""
    change = np.zeros(len(chunk.data) + 1, np.int64)
    if len(chunk.at):
        whole = ((codes[chunk.entry] == COVERED) | ~chunk.is_first_doc) & (chunk.high - chunk.low >= LENGTH)
        np.add.at(change, chunk.low[whole], 1)
        np.add.at(change, chunk.high[whole], -1)
        partial = np.flatnonzero(~whole & (masks[chunk.entry] > 0) & chunk.is_first_doc)
        for k in range(SIDE + 1):
            a = chunk.at[partial[(masks[chunk.entry[partial]] >> np.uint32(k)) & 1 == 1]] - SIDE + k
            np.add.at(change, a, 1)
            np.add.at(change, a + LENGTH, -1)
    return np.cumsum(change)[:-1] > 0


def _remove(decided: str, compared: str, sizes: Sizes):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        told, told_masks = _told(decided, part, _DECIDED), _told(compared, part, ["kind", "masks"])
        for number, docs, chunk, starts in chunks(batches, sizes):
            codes = _codes_of(told, number, chunk)
            masks, split = np.zeros(len(codes), np.uint32), np.flatnonzero(codes == SPLIT)
            hits = [(split_one, *_unpack(blob, "<u4", "<u4")) for split_one, blob in told_masks.get(number, ())]
            for split_one, e, m in hits:
                if not split_one:
                    masks[e] = m
            if len(split):
                strings, _, of, later = chunk.strings(split)
                found = np.zeros(len(strings) + 1, bool)  # the last one stands for -1
                for split_one, e, _ in hits:
                    if split_one:
                        found[e] = True
                masks[split] = ((later | found[of]) << np.arange(SIDE + 1)).sum(axis=1).astype(np.uint32)
            gone = covered(chunk, codes, masks)
            of_doc = [np.zeros(len(t), bool) for _, t in docs]
            for (d, _, p), at, low in zip(chunk.pieces, starts, chunk.starts):
                of_doc[d][at : at + len(p)] |= gone[low : low + len(p)]
            out = []
            for (i, text), g in zip(docs, of_doc):
                edge = np.flatnonzero(np.diff(np.concatenate([[False], g, [False]]).astype(np.int8)))
                kept = np.frombuffer(text, np.uint8)[~g].tobytes() if len(edge) else text
                out.append((i, len(text), [{"start": int(s), "end": int(e)} for s, e in zip(edge[::2], edge[1::2])], kept))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), kind, pa.binary()))], ["id", "n_bytes", "spans", "kept"])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sizes: Sizes = Sizes()) -> DataFrame:
    """(id, n_bytes, spans: array of removed (start, end) bytes, kept: the remaining bytes) of every row."""
    spark = docs.sparkSession
    docs = common.stable(docs)
    common.pin_splits(spark)
    common.tune(spark, ROWS)
    base = docs.select(F.col(id_col).cast("long").alias("id"), common.text_of(text_col).cast("binary").alias("text"))
    buckets = common.partitions_for(docs, BUCKET_BYTES)
    folder = common.shared_dir(spark)

    sent = base.mapInArrow(_send_entries(buckets, sizes), "bucket int, part int, chunk int, least bigint, docs binary, keys binary, checksum bigint")
    dealt = sent.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    decided = dealt.mapInArrow(_decide(sizes.hot), "part int, chunk int, bucket int, codes binary, checksum bigint")
    _by_part(decided, f"{folder}/decided")

    sent = base.mapInArrow(_send_contexts(buckets, f"{folder}/decided", sizes), "bucket int, part int, chunk int, kind int, keys binary, contexts binary")
    dealt = sent.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    _by_part(dealt.mapInArrow(_compare(sizes.slice), "part int, chunk int, kind int, masks binary"), f"{folder}/compared")

    out = base.mapInArrow(
        _remove(f"{folder}/decided", f"{folder}/compared", sizes), "id bigint, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary"
    )
    return out.withColumnRenamed("id", id_col)


def _by_part(df: DataFrame, folder: str) -> None:
    df.repartition("part").write.mode("overwrite").partitionBy("part").parquet(folder)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = remove_repeats(common.load(spark, sf_dir, "documents"))
    return got.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


QUERIES = {"op3_suffix_dedup": op3_suffix_dedup}
