"""Token ids in grammar-compressed shards (Re-Pair).

Documents are range-sorted by id; each partition encodes its documents and writes
shards of about ``SHARD_IDS`` ids. A shard is compressed by itself: in each round
the most frequent pairs of neighbouring ids are replaced by nonterminals (never
across the end of a document), until no pair has two places that don't overlap. The file holds the
rules, the length of each nonterminal's expansion, the remaining symbols and where
each document starts, so one document is decoded without the others
(``Shard.document``), and a position inside it is found by expansion lengths
(``Shard.ids_at``).

Shard files are written under temporary names, renamed, and listed in a manifest
table beside them; names come from the partition and the shard's number, so a task that is
run again replaces its files by equal ones.

File format (little-endian): ``KLRP1``, header length (u32), header (JSON: counts, base
of nonterminals, end id, symbol width), rules (u32 pairs), expansion lengths (u32),
document ids (i64) and whether null (u8), ids of each document (u32), first symbol of
each document (u64, one more than documents), symbols (u16 or u32).

Defined cases: a null text is the empty text and holds the end id alone; ties and
repeated rows follow in the input's order; a null id comes first; an empty table
writes no shard and gives an empty result; other columns are left out.
"""

from __future__ import annotations

import functools
import json
import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .vocab import Memo, vocab

SHARD_IDS = 2_000_000
#: Input bytes of one partition of the sorted documents.
PARTITION_BYTES = 16 << 20
#: The fewest places a pair must have to be replaced.
LEAST = 2
MEMO = 400_000
#: The longest word whose ids are remembered whole: where words aren't set apart by spaces, sentences would be.
LONGEST_WORD = 40
#: Bytes of texts whose words are looked up at once.
LOOKUP_BYTES = 8 << 20
MAGIC = b"KLRP1"


# ---- ids

_SPACE = "\t\n\v\f\r "
#: Kinds of bytes: white space, letters (with all that isn't ASCII), digits, others.
_KIND = bytes(0 if chr(b) in _SPACE else 1 if b >= 128 or chr(b).isalpha() else 2 if chr(b).isdigit() else 3 for b in range(256))
#: Bytes of whose words only the scanner knows where they are cut: apostrophes, and what begins a character outside U+00C0 to U+027F,
#: U+0400 to U+047F and U+04C0 to U+04FF, which are letters but for the signs that ``_atoms`` names.
_HARD = bytes(b == ord("'") or b == 0xC2 or (b >= 0xCA and b not in (0xD0, 0xD1, 0xD3)) for b in range(256))


def _atoms(low: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """(parts of texts that encode by themselves, the first part of each text and one more). Parts are runs of letters, digits and runs of others,
    as the standard scanner cuts them, each with the white space before it; words with a hard character stay whole."""
    offsets = np.frombuffer(low.buffers()[1], np.int32)[low.offset : low.offset + len(low) + 1]
    data = bytes(memoryview(low.buffers()[2] or b"")[offsets[0] : offsets[-1]])
    offsets = offsets - offsets[0]
    kind, hard = (np.frombuffer(data.translate(table), np.uint8) for table in (_KIND, _HARD))
    cut = np.empty(len(data) + 1, bool)
    cut[1:-1] = ((kind[1:] != kind[:-1]) | (kind[1:] == 2)) & (kind[:-1] != 0)
    cut[offsets] = True
    starts = np.flatnonzero(cut).astype(np.int32)
    hard = np.flatnonzero(hard.view(bool))
    for sign in (b"\xc3\x97", b"\xc3\xb7", b"\xc4\xb0"):  # amid letters; the last one's lower case ends in a mark
        if sign in data:
            hard = np.concatenate([hard, [m.start() for m in re.finditer(sign, data)]])
    if len(hard):
        edge = kind.take(starts[:-1]) == 0
        edge[np.searchsorted(starts, offsets[offsets < len(data)])] = True
        edges = np.append(np.flatnonzero(edge), len(edge))
        word = np.unique(np.searchsorted(edges, np.searchsorted(starts, hard, "right") - 1, "right") - 1)
        inside = np.zeros(len(starts) + 1, np.int8)
        inside[edges[word] + 1] += 1
        inside[edges[word + 1]] -= 1
        starts = starts[np.cumsum(inside, dtype=np.int8)[:-1] == 0]
    return pa.StringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts), pa.py_buffer(data)), np.searchsorted(starts, offsets)


class LibraryEncoder:
    """Ids by the tokenizers library, asked once for each pre-token that isn't in the memo."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.v = vocab(path)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.merges = self.library.model.tokenize
        self.table = {b: c for b, c in enumerate(self.v.chars)}
        self.memo = Memo(self._ask, MEMO)
        self.words = Memo(self._word, MEMO, LONGEST_WORD)

    def _word(self, word: str) -> bytes:
        if word[:1] in _SPACE:  # a part of a column
            word = word.lstrip(_SPACE)
            if not word:
                return b""
        if not (word.isascii() and word.isalpha()):
            if not self.v.plain(word):
                low = self.v.normal(word)
                if low is not None and low.isalpha():
                    return self._ask(low)
                return b"".join(map(self.memo.__getitem__, self.v.pieces(word)))
            word = word.lower()
        if word.isalpha():
            return self._ask(word)
        if word[-1] in ".,;:!?" and word[:-1].isalpha():  # the commonest shape: a word is asked for once, with and without a mark
            return self.words[word[:-1]] + self.memo[word[-1]]
        return b"".join(map(self.memo.__getitem__, self.v.cut(word)))

    def _ask(self, piece: str) -> bytes:
        # a piece is normalised and cut already: what is left of the library's work are the merges
        chars = piece if piece.isascii() and piece.isprintable() and " " not in piece else "".join(map(self.table.__getitem__, piece.encode("utf-8")))
        return array("I", [t.id for t in self.merges(chars)]).tobytes()

    def encode(self, text: str) -> bytes:
        out = []
        for part, special in self.v.segments(text):
            if special >= 0:
                out.append(special.to_bytes(4, "little"))
            else:
                words, uncut = self.v.words(part)
                out.extend(map((self.words if uncut else self.memo).__getitem__, words))
        self.memo.trim()
        self.words.trim()
        return b"".join(out)

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one behind the other, number of each text's). Every word is looked up once for all texts: no rule of such a
        vocabulary looks beyond white space. Texts with special strings go by themselves."""
        docs, v = len(texts), self.v
        if not v.lowers or not docs:
            every = [np.frombuffer(self.encode(t), "<u4") for t in common.texts(texts)]
            return np.concatenate([np.empty(0, np.uint32), *every]), np.array([len(x) for x in every], np.int64)
        low = pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), ""))
        atoms, places = _atoms(low)
        coded = atoms.dictionary_encode()
        index = coded.indices.to_numpy()
        found = self.words.all(coded.dictionary.to_pylist())
        self.memo.trim()
        self.words.trim()
        odd = np.zeros(docs, bool)
        if v.hint.encode().lower() in atoms.buffers()[2].to_pybytes():
            odd[np.flatnonzero(pc.match_substring(texts, v.hint).to_numpy(zero_copy_only=False))] = True
        sizes = np.fromiter(map(len, found), np.int32, len(found))
        sizes >>= 2
        each = sizes.take(index)
        ends = np.cumsum(each, dtype=np.int32)
        shift = (np.cumsum(sizes, dtype=np.int32) - sizes).take(index) - (ends - each)
        ids = np.frombuffer(b"".join(found), "<u4").take(np.repeat(shift, each) + np.arange(ends[-1] if len(ends) else 0, dtype=np.int32))
        bounds = np.concatenate([[0], ends])[places].astype(np.int64)
        counts = np.diff(bounds)
        if odd.any():
            parts, done = [], 0
            for k in np.flatnonzero(odd).tolist():
                own = np.frombuffer(self.encode(texts[k].as_py() or ""), "<u4")
                parts += [ids[done : bounds[k]], own]
                counts[k], done = len(own), bounds[k + 1]
            ids = np.concatenate([*parts, ids[done:]])
        return ids, counts


@functools.lru_cache(maxsize=2)
def library_encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


# ---- grammar


def _grouped(pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order in which equal pairs stand together, in the order of their places; the pairs so, and where each of them begins.

    Numbers sort faster than their places do: the pairs' hashes are sorted with the places in their lower bits. Two pairs
    of one hash would lie mixed; then the pairs are sorted themselves."""
    bits = np.uint64(max(1, int(len(pair)).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    key = pair * np.uint64(0x9E3779B97F4A7C15)
    key ^= key >> np.uint64(32)
    key *= np.uint64(0xD6E8FEB86659FD93)
    key &= ~low
    key |= np.arange(len(pair), dtype=np.uint64)
    key.sort()
    order = (key & low).view(np.int64)
    found = pair.take(order)
    starts = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
    key >>= bits
    if (key.take(starts[1:]) == key.take(starts[1:] - 1)).any():
        order = np.argsort(pair, kind="stable")
        found = pair.take(order)
        starts = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
    return order, found, starts


def _bounds(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each pair a count that isn't below its true one: how many pairs share its bucket of a hash."""
    bits = min(19, max(10, (4 * len(left)).bit_length()))
    bucket = ((left * np.uint32(2654435761) + right * np.uint32(2246822519)) >> np.uint32(32 - bits)).astype(np.intp)
    return np.bincount(bucket, minlength=1 << bits).astype(np.int32).take(bucket)


def repair(ids: np.ndarray, base: int, end: int, least: int = LEAST, step: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, rules): rule k of two symbols is symbol ``base + k``; ``end`` is in no rule.

    A round replaces all pairs of at least a ``step``-th of the last round's least count, where places overlap the more frequent
    pair; counts are true ones. Rounds go on until no pair has ``least`` places that don't overlap.

    All places of a pair come up in one round, that of its younger symbol, and only get fewer. So each place keeps a bound of its
    pair's count from then on: a round counts at the places that it changed and at those whose bound is high enough. Once few
    places are left, the symbols at none of them are set aside."""
    least = max(2, least)
    seq = ids.astype(np.uint32)
    most = np.zeros(len(seq), np.int32)  # at each place the bound of its pair with the next symbol; 0 where none may be replaced
    fresh, rules = None, []
    made, floor, whole = 0, 1 << 18, None
    while True:
        left, right = (seq[:-1], seq[1:]) if fresh is None else (seq.take(fresh), seq.take(fresh + 1))
        most[slice(len(left)) if fresh is None else fresh] = _bounds(left, right) * ((left != end) & (right != end))
        if whole is None and floor == least and 4 * np.count_nonzero(live := most >= least) < len(seq):
            live[1:] |= live[:-1]
            kept = live.copy()
            kept[1:] |= live[:-1]  # one symbol behind each stretch, for all that are left out there
            whole, slot = (seq, ~live), np.flatnonzero(kept)
            most, seq = most[kept], np.where(live, seq, np.uint32(end))[kept]
        while (top := int(most.max(initial=0))) >= least:
            floor = max(least, min(floor, top) // step)
            where = np.flatnonzero(most >= floor)
            l, r = seq.take(where), seq.take(where + 1)
            pair = l.astype(np.uint64) << np.uint64(32) | r
            order, pair, starts = _grouped(pair)
            where = where.take(order)
            sizes = np.diff(np.append(starts, len(pair)))
            # of a run of one symbol every other place counts
            twin = np.flatnonzero((l == r)[order])
            runs = np.flatnonzero(np.concatenate([[True], np.diff(where[twin]) != 1])) if len(twin) else twin
            odd = twin[(np.arange(len(twin)) - np.repeat(runs, np.diff(np.append(runs, len(twin))))) % 2 == 1]
            counts = sizes - np.bincount(np.searchsorted(starts, odd, "right") - 1, minlength=len(starts))
            np.put(most, where, np.repeat(counts, sizes))
            chosen = np.flatnonzero(counts >= floor)
            if len(chosen):
                break
        else:
            break
        # the more frequent pair has a place before its neighbours, so the most frequent one has all of its places
        times = counts[chosen]
        rank = np.zeros(len(counts), np.int32)
        rank[chosen[np.argsort(times.astype(np.uint16) if times.max() < 1 << 16 else times, kind="stable")]] = np.arange(1, len(chosen) + 1)
        mine = np.repeat(rank, sizes)
        mine[odd] = 0
        some = np.flatnonzero(mine)
        where, pair, mine = where.take(some), pair.take(some), mine.take(some)
        ranks = np.zeros(len(seq) + 2, np.int32)
        np.put(ranks, where + 1, mine)
        some = np.flatnonzero((mine > ranks.take(where)) & (mine > ranks.take(where + 2)))
        mine = mine.take(some)
        some = some.take(np.flatnonzero(np.bincount(mine, minlength=len(chosen) + 1).take(mine) >= least))
        where, pair = where.take(some), pair.take(some)
        new = np.concatenate([[True], pair[1:] != pair[:-1]])
        ruled = pair[new]
        np.put(seq, where, (base + made + np.cumsum(new) - 1).astype(np.uint32))
        where = np.sort(where)
        stay = np.ones(len(seq), bool)
        np.put(stay, where + 1, False)
        # by their numbers: a mask of many changes is slower
        stay = np.flatnonzero(stay)
        seq, most = seq.take(stay), most.take(stay)
        if whole is not None:
            slot = slot.take(stay)
        # each place has moved by the places that went before it
        here = where - np.arange(len(where))
        before = here.take(np.flatnonzero(np.diff(here, prepend=-1) > 1)) - 1
        if here[-1] == len(seq) - 1:
            most[-1], here = 0, here[:-1]
        fresh = np.concatenate([here, before])
        rules.append(np.stack([ruled >> np.uint64(32), ruled & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32))
        made += len(ruled)
    if whole is not None:
        every, aside = whole
        inner = seq != end
        every[slot[inner]], aside[slot[inner]] = seq[inner], True
        seq = every[aside]
    return seq, np.concatenate(rules) if rules else np.empty((0, 2), np.uint32)


def expansion_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    out, todo = np.zeros(len(rules), np.int64), np.arange(len(rules))
    while len(todo):
        parts = rules[todo].astype(np.int64) - base
        sizes = np.where(parts < 0, 1, out[np.maximum(parts, 0)])
        known = (sizes > 0).all(axis=1)
        out[todo[known]] = sizes[known].sum(axis=1)
        todo = todo[~known]
    return out.astype(np.uint32)


def expand(symbols: np.ndarray, rules: np.ndarray, base: int, lengths: np.ndarray | None = None) -> np.ndarray:
    """The ids of symbols. Each rule that is asked for is written down once, the shorter before those made of them; should that take
    more than twice the result, the longest are taken apart where they stand."""
    lengths = expansion_lengths(rules, base) if lengths is None else lengths
    seq, asked = symbols.astype(np.int64), np.zeros(len(rules), bool)
    asked[seq[seq >= base] - base] = True
    todo = np.flatnonzero(asked)
    while len(todo):
        parts = rules[todo].reshape(-1)
        todo = parts[parts >= base].astype(np.int64) - base
        todo = todo[~asked[todo]]
        asked[todo] = True
    known = np.flatnonzero(asked)
    known = known[np.argsort(lengths[known], kind="stable")]
    sizes = lengths[known].astype(np.int64)
    few = int(np.searchsorted(np.cumsum(sizes), 2 * (len(seq) + int(lengths[seq[seq >= base] - base].sum(dtype=np.int64))), "right"))
    if few < len(known):
        asked[:] = False
        asked[known[few:]] = True
        while len(at := np.flatnonzero(seq >= base)) and len(at := at[asked[seq[at] - base]]):
            parts = np.ones(len(seq), np.int64)
            parts[at] = 2
            pair, at = rules[seq[at] - base], (np.cumsum(parts) - parts)[at]
            seq = np.repeat(seq, parts)
            seq[at], seq[at + 1] = pair[:, 0], pair[:, 1]
        known, sizes = known[:few], sizes[:few]
    total = int(sizes.sum())
    # where a symbol's ids are written down: a plain one's at its own number, then those of the rules
    wide = np.int32 if base + 3 * total < 1 << 30 else np.int64
    place, size = np.arange(base + len(rules), dtype=wide), np.ones(base + len(rules), wide)
    place[base + known], size[base + known] = base + np.cumsum(sizes) - sizes, sizes
    held, low = np.arange(base + total, dtype=np.uint32), base
    starts = np.flatnonzero(np.diff(sizes, prepend=0))
    for these, n in zip(np.split(known, starts[1:]), sizes[starts].tolist()):
        left, right = rules[these, 0], rules[these, 1]
        j, first = np.arange(n, dtype=wide), size[left]
        held[low : low + n * len(these)] = held[np.where(j < first[:, None], place[left][:, None], (place[right] - first)[:, None]) + j].reshape(-1)
        low += n * len(these)
    each = size.take(seq)
    ends = np.cumsum(each, dtype=np.int64)
    count = int(ends[-1]) if len(ends) else 0
    ends = ends.astype(wide if count < 1 << 30 else np.int64)
    return held.take(np.repeat(place.take(seq) - (ends - each), each) + np.arange(count, dtype=ends.dtype))


class Shard:
    """A shard read back."""

    def __init__(self, data: bytes):
        if data[:5] != MAGIC:
            raise ValueError("not a shard")
        (n,) = struct.unpack_from("<I", data, 5)
        self.head = head = json.loads(data[9 : 9 + n])
        at = 9 + n

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        self.base = head["base"]
        self.rules = take("<u4", 2 * head["rules"]).reshape(-1, 2)
        self.lengths = take("<u4", head["rules"])
        self.doc_ids, self.null = take("<i8", head["docs"]), take("u1", head["docs"])
        self.sizes = take("<u4", head["docs"])
        self.first = take("<u8", head["docs"] + 1)
        self.symbols = take(f"<u{head['width']}", head["symbols"])

    def __len__(self) -> int:
        return len(self.doc_ids)

    def document(self, k: int) -> np.ndarray:
        """Ids of document ``k``."""
        return expand(self.symbols[int(self.first[k]) : int(self.first[k + 1])], self.rules, self.base, self.lengths)

    def documents(self) -> list[np.ndarray]:
        """Ids of all documents."""
        return np.split(expand(self.symbols, self.rules, self.base, self.lengths), np.cumsum(self.sizes.astype(np.int64))[:-1])

    def ids_at(self, k: int, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of document ``k``; only symbols that overlap are expanded."""
        s = self.symbols[int(self.first[k]) : int(self.first[k + 1])].astype(np.int64)
        size = np.ones(len(s), np.int64)
        size[s >= self.base] = self.lengths[s[s >= self.base] - self.base]
        ends = np.cumsum(size)
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
        skipped = int(ends[a - 1]) if a else 0
        return expand(s[a:b], self.rules, self.base, self.lengths)[start - skipped : stop - skipped]


def pack(docs: list[int | None], sizes: np.ndarray, ids: np.ndarray, base: int, end: int) -> bytes:
    """A shard file of documents: their own ids, and the number and all of their tokens' with the end id."""
    symbols, rules = repair(ids, base, end)
    first = np.concatenate([[0], np.flatnonzero(symbols == end) + 1]).astype("<u8")
    width = 2 if base + len(rules) <= 1 << 16 else 4
    head = json.dumps({"docs": len(docs), "ids": len(ids), "rules": len(rules), "symbols": len(symbols), "base": base, "end": end, "width": width}).encode()
    return b"".join(
        [
            MAGIC,
            struct.pack("<I", len(head)),
            head,
            rules.astype("<u4").tobytes(),
            expansion_lengths(rules, base).astype("<u4").tobytes(),
            np.array([i or 0 for i in docs], "<i8").tobytes(),
            np.array([i is None for i in docs], "u1").tobytes(),
            sizes.astype("<u4").tobytes(),
            first.tobytes(),
            symbols.astype(f"<u{width}").tobytes(),
        ]
    )


# ---- writing and reading


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[list[int | None], pa.Array]]:
    """(ids, texts) of a batch's rows, some ``LOOKUP_BYTES`` at once."""
    names, texts = batch.column(0).to_pylist(), batch.column(1)
    size, low = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy()).astype(np.int64), 0
    while low < len(size):
        high = max(low + 1, int(np.searchsorted(size, LOOKUP_BYTES + (size[low - 1] if low else 0), "right")))
        yield names[low:high], texts[low:high]
        low = high


def write_shards(docs: DataFrame, vocab_path: str, end_id: int, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shards of ``docs`` to ``folder`` and return the manifest: part, seq, name, docs, ids, bytes."""
    common.tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, part = library_encoder(vocab_path), TaskContext.get().partitionId()
        # inside a shard the end of a document is a symbol of its own: a text may hold the end id as well
        stop = max([*e.v.token_id.values(), *e.v.special.values(), end_id]) + 1
        held, n, seq = [], 0, 0

        def flush() -> pa.RecordBatch:
            names, sizes, ids = zip(*held)
            docs = [i for some in names for i in some]
            data = pack(docs, np.concatenate(sizes), np.concatenate(ids), stop + 1, stop)
            name = f"part-{part:06d}-{seq:05d}.ids"
            common.put_file(folder, name, data)
            row = {"part": [part], "seq": [seq], "name": [name], "docs": [len(docs)], "ids": [n], "bytes": [len(data)]}
            return pa.RecordBatch.from_pydict(row, pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("name", pa.string()), ("docs", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64())]))

        for b in batches:
            for names, texts in _slices(b):
                ids, sizes = e.encode_all(texts)
                ends = np.cumsum(sizes)
                ids, sizes, ends = np.insert(ids, ends, stop), sizes + 1, ends + np.arange(1, len(ends) + 1)
                low = at = 0
                while low < len(ends):
                    # a shard ends with the document that fills it
                    full = int(np.searchsorted(ends, at + SHARD_IDS - n))
                    high = min(len(ends), full + 1)
                    to = int(ends[high - 1])
                    held.append((names[low:high], sizes[low:high], ids[at:to]))
                    n += to - at
                    low, at = high, to
                    if n >= SHARD_IDS:
                        yield flush()
                        held, n, seq = [], 0, seq + 1
        if held:
            yield flush()

    got = docs.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), common.text_of(text_col).alias("text"))
    parts = common.partitions_for(docs, PARTITION_BYTES)
    ordered = got.repartitionByRange(parts, "id", "row").sortWithinPartitions("id", "row").select("id", "text")
    return common.materialize(ordered.mapInArrow(common.released(run), "part int, seq int, name string, docs bigint, ids bigint, bytes bigint"), f"{folder}/manifest")


def read_shards(manifest: DataFrame, folder: str, end_id: int) -> DataFrame:
    """(id, start, ids binary: little-endian u32 with the end id) of every document, from the files."""
    # one row a shard: offsets of parts first, then of the shards inside a part
    parts = manifest.groupBy("part").agg(F.sum("ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.join(offsets, "part").select("name", (F.col("offset") + F.coalesce(F.sum("ids").over(inside), F.lit(0))).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                shard = Shard(common.get_file(folder, name))
                ends = np.cumsum(shard.sizes.astype(np.int64))
                starts = start + np.concatenate([[0], ends])
                every = expand(shard.symbols, shard.rules, shard.base, shard.lengths)
                every[ends - 1] = end_id
                # all documents of a shard lie in one buffer, of which each is a stretch
                offsets = np.concatenate([[0], 4 * ends]).astype(np.int64)
                ids = pa.Array.from_buffers(pa.large_binary(), len(shard), [None, pa.py_buffer(offsets), pa.py_buffer(every.astype("<u4", copy=False))])
                for low in range(0, len(shard), common.BATCH_ROWS):
                    high = min(len(shard), low + common.BATCH_ROWS)
                    doc_ids = pa.array(shard.doc_ids[low:high], pa.int64(), mask=shard.null[low:high].astype(bool))
                    yield pa.RecordBatch.from_arrays([doc_ids, pa.array(starts[low:high]), ids[low:high].cast(pa.binary())], ["id", "start", "ids"])

    count = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return placed.repartition(count, "name").mapInArrow(common.released(run), "id bigint, start bigint, ids binary")


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = common.shared_dir(spark)
    manifest = write_shards(common.load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2, folder)
    got = read_shards(manifest, folder, 2)
    return got.select(F.col("id").alias("doc_id"), "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


QUERIES = {"op7_token_store": op7_token_store}
