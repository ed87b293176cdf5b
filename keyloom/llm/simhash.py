"""SimHash near-duplicates, linked by Golay-code fuzzy hashing.

A fingerprint has 64 bits, cut into segments of 22, 21 and 21. The perfect binary
Golay code [23, 12, 7] decodes a segment (padded with zeros to 23 bits) to the
codewords within four bits of it: one, or six. Two segments that differ in one
bit share one of these codewords: the nearest codeword of either is at most three
bits away, so at most four from the other. Two fingerprints that differ in at most
two bits have, by the pigeonhole principle, a segment ``i`` without an error
whose successor has at most one. So the keys (i, segment i, codeword index of
the next segment) of three segments bring together every such pair, and each
candidate is verified by its distance.

Copies are folded first: only distinct fingerprints are keyed. Within a bucket no
list of all pairs is made: a task verifies neighbours in blocks, or, in large
buckets, meets fingerprints at their one-bit neighbours, which costs 65 entries for
each fingerprint and loses no link; a task passes on a spanning star of what
it has linked.

``near_duplicates`` works on texts of a shingle similarity (Jaccard) of at least
``similarity``. Keys are the Golay keys of the fingerprint of all shingles, and lanes of
fingerprints of sampled shingles (the three smallest of a seeded order): at the least similarity a
lane's fingerprint is shared with a chance of 0.51, none of 16 with one of 1 in 90,000. Rows
of equal sets are folded by a 128-bit digest first. In a bucket of at most ``FEW`` rows all pairs are
candidates. In a crowded one each row meets the row that has the most neighbours; where that leaves the bucket
in several parts, its rows join exactly, by their rarest shingles (``crowd_pairs``): no
pair of rows that only share what a crowd shares is ever looked at. Sizes and
parity bits rule out candidates without losing a similar pair; the others are verified on the full sets.

Defined cases: a null text is the empty text; texts without words have the
fingerprint zero and link to one another and to what lies within two bits of
zero; ties and repeated rows share a fingerprint and so a component; a
null id is ignored when the smallest id of a component is taken (null only if
all are null); an empty table gives an empty result; other columns are left out by
``simhash_components`` and kept by ``near_duplicates``.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import accumulate, combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .graph import connected_components

SEED = 42
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the cyclic Golay code.
GOLAY = 0b110001110101
#: Buckets of more fingerprints are linked by one-bit neighbours.
LARGE = 48
#: Lanes of ``near_duplicates`` and shingles sampled in each.
LANES, SAMPLED = 16, 3
#: Parity bits of a set of shingles at most.
MOST_BITS = 1 << 16
#: Rows of a bucket all of whose pairs are looked at; rows of larger ones are crowded.
FEW = 16
#: Rows of a block, entries that one unit probes it with, entries and pairs that one partition holds.
BLOCK, PROBES, ROWS_A_PARTITION, PAIRS_A_PARTITION = 1024, 1 << 12, 200_000, 20_000
#: Shingles of a packed chunk, and of a bucket in which they are counted.
PACKED, BUCKET = 1 << 18, 4 << 20
#: Rows of keys that one partition holds.
KEYS_A_PARTITION = 2_000_000


# ---- fingerprints


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    """XXH64 of each shingle of ``k`` words, repeats included; of all words if there are fewer."""
    if not words:
        return np.empty(0, np.uint64)
    text = b" ".join(words)
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(text, SEED)], np.uint64)
    ends = list(accumulate(map(len, words)))
    starts = [0, *(e + i + 1 for i, e in enumerate(ends))]
    stops = [e + i for i, e in enumerate(ends)]
    spans = map(slice, starts, stops[k - 1 :])
    return np.fromiter(map(xxhash.xxh64_intdigest, map(text.__getitem__, spans), repeat(SEED)), np.uint64, len(words) - k + 1)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes; zero for none."""
    n = len(hashes)
    if not n:
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 255 * 256):
        bits = np.unpackbits(hashes[at : at + 255 * 256].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for k in range(0, len(bits), 255):
            counts += np.add.reduce(bits[k : k + 255], axis=0, dtype=np.uint8)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, k: int) -> int:
    return majority(shingle_hashes(words_of(text), k))


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long: the fingerprint's bits) of every row."""
    common.tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(x or b"", shingle) for x in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["id", "fp"])

    got = docs.select(F.col(id_col).alias("id"), common.text_of(text_col).cast("binary").alias("text"))
    return got.mapInArrow(common.released(run), f"id {got.schema['id'].dataType.simpleString()}, fp bigint")


# ---- Golay code


@functools.cache
def golay_table() -> tuple[np.ndarray, np.ndarray]:
    """For each of the 2048 syndromes the error patterns of at most four bits, and how many (1 or 6)."""
    unit = []
    for bit in range(23):
        r = 1 << bit
        for k in range(bit, 10, -1):
            if r >> k & 1:
                r ^= GOLAY << (k - 11)
        unit.append(r)
    patterns = np.zeros((2048, 6), np.uint32)
    count = np.zeros(2048, np.int64)
    for weight in range(5):
        for bits in combinations(range(23), weight):
            s = 0
            for b in bits:
                s ^= unit[b]
            patterns[s, count[s]] = sum(1 << b for b in bits)
            count[s] += 1
    return patterns, count


@functools.cache
def _syndromes() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of the lower 12 and the upper 11 bits."""

    def of(value: int) -> int:
        for k in range(22, 10, -1):
            if value >> k & 1:
                value ^= GOLAY << (k - 11)
        return value

    return np.array([of(x) for x in range(4096)], np.uint16), np.array([of(x << 12) for x in range(2048)], np.uint16)


def codeword_indices(segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices (12 bits) of the codewords within four bits of 23-bit segments, and how many of the six hold."""
    low, high = _syndromes()
    patterns, count = golay_table()
    segment = segment.astype(np.uint32)
    s = low[segment & 4095] ^ high[segment >> 12]
    return (segment[:, None] ^ patterns[s]) >> 11, count[s]


def golay_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, position of the fingerprint) of all keys of all fingerprints."""
    keys, at = [], []
    for i, (low, width) in enumerate(SEGMENTS):
        exact = (fp >> np.uint64(low)) & np.uint64((1 << width) - 1)
        next_low, next_width = SEGMENTS[(i + 1) % 3]
        index, count = codeword_indices((fp >> np.uint64(next_low)) & np.uint64((1 << next_width) - 1))
        held = np.arange(6)[None, :] < count[:, None]
        where = np.nonzero(held)
        keys.append((np.uint64(i) << np.uint64(34)) | (exact[where[0]] << np.uint64(12)) | index[where].astype(np.uint64))
        at.append(where[0])
    return np.concatenate(keys), np.concatenate(at)


# ---- links


def _pairs_by_neighbour(fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links at two bits or fewer among distinct fingerprints: whoever shares a one-bit neighbour."""
    flips = np.concatenate([[0], np.left_shift(np.uint64(1), np.arange(64, dtype=np.uint64))]).astype(np.uint64)
    for part in range(16):  # by the low bits of what they meet at, so that memory stays near 4 entries each
        seen, whose = [], []
        for f in flips:
            x = fp ^ f
            m = np.nonzero((x & np.uint64(15)) == part)[0]
            seen.append(x[m])
            whose.append(m)
        seen, whose = np.concatenate(seen), np.concatenate(whose)
        order = np.argsort(seen, kind="stable")
        seen, whose = seen[order], whose[order]
        same = seen[1:] == seen[:-1]
        yield fp[whose[:-1][same]], fp[whose[1:][same]]


def linked(key: np.ndarray, fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of different fingerprints of one key that differ in two bits or fewer."""
    order = np.lexsort((fp, key))
    key, fp = key[order], fp[order]
    if not len(key):
        return
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.append(starts, len(key)))
    size_of = np.repeat(sizes, sizes)
    small = size_of <= LARGE
    ks, fs = key[small], fp[small]
    for lag in range(1, int(sizes[sizes <= LARGE].max(initial=0))):
        hit = (ks[lag:] == ks[:-lag]) & (np.bitwise_count(fs[lag:] ^ fs[:-lag]) <= 2) & (fs[lag:] != fs[:-lag])
        yield fs[:-lag][hit], fs[lag:][hit]
    for start, n in zip(starts[sizes > LARGE], sizes[sizes > LARGE]):
        yield from _pairs_by_neighbour(np.unique(fp[start : start + n]))


def spanning(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[list[int], list[int]]:
    """A star for each component of the pairs: (member, smallest)."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := up.setdefault(x, x)) != x:
            up[x] = x = up[p]
        return x

    for a, b in pairs:
        for x, y in zip(a.tolist(), b.tolist()):
            x, y = root(x), root(y)
            if x != y:
                up[max(x, y)] = min(x, y)
    members = [x for x in up if root(x) != x]
    return members, [root(x) for x in members]


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        key, at = golay_keys(fp)
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(fp[at].view(np.int64))], ["key", "fp"])


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches]
    if got:
        key, fp = (np.concatenate(x) for x in zip(*got))
        u, v = spanning((a.view(np.int64), b.view(np.int64)) for a, b in linked(key, fp.view(np.uint64)))
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def links(distinct: DataFrame) -> DataFrame:
    """(u, v): edges between distinct fingerprints (column fp) that span each set linked at two bits or fewer."""
    spark = distinct.sparkSession
    session = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(session, -(-distinct.count() * 16 // KEYS_A_PARTITION))
    return distinct.select("fp").mapInArrow(common.released(_keys), "key bigint, fp bigint").repartition(parts, "key").mapInArrow(common.released(_link), "u bigint, v bigint")


def simhash_components(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, fingerprint, component_id, group_size: rows of the same fingerprint) of every row."""
    prints = common.materialize(fingerprints(docs, shingle, id_col, text_col))
    classes = common.materialize(prints.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("group_size")))
    roots = common.materialize(connected_components(links(classes)))
    least = roots.join(classes, roots.node == classes.fp).groupBy("root").agg(F.min("least").alias("component_id"))
    named = roots.join(least, "root").select(F.col("node").alias("fp"), "component_id")
    known = classes.join(named, "fp", "left").select("fp", "group_size", F.coalesce("component_id", "least").alias("component_id"))
    return common.join_spread(prints, common.materialize(known), ["fp"], "group_size").select(
        F.col("id").alias(id_col), "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "group_size"
    )


# ---- near-duplicates by similarity of the sets of shingles


def parity(hashes: np.ndarray) -> bytes:
    """Which of at least twice as many bits as there are hashes (64 to 65,536) are hit an odd number of times.

    Two sets differ in at least as many elements as their bits differ; halves of the bits may be folded by exclusive or."""
    width = min(MOST_BITS, max(64, 1 << (2 * len(hashes) - 1).bit_length())) if len(hashes) else 64
    hit = np.bincount((hashes & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(hit.astype(np.uint8)).tobytes()


def _views(shingle: int):
    """(row, size and digest of its set of shingles, parity bits, keys) of each text; keys are the Golay keys of its
    fingerprint and those of the samples."""
    rng = np.random.default_rng(SEED)
    odd = rng.integers(0, 1 << 63, LANES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    xor = rng.integers(0, 1 << 63, LANES, dtype=np.uint64)
    lane = rng.integers(0, 1 << 63, LANES + 1, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, digests, bits, prints, samples = [], [], [], [], []
            for x in b.column(1).to_pylist():
                h = shingle_hashes(words_of(x or b""), shingle)
                prints.append(majority(h))
                h = np.unique(h)
                sizes.append(len(h))
                digests.append(xxhash.xxh3_128_digest(h.tobytes(), SEED))
                bits.append(parity(h))
                if not len(h):
                    samples.append(h)
                    continue
                x = (h[None, :] ^ xor[:, None]) * odd[:, None]
                x ^= x >> np.uint64(31)
                take = min(SAMPLED, len(h))
                if len(h) > take:
                    x = np.take_along_axis(x, np.argpartition(x, take - 1, axis=1)[:, :take], 1)
                x.sort(axis=1)
                if take == 3:
                    x = (x[:, 0] & x[:, 1]) | (x[:, 0] & x[:, 2]) | (x[:, 1] & x[:, 2])
                else:
                    x = np.bitwise_xor.reduce(x, axis=1)
                samples.append(x ^ lane[:LANES])
            golay, at = golay_keys(np.array(prints, np.uint64))
            order = np.argsort(at, kind="stable")
            of_print = np.split(golay[order] ^ lane[LANES], np.cumsum(np.bincount(at, minlength=len(prints)))[:-1])
            keys = [np.unique(np.concatenate(x)) for x in zip(samples, of_print)]
            ends = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in keys])]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sizes, pa.int32()), pa.array(digests, pa.binary()), pa.array(bits, pa.binary()), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(keys).view(np.int64))), b.column(2)],
                ["row", "size", "digest", "bits", "keys", "of"],
            )

    return run


def fold(bits: bytes, width: int) -> np.ndarray:
    """Parity bits folded to ``width`` bytes: bit k of a longer set falls on bit k modulo the width."""
    return np.bitwise_xor.reduce(np.frombuffer(bits, np.uint8).reshape(-1, width), axis=0)


def _may_be_similar(similarity: float):
    """Of pairs with their sizes and parity bits those that these don't rule out."""
    share = (1 - similarity) / (1 + similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            sizes = b.column(2).to_numpy(zero_copy_only=False).astype(np.int64) + b.column(3).to_numpy(zero_copy_only=False)
            apart = np.empty(b.num_rows, np.int64)
            for k, (x, y) in enumerate(zip(b.column(4).to_pylist(), b.column(5).to_pylist())):
                width = min(len(x), len(y))
                apart[k] = np.bitwise_count(fold(x, width) ^ fold(y, width)).sum()
            yield b.select([0, 1]).filter(pa.array(apart <= share * sizes + 1e-6))

    return run


def _verify(shingle: int, similarity: float):
    """Similar pairs (u, v), from rows of one block after another: its text ``a`` first (no other), then the others."""

    def shingles(text: bytes | None) -> np.ndarray:
        return np.unique(shingle_hashes(words_of(text or b""), shingle))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, held = None, None
        for b in batches:
            u, v = [], []
            for a, other, text in zip(*(b.column(k).to_pylist() for k in range(3))):
                if other is None:
                    lead, held = a, shingles(text)
                    continue
                if a != lead:
                    raise RuntimeError("a block of pairs has no first text")
                x = shingles(text)
                both = len(np.intersect1d(x, held, assume_unique=True))
                if both >= similarity * (len(x) + len(held) - both):
                    u.append(a)
                    v.append(other)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return run


def verified(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(u, v): the pairs (a, b) of rows whose sets of shingles have at least the similarity; texts: row, text.

    The pairs of one row are dealt in blocks of ``BLOCK``: its text is sent once to each block, not with each pair."""
    session = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = common.materialize(pairs.groupBy("a").agg(F.count("*").alias("n")))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = common.join_spread(pairs, counts, ["a"], "n").select("a", "b", F.pmod(F.xxhash64("b"), blocks).cast("int").alias("block"))
    sent = dealt.join(texts.withColumnRenamed("row", "b"), "b").select("a", "b", "text", "block")
    first = counts.select("a", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block")).join(texts.withColumnRenamed("row", "a"), "a")
    every = first.select("a", F.lit(None).cast("bigint").alias("b"), "text", "block").union(sent)
    parts = max(session, -(-(counts.agg(F.sum("n")).first()[0] or 0) // PAIRS_A_PARTITION))
    every = every.repartition(parts, "a", "block").sortWithinPartitions("a", "block", F.col("b").asc_nulls_first())
    return every.select("a", "b", "text").mapInArrow(common.released(_verify(shingle, similarity)), "u bigint, v bigint")


# ---- crowded buckets: an exact join on the rarest shingles


def _pack_sets(shingle: int):
    """Texts' sets of shingles in chunks: chunk, rows, sizes and shingles as packed integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, rows, sets, held = TaskContext.get().partitionId(), 0, [], [], 0

        def flush() -> pa.RecordBatch:
            fields = [np.array(rows, np.int64), np.array([len(x) for x in sets], np.int32), np.concatenate([*sets, np.empty(0, np.uint64)])]
            return pa.RecordBatch.from_arrays([pa.array([part << 32 | number]), *[pa.array([x.tobytes()], pa.binary()) for x in fields]], ["chunk", "rows", "sizes", "shingles"])

        for b in batches:
            for row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows.append(row)
                sets.append(np.unique(shingle_hashes(words_of(text or b""), shingle)))
                held += len(sets[-1])
                if held >= PACKED:
                    yield flush()
                    number, rows, sets, held = number + 1, [], [], 0
        if rows:
            yield flush()

    return run


def _send_counts(buckets: int):
    """(bucket, chunk, shingles, counts): the distinct shingles of chunks, dealt by their upper bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                each, times = np.unique(np.frombuffer(blob, np.uint64), return_counts=True)
                cuts = np.searchsorted(each, _bounds(buckets))
                rows = [(k, chunk, each[x:y].tobytes(), times[x:y].astype(np.uint32).tobytes()) for k, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])) if y > x]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], ["bucket", "chunk", "shingles", "counts"])

    return run


def _bounds(buckets: int) -> np.ndarray:
    return np.array([k * (1 << 64) // buckets for k in range(buckets)] + [(1 << 64) - 1], np.uint64)


def _rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, bucket, codes): for each shingle that a chunk sent, how many texts hold it: 0 for one, then eight steps a doubling."""
    held: list[tuple] = []

    def flush() -> pa.RecordBatch:
        lists = [np.frombuffer(r[2], np.uint64) for r in held]
        each, number = np.unique(np.concatenate(lists), return_inverse=True)
        times = np.bincount(number, np.concatenate([np.frombuffer(r[3], np.uint32) for r in held]), len(each))
        code = np.minimum(255, np.ceil(8 * np.log2(times))).astype(np.uint8)[number]
        codes = np.split(code, np.cumsum([len(x) for x in lists])[:-1])
        return pa.RecordBatch.from_arrays([pa.array([r[1] for r in held], pa.int64()), pa.array([r[0] for r in held], pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary())], ["chunk", "bucket", "codes"])

    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if held and held[-1][0] != row[0]:
                yield flush()
                held = []
            held.append(row)
    if held:
        yield flush()


def _prefixes(similarity: float):
    """(h, row, size, at): of each set, ordered from rare shingles to frequent ones, the first that similar sets must share one of;
    those that no other text holds are left out, but count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, sizes, blob, codes in zip(*(b.column(k).to_pylist() for k in range(4))):
                every = np.frombuffer(blob, np.uint64)
                each, number = np.unique(every, return_inverse=True)
                code = np.concatenate([np.frombuffer(c["codes"], np.uint8) for c in sorted(codes, key=lambda c: c["bucket"])])[number]
                size = np.frombuffer(sizes, np.int32).astype(np.int64)
                of = np.repeat(np.arange(len(size)), size)
                order = np.lexsort((every, code, of))
                at = np.arange(len(every)) - np.repeat(np.cumsum(size) - size, size)
                keep = (at <= (1 - similarity) * size[of] + 1e-6) & (code[order] > 0)
                where = order[keep]
                row = np.frombuffer(rows, np.int64)[of[keep]]
                yield pa.RecordBatch.from_arrays([pa.array(every[where].view(np.int64)), pa.array(row), pa.array(size[of[keep]]), pa.array(at[keep])], ["h", "row", "size", "at"])

    return run


def overlaps(low: np.ndarray, high: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of entries that share a shingle and may be similar: ``low`` holds the smaller set, ``high`` the larger.

    Columns: row, root, size, place of the shingle in the order of the set. Of sets of x and y elements of a similarity s at least
    s / (1 + s) * (x + y) are common, and all that come before the first common one are not: so a larger set with its place bounds the
    smaller one's size, and only sizes in that range are looked at. Entries of the commonest root are passed over as a whole for
    those of the same root."""
    need = similarity / (1 + similarity)
    roots, counts = np.unique(low[:, 1], return_counts=True)
    top = roots[counts.argmax()]
    low = low[np.argsort(low[:, 2], kind="stable")]
    for pool, asked in ((low[low[:, 1] != top], high[high[:, 1] == top]), (low, high[high[:, 1] != top])):
        y = asked[:, 2]
        a = np.searchsorted(pool[:, 2], similarity * y - 1e-6, "left")
        b = np.searchsorted(pool[:, 2], np.minimum(y, (y - asked[:, 3]) / need - y + 1e-6), "right")
        for k in np.flatnonzero(b > a):
            x = pool[a[k] : b[k]]
            r, root, size, _ = asked[k]
            may = (x[:, 1] != root) & ((x[:, 2] < size) | (x[:, 0] < r)) & (x[:, 2] - x[:, 3] >= need * (x[:, 2] + size) - 1e-6)
            found = x[may, 0]
            if len(found):
                yield found, np.full(len(found), r)


def _propose(similarity: float):
    """Pairs of each unit (h, part, salt) in turn: its entries of the smaller sets come first, then those of the larger."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, low, out, held = None, [], [], 0
        for b in batches:
            if not b.num_rows:
                continue
            unit = np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in range(3)], 1)
            role = b.column(3).to_numpy(zero_copy_only=False)
            entry = np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in range(4, 8)], 1)
            starts = np.flatnonzero(np.concatenate([[True], (unit[1:] != unit[:-1]).any(axis=1)]))
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(unit)]):
                if (name := tuple(unit[s])) != last:
                    last, low = name, []
                first = role[s:e] == 0
                if first.any():
                    low.append(entry[s:e][first])
                if not low or first.all():
                    continue
                for pair in overlaps(np.concatenate(low), entry[s:e][~first], similarity):
                    out.append(pair)
                    held += len(pair[0])
                    if held >= 50_000:
                        yield _pairs(out)
                        out, held = [], 0
        if out:
            yield _pairs(out)

    return run


def _pairs(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    u, v = (np.concatenate(x) for x in zip(*found))
    both = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], 1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, 0])), pa.array(np.ascontiguousarray(both[:, 1]))], ["a", "b"])


def crowd_pairs(texts: DataFrame, roots: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(a, b): all pairs of rows (texts: row, text) of different roots that may be similar, by their rarest shingles.

    In an order of all shingles from rare to frequent, two similar sets have a common one among the first of either: of the
    smaller set within (1 - s) / (1 + s) of its size, of the larger within 1 - s. So shingles that crowds have in common
    bring no pairs together, unless they are nearly all that a text holds. Shingles are counted in packed lists of chunks, each
    once a chunk, so one that very many texts hold is no load for any task."""
    spark = texts.sparkSession
    session = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks = common.materialize(texts.mapInArrow(common.released(_pack_sets(shingle)), "chunk bigint, rows binary, sizes binary, shingles binary"))
    total = (chunks.agg(F.sum(F.octet_length("shingles"))).first()[0] or 0) // 8
    buckets = max(session, -(-total // BUCKET))
    sent = chunks.select("chunk", "shingles").mapInArrow(common.released(_send_counts(buckets)), "bucket int, chunk bigint, shingles binary, counts binary")
    ranked = sent.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(common.released(_rank), "chunk bigint, bucket int, codes binary")
    codes = ranked.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "codes")).alias("codes"))
    whole = chunks.join(codes, "chunk").select("rows", "sizes", "shingles", "codes")
    entry = whole.mapInArrow(common.released(_prefixes(similarity)), "h bigint, row bigint, size bigint, at bigint").join(roots, "row", "left")
    entry = entry.select("row", F.coalesce("root", "row").alias("root"), "size", "at", "h")
    low = (F.lit(1.0) - similarity) / (1 + similarity) * F.col("size") + 1e-6
    entry = common.materialize(entry.withColumn("low", F.col("at") <= low))
    met = entry.groupBy("h").agg(F.count("*").alias("n"), F.count_if("low").alias("n_low"), F.min("root").alias("least"), F.max("root").alias("most"))
    met = common.materialize(met.where("least <> most and n_low > 0").select("h", "n", F.ceil(F.col("n_low") / BLOCK).cast("long").alias("parts"), F.ceil(F.col("n") / PROBES).cast("long").alias("salts")))
    entry = common.join_spread(entry, met, ["h"], "n")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    lows = entry.where("low").withColumn("part", F.pmod(F.xxhash64("row"), "parts")).withColumn("salt", every("salts")).withColumn("role", F.lit(0))
    highs = entry.withColumn("salt", F.pmod(F.xxhash64("row"), "salts")).withColumn("part", every("parts")).withColumn("role", F.lit(1))
    names = ["h", "part", "salt", "role", "row", "root", "size", "at"]
    unit = lows.select(*names).union(highs.select(*names))
    parts = max(session, -(-(met.agg(F.sum("n")).first()[0] or 0) // ROWS_A_PARTITION))
    unit = unit.repartition(parts, "h", "part", "salt").sortWithinPartitions("h", "part", "salt", "role")
    return unit.mapInArrow(common.released(_propose(similarity)), "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, whole, one of each group of near-duplicates: the one of the smallest id,
    of repeated ids the first in the input's order; a null id is larger than any other."""
    common.tune(docs.sparkSession)
    docs = common.stable(docs)
    texts = docs.select(F.monotonically_increasing_id().alias("row"), common.text_of(text_col).cast("binary").alias("text"), F.struct(F.col(id_col).alias("id"), *common.place(docs)).alias("of"))
    kind = texts.schema["of"].dataType.simpleString()
    views = common.materialize(texts.mapInArrow(common.released(_views(shingle)), f"row bigint, size int, digest binary, bits binary, keys array<bigint>, of {kind}").select("row", "size", "digest", "bits", "keys", "of.*"))

    # rows of one set of shingles meet at the first of them, which stands for them
    sets = common.materialize(views.groupBy("digest").agg(F.min("row").alias("first"), F.count("*").alias("n")))
    copies = common.join_spread(views.select("row", "digest"), sets.where("n > 1"), ["digest"], "n").where("row > first").select(F.col("first").alias("u"), F.col("row").alias("v"))
    first = views.join(sets.select(F.col("first").alias("row")), "row", "left_semi")

    # buckets of the rows of one key: all pairs of a small one, the first row with each other of a crowded one
    keyed = common.materialize(first.select("row", "size", F.explode("keys").alias("key")))
    groups = common.materialize(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    keyed = common.materialize(common.join_spread(keyed, groups, ["key"], "n"))
    small, crowd = keyed.where(F.col("n") <= FEW), keyed.where(F.col("n") > FEW)
    # the row that meets the most others in its buckets leads: among edited copies that is the one nearest to the original
    met = crowd.groupBy("row").agg(F.sum("n").alias("met"))
    crowd = crowd.join(met, "row")
    leads = crowd.groupBy("key").agg(F.max_by(F.struct("row", "size"), F.struct("met", -F.col("row"))).alias("lead"), F.first("n").alias("_n"))
    crowd = common.materialize(common.join_spread(crowd.select("row", "size", "key", "n"), common.materialize(leads), ["key"], "_n"))
    members = small.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("row", "size"))).alias("x"))  # at most FEW
    members = members.select(F.posexplode("x").alias("k", "one"), "x").select("one", F.explode(F.slice("x", F.col("k") + 2, F.lit(FEW))).alias("two"))
    alike = lambda x, y: F.least(x, y) >= similarity * F.greatest(x, y) - 1e-6
    pairs = members.where(alike(F.col("one.size"), F.col("two.size"))).select(F.col("one.row").alias("a"), F.col("two.row").alias("b"))
    star = crowd.where((F.col("row") != F.col("lead.row")) & alike(F.col("size"), F.col("lead.size"))).select(F.col("lead.row").alias("a"), F.col("row").alias("b"))

    bits = common.materialize(first.join(keyed.select("row").distinct(), "row", "left_semi").select("row", "size", "bits", "file", "at"))

    def possible(pairs: DataFrame) -> DataFrame:
        """The pairs that sizes and parity bits don't rule out."""
        pairs = common.materialize(pairs)
        counts = common.materialize(pairs.groupBy("a").agg(F.count("*").alias("n")))
        left = counts.join(bits.select(F.col("row").alias("a"), F.col("size").alias("size_a"), F.col("bits").alias("bits_a")), "a")
        right = bits.select(F.col("row").alias("b"), F.col("size").alias("size_b"), F.col("bits").alias("bits_b"))
        both = common.join_spread(pairs, common.materialize(left), ["a"], "n").join(right, "b")
        return common.materialize(both.select("a", "b", "size_a", "size_b", "bits_a", "bits_b").mapInArrow(common.released(_may_be_similar(similarity)), "a bigint, b bigint"))

    proposed = possible(pairs.union(star).distinct())
    crowded = common.materialize(crowd.select("row").distinct())
    asked = proposed.select(F.col("a").alias("row")).union(proposed.select("b")).union(crowded).distinct()
    plain = docs.select(common.text_of(text_col).cast("binary").alias("text"))
    held = common.materialize(common.pick_rows(plain, bits.join(asked, "row", "left_semi"), True, "row"))
    edges = common.materialize(verified(proposed, held, shingle, similarity))

    # crowded buckets whose rows aren't connected yet: an exact join of all their rows
    roots = common.materialize(connected_components(edges).select(F.col("node").alias("row"), "root"))
    rooted = crowd.join(roots, "row", "left").select("row", "key", "n", F.coalesce("root", "row").alias("root"))
    apart = rooted.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most")
    open_rows = common.join_spread(crowd.select("row", "key"), common.materialize(apart.select("key", "n")), ["key"], "n").select("row").distinct()
    left = held.join(open_rows, "row", "left_semi")
    more = verified(possible(crowd_pairs(left, roots, shingle, similarity)), held, shingle, similarity)
    joined = common.materialize(connected_components(edges.union(common.materialize(more)).union(copies)))

    places = views.select(F.col("row").alias("node"), "id", "file", "at")
    sizes = joined.groupBy("root").agg(F.count("*").alias("n"))
    members = joined.join(places, "node").select("root", "node", "id", "file", "at")
    kept = members.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node")).alias("best")).join(sizes, "root")
    gone = common.join_spread(members, common.materialize(kept), ["root"], "n").where(F.col("node") != F.col("best.node")).select("file", "at")
    return common.pick_rows(docs, gone, keep=False)


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(common.load(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


QUERIES = {"op10_simhash_near_dedup": op10_simhash_near_dedup}
