"""Exact deduplication with Patricia tries that own the texts.

1. Each worker normalises texts (runs of ASCII white space become one space)
   and puts equal ones of an Arrow batch together, so a group of copies sends one
   row per batch, however large it is.
2. Rows go to partitions by (length, content hash). A partition inserts full
   byte strings into a compressed radix trie; the terminal node of a string keeps
   the smallest identifier and the number of rows. Beyond a byte budget the
   largest subtrees are spilled to the worker's local disk by their prefix
   and built one after another at the end.
3. The owners (one row per distinct text) are joined back to the rows by length
   and hash: no list of copies is ever held by one task.

Texts of one length and SHA-256 are taken as equal in step 3; the trie of step 2 would give two
such texts an owner each, and raises an error if equal texts came with different hashes.

Defined cases: a null text equals the empty text; ties and repeated rows: among
rows of one id each is a row of its own in ``group_size``, and all rows of the
smallest id are kept by ``exact_dedup`` (``keep_rows`` keeps one of them); a
null id is larger than any other; an empty table gives an empty result; other
columns are left out by ``exact_dedup`` and kept by ``keep_rows``.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Bytes of strings that one task's trie holds before subtrees are spilled.
TRIE_BYTES = 48 << 20
#: Input bytes of a partition of tries.
PARTITION_BYTES = 16 << 20


def normalise(text: bytes) -> bytes:
    """Each run of the bytes 20, 09-0D (hex) becomes one space."""
    if not text:
        return text
    out = b" ".join(text.split())
    if text[:1].isspace():
        out = b" " + out
    if out != b" " and text[-1:].isspace():
        out += b" "
    return out


class Node:
    __slots__ = ("edge", "kids", "owner")

    def __init__(self, edge: bytes, owner=None):
        self.edge, self.kids, self.owner = edge, {}, owner


def _smaller(a, b):
    """The smaller identifier; null is larger than any other."""
    return b if a is None else a if b is None or a <= b else b


def _common(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of ``a`` and ``b[at:]``."""
    n = min(len(a), len(b) - at)
    if a[:n] == b[at : at + n]:
        return n
    low, high = 0, n  # a[:low] agrees, a[:high] doesn't
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[at + low : at + mid]:
            low = mid
        else:
            high = mid
    return low


class PatriciaTrie:
    """A compressed radix trie of byte strings; terminals own (smallest id, rows, hash).

    Beyond ``budget`` bytes the largest subtrees go to files of the worker's own disk, found below the first node at which strings
    part, so a long common prefix is one step. The files are private to the task, which a retry begins anew."""

    def __init__(self, budget: int = TRIE_BYTES, folder: str | None = None):
        self.root, self.budget, self.folder = Node(b""), budget, folder
        self.held = 0
        self.spilled: dict[bytes, object] = {}  # by the prefix of a subtree
        self.lengths: list[int] = []  # of these prefixes, the longest first: what has gone to a file stays with it

    def insert(self, key: bytes, owner: tuple) -> None:
        for n in self.lengths:
            f = self.spilled.get(key[:n])
            if f is not None:
                pickle.dump((key, owner), f)
                return
        self.held += self._insert(key, owner)
        if self.held > self.budget:
            self._spill()

    def _insert(self, key: bytes, owner: tuple) -> int:
        node, at, n = self.root, 0, len(key)
        while True:
            if at == n:
                if node.owner is None:
                    node.owner = owner
                    return 64
                if node.owner[2] != owner[2]:
                    raise ValueError("equal strings with different hashes")
                node.owner = (_smaller(node.owner[0], owner[0]), node.owner[1] + owner[1], owner[2])
                return 0
            kid = node.kids.get(key[at])
            if kid is None:
                node.kids[key[at]] = Node(key[at:], owner)
                return n - at + 300
            same = _common(kid.edge, key, at)
            if same < len(kid.edge):
                fork = Node(kid.edge[:same])
                kid.edge = kid.edge[same:]
                fork.kids[kid.edge[0]] = kid
                node.kids[key[at]] = kid = fork
            node, at = kid, at + same

    def _walk(self, node: Node, before: bytes) -> Iterator[tuple[bytes, tuple]]:
        stack = [(node, before)]
        while stack:
            node, before = stack.pop()
            text = before + node.edge
            if node.owner is not None:
                yield text, node.owner
            stack.extend((kid, text) for kid in node.kids.values())

    def _size(self, node: Node) -> int:
        size, stack = 0, [node]
        while stack:
            node = stack.pop()
            size += len(node.edge) + 300
            stack.extend(node.kids.values())
        return size

    def _spill(self) -> None:
        """Write the largest subtrees to disk until half of the budget is free; what comes for them later follows directly."""
        at, before = self.root, b""
        while at.owner is None and len(at.kids) == 1:
            (at,) = at.kids.values()
            before += at.edge
        sizes = {first: self._size(kid) for first, kid in at.kids.items()}
        for first in sorted(sizes, key=sizes.get, reverse=True):
            if self.held <= self.budget // 2:
                break
            prefix = before + bytes([first])
            self.spilled[prefix] = f = tempfile.TemporaryFile(dir=self.folder)
            for pair in self._walk(at.kids.pop(first), before):
                pickle.dump(pair, f)
            self.held = max(0, self.held - sizes[first])
        self.lengths = sorted({len(p) for p in self.spilled}, reverse=True)

    def _drain(self, files: list) -> Iterator[tuple[bytes, tuple]]:
        yield from self._walk(self.root, b"")
        self.root, self.held = Node(b""), 0
        files.extend(self.spilled.values())

    def owners(self) -> Iterator[tuple[bytes, tuple]]:
        """All strings with their owners, subtree by subtree."""
        files: list = []
        yield from self._drain(files)
        while files:
            f, sub = files.pop(), PatriciaTrie(self.budget, self.folder)
            f.seek(0)
            while True:
                try:
                    sub.insert(*pickle.load(f))
                except EOFError:
                    break
            f.close()
            yield from sub._drain(files)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, id, n, sha) of each text."""
    for b in batches:
        shas, sizes = [], []
        for x in b.column(2).to_pylist():
            t = normalise(x or b"")
            sizes.append(len(t))
            shas.append(hashlib.sha256(t).digest())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(shas, pa.binary())], ["row", "id", "n", "sha"])


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(n, sha, text, id, rows) of the distinct texts of each batch."""
    for b in batches:
        found: dict[bytes, list] = {}
        for i, x in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            t = normalise(x or b"")
            if (got := found.get(t)) is None:
                found[t] = [i, 1]
            else:
                got[0] = _smaller(got[0], i)
                got[1] += 1
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([len(t) for t in found], pa.int64()),
                pa.array([hashlib.sha256(t).digest() for t in found], pa.binary()),
                pa.array(list(found), pa.binary()),
                pa.array([i for i, _ in found.values()], b.column(1).type),
                pa.array([k for _, k in found.values()], pa.int64()),
            ],
            ["n", "sha", "text", "id", "rows"],
        )


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    trie, kind = PatriciaTrie(), None
    for b in batches:
        kind = b.column(3).type
        for sha, text, i, rows in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist()):
            trie.insert(text, (i, rows, sha))
    out = []

    def flush():
        return pa.RecordBatch.from_arrays(
            [
                pa.array([x[0] for x in out], pa.int64()),
                pa.array([x[1][2] for x in out], pa.binary()),
                pa.array([x[1][0] for x in out], kind),
                pa.array([x[1][1] for x in out], pa.int64()),
            ],
            ["n", "sha", "keep_id", "group_size"],
        )

    for key, owner in trie.owners():
        out.append((len(key), owner))
        if len(out) >= 20_000:
            yield flush()
            out.clear()
    if out:
        yield flush()


def _keyed(docs: DataFrame, id_col: str, text_col: str, more: list | None = None) -> DataFrame:
    return docs.select(
        F.struct(F.monotonically_increasing_id().alias("row"), *(more or [])).alias("row"), F.col(id_col).alias("id"), common.text_of(text_col).cast("binary").alias("text")
    )


def owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(n, sha, keep_id, group_size) of each distinct normalised text."""
    common.tune(docs.sparkSession)
    got = _keyed(docs, id_col, text_col)
    kind = got.schema["id"].dataType.simpleString()
    parts = common.partitions_for(docs, PARTITION_BYTES)
    sent = got.mapInArrow(common.released(_distinct), f"n bigint, sha binary, text binary, id {kind}, rows bigint")
    return sent.repartition(parts, "n", "sha").mapInArrow(common.released(_own), f"n bigint, sha binary, keep_id {kind}, group_size bigint")


def _owned_rows(docs: DataFrame, id_col: str, text_col: str, more: list | None = None) -> DataFrame:
    """(row, id, n, sha, keep_id, group_size) of every row; the rows of a large group are spread over tasks."""
    owned = common.materialize(owners(docs, id_col, text_col))
    got = _keyed(docs, id_col, text_col, more)
    kinds = {f.name: f.dataType.simpleString() for f in got.schema}
    rows = got.mapInArrow(common.released(_digests), f"row {kinds['row']}, id {kinds['id']}, n bigint, sha binary")
    return common.join_spread(rows, owned, ["n", "sha"], "group_size")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) of every row."""
    return _owned_rows(docs, id_col, text_col).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def keep_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, whole, one for each distinct text: that of the smallest id, and of
    repeated rows the first in the input's order."""
    docs = common.stable(docs)
    rows = _owned_rows(docs, id_col, text_col, common.place(docs))
    kept = rows.where(F.col("id").eqNullSafe(F.col("keep_id"))).groupBy("n", "sha").agg(F.min("row").alias("row"))
    return common.pick_rows(docs, kept.select("row.file", "row.at"), keep=True)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(common.load(spark, sf_dir, "documents"))


QUERIES = {"op8_exact_dedup": op8_exact_dedup}
ORACLES = {
    "op8_exact_dedup": r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
), g AS (
  SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm
)
SELECT t.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, t.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g USING (norm)
"""
}
