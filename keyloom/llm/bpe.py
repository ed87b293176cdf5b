"""BPE encoding by per-prefix dynamic programming, and decoding.

A sequence of tokens is the encoding of its bytes exactly when each
neighbouring pair is *compatible*: merging the two tokens' bytes by the merge
rules gives back those two tokens. So every prefix of a pre-token has one last
token: among the tokens that end there (found by walking an automaton with suffix
links along the pre-token), the one that is compatible with the
last token of the prefix before it. Storing that token for each prefix and
following the back-pointers from the end gives the exact ids, in one pass and
whatever the length of the pre-token.

The automaton is that of the vocabulary's tokens (Aho and Corasick) where the method names a suffix automaton: a
suffix automaton tells all substrings of tokens, from which the whole tokens that end at a place
would have to be picked by following the same suffix links, with several times the states; the matches are the same.

Pre-tokens seen before are answered from a bounded memo of a worker.

Defined cases: a null text is the empty text, which has no ids; special strings
of the vocabulary inside a text become their id; repeated rows are encoded
each; an empty table gives an empty result; other columns are left out by
``encode`` and kept by ``encode_rows``.
"""

from __future__ import annotations

import functools
import hashlib
from array import array
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .vocab import Memo, Vocab, vocab

#: Pre-tokens that a worker remembers; beyond it the memo starts anew.
MEMO = 120_000
NEVER = 1 << 60


class PrefixEncoder:
    """Encoder and decoder of one byte-level vocabulary."""

    def __init__(self, v: Vocab):
        self.v = v
        self.bytes_of: list[bytes] = [b""] * (max([*v.token_id.values(), *v.special.values()], default=-1) + 1)
        back = {c: b for b, c in enumerate(v.chars)}
        self.chars_of: list[str] = [""] * len(self.bytes_of)
        for token, k in v.token_id.items():
            self.chars_of[k] = token
            self.bytes_of[k] = bytes(back[c] for c in token)
        for token, k in v.special.items():
            self.bytes_of[k] = token.encode("utf-8")
        self.pair: dict[int, bool] = {}
        self.table = {b: c for b, c in enumerate(v.chars)}
        # the one merge that makes each token, and its rank
        self.join: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        ids = v.token_id
        for (a, b), rank in v.rank.items():
            if a in ids and b in ids and a + b in ids:
                self.join[ids[a], ids[b]] = rank
                self.made.setdefault(ids[a + b], (ids[a], ids[b], rank))
        self.ends: dict[tuple[int, int], list[tuple[int, int]]] = {}
        # only tokens whose own characters encode as that token can stand in an encoding
        self.sole: dict[int, bool] = {}
        self.auto = ahocorasick.Automaton()
        for token, k in v.token_id.items():
            if self.is_whole(k):
                self.auto.add_word(token, (k, len(token)))
        self.auto.make_automaton()
        self.memo = Memo(self.encode_piece, MEMO)

    def is_whole(self, k: int) -> bool:
        """Whether the token's own characters encode as that token: both its parts are
        whole, and no merge but its own last one crosses the border between them."""
        got = self.sole.get(k)
        if got is None:
            if k not in self.made:
                got = len(self.chars_of[k]) == 1
            else:
                a, b, _ = self.made[k]
                got = self.is_whole(a) and self.is_whole(b) and self.crossing(a, b) == 1
            self.sole[k] = got
        return got

    def border(self, k: int, side: int) -> list[tuple[int, int]]:
        """The symbols that stand at the token's left (0) or right (1) end while it is
        merged, each with the rank of the merge that takes it up."""
        got = self.ends.get((k, side))
        if got is None:
            got, until, at = [], NEVER, k
            while True:
                got.append((at, until))
                if at not in self.made:
                    break
                until = self.made[at][2]
                at = self.made[at][side]
            self.ends[k, side] = got
        return got

    def compatible(self, left: int, right: int) -> bool:
        """Whether no merge crosses the border between the two tokens.

        Merges go by rank, so a crossing merge of two border symbols happens if
        it comes before the merges that take either up. A merge of the same rank
        further left goes first, one further right later.
        """
        key = left << 32 | right
        got = self.pair.get(key)
        if got is None:
            if len(self.pair) > 4 * MEMO:
                self.pair.clear()
            got = self.pair[key] = not self.crossing(left, right)
        return got

    def crossing(self, left: int, right: int) -> int:
        join, ends = self.join, self.border(right, 0)
        return sum(
            (rank := join.get((a, b))) is not None and rank < until_a and rank <= until_b
            for a, until_a in self.border(left, 1)
            for b, until_b in ends
        )

    def encode_piece(self, piece: str) -> bytes:
        """Ids of a pre-token as little-endian 32-bit integers."""
        chars = "".join(map(self.table.__getitem__, piece.encode("utf-8")))
        k = self.v.token_id.get(chars)
        if k is not None and self.is_whole(k):
            return k.to_bytes(4, "little")
        n = len(chars)
        last = [-1] * (n + 1)
        size = [0] * (n + 1)
        pair = self.pair
        for end, (k, length) in self.auto.iter(chars):
            end += 1
            if last[end] >= 0:
                continue
            before = last[end - length]
            if end > length and (before < 0 or not (got if (got := pair.get(before << 32 | k)) is not None else self.compatible(before, k))):
                continue
            last[end], size[end] = k, length
        out, at = [], n
        while at:
            if last[at] < 0:
                raise ValueError(f"no encoding of {piece!r}: the vocabulary lacks one of its bytes")
            out.append(last[at])
            at -= size[at]
        out.reverse()
        return array("I", out).tobytes()

    def encode(self, text: str) -> bytes:
        out, memo = [], self.memo
        for part, special in self.v.segments(text):
            if special >= 0:
                out.append(special.to_bytes(4, "little"))
                continue
            out.append(b"".join(map(memo.__getitem__, self.v.pieces(part))))
            memo.trim()
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        table = self.bytes_of
        return b"".join(map(table.__getitem__, array("I", ids))).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> PrefixEncoder:
    return PrefixEncoder(vocab(path))


def encode(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids binary: little-endian unsigned 32-bit, n_tokens) of every row."""
    common.tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocab_path)
        for b in batches:
            ids = [e.encode(t) for t in common.texts(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())], ["id", "ids", "n_tokens"])

    got = docs.select(F.col(id_col).alias("id"), common.text_of(text_col).alias("text"))
    kind = got.schema["id"].dataType.simpleString()
    return got.mapInArrow(common.released(run), f"id {kind}, ids binary, n_tokens bigint").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, vocab_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of rows with ids; null ids decode to the empty text."""
    common.tune(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocab_path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([e.decode(x or b"") for x in b.column(1).to_pylist()], pa.string())], ["id", "text"])

    got = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    kind = got.schema["id"].dataType.simpleString()
    return got.mapInArrow(common.released(run), f"id {kind}, text string").withColumnRenamed("id", id_col)


def encode_decode(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, n_tokens, decoded) of every row in one pass: no exchange, and one transfer to Python."""
    common.tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocab_path)
        for b in batches:
            ids = [e.encode(t) for t in common.texts(b.column(1))]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([e.decode(x) for x in ids], pa.string())],
                ["id", "ids", "n_tokens", "decoded"],
            )

    got = docs.select(F.col(id_col).alias("id"), common.text_of(text_col).alias("text"))
    kind = got.schema["id"].dataType.simpleString()
    return got.mapInArrow(common.released(run), f"id {kind}, ids binary, n_tokens bigint, decoded string").withColumnRenamed("id", id_col)


def op1_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    got = encode_decode(common.load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return got.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


QUERIES = {"op1_bpe_encode_decode": op1_bpe_encode_decode}
