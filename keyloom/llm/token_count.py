"""Token counts with a whole-token shortcut.

Offline, once per worker: every vocabulary string is taken apart along its merges;
one is *proven whole* if no other merge can cross the border inside its last
merge, and its two parts are proven as well. A pre-token that is such a
string is one token. Only the other pre-tokens are merged.

The proof uses ranks alone: while parts ``a`` and ``b`` are put together, the
symbols at their border are known; a merge of two of them that comes before the
merges which take either up would break the string.

Defined cases: a null text is the empty text (no tokens); special strings of the
vocabulary count one each; repeated rows are counted each; an empty table gives
an empty result; other columns are left out.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .vocab import Memo, Vocab, vocab

#: Pre-tokens whose counts a worker remembers, in each of two generations.
MEMO = 400_000
NEVER = 1 << 60


def prove_whole(v: Vocab) -> set[str]:
    """The vocabulary strings that encode alone as one token."""
    made: dict[str, tuple[str, str, int]] = {}
    for (a, b), rank in v.rank.items():
        made.setdefault(a + b, (a, b, rank))

    def border(symbol: str, side: int) -> list[tuple[str, int]]:
        out, until = [], NEVER
        while True:
            out.append((symbol, until))
            if symbol not in made:
                return out
            until = made[symbol][2]
            symbol = made[symbol][side]

    proven: dict[str, bool] = {}

    def whole(token: str) -> bool:
        got = proven.get(token)
        if got is None:
            if token in made:
                a, b, _ = made[token]
                crossing = sum(
                    (rank := v.rank.get((x, y))) is not None and rank < until_x and rank <= until_y
                    for x, until_x in border(a, 1)
                    for y, until_y in border(b, 0)
                )
                got = whole(a) and whole(b) and crossing == 1
            else:
                got = len(token.removesuffix(v.suffix) if v.suffix else token) == 1
            proven[token] = got
        return got

    return {t for t in v.token_id if t not in v.special and whole(t)}


class Counter:
    def __init__(self, v: Vocab):
        self.v = v
        self.table = {b: c for b, c in enumerate(v.chars)}
        self.whole = prove_whole(v)
        self.memo = Memo(self.count_piece, MEMO)
        self.words = Memo(self.count_word, MEMO)

    def count_word(self, word: str) -> int:
        if word.isalpha():
            return self.count_piece(word)
        if word[-1] in ".,;:!?" and word[:-1].isalpha():
            return self.words[word[:-1]] + self.memo[word[-1]]
        return sum(map(self.memo.__getitem__, self.v.cut(word)))

    def count_piece(self, piece: str) -> int:
        # plain ASCII stands for itself in a byte-level vocabulary
        text = piece if piece.isascii() and piece.isprintable() and " " not in piece else "".join(map(self.table.__getitem__, piece.encode("utf-8")))
        if text + self.v.suffix in self.whole:
            return 1
        return len(self.v.merge(self.v.symbols(piece)))  # n log n: a word of a megabyte takes seconds

    def count(self, text: str) -> int:
        n = 0
        for part, special in self.v.segments(text):
            if special >= 0:
                n += 1
            else:
                words, uncut = self.v.words(part)
                n += sum(map((self.words if uncut else self.memo).__getitem__, words))
        self.memo.trim()
        self.words.trim()
        return n


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(vocab(path))


def count_tokens(docs: DataFrame, vocab_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row."""
    common.tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(vocab_path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([c.count(t) for t in common.texts(b.column(1))], pa.int64())], ["id", "n_bytes", "n_tokens"])

    got = docs.select(F.col(id_col).alias("id"), common.text_of(text_col).alias("text"))
    got = got.withColumn("n_bytes", F.octet_length("text").cast("long"))
    kind = got.schema["id"].dataType.simpleString()
    got = got.mapInArrow(run, f"id {kind}, n_bytes bigint, n_tokens bigint")
    return got.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(common.load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op2_token_counts": op2_token_counts}
