r"""Benchmark decontamination by BM25 retrieval with block-max WAND.

The test items form an inverted index: postings of BM25 impacts, divided by the
item's score for itself, so a passage that holds the whole item scores at least
one. Items are cut into blocks of ``BLOCK``, and each term's postings keep its largest
impact in each block it stands in.

Every document is cut into passages (overlapping windows of words, each item
fits into one whole), and every passage is a query. The block maxima of its words are added up from their
postings; blocks whose sum reaches the threshold are the pivots, all others are skipped with the items in
them. The pivots' items are scored exactly, from the postings of their block. All items at or
above the threshold are retrieved, no top-k, so no threshold rises while a query runs; that is why
the pivots of many passages are found at once, by adding arrays, where WAND moves one cursor after the other.

A retrieved item is *verified*: both its question and its answer must stand in the passage. Of a part of more than
``SHORT`` words at least ``OVERLAP`` of its shingles must; of a shorter one, of which a changed word would break most
shingles, that share of its words, within a stretch one word longer than itself. An item
without a cut into question and answer is both; if it has fewer than ``WHOLE`` words it must stand there word by word.

Words are runs of letters, digits and ``_``, in lower case. The answer of an item is
what follows its last question mark or, without one, its last sentences of at least
``ANSWER_WORDS`` words.

The index is held by every task. Its size is measured (pickled); test sets of more than
``INDEX_BYTES`` are cut into several indexes, each of which queries all documents.

Defined cases: null and empty texts are clean; null and empty items match nothing; a
null item id is reported as null; repeated items are reported each by its id, repeated
rows are judged each; items of one or two words, or with such a question or answer, are found like others;
an empty table of documents gives an empty result, an empty
test set finds nothing; other columns are left out by ``find_leaks`` and kept by
``keep_rows``.
"""

from __future__ import annotations

import functools
import math
import pickle
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Items of a block; words of a passage at least; share of an item's own score to retrieve.
BLOCK, PASSAGE, THRESHOLD = 4, 128, 0.5
#: Words of a shingle, and the share of the question and of the answer to verify.
SHINGLE, OVERLAP = 3, 0.6
#: Words of an answer at least, of a part that is verified by words at most, of an uncut item that is verified by shingles at least.
ANSWER_WORDS, SHORT, WHOLE = 3, 9, 8
#: Bytes of one pickled index, and of the text that is tried for it.
INDEX_BYTES, TEXT_BYTES = 64 << 20, 4 << 20
#: Words of the longest items of a band: passages are as long as the band's items need.
BANDS = (64, 512)
#: Words of texts that are queried together, and sums of blocks that are held at once.
QUERY_WORDS, SUMS = 100_000, 1 << 20
K1, B = 1.2, 0.75

_WORD = re.compile(r"\w+")
_SENTENCES = re.compile(r"[^.!?\n]+[.!?\n]*")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]] | None:
    """Words of the question and of the answer of an item; nothing if it has no such cut."""
    at = text.rfind("?")
    if at >= 0:
        q, a = words_of(text[: at + 1]), words_of(text[at + 1 :])
        if q and len(a) >= ANSWER_WORDS:
            return q, a
    parts, answer = _SENTENCES.findall(text), []
    while parts and len(answer) < ANSWER_WORDS:
        answer = words_of(parts.pop()) + answer
    question = words_of("".join(parts))
    if len(question) < ANSWER_WORDS or len(answer) < ANSWER_WORDS:
        return None
    return question, answer


def shingles(words: list[str]) -> set[tuple[str, ...]]:
    return set(zip(*(words[i:] for i in range(SHINGLE))))


def share(part: list[str], passage: list[str], here: set[tuple[str, ...]]) -> float:
    """How much of a question or an answer stands in a passage."""
    if len(part) > SHORT:
        own = shingles(part)
        return len(own & here) / len(own)
    need, size, best = Counter(part), len(part) + 1, 0
    for i in {k for w, k in zip(passage, range(len(passage))) if w in need}:
        # some best stretch begins with a word of the part
        best = max(best, (Counter(passage[i : i + size]) & need).total())
        if best == len(part):
            break
    return best / len(part)


@functools.lru_cache(maxsize=4096)
def _parts(text: str) -> tuple[tuple[list[str], ...], bool]:
    """The parts of an item that must stand in a passage, and whether they must word by word."""
    cut = question_and_answer(text)
    if cut:
        return cut, False
    whole = words_of(text)
    return (whole, whole), len(whole) < WHOLE


def overlap(text: str, passage: list[str], here: set[tuple[str, ...]]) -> tuple[float, float]:
    """Shares of an item's question and answer in a passage."""
    (question, answer), exact = _parts(text)
    if exact:
        n = len(question)
        found = any(passage[i : i + n] == question for i in range(len(passage) - n + 1))
        return (1.0, 1.0) if found else (0.0, 0.0)
    return share(question, passage, here), share(answer, passage, here)


class Part:
    """An inverted index of the items of a band: postings by term of block maxima, and by block of impacts."""

    def __init__(self, items: list[tuple[int | None, list[str], str]], frequency: Counter, total: int, mean: float):
        # like items next to each other make the block maxima tight
        common_word = lambda words: min(words, key=lambda w: (-frequency[w], w))
        items = sorted(items, key=lambda x: (common_word(x[1]), x[0] is None, x[0] or 0))
        self.items = [(i, text) for i, _, text in items]
        self.half = max(PASSAGE // 2, max((len(w) for _, w, _ in items), default=1))
        self.blocks = -(-len(items) // BLOCK)
        self.terms: dict[str, int] = {}
        item, term, impact = [], [], []
        for k, (_, words, _) in enumerate(items):
            held = {}
            for w, tf in Counter(words).items():
                idf = math.log(1 + (total - frequency[w] + 0.5) / (frequency[w] + 0.5))
                held[w] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / mean))
            own = sum(held.values())
            for w, x in held.items():
                item.append(k)
                term.append(self.terms.setdefault(w, len(self.terms)))
                impact.append(x / own)
        item, term, impact = np.array(item, np.int64), np.array(term, np.int64), np.array(impact, np.float32)
        # by block and term: what a pivot's items are scored from
        order = np.lexsort((item, term, item // BLOCK))
        self.b_term, self.b_item, self.b_impact = term[order].astype(np.int32), (item[order] % BLOCK).astype(np.int8), impact[order]
        self.b_start = np.searchsorted(item[order] // BLOCK, np.arange(self.blocks + 1))
        # by term and block, with the largest impact: what pivots are found by
        order = np.lexsort((item // BLOCK, term))
        block, term, impact = (item // BLOCK)[order], term[order], impact[order]
        new = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (term[1:] != term[:-1])])) if len(term) else term
        self.p_block = block[new].astype(np.int32)
        self.p_max = np.maximum.reduceat(impact, new) if len(new) else impact
        self.p_start = np.searchsorted(term[new], np.arange(len(self.terms) + 1))

    def retrieve(self, texts: list[list[str]]) -> Iterator[tuple[int, int, int, float]]:
        """(text, window, item, score) of all items at or above the threshold; a window is two halves."""
        none = len(self.terms)
        ids = np.fromiter((self.terms.get(w, none) for words in texts for w in words), np.int64)
        sizes = np.array([len(words) for words in texts], np.int64)
        halves = np.maximum(1, -(-sizes // self.half))
        windows = np.maximum(1, halves - 1)
        first = np.cumsum(windows) - windows
        of = np.repeat(np.arange(len(texts)), sizes)
        at = (np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)) // self.half
        known = ids < none
        of, at, ids = of[known], at[known], ids[known]
        # each word once in each window, by which the sum of block maxima is as tight as they allow
        own, prior = at < windows[of], at > 0
        pairs = np.concatenate([((first[of] + at) * none + ids)[own], ((first[of] + at - 1) * none + ids)[prior]])
        window, term = np.divmod(np.unique(pairs), max(1, none))
        step = max(1, SUMS // max(1, self.blocks))
        for low in range(0, int(windows.sum()), step):
            a, b = np.searchsorted(window, [low, low + step])
            if a == b:
                continue
            t = term[a:b]
            n = self.p_start[t + 1] - self.p_start[t]
            post = np.arange(int(n.sum())) + np.repeat(self.p_start[t] - (np.cumsum(n) - n), n)
            cell = np.repeat((window[a:b] - low) * self.blocks, n) + self.p_block[post]
            bound = np.bincount(cell, self.p_max[post])
            for pivot in np.flatnonzero(bound >= THRESHOLD * 0.999).tolist():
                w, block = divmod(pivot, self.blocks)
                s, e = np.searchsorted(window[a:b], [w + low, w + low + 1])
                lo, hi = self.b_start[block], self.b_start[block + 1]
                words, asked = t[s:e], self.b_term[lo:hi]
                place = np.minimum(np.searchsorted(words, asked), len(words) - 1)
                hit = words[place] == asked
                score = np.bincount(self.b_item[lo:hi][hit], self.b_impact[lo:hi][hit], BLOCK)
                for k in np.flatnonzero(score >= THRESHOLD * 0.9999).tolist():
                    text = int(np.searchsorted(first, w + low, "right")) - 1
                    yield text, w + low - int(first[text]), block * BLOCK + k, float(score[k])


class Index:
    def __init__(self, items: list[tuple[int | None, str]]):
        held = [(i, w, t) for i, t in items if t and (w := words_of(t))]
        frequency = Counter(w for _, words, _ in held for w in set(words))
        mean = sum(len(w) for _, w, _ in held) / len(held) if held else 1.0
        bands: dict[int, list] = {}
        for x in held:
            bands.setdefault(sum(len(x[1]) > most for most in BANDS), []).append(x)
        self.parts = [Part(bands[k], frequency, len(held), mean) for k in sorted(bands)]

    def leaks(self, texts: list[str]) -> list[list[dict]]:
        """Verified items in each text: item_id, score, question and answer overlap, first word of the passage."""
        out: list[list[dict]] = []
        held, n = [], 0
        for text in texts:
            held.append(words_of(text))
            n += len(held[-1])
            if n >= QUERY_WORDS:
                out += self._query(held)
                held, n = [], 0
        return out + self._query(held) if held else out

    def _query(self, texts: list[list[str]]) -> list[list[dict]]:
        best: list[dict[tuple[int, int], dict]] = [{} for _ in texts]
        for p, part in enumerate(self.parts):
            last, passage, here = None, [], set()
            for d, window, k, score in part.retrieve(texts):
                got = best[d].get((p, k))
                if got and got["score"] >= 1 and got["answer"] == 1 and got["question"] == 1:
                    continue
                if (d, window) != last:
                    last, passage = (d, window), texts[d][window * part.half : (window + 2) * part.half]
                    here = shingles(passage)
                item, text = part.items[k]
                q, a = overlap(text, passage, here)
                if min(q, a) >= OVERLAP - 1e-9 and (not got or (min(q, a), score) > (min(got["question"], got["answer"]), got["score"])):
                    best[d][p, k] = {"item_id": item, "score": score, "question": q, "answer": a, "word": window * part.half}
        return [sorted(x.values(), key=lambda x: (x["item_id"] is None, x["item_id"] or 0)) for x in best]


def _bounded(items: list[tuple[int | None, str]]) -> Iterator[Index]:
    """Indexes of at most ``INDEX_BYTES`` each, unless one item alone is larger."""
    index = Index(items)
    if len(items) > 1 and len(pickle.dumps(index)) > INDEX_BYTES:
        yield from _bounded(items[: len(items) // 2])
        yield from _bounded(items[len(items) // 2 :])
    else:
        yield index


def indexes(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[Index]:
    """The indexes of a test set, one after the other; the driver holds the text of one."""
    held, size = [], 0
    for i, t in items.select(F.col(id_col).cast("long"), common.text_of(text_col)).orderBy(F.col(id_col)).toLocalIterator():
        if held and size + len(t) > TEXT_BYTES:
            yield from _bounded(held)
            held, size = [], 0
        held.append((i, t))
        size += len(t)
    yield from _bounded(held)


_MATCH = "array<struct<item_id:bigint,score:double,question:double,answer:double,word:bigint>>"


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, leaks: array of item_id, score, question, answer, word) of every row."""
    spark = docs.sparkSession
    common.tune(spark)
    got = docs.select(F.col(id_col).alias("id"), common.text_of(text_col).alias("text"))
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("question", pa.float64()), ("answer", pa.float64()), ("word", pa.int64())]))
    id_kind = got.schema["id"].dataType.simpleString()
    found = got.select("id", "text", F.array().cast(_MATCH).alias("leaks"))
    for index in indexes(items):
        held = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for b in batches:
                more = [old + new for old, new in zip(b.column(2).to_pylist(), held.value.leaks(list(common.texts(b.column(1)))))]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(more, kind)], ["id", "text", "leaks"])

        found = found.mapInArrow(common.released(run), f"id {id_kind}, text string, leaks {_MATCH}")
    return found.select(F.col("id").alias(id_col), "leaks")


def keep_rows(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, whole, in which no item was verified."""
    spark = docs.sparkSession
    common.tune(spark)
    at = docs.columns.index(text_col)
    for index in indexes(items):
        held = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array([not found for found in held.value.leaks(list(common.texts(b.column(at))))], pa.bool_()))

        docs = docs.mapInArrow(common.released(run), docs.schema)
    return docs


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(common.load(spark, sf_dir, "documents"), common.load(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", (F.size("leaks") > 0).alias("contaminated"), F.transform("leaks", lambda x: x["item_id"]).alias("item_ids"),
        F.array_max(F.transform("leaks", lambda x: x["score"])).alias("best_score"),
    )


QUERIES = {"op5_decontaminate": op5_decontaminate}
