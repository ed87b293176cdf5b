"""Toxicity by multiple-instance learning.

Only documents are labelled, but what makes one toxic stands in single
sentences. A document is a bag of sentences; a sentence gets a probability from
a linear model over its words and the character n-grams inside them, and the
document's is the noisy-or of its sentences: ``1 - prod(1 - p)``. The weights are
trained from document labels through the noisy-or, so that the same model then
locates the offending sentences (``locate``).

Training takes a bounded sample: at most ``SAMPLE`` labelled rows of the training folds
(the smallest by a seeded hash of the id) of at most ``BAG_BYTES`` each. Scoring
covers every row and whole texts; a worker remembers weights of words in a
bounded memo.

Defined cases: null and empty texts have no sentences and score the noisy-or of
none, zero; a null id or label is not trained on, and a null id is in no held-out fold; repeated rows are scored each; an
empty table gives an empty result; if no label can be learnt from, every score is
zero; other columns are left out by ``score`` and kept by ``keep_rows``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .vocab import Memo

#: Labelled rows to learn from, and the longest of them in bytes.
SAMPLE, BAG_BYTES = 4000, 32 << 10
#: Features kept: those in the most telling words and n-grams.
FEATURES, LEAST_BAGS = 4000, 4
#: Standard deviations by which a feature's positive bags exceed the mean to be kept.
TELLING = 5
ROUNDS, RATE, DECAY, SHRINK = 300, 0.3, 2e-3, 5e-4
#: Share of the features that one round of training sees.
KEPT = 0.65
#: Lowest log-odds of a sentence without evidence.
LEAST_BIAS = -7.0
THRESHOLD = 0.7
FOLDS, HELD_OUT = 3, 1
MEMO = 100_000

_SENTENCE = re.compile(r"[.!?\n]+")
_WORD = re.compile(r"\w+")


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences of a text."""
    out, at = [], 0
    for m in _SENTENCE.finditer(text):
        if m.start() > at:
            out.append((at, m.start()))
        at = m.end()
    if at < len(text):
        out.append((at, len(text)))
    return out


def word_features(word: str) -> set[str]:
    """The word, and its character n-grams of 5 and 6 with the word's borders."""
    bound = f"<{word}>"
    return {f" {word}", *(bound[i : i + n] for n in (5, 6) for i in range(len(bound) - n + 1))}


class Model:
    """Weights of features and the bias of a sentence."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self.memo = Memo(self._weigh, MEMO)

    def __reduce__(self):
        return Model, (self.weights, self.bias)

    def _weigh(self, word: str) -> float:
        w = self.weights
        return sum(w[f] for f in word_features(word) if f in w)

    def sentence_logits(self, text: str) -> list[float]:
        low, memo, bias = text.lower(), self.memo, self.bias
        out = [bias + sum(map(memo.__getitem__, words)) for s in _SENTENCE.split(low) if (words := _WORD.findall(s))]
        memo.trim()
        return out

    def score(self, text: str) -> float:
        """The noisy-or of the sentences."""
        z = np.array(self.sentence_logits(text))
        # log(1 - p) = -log(1 + exp(z))
        return float(-np.expm1(-np.logaddexp(0, z).sum())) if len(z) else 0.0

    def locate(self, text: str, least: float = 0.5) -> list[tuple[int, int, float]]:
        """(start, end, probability) of the sentences at least ``least`` likely to be what makes the text toxic."""
        out = []
        for start, end in sentences(text):
            words = _WORD.findall(text[start:end].lower())
            p = 1 / (1 + np.exp(-(self.bias + sum(map(self.memo.__getitem__, words)))))
            if p >= least and words:
                out.append((start, end, float(p)))
        return out


def fit(bags: list[tuple[str, int]]) -> Model:
    """Weights from (text, label) by gradient descent on the likelihood of the noisy-or."""
    bags = [(t or "", y) for t, y in bags]
    total, positive = len(bags), sum(y for _, y in bags)
    if not 0 < positive < total:
        return Model({}, -60.0)
    # only what stands in several positive bags can tell them apart; all else is never stored
    split = [[words for s in _SENTENCE.split(text.lower()) if (words := _WORD.findall(s))] for text, _ in bags]
    hits: Counter = Counter()
    for found, (_, y) in zip(split, bags):
        if y:
            hits.update({f for w in {w for words in found for w in words} for f in word_features(w)})
    hits = Counter({f: n for f, n in hits.items() if n >= LEAST_BAGS})
    held: dict[str, tuple[str, ...]] = {}

    def candidates(word: str) -> tuple[str, ...]:
        got = held.get(word)
        if got is None:
            got = held[word] = tuple(f for f in word_features(word) if f in hits)
        return got

    seen: Counter = Counter()
    for found in split:
        seen.update({f for words in found for w in words for f in candidates(w)})
    # how far a feature's positive bags are above the share of positive bags, in standard deviations
    share = positive / total
    worth = {}
    for f, n in seen.items():
        z = (hits[f] - n * share) / (n * share * (1 - share)) ** 0.5
        if z > TELLING:
            worth[f] = z
    names = sorted(worth, key=lambda f: (-worth[f], f))[:FEATURES]
    index = {f: k for k, f in enumerate(names)}
    of_ids = {w: [index[f] for f in fs if f in index] for w, fs in held.items()}
    # sentences without any kept feature of a bag are alike: one entry with a multiplicity
    cols, rows, bag_of, times = [], [], [], []
    for k, found in enumerate(split):
        plain = 0
        for words in found:
            ids = [i for w in words for i in of_ids[w]]
            if ids:
                rows.extend([len(bag_of)] * len(ids))
                cols.extend(ids)
                bag_of.append(k)
                times.append(1.0)
            else:
                plain += 1
        bag_of.append(k)
        times.append(float(plain))
    cols, rows, bag_of, times = np.array(cols, np.int64), np.array(rows, np.int64), np.array(bag_of, np.int64), np.array(times)
    y = np.array([b for _, b in bags], float)
    n_s = len(bag_of)
    w, bias, rng = np.zeros(len(names)), -5.0, np.random.default_rng(9)
    m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for step in range(1, ROUNDS + 1):
        # a random part of the features at a time: each has to learn what others could explain as well
        on = rng.random(len(names)) < KEPT
        z = bias + np.bincount(rows, (w * on)[cols], n_s)
        p = 1 / (1 + np.exp(-z))
        lost = np.bincount(bag_of, times * np.logaddexp(0, z), total)  # -log(1 - P)
        P = -np.expm1(-lost)
        # d loss / d lost: positive bags pull their sentences up, negative ones push down
        pull = np.where(y == 1, -(1 - P) / np.maximum(P, 1e-9), 1.0)
        g_z = pull[bag_of] * times * p / total
        g = np.append(np.bincount(cols, g_z[rows], len(names)) * on + DECAY * w / 100, g_z.sum())
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        w -= move[:-1]
        bias = max(bias - move[-1], LEAST_BIAS)
        w = np.sign(w) * np.maximum(np.abs(w) - RATE * SHRINK, 0)  # small weights go
    return Model({f: float(x) for f, x in zip(names, w) if abs(x) > 1e-3}, float(bias))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> list[tuple[str, int]]:
    """The bounded sample: texts and labels of the training folds."""
    fold = F.crc32(F.col(id_col).cast("string")) % FOLDS
    chosen = (
        labels.select(F.col(id_col), F.col(label_col).cast("int").alias("__y"))
        .where(F.col(id_col).isNotNull() & F.col("__y").isin(0, 1) & (fold != HELD_OUT))
        .orderBy(F.xxhash64(id_col), id_col, "__y")
        .limit(SAMPLE)
    )
    texts = docs.select(F.col(id_col), common.text_of(text_col).alias("__text")).where(F.octet_length("__text") <= BAG_BYTES)
    # at most SAMPLE rows are broadcast; repeated ids are taken once
    got = texts.join(F.broadcast(chosen), id_col).groupBy(id_col).agg(F.min_by("__text", F.xxhash64("__text")).alias("t"), F.max("__y").alias("y"))
    return [(r["t"], r["y"]) for r in sorted(got.collect(), key=lambda r: r[id_col])]


def train(docs: DataFrame, labels: DataFrame, **columns: str) -> Model:
    return fit(training_rows(docs, labels, **columns))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, sentences: array of (start, end, probability) that locate it) of every row."""
    common.tune(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            scores, spans = [], []
            for t in common.texts(b.column(1)):
                p = m.score(t)
                scores.append(p)
                spans.append([{"start": s, "end": e, "p": q} for s, e, q in m.locate(t)] if p >= THRESHOLD else [])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array(spans, kind)], ["id", "score", "sentences"])

    got = docs.select(F.col(id_col).alias("id"), common.text_of(text_col).alias("text"))
    kind = got.schema["id"].dataType.simpleString()
    return got.mapInArrow(common.released(run), f"id {kind}, score double, sentences array<struct<start:int,end:int,p:double>>").withColumnRenamed("id", id_col)


def keep_rows(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, whole, whose score is below the threshold."""
    common.tune(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            yield b.filter(pa.array([m.score(t) < THRESHOLD for t in common.texts(b.column(at))], pa.bool_()))

    return docs.mapInArrow(common.released(run), docs.schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.load(spark, sf_dir, "documents")
    got = score(docs, train(docs, common.load(spark, sf_dir, "labels")))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT, F.lit(False))
    return got.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op9_toxicity": op9_toxicity}
