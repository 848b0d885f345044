"""Quality classifier on random-indexing word vectors.

Every word has a fixed sparse random index vector; a word's vector is the sum of the index vectors of the words around
it, over all documents.  Words are hashed to a fixed number of buckets, so the table of vectors has a fixed size.  A
text is pooled into the mean and the spread of its words' vectors, and the same of its words' forms (case, digits,
punctuation), which have vectors of their own.  A two-layer network in numpy scores the pooled vector, and a
temperature fitted on rows apart from the training rows calibrates its probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardsift.llm.common import arrow_batches, frugal, held_out, rows_where, text_slices
from boardsift.llm.labelled import MAX_ROWS, labelled_sample
from boardsift.llm.ragged import offsets
from boardsift.llm.text import Words, bare, hashes, split_words
from boardsift.llm.treesum import partial_rows, tree_sum

#: Buckets of words, and of word forms after them.
WORDS, FORMS = 1 << 15, 1 << 10
DIMENSIONS = 32
#: Words on each side that count as context.
REACH = 2
HIDDEN = 32
#: Words whose vectors are gathered at once.
POOLED = 100_000
#: A document is good from this score on.
THRESHOLD = 0.3
_BLOCKS = 33


@lru_cache(maxsize=1)
def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Where each bucket's index vector has its 1 and its -1."""
    random = np.random.default_rng(20_01)
    plus = random.integers(0, DIMENSIONS, WORDS + FORMS)
    return plus, (plus + random.integers(1, DIMENSIONS, WORDS + FORMS)) % DIMENSIONS


_UPPER, _LOWER, _DIGIT, _RUN = regex.compile(r"\p{Lu}+"), regex.compile(r"[^\P{L}\p{Lu}]+"), regex.compile(r"\p{N}+"), regex.compile(r"([^\p{L}\p{N}\n])\1+")


def _forms(vocab: list[str]) -> list[str]:
    """Tz!! -> Xx!: letters by case, digits as 9, runs as one character; all words at once."""
    text = "\n".join(vocab)
    if text.count("\n") != len(vocab) - 1:
        text = "\n".join(x.replace("\n", " ") for x in vocab)
    return _RUN.sub(r"\1", _UPPER.sub("X", _LOWER.sub("x", _DIGIT.sub("9", text)))).split("\n")


def _buckets(words: Words) -> np.ndarray:
    """Two rows of buckets per word of a batch: the bare word and its form."""
    word = (hashes(bare(words.vocab)) % np.uint64(WORDS)).astype(np.int64)
    forms = pa.array(_forms(words.vocab.to_pylist()), pa.string()).dictionary_encode() if len(words.vocab) else pa.array([], pa.string()).dictionary_encode()
    form = WORDS + (hashes(forms.dictionary) % np.uint64(FORMS)).astype(np.int64)
    return np.stack([word, form[forms.indices.to_numpy()]])[:, words.code]


def _accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    plus, minus = index_vectors()
    size = (WORDS + FORMS) * DIMENSIONS
    total = np.zeros(size, np.int64)
    for batch in text_slices(batches, limit=2 << 20):
        words = split_words(batch.column("text"))
        doc = words.doc
        for bucket in _buckets(words):
            for step in range(1, REACH + 1):
                near = doc[step:] == doc[:-step]
                left, right = bucket[:-step][near], bucket[step:][near]
                for a, b in ((left, right), (right, left)):
                    total += np.bincount(a * DIMENSIONS + plus[b], minlength=size) - np.bincount(a * DIMENSIONS + minus[b], minlength=size)
    yield partial_rows(total.astype(np.float32), _BLOCKS)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Vectors of all buckets, of length 1 (0 where a bucket has no context), from every document."""
    rows = arrow_batches(docs).select(docs["text"].cast("string").alias("text"))
    total = tree_sum(rows, _accumulate, (WORDS + FORMS) * DIMENSIONS, _BLOCKS, "float32", "vectors").reshape(-1, DIMENSIONS)
    # what all words share says nothing about one of them
    norm = np.linalg.norm(total, axis=1, keepdims=True)
    unit = total / np.maximum(norm, 1e-9)
    common = np.concatenate([np.tile(part.sum(0) / max(1, (np.abs(part).sum(1) > 0).sum()), (len(part), 1)) for part in (unit[:WORDS], unit[WORDS:])])
    unit = np.where(norm > 0, unit - common, 0)
    return (unit / np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the vectors of each text's words and forms; zeros for a text without words."""
    words = split_words(column)
    n = len(words.offset) - 1
    out = np.zeros((n, 4 * DIMENSIONS + 3), np.float32)
    count = np.diff(words.offset)
    full = np.flatnonzero(count)
    if not len(full):
        return out
    start = words.offset[:-1][full]
    both = _buckets(words)
    # vectors of so many words at once
    block = np.searchsorted(start, np.arange(0, words.offset[-1] + POOLED, POOLED))
    for a, z in zip(block, block[1:], strict=False):
        if a == z:
            continue
        rows, size = full[a:z], count[full[a:z]][:, None]
        end = words.offset[rows[-1] + 1]
        for i in range(2):
            vector = vectors[both[i, start[a] : end]]
            mean = np.add.reduceat(vector, start[a:z] - start[a], axis=0) / size
            np.square(vector, out=vector)
            square = np.add.reduceat(vector, start[a:z] - start[a], axis=0) / size
            out[rows, 2 * i * DIMENSIONS : (2 * i + 1) * DIMENSIONS] = mean
            out[rows, (2 * i + 1) * DIMENSIONS : (2 * i + 2) * DIMENSIONS] = np.sqrt(np.maximum(square - mean * mean, 0))
            out[rows, 4 * DIMENSIONS + i] = np.linalg.norm(mean, axis=1)
    # how near each word's vector is to the next one's: 1 where a text repeats a word over and over
    bucket = both[0]
    same = np.append((bucket[1:] == bucket[:-1]) & (words.doc[1:] == words.doc[:-1]), False)
    out[full, 4 * DIMENSIONS + 2] = np.add.reduceat(same.astype(np.float32), start) / count[full]
    return out


def _pool(vectors):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, limit=2 << 20):
            found = pooled(batch.column("text"), vectors.value)
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([x.tobytes() for x in found], pa.binary())], names=["label", "x"])

    return work


class Network:
    """Two layers, tanh between them, one logit; trained by Adam, calibrated by a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, epochs: int = 60, seed: int = 7):
        random = np.random.default_rng(seed)
        order = random.permutation(len(y))
        x, y = x[order].astype(np.float64), y[order].astype(np.float64)
        self.prior = (y.sum() + 1) / (len(y) + 2)
        self.trained = len(y) >= 10 and 0 < y.sum() < len(y)
        self.mean, self.scale = x.mean(0) if len(y) else 0.0, x.std(0) + 1e-3 if len(y) else 1.0
        if not self.trained:
            return
        x = (x - self.mean) / self.scale
        fit = max(1, len(y) * 4 // 5)
        weights = [random.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), random.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
        step = 0
        for epoch in range(epochs):
            rate = 3e-3 * (1 - epoch / epochs)
            turn = random.permutation(fit)
            for pick in (turn[i : i + 64] for i in range(0, fit, 64)):
                step += 1
                a, t = x[pick], y[pick]
                h = np.tanh(a @ weights[0] + weights[1])
                p = 1 / (1 + np.exp(-np.clip(h @ weights[2] + weights[3], -30, 30)))
                d = (p - t) / len(pick)
                dh = d[:, None] * weights[2] * (1 - h * h)
                grads = [a.T @ dh + 1e-4 * weights[0], dh.sum(0), h.T @ d + 1e-4 * weights[2], d.sum(keepdims=True)]
                for w, g, m, v in zip(weights, grads, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        self.weights = weights
        logit, target = self._logit(x[fit:]), y[fit:]
        loss = lambda t: np.logaddexp(0, -(2 * target - 1) * logit / t).mean() if len(target) else 0.0
        self.temperature = min(np.geomspace(0.25, 8, 61), key=lambda t: (loss(t), abs(np.log(t))))

    def _logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.weights[0] + self.weights[1]) @ self.weights[2] + self.weights[3]

    def probability(self, x: np.ndarray, shift: float = 0.0) -> np.ndarray:
        if not self.trained:
            return np.full(len(x), self.prior)
        logit = self._logit((x - self.mean) / self.scale) / self.temperature + shift
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def _score(vectors, network: Network, shift: float):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, limit=2 << 20):
            score = network.probability(pooled(batch.column("text"), vectors.value), shift)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return frugal(work)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS):
    """Word vectors from all documents, a network from a bounded sample of labelled ones, and the shift of its logits."""
    spark = docs.sparkSession
    vectors = spark.sparkContext.broadcast(word_vectors(docs))
    sample, shift = labelled_sample(docs, labels, "quality", max_rows)
    rows = arrow_batches(sample.select("label", "text")).mapInArrow(_pool(vectors), "label int, x binary").collect()  # bounded by the sample
    x = np.array([np.frombuffer(r["x"], np.float32) for r in rows]).reshape(len(rows), 4 * DIMENSIONS + 3)
    return vectors, Network(x, np.array([r["label"] for r in rows], np.int64)), shift


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score every whole text of ``docs`` (doc_id, text, ...) for quality, learned from ``labels`` (doc_id, quality).

    Returns doc_id, held_out, score, predicted, one row per input row.  Only words are inputs of a score; null and
    empty texts are scored as texts without words.  Without labels of both kinds every score is the labels' share.
    Repeated rows are scored alike, other columns are ignored, and an empty table gives an empty result.
    """
    vectors, network, shift = fit(docs, labels)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = arrow_batches(plain).mapInArrow(_score(vectors, network, shift), "doc_id long, score double, predicted int")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def drop_low_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents that the classifier rejects; all columns stay, whatever their names.

    Null and empty texts are scored as texts without words, repeated rows fare alike, and an empty table gives an
    empty one.  Without labels of both kinds nothing is known about bad texts, and every document stays."""
    vectors, network, shift = fit(docs, labels)
    if not network.trained:
        return docs
    return arrow_batches(docs).mapInArrow(rows_where(lambda column: network.probability(pooled(column, vectors.value), shift) >= THRESHOLD), docs.schema)
