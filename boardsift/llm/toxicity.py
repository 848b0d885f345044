"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as the embedding of its hash bucket and the mean embedding of its grams of four and six bytes, so an unseen
form of a known word is still near it, and with how much more often the word and its grams occur in toxic texts.  These
log odds come from the labelled texts as well; for a text that is trained on they are taken from the other folds of the
sample, so the network learns how far to trust them.  A text is read in windows of ``WINDOW`` words, each starting
``STRIDE`` after the one before; every window is scored and the text's score is that of its worst window.  Training
sees document labels only: it starts from windows that hold the words and grams typical of toxic texts, and later picks
the windows that the network itself scores highest.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardsift.llm.common import arrow_batches, frugal, held_out, rows_where, text_slices
from boardsift.llm.labelled import MAX_ROWS, labelled_sample
from boardsift.llm.text import Words, bare_words

WINDOW, STRIDE = 64, 32
WORDS, GRAMS = 1 << 14, 1 << 15
#: Bytes of the grams.
SIZES = (4, 6)
#: Sizes of the embeddings, of the hidden state in each direction and of the attention.
EMBED, HIDDEN, ATTEND = 6, 8, 8
#: Inputs of a word: both embeddings, the log odds of the word, and the mean and largest of its grams'.
INPUT = 2 * EMBED + 3
#: Parts of the sample whose log odds come from the others, and share of a batch's word embeddings that are left out.
FOLDS, DROPPED = 5, 0.5
#: A document is toxic from this score on.
THRESHOLD = 0.5
#: Steps of each training round at least.
MIN_STEPS = 60
#: Distinct words whose grams are looked up at once.
AT_ONCE = 20_000
#: Windows scored at once.
CHUNK = 2048


class Lexicon(NamedTuple):
    """Distinct words of a batch: hash bucket, and buckets of the grams of word i at ``gram[edge[i]:edge[i + 1]]``."""

    word: np.ndarray
    gram: np.ndarray
    edge: np.ndarray


def lexicon(vocab: list[str], hashed: np.ndarray) -> Lexicon:
    """Grams run over the bytes of a word between two marks; a word too short for one has a gram of its own bytes."""
    parts = [_grams(vocab[i : i + AT_ONCE]) for i in range(0, len(vocab), AT_ONCE)]
    count = np.concatenate([n for _, n in parts]) if parts else np.empty(0, np.int64)
    bucket = np.concatenate([b for b, _ in parts]) if parts else np.empty(0, np.int32)
    return Lexicon((hashed % np.uint64(WORDS)).astype(np.int64), bucket, np.concatenate([[0], np.cumsum(count)]))


def _grams(vocab: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the grams of all words one after another, and how many each word has."""
    shown = [b"\x02" + x.encode() + b"\x03" for x in vocab]
    size = np.fromiter(map(len, shown), np.int64, len(shown))
    begin = np.cumsum(size) - size
    flat = np.frombuffer(b"".join(shown) + bytes(max(SIZES)), np.uint8)
    # where each gram starts, for each size in turn, word by word
    each = np.stack([np.maximum(size - n + 1, 1) for n in SIZES], 1)
    count = each.sum(1)
    edge = np.concatenate([[0], np.cumsum(count)])
    run = each.ravel()
    first = np.cumsum(run) - run
    place = np.repeat(np.repeat(begin, len(SIZES)) - first, run) + np.arange(edge[-1])
    width = np.repeat(np.tile(np.array(SIZES), len(size)), run)
    end = np.repeat(np.repeat(begin + size, len(SIZES)), run)
    code = np.zeros(len(place), np.uint64)
    for i in range(max(SIZES)):
        inside = (i < width) & (place + i < end)
        code = (code << np.uint64(8)) | np.where(inside, flat[np.minimum(place + i, len(flat) - 1)], 0).astype(np.uint64)
    code += width.astype(np.uint64) << np.uint64(56)
    return ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - GRAMS.bit_length() + 1)).astype(np.int32), count


def windows(offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where every window starts among all words, and its document; a document without words has none."""
    count = np.diff(offset)
    number = np.where(count > 0, np.maximum(1, -(-(count - WINDOW) // STRIDE) + 1), 0)
    doc = np.repeat(np.arange(len(count)), number)
    place = np.arange(len(doc)) - np.concatenate([[0], np.cumsum(number)])[:-1][doc]
    return offset[:-1][doc] + place * STRIDE, doc


def window_words(code: np.ndarray, offset: np.ndarray, start: np.ndarray, doc: np.ndarray, blank: int) -> np.ndarray:
    """Words of each window, ``blank`` beyond the end of its document."""
    at = start[:, None] + np.arange(WINDOW)[None, :]
    return np.where(at < offset[1:][doc][:, None], code[np.minimum(at, max(0, len(code) - 1))], blank)


def _sums(index: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """Rows added up by their index."""
    return np.stack([np.bincount(index, rows[:, j], size) for j in range(rows.shape[1])], 1).astype(np.float32)


class Network:
    def __init__(self, seed: int = 11):
        random = np.random.default_rng(seed)
        normal = lambda *shape: (random.normal(0, shape[0] ** -0.5, shape)).astype(np.float32)
        self.p = {name: random.normal(0, 0.1, (size, EMBED)).astype(np.float32) for name, size in (("word", WORDS), ("gram", GRAMS))}
        self.odds = np.zeros(WORDS, np.float32), np.zeros(GRAMS, np.float32)
        for side in "fb":
            self.p |= {f"W{side}": normal(INPUT, 3 * HIDDEN), f"U{side}": normal(HIDDEN, 3 * HIDDEN), f"c{side}": np.zeros(3 * HIDDEN, np.float32)}
        self.p |= {"A": normal(2 * HIDDEN, ATTEND), "a0": np.zeros(ATTEND, np.float32), "av": normal(ATTEND), "w": normal(2 * HIDDEN), "b": np.zeros(1, np.float32)}
        self.prior: float | None = None
        #: What is added to the logit of a text: the labels are not sampled at their shares.
        self.shift = 0.0

    def features(self, lex: Lexicon, odds: tuple[np.ndarray, np.ndarray] | None = None, kept: np.ndarray | None = None) -> np.ndarray:
        """Inputs of every distinct word, and of the blank after them; ``kept`` scales words' embeddings."""
        of_word, of_gram = odds or self.odds
        out = np.zeros((len(lex.word) + 1, INPUT), np.float32)
        out[:-1, :EMBED] = self.p["word"][lex.word]
        if kept is not None:
            out[:-1, :EMBED] *= kept[:, None]
        out[:-1, 2 * EMBED] = of_word[lex.word]
        for a in range(0, len(lex.word), AT_ONCE):
            edge = lex.edge[a : a + AT_ONCE + 1]
            rows, size = slice(a, a + len(edge) - 1), np.diff(edge)
            gram, start = lex.gram[edge[0] : edge[-1]], edge[:-1] - edge[0]
            odds_of = of_gram[gram]
            out[rows, EMBED : 2 * EMBED] = np.add.reduceat(self.p["gram"][gram], start, axis=0) / size[:, None]
            out[rows, 2 * EMBED + 1] = np.add.reduceat(odds_of, start) / size
            out[rows, 2 * EMBED + 2] = np.maximum.reduceat(odds_of, start)
        return out

    def _run(self, side: str, gates: np.ndarray, index: np.ndarray, keep: list | None) -> np.ndarray:
        """Hidden states (windows, words, HIDDEN) of one direction; gates: input part of the gates by word."""
        size, n = len(index), HIDDEN
        out = np.empty((size, WINDOW, n), np.float32)
        h = np.zeros((size, n), np.float32)
        for t in range(WINDOW) if side == "f" else range(WINDOW - 1, -1, -1):
            g = gates[index[:, t]]
            u = h @ self.p[f"U{side}"]
            s = np.tanh(0.5 * (g[:, : 2 * n] + u[:, : 2 * n]))
            s *= 0.5
            s += 0.5
            z, r = s[:, :n], s[:, n:]
            new = np.tanh(g[:, 2 * n :] + r * u[:, 2 * n :])
            if keep is not None:
                keep.append((t, h, z, r, new, u[:, 2 * n :]))
            h = new + z * (h - new)
            out[:, t] = h
        return out

    def forward(self, feature: np.ndarray, index: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows of words, given as rows of ``feature``; the last row is the blank."""
        states = []
        for side in "fb":
            steps: list | None = None if keep is None else []
            states.append(self._run(side, feature @ self.p[f"W{side}"] + self.p[f"c{side}"], index, steps))
            if keep is not None:
                keep[side] = steps
        h = np.concatenate(states, 2)
        s = np.tanh(h @ self.p["A"] + self.p["a0"])
        e = np.where(index == len(feature) - 1, np.float32(-1e9), s @ self.p["av"])
        e = np.exp(e - e.max(1, keepdims=True))
        weight = e / e.sum(1, keepdims=True)
        c = (weight[:, :, None] * h).sum(1)
        if keep is not None:
            keep |= {"h": h, "s": s, "weight": weight, "c": c}
        return c @ self.p["w"] + self.p["b"]

    def gradients(self, lex: Lexicon, index: np.ndarray, target: np.ndarray, odds: tuple[np.ndarray, np.ndarray] | None = None, kept: np.ndarray | None = None) -> dict[str, np.ndarray]:
        keep: dict = {}
        feature, p, n = self.features(lex, odds, kept), self.p, HIDDEN
        logit = self.forward(feature, index, keep)
        d = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - target)[:, None].astype(np.float32) / len(target)
        h, s, weight = keep["h"], keep["s"], keep["weight"]
        grad = {"w": (d * keep["c"]).sum(0), "b": d.sum(0)}
        dc = d * p["w"]
        dweight = np.einsum("btk,bk->bt", h, dc)
        dh = weight[:, :, None] * dc[:, None, :]
        de = weight * (dweight - (weight * dweight).sum(1, keepdims=True))
        grad["av"] = np.einsum("bt,bta->a", de, s)
        ds = de[:, :, None] * p["av"] * (1 - s * s)
        grad["A"], grad["a0"] = np.einsum("btk,bta->ka", h, ds), ds.sum((0, 1))
        dh += ds @ p["A"].T
        dx = np.zeros((*index.shape, INPUT), np.float32)
        x = feature[index]
        for side, own in (("f", dh[:, :, :n]), ("b", dh[:, :, n:])):
            U, W = p[f"U{side}"], p[f"W{side}"]
            dU, dW, dc0, back = np.zeros_like(U), np.zeros_like(W), np.zeros(3 * n, np.float32), np.zeros((len(index), n), np.float32)
            for t, before, z, r, new, un in reversed(keep[side]):
                g = own[:, t] + back
                dn = g * (1 - z) * (1 - new * new)
                dz = g * (before - new) * z * (1 - z)
                dr = dn * un * r * (1 - r)
                dgate, du = np.concatenate([dz, dr, dn], 1), np.concatenate([dz, dr, dn * r], 1)
                back = g * z + du @ U.T
                dU += before.T @ du
                dW += x[:, t].T @ dgate
                dc0 += dgate.sum(0)
                dx[:, t] += dgate @ W.T
            grad |= {f"U{side}": dU, f"W{side}": dW, f"c{side}": dc0}
        by_word = _sums(index.ravel(), dx.reshape(-1, INPUT), len(feature))[:-1]
        if kept is not None:
            by_word[:, :EMBED] *= kept[:, None]
        grad["word"] = _sums(lex.word, by_word[:, :EMBED], WORDS)
        size = np.diff(lex.edge)
        grad["gram"] = _sums(lex.gram, np.repeat(by_word[:, EMBED : 2 * EMBED] / size[:, None], size, axis=0), GRAMS)
        return grad

    def logits(self, feature: np.ndarray, index: np.ndarray) -> np.ndarray:
        return np.concatenate([self.forward(feature, index[i : i + CHUNK]) for i in range(0, len(index), CHUNK)]) if len(index) else np.empty(0, np.float32)

    def probability(self, column: pa.Array) -> np.ndarray:
        """Score of every text: that of its worst window; a text without words has the score of a blank one, 0."""
        words, hashed = bare_words(column)
        n = len(words.offset) - 1
        if self.prior is not None:
            return np.full(n, self.prior)
        used = np.unique(words.code)
        lex = lexicon(_plain(words.vocab.take(pa.array(used)).to_pylist()), hashed[used])
        code = np.searchsorted(used, words.code)
        start, doc = windows(words.offset)
        feature = self.features(lex)
        gates_index = window_words(code, words.offset, start, doc, len(used))
        logit = self.logits(feature, gates_index)
        worst = np.full(n, -30.0)
        np.maximum.at(worst, doc, logit)
        return np.where(np.diff(words.offset) > 0, 1 / (1 + np.exp(-np.clip(worst + self.shift, -30, 30))), 0.0)


def _plain(vocab: list[str]) -> list[str]:
    return [x.lower().strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") for x in vocab]


def _occurrences(words: Words, lex: Lexicon, label: np.ndarray, fold: np.ndarray, grams: bool) -> np.ndarray:
    """(folds, 2, buckets): in how many documents of each fold and label a bucket of words or grams occurs; counted
    over a few documents at once."""
    size = GRAMS if grams else WORDS
    counts = np.zeros((FOLDS, 2, size))
    for low in range(0, len(label), 200):
        edge = words.offset[low : low + 201]
        seen = np.unique(np.repeat(np.arange(len(edge) - 1), np.diff(edge)) * len(lex.word) + words.code[edge[0] : edge[-1]])
        doc, word = seen // max(1, len(lex.word)), seen % max(1, len(lex.word))
        if grams:
            count = np.diff(lex.edge)[word]
            at = np.repeat(lex.edge[:-1][word] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            ids, doc = lex.gram[at], np.repeat(doc, count)
        else:
            ids = lex.word[word]
        pair = np.unique(doc * size + ids)
        np.add.at(counts, (fold[low + pair // size], label[low + pair // size], pair % size), 1)
    return counts


def _log_odds(counts: np.ndarray, label: np.ndarray) -> np.ndarray:
    """How much more often a bucket occurs in toxic documents, as a smoothed log ratio of document shares; 0 where it
    is rare."""
    n1, n0 = max(1, label.sum()), max(1, (label == 0).sum())
    b, a = counts
    odds = (np.log((a + 2.0) / (n1 + 4.0)) - np.log((b + 2.0 * n0 / n1) / (n0 + 4.0 * n0 / n1))) * (a + b * n1 / n0 >= 3)
    return np.clip(odds, -3, 3).astype(np.float32)


def train(texts: list[str] | pa.Array, label: np.ndarray, rounds: int = 3, epochs: int = 4, seed: int = 5) -> Network:
    network = Network()
    if not 0 < label.sum() < len(label):
        network.prior = float((label.sum() + 1) / (len(label) + 2)) if len(label) else 0.0
        return network
    random = np.random.default_rng(seed)
    words, hashed = bare_words(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
    lex = lexicon(_plain(words.vocab.to_pylist()), hashed)
    fold = random.permutation(len(label)) % FOLDS
    counts = [_occurrences(words, lex, label, fold, grams) for grams in (False, True)]
    network.odds = tuple(_log_odds(c.sum(0), label) for c in counts)
    others = [tuple(_log_odds(c.sum(0) - c[k], label[fold != k]) for c in counts) for k in range(FOLDS)]
    start, owner = windows(words.offset)
    index = window_words(words.code.astype(np.int32), words.offset, start, owner, len(lex.word)).astype(np.int32)

    def by_fold(score) -> np.ndarray:
        out = np.empty(len(index), np.float32)
        for k in range(FOLDS):
            at = np.flatnonzero(fold[owner] == k)
            out[at] = score(network.features(lex, others[k]), index[at])
        return out

    def strongest(feature: np.ndarray, part: np.ndarray) -> np.ndarray:
        strength = feature[:, [2 * EMBED, 2 * EMBED + 2]].sum(1)
        return np.concatenate([strength[x].sum(1) for x in np.array_split(part, len(part) // 20_000 + 1)])

    value = by_fold(strongest)
    names = list(network.p)
    first, second = ({k: np.zeros_like(network.p[k]) for k in names} for _ in range(2))
    step = 0
    for turn in range(rounds):
        # the worst window of every document, and of clean ones as many at random
        order = np.lexsort((-value, owner))
        lead = order[np.concatenate([[True], owner[order][1:] != owner[order][:-1]])] if len(order) else order
        other = np.flatnonzero(label[owner] == 0)
        picked = np.concatenate([lead, random.choice(other, min(len(other), len(lead)), replace=False)])
        # small samples are read more often, so that every training takes MIN_STEPS steps a round at least
        passes = max(epochs, -(-MIN_STEPS // -(-len(picked) // 128)))
        for epoch in range(passes):
            rate = 8e-3 * (1 - (turn + epoch / passes) / rounds) + 5e-4
            batches = []
            for k in range(FOLDS):
                mixed = random.permutation(picked[fold[owner[picked]] == k])
                batches += [(k, mixed[i : i + 128]) for i in range(0, len(mixed), 128)]
            for k, batch in (batches[i] for i in random.permutation(len(batches))):
                used, inner = np.unique(index[batch], return_inverse=True)
                inner = inner.reshape(-1, WINDOW)
                if used[-1] != len(lex.word):
                    used = np.append(used, len(lex.word))
                own = used[:-1]
                count = np.diff(lex.edge)[own]
                edge = np.concatenate([[0], np.cumsum(count)])
                part = Lexicon(lex.word[own], lex.gram[np.repeat(lex.edge[:-1][own] - edge[:-1], count) + np.arange(edge[-1])], edge)
                kept = (random.random(len(own)) >= DROPPED).astype(np.float32) / (1 - DROPPED)
                grad = network.gradients(part, inner, label[owner[batch]], others[k], kept)
                step += 1
                for name in names:
                    first[name] += 0.1 * (grad[name] - first[name])
                    second[name] += 0.01 * (grad[name] ** 2 - second[name])
                    network.p[name] -= (rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        if turn + 1 < rounds:
            value = by_fold(network.logits)
    return network


def _score(network):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, limit=2 << 20):
            score = network.value.probability(batch.column("text")).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return frugal(work)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Network:
    """A network from a bounded sample of labelled documents."""
    sample, shift = labelled_sample(docs, labels, "toxic", max_rows)
    rows = sample.select("doc_id", "text", "label").toArrow().sort_by("doc_id")  # bounded by the sample
    network = train(rows.column("text").combine_chunks(), rows.column("label").to_numpy().astype(np.int64))
    network.shift = shift
    return network


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score every whole text of ``docs`` (doc_id, text, ...) for toxicity, learned from ``labels`` (doc_id, toxic).

    Returns doc_id, held_out, score, predicted, one row per input row.  Only words are inputs of a score; null, empty
    and wordless texts score 0.  Without labels of both kinds every score is the labels' share.  Repeated rows are
    scored alike, other columns are ignored, and an empty table gives an empty result.
    """
    network = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = arrow_batches(plain).mapInArrow(_score(network), "doc_id long, score double, predicted int")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents that the network rejects; all columns stay, whatever their names.

    Null, empty and wordless texts stay, repeated rows fare alike, and an empty table gives an empty one.  Without
    labels of both kinds nothing is known about toxic texts, and every document stays."""
    network = fit(docs, labels)
    if network.prior is not None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(network)
    return arrow_batches(docs).mapInArrow(rows_where(lambda column: shared.value.probability(column) < THRESHOLD), docs.schema)
