"""Byte-level BPE in numpy.

The distinct pre-tokens of a batch are laid out as padded matrices, one per length class.  In each round every row
merges its leftmost pair of minimum rank: ranks of adjacent pairs come from a hash table of all mergeable pairs, the
row is compacted in place, and only the two pairs beside the merge are looked up again.  A pre-token of over
``LONG`` bytes is merged alone, all occurrences of its minimum pair at once, which gives the same ids unless the merged
token is part of a token of lower rank (known from the table; then one occurrence at a time).
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from boardsift.llm.common import arrow_batches, frugal, text_slices
from boardsift.llm.ragged import PieceCache, gather, offsets

#: Pre-tokens up to so many bytes go into matrices.
LONG = 256
#: Text bytes encoded at once in a task.
SLICE = 4 << 20
_NONE = np.int32(2**31 - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """(left id, right id) -> id of the merged token, by open addressing."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(len(merged) * 3).bit_length())
        self.key = np.full(1 << self.bits, -1, np.int64)
        self.value = np.full(1 << self.bits, _NONE, np.int32)
        key = (left.astype(np.int64) << 32) | right.astype(np.int64)
        slot, todo, self.probes = self._slot(key), np.arange(len(key)), 0
        while len(todo):
            at = (slot[todo] + self.probes) & ((1 << self.bits) - 1)
            free = np.flatnonzero(self.key[at] < 0)
            _, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.key[at[put]], self.value[at[put]] = key[todo[put]], merged[todo[put]]
            todo = np.delete(todo, put)
            self.probes += 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; padding (-1) and pairs that don't merge give the largest number."""
        key = (left.astype(np.int64) << 32) | (right.astype(np.int64) & 0xFFFFFFFF)
        slot = self._slot(key)
        out = np.full(key.shape, _NONE, np.int32)
        found = self.key[slot]
        hit = found == key
        out[hit] = self.value[slot[hit]]
        open_ = np.flatnonzero(~hit.ravel() & (found.ravel() >= 0) & (left.ravel() >= 0) & (right.ravel() >= 0))
        flat, slots, keys = out.ravel(), slot.ravel(), key.ravel()
        for step in range(1, self.probes):
            if not len(open_):
                break
            at = (slots[open_] + step) & ((1 << self.bits) - 1)
            found = self.key[at]
            hit = found == keys[open_]
            flat[open_[hit]] = self.value[at[hit]]
            open_ = open_[~hit & (found >= 0)]
        return flat.reshape(key.shape)


class ByteBpe:
    """Encoder and decoder for one rank file."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pattern = regex.compile(pattern)
        size = max(ranks.values()) + 1
        token = [b""] * size
        for piece, rank in ranks.items():
            token[rank] = piece
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        left, right, merged = (np.array(x, np.int32) for x in zip(*pairs, strict=True))
        self.single = np.zeros(size, bool)
        for part in (left, right):
            self.single[part[part >= merged]] = True
        self.pairs = PairTable(left, right, merged)
        self.token_length = np.array([len(t) for t in token], np.int64)
        self.token_bytes = np.frombuffer(b"".join(token), np.uint8)
        self.token_start = offsets(self.token_length)[:-1]
        decimal = [b"%d " % i for i in range(size)]
        self.decimal_length = np.array([len(t) for t in decimal], np.int64)
        self.decimal_bytes = np.frombuffer(b"".join(decimal), np.uint8)
        self.decimal_start = offsets(self.decimal_length)[:-1]
        self.cache = PieceCache(self.encode_strings)

    def merge_matrix(self, ids: np.ndarray) -> np.ndarray:
        """Merge every row of a matrix padded with -1 on the right until no pair of it has a rank."""
        ids = ids.copy()
        if ids.shape[1] < 2:
            return ids
        out, row = ids.copy(), np.arange(len(ids))
        rank = self.pairs.rank(ids[:, :-1], ids[:, 1:])
        while True:
            at = rank.argmin(1)
            here = np.arange(len(ids))
            best = rank[here, at]
            live = best != _NONE
            if not live.all():
                done = ~live
                out[row[done]] = -1
                out[row[done], : ids.shape[1]] = ids[done]
                ids, rank, row, at, best = ids[live], rank[live], row[live], at[live], best[live]
                if not len(ids):
                    return out
                width = int((ids >= 0).sum(1).max())
                ids, rank, here = ids[:, :width], rank[:, : width - 1], np.arange(len(ids))
            ids[here, at] = best
            # what stands after the merged pair moves one to the left
            shift = np.arange(ids.shape[1])[None, :]
            shift = np.minimum(shift + (shift > at[:, None]), ids.shape[1] - 1)
            ids = np.take_along_axis(ids, shift, 1)
            ids[:, -1] = -1
            rank = np.take_along_axis(rank, np.minimum(shift[:, :-1], rank.shape[1] - 1), 1)
            rank[:, -1] = _NONE
            inner = np.minimum(at, rank.shape[1] - 1)
            rank[here, inner] = np.where(at < rank.shape[1], self.pairs.rank(ids[here, inner], ids[here, np.minimum(inner + 1, ids.shape[1] - 1)]), rank[here, inner])
            before = np.maximum(at - 1, 0)
            rank[here, before] = np.where(at > 0, self.pairs.rank(ids[here, before], ids[here, at]), rank[here, before])

    def merge_long(self, ids: np.ndarray) -> np.ndarray:
        """The same for one long sequence, merging all occurrences of the minimum pair at once."""
        while len(ids) > 1:
            rank = self.pairs.rank(ids[:-1], ids[1:])
            best = rank.min()
            if best == _NONE:
                break
            at = np.flatnonzero(rank == best)
            if self.single[best]:
                at = at[:1]
            # in a run of overlapping pairs every second one merges, from the left
            run = np.concatenate([[0], np.cumsum(np.diff(at) != 1)])
            first = np.searchsorted(run, run)
            at = at[(np.arange(len(at)) - first) % 2 == 0]
            ids = ids.copy()
            ids[at] = best
            ids = np.delete(ids, at + 1)
        return ids

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after another, and how many each has."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        flat, start = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)], offsets(size)[:-1]
        count, parts, places = size.copy(), [], []
        low = 1
        while low < LONG:
            rows = np.flatnonzero((size > low) & (size <= 2 * low)) if low > 1 else np.flatnonzero((size >= 1) & (size <= 2))
            width = 2 * low
            low = width
            for piece in (rows[i : i + 65536] for i in range(0, len(rows), 65536)):
                column = np.arange(width)[None, :]
                inside = column < size[piece][:, None]
                matrix = np.where(inside, flat[np.minimum(start[piece][:, None] + column, len(flat) - 1)], -1)
                merged = self.merge_matrix(matrix)
                there = merged >= 0
                count[piece] = there.sum(1)
                parts.append(merged[there])
                places.append(piece)
        for i in np.flatnonzero(size > LONG):
            merged = self.merge_long(flat[start[i] : start[i] + size[i]])
            count[i] = len(merged)
            parts.append(merged)
            places.append(np.array([i]))
        if not parts:
            return np.empty(0, np.int32), count
        order = np.concatenate(places)
        ids, done = np.concatenate(parts), count[order]
        begin = np.empty(len(pieces), np.int64)
        begin[order] = offsets(done)[:-1]
        begin[size == 0] = 0
        return gather(ids, begin, count), count

    def encode_strings(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each has: every distinct pre-token is merged once."""
        place: dict[str, int] = {}
        code, held = [], np.empty(len(texts), np.int64)
        for i, text in enumerate(texts):
            found = self.pattern.findall(text)
            held[i] = len(found)
            code.extend([place.setdefault(x, len(place)) for x in found])
        ids, count = self.encode_pieces([x.encode() for x in place])
        pick = np.array(code, np.int64)
        out = gather(ids, offsets(count)[:-1][pick], count[pick])
        per_text = np.diff(offsets(count[pick])[offsets(held)])
        return out, per_text

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a text column and their number per row; null counts as empty.

        A text is cut before its single spaces, so that each distinct chunk is split by the pattern once.  A cut is
        sound where what follows the space is no white space; texts with other cuts are split whole.
        """
        column = pc.fill_null(column.cast(pa.large_string()), "")
        chunks = pc.split_pattern(column, " ")
        encoded = chunks.values.dictionary_encode()
        code, offset = encoded.indices.to_numpy().astype(np.int64), chunks.offsets.to_numpy().astype(np.int64)
        vocab = encoded.dictionary.to_pylist()
        unsound = np.fromiter((not x or x[0].isspace() for x in vocab), bool, len(vocab))
        n = len(column)
        doc = np.repeat(np.arange(n), np.diff(offset))
        first = offset[:-1]
        bad_chunk = unsound[code]
        bad_chunk[first] = False
        whole = np.bincount(doc[bad_chunk], minlength=n) > 0
        keep = ~whole[doc]
        # a text's first chunk has no space before it, so it is a string of its own
        firsts = first[~whole]
        first_words = encoded.indices.take(pa.array(firsts)).to_numpy()
        used = np.zeros(len(vocab), bool)
        keep[firsts] = False
        used[code[keep]] = True
        keep[firsts] = True
        spaced = np.flatnonzero(used)
        unit = np.cumsum(used) - 1
        starts, first_unit = np.unique(first_words, return_inverse=True)
        code = unit[code]
        code[firsts] = len(spaced) + first_unit
        strings = [" " + vocab[i] for i in spaced.tolist()]
        have = dict.fromkeys(strings)
        plain = [vocab[i] for i in starts.tolist()]
        # a first chunk may equal a chunk with its space: both are one string of the cache
        extra = [x for x in plain if x not in have]
        place = {x: i for i, x in enumerate(strings + extra)}
        code[firsts] = np.array([place[x] for x in plain], np.int64)[first_unit] if plain else code[firsts]
        flat, start, count = self.cache.look_up(strings + extra)
        unit, owner = code[keep], doc[keep]
        out = gather(flat, start[unit], count[unit])
        per_row = np.bincount(owner, weights=count[unit], minlength=n).astype(np.int64)
        rows = np.flatnonzero(whole)
        if not len(rows):
            return out, per_row
        other, held = self.encode_strings(column.take(pa.array(rows)).to_pylist())
        begin = offsets(per_row)[:-1]
        begin[rows], per_row[rows] = len(out) + offsets(held)[:-1], held
        return gather(np.concatenate([out, other]), begin, per_row), per_row

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of a sequence of ids."""
        return gather(self.token_bytes, self.token_start[ids], self.token_length[ids])


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


def _digests(path: str, pattern: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for batch in text_slices(batches, limit=SLICE):
            ids, count = bpe.encode_column(batch.column("text"))
            edge = offsets(count)
            decimal = gather(bpe.decimal_bytes, bpe.decimal_start[ids], bpe.decimal_length[ids]).tobytes()
            at = offsets(bpe.decimal_length[ids])[edge]
            ids_sha = [hashlib.sha256(decimal[a : b - 1] if b > a else b"").hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            decoded = bpe.decode(ids).tobytes()
            at = offsets(bpe.token_length[ids])[edge]
            text_sha = [hashlib.sha256(decoded[a:b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(count), pa.array(ids_sha), pa.array(text_sha)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return frugal(work)


def _encode(path: str, pattern: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for batch in text_slices(batches, limit=SLICE):
            ids, count = bpe.encode_column(batch.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(offsets(count).astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], names=["doc_id", "ids"])

    return work


def _decode(path: str, pattern: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for batch in batches:
            texts = [bpe.decode(np.array(x or [], np.int64)).tobytes() for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.binary())], names=["doc_id", "bytes"])

    return work


def _plain(docs: DataFrame) -> DataFrame:
    return arrow_batches(docs).select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))


def encode(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id and the ids of each whole text; null and empty texts have none.  Rows stay as they are, repeated ones
    too, and other columns are ignored."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    return _plain(docs).mapInArrow(_encode(path, pattern), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id and the bytes of each row of ids."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    return arrow_batches(encoded).select("doc_id", "ids").mapInArrow(_decode(path, pattern), "doc_id long, bytes binary")


def round_trip_digests(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Encode every text, decode the ids again, and keep digests of both: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Texts are read whole, however long; null and empty ones have no ids and the digest of nothing.  Repeated rows give
    repeated rows, doc_id may be null, other columns are ignored, and an empty table gives an empty result."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    return _plain(docs).mapInArrow(_digests(path, pattern), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
