"""Vectorised words: every distinct white-space chunk of a batch is handled once."""

from __future__ import annotations

import string
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Stripped from both ends of a word before it is hashed.
EDGE_CHARACTERS = string.punctuation + "«»“”„‘’…–—¿¡·•"


class Words(NamedTuple):
    """``code[offset[d]:offset[d + 1]]`` are the words of document d as indices into ``vocab``."""

    code: np.ndarray
    offset: np.ndarray
    vocab: pa.Array

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offset) - 1), np.diff(self.offset))

    def kept(self, mask: np.ndarray) -> "Words":
        """Only the words whose vocabulary entry is in ``mask``."""
        keep = mask[self.code]
        before = np.concatenate([[0], np.cumsum(keep)])
        return Words(self.code[keep], before[self.offset], self.vocab)


def split_words(column: pa.Array) -> Words:
    """White-space chunks (ASCII white space) of every text; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lists = pc.ascii_split_whitespace(pc.fill_null(column.cast(pa.large_string()), ""))
    encoded = lists.values.dictionary_encode()
    words = Words(encoded.indices.to_numpy(), lists.offsets.to_numpy().astype(np.int64), encoded.dictionary)
    return words.kept(pc.not_equal(encoded.dictionary, "").to_numpy(zero_copy_only=False))


def hashes(vocab: pa.Array | list[str]) -> np.ndarray:
    """64-bit hashes of strings, the same on every machine."""
    items = vocab if isinstance(vocab, list) else vocab.to_pylist()
    return np.fromiter((xxhash.xxh3_64_intdigest(x) for x in items), np.uint64, len(items))


def bare(vocab: pa.Array) -> pa.Array:
    """Lower-cased words without punctuation at their ends."""
    return pc.utf8_trim(pc.utf8_lower(vocab), characters=EDGE_CHARACTERS)


def bare_words(column: pa.Array) -> tuple[Words, np.ndarray]:
    """Words of every text without case and edge punctuation, and the hash of each vocabulary entry."""
    words = split_words(column)
    plain = bare(words.vocab)
    words = words.kept(pc.not_equal(plain, "").to_numpy(zero_copy_only=False))
    return words, hashes(plain)
