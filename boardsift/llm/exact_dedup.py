"""Exact duplicates by a tree merge of sorted digest runs.

Every partition of the input sorts its digests into a run that holds one entry per distinct text.  Runs are exchanged
in binomial rounds: in a round the partitions whose numbers differ in one bit swap halves of their digest ranges, and
each merges the two sorted runs it then has into one.  A shuffle carries ``BITS`` such rounds at once: a partition gets
the pieces of its ``2**BITS`` partners, still sorted, and merges them as a binomial tree, bit by bit.  At every level
the entry to keep of equal texts is chosen and their number added up, so a text that occurs in a third of all rows is
one entry per run from the leaves on, and in the end every partition holds one slice of the digest range.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardsift.llm.common import arrow_batches, frugal, numbered, staged, text_slices, with_groups, without_rows

#: Characters that do not count when texts are compared: [\x20\x09-\x0D].
IGNORED = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Binomial rounds of one shuffle: one hexadecimal digit of the digest.
BITS = 4
FAN = 1 << BITS
#: Bytes of a key: SHA-256, an independent 64-bit fingerprint and the length.  Texts are equal if all three are; texts
#: that share a digest only are two groups.
KEY = 32 + 8 + 8

_DIGESTS = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("key", pa.binary()), ("chars", pa.int64())])
_PIECES = "node long, source long, run binary"
_GROUPS = "key binary, keep_id long, keep_row long, group_size long"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        key, chars = [], []
        for text in batch.column("text").to_pylist():
            bare = (text or "").encode().translate(None, IGNORED)
            key.append(hashlib.sha256(bare).digest() + xxhash.xxh3_64_digest(bare, 1) + len(bare).to_bytes(8, "big"))
            chars.append(len(text or ""))
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(key, pa.binary()), pa.array(chars, pa.int64())], schema=_DIGESTS)


class Run(NamedTuple):
    """Entries of distinct texts, sorted by key; ``no_id`` is 1 where the kept row has no id (its doc_id is 0 then)."""

    key: np.ndarray
    chars: np.ndarray
    no_id: np.ndarray
    doc_id: np.ndarray
    row: np.ndarray
    n: np.ndarray

    def part(self, a: int, z: int) -> "Run":
        return Run(*(x[a:z] for x in self))

    def packed(self) -> bytes:
        return b"".join(x.tobytes() for x in self)

    @staticmethod
    def unpacked(data: bytes) -> "Run":
        n = len(data) // (KEY + 40)
        return Run(np.frombuffer(data, f"S{KEY}", n), *(np.frombuffer(data, np.int64, n, KEY * n + 8 * n * i) for i in range(5)))


def leaf_run(key: list[bytes], chars: np.ndarray, no_id: np.ndarray, doc_id: np.ndarray, row: np.ndarray) -> Run:
    """The run of one partition's rows: of equal texts the row with the most characters, then the smallest id (null
    last), then the first row stays."""
    keys = np.frombuffer(b"".join(key), f"S{KEY}")
    order = np.lexsort((row, doc_id, no_id, -chars, keys))
    sorted_keys = keys[order]
    start = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(order) else order
    kept = order[start]
    return Run(keys[kept], chars[kept], no_id[kept], doc_id[kept], row[kept], np.diff(np.append(start, len(order))))


def merge_two(a: Run, b: Run) -> Run:
    """One sorted run of two; of texts in both the entry to keep, and the sum of their numbers."""
    at = np.searchsorted(a.key, b.key)
    both = np.zeros(len(b.key), bool)
    inside = at < len(a.key)
    both[inside] = a.key[at[inside]] == b.key[inside]
    here, there = at[both], np.flatnonzero(both)
    better, equal = np.zeros(len(here), bool), np.ones(len(here), bool)
    for x, y in ((-a.chars, -b.chars), (a.no_id, b.no_id), (a.doc_id, b.doc_id), (a.row, b.row)):
        better |= equal & (y[there] < x[here])
        equal &= y[there] == x[here]
    merged = [x.copy() for x in a]
    for mine, theirs in zip(merged[:5], b[:5], strict=True):
        mine[here[better]] = theirs[there[better]]
    merged[5][here] += b.n[there]
    return Run(*(np.insert(mine, at[~both], theirs[~both]) for mine, theirs in zip(merged, b, strict=True)))


def merge_runs(runs: dict[int, Run]) -> Run:
    """Runs by the numbers of the partitions they come from, merged as a binomial tree: level by level those whose
    numbers differ in that level's bit."""
    for level in range(BITS):
        merged: dict[int, Run] = {}
        for number in sorted(runs):
            to = number & ~(1 << level)
            merged[to] = merge_two(merged[to], runs[number]) if to in merged else runs[number]
        runs = merged
    (run,) = runs.values()
    return run


def _cut(run: Run, node: int, level: int) -> pa.RecordBatch:
    """The pieces of a run for the partners of ``node`` in a shuffle: piece j of the range goes to the one whose digit
    ``level`` is j.  All digests of a run agree on the digits before."""
    place = FAN**level
    digit = np.frombuffer(run.key.tobytes(), np.uint8).reshape(-1, KEY)[:, level // 2] >> (0 if level % 2 else BITS) & (FAN - 1)
    edge = np.searchsorted(digit, np.arange(FAN + 1)).tolist()
    own = node // place % FAN
    pieces = [(node + (j - own) * place, run.part(a, z).packed()) for j, (a, z) in enumerate(zip(edge, edge[1:], strict=False)) if z > a]
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pieces], pa.int64()), pa.array([own] * len(pieces), pa.int64()), pa.array([x for _, x in pieces], pa.binary())], names=["node", "source", "run"])


def _leaf_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = [b for b in batches if b.num_rows]
    if seen:
        table = pa.Table.from_batches(seen)
        column = lambda name: table.column(name).fill_null(0).to_numpy()
        no_id = table.column("doc_id").is_null().to_numpy().astype(np.int64)
        run = leaf_run(table.column("key").to_pylist(), column("chars"), no_id, column("doc_id"), column("row"))
        yield _cut(run, TaskContext.get().partitionId(), 0)


def _merged(table: pa.Table) -> Run:
    return merge_runs({x["source"]: Run.unpacked(x["run"]) for x in table.to_pylist()})


def _exchange(level: int):
    def work(key, table):
        return pa.Table.from_batches([_cut(_merged(table), key[0].as_py(), level)])

    return work


def _groups(key, table):
    run = _merged(table)
    run = Run(*(x[run.n > 1] for x in run))
    keys = pa.array([k.ljust(KEY, b"\0") for k in run.key.tolist()], pa.binary())
    return pa.table({"key": keys, "keep_id": pa.array(run.doc_id, mask=run.no_id == 1), "keep_row": pa.array(run.row), "group_size": pa.array(run.n)})


def tree_merge(digests: DataFrame) -> DataFrame:
    """Groups of two or more rows: key, keep_id, keep_row, group_size."""
    leaves = max(1, digests.rdd.getNumPartitions())
    pieces = digests.mapInArrow(frugal(_leaf_pieces), _PIECES)
    level = 1
    while FAN**level < leaves:
        pieces = pieces.groupBy("node").applyInArrow(_exchange(level), _PIECES)
        level += 1
    return pieces.groupBy("node").applyInArrow(_groups, _GROUPS)


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """Find the rows of ``docs`` (doc_id, text, ...) whose texts are equal but for white space.

    Returns one row per input row: row (a row number), doc_id, keep_id, group_size, kept, text_sha256.
    A null text counts as empty; empty texts equal each other; a text is read whole, however long.  Of rows that are
    equal in text, length and doc_id one stays, and a null doc_id comes after all others.  Other columns are ignored,
    and an empty table gives an empty result.
    """
    # the rows are read once: their numbers are written with the digests
    return _duplicates(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))


def _duplicates(source: DataFrame) -> DataFrame:
    """What :func:`exact_duplicates` returns, of rows (row, doc_id, text)."""
    digests = staged(arrow_batches(source).mapInArrow(frugal(_digest), "row long, doc_id long, key binary, chars long"), "digests")
    groups = staged(tree_merge(digests), "groups")
    joined = with_groups(digests.select("row", "doc_id", "key"), groups, "key", "group_size")
    single = F.col("group_size").isNull()
    return joined.select("row", "doc_id", F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), (single | (F.col("row") == F.col("keep_row"))).alias("kept"), F.lower(F.hex(F.substring("key", 1, 32))).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that :func:`exact_duplicates` does not keep; all columns stay, whatever their names.
    Nulls, empty and long texts, repeated rows and empty tables are handled as there."""
    docs, name = numbered(docs)
    source = docs.select(F.col(name).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return without_rows(docs, name, staged(_duplicates(source).where(~F.col("kept")).select("row"), "lost"))
