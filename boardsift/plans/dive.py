"""Reverse search depth first, each board in one task.

A level search goes through all boards of a disc count before the next one, and shares that work among tasks; a board
that can be reached usually has a line that is found long before.  So a dive takes the best open boards of the lowest
level, a batch at a time, until one of their predecessors is a leaf, nothing is open, or its budget of boards is spent.
Boards are independent, so many of them dive at once; a task holds the open boards of one of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardsift.functions import kernels

#: Boards opened at once, and boards a dive may find before it gives up.
BATCH, MAX_NODES = 64, 300_000
#: Leaves that are sent to all executors at most; a forward table's size depends on its discs only.
MAX_LEAVES = 5_000_000
U = np.uint64


class Known:
    """A set of boards as sorted runs of hashes, merged as they grow."""

    def __init__(self):
        self.runs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    @staticmethod
    def _hash(player: np.ndarray, opponent: np.ndarray) -> np.ndarray:
        mixed = (player ^ (opponent * U(0x9E3779B97F4A7C15))) * U(0xD6E8FEB86659FD93)
        return mixed ^ (mixed >> U(32))

    def has(self, player: np.ndarray, opponent: np.ndarray) -> np.ndarray:
        key = self._hash(player, opponent)
        out = np.zeros(len(key), bool)
        for keys, players, opponents in self.runs:
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            out |= (players[at] == player) & (opponents[at] == opponent)
        return out

    def add(self, player: np.ndarray, opponent: np.ndarray) -> None:
        if not len(player):
            return
        run = (self._hash(player, opponent), player, opponent)
        while True:
            order = np.argsort(run[0], kind="stable")
            run = tuple(x[order] for x in run)
            if not self.runs or len(self.runs[-1][0]) > 2 * len(run[0]):
                self.runs.append(run)
                return
            run = tuple(np.concatenate(x) for x in zip(self.runs.pop(), run, strict=True))


def distinct(player: np.ndarray, opponent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((opponent, player))
    player, opponent = player[order], opponent[order]
    first = np.ones(len(player), bool)
    first[1:] = (player[1:] != player[:-1]) | (opponent[1:] != opponent[:-1])
    return player[first], opponent[first]


def before(player: np.ndarray, opponent: np.ndarray, strict: bool) -> tuple[np.ndarray, np.ndarray]:
    """Distinct smallest images of the pruned boards one disc before, from the other side too where that can't move."""
    _, _, _, p, o = kernels.parents(player, opponent, strict)
    p, o = distinct(*kernels.canonical(p, o))
    keep = kernels.pruned(p, o)
    p, o = p[keep], o[keep]
    stuck = kernels.moves(o, p) == 0
    turned = kernels.canonical(o[stuck], p[stuck])
    return distinct(np.concatenate([p, turned[0]]), np.concatenate([o, turned[1]]))


def dive(player: int, opponent: int, discs: int, leaves: Known, max_nodes: int = MAX_NODES, batch: int = BATCH, strict: bool = False) -> tuple[str, int, int]:
    """Verdict on a sound board, boards found and boards opened."""
    p, o = np.array([player], U), np.array([opponent], U)
    if not int(kernels.moves(o, p)[0]):
        p, o = np.concatenate([p, o]), np.concatenate([o, p])
    p, o = distinct(*kernels.canonical(p, o))
    height = (player | opponent).bit_count()
    if height <= discs:
        return ("OK" if leaves.has(*(x[:1] for x in kernels.canonical(np.array([player], U), np.array([opponent], U)))).any() else "NG"), 0, 0
    open_ = {height: [kernels.h_score(p, o), p, o]}
    known: dict[int, Known] = {}
    found = opened = 0
    while open_:
        level = min(open_)
        h, p, o = open_.pop(level)
        if len(h) > batch:
            best = np.argpartition(h, batch)
            open_[level] = [x[best[batch:]] for x in (h, p, o)]
            p, o = p[best[:batch]], o[best[:batch]]
        opened += len(p)
        p, o = before(p, o, strict)
        if level - 1 == discs:
            found += len(p)
            if leaves.has(p, o).any():
                return "OK", found, opened
        else:
            seen = known.setdefault(level - 1, Known())
            fresh = ~seen.has(p, o)
            p, o = p[fresh], o[fresh]
            seen.add(p, o)
            found += len(p)
            if len(p):
                more = [kernels.h_score(p, o), p, o]
                open_[level - 1] = [np.concatenate(x) for x in zip(open_[level - 1], more, strict=True)] if level - 1 in open_ else more
        if found > max_nodes and open_:
            return "UNKNOWN", found, opened
    return "NG", found, opened


def leaf_set(leaves: DataFrame) -> Known:
    """The leaves (player, opponent), smallest images, as one set."""
    n = leaves.count()
    if n > MAX_LEAVES:
        raise ValueError(f"{n} leaves are too many for a dive; search by level instead")
    table = leaves.select("player", "opponent").toArrow()
    out = Known()
    out.add(*(table.column(x).to_numpy().view(np.uint64) for x in ("player", "opponent")))
    return out


def dives(boards: DataFrame, discs: int, leaves: DataFrame, max_nodes: int = MAX_NODES, batch: int = BATCH, strict: bool = False) -> DataFrame:
    """board_id, verdict, found and opened (numbers of boards) of every sound board (board_id, player, opponent)."""
    shared = boards.sparkSession.sparkContext.broadcast(leaf_set(leaves))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            masks = (rows.column(x).to_numpy().view(np.uint64).tolist() for x in ("player", "opponent"))
            out = [dive(p, o, discs, shared.value, max_nodes, batch, strict) for p, o in zip(*masks, strict=True)]
            if out:
                yield pa.RecordBatch.from_arrays([rows.column("board_id"), *(pa.array(x) for x in zip(*out, strict=True))], names=["board_id", "verdict", "found", "opened"])

    # a board may take minutes: rows are dealt one by one, whatever partition they come from
    dealt = boards.select(F.col("board_id").cast("long").alias("board_id"), "player", "opponent")
    dealt = dealt.repartition(max(boards.sparkSession.sparkContext.defaultParallelism, int(boards.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return dealt.mapInArrow(work, "board_id long, verdict string, found long, opened long")
