"""Moves forwards and backwards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boardsift.functions import bits, kernels
from boardsift.staging import staged


def forward_moves(df: DataFrame) -> DataFrame:
    """One row per legal move: the columns of ``df`` with square, flipped and the board after the move."""
    rows = df.withColumn("square", F.explode(bits.bits_of(bits.moves(F.col("player"), F.col("opponent")))))
    rows = rows.withColumn("flipped", bits.flip(bits.square_bit(F.col("square")), F.col("player"), F.col("opponent")))
    after = bits.play(bits.square_bit(F.col("square")), F.col("flipped"), F.col("player"), F.col("opponent"))
    return rows.withColumn("after", after).withColumn("player", F.col("after.player")).withColumn("opponent", F.col("after.opponent")).drop("after")


def canonical(df: DataFrame) -> DataFrame:
    """Boards replaced by their smallest image; other columns stay."""
    kernel = lambda p, o: (slice(None), *kernels.canonical(p, o))
    return by_kernel(df, kernel)


def by_kernel(df: DataFrame, kernel) -> DataFrame:
    """``df`` with boards replaced by what a kernel gives for them: the rows they come from, players, opponents."""
    names = df.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                row, *board = kernel(*(part.column(x).to_numpy().view(np.uint64) for x in ("player", "opponent")))
                taken = pa.array(np.arange(part.num_rows)[row])
                found = dict(zip(("player", "opponent"), (pa.array(x.view(np.int64)) for x in board), strict=True))
                yield pa.RecordBatch.from_arrays([found[x] if x in found else part.column(x).take(taken) for x in names], names=names)

    return df.mapInArrow(work, df.schema)


def predecessors(df: DataFrame, key: str, strict: bool = False) -> DataFrame:
    """key, square, flipped, player, opponent of every board that may have come before.

    As the relation goes, a disc outside the centre of the side that moved last may have turned any combination of
    prefixes of the runs beside it; ``strict`` also asks that the move played forwards turns exactly these.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                row, square, *masks = kernels.parents(*(part.column(x).to_numpy().view(np.uint64) for x in ("player", "opponent")), strict)
                yield pa.RecordBatch.from_arrays([part.column(key).take(pa.array(row)), pa.array(square.astype(np.int32)), *(pa.array(x.view(np.int64)) for x in masks)], names=[key, "square", "flipped", "player", "opponent"])

    return df.select(F.col(key).cast("long"), "player", "opponent").mapInArrow(work, f"{key} long, square int, flipped long, player long, opponent long")


def reverse_step(df: DataFrame, strict: bool = False) -> DataFrame:
    """Pruned boards one disc before, and from the other side where that one can't move, as smallest images, in one
    kernel: nothing but (key columns, board) leaves it."""
    def kernel(p: np.ndarray, o: np.ndarray):
        row, _, _, p, o = kernels.parents(p, o, strict)
        keep = kernels.pruned(p, o)
        row, p, o = row[keep], p[keep], o[keep]
        stuck = kernels.moves(o, p) == 0
        row, p, o = np.concatenate([row, row[stuck]]), np.concatenate([p, o[stuck]]), np.concatenate([o, p[stuck]])
        return row, *kernels.canonical(p, o)

    return by_kernel(df, kernel)


def forward_step(df: DataFrame) -> DataFrame:
    """Smallest images of all boards after one move."""
    def kernel(p: np.ndarray, o: np.ndarray):
        row, p, o = kernels.children(p, o)
        return row, *kernels.canonical(p, o)

    return by_kernel(df, kernel)


def with_passes(df: DataFrame) -> DataFrame:
    """Boards, and for those whose other side can't move the same board seen from that side."""
    def kernel(p: np.ndarray, o: np.ndarray):
        stuck = kernels.moves(o, p) == 0
        return np.concatenate([np.arange(len(p)), np.flatnonzero(stuck)]), np.concatenate([p, o[stuck]]), np.concatenate([o, p[stuck]])

    return by_kernel(df, kernel)


def with_own_passes(df: DataFrame) -> DataFrame:
    """Boards, and those whose mover can't move but the other side can from that side, as smallest images."""
    def kernel(p: np.ndarray, o: np.ndarray):
        stuck = (kernels.moves(p, o) == 0) & (kernels.moves(o, p) != 0)
        return np.concatenate([np.arange(len(p)), np.flatnonzero(stuck)]), *kernels.canonical(np.concatenate([p, o[stuck]]), np.concatenate([o, p[stuck]]))

    return by_kernel(df, kernel)


def order_children(df: DataFrame, key: str) -> DataFrame:
    """Rank of each child board under its key by (h_score, board), smallest first."""
    order = Window.partitionBy(key).orderBy("h", bits.flip_sign(F.col("player")), bits.flip_sign(F.col("opponent")))
    return df.withColumn("h", bits.h_score(F.col("player"), F.col("opponent"))).withColumn("place", F.row_number().over(order))


def pop_best(df: DataFrame, count: int) -> DataFrame:
    """The ``count`` boards of smallest (h_score, board)."""
    return df.withColumn("h", bits.h_score(F.col("player"), F.col("opponent"))).orderBy("h", bits.flip_sign(F.col("player")), bits.flip_sign(F.col("opponent"))).limit(count)


def sort_boards(df: DataFrame) -> DataFrame:
    """Total order by (player, opponent), unsigned."""
    return df.orderBy(bits.flip_sign(F.col("player")), bits.flip_sign(F.col("opponent")))


def placed(df: DataFrame) -> DataFrame:
    """``df`` with the place (from 1) of each row in the total order.

    Rows are sorted in ranges and numbered within each; a range's places start after the rows of those before it, which
    needs one number per range."""
    keys = [bits.flip_sign(F.col("player")), bits.flip_sign(F.col("opponent"))]
    numbered = staged(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("place", F.monotonically_increasing_id()), "sorted")
    part, inside = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = numbered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return numbered.withColumn("part", part).withColumn("inside", inside).join(F.broadcast(ranges.select("part", "base")), "part").withColumn("place", F.col("base") + F.col("inside") + 1).drop("part", "inside", "base")


def merge_sorted_distinct(runs: list[DataFrame]) -> DataFrame:
    """Distinct boards of several layers, in order."""
    out = runs[0].select("player", "opponent")
    for run in runs[1:]:
        out = out.unionByName(run.select("player", "opponent"))
    return sort_boards(out.dropDuplicates(["player", "opponent"]))


def split_by_set(df: DataFrame, known: DataFrame) -> DataFrame:
    """``in_set``: whether a board (not its images) is among the known ones."""
    marked = known.select("player", "opponent").distinct().withColumn("in_set", F.lit(True))
    return df.join(marked, ["player", "opponent"], "left").withColumn("in_set", F.coalesce("in_set", F.lit(False)))


def meet(df: DataFrame, leaves: DataFrame) -> DataFrame:
    """Boards that are among the leaves; both are smallest images already."""
    return df.join(leaves.select("player", "opponent"), ["player", "opponent"], "left_semi")


def not_visited(df: DataFrame, visited: DataFrame, keys: list[str]) -> DataFrame:
    return df.dropDuplicates(keys).join(visited.select(*keys), keys, "left_anti")
