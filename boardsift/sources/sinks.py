"""Writers: verdict folders, binary layers, growth steps, Markdown tables and plot data."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardsift.functions import bits, kernels


def write_split(df: DataFrame, keep: Column, path: str, text: str = "board") -> None:
    """Lines of boards by verdict, in the folders verdict=OK and verdict=NG; a null predicate is written to neither."""
    # exploded, as the optimizer would compute a condition on the verdict anew beside it; no array, no row
    verdict = bits.let(keep, lambda k: F.when(k, F.array(F.lit("OK"))).when(~k, F.array(F.lit("NG"))))
    df.select(text, F.explode(verdict).alias("verdict")).write.mode("overwrite").partitionBy("verdict").text(path)


def write_explained(df: DataFrame, path: str) -> None:
    """The explained squares of every board, by verdict of the occupancy filter."""
    occupied = F.col("player").bitwiseOR(F.col("opponent"))
    seen = bits.explained(occupied)
    df.select(bits.occupied_text(seen).alias("value"), F.when(seen == occupied, "OK").otherwise("NG").alias("verdict")).write.mode("overwrite").partitionBy("verdict").text(path)


def write_verdicts(df: DataFrame, path: str) -> None:
    """Boards by verdict OK, NG or UNKNOWN."""
    df.select("board", "verdict").write.mode("overwrite").partitionBy("verdict").text(path)


def write_layer(df: DataFrame, path: str) -> None:
    """Boards (player, opponent) as Parquet, each file sorted in unsigned order."""
    df.select("player", "opponent").sortWithinPartitions(bits.flip_sign(F.col("player")), bits.flip_sign(F.col("opponent"))).write.mode("overwrite").parquet(path)


def write_layer_bin(df: DataFrame, path: str) -> int:
    """Distinct boards as sorted binary records, one file for each partition of a range sort; returns their number.

    ``path`` is a folder all executors share.
    """
    keys = [bits.flip_sign(F.col("player")), bits.flip_sign(F.col("opponent"))]
    rows = df.select("player", "opponent").distinct().repartitionByRange(*keys).sortWithinPartitions(*keys)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        files.create_dir(folder, recursive=True)
        from pyspark import TaskContext

        name, n = f"{folder}/part-{TaskContext.get().partitionId():05d}.bin", 0
        draft = f"{name}.{uuid.uuid4().hex}"
        with files.open_output_stream(draft, compression=None) as out:
            for batch in batches:
                out.write(np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], 1).astype("<i8").tobytes())
                n += batch.num_rows
        files.move(draft, name)  # a task that is tried again replaces its file
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return rows.mapInArrow(work, "n long").agg(F.sum("n")).first()[0] or 0


def growth_steps(df: DataFrame, key: str = "k") -> DataFrame:
    """key, step, mask: how the explained squares grow from the centre, one square more each."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, i, bits.signed(m)) for k, o in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for i, m in enumerate(kernels.growth_steps(o & (1 << 64) - 1))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=[key, "step", "mask"])

    return df.select(F.col(key).cast("long"), F.col("player").bitwiseOR(F.col("opponent")).alias("occupied")).mapInArrow(work, f"{key} long, step long, mask long")


def markdown(counts: DataFrame, row: str, columns: list[str]) -> DataFrame:
    """Lines of a Markdown table: line number and text."""
    head = counts.sparkSession.createDataFrame([(0, f"| {row} | " + " | ".join(columns) + " |"), (1, "|" + " ---: |" * (len(columns) + 1))], "line long, value string")
    from pyspark.sql import Window

    body = counts.withColumn("line", F.row_number().over(Window.orderBy(row)).cast("long") + 1)  # one row for each number of discs, at most 65
    cells = F.concat_ws(" | ", F.col(row).cast("string"), *(F.col(f"`{c}`").cast("string") for c in columns))
    return head.unionByName(body.select("line", F.concat(F.lit("| "), cells, F.lit(" |")).alias("value")))


def plot_bounds(stats: DataFrame) -> DataFrame:
    """Shared axis bounds of a plot of solver statistics."""
    return stats.agg(F.min("vars").alias("min_vars"), F.max("vars").alias("max_vars"), F.min("clauses").alias("min_clauses"), F.max("clauses").alias("max_clauses"))
