"""Sources of boards: text, binary layers, ranks, solver statistics and generators."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boardsift.functions import bits, kernels


def parse_board(line: Column) -> Column:
    """The board of a line as 64 characters: others than X, O and - are skipped; null unless 64 are left."""
    text = F.regexp_replace(line, "[^XO-]", "")
    return F.when(F.length(text) == 64, text)


def with_masks(df: DataFrame, board: str = "board") -> DataFrame:
    return df.withColumn("player", bits.from_text(F.col(board), "X")).withColumn("opponent", bits.from_text(F.col(board), "O"))


def scan_boards_text(spark: SparkSession, path: str) -> DataFrame:
    """board, player, opponent of every line that holds a board; a source without any is refused."""
    boards = spark.read.text(path).select(parse_board(F.col("value")).alias("board")).where("board IS NOT NULL")
    if boards.isEmpty():
        raise ValueError(f"no board in {path}")
    return with_masks(boards)


def scan_occupancy_text(lines: DataFrame) -> DataFrame:
    """occupied of lines of 64 characters of O, X, G and -; other lines are refused."""
    good = F.col("value").rlike("^[OXG-]{64}$")
    return lines.select("*", F.when(good, bits.from_text(F.col("value"), "OXG")).otherwise(F.raise_error(F.lit("not an occupancy line")).cast("long")).alias("occupied"))


def scan_rank_text(lines: DataFrame) -> DataFrame:
    """rank (DECIMAL(38,0)) of every line that isn't blank; what is no number is an error."""
    return lines.where("trim(value) <> ''").select(F.trim("value").cast("decimal(38,0)").alias("rank"))


def rank_decode(rank: Column) -> Column:
    """The board of a rank as text: mixed radix from the lowest digit, 3 on outer squares and 2 on the centre."""
    start = F.struct(rank.cast("decimal(38,0)").alias("r"), F.lit("").alias("s"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), start, _digit)["s"]


def _digit(acc: Column, i: Column) -> Column:
    centre = i.isin(*bits.CENTRE_SQUARES)
    base = F.when(centre, F.lit(2)).otherwise(F.lit(3)).cast("decimal(38,0)")
    digit = acc["r"] % base
    sign = F.when(centre, F.when(digit == 0, "X").otherwise("O")).otherwise(F.when(digit == 0, "-").when(digit == 1, "X").otherwise("O"))
    return F.struct(((acc["r"] - digit) / base).cast("decimal(38,0)").alias("r"), F.concat(acc["s"], sign).alias("s"))


def scan_solver_stats(lines: DataFrame) -> DataFrame:
    """index, ans, vars, clauses of lines ``k=v, k=v``; a line without ans, vars or clauses is an error."""
    pairs = F.expr("str_to_map(value, ',\\\\s*', '=')")
    need = lambda k: F.coalesce(pairs[k], F.raise_error(F.lit(f"a line lacks {k}")))
    return lines.select(pairs["index"].cast("int").alias("index"), (need("ans") == "true").alias("ans"), need("vars").cast("int").alias("vars"), need("clauses").cast("int").alias("clauses"))


def scan_boards_bin(spark: SparkSession, path: str) -> DataFrame:
    """Boards of binary layer files (records of two little-endian 64-bit masks); a file of another length is refused."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content").to_pylist():
                if len(data) % 16:
                    raise ValueError("a layer file's length is no multiple of 16")
                masks = np.frombuffer(data, "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(masks[:, 0]), pa.array(masks[:, 1])], names=["player", "opponent"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(cut, "player long, opponent long")


def boards_of_keys(df: DataFrame, key: str) -> DataFrame:
    """k, board, player, opponent: a board for each key, from two MD5 digests of it."""
    k = F.col(key).cast("string")
    digest = F.concat(F.md5(F.concat(k, F.lit("a"))), F.md5(F.concat(k, F.lit("b"))))
    outer, inner = (F.translate(digest, "0123456789abcdef", to) for to in ("--XXXXXXXOOOOOOO", "XXXXXXXXOOOOOOOO"))
    part = lambda x, a, b: F.substring(x, a + 1, b - a)
    board = F.concat(part(outer, 0, 27), part(inner, 27, 29), part(outer, 29, 35), part(inner, 35, 37), part(outer, 37, 64))
    return with_masks(df.select(F.col(key).cast("long").alias("k"), board.alias("board")))


def _seed(seed: int, i: int) -> int:
    """Far-apart seeds: Spark adds the partition's number to a seed, so neighbouring ones would repeat each other."""
    return int.from_bytes(hashlib.sha256(f"{seed}-{i}".encode()).digest()[:7], "big")


def rand_below(limit: int, seed: int = 0) -> Column:
    """A number uniform in [0, limit) for every row, for limits up to 2^53."""
    if not 0 < limit <= 1 << 53:
        raise ValueError("the limit must lie in 1 .. 2^53")
    return F.floor(F.rand(_seed(seed, -1)) * F.lit(limit)).cast("long")


def gen_uniform(spark: SparkSession, count: int, seed: int = 0) -> DataFrame:
    """Boards uniform over all positions with a full centre: every square by a draw of its own."""
    cell = [F.when(F.rand(_seed(seed, i)) < 0.5, "X").otherwise("O") if i in bits.CENTRE_SQUARES else F.element_at(F.array(F.lit("-"), F.lit("X"), F.lit("O")), (F.rand(_seed(seed, i)) * 3).cast("int") + 1) for i in range(64)]
    return with_masks(spark.range(count).select(F.col("id").alias("board_id"), F.concat(*cell).alias("board")))


def gen_fixed_discs(spark: SparkSession, count: int, discs: int, seed: int = 0) -> DataFrame:
    """Boards with a full centre and exactly ``discs`` discs outside it, every set of squares as likely, colours even."""
    outer = [i for i in range(64) if i not in bits.CENTRE_SQUARES]
    if not 0 <= discs <= len(outer):
        raise ValueError("discs must be 0 to 60")
    draws = F.array(*(F.struct(F.rand(_seed(seed, i)).alias("r"), F.lit(i).alias("square")) for i in outer))
    chosen = F.transform(F.slice(F.array_sort(draws), 1, discs), lambda d: d["square"]) if discs else F.array().cast("array<int>")
    colours = F.concat(*(F.when(F.rand(_seed(seed, 64 + i)) < 0.5, "X").otherwise("O") for i in range(64)))
    rows = spark.range(count).select(F.col("id").alias("board_id"), chosen.alias("squares"), colours.alias("colours"))
    full = F.array_union("squares", F.array(*map(F.lit, bits.CENTRE_SQUARES)))
    cell = lambda i: F.when(F.array_contains(full, i), F.call_function("substring", F.col("colours"), i + F.lit(1), F.lit(1))).otherwise("-")
    return with_masks(rows.select("board_id", F.array_join(F.transform(F.sequence(F.lit(0), F.lit(63)), cell), "").alias("board")))


def random_play(spark: SparkSession, count: int, plies: int, seed: int = 0) -> DataFrame:
    """Boards after random legal plies, each row with random numbers of its own."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_pylist()
            boards = np.array([kernels.random_play(plies, np.random.default_rng([seed, i])) for i in ids], np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(boards[:, 0]), pa.array(boards[:, 1])], names=["board_id", "player", "opponent"])

    found = spark.range(count).mapInArrow(work, "board_id long, player long, opponent long")
    return found.withColumn("board", bits.to_text(F.col("player"), F.col("opponent")))
