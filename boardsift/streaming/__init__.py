"""The native filters over a stream of board lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardsift.operators import filters
from boardsift.sources.boards import parse_board, with_masks


def verdicts(lines: DataFrame) -> DataFrame:
    """board and rejected_by of every board in a stream (or table) of lines; no state is kept."""
    boards = with_masks(lines.select(parse_board(F.col("value")).alias("board")).where("board IS NOT NULL"))
    return filters.cascade(boards).select("board", "rejected_by")
