"""Forward tables and reverse searches as dataflows over levels of equal disc counts.

A level depends on the next one only, so a search is one shuffle (the removal of duplicates) a level, and a level that
was written can be read again to go on from there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boardsift.functions import bits
from boardsift.operators import filters, moves
from boardsift.plans import dive
from boardsift.staging import staged

#: Boards a dive may find before a board is left to the level search.
FIRST_DIVE = 20_000

BOARD = ["player", "opponent"]


def _start(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(bits.mask(bits.START_PLAYER).alias("player"), bits.mask(bits.START_OPPONENT).alias("opponent"))


def forward_levels(spark: SparkSession, discs: int) -> list[DataFrame]:
    """Smallest images of all boards reachable from the start with 4, 5, ... ``discs`` discs, one table each; a board
    whose mover can't move is there from the other side too, if that one can."""
    level = moves.canonical(_start(spark))
    out = []
    for n in range(4, discs + 1):
        level = staged(moves.with_own_passes(level.select(*BOARD)).dropDuplicates(BOARD), f"forward{n}")
        out.append(level)
        if n < discs:
            level = moves.forward_step(level).dropDuplicates(BOARD)
    return out


def forward_table(spark: SparkSession, discs: int) -> tuple[DataFrame, DataFrame]:
    """Internal boards (fewer than ``discs`` discs, column discs) and leaves (``discs`` discs, the mover can move)."""
    levels = forward_levels(spark, discs)
    leaves = levels[-1].where(bits.moves(F.col("player"), F.col("opponent")) != 0)
    internal = spark.createDataFrame([], "player long, opponent long, discs int")
    for n, level in enumerate(levels[:-1], 4):
        internal = internal.unionByName(level.withColumn("discs", F.lit(n)))
    return internal, leaves


def forward_table_pruned(spark: SparkSession, targets: DataFrame, discs: int) -> DataFrame:
    """t_id, player, opponent: forward boards of ``discs`` discs that can still grow into each target (t_id, t_player,
    t_opponent); boards are there from the other side too where the mover can't move, whether that one can or not."""
    level = moves.canonical(_start(spark)).crossJoin(F.broadcast(targets))  # one row for each target
    columns = [*BOARD, *targets.columns]
    for n in range(4, discs):
        after = moves.canonical(moves.with_passes(moves.forward_step(level.select(*columns)))).dropDuplicates([*BOARD, "t_id"])
        level = staged(filters.grown_into_target(after.select(*columns)), f"pruned{n + 1}")
    return level.select("t_id", *BOARD)


def _seeds(boards: DataFrame) -> DataFrame:
    """Boards as they are, and from the other side where that one can't move."""
    return moves.with_passes(boards.select("board_id", *BOARD))


def reverse_level(level: DataFrame, strict: bool = False) -> DataFrame:
    """Boards one disc before, pruned, as smallest images, without duplicates under their board_id."""
    return moves.reverse_step(level.select("board_id", *BOARD), strict).dropDuplicates(["board_id", *BOARD])


def reverse_dfs(boards: DataFrame, discs: int, leaves: DataFrame | None = None, max_nodes: int = dive.MAX_NODES, batch: int = dive.BATCH, strict: bool = False) -> DataFrame:
    """Verdicts on boards (board_id, player, opponent) by a dive for each: OK at the first line that meets the forward
    table at ``discs`` discs, NG if none is left, UNKNOWN once more than ``max_nodes`` boards were found; with
    invalid_reason, found and opened (null for unsound boards, which are NG).  ``batch`` boards are opened at once, the
    best first; with 1 it is plain ordered depth-first search."""
    spark = boards.sparkSession
    if leaves is None:
        leaves = forward_table(spark, discs)[1]
    marked = staged(boards.select("board_id", *BOARD, filters.validate().alias("invalid_reason")), "boards")
    found = dive.dives(marked.where("invalid_reason IS NULL"), discs, leaves, max_nodes, batch, strict)
    unsound = marked.where("invalid_reason IS NOT NULL").select("board_id", F.lit("NG").alias("verdict"), F.lit(None).cast("long").alias("found"), F.lit(None).cast("long").alias("opened"), "invalid_reason")
    return found.withColumn("invalid_reason", F.lit(None).cast("string")).unionByName(unsound)


def reverse_bfs(boards: DataFrame, discs: int, leaves: DataFrame | None = None, max_nodes: int | None = None, strict: bool = False, resume: DataFrame | None = None, first_dive: int = FIRST_DIVE) -> DataFrame:
    """Verdicts on boards (board_id, player, opponent): OK if some line of predecessors meets the forward table at
    ``discs`` discs, NG if none does, UNKNOWN if more than ``max_nodes`` boards were found before that was settled.

    Boards that a short dive settles (``first_dive`` boards found at most; 0 for none) take no part in the levels, which
    go through all lines to their end.  Unsound boards are NG with an ``invalid_reason``; boards of at most ``discs``
    discs are looked up directly.  ``strict`` allows only predecessors that play forwards again; the two modes answer
    different questions.  ``resume`` is a level written earlier (board_id, player, opponent, all of one disc count) to
    go on from.
    """
    spark = boards.sparkSession
    if leaves is None:
        leaves = forward_table(spark, discs)[1]
    marked = staged(boards.select("board_id", *BOARD, filters.validate().alias("invalid_reason"), bits.popcount(F.col("player"), F.col("opponent")).alias("discs")), "boards")
    sound = marked.where("invalid_reason IS NULL")
    settled = None
    if first_dive and max_nodes is None and resume is None:
        dived = staged(dive.dives(sound.where(F.col("discs") > discs), discs, leaves, first_dive, strict=strict), "dived")
        settled = dived.where("verdict <> 'UNKNOWN'").select("board_id", "verdict")
        sound = staged(sound.join(settled, "board_id", "left_anti"), "open")
    highest = sound.agg(F.max("discs")).first()[0] or 0
    level = None
    if resume is not None:
        level = resume.select("board_id", *BOARD)
        highest = level.select(bits.popcount(F.col("player"), F.col("opponent")).alias("d")).agg(F.max("d")).first()[0] or 0
    spent = over = None
    for n in range(highest - 1, discs - 1, -1):
        source = _seeds(sound.where(F.col("discs") == n + 1)) if resume is None else None
        level = source if level is None else level if source is None else level.unionByName(source)
        level = staged(reverse_level(level, strict), f"reverse{n}")
        if max_nodes is not None:
            count = level.groupBy("board_id").agg(F.count("*").alias("nodes"))
            spent = count if spent is None else spent.unionByName(count).groupBy("board_id").agg(F.sum("nodes").alias("nodes"))
            spent = staged(spent, "nodes")
            over = spent.where(F.col("nodes") > max_nodes).select("board_id")
            level = level.join(over, "board_id", "left_anti")
    direct = moves.canonical(sound.where(F.col("discs") <= discs).select("board_id", *BOARD))
    last = direct if level is None else level.select("board_id", *BOARD).unionByName(direct)
    found = moves.meet(last, leaves).select("board_id").distinct().withColumn("found", F.lit(True))
    out = marked.join(found, "board_id", "left")
    verdict = F.when(F.col("found"), "OK")
    if settled is not None:
        out = out.join(settled.withColumnRenamed("verdict", "dived"), "board_id", "left")
        verdict = F.when(F.col("dived").isNotNull(), F.col("dived")).when(F.col("found"), "OK")
    if over is not None:
        out = out.join(over.withColumn("over", F.lit(True)), "board_id", "left")
        verdict = verdict.when(F.col("over"), "UNKNOWN")
    return out.select("board_id", verdict.otherwise("NG").alias("verdict"), "invalid_reason")


def node_stats(spark: SparkSession, discs: int) -> DataFrame:
    """discs, processed (distinct boards that were played on) and generated (boards after their moves, before any
    removal of duplicates) of the forward table."""
    out = spark.createDataFrame([], "discs int, processed long, generated long")
    for n, level in enumerate(forward_levels(spark, discs)[:-1], 4):
        counts = level.agg(F.count("*").alias("processed"), F.coalesce(F.sum(bits.popcount(bits.moves(F.col("player"), F.col("opponent")), F.lit(0).cast("long")).cast("long")), F.lit(0)).alias("generated"))
        out = out.unionByName(counts.select(F.lit(n).alias("discs"), "processed", "generated"))
    return out


def reverse_best_first(boards: DataFrame, discs: int, leaves: DataFrame | None = None, batch: int = 1000, max_nodes: int = 1_000_000, strict: bool = False, keep=None) -> DataFrame:
    """Verdicts by best-first search: in every round the ``batch`` open boards of smallest h_score of each board_id are
    taken; leaves settle their board_id, the others are replaced by their predecessors.  ``keep`` is a further
    predicate (a linear program, say) on the boards taken.  Opened boards are never opened again."""
    from pyspark.sql import Window

    spark = boards.sparkSession
    if leaves is None:
        leaves = forward_table(spark, discs)[1]
    marked = staged(boards.select("board_id", *BOARD, filters.validate().alias("invalid_reason")), "boards")
    open_ = staged(moves.canonical(_seeds(marked.where("invalid_reason IS NULL"))).dropDuplicates(["board_id", *BOARD]), "open")
    seen = open_
    solved = spark.createDataFrame([], "board_id long")
    unknown = spark.createDataFrame([], "board_id long")
    order = Window.partitionBy("board_id").orderBy("h", bits.flip_sign(F.col("player")), bits.flip_sign(F.col("opponent")))
    taken_sofar = spark.createDataFrame([], "board_id long, nodes long")
    while not open_.isEmpty():
        ranked = staged(open_.withColumn("h", bits.h_score(F.col("player"), F.col("opponent"))).withColumn("place", F.row_number().over(order)), "ranked")
        taken = ranked.where(F.col("place") <= batch).select("board_id", *BOARD)
        hit = moves.meet(taken.where(bits.popcount(F.col("player"), F.col("opponent")) == discs), leaves).select("board_id")
        solved = staged(solved.unionByName(hit).distinct(), "solved")
        taken_sofar = staged(taken_sofar.unionByName(taken.groupBy("board_id").agg(F.count("*").alias("nodes"))).groupBy("board_id").agg(F.sum("nodes").alias("nodes")), "nodes")
        unknown = taken_sofar.where(F.col("nodes") > max_nodes).select("board_id")
        grow = taken.where(bits.popcount(F.col("player"), F.col("opponent")) > discs)
        if keep is not None:
            grow = grow.where(keep)
        fresh = reverse_level(grow.join(solved, "board_id", "left_anti").join(unknown, "board_id", "left_anti"), strict).select("board_id", *BOARD)
        fresh = staged(fresh.join(seen, ["board_id", *BOARD], "left_anti"), "fresh")
        seen = seen.unionByName(fresh)  # a part for each round, none written again
        rest = ranked.where(F.col("place") > batch).select("board_id", *BOARD)
        open_ = staged(rest.unionByName(fresh).join(solved, "board_id", "left_anti").join(unknown, "board_id", "left_anti"), "open")
    out = marked.select("board_id", "invalid_reason").join(solved.withColumn("found", F.lit(True)), "board_id", "left").join(unknown.withColumn("over", F.lit(True)), "board_id", "left")
    return out.select("board_id", F.when(F.col("found"), "OK").when(F.col("over"), "UNKNOWN").otherwise("NG").alias("verdict"), "invalid_reason")
