"""The command line: ``python -m boardsift COMMAND ...``.

Inputs are files or folders of board lines that Spark can read; results are folders of lines by verdict.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boardsift.functions import bits, kernels
from boardsift.functions.udfs import seg3_more
from boardsift.operators import filters, summaries
from boardsift.plans import search
from boardsift.solve import linear, sat
from boardsift.sources import boards as sources
from boardsift.sources import sinks

PREDICATES = {"con": filters.con, "occupancy": filters.occupancy, "sym": filters.sym, "seg3-more": lambda: seg3_more("player", "opponent")}
SEARCHES = ("dfs", "dfs-move-ordering", "dfs-parallel", "gbfs-parallel", "bfs", "bfs-parallel")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="boardsift")
    commands = top.add_subparsers(dest="command", required=True)
    check = commands.add_parser("check", help="split boards by a predicate")
    check.add_argument("predicate", choices=[*PREDICATES, "sat", "lp"])
    check.add_argument("inputs", nargs="+")
    check.add_argument("-o", "--output", default="result")
    check.add_argument("--ip", action="store_true", help="lp: integers only")
    reverse = commands.add_parser("reverse_to_initial", help="search backwards to the forward table")
    reverse.add_argument("search", choices=SEARCHES)
    reverse.add_argument("input", nargs="?", default="board.txt")
    reverse.add_argument("-o", "--output", default="result")
    reverse.add_argument("-d", "--discs", type=int, default=10)
    reverse.add_argument("--max-nodes", type=int, default=1_000_000)
    reverse.add_argument("--use-lp", action="store_true", help="gbfs-parallel: drop boards that the linear program rejects")
    reverse.add_argument("--table-size", type=int, help="accepted and ignored: tables are not bounded by entries")
    reverse.add_argument("--threads", type=int, help="accepted and ignored: Spark's master says how many tasks run")
    interval = commands.add_parser("compute_ci", help="interval of the share of reachable boards")
    for name in ("ok", "ng", "unknown"):
        interval.add_argument(f"--{name}", type=int, required=True)
    interval.add_argument("--alpha", type=float, default=0.005)
    boards = commands.add_parser("gen_random_boards", help="random boards")
    boards.add_argument("-n", type=int, default=0, help="discs beside the centre; 0: uniform over all positions")
    boards.add_argument("-c", type=int, default=50)
    boards.add_argument("--seed", type=int, default=0)
    boards.add_argument("-o", "--output", required=True)
    play = commands.add_parser("random_play", help="boards after random play, one folder for each number of plies")
    play.add_argument("--plies", type=int, nargs=2, default=(20, 60))
    play.add_argument("-c", type=int, default=50)
    play.add_argument("--seed", type=int, default=0)
    play.add_argument("-o", "--output", required=True)
    ranks = commands.add_parser("rnd_to_txt", help="boards of ranks")
    ranks.add_argument("input")
    ranks.add_argument("-o", "--output", required=True)
    fix = commands.add_parser("fix_sat_file", help="boards of the inputs that are not in a list of satisfiable ones")
    fix.add_argument("inputs", nargs="+")
    fix.add_argument("-s", "--sat-file", required=True)
    fix.add_argument("-o", "--output", required=True)
    steps = commands.add_parser("vis_occupancy_steps", help="how the explained squares of a board grow")
    steps.add_argument("board")
    steps.add_argument("-o", "--output", required=True)
    stones = commands.add_parser("stone_stats", help="boards by number of discs, and the mean")
    stones.add_argument("inputs", nargs="+")
    stones.add_argument("--stones", type=int, help="only the boards of so many discs")
    counts = commands.add_parser("plot_cnf_counts", help="axis bounds of solver statistics")
    counts.add_argument("--input", required=True)
    return top


def _boards(spark: SparkSession, paths: list[str]) -> DataFrame:
    out = sources.scan_boards_text(spark, paths[0])
    for path in paths[1:]:
        out = out.unionByName(sources.scan_boards_text(spark, path))
    return out


def _lines(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def _by_verdict(boards: DataFrame, verdicts: DataFrame, path: str) -> None:
    sinks.write_verdicts(boards.join(verdicts.select("board_id", "verdict"), "board_id").where("verdict IS NOT NULL"), path)


def _check(spark: SparkSession, args: argparse.Namespace) -> None:
    boards = _boards(spark, args.inputs)
    if args.predicate in PREDICATES:
        sinks.write_split(boards, PREDICATES[args.predicate](), args.output)
        return
    numbered = search.staged(boards.withColumn("board_id", F.monotonically_increasing_id()), "boards")
    verdicts = sat.verdicts(numbered, "board_id") if args.predicate == "sat" else linear.verdicts(numbered, "board_id", integer=args.ip)
    _by_verdict(numbered, verdicts, args.output)


def _reverse(spark: SparkSession, args: argparse.Namespace) -> None:
    numbered = search.staged(_boards(spark, [args.input]).withColumn("board_id", F.monotonically_increasing_id()), "boards")
    if args.search == "gbfs-parallel":
        keep = linear.keeps("player", "opponent") if args.use_lp else None
        found = search.reverse_best_first(numbered, args.discs, max_nodes=args.max_nodes, keep=keep)
    elif args.search.startswith("dfs"):
        batch = {"dfs": 8, "dfs-move-ordering": 1, "dfs-parallel": 64}[args.search]
        found = search.reverse_dfs(numbered, args.discs, max_nodes=args.max_nodes, batch=batch)
    else:
        found = search.reverse_bfs(numbered, args.discs, max_nodes=args.max_nodes)
    _by_verdict(numbered, found, args.output)


def run(spark: SparkSession, argv: list[str]) -> None:
    args = parser().parse_args(argv)
    if args.command == "check":
        _check(spark, args)
    elif args.command == "reverse_to_initial":
        _reverse(spark, args)
    elif args.command == "compute_ci":
        counts = [("OK", args.ok), ("NG", args.ng), ("UNKNOWN", args.unknown)]
        for name, value in summaries.interval(spark, counts, args.alpha).first().asDict().items():
            print(f"{name}: {value:.6f}" if name in ("lower", "upper") else f"{name}: {value:.6e}" if "population" in name else f"{name}: {value}")
    elif args.command == "gen_random_boards":
        _lines(sources.gen_fixed_discs(spark, args.c, args.n, args.seed) if args.n else sources.gen_uniform(spark, args.c, args.seed), "board", args.output)
    elif args.command == "random_play":
        for plies in range(args.plies[0], args.plies[1] + 1):
            _lines(sources.random_play(spark, args.c, plies, args.seed + plies), "board", f"{args.output}/plies={plies}")
    elif args.command == "rnd_to_txt":
        _lines(sources.scan_rank_text(spark.read.text(args.input)).select(sources.rank_decode(F.col("rank")).alias("board")), "board", args.output)
    elif args.command == "fix_sat_file":
        _lines(_boards(spark, args.inputs).select("board").join(sources.scan_boards_text(spark, args.sat_file).select("board"), "board", "left_anti"), "board", args.output)
    elif args.command == "vis_occupancy_steps":
        marks = [i for i, x in enumerate(args.board) if x in "GXO"]
        if len(args.board) != 64:
            raise ValueError("a board has 64 squares")
        masks = [(i, bits.signed(m)) for i, m in enumerate(kernels.growth_steps(sum(1 << i for i in marks)))]
        _lines(spark.createDataFrame(masks, "step long, mask long").orderBy("step").select(bits.occupied_text(F.col("mask")).alias("board")), "board", args.output)
    elif args.command == "stone_stats":
        boards = _boards(spark, args.inputs)
        if args.stones is not None:
            boards = boards.where(filters.stones_equal(args.stones))
        for row in summaries.count_by_discs(boards).orderBy("discs").collect():  # 65 rows at most
            print(f"{row['discs']}: {row['boards']}")
        print(f"mean: {summaries.average_discs(boards).first()[0]}")
    elif args.command == "plot_cnf_counts":
        print(sinks.plot_bounds(sources.scan_solver_stats(spark.read.text(args.input))).first().asDict())


def main() -> None:
    run(SparkSession.builder.appName("boardsift").getOrCreate(), sys.argv[1:])
