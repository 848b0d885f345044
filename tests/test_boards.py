"""Board operators against laws, goldens and plain Python."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from boardsift.functions import bits, kernels
from boardsift.operators import filters, moves, summaries
from boardsift import cli
from boardsift.plans import dive, search
from boardsift.solve import linear, sat
from boardsift.sources import boards as sources
from boardsift.sources import sinks


def played(n, plies):
    out = [kernels.random_play(plies, np.random.default_rng([3, i])) for i in range(n)]
    return np.array(out, np.uint64)


def frame(spark, boards):
    rows = [(i, bits.signed(int(p)), bits.signed(int(o))) for i, (p, o) in enumerate(boards)]
    return spark.createDataFrame(rows, "board_id long, player long, opponent long")


def test_images_form_a_group():
    b = played(50, 30)
    for p, o in kernels.images(b[:, 0], b[:, 1]):
        assert (kernels.canonical(p, o)[0] == kernels.canonical(b[:, 0], b[:, 1])[0]).all()
    assert (kernels.mirror_h(kernels.mirror_h(b[:, 0])) == b[:, 0]).all()
    assert (kernels.transpose(kernels.transpose(b[:, 0])) == b[:, 0]).all()


def test_native_and_kernel_agree(spark):
    b = played(30, 40)
    df = frame(spark, b)
    rows = df.select("board_id", bits.moves(F.col("player"), F.col("opponent")).alias("m"), bits.explained(filters.occupied()).alias("e"), bits.unique(F.col("player"), F.col("opponent")).alias("u")).orderBy("board_id").collect()
    assert [r["m"] for r in rows] == kernels.moves(b[:, 0], b[:, 1]).view(np.int64).tolist()
    assert [r["e"] for r in rows] == kernels.explained(b[:, 0] | b[:, 1]).view(np.int64).tolist()
    assert [r["u"]["player"] for r in rows] == kernels.canonical(b[:, 0], b[:, 1])[0].view(np.int64).tolist()


def test_moves_match_plain_python():
    for p, o in played(20, 25).tolist():
        want = {s: f for s, f in kernels.legal(p, o)}
        mask = int(kernels.moves(np.array([p], np.uint64), np.array([o], np.uint64))[0])
        assert {s for s in range(64) if mask >> s & 1} == set(want)
        for s, f in want.items():
            assert int(kernels.flip(np.array([1 << s], np.uint64), np.array([p], np.uint64), np.array([o], np.uint64))[0]) == f


def test_reachable_boards_pass_every_filter():
    b = played(100, 45)
    occupied = b[:, 0] | b[:, 1]
    assert kernels.pruned(b[:, 0], b[:, 1]).all()
    assert kernels.seg3(occupied).all()


def test_strict_predecessors_replay():
    b = played(10, 12)
    row, square, flipped, p, o = kernels.parents(b[:, 0], b[:, 1], strict=True)
    bit = np.uint64(1) << square.astype(np.uint64)
    assert len(row) and (o ^ flipped == b[row, 0]).all() and (p ^ (flipped | bit) == b[row, 1]).all()
    assert (kernels.flip(bit, p, o) == flipped).all()
    assert len(kernels.parents(b[:, 0], b[:, 1])[0]) >= len(row)


def test_forward_table(spark):
    internal, leaves = search.forward_table(spark, 8)
    assert (internal.count(), leaves.count()) == (19, 60)


def test_reverse_search_modes(spark):
    line = "------------------OOO-----XOX-----OXXX--------------------------"
    df = sources.with_masks(spark.createDataFrame([(1, line)], "board_id long, board string"))
    assert search.reverse_bfs(df, 9).first()["verdict"] == "OK"
    assert search.reverse_bfs(df, 9, strict=True).first()["verdict"] == "NG"


def test_unsound_boards(spark):
    df = spark.createDataFrame([(1, 1 << 27, 1 << 27), (2, 1 << 27, 1 << 28)], "board_id long, player long, opponent long")
    found = {r["board_id"]: (r["verdict"], r["invalid_reason"]) for r in search.reverse_bfs(df, 5).collect()}
    assert found == {1: ("NG", "Overlap"), 2: ("NG", "MissingCenter")}


def test_interval(spark):
    verdicts = spark.createDataFrame([("OK",)] * 147 + [("UNKNOWN",)] * 504, "verdict string").unionByName(spark.range(999349).select(F.lit("NG").alias("verdict")))
    row = summaries.wilson_ci(verdicts).first()
    assert (round(row["lower"], 6), round(row["upper"], 6)) == (0.000117, 0.000727)
    assert f"{row['population_lower']:.6e}" == "7.913957e+25" and f"{row['population_upper']:.6e}" == "4.928495e+26"
    with pytest.raises(ValueError):
        summaries.wilson_ci(verdicts, 1.0)


def test_parse_and_binary(spark, tmp_path):
    lines = spark.createDataFrame([("X" * 63,), ("-" * 65,), (" X" + "-" * 63 + "!",), (None,)], "value string")
    assert [r[0] for r in lines.select(sources.parse_board(F.col("value"))).where(F.expr("1=1")).collect()].count(None) == 3
    b = frame(spark, played(40, 20))
    assert sinks.write_layer_bin(b, str(tmp_path / "layer")) == b.select("player", "opponent").distinct().count()
    assert sources.scan_boards_bin(spark, str(tmp_path / "layer")).count() == b.select("player", "opponent").distinct().count()


def test_generators(spark):
    rows = sources.gen_fixed_discs(spark, 50, 17, 5).collect()
    assert {64 - r["board"].count("-") for r in rows} == {21} and len({r["board"] for r in rows}) > 45
    assert sources.gen_uniform(spark, 50, 5).where(filters.validate().isNotNull()).count() == 0


def test_satisfiability_and_program():
    for p, o in played(3, 14).tolist():
        n, clauses = sat.encode(p, o)
        assert sat.solve(n, clauses) is True
        assert linear.check(p, o) == "OK"
    # a disc that no run of three reaches
    far = sum(1 << s for s in (28, 35)) | 1
    assert sat.solve(*sat.encode(far, sum(1 << s for s in (27, 36)))) is False
    assert linear.check(far, sum(1 << s for s in (27, 36))) == "NG"
    with pytest.raises(ValueError):
        sat.encode(1, 2)


def test_solver_against_brute_force():
    random.seed(4)
    for _ in range(200):
        n = random.randint(3, 8)
        clauses = [[random.choice((1, -1)) * random.randint(1, n) for _ in range(3)] for _ in range(random.randint(5, 40))]
        want = any(all(any((x > 0) == bool(m >> (abs(x) - 1) & 1) for x in c) for c in clauses) for m in range(1 << n))
        assert sat.solve(n, clauses) is want


def test_dives_settle_played_boards(spark):
    """Boards of 20 plies are all reached; an empty one is unsound."""
    boards = sources.random_play(spark, 6, 20, 3).select("board_id", "player", "opponent").unionByName(spark.createDataFrame([(10, 0, 0)], "board_id long, player long, opponent long"))
    found = {r["board_id"]: r for r in search.reverse_dfs(boards, 10).collect()}
    assert [found[i]["verdict"] for i in range(6)] == ["OK"] * 6 and found[10]["verdict"] == "NG" and found[10]["invalid_reason"] == "MissingCenter"
    assert all(found[i]["found"] >= found[i]["opened"] > 0 for i in range(6))
    few = {r["board_id"]: r["verdict"] for r in search.reverse_dfs(boards.where("board_id < 6"), 10, max_nodes=5).collect()}
    assert set(few.values()) == {"UNKNOWN"}


def test_known_boards_against_a_set():
    r = np.random.default_rng(1)
    known, plain = dive.Known(), set()
    for _ in range(40):
        p, o = r.integers(0, 50, (2, 30)).astype(np.uint64)
        assert known.has(p, o).tolist() == [x in plain for x in zip(p.tolist(), o.tolist())]
        fresh = [x for x in set(zip(p.tolist(), o.tolist())) if x not in plain]
        plain |= set(fresh)
        known.add(*(np.array([x[k] for x in fresh], np.uint64) for k in (0, 1)))


def test_command_line(spark, tmp_path, capsys):
    out = str(tmp_path / "out")
    cli.run(spark, ["compute_ci", "--ok", "147", "--ng", "999349", "--unknown", "504"])
    said = capsys.readouterr().out
    assert "lower: 0.000117" in said and "upper: 0.000727" in said and "population_lower: 7.913957e+25" in said
    cli.run(spark, ["random_play", "--plies", "6", "7", "-c", "3", "-o", out])
    cli.run(spark, ["check", "con", out, "-o", str(tmp_path / "con")])
    assert spark.read.text(str(tmp_path / "con")).groupBy("verdict").count().collect() == [("OK", 6)]
    for how in ("dfs", "bfs"):
        cli.run(spark, ["reverse_to_initial", how, out, "--discs", "7", "-o", str(tmp_path / how)])
        assert spark.read.text(str(tmp_path / how)).groupBy("verdict").count().collect() == [("OK", 6)]
    cli.run(spark, ["gen_random_boards", "-n", "10", "-c", "4", "-o", str(tmp_path / "made")])
    capsys.readouterr()
    cli.run(spark, ["stone_stats", str(tmp_path / "made")])
    assert capsys.readouterr().out.split("\n")[:2] == ["14: 4", "mean: 14.0"]
    cli.run(spark, ["fix_sat_file", out, "-s", out, "-o", str(tmp_path / "fixed")])
    assert spark.read.text(str(tmp_path / "fixed")).count() == 0


def test_explained_squares_of_many_boards(spark):
    """A lambda computes what it names anew for each element, so sets have to be computed before."""
    boards = sources.boards_of_keys(spark.range(20_000), "id")
    start = time.monotonic()
    rows = boards.select("k", bits.occupied_text(bits.explained(filters.occupied())).alias("seen")).orderBy("k").collect()
    assert time.monotonic() - start < 20
    masks = np.array([r[:] for r in boards.orderBy("k").select("player", "opponent").collect()], np.int64).view(np.uint64)
    want = kernels.explained(masks[:, 0] | masks[:, 1]).tolist()
    assert [r["seen"] for r in rows] == ["".join("G" if x >> i & 1 else "-" for i in range(64)) for x in want]


def test_text_of_any_length_to_masks_and_back(spark):
    lines = ["X" * 64, "-" * 64, "O" + "-" * 62 + "X", "", "XO", "01x\u00e9O" + "X" * 59, None]
    rows = spark.createDataFrame([(x,) for x in lines], "t string").select(bits.from_text(F.col("t"), "X").alias("x"), bits.from_text(F.col("t"), "OX").alias("b")).collect()
    bit = lambda t, of: t if t is None else bits.signed(sum(1 << i for i, c in enumerate(t) if c in of))
    assert [tuple(r) for r in rows] == [(bit(t, "X"), bit(t, "OX")) for t in lines]
    shown = spark.createDataFrame([(-1,), (1,), (-(1 << 63),), (0,), (None,)], "m long").select(bits.occupied_text(F.col("m"))).collect()
    assert [r[0] for r in shown] == ["G" * 64, "G" + "-" * 63, "-" * 63 + "G", "-" * 64, "-" * 64]


def test_split_computes_a_verdict_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def judged(i):
        seen.add(1)
        return [True, False, None][i % 3]

    sinks.write_split(spark.range(300).select("id", F.lit("-").alias("board")), judged("id"), str(tmp_path / "split"))
    assert sorted(spark.read.text(str(tmp_path / "split")).groupBy("verdict").count().collect()) == [("NG", 100), ("OK", 100)]
    assert seen.value == 300


def test_connected_along_a_snake(spark):
    """Sets that take many steps from the centre, and the same with a gap in them."""
    snake = [27, 26, 25, 24, 16, 8, 0, 1, 2, 3, 4, 5, 6, 7, 15, 23, 31, 39, 47, 55, 63, 62, 61, 60, 59, 58, 57, 56]
    whole = sum(1 << i for i in snake) | bits.CENTRE
    gap = whole & ~(1 << 4)
    row = spark.createDataFrame([(bits.signed(whole), bits.signed(gap))], "w long, g long").select(bits.connected(F.col("w")), bits.connected(F.col("g"))).first()
    assert row[0] == bits.signed(whole)
    assert row[1] == bits.signed(sum(1 << i for i in snake[: snake.index(4)]) | bits.CENTRE)


def test_connected_of_many_boards(spark, tmp_path):
    """Most boards hang together after a few steps, so few go through all 60."""
    boards = sources.boards_of_keys(spark.range(100_000), "id")
    start = time.monotonic()
    sinks.write_split(boards, filters.con(), str(tmp_path / "con"))
    assert time.monotonic() - start < 15
    assert spark.read.text(str(tmp_path / "con")).count() == 100_000
