"""One registered query per operator, and its oracle where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boardsift.functions import bits, stats, udfs
from boardsift.operators import filters, moves, summaries
from boardsift.oracle import statement, text_of
from boardsift.plans import search
from boardsift.solve import linear, sat
from boardsift.sources import boards as sources
from boardsift.sources import sinks
from boardsift.staging import new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SUPPLIER = {"table": "supplier", "key": "s_suppkey"}
NATION = {"table": "nation", "key": "n_nationkey"}


def register(name: str, oracle: str | None = None):
    def put(query: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = query
        if oracle is not None:
            ORACLES[name] = oracle
        return query

    return put


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def boards(spark: SparkSession, sf: str, name: str = "customer", key: str = "c_custkey") -> DataFrame:
    return sources.boards_of_keys(table(spark, sf, name), key)


def suppliers(spark: SparkSession, sf: str) -> DataFrame:
    return boards(spark, sf, "supplier", "s_suppkey")


def nations(spark: SparkSession, sf: str) -> DataFrame:
    return boards(spark, sf, "nation", "n_nationkey")


def c(name: str):
    return F.col(name)


def occupied():
    return filters.occupied()


def text(player="player", opponent="opponent"):
    return bits.to_text(c(player) if isinstance(player, str) else player, c(opponent) if isinstance(opponent, str) else opponent)


# sources


@register("parse_board", statement("SELECT k, board FROM b WHERE k % 7 <> 0", "b"))
def _(spark, sf):
    line = F.when(c("k") % 7 == 0, F.expr("substring(board, 2)")).otherwise(F.concat(F.lit("> "), F.expr("substring(board, 1, 30)"), F.lit(" .\t"), F.expr("substring(board, 31)"), F.lit("!")))
    return boards(spark, sf).select("k", sources.parse_board(line).alias("board")).where("board IS NOT NULL")


@register("scan_boards_text", statement("SELECT board, count(*) AS n FROM b GROUP BY board", "b", **SUPPLIER))
def _(spark, sf):
    path = new_path(spark, "lines")
    suppliers(spark, sf).select(F.concat("board", F.lit(" \r")).alias("value")).unionByName(spark.createDataFrame([("junk",)], "value string")).write.text(path)
    return sources.scan_boards_text(spark, path).groupBy("board").agg(F.count("*").alias("n"))


@register("scan_boards_bin", statement("SELECT board FROM b GROUP BY board", "b", **SUPPLIER))
def _(spark, sf):
    path = new_path(spark, "layer")
    sinks.write_layer_bin(suppliers(spark, sf), path)
    return sources.scan_boards_bin(spark, path).select(text().alias("board"))


@register("scan_rank_text", "SELECT (c_custkey::VARCHAR || '00000000000000000007')::HUGEINT::VARCHAR AS rank FROM customer")
def _(spark, sf):
    lines = table(spark, sf, "customer").select(F.concat(F.lit(" "), c("c_custkey").cast("string"), F.lit("00000000000000000007 ")).alias("value"))
    return sources.scan_rank_text(lines.unionByName(spark.createDataFrame([("  ",)], "value string"))).select(c("rank").cast("string").alias("rank"))


_RANK = "(c_custkey::HUGEINT * 123456789012345::HUGEINT * 1234567890::HUGEINT) % 678258532403459256228710931216::HUGEINT"


@register(
    "rank_decode",
    f"""WITH RECURSIVE r AS (SELECT c_custkey AS k, {_RANK} AS v, 0 AS i, '' AS s FROM customer
        UNION ALL SELECT k, v // (CASE WHEN i IN (27, 28, 35, 36) THEN 2 ELSE 3 END), i + 1, s || (CASE WHEN i IN (27, 28, 35, 36) THEN substr('XO', (v % 2)::INTEGER + 1, 1) ELSE substr('-XO', (v % 3)::INTEGER + 1, 1) END) FROM r WHERE i < 64)
        SELECT k, s AS board FROM r WHERE i = 64""",
)
def _(spark, sf):
    big = lambda x: F.lit(x).cast("decimal(38,0)")
    rank = ((c("c_custkey").cast("decimal(10,0)") * F.expr("cast('123456789012345' AS decimal(16,0))")).cast("decimal(26,0)") * F.expr("cast('1234567890' AS decimal(11,0))")).cast("decimal(38,0)") % big("678258532403459256228710931216")
    return table(spark, sf, "customer").select(c("c_custkey").alias("k"), sources.rank_decode(rank).alias("board"))


@register("scan_solver_stats", "SELECT c_custkey::INTEGER AS index, c_custkey % 3 = 0 AS ans, (c_custkey * 7)::INTEGER AS vars, (c_custkey * 11 + 5)::INTEGER AS clauses FROM customer")
def _(spark, sf):
    return sources.scan_solver_stats(_solver_lines(spark, sf))


def _solver_lines(spark, sf):
    k = c("c_custkey")
    return table(spark, sf, "customer").select(F.concat(F.lit("index="), k, F.lit(", ans="), (k % 3 == 0).cast("string"), F.lit(", vars="), k * 7, F.lit(",  clauses="), k * 11 + 5).alias("value"))


@register("scan_occupancy_text", statement("SELECT k, length(replace(board, '-', '')) AS discs FROM b", "b"))
def _(spark, sf):
    lines = boards(spark, sf).select("k", F.translate("board", "X", "G").alias("value"))
    return sources.scan_occupancy_text(lines).select("k", F.bit_count("occupied").cast("long").alias("discs"))


@register("gen_uniform", "SELECT i AS board_id, TRUE AS sound FROM range(1000) t(i)")
def _(spark, sf):
    return sources.gen_uniform(spark, 1000, 1).select("board_id", filters.validate().isNull().alias("sound"))


@register("gen_fixed_discs", "SELECT i AS board_id, 24 AS discs FROM range(1000) t(i)")
def _(spark, sf):
    return sources.gen_fixed_discs(spark, 1000, 20, 1).select("board_id", bits.popcount(c("player"), c("opponent")).alias("discs"))


@register("random_play", "SELECT i AS board_id, 24 AS discs, NULL::VARCHAR AS error FROM range(200) t(i)")
def _(spark, sf):
    return sources.random_play(spark, 200, 20, 1).select("board_id", F.least(bits.popcount(c("player"), c("opponent")), F.lit(24)).alias("discs"), filters.validate().alias("error"))


# scalar functions


@register("board_to_string", statement("SELECT k, board FROM b", "b"))
def _(spark, sf):
    return boards(spark, sf).select("k", text().alias("board"))


@register("board_show", statement(r"SELECT k, regexp_replace(board, '(.{8})', '\1' || chr(10), 'g') AS shown FROM b", "b"))
def _(spark, sf):
    return boards(spark, sf).select("k", bits.show(c("player"), c("opponent")).alias("shown"))


@register("occupied_to_string", statement("SELECT k, translate(board, 'XO', 'GG') AS occupied FROM b", "b"))
def _(spark, sf):
    return boards(spark, sf).select("k", bits.occupied_text(occupied()).alias("occupied"))


@register("popcount", statement("SELECT k, length(replace(board, '-', ''))::INTEGER AS discs FROM b", "b"))
def _(spark, sf):
    return boards(spark, sf).select("k", bits.popcount(c("player"), c("opponent")).alias("discs"))


def _shifted(sign: str) -> str:
    return statement(f"SELECT k, name, string_agg(CASE WHEN x - ({sign}dx) BETWEEN 0 AND 7 AND y - ({sign}dy) BETWEEN 0 AND 7 AND substr(board, (y - ({sign}dy)) * 8 + x - ({sign}dx) + 1, 1) = 'X' THEN 'G' ELSE '-' END, '' ORDER BY sq) AS moved FROM b, sq, dirs GROUP BY k, name", "b", "sq", "dirs", **SUPPLIER)


def _each_direction(df, move):
    rows = F.explode(F.array(*(F.struct(F.lit(d).alias("name"), bits.occupied_text(move(d, c("player"))).alias("moved")) for d in bits.NAMES)))
    return df.select("k", rows.alias("r")).select("k", "r.name", "r.moved")


@register("shift_dir", _shifted(""))
def _(spark, sf):
    return _each_direction(suppliers(spark, sf), bits.step)


@register("backshift", _shifted("-"))
def _(spark, sf):
    return _each_direction(suppliers(spark, sf), bits.step_back)


for _name, _change, _s in (("mirror_h", bits.mirror_h, 1), ("mirror_v", bits.mirror_v, 2), ("transpose", bits.transpose, 4)):

    def _mirror(spark, sf, change=_change):
        return boards(spark, sf).select("k", text(change(c("player")), change(c("opponent"))).alias("image"))

    register(_name, statement(f"SELECT k, image FROM images WHERE s = {_s}", "images"))(_mirror)


@register("symmetry", statement("SELECT k, s, image FROM images", "images"))
def _(spark, sf):
    rows = boards(spark, sf).select("k", F.posexplode(bits.images(c("player"), c("opponent"))).alias("s", "b"))
    return rows.select("k", "s", text(c("b.player"), c("b.opponent")).alias("image"))


@register("unique", statement("SELECT k, arg_min(image, pk || ok) AS image FROM keys GROUP BY k", "keys"))
def _(spark, sf):
    return moves.canonical(boards(spark, sf).select("k", "player", "opponent")).select("k", text().alias("image"))


@register("unique_native", statement("SELECT k, arg_min(image, pk || ok) AS image FROM keys GROUP BY k", "keys"))
def _(spark, sf):
    found = boards(spark, sf).select("k", bits.unique(c("player"), c("opponent")).alias("u"))
    return found.select("k", text(c("u.player"), c("u.opponent")).alias("image"))


@register("flip", statement("SELECT k, sq AS square, string_agg(flipped::VARCHAR, ',' ORDER BY flipped) AS flipped FROM (SELECT DISTINCT * FROM turned) GROUP BY k, sq", "turned", **SUPPLIER))
def _(spark, sf):
    rows = suppliers(spark, sf).select("*", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("square"))
    rows = rows.select("k", "square", bits.flip(bits.square_bit(c("square")), c("player"), c("opponent")).alias("f")).where("f <> 0")
    return rows.select("k", "square", F.array_join(bits.bits_of(c("f")), ",").alias("flipped"))


@register("get_moves", statement("SELECT b.k, coalesce(string_agg(sq::VARCHAR, ',' ORDER BY sq), '') AS moves FROM b LEFT JOIN (SELECT DISTINCT k, sq FROM turned) t USING (k) GROUP BY b.k", "turned", "b"))
def _(spark, sf):
    return boards(spark, sf).select("k", F.array_join(bits.bits_of(bits.moves(c("player"), c("opponent"))), ",").alias("moves"))


_CHILDREN = "SELECT m.k, m.sq AS square, string_agg(CASE WHEN z.sq = m.sq THEN 'O' WHEN z.sq = t.flipped THEN 'O' WHEN z.c = 'X' THEN 'O' WHEN z.c = 'O' THEN 'X' ELSE '-' END, '' ORDER BY z.sq) AS board FROM (SELECT DISTINCT k, sq FROM turned) m JOIN cells z USING (k) LEFT JOIN (SELECT DISTINCT * FROM turned) t ON t.k = m.k AND t.sq = m.sq AND t.flipped = z.sq GROUP BY m.k, m.sq"
for _name in ("forward_moves", "apply_move"):

    def _children(spark, sf):
        return moves.forward_moves(suppliers(spark, sf).select("k", "player", "opponent")).select("k", "square", text().alias("board"))

    register(_name, statement(_CHILDREN, "turned", "cells", **SUPPLIER))(_children)


@register("swap_side", statement("SELECT k, translate(board, 'XO', 'OX') AS board FROM b", "b"))
def _(spark, sf):
    return boards(spark, sf).select("k", text("opponent", "player").alias("board"))


# in each direction the run of O beside an O allows 0 to max(run, 1) - 1 turned discs
_RETRO = "lens AS (SELECT a.k, a.sq, dd.d, greatest(coalesce(min(CASE WHEN z.c <> 'O' THEN r.j END), count(r.j) + 1) - 1, 1) AS n FROM cells a CROSS JOIN dirs dd LEFT JOIN rays r ON r.sq = a.sq AND r.d = dd.d LEFT JOIN cells z ON z.k = a.k AND z.sq = r.sq2 WHERE a.c = 'O' AND NOT a.centre GROUP BY ALL)"
_RETRO_COUNT = "SELECT k, sq AS square, product(n)::BIGINT - 1 AS sets, round(product(n) * sum((n - 1) / 2.0))::BIGINT AS discs FROM lens GROUP BY k, sq HAVING product(n) > 1"
for _name in ("retro_flips", "predecessors"):

    def _before(spark, sf):
        found = moves.predecessors(suppliers(spark, sf), "k")
        return found.groupBy("k", "square").agg(F.count("*").alias("sets"), F.sum(F.bit_count("flipped")).alias("discs"))

    register(_name, statement(_RETRO_COUNT, "cells", "rays", more=_RETRO, **SUPPLIER))(_before)


@register("retro_board", statement("SELECT k, square, sets AS boards, sets * (d - 1) AS discs FROM (" + _RETRO_COUNT + ") JOIN (SELECT k, length(replace(board, '-', '')) AS d FROM b) USING (k)", "cells", "rays", more=_RETRO, **SUPPLIER))
def _(spark, sf):
    found = moves.predecessors(suppliers(spark, sf), "k")
    return found.groupBy("k", "square").agg(F.count("*").alias("boards"), F.sum(bits.popcount(c("player"), c("opponent"))).alias("discs"))


@register("predecessors_strict")
def _(spark, sf):
    return moves.predecessors(suppliers(spark, sf), "k", strict=True).groupBy("k", "square").agg(F.count("*").alias("sets"))


@register("line_run_lengths", statement("SELECT k, sq, d, (run + 1)::INTEGER AS run FROM runs", "runs", **SUPPLIER))
def _(spark, sf):
    rows = suppliers(spark, sf).select("k", F.posexplode(udfs.line_runs(occupied())).alias("at", "run")).where("run > 0")
    return rows.select("k", F.floor(c("at") / 8).cast("int").alias("sq"), (c("at") % 8).cast("int").alias("d"), "run")


@register("features", statement("SELECT k, 0 AS in_sq, in_edge::INTEGER AS in_edge, same_all::INTEGER AS same_all, same_min::INTEGER AS same_min FROM feat", "feat"))
def _(spark, sf):
    return boards(spark, sf).select("k", bits.features(c("player"), c("opponent")).alias("f")).select("k", "f.*")


_H = "(1.0 + 1.0 / (in_edge + 1) + 1.0 / (same_all + 1) + 1.0 / (same_min + 1)) * pow(2.0, length(replace(board, '-', '')))"


@register("h_score", statement(f"SELECT k, printf('%.9e', {_H}) AS h FROM feat JOIN b USING (k)", "feat", "b"))
def _(spark, sf):
    return boards(spark, sf).select("k", F.format_string("%.9e", bits.h_score(c("player"), c("opponent"))).alias("h"))


_PART = "CASE WHEN centre OR sq % 3 <> 0 THEN c ELSE '-' END"


@register(
    "stable_discs",
    statement(
        """SELECT k, coalesce(string_agg(sq::VARCHAR, ',' ORDER BY sq), '') AS stable FROM part p WHERE c <> '-' AND NOT EXISTS (
             SELECT 1 FROM prun r JOIN rays e ON e.sq = r.sq AND e.d = r.d AND e.j = r.run + 1 JOIN cells z ON z.k = r.k AND z.sq = e.sq2 AND z.c <> '-'
             JOIN rays f ON f.sq = r.sq AND f.d = (r.d + 4) % 8 AND f.j = 1 JOIN cells y ON y.k = r.k AND y.sq = f.sq2 AND y.c <> '-' WHERE r.k = p.k AND r.sq = p.sq) GROUP BY k""",
        "cells",
        "rays",
        more=f"part AS (SELECT k, sq, {_PART} AS c FROM cells), prun AS (SELECT a.k, a.sq, dd.d, coalesce(min(CASE WHEN z.c = '-' THEN r.j END), count(r.j) + 1) - 1 AS run FROM part a CROSS JOIN dirs dd LEFT JOIN rays r ON r.sq = a.sq AND r.d = dd.d LEFT JOIN part z ON z.k = a.k AND z.sq = r.sq2 WHERE a.c <> '-' GROUP BY ALL)",
        **SUPPLIER,
    ),
)
def _(spark, sf):
    keep = bits.mask(sum(1 << i for i in range(64) if i % 3 or i in bits.CENTRE_SQUARES))
    found = suppliers(spark, sf).select("k", udfs.stable_discs(occupied().bitwiseAND(keep), occupied()).alias("s")).where("s <> 0")
    return found.select("k", F.array_join(bits.bits_of(c("s")), ",").alias("stable"))


@register(
    "combination",
    """WITH RECURSIVE p AS (SELECT 0 AS n, [1::HUGEINT] AS row UNION ALL
       SELECT n + 1, list_transform(range(1, len(row) + 2), lambda i: (CASE WHEN i > 1 THEN row[i - 1] ELSE 0 END)::HUGEINT + (CASE WHEN i <= len(row) THEN row[i] ELSE 0 END)::HUGEINT) FROM p WHERE n < 60)
       SELECT n_nationkey AS k, (n_nationkey + 30) AS n, r_regionkey * 9 AS r, coalesce(row[r_regionkey * 9 + 1], 0)::VARCHAR AS c FROM nation, region JOIN p ON p.n = n_nationkey + 30""",
)
def _(spark, sf):
    rows = table(spark, sf, "nation").crossJoin(F.broadcast(table(spark, sf, "region")))
    rows = rows.select(c("n_nationkey").alias("k"), (c("n_nationkey") + 30).alias("n"), (c("r_regionkey") * 9).alias("r"))
    return rows.withColumn("c", stats.combination(c("n"), c("r")).cast("string"))


_Z = stats.norm_ppf(0.005)
_WILSON = "((p + {z} * {z} / (2 * n)) {sign} {z} * sqrt(p * (1 - p) / n + {z} * {z} / (4 * n * n))) / (1 + {z} * {z} / n)"


def _wilson(sign: str) -> str:
    return _WILSON.replace("{z}", repr(_Z)).replace("{sign}", sign)


@register("wilson_bounds", f"SELECT k, round({_wilson('-')}, 9) AS lower, round({_wilson('+')}, 9) AS upper FROM (SELECT c_custkey AS k, (c_custkey % 50) / 100.0::DOUBLE AS p, 100.0::DOUBLE AS n FROM customer)")
def _(spark, sf):
    bound = stats.wilson_bounds((c("c_custkey") % 50).cast("double"), F.lit(100.0), _Z)
    return table(spark, sf, "customer").select(c("c_custkey").alias("k"), F.round(bound["lower"], 9).alias("lower"), F.round(bound["upper"], 9).alias("upper"))


@register("norm_ppf", f"SELECT 1 AS one, {round(2.807033768343811, 9)} AS z")
def _(spark, sf):
    return spark.range(1).select(F.lit(1).alias("one"), F.lit(round(stats.norm_ppf(0.005), 9)).alias("z"))


@register("scale_to_population", "SELECT c_custkey AS k, round(c_custkey / 1000000.0 * 678258532403459256228710931216 / 1e20) AS boards FROM customer")
def _(spark, sf):
    return table(spark, sf, "customer").select(c("c_custkey").alias("k"), F.round(stats.scale_to_population(c("c_custkey") / 1e6) / 1e20).alias("boards"))


@register("mask_to_moves", statement("SELECT b.k, '[,' || coalesce(string_agg('(' || (sq % 8) || ', ' || (sq // 8) || ')', ',' ORDER BY sq) || ',', '') || ']' AS moves FROM b LEFT JOIN (SELECT DISTINCT k, sq FROM turned) t USING (k) GROUP BY b.k", "turned", "b"))
def _(spark, sf):
    return boards(spark, sf).select("k", bits.mask_to_moves(bits.moves(c("player"), c("opponent"))).alias("moves"))


@register("onebit", "SELECT c_custkey AS k, bit_count((c_custkey % 256)::INTEGER) <= 1 AS one FROM customer")
def _(spark, sf):
    return table(spark, sf, "customer").select(c("c_custkey").alias("k"), bits.onebit(c("c_custkey") % 256).alias("one"))


@register("rand_below", "SELECT c_custkey AS k, TRUE AS inside FROM customer")
def _(spark, sf):
    drawn = table(spark, sf, "customer").withColumn("r", sources.rand_below(1000))
    return drawn.select(c("c_custkey").alias("k"), c("r").between(0, 999).alias("inside"))


# filters


@register("validate", statement("SELECT k, CASE WHEN k % 5 = 0 THEN 'Overlap' WHEN k % 7 = 0 THEN 'MissingCenter' END AS error FROM b", "b"))
def _(spark, sf):
    low = bits.mask(1 << 27)
    rows = boards(spark, sf).withColumn("player", F.when(c("k") % 5 == 0, c("player").bitwiseOR(low)).when(c("k") % 7 == 0, c("player").bitwiseAND(F.bitwise_not(low))).otherwise(c("player")))
    rows = rows.withColumn("opponent", F.when(c("k") % 5 == 0, c("opponent").bitwiseOR(low)).when(c("k") % 7 == 0, c("opponent").bitwiseAND(F.bitwise_not(low))).otherwise(c("opponent")))
    return rows.select("k", filters.validate().alias("error"))


_SYM = "SELECT k, bool_and(own <= ck || pk) AS keep FROM (SELECT *, first_value(ck || pk) OVER (PARTITION BY k ORDER BY s) AS own FROM keys) GROUP BY k"


@register("sym", statement(_SYM, "keys"))
def _(spark, sf):
    return boards(spark, sf).select("k", filters.sym().alias("keep"))


_CON = "linked AS (SELECT k, sq FROM cells WHERE centre UNION SELECT l.k, z.sq FROM linked l JOIN rays r ON r.sq = l.sq AND r.j = 1 JOIN cells z ON z.k = l.k AND z.sq = r.sq2 AND z.c <> '-')"
_CON_SELECT = "SELECT k, n = length(replace(board, '-', '')) AS keep FROM (SELECT k, count(*) AS n FROM linked GROUP BY k) JOIN b USING (k)"


@register("con", statement(_CON_SELECT, "cells", "rays", more=_CON))
def _(spark, sf):
    return boards(spark, sf).select("k", filters.con().alias("keep"))


@register("reachable_mask", statement(f"SELECT k, {text_of('e')} AS seen FROM seen", "seen"))
def _(spark, sf):
    return boards(spark, sf).select("k", bits.occupied_text(bits.explained(occupied())).alias("seen"))


@register("occupancy", statement("SELECT k, e = occ AS keep FROM seen", "seen"))
def _(spark, sf):
    return boards(spark, sf).select("k", filters.occupancy().alias("keep"))


@register("occupancy_order", statement(f"SELECT k, sq, {text_of('m')} AS older FROM ordr", "ordr", **NATION))
def _(spark, sf):
    rows = nations(spark, sf).select("k", F.posexplode(udfs.occupancy_order(occupied())).alias("sq", "m")).where("m <> 0")
    return rows.select("k", "sq", bits.occupied_text(c("m")).alias("older"))


_SEG3 = """long AS (SELECT k, sq, d FROM runs WHERE run >= 2 AND NOT centre), single AS (SELECT k, sq, any_value(d) AS d FROM long GROUP BY k, sq HAVING count(*) = 1),
  edge AS (SELECT o.k, o.sq AS a, r.sq2 AS z FROM single o JOIN rays r ON r.sq = o.sq AND r.d = o.d AND r.j <= 2), path AS (SELECT k, a, z FROM edge UNION SELECT p.k, p.a, e.z FROM path p JOIN edge e ON e.k = p.k AND e.a = p.z)"""


@register("seg3", statement("SELECT b.k, NOT EXISTS (SELECT 1 FROM runs u WHERE u.k = b.k AND NOT centre AND NOT EXISTS (SELECT 1 FROM long l WHERE l.k = u.k AND l.sq = u.sq)) AND NOT EXISTS (SELECT 1 FROM path p WHERE p.k = b.k AND p.a = p.z) AS keep FROM b", "b", "runs", more=_SEG3, **SUPPLIER))
def _(spark, sf):
    return suppliers(spark, sf).select("k", udfs.seg3(occupied()).alias("keep"))


ORACLES["no_cycle"] = ORACLES["seg3"]
QUERIES["no_cycle"] = QUERIES["seg3"]

_MORE = """put AS (SELECT o.k, o.sq, o.d FROM oldruns o JOIN sq s USING (sq) WHERE o.run >= 2 AND NOT s.centre),
  flips AS (SELECT p.k, p.sq, p.d FROM runs p JOIN runs q ON q.k = p.k AND q.sq = p.sq AND q.d = p.d + 4 AND p.run >= 1 AND q.run >= 1 WHERE p.d < 4),
  fixed AS (SELECT k, sq, c FROM cells WHERE c <> '-' AND NOT centre AND NOT EXISTS (SELECT 1 FROM flips f WHERE f.k = cells.k AND f.sq = cells.sq)),
  cand AS (SELECT x.k, x.sq, p.d, n.c = x.c AS own1, f.c = x.c AS own2,
      EXISTS (SELECT 1 FROM flips t WHERE t.k = x.k AND t.sq = n.sq AND t.d <> p.d % 4) AS oth1, EXISTS (SELECT 1 FROM flips t WHERE t.k = x.k AND t.sq = f.sq AND t.d <> p.d % 4) AS oth2, EXISTS (SELECT 1 FROM flips t WHERE t.k = x.k AND t.sq = f.sq) AS any2
      FROM fixed x JOIN put p ON p.k = x.k AND p.sq = x.sq JOIN rays r1 ON r1.sq = x.sq AND r1.d = p.d AND r1.j = 1 JOIN rays r2 ON r2.sq = x.sq AND r2.d = p.d AND r2.j = 2 JOIN cells n ON n.k = x.k AND n.sq = r1.sq2 JOIN cells f ON f.k = x.k AND f.sq = r2.sq2),
  judged AS (SELECT k, sq, bool_or(CASE WHEN NOT own1 AND NOT oth1 THEN FALSE WHEN NOT own2 AND NOT any2 THEN FALSE WHEN NOT own2 AND NOT oth2 AND own1 AND NOT oth1 THEN FALSE ELSE TRUE END) AS fine FROM cand GROUP BY k, sq)"""


@register("seg3_more", statement("SELECT s.k, NOT EXISTS (SELECT 1 FROM judged j WHERE j.k = s.k AND NOT fine) AS keep FROM seen s WHERE e = occ", "seen", "runs", "oldruns", more=_MORE, **SUPPLIER))
def _(spark, sf):
    return suppliers(spark, sf).where(filters.occupancy()).select("k", udfs.seg3_more("player", "opponent").alias("keep"))


@register("cascade", statement("SELECT s.k, CASE WHEN NOT y.keep THEN 'sym' WHEN NOT n.keep THEN 'con' WHEN s.e <> s.occ THEN 'occupancy' WHEN EXISTS (SELECT 1 FROM judged j WHERE j.k = s.k AND NOT fine) THEN 'seg3_more' END AS rejected_by FROM seen s JOIN (" + _SYM + ") y USING (k) JOIN (" + _CON_SELECT + ") n USING (k)", "seen", "runs", "oldruns", "keys", more=_MORE + ", " + _CON, **SUPPLIER))
def _(spark, sf):
    return filters.cascade(suppliers(spark, sf)).select("k", "rejected_by")


def _spoiled(played: DataFrame) -> DataFrame:
    """Boards, and from 1000 on the same with one more disc far from all others, which no line of play can place."""
    far = occupied().bitwiseOR(bits.spread(bits.spread(occupied())))
    lost = played.withColumn("square", F.get(bits.bits_of(F.bitwise_not(far)), F.lit(0))).where("square IS NOT NULL")
    lost = lost.withColumn("player", c("player").bitwiseOR(bits.square_bit(c("square")))).withColumn("board_id", c("board_id") + 1000)
    return played.select("board_id", "player", "opponent").unionByName(lost.select("board_id", "player", "opponent"))


def _by_kind(count: int, spoiled: int, good: str, bad: str) -> str:
    return f"SELECT i AS board_id, {good} FROM range({count}) t(i) UNION ALL SELECT i + 1000, {bad} FROM range({spoiled}) t(i)"


# boards of random play can be reached, so no filter may reject them; a disc that no other explains can't be


@register("sat", _by_kind(12, 12, "'OK' AS verdict", "'NG'"))
def _(spark, sf):
    return sat.verdicts(_spoiled(_played(spark, 10, 12)), "board_id").select("board_id", "verdict")


@register("lp", _by_kind(12, 12, "'OK' AS verdict", "'NG'"))
def _(spark, sf):
    return linear.verdicts(_spoiled(_played(spark, 10, 12)), "board_id")


@register("ip", _by_kind(12, 12, "TRUE AS kept", "FALSE"))
def _(spark, sf):
    return linear.verdicts(_spoiled(_played(spark, 10, 12)), "board_id", integer=True).select("board_id", (F.col("verdict") != "NG").alias("kept"))


@register("fwd_compatible")
def _(spark, sf):
    targets = nations(spark, sf).select(c("k").alias("t_id"), c("player").alias("t_player"), c("opponent").alias("t_opponent"))
    return filters.fwd_compatible(search.forward_levels(spark, 6)[-1], targets).groupBy("t_id").agg(F.count("*").alias("boards"))


QUERIES["target_theta"] = QUERIES["fwd_compatible"]
QUERIES["any_of"] = QUERIES["fwd_compatible"]


@register("stones_eq", statement("SELECT k, board FROM b WHERE length(replace(board, '-', '')) = 57", "b"))
def _(spark, sf):
    return boards(spark, sf).where(filters.stones_equal(57)).select("k", "board")


# joins and sets


@register("split_by_set", statement("SELECT k, k IN (SELECT s_suppkey FROM supplier) AS in_set FROM b", "b"))
def _(spark, sf):
    return moves.split_by_set(boards(spark, sf), suppliers(spark, sf)).select("k", "in_set")


_MEET = "SELECT k FROM h WHERE k IN (SELECT s_suppkey FROM supplier)"
for _name in ("meet_leaf", "meet_leaf_sorted", "leaf_test"):

    def _meet(spark, sf):
        mine = moves.canonical(boards(spark, sf).select("k", "player", "opponent"))
        leaves = moves.canonical(suppliers(spark, sf).select("player", "opponent"))
        return moves.meet(mine, leaves).select("k")

    register(_name, statement(_MEET, "h"))(_meet)


@register("visited_anti", statement("SELECT k FROM h WHERE k NOT IN (SELECT s_suppkey FROM supplier)", "h"))
def _(spark, sf):
    mine = moves.canonical(boards(spark, sf).select("k", "player", "opponent"))
    return moves.not_visited(mine, moves.canonical(suppliers(spark, sf).select("player", "opponent")), ["player", "opponent"]).select("k")


@register("union_pass", statement("SELECT b.k, b.board FROM b UNION ALL SELECT k, translate(board, 'XO', 'OX') FROM b WHERE k IN (SELECT k FROM flipless)", "b", "dirs", "sq", "rays", more="fcells AS (SELECT k, sq, translate(substr(board, sq + 1, 1), 'XO', 'OX') AS c FROM b, sq), fstops AS (SELECT a.k, a.sq, r.d, min(r.j) AS j FROM fcells a JOIN rays r USING (sq) JOIN fcells z ON z.k = a.k AND z.sq = r.sq2 WHERE a.c = '-' AND z.c <> 'O' GROUP BY ALL), can AS (SELECT DISTINCT s.k FROM fstops s JOIN rays r ON r.sq = s.sq AND r.d = s.d AND r.j = s.j AND s.j > 1 JOIN fcells z ON z.k = s.k AND z.sq = r.sq2 AND z.c = 'X'), flipless AS (SELECT k FROM b WHERE k NOT IN (SELECT k FROM can))"))
def _(spark, sf):
    return moves.with_passes(boards(spark, sf).select("k", "player", "opponent")).select("k", text().alias("board"))


for _name in ("distinct", "count_distinct_keys", "merge_sorted_distinct"):

    def _distinct(spark, sf, name=_name):
        runs = [boards(spark, sf), suppliers(spark, sf)]
        if name == "merge_sorted_distinct":
            return moves.merge_sorted_distinct(runs).agg(F.count("*").alias("boards"))
        return summaries.count_distinct(runs[0].unionByName(runs[1]))

    register(_name, "SELECT count(*) AS boards FROM (SELECT c_custkey AS k FROM customer UNION SELECT s_suppkey FROM supplier)")(_distinct)


# summaries


@register("count_by_discs", statement("SELECT length(replace(board, '-', ''))::INTEGER AS discs, count(*) AS boards FROM b GROUP BY 1", "b"))
def _(spark, sf):
    return summaries.count_by_discs(boards(spark, sf))


@register("avg_discs", statement("SELECT round(avg(length(replace(board, '-', ''))), 6) AS avg_discs, count(*) AS boards FROM b", "b"))
def _(spark, sf):
    return summaries.average_discs(boards(spark, sf))


_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def _with_segment(spark, sf):
    return boards(spark, sf).join(table(spark, sf, "customer").select(c("c_custkey").alias("k"), "c_mktsegment"), "k")


_PIVOT = "SELECT length(replace(board, '-', ''))::INTEGER AS discs, " + ", ".join(f"count(*) FILTER (c_mktsegment = '{s}') AS \"{s}\"" for s in _SEGMENTS) + " FROM b JOIN customer ON c_custkey = k GROUP BY 1"


@register("pivot_discs", statement(_PIVOT, "b"))
def _(spark, sf):
    return summaries.pivot_discs(_with_segment(spark, sf), "c_mktsegment", _SEGMENTS)


@register("sink_markdown", statement("SELECT row_number() OVER (ORDER BY discs)::BIGINT + 1 AS line, '| ' || concat_ws(' | ', discs, " + ", ".join(f'"{s}"' for s in _SEGMENTS) + ") || ' |' AS value FROM (" + _PIVOT + ") UNION ALL VALUES (0, '| discs | " + " | ".join(_SEGMENTS) + " |'), (1, '|" + " ---: |" * 6 + "')", "b"))
def _(spark, sf):
    return sinks.markdown(summaries.pivot_discs(_with_segment(spark, sf), "c_mktsegment", _SEGMENTS), "discs", _SEGMENTS)


@register("totals_by_file", "SELECT c_mktsegment, count(*) AS boards FROM customer GROUP BY 1")
def _(spark, sf):
    return summaries.totals(_with_segment(spark, sf), "c_mktsegment")


@register("minmax_bounds", "SELECT min(c_custkey * 7)::INTEGER AS min_vars, max(c_custkey * 7)::INTEGER AS max_vars, min(c_custkey * 11 + 5)::INTEGER AS min_clauses, max(c_custkey * 11 + 5)::INTEGER AS max_clauses FROM customer")
def _(spark, sf):
    return sinks.plot_bounds(sources.scan_solver_stats(_solver_lines(spark, sf)))


QUERIES["sink_scatter"], ORACLES["sink_scatter"] = QUERIES["minmax_bounds"], ORACLES["minmax_bounds"]

_VERDICT = "CASE WHEN k % 11 = 0 THEN 'UNKNOWN' WHEN keep THEN 'OK' ELSE 'NG' END"


def _verdicts(spark, sf):
    return boards(spark, sf).select("k", "board", F.when(c("k") % 11 == 0, "UNKNOWN").when(filters.con(), "OK").otherwise("NG").alias("verdict"))


@register("wilson_ci", statement(f"SELECT ok, ng, unknown, round({_wilson('-')}, 6) AS lower, round({_wilson('+').replace('p', 'q').replace('sqrt'.replace('p', 'q'), 'sqrt')}, 6) AS upper, round({_wilson('-')} * 678258532403459256228710931216 / 1e24) AS population_lower FROM (SELECT *, ok / n AS p, (ok + unknown) / n AS q FROM (SELECT count(*) FILTER (v = 'OK') AS ok, count(*) FILTER (v = 'NG') AS ng, count(*) FILTER (v = 'UNKNOWN') AS unknown, count(*)::DOUBLE AS n FROM (SELECT {_VERDICT} AS v FROM ({_CON_SELECT}))))", "cells", "rays", more=_CON))
def _(spark, sf):
    found = summaries.wilson_ci(_verdicts(spark, sf))
    return found.select("ok", "ng", "unknown", F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"), F.round(c("population_lower") / 1e24).alias("population_lower"))


@register("verdict_counts", statement(f"SELECT v AS verdict, count(*) AS boards FROM (SELECT {_VERDICT} AS v FROM ({_CON_SELECT})) GROUP BY 1", "cells", "rays", more=_CON))
def _(spark, sf):
    return summaries.totals(_verdicts(spark, sf), "verdict")

# sinks


@register("sink_split", statement("SELECT CASE WHEN keep THEN 'OK' ELSE 'NG' END AS verdict, count(*) AS boards FROM (" + _CON_SELECT + ") GROUP BY 1", "cells", "rays", more=_CON))
def _(spark, sf):
    path = new_path(spark, "split")
    sinks.write_split(boards(spark, sf), filters.con(), path)
    return spark.read.text(path).groupBy("verdict").agg(F.count("*").alias("boards"))


@register("partition_complement", "SELECT count(*) AS boards FROM customer")
def _(spark, sf):
    path = new_path(spark, "split")
    sinks.write_split(boards(spark, sf), filters.occupancy(), path)
    return spark.read.text(path).agg(F.count("*").alias("boards"))


@register("sink_explain", statement(f"SELECT CASE WHEN e = occ THEN 'OK' ELSE 'NG' END AS verdict, {text_of('e')} AS value, count(*) AS n FROM seen GROUP BY 1, 2", "seen", **SUPPLIER))
def _(spark, sf):
    path = new_path(spark, "explained")
    sinks.write_explained(suppliers(spark, sf), path)
    return spark.read.text(path).groupBy("verdict", "value").agg(F.count("*").alias("n"))


@register("sink_tri", statement(f"SELECT {_VERDICT} AS verdict, count(*) AS boards FROM ({_CON_SELECT}) GROUP BY 1", "cells", "rays", more=_CON))
def _(spark, sf):
    path = new_path(spark, "tri")
    sinks.write_verdicts(_verdicts(spark, sf), path)
    return spark.read.text(path).groupBy("verdict").agg(F.count("*").alias("boards"))


@register("sink_bin", statement("SELECT board FROM b GROUP BY board", "b"))
def _(spark, sf):
    path = new_path(spark, "layer")
    sinks.write_layer(boards(spark, sf).dropDuplicates(["player", "opponent"]), path)
    return spark.read.parquet(path).select(text().alias("board"))


for _name in ("sink_steps", "occupancy_steps"):

    def _steps(spark, sf):
        rows = sinks.growth_steps(suppliers(spark, sf))
        return rows.groupBy("k").agg((F.max("step") + 1).alias("steps"), F.max_by("mask", "step").alias("last")).select("k", "steps", bits.occupied_text(c("last")).alias("last"))

    register(_name, statement(f"SELECT k, bit_count(e)::BIGINT - 3 AS steps, {text_of('e')} AS last FROM seen", "seen", **SUPPLIER))(_steps)


@register("sink_dimacs")
def _(spark, sf):
    return sat.dimacs(_played(spark, 16, 12), "board_id")


@register("sink_lp_solution")
def _(spark, sf):
    return linear.rows(_played(spark, 16, 12), "board_id").groupBy("board_id").agg(F.count("*").alias("entries"), F.countDistinct("row").alias("rows"), F.countDistinct("symbol").alias("columns"))


# order


_ORDER = "row_number() OVER (ORDER BY reverse(translate(board, 'XO-', '100')), reverse(translate(board, 'XO-', '010')))"


@register("sort_boards", statement(f"SELECT k, {_ORDER} AS place FROM b", "b"))
def _(spark, sf):
    return moves.placed(boards(spark, sf).select("k", "player", "opponent")).select("k", "place")


@register("pop_best", statement(f"SELECT k FROM feat JOIN b USING (k) ORDER BY {_H}, reverse(translate(board, 'XO-', '100')), reverse(translate(board, 'XO-', '010')) LIMIT 10", "feat", "b"))
def _(spark, sf):
    return moves.pop_best(boards(spark, sf), 10).select("k")


@register("order_children")
def _(spark, sf):
    children = moves.forward_moves(suppliers(spark, sf).select("k", "player", "opponent"))
    return moves.order_children(children, "k").select("k", "square", "place", text().alias("board"))


# searches: the tables of the start position, known layer sizes as oracle

_LAYERS = "SELECT * FROM (VALUES (4, 1), (5, 1), (6, 3), (7, 14), (8, 60)) t(discs, boards)"


@register("layer_counts", _LAYERS)
def _(spark, sf):
    internal, leaves = search.forward_table(spark, 8)
    both = internal.unionByName(leaves.withColumn("discs", F.lit(8)))
    return both.groupBy("discs").agg(F.count("*").alias("boards"))


for _name in ("forward_table", "forward_expand"):
    QUERIES[_name], ORACLES[_name] = QUERIES["layer_counts"], _LAYERS


@register("node_stats", "SELECT * FROM (VALUES (4, 1, 4), (5, 1, 3), (6, 3, 14), (7, 14, 61)) t(discs, processed, generated)")
def _(spark, sf):
    return search.node_stats(spark, 8)


def _played(spark, plies: int, count: int = 20) -> DataFrame:
    return sources.random_play(spark, count, plies, 7)


_KINDS = _by_kind(20, 20, "'OK' AS verdict", "'NG'")
# depth first: with the best board opened alone, a few at once, and many at once
for _name, _batch in (("reverse_dfs", 8), ("reverse_dfs_ordered", 1), ("reverse_dfs_parallel", 64)):

    def _dived(spark, sf, batch=_batch):
        return search.reverse_dfs(_spoiled(_played(spark, 7)), 7, batch=batch).select("board_id", "verdict")

    register(_name, _KINDS)(_dived)

# by level: without a dive before, and with one
for _name, _dive in (("reverse_bfs", search.FIRST_DIVE), ("reverse_bfs_blocked", 0), ("reverse_bfs_parallel", 0)):

    def _reverse(spark, sf, dive=_dive):
        return search.reverse_bfs(_spoiled(_played(spark, 7)), 7, first_dive=dive).select("board_id", "verdict")

    register(_name, _KINDS)(_reverse)


@register("reverse_bfs_resume", _KINDS)
def _(spark, sf):
    """The first level is written, and a search goes on from the file."""
    played = _spoiled(_played(spark, 7))
    path = new_path(spark, "level")
    search.reverse_level(search._seeds(played)).write.parquet(path)
    return search.reverse_bfs(played, 7, resume=spark.read.parquet(path)).select("board_id", "verdict")


@register("reverse_gbfs", _KINDS)
def _(spark, sf):
    return search.reverse_best_first(_spoiled(_played(spark, 6)), 7).select("board_id", "verdict")


@register("node_limit", "SELECT i AS board_id, 'UNKNOWN' AS verdict FROM range(20) t(i)")
def _(spark, sf):
    return search.reverse_bfs(_played(spark, 7), 4, leaves=spark.createDataFrame([], "player long, opponent long"), max_nodes=1).select("board_id", "verdict")


@register("forward_table_pruned")
def _(spark, sf):
    targets = _played(spark, 10, 5).select(c("board_id").alias("t_id"), c("player").alias("t_player"), c("opponent").alias("t_opponent"))
    return search.forward_table_pruned(spark, targets, 7).groupBy("t_id").agg(F.count("*").alias("boards"))


@register("flagship", statement(f"SELECT verdict, count(*) AS boards FROM (SELECT CASE WHEN y.keep AND n.keep THEN 'OK' ELSE 'NG' END AS verdict FROM ({_SYM}) y JOIN ({_CON_SELECT}) n USING (k)) GROUP BY 1", "keys", "cells", "rays", more=_CON))
def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Boards of customers through the first filters, counted by verdict."""
    keep = filters.validate().isNull() & filters.sym() & filters.con()
    return boards(spark, sf).select(F.when(keep, "OK").otherwise("NG").alias("verdict")).groupBy("verdict").agg(F.count("*").alias("boards"))
