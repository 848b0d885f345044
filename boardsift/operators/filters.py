"""Predicates of the cascade, as columns; true keeps a board."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardsift.functions import bits
from boardsift.functions.udfs import seg3_more, stable_discs


def occupied() -> Column:
    return F.col("player").bitwiseOR(F.col("opponent"))


def validate() -> Column:
    """Null for a sound board, else Overlap or MissingCenter."""
    centre = bits.mask(bits.CENTRE)
    return F.when(F.col("player").bitwiseAND(F.col("opponent")) != 0, "Overlap").when(occupied().bitwiseAND(centre) != centre, "MissingCenter")


def sym() -> Column:
    """No image has a smaller (occupied, player), unsigned."""
    key = lambda b: F.struct(bits.flip_sign(b["player"].bitwiseOR(b["opponent"])).alias("o"), bits.flip_sign(b["player"]).alias("p"))
    return bits.let(F.transform(bits.images(F.col("player"), F.col("opponent")), key), lambda keys: F.array_min(keys) == keys[0])


def con() -> Column:
    """All discs hang together with the centre, which must be full."""
    return bits.connected(occupied()) == occupied()


def occupancy() -> Column:
    centre = bits.mask(bits.CENTRE)
    return (occupied().bitwiseAND(centre) == centre) & (bits.explained(occupied()) == occupied())


def cascade(df: DataFrame) -> DataFrame:
    """First filter that rejects each board, in the order that the later ones rely on; null for boards that pass."""
    known = df.withColumn("rejected_by", F.when(validate().isNotNull(), "invalid").when(~sym(), "sym").when(~con(), "con").when(~occupancy(), "occupancy"))
    return known.withColumn("rejected_by", F.when(F.col("rejected_by").isNotNull(), F.col("rejected_by")).when(~seg3_more("player", "opponent"), "seg3_more"))


#: Targets whose images are broadcast at most.
FEW = 10_000


def _fits(i: Column, j: Column) -> Column:
    """Whether a board can still grow into the board (i, j): its discs are discs there, and those that can never turn
    agree in colour, maybe all swapped."""
    union = i.bitwiseOR(j)
    stable = stable_discs(occupied(), union)
    s = lambda x: x.bitwiseAND(stable)
    agree = ((s(F.col("player")) == s(i)) & (s(F.col("opponent")) == s(j))) | ((s(F.col("player")) == s(j)) & (s(F.col("opponent")) == s(i)))
    return (occupied().bitwiseAND(F.bitwise_not(union)) == 0) & agree


def _with_images(df: DataFrame) -> DataFrame:
    """A row for each image (i_player, i_opponent) of the target (t_player, t_opponent)."""
    rows = df.withColumn("image", F.explode(bits.images(F.col("t_player"), F.col("t_opponent"))))
    return rows.withColumn("i_player", F.col("image.player")).withColumn("i_opponent", F.col("image.opponent")).drop("image")


def grown_into_target(df: DataFrame) -> DataFrame:
    """The distinct rows whose boards can still grow into some image of the target (t_player, t_opponent) beside them."""
    return _with_images(df).where(_fits(F.col("i_player"), F.col("i_opponent"))).select(*df.columns).distinct()


def fwd_compatible(boards: DataFrame, targets: DataFrame) -> DataFrame:
    """board rows x target rows (columns of targets prefixed ``t_``) such that the board can still grow into some image
    of the target.

    Every pair has to be looked at, so up to ``FEW`` targets are broadcast, eight images each; more are left to the
    planner, in blocks of both sides.
    """
    images = _with_images(targets)
    i, j = F.col("i_player"), F.col("i_opponent")
    if targets.limit(FEW + 1).count() <= FEW:
        images = F.broadcast(images)
    both = boards.join(images, occupied().bitwiseAND(F.bitwise_not(i.bitwiseOR(j))) == 0)
    return both.where(_fits(i, j)).select(*boards.columns, *targets.columns).distinct()


def stones_equal(n: int) -> Column:
    return bits.popcount(F.col("player"), F.col("opponent")) == n
