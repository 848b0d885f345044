"""Boards as two LONG columns (bit sets of the mover's and the other's discs), in native column expressions.

Square i = 8 y + x is bit i.  Spark's LONG is signed, so boards are ordered by ``flip_sign`` of their masks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Directions in order, as (dx, dy); direction d + 4 is opposite to d.
DIRECTIONS = {"E": (1, 0), "NE": (1, 1), "N": (0, 1), "NW": (-1, 1), "W": (-1, 0), "SW": (-1, -1), "S": (0, -1), "SE": (1, -1)}
NAMES = list(DIRECTIONS)
#: The four centre squares, and the start position.
CENTRE_SQUARES = (27, 28, 35, 36)
START_PLAYER, START_OPPONENT = 0x0000000810000000, 0x0000001008000000


def signed(mask: int) -> int:
    """An unsigned 64-bit number as a LONG of the same bits."""
    return mask - (1 << 64) if mask >> 63 else mask


def squares_mask(squares) -> int:
    return sum(1 << s for s in squares)


CENTRE = squares_mask(CENTRE_SQUARES)
_FILE_A, _FILE_H = squares_mask(range(0, 64, 8)), squares_mask(range(7, 64, 8))
_MIN = -(1 << 63)


def mask(value: int) -> Column:
    return F.lit(signed(value)).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def flip_sign(x: Column) -> Column:
    return x.bitwiseXOR(mask(1 << 63))


def step(name: str, x: Column) -> Column:
    """All squares of a set moved one to a direction; what leaves the board is gone."""
    dx, dy = DIRECTIONS[name]
    by = 8 * dy + dx
    if dx:
        x = x.bitwiseAND(mask(~(_FILE_H if dx > 0 else _FILE_A) & (2**64 - 1)))
    return F.shiftleft(x, by) if by > 0 else F.shiftrightunsigned(x, -by)


def opposite(name: str) -> str:
    return NAMES[(NAMES.index(name) + 4) % 8]


def step_back(name: str, x: Column) -> Column:
    return step(opposite(name), x)


def union(sets: list[Column]) -> Column:
    out = sets[0]
    for x in sets[1:]:
        out = out.bitwiseOR(x)
    return out


def popcount(player: Column, opponent: Column) -> Column:
    return (F.bit_count(player) + F.bit_count(opponent)).cast("int")


def _swapped(x: Column, by: int, low: int) -> Column:
    """Neighbouring groups of ``by`` bits change places; ``low`` marks the lower group of each pair."""
    return F.shiftrightunsigned(x, by).bitwiseAND(mask(low)).bitwiseOR(F.shiftleft(x.bitwiseAND(mask(low)), by))


def _groups(by: int) -> int:
    return squares_mask(i for i in range(64) if i // by % 2 == 0)


def mirror_h(x: Column) -> Column:
    """File A to H and back."""
    for by in (1, 2, 4):
        x = _swapped(x, by, _groups(by))
    return x


def mirror_v(x: Column) -> Column:
    """Rank 1 to 8 and back."""
    for by in (8, 16, 32):
        x = _swapped(x, by, _groups(by))
    return x


def transpose(x: Column) -> Column:
    """Square (x, y) to (y, x): bit k of the column number changes places with bit k of the row number."""
    for k in (0, 1, 2):
        x = let(x, _exchange(7 << k, squares_mask(i for i in range(64) if i >> k & 1 and not i >> (k + 3) & 1)))
    return x


def _exchange(by: int, lower: int) -> Callable[[Column], Column]:
    """Bits of ``lower`` change places with those ``by`` above them."""
    def body(v: Column) -> Column:
        moved = F.shiftrightunsigned(v, by).bitwiseXOR(v).bitwiseAND(mask(lower))
        return let(moved, lambda t: v.bitwiseXOR(t).bitwiseXOR(F.shiftleft(t, by)))

    return body


def symmetry(x: Column, s: int) -> Column:
    """Image s of a set: bit 0 mirrors files, then bit 1 mirrors ranks, then bit 2 transposes."""
    for bit, change in ((1, mirror_h), (2, mirror_v), (4, transpose)):
        if s & bit:
            x = let(x, change)
    return x


def images(player: Column, opponent: Column) -> Column:
    """Array of the eight images (player, opponent)."""
    def four(p: Column, o: Column) -> list[Column]:
        return [F.struct(symmetry(p, s).alias("player"), symmetry(o, s).alias("opponent")) for s in range(4)]

    flat = F.array(*four(player, opponent))
    turned = F.transform(flat, lambda b: F.struct(transpose(b["player"]).alias("player"), transpose(b["opponent"]).alias("opponent")))
    return F.concat(flat, turned)


def unique(player: Column, opponent: Column) -> Column:
    """The smallest image by (player, opponent), unsigned: struct(player, opponent)."""
    keys = F.transform(images(player, opponent), lambda b: F.struct(flip_sign(b["player"]).alias("player"), flip_sign(b["opponent"]).alias("opponent")))
    return let(F.array_min(keys), lambda b: F.struct(flip_sign(b["player"]).alias("player"), flip_sign(b["opponent"]).alias("opponent")))


def _run(name: str, start: Column, through: Column) -> Column:
    """Squares reached from ``start`` by steps in one direction over ``through`` only."""
    first = start.bitwiseAND(through)
    return F.aggregate(F.sequence(F.lit(1), F.lit(5)), first, lambda f, _: f.bitwiseOR(step(name, f).bitwiseAND(through)))


def flip(move: Column, player: Column, opponent: Column) -> Column:
    """Discs turned by a disc on the squares of ``move`` (a set of one); 0 on an occupied square."""
    def closed(d: str) -> Callable[[Column], Column]:
        return lambda f: F.when(step(d, f).bitwiseAND(player) != 0, f).otherwise(F.lit(0).cast("long"))

    parts = [let(_run(d, step(d, move), opponent), closed(d)) for d in NAMES]
    return F.when(move.bitwiseAND(player.bitwiseOR(opponent)) != 0, F.lit(0).cast("long")).otherwise(union(parts))


def moves(player: Column, opponent: Column) -> Column:
    """Empty squares on which the mover turns at least one disc."""
    ends = union([step(d, _run(d, step(d, player), opponent)) for d in NAMES])
    return ends.bitwiseAND(F.bitwise_not(player.bitwiseOR(opponent)))


def play(move: Column, flipped: Column, player: Column, opponent: Column) -> Column:
    """The board after a move, seen by the other side."""
    return F.struct(opponent.bitwiseXOR(flipped).alias("player"), player.bitwiseXOR(flipped.bitwiseOR(move)).alias("opponent"))


def unplay(move: Column, flipped: Column, player: Column, opponent: Column) -> Column:
    """The board before the other side put a disc on ``move`` and turned ``flipped``."""
    return F.struct(opponent.bitwiseXOR(flipped.bitwiseOR(move)).alias("player"), player.bitwiseXOR(flipped).alias("opponent"))


def bits_of(x: Column) -> Column:
    """Squares of a set, ascending, as an array."""
    return F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("getbit", x, i) == 1)


def square_bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), i)


def to_text(player: Column, opponent: Column) -> Column:
    """64 characters of X (player, also where both stand), O and -."""
    cell = lambda i: F.when(F.call_function("getbit", player, i) == 1, "X").when(F.call_function("getbit", opponent, i) == 1, "O").otherwise("-")
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(63)), cell), "")


def mask_to_moves(x: Column) -> Column:
    """A set as text, each square as (file, rank) from 0: ``[,(2, 3),(4, 5),]``."""
    square = lambda i: F.concat(F.lit("("), (i % 8).cast("string"), F.lit(", "), F.floor(i / 8).cast("string"), F.lit(")"))
    return F.array_join(F.concat(F.array(F.lit("[")), F.transform(bits_of(x), square), F.array(F.lit("]"))), ",")


def onebit(x: Column) -> Column:
    """No more than one bit is set."""
    return x.bitwiseAND(x - 1) == 0


def show(player: Column, opponent: Column) -> Column:
    return F.regexp_replace(to_text(player, opponent), "(.{8})", "$1\n")


def occupied_text(x: Column) -> Column:
    """64 characters of G and -, from the set as a binary number."""
    return F.translate(F.reverse(F.lpad(F.bin(F.coalesce(x, mask(0))), 64, "0")), "01", "-G")


def from_text(text: Column, discs: str) -> Column:
    """Set of the squares that show one of the characters of ``discs``, read as a binary number."""
    digits = F.translate(F.regexp_replace(F.substring(text, 1, 64), f"[^{discs}]", "0"), discs, "1" * len(discs))
    return F.conv(F.lpad(F.reverse(digits), 64, "0"), 2, -10).cast("long")


def spread(x: Column) -> Column:
    """A set and all neighbours of it."""
    return union([x, *(step(d, x) for d in NAMES)])


def _fixpoint(grown: Callable[[Column], Column]) -> Column:
    """The centre, grown until nothing is added: 60 squares at most, so 60 times at most.  Most sets are whole after a
    few times; only the others go on.  What ``grown`` names is computed anew each time, so it should be a ``let``."""
    def grow(m: Column, times: int) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(times)), m, lambda m, _: grown(m))

    return let(grow(mask(CENTRE), 8), lambda m: F.when(grown(m) == m, m).otherwise(grow(m, 52)))


def connected(occupied: Column) -> Column:
    """Occupied squares that hang together with the centre, by the eight neighbours."""
    return let(occupied, lambda o: _fixpoint(lambda m: m.bitwiseOR(o.bitwiseAND(spread(m)))))


def explained(occupied: Column) -> Column:
    """Least fixpoint from the centre: an occupied square is explained once the next two in some direction are."""
    def grown(e: Column, o: Column) -> Column:
        new = [step_back(d, e.bitwiseAND(step_back(d, e))) for d in NAMES]
        return e.bitwiseOR(o.bitwiseAND(union(new)))

    return let(occupied, lambda o: _fixpoint(lambda e: grown(e, o)))


def features(player: Column, opponent: Column) -> Column:
    """struct(in_sq, in_edge, same_all, same_min): edges are pairs of neighbours; those of one colour count once."""
    occupied = player.bitwiseOR(opponent)
    total = lambda a, names: sum((F.bit_count(a.bitwiseAND(step(d, a))) for d in names), F.lit(0))
    mine, theirs = total(player, NAMES[:4]), total(opponent, NAMES[:4])
    half = lambda x: F.floor(x / 2).cast("int")
    return F.struct(F.lit(0).alias("in_sq"), total(occupied, NAMES).cast("int").alias("in_edge"), half(mine + theirs).alias("same_all"), half(F.least(mine, theirs)).alias("same_min"))


def h_score(player: Column, opponent: Column) -> Column:
    """Search order: smaller is better."""
    score = lambda f: sum((1.0 / (f[k] + F.lit(1)) for k in ("in_sq", "in_edge", "same_all", "same_min")), F.lit(0.0))
    return let(features(player, opponent), score) * F.pow(F.lit(2.0), popcount(player, opponent))
