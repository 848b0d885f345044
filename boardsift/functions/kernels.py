"""Numpy kernels over arrays of boards (uint64 masks), for steps that branch per square."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from boardsift.functions.bits import CENTRE, DIRECTIONS, NAMES

U = np.uint64
_NOT_H, _NOT_A = U(0x7F7F7F7F7F7F7F7F), U(0xFEFEFEFEFEFEFEFE)
_BITS = U(1) << np.arange(64, dtype=np.uint64)


def step(d: int, x: np.ndarray) -> np.ndarray:
    dx, dy = DIRECTIONS[NAMES[d]]
    by = 8 * dy + dx
    if dx:
        x = x & (_NOT_H if dx > 0 else _NOT_A)
    return x << U(by) if by > 0 else x >> U(-by)


@lru_cache(maxsize=1)
def rays() -> np.ndarray:
    """rays()[square, direction, k]: the square k + 1 steps away, 64 beyond the edge."""
    out = np.full((64, 8, 7), 64)
    for square in range(64):
        for d, (dx, dy) in enumerate(DIRECTIONS.values()):
            x, y = square % 8 + dx, square // 8 + dy
            k = 0
            while 0 <= x < 8 and 0 <= y < 8:
                out[square, d, k] = 8 * y + x
                x, y, k = x + dx, y + dy, k + 1
    return out


def cells(x: np.ndarray) -> np.ndarray:
    """Sets as rows of 65 booleans; the last, beyond the edge, is false."""
    out = np.zeros((*x.shape, 65), bool)
    out[..., :64] = (x[..., None] & _BITS) != 0
    return out


def explained(occupied: np.ndarray) -> np.ndarray:
    seen = np.full(occupied.shape, CENTRE, np.uint64)
    while True:
        new = np.zeros_like(seen)
        for d in range(8):
            back = (d + 4) % 8
            new |= step(back, seen & step(back, seen))
        grown = seen | (new & occupied)
        if (grown == seen).all():
            return seen
        seen = grown


def order_masks(occupied: np.ndarray) -> np.ndarray:
    """(boards, 64): for each occupied square what is explained without it, and itself; 0 elsewhere."""
    there = (occupied[:, None] & _BITS) != 0
    without = explained(np.where(there, occupied[:, None] ^ _BITS, U(CENTRE)))
    return np.where(there, without | _BITS, U(0))


def run_lengths(inside: np.ndarray) -> np.ndarray:
    """(boards, 64, 8): unbroken squares of a set in each direction from each square, the square itself not counted.

    ``inside`` is (boards, 65), or (boards, 64, 65) with a set for each square.
    """
    ray = rays()
    on = inside[:, ray] if inside.ndim == 2 else inside[:, np.arange(64)[:, None, None], ray]
    return np.logical_and.accumulate(on, axis=3).sum(3)


_OUTER = np.array([not CENTRE >> s & 1 for s in range(64)])


def capabilities(occupied: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """can_put (boards, 64, 8): a run of three in what may be older, from a disc outside the centre; can_flip
    (boards, 64, 4): occupied on both sides along a line."""
    there = cells(occupied)
    order = order_masks(occupied)
    runs = run_lengths(there) * there[:, :64, None]
    old = run_lengths(cells(order)) * there[:, :64, None]
    return (old >= 2) & (_OUTER & there[:, :64])[:, :, None], (runs[:, :, :4] >= 1) & (runs[:, :, 4:] >= 1)


def seg3_more(player: np.ndarray, opponent: np.ndarray) -> np.ndarray:
    """False where some disc outside the centre, never flippable, has no direction in which its placement could have
    flipped the disc beside it and ended on the next one.  Boards whose occupancy isn't explained may have discs
    without any direction; they are False too."""
    can_put, can_flip = capabilities(player | opponent)
    n = len(player)
    mine, theirs = cells(player), cells(opponent)
    flip65 = np.zeros((n, 65, 4), bool)
    flip65[:, :64] = can_flip
    never = ~can_flip.any(2) & (mine | theirs)[:, :64] & _OUTER
    ray = rays()
    possible = np.zeros((n, 64), bool)
    for d in range(8):
        near, far = ray[:, d, 0], ray[:, d, 1]
        line = d % 4
        own = [np.where(mine[:, :64], mine[:, s], theirs[:, s]) for s in (near, far)]
        turned = [flip65[:, s].any(2) for s in (near, far)]
        across = [np.delete(flip65[:, s], line, axis=2).any(2) for s in (near, far)]
        # a disc of the other colour must have been turned again later, along another line
        bad_near = ~own[0] & ~across[0]
        bad_far = ~own[1] & ~across[1] & (~turned[1] | (own[0] & ~across[0]))
        possible |= can_put[:, :, d] & ~(bad_near | bad_far)
    lost = can_put.any(2) == 0
    outer = (mine | theirs)[:, :64] & _OUTER
    return ~((never & ~possible).any(1) | (lost & outer).any(1))


def seg3(occupied: np.ndarray) -> np.ndarray:
    """Every disc outside the centre has a run of three; discs with one such direction depend on the two discs there,
    and these dependencies have no cycle."""
    there = cells(occupied)
    long = (run_lengths(there) >= 2) & (there[:, :64] & _OUTER)[:, :, None]
    number = long.sum(2)
    fine = ~((number == 0) & there[:, :64] & _OUTER).any(1)
    ray = rays()
    only = number == 1
    d = long.argmax(2)
    needs = np.zeros((len(occupied), 64, 65), bool)
    rows, squares = np.nonzero(only)
    for k in (0, 1):
        needs[rows, squares, ray[squares, d[rows, squares], k]] = True
    return fine & acyclic(needs[:, :, :64])


def acyclic(edge: np.ndarray) -> np.ndarray:
    """(boards, nodes, nodes): whether taking away nodes that depend on nothing left, again and again, leaves none."""
    left = np.ones(edge.shape[:2], bool)
    while True:
        blocked = (edge & left[:, None, :]).any(2)
        stay = left & blocked
        if (stay == left).all():
            return ~left.any(1)
        left = stay


def stable(occupied: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Discs that can never turn on the way to a target: in no direction is there a target square after the run of
    discs, and one right behind."""
    there, goal = cells(occupied), cells(target)
    ray = rays()
    run = run_lengths(there)
    after = np.where(run < 7, np.take_along_axis(np.broadcast_to(ray, (len(occupied), 64, 8, 7)), np.minimum(run, 6)[..., None], 3)[..., 0], 64)
    rows = np.arange(len(occupied))[:, None, None]
    ends = goal[rows, after]
    behind = goal[:, ray[:, [(d + 4) % 8 for d in range(8)], 0]]
    can = (ends & behind).any(2)
    return ((there[:, :64] & ~can) * _BITS).sum(1, dtype=np.uint64)


def retro_flips(opponent: np.ndarray, square: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All sets of discs that the other side's disc on ``square`` may have turned: (row, set).

    In each direction a run of L discs of the other side allows none or 1 to L - 1 of them; all combinations but the
    empty one count.
    """
    run = run_lengths_at(cells(opponent), square)
    row, found = np.arange(len(square)), np.zeros(len(square), np.uint64)
    ray = rays()
    prefix = np.zeros((64, 8, 8), np.uint64)
    for k in range(7):
        bit = np.where(ray[:, :, k] < 64, _BITS[np.minimum(ray[:, :, k], 63)], U(0))
        prefix[:, :, k + 1] = prefix[:, :, k] | bit
    for d in range(8):
        choices = np.maximum(run[row, d], 1)
        again = np.repeat(np.arange(len(row)), choices)
        taken = np.arange(len(again)) - np.repeat(np.cumsum(choices) - choices, choices)
        row = row[again]
        found = found[again] | prefix[square[row], d, taken]
    keep = found != 0
    return row[keep], found[keep]


def run_lengths_at(inside: np.ndarray, square: np.ndarray) -> np.ndarray:
    on = inside[np.arange(len(square))[:, None, None], rays()[square]]
    return np.logical_and.accumulate(on, axis=2).sum(2)


def mirror_h(x: np.ndarray) -> np.ndarray:
    for by, low in ((1, 0x5555555555555555), (2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F)):
        x = (x >> U(by)) & U(low) | (x & U(low)) << U(by)
    return x


def mirror_v(x: np.ndarray) -> np.ndarray:
    return x.byteswap()


def transpose(x: np.ndarray) -> np.ndarray:
    grid = np.unpackbits(np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").reshape(-1, 8, 8)
    return np.packbits(grid.transpose(0, 2, 1).reshape(-1, 64), axis=1, bitorder="little").view(np.uint64).ravel()


def images(player: np.ndarray, opponent: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Image s mirrors files for bit 0, then ranks for bit 1, then transposes for bit 2."""
    out = [(player, opponent)]
    for change in (mirror_h, mirror_v, transpose):
        out += [(change(p), change(o)) for p, o in out]
    return out


def canonical(player: np.ndarray, opponent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest image by (player, opponent)."""
    best = (player, opponent)
    for p, o in images(player, opponent)[1:]:
        less = (p < best[0]) | ((p == best[0]) & (o < best[1]))
        best = np.where(less, p, best[0]), np.where(less, o, best[1])
    return best


def _run(d: int, start: np.ndarray, through: np.ndarray) -> np.ndarray:
    found = start & through
    for _ in range(5):
        found = found | (step(d, found) & through)
    return found


def moves(player: np.ndarray, opponent: np.ndarray) -> np.ndarray:
    out = np.zeros_like(player)
    for d in range(8):
        out |= step(d, _run(d, step(d, player), opponent))
    return out & ~(player | opponent)


def flip(move: np.ndarray, player: np.ndarray, opponent: np.ndarray) -> np.ndarray:
    """Discs turned by a disc on the empty square ``move``."""
    out = np.zeros_like(player)
    for d in range(8):
        found = _run(d, step(d, move), opponent)
        out |= np.where(step(d, found) & player != 0, found, U(0))
    return out


def children(player: np.ndarray, opponent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, player, opponent) after every legal move."""
    row, square = np.nonzero(cells(moves(player, opponent))[:, :64])
    p, o, bit = player[row], opponent[row], _BITS[square]
    turned = flip(bit, p, o)
    return row, o ^ turned, p ^ (turned | bit)


def parents(player: np.ndarray, opponent: np.ndarray, strict: bool = False) -> tuple[np.ndarray, ...]:
    """(row, square, flipped, player, opponent) of what may have come before each board."""
    row, square = np.nonzero(cells(opponent)[:, :64] & _OUTER)
    pair, flipped = retro_flips(opponent[row], square)
    row, square = row[pair], square[pair]
    bit = _BITS[square]
    p, o = opponent[row] ^ (flipped | bit), player[row] ^ flipped
    if strict:
        same = flip(bit, p, o) == flipped
        row, square, flipped, p, o = (x[same] for x in (row, square, flipped, p, o))
    return row, square, flipped, p, o


def pruned(player: np.ndarray, opponent: np.ndarray) -> np.ndarray:
    """Boards that pass the occupancy filter and then seg3_more."""
    occupied = player | opponent
    keep = (occupied & U(CENTRE) == U(CENTRE)) & (explained(occupied) == occupied)
    at = np.flatnonzero(keep)
    keep[at] = seg3_more(player[at], opponent[at])
    return keep


def h_score(player: np.ndarray, opponent: np.ndarray) -> np.ndarray:
    """Search order: smaller is better; the same numbers as ``bits.h_score``."""
    total = lambda x, directions: sum(np.bitwise_count(x & step(d, x)).astype(np.int64) for d in directions)
    occupied = player | opponent
    half = [NAMES.index(n) for n in NAMES[:4]]
    mine, theirs = total(player, half), total(opponent, half)
    counts = (np.zeros(len(player)), total(occupied, range(8)), (mine + theirs) // 2, np.minimum(mine, theirs) // 2)
    return sum(1.0 / (n + 1) for n in counts) * 2.0 ** np.bitwise_count(occupied)


def growth_steps(occupied: int) -> list[int]:
    """Masks from the centre outwards over the explained squares, one square more each, in breadth-first order with
    neighbours N, NE, E, SE, S, SW, W, NW."""
    goal = int(explained(np.array([occupied], np.uint64))[0])
    seen = CENTRE & goal
    steps, queue = [seen], [s for s in range(64) if seen >> s & 1]
    around = [NAMES.index(d) for d in ("N", "NE", "E", "SE", "S", "SW", "W", "NW")]
    ray = rays()
    while queue:
        square = queue.pop(0)
        for d in around:
            near = int(ray[square, d, 0])
            if near < 64 and goal >> near & 1 and not seen >> near & 1:
                seen |= 1 << near
                steps.append(seen)
                queue.append(near)
    return steps


def random_play(plies: int, random: np.random.Generator) -> tuple[int, int]:
    """A board after random legal plies from the start; a side that can't move passes, and if neither can the ply
    does nothing."""
    from boardsift.functions.bits import START_OPPONENT, START_PLAYER

    player, opponent = START_PLAYER, START_OPPONENT
    for _ in range(plies):
        options = legal(player, opponent)
        if not options:
            player, opponent = opponent, player
            options = legal(player, opponent)
            if not options:
                continue
        square, turned = options[random.integers(len(options))]
        player, opponent = opponent ^ turned, player ^ (turned | 1 << square)
    return player, opponent


def legal(player: int, opponent: int) -> list[tuple[int, int]]:
    """(square, turned discs) of all moves."""
    out = []
    ray = rays()
    for square in range(64):
        if (player | opponent) >> square & 1:
            continue
        turned = 0
        for d in range(8):
            line = 0
            for near in ray[square, d]:
                near = int(near)
                if near < 64 and opponent >> near & 1:
                    line |= 1 << near
                    continue
                if near < 64 and player >> near & 1:
                    turned |= line
                break
        if turned:
            out.append((square, turned))
    return out
