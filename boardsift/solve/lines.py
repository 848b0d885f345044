"""Candidate turns: a disc on a square turns the discs between it and a base further along a line."""

from __future__ import annotations

from typing import NamedTuple

from boardsift.functions.bits import CENTRE_SQUARES
from boardsift.functions.kernels import rays


class Turn(NamedTuple):
    square: int
    colour: int
    direction: int
    length: int
    turned: tuple[int, ...]
    base: int


def outer_discs(occupied: int) -> list[int]:
    return [s for s in range(64) if occupied >> s & 1 and s not in CENTRE_SQUARES]


def turns_of(square: int, allowed: int) -> list[tuple[int, int, tuple[int, ...], int]]:
    """(direction, length, turned squares, base) along unbroken runs of allowed squares; length counts the disc itself."""
    out = []
    for d in range(8):
        passed: list[int] = []
        for near in map(int, rays()[square, d]):
            if near == 64 or not allowed >> near & 1:
                break
            if passed:
                out.append((d, len(passed) + 2, tuple(passed), near))
            passed.append(near)
    return out
