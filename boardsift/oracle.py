"""DuckDB statements that compute the registered queries from squares and strings instead of masks."""

from __future__ import annotations

from boardsift.functions.bits import CENTRE, DIRECTIONS

_ALL = 2**64 - 1
_NOT_A, _NOT_H = sum(0xFE << 8 * i for i in range(8)), sum(0x7F << 8 * i for i in range(8))
_DIRS = ", ".join(f"({d}, '{n}', {dx}, {dy})" for d, (n, (dx, dy)) in enumerate(DIRECTIONS.items()))


def _shift(d: int, x: str) -> str:
    """A set of squares (UBIGINT) one step on; masked before it is shifted, as shifts must not overflow."""
    dx, dy = list(DIRECTIONS.values())[d]
    by = 8 * dy + dx
    side = _ALL if not dx else _NOT_H if dx > 0 else _NOT_A
    if by > 0:
        side &= _ALL >> by
    return f"(({x} & {side}::UBIGINT) {'<<' if by > 0 else '>>'} {abs(by)})"


def _grown(e: str, occupied: str) -> str:
    new = " | ".join(_shift((d + 4) % 8, f"({e} & {_shift((d + 4) % 8, e)})") for d in range(8))
    return f"({e} | ({occupied} & ({new})))"


_FRAGMENTS = {
    "h": "h AS (SELECT {K}::BIGINT AS k, md5({K}::VARCHAR || 'a') || md5({K}::VARCHAR || 'b') AS h FROM {T})",
    "b": "b AS (SELECT k, substr(o, 1, 27) || substr(i, 28, 2) || substr(o, 30, 6) || substr(i, 36, 2) || substr(o, 38, 27) AS board FROM (SELECT k, translate(h, '0123456789abcdef', '--XXXXXXXOOOOOOO') AS o, translate(h, '0123456789abcdef', 'XXXXXXXXOOOOOOOO') AS i FROM h))",
    "dirs": f"dirs(d, name, dx, dy) AS (VALUES {_DIRS})",
    "sq": "sq AS (SELECT i::INTEGER AS sq, (i % 8)::INTEGER AS x, (i // 8)::INTEGER AS y, i IN (27, 28, 35, 36) AS centre FROM range(64) t(i))",
    "cells": "cells AS (SELECT k, sq, x, y, centre, substr(board, sq + 1, 1) AS c FROM b, sq)",
    "rays": "rays AS (SELECT sq, d, j::INTEGER AS j, ((y + dy * j) * 8 + x + dx * j)::INTEGER AS sq2 FROM sq, dirs, range(1, 8) t(j) WHERE x + dx * j BETWEEN 0 AND 7 AND y + dy * j BETWEEN 0 AND 7)",
    # first square of each ray that isn't of the other side, for moves of X
    "stops": "stops AS (SELECT a.k, a.sq, r.d, min(r.j) AS j FROM cells a JOIN rays r USING (sq) JOIN cells z ON z.k = a.k AND z.sq = r.sq2 WHERE a.c = '-' AND z.c <> 'O' GROUP BY ALL)",
    "turned": "turned AS (SELECT s.k, s.sq, q.sq2 AS flipped FROM stops s JOIN rays r ON r.sq = s.sq AND r.d = s.d AND r.j = s.j JOIN cells z ON z.k = s.k AND z.sq = r.sq2 AND z.c = 'X' JOIN rays q ON q.sq = s.sq AND q.d = s.d AND q.j < s.j)",
    "images": "images AS (SELECT k, s::INTEGER AS s, string_agg(substr(board, (CASE WHEN s & 4 <> 0 THEN (CASE WHEN s & 2 <> 0 THEN 7 - x ELSE x END) * 8 + (CASE WHEN s & 1 <> 0 THEN 7 - y ELSE y END) ELSE (CASE WHEN s & 2 <> 0 THEN 7 - y ELSE y END) * 8 + (CASE WHEN s & 1 <> 0 THEN 7 - x ELSE x END) END) + 1, 1), '' ORDER BY sq) AS image FROM b, sq, range(8) t(s) GROUP BY k, s)",
    "keys": "keys AS (SELECT *, reverse(translate(image, 'XO-', '100')) AS pk, reverse(translate(image, 'XO-', '010')) AS ok, reverse(translate(image, 'XO-', '110')) AS ck FROM images)",
    "occ": "occ AS (SELECT k, sum(CASE WHEN c <> '-' THEN 1::HUGEINT << sq ELSE 0 END)::UBIGINT AS occ FROM cells GROUP BY k)",
    "reach": f"reach AS (SELECT k, occ, {CENTRE}::UBIGINT AS e, 0 AS n FROM occ UNION ALL SELECT k, occ, {_grown('e', 'occ')}, n + 1 FROM reach WHERE n < 60)",
    "seen": "seen AS (SELECT k, occ, e FROM reach WHERE n = 60)",
    "less": f"less AS (SELECT k, sq, occ, (occ & ~(1::UBIGINT << sq)) AS o, {CENTRE}::UBIGINT AS e, 0 AS n FROM occ, sq WHERE occ & (1::UBIGINT << sq) <> 0 UNION ALL SELECT k, sq, occ, o, {_grown('e', 'o')}, n + 1 FROM less WHERE n < 40)",
    "ordr": "ordr AS (SELECT k, sq, e | (1::UBIGINT << sq) AS m FROM less WHERE n = 40)",
    "runs": "runs AS (SELECT a.k, a.sq, a.centre, a.c, dd.d, coalesce(min(CASE WHEN z.c = '-' THEN r.j END), count(r.j) + 1) - 1 AS run FROM cells a CROSS JOIN dirs dd LEFT JOIN rays r ON r.sq = a.sq AND r.d = dd.d LEFT JOIN cells z ON z.k = a.k AND z.sq = r.sq2 WHERE a.c <> '-' GROUP BY ALL)",
    "oldruns": "oldruns AS (SELECT o.k, o.sq, dd.d, coalesce(min(CASE WHEN o.m & (1::UBIGINT << coalesce(r.sq2, 0)) = 0 OR z.c = '-' THEN r.j END), count(r.j) + 1) - 1 AS run FROM ordr o CROSS JOIN dirs dd LEFT JOIN rays r ON r.sq = o.sq AND r.d = dd.d LEFT JOIN cells z ON z.k = o.k AND z.sq = r.sq2 GROUP BY ALL)",
    "feat": "feat AS (SELECT b.k, coalesce(in_edge, 0) AS in_edge, (coalesce(xs, 0) + coalesce(os, 0)) // 2 AS same_all, least(coalesce(xs, 0), coalesce(os, 0)) // 2 AS same_min FROM b LEFT JOIN (SELECT a.k, count(*) AS in_edge, count(*) FILTER (a.c = 'X' AND z.c = 'X' AND z.sq > a.sq) AS xs, count(*) FILTER (a.c = 'O' AND z.c = 'O' AND z.sq > a.sq) AS os FROM cells a JOIN rays r ON r.sq = a.sq AND r.j = 1 JOIN cells z ON z.k = a.k AND z.sq = r.sq2 WHERE a.c <> '-' AND z.c <> '-' GROUP BY a.k) USING (k))",
}
_NEEDS = {
    "b": ["h"], "cells": ["b", "sq"], "rays": ["sq", "dirs"], "stops": ["cells", "rays"], "turned": ["stops"], "images": ["b", "sq"], "keys": ["images"],
    "occ": ["cells"], "reach": ["occ"], "seen": ["reach"], "less": ["occ", "sq"], "ordr": ["less"], "runs": ["cells", "rays"], "oldruns": ["ordr", "rays", "cells"], "feat": ["cells", "rays"],
}


def statement(select: str, *needs: str, table: str = "customer", key: str = "c_custkey", more: str = "") -> str:
    """A statement over the boards of a table's keys, with the common tables it needs."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for name in needs:
        add(name)
    parts = [_FRAGMENTS[n].replace("{K}", key).replace("{T}", table) for n in order] + ([more] if more else [])
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + select


def text_of(mask: str) -> str:
    """A set of squares (UBIGINT) as 64 characters of G and -."""
    return f"list_reduce(list_transform(range(64), lambda i: CASE WHEN {mask} & (1::UBIGINT << i::INTEGER) <> 0 THEN 'G' ELSE '-' END), lambda a, c: a || c)"
