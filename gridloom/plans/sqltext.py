"""Pieces of SQL for the oracle."""

from __future__ import annotations


def pixels(name: str = "px") -> str:
    """CTE (id, x, y, v) of the 8 x 8 images."""
    return (
        f"{name} AS (SELECT vec_id AS id, CAST((i - 1) % 8 AS INTEGER) AS x, CAST((i - 1) // 8 AS INTEGER) AS y,"
        " CAST(least(255, greatest(0, floor((CAST(embedding[i] AS DOUBLE) + 0.53) * 255))) AS INTEGER) AS v FROM embeddings, range(1, 65) t(i))"
    )


def store(expression: str) -> str:
    return f"CAST(least(255, greatest(0, trunc(({expression}) + 0.5))) AS INTEGER)"


def clamp(expression: str) -> str:
    return f"CAST(least(255, greatest(0, {expression})) AS INTEGER)"


def listed(value: str, source: str = "px", ctes: str = "", w: int = 8, h: int = 8, base: bool = True) -> str:
    """The images as text from a source with id, x, y."""
    heads = ", ".join(x for x in ([pixels()] if base else []) + ([ctes] if ctes else []))
    return (
        f"WITH {heads} SELECT id AS image_id, CAST({w} AS INTEGER) AS w, CAST({h} AS INTEGER) AS h,"
        f" string_agg(CAST({value} AS VARCHAR), ',' ORDER BY y, x) AS pixels FROM {source} GROUP BY id"
    )


def edge(axis: str, step: str, border: str, size: int = 8) -> str:
    """Where position axis + step reads."""
    at = f"({axis} + {step})"
    if border == "mirror":
        at = f"(CASE WHEN {at} < 0 THEN -{at} WHEN {at} >= {size} THEN {2 * (size - 1)} - {at} ELSE {at} END)"
    return f"least({size - 1}, greatest(0, {at}))" if border != "skip" else at


def window(aggregates: dict[str, str], offsets: list[tuple], names: list[str], border: str = "mirror", source: str = "px", join: str = "JOIN") -> str:
    """(SELECT id, x, y, v, aggregates): n is a neighbour's level, the names are the weights of its offset.

    offsets: (dx, dy, weight...). With border 'skip' neighbours outside are missing; join LEFT JOIN keeps them null.
    """
    rows = ", ".join(f"({', '.join(map(repr, o))})" for o in offsets)
    heads = ", ".join(["dx", "dy", *names])
    found = ", ".join(f"{e} AS {a}" for a, e in aggregates.items())
    return (
        f"(SELECT p.id, p.x, p.y, any_value(p.v) AS v, {found} FROM {source} p CROSS JOIN (VALUES {rows}) k({heads})"
        f" {join} {source} q ON q.id = p.id AND q.x = {edge('p.x', 'k.dx', border)} AND q.y = {edge('p.y', 'k.dy', border)} GROUP BY p.id, p.x, p.y)"
    )


def square(r: int) -> list[tuple[int, int]]:
    return [(x, y) for y in range(-r, r + 1) for x in range(-r, r + 1)]


def mask(m) -> list[tuple]:
    """Offsets with the mask's weights, and those of its transpose, without double zeros."""
    r = len(m) // 2
    return [(x - r, y - r, m[y][x], m[x][y]) for y in range(len(m)) for x in range(len(m)) if m[y][x] or m[x][y]]
