"""A grid on the sphere: rows of latitude, columns of longitude whose number follows the cosine, so that cells keep their width.

Columns wrap at the antimeridian; rows near a pole are a single column. A cell is named by (row, col). All functions take
and give SQL expressions: one expression is planned much faster than the hundred columns it would be made of.
"""

from __future__ import annotations

#: Nautical miles in a degree of latitude, a little less than the Earth's radius gives, so that cells are never too small.
DEGREE_NM = 60.0
#: A row with so few columns is one: a circle there reaches round the pole, and elsewhere never beyond the next column.
FEW = 24


def row(lat: str, height: float) -> str:
    return f"CAST(floor({lat} / {height!r}D) AS BIGINT)"


def columns(of: str, height: float) -> str:
    """Columns of a row: as many as keep a cell wider than it is high at the row's edge nearer to a pole."""
    n = f"CAST(floor(cos(radians(least(greatest(abs({of}), abs({of} + 1)) * {height!r}D, 90.0D))) * {360.0 / height * 0.99!r}D) AS BIGINT)"
    return f"if({n} <= {FEW}, 1L, {n})"


def column(lon: str, of: str, height: float) -> str:
    n = columns(of, height)
    return f"pmod(CAST(floor(({lon} + 180) / 360 * {n}) AS BIGINT), {n})"


def _beside(lon: str, rows: str, height: float) -> str:
    """Array of (row, col): in each row of an array the cells at a longitude and on both sides of it."""
    sized = f"transform({rows}, r -> named_struct('r', r, 'n', {columns('r', height)}))"
    cols = f"array_distinct(transform(array(-1, 0, 1), k -> pmod(CAST(floor(({lon} + 180) / 360 * x.n) AS BIGINT) + k, x.n)))"
    return f"flatten(transform({sized}, x -> transform({cols}, c -> named_struct('row', x.r, 'col', c))))"


def around(lat: str, lon: str, height: float) -> str:
    """Array of (row, col): a place's own cell and all that a circle around it, as wide as a cell is high, can reach."""
    own = row(lat, height)
    return _beside(lon, f"array({own} - 1, {own}, {own} + 1)", height)


def above(lon: str, of: str, height: float) -> str:
    """Array of (row, col): those of them in the row above a row."""
    return _beside(lon, f"array({of} + 1)", height)


def covering(lat: str, lon: str, radius_nm: str, height: float) -> str:
    """Array of (row, col): all cells that a circle of any radius can reach, all round in rows near a pole."""
    reach = f"({radius_nm} * {1.001 / DEGREE_NM!r}D)"
    edge = f"least(abs({lat}) + {reach}, 90.0D)"
    wide = f"if({edge} > 89.9D, 180.0D, least(degrees(asin(least(1.0D, sin(radians(least({reach}, 90.0D))) / cos(radians({edge}))))) * 1.001D, 180.0D))"
    rows = f"sequence({row(f'({lat} - {reach})', height)}, {row(f'({lat} + {reach})', height)})"
    sized = f"transform({rows}, r -> named_struct('r', r, 'n', {columns('r', height)}, 'w', {wide}))"
    lo, hi = (f"CAST(floor(({lon} {sign} x.w + 180) / 360 * x.n) AS BIGINT)" for sign in "-+")
    cols = f"array_distinct(transform(sequence({lo}, least({hi}, {lo} + x.n - 1)), c -> pmod(c, x.n)))"
    return f"flatten(transform({sized}, x -> transform({cols}, c -> named_struct('row', x.r, 'col', c))))"
