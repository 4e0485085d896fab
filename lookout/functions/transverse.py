"""Transverse Mercator as native expressions: UTM zones of WGS 84.

Krüger's series in the third flattening, to the fourth order, forward and inverse; within 4000 km
of the central meridian both are exact to well below a millimetre.  Everything is SQL text over a
point ``p`` with fields x and y, so a whole reprojection is one codegen expression and no Python
runs in a task.

Along a parallel the northing, and along a meridian the easting, have their only turning points at
the central meridian and at the equator.  So the box of a rectangle's image is that of its corners
and of the points where its edges cross those two lines; corners alone would be too small.
"""

from __future__ import annotations

import math

# WGS 84 and the rules of the UTM grid.
SEMI_MAJOR = 6378137.0
INVERSE_FLATTENING = 298.257223563
SCALE = 0.9996
FALSE_EASTING = 500000.0
FALSE_NORTHING_SOUTH = 10000000.0
NORTH, SOUTH = 32600, 32700
ZONES = 60
# Degrees from the central meridian beyond which a point has no place on the grid.
FARTHEST = 80.0

_F = 1.0 / INVERSE_FLATTENING
_N = _F / (2.0 - _F)
_E = 2.0 * math.sqrt(_N) / (1.0 + _N)
_RADIUS = SCALE * SEMI_MAJOR / (1.0 + _N) * (1.0 + _N**2 / 4.0 + _N**4 / 64.0)


def _series(rows: list[list[float]]) -> list[float]:
    """Coefficients whose k-th row holds the factors of the powers of n from the k-th on."""
    return [sum(c * _N ** (k + j) for j, c in enumerate(row)) for k, row in enumerate(rows, start=1)]


# The series' published coefficients (conformal sphere to grid, back, latitude).
_ALPHA = _series([[1 / 2, -2 / 3, 5 / 16, 41 / 180], [13 / 48, -3 / 5, 557 / 1440], [61 / 240, -103 / 140], [49561 / 161280]])
_BETA = _series([[1 / 2, -2 / 3, 37 / 96, -1 / 360], [1 / 48, 1 / 15, -437 / 1440], [17 / 480, -37 / 840], [4397 / 161280]])
_DELTA = _series([[2, -2 / 3, -2, 116 / 45], [7 / 3, -8 / 5, -227 / 45], [56 / 15, -136 / 35], [4279 / 630]])


def _d(v: float) -> str:
    return f"{v!r}D"


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _sum(coefficients: list[float], first: str, x: str, second: str, y: str) -> str:
    return " + ".join(
        f"{_d(c)} * {first}({_d(2.0 * k)} * {x}) * {second}({_d(2.0 * k)} * {y})" for k, c in enumerate(coefficients, start=1)
    )


def sql_is_utm(srid: str) -> str:
    return f"({srid} BETWEEN {NORTH + 1} AND {NORTH + ZONES} OR {srid} BETWEEN {SOUTH + 1} AND {SOUTH + ZONES})"


def sql_meridian(srid: str) -> str:
    """Longitude of the zone's central meridian."""
    return f"(({srid} % 100) * 6D - 183D)"


def sql_false_northing(srid: str) -> str:
    return f"(CASE WHEN {srid} > {SOUTH} THEN {_d(FALSE_NORTHING_SOUTH)} ELSE 0D END)"


def sql_forward(p: str, srid: str) -> str:
    """Longitude and latitude to the zone's easting and northing; null too far from its meridian."""
    off = f"(pmod({p}.x - {sql_meridian(srid)} + 180D, 360D) - 180D)"
    s = f"sin(radians({p}.y))"
    conformal = f"sinh(atanh({s}) - {_d(_E)} * atanh({_d(_E)} * {s}))"
    sphere = "named_struct('xi', atan2(tt.t, cos(tt.l)), 'eta', atanh(sin(tt.l) / sqrt(1D + tt.t * tt.t)))"
    east = f"{_d(FALSE_EASTING)} + {_d(_RADIUS)} * (ts.eta + {_sum(_ALPHA, 'cos', 'ts.xi', 'sinh', 'ts.eta')})"
    north = f"{sql_false_northing(srid)} + {_d(_RADIUS)} * (ts.xi + {_sum(_ALPHA, 'sin', 'ts.xi', 'cosh', 'ts.eta')})"
    inner = _let(sphere, "ts", f"named_struct('x', {east}, 'y', {north})")
    inner = _let(f"named_struct('t', {conformal}, 'l', radians({off}))", "tt", inner)
    return f"CASE WHEN abs({off}) <= {_d(FARTHEST)} AND abs({p}.y) < 90D THEN {inner} END"


def sql_inverse(p: str, srid: str) -> str:
    """The zone's easting and northing to longitude and latitude."""
    grid = (
        f"named_struct('xi', ({p}.y - {sql_false_northing(srid)}) / {_d(_RADIUS)}, "
        f"'eta', ({p}.x - {_d(FALSE_EASTING)}) / {_d(_RADIUS)})"
    )
    sphere = (
        f"named_struct('xi', ug.xi - ({_sum(_BETA, 'sin', 'ug.xi', 'cosh', 'ug.eta')}), "
        f"'eta', ug.eta - ({_sum(_BETA, 'cos', 'ug.xi', 'sinh', 'ug.eta')}))"
    )
    latitude = "uc + " + " + ".join(f"{_d(c)} * sin({_d(2.0 * k)} * uc)" for k, c in enumerate(_DELTA, start=1))
    y = _let("asin(sin(us.xi) / cosh(us.eta))", "uc", f"degrees({latitude})")
    x = f"{sql_meridian(srid)} + degrees(atan2(sinh(us.eta), cos(us.xi)))"
    # a rounding error beside the date line is no turn around the earth
    x = _let(x, "ux", "CASE WHEN abs(ux) <= 180.000000001D THEN ux ELSE ux - signum(ux) * 360D END")
    return _let(grid, "ug", _let(sphere, "us", f"named_struct('x', {x}, 'y', {y})"))


def sql_box(r: str, move: str, name: str, cross_x: str, cross_y: str) -> str:
    """Box of the image of rectangle ``r``; ``move`` maps the point called ``name``, and the image's
    coordinates turn only where x is ``cross_x`` or y is ``cross_y``."""
    x = f"array({r}.xmin, {r}.xmax, least(greatest({cross_x}, {r}.xmin), {r}.xmax))"
    y = f"array({r}.ymin, {r}.ymax, least(greatest({cross_y}, {r}.ymin), {r}.ymax))"
    corners = f"flatten(transform({x}, bx -> transform({y}, b_y -> named_struct('x', bx, 'y', b_y))))"
    ends = ", ".join(f"'{k}', array_{k[1:]}(transform(bi, bq -> bq.{k[0]}))" for k in ("xmin", "ymin", "xmax", "ymax"))
    image = _let(f"transform({corners}, {name} -> {move})", "bi", f"CASE WHEN NOT exists(bi, bq -> bq IS NULL) THEN named_struct({ends}) END")
    return image
