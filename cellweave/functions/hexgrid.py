"""Planar aperture-7 hexagon grid in pure column arithmetic.

Plane coordinates are longitude and latitude in degrees. Each level divides a cell by seven; the basis
vector turns by the argument of (2+w) on odd levels and of (1+2w) on even levels, w = exp(i*pi/3), so the
orientation of the grid stays bounded. A cell is the integer pair (q, r) at resolution ``res``.
"""

from __future__ import annotations

import cmath
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

BASE_DEGREES = 20.0
MAX_RES = 15
_W = cmath.exp(1j * math.pi / 3)
SQRT3 = math.sqrt(3.0)

# The six neighbours of a cell as (q, r) steps.
NEIGHBOURS = [(1, 0), (0, 1), (-1, 1), (-1, 0), (0, -1), (1, -1)]


def divisor(res: int) -> complex:
    """Factor between level ``res - 1`` and level ``res``."""
    return 2 + _W if res % 2 == 1 else 1 + 2 * _W


def basis(res: int) -> complex:
    """Vector from a cell centre to its first neighbour at level ``res``."""
    if not 0 <= res <= MAX_RES:
        raise ValueError(f"resolution must be in 0..{MAX_RES}, not {res}")
    a = complex(BASE_DEGREES, 0.0)
    for k in range(1, res + 1):
        a /= divisor(k)
    return a


def cell_radius(res: int) -> float:
    """Distance from a cell centre to its corners, in degrees."""
    return abs(basis(res)) / SQRT3


def axial_plane(lon: Column, lat: Column, res: int) -> tuple[Column, Column]:
    """Point in the axes of the grid, as two doubles; cell centres are the points with whole coordinates."""
    inv = 1 / basis(res)
    re = lon * F.lit(inv.real) - lat * F.lit(inv.imag)
    im = lon * F.lit(inv.imag) + lat * F.lit(inv.real)
    rf = im * F.lit(2.0) / F.lit(SQRT3)
    return re - rf / F.lit(2.0), rf


def hex_axial(lon: Column, lat: Column, res: int) -> tuple[Column, Column]:
    """Axial coordinates of the cell that holds the point, as two bigint columns."""
    qf, rf = axial_plane(lon, lat, res)
    sf = -qf - rf
    q, r, s = (F.floor(v + F.lit(0.5)) for v in (qf, rf, sf))
    dq, dr, ds = F.abs(q - qf), F.abs(r - rf), F.abs(s - sf)
    q_out = F.when((dq > dr) & (dq > ds), -r - s).otherwise(q)
    r_out = F.when((dq > dr) & (dq > ds), r).when(dr > ds, -q - s).otherwise(r)
    return q_out.cast("bigint"), r_out.cast("bigint")


def hex_id(res: Column | int, q: Column, r: Column) -> Column:
    res = F.lit(res) if isinstance(res, int) else res
    return F.concat_ws("/", res.cast("string"), q.cast("string"), r.cast("string"))


def hex_cell(lon: Column, lat: Column, res: int) -> Column:
    """Cell id of a point."""
    q, r = hex_axial(lon, lat, res)
    return hex_id(res, q, r)


def hex_resolution(cell: Column) -> Column:
    return F.split_part(cell, F.lit("/"), F.lit(1)).cast("int")


def hex_parts(cell: Column) -> tuple[Column, Column]:
    """(q, r) read back from a cell id."""
    return tuple(F.split_part(cell, F.lit("/"), F.lit(i)).cast("bigint") for i in (2, 3))


def _by_res(res: Column | int, value) -> Column:
    """Value that depends on the level: a literal for one level, a lookup for a level column."""
    if isinstance(res, int):
        return F.lit(value(res))
    return F.element_at(F.array(*[F.lit(value(k)) for k in range(MAX_RES + 1)]), res.cast("int") + 1)


def hex_center(res: Column | int, q: Column, r: Column) -> tuple[Column, Column]:
    """Longitude and latitude of the cell centre."""
    re = q.cast("double") + r.cast("double") * F.lit(0.5)
    im = r.cast("double") * F.lit(SQRT3 / 2)
    ax, ay = _by_res(res, lambda k: basis(k).real), _by_res(res, lambda k: basis(k).imag)
    return re * ax - im * ay, re * ay + im * ax


def corner_offsets(res: int) -> list[complex]:
    return [basis(res) * cmath.exp(1j * math.pi * (30 + 60 * j) / 180) / SQRT3 for j in range(6)]


def hex_ring(res: Column | int, q: Column, r: Column) -> Column:
    """Closed counter-clockwise boundary as array<struct<x,y>>."""
    cx, cy = hex_center(res, q, r)

    def corners(k: int) -> Column:
        offsets = corner_offsets(k)
        return F.array(*[F.struct(F.lit(o.real).alias("x"), F.lit(o.imag).alias("y")) for o in (*offsets, offsets[0])])

    if isinstance(res, int):
        table = corners(res)
    else:
        table = F.element_at(F.array(*[corners(k) for k in range(MAX_RES + 1)]), res.cast("int") + 1)
    return F.transform(table, lambda o: F.struct((cx + o["x"]).alias("x"), (cy + o["y"]).alias("y")))


def hex_parent(res: Column | int, q: Column, r: Column) -> tuple[Column, Column]:
    """Axial coordinates of the parent, one level up; every parent has seven children."""
    def sevenths(v: Column) -> Column:
        return F.floor(v.cast("double") / F.lit(7.0) + F.lit(0.5)).cast("bigint")

    odd = (F.lit(res) if isinstance(res, int) else res) % 2 == 1
    up_q = F.when(odd, sevenths(3 * q + r)).otherwise(sevenths(3 * q + 2 * r))
    up_r = F.when(odd, sevenths(2 * r - q)).otherwise(sevenths(r - 2 * q))
    return up_q, up_r


def hex_children(res: Column | int, q: Column, r: Column) -> Column:
    """The seven child cells, one level down, as array<struct<q,r>>."""
    odd = ((F.lit(res) if isinstance(res, int) else res) + 1) % 2 == 1
    # multiply by the divisor of the child level: (q + r w)(2 + w) or (q + r w)(1 + 2 w), w*w = w - 1
    mid_q = F.when(odd, 2 * q - r).otherwise(q - 2 * r)
    mid_r = F.when(odd, q + 3 * r).otherwise(2 * q + 3 * r)
    steps = [(0, 0), *NEIGHBOURS]
    return F.array(*[F.struct((mid_q + dq).alias("q"), (mid_r + dr).alias("r")) for dq, dr in steps])


def hex_neighbour_array(q: Column, r: Column) -> Column:
    return F.array(*[F.struct((q + dq).alias("q"), (r + dr).alias("r")) for dq, dr in NEIGHBOURS])
