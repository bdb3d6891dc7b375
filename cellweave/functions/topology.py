"""Topological relations between a convex grid cell and a point, line or polygon.

The cell is always convex, so every relation follows from how each segment of the other geometry runs through
the cell; an area clipped to the cell only tells whether a cell that no boundary enters lies in the feature or
outside it. All directions are cell -> feature. Signed distances within ``TOLERANCE`` of zero count as zero.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cellweave.functions.geo import _let, clip_ring, ring_signed_area

TOLERANCE = 1e-12

# Predicate names of the nine relations.
PREDICATES = {
    "intersects": "geo:sfIntersects",
    "contains": "geo:sfContains",
    "crosses": "geo:sfCrosses",
    "equals": "geo:sfEquals",
    "overlaps": "geo:sfOverlaps",
    "touches": "geo:sfTouches",
    "within": "geo:sfWithin",
    "covers": "geo:ehCovers",
    "coveredBy": "geo:ehCoveredBy",
}

# Names used by the edge-list form.
EDGE_NAMES = {
    "contains": "contains",
    "coveredBy": "covered by",
    "covers": "covers",
    "crosses": "crosses",
    "intersects": "intersects",
    "overlaps": "overlaps",
    "touches": "touches",
}


def _edges(ring: Column) -> Column:
    return F.zip_with(
        F.slice(ring, F.lit(1), F.greatest(F.size(ring) - 1, F.lit(0))),
        F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))),
        lambda a, b: F.struct(a.alias("a"), b.alias("b")),
    )


def _sides(p: Column, edges: Column) -> Column:
    """Distance-like sign of a point against each directed edge; positive on the left, i.e. inside."""
    d = F.transform(
        edges, lambda e: (e["b"]["x"] - e["a"]["x"]) * (p["y"] - e["a"]["y"]) - (e["b"]["y"] - e["a"]["y"]) * (p["x"] - e["a"]["x"])
    )
    return F.transform(d, lambda v: F.when(F.abs(v) <= TOLERANCE, F.lit(0.0)).otherwise(v))


def _run(start_sides: Column, end_sides: Column) -> Column:
    """How one segment meets the closed cell: struct(hit, interior, outside)."""
    start = F.struct(F.lit(0.0).alias("t0"), F.lit(1.0).alias("t1"), F.lit(False).alias("on"), F.lit(False).alias("off"))

    def step(s: Column, d: Column) -> Column:
        du, dv = d["u"], d["v"]
        t = du / (du - dv)
        return F.struct(
            F.when((du < 0) & (dv >= 0), F.greatest(s["t0"], t)).otherwise(s["t0"]).alias("t0"),
            F.when((du >= 0) & (dv < 0), F.least(s["t1"], t)).otherwise(s["t1"]).alias("t1"),
            (s["on"] | ((du == 0) & (dv == 0))).alias("on"),
            (s["off"] | ((du < 0) & (dv < 0))).alias("off"),
        )

    def finish(s: Column) -> Column:
        hit = ~s["off"] & (s["t0"] <= s["t1"] + TOLERANCE)
        return F.struct(
            hit.alias("hit"),
            (hit & ~s["on"] & (s["t0"] < s["t1"] - TOLERANCE)).alias("interior"),
            (~hit | (s["t0"] > TOLERANCE) | (s["t1"] < 1 - TOLERANCE)).alias("outside"),
        )

    both = F.zip_with(start_sides, end_sides, lambda u, v: F.struct(u.alias("u"), v.alias("v")))
    return F.aggregate(both, start, step, finish)


def _runs(edges: Column, ring: Column) -> Column:
    """The run of every segment of a ring. Each corner is held against the cell's edges once, not once per use."""
    def between(marked: Column) -> Column:
        rest = F.greatest(F.size(marked) - 1, F.lit(0))
        return F.zip_with(F.slice(marked, F.lit(1), rest), F.slice(marked, F.lit(2), rest), _run)

    return _let(F.transform(ring, lambda p: _sides(p, edges)), between)


def _point_flags(cell: Column, p: Column) -> dict[str, Column]:
    low = F.array_min(_sides(p, _edges(cell)))
    return {"intersects": low >= 0, "contains": low > 0, "touches": low == 0, "covers": low >= 0}


def _line_flags(cell: Column, runs: Column) -> dict[str, Column]:
    hit = F.exists(runs, lambda s: s["hit"])
    interior = F.exists(runs, lambda s: s["interior"])
    outside = F.exists(runs, lambda s: s["outside"])
    return {
        "intersects": hit,
        "contains": interior & ~outside,
        "crosses": interior & outside,
        "touches": hit & ~interior,
        "covers": ~outside,
    }


def _polygon_flags(m: Column) -> dict[str, Column]:
    """Relations from the course of the boundary; no area is compared with a tolerance.

    If no boundary runs through the open cell, the cell lies wholly in the feature or outside it, and the common area
    is all of the cell or nothing. The feature lies in the cell if no part of its outer ring is outside.
    """
    cell_in = ~m["interior"] & (m["common"] > m["cell"] / 2)
    meet = m["interior"] | cell_in
    feature_in = meet & ~m["outside"]
    return {
        "intersects": meet | m["contact"],
        "contains": feature_in,
        "equals": feature_in & cell_in,
        "overlaps": meet & ~feature_in & ~cell_in,
        "touches": m["contact"] & ~meet,
        "within": cell_in,
        "covers": feature_in,
        "coveredBy": cell_in,
    }


def _measure(cell: Column, geom: Column) -> Column:
    def common(rings: Column) -> Column:
        def shell_less_holes(clipped: Column) -> Column:
            holes = F.slice(clipped, F.lit(2), F.greatest(F.size(clipped) - 1, F.lit(0)))
            return F.aggregate(holes, F.element_at(clipped, 1), lambda s, hole: s - hole)

        return _let(F.transform(rings, lambda r: F.abs(_let(clip_ring(r, cell), ring_signed_area))), shell_less_holes)

    def measured(runs: Column) -> Column:
        interior = F.exists(runs, lambda ring: F.exists(ring, lambda s: s["interior"]))
        return F.struct(
            F.abs(ring_signed_area(cell)).alias("cell"),
            F.when(interior, F.lit(0.0)).otherwise(common(geom["rings"])).alias("common"),
            interior.alias("interior"),
            F.exists(F.element_at(runs, 1), lambda s: s["outside"]).alias("outside"),
            F.exists(runs, lambda ring: F.exists(ring, lambda s: s["hit"])).alias("contact"),
        )

    return _let(_let(_edges(cell), lambda edges: F.transform(geom["rings"], lambda r: _runs(edges, r))), measured)


def _names(flags: dict[str, Column], names: dict[str, str]) -> Column:
    listed = [F.when(flags[k], F.lit(names[k])) for k in names if k in flags]
    return F.array_compact(F.array(*listed))


def relations(cell: Column, geom: Column, names: dict[str, str] | None = None) -> Column:
    """Names of all relations of a convex counter-clockwise cell ring to a geometry; empty when disjoint."""
    names = names or PREDICATES
    first = F.element_at(geom["rings"], 1)
    as_point = _names(_point_flags(cell, F.element_at(first, 1)), names)
    as_line = _let(_let(_edges(cell), lambda edges: _runs(edges, first)), lambda runs: _names(_line_flags(cell, runs), names))
    as_polygon = _let(_measure(cell, geom), lambda m: _names(_polygon_flags(m), names))
    return F.when(geom["kind"] == "Point", as_point).when(geom["kind"] == "LineString", as_line).otherwise(as_polygon)
