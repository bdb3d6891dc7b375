"""Geometry expressions on our own columns.

A geometry is ``struct<kind string, rings array<array<struct<x double, y double>>>>``: one ring of one
point for a Point, one ring for a LineString, shell plus holes for a Polygon.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6371008.8
BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"
GEOM_TYPE = "struct<kind:string,rings:array<array<struct<x:double,y:double>>>>"


def xy(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def point(x: Column, y: Column) -> Column:
    return F.struct(F.lit("Point").alias("kind"), F.array(F.array(xy(x, y))).alias("rings"))


def line(points: Column) -> Column:
    return F.struct(F.lit("LineString").alias("kind"), F.array(points).alias("rings"))


def polygon(shell: Column, *holes: Column) -> Column:
    return F.struct(F.lit("Polygon").alias("kind"), F.array(shell, *holes).alias("rings"))


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Axis-parallel rectangle, counter-clockwise and closed."""
    return polygon(F.array(xy(x0, y0), xy(x1, y0), xy(x1, y1), xy(x0, y1), xy(x0, y0)))


def _let(value: Column, body) -> Column:
    """Bind an expression once inside another expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


# -- shape of rings -----------------------------------------------------------------------------------------


def ring_signed_area(ring: Column) -> Column:
    """Shoelace area in squared degrees, positive when counter-clockwise."""
    edges = F.zip_with(
        F.slice(ring, F.lit(1), F.greatest(F.size(ring) - 1, F.lit(0))),
        F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))),
        lambda a, b: a["x"] * b["y"] - b["x"] * a["y"],
    )
    return F.aggregate(edges, F.lit(0.0), lambda s, v: s + v) / 2.0


def area(geom: Column) -> Column:
    """Planar area of a polygon: shell minus holes; zero for points, lines and polygons without a ring."""
    shell = F.coalesce(F.abs(ring_signed_area(F.get(geom["rings"], F.lit(0)))), F.lit(0.0))
    holes = F.aggregate(
        F.slice(geom["rings"], F.lit(2), F.greatest(F.size(geom["rings"]) - 1, F.lit(0))),
        F.lit(0.0),
        lambda s, ring: s + F.abs(ring_signed_area(ring)),
    )
    return F.when(geom["kind"] == "Polygon", shell - holes).otherwise(F.lit(0.0))


def centroid(ring: Column) -> Column:
    """Area centroid of a closed ring as struct<x,y>."""
    origin = F.element_at(ring, 1)

    def moments(a: Column, b: Column) -> Column:
        ax, ay = a["x"] - origin["x"], a["y"] - origin["y"]
        bx, by = b["x"] - origin["x"], b["y"] - origin["y"]
        cross = ax * by - bx * ay
        return F.struct(cross.alias("w"), ((ax + bx) * cross).alias("x"), ((ay + by) * cross).alias("y"))

    edges = F.zip_with(F.slice(ring, F.lit(1), F.size(ring) - 1), F.slice(ring, F.lit(2), F.size(ring) - 1), moments)
    zero = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    return F.aggregate(
        edges,
        zero,
        lambda s, e: F.struct(
            (s["w"] + e["w"]).alias("w"), (s["x"] + e["x"]).alias("x"), (s["y"] + e["y"]).alias("y")
        ),
        lambda s: xy(origin["x"] + s["x"] / (s["w"] * 3.0), origin["y"] + s["y"] / (s["w"] * 3.0)),
    )


def bounds(geom: Column) -> tuple[Column, Column, Column, Column]:
    """(min x, min y, max x, max y)."""
    points = F.flatten(geom["rings"])
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def center(geom: Column) -> Column:
    """Representative centre: ring centroid for polygons, middle of the bounding box otherwise."""
    x0, y0, x1, y1 = bounds(geom)
    return F.when(geom["kind"] == "Polygon", centroid(F.element_at(geom["rings"], 1))).otherwise(
        xy((x0 + x1) / 2.0, (y0 + y1) / 2.0)
    )


def swap_xy(geom: Column) -> Column:
    return F.struct(
        geom["kind"].alias("kind"),
        F.transform(geom["rings"], lambda ring: F.transform(ring, lambda p: xy(p["y"], p["x"]))).alias("rings"),
    )


# -- text form ----------------------------------------------------------------------------------------------


def to_wkt(geom: Column) -> Column:
    """Well-known text with shortest round-trip numbers."""
    def ring_text(ring: Column) -> Column:
        pairs = F.transform(ring, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string")))
        return F.concat(F.lit("("), F.array_join(pairs, ", "), F.lit(")"))

    first = ring_text(F.element_at(geom["rings"], 1))
    nested = F.concat(F.lit("("), F.array_join(F.transform(geom["rings"], ring_text), ", "), F.lit(")"))
    body = F.when(geom["kind"] == "Polygon", nested).otherwise(first)
    return F.concat_ws(" ", F.upper(geom["kind"]), body)


def point_from_wkt(text: Column) -> Column:
    """struct<x,y> of ``POINT (x y)``, any letter case; null for other text."""
    number = r"([-+0-9.eE]+)"
    pattern = rf"(?i)^\s*point\s*\(\s*{number}\s+{number}\s*\)\s*$"
    return F.when(
        text.rlike(pattern),
        F.struct(
            F.regexp_extract(text, pattern, 1).try_cast("double").alias("x"),
            F.regexp_extract(text, pattern, 2).try_cast("double").alias("y"),
        ),
    )


# -- validity, parts, clipping -------------------------------------------------------------------------------


def _finite(ring: Column) -> Column:
    def ok(v: Column) -> Column:
        return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))

    return F.forall(ring, lambda p: ok(p["x"]) & ok(p["y"]))


def is_valid(geom: Column) -> Column:
    """Finite coordinates; enough points; polygon rings closed with non-zero area."""
    rings = geom["rings"]
    finite = F.forall(rings, _finite)
    line_ok = F.forall(rings, lambda ring: F.size(F.array_distinct(ring)) >= 2)
    poly_ok = F.forall(
        rings,
        lambda ring: (F.size(ring) >= 4)
        & (F.element_at(ring, 1) == F.element_at(ring, -1))
        & (F.abs(ring_signed_area(ring)) > 0),
    )
    shape = (
        F.when(geom["kind"] == "Point", F.size(F.flatten(rings)) == 1)
        .when(geom["kind"] == "LineString", line_ok)
        .when(geom["kind"] == "Polygon", poly_ok)
        .otherwise(F.lit(False))
    )
    return F.coalesce((F.size(rings) > 0) & finite & shape, F.lit(False))


def drop_repeats(arr: Column) -> Column:
    """Remove consecutive duplicates."""
    return F.filter(arr, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(arr, i - 1)))


def make_valid(geom: Column) -> Column:
    """Drop repeated points, close rings, turn shells counter-clockwise and holes clockwise."""
    def closed(ring: Column) -> Column:
        tidy = drop_repeats(ring)
        return F.when(F.element_at(tidy, 1) == F.element_at(tidy, -1), tidy).otherwise(
            F.concat(tidy, F.slice(tidy, 1, 1))
        )

    def oriented(ring: Column, i: Column) -> Column:
        want_positive = i == 0
        return _let(closed(ring), lambda r: F.when((ring_signed_area(r) > 0) == want_positive, r).otherwise(F.reverse(r)))

    rings = F.when(geom["kind"] == "Polygon", F.transform(geom["rings"], oriented)).otherwise(
        F.transform(geom["rings"], drop_repeats)
    )
    return F.struct(geom["kind"].alias("kind"), rings.alias("rings"))


def explode_parts(df: DataFrame, parts: str = "parts", out: str = "geom") -> DataFrame:
    """One row per member of a geometry collection (array of geometries)."""
    return df.select(*[c for c in df.columns if c != parts], F.posexplode(parts).alias("part", out))


def clip_ring(ring: Column, convex: Column) -> Column:
    """Part of a closed ring inside a closed counter-clockwise convex ring (Sutherland-Hodgman)."""
    edges = F.zip_with(
        F.slice(convex, F.lit(1), F.size(convex) - 1),
        F.slice(convex, F.lit(2), F.size(convex) - 1),
        lambda a, b: F.struct(a.alias("a"), b.alias("b")),
    )

    point_type = "array<struct<x:double,y:double>>"

    def side(p: Column, e: Column) -> Column:
        return (e["b"]["x"] - e["a"]["x"]) * (p["y"] - e["a"]["y"]) - (e["b"]["y"] - e["a"]["y"]) * (
            p["x"] - e["a"]["x"]
        )

    def cut(cur: Column, e: Column) -> Column:
        marked = F.transform(cur, lambda p: F.struct(p.alias("p"), side(p, e).alias("d")))

        def step(u: Column, v: Column) -> Column:
            t = u["d"] / (u["d"] - v["d"])
            hit = xy(
                u["p"]["x"] + (v["p"]["x"] - u["p"]["x"]) * t, u["p"]["y"] + (v["p"]["y"] - u["p"]["y"]) * t
            )
            crossing = ((u["d"] >= 0) & (v["d"] < 0)) | ((u["d"] < 0) & (v["d"] >= 0))
            none = F.array().cast(point_type)
            head = F.when(crossing, F.array(hit)).otherwise(none)
            tail = F.when(v["d"] >= 0, F.array(v["p"])).otherwise(none)
            return F.concat(head, tail)

        pairs = _let(
            marked,
            lambda m: F.flatten(
                F.zip_with(
                    F.slice(m, F.lit(1), F.greatest(F.size(m) - 1, F.lit(0))),
                    F.slice(m, F.lit(2), F.greatest(F.size(m) - 1, F.lit(0))),
                    step,
                )
            ),
        )
        return _let(
            pairs,
            lambda out: F.when(F.size(out) > 0, F.concat(F.slice(out, -1, 1), out)).otherwise(out),
        )

    return F.aggregate(edges, ring.cast(point_type), lambda cur, e: cut(cur, e).cast(point_type))


def clip(geom: Column, convex: Column) -> Column:
    """Polygon clipped to a convex ring; empty rings are dropped."""
    rings = F.filter(F.transform(geom["rings"], lambda r: clip_ring(r, convex)), lambda r: F.size(r) > 3)
    return F.struct(geom["kind"].alias("kind"), rings.alias("rings"))


def point_in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Ray casting; points on the boundary may fall on either side."""
    edges = F.zip_with(
        F.slice(ring, F.lit(1), F.size(ring) - 1),
        F.slice(ring, F.lit(2), F.size(ring) - 1),
        lambda a, b: F.when(
            ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]), 1
        ).otherwise(0),
    )
    return F.aggregate(edges, F.lit(0), lambda s, v: s + v) % 2 == 1


def point_in_polygon(x: Column, y: Column, geom: Column) -> Column:
    """Inside the shell and outside every hole: an odd number of rings hold the point."""
    inside = F.transform(geom["rings"], lambda ring: point_in_ring(x, y, ring).cast("int"))
    return F.aggregate(inside, F.lit(0), lambda s, v: s + v) % 2 == 1


# -- sphere ---------------------------------------------------------------------------------------------------


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance in metres."""
    dlat, dlon = F.radians(lat2 - lat1) / 2.0, F.radians(lon2 - lon1) / 2.0
    a = F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon) * F.sin(dlon)
    return F.asin(F.least(F.lit(1.0), F.sqrt(a))) * F.lit(2.0 * EARTH_RADIUS_M)


def unit_vector(lon: Column, lat: Column) -> Column:
    """Point on the unit sphere as struct<x,y,z>."""
    lo, la = F.radians(lon), F.radians(lat)
    return F.struct(
        (F.cos(la) * F.cos(lo)).alias("x"), (F.cos(la) * F.sin(lo)).alias("y"), F.sin(la).alias("z")
    )


def chord(a: Column, b: Column) -> Column:
    """Straight distance between two unit vectors; grows with great-circle distance."""
    dx, dy, dz = a["x"] - b["x"], a["y"] - b["y"], a["z"] - b["z"]
    return F.sqrt(dx * dx + dy * dy + dz * dz)


def chord_to_m(c: Column) -> Column:
    return F.asin(F.least(F.lit(1.0), c / 2.0)) * F.lit(2.0 * EARTH_RADIUS_M)


# -- codes ----------------------------------------------------------------------------------------------------


def _interleave(first: Column, second: Column, n_first: int, n_second: int, group: int) -> list[Column]:
    """Numbers made of ``group`` bits taken from the two integers in turn, highest bits first."""
    bits = []
    for k in range(n_first + n_second):
        src, n = (first, n_first) if k % 2 == 0 else (second, n_second)
        bits.append(F.shiftright(src, n - 1 - k // 2).bitwiseAND(F.lit(1)))
    out = []
    for start in range(0, len(bits), group):
        value = F.lit(0)
        for bit in bits[start : start + group]:
            value = value * 2 + bit
        out.append(value)
    return out


def _scaled(v: Column, low: float, span: float, bits: int) -> Column:
    top = (1 << bits) - 1
    raw = F.floor((v - low) / span * float(1 << bits)).cast("bigint")
    return F.least(F.greatest(raw, F.lit(0)), F.lit(top)).cast("bigint")


def geohash(lon: Column, lat: Column, precision: int) -> Column:
    n_lon, n_lat = (5 * precision + 1) // 2, 5 * precision // 2
    codes = _interleave(_scaled(lon, -180.0, 360.0, n_lon), _scaled(lat, -90.0, 180.0, n_lat), n_lon, n_lat, 5)
    return F.concat(*[F.substring(F.lit(BASE32), c.cast("int") + 1, F.lit(1)) for c in codes])


def quad_cell(lon: Column, lat: Column, zoom: int) -> Column:
    """Cell of the second grid: a quad key of ``zoom`` digits on the longitude/latitude plane."""
    x = _scaled(lon, -180.0, 360.0, zoom)
    y = _scaled(lat, -90.0, 180.0, zoom)
    return F.concat(*[c.cast("string") for c in _interleave(y, x, zoom, zoom, 2)])
