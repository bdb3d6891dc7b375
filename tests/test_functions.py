"""Expressions against values worked out by hand."""

import datetime as dt
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cellweave.functions import dates, geo, hexgrid as hx, text, topology, values


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def test_geohash_textbook(spark):
    assert one(spark, g=geo.geohash(F.lit(10.40744), F.lit(57.64911), 11)).g == "u4pruydqqvj"


def test_wind_labels(spark):
    rows = [(11.25, "N"), (11.26, "NNE"), (33.75, "NNE"), (348.75, "NNW"), (348.76, "N"), (0.0, "N"), (None, None), (180.0, "S")]
    df = spark.createDataFrame(rows, "d double, want string").select("want", values.wind_label(F.col("d")).alias("have"))
    assert all(r.want == r.have for r in df.collect())


def test_text(spark):
    r = one(
        spark, price=text.parse_price(F.lit("$1,234.50")), key=text.camel_key(F.lit("addr:house_name")),
        cls=text.camel_class(F.lit("addr:house_name")), gap=text.camel_class(F.lit("a::b")),
        url=text.wikipedia_url(F.lit("de:Köln Dom")), bare=text.wikipedia_url(F.lit("Köln")),
        esc=text.escape_literal(F.lit('a\\b"c\nd')), wd=text.wikidata_object(F.lit("Q5")), lit=text.wikidata_object(F.lit("x")),
    )
    assert (r.price, r.key, r.cls, r.gap) == (1234.5, "addrHouseName", "AddrHouseName", "A_B")
    assert r.url == "https://de.wikipedia.org/wiki/de%3AK%C3%B6ln%20Dom"
    assert r.bare == "https://.wikipedia.org/wiki/%3AK%C3%B6ln"
    assert r.esc == 'a\\\\b\\"c d'
    assert (r.wd, r.lit) == ("http://www.wikidata.org/wiki/Q5", "x")


def test_dates(spark):
    d = lambda s: F.to_date(F.lit(s))
    r = one(
        spark, dur=dates.duration_months(d("2015-01-01"), d("2015-03-01")), found=dates.date_in_text(F.lit("at 2016-05-17 x")),
        none=dates.date_in_text(F.lit("none")), bad=dates.date_in_text(F.lit("2016-99-99")), us=dates.us_date(F.lit("03/04/2015")),
        doy=dates.date_from_doy(F.lit(2015), F.lit(31)), late=dates.clamp_end(d("2019-01-01"), d("2018-05-01"), "2018-12-01"),
    )
    assert (r.dur, r.found, r.none, r.bad) == (3, dt.date(2016, 5, 1), None, None)
    assert (r.us, r.doy, r.late) == (dt.date(2015, 3, 4), dt.date(2015, 2, 1), dt.date(2018, 5, 1))


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 12), st.integers(-10**6, 10**6), st.integers(-10**6, 10**6))
def test_children_lie_round_the_parent(res, q, r):
    """Seven children, the middle one on the parent's centre."""
    w = complex(0.5, math.sqrt(3) / 2)
    odd = res % 2 == 1
    mid = (2 * q - r, q + 3 * r) if odd else (q - 2 * r, 2 * q + 3 * r)
    parent, child = (q + r * w) * hx.basis(res - 1), (mid[0] + mid[1] * w) * hx.basis(res)
    assert abs(parent - child) <= 1e-9 * max(1.0, abs(parent))


def test_hex_hierarchy_and_cells(spark):
    grid = spark.range(-20, 21).select(F.col("id").alias("q")).crossJoin(spark.range(-20, 21).select(F.col("id").alias("r")))
    for res in (3, 4):
        kids = grid.withColumn("c", F.explode(hx.hex_children(res - 1, F.col("q"), F.col("r"))))
        uq, ur = hx.hex_parent(res, F.col("c.q"), F.col("c.r"))
        assert kids.where((uq != F.col("q")) | (ur != F.col("r"))).count() == 0
        assert kids.select("c").distinct().count() == 7 * grid.count()
        lon, lat = hx.hex_center(res, F.col("q"), F.col("r"))
        back = hx.hex_axial(lon, lat, res)
        assert grid.where((back[0] != F.col("q")) | (back[1] != F.col("r"))).count() == 0


CELL = [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]


def shape(kind, *rings):
    ring = lambda pts: F.array(*[geo.xy(F.lit(float(x)), F.lit(float(y))) for x, y in pts])
    return F.struct(F.lit(kind).alias("kind"), F.array(*map(ring, rings)).alias("rings"))


CASES = [
    ("Point", [[(1, 1)]], {"intersects", "contains", "covers"}),
    ("Point", [[(4, 1)]], {"intersects", "touches", "covers"}),
    ("Point", [[(5, 1)]], set()),
    ("LineString", [[(1, 1), (2, 2)]], {"intersects", "contains", "covers"}),
    ("LineString", [[(-1, 2), (5, 2)]], {"intersects", "crosses"}),
    ("LineString", [[(1, 1), (5, 2), (5, 9)]], {"intersects", "crosses"}),
    ("LineString", [[(-1, 4), (5, 4)]], {"intersects", "touches"}),
    ("LineString", [[(1, 0), (3, 0)]], {"intersects", "touches", "covers"}),
    ("LineString", [[(4, 4), (6, 6)]], {"intersects", "touches"}),
    ("LineString", [[(3, 6), (6, 3)]], set()),
    ("Polygon", [[(1, 1), (2, 1), (2, 2), (1, 2), (1, 1)]], {"intersects", "contains", "covers"}),
    ("Polygon", [CELL], {"intersects", "contains", "covers", "equals", "within", "coveredBy"}),
    ("Polygon", [[(-1, -1), (9, -1), (9, 9), (-1, 9), (-1, -1)]], {"intersects", "within", "coveredBy"}),
    ("Polygon", [[(2, 2), (9, 2), (9, 9), (2, 9), (2, 2)]], {"intersects", "overlaps"}),
    ("Polygon", [[(4, 0), (8, 0), (8, 4), (4, 4), (4, 0)]], {"intersects", "touches"}),
    ("Polygon", [[(-9, -9), (9, -9), (9, 9), (-9, 9), (-9, -9)], [(-1, -1), (-1, 5), (5, 5), (5, -1), (-1, -1)]], set()),
    ("Polygon", [[(-9, -9), (9, -9), (9, 9), (-9, 9), (-9, -9)], CELL[::-1]], {"intersects", "touches"}),
    ("Polygon", [[(1, 1), (1.0002, 1), (1.0002, 1.0002), (1, 1.0002), (1, 1)]], {"intersects", "contains", "covers"}),
    ("Polygon", [[(1, -0.00002), (1.0001, -0.00002), (1.0001, 0.00008), (1, 0.00008), (1, -0.00002)]], {"intersects", "overlaps"}),
    ("Polygon", [[(1, -0.0001), (1.0001, -0.0001), (1.0001, 0), (1, 0), (1, -0.0001)]], {"intersects", "touches"}),
    ("Polygon", [[(1, 0), (1.0001, 0), (1.0001, 0.0001), (1, 0.0001), (1, 0)]], {"intersects", "contains", "covers"}),
    ("Polygon", [[(-1, 1), (1, 1), (1, 3), (5, 3), (5, 5), (-1, 5), (-1, 1)]], {"intersects", "overlaps"}),
]


@pytest.mark.parametrize("kind,rings,want", CASES)
def test_relations(spark, kind, rings, want):
    cell = F.array(*[geo.xy(F.lit(float(x)), F.lit(float(y))) for x, y in CELL])
    names = {k: k for k in topology.PREDICATES}
    assert set(one(spark, r=topology.relations(cell, shape(kind, *rings), names)).r) == want


def test_clipped_away(spark):
    far = shape("Polygon", [(9, 9), (10, 9), (10, 10), (9, 10), (9, 9)])
    cell = F.array(*[geo.xy(F.lit(float(x)), F.lit(float(y))) for x, y in CELL])
    assert one(spark, a=geo.area(geo.clip(far, cell))).a == 0.0


def test_geometry(spark):
    box = shape("Polygon", CELL, [(1, 1), (1, 2), (2, 2), (2, 1), (1, 1)])
    r = one(
        spark, area=geo.area(box), wkt=geo.to_wkt(shape("Polygon", CELL)), back=geo.point_from_wkt(F.lit("Point(1.5 -2)")),
        swap=geo.to_wkt(geo.swap_xy(shape("Point", [(1, 2)]))), ok=geo.is_valid(box), bad=geo.is_valid(shape("Polygon", CELL[:4])),
        inside=geo.point_in_polygon(F.lit(3.0), F.lit(3.0), box), hole=geo.point_in_polygon(F.lit(1.5), F.lit(1.5), box),
        z=values.line_z_order(F.create_map(F.lit("highway"), F.lit("primary"), F.lit("layer"), F.lit("-1"), F.lit("tunnel"), F.lit("yes"))),
    )
    assert (r.area, r.ok, r.bad, r.inside, r.hole, r.z) == (15.0, True, False, True, False, -13)
    assert r.wkt == "POLYGON ((0.0 0.0, 4.0 0.0, 4.0 4.0, 0.0 4.0, 0.0 0.0))"
    assert (r.back.x, r.back.y, r.swap) == (1.5, -2.0, "POINT (2.0 1.0)")
