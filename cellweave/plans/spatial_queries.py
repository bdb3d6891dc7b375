"""Registered queries: grid, codes and spatial joins."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from cellweave.functions import geo, hexgrid as hx, values
from cellweave.functions.topology import PREDICATES
from cellweave.operators import grid, spatial, triples
from cellweave.plans import inputs
from cellweave.plans.inputs import num
from cellweave.plans.registry import load, query

RES = 3
FINE = 4


def hex_sql(src: str, res: int, out: str) -> str:
    """Chain of SQL steps that adds q and r to the points of ``src``."""
    inv = 1 / hx.basis(res)
    return f"""{out}_a AS (SELECT *, lon * {num(inv.real)} - lat * {num(inv.imag)} AS re_,
        (lon * {num(inv.imag)} + lat * {num(inv.real)}) * 2e0 / {num(hx.SQRT3)} AS rf FROM {src}),
    {out}_b AS (SELECT *, re_ - rf / 2e0 AS qf FROM {out}_a),
    {out}_c AS (SELECT *, -qf - rf AS sf, floor(qf + 0.5e0) AS q0, floor(rf + 0.5e0) AS r0, floor(-qf - rf + 0.5e0) AS s0 FROM {out}_b),
    {out}_d AS (SELECT *, abs(q0 - qf) AS dq, abs(r0 - rf) AS dr, abs(s0 - sf) AS ds FROM {out}_c),
    {out} AS (SELECT * EXCLUDE (re_, rf, qf, sf, q0, r0, s0, dq, dr, ds),
        CAST(CASE WHEN dq > dr AND dq > ds THEN -r0 - s0 ELSE q0 END AS BIGINT) AS q,
        CAST(CASE WHEN dq > dr AND dq > ds THEN r0 WHEN dr > ds THEN -q0 - s0 ELSE r0 END AS BIGINT) AS r FROM {out}_d)"""


def id_sql(res, q: str = "q", r: str = "r") -> str:
    return f"{res} || '/' || {q} || '/' || {r}" if isinstance(res, str) else f"'{res}/' || {q} || '/' || {r}"


def parent_sql(res: int, q: str = "q", r: str = "r") -> tuple[str, str]:
    a, b = (f"3 * {q} + {r}", f"2 * {r} - {q}") if res % 2 == 1 else (f"3 * {q} + 2 * {r}", f"{r} - 2 * {q}")
    return tuple(f"CAST(floor(CAST({e} AS DOUBLE) / 7e0 + 0.5e0) AS BIGINT)" for e in (a, b))


def center_sql(res: int, q: str = "q", r: str = "r") -> tuple[str, str]:
    a = hx.basis(res)
    re, im = f"(CAST({q} AS DOUBLE) + CAST({r} AS DOUBLE) * 0.5e0)", f"(CAST({r} AS DOUBLE) * {num(hx.SQRT3 / 2)})"
    return f"({re} * {num(a.real)} - {im} * {num(a.imag)})", f"({re} * {num(a.imag)} + {im} * {num(a.real)})"


def customer_grid(spark, sf, res=RES):
    """Grid of all cells that hold a customer point."""
    points = inputs.customer_points(spark, sf)
    ids = grid.with_cell(points, res).select("cell_id").distinct()
    return grid.cells_from_ids(ids, res=res)


def grid_sql(res=RES, name="grid") -> str:
    lon, lat = center_sql(res)
    return f"""{inputs.CUSTOMER_POINTS_SQL}, {hex_sql('customer_points', res, 'hexed')},
    {name} AS (SELECT DISTINCT {id_sql(res)} AS cell_id, q, r, {lon} AS clon, {lat} AS clat FROM hexed)"""


@query(
    "hex_cells",
    f"WITH {inputs.CUSTOMER_POINTS_SQL}, {hex_sql('customer_points', FINE, 'hexed')} SELECT osm_id, {id_sql(FINE)} AS cell_id FROM hexed",
)
def hex_cells(spark, sf):
    return grid.feature_cell_map(inputs.customer_points(spark, sf), FINE)


@query(
    "hex_centers",
    f"""WITH {grid_sql(FINE)} SELECT cell_id, {FINE} AS res, round(clon, 6) + 0.0 AS lon, round(clat, 6) + 0.0 AS lat,
    round(clon + {num(hx.corner_offsets(FINE)[0].real)}, 6) + 0.0 AS x0, round(clat + {num(hx.corner_offsets(FINE)[0].imag)}, 6) + 0.0 AS y0,
    round({num(abs(hx.basis(FINE)) ** 2 * math.sqrt(3) / 2)}, 6) AS area FROM grid""",
)
def hex_centers(spark, sf):
    g = customer_grid(spark, sf, FINE)
    first = F.element_at(F.element_at(F.col("geom.rings"), 1), 1)
    zero = F.lit(0.0)
    return g.select(
        "cell_id", "res", (F.round("lon", 6) + zero).alias("lon"), (F.round("lat", 6) + zero).alias("lat"),
        (F.round(first["x"], 6) + zero).alias("x0"), (F.round(first["y"], 6) + zero).alias("y0"),
        F.round(geo.area(F.col("geom")), 6).alias("area"),
    )


_PQ, _PR = parent_sql(FINE)


@query("hex_parents", f"WITH {grid_sql(FINE)} SELECT cell_id, {id_sql(FINE - 1, _PQ, _PR)} AS parent_id FROM grid")
def hex_parents(spark, sf):
    return grid.hex_parents(customer_grid(spark, sf, FINE)).select("cell_id", "parent_id")


@query(
    "hex_adjacency",
    f"""WITH {grid_sql(RES)} SELECT a.cell_id AS subject, 'hcf:isAdjacentTo' AS predicate, b.cell_id AS object
    FROM grid a JOIN grid b ON a.cell_id <> b.cell_id AND abs(a.q - b.q) <= 1 AND abs(a.r - b.r) <= 1 AND abs(a.q + a.r - b.q - b.r) <= 1""",
)
def hex_adjacency(spark, sf):
    return grid.adjacency_triples(customer_grid(spark, sf, RES))


def two_level_grid(spark, sf):
    """Customer cells at three levels, the coarser ones derived through parents."""
    fine = customer_grid(spark, sf, FINE).select("cell_id")
    mid = grid.hex_parents(grid.cells_from_ids(fine)).select(F.col("parent_id").alias("cell_id")).distinct()
    top = grid.hex_parents(grid.cells_from_ids(mid)).select(F.col("parent_id").alias("cell_id")).distinct()
    return grid.cells_from_ids(fine.unionByName(mid).unionByName(top))


_P3 = parent_sql(FINE)
_P2 = parent_sql(FINE - 1, "q3", "r3")


@query(
    "hex_hierarchy",
    f"""WITH {grid_sql(FINE)}, up AS (SELECT *, {_P3[0]} AS q3, {_P3[1]} AS r3 FROM grid),
    up2 AS (SELECT *, {_P2[0]} AS q2, {_P2[1]} AS r2 FROM up),
    pairs AS (SELECT DISTINCT {id_sql(FINE - 1, 'q3', 'r3')} AS a, cell_id AS d FROM up2
      UNION SELECT {id_sql(FINE - 2, 'q2', 'r2')}, cell_id FROM up2
      UNION SELECT {id_sql(FINE - 2, 'q2', 'r2')}, {id_sql(FINE - 1, 'q3', 'r3')} FROM up2)
    SELECT a AS subject, 'isParentCellOf' AS predicate, d AS object FROM pairs
    UNION ALL SELECT d, 'isChildCellOf', a FROM pairs""",
)
def hex_hierarchy(spark, sf):
    return grid.hierarchy_triples(two_level_grid(spark, sf))


_C2 = parent_sql(2)


@query(
    "hex_compact",
    f"""WITH {grid_sql(2)}, up AS (SELECT *, {_C2[0]} AS pq, {_C2[1]} AS pr FROM grid),
    full2 AS (SELECT pq, pr FROM up GROUP BY 1, 2 HAVING count(*) = 7),
    up1 AS (SELECT *, {parent_sql(1, 'pq', 'pr')[0]} AS gq, {parent_sql(1, 'pq', 'pr')[1]} AS gr FROM full2),
    full1 AS (SELECT gq, gr FROM up1 GROUP BY 1, 2 HAVING count(*) = 7)
    SELECT {id_sql(2)} AS cell_id, 2 AS res FROM up ANTI JOIN full2 USING (pq, pr)
    UNION ALL SELECT {id_sql(1, 'pq', 'pr')}, 1 FROM up1 ANTI JOIN full1 USING (gq, gr)
    UNION ALL SELECT {id_sql(0, 'gq', 'gr')}, 0 FROM full1""",
)
def hex_compact(spark, sf):
    return grid.compact_cells(customer_grid(spark, sf, 2)).select("cell_id", "res")


@query("hex_uncompact", f"WITH {grid_sql(2)} SELECT cell_id FROM grid")
def hex_uncompact(spark, sf):
    """Compacting and expanding again gives the cells back."""
    return grid.uncompact_cells(grid.compact_cells(customer_grid(spark, sf, 2)), 2).select("cell_id")


def _bits_sql(v: str, low: str, span: str, bits: int) -> str:
    return f"least(greatest(CAST(floor(({v} - {low}) / {span} * {num(1 << bits)}) AS BIGINT), 0), {(1 << bits) - 1})"


@query(
    "geohash_points",
    f"""WITH {inputs.CUSTOMER_POINTS_SQL},
    b AS (SELECT osm_id, {_bits_sql('lon', '-180e0', '360e0', 18)} AS x, {_bits_sql('lat', '-90e0', '180e0', 17)} AS y FROM customer_points),
    n AS (SELECT osm_id, list_reduce(list_transform(range(0, 35), lambda k:
        CASE WHEN k % 2 = 0 THEN (x >> CAST(17 - k // 2 AS BIGINT)) & 1 ELSE (y >> CAST(16 - k // 2 AS BIGINT)) & 1 END), lambda s, v: s * 2 + v) AS code FROM b)
    SELECT osm_id, array_to_string(list_transform(range(0, 7), lambda i:
        substr('{geo.BASE32}', CAST(((code >> CAST(30 - 5 * i AS BIGINT)) & 31) + 1 AS BIGINT), 1)), '') AS geohash FROM n""",
)
def geohash_points(spark, sf):
    p = inputs.customer_points(spark, sf)
    return p.select("osm_id", geo.geohash(F.col("lon"), F.col("lat"), 7).alias("geohash"))


@query(
    "cell_crosswalk",
    f"""WITH {grid_sql(FINE)},
    b AS (SELECT cell_id, {_bits_sql('clon', '-180e0', '360e0', 13)} AS x, {_bits_sql('clat', '-90e0', '180e0', 13)} AS y FROM grid)
    SELECT cell_id, array_to_string(list_transform(range(0, 13), lambda k:
      CAST(2 * ((y >> CAST(12 - k AS BIGINT)) & 1) + ((x >> CAST(12 - k AS BIGINT)) & 1) AS VARCHAR)), '') AS quad_id FROM b""",
)
def cell_crosswalk(spark, sf):
    return grid.cell_crosswalk(customer_grid(spark, sf, FINE), 13)


_COVER_RES = 4
_cb = hx.basis(_COVER_RES)
_CLON, _CLAT = center_sql(_COVER_RES)
_span = int(8 / abs(_cb)) + 3


@query(
    "hex_cover",
    f"""WITH {inputs.BOXES_SQL}, mids AS (SELECT *, cx AS lon, cy AS lat FROM boxes), {hex_sql('mids', _COVER_RES, 'mid')},
    steps AS (SELECT unnest(range(-{2 * _span}, {2 * _span} + 1)) AS d),
    around AS (SELECT n_name, n_regionkey, x0, y0, x1, y1, m.q + a.d AS q, m.r + b.d AS r FROM mid m, steps a, steps b),
    cells AS (SELECT *, {_CLON} AS clon, {_CLAT} AS clat FROM around)
    SELECT n_name, n_regionkey, {id_sql(_COVER_RES)} AS cell_id FROM cells
    WHERE clon > x0 AND clon < x1 AND clat > y0 AND clat < y1""",
)
def hex_cover(spark, sf):
    boxes = inputs.nation_boxes(spark, sf).select("n_name", "n_regionkey", "geom")
    return grid.hex_cover(boxes, _COVER_RES).select("n_name", "n_regionkey", "cell_id")


_OUTLINE_RES = 2
_ROWS = math.ceil(240 / hx.cell_radius(_OUTLINE_RES))


@query(
    "hex_cover_outlines",
    f"""WITH {inputs.CUSTOMER_POINTS_SQL},
    ring AS (SELECT c_nationkey, lon AS x1, lat AS y1,
        coalesce(lead(lon) OVER w, first_value(lon) OVER w) AS x2, coalesce(lead(lat) OVER w, first_value(lat) OVER w) AS y2
      FROM customer_points JOIN customer ON osm_id = c_custkey WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey)),
    steps AS (SELECT unnest(range(-{_ROWS}, {_ROWS} + 1)) AS d),
    cells AS (SELECT a.d AS q, b.d AS r FROM steps a, steps b),
    placed AS (SELECT * FROM (SELECT *, {center_sql(_OUTLINE_RES)[0]} AS clon, {center_sql(_OUTLINE_RES)[1]} AS clat FROM cells)
      WHERE abs(clon) <= 181 AND abs(clat) <= 91)
    SELECT c_nationkey, {id_sql(_OUTLINE_RES)} AS cell_id FROM placed JOIN ring ON (y1 > clat) <> (y2 > clat)
      AND clon < x1 + (clat - y1) * (x2 - x1) / (y2 - y1)
    GROUP BY c_nationkey, q, r HAVING count(*) % 2 = 1""",
)
def hex_cover_outlines(spark, sf):
    """Cover of the outline through each nation's customers in key order: many corners, concave, crossing itself."""
    nation = load(spark, sf, "customer").select(F.col("c_custkey").alias("osm_id"), "c_nationkey")
    corner = F.struct("osm_id", geo.xy(F.col("lon"), F.col("lat")).alias("p"))
    rings = inputs.customer_points(spark, sf).join(nation, "osm_id").groupBy("c_nationkey").agg(F.array_sort(F.collect_list(corner)).alias("c"))
    outlines = rings.select("c_nationkey", geo.polygon(F.transform("c", lambda c: c["p"])).alias("geom"))
    return grid.hex_cover(outlines, _OUTLINE_RES).select("c_nationkey", "cell_id")


# -- topology ---------------------------------------------------------------------------------------------------

TOPO_RES = 2
_R = hx.cell_radius(TOPO_RES)
_CORNERS = hx.corner_offsets(TOPO_RES)
# outward normals of the six sides and the distance of a side from the centre
_NORMALS = [(_CORNERS[j] + _CORNERS[(j + 1) % 6]) / abs(_CORNERS[j] + _CORNERS[(j + 1) % 6]) for j in range(6)]
_APOTHEM = _R * math.sqrt(3) / 2


def _offset_sql(x: str, y: str) -> str:
    """How far a point lies outside the hexagon round (clon, clat): largest distance past a side."""
    return "greatest(" + ", ".join(
        f"(({x}) - clon) * {num(n.real)} + (({y}) - clat) * {num(n.imag)} - {num(_APOTHEM)}" for n in _NORMALS
    ) + ")"


@query(
    "topology_points",
    f"""WITH {grid_sql(TOPO_RES)}, {inputs.FEATURES_SQL},
    f AS (SELECT osm_id, date, lon, lat FROM features),
    near AS (SELECT cell_id, osm_id, date, {_offset_sql('lon', 'lat')} AS off FROM f JOIN grid
      ON abs(lon - clon) <= {num(_R + 1e-9)} AND abs(lat - clat) <= {num(_R + 1e-9)})
    SELECT cell_id AS subject, unnest(CASE WHEN off < -1e-9 THEN ['{PREDICATES["intersects"]}', '{PREDICATES["contains"]}', '{PREDICATES["covers"]}']
      ELSE ['{PREDICATES["intersects"]}', '{PREDICATES["touches"]}', '{PREDICATES["covers"]}'] END) AS predicate,
      osm_id AS object, CAST(date AS VARCHAR) AS date FROM near WHERE off <= 1e-9""",
)
def topology_points(spark, sf):
    out = spatial.topology_triples(inputs.customer_features(spark, sf), customer_grid(spark, sf, TOPO_RES))
    return out.withColumn("date", F.col("date").cast("string"))


def _box_relations_sql() -> str:
    """Two convex shapes by separating axes: box sides and hexagon normals."""
    half_hex_x = max(c.real for c in _CORNERS)
    half_hex_y = max(c.imag for c in _CORNERS)
    gaps = [f"abs(cx - clon) - half - {num(half_hex_x)}", f"abs(cy - clat) - half - {num(half_hex_y)}"]
    for n in _NORMALS[:3]:
        reach = f"half * {num(abs(n.real) + abs(n.imag))} + {num(_APOTHEM)}"
        gaps.append(f"abs((cx - clon) * {num(n.real)} + (cy - clat) * {num(n.imag)}) - ({reach})")
    gap = "greatest(" + ", ".join(gaps) + ")"
    corners_out = "greatest(" + ", ".join(_offset_sql(x, y) for x in ("x0", "x1") for y in ("y0", "y1")) + ")"
    hexes_out = "greatest(" + ", ".join(
        f"clon + {num(c.real)} - x1, x0 - clon - {num(c.real)}, clat + {num(c.imag)} - y1, y0 - clat - {num(c.imag)}" for c in _CORNERS
    ) + ")"
    return f"""m AS (SELECT cell_id, n_name, {gap} AS gap, {corners_out} AS corners_out, {hexes_out} AS hexes_out FROM boxes, grid),
    rel AS (SELECT cell_id, n_name, list_filter([
      CASE WHEN gap < 0 THEN '{PREDICATES["intersects"]}' END,
      CASE WHEN corners_out < 0 THEN '{PREDICATES["contains"]}' END,
      CASE WHEN gap < 0 AND corners_out > 0 AND hexes_out > 0 THEN '{PREDICATES["overlaps"]}' END,
      CASE WHEN hexes_out < 0 THEN '{PREDICATES["within"]}' END,
      CASE WHEN corners_out < 0 THEN '{PREDICATES["covers"]}' END,
      CASE WHEN hexes_out < 0 THEN '{PREDICATES["coveredBy"]}' END], lambda v: v IS NOT NULL) AS names FROM m)"""


@query(
    "topology_polygons",
    f"""WITH {inputs.BOXES_SQL}, {grid_sql(TOPO_RES)}, {_box_relations_sql()}
    SELECT cell_id AS "from", n_name AS "to", unnest(names) AS relation FROM rel""",
)
def topology_polygons(spark, sf):
    boxes = inputs.nation_boxes(spark, sf).select("n_name", "geom")
    pairs = spatial.spatial_candidates(boxes, customer_grid(spark, sf, TOPO_RES))
    return spatial.topology(pairs).select(F.col("cell_id").alias("from"), F.col("n_name").alias("to"), "relation")


_MINI_SQL = f"""boxes AS (SELECT *, cx - half AS x0, cx + half AS x1, cy - half AS y0, cy + half AS y1
  FROM (SELECT c_custkey AS n_name, {inputs.lon_sql('c_custkey')} AS cx, {inputs.lat_sql('c_custkey')} AS cy,
        {num(0.0002)} * pow(4e0, c_custkey % 9) AS half FROM customer))"""


@query(
    "topology_small_polygons",
    f"""WITH {_MINI_SQL}, {grid_sql(TOPO_RES)}, {_box_relations_sql()}
    SELECT cell_id AS "from", n_name AS "to", unnest(names) AS relation FROM rel""",
)
def topology_small_polygons(spark, sf):
    """Boxes from the size of a building to that of a country against one grid."""
    c = inputs.customer_points(spark, sf)
    half = F.lit(0.0002) * F.pow(F.lit(4.0), (F.col("osm_id") % 9).cast("double"))
    ring = geo.box(F.col("lon") - half, F.col("lat") - half, F.col("lon") + half, F.col("lat") + half)
    pairs = spatial.spatial_candidates(c.select("osm_id", ring.alias("geom")), customer_grid(spark, sf, TOPO_RES))
    return spatial.topology(pairs).select(F.col("cell_id").alias("from"), F.col("osm_id").alias("to"), "relation")


def _line_sql() -> str:
    """Clip every segment to the six half planes by its parameter interval."""
    def d(x, y, n):
        return f"(({x}) - clon) * {num(n.real)} + (({y}) - clat) * {num(n.imag)} - {num(_APOTHEM)}"

    enter = ", ".join(
        f"CASE WHEN ({d('ax', 'ay', n)}) > 0 AND ({d('bx', 'by_', n)}) <= 0 THEN ({d('ax', 'ay', n)}) / (({d('ax', 'ay', n)}) - ({d('bx', 'by_', n)})) ELSE 0 END"
        for n in _NORMALS
    )
    leave = ", ".join(
        f"CASE WHEN ({d('ax', 'ay', n)}) <= 0 AND ({d('bx', 'by_', n)}) > 0 THEN ({d('ax', 'ay', n)}) / (({d('ax', 'ay', n)}) - ({d('bx', 'by_', n)})) ELSE 1 END"
        for n in _NORMALS
    )
    off = " OR ".join(f"(({d('ax', 'ay', n)}) > 0 AND ({d('bx', 'by_', n)}) > 0)" for n in _NORMALS)
    return f"runs AS (SELECT cell_id, line_id, greatest({enter}) AS t0, least({leave}) AS t1, ({off}) AS off FROM lines, grid)"


@query(
    "topology_lines",
    f"""WITH {inputs.BOXES_SQL}, {inputs.LINES_SQL}, {grid_sql(TOPO_RES)}, {_line_sql()},
    rel AS (SELECT cell_id, line_id, list_filter([
      '{PREDICATES["intersects"]}',
      CASE WHEN t0 = 0 AND t1 = 1 THEN '{PREDICATES["contains"]}' END,
      CASE WHEN t0 > 0 OR t1 < 1 THEN '{PREDICATES["crosses"]}' END,
      CASE WHEN t0 = 0 AND t1 = 1 THEN '{PREDICATES["covers"]}' END], lambda v: v IS NOT NULL) AS names
      FROM runs WHERE NOT off AND t0 < t1)
    SELECT cell_id, line_id, unnest(names) AS relation FROM rel""",
)
def topology_lines(spark, sf):
    lines = inputs.nation_lines(spark, sf).select("line_id", "geom")
    pairs = spatial.spatial_candidates(lines, customer_grid(spark, sf, TOPO_RES))
    return spatial.topology(pairs).select("cell_id", "line_id", "relation")


@query(
    "relation_edges",
    f"""WITH {inputs.BOXES_SQL}, {grid_sql(TOPO_RES)}, {_box_relations_sql()},
    names AS (SELECT cell_id, n_name, unnest(names) AS p FROM rel)
    SELECT cell_id AS "from", n_name AS "to", CASE p WHEN '{PREDICATES["intersects"]}' THEN 'intersects'
      WHEN '{PREDICATES["contains"]}' THEN 'contains' WHEN '{PREDICATES["overlaps"]}' THEN 'overlaps'
      WHEN '{PREDICATES["covers"]}' THEN 'covers' ELSE 'covered by' END AS description
    FROM names WHERE p <> '{PREDICATES["within"]}'""",
)
def relation_edges(spark, sf):
    boxes = inputs.nation_boxes(spark, sf).select(F.col("n_name").alias("osm_id"), "geom")
    return spatial.relation_edges(boxes, customer_grid(spark, sf, TOPO_RES))


@query(
    "multipart_relations",
    f"""WITH {grid_sql(TOPO_RES)},
    near AS (SELECT cell_id, c_nationkey, {_offset_sql('lon', 'lat')} AS off FROM customer_points JOIN customer ON osm_id = c_custkey
      JOIN grid ON abs(lon - clon) <= {num(_R + 1e-9)} AND abs(lat - clat) <= {num(_R + 1e-9)}),
    h AS (SELECT cell_id, c_nationkey, count(*) AS met, count(*) FILTER (off < -1e-9) AS inner_ FROM near WHERE off <= 1e-9 GROUP BY 1, 2),
    t AS (SELECT h.*, n FROM h JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) USING (c_nationkey))
    SELECT cell_id, c_nationkey, unnest(list_filter(['{PREDICATES["intersects"]}',
      CASE WHEN met = n AND inner_ > 0 THEN '{PREDICATES["contains"]}' END, CASE WHEN met < n AND inner_ > 0 THEN '{PREDICATES["crosses"]}' END,
      CASE WHEN inner_ = 0 THEN '{PREDICATES["touches"]}' END, CASE WHEN met = n THEN '{PREDICATES["covers"]}' END], lambda v: v IS NOT NULL)) AS relation FROM t""",
)
def multipart_relations(spark, sf):
    """Each nation as a multi-point of its customers."""
    c = load(spark, sf, "customer").select("c_custkey", "c_nationkey")
    parts = c.select("c_nationkey", geo.point(inputs.lon_of(F.col("c_custkey")), inputs.lat_of(F.col("c_custkey"))).alias("geom"))
    return spatial.multipart_relations(parts, customer_grid(spark, sf, TOPO_RES), "c_nationkey")


@query(
    "geometry_triples",
    f"""WITH {inputs.FEATURES_SQL}
    SELECT osm_id AS subject, 'geo:hasGeometry' AS predicate, 'geo' || osm_id AS object, CAST(date AS VARCHAR) AS date FROM features
    UNION ALL SELECT 'geo' || osm_id, 'geo:asWKT', 'POINT (' || CAST(lon AS VARCHAR) || ' ' || CAST(lat AS VARCHAR) || ')', CAST(date AS VARCHAR) FROM features""",
)
def geometry_triples(spark, sf):
    out = triples.geometry_triples(inputs.customer_features(spark, sf))
    return out.withColumn("date", F.col("date").cast("string"))


@query(
    "points_to_grid",
    f"""WITH {inputs.CUSTOMER_POINTS_SQL}, {hex_sql('customer_points', RES, 'hexed')},
    stations AS (SELECT s_suppkey + 1 AS k, {inputs.lon_sql('s_suppkey + 1')} AS lon, {inputs.lat_sql('s_suppkey + 1')} AS lat FROM supplier),
    {hex_sql('stations', RES, 'shex')}
    SELECT osm_id, {id_sql(RES)} AS cell_id FROM hexed
    WHERE {id_sql(RES)} IN (SELECT {id_sql(RES)} FROM shex)""",
)
def points_to_grid(spark, sf):
    """Customer points kept where a station cell exists."""
    cells = grid.with_cell(inputs.supplier_stations(spark, sf), RES).select("cell_id").distinct()
    return spatial.join_to_grid(inputs.customer_points(spark, sf), cells, RES).select("osm_id", "cell_id")


@query(
    "bbox_features",
    f"WITH {inputs.CUSTOMER_POINTS_SQL} SELECT * FROM customer_points WHERE lon BETWEEN -20 AND 40.5 AND lat BETWEEN -30 AND 35.25",
)
def bbox_features(spark, sf):
    return spatial.bbox_filter(inputs.customer_points(spark, sf), -20, -30, 40.5, 35.25)


@query("features_with_tag", f"WITH {inputs.FEATURES_SQL} SELECT osm_id FROM features WHERE segment = 'MACHINERY'")
def features_with_tag(spark, sf):
    return spatial.features_with_tag(inputs.customer_features(spark, sf), "segment", "MACHINERY").select("osm_id")


@query(
    "valid_geometries",
    f"""WITH {inputs.BOXES_SQL} SELECT c_custkey, round(4 * half * half, 6) AS area FROM customer JOIN boxes ON n_nationkey = c_nationkey
    WHERE c_custkey % 3 <> 0""",
)
def valid_geometries(spark, sf):
    """Open rings, reversed rings and empty boxes: the first two are repaired, the last one is dropped."""
    b = load(spark, sf, "customer").join(inputs.nation_boxes(spark, sf), F.col("c_nationkey") == F.col("n_nationkey"))
    ring = F.element_at(F.col("geom.rings"), 1)
    k = F.col("c_custkey") % 3
    bent = (
        F.when(k == 0, F.transform(ring, lambda p: geo.xy(p["x"], F.lit(1.0))))
        .when(k == 1, F.slice(ring, 1, 4))
        .otherwise(F.reverse(ring))
    )
    shapes = b.select("c_custkey", geo.polygon(bent).alias("geom"))
    return spatial.valid_geometries(shapes, repair=True).select(
        "c_custkey", F.round(geo.ring_signed_area(F.element_at(F.col("geom.rings"), 1)), 6).alias("area")
    )


@query(
    "clip_polygons",
    f"""WITH {inputs.BOXES_SQL}, wide AS (SELECT n_nationkey, cx - 8 * half AS x0, cx + 8 * half AS x1, cy - 8 * half AS y0, cy + 8 * half AS y1 FROM boxes)
    SELECT a.n_nationkey AS a, b.n_nationkey AS b,
      round((least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)), 6) AS area
    FROM wide a JOIN wide b ON a.n_nationkey < b.n_nationkey AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1""",
)
def clip_polygons(spark, sf):
    """Common area of overlapping wide boxes, found by the tile join with boxes on both sides."""
    w = 8 * F.col("half")
    wide = geo.box(F.col("cx") - w, F.col("cy") - w, F.col("cx") + w, F.col("cy") + w)
    b = inputs.nation_boxes(spark, sf).select("n_nationkey", wide.alias("geom"))
    pairs = spatial.spatial_candidates(b, b.select(F.col("n_nationkey").alias("cell_id"), "geom")).where("n_nationkey < cell_id")
    both = geo.clip(F.col("geom"), F.element_at(F.col("cell_geom.rings"), 1))
    out = pairs.select(F.col("n_nationkey").alias("a"), F.col("cell_id").alias("b"), F.round(geo.area(both), 6).alias("area"))
    return out.where("area > 0")


@query(
    "wkt_round_trip",
    f"WITH {inputs.CUSTOMER_POINTS_SQL} SELECT osm_id, lat AS x, lon AS y FROM customer_points",
)
def wkt_round_trip(spark, sf):
    p = inputs.customer_points(spark, sf).withColumn("geom", geo.swap_xy(geo.point(F.col("lon"), F.col("lat"))))
    back = geo.point_from_wkt(geo.to_wkt(F.col("geom")))
    return p.select("osm_id", back["x"].alias("x"), back["y"].alias("y"))


@query(
    "ring_centroids",
    f"WITH {inputs.BOXES_SQL} SELECT n_name, round(cx, 6) + 0.0 AS x, round(cy, 6) + 0.0 AS y, round(4 * half * half, 6) AS area FROM boxes",
)
def ring_centroids(spark, sf):
    b = inputs.nation_boxes(spark, sf)
    c = geo.center(F.col("geom"))
    return b.select(
        "n_name", (F.round(c["x"], 6) + F.lit(0.0)).alias("x"), (F.round(c["y"], 6) + F.lit(0.0)).alias("y"),
        F.round(geo.area(F.col("geom")), 6).alias("area"),
    )


_ARC = """greatest(-1e0, least(1e0, {0}))"""


@query(
    "nearest_line_distance",
    f"""WITH {inputs.BOXES_SQL}, {inputs.LINES_SQL}, {inputs.STATIONS_SQL},
    seg AS (SELECT line_id, cos(radians(ay)) * cos(radians(ax)) AS ax, cos(radians(ay)) * sin(radians(ax)) AS ay, sin(radians(ay)) AS az,
      cos(radians(by_)) * cos(radians(bx)) AS bx, cos(radians(by_)) * sin(radians(bx)) AS by_, sin(radians(by_)) AS bz FROM lines),
    pts AS (SELECT station, cos(radians(lat)) * cos(radians(lon)) AS x, cos(radians(lat)) * sin(radians(lon)) AS y, sin(radians(lat)) AS z FROM stations),
    nrm AS (SELECT *, ay * bz - az * by_ AS nx, az * bx - ax * bz AS ny, ax * by_ - ay * bx AS nz FROM seg),
    nn AS (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) AS nl FROM nrm),
    pr AS (SELECT station, nn.*, x, y, z, (x * nx + y * ny + z * nz) / nl AS sd FROM pts, nn),
    foot AS (SELECT *, (ny * z - nz * y) / nl AS tx, (nz * x - nx * z) / nl AS ty, (nx * y - ny * x) / nl AS tz FROM pr),
    d AS (SELECT station,
      CASE WHEN (ax * tx + ay * ty + az * tz) <= 0 AND (bx * tx + by_ * ty + bz * tz) >= 0 THEN asin(least(1e0, abs(sd)))
      ELSE least(acos(greatest(-1e0, least(1e0, ax * x + ay * y + az * z))), acos(greatest(-1e0, least(1e0, bx * x + by_ * y + bz * z)))) END AS ang FROM foot)
    SELECT station, round(min(ang) * {num(geo.EARTH_RADIUS_M)} / 1000, 3) AS km FROM d GROUP BY station""",
)
def nearest_line_distance(spark, sf):
    near = spatial.nearest_distance(inputs.supplier_stations(spark, sf), inputs.nation_lines(spark, sf), "station")
    return near.select("station", F.round(F.col("distance_m") / 1000, 3).alias("km"))


@query(
    "haversine_pairs",
    f"""WITH {inputs.CUSTOMER_POINTS_SQL}, {inputs.BOXES_SQL}, p AS (
      SELECT osm_id, radians(lat) AS a, radians(cy) AS b, radians(cx - lon) AS dl FROM customer_points
      JOIN customer ON osm_id = c_custkey JOIN boxes ON n_nationkey = c_nationkey)
    SELECT osm_id, round({num(geo.EARTH_RADIUS_M / 1000)} * 2 * asin(least(1e0, sqrt(pow(sin((b - a) / 2), 2) + cos(a) * cos(b) * pow(sin(dl / 2), 2)))), 3) AS km FROM p""",
)
def haversine_pairs(spark, sf):
    c = load(spark, sf, "customer").join(inputs.nation_boxes(spark, sf), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey")
    d = geo.haversine_m(inputs.lon_of(k), inputs.lat_of(k), F.col("cx"), F.col("cy"))
    return c.select(k.alias("osm_id"), F.round(d / 1000, 3).alias("km"))


# -- tag rules ----------------------------------------------------------------------------------------------------

_ROADS = ["motorway", "primary", "residential", "track"]


@query(
    "line_z_order",
    """WITH t AS (SELECT p_partkey, ['motorway', 'primary', 'residential', 'track'][p_size % 4 + 1] AS highway,
      p_type = 'PROMO' AS bridge, p_type = 'LARGE' AS tunnel, p_brand = 'Brand#7' AS railway, p_size % 3 - 1 AS layer, p_size % 5 = 0 AS layered FROM part)
    SELECT p_partkey, CASE highway WHEN 'motorway' THEN 9 WHEN 'primary' THEN 7 WHEN 'residential' THEN 3 ELSE 0 END
      + CASE WHEN bridge THEN 10 ELSE 0 END + CASE WHEN tunnel THEN -10 ELSE 0 END + CASE WHEN railway THEN 5 ELSE 0 END
      + CASE WHEN layered THEN 10 * layer ELSE 0 END AS z_order FROM t""",
)
def line_z_order(spark, sf):
    part = load(spark, sf, "part")
    roads = F.array(*map(F.lit, _ROADS))
    pairs = F.array(
        F.struct(F.lit("highway").alias("k"), F.element_at(roads, F.col("p_size") % 4 + 1).alias("v")),
        F.struct(F.lit("bridge").alias("k"), F.when(F.col("p_type") == "PROMO", F.lit("yes")).alias("v")),
        F.struct(F.lit("tunnel").alias("k"), F.when(F.col("p_type") == "LARGE", F.lit("true")).alias("v")),
        F.struct(F.lit("railway").alias("k"), F.when(F.col("p_brand") == "Brand#7", F.lit("rail")).alias("v")),
        F.struct(F.lit("layer").alias("k"), F.when(F.col("p_size") % 5 == 0, (F.col("p_size") % 3 - 1).cast("string")).alias("v")),
    )
    tags = F.map_from_entries(F.filter(pairs, lambda e: e["v"].isNotNull()))
    return part.select("p_partkey", values.line_z_order(tags).alias("z_order"))


@query(
    "closed_way_areas",
    "SELECT p_partkey FROM part WHERE p_size % 2 = 0 AND (p_type = 'PROMO' OR p_type = 'LARGE')",
)
def closed_way_areas(spark, sf):
    part = load(spark, sf, "part")
    key = F.when(F.col("p_type") == "PROMO", F.lit("building")).otherwise(F.lit("highway"))
    value = F.when(F.col("p_type") == "LARGE", F.lit("platform")).otherwise(F.col("p_type"))
    x = F.col("p_size").cast("double")
    ring = F.array(geo.xy(x, x), geo.xy(x + 1, x), geo.xy(x, x + 1), geo.xy(x + F.col("p_size") % 2, x))
    return part.where(values.is_area(F.create_map(key, value), ring)).select("p_partkey")
