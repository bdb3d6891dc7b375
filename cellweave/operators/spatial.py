"""Spatial joins by tile keys: candidates, topological relations, nearest distance."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.functions import geo, hexgrid as hx
from cellweave.functions.topology import EDGE_NAMES, PREDICATES, relations
from cellweave.operators.scale import parallelism, pinned
from cellweave.operators.triples import triple

# Tile sizes in degrees double from level to level.
FINEST_TILE = 0.01
TILE_LEVELS = 16

# Boxes of cells are taken larger by so many degrees: a shape on the rim of a cell must not be lost to rounding.
RIM = 1e-9


def _tile_level(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Finest level whose tiles are at least as large as the box, so the box meets at most four tiles."""
    extent = F.greatest(x1 - x0, y1 - y0, F.lit(FINEST_TILE))
    return F.least(F.ceil(F.log2(extent / FINEST_TILE)).cast("int"), F.lit(TILE_LEVELS))


def _with_tiles(df: DataFrame, box: str) -> DataFrame:
    """One row per tile of the row's level that its box meets."""
    size = F.lit(FINEST_TILE) * F.pow(F.lit(2.0), F.col("tile_level"))

    def span(axis: str) -> Column:
        lo, hi = F.col(f"{box}.{axis}0"), F.col(f"{box}.{axis}1")
        return F.explode_outer(F.sequence(F.floor(lo / size).cast("bigint"), F.floor(hi / size).cast("bigint")))

    return df.withColumn("tile_i", span("x")).withColumn("tile_j", span("y"))


def spatial_candidates(features: DataFrame, grid: DataFrame) -> DataFrame:
    """Feature and cell pairs whose bounding boxes meet, or miss each other by no more than ``RIM``, each pair once.

    Features and cells take the tile level that fits their size; a pair of levels meets on the coarser of the
    two, so each side lies in at most four tiles per level of the other side, whatever the mix of sizes. The
    join is an equi-join on the tile. A pair found in several tiles is kept only in the tile that holds the
    lower-left corner of the common box, so no de-duplication shuffle is needed.

    Features are dealt to all tasks first: a small file of large features makes many pairs, each of them costly.
    """
    def boxed(geom: str, rim: float = 0.0) -> Column:
        wider = (-rim, -rim, rim, rim)
        return pinned(F.struct(*[(v + r).alias(n) for v, r, n in zip(geo.bounds(F.col(geom)), wider, ("x0", "y0", "x1", "y1"))]))

    def level(box: str) -> Column:
        return pinned(_tile_level(*[F.col(f"{box}.{n}") for n in ("x0", "y0", "x1", "y1")]))

    features = features.repartition(parallelism(features))
    f = features.select(pinned(F.struct(*features.columns)).alias("f")).withColumn("fb", boxed("f.geom"))
    f = f.withColumn("f_level", level("fb"))
    c = grid.select("cell_id", pinned(F.col("geom")).alias("cell_geom")).withColumn("cb", boxed("cell_geom", RIM))
    c = c.withColumn("c_level", level("cb"))

    def levels(df: DataFrame, col: str) -> Column:
        # at most TILE_LEVELS + 1 values
        return F.explode_outer(df.select(col).distinct().agg(F.sort_array(F.collect_set(col))).scalar())

    tile_level = F.greatest("f_level", "c_level").alias("tile_level")
    c_levels, f_levels = levels(c, "c_level"), levels(f, "f_level")
    f = _with_tiles(f.withColumn("c_level", c_levels).select("*", tile_level), "fb")
    c = _with_tiles(c.withColumn("f_level", f_levels).select("*", tile_level), "cb").drop("tile_level")

    size = F.lit(FINEST_TILE) * F.pow(F.lit(2.0), F.col("tile_level"))
    meet = (
        (F.col("fb.x0") <= F.col("cb.x1")) & (F.col("cb.x0") <= F.col("fb.x1"))
        & (F.col("fb.y0") <= F.col("cb.y1")) & (F.col("cb.y0") <= F.col("fb.y1"))
    )
    first = (F.floor(F.greatest("fb.x0", "cb.x0") / size) == F.col("tile_i")) & (
        F.floor(F.greatest("fb.y0", "cb.y0") / size) == F.col("tile_j")
    )
    return f.join(c, ["f_level", "c_level", "tile_i", "tile_j"]).where(meet & first).select("f.*", "cell_id", "cell_geom")


def topology(candidates: DataFrame, names: dict[str, str] = PREDICATES) -> DataFrame:
    """All relations of each candidate pair in one pass; disjoint pairs vanish."""
    ring = F.element_at(F.col("cell_geom.rings"), 1)
    rel = relations(ring, F.col("geom"), names)
    found = candidates.withColumn("relation", F.explode_outer(rel)).drop("cell_geom", "geom")
    return found.where("relation IS NOT NULL")


def topology_triples(features: DataFrame, grid: DataFrame) -> DataFrame:
    """Cell -> feature relation triples with the feature's date."""
    found = topology(spatial_candidates(features.select("osm_id", "geom", "date"), grid))
    return found.select(triple(F.col("cell_id"), F.col("relation"), F.col("osm_id")).alias("t"), "date").select("t.*", "date")


def multipart_relations(parts: DataFrame, grid: DataFrame, id_col: str = "osm_id") -> DataFrame:
    """Relations of cells to features given as several parts of one kind, one row per part.

    A cell covers a feature when it covers every part and intersects it when it meets one. Parts inside
    together with parts outside make a crossing for points and lines, an overlap for polygons.
    """
    kind = F.col("geom.kind").alias("kind")
    total = parts.groupBy(id_col, kind).agg(F.count("*").alias("n"))
    pair = topology(spatial_candidates(parts.select(id_col, kind, "geom"), grid))
    counts = pair.groupBy("cell_id", id_col, "kind").pivot("relation", list(PREDICATES.values())).count().na.fill(0)
    flags = counts.join(total, [id_col, "kind"])
    p = {k: F.col(f"`{v}`") for k, v in PREDICATES.items()}
    areal = F.col("kind") == "Polygon"
    interior = (p["contains"] + p["crosses"] + p["overlaps"] + p["within"]) > 0
    covered = p["covers"] == F.col("n")
    mixed = interior & ~covered & (p["within"] == 0)
    rules = {
        "intersects": p["intersects"] > 0,
        "contains": covered & interior,
        "crosses": mixed & ~areal,
        "equals": (p["equals"] > 0) & (F.col("n") == 1),
        "overlaps": mixed & areal,
        "touches": (p["intersects"] > 0) & ~interior,
        "within": p["within"] > 0,
        "covers": covered,
        "coveredBy": p["coveredBy"] > 0,
    }
    named = F.array_compact(F.array(*[F.when(rules[k], F.lit(PREDICATES[k])) for k in PREDICATES]))
    return flags.select("cell_id", id_col, F.explode_outer(named).alias("relation")).where("relation IS NOT NULL")


def relation_edges(features: DataFrame, grid: DataFrame, id_col: str = "osm_id") -> DataFrame:
    """The same relations as an edge list (from, to, description)."""
    found = topology(spatial_candidates(features.select(id_col, "geom"), grid), EDGE_NAMES)
    return found.select(F.col("cell_id").alias("from"), F.col(id_col).alias("to"), F.col("relation").alias("description"))


def join_to_grid(df: DataFrame, grid: DataFrame, res: int | None = None) -> DataFrame:
    """Attach the cell id; rows outside the grid drop out.

    With ``res`` the rows are points (lon, lat) and the cell follows by arithmetic; otherwise their geometry is
    joined on intersection and a row is repeated per cell it meets.
    """
    if res is not None:
        with_id = df.withColumn("cell_id", hx.hex_cell(F.col("lon"), F.col("lat"), res))
        return with_id.join(grid.select("cell_id").distinct(), "cell_id", "left_semi")
    ring = F.element_at(F.col("cell_geom.rings"), 1)
    pairs = spatial_candidates(df, grid)
    return pairs.where(F.array_contains(relations(ring, F.col("geom")), PREDICATES["intersects"])).drop("cell_geom")


# -- features ---------------------------------------------------------------------------------------------------


def bbox_filter(df: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    return df.where(F.col("lon").between(west, east) & F.col("lat").between(south, north))


def valid_geometries(df: DataFrame, repair: bool = False, geom: str = "geom") -> DataFrame:
    """Valid geometries only; with ``repair`` rings are closed, tidied and oriented first."""
    if repair:
        df = df.withColumn(geom, geo.make_valid(F.col(geom)))
    return df.where(geo.is_valid(F.col(geom)))


def features_with_tag(df: DataFrame, key: str, value: str, col: str = "all_tags") -> DataFrame:
    return df.where(F.try_element_at(col, F.lit(key)) == value)


def with_geohash(df: DataFrame, precision: int, geom: str = "geom") -> DataFrame:
    c = geo.center(F.col(geom))
    return df.withColumn("geohash", geo.geohash(c["x"], c["y"], precision))


# -- nearest distance ---------------------------------------------------------------------------------------------


def _mid(a: Column, b: Column) -> Column:
    x, y, z = (a[k] + b[k] for k in "xyz")
    n = F.sqrt(x * x + y * y + z * z)
    return F.struct((x / n).alias("x"), (y / n).alias("y"), (z / n).alias("z"))


def _pieces(segments: DataFrame, max_arc: float) -> DataFrame:
    """Great-circle segments cut into pieces of at most ``max_arc`` radians."""
    s = segments.select(
        geo.unit_vector(F.col("ax"), F.col("ay")).alias("a"), geo.unit_vector(F.col("bx"), F.col("by")).alias("b")
    )
    s = s.withColumn("arc", 2 * F.asin(F.least(F.lit(1.0), geo.chord(F.col("a"), F.col("b")) / 2)))
    s = s.withColumn("n", F.greatest(F.lit(1), F.ceil(F.col("arc") / max_arc).cast("int")))
    s = s.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))

    def at(i: Column) -> Column:
        t = i / F.col("n")
        w0 = F.when(F.col("arc") > 0, F.sin((1 - t) * F.col("arc")) / F.sin("arc")).otherwise(1 - t)
        w1 = F.when(F.col("arc") > 0, F.sin(t * F.col("arc")) / F.sin("arc")).otherwise(t)
        return F.struct(*[(F.col("a")[k] * w0 + F.col("b")[k] * w1).alias(k) for k in "xyz"])

    p = s.select(at(F.col("i")).alias("a"), at(F.col("i") + 1).alias("b"))
    return p.withColumn("m", _mid(F.col("a"), F.col("b")))


def _arc_distance(p: Column, a: Column, b: Column) -> Column:
    """Chord length from a unit vector to the nearest point of the great-circle arc a-b."""
    n = {
        "x": a["y"] * b["z"] - a["z"] * b["y"],
        "y": a["z"] * b["x"] - a["x"] * b["z"],
        "z": a["x"] * b["y"] - a["y"] * b["x"],
    }
    norm = F.sqrt(n["x"] * n["x"] + n["y"] * n["y"] + n["z"] * n["z"])
    off = (p["x"] * n["x"] + p["y"] * n["y"] + p["z"] * n["z"]) / norm
    foot = {k: p[k] - off * n[k] / norm for k in "xyz"}
    # the foot lies on the arc when it is no farther than half the arc from the arc's middle
    m = {k: a[k] + b[k] for k in "xyz"}
    dot_fm = sum((foot[k] * m[k] for k in "xyz"), F.lit(0.0))
    dot_am = sum((a[k] * m[k] for k in "xyz"), F.lit(0.0))
    flen = F.sqrt(sum((foot[k] * foot[k] for k in "xyz"), F.lit(0.0)))
    on_arc = (norm > 1e-15) & (flen > 1e-15) & (dot_fm >= dot_am * flen)
    s = F.abs(off)
    cross_chord = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.sqrt(F.greatest(F.lit(0.0), 1 - s * s))))
    ends = F.least(geo.chord(p, a), geo.chord(p, b))
    return F.when(on_arc, F.least(cross_chord, ends)).otherwise(ends)


def nearest_distance(
    points: DataFrame, segments: DataFrame, point_id: str, levels: int = 5, max_arc: float = 0.02, out: str = "distance_m"
) -> DataFrame:
    """Exact great-circle distance in metres from every point to the nearest of many segments.

    Level-wise branch and bound on cubes of 3-d space, so neither poles nor the date line matter: each round
    refines the cubes a point may still need by an equi-join on the parent cube, and keeps those whose lower
    bound does not exceed the best upper bound. Only the surviving leaf cubes are joined with their segments.
    """
    sizes = [0.5 / 4**k for k in range(levels)]
    pieces = _pieces(segments, max_arc)
    reach = math.sqrt(3.0) / 2

    def cube(size: float, v: str) -> Column:
        return F.struct(*[F.floor(F.col(v)[k] / size).cast("bigint").alias(k) for k in "xyz"])

    for k, s in enumerate(sizes):
        pieces = pieces.withColumn(f"c{k}", cube(s, "m"))
    pieces = pieces.withColumn("all", F.lit(0))
    slack = pieces.agg(F.max(geo.chord(F.col("m"), F.col("a"))) + 1e-12).scalar()
    p = points.select(F.col(point_id), geo.unit_vector(F.col("lon"), F.col("lat")).alias("p"), F.lit(0).alias("parent"))
    parent = "all"
    for k, s in enumerate(sizes):
        cubes = pieces.groupBy(F.col(parent).alias("parent"), F.col(f"c{k}").alias("child")).agg(F.min("m").alias("rep"))
        mid = F.struct(*[((F.col("child")[x] + 0.5) * s).alias(x) for x in "xyz"])
        if k == 0:
            # the unit sphere meets at most 6 x 6 x 6 cubes of this size, so the table is safe to copy
            cubes = F.broadcast(cubes)
        cand = p.join(cubes, "parent").withColumn("lower", geo.chord(F.col("p"), mid) - reach * s - slack)
        cand = cand.withColumn("upper", geo.chord(F.col("p"), F.col("rep")))
        best = F.min("upper").over(Window.partitionBy(point_id))
        p = cand.withColumn("best", best).where(F.col("lower") <= F.col("best")).select(point_id, "p", F.col("child").alias("parent"))
        parent = f"c{k}"
    leaf = pieces.select(F.col(parent).alias("parent"), "a", "b")
    near = p.join(leaf, "parent").select(point_id, _arc_distance(F.col("p"), F.col("a"), F.col("b")).alias("c"))
    return near.groupBy(point_id).agg(geo.chord_to_m(F.min("c")).alias(out))
