"""Hexagon grid tables: cover, neighbours, hierarchy, compaction and their triples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.functions import geo, hexgrid as hx
from cellweave.operators.triples import TRIPLE
from cellweave.session import cut_lineage


def with_cell(df: DataFrame, res: int, lon: str = "lon", lat: str = "lat", out: str = "cell_id") -> DataFrame:
    """Attach the id of the cell that holds each point."""
    return df.withColumn(out, hx.hex_cell(F.col(lon), F.col(lat), res))


def cells_from_ids(df: DataFrame, col: str = "cell_id", res: int | None = None) -> DataFrame:
    """Grid columns (res, q, r, geom, centre) of a table of cell ids; name ``res`` when all ids share a level."""
    q, r = hx.hex_parts(F.col(col))
    level = hx.hex_resolution(F.col(col)) if res is None else F.lit(res)
    base = df.withColumns({"res": level, "q": q, "r": r})
    at = F.col("res") if res is None else res
    lon, lat = hx.hex_center(at, F.col("q"), F.col("r"))
    return base.withColumns({"geom": geo.polygon(hx.hex_ring(at, F.col("q"), F.col("r"))), "lon": lon, "lat": lat})


SPAN = 4_096


def _pieces(lo: Column, hi: Column) -> Column:
    """Starts of the stretches of at most SPAN numbers from ``lo`` to ``hi``; none if the range is empty."""
    return F.when(lo <= hi, F.sequence(lo, hi, F.lit(SPAN)))


def _numbers(df: DataFrame, lo: Column, hi: Column, out: str) -> DataFrame:
    """One row per whole number of each row's range, without ever holding a long range in one array."""
    cut = df.withColumns({"_lo": lo, "_hi": hi}).withColumn("_at", F.explode(_pieces(F.col("_lo"), F.col("_hi"))))
    stretch = F.sequence(F.col("_at"), F.least(F.col("_at") + (SPAN - 1), F.col("_hi")))
    return cut.withColumn(out, F.explode(stretch)).drop("_lo", "_hi", "_at")


def hex_cover(polys: DataFrame, res: int, geom: str = "geom") -> DataFrame:
    """Cells whose centre lies inside each polygon, with the polygon's attributes.

    A sweep over the rows of the grid, in the grid's own axes, where cell centres are whole numbers: each edge gives its
    crossing with every row it passes, the crossings of a (polygon, row) are sorted, and the cells from an odd crossing
    to the next are inside (even-odd rule, holes included). The cost is the edges times the rows they pass plus the
    cells; a polygon is many small rows from the first step on, and no row carries a whole outline.

    Edges hold their lower end, not their upper one, and runs their left end; an edge is always followed upwards, so a
    centre on an edge that two polygons share belongs to exactly one of them. Rings that are not closed are closed;
    geometries other than polygons and null ones cover nothing; repeated polygons are covered each on its own.
    """
    rest = [c for c in polys.columns if c != geom]
    stored = cut_lineage(polys.withColumn("_poly", F.monotonically_increasing_id()))
    rings = stored.where(F.col(geom)["kind"] == "Polygon").select("_poly", F.explode(F.col(geom)["rings"]).alias("ring"))
    following = F.concat(F.slice("ring", F.lit(2), F.greatest(F.size("ring") - 1, F.lit(0))), F.slice("ring", 1, 1))
    edges = rings.select("_poly", F.explode(F.arrays_zip(F.col("ring").alias("a"), following.alias("b"))).alias("e"))

    def end(name: str) -> Column:
        q, r = hx.axial_plane(F.col(f"e.{name}.x"), F.col(f"e.{name}.y"), res)
        return F.struct(r.alias("r"), q.alias("q"))

    ends = edges.select("_poly", F.array_sort(F.array(end("a"), end("b"))).alias("s")).select(
        "_poly", F.get("s", F.lit(0)).alias("lower"), F.get("s", F.lit(1)).alias("upper")
    )
    first, beyond = F.ceil("lower.r").cast("bigint"), F.ceil("upper.r").cast("bigint")
    slope = (F.col("upper.q") - F.col("lower.q")) / (F.col("upper.r") - F.col("lower.r"))
    met = _numbers(ends.where("lower.r < upper.r").withColumn("slope", slope), first, beyond - 1, "r")
    crossings = met.select("_poly", "r", (F.col("lower.q") + (F.col("r") - F.col("lower.r")) * F.col("slope")).alias("x"))
    row = Window.partitionBy("_poly", "r").orderBy("x")
    runs = crossings.select("_poly", "r", "x", F.lead("x").over(row).alias("until"), F.row_number().over(row).alias("n"))
    start, stop = F.ceil("x").cast("bigint"), F.ceil("until").cast("bigint")
    runs = runs.where((F.col("n") % 2 == 1) & (start < stop)).select("_poly", "r", start.alias("_start"), stop.alias("_stop"))
    cells = _numbers(runs.join(stored.select("_poly", *rest), "_poly"), F.col("_start"), F.col("_stop") - 1, "q")
    lon, lat = hx.hex_center(res, F.col("q"), F.col("r"))
    cell = hx.hex_id(res, F.col("q"), F.col("r"))
    return cells.select(*rest, cell.alias("cell_id"), F.lit(res).alias("res"), "q", "r", lon.alias("lon"), lat.alias("lat"))


def hex_parents(cells: DataFrame) -> DataFrame:
    """Parent id of every cell above level 0."""
    up_q, up_r = hx.hex_parent(F.col("res"), F.col("q"), F.col("r"))
    return cells.where("res > 0").withColumn("parent_id", hx.hex_id(F.col("res") - 1, up_q, up_r))


def hex_neighbours(grid: DataFrame) -> DataFrame:
    """Ordered pairs of adjacent grid cells of the same level, by equi-join on the six generated neighbours."""
    cells = grid.select("cell_id", "res", "q", "r").distinct()
    wanted = cells.withColumn("n", F.explode(hx.hex_neighbour_array(F.col("q"), F.col("r")))).select(
        "cell_id", hx.hex_id(F.col("res"), F.col("n.q"), F.col("n.r")).alias("neighbour_id")
    )
    return wanted.join(cells.select(F.col("cell_id").alias("neighbour_id")), "neighbour_id", "left_semi").select(
        "cell_id", "neighbour_id"
    )


def ancestor_chain() -> Column:
    """Array of (res, q, r) from the cell of the row up to its ancestor at level 0, the cell first."""
    start = F.struct(F.col("res").alias("res"), F.col("q").alias("q"), F.col("r").alias("r"))
    kind = "struct<res:int,q:bigint,r:bigint>"

    def up(chain, _):
        last = F.element_at(chain, -1)
        q, r = hx.hex_parent(last["res"], last["q"], last["r"])
        nxt = F.struct((last["res"] - 1).cast("int").alias("res"), q.alias("q"), r.alias("r")).cast(kind)
        return F.concat(chain, F.array(nxt))

    steps = F.when(F.col("res") > 0, F.sequence(F.lit(1), F.col("res"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.array(start.cast(kind)), up)


def hex_ancestors(grid: DataFrame) -> DataFrame:
    """(ancestor, descendant) pairs of grid cells at different levels.

    Each cell generates its whole chain of ancestors in one pass; an equi-join keeps those that are in the grid.
    """
    cells = grid.select("cell_id", "res", "q", "r").distinct()
    above = F.slice(ancestor_chain(), F.lit(2), F.col("res"))
    pairs = cells.select(F.col("cell_id").alias("descendant"), F.explode_outer(above).alias("a"))
    pairs = pairs.where("a IS NOT NULL")
    pairs = pairs.select(hx.hex_id(F.col("a.res"), F.col("a.q"), F.col("a.r")).alias("ancestor"), "descendant")
    return pairs.join(cells.select(F.col("cell_id").alias("ancestor")), "ancestor", "left_semi")


def _without_nested(cells: DataFrame) -> DataFrame:
    """Cells that lie under no other cell of the table."""
    above = cells.select("res", "q", "r", F.explode(F.slice(ancestor_chain(), F.lit(2), F.col("res"))).alias("a"))
    given = cells.select(F.struct("res", "q", "r").alias("a"))
    nested = above.join(given, "a", "left_semi").select("res", "q", "r").distinct()
    return cells.join(nested, ["res", "q", "r"], "left_anti")


def compact_cells(cells: DataFrame) -> DataFrame:
    """The fewest cells that cover the same area: complete sets of seven siblings become their parent, at all levels.

    One aggregation counts for all levels: a cell adds to each of its ancestors the number of cells of the finest level
    that it stands for, and an ancestor is complete if it collects seven to the power of the levels below it. Complete
    cells without a complete parent remain. Counts combine on the map side, so that near the top each task sends a few
    rows only. Repeated cells count once; cells under another given cell add no area and are left out first.
    """
    given = cut_lineage(cells.select(F.col("res").cast("int").alias("res"), F.col("q").cast("bigint").alias("q"), F.col("r").cast("bigint").alias("r")).distinct())
    coarse, fine = given.agg(F.min("res"), F.max("res")).first()
    if coarse != fine:
        given = _without_nested(given)

    def stands_for(res: Column) -> Column:
        return F.element_at(F.array(*[F.lit(7**k) for k in range(hx.MAX_RES + 1)]), F.lit(fine or 0) - res + 1)

    counted = given.select(stands_for(F.col("res")).alias("n"), F.explode(ancestor_chain()).alias("a"))
    full = counted.groupBy("a.res", "a.q", "a.r").agg(F.sum("n").alias("n")).where(F.col("n") == stands_for(F.col("res")))
    full = full.select("res", "q", "r")
    up_q, up_r = hx.hex_parent(F.col("res"), F.col("q"), F.col("r"))
    parents = full.select((F.col("res") + 1).alias("res"), F.col("q").alias("_q"), F.col("r").alias("_r"))
    kept = full.withColumns({"_q": up_q, "_r": up_r}).join(parents, ["res", "_q", "_r"], "left_anti")
    return kept.select("res", "q", "r", hx.hex_id(F.col("res"), F.col("q"), F.col("r")).alias("cell_id"))


def uncompact_cells(cells: DataFrame, res: int) -> DataFrame:
    """All descendants at one level; a cell finer than that level is an error."""
    finer = F.raise_error(F.concat(F.lit(f"a cell is finer than level {res}: "), F.col("res")))
    work = cells.select(F.when(F.col("res") > res, finer).otherwise(F.col("res")).cast("int").alias("res"), "q", "r")
    for _ in range(res):
        kids = F.when(F.col("res") < res, F.transform(hx.hex_children(F.col("res"), F.col("q"), F.col("r")), lambda c: F.struct((F.col("res") + 1).alias("res"), c["q"].alias("q"), c["r"].alias("r"))))
        here = F.array(F.struct("res", "q", "r"))
        work = work.select(F.explode_outer(F.coalesce(kids, here)).alias("c")).select("c.*")
    return work.withColumn("cell_id", hx.hex_id(F.col("res"), F.col("q"), F.col("r")))


def cell_crosswalk(grid: DataFrame, zoom: int = 13) -> DataFrame:
    """Quad cell of the second grid under each hexagon centre."""
    lon, lat = hx.hex_center(F.col("res"), F.col("q"), F.col("r"))
    return grid.select("cell_id", geo.quad_cell(lon, lat, zoom).alias("quad_id"))


def adjacency_triples(grid: DataFrame) -> DataFrame:
    return hex_neighbours(grid).select(
        F.col("cell_id").alias("subject"), F.lit("hcf:isAdjacentTo").alias("predicate"), F.col("neighbour_id").alias("object")
    )


def hierarchy_triples(grid: DataFrame) -> DataFrame:
    """Parent and child edges between all levels present in the grid."""
    pair = F.array(
        F.struct(F.col("ancestor").alias("subject"), F.lit("isParentCellOf").alias("predicate"), F.col("descendant").alias("object")),
        F.struct(F.col("descendant").alias("subject"), F.lit("isChildCellOf").alias("predicate"), F.col("ancestor").alias("object")),
    )
    return hex_ancestors(grid).select(F.explode(pair).alias("t")).select(*[f"t.{c}" for c in TRIPLE])


def feature_cell_map(features: DataFrame, res: int) -> DataFrame:
    """Which grid cell holds which point feature."""
    return features.select(hx.hex_cell(F.col("lon"), F.col("lat"), res).alias("cell_id"), "osm_id")

