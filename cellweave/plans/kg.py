"""The dated knowledge graph as one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame

from cellweave.operators import grid as g
from cellweave.operators.spatial import topology_triples
from cellweave.operators.triples import distinct_dates, geometry_triples, replicate_dates, tag_triples, union_triples

# Fixed value: prefix of the geometry nodes of grid cells.
CELL_GEOMETRY = "geoH3"


def grid_relations(grid: DataFrame) -> DataFrame:
    """Geometry, adjacency and hierarchy triples of the grid, undated."""
    shapes = geometry_triples(grid, "cell_id", CELL_GEOMETRY, None)
    return union_triples(shapes, g.adjacency_triples(grid), g.hierarchy_triples(grid))


def build_kg(features: DataFrame, grid: DataFrame, main_tags: DataFrame, distinct: bool = False) -> DataFrame:
    """Tag, geometry and topology triples of dated features, and the grid's triples repeated for every date.

    A bag by default: one subclass edge per tagged object. ``distinct`` turns it into a set.
    """
    kg = union_triples(
        tag_triples(features, main_tags),
        geometry_triples(features),
        topology_triples(features, grid),
        replicate_dates(grid_relations(grid), distinct_dates(features)),
    )
    return kg.distinct() if distinct else kg
