"""Shapes that lie exactly on the rim of a cell."""

from pyspark.sql import functions as F

from cellweave.functions import geo
from cellweave.operators import grid, panel, spatial


def test_points_on_a_side_touch_both_cells(spark):
    """The side between the two cells stands at a longitude of 170, which neither cell's corners reach exactly."""
    cells = grid.cells_from_ids(spark.createDataFrame([("2/-2/60",), ("2/-2/61",)], "cell_id string"), res=2)
    x = [r.x for r in cells.select(F.explode(F.transform(F.element_at("geom.rings", 1), lambda p: p["x"])).alias("x")).collect()]
    assert any(0 < abs(v - 170) < 1e-9 for v in x)
    points = spark.createDataFrame([("a", 170.0, 5.0)], "osm_id string, lon double, lat double")
    points = points.select("osm_id", geo.point(F.col("lon"), F.col("lat")).alias("geom"), F.lit("2020-01-01").alias("date"))
    found = spatial.topology_triples(points, cells).where("predicate = 'geo:sfTouches'").select("subject").collect()
    assert len(found) == 2 and ("2/-2/60",) in [tuple(r) for r in found]


def test_a_burned_spot_on_a_side_labels_one_cell(spark):
    ids = spark.createDataFrame([("2/-2/60",), ("2/-2/61",)], "cell_id string")
    spots = spark.createDataFrame([(2020, 40, 170.0, 5.0), (2020, 41, 170.0, 5.0)], "year int, BurnDate int, lon double, lat double")
    out = panel.fire_labels(spots, grid.cells_from_ids(ids, res=2), res=2).collect()
    assert [str(r.DATE) for r in out] == ["2020-02-01"]
