"""Registered queries: the assembled graph and its grid part."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellweave.functions.topology import PREDICATES
from cellweave.operators import vectors
from cellweave.plans import inputs, kg
from cellweave.plans.registry import load, query
from cellweave.plans.spatial_queries import TOPO_RES, _R, _offset_sql, customer_grid, grid_sql, num

_MAIN = "('BUILDING', 'MACHINERY')"


@query(
    "build_kg",
    f"""WITH {grid_sql(TOPO_RES)}, {inputs.FEATURES_SQL},
    near AS (SELECT date, {_offset_sql('lon', 'lat')} AS off FROM (SELECT date, lon, lat FROM features) f JOIN grid
      ON abs(lon - clon) <= {num(_R + 1e-9)} AND abs(lat - clat) <= {num(_R + 1e-9)}),
    rel AS (SELECT date, unnest(CASE WHEN off < -1e-9 THEN ['{PREDICATES["intersects"]}', '{PREDICATES["contains"]}', '{PREDICATES["covers"]}']
      ELSE ['{PREDICATES["intersects"]}', '{PREDICATES["touches"]}', '{PREDICATES["covers"]}'] END) AS predicate FROM near WHERE off <= 1e-9),
    adj AS (SELECT count(*) AS n FROM grid a JOIN grid b ON a.cell_id <> b.cell_id AND abs(a.q - b.q) <= 1 AND abs(a.r - b.r) <= 1 AND abs(a.q + a.r - b.q - b.r) <= 1),
    days AS (SELECT DISTINCT date FROM features),
    parts AS (
      SELECT date, 'rdf:type' AS predicate, 1 AS n FROM features WHERE segment IN {_MAIN}
      UNION ALL SELECT date, 'rdfs:subClassOf', 1 FROM features WHERE segment IN {_MAIN}
      UNION ALL SELECT date, 'segment', 1 FROM features WHERE segment NOT IN {_MAIN}
      UNION ALL SELECT date, 'nation', 1 FROM features
      UNION ALL SELECT date, unnest(['geo:hasGeometry', 'geo:asWKT']), 1 FROM features
      UNION ALL SELECT date, unnest(['geo:hasGeometry', 'geo:asWKT']), (SELECT count(*) FROM grid) FROM days
      UNION ALL SELECT date, predicate, 1 FROM rel
      UNION ALL SELECT date, 'hcf:isAdjacentTo', adj.n FROM days, adj WHERE adj.n > 0)
    SELECT CAST(date AS VARCHAR) AS date, predicate, CAST(sum(n) AS BIGINT) AS n FROM parts GROUP BY 1, 2""",
)
def build_kg(spark, sf):
    main = load(spark, sf, "customer").where(f"c_mktsegment IN {_MAIN}").select(F.lit("segment").alias("key"), F.col("c_mktsegment").alias("value"))
    out = kg.build_kg(inputs.customer_features(spark, sf), customer_grid(spark, sf, TOPO_RES), main)
    return out.groupBy(F.col("date").cast("string").alias("date"), "predicate").agg(F.count("*").alias("n"))


@query(
    "select_cell_vectors",
    f"""SELECT 'cell/' || vec_id AS "ID", '2016-09-01' AS "DATE", {', '.join(f'CAST(embedding[{i + 1}] AS DOUBLE) AS vector{i}' for i in range(64))}
    FROM embeddings WHERE vec_id IN (SELECT n_nationkey FROM nation)""",
)
def select_cell_vectors(spark, sf):
    v = load(spark, sf, "embeddings").select(F.concat(F.lit("cell/"), "vec_id").alias("token"), F.col("embedding").cast("array<double>").alias("vector"))
    cells = load(spark, sf, "nation").select(F.concat(F.lit("cell/"), "n_nationkey").alias("cell_id"))
    return vectors.select_cell_vectors(v, cells, "2016-09-01", 64)
