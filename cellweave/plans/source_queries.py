"""Registered queries: reader jobs over files that the test tables are written to, and small operators without another query."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellweave.functions import geo, values
from cellweave.operators import panel
from cellweave.plans import inputs
from cellweave.plans.model_queries import scratch
from cellweave.plans.registry import load, query
from cellweave.sources import readers, writers


def _text_date(df, *cols):
    return df.select(*cols, F.col("date").cast("string").alias("date"))


@query(
    "read_features",
    """SELECT c_custkey AS osm_id, CASE WHEN c_custkey % 2 = 0 THEN '2016-09-01' ELSE '2017-02-28' END AS date FROM customer""",
)
def read_features(spark, sf):
    """Two snapshot folders; the date comes from the name of each file, written both ways."""
    import uuid

    folder = scratch(spark)
    c = load(spark, sf, "customer").select(F.col("c_custkey").alias("osm_id"))
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for name, part in (("features-2016-09-01", c.where("osm_id % 2 = 0")), ("170228-features", c.where("osm_id % 2 = 1"))):
        made = f"{folder}/{uuid.uuid4().hex}"
        part.coalesce(1).write.parquet(made)
        path = spark._jvm.org.apache.hadoop.fs.Path
        fs = path(made).getFileSystem(conf)
        file = next(f.getPath() for f in fs.listStatus(path(made)) if f.getPath().getName().endswith(".parquet"))
        fs.mkdirs(path(f"{folder}/features/{name}"))
        fs.rename(file, path(f"{folder}/features/{name}/{name}.parquet"))
    return _text_date(readers.read_features(spark, f"{folder}/features"), "osm_id")


@query("list_dates", f"WITH {inputs.DATED_SQL} SELECT DISTINCT CAST(date AS VARCHAR) AS date FROM dated")
def list_dates(spark, sf):
    path = f"{scratch(spark)}/dated"
    writers.write_triples(inputs.dated_star(spark, sf), path)
    return _text_date(readers.list_dates(spark, path))


@query("read_export", "SELECT o_orderkey, o_custkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS o_orderdate FROM orders")
def read_export(spark, sf):
    """The Parquet branch of the relational reader."""
    return readers.read_jdbc_or_parquet(spark, f"{sf}/orders.parquet").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").cast("string").alias("o_orderdate"))


@query(
    "read_yearly",
    "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders",
)
def read_yearly(spark, sf):
    """Orders in folders named by year, read at once."""
    path = f"{scratch(spark)}/years"
    orders = load(spark, sf, "orders").select("o_orderkey", F.year(F.col("o_orderdate").cast("date")).alias("year"))
    orders.write.partitionBy("year").parquet(path)
    return readers.read_yearly(spark, path).select("o_orderkey", "year")


@query(
    "written_vectors",
    "SELECT label AS \"ID\", vec_id, " + ", ".join(f'CAST(embedding[{i + 1}] AS DOUBLE) AS "vector{i}"' for i in (0, 31, 63)) + " FROM embeddings",
)
def written_vectors(spark, sf):
    """Vectors through the writer and back."""
    path = f"{scratch(spark)}/vectors"
    e = load(spark, sf, "embeddings").select(F.col("label").alias("ID"), "vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    writers.write_vectors(e, path, 64)
    return spark.read.parquet(path).select("ID", "vec_id", "vector0", "vector31", "vector63")


@query(
    "keep_entities",
    "SELECT o_orderkey, o_custkey AS \"ID\" FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)",
)
def keep_entities(spark, sf):
    orders = load(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("ID"))
    return panel.keep_entities(orders, load(spark, sf, "customer").where("c_acctbal > 0").select("c_custkey"))


@query(
    "argmin",
    """SELECT o_custkey, o_orderkey, o_totalprice FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) = 1""",
)
def argmin(spark, sf):
    """The cheapest order of every customer."""
    orders = load(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return panel.argmin(orders, ["o_custkey"], "o_totalprice", ["o_orderkey"])


@query(
    "explode_parts",
    f"""WITH n AS (SELECT n_regionkey, n_nationkey, {inputs.lon_sql('n_nationkey')} AS lon, {inputs.lat_sql('n_nationkey')} AS lat FROM nation)
    SELECT n_regionkey, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INTEGER) AS part, round(lon, 2) AS lon, round(lat, 2) AS lat FROM n""",
)
def explode_parts(spark, sf):
    """The nations of a region as one collection of points, taken apart again."""
    n = load(spark, sf, "nation").select(
        "n_regionkey", "n_nationkey", geo.point(inputs.lon_of(F.col("n_nationkey")), inputs.lat_of(F.col("n_nationkey"))).alias("geom")
    )
    ordered = F.sort_array(F.collect_list(F.struct("n_nationkey", "geom")))
    parts = n.groupBy("n_regionkey").agg(F.transform(ordered, lambda x: x["geom"]).alias("parts"))
    at = F.col("geom")["rings"][0][0]
    return geo.explode_parts(parts).select("n_regionkey", "part", F.round(at["x"], 2).alias("lon"), F.round(at["y"], 2).alias("lat"))


@query(
    "clamp_round",
    """SELECT l_orderkey, l_linenumber, CAST(CASE WHEN v <= 0.5 THEN 0 ELSE 1 END AS DOUBLE) AS value
    FROM (SELECT l_orderkey, l_linenumber, (CAST(l_quantity AS DOUBLE) - 10) / 32 AS v FROM lineitem)""",
)
def clamp_round(spark, sf):
    """Values below 0 and above 1 among them, and exact halves, which go to the even number."""
    v = (F.col("l_quantity").cast("double") - 10) / 32
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", values.clamp_round(v).alias("value"))
