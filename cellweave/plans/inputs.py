"""Feature, grid, station and triple tables derived from the star-schema tables, in Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.functions.dates import month_start
from cellweave.functions.geo import box, line, point, xy
from cellweave.operators.scale import tasks_for
from cellweave.operators.triples import replicate_dates, triple, union_triples
from cellweave.plans.registry import load

# -- coordinates ------------------------------------------------------------------------------------------------


def lon_of(key: Column) -> Column:
    return F.pmod(key.cast("bigint") * 7919, F.lit(36000)).cast("double") / 100 - 180


def lat_of(key: Column) -> Column:
    return F.pmod(key.cast("bigint") * 104729, F.lit(17000)).cast("double") / 100 - 85


def lon_sql(key: str) -> str:
    return f"(CAST((CAST({key} AS BIGINT) * 7919) % 36000 AS DOUBLE) / 100 - 180)"


def lat_sql(key: str) -> str:
    return f"(CAST((CAST({key} AS BIGINT) * 104729) % 17000 AS DOUBLE) / 100 - 85)"


def num(v: float) -> str:
    """Number text that both engines read as a double."""
    text = repr(float(v))
    return text if "e" in text else text + "e0"


# -- map features -------------------------------------------------------------------------------------------------


def customer_points(spark: SparkSession, sf: str) -> DataFrame:
    c = load(spark, sf, "customer")
    return c.select(
        F.col("c_custkey").alias("osm_id"), lon_of(F.col("c_custkey")).alias("lon"), lat_of(F.col("c_custkey")).alias("lat")
    )


CUSTOMER_POINTS_SQL = (
    f"customer_points AS (SELECT c_custkey AS osm_id, {lon_sql('c_custkey')} AS lon, {lat_sql('c_custkey')} AS lat FROM customer)"
)


def supplier_stations(spark: SparkSession, sf: str) -> DataFrame:
    s = load(spark, sf, "supplier")
    return s.select(
        F.col("s_suppkey").alias("station"), lon_of(F.col("s_suppkey") + 1).alias("lon"), lat_of(F.col("s_suppkey") + 1).alias("lat")
    )


STATIONS_SQL = (
    f"stations AS (SELECT s_suppkey AS station, {lon_sql('s_suppkey + 1')} AS lon, {lat_sql('s_suppkey + 1')} AS lat FROM supplier)"
)


def nation_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Axis-parallel boxes round every nation's pseudo-centre, half-width by region."""
    n = load(spark, sf, "nation")
    k = F.col("n_nationkey").cast("bigint") + 1
    half = 1.0 + F.col("n_regionkey").cast("double")
    b = n.select("n_nationkey", "n_name", "n_regionkey", lon_of(k).alias("cx"), lat_of(k).alias("cy"), half.alias("half"))
    return b.withColumn(
        "geom", box(F.col("cx") - F.col("half"), F.col("cy") - F.col("half"), F.col("cx") + F.col("half"), F.col("cy") + F.col("half"))
    )


BOXES_SQL = f"""boxes AS (
  SELECT n_nationkey, n_name, n_regionkey, cx, cy, half, cx - half AS x0, cy - half AS y0, cx + half AS x1, cy + half AS y1
  FROM (SELECT *, {lon_sql('n_nationkey + 1')} AS cx, {lat_sql('n_nationkey + 1')} AS cy,
               1 + CAST(n_regionkey AS DOUBLE) AS half FROM nation))"""


def nation_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Segment from every nation's centre to that of the next nation of its region (the last one to the first)."""
    b = nation_boxes(spark, sf)
    per_region = b.groupBy("n_regionkey").agg(
        F.sort_array(F.collect_list(F.struct("n_nationkey", "cx", "cy"))).alias("ring")
    )
    pairs = per_region.select(F.posexplode("ring").alias("i", "a"), "ring").withColumn(
        "b", F.element_at("ring", (F.col("i") + 1) % F.size("ring") + 1)
    )
    return pairs.select(
        F.col("a.n_nationkey").alias("line_id"), F.col("a.cx").alias("ax"), F.col("a.cy").alias("ay"),
        F.col("b.cx").alias("bx"), F.col("b.cy").alias("by"),
    ).withColumn("geom", line(F.array(xy(F.col("ax"), F.col("ay")), xy(F.col("bx"), F.col("by")))))


LINES_SQL = """lines AS (
  SELECT n_nationkey AS line_id, cx AS ax, cy AS ay,
         coalesce(lead(cx) OVER w, first_value(cx) OVER w) AS bx, coalesce(lead(cy) OVER w, first_value(cy) OVER w) AS by_
  FROM boxes WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey))"""


def customer_features(spark: SparkSession, sf: str) -> DataFrame:
    """Point features with a tag map, dated by the month of the customer's first order."""
    first = load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.min(month_start(F.col("o_orderdate"))).alias("date")
    )
    c = load(spark, sf, "customer").join(
        load(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey"
    )
    return c.join(first, "c_custkey").select(
        F.concat(F.lit("node/"), F.col("c_custkey")).alias("osm_id"),
        F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("nation"), F.col("n_name")).alias("all_tags"),
        point(lon_of(F.col("c_custkey")), lat_of(F.col("c_custkey"))).alias("geom"),
        lon_of(F.col("c_custkey")).alias("lon"), lat_of(F.col("c_custkey")).alias("lat"),
        "date",
    )


FEATURES_SQL = f"""features AS (
  SELECT 'node/' || c_custkey AS osm_id, c_mktsegment AS segment, n_name AS nation,
         {lon_sql('c_custkey')} AS lon, {lat_sql('c_custkey')} AS lat, f.date
  FROM customer JOIN nation ON n_nationkey = c_nationkey
  JOIN (SELECT o_custkey, min(CAST(date_trunc('month', o_orderdate) AS DATE)) AS date FROM orders GROUP BY 1) f
    ON f.o_custkey = c_custkey)"""


# -- triples --------------------------------------------------------------------------------------------------


def star_tasks(spark: SparkSession, sf: str) -> int:
    """Partitions for the edges of the star, by the number of line items."""
    return tasks_for(load(spark, sf, "lineitem"))


def dated_star(spark: SparkSession, sf: str) -> DataFrame:
    """Order and line-item edges, dated by the order month.

    The small files unfold to many long rows, so both tables are dealt by order into partitions of bounded size first:
    what later steps combine or sort before their own shuffle stays bounded too.
    """
    orders = load(spark, sf, "orders").select("o_orderkey", "o_custkey", month_start(F.col("o_orderdate")).alias("date"))
    tasks = star_tasks(spark, sf)
    orders = orders.repartition(tasks, "o_orderkey")
    order_node = F.concat(F.lit("order/"), F.col("o_orderkey"))
    placed = orders.select(
        triple(order_node, "placedBy", F.concat(F.lit("customer/"), F.col("o_custkey"))).alias("t"), "date"
    )
    item_node = F.concat_ws("/", F.lit("item"), "l_orderkey", "l_linenumber")
    items = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").repartition(tasks, "l_orderkey")
    items = items.join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "date"), "l_orderkey").select(
        F.explode(
            F.array(
                triple(item_node, "ofPart", F.concat(F.lit("part/"), F.col("l_partkey"))),
                triple(item_node, "bySupplier", F.concat(F.lit("supplier/"), F.col("l_suppkey"))),
            )
        ).alias("t"),
        "date",
    )
    return placed.unionByName(items).select("t.*", "date")


def static_star(spark: SparkSession, sf: str) -> DataFrame:
    """Customer, nation and region edges without a date."""
    c = load(spark, sf, "customer").select(
        triple(F.concat(F.lit("customer/"), F.col("c_custkey")), "inNation", F.concat(F.lit("nation/"), F.col("c_nationkey"))).alias("t")
    )
    n = load(spark, sf, "nation").select(
        triple(F.concat(F.lit("nation/"), F.col("n_nationkey")), "inRegion", F.concat(F.lit("region/"), F.col("n_regionkey"))).alias("t")
    )
    return c.unionByName(n).select("t.*")


def star_kg(spark: SparkSession, sf: str) -> DataFrame:
    """Dated edges plus the undated ones repeated for every date."""
    dated = dated_star(spark, sf)
    months = load(spark, sf, "orders").select(month_start(F.col("o_orderdate")).alias("date"))
    return union_triples(dated, replicate_dates(static_star(spark, sf), months))


def all_edges(spark: SparkSession, sf: str) -> DataFrame:
    """All star edges without dates."""
    return dated_star(spark, sf).drop("date").unionByName(static_star(spark, sf))


DATED_SQL = """dated AS (
  SELECT 'order/' || o_orderkey AS subject, 'placedBy' AS predicate, 'customer/' || o_custkey AS object,
         CAST(date_trunc('month', o_orderdate) AS DATE) AS date FROM orders
  UNION ALL
  SELECT 'item/' || l_orderkey || '/' || l_linenumber, 'ofPart', 'part/' || l_partkey,
         CAST(date_trunc('month', o_orderdate) AS DATE) FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  UNION ALL
  SELECT 'item/' || l_orderkey || '/' || l_linenumber, 'bySupplier', 'supplier/' || l_suppkey,
         CAST(date_trunc('month', o_orderdate) AS DATE) FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

STATIC_SQL = """static_edges AS (
  SELECT 'customer/' || c_custkey AS subject, 'inNation' AS predicate, 'nation/' || c_nationkey AS object FROM customer
  UNION ALL
  SELECT 'nation/' || n_nationkey, 'inRegion', 'region/' || n_regionkey FROM nation)"""

STAR_SQL = f"""{DATED_SQL}, {STATIC_SQL},
months AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS date FROM orders),
star AS MATERIALIZED (SELECT * FROM dated UNION ALL SELECT subject, predicate, object, date FROM static_edges, months)"""

EDGES_SQL = f"""{DATED_SQL}, {STATIC_SQL},
edges AS (SELECT subject, predicate, object FROM dated UNION ALL SELECT * FROM static_edges)"""
