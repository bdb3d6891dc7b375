"""Registered queries: triples, statistics and walks."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellweave.functions.dates import month_start
from cellweave.operators import graph, triples
from cellweave.plans import inputs
from cellweave.plans.registry import load, query
from cellweave.session import cut_lineage

_STATS_SQL = f"""
WITH {inputs.STAR_SQL},
ends AS (SELECT date, subject AS node FROM star UNION SELECT date, object FROM star),
n AS (SELECT date, count(*) AS nodes FROM ends GROUP BY date),
e AS (SELECT date, count(*) AS edges FROM star GROUP BY date)
SELECT CAST(n.date AS VARCHAR) AS date, nodes, edges, round(CAST(edges AS DOUBLE) / nodes, 4) AS mean_out_degree
FROM n JOIN e USING (date)"""


@query("graph_statistics_by_month", _STATS_SQL)
def graph_statistics_by_month(spark, sf):
    """An undated triple belongs to every month, so its node does too: it is counted once and added to all of them."""
    dated = triples.normalize_triples(inputs.dated_star(spark, sf))
    months = load(spark, sf, "orders").select(month_start(F.col("o_orderdate")).alias("date"))
    size = graph.mean_out_degree_with_undated(dated, inputs.static_star(spark, sf), months, tasks=2 * inputs.star_tasks(spark, sf))
    return size.withColumn("date", F.col("date").cast("string"))


@query("graph_statistics_by_validity", _STATS_SQL)
def graph_statistics_by_validity(spark, sf):
    """The same statistics, with every triple stored once and its days of validity beside it."""
    dated = inputs.dated_star(spark, sf).withColumns({"first": F.col("date"), "last": F.col("date")}).drop("date")
    undated = {"first": F.lit(None).cast("date"), "last": F.lit(None).cast("date")}
    both = dated.unionByName(inputs.static_star(spark, sf).withColumns(undated))
    size = graph.graph_size_of_intervals(both, tasks=2 * inputs.star_tasks(spark, sf))
    return size.withColumn("date", F.col("date").cast("string"))


@query(
    "node_out_degree",
    f"""WITH {inputs.EDGES_SQL}, ends AS (
      SELECT subject AS node, 1 AS e FROM edges UNION ALL SELECT object, 0 FROM edges)
    SELECT node, CAST(sum(e) AS BIGINT) AS out_degree FROM ends GROUP BY node""",
)
def node_out_degree(spark, sf):
    return graph.out_degree(inputs.all_edges(spark, sf), [])


@query(
    "normalize_legacy_edges",
    f"""WITH {inputs.DATED_SQL} SELECT subject, predicate, object, subject AS "ID" FROM dated""",
)
def normalize_legacy_edges(spark, sf):
    legacy = inputs.dated_star(spark, sf).select(
        F.col("subject").alias("from"), F.col("object").alias("to"), F.col("predicate").alias("description"),
        F.col("subject").alias("ID"),
    )
    return triples.normalize_triples(legacy)


_TAGS_SQL = """
WITH tags AS (
  SELECT event_id, 'event_type' AS key, event_type AS value, CAST(ts AS DATE) AS date FROM events
  UNION ALL SELECT event_id, 'k', json_extract_string(props, '$.k'), CAST(ts AS DATE) FROM events),
flagged AS (SELECT *, key = 'event_type' AND value IN ('purchase', 'signup') AS main FROM tags)
SELECT 'node/' || event_id AS subject, 'rdf:type' AS predicate, value AS object, CAST(date AS VARCHAR) AS date FROM flagged WHERE main
UNION ALL SELECT value, 'rdfs:subClassOf', key, CAST(date AS VARCHAR) FROM flagged WHERE main
UNION ALL SELECT 'node/' || event_id, key, value, CAST(date AS VARCHAR) FROM flagged WHERE NOT main"""


def event_features(spark, sf):
    """Events as features; the tag map holds the event type and the JSON properties."""
    e = load(spark, sf, "events")
    return e.select(
        F.concat(F.lit("node/"), "event_id").alias("osm_id"),
        F.map_concat(F.create_map(F.lit("event_type"), "event_type"), F.from_json("props", "map<string,string>")).alias("all_tags"),
        F.col("ts").cast("date").alias("date"),
    )


def main_tags(spark, sf):
    """Tag dimension taken from the event types, with a duplicate row that must not fan out."""
    kinds = load(spark, sf, "events").where(F.col("event_type").isin("purchase", "signup"))
    return kinds.select(F.lit("event_type").alias("Key"), F.col("event_type").alias("Value"), F.lit("").alias("Description"))


@query("tag_triples", _TAGS_SQL)
def tag_triples(spark, sf):
    out = triples.tag_triples(event_features(spark, sf), main_tags(spark, sf))
    return out.withColumn("date", F.col("date").cast("string"))


@query(
    "flag_main_tags",
    """WITH tags AS (
      SELECT event_id, 'event_type' AS key, event_type AS value FROM events
      UNION ALL SELECT event_id, 'k', json_extract_string(props, '$.k') FROM events)
    SELECT key, value, CAST(key = 'event_type' AND value IN ('purchase', 'signup') AS INTEGER) AS main, count(*) AS n
    FROM tags GROUP BY ALL""",
)
def flag_main_tags(spark, sf):
    rows = triples.flag_main_tags(triples.explode_tags(event_features(spark, sf)), main_tags(spark, sf))
    return rows.groupBy("key", "value", F.col("transform").cast("int").alias("main")).agg(F.count("*").alias("n"))


@query(
    "clean_tags",
    """SELECT event_id AS osm_id, event_type AS note_free FROM events
    WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) % 2 = 0""",
)
def clean_tags(spark, sf):
    """Tags with housekeeping keys: odd events carry nothing else and disappear."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = load(spark, sf, "events").select(
        F.col("event_id").alias("osm_id"),
        F.when(k % 2 == 0, F.create_map(F.lit("kind"), F.col("event_type"), F.lit("note"), F.col("props"))).otherwise(
            F.create_map(F.lit("source"), F.col("event_type"), F.lit("fixme"), F.col("props"))
        ).alias("all_tags"),
    )
    kept = triples.clean_tags(e)
    return kept.select("osm_id", F.when(F.size("all_tags") == 1, F.col("all_tags")["kind"]).alias("note_free"))


@query(
    "min_tags",
    "SELECT event_id AS osm_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) % 3 <> 0",
)
def min_tags(spark, sf):
    f = event_features(spark, sf)
    thin = F.when(
        F.col("all_tags")["k"].cast("int") % 3 == 0, F.map_filter("all_tags", lambda k, _: k == "k")
    ).otherwise(F.col("all_tags"))
    kept = triples.min_tags(f.withColumn("all_tags", thin))
    return kept.select(F.split_part("osm_id", F.lit("/"), F.lit(2)).cast("bigint").alias("osm_id"))


@query(
    "widen_tags",
    "SELECT 'node/' || event_id AS osm_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, event_type, json_extract_string(props, '$.k') AS k FROM events",
)
def widen_tags(spark, sf):
    return triples.widen_tags(event_features(spark, sf)).withColumn("date", F.col("date").cast("string"))


@query(
    "normalize_tag_table",
    """SELECT n_name AS "Key", trim(v) AS "Value", 'd' || n_regionkey AS "Description", count(*) AS n
    FROM (SELECT n_name, n_regionkey, unnest([c_mktsegment, c_name]) AS v FROM customer JOIN nation ON c_nationkey = n_nationkey)
    GROUP BY ALL""",
)
def normalize_tag_table(spark, sf):
    """Tag rows written as ``key=a / b`` come apart into one row per value."""
    c = load(spark, sf, "customer").join(load(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    scraped = c.select(
        F.concat("n_name", F.lit("="), "c_mktsegment", F.lit(" / "), "c_name").alias("Value"),
        F.concat(F.lit("d"), "n_regionkey").alias("Comment"),
    )
    return triples.normalize_tag_table(scraped).groupBy("Key", "Value", "Description").agg(F.count("*").alias("n"))


@query(
    "dated_slices",
    f"""WITH {inputs.STATIC_SQL},
    m AS (SELECT CAST(unnest(generate_series(TIMESTAMP '1996-01-01', TIMESTAMP '1997-06-01', INTERVAL 1 MONTH)) AS DATE) AS date),
    t AS (SELECT subject, predicate, object, CAST(NULL AS DATE) AS d FROM static_edges
      UNION ALL SELECT 'order/' || o_orderkey, 'orderedOn', 'seen ' || strftime(o_orderdate, '%Y-%m-%d') || ' here',
        CAST(date_trunc('month', o_orderdate) AS DATE) FROM orders)
    SELECT subject, predicate, object, CAST(m.date AS VARCHAR) AS date FROM t JOIN m ON t.d IS NULL OR t.d = m.date""",
)
def dated_slices(spark, sf):
    seen = load(spark, sf, "orders").select(
        F.concat(F.lit("order/"), "o_orderkey").alias("subject"),
        F.lit("orderedOn").alias("predicate"),
        F.concat(F.lit("seen "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" here")).alias("object"),
    )
    both = inputs.static_star(spark, sf).unionByName(seen)
    return triples.slice_by_month(both, "1996-01-01", "1997-06-01").withColumn("date", F.col("date").cast("string"))


@query(
    "bindings_to_triples",
    """SELECT 'order/' || o_orderkey AS subject, 'hasStatus' AS predicate, o_orderstatus AS object, 'cell.' || o_custkey AS "ID" FROM orders
    UNION ALL SELECT 'order/' || o_orderkey, 'hasPriority', o_orderpriority, 'cell.' || o_custkey FROM orders""",
)
def bindings_to_triples(spark, sf):
    def term(v):
        return F.struct(F.lit("literal").alias("type"), v.alias("value"))

    def row(p, o):
        s = F.concat(F.lit("order/"), F.col("o_orderkey"))
        return F.struct(term(s).alias("s"), term(F.lit(p)).alias("p"), term(F.col(o)).alias("o"))

    answers = load(spark, sf, "orders").select(
        F.col("o_custkey").alias("cell"),
        F.to_json(
            F.struct(
                F.struct(F.array(F.lit("s"), F.lit("p"), F.lit("o")).alias("vars")).alias("head"),
                F.struct(F.array(row("hasStatus", "o_orderstatus"), row("hasPriority", "o_orderpriority")).alias("bindings")).alias("results"),
            )
        ).alias("body"),
    )
    return triples.bindings_to_triples(answers, prefix="cell.")


@query(
    "star_pattern",
    f"""WITH {inputs.STAR_SQL},
    ids AS (SELECT 'customer/' || c_custkey AS object FROM customer WHERE c_mktsegment = 'BUILDING'),
    subjects AS (SELECT DISTINCT subject FROM star JOIN ids USING (object) WHERE predicate = 'placedBy')
    SELECT star.subject, predicate, star.object, CAST(date AS VARCHAR) AS date FROM star JOIN subjects USING (subject)""",
)
def star_pattern(spark, sf):
    ids = load(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("customer/"), "c_custkey").alias("id"))
    # undated triples are matched once, and only what is found of them is repeated per date
    dated, undated = inputs.dated_star(spark, sf), inputs.static_star(spark, sf).withColumn("date", F.lit(None).cast("date"))
    found = triples.star_pattern(dated.withColumn("always", F.lit(False)).unionByName(undated.withColumn("always", F.lit(True))), "placedBy", ids)
    months = load(spark, sf, "orders").select(month_start(F.col("o_orderdate")).alias("date"))
    repeated = triples.replicate_dates(found.where("always").drop("date"), months)
    out = found.where("NOT always").unionByName(repeated)
    return out.select("subject", "predicate", "object", F.col("date").cast("string").alias("date"))


@query(
    "inverse_triples",
    f"""WITH {inputs.EDGES_SQL} SELECT subject, predicate, object FROM edges
    UNION ALL SELECT object, predicate || '_inverse', subject FROM edges""",
)
def inverse_triples(spark, sf):
    return triples.inverse_triples(inputs.all_edges(spark, sf))


@query(
    "distinct_triples",
    """SELECT DISTINCT 'part/' || l_partkey AS subject, 'soldBy' AS predicate, 'supplier/' || l_suppkey AS object FROM lineitem""",
)
def distinct_triples(spark, sf):
    t = load(spark, sf, "lineitem").select(
        F.concat(F.lit("part/"), "l_partkey").alias("subject"), F.lit("soldBy").alias("predicate"),
        F.concat(F.lit("supplier/"), "l_suppkey").alias("object"),
    )
    return triples.distinct_triples(t)


@query(
    "distinct_dates", "SELECT DISTINCT CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS VARCHAR) AS date FROM orders"
)
def distinct_dates(spark, sf):
    return triples.distinct_dates(inputs.dated_star(spark, sf)).select(F.col("date").cast("string").alias("date"))


# -- walks ------------------------------------------------------------------------------------------------------

_BFS_SQL = f"""{inputs.EDGES_SQL},
e AS (SELECT DISTINCT subject, predicate, object FROM edges),
d0 AS (SELECT DISTINCT subject AS root, subject AS node FROM edges),
d1 AS (SELECT root, object AS node, min([predicate, object]) AS path FROM d0 JOIN e ON node = subject
       WHERE object <> root GROUP BY 1, 2),
r1 AS (SELECT root, node FROM d0 UNION ALL SELECT root, node FROM d1),
c2 AS (SELECT d1.root, e.object AS node, min(path) AS path FROM d1 JOIN e ON d1.node = e.subject GROUP BY 1, 2),
d2 AS (SELECT c2.* FROM c2 ANTI JOIN r1 ON c2.root = r1.root AND c2.node = r1.node),
r2 AS (SELECT * FROM r1 UNION ALL SELECT root, node FROM d2),
c3 AS (SELECT d2.root, e.object AS node, min(path) AS path FROM d2 JOIN e ON d2.node = e.subject GROUP BY 1, 2),
d3 AS (SELECT c3.* FROM c3 ANTI JOIN r2 ON c3.root = r2.root AND c3.node = r2.node),
paths AS (
  SELECT root, node, 0 AS depth, CAST([] AS VARCHAR[]) AS path FROM d0
  UNION ALL SELECT root, node, 1, path FROM d1
  UNION ALL SELECT root, node, 2, path FROM d2
  UNION ALL SELECT root, node, 3, path FROM d3)"""


def star_paths(spark, sf, mode="first_hop"):
    edges = cut_lineage(inputs.all_edges(spark, sf))
    return graph.bfs_paths(edges, None, 3, mode)


@query(
    "bfs_paths",
    f"WITH {_BFS_SQL} SELECT root, node, depth, array_to_string(path, ' ') AS path FROM paths",
)
def bfs_paths(spark, sf):
    return star_paths(spark, sf).withColumn("path", F.array_join("path", " "))


_HUB_SQL = f"""WITH {inputs.STATIC_SQL},
e AS (SELECT object AS s, predicate || '_inverse' AS p, subject AS o FROM static_edges),
d1 AS (SELECT 'region/' || r_regionkey AS root, o AS node, 1 AS depth, [p, o] AS path FROM region JOIN e ON s = 'region/' || r_regionkey),
d2 AS (SELECT root, o AS node, 2 AS depth, list_concat(path, [p, o]) AS path FROM d1 JOIN e ON s = node)
SELECT root, node, depth, array_to_string(list_concat([root], path), ' ') AS walk FROM (SELECT * FROM d1 UNION ALL SELECT * FROM d2)"""


@query("full_walks_from_hubs", _HUB_SQL)
def full_walks_from_hubs(spark, sf):
    """Walks against edge direction: a handful of roots reach every customer."""
    back = triples.inverse_triples(inputs.static_star(spark, sf)).where(F.col("predicate").endswith("_inverse"))
    roots = load(spark, sf, "region").select(F.concat(F.lit("region/"), "r_regionkey").alias("root"))
    paths = graph.bfs_paths(back, roots, 2, "full").where("depth > 0")
    return graph.walks(paths, "full").select("root", "node", "depth", F.array_join("walk", " ").alias("walk"))


@query(
    "walks_sample",
    f"""WITH {_BFS_SQL}
    SELECT root, node, CASE WHEN len(path) = 0 THEN '' ELSE array_to_string(list_concat([root], path[1:2]), ' ') END AS walk
    FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY md5('15|' || root || '|' || node), node) AS rn FROM paths)
    WHERE rn <= 3""",
)
def walks_sample(spark, sf):
    drawn = graph.sample_per_root(star_paths(spark, sf), 3)
    return graph.walks(drawn).select("root", "node", F.array_join("walk", " ").alias("walk"))


def _reach_sql(depth: int, k: int) -> str:
    """Exhaustive search over the distinct edges ``e``, then the k lowest hashes per root."""
    steps = [
        "n0 AS (SELECT DISTINCT subject AS root FROM e)",
        "d1 AS (SELECT subject AS root, object AS node, min([predicate, object]) AS path FROM e WHERE object <> subject GROUP BY 1, 2)",
        "r1 AS (SELECT root, root AS node FROM n0 UNION ALL SELECT root, node FROM d1)",
    ]
    for i in range(2, depth + 1):
        steps += [
            f"c{i} AS (SELECT d.root, e.object AS node, min(path) AS path FROM d{i - 1} d JOIN e ON d.node = e.subject GROUP BY 1, 2)",
            f"d{i} AS (SELECT c.* FROM c{i} c ANTI JOIN r{i - 1} r ON c.root = r.root AND c.node = r.node)",
            f"r{i} AS (SELECT * FROM r{i - 1} UNION ALL SELECT root, node FROM d{i})",
        ]
    found = " UNION ALL ".join(
        ["SELECT root, root AS node, 0 AS depth, CAST([] AS VARCHAR[]) AS path FROM n0"]
        + [f"SELECT root, node, {i}, path FROM d{i}" for i in range(1, depth + 1)]
    )
    return f"""{", ".join(steps)}, reach AS ({found})
    SELECT root, node, depth, CASE WHEN len(path) = 0 THEN '' ELSE array_to_string(list_concat([root], path), ' ') END AS walk
    FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY md5('15|' || node), node) AS rn FROM reach) WHERE rn <= {k}"""


# Depth of the walks and walks per root.
WALK_DEPTH, WALKS_PER_ROOT = 4, 500


def _sampled_walks(edges):
    edges = cut_lineage(edges)
    reach = graph.sampled_reach(edges, None, WALK_DEPTH, WALKS_PER_ROOT)
    return graph.walks(reach).select("root", "node", "depth", F.array_join("walk", " ").alias("walk"))


@query(
    "walks_whole",
    f"WITH {inputs.EDGES_SQL}, e AS (SELECT DISTINCT subject, predicate, object FROM edges), {_reach_sql(WALK_DEPTH, WALKS_PER_ROOT)}",
)
def walks_whole(spark, sf):
    """Walks of all roots at full depth and number."""
    return _sampled_walks(inputs.all_edges(spark, sf))


@query(
    "walks_whole_from_hubs",
    f"""WITH {inputs.EDGES_SQL},
    e AS (SELECT DISTINCT object AS subject, predicate || '_inverse' AS predicate, subject AS object FROM edges), {_reach_sql(WALK_DEPTH, WALKS_PER_ROOT)}""",
)
def walks_whole_from_hubs(spark, sf):
    """The same against edge direction, where nations and regions reach far more nodes than they keep."""
    back = triples.inverse_triples(inputs.all_edges(spark, sf)).where(F.col("predicate").endswith("_inverse"))
    return _sampled_walks(back)


@query(
    "walk_roots",
    f"""WITH {inputs.EDGES_SQL}, nodes AS (SELECT subject AS n FROM edges UNION SELECT object FROM edges)
    SELECT DISTINCT 'customer/' || (o_custkey * 2) AS root FROM orders
    WHERE 'customer/' || (o_custkey * 2) IN (SELECT n FROM nodes)""",
)
def walk_roots(spark, sf):
    """Roots given by a grid table, half of them absent from the graph."""
    grid = load(spark, sf, "orders").select(F.concat(F.lit("customer/"), (F.col("o_custkey") * 2).cast("string")).alias("cell_id"))
    return graph.walk_roots(inputs.all_edges(spark, sf), grid)


@query(
    "drop_repeats",
    """SELECT o_custkey, array_to_string(list_transform(list_filter(list_zip(l, list_concat([NULL], l[:-2])), lambda z: z[1] IS DISTINCT FROM z[2]), lambda z: z[1]), '') AS statuses
    FROM (SELECT o_custkey, list(o_orderstatus ORDER BY o_orderdate, o_orderkey) AS l FROM orders GROUP BY 1)""",
)
def drop_repeats(spark, sf):
    from cellweave.functions.geo import drop_repeats as tidy

    o = load(spark, sf, "orders").groupBy("o_custkey").agg(
        F.sort_array(F.collect_list(F.struct("o_orderdate", "o_orderkey", "o_orderstatus"))).alias("l")
    )
    return o.select("o_custkey", F.array_join(tidy(F.transform("l", lambda z: z["o_orderstatus"])), "").alias("statuses"))
