"""Ontology-mapped triples of tagged point features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.functions import text as tx
from cellweave.operators.scale import tasks_for
from cellweave.operators.triples import TRIPLE, _emit, min_tags, triple

#: Features that one task unfolds on average.
FEATURES_PER_TASK = 50_000

# Namespaces of the generated graph.
RESOURCE = "http://www.worldkg.org/resource/"
SCHEMA = "http://www.worldkg.org/schema/"
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
RDFS_LABEL = "http://www.w3.org/2000/01/rdf-schema#label"
SF_POINT = "http://www.opengis.net/ont/sf#Point"
AS_WKT = "http://www.opengis.net/ont/geosparql#asWKT"
NODE_PAGE = "https://www.openstreetmap.org/node/"


def _one(s: Column, p: Column | str, o: Column) -> Column:
    return F.array(triple(s, p, o))


def ontology_triples(features: DataFrame, ontology: DataFrame, key_list: DataFrame) -> DataFrame:
    """Set of mapped triples for features (osm_id, lon, lat, all_tags) with at least two tags.

    A key of the ontology yields a class type when its value is listed, and a flag type when the value is
    ``Yes``; other keys become a link, a label, an outside reference, or an attribute when allow-listed. Both
    dimensions join by key; each is de-duplicated first, so features never fan out.

    A feature unfolds to many long triples. Features are dealt into partitions of bounded size before that, and so are
    the triples before they become a set: no task holds more of them as the table grows.
    """
    tasks = tasks_for(features, FEATURES_PER_TASK)
    nodes = min_tags(features).select("osm_id", "lon", "lat", "all_tags").repartition(tasks, "osm_id")
    s = tx.iri(RESOURCE, F.col("osm_id"))
    geo_node = tx.iri(RESOURCE + "geo", F.col("osm_id"))
    wkt = F.concat(F.lit("Point("), F.col("lon").cast("string"), F.lit(" "), F.col("lat").cast("string"), F.lit(")"))
    fixed = _emit(
        nodes,
        F.array(
            triple(s, SCHEMA + "spatialObject", geo_node),
            triple(geo_node, RDF_TYPE, F.lit(SF_POINT)),
            triple(geo_node, AS_WKT, wkt),
            triple(s, SCHEMA + "osmLink", tx.iri(NODE_PAGE, F.col("osm_id"))),
        ),
        None,
    )
    tags = nodes.select("osm_id", F.explode("all_tags").alias("key", "value")).select(
        "osm_id", tx.squeeze_key(F.col("key")).alias("key"), tx.escape_literal(F.col("value")).alias("value")
    )
    classes = ontology.groupBy("key", "value").agg(F.min("appendedClass").alias("cls"))
    known = ontology.select("key").distinct().withColumn("known", F.lit(True))
    allowed = key_list.select("key").distinct().withColumn("allowed", F.lit(True))
    rows = tags.join(classes, ["key", "value"], "left").join(known, "key", "left").join(allowed, "key", "left")
    key, value = F.col("key"), F.col("value")
    none = F.array().cast("array<struct<subject:string,predicate:string,object:string>>")
    mapped = F.concat(
        F.when(F.col("cls").isNotNull(), _one(s, RDF_TYPE, tx.iri(SCHEMA, F.col("cls")))).otherwise(none),
        F.when(value == "Yes", _one(s, RDF_TYPE, tx.iri(SCHEMA, tx.camel_class(key)))).otherwise(none),
    )
    free = (
        F.when(key == "osmLink", _one(s, SCHEMA + "osmLink", tx.iri(NODE_PAGE, value)))
        .when(key == "name", _one(s, RDFS_LABEL, value))
        .when(key == "wikidata", _one(s, SCHEMA + "wikidata", tx.wikidata_object(value)))
        .when(key == "wikipedia", _one(s, SCHEMA + "wikipedia", tx.wikipedia_url(value)))
        .when(F.col("allowed"), _one(s, tx.iri(SCHEMA, tx.camel_key(key)), value))
        .otherwise(none)
    )
    made = rows.select(F.explode_outer(F.when(F.col("known"), mapped).otherwise(free)).alias("t"))
    return fixed.unionByName(made.where("t IS NOT NULL").select("t.*")).repartition(tasks, *TRIPLE).distinct()


def collect_values(df: DataFrame, key: str, value: str) -> DataFrame:
    """Distinct values per key as rows (key, position, value), in order: a key with very many values is no large row."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(value)).alias("position")
    return df.select(key, value).distinct().select(key, place, value)
