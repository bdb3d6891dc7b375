"""Triple tables: normalising, tag triples, geometry triples, unions, dates and slices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.functions.dates import date_in_text, month_sequence
from cellweave.functions.geo import to_wkt
from cellweave.functions.text import json_to_map

TRIPLE = ["subject", "predicate", "object"]

# Housekeeping tag keys dropped for fetched features and for file features.
IGNORED_KEYS_API = ["created_by", "converted_by", "source", "time", "ele", "attribution"]
IGNORED_KEYS_FILE = ["created_by", "converted_by", "source", "time", "ele", "note", "todo", "openGeoDB:", "fixme", "FIXME"]


def triple(s: Column, p: Column | str, o: Column) -> Column:
    p = F.lit(p) if isinstance(p, str) else p
    return F.struct(
        s.cast("string").alias("subject"), p.cast("string").alias("predicate"), o.cast("string").alias("object")
    )


def _emit(df: DataFrame, triples: Column, date: str | None = "date") -> DataFrame:
    """Explode an array of triples, keeping the date column when there is one."""
    keep = [F.col(date).alias("date")] if date else []
    return df.select(F.explode_outer(triples).alias("_t"), *keep).select("_t.*", *(["date"] if date else []))


# -- normal forms -------------------------------------------------------------------------------------------


def normalize_triples(df: DataFrame) -> DataFrame:
    """Subject, predicate, object as text, from either naming; anchor and date columns are kept."""
    names = {"from": "subject", "description": "predicate", "to": "object"}
    if "subject" not in df.columns:
        df = df.withColumnsRenamed(names)
    extra = [c for c in ("ID", "date", "DATE") if c in df.columns]
    kept = [F.col(c).cast("string").alias(c) if c == "ID" else F.col(c).alias("date") for c in extra]
    return df.select(*[F.col(c).cast("string").alias(c) for c in TRIPLE], *kept)


def union_triples(*dfs: DataFrame) -> DataFrame:
    """Bag union by column name; dates become date typed once."""
    aligned = [d.withColumn("date", F.col("date").cast("date")) if "date" in d.columns else d for d in dfs]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), aligned)


def distinct_triples(df: DataFrame) -> DataFrame:
    return df.distinct()


def inverse_triples(df: DataFrame, suffix: str = "_inverse") -> DataFrame:
    """The triples and, for each, the triple in the other direction."""
    rest = [c for c in df.columns if c not in TRIPLE]
    both = F.array(
        triple(F.col("subject"), F.col("predicate"), F.col("object")),
        triple(F.col("object"), F.concat("predicate", F.lit(suffix)), F.col("subject")),
    )
    return df.select(F.explode(both).alias("_t"), *rest).select("_t.*", *rest)


# -- tags -----------------------------------------------------------------------------------------------------


def explode_tags(df: DataFrame, col: str = "all_tags", keep: tuple[str, ...] = ("osm_id", "date")) -> DataFrame:
    """One row per tag from a map column or its JSON text."""
    tags = F.col(col) if df.schema[col].dataType.typeName() == "map" else json_to_map(F.col(col))
    return df.select(*keep, F.explode(tags).alias("key", "value"))


def clean_tags(df: DataFrame, ignore_keys: list[str] = IGNORED_KEYS_FILE, col: str = "all_tags") -> DataFrame:
    """Drop housekeeping keys, then features that have no tag left."""
    drop = F.array(*map(F.lit, ignore_keys))
    kept = df.withColumn(col, F.map_filter(col, lambda k, _: ~F.array_contains(drop, k)))
    return kept.where(F.size(col) > 0)


def min_tags(df: DataFrame, n: int = 2, col: str = "all_tags") -> DataFrame:
    return df.where(F.size(col) >= n)


def widen_tags(df: DataFrame, keys: list[str] | None = None, col: str = "all_tags") -> DataFrame:
    """One column per tag key next to the other columns; without ``keys`` every key becomes a column."""
    if keys is None:
        found = df.select(F.explode(F.map_keys(col)).alias("k")).distinct().orderBy("k").collect()
        keys = [r["k"] for r in found]
    rest = [c for c in df.columns if c != col]
    return df.select(*rest, *[F.try_element_at(col, F.lit(k)).alias(k) for k in keys])


def normalize_tag_table(df: DataFrame) -> DataFrame:
    """Scraped tag tables to (Key, Value, Description): split ``key=value`` and ``a / b``, drop nulls."""
    if "Comment" in df.columns:
        df = df.withColumnRenamed("Comment", "Description")
    if "Key" not in df.columns:
        pair = F.split("Value", "=", 2)
        df = df.withColumn("Key", pair[0]).withColumn("Value", F.get(pair, F.lit(1)))
    return df.select("Key", F.explode_outer(F.split("Value", " / ")).alias("Value"), "Description").na.drop()


def flag_main_tags(tags: DataFrame, main_tags: DataFrame) -> DataFrame:
    """Mark each tag row with whether (key, value) is a main tag.

    The dimension is de-duplicated; Spark broadcasts it when its size allows and sort-merges otherwise.
    """
    dim = main_tags.toDF(*[c.lower() for c in main_tags.columns]).select("key", "value").distinct()
    return tags.join(dim.withColumn("transform", F.lit(True)), ["key", "value"], "left").withColumn(
        "transform", F.coalesce("transform", F.lit(False))
    )


def tag_triples(features: DataFrame, main_tags: DataFrame, distinct: bool = False) -> DataFrame:
    """Main tags become a type and a subclass edge, other tags an attribute edge."""
    rows = flag_main_tags(explode_tags(features), main_tags)
    main = F.array(
        triple(F.col("osm_id"), "rdf:type", F.col("value")),
        triple(F.col("value"), "rdfs:subClassOf", F.col("key")),
    )
    other = F.array(triple(F.col("osm_id"), F.col("key"), F.col("value")))
    out = _emit(rows, F.when(F.col("transform"), main).otherwise(other))
    return out.distinct() if distinct else out


def geometry_triples(df: DataFrame, id_col: str = "osm_id", prefix: str = "geo", date: str | None = "date") -> DataFrame:
    """Link to a geometry node, and that node's well-known text."""
    node = F.concat(F.lit(prefix), F.col(id_col).cast("string"))
    rows = F.array(
        triple(F.col(id_col), "geo:hasGeometry", node), triple(node, "geo:asWKT", to_wkt(F.col("geom")))
    )
    return _emit(df, rows, date)


# -- dates ----------------------------------------------------------------------------------------------------


def distinct_dates(df: DataFrame, col: str = "date") -> DataFrame:
    return df.select(F.col(col).alias("date")).distinct()


def replicate_dates(df: DataFrame, dates: DataFrame) -> DataFrame:
    """Every undated row once per date. The calendar (days of the graph) is one array value, not a joined table."""
    calendar = dates.select("date").distinct().agg(F.sort_array(F.collect_set("date")).alias("d"))
    return df.withColumn("date", F.explode(calendar.scalar()))


def slice_by_month(triples: DataFrame, start: str, end: str) -> DataFrame:
    """Undated triples in every month of the range, dated ones (date found in the object) only in theirs."""
    lo, hi = F.to_date(F.lit(start)), F.to_date(F.lit(end))
    d = date_in_text(F.col("object"))
    months = month_sequence(F.trunc(lo, "MM"), hi)
    wanted = F.filter(months, lambda m: m >= lo)
    return (
        triples.withColumn("_d", d)
        .withColumn("_m", F.when(F.col("_d").isNull(), wanted).otherwise(F.filter(wanted, lambda m: m == F.col("_d"))))
        .withColumn("date", F.explode_outer("_m"))
        .where("date IS NOT NULL")
        .drop("_d", "_m")
    )


# -- stored query results ---------------------------------------------------------------------------------------

_TERM = "struct<value:string>"
_BINDINGS = f"struct<results:struct<bindings:array<struct<s:{_TERM},p:{_TERM},o:{_TERM}>>>>"


def bindings_to_triples(df: DataFrame, body: str = "body", anchor: str = "cell", prefix: str = "") -> DataFrame:
    """Stored endpoint answers (JSON text) to triples anchored at the cell they were fetched for."""
    rows = df.select(F.concat(F.lit(prefix), F.col(anchor).cast("string")).alias("ID"), F.from_json(body, _BINDINGS).alias("j"))
    rows = rows.select("ID", F.explode("j.results.bindings").alias("b"))
    return rows.select(
        F.col("b.s.value").alias("subject"), F.col("b.p.value").alias("predicate"), F.col("b.o.value").alias("object"), "ID"
    )


def star_pattern(triples: DataFrame, id_predicate: str, ids: DataFrame) -> DataFrame:
    """All triples of the subjects that carry one of the ids.

    The subjects found are hashed per partition and the triples pass by them, so no task sorts its triples.
    """
    subjects = (
        triples.where(F.col("predicate") == id_predicate)
        .join(ids.select(F.col(ids.columns[0]).alias("object")).distinct(), "object", "left_semi")
        .select("subject")
        .distinct()
    )
    return triples.join(subjects.hint("shuffle_hash"), "subject", "left_semi")
