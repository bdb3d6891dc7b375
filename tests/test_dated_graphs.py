"""Dated graphs with undated triples: the same results as with a copy per date, and none of the copies."""

from pyspark.sql import functions as F

from cellweave.operators import graph, scale, triples
from cellweave.plans import inputs


def _rows(df):
    return sorted(map(str, df.collect()))


def test_undated_triples_count_on_every_date(spark):
    dated = spark.createDataFrame(
        [("a", "p", "b", "2020-01-01"), ("a", "p", "b", "2020-02-01"), ("c", "p", "x", "2020-02-01"), (None, "p", "x", "2020-02-01"),
         ("a", "p", "x", None), ("b", "p", "y", "2019-01-01")], "subject string, predicate string, object string, date string",
    ).withColumn("date", F.col("date").cast("date"))
    undated = spark.createDataFrame([("x", "p", "y"), ("x", "q", "y"), ("b", "p", None)], "subject string, predicate string, object string")
    days = spark.createDataFrame([("2020-01-01",), ("2020-02-01",), ("2020-02-01",), ("2020-03-01",), (None,)], "date string").select(F.col("date").cast("date"))
    whole = graph.mean_out_degree(triples.union_triples(dated, triples.replicate_dates(undated, days)))
    got = graph.mean_out_degree_with_undated(dated, undated, days)
    assert _rows(got.select(*whole.columns)) == _rows(whole)


def test_dated_edges_are_dealt_by_their_number(spark, sf_dir, monkeypatch):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    monkeypatch.setattr(scale.tasks_for, "__defaults__", (-(-lines // 40),))
    edges = inputs.dated_star(spark, sf_dir)
    sizes = edges.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(sizes) > 30


def test_undated_triples_are_matched_once(spark, sf_dir):
    import __spark_entry__ as entry

    ids = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("customer/"), "c_custkey").alias("id"))
    got = entry.queries()["star_pattern"](spark, sf_dir)
    whole = triples.star_pattern(inputs.star_kg(spark, sf_dir), "placedBy", ids)
    assert sorted(map(tuple, whole.groupBy("predicate").count().collect())) == sorted(map(tuple, got.groupBy("predicate").count().collect()))
