"""Steps whose work or memory must not gather in one task as tables grow."""

import pytest
from pyspark.sql import functions as F

from cellweave.functions import geo
from cellweave.operators import grid, kge, metrics, modelling, ontology, panel, scale, spatial


def test_candidate_pairs_of_one_file_are_dealt(spark, tmp_path):
    spark.range(200).coalesce(1).write.parquet(str(tmp_path / "one"))
    x, y = F.col("id") % 20, F.floor(F.col("id") / 20)
    features = spark.read.parquet(str(tmp_path / "one")).select("id", geo.box(x - 9, y - 9, x + 9, y + 9).alias("geom"))
    cells = grid.with_cell(features.select(x.alias("lon"), y.alias("lat")), 2).select("cell_id").distinct()
    pairs = spatial.spatial_candidates(features, grid.cells_from_ids(cells, res=2))
    assert features.rdd.getNumPartitions() == 1
    rows = pairs.groupBy(F.spark_partition_id()).count().collect()
    assert len(rows) > 4
    assert max(r["count"] for r in rows) < 0.5 * sum(r["count"] for r in rows)


def test_later_rounds_of_class_breaks_read_fewer_values(spark, monkeypatch):
    df = spark.range(20_000).select((F.pmod(F.xxhash64("id"), F.lit(1_000_000)) / 100).alias("v"))
    whole = panel.natural_breaks(df, "v", 4, cells=100_000)
    read, split = [], panel._split_steps
    monkeypatch.setattr(panel, "_split_steps", lambda v, *rest: read.append(v.count()) or split(v, *rest))
    assert panel.natural_breaks(df, "v", 4, cells=64) == pytest.approx(whole)
    assert read[0] == 20_000 and read[-1] < 5_000


def test_mapped_triples_are_made_in_bounded_partitions(spark, monkeypatch):
    monkeypatch.setattr(ontology, "FEATURES_PER_TASK", 10, raising=False)
    tags = F.create_map(F.lit("name"), F.col("id").cast("string"), F.lit("kind"), F.lit("Yes"))
    features = spark.range(400).coalesce(1).select(F.col("id").alias("osm_id"), F.col("id").alias("lon"), F.col("id").alias("lat"), tags.alias("all_tags"))
    onto = spark.createDataFrame([("kind", "a", "A"), ("kind", "a", "B")], "key string, value string, appendedClass string")
    keys = spark.createDataFrame([("none",)], "key string")
    out = ontology.ontology_triples(features.unionByName(features), onto, keys)
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 6 * 400 and len(sizes) > 60 and max(sizes) < 200


def test_ranked_partitions_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(scale, "TASK_ROWS", 50)
    df = spark.range(2_000).select(F.pmod(F.xxhash64("id"), F.lit(1_000)).alias("a"), "id", F.col("id").cast("string").alias("label"))
    folds = metrics.time_folds(df, ["a", "id"], 4)
    assert folds.select(F.input_file_name()).distinct().count() > 30
    assert [r["count"] for r in folds.groupBy("fold").count().orderBy("fold").collect()] == [400] * 5
    index = scale.distinct_index(df.select("label").unionByName(df.select("label")), [F.col("label")])
    assert index.select(F.input_file_name()).distinct().count() > 30
    assert [r["id"] for r in index.orderBy("label").collect()] == list(range(2_000))


def test_triples_are_made_once_for_the_split_and_twice_for_the_ids(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(len(batch))
            yield batch

    rows = [(f"s{i % 70}", f"p{i % 3}", f"o{i}") for i in range(300)] + [(None, "p0", "o1")]
    df = spark.createDataFrame(rows, "subject string, predicate string, object string").mapInPandas(count, "subject string, predicate string, object string")
    kge.split_triples(df).groupBy("part").count().collect()
    assert made.value == len(rows)
    coded, entities, relations = kge.encode_triples(df)
    assert made.value <= 2 * len(rows)
    assert coded.count() == 300
    assert made.value <= 3 * len(rows)
    labels = sorted({r[0] for r in rows if r[0]} | {r[2] for r in rows})
    # null sorts first, as an entity without triples
    assert [(r["label"], r["id"]) for r in entities.orderBy("id").collect()] == [(None, 0), *[(n, i + 1) for i, n in enumerate(labels)]]
    assert [r["label"] for r in relations.orderBy("id").collect()] == ["p0", "p1", "p2"]


def test_training_rows_lie_in_bounded_blocks_and_are_scored_once(spark, monkeypatch):
    monkeypatch.setattr(scale, "TASK_ROWS", 100)
    seen = []
    fit = modelling.GBTRegressor.fit
    monkeypatch.setattr(modelling.GBTRegressor, "fit", lambda self, df: seen.append(df) or fit(self, df))
    df = spark.range(1_000).coalesce(1).select((F.col("id") % 7).alias("a"), (F.col("id") % 7 + F.col("id") % 3).cast("double").alias("y"))
    train, _ = modelling.preprocess(df, df, ["a"], [])
    model = modelling.fit_regressor(train, "y", maxIter=2, maxDepth=2)
    assert max(r["count"] for r in seen[0].groupBy(F.spark_partition_id()).count().collect()) <= 110
    scored = spark.sparkContext.accumulator(0)
    add = F.udf(lambda v: scored.add(1) or v, "double").asNondeterministic()
    pred = model.transform(train)
    out = modelling.evaluate(pred.withColumn("prediction", add("prediction")), "regression", "y").first()
    assert scored.value == 1_000
    assert out["mae"] == pytest.approx(metrics.regression_metrics(pred, "y", "prediction").first()["mae"])


def test_the_search_tries_all_trials_of_the_whole_ranges(spark, sf_dir, monkeypatch):
    from cellweave.plans import model_queries

    tried = []
    monkeypatch.setattr(modelling, "cv_score", lambda df, label, params, folds: tried.append((params, folds, df.rdd.getNumPartitions())) or 0.0)
    assert model_queries.param_search(spark, sf_dir).count() == 1
    assert len(tried) == 50 and {folds for _, folds, _ in tried} == {4} and {n for *_, n in tried} == {1}
    assert max(p["maxDepth"] for p, *_ in tried) > 20 and max(p["maxIter"] for p, *_ in tried) > 800
    assert all(p["minInfoGain"] > 0 for p, *_ in tried)
