"""Registered queries: vectors and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellweave.operators import graph, kge, triples, vectors
from cellweave.plans import inputs
from cellweave.plans.graph_queries import star_paths
from cellweave.plans.registry import load, query
from cellweave.session import cut_lineage

DIM = 64


def _vectors(spark, sf, cond):
    e = load(spark, sf, "embeddings").where(cond)
    return e.select(F.floor(F.col("vec_id") / 2).cast("string").alias("token"), F.col("embedding").cast("array<double>").alias("vector"))


@query("pca_compress")
def pca_compress(spark, sf):
    e = load(spark, sf, "embeddings").select(F.col("label").alias("ID"), F.col("embedding").alias("vector"))
    return vectors.pca_compress(e, "ID", DIM)


def _norm(col="vector"):
    return F.round(F.sqrt(F.aggregate(col, F.lit(0.0), lambda s, v: s + v * v)), 5)


_HALF_SQL = """SELECT CAST(CAST(floor(vec_id / 2) AS BIGINT) AS VARCHAR) AS token,
    round(sqrt(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE) * CAST(v AS DOUBLE)))), 5) AS norm FROM embeddings WHERE vec_id % 2 = 1"""


@query("procrustes_norms", _HALF_SQL)
def procrustes_norms(spark, sf):
    """A rotation keeps the length of every vector."""
    return procrustes_rotate(spark, sf).select("token", _norm().alias("norm"))


@query(
    "align_dates",
    """WITH d AS (SELECT CAST(CAST(floor(vec_id / 3) AS BIGINT) AS VARCHAR) AS token, vec_id % 3 AS k, embedding FROM embeddings)
    SELECT CAST(DATE '2016-09-01' + CAST(k AS INTEGER) AS VARCHAR) AS "DATE", token,
      round(sqrt(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE) * CAST(v AS DOUBLE)))), 5) AS norm FROM d""",
)
def align_dates(spark, sf):
    """Three dates, turned one onto the other: all tokens stay, with their length."""
    e = load(spark, sf, "embeddings")
    dated = e.select(
        F.floor(F.col("vec_id") / 3).cast("string").alias("token"), F.col("embedding").cast("array<double>").alias("vector"),
        F.date_add(F.to_date(F.lit("2016-09-01")), (F.col("vec_id") % 3).cast("int")).cast("string").alias("DATE"),
    )
    return vectors.align_by_date(dated, DIM).select("DATE", "token", _norm().alias("norm"))


@query(
    "align_dates_full",
    """SELECT CAST(DATE '2016-09-01' + CAST(vec_id % 3 AS INTEGER) AS VARCHAR) AS "DATE", count(*) AS n, count(DISTINCT floor(vec_id / 3)) AS tokens
    FROM embeddings GROUP BY 1""",
)
def align_dates_full(spark, sf):
    """With centring and scaling every date keeps its tokens too."""
    e = load(spark, sf, "embeddings")
    dated = e.select(
        F.floor(F.col("vec_id") / 3).cast("string").alias("token"), F.col("embedding").cast("array<double>").alias("vector"),
        F.date_add(F.to_date(F.lit("2016-09-01")), (F.col("vec_id") % 3).cast("int")).cast("string").alias("DATE"),
    )
    out = vectors.align_by_date(dated, DIM, "full").where(F.size("vector") == DIM)
    return out.groupBy("DATE").agg(F.count("*").alias("n"), F.count_distinct("token").alias("tokens"))


_DATED_ALL_SQL = """d AS (SELECT CAST(CAST(floor(vec_id / 3) AS BIGINT) + 5 * (vec_id % 3) AS VARCHAR) AS token,
      CAST(DATE '2016-09-01' + CAST(vec_id % 3 AS INTEGER) AS VARCHAR) AS "DATE", embedding FROM embeddings)"""


def dated_vectors(spark, sf):
    """Every vector under one of three dates. Tokens move by five from date to date, so each date has some of its own."""
    k = F.col("vec_id") % 3
    return load(spark, sf, "embeddings").select(
        (F.floor(F.col("vec_id") / 3) + 5 * k).cast("string").alias("token"), F.col("embedding").cast("array<double>").alias("vector"),
        F.date_add(F.to_date(F.lit("2016-09-01")), k.cast("int")).cast("string").alias("DATE"),
    )


@query(
    "align_dates_all",
    f"""WITH {_DATED_ALL_SQL} SELECT "DATE", token,
      round(sqrt(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE) * CAST(v AS DOUBLE)))), 5) AS norm FROM d""",
)
def align_dates_all(spark, sf):
    """All rows of the table under three dates with different tokens, turned one onto the other."""
    return vectors.align_by_date(dated_vectors(spark, sf), DIM).select("DATE", "token", _norm().alias("norm"))


@query("align_dates_full_all", f"""WITH {_DATED_ALL_SQL} SELECT "DATE", count(*) AS n, count(DISTINCT token) AS tokens FROM d GROUP BY 1""")
def align_dates_full_all(spark, sf):
    """The same rows with centring and scaling."""
    out = vectors.align_by_date(dated_vectors(spark, sf), DIM, "full").where(F.size("vector") == DIM)
    return out.groupBy("DATE").agg(F.count("*").alias("n"), F.count_distinct("token").alias("tokens"))


_DOT_SQL = """WITH a AS (SELECT CAST(floor(vec_id / 2) AS BIGINT) AS token, embedding AS x FROM embeddings WHERE vec_id % 2 = 0),
    b AS (SELECT CAST(floor(vec_id / 2) AS BIGINT) AS token, embedding AS y FROM embeddings WHERE vec_id % 2 = 1)"""


@query(
    "procrustes_gain",
    f"""{_DOT_SQL} SELECT count(*) AS shared, round(avg(list_dot_product(CAST(x AS DOUBLE[]), CAST(y AS DOUBLE[])) / sqrt(list_dot_product(CAST(x AS DOUBLE[]), CAST(x AS DOUBLE[])) * list_dot_product(CAST(y AS DOUBLE[]), CAST(y AS DOUBLE[])))), 6) AS before,
    true AS nearer, true AS best FROM a JOIN b USING (token)""",
)
def procrustes_gain(spark, sf):
    """Mean cosine of shared tokens with the base before the turn; after it, it is larger and no other turn is better."""
    base, other = _vectors(spark, sf, "vec_id % 2 = 0"), _vectors(spark, sf, "vec_id % 2 = 1")
    q = vectors.rotation(base, other, DIM)

    def cosine(x: str, y: str):
        def dot(a: str, b: str):
            return F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)

        return dot(x, y) / F.sqrt(dot(x, x) * dot(y, y))

    turned = vectors.procrustes_rotate(base, other, DIM)
    # a further turn in the plane of any two axes lowers the mean: the gradient by the angle vanishes at the best turn
    unit = turned.join(base.select("token", F.col("vector").alias("b")), "token")
    size = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, v: s + v * v))
    tilt = (F.col("vector")[0] * F.col("b")[1] - F.col("vector")[1] * F.col("b")[0]) / (size("vector") * size("b"))
    both = vectors.shared_vocab(base, other).select(cosine("base", "other").alias("c"))
    after = unit.agg(F.avg(cosine("b", "vector")).alias("after"), F.avg(tilt).alias("tilt"), F.lit(bool(abs(q @ q.T - _eye(DIM)).max() < 1e-9)).alias("turn"))
    return both.agg(F.count("*").alias("shared"), F.avg("c").alias("mean")).join(after).select(
        "shared", F.round("mean", 6).alias("before"), (F.col("after") >= F.col("mean")).alias("nearer"), (F.col("turn") & (F.abs("tilt") < 1e-6)).alias("best")
    )


def _eye(n: int):
    import numpy as np

    return np.eye(n)


@query("procrustes_rotate")
def procrustes_rotate(spark, sf):
    return vectors.procrustes_rotate(_vectors(spark, sf, "vec_id % 2 = 0"), _vectors(spark, sf, "vec_id % 2 = 1"), DIM)


@query("procrustes_full")
def procrustes_full(spark, sf):
    return vectors.procrustes_full(_vectors(spark, sf, "vec_id % 2 = 0"), _vectors(spark, sf, "vec_id % 2 = 1"), DIM)[1]


@query(
    "wide_vectors",
    "SELECT vec_id AS \"ID\", " + ", ".join(f'CAST(embedding[{i + 1}] AS DOUBLE) AS "osmVector{i}"' for i in range(DIM)) + " FROM embeddings",
)
def wide_vectors(spark, sf):
    e = load(spark, sf, "embeddings").select(F.col("embedding").cast("array<double>").alias("vector"), F.col("vec_id").alias("ID"))
    return vectors.wide_vectors(e, DIM, "osmVector")


@query(
    "shared_vocab",
    """WITH a AS (SELECT CAST(vec_id AS VARCHAR) AS token FROM embeddings WHERE vec_id % 3 <> 1), b AS (SELECT CAST(vec_id AS VARCHAR) AS token FROM embeddings WHERE vec_id % 3 <> 2)
    SELECT token, 'both' AS side FROM a JOIN b USING (token) UNION ALL SELECT token, 'a' FROM a ANTI JOIN b USING (token) UNION ALL SELECT token, 'b' FROM b ANTI JOIN a USING (token)""",
)
def shared_vocab(spark, sf):
    e = load(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("token"), F.col("embedding").alias("vector"), "vec_id")
    a, b = e.where("vec_id % 3 <> 1"), e.where("vec_id % 3 <> 2")
    both = vectors.shared_vocab(a, b).select("token", F.lit("both").alias("side"))
    return both.unionByName(vectors.vocab_difference(a, b))


@query(
    "vocab_order",
    f"WITH {inputs.EDGES_SQL}, t AS (SELECT unnest([subject, predicate, object]) AS token FROM edges) SELECT token, count(*) AS cnt FROM t GROUP BY 1",
)
def vocab_order(spark, sf):
    t = inputs.all_edges(spark, sf).select(F.explode(F.array("subject", "predicate", "object")).alias("token"))
    return vectors.vocab_order(t.groupBy("token").agg(F.count("*").alias("cnt")))


@query(
    "token_pairs",
    f"""WITH {inputs.EDGES_SQL}, p AS (SELECT [subject, predicate, object] AS w FROM edges),
    x AS (SELECT w, unnest([[1, 2], [1, 3], [2, 1], [2, 3], [3, 1], [3, 2]]) AS ij FROM p)
    SELECT w[ij[1]] AS center, w[ij[2]] AS context, count(*) AS w FROM x GROUP BY 1, 2""",
)
def token_pairs(spark, sf):
    walks = inputs.all_edges(spark, sf).select(F.array("subject", "predicate", "object").alias("walk"))
    return vectors.token_pairs(walks)


def yearly_walks(spark, sf):
    """The dated edges of all years as walks."""
    dated = inputs.dated_star(spark, sf)
    return dated.select(F.trunc("date", "year").cast("string").alias("DATE"), F.array("subject", "predicate", "object").alias("walk"))


@query(
    "walk_vectors_by_date",
    f"""WITH {inputs.DATED_SQL}, y AS (SELECT DISTINCT CAST(date_trunc('year', date) AS DATE) AS d, unnest([subject, predicate, object]) AS token FROM dated),
    s AS (SELECT token, min(d) AS since FROM y GROUP BY 1), days AS (SELECT DISTINCT d FROM y)
    SELECT CAST(d AS VARCHAR) AS "DATE", token, 100 AS dims, CASE WHEN since < d THEN 1 ELSE 0 END AS old,
      CASE WHEN since < d AND NOT EXISTS (SELECT 1 FROM y WHERE y.token = s.token AND y.d = days.d) THEN 1 ELSE 0 END AS kept
    FROM s JOIN days ON since <= d""",
)
def walk_vectors_by_date(spark, sf):
    """Warm start over all years: every token since its first year; tokens a year does not have keep their vectors."""
    walks = yearly_walks(spark, sf)
    v = cut_lineage(vectors.walk_vectors_by_date(walks, "warm"))
    present = walks.select("DATE", F.explode("walk").alias("token"), F.lit(1).alias("here")).distinct()
    dates = [r[0] for r in v.select("DATE").distinct().orderBy("DATE").collect()]
    after = F.element_at(F.create_map(*[F.lit(x) for pair in zip(dates, dates[1:]) for x in pair]), F.col("DATE")) if dates[1:] else F.lit(None).cast("string")
    before = v.select(after.alias("DATE"), "token", F.col("vector").alias("before")).where("DATE IS NOT NULL")
    both = v.join(before, ["DATE", "token"], "left").join(present, ["DATE", "token"], "left")
    drift = F.sqrt(F.aggregate(F.zip_with("vector", "before", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    return both.select(
        "DATE", "token", F.size("vector").alias("dims"), F.when(F.col("before").isNotNull(), 1).otherwise(0).alias("old"),
        F.when(F.col("here").isNull() & (drift < 1e-4), 1).otherwise(0).alias("kept"),
    )


@query(
    "walk_vectors_all_dates",
    f"""WITH {inputs.DATED_SQL}, y AS (SELECT DISTINCT CAST(date_trunc('year', date) AS DATE) AS d, unnest([subject, predicate, object]) AS token FROM dated)
    SELECT CAST(y.d AS VARCHAR) AS "DATE", token, 100 AS dims, true AS has_length,
      CASE WHEN EXISTS (SELECT 1 FROM y AS x WHERE x.token = y.token AND x.d = y.d - INTERVAL 1 YEAR) THEN true END AS comparable FROM y""",
)
def walk_vectors_all_dates(spark, sf):
    """Aligned vectors of all years at the operator's own size and epochs, compared with the year before."""
    v = cut_lineage(vectors.walk_vectors_by_date(yearly_walks(spark, sf), "aligned"))
    before = v.select("token", F.add_months(F.col("DATE").cast("date"), 12).cast("string").alias("DATE"), F.col("vector").alias("before"))
    dot = F.aggregate(F.zip_with("vector", "before", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    likeness = F.try_divide(dot, _norm() * _norm("before"))
    return v.join(before, ["DATE", "token"], "left").select(
        "DATE", "token", F.size("vector").alias("dims"), (_norm() > 0).alias("has_length"), likeness.between(-1.001, 1.001).alias("comparable"),
    )


@query("walk_vectors")
def walk_vectors(spark, sf):
    walks = graph.walks(star_paths(spark, sf))
    trained = vectors.train_walk_vectors(walks)
    return vectors.entity_vectors(walks.select("root").distinct(), trained, "2000-01-01")


@query(
    "map_to_grid",
    """SELECT 'cell/' || c_nationkey AS cell_id, 'node/' || c_custkey AS "ID" FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)""",
)
def map_to_grid(spark, sf):
    mapper = load(spark, sf, "customer").select(F.concat(F.lit("cell/"), "c_nationkey").alias("cell_id"), F.col("c_custkey").alias("osm_id"))
    cells = load(spark, sf, "nation").where("n_regionkey < 3").select(F.concat(F.lit("cell/"), "n_nationkey").alias("cell_id"))
    return vectors.map_to_grid(mapper, cells, "node/")


@query("lift_to_cells")
def lift_to_cells(spark, sf):
    e = load(spark, sf, "embeddings").select(F.concat(F.lit("node/"), "vec_id").alias("token"), F.col("embedding").cast("array<double>").alias("vector"))
    mapper = load(spark, sf, "customer").select(F.concat(F.lit("cell/"), "c_nationkey").alias("cell_id"), F.col("c_custkey").alias("osm_id"))
    cells = load(spark, sf, "nation").select(F.concat(F.lit("cell/"), "n_nationkey").alias("cell_id"))
    return vectors.wide_vectors(vectors.lift_to_cells(e, mapper, cells, DIM, "node/"), DIM)


@query(
    "encode_triples",
    f"""WITH {inputs.EDGES_SQL}, e AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS id FROM (SELECT subject AS label FROM edges UNION SELECT object FROM edges)),
    r AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS id FROM (SELECT DISTINCT predicate AS label FROM edges))
    SELECT a.id AS h, r.id AS r, b.id AS t FROM edges JOIN e a ON subject = a.label JOIN r ON predicate = r.label JOIN e b ON object = b.label""",
)
def encode_triples(spark, sf):
    return kge.encode_triples(inputs.all_edges(spark, sf))[0]


@query(
    "split_triples",
    f"""WITH {inputs.EDGES_SQL}, t AS (SELECT DISTINCT subject, predicate, object FROM edges),
    b AS (SELECT *, CAST('0x' || substr(md5(concat_ws('|', subject, predicate, object, '14')), 1, 8) AS BIGINT) % 10 AS b FROM t),
    nodes AS (SELECT subject AS n FROM b WHERE b < 8 UNION SELECT object FROM b WHERE b < 8), preds AS (SELECT DISTINCT predicate AS n FROM b WHERE b < 8),
    p AS (SELECT CASE WHEN b < 8 OR s.n IS NULL OR o.n IS NULL OR q.n IS NULL THEN 'train' WHEN b = 8 THEN 'test' ELSE 'valid' END AS part
      FROM b LEFT JOIN nodes s ON subject = s.n LEFT JOIN nodes o ON object = o.n LEFT JOIN preds q ON predicate = q.n)
    SELECT part, count(*) AS n FROM p GROUP BY 1""",
)
def split_triples(spark, sf):
    return kge.split_triples(triples.distinct_triples(inputs.all_edges(spark, sf))).groupBy("part").agg(F.count("*").alias("n"))


def _labels_sql(dims: int) -> str:
    return f"""WITH {inputs.EDGES_SQL} SELECT DISTINCT unnest([subject, object]) AS token, {dims} AS dims, true AS finite, true AS loss_falls FROM edges"""


def _trained(entities, losses):
    """Entity vectors with what must hold of them: their size, finite entries, a loss that falls over the epochs."""
    finite = F.forall("vector", lambda v: ~F.isnan(v) & (F.abs(v) < 1e6))
    return entities.select("token", F.size("vector").alias("dims"), finite.alias("finite"), F.lit(losses[-1] < 0.5 * losses[0]).alias("loss_falls"))


@query("kge_transe", _labels_sql(50))
def kge_transe(spark, sf):
    entities, _, losses = kge.train_kge(inputs.all_edges(spark, sf), "transe")
    return _trained(entities, losses)


@query("kge_complex", _labels_sql(100))
def kge_complex(spark, sf):
    entities, _, losses = kge.train_kge(kge.split_triples(inputs.all_edges(spark, sf)), "complex")
    return _trained(entities, losses)
