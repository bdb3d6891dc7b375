"""Operators whose results are not plain SQL: properties and brute force on small fixtures."""

import datetime
import hashlib
import math
import os
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cellweave.functions import geo, hexgrid as hx
from cellweave.operators import graph, grid, interpolation as ip, kge, metrics, modelling as md, panel, scale, solver, spatial, triples, vectors
from cellweave.sources import readers, writers


def vec_table(spark, x, names=None):
    names = names or [f"t{i:04d}" for i in range(len(x))]
    return spark.createDataFrame([(n, [float(v) for v in row]) for n, row in zip(names, x)], "token string, vector array<double>")


def test_global_row_number_and_running_total(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.lit(2).alias("v"))
    ranked = {r.k: r.rn for r in scale.global_row_number(df, [F.col("k")]).collect()}
    assert ranked == {k: k + 1 for k in range(1000)}
    total = {r.k: r.s for r in scale.running_total(df, [F.desc("k")], {"s": "v"}).collect()}
    assert total == {k: 2 * (1000 - k) for k in range(1000)}


@pytest.mark.parametrize("n", [1, 2, 999, 1000])
def test_exact_medians(spark, n):
    rng = np.random.default_rng(n)
    x, y = rng.normal(size=n), rng.integers(0, 3, size=n)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y)], "x double, y int")
    got = scale.exact_medians(df, ["x", "y"], accuracy=50)
    assert got == {"x": pytest.approx(np.median(x)), "y": pytest.approx(np.median(y))}


def test_median_band_is_narrowed(spark, monkeypatch):
    monkeypatch.setattr(scale, "DRIVER_ROWS", 5)
    df = spark.range(2000).select((F.col("id") * 7919 % 2000).cast("double").alias("x"))
    assert scale.exact_medians(df, ["x"], accuracy=20) == {"x": 999.5}


def test_blocks_split_a_hot_key(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 2500, 0).otherwise(F.col("id")).alias("k"), "id")
    out = scale.in_blocks(df, ["k"], ["id"], F.col("id"), block_rows=100)
    sizes = [(r.k, len(r.items)) for r in out.collect()]
    assert sum(n for _, n in sizes) == 3000 and max(n for _, n in sizes) < 200


def test_bfs_ties_cycles_and_depth(spark):
    rows = [("a", "p", "b"), ("a", "p", "b"), ("a", "o", "b"), ("b", "q", "c"), ("c", "r", "a"), ("a", "z", "d"), ("d", "q", "c"), ("c", "s", "e")]
    t = spark.createDataFrame(rows, "subject string, predicate string, object string")
    roots = spark.createDataFrame([("a",)], "root string")
    full = {r.node: (r.depth, r.path) for r in graph.bfs_paths(t, roots, 2, "full").collect()}
    assert full == {"a": (0, []), "b": (1, ["o", "b"]), "d": (1, ["z", "d"]), "c": (2, ["o", "b", "q", "c"])}
    first = graph.walks(graph.bfs_paths(t, roots, 3))
    assert {r.node: r.walk for r in first.collect()}["e"] == ["a", "o", "b"]


def test_mean_out_degree(spark):
    t = spark.createDataFrame([("a", "p", "b", "x"), ("a", "p", "c", "x")], "subject string, predicate string, object string, date string")
    assert tuple(graph.mean_out_degree(t).first()) == ("x", 3, 2, 0.6667)


def test_compact_is_undone_by_uncompact(spark):
    top = spark.createDataFrame([(1, 0, 0), (1, 3, -1)], "res int, q bigint, r bigint")
    fine = grid.uncompact_cells(top, 3)
    assert fine.count() == 98
    assert {r.cell_id for r in grid.compact_cells(fine).collect()} == {"1/0/0", "1/3/-1"}
    part = fine.where("cell_id <> '3/0/0'")
    mixed = grid.compact_cells(part)
    assert mixed.count() == 1 + 6 + 6
    assert grid.uncompact_cells(mixed, 3).count() == 97


def test_adjacency_is_symmetric(spark):
    cells = grid.cells_from_ids(grid.uncompact_cells(spark.createDataFrame([(1, 0, 0)], "res int, q bigint, r bigint"), 3).select("cell_id"))
    pairs = {(r.cell_id, r.neighbour_id) for r in grid.hex_neighbours(cells).collect()}
    assert pairs and pairs == {(b, a) for a, b in pairs}


def test_nearest_distance_against_brute_force(spark):
    rng = np.random.default_rng(3)
    pts = np.column_stack([rng.uniform(-180, 180, 60), rng.uniform(-89, 89, 60)])
    seg = np.column_stack([rng.uniform(-180, 180, 40), rng.uniform(-85, 85, 40)])
    end = seg + rng.uniform(-4, 4, seg.shape)
    p = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(pts)], "id int, lon double, lat double")
    s = spark.createDataFrame([tuple(map(float, (*a, *b))) for a, b in zip(seg, end)], "ax double, ay double, bx double, by double")
    got = {r.id: r.distance_m for r in spatial.nearest_distance(p, s, "id", levels=3).collect()}

    def unit(q):
        lo, la = np.radians(q[:, 0]), np.radians(q[:, 1])
        return np.column_stack([np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la)])

    u, a, b = unit(pts), unit(seg), unit(end)
    w = np.linspace(0, 1, 4001)[:, None, None]
    arc = np.arccos(np.clip((a * b).sum(1), -1, 1))[None, :, None]
    line = (np.sin((1 - w) * arc) * a + np.sin(w * arc) * b) / np.sin(arc)
    best = np.max(np.einsum("pk,wsk->pws", u, line), axis=(1, 2))
    want = 6371008.8 * np.arccos(np.clip(best, -1, 1))
    assert len(got) == 60
    assert all(abs(got[i] - want[i]) < 60 for i in range(60))


def test_spatial_candidates_against_brute_force(spark):
    rng = np.random.default_rng(5)
    boxes = [(i, *xy, *(xy + 10 ** rng.uniform(-3, 2, 2))) for i, xy in enumerate(rng.uniform(-60, 60, (60, 2)))]
    df = spark.createDataFrame([(i, *map(float, b)) for i, *b in boxes], "id int, x0 double, y0 double, x1 double, y1 double")
    from cellweave.functions.geo import box

    f = df.select("id", box(*[F.col(c) for c in ("x0", "y0", "x1", "y1")]).alias("geom"))
    pairs = [(r.id, r.cell_id) for r in spatial.spatial_candidates(f, f.select(F.col("id").alias("cell_id"), "geom")).collect()]
    want = {(a[0], b[0]) for a in boxes for b in boxes if a[1] <= b[3] and b[1] <= a[3] and a[2] <= b[4] and b[2] <= a[4]}
    assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_pca_both_routes_match_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 5))
    df = spark.createDataFrame([("hot" if i < 55 else f"k{i // 2}", [float(v) for v in r]) for i, r in enumerate(x)], "ID string, vector array<double>")
    for rows in (1000, 10):
        got = {r.ID: np.array(r.vector) for r in vectors.pca_compress(df, "ID", 5).collect()}
        block = x[:55].T
        c = block - block.mean(axis=0)
        u, s, _ = np.linalg.svd(c, full_matrices=False)
        want = u[:, 0] * s[0]
        want = want if want[np.argmax(np.abs(want))] >= 0 else -want
        assert np.allclose(got["hot"], want)
        assert np.allclose(got["k27"], x[55]) and len(got) == 4


def test_procrustes(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 4))
    q, _ = np.linalg.qr(rng.normal(size=(4, 4)))
    base, other = vec_table(spark, x), vec_table(spark, x @ q.T * 3 + 0.0)
    rot = vectors.rotation(base, other, 4)
    assert np.allclose(rot @ rot.T, np.eye(4))
    back = {r.token: r.vector for r in vectors.procrustes_rotate(base, other, 4).collect()}
    assert np.allclose(np.array([back[f"t{i:04d}"] for i in range(40)]), 3 * x)
    a, b, gap = vectors.procrustes_full(base, vec_table(spark, x @ q.T * 3 + 7), 4)
    one, two = ({r.token: r.vector for r in d.collect()} for d in (a, b))
    assert gap == pytest.approx(0, abs=1e-9) and np.allclose([one[k] for k in sorted(one)], [two[k] for k in sorted(two)])


def small_graph(spark):
    rows = [(f"n{i}", "next", f"n{(i + 1) % 12}") for i in range(12)] + [(f"n{i}", "type", "hub") for i in range(12)]
    return spark.createDataFrame(rows, "subject string, predicate string, object string")


@pytest.mark.parametrize("model,width", [("transe", 4), ("complex", 8)])
def test_kge_loss_falls_and_repeats(spark, model, width):
    ent, rel, loss = kge.train_kge(small_graph(spark), model, 4, 5, lr=0.3)
    assert loss[-1] < loss[0]
    assert ent.count() == 13 and rel.count() == 2 and len(ent.first().vector) == width
    assert kge.train_kge(small_graph(spark), model, 4, 1, lr=0.3)[2][0] == pytest.approx(loss[0])
    with pytest.raises(NotImplementedError):
        kge.train_kge(small_graph(spark), "other", 4, 1)


@pytest.mark.parametrize("model", ["transe", "complex", "skipgram"])
def test_gradients_by_differences(model):
    """Slopes of both kinds of corruption against differences of the loss."""
    rng = np.random.default_rng(4)
    args = [rng.normal(size=(3, 4)) * 0.3 for _ in range(4)]
    w, head = np.array([1.0, 2.0, 0.5]), np.array([True, False, True])
    head = head & (model != "skipgram")
    _, *grads = kge._slopes(model, *args, w, head)
    for k in range(4):
        for i, j in ((0, 0), (1, 3), (2, 1)):
            up, down = [a.copy() for a in args], [a.copy() for a in args]
            up[k][i, j] += 1e-6
            down[k][i, j] -= 1e-6
            slope = (kge._slopes(model, *up, w, head)[0].sum() - kge._slopes(model, *down, w, head)[0].sum()) / 2e-6
            assert grads[k][i, j] == pytest.approx(slope, abs=1e-5)


def test_split_keeps_labels_known(spark):
    t = kge.split_triples(spark.range(500).select(F.concat(F.lit("s"), F.col("id") % 60).alias("subject"), F.lit("p").alias("predicate"), F.concat(F.lit("o"), "id").alias("object")))
    parts = {r.part: r["count"] for r in t.groupBy("part").count().collect()}
    assert sum(parts.values()) == 500 and parts == {"train": 500}
    known = kge.split_triples(spark.range(3000).select((F.col("id") % 50).cast("string").alias("subject"), F.lit("p").alias("predicate"), (F.col("id") % 47).cast("string").alias("object")).distinct())
    counts = {r.part: r["count"] for r in known.groupBy("part").count().collect()}
    assert counts["train"] > 5 * counts["test"] > 0


def test_walk_vectors(spark):
    walks = small_graph(spark).select(F.array("subject", "predicate", "object").alias("walk"))
    out = vectors.train_walk_vectors(walks, 6, 2)
    assert out.count() == 15 and len(out.first().vector) == 6
    dated = walks.withColumn("DATE", F.lit("2016-01-01")).unionByName(walks.limit(5).withColumn("DATE", F.lit("2017-01-01")))
    per_date = {r.DATE: r["count"] for r in vectors.walk_vectors_by_date(dated, "union", 4, 1).groupBy("DATE").count().collect()}
    assert per_date == {"2016-01-01": 15, "2017-01-01": 15}


def test_tournament_meets_every_bucket_once(spark):
    for parts in (2, 4, 6, 10):
        grid = spark.range(parts).select(F.col("id").cast("int").alias("i")).crossJoin(spark.range(parts).select(F.col("id").cast("int").alias("j")))
        turn, pair = kge._meeting(F.col("i"), F.col("j"), parts)
        met = [tuple(r) for r in grid.select("i", "j", turn, pair).collect()]
        for t in range(parts - 1):
            partner = [r[0] for r in spark.range(parts).orderBy("id").select(kge._partner(F.col("id").cast("int"), t, parts)).collect()]
            assert all(partner[partner[i]] == i != partner[i] for i in range(parts))
            assert all(i == j or partner[i] == j for i, j, u, _ in met if u == t) and all(p == min(i, partner[i]) for i, _, u, p in met if u == t)


@pytest.mark.parametrize("model", ["transe", "complex", "skipgram"])
def test_partitions_and_turns_train_all(spark, model, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(int(a), int(a + b) % 3 * (model != "skipgram"), 100 + int(b), 1.0) for a, b in rng.integers(0, 40, size=(600, 2))]
    triples = spark.createDataFrame(rows, "h bigint, r bigint, t bigint, w double")
    ids, rels = spark.range(150), spark.range(3)
    monkeypatch.setattr(kge, "TASK_TRIPLES", 20)
    runs = [kge.train(triples, ids, rels, model, 6, 25, 0.2, parts=6) for _ in range(2)]
    (ent, rel, loss), again = runs[0], runs[1][2]
    assert len(loss) == 25 and loss[-1] < 0.8 * loss[0] and loss == pytest.approx(again)
    got = {r.id: r.vec for r in ent.collect()}
    start = {r.id: r.vec for r in kge._start(ids, len(got[0]), 14).collect()}
    used = {r[0] for r in rows} | {r[2] for r in rows}
    moved = {i for i in got if not np.allclose(got[i], start[i], atol=1e-6)}
    assert set(got) == set(range(150)) and used <= moved and (model != "skipgram" or moved == used) and rel.count() == 3


def test_warm_start_keeps_and_seeds_tokens(spark):
    days = {"2016": "abcd", "2017": "bcde", "2018": "ae"}
    walks = [(d, [x, y]) for d, names in days.items() for x in names for y in names if x != y]
    df = spark.createDataFrame(walks, "DATE string, walk array<string>")
    got = {(r.DATE, r.token): np.array(r.vector) for r in vectors.walk_vectors_by_date(df, "warm", 5, 3).collect()}
    assert sorted(got) == [("2016", t) for t in "abcd"] + [("2017", t) for t in "abcde"] + [("2018", t) for t in "abcde"]
    assert np.allclose(got["2016", "a"], got["2017", "a"], atol=1e-6) and not np.allclose(got["2016", "b"], got["2017", "b"], atol=1e-3)
    assert all(np.allclose(got["2017", t], got["2018", t], atol=1e-6) for t in "bcd") and not np.allclose(got["2017", "e"], got["2018", "e"], atol=1e-3)
    # the second date does start where the first one ended: with no epochs its vectors are those
    still = {(r.DATE, r.token): np.array(r.vector) for r in vectors.walk_vectors_by_date(df, "warm", 5, 0).collect()}
    assert all(np.allclose(still["2016", t], still["2018", t], atol=1e-6) for t in "abcd")


def test_alignment_keeps_all_keys(spark):
    rng = np.random.default_rng(8)
    keys = ["abcfg", "abdfg", "abcdfg"]
    rows = [(t, [float(v) for v in rng.normal(size=3)], f"d{i}") for i, names in enumerate(keys) for t in names]
    df = spark.createDataFrame(rows, "token string, vector array<double>, DATE string")
    for mode in ("rotate", "full"):
        got = vectors.align_by_date(df, 3, mode).groupBy("DATE").agg(F.sort_array(F.collect_list("token")).alias("t")).collect()
        assert {r.DATE: "".join(r.t) for r in got} == {f"d{i}": k for i, k in enumerate(keys)}


def test_dated_vectors_and_walks_leave_no_row_out(spark, sf_dir):
    from cellweave.plans import vector_queries as q
    from cellweave.plans.inputs import dated_star

    dated = q.dated_vectors(spark, sf_dir)
    assert dated.count() == spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    sets = [{r.token for r in dated.where(F.col("DATE") == d).collect()} for d in ("2016-09-01", "2016-09-02", "2016-09-03")]
    assert all(a - b and b - a and a & b for a, b in zip(sets, sets[1:]))
    walks, edges = q.yearly_walks(spark, sf_dir), dated_star(spark, sf_dir)
    assert walks.count() == edges.count()
    assert {r[0] for r in walks.select("DATE").distinct().collect()} == {r[0] for r in edges.select(F.trunc("date", "year").cast("string")).distinct().collect()}


@pytest.mark.parametrize(
    "name, module, fit",
    [("kge_transe", kge, "train_kge"), ("kge_complex", kge, "train_kge"), ("walk_vectors", vectors, "train_walk_vectors"),
     ("gbt_regression", md, "fit_regressor"), ("gbt_classification", md, "fit_classifier")],
)
def test_registered_training_keeps_the_defaults(spark, sf_dir, monkeypatch, name, module, fit):
    import inspect

    import __spark_entry__ as entry

    class Reached(Exception):
        pass

    plain = inspect.signature(getattr(module, fit))

    def reached(*args, **kwargs):
        raise Reached(plain.bind(*args, **kwargs).arguments)

    monkeypatch.setattr(module, fit, reached)
    with pytest.raises(Reached) as e:
        entry.queries()[name](spark, sf_dir)
    assert not {"dim", "epochs", "params"} & set(e.value.args[0])


# -- interpolation ----------------------------------------------------------------------------------------------


def stations(spark, n=25, seed=7):
    rng = np.random.default_rng(seed)
    rows = [(d, "T", f"s{i:02d}", float(x), float(y), float(2 * x - y + rng.normal() + d)) for d in (1, 2) for i, (x, y) in enumerate(rng.uniform(0, 10, (n, 2)))]
    s = spark.createDataFrame(rows, "d int, variable string, station string, lon double, lat double, value double")
    return s.withColumn("date", F.date_add(F.to_date(F.lit("2010-01-01")), "d")).drop("d")


def at_stations(s):
    return s.select(F.concat("station", F.lit("|"), F.col("date").cast("string")).alias("cell_id"), "lon", "lat")


@pytest.mark.parametrize("method", ["idw", "krige", "blocks"])
def test_interpolation_reproduces_stations(spark, method, monkeypatch):
    s = stations(spark)
    if method == "blocks":
        monkeypatch.setattr(scale.with_block, "__defaults__", (4,))
    if method == "krige":
        out = ip.krige(s, at_stations(s), ["lon", "lat"])
    else:
        out = ip.idw(s, at_stations(s), ip.idw_power(s))
    want = {(f"{r.station}|{r.date}", str(r.date)): r.value for r in s.collect()}
    got = {(r.cell_id, str(r.date)): r.value for r in out.collect()}
    assert len(got) == 100
    assert all(got[k] == pytest.approx(v, abs=1e-5) for k, v in want.items())


def test_blocks_do_not_change_scores(spark, monkeypatch):
    s = stations(spark)
    one = {str(r.date): (r.power, round(r.rmse, 9)) for r in ip.idw_power(s).collect()}
    v1 = sorted((str(r.date), r.bin, round(r.gamma, 9), r.pairs) for r in ip.variogram(s, 1e6).collect())
    monkeypatch.setattr(scale.with_block, "__defaults__", (4,))
    assert {str(r.date): (r.power, round(r.rmse, 9)) for r in ip.idw_power(s).collect()} == one
    assert sorted((str(r.date), r.bin, round(r.gamma, 9), r.pairs) for r in ip.variogram(s, 1e6).collect()) == v1


def test_leave_one_out_shortcut(spark):
    """The matrix shortcut equals solving again without each station."""
    pdf = stations(spark, 12).where("date = '2010-01-02'").toPandas().sort_values("station").reset_index(drop=True)
    model, inv, _ = ip._krige_system(pdf, [])
    z, n = pdf["value"].to_numpy(), len(pdf)
    quick = (inv[:n, :n] @ z) / np.diag(inv)[:n]
    name, nugget, psill, a = model
    h = ip._angles(pdf)
    c = psill * (1 - ip._shape(name, h, a))
    c[h == 0] = nugget + psill
    for i in range(n):
        k = [j for j in range(n) if j != i]
        full = np.block([[c[np.ix_(k, k)], np.ones((n - 1, 1))], [np.ones((1, n - 1)), np.zeros((1, 1))]])
        lam = np.linalg.solve(full, np.concatenate([c[k, i], [1.0]]))
        assert quick[i] == pytest.approx(z[i] - lam[: n - 1] @ z[k], abs=1e-6)


def test_special_stations(spark):
    s = stations(spark).withColumn("value", F.lit(0.0))
    assert {r.value for r in ip.krige(s, at_stations(s)).collect()} == {0.0}
    few = stations(spark).where("station < 's02'")
    assert ip.tps(few, at_stations(few)).where("value IS NULL OR isnan(value)").count() == 0
    one = stations(spark).where("station = 's03'")
    v = {str(r.date): r.value for r in one.collect()}
    far = spark.createDataFrame([("c", 50.0, 50.0)], "cell_id string, lon double, lat double")
    assert {str(r.date): pytest.approx(r.value) for r in ip.idw(one, far, ip.idw_power(one)).collect()} == v
    bits = stations(spark).withColumn("value", (F.col("value") > 10).cast("double"))
    assert {r.value for r in ip.indicator_krige(bits, at_stations(bits)).collect()} <= {0.0, 1.0}


def test_large_groups_agree_with_dense_ones(spark, monkeypatch):
    s = stations(spark, 120).where("date = '2010-01-02'")
    cells = at_stations(s).withColumn("lon", F.col("lon") + 0.21)
    want = {r.cell_id: r.value for r in ip.krige(s, cells, ["lon", "lat"]).collect()}
    monkeypatch.setattr(ip, "DENSE_STATIONS", 100)
    monkeypatch.setattr(solver, "BLOCK", 40)
    got = {r.cell_id: r.value for r in ip.krige(s, cells, ["lon", "lat"]).collect()}
    assert got == pytest.approx(want, abs=1e-6) and len(got) == 120


@pytest.mark.skipif(not os.environ.get("SLOW_TESTS"), reason="takes more than a minute")
def test_more_than_four_thousand_stations(spark, monkeypatch):
    monkeypatch.setattr(solver, "BLOCK", 1050)
    rng = np.random.default_rng(3)
    n = 4200
    x, y = rng.uniform(-40, 40, n), rng.uniform(-30, 30, n)
    z = np.sin(x / 7) + y / 20 + 0.1 * rng.normal(size=n)
    pdf = pd.DataFrame({"date": "2010", "variable": "T", "station": [f"s{i}" for i in range(n)], "lon": x, "lat": y, "value": z})
    cells = pd.DataFrame({"cell_id": [f"c{i}" for i in range(40)], "lon": rng.uniform(-40, 40, 40), "lat": rng.uniform(-30, 30, 40)})
    got = ip.krige(spark.createDataFrame(pdf), spark.createDataFrame(cells)).toPandas().set_index("cell_id")["value"][cells["cell_id"]].to_numpy()
    h = ip._angles(pdf)
    name, nugget, psill, a = ip._fit_variogram(h, z - z.mean())
    # a Gaussian without nugget: singular up to rounding, so the solution is the one with the stated share on the diagonal
    full = np.ones((n + 1, n + 1))
    full[n, n], full[:n, :n] = 0.0, solver.kernel(name, h, nugget, psill, a) + solver.JITTER * (nugget + psill) * np.eye(n)
    w = np.linalg.solve(full, np.append(z, 0.0))
    both = ip._angles(pd.concat([cells, pdf])[["lon", "lat"]])[:40, 40:]
    assert np.allclose(got, solver.kernel(name, both, nugget, psill, a) @ w[:n] + w[n], atol=1e-5)
    assert np.abs(got - np.sin(cells["lon"] / 7) - cells["lat"] / 20).max() < 0.1


def test_trend_choice_and_fallback(spark):
    s = stations(spark).withColumn("elevation", F.col("value") * 3).withColumn("coast", F.lit(1.0) + F.length("station"))
    assert len(ip.formulas()) == 8
    best = ip.krige_select(s, s.select("date")).first()
    assert "ELEVATION" in best.formula
    out = ip.interpolate(s, at_stations(s), -1000, 5)
    assert out.count() == 100 and out.where("value > 5").count() > 0


# -- panels, models, files ----------------------------------------------------------------------------------------


def test_thin_stride():
    assert metrics.thin_stride(25_000, 10_000) == 6 and math.ceil(25_000 / 6) == 4167


def test_month_agg_missing_member_poisons(spark):
    df = spark.createDataFrame([("s", "2010-01-03", 1.0), ("s", "2010-01-04", None), ("s", "2010-02-01", 2.0)], "station string, d string, v double")
    got = {str(r.DATE): r.v for r in panel.month_agg(df.withColumn("d", F.to_date("d")), ["station"], "d", mins=["v"]).collect()}
    assert got == {"2010-01-01": None, "2010-02-01": 2.0}


def test_param_search_resumes(spark, tmp_path):
    df = spark.range(200).select(F.col("id").alias("k"), (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 7 * 3 + 1).cast("double").alias("y"))
    data, _ = md.preprocess(df, df, ["x"], [])
    ranges = {**md.RANGES, "maxDepth": (1, 2), "numberEstimators": (1, 2), "gamma": (0, 0), "minChildWeight": (0, 2)}
    trials = md.trial_table(2, ranges=ranges)
    first = md.param_search(data, "y", ["k"], trials[:1], 2, str(tmp_path / "log")).collect()
    both = md.param_search(data, "y", ["k"], trials, 2, str(tmp_path / "log")).orderBy("trial").collect()
    assert both[0] == first[0] and len(both) == 2 and md.read_trials(spark, str(tmp_path / "log")).count() == 2


def test_preprocess_learns_on_train_only(spark):
    train = spark.createDataFrame([(1.0, "a"), (3.0, "b"), (None, "a")], "x double, c string")
    test = spark.createDataFrame([(None, "z"), (9.0, "b")], "x double, c string")
    _, out = md.preprocess(train, test, ["x"], ["c"])
    assert sorted(tuple(r.features.toArray()) for r in out.collect()) == [(2.0, 0.0, 0.0), (9.0, 0.0, 1.0)]


def test_snapshot_dates_and_years(spark, tmp_path):
    df = spark.range(3).coalesce(1)
    for name in ("area-170401", "area-2016-09-01"):
        df.toPandas().to_parquet(tmp_path / f"{name}.parquet")
    assert {str(r.date) for r in readers.read_features(spark, str(tmp_path)).select("date").distinct().collect()} == {"2017-04-01", "2016-09-01"}
    for year in (2014, 2015):
        (tmp_path / "fires" / str(year)).mkdir(parents=True)
        df.toPandas().to_parquet(tmp_path / "fires" / str(year) / "x.parquet")
    assert {r.year for r in readers.read_yearly(spark, str(tmp_path / "fires")).select("year").distinct().collect()} == {2014, 2015}


def test_compaction_keeps_rows_and_lists_dates(spark, tmp_path):
    t = small_graph(spark).withColumn("date", F.to_date(F.lit("2016-09-01")))
    t.repartition(6).write.partitionBy("date").parquet(str(tmp_path / "a"))
    writers.compact(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    files = [len(list((tmp_path / d / "date=2016-09-01").glob("*.parquet"))) for d in "ab"]
    assert files[0] > files[1] == 1
    assert spark.read.parquet(str(tmp_path / "b")).exceptAll(t).count() == 0
    assert [str(r.date) for r in readers.list_dates(spark, str(tmp_path / "b")).collect()] == ["2016-09-01"]
    plan = readers.read_triples(spark, str(tmp_path / "b"), "2016-09-01")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(date" in plan


def test_widen_tags(spark):
    df = spark.createDataFrame([(1, {"a": "x", "b": "y"})], "osm_id int, all_tags map<string,string>")
    assert triples.widen_tags(df).columns == ["osm_id", "a", "b"]
    assert triples.widen_tags(df, ["b", "z"]).columns == ["osm_id", "b", "z"]


def test_natural_breaks_are_optimal(spark):
    from itertools import combinations

    rng = np.random.default_rng(3)
    x = np.sort(rng.choice(4000, 24, replace=False).astype(float))
    df = spark.createDataFrame([(float(v),) for v in x], "v double")

    def deviation(ends):
        return sum(((x[a:b] - x[a:b].mean()) ** 2).sum() for a, b in zip(ends, ends[1:]))

    best = min(((0, *c, len(x)) for c in combinations(range(1, len(x)), 3)), key=deviation)
    means = [x[a:b].mean() for a, b in zip(best, best[1:])]
    assert panel.natural_breaks(df, "v", 4) == pytest.approx([(a + b) / 2 for a, b in zip(means, means[1:])])
    assert panel.natural_breaks(df.limit(0), "v", 4) == panel.natural_breaks(df.limit(1), "v", 4) == []


@pytest.mark.parametrize("far", [[1e4], [-1e4, 3e5]])
def test_natural_breaks_with_outliers(spark, far):
    from itertools import combinations

    rng = np.random.default_rng(5)
    x = np.sort(np.r_[rng.uniform(0, 1, 18), far])
    df = spark.createDataFrame([(float(v),) for v in x], "v double")

    def deviation(ends):
        return sum(((x[a:b] - x[a:b].mean()) ** 2).sum() for a, b in zip(ends, ends[1:]))

    best = min(((0, *c, len(x)) for c in combinations(range(1, len(x)), 4)), key=deviation)
    means = [x[a:b].mean() for a, b in zip(best, best[1:])]
    assert panel.natural_breaks(df, "v", 5) == pytest.approx([(a + b) / 2 for a, b in zip(means, means[1:])])


def test_natural_breaks_need_no_fine_steps(spark):
    """Few steps a round give the classes that dynamic programming finds over all single values."""
    x = np.sort(np.random.default_rng(6).lognormal(0, 1.5, 1500))
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    want = panel.class_breaks(np.ones(len(x)), x, x**2, 5)
    assert panel.natural_breaks(df, "v", 5, cells=16) == pytest.approx(want) == panel.natural_breaks(df, "v", 5)


def test_metrics_of_degenerate_tables(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 1.0)], "y double, p double")
    assert metrics.regression_metrics(df, "y", "p").first().r2 is None
    assert metrics.roc_auc(df, "y", "p").first().auc is None
    with pytest.raises(ValueError):
        metrics.time_folds(df, ["p"], 4)


def test_stations_are_cleaned_before_interpolation(spark):
    s = stations(spark)
    twice = s.unionByName(s).unionByName(s.limit(3).withColumn("value", F.lit(None).cast("double")))
    for run in (lambda x: ip.idw(x, at_stations(s), 2.0), lambda x: ip.krige(x, at_stations(s))):
        a, b = ({(r.cell_id, r.date): r.value for r in run(d).collect()} for d in (s, twice))
        assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-9) for k in a)


def test_compact_repeated_and_nested_cells_of_mixed_levels(spark):
    whole = spark.createDataFrame([(1, 2, 5)], "res int, q bigint, r bigint")
    fine, mid = grid.uncompact_cells(whole, 4).select("res", "q", "r"), grid.uncompact_cells(whole, 2).select("res", "q", "r")
    lone = spark.createDataFrame([(3, 40, -7), (0, -9, 9)], "res int, q bigint, r bigint")
    part = fine.where("pmod(q + 3 * r, 5) > 0").unionByName(mid).unionByName(mid).unionByName(lone)
    assert sorted(r.cell_id for r in grid.compact_cells(part).collect()) == ["0/-9/9", "1/2/5", "3/40/-7"]
    # a child and its own descendants must not stand in for a missing sibling
    kids = [tuple(r) for r in mid.collect()]
    below = grid.uncompact_cells(spark.createDataFrame(kids[:1], mid.schema), 3).select("res", "q", "r")
    six = spark.createDataFrame(kids[:6], mid.schema)
    got = {r.cell_id for r in grid.compact_cells(six.unionByName(below)).collect()}
    assert got == {"/".join(map(str, k)) for k in kids[:6]}
    assert grid.compact_cells(whole.limit(0)).count() == 0


def test_sampled_reach_equals_exhaustive_search(spark):
    rng = random.Random(5)
    names = [f"n{i}" for i in range(60)]
    rows = [(rng.choice(names), rng.choice("pqr"), rng.choice(names)) for _ in range(150)]
    rows += [("n0", "h", n) for n in names] + [(n, "i", "n1") for n in names] + rows[:20] + [("n2", "p", "n2")]
    t = spark.createDataFrame(rows, "subject string, predicate string, object string")
    roots = spark.createDataFrame([(n,) for n in [*names[:25], "alone"]], "root string")
    every = {(r.root, r.node): (r.depth, r.path) for r in graph.bfs_paths(t, roots, 3).collect()}
    for k in (1, 4, 15, -1):
        got = {(r.root, r.node): (r.depth, r.path) for r in graph.sampled_reach(t, roots, 3, k).collect()}
        kept = {}
        for root in {r for r, _ in every}:
            reach = sorted((n for r, n in every if r == root), key=lambda n: (hashlib.md5(f"15|{n}".encode()).hexdigest(), n))
            kept.update({(root, n): every[root, n] for n in (reach if k < 0 else reach[:k])})
        assert got == kept, k
    with pytest.raises(ValueError):
        graph.sampled_reach(t, roots, 0, 4)


def test_searches_pass_on_new_entries_only(spark, monkeypatch):
    """A chain beside many edges that lead nowhere: rounds store what is new, not all lists again."""
    rows = [("a", "p", "b"), ("b", "p", "c"), ("c", "p", "d"), ("d", "p", "d")] + [(f"i{n}", "q", f"t{n % 7}") for n in range(400)]
    t = spark.createDataFrame(rows, "subject string, predicate string, object string")
    stored, store = [], graph.cut_lineage
    monkeypatch.setattr(graph, "cut_lineage", lambda df, *by: stored.append(store(df, *by)) or stored[-1])
    monkeypatch.setattr(graph, "release", lambda df: None)
    chain = {("a", "a", 0), ("a", "b", 1), ("a", "c", 2), ("a", "d", 3), ("b", "b", 0), ("b", "c", 1), ("b", "d", 2), ("c", "c", 0), ("c", "d", 1), ("d", "d", 0)}
    for search in (lambda: graph.bfs_paths(t, None, 4), lambda: graph.sampled_reach(t, None, 4, 500), lambda: graph.bfs_paths(t, graph.walk_roots(t), 4)):
        stored.clear()
        got = {(r.root, r.node, r.depth) for r in search().collect() if r.root[0] != "i"}
        assert got == chain
        assert max(s.count() for s in stored) == 403


def test_graph_size_of_intervals_equals_repeated_rows(spark):
    rng = random.Random(9)
    day = [datetime.date(2020, 1, 1) + datetime.timedelta(days=i) for i in range(12)]
    rows = []
    for _ in range(120):
        lo, hi = sorted((rng.randrange(12), rng.randrange(12)))
        first, last = rng.choice([(day[lo], day[hi]), (day[lo], day[lo]), (None, day[hi]), (day[lo], None), (None, None)])
        rows.append((f"s{rng.randrange(15)}", "p", f"o{rng.randrange(15)}", first, last))
    rows += rows[:10] + [("s0", "p", "s0", day[5], day[2])]  # repeats count as edges; an interval that ends first is never valid
    t = spark.createDataFrame(rows, "subject string, predicate string, object string, first date, last date")
    got = {r.date: (r.nodes, r.edges) for r in graph.graph_size_of_intervals(t).collect()}
    want = {}
    for d in {r[3] for r in rows[:-1] if r[3]}:
        live = [r for r in rows if (r[3] is None or r[3] <= d) and (r[4] is None or d <= r[4])]
        want[d] = (len({n for r in live for n in (r[0], r[2])}), len(live))
    assert got == want
    assert graph.graph_size_of_intervals(t.limit(0)).count() == 0


def test_cover_of_concave_outlines_holes_and_shared_sides(spark):
    def inside(x, y, rings):
        odd = 0
        for ring in rings:
            for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
                odd += (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1)
        return odd % 2 == 1

    def star(cx, cy, far, near, n):
        pts = [(cx + (far if i % 2 else near) * math.cos(math.pi * i / n + 0.1), cy + (far if i % 2 else near) * math.sin(math.pi * i / n + 0.1)) for i in range(2 * n)]
        return [*pts, pts[0]]

    res = 5
    shapes = {
        "star": [star(10.03, 20.07, 4.1, 1.3, 60), star(10.03, 20.07, 0.9, 0.5, 7)],
        "open": [[(-3.1, -2.2), (1.4, -2.9), (0.2, 0.3), (2.2, 2.7)]],
        "left": [[(30.0, 5.0), (33.3, 4.1), (33.9, 9.2), (30.5, 8.8)]],
        "right": [[(33.3, 4.1), (38.0, 5.2), (33.9, 9.2)]],
        "both": [[(30.0, 5.0), (33.3, 4.1), (38.0, 5.2), (33.9, 9.2), (30.5, 8.8)]],
    }
    rows = [(n, ("Polygon", [[tuple(p) for p in ring] for ring in rings])) for n, rings in shapes.items()]
    rows += [rows[1], ("line", ("LineString", [[(0.0, 0.0), (5.0, 5.0), (5.0, 0.0)]])), ("none", None), ("empty", ("Polygon", [])), ("bare", ("Polygon", [[]]))]
    df = spark.createDataFrame(rows, f"name string, geom {geo.GEOM_TYPE}")
    got = {}
    for r in grid.hex_cover(df, res).collect():
        got.setdefault(r.name, []).append((r.q, r.r))
    a = hx.basis(res)
    w = complex(0.5, math.sqrt(3) / 2)
    for n, rings in shapes.items():
        xs, ys = [p[0] for ring in rings for p in ring], [p[1] for ring in rings for p in ring]
        corners = [complex(x, y) / a for x in (min(xs), max(xs)) for y in (min(ys), max(ys))]
        rs = [z.imag * 2 / math.sqrt(3) for z in corners]
        qs = [z.real - r / 2 for z, r in zip(corners, rs)]
        want = []
        for q in range(math.floor(min(qs)) - 1, math.ceil(max(qs)) + 2):
            for r in range(math.floor(min(rs)) - 1, math.ceil(max(rs)) + 2):
                c = a * (q + r * w)
                if inside(c.real, c.imag, rings):
                    want.append((q, r))
        assert want and sorted(got[n]) == sorted(want * (2 if n == "open" else 1)), n
    assert set(got) == set(shapes)
    assert sorted(got["left"] + got["right"]) == sorted(got["both"])  # a shared side splits its cells, none twice
