"""Training by local steps: what is stored and moved does not grow with the square of the entities."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.operators import kge, vectors


def _ring(spark, n):
    rows = [(i, i % 2, (i + k) % n) for i in range(n) for k in (1, 2, 5)]
    return spark.createDataFrame(rows, "h bigint, r bigint, t bigint"), spark.range(n), spark.range(2)


@pytest.mark.parametrize("model", ["transe", "complex"])
def test_rounds_do_not_grow_with_the_tasks(spark, monkeypatch, model):
    stored = []
    keep = kge.cut_lineage
    monkeypatch.setattr(kge, "cut_lineage", lambda *a: stored.append(1) or keep(*a))
    counts, last = [], []
    for parts in (2, 12):
        stored.clear()
        losses = kge.train(*_ring(spark, 40), model, 4, 10, 0.2, parts=parts)[2]
        counts.append(len(stored))
        last.append(losses[-1] / losses[0])
    assert counts[0] == counts[1] and max(last) < 1


def test_copies_become_their_weighted_mean(spark):
    rows = [(0, 0, 7, 2, [1.0, 0.0], 3.0), (1, 0, 7, 2, [5.0, 4.0], 1.0), (0, 2, 7, 2, [2.0, 2.0], 0.0), (3, 2, 7, 2, [4.0, 0.0], 0.0),
            (0, 0, 8, 1, [9.0, 9.0], 1.0)]
    done = spark.createDataFrame(rows, kge._ROUND)
    got = {(r.kind, r.id): r.vec for r in kge._mean_of_copies(done, 2, 3).collect()}
    assert set(got) == {(0, 7), (2, 7)}
    assert np.allclose(got[0, 7], [2.0, 1.0]) and np.allclose(got[2, 7], [3.0, 1.0])


def test_a_hub_is_spread_and_its_leaves_are_not(spark):
    rows = [(i, 0, 1000) for i in range(200)] + [(i, 1, 1001) for i in range(200)]
    dealt = kge._deal(spark.createDataFrame(rows, "h bigint, r bigint, t bigint").selectExpr("*", "1.0D w", "0L g"), 8, 14).collect()
    assert len(dealt) == 400
    tasks = {}
    for r in dealt:
        tasks.setdefault(r.h, set()).add(r.task)
        tasks.setdefault(r.t, set()).add(r.task)
    assert all(len(tasks[i]) == 1 for i in range(200)) and len(tasks[1000]) > 4


def test_word_pairs_are_generated_without_nested_functions(spark):
    walks = spark.createDataFrame([(["a", "b", "a", "c"],), (["x"],), ([],), (None,), (["d", None],)], "walk array<string>")
    near = vectors.token_pairs(walks, 1)
    assert "lambda" not in near._jdf.queryExecution().analyzed().toString()
    got = {(r.center, r.context): r.w for r in near.collect()}
    assert got == {("a", "b"): 2, ("b", "a"): 2, ("a", "c"): 1, ("c", "a"): 1, ("d", None): 1, (None, "d"): 1}
    assert {(r.center, r.context): r.w for r in vectors.token_pairs(walks, 5).where("center = 'a' AND context = 'a'").collect()} == {("a", "a"): 2}


@pytest.mark.parametrize("model", ["transe", "complex", "skipgram"])
def test_a_step_moves_by_the_weighted_mean_of_the_slopes(model):
    rng = np.random.default_rng(3)
    width, size, half = 6, 40, 17
    ent, rel = rng.uniform(-0.4, 0.4, (12, width)), rng.uniform(-0.4, 0.4, (3, width))
    h, t, n, r = (rng.integers(0, k, size) for k in (12, 12, 12, 3))
    w, head = rng.uniform(0.5, 2, size), np.arange(size) < half
    if model == "skipgram":
        head[:] = False
    loss, gh, gr, gt, gn = kge._slopes(model, ent[h], rel[r], ent[t], ent[n], w, head)
    want, weight = np.zeros_like(ent), np.zeros(12)
    for index, grads in ((h, gh), (t, gt), (n, gn)):
        np.add.at(want, index, grads)
        np.add.at(weight, index, w)
    turn, used = np.zeros_like(rel), np.bincount(r, w, 3)
    np.add.at(turn, r, gr)
    want, turn = ent - 0.1 * want / np.maximum(weight, 1e-9)[:, None], rel - 0.1 * turn / used[:, None]
    tables = [ent, rel]
    if model == "complex":
        tables = [x[:, :3] + 1j * x[:, 3:] for x in tables]
    got = kge._STEP[model](*tables, h, r, t, n, w, half, 0.1)
    if model == "complex":
        tables = [np.hstack([x.real, x.imag]) for x in tables]
    assert got == pytest.approx(loss) and tables[0] == pytest.approx(want)
    assert model == "skipgram" or tables[1] == pytest.approx(turn)


def test_word_pairs_are_shuffled_in_one_direction_only(spark, monkeypatch):
    rows = [(["a", None, "a", None, "c", "b"],), (["c"],), (["b", "a"],)]
    walks = spark.createDataFrame(rows, "walk array<string>")
    for window in (0, 1, 2, 9):
        want = {}
        for (walk,) in rows:
            for i, x in enumerate(walk):
                for j in range(max(0, i - window), min(len(walk), i + window + 1)):
                    if i != j:
                        want[x, walk[j]] = want.get((x, walk[j]), 0) + 1
        near = vectors.token_pairs(walks, window)
        assert {(r.center, r.context): r.w for r in near.collect()} == want and near.count() == len(want)
    edges = spark.range(500).select(F.array(F.concat(F.lit("s"), "id"), F.lit("p"), F.concat(F.lit("o"), "id")).alias("walk"))
    counted, both = [], vectors._both_directions
    monkeypatch.setattr(vectors, "_both_directions", lambda once, by: counted.append(once.count()) or both(once, by))
    assert vectors.token_pairs(edges).count() == 3_000 and counted == [1_500]


def test_start_vectors_are_not_stored(spark, monkeypatch):
    stored, keep = [], kge.cut_lineage
    monkeypatch.setattr(kge, "cut_lineage", lambda df, *a: stored.append("vec" in df.columns) or keep(df, *a))
    triples, entities, relations = _ring(spark, 12)
    apart = spark.range(12, 15)
    known = spark.createDataFrame([(3, [0.5] * 4), (14, [0.25] * 4)], "id bigint, vec array<double>")
    ent, rel, losses = kge.train(triples, entities.unionByName(apart), relations, "transe", 4, 5, start=known)
    assert len(losses) == 5 and sum(stored) == 3 + 1  # the rounds and the result
    got, start = ({r.id: list(r.vec) for r in x.collect()} for x in (ent, kge._start(apart, 4, 14)))
    assert set(got) == set(range(15)) and got[14] == [0.25] * 4 and rel.count() == 2
    assert got[12] == pytest.approx(start[12], abs=1e-6) and got[13] == pytest.approx(start[13], abs=1e-6)
