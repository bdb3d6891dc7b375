"""Entity vectors: word vectors of walks, alignment across dates, compression per cell."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.operators.scale import reduce_vectors


def wide_vectors(df: DataFrame, d: int, prefix: str = "vector", col: str = "vector") -> DataFrame:
    """Array column to ``d`` numbered columns."""
    rest = [c for c in df.columns if c != col]
    return df.select(*[F.get(col, F.lit(i)).alias(f"{prefix}{i}") for i in range(d)], *rest)


# -- word vectors -------------------------------------------------------------------------------------------------


def train_walk_vectors(
    walks: DataFrame, dim: int = 100, epochs: int = 10, seed: int = 15, window: int = 5, col: str = "walk"
) -> DataFrame:
    """Skip-gram vectors (token, vector) of all tokens of the walks, by the distributed trainer for any vocabulary."""
    from cellweave.operators.kge import train_pairs

    corpus = walks.where(F.size(col) > 0).select(col)
    return train_pairs(token_pairs(corpus, window, col), dim, epochs, seed)[0].select("token", "vector")


def token_pairs(corpus: DataFrame, window: int = 5, col: str = "walk", by: tuple[str, ...] = ()) -> DataFrame:
    """(center, context, w): how often two tokens stand within the window of each other, per value of ``by``."""
    # two plain generators, which Spark compiles; functions nested over the list are evaluated value by value.
    # Two tokens see each other equally often, so a pair is counted once and gets its other direction after the shuffle.
    firsts = corpus.select(*by, F.col(col).alias("_walk"), F.posexplode(col).alias("_i", "_a"))
    later = F.sequence(F.col("_i") + 1, F.least(F.size("_walk") - 1, F.col("_i") + window))
    later = F.when((F.col("_i") < F.size("_walk") - 1) & F.lit(window > 0), later)
    met = firsts.select(*by, "_walk", "_a", F.explode(later).alias("_j")).select(*by, "_a", F.get("_walk", F.col("_j")).alias("_b"))
    turn = F.col("_b").isNull() | (F.col("_a") > F.col("_b"))  # a missing token stands first
    low, high = F.when(turn, F.col("_b")).otherwise(F.col("_a")), F.when(turn, F.col("_a")).otherwise(F.col("_b"))
    once = met.select(*by, low.alias("_low"), high.alias("_high")).groupBy(*by, "_low", "_high").agg(F.count("*").alias("w"))
    return _both_directions(once, list(by))


def _both_directions(once: DataFrame, by: list[str]) -> DataFrame:
    """(center, context, w) of pairs that were counted in one direction; equal tokens see each other twice."""
    same = F.col("_low").eqNullSafe(F.col("_high"))
    w = F.col("w") * F.when(same, 2).otherwise(1)

    def way(center: str, context: str) -> Column:
        return F.struct(F.col(center).alias("center"), F.col(context).alias("context"), w.alias("w"))

    ways = F.when(same, F.array(way("_low", "_high"))).otherwise(F.array(way("_low", "_high"), way("_high", "_low")))
    return once.select(*by, F.inline(ways))


def walk_vectors_by_date(
    walks: DataFrame, mode: str = "independent", dim: int = 100, epochs: int = 10, seed: int = 15, date: str = "DATE"
) -> DataFrame:
    """(DATE, token, vector) for every date of dated walks.

    ``independent`` trains the tokens of each date by themselves, all dates side by side in the same rounds; ``union``
    does so with all walks up to the date; ``aligned`` turns the vectors of each date onto those of the date before.
    ``warm`` goes date by date: each starts from the vectors of the date before, new tokens are seeded, and tokens that
    the date does not have keep their vectors.
    """
    from cellweave.operators.kge import train_pairs
    from cellweave.session import cut_lineage, release

    if mode not in ("independent", "union", "aligned", "warm"):
        raise ValueError(f"mode {mode}")
    dated = walks.where(F.size("walk") > 0).select(F.col(date).alias("DATE"), "walk")
    pairs = cut_lineage(token_pairs(dated, by=("DATE",)))
    dates = [r[0] for r in pairs.select("DATE").distinct().orderBy("DATE").collect()]
    if not dates:
        raise ValueError("no dated walks")
    if mode == "warm":
        out = state = None
        for d in dates:
            state = cut_lineage(train_pairs(pairs.where(F.col("DATE") == d).drop("DATE"), dim, epochs, seed, start=state)[0])
            now = state.select(F.lit(d).alias("DATE"), "token", "vector")
            out = now if out is None else out.unionByName(now)
        return out
    if mode == "union":
        later = F.filter(F.lit(dates), lambda d: d >= F.col("DATE"))
        pairs = pairs.withColumn("DATE", F.explode(later)).groupBy("DATE", "center", "context").agg(F.sum("w").alias("w"))
    trained = train_pairs(pairs, dim, epochs, seed, by=("DATE",))[0].select("DATE", "token", "vector")
    if mode != "aligned":
        return trained
    trained = cut_lineage(trained, ["DATE"])
    release(pairs)
    return align_by_date(trained, dim).select("DATE", "token", "vector")


def entity_vectors(roots: DataFrame, vectors: DataFrame, date: str) -> DataFrame:
    """One row per root with its vector, missing when the token was never seen."""
    v = vectors.select(F.col("token").alias("ID"), "vector")
    return roots.select(F.col("root").alias("ID")).join(v, "ID", "left").withColumn("DATE", F.lit(date))


def shared_vocab(a: DataFrame, b: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """Tokens of both tables (and of the word list, when given) with both vectors."""
    both = a.select("token", F.col("vector").alias("base")).join(b.select("token", F.col("vector").alias("other")), "token")
    return both if words is None else both.join(words.select(F.col(words.columns[0]).alias("token")).distinct(), "token", "left_semi")


def vocab_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Tokens of one table only, with the side they come from."""
    only_a = a.select("token").exceptAll(b.select("token")).withColumn("side", F.lit("a"))
    return only_a.unionByName(b.select("token").exceptAll(a.select("token")).withColumn("side", F.lit("b")))


def vocab_order(counts: DataFrame) -> DataFrame:
    return counts.orderBy(F.desc("cnt"), "token")


# -- alignment ----------------------------------------------------------------------------------------------------


def _matrix(col: pd.Series) -> np.ndarray:
    return np.stack(col.to_numpy()).astype(float)


def _apply(df: DataFrame, fn, out: str = "vector") -> DataFrame:
    """Replace each vector by a function of its batch of rows."""
    names = df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                pdf[out] = list(fn(_matrix(pdf[out])))
            yield pdf

    fields = ", ".join(f"`{f.name}` {'array<double>' if f.name == out else f.dataType.simpleString()}" for f in df.schema)
    return df.select(*names).mapInPandas(run, fields)


def rotation(base: DataFrame, other: DataFrame, dim: int, words: DataFrame | None = None) -> np.ndarray:
    """Orthogonal matrix that turns ``other`` onto ``base`` over shared, length-normalised vectors."""

    def fold(pdf: pd.DataFrame) -> np.ndarray:
        b, o = _matrix(pdf["base"]), _matrix(pdf["other"])
        b /= np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-300)
        o /= np.maximum(np.linalg.norm(o, axis=1, keepdims=True), 1e-300)
        return o.T @ b

    m = reduce_vectors(shared_vocab(base, other, words).select("base", "other"), fold, dim * dim).reshape(dim, dim)
    u, _, vt = np.linalg.svd(m)
    return u @ vt


def procrustes_rotate(base: DataFrame, other: DataFrame, dim: int, words: DataFrame | None = None) -> DataFrame:
    """All of ``other`` turned into the space of ``base``; tokens outside the shared set are turned too."""
    q = rotation(base, other, dim, words)
    return _apply(other.select("token", "vector"), lambda x: x @ q)


def procrustes_full(prev: DataFrame, cur: DataFrame, dim: int) -> tuple[DataFrame, DataFrame, float]:
    """Centre, scale to unit norm, rotate and rescale; returns both tables and the disparity.

    The transformation is fitted on the shared keys and applied to all keys of either table.
    """

    def sums(pdf: pd.DataFrame) -> np.ndarray:
        b, o = _matrix(pdf["base"]), _matrix(pdf["other"])
        return np.concatenate([[len(pdf)], b.sum(0), o.sum(0)])

    both = shared_vocab(prev, cur).select("base", "other")
    first = reduce_vectors(both, sums, 1 + 2 * dim)
    n, mb, mo = first[0], first[1 : 1 + dim] / first[0], first[1 + dim :] / first[0]

    def moments(pdf: pd.DataFrame) -> np.ndarray:
        b, o = _matrix(pdf["base"]) - mb, _matrix(pdf["other"]) - mo
        return np.concatenate([[(b * b).sum(), (o * o).sum()], (b.T @ o).ravel()])

    second = reduce_vectors(both, moments, 2 + dim * dim)
    nb, no = np.sqrt(second[0]), np.sqrt(second[1])
    if n < 2 or nb == 0 or no == 0:
        raise ValueError("alignment needs at least two different shared vectors")
    u, s, vt = np.linalg.svd((second[2:].reshape(dim, dim) / (nb * no)).T)
    q, scale = u @ vt, s.sum()
    first_all, second_all = prev.select("token", "vector"), cur.select("token", "vector")
    return _apply(first_all, lambda x: (x - mb) / nb), _apply(second_all, lambda x: ((x - mo) / no) @ q * scale), float(1 - scale**2)


def align_by_date(vectors: DataFrame, dim: int, mode: str = "rotate") -> DataFrame:
    """Chain of alignments over the dates of a (token, vector, DATE) table, each date onto the one before.

    Every date keeps all of its tokens. With ``mode="full"`` the first date is centred and scaled like the others.
    """
    from cellweave.session import cut_lineage

    dates = [r["DATE"] for r in vectors.select("DATE").distinct().orderBy("DATE").collect()]
    prev, out = None, None
    for i, d in enumerate(dates):
        cur = vectors.where(F.col("DATE") == d).select("token", "vector")
        if mode == "full" and i == 0:
            # onto itself: the identity after centring and scaling
            cur = cut_lineage(procrustes_full(cur, cur, dim)[0])
        elif prev is not None:
            cur = cut_lineage(procrustes_rotate(prev, cur, dim) if mode == "rotate" else procrustes_full(prev, cur, dim)[1])
        prev = cur
        dated = cur.withColumn("DATE", F.lit(d))
        out = dated if out is None else out.unionByName(dated)
    return out


# -- compression --------------------------------------------------------------------------------------------------


def _first_scores(gram: np.ndarray) -> np.ndarray:
    """First principal-component scores from the d x d product of the centred block with itself."""
    w, v = np.linalg.eigh(gram)
    scores = v[:, -1] * np.sqrt(max(w[-1], 0.0))
    return scores if scores[np.argmax(np.abs(scores))] >= 0 else -scores


def _centred_gram(x: np.ndarray) -> np.ndarray:
    """Entities are the features, dimensions the samples: each entity vector loses its own mean."""
    c = x - x.mean(axis=1, keepdims=True)
    return c.T @ c


def pca_compress(df: DataFrame, key: str, dim: int, col: str = "vector") -> DataFrame:
    """One ``dim``-vector per key: first-component scores of the block of its vectors; single rows pass through.

    Only the d x d product of the block is needed, and it is a sum over rows: vectors are summed batch by batch where
    they lie, then in two levels, so no key is ever gathered whole.
    """
    data = df.select(F.col(key), F.col(col).cast("array<double>").alias("v"))
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, n bigint, one array<double>, gram array<double>"

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, len(g), g["v"].iloc[0], _centred_gram(_matrix(g["v"])).ravel()) for k, g in pdf.groupby(key, dropna=False)]
            if rows:
                yield pd.DataFrame(rows, columns=[key, "n", "one", "gram"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        row = (pdf[key].iloc[0], int(pdf["n"].sum()), pdf["one"].iloc[0], np.sum(_matrix(pdf["gram"]), axis=0))
        return pd.DataFrame([row], columns=[key, "n", "one", "gram"])

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        total = add(pdf).iloc[0]
        vector = np.asarray(total["one"], dtype=float) if total["n"] == 1 else _first_scores(np.asarray(total["gram"]).reshape(dim, dim))
        return pd.DataFrame({key: [pdf[key].iloc[0]], "vector": [vector]})

    slots = data.mapInPandas(partial, schema).withColumn("_slot", F.pmod(F.spark_partition_id(), F.lit(64)))
    level = slots.groupBy(key, "_slot").applyInPandas(lambda pdf: add(pdf), schema)
    out = f"`{key}` {df.schema[key].dataType.simpleString()}, vector array<double>"
    return level.groupBy(key).applyInPandas(finish, out)


def select_cell_vectors(vectors: DataFrame, grid: DataFrame, date: str, dim: int, grid_id: str = "cell_id") -> DataFrame:
    """Wide vectors of the grid cells, stamped with their date."""
    cells = grid.select(F.col(grid_id).alias("token")).distinct()
    kept = vectors.join(cells, "token", "left_semi").select("vector", F.col("token").alias("ID")).withColumn("DATE", F.lit(date))
    return wide_vectors(kept, dim)


def map_to_grid(mapper: DataFrame, grid: DataFrame, prefix: str = "") -> DataFrame:
    """Feature-to-cell rows whose cell is in the grid."""
    kept = mapper.join(grid.select("cell_id").distinct(), "cell_id", "left_semi").na.drop()
    return kept.select("cell_id", F.concat(F.lit(prefix), F.col("osm_id").cast("string")).alias("ID"))


def lift_to_cells(vectors: DataFrame, mapper: DataFrame, grid: DataFrame, dim: int, prefix: str = "") -> DataFrame:
    """Vectors of mapped objects compressed to one vector per cell."""
    bridge = map_to_grid(mapper, grid, prefix)
    lifted = vectors.select(F.col("token").alias("ID"), "vector").join(bridge, "ID").select("cell_id", "vector")
    return pca_compress(lifted, "cell_id", dim).withColumnRenamed("cell_id", "ID")
