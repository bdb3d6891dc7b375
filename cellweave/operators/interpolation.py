"""Point measurements to grid cells: inverse distance, kriging and splines for all dates and variables at once.

Stations are long rows (date, variable, station, lon, lat, value). Date and variable are grouping keys, so there
is no loop over them. A prediction sums over all stations of its date; stations and cells travel as blocks of bounded
size that meet by an equi-join, and a task folds a pair of blocks as one matrix of distances: pairs never become
rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.functions import geo
from cellweave.functions.values import clamp_round
from cellweave.operators import solver
from cellweave.operators.panel import first_per_group, invalid_predictions, repair_predictions, within_bounds
from cellweave.operators.scale import BLOCK_ROWS, parallelism, pinned, replicate_over, shard_of, with_block
from cellweave.operators.solver import packed
from cellweave.session import cut_lineage

KEYS = ["date", "variable"]

# Powers tried by the inverse-distance choice.
POWERS = [0.1, 0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 3.5, 4.0, 4.5, 5.0]

# Trend terms; a formula is any combination of them, or the constant.
TREND_TERMS = {"LONGITUDE + LATITUDE": ["lon", "lat"], "ELEVATION": ["elevation"], "COASTDISTANCE": ["coast"]}

# A date and variable with so many stations is solved by a pseudo-inverse.
DENSE_STATIONS = 2000

# With so many by one factorisation in place, in one task (at most 0.5 GB); larger ones by elimination over tiles.
TASK_STATIONS = 8192

# Cells of a block, on average.
CELL_ROWS = 512

# Stations of a block that meets other blocks: a block is copied once per block, so these are larger; a task folds them by tiles.
PAIR_ROWS = 8192

# Random signs that estimate the diagonal of a large inverse; each colours every so-many-th station along the quad order.
PROBES = 32


def clean_stations(stations: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """Values inside their range, one row per station and date, one station per place."""
    s = within_bounds(stations, bounds) if bounds is not None else stations.where("value IS NOT NULL AND NOT isnan(value)")
    rest = [c for c in s.columns if c not in (*KEYS, "station")]
    s = first_per_group(s, [*KEYS, "station"], rest)
    return first_per_group(s, [*KEYS, "lon", "lat"], ["station"])


def _located(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, pinned(geo.unit_vector(F.col("lon"), F.col("lat"))))


def _blocks(stations: DataFrame, item: Column, *extra: Column, rows: int = BLOCK_ROWS) -> DataFrame:
    split = with_block(stations, KEYS, ["station"], rows)
    return split.groupBy(*KEYS, "blocks", "block").agg(F.collect_list(item).alias("items"), *extra)


def _spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """Partitioned by key into a number of partitions that stays: small rows here stand for much arithmetic."""
    return df.repartition(4 * parallelism(df), *keys)


def _cell_blocks(cells: DataFrame) -> tuple[DataFrame, int, int]:
    """Cells (cell_id, c and more) packed as ``cells`` by shard, copied to all salts; the numbers of shards and salts."""
    shards, salts = max(1, math.ceil(cells.count() / CELL_ROWS)), parallelism(cells)
    packed_ = cells.withColumn("_shard", shard_of(["cell_id"], shards)).groupBy("_shard").agg(F.collect_list(F.struct(*cells.columns)).alias("cells"))
    return packed_.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), shards, salts


def _at_cells(cells: DataFrame, blocks: DataFrame, fold: Callable[[dict, dict, np.ndarray], list[pa.Array]], new: str) -> DataFrame:
    """Every block of cells with every block of stations: ``fold(cells, row, angles)`` gives the new columns, one entry per cell.

    A fragment-replicate equi-join on (shard of the cells, salt of the stations): stations are copied once per shard of
    cells, cells once per salt.
    """
    packed_, shards, salts = _cell_blocks(cells)
    salted = blocks.withColumn("_salt", F.pmod(F.xxhash64(*KEYS, "block"), F.lit(salts)).cast("int"))
    at = ["_shard", "_salt"]
    pairs = _spread(packed_, at).join(_spread(replicate_over(salted, shards), at), at)
    names = [x.split()[0] for x in new.split(", ")]
    extra = [c for c in blocks.columns if c not in (*KEYS, "block", "blocks", "items")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                at = _columns(batch.column("cells")[i].values)
                row = _columns(batch.column("items")[i].values) | {c: batch.column(c)[i].as_py() for c in extra}
                d = _distances(_xyz(at["c"]), _xyz(row["p"]))
                keys = [pa.array([batch.column(k)[i].as_py()] * len(d), batch.schema.field(k).type) for k in KEYS]
                yield pa.RecordBatch.from_arrays([at["cell_id"], *keys, *fold(at, row, d)], ["cell_id", *KEYS, *names])

    schema = ", ".join(f"`{c}` {t.schema[c].dataType.simpleString()}" for c, t in [("cell_id", cells), *[(k, blocks) for k in KEYS]])
    return pairs.select("cells", "items", *KEYS, *extra).mapInArrow(run, f"{schema}, {new}")


def _columns(items: pa.StructArray) -> dict[str, pa.Array]:
    return dict(zip([f.name for f in items.type], items.flatten()))


def _xyz(p: pa.StructArray) -> list[np.ndarray]:
    return [x.to_numpy(zero_copy_only=False) for x in p.flatten()]


def _arrays(items: pa.StructArray) -> dict:
    """Stations of a block of pairs: ids, places and values."""
    row = _columns(items)
    return {"id": row["id"].to_numpy(zero_copy_only=False), "p": _xyz(row["p"]), "v": row["v"].to_numpy()}


def _cut(row: dict, at: slice) -> dict:
    return {"id": row["id"][at], "p": [x[at] for x in row["p"]], "v": row["v"][at]}


def _distances(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Angles between all unit vectors of two lists; one without a place is as far as can be."""
    gap = (a[0][:, None] - b[0]) ** 2
    for u, v in zip(a[1:], b[1:]):
        gap += (u[:, None] - v) ** 2
    np.sqrt(gap, out=gap)
    gap /= 2
    np.fmin(gap, 1.0, out=gap)
    np.arcsin(gap, out=gap)
    gap *= 2
    return gap


def _weights_of(d: np.ndarray, powers: list[float]) -> Iterator[np.ndarray]:
    """d ** -power for each power, 0 at distance zero; whole and half powers are products of inverse square roots."""
    with np.errstate(divide="ignore"):
        root, product, factors = np.where(d > 0, 1 / np.sqrt(d), 0.0), None, 0
        for power in powers:
            steps = 2 * power
            if steps != int(steps) or not 0 < steps <= 32:
                yield np.where(d > 0, d**-power, 0.0)
                continue
            if product is None or factors > steps:
                product, factors = root.copy(), 1
            while factors < steps:
                product *= root
                factors += 1
            yield product


def _idw_value(num: str = "num", den: str = "den") -> Column:
    return F.when(F.sum("hits") > 0, F.try_divide(F.sum("hit"), F.sum("hits"))).otherwise(F.try_divide(F.sum(num), F.sum(den)))


def idw(stations: DataFrame, cells: DataFrame, power: float | DataFrame = 2.0) -> DataFrame:
    """Inverse-distance weighting to every cell for every date and variable.

    ``power`` is a number or a table (date, variable, power). A cell at a station takes the station's value.
    """
    item = F.struct(F.col("p").alias("p"), F.col("value").cast("double").alias("v"))
    blocks = _blocks(_located(clean_stations(stations), "p"), item)
    if isinstance(power, DataFrame):
        blocks = blocks.join(power.select(*KEYS, "power"), KEYS, "left").withColumn("power", F.coalesce(F.col("power"), F.lit(1.0)))
    else:
        blocks = blocks.withColumn("power", F.lit(float(power)))

    def fold(at: dict, row: dict, d: np.ndarray) -> list[pa.Array]:
        v, w, here = row["v"].to_numpy(), next(_weights_of(d, [row["power"]])), (~(d > 0)).astype(float)
        return [pa.array(x) for x in (w @ v, w.sum(1), here @ v, here.sum(1))]

    folded = _at_cells(_located(cells.select("cell_id", "lon", "lat"), "c").select("cell_id", "c"), blocks, fold, _SUMS)
    return folded.groupBy("cell_id", *KEYS).agg(_idw_value().alias("value"))


_SUMS = "num double, den double, hit double, hits double"


def _block_pairs(stations: DataFrame, once: bool) -> DataFrame:
    """Pairs of blocks of one date and variable, ``items`` of block ``b`` and ``others`` of block ``c``; ``once``: only c >= b.

    The copies of all blocks meet block b in one place, so a task sees them one after the other, and a date with very
    many stations is spread over as many join keys as it has blocks. What is copied grows with stations x blocks.
    """
    item = F.struct(F.col("station").alias("id"), F.col("p").alias("p"), F.col("value").cast("double").alias("v"))
    blocks = cut_lineage(_blocks(_located(stations, "p"), item, rows=PAIR_ROWS))
    upto = F.col("block") if once else F.col("blocks") - 1
    copies = blocks.select(*KEYS, F.col("block").alias("c"), F.col("items").alias("others"), F.explode(F.sequence(F.lit(0), upto)).alias("b"))
    mine = blocks.select(*KEYS, F.col("block").alias("b"), "items")
    return _spread(mine, [*KEYS, "b"]).join(_spread(copies, [*KEYS, "b"]), [*KEYS, "b"])


def _stretches(n: int) -> list[slice]:
    return [slice(lo, lo + BLOCK_ROWS) for lo in range(0, n, BLOCK_ROWS)]


def _key_fields(df: DataFrame) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in KEYS)


def idw_power(stations: DataFrame, powers: list[float] = POWERS) -> DataFrame:
    """Leave-one-out error of every power, and the best power, per date and variable."""
    pairs = _block_pairs(clean_stations(stations), False)
    tried = [f"{x}{i}" for i in range(len(powers)) for x in ("num", "den")]
    powers = [float(p) for p in powers]

    def tile(left: dict, right: dict, same: bool) -> np.ndarray:
        v, out = right["v"], []
        d = _distances(left["p"], right["p"])
        here = ~(d > 0)
        if same:
            ids = left["id"][:, None] == right["id"]
            d[ids], here[ids] = 0.0, False
        for w in _weights_of(d, powers):
            out += [w @ v, w.sum(1)]
        here = here.astype(float)
        return np.stack([*out, here @ v, here.sum(1)])

    def sums(row: tuple) -> np.ndarray:
        left, right = _arrays(row[0]), _arrays(row[1])
        total = np.zeros((len(tried) + 2, len(left["v"])))
        for a in _stretches(len(left["v"])):
            for b in _stretches(len(right["v"])):
                total[:, a] += tile(_cut(left, a), _cut(right, b), row[2])
        return total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the copies that meet one block stand together and are added up before they leave the task
        last = total = None
        for batch in batches:
            for i in range(batch.num_rows):
                key = [batch.column(k)[i].as_py() for k in (*KEYS, "b")]
                items = batch.column("items")[i].values
                ids = _columns(items)["id"]
                if last is None or key != last[0] or not ids.equals(last[1]):
                    if last is not None:
                        yield emit(last, total, batch.schema)
                    last, total = (key, ids, _columns(items)["v"]), 0.0
                total = total + sums((items, batch.column("others")[i].values, batch.column("b")[i].as_py() == batch.column("c")[i].as_py()))
        if last is not None:
            yield emit(last, total, batch.schema)

    def emit(last: tuple, total: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
        key, ids, v = last
        keys = [pa.array([x] * len(ids), schema.field(k).type) for k, x in zip(KEYS, key)]
        return pa.RecordBatch.from_arrays([*keys, ids, v, *map(pa.array, total)], [*KEYS, "station", "value", *tried, "hit", "hits"])

    fields = ", ".join(f"{c} double" for c in [*tried, "hit", "hits"])
    rows = pairs.mapInArrow(run, f"{_key_fields(stations)}, station {stations.schema['station'].dataType.simpleString()}, value double, {fields}")
    preds = [_idw_value(f"num{i}", f"den{i}").alias(f"p{i}") for i in range(len(powers))]
    left_out = rows.groupBy(*KEYS, "station", "value").agg(*preds)
    errors = [F.sqrt(F.avg((F.col("value") - F.col(f"p{i}")) * (F.col("value") - F.col(f"p{i}")))) for i in range(len(powers))]
    scored = [F.when(e.isNotNull(), F.struct(e.alias("rmse"), F.lit(p).alias("power"))) for e, p in zip(errors, powers)]
    best = left_out.groupBy(*KEYS).agg(F.array_min(F.array(*scored)).alias("b"))
    return best.select(*KEYS, F.col("b.power").alias("power"), F.col("b.rmse").alias("rmse"))


def variogram(stations: DataFrame, cutoff_m: float, bins: int = 15) -> DataFrame:
    """Empirical variogram: mean half squared difference and pair count per distance bin, each pair once."""
    width = cutoff_m / bins
    pairs = _block_pairs(clean_stations(stations), True)

    def tile(left: dict, right: dict, same: bool) -> np.ndarray:
        d = _distances(left["p"], right["p"]) * geo.EARTH_RADIUS_M
        g = (left["v"][:, None] - right["v"]) ** 2 / 2
        at = np.triu_indices(len(d), 1) if same else (slice(None), slice(None))
        b, g = np.floor(d[at].ravel() / width), g[at].ravel()
        near = b < bins
        b = b[near].astype(int)
        return np.stack([np.bincount(b, g[near], bins), np.bincount(b, None, bins)])

    def sums(items: pa.StructArray, others: pa.StructArray, same: bool) -> np.ndarray:
        left = _arrays(items)
        right, total = left if same else _arrays(others), np.zeros((2, bins))
        for a in _stretches(len(left["v"])):
            for b in _stretches(len(right["v"])):
                if not same or b.start >= a.start:
                    total += tile(_cut(left, a), _cut(right, b), same and a.start == b.start)
        return total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple, np.ndarray] = {}
            for i in range(batch.num_rows):
                key = tuple(batch.column(k)[i].as_py() for k in KEYS)
                part = sums(batch.column("items")[i].values, batch.column("others")[i].values, batch.column("b")[i].as_py() == batch.column("c")[i].as_py())
                found[key] = found.get(key, 0.0) + part
            for key, total in found.items():
                keys = [pa.array([x] * bins, batch.schema.field(k).type) for k, x in zip(KEYS, key)]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(np.arange(bins, dtype=np.int32)), pa.array(total[0]), pa.array(total[1].astype(np.int64))], [*KEYS, "bin", "g", "n"])

    rows = pairs.mapInArrow(run, f"{_key_fields(stations)}, bin int, g double, n bigint").where("n > 0")
    return rows.groupBy(*KEYS, "bin").agg((F.sum("g") / F.sum("n")).alias("gamma"), F.sum("n").alias("pairs"))


# -- group solves -------------------------------------------------------------------------------------------------


def _shape(model: str, h: np.ndarray, a: float) -> np.ndarray:
    """Unit variogram: 0 at distance zero, towards 1 beyond the range."""
    r = h / a
    if model == "Sph":
        return np.where(r < 1, 1.5 * r - 0.5 * r**3, 1.0)
    if model == "Exp":
        return 1 - np.exp(-r)
    return 1 - np.exp(-(r**2))


def _angles(pdf: pd.DataFrame) -> np.ndarray:
    lo, la = np.radians(pdf["lon"].to_numpy()), np.radians(pdf["lat"].to_numpy())
    p = np.column_stack([np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la)])
    gap = np.sqrt(np.maximum(((p[:, None, :] - p[None, :, :]) ** 2).sum(-1), 0))
    return 2 * np.arcsin(np.minimum(1, gap / 2))


def _fit_variogram(h: np.ndarray, resid: np.ndarray) -> tuple[str, float, float, float]:
    """Model, nugget, partial sill and range by weighted least squares over a grid of ranges."""
    i, j = np.triu_indices(len(resid), 1)
    d, g = h[i, j], (resid[i] - resid[j]) ** 2 / 2
    top = d.max()
    keep = d <= top / 2 if (d <= top / 2).sum() >= 3 else d <= top
    best = _fit_bins(_bins(d[keep], g[keep], d[keep].max()), top)
    return best or ("Exp", float(resid.var()), 0.0, float(top))


def _bins(d: np.ndarray, g: np.ndarray, reach: float) -> np.ndarray:
    """Pairs, summed distances and summed half squared differences of 12 equal classes of distance."""
    at = np.minimum((d / (reach + 1e-15) * 12).astype(int), 11)
    return np.stack([np.bincount(at, x, 12) for x in (np.ones(len(d)), d, g)])


def _fit_bins(bins: np.ndarray, top: float) -> tuple[str, float, float, float] | None:
    n = bins[0]
    ok = n > 0
    hb, gb = bins[1][ok] / n[ok], bins[2][ok] / n[ok]
    w = n[ok] / np.maximum(hb, 1e-12) ** 2
    best = None
    for model in ("Sph", "Exp", "Gau"):
        for a in np.linspace(0.05, 1.0, 20) * top:
            x = np.column_stack([np.ones_like(hb), _shape(model, hb, a)])
            for cols in ([0, 1], [1], [0]):
                c = np.zeros(2)
                c[cols] = np.linalg.lstsq(x[:, cols] * np.sqrt(w)[:, None], gb * np.sqrt(w), rcond=None)[0]
                if (c >= 0).all():
                    err = (w * (x @ c - gb) ** 2).sum()
                    if best is None or err < best[0] - 1e-15:
                        best = (err, model, c[0], c[1], a)
    return best[1:] if best else None


def _design(pdf: pd.DataFrame, terms: list[str]) -> np.ndarray:
    return np.column_stack([np.ones(len(pdf)), *[pdf[c].to_numpy(float) for c in terms]])


def _krige_system(pdf: pd.DataFrame, terms: list[str]):
    """Covariance system of one date and variable: (model, inverse of the bordered matrix or None, trend)."""
    z, f = pdf["value"].to_numpy(float), _design(pdf, terms)
    beta = np.linalg.lstsq(f, z, rcond=None)[0]
    resid = z - f @ beta
    if len(z) < 3 or np.allclose(resid, 0, atol=1e-12 * max(1.0, np.abs(z).max())):
        return ("Exp", 0.0, 0.0, 1.0), None, beta
    h = _angles(pdf)
    model = _fit_variogram(h, resid)
    name, nugget, psill, a = model
    if nugget + psill <= 0:
        return ("Exp", 0.0, 0.0, 1.0), None, beta
    c = psill * (1 - _shape(name, h, a))
    c[h == 0] = nugget + psill
    n, k = len(z), f.shape[1]
    full = np.zeros((n + k, n + k))
    full[:n, :n], full[:n, n:], full[n:, :n] = c, f, f.T
    return model, np.linalg.pinv(full, hermitian=True), beta


_WEIGHTS = "date {d}, variable string, station string, lon double, lat double, w double, model string, nugget double, psill double, rng double, beta array<double>"


def _weights_schema(df: DataFrame) -> str:
    return _WEIGHTS.format(d=df.schema["date"].dataType.simpleString())


def _by_size(stations: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Clean stations of groups for one task, and those of larger groups (none: no such group)."""
    sizes = stations.groupBy(*KEYS).count()
    large = sizes.where(F.col("count") > TASK_STATIONS).select(*KEYS)
    if large.isEmpty():
        return stations, None
    return stations.join(large, KEYS, "left_anti"), cut_lineage(stations.join(large, KEYS, "left_semi"))


def _emit_weights(pdf: pd.DataFrame, w: np.ndarray, beta: np.ndarray, model: tuple) -> pd.DataFrame:
    name, nugget, psill, a = model
    return pd.DataFrame(
        {
            "date": pdf["date"], "variable": pdf["variable"], "station": pdf["station"].astype(str),
            "lon": pdf["lon"], "lat": pdf["lat"], "w": w, "model": name, "nugget": float(nugget), "psill": float(psill),
            "rng": float(a), "beta": [list(map(float, beta))] * len(pdf),
        }
    )


def evaluate(weights: DataFrame, cells: DataFrame, terms: list[str]) -> DataFrame:
    """Predictions of solved groups at every cell: trend plus weighted kernel sum, block by block."""
    terms = list(terms)
    params = F.struct("model", "nugget", "psill", "rng", "beta")
    item = F.struct(F.col("p").alias("p"), F.col("w").alias("w"))
    blocks = _blocks(_located(weights, "p"), item, F.min(params).alias("m"))
    at = _located(cells.select("cell_id", *dict.fromkeys(["lon", "lat", *terms])), "c")
    at = at.select("cell_id", "c", *[F.col(t).cast("double").alias(f"t{i}") for i, t in enumerate(terms)])

    def fold(at: dict, row: dict, d: np.ndarray) -> list[pa.Array]:
        m = row["m"]
        # the smoothing of a spline stands on the diagonal of its system only
        part = solver.kernel(m["model"], d, 0.0 if m["model"] == "Tps" else m["nugget"], m["psill"], m["rng"]) @ row["w"].to_numpy()
        trend, missing = np.full(len(d), float(m["beta"][0])), np.zeros(len(d), bool)
        for i in range(len(terms)):
            trend = trend + m["beta"][i + 1] * at[f"t{i}"].to_numpy(zero_copy_only=False)
            missing |= at[f"t{i}"].is_null().to_numpy(zero_copy_only=False)
        return [pa.array(part), pa.array(trend, mask=missing)]

    rows = _at_cells(at, blocks, fold, "s double, t double")
    return rows.groupBy("cell_id", *KEYS).agg((F.sum("s") + F.min("t")).alias("value"))


def krige(stations: DataFrame, cells: DataFrame, terms: list[str] = ()) -> DataFrame:
    """Kriging with constant or linear trend for any number of stations; predictions distributed.

    Up to ``TASK_STATIONS`` stations of a date and variable are solved in one task, more by elimination over tiles.
    """
    terms, dense = list(terms), DENSE_STATIONS

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("station").reset_index(drop=True)
        if len(pdf) > dense:
            model, w, beta, _ = _lean_krige(pdf, terms)
            return _emit_weights(pdf, np.zeros(len(pdf)) if w is None else w, beta, model)
        model, inv, beta = _krige_system(pdf, terms)
        w = np.zeros(len(pdf))
        if inv is not None:
            sol = inv @ np.concatenate([pdf["value"].to_numpy(float), np.zeros(len(terms) + 1)])
            w, beta = sol[: len(pdf)], sol[len(pdf) :]
        return _emit_weights(pdf, w, beta, model)

    need = list(dict.fromkeys([*KEYS, "station", "lon", "lat", "value", *terms]))
    small, large = _by_size(clean_stations(stations.select(*need)))
    solved = _spread(small, KEYS).groupBy(*KEYS).applyInPandas(solve, _weights_schema(stations))
    if large is not None:
        blocks = _fitted(packed(large, KEYS, terms), KEYS, len(terms) + 1)
        solved = solved.unionByName(_weights(_solved(blocks, KEYS, len(terms) + 1), KEYS, _weights_schema(stations)))
    return evaluate(solved, cells, terms)


# -- groups of a task -------------------------------------------------------------------------------------------------


def _lean_places(pdf: pd.DataFrame) -> np.ndarray:
    lo, la = np.radians(pdf["lon"].to_numpy(float)), np.radians(pdf["lat"].to_numpy(float))
    return np.column_stack([np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la)])


def _lean_fit(p: np.ndarray, resid: np.ndarray) -> tuple[str, float, float, float]:
    """The model of :func:`_fit_variogram`, with the pairs taken by stretches of rows."""

    def stretches():
        for lo in range(0, len(p), solver.BLOCK):
            d = _distances(list(p[lo : lo + solver.BLOCK].T), list(p[lo:].T))
            yield lo, d, np.arange(d.shape[1]) > np.arange(len(d))[:, None]

    top = max(d.max() for _, d, _ in stretches())
    near = [(d[on & (d <= top / 2)].max(initial=0.0), (on & (d <= top / 2)).sum()) for _, d, on in stretches()]
    reach = max(far for far, _ in near) if sum(n for _, n in near) >= 3 else top
    bins = np.zeros((3, 12))
    for lo, d, on in stretches():
        on &= d <= reach
        g = (resid[lo : lo + len(d), None] - resid[lo:]) ** 2 / 2
        bins += _bins(d[on], g[on], reach)
    return _fit_bins(bins, top) or ("Exp", float(resid.var()), 0.0, float(top))


def _filled(p: np.ndarray, model: tuple) -> np.ndarray:
    """Kernel matrix of a model, by stretches of rows."""
    c = np.empty((len(p), len(p)))
    for lo in range(0, len(p), solver.BLOCK):
        c[lo : lo + solver.BLOCK] = solver.kernel(model[0], _distances(list(p[lo : lo + solver.BLOCK].T), list(p.T)), *model[1:])
    return c


class _Factor:
    """Cholesky factorisation of a covariance matrix in place, by tiles, inside one task.

    Covariances in angles need not be positive definite; those that are not are solved with pivoting.
    """

    def __init__(self, p: np.ndarray, model: tuple):
        self.c, self.at = _filled(p, model), [(lo, min(lo + solver.BLOCK, len(p))) for lo in range(0, len(p), solver.BLOCK)]
        self._diagonal(model)
        self.definite = self._eliminate()
        if not self.definite:
            self.c = _filled(p, model)
            self._diagonal(model)

    def _diagonal(self, model: tuple) -> None:
        self.c[np.diag_indices(len(self.c))] += solver.JITTER * max(model[1] + model[2], 1e-300)

    def _eliminate(self) -> bool:
        c = self.c
        for lo, hi in self.at:
            try:
                c[lo:hi, lo:hi] = np.linalg.cholesky(c[lo:hi, lo:hi])
            except np.linalg.LinAlgError:
                return False
            c[lo:hi, hi:] = line = np.linalg.solve(c[lo:hi, lo:hi], c[lo:hi, hi:])
            for a, b in self.at:
                if a >= hi:
                    c[a:b, a:] -= line[:, a - hi : b - hi].T @ line[:, a - hi :]
        return True

    def _forward(self, rhs: np.ndarray, first: int = 0) -> np.ndarray:
        """Rows before ``first`` of the right-hand sides are zero."""
        y = rhs.copy()
        for lo, hi in self.at:
            if lo >= first:
                y[lo:hi] = np.linalg.solve(self.c[lo:hi, lo:hi], y[lo:hi] - self.c[first:lo, lo:hi].T @ y[first:lo])
        return y

    def solve(self, rhs: np.ndarray) -> np.ndarray:
        if not self.definite:
            return np.linalg.solve(self.c, rhs)
        x = self._forward(rhs)
        for lo, hi in reversed(self.at):
            x[lo:hi] = np.linalg.solve(self.c[lo:hi, lo:hi].T, x[lo:hi] - self.c[lo:hi, hi:] @ x[hi:])
        return x

    def inverse_diagonal(self) -> np.ndarray:
        if not self.definite:
            return np.diag(np.linalg.inv(self.c)).copy()
        out = np.empty(len(self.c))
        for lo, hi in self.at:
            unit = np.zeros((len(self.c), hi - lo))
            unit[np.arange(lo, hi), np.arange(hi - lo)] = 1.0
            out[lo:hi] = (self._forward(unit, lo) ** 2).sum(0)
        return out


def _lean_solution(factor: _Factor, z: np.ndarray, f: np.ndarray, diagonal: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Weights, trend and, if asked for, the diagonal of the inverse of the bordered matrix; see ``finish`` of :func:`_solved`."""
    x = factor.solve(np.column_stack([z, f]))
    gram = f.T @ x[:, 1:]
    size = np.sqrt(np.maximum(np.abs(np.diag(gram)), 1e-300))
    inverse = np.linalg.pinv(gram / np.outer(size, size), rcond=1e-13) / np.outer(size, size)
    beta = inverse @ (f.T @ x[:, 0])
    w = x[:, 0] - x[:, 1:] @ beta
    if not diagonal:
        return w, beta, None
    return w, beta, factor.inverse_diagonal() - ((x[:, 1:] @ inverse) * x[:, 1:]).sum(1)


def _lean_krige(pdf: pd.DataFrame, terms: list[str], diagonal: bool = False) -> tuple[tuple, np.ndarray | None, np.ndarray, np.ndarray | None]:
    """(model, weights or None, trend, diagonal) of one date and variable."""
    z, f = pdf["value"].to_numpy(float), _design(pdf, terms)
    beta = np.linalg.lstsq(f, z, rcond=None)[0]
    resid = z - f @ beta
    flat = ("Exp", 0.0, 0.0, 1.0)
    if len(z) < 3 or np.allclose(resid, 0, atol=1e-12 * max(1.0, np.abs(z).max())):
        return flat, None, beta, None
    p = _lean_places(pdf)
    model = _lean_fit(p, resid)
    if model[1] + model[2] <= 0:
        return flat, None, beta, None
    return _with_jitter(*model), *_lean_solution(_Factor(p, model), z, f, diagonal)


def _with_jitter(name: str, nugget: float, psill: float, rng: float) -> tuple[str, float, float, float]:
    """The model that was solved: what stood on the diagonal belongs to a station's own place, so predictions there stay exact."""
    return name, nugget if name == "Tps" else nugget + solver.JITTER * (nugget + psill), psill, rng


def _lean_spline(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The spline of :func:`tps` without further matrices: the kernel is freed of the trend where it stands."""
    z, f, p = pdf["value"].to_numpy(float), _design(pdf, ["lon", "lat"]), _lean_places(pdf)
    n, spline = len(z), ("Tps", 0.0, 0.0, 1.0)
    stretches = [slice(lo, lo + solver.BLOCK) for lo in range(0, n, solver.BLOCK)]
    top = max(_distances(list(p[at].T), list(p.T)).max() for at in stretches)
    u, size, _ = np.linalg.svd(f, full_matrices=False)
    q = u[:, size > size.max() * n * np.finfo(float).eps]
    k = _filled(p, spline)
    against = q.T @ k
    for at in stretches:
        k[at] -= q[at] @ against
    against = k @ q
    for at in stretches:
        k[at] -= against[at] @ q.T
    vals, vecs = np.linalg.eigh(k)
    del k
    vals = np.maximum(vals, 0)
    part = vecs.T @ (z - q @ (q.T @ z))
    best = (np.inf, 1e-8)
    for lam in _smoothings(n, top):
        shrink = lam / (vals + lam)
        tr = shrink.sum() - q.shape[1]  # the trend's own directions are never shrunk
        gcv = n * ((shrink * part) ** 2).sum() / tr**2 if tr > 0 else np.inf
        best = min(best, (gcv, lam))
    w = vecs @ (part / (vals + best[1]))
    del vecs
    w -= q @ (q.T @ w)
    bent = np.concatenate([solver.kernel("Tps", _distances(list(p[at].T), list(p.T)), *spline[1:]) @ w for at in stretches])
    return w, np.linalg.lstsq(f, z - bent - best[1] * w, rcond=None)[0]


# -- groups larger than a task ------------------------------------------------------------------------------------


def _doubles(cell: bytes, *shape: int) -> np.ndarray:
    return np.frombuffer(cell, np.float64).reshape(*shape)


def _grouped(df: DataFrame, keys: list[str], fn, new: str) -> DataFrame:
    """Add columns to one-row groups by a function of the row."""
    types = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    names = [x.split()[0] for x in new.split(", ")]

    def run(batches):
        for pdf in batches:
            rows = [fn(r) for r in pdf.to_dict("records")]
            yield pd.concat([pdf[keys], pd.DataFrame(rows, columns=names, index=pdf.index)], axis=1)

    return df.mapInPandas(run, f"{types}, {new}")


def _fitted(blocks: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Blocks with the residuals of the trend and the variogram model of their group; ``flat`` if there is none to fit."""
    moments = "dots array<double>"

    def dots(r: dict) -> dict:
        f, z = _doubles(r["trend"], -1, k), _doubles(r["value"], -1)
        return {"dots": [*(f.T @ f).ravel(), *(f.T @ z), *np.array([(z * z).sum()])]}

    def trend(r: dict) -> tuple:
        m = np.asarray(r["t"])
        gram, fz = m[: k * k].reshape(k, k), m[k * k : k * k + k]
        size = np.sqrt(np.maximum(np.diag(gram), 1e-300))
        return (list(np.linalg.pinv(gram / np.outer(size, size), hermitian=True) @ (fz / size) / size),)

    def rest(r: dict) -> dict:
        z = _doubles(r["value"], -1)
        resid = z - _doubles(r["trend"], -1, k) @ np.asarray(r["beta"])
        return {"resid": resid.tobytes(), "dots": [float((resid**2).sum()), float(np.abs(resid).max()), float(np.abs(z).max())]}

    sums = solver.group_sum(solver._mapped(blocks, dots, moments), keys, "dots", "t")
    blocks = blocks.join(_grouped(sums, keys, trend, "beta array<double>"), keys)
    blocks = cut_lineage(solver._mapped(blocks, rest, f"resid binary, {moments}"))
    facts = [F.sum(F.get("dots", F.lit(0))).alias("square"), F.max(F.get("dots", F.lit(1))).alias("off"), F.max(F.get("dots", F.lit(2))).alias("size")]
    spread = cut_lineage(blocks.groupBy(*keys).agg(*facts, F.max("n").alias("n")))
    # nothing is left to fit where the trend meets all values: no pair is looked at
    met = F.col("off") <= 1e-12 * F.greatest(F.lit(1.0), F.col("size"))
    even = {"model": F.lit("Exp"), "nugget": F.lit(1.0), "psill": F.lit(0.0), "rng": F.lit(1.0), "flat": F.lit(True)}
    flat = blocks.join(spread.where(met).select(*keys), keys, "left_semi").drop("dots").withColumns(even)
    spread = spread.where(~met)
    blocks = cut_lineage(blocks.join(spread.select(*keys), keys, "left_semi").drop("dots"))
    if blocks.isEmpty():
        return cut_lineage(flat)

    def pairs(left: dict, right: dict, same: bool) -> tuple[np.ndarray, np.ndarray]:
        d = solver.angles(_doubles(left["place"], -1, 3), _doubles(right["place"], -1, 3))
        g = (_doubles(left["resid"], -1)[:, None] - _doubles(right["resid"], -1)[None, :]) ** 2 / 2
        at = np.triu_indices(len(d), 1) if same else (slice(None), slice(None))
        return d[at].ravel(), g[at].ravel()

    def widest(left: dict, right: dict, same: bool) -> np.ndarray:
        return np.array([pairs(left, right, same)[0].max(initial=0.0)])

    def reach(left: dict, right: dict, same: bool) -> np.ndarray:
        d, _ = pairs(left, right, same)
        near = d[d <= left["top"] / 2]
        return np.array([near.max(initial=0.0), len(near)])

    def classes(left: dict, right: dict, same: bool) -> np.ndarray:
        d, g = pairs(left, right, same)
        keep = d <= left["reach"]
        return _bins(d[keep], g[keep], left["reach"]).ravel()

    held = ["place", "resid"]
    tops = solver.pair_sums(blocks, keys, held, widest, 1, 1).select(*keys, F.get("sums", F.lit(0)).alias("top"))
    blocks = cut_lineage(blocks.join(tops, keys))
    reaches = solver.pair_sums(blocks, keys, [*held, "top"], reach, 1, 2).select(*keys, F.get("sums", F.lit(0)).alias("reach"), F.get("sums", F.lit(1)).alias("near"))
    blocks = cut_lineage(blocks.join(reaches, keys).withColumn("reach", F.when(F.col("near") >= 3, F.col("reach")).otherwise(F.col("top"))).drop("near"))
    bins = solver.pair_sums(blocks, keys, [*held, "reach"], classes, 0, 36)
    facts = bins.join(spread, keys).join(blocks.groupBy(*keys).agg(F.max("top").alias("top")), keys)

    def model(r: dict) -> tuple:
        variance = r["square"] / r["n"]
        name, nugget, psill, rng = _fit_bins(np.asarray(r["sums"]).reshape(3, 12), r["top"]) or ("Exp", variance, 0.0, r["top"])
        if nugget + psill <= 0:
            return name, 1.0, 0.0, 1.0, True
        return name, float(nugget), float(psill), float(rng), False

    fitted = blocks.join(_grouped(facts, keys, model, "model string, nugget double, psill double, rng double, flat boolean"), keys)
    return cut_lineage(fitted.drop("top", "reach").unionByName(flat))


def _solved(blocks: DataFrame, keys: list[str], k: int, probes: int = 0, exact: bool = False) -> DataFrame:
    """Blocks with the weights ``w`` of their stations and the trend ``beta``.

    With probes also the estimated ``diagonal`` of the inverse of the bordered matrix, with ``exact`` the diagonal itself.
    Flat groups take no part in the rounds: their weights are zero.
    """
    sides = 1 + k + probes
    schema = "w binary, diagonal binary, beta array<double>"
    flat, blocks = blocks.where("flat"), blocks.where("NOT flat")
    still = solver._mapped(flat, lambda r: {"w": _zeros(r), "diagonal": _zeros(r), "beta": r["beta"]}, schema)
    if blocks.isEmpty():
        return cut_lineage(still)

    def right(r: dict) -> dict:
        z, f = _doubles(r["value"], -1), _doubles(r["trend"], -1, k)
        v = np.zeros((len(z), probes))
        if probes:
            rng = np.random.default_rng([17, r["b"]])
            v[np.arange(len(z)), np.arange(len(z)) % probes] = rng.choice([-1.0, 1.0], len(z))
        return {"rhs": np.column_stack([z, f, v]).tobytes()}

    def onto(r: dict) -> dict:
        return {"dots": (_doubles(r["trend"], -1, k).T @ _doubles(r["x"], -1, sides)).ravel().tolist()}

    def finish(r: dict) -> dict:
        x, against = _doubles(r["x"], -1, sides), np.asarray(r["t"]).reshape(k, sides)
        y, gram = x[:, 1 : 1 + k], against[:, 1 : 1 + k]
        size = np.sqrt(np.maximum(np.abs(np.diag(gram)), 1e-300))
        inverse = np.linalg.pinv(gram / np.outer(size, size), rcond=1e-13) / np.outer(size, size)
        g = x - y @ (inverse @ against)
        diagonal = np.zeros(0)
        if probes:
            sign = _doubles(r["rhs"], -1, sides)[:, 1 + k :]
            diagonal = (sign * g[:, 1 + k :]).sum(1)
        if exact:
            diagonal = np.asarray(r["inverse"]) - ((y @ inverse) * y).sum(1)
        beta = inverse @ against[:, 0]
        return {"w": np.ascontiguousarray(g[:, 0]).tobytes(), "diagonal": np.ascontiguousarray(diagonal).tobytes(), "beta": [float(b) for b in beta]}

    # covariances need not be positive definite; the spline's matrix is made so
    done = solver.solve(cut_lineage(solver._mapped(blocks, right, "rhs binary")), keys, sides, signed=not probes, diagonal=exact)
    sums = solver.group_sum(solver._mapped(done, onto, "dots array<double>"), keys, "dots", "t")
    solved = solver._mapped(done.join(sums, keys), finish, schema).drop("x", "rhs", "t", "inverse")
    return cut_lineage(solved.unionByName(still))


def _zeros(r: dict) -> bytes:
    return np.zeros(len(r["value"]) // 8).tobytes()


def _weights(blocks: DataFrame, keys: list[str], schema: str) -> DataFrame:
    """One row per station of solved blocks."""

    def rows(batches):
        for pdf in batches:
            for r in pdf.to_dict("records"):
                p = _doubles(r["place"], -1, 3)
                n = len(p)
                name, nugget, psill, rng = (r[c] for c in solver.PARAMS) if r["flat"] else _with_jitter(*(r[c] for c in solver.PARAMS))
                yield pd.DataFrame(
                    {
                        "date": [r["date"]] * n, "variable": r["variable"], "station": list(r["station"]),
                        "lon": np.degrees(np.arctan2(p[:, 1], p[:, 0])), "lat": np.degrees(np.arcsin(np.clip(p[:, 2], -1, 1))),
                        "w": _doubles(r["w"], -1), "model": name, "nugget": nugget, "psill": psill, "rng": rng,
                        "beta": [list(r["beta"])] * n,
                    }
                )

    return blocks.mapInPandas(rows, schema)


def formulas() -> list[str]:
    names = list(TREND_TERMS)
    return [" + ".join(c) for k in (1, 2, 3) for c in combinations(names, k)] + ["1"]


def formula_terms(formula: str) -> list[str]:
    return [t for name, cols in TREND_TERMS.items() if name in formula for t in cols]


def krige_scores(stations: DataFrame) -> DataFrame:
    """Leave-one-out error of every trend formula per date and variable, from the diagonal of one matrix inverse each.

    The same system at every size: a group of up to ``TASK_STATIONS`` stations is factorised in one task, a larger one over
    tiles, all formulas in the same rounds.
    """
    names = formulas()

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("station").reset_index(drop=True)
        out = []
        for name in names:
            _, w, _, diagonal = _lean_krige(pdf, formula_terms(name), True)
            out.append(0.0 if w is None else float(np.sqrt(np.mean((w / diagonal) ** 2))))
        return pd.DataFrame({"date": pdf["date"].iloc[0], "variable": pdf["variable"].iloc[0], "formula": names, "rmse": out})

    schema = f"date {stations.schema['date'].dataType.simpleString()}, variable string, formula string, rmse double"
    need = [*KEYS, "station", "lon", "lat", "value", "elevation", "coast"]
    small, large = _by_size(clean_stations(stations.select(*need)))
    scores = _spread(small, KEYS).groupBy(*KEYS).applyInPandas(score, schema)
    if large is None:
        return scores
    terms, keys = ["lon", "lat", "elevation", "coast"], [*KEYS, "formula"]
    every = packed(large, KEYS, terms).withColumn("formula", F.explode(F.array(*map(F.lit, names))))

    def own(r: dict) -> dict:
        used = np.array([1.0, *[float(t in formula_terms(r["formula"])) for t in terms]])
        return {"trend": (_doubles(r["trend"], -1, 5) * used).tobytes()}

    blocks = _solved(_fitted(solver._mapped(every, own, "trend binary"), keys, 5), keys, 5, exact=True)

    def errors(r: dict) -> dict:
        e = np.zeros(1) if r["flat"] else _doubles(r["w"], -1) / _doubles(r["diagonal"], -1)
        return {"dots": [float((e * e).sum())]}

    sums = solver.group_sum(solver._mapped(blocks, errors, "dots array<double>"), keys, "dots", "t")
    sizes = blocks.groupBy(*keys).agg(F.max("n").alias("n"))
    mean = F.sqrt(F.get("t", F.lit(0)) / F.col("n")).alias("rmse")
    return scores.unionByName(sums.join(sizes, keys).select(*keys, mean))


def krige_select(stations: DataFrame, dates: DataFrame) -> DataFrame:
    """Formula with the smallest mean error over the sampled dates, per variable."""
    sampled = stations.join(dates.select("date").distinct(), "date", "left_semi")
    mean = krige_scores(sampled).groupBy("variable", "formula").agg(F.avg("rmse").alias("mean_rmse"))
    best = mean.groupBy("variable").agg(F.min(F.struct("mean_rmse", "formula")).alias("b"))
    return best.select("variable", F.col("b.formula").alias("formula"), F.col("b.mean_rmse").alias("mean_rmse"))


def indicator_krige(stations: DataFrame, cells: DataFrame) -> DataFrame:
    """Kriging of 0/1 values with a constant trend, clamped and rounded; no value counts as 0."""
    s = stations.where(F.col("value").between(0, 1))
    out = krige(s, cells)
    v = F.when(F.isnan("value"), F.lit(None)).otherwise(F.col("value"))
    return out.withColumn("value", F.coalesce(clamp_round(v), F.lit(0.0)))


def tps(stations: DataFrame, cells: DataFrame) -> DataFrame:
    """Thin-plate spline, smoothing by generalised cross-validation; fewer than five stations are padded.

    Groups larger than ``TASK_STATIONS`` try all smoothings in the same rounds of elimination, with the trace of
    the smoother estimated from ``PROBES`` fixed random signs.
    """
    dense = DENSE_STATIONS

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("station").reset_index(drop=True)
        if len(pdf) > dense:
            return _emit_weights(pdf, *_lean_spline(pdf), ("Tps", 0.0, 0.0, 1.0))
        while len(pdf) < 5:
            extra = pdf.head(5 - len(pdf)).copy()
            extra[["lon", "lat"]] += 0.0001 * len(pdf)
            extra["station"] = extra["station"].astype(str) + "+"
            pdf = pd.concat([pdf, extra], ignore_index=True)
        z, f, h = pdf["value"].to_numpy(float), _design(pdf, ["lon", "lat"]), _angles(pdf)
        n = len(z)
        k = np.where(h > 0, h * h * np.log(np.where(h > 0, h, 1.0)), 0.0)
        q, _ = np.linalg.qr(f, mode="complete")
        rank = np.linalg.matrix_rank(f)
        q2 = q[:, rank:]
        vals, vecs = np.linalg.eigh(q2.T @ k @ q2) if n > rank else (np.zeros(0), np.zeros((0, 0)))
        u = vecs.T @ (q2.T @ z)
        best = (np.inf, 1e-8)
        for lam in _smoothings(n, h.max()):
            shrink = lam / (np.maximum(vals, 0) + lam)
            tr = shrink.sum()
            gcv = n * ((shrink * u) ** 2).sum() / tr**2 if tr > 0 else np.inf
            best = min(best, (gcv, lam))
        w = q2 @ (vecs @ (u / (np.maximum(vals, 0) + best[1]))) if len(vals) else np.zeros(n)
        beta = np.linalg.lstsq(f, z - k @ w - best[1] * w, rcond=None)[0]
        return _emit_weights(pdf, w, beta, ("Tps", 0.0, 0.0, 1.0))

    need = [*KEYS, "station", "lon", "lat", "value"]
    small, large = _by_size(clean_stations(stations.select(*need)))
    solved = _spread(small, KEYS).groupBy(*KEYS).applyInPandas(solve, _weights_schema(stations))
    if large is not None:
        solved = solved.unionByName(_weights(_large_spline(large), KEYS, _weights_schema(stations)))
    return evaluate(solved, cells, ["lon", "lat"])


def _smoothings(n: int, top: float) -> np.ndarray:
    """Smoothings to try, from next to none to a plane: steps of ten up to a hundred times a bound of the largest eigenvalue."""
    h = np.array([top, min(top, np.exp(-0.5))])
    return n * np.abs(solver.kernel("Tps", h, 0.0, 0.0, 1.0)).max(initial=1e-300) * 10.0 ** np.arange(-8, 3)


def _large_spline(stations: DataFrame) -> DataFrame:
    """Solved blocks of the smoothing that cross-validates best."""
    blocks, k = packed(stations, KEYS, ["lon", "lat"]), 3

    def widest(left: dict, right: dict, same: bool) -> np.ndarray:
        return np.array([solver.angles(_doubles(left["place"], -1, 3), _doubles(right["place"], -1, 3)).max()])

    tops = solver.pair_sums(blocks, KEYS, ["place"], widest, 1, 1)
    facts = tops.join(blocks.groupBy(*KEYS).agg(F.max("n").alias("n"), F.max("nb").alias("nb")), KEYS)
    tried = _grouped(facts, KEYS, lambda r: (list(_smoothings(r["n"], r["sums"][0])),), "smoothing array<double>")
    keys = [*KEYS, "step"]
    dealt = blocks.join(tried, KEYS).select("*", F.posexplode("smoothing").alias("step", "nugget")).drop("smoothing")
    # products of the trend as large as the spline's own, so that neither drowns the other
    bent = F.array_max("smoothing") / F.col("n") / 100
    dealt = dealt.join(tried.join(facts.select(*KEYS, "n"), KEYS).select(*KEYS, bent.alias("psill")), KEYS)
    dealt = dealt.withColumns({"model": F.lit("Tps"), "rng": F.lit(1.0), "flat": F.lit(False), "beta": F.array().cast("array<double>")})
    done = _solved(dealt, keys, k, PROBES)

    def facts_of(r: dict) -> dict:
        w = _doubles(r["w"], -1)
        return {"dots": [float((w * w).sum()), float(_doubles(r["diagonal"], -1).sum())]}

    sums = solver.group_sum(solver._mapped(done, facts_of, "dots array<double>"), keys, "dots", "t")
    score = F.get("t", F.lit(0)) / (F.get("t", F.lit(1)) * F.get("t", F.lit(1)))
    best = sums.groupBy(*KEYS).agg(F.min_by("step", score).alias("step"))
    unbent = F.array(*[F.get("beta", F.lit(i)) for i in range(k)])
    return done.join(best, keys, "left_semi").withColumn("beta", unbent)


def interpolate(stations: DataFrame, cells: DataFrame, lo: float, hi: float, terms: list[str] = ()) -> DataFrame:
    """Kriging, with invalid predictions replaced by inverse-distance values of the same date."""
    pred = krige(stations, cells, terms)
    bad = invalid_predictions(pred, "value", lo, hi).select(*KEYS).distinct()
    s = stations.join(bad, KEYS, "left_semi")
    fallback = idw(s, cells, idw_power(s))
    return repair_predictions(pred, fallback, ["cell_id", *KEYS], "value", lo, hi)

