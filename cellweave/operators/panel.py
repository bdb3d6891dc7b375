"""Cell panels: monthly aggregation, pivots, joins on entity and date, use-case tables."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.functions import dates as dt, hexgrid as hx, text as tx
from cellweave.functions.values import WIND_LABELS
from cellweave.operators.scale import exact_medians
from cellweave.session import cut_lineage, release

# Area of one land-cover pixel in square metres.
PIXEL_AREA = 900

# Land-cover legend (value, main class, sub class).
LAND_COVER = [
    (0, "Unclassified", "Unclassified"),
    (11, "Water", "Open Water"),
    (12, "Water", "Perennial Ice/Snow"),
    (21, "Developed", "Developed, Open Space"),
    (22, "Developed", "Developed, Low Intensity"),
    (23, "Developed", "Developed, Medium Intensity"),
    (24, "Developed", "Developed High Intensity"),
    (31, "Barren", "Barren Land (Rock/Sand/Clay)"),
    (41, "Forest", "Deciduous Forest"),
    (42, "Forest", "Evergreen Forest"),
    (43, "Forest", "Mixed Forest"),
    (51, "Shrubland", "Dwarf Scrub"),
    (52, "Shrubland", "Shrub/Scrub"),
    (71, "Herbaceous", "Grassland/Herbaceous"),
    (72, "Herbaceous", "Sedge/Herbaceous"),
    (73, "Herbaceous", "Lichens"),
    (74, "Herbaceous", "Moss"),
    (81, "Planted/Cultivated", "Pasture/Hay"),
    (82, "Planted/Cultivated", "Cultivated Crops"),
    (90, "Wetlands", "Woody Wetlands"),
    (95, "Wetlands", "Emergent Herbaceous Wetlands"),
]

# Cause text that means unknown, last usable containment date.
UNKNOWN_CAUSE = "Missing data/not specified/undetermined"
LAST_CONTAINMENT = "2018-12-01"


# -- filters ------------------------------------------------------------------------------------------------------


def drop_incomplete(df: DataFrame) -> DataFrame:
    return df.na.drop()


def within_bounds(long_df: DataFrame, bounds: DataFrame) -> DataFrame:
    """Rows of (variable, value) inside the variable's range; variables without a range drop out."""
    b = bounds.select(F.col("column").alias("variable"), F.col("minValue").alias("_lo"), F.col("maxValue").alias("_hi"))
    return long_df.join(b, "variable").where(F.col("value").between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def time_split(df: DataFrame, date_col: str, cut: str) -> tuple[DataFrame, DataFrame]:
    """Rows before the date, and rows from the date on."""
    d = F.col(date_col).cast("date")
    return df.where(d < F.to_date(F.lit(cut))), df.where(d >= F.to_date(F.lit(cut)))


def drop_columns(df: DataFrame, names: list[str]) -> DataFrame:
    return df.drop(*names)


def keep_entities(df: DataFrame, entities: DataFrame, key: str = "ID") -> DataFrame:
    return df.join(entities.select(F.col(entities.columns[0]).alias(key)).distinct(), key, "left_semi")


def complete_columns(df: DataFrame, date_col: str, start: str, end: str) -> DataFrame:
    """Keep the columns observed on every day of the range, and on no other day.

    One pass per column set: days are counted by presence bits per day, so the second step is tiny.
    """
    d = F.col(date_col).cast("date")
    names = [c for c in df.columns if c != date_col]
    per_day = df.groupBy(d.alias("_d")).agg(*[F.max(F.col(f"`{c}`").isNotNull().cast("int")).alias(c) for c in names])
    inside = F.col("_d").between(F.to_date(F.lit(start)), F.to_date(F.lit(end)))
    flags = per_day.agg(
        F.datediff(F.to_date(F.lit(end)), F.to_date(F.lit(start))).alias("_days"),
        *[F.sum(F.when(inside, F.col(f"`{c}`")).otherwise(-F.col(f"`{c}`") * 10**6)).alias(c) for c in names],
    ).first()
    keep = [c for c in names if flags[c] == (flags["_days"] or 0) + 1]
    return df.select(date_col, *[F.col(f"`{c}`") for c in keep])


def zero_fill(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.na.fill(0, subset=cols)


def columns_like(df: DataFrame, include: list[str], exclude: list[str] = ()) -> list[str]:
    return [c for c in df.columns if any(i in c for i in include) and not any(e in c for e in exclude)]


def filter_causes(df: DataFrame, from_date: str, drop_cause: str = UNKNOWN_CAUSE) -> DataFrame:
    return df.where(
        (F.col("DISCOVERY_DATE") >= F.to_date(F.lit(from_date))) & (F.col("NWCG_GENERAL_CAUSE") != drop_cause)
    )


def invalid_predictions(df: DataFrame, var: str, lo: float, hi: float) -> DataFrame:
    return df.where(is_invalid(F.col(var), lo, hi))


def is_invalid(value: Column, lo: float, hi: float) -> Column:
    return value.isNull() | F.isnan(value) | ~value.between(lo, hi)


def default_label(df: DataFrame, col: str, value: int = 0) -> DataFrame:
    return df.withColumn(col, F.coalesce(F.col(col), F.lit(value)))


# -- aggregation --------------------------------------------------------------------------------------------------


def month_agg(
    df: DataFrame, keys: list[str], date_col: str, mins: list[str] = (), maxs: list[str] = (), means: list[str] = ()
) -> DataFrame:
    """Monthly min, max and mean in one pass; one missing member makes the result missing."""
    def strict(fn, c):
        return F.when(F.count(c) == F.count(F.lit(1)), fn(c)).alias(c)

    month = dt.month_start(F.col(date_col)).alias("DATE")
    aggs = [strict(fn, c) for fn, cs in ((F.min, mins), (F.max, maxs), (F.avg, means)) for c in cs]
    return df.groupBy(*keys, month).agg(*aggs)


def count_pivot(df: DataFrame, keys: list[str], cat: str, labels: list[str] = WIND_LABELS, prefix: str = "") -> DataFrame:
    """Counts per category as columns, zero where absent; the missing category only keeps its group alive."""
    counted = [F.count_if(F.col(cat) == v).alias(f"{prefix}{v}") for v in labels]
    return df.groupBy(*keys).agg(*counted)


def classify_pixels(pixels: DataFrame, legend: DataFrame, level: str = "subClass") -> DataFrame:
    """Raster value to land-cover class."""
    return pixels.join(legend.select("value", F.col(level).alias("class")).distinct(), "value", "left")


def land_cover_legend(spark) -> DataFrame:
    return spark.createDataFrame(LAND_COVER, "value int, mainClass string, subClass string")


def area_pivot(pixels: DataFrame, classes: list[str], pixel_area: float = PIXEL_AREA, key: str = "ID") -> DataFrame:
    """Covered area per class as columns, zero where absent."""
    aggs = [
        F.coalesce(F.sum(F.when(F.col("class") == c, F.col("coverage_fraction") * pixel_area)), F.lit(0.0)).alias(c)
        for c in classes
    ]
    return pixels.groupBy(key).agg(*aggs)


def zonal_mean(pixels: DataFrame, key: str = "ID", value: str = "value", weight: str = "coverage_fraction") -> DataFrame:
    ok = F.col(value).isNotNull()
    w = F.sum(F.when(ok, F.col(weight)))
    return pixels.groupBy(key).agg((F.sum(F.col(value) * F.col(weight)) / F.nullif(w, F.lit(0))).alias("mean"))


def max_per_group(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    """Rows that reach their group's maximum, ties kept: two combining aggregates, no sort."""
    best = df.groupBy(*keys).agg(F.max(col).alias("_best"))
    return df.join(best, keys).where(F.col(col) == F.col("_best")).drop("_best")


def dominant_class(areas: DataFrame, key: str = "ID") -> DataFrame:
    """Class with the largest area per cell, ties kept. The wide row holds all classes, so no shuffle is needed."""
    classes = [c for c in areas.columns if c != key]
    best = F.greatest(*[F.col(f"`{c}`") for c in classes]) if len(classes) > 1 else F.col(f"`{classes[0]}`")
    hits = F.array_compact(F.array(*[F.when(F.col(f"`{c}`") == best, F.lit(c)) for c in classes]))
    return areas.select(key, F.explode(hits).alias("LANDCOVER"))


def first_per_group(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key in a given order: a combining minimum over the whole row, no sort."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    row = F.min(F.struct(*order, *rest)).alias("_r")
    return df.groupBy(*keys).agg(row).select(*keys, "_r.*").select(*df.columns)


distinct_first = first_per_group


def argmin(df: DataFrame, keys: list[str], col: str, order: list[str]) -> DataFrame:
    return first_per_group(df, keys, [col, *order])


def value_range(df: DataFrame, col: str) -> DataFrame:
    return df.agg(F.min(col).alias("lo"), F.max(col).alias("hi"))


def sample_dates(df: DataFrame, col: str, frac: float = 0.2, seed: int = 15) -> DataFrame:
    """Seeded draw of a share of the distinct dates."""
    days = df.select(F.col(col).cast("date").alias("date")).distinct()
    n = days.count()
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("date").cast("string")))
    return days.orderBy(draw, "date").limit(round(frac * n))


def order_rows(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.orderBy(*cols)


# -- joins --------------------------------------------------------------------------------------------------------


def null_safe_left_join(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Left join in which two missing keys match."""
    right = b.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    cond = reduce(lambda x, y: x & y, [a[k].eqNullSafe(right[f"_r_{k}"]) for k in keys])
    return a.join(right, cond, "left").drop(*[f"_r_{k}" for k in keys])


def join_variables(long_df: DataFrame, variables: list[str], keys: tuple[str, ...] = ("ID", "DATE")) -> DataFrame:
    """Tables of one variable each, kept as long rows, side by side: one aggregate instead of a chain of joins."""
    picks = [F.max(F.when(F.col("variable") == v, F.col("value"))).alias(v) for v in variables]
    return long_df.groupBy(*keys).agg(*picks)


def fact_dim_join(fact: DataFrame, dim: DataFrame, left_key: str, right_key: str) -> DataFrame:
    return fact.join(dim, fact[left_key] == dim[right_key], "left")


def repair_predictions(pred: DataFrame, fallback: DataFrame, keys: list[str], var: str, lo: float, hi: float) -> DataFrame:
    """Replace invalid predictions by those of a second method."""
    other = fallback.select(*keys, F.col(var).alias("_other"))
    bad = is_invalid(F.col(var), lo, hi)
    return pred.join(other, keys, "left").withColumn(var, F.when(bad, F.col("_other")).otherwise(F.col(var))).drop("_other")


def join_vectors(
    base: DataFrame, vectors: DataFrame, mode: str = "month", crosswalk: DataFrame | None = None, prefix: str = ""
) -> DataFrame:
    """Panel rows with their cell's vector: of the same date, of the year's first day, or dateless.

    With a crosswalk (ID, foreign id) the vectors belong to cells of a second grid. Rows with a missing value
    drop out, as do rows without a vector.
    """
    vec = vectors
    if crosswalk is not None:
        own, foreign = crosswalk.columns
        bridge = crosswalk.select(F.col(own).alias("_cell"), F.concat(F.lit(prefix), F.col(foreign).cast("string")).alias("ID"))
        vec = bridge.join(vec, "ID").drop("ID").withColumnRenamed("_cell", "ID")
    if mode == "static":
        return base.join(vec.drop("DATE"), "ID").na.drop()
    at = dt.year_start(F.col("DATE")) if mode == "year" else F.col("DATE").cast("date")
    vec = vec.withColumn("_at", F.col("DATE").cast("date")).drop("DATE")
    return base.withColumn("_at", at).join(vec, ["ID", "_at"]).drop("_at").na.drop()


# -- use-case tables ----------------------------------------------------------------------------------------------


def listing_base(calendar: DataFrame, listings: DataFrame, res: int = 9) -> DataFrame:
    """Calendar rows with their listing: complete rows only, cell id, price as a number, month as text."""
    dim = listings.withColumnRenamed("id", "_listing")
    joined = fact_dim_join(calendar, dim, "listing_id", "_listing").na.drop()
    out = joined.withColumns(
        {
            "ID": hx.hex_cell(F.col("longitude"), F.col("latitude"), res),
            "price": tx.parse_price(F.col("price")),
            "date": F.date_format(F.col("date").cast("date"), "yyyy-MM-01"),
        }
    )
    return out.drop("_listing", "available", "longitude", "latitude", "listing_id")


def landcover_panel(layers: DataFrame, epochs: list[tuple[str, str, str]], dominant: bool = True) -> DataFrame:
    """Land-cover rows repeated for every month of their epoch.

    ``layers`` has columns epoch, ID and one area column per class; ``epochs`` lists (epoch, first, last month).
    """
    pairs = [F.lit(v) for name, lo, hi in epochs for v in (name, f"{lo}|{hi}")]
    span = F.split(F.element_at(F.create_map(*pairs), F.col("epoch")), r"\|")
    months = dt.month_sequence(span[0].cast("date"), span[1].cast("date"))
    rows = layers
    if dominant:
        classes = [c for c in layers.columns if c not in ("epoch", "ID")]
        best = F.greatest(*[F.col(f"`{c}`") for c in classes])
        hits = F.array_compact(F.array(*[F.when(F.col(f"`{c}`") == best, F.lit(c)) for c in classes]))
        rows = layers.select("epoch", "ID", F.explode(hits).alias("LANDCOVER"))
    return rows.withColumn("DATE", F.explode_outer(months)).drop("epoch")


def fire_labels(burned: DataFrame, grid: DataFrame, id_col: str = "ID", res: int | None = None) -> DataFrame:
    """Burned areas (year, BurnDate, geom) to one labelled row per cell and month.

    With ``res`` the rows are burned spots (year, BurnDate, lon, lat) and each lies in one cell, also on a border.
    """
    from cellweave.operators.spatial import join_to_grid

    dated = burned.withColumn("DATE", dt.month_start(dt.date_from_doy(F.col("year"), F.col("BurnDate"))))
    met = join_to_grid(dated.select("DATE", *(["geom"] if res is None else ["lon", "lat"])), grid, res)
    return met.select(F.col("cell_id").alias(id_col), "DATE").distinct().withColumn("WILDFIRE", F.lit(1))


def fire_causes(causes: DataFrame, grid: DataFrame | None, from_date: str = "2010-01-01", res: int | None = None, cutoff: str = LAST_CONTAINMENT) -> DataFrame:
    """One row per fire and month of activity with its cause, located in the grid when one is given."""
    start, end = dt.us_date(F.col("DISCOVERY_DATE")), dt.us_date(F.col("CONT_DATE"))
    f = filter_causes(causes.withColumns({"DISCOVERY_DATE": start, "CONT_DATE": end}), from_date)
    f = f.withColumn("DISCOVERY_DATE", dt.month_start(F.col("DISCOVERY_DATE")))
    f = f.withColumn("CONT_DATE", dt.clamp_end(dt.month_start(F.col("CONT_DATE")), F.col("DISCOVERY_DATE"), cutoff))
    if grid is not None:
        from cellweave.operators.spatial import join_to_grid

        f = join_to_grid(f, grid, res).withColumnRenamed("cell_id", "ID")
    return dt.expand_months(f, "DISCOVERY_DATE", "CONT_DATE")


def wildfire_base(weather: DataFrame, fires: DataFrame, landcover: DataFrame) -> DataFrame:
    """Weather panel with fire label (absent means 0) and land cover."""
    out = weather.join(fires, ["ID", "DATE"], "left")
    return default_label(out, "WILDFIRE").join(landcover, ["ID", "DATE"], "left")


# -- binning ------------------------------------------------------------------------------------------------------


def natural_breaks(df: DataFrame, col: str, k: int = 5, cells: int = 4_096) -> list[float]:
    """Inner break points between the k classes with the least squared deviation: half way between their means.

    Exact, by branch and bound: values are counted and summed in steps, the best classes over whole steps bound the
    least deviation from above, and a step can hold a break only if leaving it out brings the bound from below to this
    value. Such steps are split between their own extremes (one aggregation a round, about ``cells`` rows) until they
    hold one value; the others are joined where no break can stand between them. Costs within a billionth count as
    equal. Fewer distinct values than classes give fewer breaks.

    A round reads the values of open steps only: they are stored anew whenever they are less than half of those read.
    """
    v = df.select(F.col(col).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    lo, hi = v.agg(F.min("v"), F.max("v")).first()
    if lo is None or lo == hi:
        return []
    closed, split, parts, stored = [], [(lo, hi)], cells, None
    while split:
        step = _step_of(split, parts)
        found = _split_steps(v, step)
        table = np.array(sorted(closed + [f[1:] for f in found]), dtype=float)
        centre = table[np.argmax(table[:, 2]), 3]
        sums = _sums(table, centre)
        open_, apart = _undecided(*sums, k, (table[:, 0] < table[:, 1]) & (table[:, 5] == 0))
        split = [(r[0], r[1]) for r in table[open_].tolist()]
        if split:
            closed = _joined(table, open_, apart)
            parts = max(2, cells // len(split))
            if 2 * table[open_, 2].sum() < sum(f[3] for f in found):
                open_ranges = set(split)
                before, stored = stored, _within(v, step, {f[0] for f in found if (f[1], f[2]) in open_ranges})
                v = stored
                if before is not None:
                    release(before)
    if stored is not None:
        release(stored)
    return [float(centre + b) for b in class_breaks(*sums, k)]


def _step_of(ranges: list[tuple[float, float]], parts: int) -> Column:
    """Number of the step a value lies in, of ``parts`` equal steps of every range; -1 between the ranges."""
    if len(ranges) == 1:
        (lo, hi), value = ranges[0], F.col("v")
        place = F.least(F.floor((value - F.lit(lo)) / F.lit(hi - lo) * F.lit(float(parts))), F.lit(parts - 1).cast("bigint"))
        return F.when(value.between(lo, hi), place).otherwise(F.lit(-1).cast("bigint"))
    low, high = (np.array(x) for x in zip(*ranges))

    @F.pandas_udf("bigint")
    def step(x: pd.Series) -> pd.Series:
        value = x.to_numpy(float)
        at = np.maximum(np.searchsorted(low, value, "right") - 1, 0)
        place = np.minimum(np.floor((value - low[at]) / (high[at] - low[at]) * parts), parts - 1)
        return pd.Series(np.where((value >= low[at]) & (value <= high[at]), at * parts + place, -1).astype("int64"))

    return step("v")


def _split_steps(v: DataFrame, step: Column) -> list[tuple]:
    """(step, low, high, n, mean, squared deviation, closed) of the values of every step."""
    stats = [F.min("v"), F.max("v"), F.count("v"), F.avg("v"), F.var_pop("v") * F.count("v")]
    rows = v.withColumn("step", step).where("step >= 0").groupBy("step").agg(*stats).collect()
    return [(*tuple(r), 0.0) for r in rows]


def _within(v: DataFrame, step: Column, steps: set[int]) -> DataFrame:
    """The values of some steps, stored."""
    wanted = F.split(F.lit(" ".join("yes" if i in steps else "no" for i in range(max(steps) + 1))), " ")
    return cut_lineage(v.withColumn("step", step).where(F.get(wanted, F.col("step").cast("int")) == "yes").select("v"))


def _sums(table: np.ndarray, centre: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, mean = table[:, 2].astype(np.longdouble), table[:, 3].astype(np.longdouble) - centre
    return n, n * mean, table[:, 4] + n * mean**2


def _best_begins(before: np.ndarray, cost, first: int) -> tuple[np.ndarray, np.ndarray]:
    """For every end j above ``first`` the first begin i of ``first`` to j - 1 with the least before[i] + cost(i, j), and this sum.

    The best begin never moves back as the end grows, so it is found by halving, all intervals of a level at once.
    """
    m = len(before) - 1
    begin, least = np.zeros(m + 1, dtype=int), np.full(m + 1, np.inf, dtype=before.dtype)
    a, b, lo, hi = (np.array([x]) for x in (first + 1, m, first, m - 1))
    while len(a):
        j = (a + b) // 2
        size = np.minimum(hi, j - 1) - lo + 1
        start = np.cumsum(size) - size
        part = np.repeat(np.arange(len(j)), size)
        i = np.arange(size.sum()) - start[part] + lo[part]
        total = before[i] + cost(i, j[part])
        low = np.minimum.reduceat(total, start)
        hits = np.flatnonzero(total == low[part])
        pick = i[hits[np.searchsorted(part[hits], np.arange(len(j)))]]
        begin[j], least[j] = pick, low
        a, b, lo, hi = np.r_[a, j + 1], np.r_[j - 1, b], np.r_[lo, pick], np.r_[pick, hi]
        a, b, lo, hi = (x[a <= b] for x in (a, b, lo, hi))
    return begin, least


def _prefix_costs(n: np.ndarray, s: np.ndarray, q: np.ndarray, k: int, drop: np.ndarray) -> list[np.ndarray]:
    """For c = 1 to k, the least deviation of every prefix in c classes, empty ones allowed.

    Between two classes one step of ``drop`` may be left out.
    """
    n, s, q = (np.r_[np.longdouble(0), np.cumsum(x)] for x in (n, s, q))
    m = len(n) - 1

    def cost(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.maximum((q[j] - q[i]) - (s[j] - s[i]) ** 2 / (n[j] - n[i]), 0)

    rows = [np.r_[np.longdouble(0), cost(np.zeros(m, dtype=int), np.arange(1, m + 1))]]
    for _ in range(1, k):
        before = rows[-1].copy()
        before[1:] = np.where(drop, np.minimum(before[1:], rows[-1][:-1]), before[1:])
        rows.append(np.minimum(before, _best_begins(before, cost, 0)[1]))
    return rows


def _undecided(n: np.ndarray, s: np.ndarray, q: np.ndarray, k: int, drop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps that can hold a break of the best classes, and for each step whether a break can stand before it."""
    m = len(n)
    most = _prefix_costs(n, s, q, k, np.zeros(m, dtype=bool))[-1][-1] * (1 + 1e-9)
    left = _prefix_costs(n, s, q, k, drop)
    right = [r[::-1] for r in _prefix_costs(n[::-1], s[::-1], q[::-1], k, drop[::-1])]
    inside, before = np.full(m, np.inf), np.full(m, np.inf)
    for c in range(1, k):
        inside = np.minimum(inside, left[c - 1][:-1] + right[k - c - 1][1:])
        before = np.minimum(before, left[c - 1][:-1] + right[k - c - 1][:-1])
    return drop & (inside <= most), before <= most


def _joined(table: np.ndarray, open_: np.ndarray, apart: np.ndarray) -> list[tuple]:
    """The steps without breaks inside, neighbours as one where no break can stand between them."""
    out: list[tuple] = []
    last = None
    for i, (low, high, n, mean, dev, _) in enumerate(table.tolist()):
        if open_[i]:
            continue
        if last == i - 1 and not apart[i]:
            a, _, na, ma, da, _ = out.pop()
            both = na + n
            out.append((a, high, both, ma + (mean - ma) * n / both, da + dev + (mean - ma) ** 2 * na * n / both, 1.0))
        else:
            out.append((low, high, n, mean, dev, 1.0))
        last = i
    return out


def class_breaks(n: np.ndarray, s: np.ndarray, q: np.ndarray, k: int) -> list[float]:
    """Best k consecutive classes of ordered groups given by count, sum and sum of squares."""
    n, s, q = (np.r_[np.zeros(1, dtype=x.dtype), np.cumsum(x)] for x in (n, s, q))
    m = len(n) - 1

    def cost(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return (q[j] - q[i]) - (s[j] - s[i]) ** 2 / (n[j] - n[i])

    best = np.r_[0.0, cost(np.zeros(m, dtype=int), np.arange(1, m + 1))]
    cuts = []
    for c in range(2, min(k, m) + 1):
        last, best = _best_begins(best, cost, c - 1)
        cuts = [*cuts, last]
    ends = [m]
    for last in reversed(cuts):
        ends.append(int(last[ends[-1]]))
    ends = [0, *reversed(ends)] if ends[-1] else list(reversed(ends))
    means = [(s[b] - s[a]) / (n[b] - n[a]) for a, b in zip(ends, ends[1:])]
    return [(a + b) / 2 for a, b in zip(means, means[1:])]


def bin_labels(df: DataFrame, col: str, breaks: list[float], labels: list[str], out: str | None = None) -> DataFrame:
    """Label of the bin a value falls in; bins are closed below, values outside the range take the end bins."""
    index = sum((F.when(F.col(col) >= b, 1).otherwise(0) for b in breaks), F.lit(1))
    label = F.element_at(F.array(*map(F.lit, labels)), index.cast("int"))
    return df.withColumn(out or col, F.when(F.col(col).isNotNull(), label))


def impute_medians(df: DataFrame, cols: list[str], medians: dict[str, float] | None = None) -> DataFrame:
    medians = medians or exact_medians(df, cols)
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(medians[c])) for c in cols})
