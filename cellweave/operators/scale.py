"""Building blocks that keep hot keys, global orders and reductions distributed.

Nothing here gathers a group into one task: hot groups are split into blocks, global ranks come from
range-sorted partitions plus one small offset per partition, and matrices are summed partition by partition.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.session import cut_lineage, release

BLOCK_ROWS = 512
#: Rows that one task of a wide step takes on average.
TASK_ROWS = 500_000
DRIVER_ROWS = 50_000


def parallelism(df: DataFrame) -> int:
    """Shuffle width of the caller's session."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def tasks_for(df: DataFrame, rows_each: int = TASK_ROWS) -> int:
    """Number of partitions that bounds the rows of one of them, at least the shuffle width; counts ``df``."""
    return max(parallelism(df), math.ceil(df.count() / rows_each))


def pinned(value: Column) -> Column:
    """Evaluate a costly expression once per row.

    The optimizer merges projections and would copy the expression into every later use; a generator over a
    one-element list stops that without moving any data.
    """
    return F.explode_outer(F.array(value))


def with_block(df: DataFrame, keys: list[str], spread: list[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add ``block`` and ``blocks``: every key's rows are split by hash into blocks of about ``block_rows``.

    Counting combines on the map side, so a key with a third of all rows costs one counter per task. The counts are
    one row per key: Spark broadcasts them if they are small, and otherwise splits the partition of a hot key
    at run time (adaptive skew join), without copies of the table of counts.
    """
    counts = df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).cast("int").alias("_blocks"))
    return (
        df.join(counts, keys)
        .withColumn("block", F.pmod(F.xxhash64(*spread, F.lit("block")), F.col("_blocks")).cast("int"))
        .withColumnRenamed("_blocks", "blocks")
    )


def in_blocks(
    df: DataFrame, keys: list[str], spread: list[str], item: Column, out: str = "items", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """One row per (keys, block) with the block's items as an array; blocks have a bounded expected size."""
    return with_block(df, keys, spread, block_rows).groupBy(*keys, "blocks", "block").agg(
        F.collect_list(item).alias(out)
    )


def replicate_over(blocks: DataFrame, shards: int) -> DataFrame:
    """Copy every block to all shards of the other side: the replicated half of a fragment-replicate join."""
    return blocks.withColumn("_shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))


def shard_of(spread: list[str], shards: int) -> Column:
    return F.pmod(F.xxhash64(*spread, F.lit("shard")), F.lit(shards)).cast("int")


def _offset_of(part: Column, totals: dict[int, float]) -> Column:
    """Sum of the totals of all earlier partitions, looked up by index in one constant array."""
    ordered = [totals.get(p, 0) for p in range(max(totals, default=-1) + 1)]
    starts = [0, *accumulate(ordered)][: len(ordered)]
    return F.get(F.lit(starts), part.cast("int")) if starts else F.lit(0).cast("bigint")


def global_row_number(df: DataFrame, order: list[Column], out: str = "rn", rows: int | None = None) -> DataFrame:
    """Exact 1-based rank of every row in a total order, without a single-partition window.

    Rows are range partitioned and sorted, and stored once so that ranks cannot move on a retry. Only one
    count per partition reaches the driver. ``rows``, the number of rows if the caller knows it, bounds the rows of
    a partition.
    """
    ranged = (
        df.repartitionByRange(max(parallelism(df), math.ceil((rows or 0) / TASK_ROWS)), *order)
        .sortWithinPartitions(*order)
        .withColumn("__pos", F.monotonically_increasing_id())
    )
    stored = cut_lineage(ranged)
    part = F.shiftright("__pos", 33)
    offset = _offset_of(part, dict(tuple(r) for r in stored.groupBy(part.alias("p")).count().collect()))
    in_part = F.col("__pos").bitwiseAND(F.lit((1 << 33) - 1))
    return stored.withColumn(out, offset + in_part + 1).drop("__pos")


def distinct_index(df: DataFrame, order: list[Column], out: str = "id") -> DataFrame:
    """Dense 0-based integer per distinct row, in the given total order."""
    once = cut_lineage(df.distinct())
    ranked = global_row_number(once, order, out, once.count()).withColumn(out, F.col(out) - 1)
    release(once)
    return ranked


def running_total(df: DataFrame, order: list[Column], cols: dict[str, str]) -> DataFrame:
    """Inclusive cumulative sums in a total order; ``cols`` maps output to input column.

    Same scheme as :func:`global_row_number`: sums inside sorted partitions plus one offset per partition.
    """
    from pyspark.sql import Window

    ranged = (
        df.repartitionByRange(parallelism(df), *order)
        .sortWithinPartitions(*order)
        .withColumn("__pos", F.monotonically_increasing_id())
    )
    stored = cut_lineage(ranged).withColumn("__part", F.shiftright("__pos", 33))
    sums = [F.sum(c).alias(o) for o, c in cols.items()]
    totals = sorted((r["__part"], [r[o] for o in cols]) for r in stored.groupBy("__part").agg(*sums).collect())
    window = Window.partitionBy("__part").orderBy("__pos").rowsBetween(Window.unboundedPreceding, 0)
    result = stored
    for i, (o, c) in enumerate(cols.items()):
        offset = _offset_of(F.col("__part"), {p: t[i] or 0 for p, t in totals})
        result = result.withColumn(o, F.coalesce(F.sum(c).over(window), F.lit(0)) + offset)
    return result.drop("__pos", "__part")


def exact_medians(df: DataFrame, cols: list[str], accuracy: int = 10_000) -> dict[str, float | None]:
    """Exact median of each numeric column (mean of the two middle values), nulls left out.

    A sketch gives a band that must hold the middle ranks, one count checks it, and the band is narrowed until
    its distinct values fit on the driver. Each round is one scan with map-side combining for all columns.
    """
    values = {c: F.col(f"`{c}`").cast("double") for c in cols}
    counts = df.agg(*[F.count(v).alias(c) for c, v in values.items()]).first()
    band = {c: (None, None, 0, counts[c]) for c in cols if counts[c]}
    result: dict[str, float | None] = {c: None for c in cols}

    def inside(c: str) -> Column:
        lo, hi, _, _ = band[c]
        v = values[c]
        return v if lo is None else F.when(v.between(lo, hi), v)

    while band:
        probes = []
        for c, (_, _, below, n) in band.items():
            k1, k2 = (counts[c] - 1) // 2 - below, counts[c] // 2 - below
            margin = 2.0 / accuracy
            p = [max(0.0, k1 / n - margin), min(1.0, (k2 + 1) / n + margin)]
            probes.append(F.percentile_approx(inside(c), p, accuracy).alias(c))
        found = df.agg(*probes).first()
        checks = []
        for c in band:
            lo, hi = found[c]
            checks.append(F.count_if(values[c] < lo).alias(f"{c}|below"))
            checks.append(F.count_if(values[c].between(lo, hi)).alias(f"{c}|in"))
        seen = df.agg(*checks).first()
        for c in list(band):
            lo, hi = found[c]
            below, n = seen[f"{c}|below"], seen[f"{c}|in"]
            k1, k2 = (counts[c] - 1) // 2, counts[c] // 2
            if not below <= k1 <= k2 < below + n:
                raise RuntimeError(f"quantile sketch of {c} missed the median")
            stuck = band[c][0] == lo and band[c][1] == hi
            band[c] = (lo, hi, below, n)
            hist = df.select(inside(c).alias("v")).where("v is not null").groupBy("v").count()
            rows = hist.limit(DRIVER_ROWS + 1).collect() if n <= DRIVER_ROWS or stuck or lo == hi else None
            if rows is None or len(rows) > DRIVER_ROWS:
                continue
            rows.sort()
            edges = list(accumulate(r["count"] for r in rows))
            pick = [next(r["v"] for r, e in zip(rows, edges) if below + e > k) for k in (k1, k2)]
            result[c] = (pick[0] + pick[1]) / 2.0
            del band[c]
    return result


def sum_arrays(parts: DataFrame, slots: int = 32) -> np.ndarray:
    """Elementwise sum of an array<double> column ``m`` with one bounded row per task, in two levels."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"m": [np.sum(np.stack(pdf["m"].to_numpy()), axis=0)]})

    level = parts.withColumn("_slot", F.pmod(F.spark_partition_id(), F.lit(slots)))
    rows = level.groupBy("_slot").applyInPandas(lambda pdf: add(pdf), "m array<double>").collect()
    if not rows:
        raise ValueError("nothing to sum")
    return np.sum([np.asarray(r["m"]) for r in rows], axis=0)


def reduce_vectors(df: DataFrame, fold: Callable[[pd.DataFrame], np.ndarray], size: int) -> np.ndarray:
    """Sum of ``fold(batch)`` over all Arrow batches; every task sends one array of ``size`` numbers."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size)
        for pdf in batches:
            if len(pdf):
                total += fold(pdf).ravel()
        yield pd.DataFrame({"m": [total]})

    return sum_arrays(df.mapInPandas(partial, "m array<double>"))
