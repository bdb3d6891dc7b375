"""Shared parts of the corpus operators: word rules, row numbers, expression bindings, bucketed prefix sums."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweave.operators.scale import parallelism

#: Words are maximal runs of characters other than these; the pattern reads the same in Java and in RE2.
SPACES = r"[\x20\x09-\x0D]+"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str | Column = "text") -> Column:
    """The text with null read as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def words_of(text: Column) -> Column:
    """Array of all words of a text."""
    return F.array_remove(F.split(text, SPACES), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, as one lazily evaluated expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet (in any case)."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def values_of(batch: pa.RecordBatch, column: str, rows: int = 256) -> Iterator:
    """Values of a batch as Python objects, a few rows at a time: a batch may hold thousands of long texts."""
    for lo in range(0, batch.num_rows, rows):
        yield from batch.column(column).slice(lo, rows).to_pylist()


def bucket_of(key: Column, bits: int) -> Column:
    """Leading bits of a 64-bit hash: ranges of equal width, in the order of the key."""
    return F.shiftright(key, 64 - bits).cast("int")


def bucket_bits(df: DataFrame, least: int = 6) -> int:
    """Enough hash ranges for a few per task; the results do not depend on it."""
    return max(least, (4 * parallelism(df) - 1).bit_length())


def prefix_before(
    df: DataFrame, group: list[str], key: str, ties: list[str], value: str, out: str, bits: int
) -> DataFrame:
    """Add the sum of ``value`` over all earlier rows of the group, in the order of (key, ties).

    ``key`` is a uniform 64-bit hash. A group is cut into ranges of the key, so that a group with a third of all
    rows is spread over 2**bits windows; only one total per range enters the window over the whole group.
    """
    ranged = df.withColumn("_range", bucket_of(F.col(key), bits))
    totals = ranged.groupBy(*group, "_range").agg(F.sum(value).alias("_total"))
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*group, "_range", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*group, "_range").orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranged.join(starts, [*group, "_range"])
        .withColumn(out, F.col("_start") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .drop("_range", "_start")
    )


def count_not_above(ordered: Column, value: Column) -> Column:
    """How many entries of an ascending array are not above ``value``, by bisection."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(ordered) + F.lit(1.0))).cast("int"))
    start = F.struct(F.lit(0).alias("lo"), F.size(ordered).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        open_ = s["lo"] < s["hi"]
        right = open_ & F.coalesce(F.get(ordered, mid) <= value, F.lit(False))
        return F.struct(
            F.when(right, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(open_ & ~right, mid).otherwise(s["hi"]).alias("hi")
        )

    return F.aggregate(steps, start, halve)["lo"]
