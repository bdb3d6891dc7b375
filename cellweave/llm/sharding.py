"""Contiguous shards of nearly equal bytes from global prefix sums.

Rows are put in one total order (hash of the text, id, size) by a range partitioning with sorted partitions, stored
once, and numbered inside their partition. Only one byte total and one row count per partition reach the driver; their
running sums give every row its global position in bytes and rows. Shards are the equal cuts of the byte axis: a row
goes where the middle of its bytes lies. Rows with equal text are neighbours in the order, and such a group goes to one
shard as a whole if it is at most a tenth of a shard; a larger group is cut like single rows, so a group with a third
of all bytes is spread over a third of the shards.

Defined results: a null text has no bytes and weighs the overhead alone; repeated rows each have a place; a null id is
kept; an empty table gives an empty table; other columns are carried through, whatever their names.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweave.llm.common import free_name, load, text_of
from cellweave.operators.scale import parallelism
from cellweave.session import cut_lineage

SHARDS = 40
OVERHEAD = 16
WHOLE_GROUP = 0.1
SALTS = 1_024


def _earlier(part: Column, totals: dict[int, int]) -> Column:
    """Sum of the totals of all earlier partitions, found by index."""
    sizes = [totals.get(p, 0) for p in range(max(totals, default=-1) + 1)]
    return F.get(F.lit([0, *accumulate(sizes)][: len(sizes)]), part) if sizes else F.lit(0).cast("bigint")


def positions(rows: DataFrame, order: list[Column], size: str, at: str, rank: str) -> tuple[DataFrame, int]:
    """Add bytes before (``at``) and rows before (``rank``) in a total order; also the sum of all sizes.

    The sorted table is stored, so positions cannot move when a task is run again.
    """
    number = free_name(rows, "_number")
    ranged = rows.repartitionByRange(parallelism(rows), *order).sortWithinPartitions(*order)
    stored = cut_lineage(ranged.withColumn(number, F.monotonically_increasing_id()))
    part = F.shiftright(number, 33).cast("int")
    per_part = stored.groupBy(part.alias("p")).agg(F.sum(size).alias("s"), F.count(F.lit(1)).alias("n")).collect()
    held = free_name(stored, "_part")
    inside = Window.partitionBy(held).orderBy(number).rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        stored.withColumn(held, part)
        .withColumn(at, _earlier(F.col(held), {r.p: r.s for r in per_part}) + F.coalesce(F.sum(size).over(inside), F.lit(0)))
        .withColumn(rank, _earlier(F.col(held), {r.p: r.n for r in per_part}) + F.col(number).bitwiseAND((1 << 33) - 1))
        .drop(held, number)
    )
    return placed, sum(r.s for r in per_part)


def assign_shards(
    rows: DataFrame, group: str, size: str, ties: list[str], shards: int = SHARDS, whole_group: float = WHOLE_GROUP
) -> DataFrame:
    """Add ``shard`` and ``slot``; ``group`` is a 64-bit hash that equal texts share, ``size`` a number of bytes."""
    at, rank = free_name(rows, "_at"), free_name(rows, "_rank")
    placed, total = positions(rows, [F.col(c) for c in (group, *ties, size)], size, at, rank)
    first, weight = free_name(placed, "_first"), free_name(placed, "_weight")
    most = int(whole_group * total / shards)
    groups = placed.groupBy(group).agg(F.min(at).alias(first), F.sum(size).alias(weight), F.count(F.lit(1)).alias("_n"))
    salt, is_large = free_name(placed, "_salt"), free_name(placed, "_large")
    together = groups.where((F.col("_n") > 1) & (F.col(weight) <= most)).select(
        group, first, weight, F.pmod(F.col("_n"), F.lit(1)).cast("int").alias(salt)  # 0, but not a constant that the join could drop
    )
    # at most shards / whole_group groups are larger; their rows look for nothing, so they are spread by a salt
    large = groups.where(F.col(weight) > most).select(group, F.lit(True).alias(is_large))
    spread = F.when(F.col(is_large), F.pmod(F.xxhash64(*ties), F.lit(SALTS)) + 1).otherwise(0).cast("int")
    salted = placed.join(F.broadcast(large), group, "left").withColumn(salt, spread).drop(is_large)
    joined = salted.join(together, [group, salt], "left").drop(salt)
    middle = F.coalesce(2 * F.col(first) + F.col(weight), 2 * F.col(at) + F.col(size))
    cut = F.floor(middle.cast("decimal(38,0)") * shards / F.lit(max(2 * total, 1)))
    sharded = joined.withColumn("shard", F.least(F.lit(shards - 1), cut.cast("int"))).drop(first, weight, at)
    begin = free_name(sharded, "_begin")
    begins = sharded.groupBy("shard").agg(F.min(rank).alias(begin))
    return (
        sharded.join(F.broadcast(begins), "shard")  # one row per shard
        .withColumn("slot", F.col(rank) - F.col(begin))
        .drop(rank, begin)
    )


def shard_documents(docs: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every document."""
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(text_of(text)) + OVERHEAD).cast("bigint").alias("size"),
        F.crc32(text_of(text).cast("binary")).alias("text_crc32"),
        F.xxhash64(text_of(text)).alias("text_hash"),
    )
    return assign_shards(rows, "text_hash", "size", ["doc_id", "text_crc32"], shards).drop("text_hash")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text") -> None:
    """Write the documents as one folder per shard, in slot order, one file per shard."""
    boxed = docs.select(
        F.struct(*docs.columns).alias("row"),
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(text_of(text)) + OVERHEAD).cast("bigint").alias("size"),
        F.xxhash64(text_of(text)).alias("text_hash"),
    )
    placed = assign_shards(boxed, "text_hash", "size", ["doc_id"], shards)
    number, slot = free_name(docs, "shard"), free_name(docs, "slot")
    rows = placed.select("row.*", F.col("shard").alias(number), F.col("slot").alias(slot))
    rows.repartition(shards, number).sortWithinPartitions(number, slot).write.mode("overwrite").partitionBy(
        number
    ).parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_documents(load(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("bigint"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
