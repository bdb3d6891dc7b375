"""Writers: dated triples, clustered features, compaction, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession

from cellweave.operators.scale import parallelism
from cellweave.operators.vectors import wide_vectors


def _by_date(df: DataFrame, rows_per_file: int) -> DataFrameWriter:
    """Rows gathered by date in one pass: small dates share a task, the partition of a large date is split at run time.

    Both follow the advisory partition size of the session; ``rows_per_file`` bounds the rows of one file.
    """
    return df.hint("rebalance", "date").write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy("date")


def write_triples(df: DataFrame, path: str, rows_per_file: int = 5_000_000) -> None:
    """Replace a triple table, partitioned by date."""
    _by_date(df, rows_per_file).parquet(path)


def append_triples(df: DataFrame, path: str, rows_per_file: int = 5_000_000) -> None:
    """Write the dates of ``df`` and leave the other dates alone; running it twice changes nothing."""
    _by_date(df, rows_per_file).option("partitionOverwriteMode", "dynamic").parquet(path)


def write_clustered(df: DataFrame, path: str, single: bool = False, by: str = "geohash") -> None:
    """Features in spatial order, so that file statistics prune; optionally one file."""
    n = 1 if single else parallelism(df)
    df.repartitionByRange(n, by).sortWithinPartitions(by).write.mode("overwrite").parquet(path)


def compact(spark: SparkSession, path: str, out: str, target_rows: int = 5_000_000) -> None:
    """Rewrite a dated table with fewer, larger files in a new folder; the rows stay the same."""
    _by_date(spark.read.parquet(path), target_rows).parquet(out)


def write_vectors(df: DataFrame, path: str, d: int, prefix: str = "vector") -> None:
    wide_vectors(df, d, prefix).write.mode("overwrite").parquet(path)

