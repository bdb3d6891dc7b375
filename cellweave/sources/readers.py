"""Readers: feature files, dated triple tables, CSV, relational exports, yearly folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cellweave.operators.triples import normalize_triples


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """All Parquet files below a folder, stamped with the snapshot date of their file name."""
    return with_snapshot_date(spark.read.option("recursiveFileLookup", "true").parquet(path))


def with_snapshot_date(df: DataFrame) -> DataFrame:
    """Date from the file name: ``yyyy-MM-dd``, or the first run of digits read as ``yyMMdd``."""
    name = F.col("_metadata.file_name")
    iso = F.nullif(F.regexp_extract(name, r"\d{4}-\d{2}-\d{2}", 0), F.lit(""))
    short = F.concat(F.lit("20"), F.regexp_extract(name, r"\d+", 0))
    return df.withColumn("date", F.coalesce(F.try_to_date(iso, "yyyy-MM-dd"), F.try_to_date(short, "yyyyMMdd")))


def read_triples(spark: SparkSession, path: str, date: str | None = None) -> DataFrame:
    """Normalised triples, of one date when given: only that partition is listed and read."""
    df = spark.read.parquet(path)
    if date is not None:
        df = df.where(F.col("date") == F.to_date(F.lit(date)))
    return normalize_triples(df)


def list_dates(spark: SparkSession, path: str) -> DataFrame:
    """Dates of a partitioned table. Only the partition column is read, so no data page of any file is."""
    return spark.read.parquet(path).select("date").distinct().orderBy("date")


def read_csv(spark: SparkSession, path: str, schema: StructType | str, sep: str = ",") -> DataFrame:
    return spark.read.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').schema(schema).csv(path)


def read_jdbc_or_parquet(spark: SparkSession, source: str, table: str | None = None, **jdbc: str) -> DataFrame:
    """A relational table through a JDBC driver, or its Parquet export.

    Pass partitionColumn, lowerBound, upperBound and numPartitions so that the table is read in parallel.
    """
    if source.startswith("jdbc:"):
        return spark.read.format("jdbc").options(url=source, dbtable=table, **jdbc).load()
    return spark.read.parquet(source)


def read_yearly(spark: SparkSession, path: str) -> DataFrame:
    """One read over folders named by year, with the year as a column."""
    df = spark.read.option("recursiveFileLookup", "true").parquet(path)
    return df.withColumn("year", F.regexp_extract(F.col("_metadata.file_path"), r"/(?:year=)?(\d{4})/[^/]*$", 1).cast("int"))
