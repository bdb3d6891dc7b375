"""Calendar expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: mean length of a month in days.
MEAN_MONTH_DAYS = 365.25 / 12


def month_start(d: Column) -> Column:
    return F.trunc(d.cast("date"), "MM")


def year_start(d: Column) -> Column:
    return F.trunc(d.cast("date"), "YEAR")


def date_in_text(text: Column) -> Column:
    """First ``yyyy-MM-dd`` found in free text, moved to the first of its month; null if none."""
    found = F.regexp_extract(text.cast("string"), r"\d{4}-\d{2}-\d{2}", 0)
    return month_start(F.try_to_date(F.nullif(found, F.lit("")), "yyyy-MM-dd"))


def us_date(text: Column) -> Column:
    """Date written as month/day/year; null when the text is not a date."""
    return F.try_to_date(text, "MM/dd/yyyy")


def date_from_doy(year: Column, offset: Column) -> Column:
    """First of January of ``year`` moved on by ``offset`` days."""
    return F.date_add(F.make_date(year.cast("int"), F.lit(1), F.lit(1)), offset.cast("int"))


def clamp_end(end: Column, start: Column, cutoff: str) -> Column:
    """A missing end, or one after the cutoff, becomes the start."""
    filled = F.coalesce(end, start)
    return F.when(filled > F.to_date(F.lit(cutoff)), start).otherwise(filled)


def duration_months(start: Column, end: Column) -> Column:
    """Whole months covered by ``start..end``, both ends counted, half months to even."""
    return (F.bround(F.datediff(end, start) / F.lit(MEAN_MONTH_DAYS), 0) + 1).cast("int")


def month_sequence(start: Column, end: Column) -> Column:
    return F.sequence(start, end, F.expr("interval 1 month"))


def expand_months(df: DataFrame, start: str, end: str, out: str = "DATE") -> DataFrame:
    """One row per month of activity, counted from the start month."""
    n = duration_months(F.col(start), F.col(end))
    return df.withColumn("_step", F.explode_outer(F.sequence(F.lit(0), n - 1))).withColumn(
        out, F.add_months(F.col(start), F.col("_step"))
    ).drop("_step")
