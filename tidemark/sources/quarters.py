"""Quarters as a dimension, and the audit of which ones have landed."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def quarter_label(day: Column) -> Column:
    return F.concat(F.year(day).cast("string"), F.lit("q"), F.quarter(day).cast("string"))


def quarter_range(
    spark: SparkSession, first_year: int, first_quarter: int, last_year: int, last_quarter: int
) -> DataFrame:
    """(year, quarter, label) from first to last inclusive; empty if they are reversed."""
    if (first_year, first_quarter) > (last_year, last_quarter):
        return spark.createDataFrame([], "year long, quarter long, label string")
    span = F.sequence(
        F.lit(dt.date(first_year, 3 * first_quarter - 2, 1)),
        F.lit(dt.date(last_year, 3 * last_quarter - 2, 1)),
        F.expr("INTERVAL 3 MONTHS"),
    )
    return spark.range(1).select(F.explode(span).alias("day")).select(
        F.year("day").cast("long").alias("year"),
        F.quarter("day").cast("long").alias("quarter"),
        quarter_label(F.col("day")).alias("label"),
    )


def quarters_spanning(days: DataFrame, column: str) -> DataFrame:
    """Every quarter between the first and last date of a column, without gaps."""
    span = days.agg(
        F.trunc(F.min(column), "quarter").alias("first"),
        F.trunc(F.max(column), "quarter").alias("last"),
    ).filter(F.col("first").isNotNull())
    return span.select(
        F.explode(F.sequence("first", "last", F.expr("INTERVAL 3 MONTHS"))).alias("day")
    ).select(
        F.year("day").cast("long").alias("year"),
        F.quarter("day").cast("long").alias("quarter"),
        quarter_label(F.col("day")).alias("label"),
    )


def missing_quarters(wanted: DataFrame, landed: DataFrame) -> DataFrame:
    """Wanted quarters with nothing landed; ``landed`` has a ``label`` column."""
    return wanted.join(landed.select("label").distinct(), "label", "left_anti").select(
        "year", "quarter", "label"
    )


def landed_quarters(files: DataFrame) -> DataFrame:
    """Quarter labels found in landed paths such as ``…/2025q1/SUBMISSION.tsv``."""
    label = F.regexp_extract(F.lower(F.col("path")), r"/(\d{4}q[1-4])/[^/]*$", 1)
    return files.select(label.alias("label")).filter(F.col("label") != "").distinct()
