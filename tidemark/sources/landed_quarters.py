"""Raw tables kept by the quarter they landed in, laid out for the join on the accession.

A table is partitioned by ``quarter`` and bucketed and sorted by ACCESSION_NUMBER. Loading replaces exactly the quarters that the rows name, in
one dynamic partition overwrite: a quarter that lands twice counts once, and no file of another quarter is touched. A manifest beside the
tables says what has been loaded, and is written after the data, so an interrupted load is seen as missing. Tables with the same
number of buckets join and group on the accession without an exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = "ACCESSION_NUMBER"
BUCKETS = 64
LEAST_BUCKETS = 8
BUCKET_ROWS = 2_000_000
_MODE = "spark.sql.sources.partitionOverwriteMode"


def buckets_for(rows: int, least: int = LEAST_BUCKETS, bucket_rows: int = BUCKET_ROWS) -> int:
    """Buckets for tables of which the largest has so many rows: a bucket is one task of a load and of the join."""
    return max(least, -(-rows // bucket_rows))


def load_quarters(rows: DataFrame, name: str, root: str, buckets: int = BUCKETS) -> DataFrame:
    """Replace the quarters named in ``rows`` (column ``quarter``), create the table below ``root`` if there is none, and note the load in the manifest.

    Gives the manifest's new rows: name, quarter, rows, loaded_at. Quarters without rows are left as they are. ``rows`` are read twice: hand over a
    stored table.
    """
    spark = rows.sparkSession
    ordered = rows.select(*[c for c in rows.columns if c != "quarter"], F.col("quarter").cast("string").alias("quarter"))
    if not spark.catalog.tableExists(name):
        _laid_out(ordered.limit(0), buckets).option("path", f"{root}/{name}").saveAsTable(name)
    before = spark.conf.get(_MODE)
    spark.conf.set(_MODE, "dynamic")
    try:
        # One task per bucket: each quarter gets one file of every bucket that has rows.
        ordered.repartition(buckets, KEY).write.mode("overwrite").insertInto(name)
    finally:
        spark.conf.set(_MODE, before)
    spark.catalog.refreshTable(name)
    wanted = ordered.select("quarter").distinct()
    counted = spark.table(name).join(wanted, "quarter", "left_semi").groupBy("quarter").agg(F.count(F.lit(1)).alias("rows"))
    noted = counted.select(F.lit(name).alias("name"), "quarter", "rows", F.current_timestamp().alias("loaded_at"))
    noted.coalesce(1).write.mode("append").parquet(f"{root}/manifest")
    return noted


def _laid_out(rows: DataFrame, buckets: int):
    return rows.write.format("parquet").partitionBy("quarter").bucketBy(buckets, KEY).sortBy(KEY)


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """The last load of every table and quarter: name, quarter, rows, loaded_at, and ``loads``, how often it has been loaded."""
    every = spark.read.parquet(f"{root}/manifest")
    last = every.groupBy("name", "quarter").agg(F.max_by("rows", "loaded_at").alias("rows"), F.max("loaded_at").alias("loaded_at"), F.count(F.lit(1)).alias("loads"))
    return last.select("name", "quarter", "rows", "loaded_at", "loads")


def incomplete_quarters(spark: SparkSession, root: str, names: list[str]) -> DataFrame:
    """(quarter, missing): quarters that some of the tables have and others have not."""
    seen = manifest(spark, root).groupBy("quarter").agg(F.collect_set("name").alias("seen"))
    missing = F.array_sort(F.array_except(F.array(*map(F.lit, names)), F.col("seen")))
    return seen.select("quarter", missing.alias("missing")).filter(F.size("missing") > 0)
