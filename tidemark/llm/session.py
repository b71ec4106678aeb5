"""Session settings of the text jobs, and the tables they read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TEXT_SETTINGS = {
    # Texts differ in length a thousandfold: bound a batch in bytes as well as in rows.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "500",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def tune_text(spark: SparkSession) -> SparkSession:
    for key, value in TEXT_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def hash_sample(rows: DataFrame, group: str, sizes: dict, counts: dict) -> DataFrame:
    """The `sizes[g]` ids with the smallest hashes of each group g, of `rows` (doc_id, group).

    `counts[g]` distinct ids of a group are known to exist. Ids whose hash lies far beyond what the sample needs leave in the scan,
    so that about twice the sample is compared, however large the table. The draw depends on ids alone.
    """
    cells = [F.lit(x) for g, n in sizes.items() for x in (g, min(1.0, (2 * n + 50) / max(1, counts[g])))]
    share = F.element_at(F.create_map(*cells), F.col(group))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    near = rows.select("doc_id", group).filter(place < share).distinct()
    wanted = F.element_at(F.create_map(*[F.lit(x) for g, n in sizes.items() for x in (g, n)]), F.col(group))
    nth = F.row_number().over(Window.partitionBy(group).orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)), "doc_id"))
    return near.withColumn("nth", nth).filter(F.col("nth") <= wanted).select("doc_id", group)
