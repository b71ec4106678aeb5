"""Landed quarterly filing tables: ``<root>/<quarter>/<TABLE>.tsv`` with drifting columns."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.schemas import RAW_COLUMNS
from tidemark.session import materialize


_OPEN_COST = "spark.sql.files.openCostInBytes"


def landed_files(spark: SparkSession, root: str) -> DataFrame:
    """Paths of all files below the root; only the listing is read, not the content."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(root)
        .select("path")
    )


def landed_tables(spark: SparkSession, root: str, table: str) -> DataFrame:
    """The files of each ``<TABLE>.tsv`` below the root, be it one file or a folder of part files."""
    return landed_files(spark, root).filter(F.col("path").rlike(rf"/{table}\.tsv(/[^/]*)?$"))


def _first_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        some = batch[(batch["start"] == 0) & (batch["line"].str.strip() != "")]
        if len(some):
            yield some.iloc[:1][["path", "line"]]
            return


def layouts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(line, paths): the files with one and the same header line, found by one job however many files there are.

    Every split is read alone and left after its first line, so content is not read through. Files without a line are left out.
    """
    before = spark.conf.get(_OPEN_COST)
    spark.conf.set(_OPEN_COST, spark.conf.get("spark.sql.files.maxPartitionBytes"))  # no two splits share a partition
    try:
        lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("line"))
        first = lines.mapInPandas(_first_lines, "path string, line string")
        return materialize(first.groupBy("line").agg(F.array_sort(F.collect_list("path")).alias("paths")))
    finally:
        spark.conf.set(_OPEN_COST, before)


def _reader(spark: SparkSession, quote: str):
    return (
        spark.read.option("sep", "\t")
        .option("header", True)
        .option("quote", quote)
        .option("mode", "PERMISSIVE")
        .option("enforceSchema", True)
    )


def scan_table(
    spark: SparkSession,
    root: str,
    table: str,
    quote: str = '"',
    lineage: bool = False,
    malformed: str | None = None,
) -> DataFrame:
    """All quarters of one table as text columns, matched by name.

    A multi-file CSV read binds columns by position, so files are grouped by their own header, part
    files too, and every distinct header becomes one scan with its own schema; the scans are united by
    name. The number of jobs and scans follows the number of layouts, not of files: one job finds the
    header lines. A file without a single line has none and is left out. Columns a layout lacks,
    and known columns no layout has, are null. ``lineage`` adds each row's ``source_file``;
    ``malformed`` names a column for the text of lines with too few or too many fields.
    """
    paths = [row["path"] for row in landed_tables(spark, root, table).collect()]
    if not paths:
        raise FileNotFoundError(f"no {table}.tsv below {root}")
    found = layouts(spark, paths).orderBy("line").collect()  # as many as there are layouts
    if not found:
        raise FileNotFoundError(f"no {table}.tsv below {root} has a header")
    scans = []
    for files in [r["paths"] for r in found]:
        fields = [*_reader(spark, quote).csv(files[0]).columns, *([malformed] if malformed else [])]
        schema = T.StructType([T.StructField(c, T.StringType()) for c in fields])
        reader = _reader(spark, quote).schema(schema)
        if malformed:
            reader = reader.option("columnNameOfCorruptRecord", malformed)
        scan = reader.csv(files)
        if lineage:
            scan = scan.select("*", F.col("_metadata.file_path").alias("source_file"))
        scans.append(scan)
    united = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), scans)
    absent = [c for c in RAW_COLUMNS.get(table, ()) if c not in united.columns]
    return united.withColumns({c: F.lit(None).cast("string") for c in absent}) if absent else united


def load_footnotes(spark: SparkSession, root: str, quote: str = '"') -> DataFrame:
    return scan_table(spark, root, "FOOTNOTES", quote).select("ACCESSION_NUMBER", "FOOTNOTE_TXT")


def load_filings(spark: SparkSession, root: str, quote: str = '"') -> tuple[DataFrame, DataFrame, DataFrame]:
    """Submissions, reporting owners and transactions."""
    return tuple(
        scan_table(spark, root, name, quote)
        for name in ("SUBMISSION", "REPORTINGOWNER", "NONDERIV_TRANS")
    )


def malformed_lines(spark: SparkSession, root: str, table: str, quote: str = '"') -> DataFrame:
    """(source_file, lines, malformed): how many lines of each file do not fit its header."""
    scan = scan_table(spark, root, table, quote, lineage=True, malformed="malformed_line")
    # Field counts are only checked for the columns a query reads, so it has to read them all.
    fields = [c for c in scan.columns if c not in ("source_file", "malformed_line")]
    whole = F.length(F.concat_ws("", *fields)) >= 0
    return scan.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if(whole & F.col("malformed_line").isNotNull()).alias("malformed"),
    )
