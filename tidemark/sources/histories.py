"""Filers' histories and the ticker map, as published in JSON, and what they add to the quarterly tables.

Quarterly tables lag. Histories list every filing of a filer in parallel arrays, by field; a filing stands in the history of its issuer and of each of its
owners. The ticker map gives companies the tickers under which they are quoted today.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import signals
from tidemark.operators.joins import splittable_join

# The fields of a history, and of the ticker map.
HISTORY_FIELDS = {
    "accessionNumber": "accession", "filingDate": "filing_date", "reportDate": "period_of_report", "form": "form_type", "primaryDocument": "document",
}
_ARRAYS = ", ".join(f"{name} array<string>" for name in HISTORY_FIELDS)
HISTORY_SCHEMA = f"cik string, filings struct<recent: struct<{_ARRAYS}>>, {_ARRAYS}, _corrupt_record string"
TICKER_MAP = "map<string, struct<cik_str: string, ticker: string, title: string>>"
CONTINUED = r"^CIK(\d{10})-"


def _parsed(spark: SparkSession, path: str, lines: bool) -> DataFrame:
    """One row per history, or continuation of one, with its file."""
    read = spark.read.schema(HISTORY_SCHEMA).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
    return read.option("multiLine", not lines).option("recursiveFileLookup", True).json(path).withColumn("file", F.col("_metadata.file_name"))


def read_filing_histories(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(cik, accession, form_type, filing_date, period_of_report, document), one row per filer and filing.

    One history per file, or with ``lines`` one per line, which many filers should be stored as. Files of older filings hold the arrays alone, and have the filer in their name. Arrays that are
    missing or shorter give nulls; dates that are none are null; entries without accession, and what can't be read (``unreadable_histories``), are left out.
    """
    nothing = F.array().cast("array<string>")
    zipped = lambda prefix: F.arrays_zip(*[F.coalesce(f"{prefix}{name}", nothing).alias(name) for name in HISTORY_FIELDS])
    parsed = _parsed(spark, path, lines)
    filer = F.coalesce(F.col("cik"), F.nullif(F.regexp_extract("file", CONTINUED, 1), F.lit("")))
    listed = parsed.select(signals.plain_cik(filer).alias("cik"), F.explode(F.concat(zipped("filings.recent."), zipped(""))).alias("filing"))
    fields = listed.select("cik", *[F.col(f"filing.{name}").alias(label) for name, label in HISTORY_FIELDS.items()])
    dates = {c: F.try_to_date(F.col(c), "yyyy-MM-dd") for c in ("filing_date", "period_of_report")}
    return fields.filter(F.length("accession") > 0).withColumns(dates)


def unreadable_histories(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(file, text) of histories that are no JSON, or whose filer is unknown."""
    known = F.col("cik").isNotNull() | F.col("file").rlike(CONTINUED)
    return _parsed(spark, path, lines).filter(F.col("_corrupt_record").isNotNull() | ~known).select("file", F.col("_corrupt_record").alias("text"))


def unpublished(histories: DataFrame, submissions: DataFrame, form_type: str = "4") -> DataFrame:
    """(accession, filing_date, period_of_report, filers): filings of one form that the quarterly tables (``ACCESSION_NUMBER``) do not hold yet.

    A filing comes once, however many filers list it (``filers``); its dates are the earliest listed.
    """
    once = (
        histories.filter(F.col("form_type") == form_type)
        .groupBy("accession")
        .agg(F.min("filing_date").alias("filing_date"), F.min("period_of_report").alias("period_of_report"), F.count_distinct("cik").alias("filers"))
    )
    return once.join(submissions.select(F.col("ACCESSION_NUMBER").alias("accession")), "accession", "left_anti")


def read_ticker_map(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(cik, ticker, company, place): one JSON object per file, or with ``lines`` per line, its entries numbered by their keys.

    A list of companies is bounded by what is quoted, so a file is read whole. Entries without CIK or ticker are left out.
    """
    entries = spark.read.text(path, wholetext=not lines, recursiveFileLookup=True).select(F.explode(F.from_json("value", TICKER_MAP)).alias("key", "entry"))
    named = entries.filter(F.col("entry.cik_str").isNotNull() & (F.length("entry.ticker") > 0))
    return named.select(
        signals.plain_cik(F.col("entry.cik_str")).alias("cik"), F.col("entry.ticker").alias("ticker"), F.col("entry.title").alias("company"), F.expr("try_cast(key AS BIGINT)").alias("place")
    )


def fill_tickers(events: DataFrame, ticker_map: DataFrame) -> DataFrame:
    """Events whose ticker the study would not accept get that of their issuer's CIK; adds ``ticker_filled``.

    Of a company's several tickers the first by place is taken, then by text. Those without a company in the map keep theirs. Today's tickers say nothing of delisted companies, nor of tickers passed on:
    for dated ones see ``listings``.
    """
    first = ticker_map.groupBy(F.col("cik").alias("issuer_cik")).agg(F.min(F.struct(F.col("place").isNull(), "place", "ticker")).alias("first"))
    found = splittable_join(events, first.select("issuer_cik", F.col("first.ticker").alias("mapped")), "issuer_cik", "left")
    fills = ~F.coalesce(signals.has_study_ticker(F.col("ticker")), F.lit(False)) & F.col("mapped").isNotNull()
    return found.withColumn("ticker_filled", fills).withColumn("ticker", F.when(F.col("ticker_filled"), F.col("mapped")).otherwise(F.col("ticker"))).drop("mapped")
