"""Permanent ids: a ticker names a company only for a time, and a company may change its ticker.

Listings are (ticker, permanent_id, valid_from, valid_to), from the first day on and before the last one; no last day means still listed. Each is
filed under every year it is valid in, so rows find theirs by an equi-join on ticker and year and a comparison of days, without a
range join. Events, prices and delistings under permanent ids keep a reused ticker's lives apart and a renamed company's together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.joins import splittable_join

LAST_YEAR = 2200


def with_permanent_id(rows: DataFrame, listings: DataFrame, day: str, ticker: str = "ticker") -> DataFrame:
    """``rows`` with the ``permanent_id`` their ticker stood for on that day; null where it was not listed."""
    own = ["ticker", "permanent_id", "valid_from", "valid_to"]
    years = F.sequence(F.year("valid_from"), F.least(F.coalesce(F.year("valid_to"), F.lit(LAST_YEAR)), F.lit(LAST_YEAR)))
    filed = listings.select(*own).withColumn("year", F.explode(years))
    # A company without a gap between two listings of one ticker has one row there.
    held = filed.groupBy(F.concat_ws("|", "ticker", "year").alias("listing_key")).agg(F.sort_array(F.collect_set(F.struct("valid_from", "valid_to", "permanent_id"))).alias("held"))
    keyed = rows.withColumn("listing_key", F.concat_ws("|", F.col(ticker), F.year(day)))
    met = splittable_join(keyed, held, "listing_key", "left")
    valid = F.filter("held", lambda x: (x["valid_from"] <= F.col(day)) & (x["valid_to"].isNull() | (F.col(day) < x["valid_to"])))
    return met.withColumn("permanent_id", F.get(valid, F.lit(0))["permanent_id"]).drop("held", "listing_key")


def by_permanent_id(rows: DataFrame, listings: DataFrame, day: str) -> DataFrame:
    """``rows`` under their permanent id in place of the ticker, all other columns as they are."""
    return with_permanent_id(rows, listings, day).withColumn("ticker", F.col("permanent_id")).drop("permanent_id")


def overlapping_listings(listings: DataFrame) -> DataFrame:
    """Pairs of listings of one ticker that are valid on the same day: none in a sound table."""
    one, other = listings.alias("one"), listings.alias("other")
    until = lambda side: F.coalesce(F.col(f"{side}.valid_to"), F.make_date(F.lit(LAST_YEAR + 1), F.lit(1), F.lit(1)))
    same = (F.col("one.ticker") == F.col("other.ticker")) & (F.col("one.valid_from") < until("other")) & (F.col("other.valid_from") < until("one"))
    first = F.struct("one.valid_from", "one.permanent_id") < F.struct("other.valid_from", "other.permanent_id")
    return one.join(other, same & first).select(
        F.col("one.ticker").alias("ticker"), F.col("one.permanent_id").alias("one"), F.col("other.permanent_id").alias("other")
    )
