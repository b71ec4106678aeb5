"""Contract checks: how many rows break each rule the studies rely on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.schemas import EVENT_KEY, EVENT_SCHEMA, PURCHASE_CODE

REQUIRED = ("accession", "txn_sk", "issuer_cik", "insider_id", "filing_date", "shares")


def count_violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations), all rules in one pass; a rule that is null counts as kept."""
    wide = df.agg(*[F.count_if(broken).alias(name) for name, broken in rules.items()])
    pairs = [F.struct(F.lit(n).alias("rule"), F.col(f"`{n}`").alias("violations")) for n in rules]
    return wide.select(F.inline(F.array(*pairs)))


def duplicate_keys(df: DataFrame, key: Sequence[str], rule: str) -> DataFrame:
    """Rows beyond the first of their key, counted map-side first."""
    extra = df.groupBy(*key).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("violations"))
    return extra.select(F.lit(rule).alias("rule"), "violations")


def schema_mismatches(df: DataFrame) -> list[str]:
    """Contract columns that are absent or of another type."""
    have = {f.name: f.dataType for f in df.schema.fields}
    return [f.name for f in EVENT_SCHEMA.fields if have.get(f.name) != f.dataType]


def event_contract(events: DataFrame) -> DataFrame:
    """Required fields, the purchase code, sensible prices and owner counts, unique keys."""
    rules = {f"{c} is missing": F.col(c).isNull() for c in REQUIRED}
    rules["txn_code is not P"] = ~F.col("txn_code").eqNullSafe(F.lit(PURCHASE_CODE))
    rules["price is negative"] = F.col("price") < 0
    rules["n_reporting_owners below 1"] = F.col("n_reporting_owners") < 1
    return count_violations(events, rules).unionByName(
        duplicate_keys(events, EVENT_KEY, "event key repeats")
    )


def panel_contract(panel: DataFrame) -> DataFrame:
    """No look-ahead, and entry prices a return can be computed from."""
    return count_violations(
        panel,
        {
            "entry before filing": F.col("entry_date") < F.col("filing_date"),
            "entry price not positive": F.col("entry_close") <= 0,
        },
    )


def raw_key_contract(submissions: DataFrame, owners: DataFrame, transactions: DataFrame) -> DataFrame:
    """Quarters loaded twice show up as repeated keys in the raw tables."""
    return (
        duplicate_keys(submissions, ["ACCESSION_NUMBER"], "submission key repeats")
        .unionByName(
            duplicate_keys(owners, ["ACCESSION_NUMBER", "RPTOWNERCIK"], "owner key repeats")
        )
        .unionByName(
            duplicate_keys(
                transactions, ["ACCESSION_NUMBER", "NONDERIV_TRANS_SK"], "transaction key repeats"
            )
        )
    )


def price_contract(prices: DataFrame) -> DataFrame:
    return duplicate_keys(prices, ["ticker", "date"], "price key repeats").unionByName(
        count_violations(prices, {"close not positive": F.col("close") <= 0})
    )
