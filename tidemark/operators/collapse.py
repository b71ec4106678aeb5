"""Co-filer collapse: one row per economic transaction.

A filing lists every owner who reports it, so joining owners to transactions repeats each
transaction once per owner. The collapse keeps the owner with the lowest id, unions the role
flags and counts the owners.

All choices are ``min`` over a struct, which orders nulls first and is combined map-side, so a
filing that holds a large share of all rows shrinks before it is shuffled. Ties between equal
owner ids are broken by every other carried column, owner columns first. That order makes the
minimum over owners x transactions the pair of the two separate minima, so the same answer
can be had without building the product at all (``assemble_events``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import signals
from tidemark.operators.joins import splittable_join
from tidemark.schemas import EVENT_COLUMNS, EVENT_KEY, ROLE_FLAGS

OWNER_COLUMNS = ("insider_id", "insider_name", "relationship", "title")
FILING_COLUMNS = (
    "issuer_cik", "issuer_name", "ticker", "document_type", "filing_date", "period_of_report",
    "is_10b5_1",
)
TRADE_COLUMNS = (
    "txn_date", "txn_code", "shares", "price", "price_footnoted", "value",
    "shares_owned_following", "direct_indirect",
)


def _first_owner():
    return F.min(F.struct(*OWNER_COLUMNS))


def _first_titled_owner():
    return F.min(F.when(F.col("title").isNotNull(), F.struct(*OWNER_COLUMNS)))


def _any_role():
    return [F.bool_or(flag).alias(flag) for flag in ROLE_FLAGS]


LEAD_COLUMNS = (*OWNER_COLUMNS, *FILING_COLUMNS, *TRADE_COLUMNS)


def partial_events(typed: DataFrame, *within: Column) -> DataFrame:
    """Flattened, typed rows folded to one mergeable row per key: ``lead``, ``titled``, the roles and the number of rows.

    ``within`` comes after the key: sorts compare the accession first, which tells rows apart, and a window only where it ties.
    """
    return typed.groupBy(*EVENT_KEY, *within).agg(
        F.min(F.struct(*LEAD_COLUMNS)).alias("lead"),
        _first_titled_owner().alias("titled"),
        *_any_role(),
        F.count(F.lit(1)).alias("n_reporting_owners"),
    )


def merge_partials(partials: DataFrame) -> DataFrame:
    """Partial events of one key into one, whatever parts of its rows they were made from."""
    return partials.groupBy(*EVENT_KEY).agg(
        F.min("lead").alias("lead"), F.min("titled").alias("titled"), *_any_role(), F.sum("n_reporting_owners").alias("n_reporting_owners")
    )


def finish_partials(partials: DataFrame) -> DataFrame:
    """Events from partial ones that hold all rows of their key."""
    carried = [F.col(f"lead.{c}").alias(c) for c in LEAD_COLUMNS if c != "title"]
    return partials.select(
        *EVENT_KEY, *carried, F.col("titled.title").alias("title"), *ROLE_FLAGS, "n_reporting_owners"
    ).select(*EVENT_COLUMNS)


def collapse_cofilers(typed: DataFrame, within: Column | None = None) -> DataFrame:
    """Collapse already flattened, typed rows to one per (accession, txn_sk).

    ``within`` adds a grouping that the key implies, such as a stream's window.
    """
    return finish_partials(partial_events(typed, *([] if within is None else [within])))


def collapse_owners(owners: DataFrame, *within: Column) -> DataFrame:
    """One row per filing: its representative owner, unioned roles and owner count."""
    return (
        signals.with_role_flags(owners)
        .groupBy("accession", *within)
        .agg(
            _first_owner().alias("owner"),
            _first_titled_owner().alias("titled"),
            *_any_role(),
            F.count(F.lit(1)).alias("n_owners"),
        )
    )


def collapse_filings(filings: DataFrame) -> DataFrame:
    """One row per accession; a filing loaded twice keeps its weight in the owner count."""
    return filings.groupBy("accession").agg(
        F.min(F.struct(*FILING_COLUMNS)).alias("filing"), F.count(F.lit(1)).alias("n_filings")
    )


def collapse_trades(trades: DataFrame) -> DataFrame:
    return trades.groupBy(*EVENT_KEY).agg(
        F.min(F.struct(*TRADE_COLUMNS)).alias("trade"), F.count(F.lit(1)).alias("n_trades")
    )


def assemble_events(
    filings: DataFrame, owners: DataFrame, trades: DataFrame, footnotes: DataFrame | None = None, colocated: bool = False
) -> DataFrame:
    """Events straight from the three typed tables, without the owner x transaction product.

    Each side is collapsed on its own key first. Filings, owners and footnote hits then share one
    partitioning by accession with one row each. The last join meets them with the transactions,
    of which one accession may hold many, and is planned so that such an accession can be split. With
    ``colocated`` tables, bucketed by accession, that join takes them as they lie instead, without an exchange.
    """
    heads = collapse_filings(filings).join(collapse_owners(owners), "accession")
    planned = F.col("filing.is_10b5_1")
    if footnotes is not None:
        heads = heads.join(planned_filings(footnotes), "accession", "left")
        planned = planned | F.coalesce(F.col("planned_note"), F.lit(False))
    heads = heads.withColumn("planned", planned)
    collapsed = collapse_trades(trades)
    joined = collapsed.join(heads, "accession") if colocated else splittable_join(collapsed, heads, "accession")
    return joined.select(
        *EVENT_KEY,
        *[F.col(f"owner.{c}").alias(c) for c in OWNER_COLUMNS if c != "title"],
        *[F.col(f"filing.{c}").alias(c) for c in FILING_COLUMNS if c != "is_10b5_1"],
        F.col("planned").alias("is_10b5_1"),
        *[F.col(f"trade.{c}").alias(c) for c in TRADE_COLUMNS],
        F.col("titled.title").alias("title"),
        *ROLE_FLAGS,
        (F.col("n_owners") * F.col("n_filings") * F.col("n_trades")).alias("n_reporting_owners"),
    ).select(*EVENT_COLUMNS)


def plan_mentions(footnotes: DataFrame) -> DataFrame:
    """Per filing, whether any of its footnotes mentions a trading plan."""
    return footnotes.groupBy(F.col("ACCESSION_NUMBER").alias("accession")).agg(
        F.bool_or(signals.mentions_plan(F.col("FOOTNOTE_TXT"))).alias("planned_note")
    )


def planned_filings(footnotes: DataFrame) -> DataFrame:
    """The filings with a footnote that mentions a plan; the text itself is never shuffled."""
    return (
        footnotes.filter(signals.mentions_plan(F.col("FOOTNOTE_TXT")))
        .select(F.col("ACCESSION_NUMBER").alias("accession"))
        .distinct()
        .withColumn("planned_note", F.lit(True))
    )


def with_footnote_plans(df: DataFrame, footnotes: DataFrame) -> DataFrame:
    """OR footnote mentions into the planned-trade flag; filings without notes keep theirs."""
    flag = F.col("is_10b5_1") | F.coalesce(F.col("planned_note"), F.lit(False))
    joined = splittable_join(df, planned_filings(footnotes), "accession", "left")
    return joined.withColumn("is_10b5_1", flag).drop("planned_note")
