"""The test tables seen as filing, price and reference tables.

There are no real filings in the test environment, so orders play filings, line items play
transactions and suppliers play reporting owners (see FIXTURES.md for the mapping).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.schemas import DELISTING_SCHEMA

PLAN_NOTE = " adopted under Rule 10B5-1 plan"


class Tables:
    """Lazily mapped domain tables over one folder of test tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = str(folder).rstrip("/")
        self._opened: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        if name not in self._opened:
            self._opened[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._opened[name]

    def submissions(self) -> DataFrame:
        orders = self.raw("orders")
        customers = self.raw("customer")
        day = F.col("o_orderdate").cast("date")
        letter = F.col("o_custkey") % 28
        return orders.join(customers, orders.o_custkey == customers.c_custkey).select(
            F.col("o_orderkey").cast("string").alias("ACCESSION_NUMBER"),
            F.when(F.col("o_orderkey") % 97 == 0, "junk")
            .otherwise(F.upper(F.date_format(day, "dd-MMM-yyyy")))
            .alias("FILING_DATE"),
            F.upper(F.date_format(F.date_sub(day, 4), "dd-MMM-yyyy")).alias("PERIOD_OF_REPORT"),
            F.when(F.col("o_orderpriority") == "5-LOW", "4/A")
            .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "3")
            .otherwise("4")
            .alias("DOCUMENT_TYPE"),
            F.lpad(F.col("o_custkey").cast("string"), 10, "0").alias("ISSUERCIK"),
            F.col("c_name").alias("ISSUERNAME"),
            F.when(letter < 25, F.concat(F.lit("BR"), F.char(letter + 65)))
            .when(letter == 25, F.lit(None))
            .when(letter == 26, "")
            .otherwise("X-1")
            .alias("ISSUERTRADINGSYMBOL"),
            F.when(F.col("o_orderkey") % 8 == 0, "1")
            .when(F.col("o_orderkey") % 8 == 1, " TRUE ")
            .when(F.col("o_orderkey") % 8 == 2, "t")
            .when(F.col("o_orderkey") % 8 == 3, "false")
            .when(F.col("o_orderkey") % 8 == 4, "0")
            .alias("AFF10B5ONE"),
        )

    def owners(self) -> DataFrame:
        pairs = self.raw("lineitem").select("l_orderkey", "l_suppkey").distinct()
        suppliers = self.raw("supplier")
        role, title = F.col("s_suppkey") % 6, F.col("s_suppkey") % 4
        return pairs.join(suppliers, pairs.l_suppkey == suppliers.s_suppkey).select(
            F.col("l_orderkey").cast("string").alias("ACCESSION_NUMBER"),
            F.col("l_suppkey").cast("string").alias("RPTOWNERCIK"),
            F.col("s_name").alias("RPTOWNERNAME"),
            F.when(role == 0, "Director")
            .when(role == 1, "Officer")
            .when(role == 2, "Director,Officer")
            .when(role == 3, "TenPercentOwner")
            .when(role == 4, "Other")
            .alias("RPTOWNER_RELATIONSHIP"),
            F.when(title == 1, "CEO").when(title == 2, "CFO").when(title == 3, "VP")
            .alias("RPTOWNER_TITLE"),
        )

    def transactions(self) -> DataFrame:
        # The source repeats (order, line) keys; the lowest row stands for the transaction.
        order = (
            "l_suppkey", "l_partkey", "l_extendedprice", "l_quantity", "l_shipdate",
            "l_discount", "l_tax", "l_returnflag", "l_linestatus",
        )
        lines = (
            self.raw("lineitem")
            .groupBy("l_orderkey", "l_linenumber")
            .agg(F.min(F.struct(*order)).alias("line"))
            .select("l_orderkey", "l_linenumber", "line.*")
        )
        price = F.when(
            (F.col("l_tax") == 0) & (F.col("l_linenumber") == 1), F.lit(0.0)
        ).otherwise(F.col("l_extendedprice") / F.col("l_quantity"))
        return lines.select(
            F.col("l_orderkey").cast("string").alias("ACCESSION_NUMBER"),
            F.col("l_linenumber").cast("long").alias("NONDERIV_TRANS_SK"),
            F.upper(F.date_format(F.col("l_shipdate").cast("date"), "dd-MMM-yyyy"))
            .alias("TRANS_DATE"),
            F.when(F.col("l_returnflag") == "A", "P")
            .when(F.col("l_returnflag") == "N", "S")
            .when(F.col("l_returnflag") == "R", "M")
            .alias("TRANS_CODE"),
            F.col("l_quantity").alias("TRANS_SHARES"),
            price.alias("TRANS_PRICEPERSHARE"),
            F.when(F.col("l_discount") == 0.05, "F1").alias("TRANS_PRICEPERSHARE_FN"),
            F.when(F.col("l_linestatus") == "O", "A")
            .when(F.col("l_linestatus") == "F", "D")
            .alias("TRANS_ACQUIRED_DISP_CD"),
            (F.col("l_quantity") * 10).alias("SHRS_OWND_FOLWNG_TRANS"),
            F.when(F.col("l_partkey") % 2 == 0, "D").otherwise("I")
            .alias("DIRECT_INDIRECT_OWNERSHIP"),
        )

    def footnotes(self) -> DataFrame:
        return self.raw("documents").select(
            F.expr("CAST(doc_id DIV 2 AS STRING)").alias("ACCESSION_NUMBER"),
            F.when(F.col("doc_id") % 5 == 0, F.concat(F.col("text"), F.lit(PLAN_NOTE)))
            .otherwise(F.col("text"))
            .alias("FOOTNOTE_TXT"),
        )

    def _weekday_lines(self) -> DataFrame:
        day = F.col("l_shipdate").cast("date")
        return (
            self.raw("lineitem")
            .select(
                "l_partkey",
                "l_quantity",
                day.alias("date"),
                F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"),
            )
            .filter(F.dayofweek("date").between(2, 6))
        )

    def prices(self) -> DataFrame:
        parts = self.raw("part").select(
            "p_partkey",
            F.concat(
                F.lit("BR"), F.char(F.replace(F.col("p_brand"), F.lit("Brand#"), F.lit("")).cast("int") + 64)
            ).alias("ticker"),
        )
        lines = self._weekday_lines()
        return (
            lines.join(parts, lines.l_partkey == parts.p_partkey)
            .groupBy("ticker", "date")
            .agg(
                (F.min("cents") / 100).alias("open"),
                (F.sum("cents") / (F.count(F.lit(1)) * 100)).alias("close"),
                F.sum("l_quantity").alias("volume"),
            )
        )

    def benchmark(self) -> DataFrame:
        return (
            self._weekday_lines()
            .groupBy("date")
            .agg(
                (F.sum("cents") / (F.count(F.lit(1)) * 100)).alias("close"),
                (F.min("cents") / 100).alias("open"),
            )
        )

    def delistings(self) -> DataFrame:
        """One ticker is delisted, used again and delisted once more; that day is listed twice."""
        rows = [
            ("BRX", dt.date(1997, 3, 3), 20000.0),
            ("BRX", dt.date(1999, 6, 1), 0.0),
            ("BRX", dt.date(1999, 6, 1), 50000.0),
            ("BRY", dt.date(2000, 1, 3), 10000.0),
        ]
        return self.spark.createDataFrame(rows, DELISTING_SCHEMA)

    def corporate_actions(self) -> DataFrame:
        """Splits and dividends on the days of some orders; a few dividends are larger than the price."""
        key, letter = F.col("o_orderkey"), F.col("o_custkey") % 28
        return self.raw("orders").filter((letter < 25) & (key % 25 == 0)).select(
            F.concat(F.lit("BR"), F.char(letter + 65)).alias("ticker"),
            F.col("o_orderdate").cast("date").alias("ex_date"),
            F.when(key % 400 == 0, 2.0).when(key % 400 == 200, 0.5).alias("split"),
            F.when(key % 1000 == 25, F.col("o_totalprice")).when(key % 100 == 50, F.col("o_totalprice") / 1000).alias("dividend"),
        )

    def listings(self) -> DataFrame:
        """One ticker with three lives, and one that takes over the ticker of another; all others are listed throughout."""
        day = dt.date
        lives = [
            ("BRX", "ID-X1", day(1990, 1, 1), day(1997, 3, 3)), ("BRX", "ID-X2", day(1997, 3, 3), day(1999, 6, 1)), ("BRX", "ID-X3", day(1999, 6, 1), None),
            ("BRC", "ID-BRC", day(1990, 1, 1), day(1998, 1, 1)), ("BRD", "ID-BRD", day(1990, 1, 1), day(1998, 1, 1)), ("BRD", "ID-BRC", day(1998, 1, 1), None),
        ]
        special = self.spark.createDataFrame(lives, "ticker string, permanent_id string, valid_from date, valid_to date")
        others = self.raw("part").select(F.concat(F.lit("BR"), F.char(F.replace(F.col("p_brand"), F.lit("Brand#"), F.lit("")).cast("int") + 64)).alias("ticker")).distinct()
        others = others.filter(~F.col("ticker").isin("BRX", "BRC", "BRD")).select(
            "ticker", F.concat(F.lit("ID-"), "ticker").alias("permanent_id"), F.lit(day(1990, 1, 1)).alias("valid_from"), F.lit(None).cast("date").alias("valid_to")
        )
        return special.unionByName(others)

    def cost_table(self) -> DataFrame:
        """Spreads by turnover in two versions, narrower in the later one."""
        rows = [(dt.date(1995, 1, 1), 0.0, 0.020), (dt.date(1995, 1, 1), 50_000.0, 0.010), (dt.date(1995, 1, 1), 200_000.0, 0.004)]
        rows += [(dt.date(1998, 7, 1), 0.0, 0.015), (dt.date(1998, 7, 1), 120_000.0, 0.002)]
        return self.spark.createDataFrame(rows, "effective_date date, min_adv double, spread double")

    def ticker_sizes(self) -> DataFrame:
        """A ticker's size, known at each month's end: that month's traded volume."""
        return self.prices().groupBy("ticker", F.last_day("date").alias("effective_date")).agg(F.sum("volume").alias("size"))

    def ticker_sectors(self) -> DataFrame:
        """Four sectors by the brand's number; in 1998 every ticker moves on by one, and those of every eighth brand have none."""
        brand = F.replace(F.col("p_brand"), F.lit("Brand#"), F.lit("")).cast("int")
        moves = F.array(*[F.struct(F.lit(day).alias("effective_date"), F.concat(F.lit("S"), (brand + i) % 4).alias("sector")) for i, day in enumerate((dt.date(1994, 12, 15), dt.date(1998, 7, 1)))])
        return self.raw("part").select("p_brand").distinct().filter(brand % 8 != 0).select(F.concat(F.lit("BR"), F.char(brand + 64)).alias("ticker"), F.inline(moves))

    def issuer_sizes(self) -> DataFrame:
        """Issuer size by effective date: an opening figure, then a restated one."""
        base = self.raw("customer").select(
            F.col("c_custkey").cast("string").alias("issuer_cik"),
            F.col("c_acctbal").alias("size"),
        )
        return base.select(
            "issuer_cik",
            F.inline(
                F.array(
                    F.struct(F.lit(dt.date(1995, 1, 1)).alias("effective_date"),
                             F.col("size").alias("market_cap")),
                    F.struct(F.lit(dt.date(1998, 7, 1)).alias("effective_date"),
                             (F.col("size") * 2).alias("market_cap")),
                )
            ),
        )

    def cluster_probe(self) -> DataFrame:
        return self.raw("events").select(
            F.col("event_id").cast("string").alias("accession"),
            F.lit(1).cast("long").alias("txn_sk"),
            F.col("user_id").cast("string").alias("insider_id"),
            F.col("event_type").alias("issuer_cik"),
            F.col("ts").cast("date").alias("filing_date"),
        )
