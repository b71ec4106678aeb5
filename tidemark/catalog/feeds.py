"""Landed files, stored tables and the streaming feed, over data Spark writes from the tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.catalog.registry import flat_rows, query, unplanned_events
from tidemark.fixtures import Tables
from tidemark.functions import signals
from tidemark.plans import events as event_plans
from tidemark.schemas import EVENT_COLUMNS, RAW_COLUMNS
from tidemark.session import materialize, scratch_path
from tidemark.sources import filings, histories, index, landed_quarters, quarters, store
from tidemark.streaming import corrections, feed, landed

LATE_BEFORE = dt.date(1996, 1, 1)
QUARTER_END = dt.date(1999, 12, 31)


def land(df: DataFrame, path: str) -> None:
    """Write a table the way quarterly sets arrive: tab-separated text with a header."""
    (
        df.write.option("sep", "\t")
        .option("header", True)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


@query(
    "r1_drift_scan",
    "SELECT ACCESSION_NUMBER, FILING_DATE, PERIOD_OF_REPORT, DOCUMENT_TYPE, ISSUERCIK, ISSUERNAME, "
    "nullif(ISSUERTRADINGSYMBOL, '') AS ISSUERTRADINGSYMBOL, CASE WHEN PERIOD_OF_REPORT IS NOT NULL AND CAST(strptime(PERIOD_OF_REPORT, '%d-%b-%Y') AS DATE) >= DATE '1998-01-01' "
    "THEN AFF10B5ONE END AS AFF10B5ONE FROM sub",
)
def r1_drift_scan(t: Tables) -> DataFrame:
    """Early filings land without the flag and with their columns in another order.

    Text files have no empty string beside null: an empty ticker comes back as null.
    """
    root = scratch_path(t.spark, "landed")
    rows = t.submissions()
    late = signals.filing_day(F.col("PERIOD_OF_REPORT")) >= F.lit(dt.date(1998, 1, 1))
    early_columns = sorted(c for c in RAW_COLUMNS["SUBMISSION"] if c != "AFF10B5ONE")
    land(rows.filter(~late).select(*early_columns), f"{root}/early/SUBMISSION.tsv")
    land(rows.filter(late).select(*RAW_COLUMNS["SUBMISSION"]), f"{root}/late/SUBMISSION.tsv")
    return filings.scan_table(t.spark, root, "SUBMISSION").select(*RAW_COLUMNS["SUBMISSION"])


@query(
    "r2_footnotes",
    "SELECT ACCESSION_NUMBER, regexp_replace(FOOTNOTE_TXT, '[\\t\\r\\n]', ' ', 'g') AS FOOTNOTE_TXT FROM notes",
)
def r2_footnotes(t: Tables) -> DataFrame:
    root = scratch_path(t.spark, "landed")
    one_line = F.regexp_replace("FOOTNOTE_TXT", r"[\t\r\n]", " ").alias("FOOTNOTE_TXT")
    land(t.footnotes().select("ACCESSION_NUMBER", one_line), f"{root}/all/FOOTNOTES.tsv")
    return filings.load_footnotes(t.spark, root)


@query("r3_roundtrip", "SELECT * FROM ev")
def r3_roundtrip(t: Tables) -> DataFrame:
    return event_plans.build_events(
        t.submissions(), t.owners(), t.transactions(), t.footnotes(),
        out_path=scratch_path(t.spark, "events"),
    )


RELOADED = "1996q2"


@query("r3_reload", "SELECT * FROM ev")
def r3_reload(t: Tables) -> DataFrame:
    """Every quarter loaded, one of them twice; events from the tables as they lie, without an exchange of the three."""
    root = scratch_path(t.spark, "quarters")
    mark = root.rsplit("-", 1)[1]
    filed = signals.filing_day(F.col("FILING_DATE"))
    subs = t.submissions().withColumn("quarter", F.coalesce(quarters.quarter_label(filed), F.lit("undated")))
    quarter_of = materialize(subs.select("ACCESSION_NUMBER", "quarter"))
    tables = {"submission": subs, "owner": t.owners().join(quarter_of, "ACCESSION_NUMBER"), "trans": t.transactions().join(quarter_of, "ACCESSION_NUMBER")}
    tables = {name: materialize(rows) for name, rows in tables.items()}  # read by both loads, and twice by each
    buckets = landed_quarters.buckets_for(max(rows.count() for rows in tables.values()))
    for wanted in (F.lit(True), F.col("quarter") == RELOADED):
        for name, rows in tables.items():
            landed_quarters.load_quarters(rows.filter(wanted), f"{name}_{mark}", root, buckets=buckets)
    stored = [t.spark.table(f"{name}_{mark}") for name in tables]
    return signals.drop_planned(event_plans.purchase_events(*stored, t.footnotes(), colocated=True))


_QUARTERS = {
    "filed": "SELECT CAST(try_strptime(FILING_DATE, '%d-%b-%Y') AS DATE) AS day FROM sub",
    "wanted": "SELECT CAST(range AS DATE) AS q FROM range(DATE '1994-01-01', DATE '2002-10-02', INTERVAL 3 MONTH)",
}


@query(
    "r8_quarter_audit",
    "SELECT year(q) AS year, quarter(q) AS quarter, year(q) || 'q' || quarter(q) AS label FROM wanted "
    "WHERE q NOT IN (SELECT CAST(date_trunc('quarter', day) AS DATE) FROM filed WHERE day IS NOT NULL)",
    **_QUARTERS,
)
def r8_quarter_audit(t: Tables) -> DataFrame:
    filed = t.submissions().select(signals.filing_day(F.col("FILING_DATE")).alias("day"))
    landed = filed.filter(F.col("day").isNotNull()).select(
        quarters.quarter_label(F.col("day")).alias("label")
    )
    return quarters.missing_quarters(
        quarters.quarter_range(t.spark, 1994, 1, 2002, 4), landed
    )


@query(
    "r9_index",
    "SELECT '4' AS form_type, CASE CAST(ISSUERCIK AS BIGINT) % 7 WHEN 0 THEN rpad(ISSUERNAME, 61, 'x') WHEN 1 THEN rpad(ISSUERNAME, 62, 'x') ELSE ISSUERNAME END AS company, CAST(CAST(ISSUERCIK AS BIGINT) AS VARCHAR) AS cik, day AS filing_date, "
    "'edgar/data/' || CAST(ISSUERCIK AS BIGINT) || '/' || ACCESSION_NUMBER || '.txt' AS file_name, ACCESSION_NUMBER AS accession "
    "FROM (SELECT *, CAST(try_strptime(FILING_DATE, '%d-%b-%Y') AS DATE) AS day FROM sub) "
    "WHERE DOCUMENT_TYPE = '4' AND day > DATE '1999-12-31'",
)
def r9_index(t: Tables) -> DataFrame:
    """Filings written as daily-index lines, then read back and narrowed to new Form 4s."""
    root = scratch_path(t.spark, "index")
    day = signals.filing_day(F.col("FILING_DATE"))
    # Some names fill their column to the last place but one, or to the last.
    cik = F.col("ISSUERCIK").cast("long")
    name = F.when(cik % 7 == 0, F.rpad("ISSUERNAME", 61, "x")).when(cik % 7 == 1, F.rpad("ISSUERNAME", 62, "x"))
    line = F.concat(
        F.rpad("DOCUMENT_TYPE", 12, " "),
        F.rpad(F.coalesce(name, F.col("ISSUERNAME")), 62, " "),
        F.rpad(F.col("ISSUERCIK").cast("long").cast("string"), 12, " "),
        F.coalesce(F.date_format(day, "yyyyMMdd"), F.lit("unknown")),
        F.lit("    edgar/data/"),
        F.col("ISSUERCIK").cast("long").cast("string"),
        F.lit("/"),
        F.col("ACCESSION_NUMBER"),
        F.lit(".txt"),
    )
    t.submissions().select(line.alias("value")).write.text(f"{root}/form.idx")
    return index.filings_since(index.read_form_index(t.spark, f"{root}/form.idx"), QUARTER_END)


def _feed_events(t: Tables, *drops: DataFrame, footnotes: DataFrame | None = None, drop_planned: bool = False) -> DataFrame:
    """Run the feed once per drop, all under one checkpoint, and read what it emitted."""
    root = scratch_path(t.spark, "feed")
    for drop in drops:
        store.write_table(drop, f"{root}/in", mode="append")
        rows = feed.read_feed(t.spark, f"{root}/in", drop.schema)
        feed.finish_feed(
            feed.start_feed(rows, f"{root}/out", f"{root}/checkpoint", drop_planned=drop_planned, footnotes=footnotes)
        )
        feed.finish_feed(feed.start_undated(rows, f"{root}/undated", f"{root}/undated-checkpoint"))
    closed = store.read_table(t.spark, f"{root}/out").select(*EVENT_COLUMNS)
    undated = event_plans.normalize(store.read_table(t.spark, f"{root}/undated"), footnotes)
    undated = signals.drop_planned(undated) if drop_planned else undated
    return closed.unionByName(undated.select(*EVENT_COLUMNS))


@query(
    "t1_stream",
    "SELECT * FROM all_events_noscan WHERE filing_date IS NULL OR filing_date + 1 <= (SELECT max(filing_date) FROM typed_noscan) - 7",
)
def t1_stream(t: Tables) -> DataFrame:
    """Streamed events equal the batch's over the days the watermark has closed; undated rows come from their side table."""
    return _feed_events(t, flat_rows(t))


@query(
    "t2_late",
    "SELECT * FROM all_events_noscan WHERE filing_date IS NULL OR filing_date >= DATE '1996-01-01' "
    "AND filing_date + 1 <= (SELECT max(filing_date) FROM typed_noscan) - 7",
)
def t2_late(t: Tables) -> DataFrame:
    """Filings of closed years that arrive in a second drop are turned away."""
    rows = flat_rows(t)
    late = signals.filing_day(F.col("filing_date_raw")) < F.lit(LATE_BEFORE)
    return _feed_events(t, rows.filter(~F.coalesce(late, F.lit(False))), rows.filter(late))


@query(
    "t3_planned_feed",
    "SELECT * FROM ev WHERE filing_date IS NULL OR filing_date + 1 <= (SELECT max(filing_date) FROM typed_noscan) - 7",
)
def t3_planned_feed(t: Tables) -> DataFrame:
    """Without planned trades, by flag or by footnote, the feed equals the batch's event table."""
    return _feed_events(t, flat_rows(t), footnotes=t.footnotes(), drop_planned=True)


SPLIT_DAY = dt.date(1998, 1, 1)
FAR_DAY = dt.date(2030, 1, 1)


def _in_drops(rows: DataFrame, root: str, table: str, last: bool) -> None:
    """Land the rows of the first or the second half of the drops; the second ends with a filing far ahead, which closes all others."""
    half = F.col("landed") >= F.lit(SPLIT_DAY) if last else F.col("landed") < F.lit(SPLIT_DAY)
    landed.land_drop(rows.filter(half), root, table)


@query("t4_landed_feed", "SELECT * FROM ev")
def t4_landed_feed(t: Tables) -> DataFrame:
    """The three landed tables as streams. Transactions land up to a month after their filing, owners up to two, some of a filing's
    owners in another drop than the rest, and those of a fiftieth of the filings a year late."""
    root = scratch_path(t.spark, "landed-feed")
    number = F.col("ACCESSION_NUMBER").cast("long")
    months = F.trunc(F.coalesce(signals.filing_day(F.col("FILING_DATE")), F.lit(dt.date(1995, 1, 1))), "MM")
    filings = materialize(t.submissions().withColumn("landed", months))
    days = filings.select("ACCESSION_NUMBER", "landed")
    later = lambda n: F.add_months("landed", n)
    wait = F.when(number % 50 == 7, 12).when((number % 10 == 3) & (F.col("RPTOWNERCIK").cast("long") % 2 == 1), 1).otherwise(number % 3)
    tables = {
        "SUBMISSION": filings,
        "NONDERIV_TRANS": t.transactions().join(days, "ACCESSION_NUMBER").withColumn("landed", later((number % 2).cast("int"))),
        "REPORTINGOWNER": t.owners().join(days, "ACCESSION_NUMBER").withColumn("landed", later(wait.cast("int"))),
    }
    tables = {name: rows if rows is filings else materialize(rows) for name, rows in tables.items()}  # both halves of the drops read them
    ahead = {"ACCESSION_NUMBER": "END", "DOCUMENT_TYPE": "4", "TRANS_CODE": "P", "TRANS_ACQUIRED_DISP_CD": "A", "landed": FAR_DAY}
    for last in (False, True):
        for name, rows in tables.items():
            _in_drops(rows, root, name, last)
            if last:
                end = t.spark.range(1).select(*[F.lit(ahead.get(f.name)).cast(f.dataType).alias(f.name) for f in rows.schema.fields])
                landed.land_drop(end, root, name)
        sub, own, trn = (landed.read_landed(t.spark, root, n, tables[n].schema) for n in ("SUBMISSION", "REPORTINGOWNER", "NONDERIV_TRANS"))
        events = landed.landed_events(sub, own, trn, span="95 days", footnotes=t.footnotes())
        feed.finish_feed(landed.start_landed(events, f"{root}/out", f"{root}/checkpoint", drop_planned=True))
    out = landed.read_emitted(t.spark, f"{root}/out")
    settled = landed.settle_ownerless(out, store.read_table(t.spark, f"{root}/REPORTINGOWNER"))
    return out.filter("owned").select(*EVENT_COLUMNS).unionByName(settled)


def _corrected(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Versions, late rows and undated rows of a feed in two drops. A third of the owners' rows land 20 days after the filing, a seventh 400 days after."""
    root = scratch_path(t.spark, "corrections")
    owner = F.col("insider_id").cast("long")
    filed = F.coalesce(signals.filing_day(F.col("filing_date_raw")), F.lit(dt.date(1995, 1, 1)))
    wait = F.when(owner % 7 == 0, 400).when(owner % 3 == 0, 20).otherwise(0)
    rows = materialize(flat_rows(t).withColumn("landed", F.date_add(filed, wait)))
    for last in (False, True):
        half = F.col("landed") >= F.lit(SPLIT_DAY) if last else F.col("landed") < F.lit(SPLIT_DAY)
        store.write_table(rows.filter(half), f"{root}/in", mode="append")
        drop = feed.read_feed(t.spark, f"{root}/in", rows.schema)
        feed.finish_feed(corrections.start_versions(corrections.event_versions(drop), f"{root}/out", f"{root}/checkpoint"))
        feed.finish_feed(corrections.start_versions(corrections.late_rows(drop), f"{root}/late", f"{root}/late-checkpoint"))
        feed.finish_feed(feed.start_undated(drop, f"{root}/undated", f"{root}/undated-checkpoint"))
    return tuple(store.read_table(t.spark, f"{root}/{name}") for name in ("out", "late", "undated"))


@query("t2_late_side", "SELECT * FROM all_events_noscan")
def t2_late_side(t: Tables) -> DataFrame:
    """Corrected events merged with what came after their expiry, and the undated ones, are the batch's over both drops."""
    versions, late, undated = _corrected(t)
    return corrections.corrected_events(versions, late).unionByName(event_plans.normalize(undated))


@query(
    "t2_late_count",
    "SELECT count(*) FILTER (filing_date IS NOT NULL AND CAST(insider_id AS BIGINT) % 7 <> 0) AS in_time, "
    "count(*) FILTER (filing_date IS NOT NULL AND CAST(insider_id AS BIGINT) % 7 = 0) AS late, count(*) FILTER (filing_date IS NULL) AS undated FROM typed_noscan",
)
def t2_late_count(t: Tables) -> DataFrame:
    """Every input row is counted once: in an event's last version, in the late rows or in the undated ones."""
    versions, late, undated = _corrected(t)
    taken = corrections.latest_partials(versions).agg(F.coalesce(F.sum("n_reporting_owners"), F.lit(0)).alias("n"))
    count = lambda rows: rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    return taken.select(F.col("n").alias("in_time"), count(late).alias("late"), count(undated).alias("undated"))


_HISTORY_SQL = (
    "SELECT CAST(CAST(ISSUERCIK AS BIGINT) AS VARCHAR) AS cik, ACCESSION_NUMBER AS accession, DOCUMENT_TYPE AS form_type, "
    "CAST(try_strptime(FILING_DATE, '%d-%b-%Y') AS DATE) AS filing_date, CAST(strptime(PERIOD_OF_REPORT, '%d-%b-%Y') AS DATE) AS period_of_report FROM sub"
)


def _landed_histories(t: Tables) -> DataFrame:
    """Every issuer's and every owner's filings, written as histories, a line each; those of one filer and month are one line."""
    path = scratch_path(t.spark, "histories")
    day = lambda c: F.coalesce(F.date_format(signals.filing_day(F.col(c)), "yyyy-MM-dd"), F.lit(""))
    listed = t.submissions().select(
        "ACCESSION_NUMBER", "ISSUERCIK", F.col("DOCUMENT_TYPE").alias("form"), day("FILING_DATE").alias("filingDate"), day("PERIOD_OF_REPORT").alias("reportDate")
    )
    owned = listed.join(t.owners(), "ACCESSION_NUMBER").select(F.concat(F.lit("9"), F.lpad("RPTOWNERCIK", 12, "0")).alias("cik"), *listed.columns)
    rows = listed.withColumn("cik", F.col("ISSUERCIK")).unionByName(owned)
    fields = ("ACCESSION_NUMBER", "form", "filingDate", "reportDate")
    lists = rows.groupBy("cik", F.substring("reportDate", 1, 7).alias("month")).agg(F.collect_list(F.struct(*fields)).alias("f"))
    recent = F.struct(
        F.col("f.ACCESSION_NUMBER").alias("accessionNumber"), F.col("f.form").alias("form"), F.col("f.filingDate").alias("filingDate"), F.col("f.reportDate").alias("reportDate")
    )
    lists.select("cik", F.struct(recent.alias("recent")).alias("filings")).write.json(path)
    return histories.read_filing_histories(t.spark, path, lines=True)


@query("r9_histories", _HISTORY_SQL + " UNION ALL SELECT '9' || lpad(RPTOWNERCIK, 12, '0'), accession, form_type, filing_date, period_of_report FROM own JOIN listed ON accession = ACCESSION_NUMBER", listed=_HISTORY_SQL)
def r9_histories(t: Tables) -> DataFrame:
    return _landed_histories(t).select("cik", "accession", "form_type", "filing_date", "period_of_report")


@query(
    "r9_unpublished",
    "SELECT accession, filing_date, period_of_report, 1 + (SELECT count(DISTINCT RPTOWNERCIK) FROM own WHERE ACCESSION_NUMBER = accession) AS filers "
    "FROM listed WHERE form_type = '4' AND NOT (filing_date IS NOT NULL AND filing_date <= DATE '1999-12-31')",
    listed=_HISTORY_SQL,
)
def r9_unpublished(t: Tables) -> DataFrame:
    """What histories add to tables that end with a quarter."""
    published = t.submissions().filter(signals.filing_day(F.col("FILING_DATE")) <= F.lit(QUARTER_END))
    return histories.unpublished(_landed_histories(t), published)


def _landed_ticker_map(t: Tables) -> DataFrame:
    """Companies with an even number are quoted, every sixth under two tickers; a line holds at most a thousand."""
    path = scratch_path(t.spark, "tickers")
    key = F.col("c_custkey")
    quoted = t.raw("customer").filter(key % 2 == 0).select(key, F.explode(F.when(key % 6 == 0, F.array(F.lit(1), F.lit(0))).otherwise(F.array(F.lit(0)))).alias("nth"))
    entry = F.struct(key.alias("cik_str"), F.concat(F.lit("BR"), F.char((key + F.col("nth")) % 25 + 65)).alias("ticker"), F.lit("Co").alias("title"))
    objects = quoted.groupBy(F.expr("c_custkey DIV 1000")).agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct((key * 2 + F.col("nth")).cast("string").alias("key"), entry.alias("value"))))).alias("value")
    )
    objects.select("value").write.text(path)
    return histories.read_ticker_map(t.spark, path, lines=True)


_MAPPED = "SELECT CAST(c_custkey AS VARCHAR) AS cik, 'BR' || chr(CAST(65 + (c_custkey + nth) % 25 AS INTEGER)) AS ticker, c_custkey * 2 + nth AS place FROM customer, range(2) AS r(nth) WHERE c_custkey % 2 = 0 AND (nth = 0 OR c_custkey % 6 = 0)"


@query("r9_ticker_map", _MAPPED)
def r9_ticker_map(t: Tables) -> DataFrame:
    return _landed_ticker_map(t).select("cik", "ticker", "place")


@query(
    "v6_filled_tickers",
    "SELECT accession, txn_sk, CASE WHEN bad AND m.ticker IS NOT NULL THEN m.ticker ELSE e.ticker END AS ticker, bad AND m.ticker IS NOT NULL AS ticker_filled "
    "FROM (SELECT *, NOT coalesce(regexp_matches(ticker, '^[A-Za-z.]+$'), false) AS bad FROM ev) e LEFT JOIN (SELECT cik, arg_min(ticker, place) AS ticker FROM mapped GROUP BY 1) m ON m.cik = e.issuer_cik",
    mapped=_MAPPED,
)
def v6_filled_tickers(t: Tables) -> DataFrame:
    return histories.fill_tickers(unplanned_events(t), _landed_ticker_map(t)).select("accession", "txn_sk", "ticker", "ticker_filled")
