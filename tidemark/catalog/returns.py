"""Sessions, price lookups, the panel and its curves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.catalog.registry import query, r9, study_events, study_panel, unplanned_events
from tidemark.fixtures import Tables
from tidemark.functions import returns
from tidemark.operators import adjust, bootstrap, flatten, ladder, listings, sessions
from tidemark.oracle import CTES
from tidemark.plans import curve as curves
from tidemark.plans import matched, study
from tidemark.plans.panel import abnormal_returns
from tidemark.schemas import EVENT_KEY, HORIZONS
from tidemark.session import materialize

REPLICATES = 200

PANEL_COLUMNS = "accession, txn_sk, ticker, filing_date, entry_date, entry_close, priced, " + ", ".join(
    [f"ret_{h}" for h in HORIZONS] + [f"abn_{h}" for h in HORIZONS]
)


def _per_horizon(template: str) -> str:
    return " UNION ALL ".join(template.format(h=h, n=n) for h, n in HORIZONS.items())


@query("r6_calendar", "SELECT DISTINCT date FROM bench")
def r6_calendar(t: Tables) -> DataFrame:
    return sessions.trading_calendar(t.benchmark())


@query("r7_sessions", "SELECT t, cal_date FROM cal")
def r7_sessions(t: Tables) -> DataFrame:
    numbered = sessions.numbered_sessions(sessions.trading_calendar(t.benchmark()))
    return numbered.select(F.col("t").cast("long").alias("t"), "cal_date")


@query(
    "j3_asof",
    "SELECT f.accession, f.filing_date, c.t AS entry_t, c.cal_date AS entry_date FROM filed f "
    "ASOF LEFT JOIN cal c ON f.filing_date <= c.cal_date",
    filed="SELECT ACCESSION_NUMBER AS accession, CAST(try_strptime(FILING_DATE, '%d-%b-%Y') AS DATE) "
    "AS filing_date FROM sub",
)
def j3_asof(t: Tables) -> DataFrame:
    filings = flatten.typed_filings(flatten.filing_columns(t.submissions()))
    return sessions.first_tradable_session(
        filings.select("accession", "filing_date"), sessions.trading_calendar(t.benchmark())
    ).withColumn("entry_t", F.col("entry_t").cast("long"))


@query(
    "j4_ladder",
    _per_horizon(
        "SELECT e.accession, e.txn_sk, e.entry_date, '{h}' AS horizon, e.entry_t + {n} AS exit_t, c.cal_date AS exit_date "
        "FROM entry e LEFT JOIN cal c ON c.t = e.entry_t + {n}"
    ),
)
def j4_ladder(t: Tables) -> DataFrame:
    events = study_events(t).select(*EVENT_KEY, "filing_date")
    return sessions.exit_ladder(
        events, sessions.trading_calendar(t.benchmark()), HORIZONS
    ).drop("filing_date")


@query(
    "j5_prices",
    _per_horizon(
        "SELECT e.accession, e.txn_sk, p0.close AS entry_close, '{h}' AS horizon, p.close AS exit_close FROM entry e "
        "LEFT JOIN px p0 ON p0.ticker = e.ticker AND p0.date = e.entry_date "
        "LEFT JOIN cal c ON c.t = e.entry_t + {n} "
        "LEFT JOIN px p ON p0.close IS NOT NULL AND p.ticker = e.ticker AND p.date = c.cal_date"
    ),
)
def j5_prices(t: Tables) -> DataFrame:
    numbered = sessions.numbered_sessions(sessions.trading_calendar(t.benchmark()))
    placed = sessions.first_tradable_session(
        study_events(t), sessions.trading_calendar(t.benchmark())
    ).withColumn("entry_t", F.col("entry_t").cast("long"))
    px = ladder.exit_prices(ladder.session_prices(t.prices(), numbered), HORIZONS)
    found = placed.join(
        px.withColumnRenamed("t", "entry_t").drop("cal_date"), ["ticker", "entry_t"], "left"
    )
    exits = [
        F.struct(F.lit(h).alias("horizon"), F.col(f"exit_{h}").alias("exit_close"))
        for h in HORIZONS
    ]
    return found.select(
        *EVENT_KEY, F.col("close").alias("entry_close"), F.inline(F.array(*exits))
    )


@query(
    "j6_benchmark",
    _per_horizon(
        "SELECT e.accession, e.txn_sk, '{h}' AS horizon, b1.close / b0.close - 1.0 AS bench_ret FROM entry e "
        "LEFT JOIN bench b0 ON b0.date = e.entry_date LEFT JOIN cal c ON c.t = e.entry_t + {n} "
        "LEFT JOIN bench b1 ON b1.date = c.cal_date"
    ),
)
def j6_benchmark(t: Tables) -> DataFrame:
    market = t.benchmark()
    numbered = sessions.numbered_sessions(sessions.trading_calendar(market))
    placed = sessions.with_entry(
        study_events(t), numbered, sessions.entry_calendar(numbered, market, HORIZONS)
    )
    cells = [
        F.struct(F.lit(h).alias("horizon"), F.col(f"bench_ret_{h}").alias("bench_ret"))
        for h in HORIZONS
    ]
    return placed.select(*EVENT_KEY, F.inline(F.array(*cells)))


@query(
    "v1_return",
    "SELECT p.ticker, p.date, CASE WHEN open > 0 THEN CASE WHEN p.date >= d.delist_date "
    "THEN coalesce(recovery_value, 0.0) / open - 1.0 ELSE close / open - 1.0 END END AS ret "
    "FROM px p ASOF LEFT JOIN delist_days d ON p.ticker = d.ticker AND p.date >= d.delist_date",
)
def v1_return(t: Tables) -> DataFrame:
    dated = t.prices().join(ladder.delisting_history(t.delistings()), "ticker", "left")
    dated = dated.withColumn("end", ladder.last_delisting(F.col("date")))
    return dated.select(
        "ticker",
        "date",
        returns.forward_return(
            F.col("open"), F.col("close"), F.col("end").isNotNull(), F.col("end.recovery_value")
        ).alias("ret"),
    )


@query("v2_panel", f"SELECT {PANEL_COLUMNS} FROM wide")
def v2_panel(t: Tables) -> DataFrame:
    return study_panel(t)


@query("v2_next_open", f"SELECT {PANEL_COLUMNS} FROM wide_next")
def v2_next_open(t: Tables) -> DataFrame:
    """Filled at the open after the first session, stock and benchmark alike."""
    return study_panel(t, entry_field="open", entry_lag=1)


@query("v3_delist", f"SELECT {PANEL_COLUMNS} FROM wide_delisted")
def v3_delist(t: Tables) -> DataFrame:
    return study_panel(t, delistings=t.delistings())


_ADJUSTED = {
    "actions": "SELECT 'BR' || chr(CAST(65 + o_custkey % 28 AS INTEGER)) AS ticker, CAST(o_orderdate AS DATE) AS ex_date, "
    "CASE o_orderkey % 400 WHEN 0 THEN 2.0::DOUBLE WHEN 200 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS split, "
    "CASE WHEN o_orderkey % 1000 = 25 THEN o_totalprice WHEN o_orderkey % 100 = 50 THEN o_totalprice / 1000 ELSE 0 END AS dividend "
    "FROM orders WHERE o_custkey % 28 < 25 AND o_orderkey % 25 = 0",
    "day_actions": "SELECT ticker, ex_date, product(split) AS split, sum(dividend) AS dividend FROM actions GROUP BY 1, 2",
    "quotes": CTES["px"],
    "valued_actions": "SELECT a.*, q.close AS last_close FROM day_actions a ASOF LEFT JOIN quotes q ON q.ticker = a.ticker AND a.ex_date > q.date",
    "factors": "SELECT q.ticker, q.date, coalesce(list_product(list(1.0::DOUBLE / v.split * CASE WHEN v.dividend < v.last_close THEN 1 - v.dividend / v.last_close ELSE 1 END ORDER BY v.ex_date DESC)), 1) AS factor, "
    "coalesce(product(v.split), 1) AS shares FROM quotes q LEFT JOIN valued_actions v ON v.ticker = q.ticker AND v.ex_date > q.date GROUP BY 1, 2",
    "px": "SELECT q.ticker, q.date, q.open * f.factor AS open, q.close * f.factor AS close, q.volume * f.shares AS volume, f.factor "
    "FROM quotes q JOIN factors f ON f.ticker = q.ticker AND f.date = q.date",
}


@query("r4_adjusted", "SELECT ticker, date, round(open, 7) AS open, round(close, 7) AS close, round(volume, 7) AS volume, round(factor, 9) AS factor FROM px", **_ADJUSTED)
def r4_adjusted(t: Tables) -> DataFrame:
    adjusted = adjust.adjusted_prices(t.prices(), t.corporate_actions())
    return adjusted.select("ticker", "date", *[F.round(c, 7).alias(c) for c in ("open", "close", "volume")], r9("factor"))


@query("r4_unbooked", "SELECT ticker, ex_date AS date, round(dividend, 4) AS dividend, round(last_close, 4) AS last_close FROM valued_actions WHERE dividend >= last_close", **_ADJUSTED)
def r4_unbooked(t: Tables) -> DataFrame:
    return adjust.unbooked_dividends(t.prices(), t.corporate_actions()).select("ticker", "date", *[F.round(c, 4).alias(c) for c in ("dividend", "last_close")])


@query(
    "v2_total_return",
    "SELECT accession, txn_sk, ticker, entry_date, priced, " + ", ".join(f"round(ret_{h}, 9) AS ret_{h}, round(abn_{h}, 9) AS abn_{h}" for h in HORIZONS) + " FROM wide",
    **_ADJUSTED,
)
def v2_total_return(t: Tables) -> DataFrame:
    """The panel of returns with splits and dividends in them."""
    panel = abnormal_returns(study_events(t), adjust.adjusted_prices(t.prices(), t.corporate_actions()), t.benchmark())
    return panel.select("accession", "txn_sk", "ticker", "entry_date", "priced", *[r9(f"{k}_{h}") for h in HORIZONS for k in ("ret", "abn")])


_LISTED = {
    "lives": "SELECT * FROM (VALUES ('BRX', 'ID-X1', DATE '1990-01-01', DATE '1997-03-03'), ('BRX', 'ID-X2', DATE '1997-03-03', DATE '1999-06-01'), ('BRX', 'ID-X3', DATE '1999-06-01', NULL), "
    "('BRC', 'ID-BRC', DATE '1990-01-01', DATE '1998-01-01'), ('BRD', 'ID-BRD', DATE '1990-01-01', DATE '1998-01-01'), ('BRD', 'ID-BRC', DATE '1998-01-01', NULL)) AS l(ticker, id, since, until) "
    "UNION ALL SELECT DISTINCT ticker, 'ID-' || ticker, DATE '1990-01-01', NULL FROM quoted WHERE ticker NOT IN ('BRX', 'BRC', 'BRD')",
    "quoted": CTES["px"],
    "px": "SELECT l.id AS ticker, p.date, p.open, p.close, p.volume FROM quoted p JOIN lives l ON l.ticker = p.ticker AND p.date >= l.since AND (l.until IS NULL OR p.date < l.until)",
    "named": CTES["elig"],
    "elig": "SELECT e.* REPLACE (l.id AS ticker) FROM named e LEFT JOIN lives l ON l.ticker = e.ticker AND e.filing_date >= l.since AND (l.until IS NULL OR e.filing_date < l.until)",
}


@query("v3_permanent", f"SELECT {PANEL_COLUMNS} FROM wide", **_LISTED)
def v3_permanent(t: Tables) -> DataFrame:
    """The panel under permanent ids: a reused ticker's lives apart, a renamed company's prices together."""
    known = t.listings()
    prices = listings.by_permanent_id(t.prices(), known, "date").filter(F.col("ticker").isNotNull())
    return abnormal_returns(listings.by_permanent_id(study_events(t), known, "filing_date"), prices, t.benchmark())


_BANDED = {
    "months": "SELECT DISTINCT CAST(date_trunc('month', cal_date) AS DATE) AS month FROM cal",
    "month_sizes": "SELECT ticker, last_day(date) AS since, sum(volume) AS size FROM px GROUP BY 1, 2",
    "as_of": "SELECT m.month, s.ticker, arg_max(s.size, s.since) AS size FROM months m JOIN month_sizes s ON s.since <= m.month GROUP BY 1, 2",
    "breaks": "SELECT month, quantile_cont(size, 1.0 / 3) AS q1, quantile_cont(size, 2.0 / 3) AS q2 FROM as_of GROUP BY 1",
    "bands": "SELECT a.ticker, a.month, 1 + (size > q1)::INTEGER + (size > q2)::INTEGER AS band FROM as_of a JOIN breaks b ON b.month = a.month",
    "every": "SELECT p.ticker, c.t, b.band, " + ", ".join(f"p{h}.close / nullif(p.close, 0) - 1.0 AS ret_{h}" for h in HORIZONS)
    + " FROM px p JOIN cal c ON c.cal_date = p.date LEFT JOIN bands b ON b.ticker = p.ticker AND b.month = date_trunc('month', p.date) "
    + " ".join(f"LEFT JOIN cal c{h} ON c{h}.t = c.t + {n} LEFT JOIN px p{h} ON p{h}.ticker = p.ticker AND p{h}.date = c{h}.cal_date" for h, n in HORIZONS.items()),
    "series": "SELECT t, band, " + ", ".join(f"avg(ret_{h}) AS band_{h}" for h in HORIZONS) + " FROM every WHERE band IS NOT NULL GROUP BY 1, 2",
}


@query(
    "v2_size_matched",
    "SELECT e.accession, e.txn_sk, e.ticker, e.entry_date, x.band, " + ", ".join(f"round(x.ret_{h}, 9) AS ret_{h}, round(x.ret_{h} - s.band_{h}, 9) AS abn_{h}" for h in HORIZONS)
    + " FROM entry e LEFT JOIN every x ON x.ticker = e.ticker AND x.t = e.entry_t LEFT JOIN series s ON s.t = x.t AND s.band = x.band",
    **_BANDED,
)
def v2_size_matched(t: Tables) -> DataFrame:
    found = matched.size_matched_returns(study_events(t), t.prices(), t.benchmark(), t.ticker_sizes())
    return found.select("accession", "txn_sk", "ticker", "entry_date", "band", *[r9(f"{k}_{h}") for h in HORIZONS for k in ("ret", "abn")])


_SECTORED = {
    **_BANDED,
    "brands": "SELECT DISTINCT CAST(replace(p_brand, 'Brand#', '') AS INTEGER) AS b FROM part",
    "sectors": "SELECT 'BR' || chr(CAST(64 + b AS INTEGER)) AS ticker, 'S' || CAST(b % 4 AS VARCHAR) AS early, 'S' || CAST((b + 1) % 4 AS VARCHAR) AS late FROM brands WHERE b % 8 <> 0",
    "grouped": "SELECT e.*, CASE WHEN c.cal_date >= DATE '1998-07-01' THEN s.late ELSE s.early END AS sector FROM every e JOIN cal c ON c.t = e.t LEFT JOIN sectors s ON s.ticker = e.ticker",
    "sector_band": "SELECT t, sector, band, " + ", ".join(f"CASE WHEN count(ret_{h}) >= 3 THEN avg(ret_{h}) END AS m_{h}" for h in HORIZONS) + " FROM grouped WHERE sector IS NOT NULL AND band IS NOT NULL GROUP BY 1, 2, 3",
    "sector_all": "SELECT t, sector, " + ", ".join(f"CASE WHEN count(ret_{h}) >= 3 THEN avg(ret_{h}) END AS m_{h}" for h in HORIZONS) + " FROM grouped WHERE sector IS NOT NULL GROUP BY 1, 2",
}


@query(
    "v2_sector_matched",
    "SELECT e.accession, e.txn_sk, e.ticker, e.entry_date, x.sector, CASE WHEN x.sector IS NOT NULL THEN x.band END AS band, " + ", ".join(f"round(x.ret_{h}, 9) AS ret_{h}, round(x.ret_{h} - coalesce(b.m_{h}, s.m_{h}), 9) AS abn_{h}" for h in HORIZONS)
    + " FROM entry e LEFT JOIN grouped x ON x.ticker = e.ticker AND x.t = e.entry_t LEFT JOIN sector_band b ON b.t = x.t AND b.sector = x.sector AND b.band = x.band LEFT JOIN sector_all s ON s.t = x.t AND s.sector = x.sector",
    **_SECTORED,
)
def v2_sector_matched(t: Tables) -> DataFrame:
    found = matched.sector_matched_returns(study_events(t), t.prices(), t.benchmark(), t.ticker_sectors(), t.ticker_sizes())
    return found.select("accession", "txn_sk", "ticker", "entry_date", "sector", "band", *[r9(f"{k}_{h}") for h in HORIZONS for k in ("ret", "abn")])


_WINDOWED = {
    "bounds": "SELECT min(filing_date) AS first, max(filing_date) + 420 AS last FROM elig",
    "bench": "SELECT date, CAST(sum(cents) AS DOUBLE) / CAST(100 * count(*) AS DOUBLE) AS close FROM lines "
    "WHERE date BETWEEN (SELECT first FROM bounds) AND (SELECT last FROM bounds) GROUP BY 1",
}


@query(
    "v4_study",
    "SELECT horizon, CAST(count(abn) AS BIGINT) AS n, round(avg(abn), 9) AS mean_abn, "
    "(SELECT count(*) FROM wide) AS n_events, (SELECT count(*) FROM wide WHERE priced) AS n_priced, "
    "(SELECT round(avg(CAST(priced AS INTEGER)), 9) FROM wide) AS coverage FROM long GROUP BY horizon",
    **_WINDOWED,
)
def v4_study(t: Tables) -> DataFrame:
    """The whole study without sampling: curve beside coverage."""
    panel = materialize(
        study.study_panel(
            unplanned_events(t), t.prices(), t.benchmark()
        )
    )
    scope = curves.coverage(panel)
    part = {c: scope.select(c).scalar() for c in ("n_events", "n_priced")}
    return curves.horizon_means(panel).select(
        "horizon",
        "n",
        r9("mean_abn"),
        part["n_events"].alias("n_events"),
        part["n_priced"].alias("n_priced"),
        r9(F.try_divide(part["n_priced"], part["n_events"]), "coverage"),
    )


# Poisson(1) weights from an md5 of the event key: one digest serves four replicates.
_STEPS = " + ".join(f"(u >= {s})::INTEGER" for s in bootstrap.POISSON_STEPS)
BOOT_CTES = {
    "quads": f"SELECT CAST(range AS BIGINT) AS quad FROM range({REPLICATES // 4})",
    "slots": "SELECT CAST(range AS BIGINT) AS slot FROM range(4)",
    "digests": "SELECT accession, txn_sk, quad, md5(accession || '|' || txn_sk || '|' || quad) AS d FROM entry, quads",
    "weights": f"SELECT accession, txn_sk, quad * 4 + slot AS replicate, {_STEPS} AS w FROM "
    "(SELECT *, CAST('0x' || substr(d, 1 + 8 * slot, 8) AS BIGINT) AS u FROM digests, slots)",
    "replicates": "SELECT l.horizon, w.replicate, sum(w.w * l.abn) / sum(w.w) AS mean FROM weights w "
    "JOIN long l ON w.accession = l.accession AND w.txn_sk = l.txn_sk WHERE l.abn IS NOT NULL AND w.w > 0 "
    "GROUP BY 1, 2",
    "intervals": "SELECT horizon, list_sort(list(mean)) AS m FROM replicates GROUP BY 1",
    "points": "SELECT horizon, CAST(count(abn) AS BIGINT) AS n, avg(abn) AS mean_abn FROM long GROUP BY 1",
    "curve": f"SELECT p.horizon, p.n, p.mean_abn, m[{bootstrap.rank_index(2.5, REPLICATES) + 1}] AS ci_lo, "
    f"m[{bootstrap.rank_index(97.5, REPLICATES) + 1}] AS ci_hi FROM points p LEFT JOIN intervals i ON p.horizon = i.horizon",
    "judged": "SELECT *, CASE WHEN mean_abn IS NULL THEN 'no data' WHEN ci_lo > 0 THEN 'positive' "
    "WHEN ci_hi < 0 THEN 'negative' ELSE 'includes 0' END AS verdict FROM curve",
}


def _curve(t: Tables) -> DataFrame:
    return curves.poisson_curve(materialize(study_panel(t)), n_boot=REPLICATES)


@query(
    "a6_curve",
    "SELECT horizon, n, round(mean_abn, 9) AS mean_abn, round(ci_lo, 9) AS ci_lo, round(ci_hi, 9) AS ci_hi FROM curve",
    **BOOT_CTES,
)
def a6_curve(t: Tables) -> DataFrame:
    return _curve(t).select("horizon", "n", r9("mean_abn"), r9("ci_lo"), r9("ci_hi"))


@query(
    "a7_bootstrap_md5",
    "SELECT horizon, replicate, round(mean, 9) AS mean FROM replicates",
    **BOOT_CTES,
)
def a7_bootstrap_md5(t: Tables) -> DataFrame:
    values = [f"abn_{h}" for h in HORIZONS]
    wide = bootstrap.poisson_means(study_panel(t), values, EVENT_KEY, [], REPLICATES)
    cells = [
        F.struct(F.lit(h).alias("horizon"), F.col(f"mean_abn_{h}").alias("mean")) for h in HORIZONS
    ]
    long = wide.select("replicate", F.inline(F.array(*cells)))
    return long.filter(F.col("mean").isNotNull()).select("horizon", "replicate", r9("mean"))


BOUNDS_SQL = (
    "SELECT horizon, CAST(count(abn) AS BIGINT) AS n, round(avg(abn), 9) AS mean_abn, CASE WHEN count(abn) > 0 THEN 10000 ELSE 0 END AS replicates, "
    "count(abn) >= 30 AS brackets_mean, count(abn) >= 30 AS normal_centre, count(abn) >= 30 AS normal_width FROM long GROUP BY 1"
)


@query("a7_bootstrap_exact", BOUNDS_SQL)
def a7_bootstrap_exact(t: Tables) -> DataFrame:
    """Random draws, held against the data's own normal interval.

    With 30 values or more, the replicates' interval must bracket the mean, its centre lie within 0.3
    half-widths of the mean, and its width within 20 per cent of the normal one; with fewer nothing is claimed.
    """
    return _held_by_replicates(t, bootstrap.resampled_means)


def _held_by_replicates(t: Tables, draw) -> DataFrame:
    rows = curves.long_returns(materialize(study_panel(t)))
    means = materialize(draw(rows, "abn", ["horizon"], 10_000))
    drawn = bootstrap.percentile_interval(means, ["horizon"], 10_000)
    number = means.groupBy("horizon").agg(F.count(F.lit(1)).cast("int").alias("replicates"))
    held = _held_by_data(rows, drawn).join(number, "horizon", "left")
    return held.withColumn("replicates", F.coalesce("replicates", F.lit(0)))


def _held_by_data(rows: DataFrame, drawn: DataFrame) -> DataFrame:
    """Intervals (horizon, ci_lo, ci_hi) against the normal interval of the data."""
    data = rows.groupBy("horizon").agg(
        F.count("abn").alias("n"), F.avg("abn").alias("mean_abn"),
        (1.959964 * F.stddev_pop("abn") / F.sqrt(F.count("abn"))).alias("half"),
    )
    held = data.join(drawn, "horizon", "left")
    enough = F.col("n") >= 30
    centre, width = (F.col("ci_lo") + F.col("ci_hi")) / 2, (F.col("ci_hi") - F.col("ci_lo")) / 2
    return held.select(
        "horizon", "n", r9("mean_abn"),
        (enough & F.col("mean_abn").between(F.col("ci_lo"), F.col("ci_hi"))).alias("brackets_mean"),
        (enough & (F.abs(centre - F.col("mean_abn")) <= 0.3 * F.col("half"))).alias("normal_centre"),
        (enough & (F.abs(width - F.col("half")) <= 0.2 * F.col("half"))).alias("normal_width"),
    )


@query("a7_bucketed", BOUNDS_SQL.replace("CASE WHEN count(abn) > 0 THEN 10000 ELSE 0 END", "CASE WHEN count(abn) >= 30 THEN 10000 END"))
def a7_bucketed(t: Tables) -> DataFrame:
    """Poisson weights drawn per bucket, held as ``a7_bootstrap_exact`` is; of a few rows some replicates draw nothing."""
    held = _held_by_replicates(t, bootstrap.bucketed_means)
    return held.withColumn("replicates", F.when(F.col("n") >= 30, F.col("replicates")))


@query(
    "a7_little",
    "SELECT horizon, CAST(count(abn) AS BIGINT) AS n, round(avg(abn), 9) AS mean_abn, "
    "count(abn) >= 30 AS brackets_mean, count(abn) >= 30 AS normal_centre, count(abn) >= 30 AS normal_width FROM long GROUP BY 1",
)
def a7_little(t: Tables) -> DataFrame:
    """The bag of little bootstraps, held to the same bounds."""
    rows = curves.long_returns(materialize(study_panel(t)))
    found = bootstrap.little_intervals(rows, "abn", EVENT_KEY, ["horizon"], subsets=100)
    return _held_by_data(rows, found.select("horizon", "ci_lo", "ci_hi"))


@query(
    "a8_coverage",
    "SELECT count(*) AS n_events, count(*) FILTER (WHERE priced) AS n_priced, "
    "round(avg(CAST(priced AS INTEGER)), 9) AS coverage FROM wide",
)
def a8_coverage(t: Tables) -> DataFrame:
    return curves.coverage(study_panel(t)).select("n_events", "n_priced", r9("coverage"))


@query("a9_verdict", "SELECT horizon, n, verdict FROM judged", **BOOT_CTES)
def a9_verdict(t: Tables) -> DataFrame:
    return curves.with_verdicts(_curve(t)).select("horizon", "n", "verdict")


@query(
    "a10_gate",
    "SELECT coalesce(bool_or(ci_lo > 0), false) AS any_positive, "
    "CASE WHEN coalesce(bool_or(ci_lo > 0), false) THEN 'continue' ELSE 'stop' END AS decision FROM curve",
    **BOOT_CTES,
)
def a10_gate(t: Tables) -> DataFrame:
    return curves.gate(_curve(t))


@query(
    "r4_prices",
    "SELECT ticker, date, open, close, volume FROM px WHERE ticker IN (SELECT ticker FROM elig) "
    "AND date BETWEEN (SELECT min(filing_date) FROM elig) AND (SELECT max(filing_date) + 420 FROM elig)",
)
def r4_prices(t: Tables) -> DataFrame:
    from tidemark.sources.prices import daily_closes, study_window

    events = materialize(study_events(t).select("ticker", "filing_date"))
    return daily_closes(t.prices(), events, *study_window(events))


@query("r5_unpivot", "SELECT ticker, date, open, close FROM px WHERE close IS NOT NULL")
def r5_unpivot(t: Tables) -> DataFrame:
    from tidemark.sources.prices import wide_to_long

    # A wide table has one column per ticker, so their number is bounded by its layout.
    tickers = [r["ticker"] for r in t.prices().select("ticker").distinct().orderBy("ticker").collect()]
    wide = (
        t.prices()
        .groupBy("date")
        .pivot("ticker", tickers)
        .agg(F.first("open").alias("open"), F.first("close").alias("close"))
    )
    return wide_to_long(wide, tickers)
