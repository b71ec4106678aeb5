"""Segment features, baskets and exits."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.catalog.registry import ORACLE, query, r9, study_events, study_panel, unplanned_events
from tidemark.catalog.returns import BOOT_CTES, REPLICATES
from tidemark.fixtures import Tables
from tidemark.functions import signals
from tidemark.operators import basket, ladder, medians, segments, sessions
from tidemark.plans import curve as curves
from tidemark.plans.panel import abnormal_returns
from tidemark.schemas import EVENT_KEY, HORIZONS
from tidemark.session import materialize

BANDS = ((3_000.0, "micro"), (6_000.0, "small"), (9_000.0, "mid"))
HOLD = 63
EMBARGO = 45
CUTOFF = dt.date(1999, 1, 1)

_BUCKET = (
    "CASE WHEN regexp_matches(coalesce(title, ''), '(?i)\\bceo\\b|chief executive') THEN 'CEO' "
    "WHEN regexp_matches(coalesce(title, ''), '(?i)\\bcfo\\b|chief financial') THEN 'CFO' "
    "WHEN is_director THEN 'Director' WHEN is_ten_percent_owner THEN '10% owner' ELSE 'Other' END"
)


def _px(t: Tables) -> DataFrame:
    numbered = sessions.numbered_sessions(sessions.trading_calendar(t.benchmark()))
    return ladder.session_prices(t.prices(), numbered)


@query("g1_role_bucket", f"SELECT accession, txn_sk, {_BUCKET} AS role_bucket FROM ev")
def g1_role_bucket(t: Tables) -> DataFrame:
    return segments.with_role_bucket(unplanned_events(t)).select(*EVENT_KEY, "role_bucket")


@query(
    "g2_own_size",
    "SELECT e.accession, e.txn_sk, round(quantile_cont(p.value, 0.5), 6) AS prior_median, "
    "round(e.value / nullif(quantile_cont(p.value, 0.5), 0), 6) AS value_vs_own "
    "FROM ev e LEFT JOIN ev p ON p.insider_id = e.insider_id AND p.filing_date < e.filing_date "
    "GROUP BY e.accession, e.txn_sk, e.value",
)
def g2_own_size(t: Tables) -> DataFrame:
    sized = medians.with_own_size(materialize(unplanned_events(t)))
    return sized.select(
        *EVENT_KEY,
        F.round("prior_median", 6).alias("prior_median"),
        F.round("value_vs_own", 6).alias("value_vs_own"),
    )


@query(
    "g2_own_size_probe",
    "SELECT DISTINCT e.user_id AS insider_id, e.day AS filing_date, round(q.m, 6) AS prior_median FROM probe e LEFT JOIN "
    "(SELECT d.user_id, d.day, quantile_cont(p.value, 0.5) AS m FROM (SELECT DISTINCT user_id, day FROM probe) d "
    "JOIN probe p ON p.user_id = d.user_id AND p.day < d.day GROUP BY 1, 2) q ON q.user_id = e.user_id AND q.day = e.day",
    probe="SELECT CAST(CASE WHEN user_id % 3 = 0 THEN 0 ELSE user_id END AS VARCHAR) AS user_id, CAST(ts AS DATE) AS day, value FROM events",
)
def g2_own_size_probe(t: Tables) -> DataFrame:
    """A third of the users act as one, so the busy route is taken beside the calm one."""
    return medians.prior_medians(materialize(_probe_rows(t))).select(
        "insider_id", "filing_date", F.round("prior_median", 6).alias("prior_median")
    )


def _probe_rows(t: Tables) -> DataFrame:
    user = F.when(F.col("user_id") % 3 == 0, 0).otherwise(F.col("user_id")).cast("string")
    return t.raw("events").select(user.alias("insider_id"), F.col("ts").cast("date").alias("filing_date"), "value")


@query("g2_refined_probe", ORACLE["g2_own_size_probe"])
def g2_refined_probe(t: Tables) -> DataFrame:
    """The same with buckets of at most a hundred rows, so that the busy ones are cut again and again."""
    return medians.prior_medians(materialize(_probe_rows(t)), window_rows=50, bucket_rows=100).select(
        "insider_id", "filing_date", F.round("prior_median", 6).alias("prior_median")
    )


_SIZED = {
    "sized": "SELECT e.accession, e.txn_sk, e.value, s.market_cap FROM ev e "
    "ASOF LEFT JOIN sizes s ON e.issuer_cik = s.issuer_cik AND e.filing_date >= s.effective_date"
}


@query(
    "g3_company_size",
    "SELECT accession, txn_sk, value / nullif(market_cap, 0) AS value_vs_company FROM sized",
    **_SIZED,
)
def g3_company_size(t: Tables) -> DataFrame:
    return segments.with_market_cap(materialize(unplanned_events(t)), t.issuer_sizes(), BANDS).select(
        *EVENT_KEY, "value_vs_company"
    )


def _cluster_sql(source: str) -> str:
    return (
        f"SELECT e.accession, e.txn_sk, CASE WHEN e.filing_date IS NOT NULL THEN count(DISTINCT p.insider_id) END "
        f"AS cluster_size FROM {source} e LEFT JOIN {source} p ON p.issuer_cik = e.issuer_cik "
        f"AND p.filing_date BETWEEN e.filing_date - 30 AND e.filing_date GROUP BY e.accession, e.txn_sk, e.filing_date"
    )


@query("g4_cluster", _cluster_sql("ev"))
def g4_cluster(t: Tables) -> DataFrame:
    return segments.with_cluster_size(materialize(unplanned_events(t))).select(
        *EVENT_KEY, "cluster_size"
    )


@query(
    "g4_cluster_probe",
    "SELECT e.accession, e.txn_sk, d.cluster_size FROM probe e JOIN (SELECT i.issuer_cik, i.filing_date, "
    "count(DISTINCT p.insider_id) AS cluster_size FROM (SELECT DISTINCT issuer_cik, filing_date FROM probe) i "
    "JOIN (SELECT DISTINCT issuer_cik, insider_id, filing_date FROM probe) p ON p.issuer_cik = i.issuer_cik "
    "AND p.filing_date BETWEEN i.filing_date - 7 AND i.filing_date GROUP BY 1, 2) d "
    "ON d.issuer_cik = e.issuer_cik AND d.filing_date = e.filing_date",
    probe="SELECT CAST(event_id AS VARCHAR) AS accession, CAST(1 AS BIGINT) AS txn_sk, CAST(user_id AS VARCHAR) "
    "AS insider_id, event_type AS issuer_cik, CAST(ts AS DATE) AS filing_date FROM events",
)
def g4_cluster_probe(t: Tables) -> DataFrame:
    return segments.with_cluster_size(t.cluster_probe(), 7).select(*EVENT_KEY, "cluster_size")


@query(
    "g5_routine",
    "SELECT e.accession, e.txn_sk, count(DISTINCT m.y) >= 2 AS is_routine FROM ev e LEFT JOIN (SELECT DISTINCT "
    "insider_id, year(filing_date) AS y, month(filing_date) AS m FROM ev WHERE filing_date IS NOT NULL) m "
    "ON m.insider_id = e.insider_id AND m.m = month(e.filing_date) AND m.y BETWEEN year(e.filing_date) - 2 "
    "AND year(e.filing_date) - 1 GROUP BY 1, 2",
)
def g5_routine(t: Tables) -> DataFrame:
    return segments.with_routine_flag(materialize(unplanned_events(t)), years=2).select(
        *EVENT_KEY, "is_routine"
    )


@query(
    "g6_cap_band",
    "SELECT accession, txn_sk, market_cap, CASE WHEN market_cap IS NULL THEN 'unknown' WHEN market_cap < 3000 THEN 'micro' "
    "WHEN market_cap < 6000 THEN 'small' WHEN market_cap < 9000 THEN 'mid' ELSE 'large' END AS cap_band FROM sized",
    **_SIZED,
)
def g6_cap_band(t: Tables) -> DataFrame:
    return segments.with_market_cap(materialize(unplanned_events(t)), t.issuer_sizes(), BANDS).select(
        *EVENT_KEY, "market_cap", "cap_band"
    )


@query(
    "g7_year_high",
    "SELECT e.accession, e.txn_sk, h.high AS high_52w, h.close / h.high - 1.0 AS vs_high FROM entry e LEFT JOIN "
    "(SELECT p.ticker, p.date, p.close, max(q.close) AS high FROM px p JOIN px q ON q.ticker = p.ticker "
    "AND q.date BETWEEN p.date - 365 AND p.date GROUP BY 1, 2, 3) h ON h.ticker = e.ticker AND h.date = e.entry_date",
)
def g7_year_high(t: Tables) -> DataFrame:
    panel = study_panel(t, price_features=segments.year_high_features())
    return panel.select(*EVENT_KEY, "high_52w", "vs_high")


@query(
    "g8_segment_curve",
    "SELECT p.role_bucket, p.horizon, p.n, round(p.mean_abn, 9) AS mean_abn, "
    f"round(m[{int(2.5 / 100 * REPLICATES) + 1}], 9) AS ci_lo, round(m[{int(97.5 / 100 * REPLICATES) + 1}], 9) AS ci_hi "
    "FROM seg_points p LEFT JOIN seg_intervals i ON p.role_bucket = i.role_bucket AND p.horizon = i.horizon",
    **BOOT_CTES,
    seg_long=f"SELECT l.*, {_BUCKET} AS role_bucket FROM long l JOIN elig e ON l.accession = e.accession AND l.txn_sk = e.txn_sk",
    seg_points="SELECT role_bucket, horizon, CAST(count(abn) AS BIGINT) AS n, avg(abn) AS mean_abn FROM seg_long GROUP BY 1, 2",
    seg_means="SELECT l.role_bucket, l.horizon, w.replicate, sum(w.w * l.abn) / sum(w.w) AS mean FROM weights w "
    "JOIN seg_long l ON w.accession = l.accession AND w.txn_sk = l.txn_sk WHERE l.abn IS NOT NULL AND w.w > 0 GROUP BY 1, 2, 3",
    seg_intervals="SELECT role_bucket, horizon, list_sort(list(mean)) AS m FROM seg_means GROUP BY 1, 2",
)
def g8_segment_curve(t: Tables) -> DataFrame:
    panel = study_panel(t, carry=("title", "is_director", "is_ten_percent_owner"))
    bucketed = materialize(segments.with_role_bucket(panel))
    curve = curves.poisson_curve(bucketed, n_boot=REPLICATES, by=["role_bucket"])
    return curve.select("role_bucket", "horizon", "n", r9("mean_abn"), r9("ci_lo"), r9("ci_hi"))


_FEATURES = {
    "g1_role_bucket": ("role", "role_bucket"),
    "g4_cluster": ("cluster", "CASE WHEN cluster_size > 1 THEN 'cluster' WHEN cluster_size IS NOT NULL THEN 'alone' ELSE 'unknown' END"),
    "g5_routine": ("routine", "CASE WHEN is_routine THEN 'routine' ELSE 'opportune' END"),
    "g6_cap_band": ("cap_band", "cap_band"),
    "g2_own_size": ("own_size", "CASE WHEN value_vs_own >= 1 THEN 'larger' WHEN value_vs_own IS NOT NULL THEN 'smaller' ELSE 'first' END"),
}


@query(
    "g8_every_feature",
    "SELECT p.feature, p.segment, p.horizon, p.n, round(p.mean_abn, 9) AS mean_abn, "
    f"round(m[{int(2.5 / 100 * REPLICATES) + 1}], 9) AS ci_lo, round(m[{int(97.5 / 100 * REPLICATES) + 1}], 9) AS ci_hi "
    "FROM feat_points p LEFT JOIN feat_intervals i ON p.feature = i.feature AND p.segment = i.segment AND p.horizon = i.horizon",
    **BOOT_CTES,
    feat=" UNION ALL ".join(
        f"SELECT accession, txn_sk, '{name}' AS feature, {label} AS segment FROM ({ORACLE[source]})"
        for source, (name, label) in _FEATURES.items()
    ),
    feat_long="SELECT l.*, f.feature, f.segment FROM long l JOIN feat f ON l.accession = f.accession AND l.txn_sk = f.txn_sk",
    feat_points="SELECT feature, segment, horizon, CAST(count(abn) AS BIGINT) AS n, avg(abn) AS mean_abn FROM feat_long GROUP BY 1, 2, 3",
    feat_means="SELECT l.feature, l.segment, l.horizon, w.replicate, sum(w.w * l.abn) / sum(w.w) AS mean FROM weights w "
    "JOIN feat_long l ON w.accession = l.accession AND w.txn_sk = l.txn_sk WHERE l.abn IS NOT NULL AND w.w > 0 GROUP BY 1, 2, 3, 4",
    feat_intervals="SELECT feature, segment, horizon, list_sort(list(mean)) AS m FROM feat_means GROUP BY 1, 2, 3",
)
def g8_every_feature(t: Tables) -> DataFrame:
    """One curve per segment of every feature; features come from all events, the curve from the eligible ones."""
    featured = segments.add_segment_features(materialize(unplanned_events(t)), t.issuer_sizes(), years=2, bands=BANDS)
    labels = segments.segment_labels()
    events = signals.eligible_events(featured).select("*", *[label.alias(f"by_{name}") for name, label in labels.items()])
    panel = materialize(
        abnormal_returns(materialize(events), t.prices(), t.benchmark(), carry=[f"by_{name}" for name in labels])
    )
    rows = segments.by_segment(panel, {name: F.col(f"by_{name}") for name in labels})
    curve = curves.poisson_curve(rows, n_boot=REPLICATES, by=["feature", "segment"])
    return curve.select("feature", "segment", "horizon", "n", r9("mean_abn"), r9("ci_lo"), r9("ci_hi"))


@query(
    "b1_cohorts",
    "SELECT CAST(date_trunc('month', entry_date) AS DATE) AS month, count(*) AS n, round(avg(ret_1m), 9) AS cohort_return "
    "FROM wide WHERE ret_1m IS NOT NULL GROUP BY 1",
)
def b1_cohorts(t: Tables) -> DataFrame:
    return basket.monthly_cohorts(study_panel(t), "1m").select("month", "n", r9("cohort_return"))


_COST = {
    "px_t": "SELECT p.*, c.t FROM px p JOIN cal c ON c.cal_date = p.date",
    "turnover": "SELECT p.ticker, p.t, avg(q.close * q.volume) AS adv FROM px_t p LEFT JOIN px_t q ON q.ticker = p.ticker "
    "AND q.t BETWEEN p.t - 20 AND p.t - 1 GROUP BY 1, 2",
    "net": "SELECT *, ret_1m - cost AS net_1m FROM (SELECT w.*, a.adv, "
    "CASE WHEN adv IS NULL THEN 0.020 WHEN adv < 50000 THEN 0.020 WHEN adv < 200000 THEN 0.010 "
    "WHEN adv < 1000000 THEN 0.004 ELSE 0.001 END::DOUBLE + 0.001::DOUBLE + 0.1::DOUBLE * coalesce(10000.0::DOUBLE / nullif(adv, 0), 1.0::DOUBLE) AS cost "
    "FROM wide w LEFT JOIN turnover a ON a.ticker = w.ticker AND a.t = w.entry_t)",
}


_NEXT_OPEN = {"entry_field": "open", "entry_lag": 1}
_COST_NEXT = {**_COST, "net": _COST["net"].replace("FROM wide w", "FROM wide_next w")}


def _net(t: Tables, **options) -> DataFrame:
    return basket.net_returns(study_panel(t, price_features=basket.turnover_feature(), **options), "1m")


@query(
    "b2_net_returns",
    "SELECT accession, txn_sk, round(cost, 9) AS cost, round(net_1m, 9) AS net_1m FROM net",
    **_COST,
)
def b2_net_returns(t: Tables) -> DataFrame:
    return _net(t).select(
        *EVENT_KEY, r9("cost"), r9("net_1m")
    )


@query(
    "b2_net_next_open",
    "SELECT accession, txn_sk, round(cost, 9) AS cost, round(net_1m, 9) AS net_1m FROM net",
    **_COST_NEXT,
)
def b2_net_next_open(t: Tables) -> DataFrame:
    return _net(t, **_NEXT_OPEN).select(*EVENT_KEY, r9("cost"), r9("net_1m"))


@query(
    "b2_cost_table",
    "SELECT accession, txn_sk, spread, round(cost, 9) AS cost, round(net_1m, 9) AS net_1m FROM net",
    **{
        **_COST,
        "costs": "SELECT * FROM (VALUES (DATE '1995-01-01', DATE '1998-07-01', NULL, 50000.0::DOUBLE, 0.020::DOUBLE), (DATE '1995-01-01', DATE '1998-07-01', 50000.0, 200000.0, 0.010), "
        "(DATE '1995-01-01', DATE '1998-07-01', 200000.0, NULL, 0.004), (DATE '1998-07-01', DATE '2200-01-01', NULL, 120000.0, 0.015), "
        "(DATE '1998-07-01', DATE '2200-01-01', 120000.0, NULL, 0.002)) AS v(since, until, low, high, spread)",
        "net": "SELECT *, ret_1m - cost AS net_1m FROM (SELECT w.*, c.spread, c.spread + 0.001::DOUBLE + 0.1::DOUBLE * coalesce(10000.0::DOUBLE / nullif(adv, 0), 1.0::DOUBLE) AS cost "
        "FROM (SELECT w.*, a.adv FROM wide w LEFT JOIN turnover a ON a.ticker = w.ticker AND a.t = w.entry_t) w LEFT JOIN costs c ON w.entry_date >= c.since AND w.entry_date < c.until "
        "AND coalesce(adv, 0) >= coalesce(low, -1) AND (high IS NULL OR coalesce(adv, 0) < high))",
    },
)
def b2_cost_table(t: Tables) -> DataFrame:
    panel = basket.with_spreads(study_panel(t, price_features=basket.turnover_feature()), t.cost_table())
    return basket.net_returns(panel, "1m").select(*EVENT_KEY, "spread", r9("cost"), r9("net_1m"))


@query(
    "b3_walk_forward",
    "SELECT fold, side, count(*) AS n, round(avg(abn_1m), 9) AS mean FROM (SELECT f.fold, CASE "
    "WHEN year(w.entry_date) = f.fold THEN 'test' WHEN w.entry_date + 45 < make_date(f.fold, 1, 1) THEN 'train' END AS side, "
    "w.abn_1m FROM (SELECT unnest(range(min(year(entry_date)), max(year(entry_date)) + 1)) AS fold FROM wide WHERE abn_1m IS NOT NULL) f JOIN wide w "
    "ON year(w.entry_date) <= f.fold WHERE w.abn_1m IS NOT NULL) WHERE side IS NOT NULL GROUP BY 1, 2",
)
def b3_walk_forward(t: Tables) -> DataFrame:
    return basket.walk_forward(study_panel(t), "abn_1m", EMBARGO).select(
        "fold", "side", "n", r9("mean")
    )


@query(
    "b3_grid",
    "SELECT fold, horizon, n_train, round(train_mean, 9) AS train_mean, n_test, round(test_mean, 9) AS test_mean FROM "
    "(SELECT *, row_number() OVER (PARTITION BY fold ORDER BY train_mean / steps DESC, steps) AS place FROM "
    "(SELECT fold, horizon, steps, count(*) FILTER (side = 'train') AS n_train, avg(abn) FILTER (side = 'train') AS train_mean, "
    "count(*) FILTER (side = 'test') AS n_test, avg(abn) FILTER (side = 'test') AS test_mean FROM sides GROUP BY 1, 2, 3) "
    "WHERE n_train > 0) WHERE place = 1 AND n_test > 0",
    dated="SELECT l.horizon, h.steps, l.abn, w.entry_date FROM long l JOIN wide w ON l.accession = w.accession AND l.txn_sk = w.txn_sk "
    "JOIN horizons h ON h.horizon = l.horizon WHERE l.abn IS NOT NULL",
    folds="SELECT horizon, unnest(range(min(year(entry_date)), max(year(entry_date)) + 1)) AS fold FROM dated GROUP BY horizon",
    sides="SELECT f.fold, d.horizon, d.steps, d.abn, CASE WHEN year(d.entry_date) = f.fold THEN 'test' "
    "WHEN d.entry_date + 45 < make_date(f.fold, 1, 1) THEN 'train' END AS side FROM folds f JOIN dated d "
    "ON d.horizon = f.horizon AND year(d.entry_date) <= f.fold",
)
def b3_grid(t: Tables) -> DataFrame:
    chosen = basket.walk_forward_choice(materialize(study_panel(t)), HORIZONS, embargo_days=EMBARGO)
    return chosen.select("fold", "horizon", "n_train", r9("train_mean"), "n_test", r9("test_mean"))


FIRST_FOLD = dt.date(1995, 1, 1)


@query(
    "b3_folds",
    "SELECT f.fold, f.side, count(w.abn_1m) AS n, round(avg(w.abn_1m), 9) AS mean FROM folds f LEFT JOIN wide w "
    "ON w.entry_date >= f.first AND w.entry_date < f.until GROUP BY 1, 2",
    numbers="SELECT CAST(range AS BIGINT) AS fold, DATE '1995-01-01' + CAST(range * 10 AS INTEGER) AS cut FROM range(200)",
    folds="SELECT fold, 'train' AS side, cut - 730 AS first, cut - 45 AS until FROM numbers UNION ALL SELECT fold, 'test', cut, cut + 91 FROM numbers",
)
def b3_folds(t: Tables) -> DataFrame:
    """Two hundred overlapping folds: two rolling years with an embargo, tested on the quarter after; a new one every ten days."""
    cut = F.date_add(F.lit(FIRST_FOLD), (F.col("id") * 10).cast("int"))
    side = lambda name, start, end: F.struct(F.lit(name).alias("side"), start.alias("start"), end.alias("end"))
    sides = F.array(side("train", F.date_sub(cut, 730), F.date_sub(cut, EMBARGO)), side("test", cut, F.date_add(cut, 91)))
    folds = t.spark.range(200).select(F.col("id").alias("fold"), F.inline(sides))
    return basket.fold_means(study_panel(t), "abn_1m", folds).select("fold", "side", "n", r9("mean"))


@query(
    "b3_time_split",
    "SELECT side, count(*) AS n, round(avg(abn_1m), 9) AS mean FROM (SELECT CASE WHEN entry_date >= DATE '1999-01-01' "
    "THEN 'test' WHEN entry_date + 45 < DATE '1999-01-01' THEN 'train' END AS side, abn_1m FROM wide "
    "WHERE abn_1m IS NOT NULL) WHERE side IS NOT NULL GROUP BY 1",
)
def b3_time_split(t: Tables) -> DataFrame:
    return basket.time_split(study_panel(t), "abn_1m", CUTOFF, EMBARGO).select(
        "side", "n", r9("mean")
    )


_PERFORMANCE = (
    "SELECT count(*) AS months, CAST(sum(n) AS BIGINT) AS trades, round(pow(product(1 + r), 12.0 / count(*)) - 1, 6) AS cagr, "
    "round(avg(r) / nullif(stddev_samp(r), 0) * sqrt(12.0), 6) AS sharpe, round(min(equity / peak - 1), 6) AS max_drawdown, "
    "round(CAST(sum(wins) AS DOUBLE) / CAST(sum(n) AS DOUBLE), 6) AS hit_rate, round(avg(n), 6) AS turnover, round(avg(room), 4) AS capacity FROM "
    "(SELECT *, greatest(1.0, max(equity) OVER (ORDER BY month ROWS UNBOUNDED PRECEDING)) AS peak FROM "
    "(SELECT *, product(1 + r) OVER (ORDER BY month ROWS UNBOUNDED PRECEDING) AS equity FROM "
    "(SELECT date_trunc('month', entry_date) AS month, count(*) AS n, avg(net_1m) AS r, "
    "count(*) FILTER (WHERE net_1m > 0) AS wins, sum(coalesce(adv, 0) * 0.01::DOUBLE) AS room FROM net "
    "WHERE net_1m IS NOT NULL GROUP BY 1)))"
)


@query("b4_performance", _PERFORMANCE, **_COST)
def b4_performance(t: Tables) -> DataFrame:
    return _performance(_net(t))


@query("b4_performance_next_open", _PERFORMANCE, **_COST_NEXT)
def b4_performance_next_open(t: Tables) -> DataFrame:
    return _performance(_net(t, **_NEXT_OPEN))


def _performance(trades: DataFrame) -> DataFrame:
    report = basket.performance(trades, "net_1m")
    return report.select(
        "months", "trades",
        *[F.round(c, 6).alias(c) for c in ("cagr", "sharpe", "max_drawdown", "hit_rate", "turnover")],
        F.round("capacity", 4).alias("capacity"),
    )


_EXITS = {
    "prints": "SELECT p.ticker, c.t, p.close, lead(p.close) OVER (PARTITION BY p.ticker ORDER BY c.t) AS fill "
    "FROM px p JOIN cal c ON c.cal_date = p.date",
    "paths": "SELECT e.ticker, e.t AS entry_t, e.close AS entry_close, p.t, p.close, p.fill, greatest(e.close, "
    "max(p.close) OVER (PARTITION BY e.ticker, e.t ORDER BY p.t ROWS UNBOUNDED PRECEDING)) AS peak "
    f"FROM prints e JOIN prints p ON p.ticker = e.ticker AND p.t BETWEEN e.t + 1 AND e.t + {HOLD}",
    "stops": "SELECT ticker, entry_t, arg_min(coalesce(fill, -1), t) AS fill FROM paths WHERE peak >= entry_close * (1 + 0.1::DOUBLE) "
    "AND close <= peak * (1 - 0.1::DOUBLE) GROUP BY 1, 2",
    "rests": "SELECT ticker, entry_t, arg_min(coalesce(fill, -1), t) AS fill FROM paths WHERE peak >= entry_close * 2 "
    "AND close <= peak * (1 - 0.3::DOUBLE) GROUP BY 1, 2",
    "doubles": "SELECT ticker, entry_t, arg_min(coalesce(fill, -1), t) AS fill FROM paths WHERE close >= entry_close * 2 GROUP BY 1, 2",
    "exits": "SELECT e.ticker, e.t AS entry_t, h.close / e.close - 1.0 AS fixed, "
    "CASE WHEN s.ticker IS NOT NULL THEN CASE WHEN s.fill >= 0 THEN s.fill / e.close - 1.0 END ELSE h.close / e.close - 1.0 END AS trailing_stop, "
    "CASE WHEN d.ticker IS NOT NULL THEN (CASE WHEN d.fill >= 0 THEN d.fill / e.close - 1.0 END + "
    "CASE WHEN r.ticker IS NOT NULL THEN CASE WHEN r.fill >= 0 THEN r.fill / e.close - 1.0 END ELSE h.close / e.close - 1.0 END) / 2 "
    "ELSE h.close / e.close - 1.0 END AS scale_out, s.ticker IS NOT NULL AS stopped, d.ticker IS NOT NULL AS doubled FROM prints e "
    f"LEFT JOIN prints h ON h.ticker = e.ticker AND h.t = e.t + {HOLD} "
    "LEFT JOIN stops s ON s.ticker = e.ticker AND s.entry_t = e.t LEFT JOIN rests r ON r.ticker = e.ticker AND r.entry_t = e.t "
    "LEFT JOIN doubles d ON d.ticker = e.ticker AND d.entry_t = e.t",
}


@query(
    "b5_exit_paths",
    "SELECT ticker, entry_t, round(fixed, 9) AS fixed, round(trailing_stop, 9) AS trailing_stop, round(scale_out, 9) AS scale_out, "
    "stopped, doubled FROM exits",
    **_EXITS,
)
def b5_exit_paths(t: Tables) -> DataFrame:
    return basket.exit_overlays(_px(t), HOLD).select(
        "ticker", "entry_t", r9("fixed"), r9("trailing_stop"), r9("scale_out"), "stopped", "doubled"
    )


@query(
    "b5_exit_report",
    " UNION ALL ".join(
        f"SELECT '{r}' AS rule, count({r}) AS n, round(avg({r}), 9) AS mean, count(*) - count({r}) AS left_out, "
        f"count({r} - fixed) AS n_paired, round(avg({r} - fixed), 9) AS mean_vs_fixed, "
        f"round(avg(CAST(CASE WHEN {r} IS NOT NULL THEN {r} > 0 END AS INTEGER)), 9) AS hit_rate "
        "FROM entry e JOIN exits x ON x.ticker = e.ticker AND x.entry_t = e.entry_t"
        for r in ("fixed", "trailing_stop", "scale_out")
    ),
    **_EXITS,
)
def b5_exit_report(t: Tables) -> DataFrame:
    placed = sessions.first_tradable_session(
        study_events(t), sessions.trading_calendar(t.benchmark())
    )
    entries = materialize(basket.entry_counts(placed))
    report = basket.exit_report(entries, basket.exit_overlays(_px(t), HOLD, entries=entries))
    return report.select("rule", "n", r9("mean"), r9("hit_rate"), "left_out", "n_paired", r9("mean_vs_fixed"))


_LIVES = {
    **_EXITS,
    "prints": "SELECT ticker, life, t, close, terminal, CASE WHEN terminal THEN close ELSE lead(close) OVER (PARTITION BY ticker, life ORDER BY t) END AS fill FROM "
    "(SELECT p.ticker, c.t, p.close, false AS terminal, (SELECT count(*) FROM delist_days d WHERE d.ticker = p.ticker AND d.delist_date <= p.date) AS life "
    "FROM px p JOIN cal c ON c.cal_date = p.date UNION ALL "
    "SELECT d.ticker, (SELECT min(t) FROM cal WHERE cal_date >= d.delist_date), d.recovery_value, true, "
    "(SELECT count(*) FROM delist_days o WHERE o.ticker = d.ticker AND o.delist_date < d.delist_date) FROM delist_days d "
    "WHERE d.delist_date <= (SELECT max(cal_date) FROM cal))",
    "paths": "SELECT e.ticker, e.t AS entry_t, e.close AS entry_close, p.t, p.close, p.fill, p.terminal, greatest(e.close, "
    "max(p.close) OVER (PARTITION BY e.ticker, e.t ORDER BY p.t ROWS UNBOUNDED PRECEDING)) AS peak "
    f"FROM prints e JOIN prints p ON p.ticker = e.ticker AND p.life = e.life AND p.t BETWEEN e.t + 1 AND e.t + {HOLD} WHERE NOT e.terminal",
    "ended": "SELECT ticker, entry_t, max(close) AS close FROM paths WHERE terminal GROUP BY 1, 2",
    "held": f"SELECT e.ticker, e.t, coalesce(g.close, h.close) AS close FROM prints e LEFT JOIN prints h ON h.ticker = e.ticker AND h.life = e.life AND h.t = e.t + {HOLD} AND NOT h.terminal "
    "LEFT JOIN ended g ON g.ticker = e.ticker AND g.entry_t = e.t WHERE NOT e.terminal",
    "exits": _EXITS["exits"].replace(f"LEFT JOIN prints h ON h.ticker = e.ticker AND h.t = e.t + {HOLD}", "LEFT JOIN held h ON h.ticker = e.ticker AND h.t = e.t").replace(
        "FROM prints e", "FROM (SELECT * FROM prints WHERE NOT terminal) e"
    ),
}


def _px_with_ends(t: Tables) -> DataFrame:
    return basket.terminal_prints(_px(t), t.delistings(), sessions.trading_calendar(t.benchmark()))


@query("b5_delisted_paths", ORACLE["b5_exit_paths"].split("\n")[-1], **_LIVES)
def b5_delisted_paths(t: Tables) -> DataFrame:
    """The exit rules where a delisting is a ticker's last print, at what is recovered."""
    return basket.exit_overlays(_px_with_ends(t), HOLD).select(
        "ticker", "entry_t", r9("fixed"), r9("trailing_stop"), r9("scale_out"), "stopped", "doubled"
    )


@query("b5_delisted", ORACLE["b5_exit_report"].split("\n")[-1], **_LIVES)
def b5_delisted(t: Tables) -> DataFrame:
    placed = sessions.first_tradable_session(study_events(t), sessions.trading_calendar(t.benchmark()))
    entries = materialize(basket.entry_counts(placed))
    report = basket.exit_report(entries, basket.exit_overlays(_px_with_ends(t), HOLD, entries=entries))
    return report.select("rule", "n", r9("mean"), r9("hit_rate"), "left_out", "n_paired", r9("mean_vs_fixed"))


@query(
    "b6_pooling",
    "SELECT o.role_bucket, insider_id, n, round(own_mean, 9) AS own_mean, round(segment_mean, 9) AS segment_mean, "
    "round(segment_mean + coalesce(n / (n + k), 0) * (own_mean - segment_mean), 9) AS estimate FROM own_stats o JOIN "
    "(SELECT role_bucket, segment_mean, within_var / nullif(greatest(spread - within_var * inv, 0), 0) AS k FROM "
    "(SELECT role_bucket, sum(n * own_mean) / CAST(sum(n) AS DOUBLE) AS segment_mean, "
    "sum((n - 1) * own_var) / nullif(CAST(sum(n - 1) AS DOUBLE), 0) AS within_var, var_samp(own_mean) AS spread, avg(1.0::DOUBLE / n) AS inv "
    "FROM own_stats GROUP BY 1)) s ON s.role_bucket = o.role_bucket",
    own_stats="SELECT role_bucket, insider_id, count(*) AS n, avg(abn_1m) AS own_mean, coalesce(var_samp(abn_1m), 0) AS own_var "
    f"FROM (SELECT w.abn_1m, e.insider_id, {_BUCKET} AS role_bucket FROM wide w JOIN elig e ON w.accession = e.accession "
    "AND w.txn_sk = e.txn_sk WHERE w.abn_1m IS NOT NULL) GROUP BY 1, 2",
)
def b6_pooling(t: Tables) -> DataFrame:
    panel = study_panel(t, carry=("title", "is_director", "is_ten_percent_owner", "insider_id"))
    pooled = basket.partial_pooling(segments.with_role_bucket(panel), "abn_1m")
    return pooled.select(
        "role_bucket", "insider_id", "n", r9("own_mean"), r9("segment_mean"), r9("estimate")
    )


@query(
    "b6_oos",
    "SELECT predictor, count(abn_1m) AS n, round(avg(CASE predictor WHEN 'segment' THEN (abn_1m - segment_mean) ** 2 WHEN 'own' THEN (abn_1m - own_mean) ** 2 "
    "ELSE (abn_1m - estimate) ** 2 END), 9) AS mse FROM (VALUES ('segment'), ('pooled'), ('own')) AS p(predictor) LEFT JOIN "
    "(SELECT l.abn_1m, k.* FROM later l JOIN known k ON k.role_bucket = l.role_bucket AND k.insider_id = l.insider_id) ON true GROUP BY 1",
    bucketed=f"SELECT w.abn_1m, w.entry_date, e.insider_id, {_BUCKET} AS role_bucket FROM wide w JOIN elig e ON w.accession = e.accession "
    "AND w.txn_sk = e.txn_sk WHERE w.abn_1m IS NOT NULL",
    later="SELECT * FROM bucketed WHERE entry_date >= DATE '1999-01-01'",
    own_before="SELECT role_bucket, insider_id, count(*) AS n, avg(abn_1m) AS own_mean, coalesce(var_samp(abn_1m), 0) AS own_var "
    "FROM bucketed WHERE entry_date + 45 < DATE '1999-01-01' GROUP BY 1, 2",
    known="SELECT o.role_bucket, insider_id, own_mean, segment_mean, segment_mean + coalesce(n / (n + k), 0) * (own_mean - segment_mean) AS estimate "
    "FROM own_before o JOIN (SELECT role_bucket, segment_mean, within_var / nullif(greatest(spread - within_var * inv, 0), 0) AS k FROM "
    "(SELECT role_bucket, sum(n * own_mean) / CAST(sum(n) AS DOUBLE) AS segment_mean, "
    "sum((n - 1) * own_var) / nullif(CAST(sum(n - 1) AS DOUBLE), 0) AS within_var, var_samp(own_mean) AS spread, avg(1.0::DOUBLE / n) AS inv "
    "FROM own_before GROUP BY 1)) s ON s.role_bucket = o.role_bucket",
)
def b6_oos(t: Tables) -> DataFrame:
    panel = study_panel(t, carry=("title", "is_director", "is_ten_percent_owner", "insider_id"))
    tested = basket.pooling_out_of_sample(segments.with_role_bucket(panel), "abn_1m", CUTOFF, EMBARGO)
    return tested.select("predictor", "n", r9("mse"))
