"""The basket as a portfolio through time, its capacity, and exit rules out of sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.catalog.registry import query, r9, study_events, study_panel
from tidemark.catalog.studies import _COST, _EXITS, _LIVES, HOLD, _px
from tidemark.fixtures import Tables
from tidemark.operators import basket, rebalance, sessions
from tidemark.session import materialize

HOLD_MONTHS = 3
CAPITAL = 1_000_000.0
POSITIONS = (1_000.0, 10_000.0, 100_000.0, 1_000_000.0)
SETTINGS = ((0.10, 0.10, 0.30), (0.10, 0.20, 0.40), (0.25, 0.15, 0.20))  # activate, trail, wide trail
SETTLED_DAYS = 95

_STATS = (
    "count(*) AS months, round(pow(product(1 + r), 12.0 / count(*)) - 1, 6) AS cagr, "
    "round(avg(r) / nullif(stddev_samp(r), 0) * sqrt(12.0), 6) AS sharpe, round(min(equity / peak - 1), 6) AS max_drawdown"
)


def _with_peak(source: str, by: str = "") -> str:
    order = f"{by}ORDER BY month ROWS UNBOUNDED PRECEDING"
    return f"(SELECT *, greatest(1.0, max(equity) OVER ({order})) AS peak FROM (SELECT *, product(1 + r) OVER ({order}) AS equity FROM {source}))"


def _rounded_stats() -> list:
    return ["months", *[F.round(c, 6).alias(c) for c in ("cagr", "sharpe", "max_drawdown")]]


_BOOK = {
    "px_t": _COST["px_t"],
    "turnover": _COST["turnover"],
    "lived": _LIVES["prints"],
    "rebal": "SELECT row_number() OVER (ORDER BY min(t)) - 1 AS m, min(t) AS r, min(cal_date) AS month FROM cal GROUP BY date_trunc('month', cal_date)",
    "calls": "SELECT DISTINCT e.ticker, (SELECT count(*) FROM delist_days d WHERE d.ticker = e.ticker AND d.delist_date <= e.entry_date) AS life, b.m "
    "FROM (SELECT DISTINCT ticker, entry_t, entry_date FROM entry WHERE entry_t IS NOT NULL) e ASOF JOIN rebal b ON e.entry_t <= b.r",
    "placed": "SELECT q.ticker, q.life, q.t, q.close, q.terminal, b.m FROM lived q ASOF JOIN rebal b ON q.t > b.r",
    "firsts": "SELECT f.ticker, f.life, f.m, p.open AS price, a.adv FROM (SELECT q.ticker, q.life, q.m, min(q.t) AS t FROM placed q JOIN px_t p ON p.ticker = q.ticker AND p.t = q.t "
    "WHERE NOT q.terminal AND p.open IS NOT NULL GROUP BY 1, 2, 3) f JOIN px_t p ON p.ticker = f.ticker AND p.t = f.t LEFT JOIN turnover a ON a.ticker = f.ticker AND a.t = f.t",
    "closing": "SELECT ticker, life, m, close AS recovered FROM placed WHERE terminal",
    "book": "SELECT g.ticker, g.life, b.m, f.price, f.adv, x.recovered, EXISTS (SELECT 1 FROM calls c WHERE c.ticker = g.ticker AND c.life = g.life AND c.m <= b.m AND c.m > b.m - 3) AS wanted "
    "FROM (SELECT ticker, life, min(m) AS first FROM calls GROUP BY 1, 2) g JOIN rebal b ON b.m >= g.first LEFT JOIN closing e ON e.ticker = g.ticker AND e.life = g.life "
    "LEFT JOIN firsts f ON f.ticker = g.ticker AND f.life = g.life AND f.m = b.m LEFT JOIN closing x ON x.ticker = g.ticker AND x.life = g.life AND x.m = b.m WHERE e.m IS NULL OR b.m <= e.m",
    "valued": "SELECT *, coalesce(last_value(CASE WHEN price IS NOT NULL THEN wanted END IGNORE NULLS) OVER w, false) AS held, last_value(price IGNORE NULLS) OVER w AS mark FROM book "
    "WINDOW w AS (PARTITION BY ticker, life ORDER BY m ROWS UNBOUNDED PRECEDING)",
    "run": "SELECT a.*, coalesce(a.recovered, n.mark) / nullif(a.mark, 0) - 1.0 AS ret FROM valued a LEFT JOIN valued n ON n.ticker = a.ticker AND n.life = a.life AND n.m = a.m + 1",
    "gained": "SELECT m, count(*) AS n, coalesce(avg(ret), 0) AS gross FROM run WHERE held GROUP BY 1",
    "moves": "SELECT a.m, a.held, a.price, a.adv, coalesce(b.held, false) AS was_held, abs(CASE WHEN a.held THEN 1.0::DOUBLE / g.n ELSE 0 END - "
    "CASE WHEN b.held THEN 1.0::DOUBLE / h.n * (1 + coalesce(b.ret, 0)) / (1 + h.gross) ELSE 0 END) AS moved FROM run a "
    "LEFT JOIN run b ON b.ticker = a.ticker AND b.life = a.life AND b.m = a.m - 1 LEFT JOIN gained g ON g.m = a.m LEFT JOIN gained h ON h.m = a.m - 1 WHERE a.held OR b.held",
    "counted": "SELECT m, count(*) FILTER (held) AS n, count(*) FILTER (held AND NOT was_held) AS entered, count(*) FILTER (NOT held) AS departed, "
    "count(*) FILTER (held AND price IS NULL) AS stale, coalesce(sum(moved) FILTER (price IS NOT NULL), 0) AS traded, "
    "coalesce(sum(moved * (CASE WHEN adv IS NULL OR adv < 50000 THEN 0.020 WHEN adv < 200000 THEN 0.010 WHEN adv < 1000000 THEN 0.004 ELSE 0.001 END::DOUBLE "
    "+ 0.001::DOUBLE + 0.1::DOUBLE * coalesce(moved * 1000000.0::DOUBLE / nullif(adv, 0), 1.0::DOUBLE)) / 2) FILTER (price IS NOT NULL), 0) AS cost FROM moves GROUP BY 1",
    "series": "SELECT b.month, coalesce(c.n, 0) AS n, coalesce(c.entered, 0) AS entered, coalesce(c.departed, 0) AS departed, coalesce(c.stale, 0) AS stale, coalesce(c.traded, 0) AS traded, "
    "coalesce(g.gross, 0) AS gross, coalesce(c.cost, 0) AS cost, coalesce(g.gross, 0) - coalesce(c.cost, 0) AS r FROM rebal b LEFT JOIN counted c ON c.m = b.m LEFT JOIN gained g ON g.m = b.m "
    "WHERE b.m >= (SELECT min(m) FROM counted) AND b.m < (SELECT max(m) FROM rebal)",
}


def _series(t: Tables) -> DataFrame:
    calendar = sessions.trading_calendar(t.benchmark())
    placed = sessions.first_tradable_session(study_events(t), calendar)
    return rebalance.monthly_series(placed, t.prices(), calendar, HOLD_MONTHS, CAPITAL, t.delistings())


@query(
    "b4_rebalanced",
    "SELECT month, n, entered, departed, stale, round(traded, 9) AS traded, round(gross, 9) AS gross, round(cost, 9) AS cost, round(r, 9) AS net FROM series",
    **_BOOK,
)
def b4_rebalanced(t: Tables) -> DataFrame:
    return _series(t).select("month", "n", "entered", "departed", "stale", r9("traded"), r9("gross"), r9("cost"), r9("r", "net"))


@query(
    "b4_rebalanced_report",
    f"SELECT {_STATS}, round(CAST(count(*) FILTER (r > 0) AS DOUBLE) / count(*), 6) AS hit_rate, round(avg(n), 6) AS names, round(avg(traded), 6) AS turnover, "
    f"round(avg(cost), 6) AS mean_cost FROM {_with_peak('series')}",
    **_BOOK,
)
def b4_rebalanced_report(t: Tables) -> DataFrame:
    report = rebalance.series_report(materialize(_series(t)))
    return report.select(*_rounded_stats(), *[F.round(c, 6).alias(c) for c in ("hit_rate", "names", "turnover", "mean_cost")])


@query(
    "b4_capacity",
    f"SELECT position, {_STATS}, CAST(sum(n) AS BIGINT) AS trades, round(sum(fits) / CAST(sum(n) AS DOUBLE), 6) AS fillable, round(sum(n * net) / CAST(sum(n) AS DOUBLE), 6) AS mean_net, "
    f"(SELECT round(greatest(sum(before) / nullif(sum(slope), 0), 0), 2) FROM parts) AS break_even FROM {_with_peak('sized', 'PARTITION BY position ')} GROUP BY 1",
    **_COST,
    parts="SELECT entry_date, adv, ret_1m - (cost - 0.1::DOUBLE * coalesce(10000.0::DOUBLE / nullif(adv, 0), 1.0::DOUBLE)) - CASE WHEN adv > 0 THEN 0 ELSE 0.1::DOUBLE END AS before, "
    "CASE WHEN adv > 0 THEN 0.1::DOUBLE / adv ELSE 0 END AS slope FROM net WHERE ret_1m IS NOT NULL",
    sized="SELECT *, greatest(net, -1.0) AS r FROM (SELECT position, date_trunc('month', entry_date) AS month, count(*) AS n, count(*) FILTER (adv * 0.01::DOUBLE >= position) AS fits, "
    "avg(before - slope * position) AS net FROM parts, (VALUES (1000.0::DOUBLE), (10000.0), (100000.0), (1000000.0)) AS p(position) GROUP BY 1, 2)",
)
def b4_capacity(t: Tables) -> DataFrame:
    trades = study_panel(t, price_features=basket.turnover_feature())
    found = basket.capacity_curve(trades, "ret_1m", POSITIONS)
    return found.select(
        "position", *_rounded_stats(), "trades", F.round("fillable", 6).alias("fillable"), F.round("mean_net", 6).alias("mean_net"), F.round("break_even", 2).alias("break_even")
    )


_OOS_EXITS = {
    "prints": _EXITS["prints"],
    "settings": "SELECT * FROM (VALUES " + ", ".join(f"({i}, {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)" for i, (a, b, c) in enumerate(SETTINGS)) + ") AS s(setting, activate, trail, wide)",
    "counts": "SELECT ticker, entry_t, entry_date, count(*) AS weight FROM entry WHERE entry_t IS NOT NULL GROUP BY 1, 2, 3",
    "bought": f"SELECT e.*, p.close AS entry_close, h.close / p.close - 1.0 AS fixed FROM counts e JOIN prints p ON p.ticker = e.ticker AND p.t = e.entry_t "
    f"LEFT JOIN prints h ON h.ticker = e.ticker AND h.t = e.entry_t + {HOLD}",
    "walks": "SELECT e.ticker, e.entry_t, e.entry_close, p.t, p.close, p.fill, greatest(e.entry_close, max(p.close) OVER (PARTITION BY e.ticker, e.entry_t ORDER BY p.t ROWS UNBOUNDED PRECEDING)) AS peak "
    f"FROM bought e JOIN prints p ON p.ticker = e.ticker AND p.t BETWEEN e.entry_t + 1 AND e.entry_t + {HOLD}",
    "stopped": "SELECT setting, ticker, entry_t, arg_min(coalesce(fill, -1), t) AS fill FROM walks, settings WHERE peak >= entry_close * (1 + activate) AND close <= peak * (1 - trail) GROUP BY 1, 2, 3",
    "released": "SELECT setting, ticker, entry_t, arg_min(coalesce(fill, -1), t) AS fill FROM walks, settings WHERE peak >= entry_close * 2 AND close <= peak * (1 - wide) GROUP BY 1, 2, 3",
    "doubled": "SELECT ticker, entry_t, arg_min(coalesce(fill, -1), t) AS fill FROM walks WHERE close >= entry_close * 2 GROUP BY 1, 2",
    "left_at": "SELECT s.setting, e.ticker, e.entry_t, e.entry_date, e.weight, e.fixed, CASE WHEN x.ticker IS NULL THEN e.fixed WHEN x.fill >= 0 THEN x.fill / e.entry_close - 1.0 END AS stop_exit, "
    "CASE WHEN d.ticker IS NULL THEN e.fixed ELSE (CASE WHEN d.fill >= 0 THEN d.fill / e.entry_close - 1.0 END + CASE WHEN r.ticker IS NULL THEN e.fixed WHEN r.fill >= 0 THEN r.fill / e.entry_close - 1.0 END) / 2 END AS scaled "
    "FROM bought e CROSS JOIN settings s LEFT JOIN stopped x ON x.setting = s.setting AND x.ticker = e.ticker AND x.entry_t = e.entry_t "
    "LEFT JOIN released r ON r.setting = s.setting AND r.ticker = e.ticker AND r.entry_t = e.entry_t LEFT JOIN doubled d ON d.ticker = e.ticker AND d.entry_t = e.entry_t",
    "paired": "SELECT 'trailing_stop' AS rule, setting, entry_date, weight, stop_exit - fixed AS gain FROM left_at WHERE stop_exit - fixed IS NOT NULL "
    "UNION ALL SELECT 'scale_out', setting, entry_date, weight, scaled - fixed FROM left_at WHERE scaled - fixed IS NOT NULL",
    "spans": "SELECT unnest(range(min(year(entry_date)), max(year(entry_date)) + 1)) AS fold FROM paired",
    "judged_exits": "SELECT f.fold, p.rule, p.setting, sum(weight) FILTER (entry_date + 95 < make_date(f.fold, 1, 1)) AS n_train, "
    "CAST(sum(weight * gain) FILTER (entry_date + 95 < make_date(f.fold, 1, 1)) AS DOUBLE) / CAST(sum(weight) FILTER (entry_date + 95 < make_date(f.fold, 1, 1)) AS DOUBLE) AS train_gain, "
    "sum(weight) FILTER (year(entry_date) = f.fold) AS n_test, "
    "CAST(sum(weight * gain) FILTER (year(entry_date) = f.fold) AS DOUBLE) / CAST(sum(weight) FILTER (year(entry_date) = f.fold) AS DOUBLE) AS test_gain "
    "FROM spans f JOIN paired p ON year(p.entry_date) <= f.fold GROUP BY 1, 2, 3",
}


@query(
    "b5_oos",
    "SELECT fold, rule, CAST(setting AS BIGINT) AS setting, CAST(n_train AS BIGINT) AS n_train, round(train_gain, 9) AS train_gain, CAST(n_test AS BIGINT) AS n_test, round(test_gain, 9) AS test_gain "
    "FROM (SELECT *, row_number() OVER (PARTITION BY fold, rule ORDER BY train_gain DESC, setting) AS place FROM judged_exits WHERE n_train > 0) WHERE place = 1 AND n_test > 0",
    **_OOS_EXITS,
)
def b5_oos(t: Tables) -> DataFrame:
    placed = sessions.first_tradable_session(study_events(t), sessions.trading_calendar(t.benchmark()))
    entries = materialize(basket.entry_counts(placed, "entry_date"))
    tested = basket.exit_walk_forward(entries, _px(t), HOLD, SETTINGS, SETTLED_DAYS)
    return tested.select("fold", "rule", "setting", "n_train", r9("train_gain"), "n_test", r9("test_gain"))
