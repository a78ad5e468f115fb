"""The same queries in SQL, for an engine that shares nothing with Spark but the tables."""

from __future__ import annotations

from ..params import DEFAULTS
from . import regress_sql
from .queries import FEATURES, NUDGE, ORDERS, REGRESSORS

_W = "PARTITION BY series_key ORDER BY timestamp NULLS LAST, seq"
_CUM = f"{_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
_TICK = "base AS (SELECT event_type AS series_key, event_id AS seq, ts AS timestamp, value AS price FROM events)"
_DAILY = """base AS (SELECT o_orderpriority AS series_key, CAST(0 AS BIGINT) AS seq, o_orderdate AS timestamp,
  100 + (CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) - 150000) / 100000 AS price FROM orders GROUP BY o_orderpriority, o_orderdate)"""
_LONG = "base AS (SELECT 'ALL' AS series_key, event_id AS seq, ts AS timestamp, 100 + value / 30011 AS price FROM events)"
_RAW = "base AS (SELECT o_orderpriority AS series_key, o_orderkey AS seq, o_orderdate AS timestamp, o_totalprice AS price FROM orders)"


def _roll(agg: str, x: str, n: int) -> str:
    over = f"OVER ({_W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    call = f"quantile_cont({x}, 0.75)" if agg == "q75" else f"{agg}({x})"
    return f"CASE WHEN count({x}) {over} >= {n} THEN {call} {over} END"


def _lag(x: str = "price", k: int = 1) -> str:
    return f"lag({x}, {k}) OVER ({_W})"


def _change(k: int = 1) -> str:
    return f"((price - {_lag(k=k)}) / nullif({_lag(k=k)}, 0))"


def _r(x: str, digits: int = 4) -> str:
    return f"round(({x}) + {NUDGE * 10.0**-digits:.10f}, {digits}) + 0.0"


def _product(x: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN product(1 + {x}) OVER ({_CUM}) END"


def _sign(x: str, low: str, high: str) -> str:
    return f"CASE WHEN {x} < {low} THEN 1 WHEN {x} > {high} THEN -1 ELSE 0 END"


def _clip(x: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN greatest(-2.0, least(2.0, {x})) END"


_CAL = """CAST(hour(timestamp) AS INTEGER) AS hour, CAST(isodow(timestamp) - 1 AS INTEGER) AS day_of_week, CAST(day(timestamp) AS INTEGER) AS day_of_month,
  CAST(month(timestamp) AS INTEGER) AS month, CAST(quarter(timestamp) AS INTEGER) AS quarter"""


def _feature_ctes() -> str:
    f1 = [f"{_change()} AS returns", f"ln(price / {_lag()}) AS log_returns", f"price - {_lag()} AS step", _CAL]
    f1 += [f"{_roll('avg', 'price', n)} AS ma_{n}" for n in (5, 20, 50)]
    f1 += [f"price - {_lag(k=k)} AS momentum_{k}, {_change(k)} * 100 AS momentum_{k}_pct" for k in (3, 5, 10, 20)]
    f1 += [f"{_change(k)} * 100 AS roc_{k}" for k in (5, 20)]
    f1 += [f"{_roll('stddev_samp', 'price', 20)} AS rolling_std"]
    f1 += [f"{_roll('max', 'price', n)} AS high_{n}, {_roll('min', 'price', n)} AS low_{n}" for n in (10, 20, 50)]
    f2 = [f"(price - ma_{n}) / nullif(ma_{n}, 0) AS price_to_ma_{n}" for n in (5, 20, 50)]
    f2 += [f"{_roll('stddev_samp', 'returns', n)} AS volatility_{n}" for n in (10, 20, 30)]
    f2 += ["CASE WHEN step > 0 THEN step ELSE 0 END AS gain, CASE WHEN step < 0 THEN -step ELSE 0 END AS loss", "price - ma_20 AS deviation"]
    f2 += ["(price - ma_20) / nullif(rolling_std, 0) AS z_score", "ma_20 AS bb_middle, ma_20 + 2 * rolling_std AS bb_upper, ma_20 - 2 * rolling_std AS bb_lower"]
    f2 += [f"(price - low_{n}) / nullif(high_{n} - low_{n}, 0) AS price_position_{n}, (high_{n} - price) / nullif(price, 0) * 100 AS dist_from_high_{n}, (price - low_{n}) / nullif(price, 0) * 100 AS dist_from_low_{n}" for n in (10, 20, 50)]
    f2 += ["CAST(day_of_month >= 28 AS INTEGER) AS is_month_end, CAST(day_of_month >= 28 AND month % 3 = 0 AS INTEGER) AS is_quarter_end, CAST(day_of_week = 0 AS INTEGER) AS is_monday, CAST(day_of_week = 4 AS INTEGER) AS is_friday"]
    f3 = [f"volatility_{n} * sqrt(252) AS volatility_{n}_annual" for n in (10, 20, 30)]
    f3 += [f"{_roll('stddev_samp', 'volatility_20', 20)} AS vol_of_vol", f"{_roll('avg', 'gain', 14)} AS avg_gain, {_roll('avg', 'loss', 14)} AS avg_loss"]
    f3 += ["(bb_upper - bb_lower) / nullif(bb_middle, 0) AS bb_bandwidth, (price - bb_lower) / nullif(bb_upper - bb_lower, 0) AS bb_percent"]
    f3 += [f"{_sign('z_score', '-1.5', '1.5')} AS signal_raw, {_clip('(-z_score / 1.5)')} AS signal_strength, {_roll('q75', 'volatility_20', 100)} AS cut"]
    f3 += [f"{_sign('ma_20', 'ma_5', 'ma_5')} AS ma_cross_signal"]
    f4 = ["CASE WHEN avg_loss = 0 AND avg_gain > 0 THEN 100 WHEN avg_loss > 0 THEN 100 - 100 / (1 + avg_gain / avg_loss) END AS rsi", "coalesce(CAST(volatility_20 < cut AS INTEGER), 0) AS vol_regime_ok"]
    f5 = ["coalesce(CAST(rsi < 30 AS INTEGER), 0) AS rsi_oversold, coalesce(CAST(rsi > 70 AS INTEGER), 0) AS rsi_overbought", "signal_raw * vol_regime_ok AS signal"]
    f6 = [f"CAST(signal - {_lag('signal')} AS DOUBLE) AS signal_change"]
    f7 = ["CAST(signal_change IS DISTINCT FROM 0 AS INTEGER) AS entry_signal"]
    out, before = [], "base"
    for k, columns in enumerate((f1, f2, f3, f4, f5, f6, f7), start=1):
        out.append(f"f{k} AS (SELECT *, {', '.join(columns)} FROM {before})")
        before = f"f{k}"
    return ", ".join([_DAILY, *out])


_INTS = {"rsi_oversold", "rsi_overbought", *FEATURES["calendar"], "signal_raw", "vol_regime_ok", "signal", "ma_cross_signal", "entry_signal"}
_FEATURED = _feature_ctes()

_SIGNALS = (
    f"{_DAILY}, s1 AS (SELECT *, {_change()} AS returns, {_roll('avg', 'price', 20)} AS ma_20, {_roll('avg', 'price', 5)} AS ma_5, {_roll('stddev_samp', 'price', 20)} AS sd, {_change(20)} * 100 AS roc FROM base), "
    f"s2 AS (SELECT *, {_roll('stddev_samp', 'returns', 20)} AS volatility_20, (price - ma_20) / nullif(sd, 0) AS z_score FROM s1), "
    "s3 AS (SELECT *, coalesce(CAST(volatility_20 < (SELECT quantile_cont(x.volatility_20, 0.75) FROM s2 x WHERE x.series_key = s2.series_key) AS INTEGER), 0) AS vol_regime_ok_global, "
    f"{_clip('(-z_score / 1.5)')} AS mean_reversion_strength, {_clip('((ma_5 - ma_20) / nullif(ma_20, 0) * 100)')} AS momentum_strength, {_sign('ma_20', 'ma_5', 'ma_5')} AS cross_signal FROM s2), "
    f"s4 AS (SELECT *, ({_sign('z_score', '-1.5', '1.5')}) * vol_regime_ok_global AS signal_mean_reversion, CASE WHEN cross_signal = 1 AND roc < 0 THEN 0 WHEN cross_signal = -1 AND roc > 0 THEN 0 ELSE cross_signal END AS signal_momentum, "
    "0.0 + mean_reversion_strength * 0.5 + momentum_strength * 0.5 AS combined_strength FROM s3), "
    "signalled AS (SELECT *, CASE WHEN combined_strength < -0.5 THEN -1 WHEN combined_strength > 0.5 THEN 1 ELSE 0 END AS signal_combined FROM s4)"
)


def _equity(signal: str, source: str = "signalled") -> str:
    return (
        f"e1 AS (SELECT *, CAST({_lag(signal)} AS DOUBLE) AS position FROM {source}), e2 AS (SELECT *, abs(position - {_lag('position')}) AS position_change FROM e1), "
        "e3 AS (SELECT *, position_change * (1.5 / 10000) AS transaction_costs, position * returns - position_change * (1.5 / 10000) AS strategy_returns_net FROM e2), "
        f"equity AS (SELECT *, {_product('strategy_returns_net')} AS cum_strategy_returns, {_product('returns')} AS cum_buy_hold FROM e3), "
        f"t1 AS (SELECT series_key, seq, timestamp, price, coalesce(position, 0) AS position FROM equity), t2 AS (SELECT *, lag(position) OVER ({_W}) AS before FROM t1), "
        f"t3 AS (SELECT *, lead(timestamp) OVER ({_W}) AS exit_time, lead(price) OVER ({_W}) AS exit_price FROM t2 WHERE before IS NULL OR before <> position), "
        "trades AS (SELECT series_key, timestamp AS entry_time, exit_time, CASE WHEN position = 1 THEN 'LONG' ELSE 'SHORT' END AS direction, price AS entry_price, exit_price, "
        "date_diff('second', timestamp, exit_time) / 3600.0 AS duration_hours, (CASE WHEN position = 1 THEN exit_price - price ELSE price - exit_price END) / nullif(price, 0) * 100 - 0.015 AS pnl, 0.015 AS cost "
        "FROM t3 WHERE position <> 0 AND exit_time IS NOT NULL)"
    )


_SUMMARY = (
    "SELECT series_key, {extra}" + ", ".join(f"{_r(x)} AS {n}" for x, n in (("total_return", "total_return"), ("total_return_bh", "total_return_bh"), ("total_return - total_return_bh", "excess_return")))
    + f", num_trades, logged_trades, {_r('coalesce(wins * 100.0 / nullif(logged_trades, 0), 0)')} AS win_rate, {_r('total_costs')} AS total_costs FROM (SELECT series_key, "
    "(arg_max(struct_pack(v := cum_strategy_returns), timestamp).v - 1) * 100 AS total_return, (arg_max(struct_pack(v := cum_buy_hold), timestamp).v - 1) * 100 AS total_return_bh, CAST(floor(coalesce(sum(position_change), 0) / 2) AS BIGINT) AS num_trades, coalesce(sum(transaction_costs), 0) * 100 AS total_costs "
    "FROM equity GROUP BY series_key) a LEFT JOIN (SELECT series_key AS k, count(*) AS n_log, count(*) FILTER (pnl > 0) AS n_win FROM trades GROUP BY series_key) b ON a.series_key = b.k, "
    "LATERAL (SELECT coalesce(n_log, 0) AS logged_trades, coalesce(n_win, 0) AS wins) c"
)


def _summary(extra: str = "") -> str:
    return _SUMMARY.replace("{extra}", extra)


def _bars() -> str:
    return "bars AS (SELECT series_key, CAST(timestamp AS DATE) AS trade_date, arg_min(price, (timestamp, seq)) AS open, min(price) AS low, max(price) AS high, arg_max(price, (timestamp, seq)) AS close, avg(price) AS avg, stddev_samp(price) AS volatility, count(price) AS num_obs FROM base GROUP BY 1, 2)"


def _feature(columns: list[str]) -> str:
    return f"WITH {_FEATURED} SELECT series_key, timestamp, {', '.join(c if c in _INTS else f'{_r(c)} AS {c}' for c in columns)} FROM f7"


def _severity(x: str, name: str, other: str = "NONE") -> str:
    return f"CASE WHEN {x} THEN '{name}' ELSE '{other}' END AS severity"


_DRAW = (
    f"d1 AS (SELECT *, {_product('strategy_returns_net')} AS cum, row_number() OVER ({_W}) AS rn FROM equity), d2 AS (SELECT *, max(cum) OVER ({_CUM}) AS top FROM d1), "
    "d3 AS (SELECT *, (cum - top) / nullif(top, 0) AS dd FROM d2), d4 AS (SELECT *, coalesce(dd < 0, false) AS under FROM d3), "
    f"d5 AS (SELECT *, lag(under) OVER ({_W}) AS was FROM d4), d6 AS (SELECT *, sum(CASE WHEN was IS NOT NULL AND was <> under THEN 1 ELSE 0 END) OVER ({_CUM}) AS run FROM d5), "
    "worst AS (SELECT series_key, min(dd) AS dd, arg_min(timestamp, (dd, rn)) FILTER (dd IS NOT NULL) AS worst_time, arg_min(rn, (dd, rn)) FILTER (dd IS NOT NULL) AS low, max(rn) AS n, arg_max(struct_pack(v := cum), rn).v AS growth FROM d6 GROUP BY series_key), "
    "len AS (SELECT series_key, avg(n) AS d FROM (SELECT series_key, run, count(*) AS n FROM d6 WHERE under GROUP BY 1, 2) GROUP BY 1), "
    "back AS (SELECT d6.series_key, min(rn) AS b FROM d6 JOIN worst USING (series_key) WHERE rn >= low AND d6.dd >= 0 GROUP BY 1)"
)


def oracle_sql() -> dict[str, str]:
    lo, hi, z, spike = ORDERS.min_price, ORDERS.max_price, ORDERS.outlier_z, ORDERS.spike_pct
    q = {
        "daily_summary": f"WITH {_TICK}, {_bars()} SELECT series_key, trade_date, open, low, high, close, {_r('avg', 6)} AS avg, {_r('volatility', 6)} AS volatility, num_obs, {_r('(close - open) / nullif(open, 0) * 100', 6)} AS daily_return FROM bars".replace("open, low, high, close,", ", ".join(f"{_r(c, 6)} AS {c}" for c in ("open", "low", "high", "close")) + ",", 1),
        "moving_averages": f"WITH {_TICK}, m AS (SELECT *, " + ", ".join(f"{_roll('avg', 'price', n)} AS ma_{n}" for n in (5, 20, 50)) + f" FROM base) SELECT series_key, seq, timestamp, {_r('price', 6)} AS price, "
        + ", ".join(f"{_r(f'ma_{n}', 6)} AS ma_{n}, {_r(f'price - ma_{n}', 6)} AS deviation_from_ma_{n}, {_r(f'(price - ma_{n}) / nullif(ma_{n}, 0) * 100', 6)} AS deviation_pct_{n}" for n in (5, 20, 50)) + " FROM m",
        "returns_volatility": f"WITH {_DAILY}, a AS (SELECT *, {_lag()} AS prev_price FROM base), b AS (SELECT *, (price - prev_price) / nullif(prev_price, 0) * 100 AS return_pct, ln(price / prev_price) AS log_return FROM a), c AS (SELECT *, "
        + ", ".join(f"{_roll('stddev_samp', 'return_pct', n)} AS v{n}" for n in (10, 20, 50)) + f" FROM b) SELECT series_key, seq, timestamp, {_r('price')} AS price, {_r('prev_price')} AS prev_price, {_r('return_pct')} AS return_pct, {_r('log_return')} AS log_return, "
        + ", ".join(f"{_r(f'v{n}')} AS rolling_vol_{n}, {_r(f'v{n} * sqrt(252)')} AS rolling_vol_{n}_annual" for n in (10, 20, 50)) + " FROM c",
        "extreme_moves": f"WITH {_TICK}, {_bars()}, m AS (SELECT series_key, trade_date, open, close, (close - open) / nullif(open, 0) * 100 AS r FROM bars) SELECT series_key, trade_date, {_r('open')} AS open, {_r('close')} AS close, {_r('r')} AS daily_return_pct, {_r('abs(r)')} AS abs_return_pct FROM m WHERE abs(r) > 1 ORDER BY abs(r) DESC, trade_date, series_key LIMIT 20",
        "signal_performance": f"WITH {_FEATURED}, a AS (SELECT *, " + ", ".join(f"(lead(price, {k}) OVER ({_W}) - price) / nullif(price, 0) * 100 AS r{k}" for k in (1, 5, 20)) + " FROM f7) SELECT series_key, signal, count(*) AS signal_count, "
        + ", ".join(f"{_r(f'avg(r{k})')} AS avg_{k}period_return" for k in (1, 5, 20)) + f", {_r('avg(z_score)')} AS avg_z_score FROM a WHERE signal <> 0 GROUP BY 1, 2",
        "volatility_regimes": f"WITH {_DAILY}, a AS (SELECT *, {_change()} AS returns FROM base), b AS (SELECT *, {_roll('stddev_samp', 'returns', 20)} AS v FROM a), c AS (SELECT series_key, quantile_cont(v, 0.33) AS lo, quantile_cont(v, 0.67) AS hi FROM b GROUP BY 1) "
        f"SELECT series_key, CASE WHEN v IS NULL THEN 'UNKNOWN' WHEN v < lo THEN 'LOW_VOL' WHEN v < hi THEN 'MEDIUM_VOL' ELSE 'HIGH_VOL' END AS vol_regime, count(price) AS observation_count, {_r('avg(price)')} AS avg_price, {_r('stddev_samp(price)')} AS price_std, {_r('avg(returns)')} AS avg_return, {_r('stddev_samp(returns)')} AS return_std FROM b JOIN c USING (series_key) GROUP BY 1, 2",
        "time_patterns": f"WITH {_DAILY}, a AS (SELECT *, {_change()} AS returns FROM base) SELECT series_key, CAST(isodow(timestamp) - 1 AS INTEGER) AS day_of_week, dayname(timestamp) AS day_name, count(returns) AS observation_count, {_r('avg(returns)')} AS avg_return, {_r('stddev_samp(returns)')} AS return_volatility, {_r('min(price)')} AS min_price, {_r('max(price)')} AS max_price FROM a GROUP BY 1, 2, 3",
        "drawdown_analysis": f"WITH {_DAILY}, a AS (SELECT *, max(price) OVER ({_CUM}) AS top FROM base), b AS (SELECT *, (price - top) / nullif(top, 0) * 100 AS dd FROM a) SELECT series_key, seq, timestamp, {_r('price')} AS price, {_r('top')} AS running_max, {_r('price - top')} AS drawdown, {_r('dd')} AS drawdown_pct FROM b WHERE dd < -0.5 ORDER BY dd, timestamp, seq, series_key LIMIT 20",
        "mean_reversion_speed": f"WITH {_FEATURED}, a AS (SELECT *, row_number() OVER ({_W}) AS rn FROM f7) SELECT e.series_key, e.timestamp AS extreme_time, CAST(min(f.rn) - e.rn AS INTEGER) AS reversion_days FROM a e JOIN a f ON e.series_key = f.series_key AND f.rn > e.rn AND f.rn <= e.rn + 20 AND abs(f.z_score) < 0.5 WHERE abs(e.z_score) > 1.5 GROUP BY e.series_key, e.timestamp, e.rn",
        "feature_correlations": f"WITH {_FEATURED}, a AS (SELECT *, lead(returns) OVER ({_W}) AS r1, CASE WHEN count(returns) OVER ({_W} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) = 5 AND row_number() OVER ({_W}) >= 5 THEN sum(returns) OVER ({_W} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) END AS r5 FROM f7) "
        + " UNION ALL ".join(f"SELECT series_key, '{f}' AS feature, {_r(f'corr({f}, r1)')} AS correlation_1period, {_r(f'corr({f}, r5)')} AS correlation_5period FROM a GROUP BY series_key" for f in REGRESSORS),
    }
    q |= {f"feat_{name}": _feature(columns) for name, columns in FEATURES.items()}
    q["feat_summary"] = f"WITH {_FEATURED} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, {_r(f'avg(CAST({c} AS DOUBLE))')} AS mean, {_r(f'stddev_samp(CAST({c} AS DOUBLE))')} AS std, {_r(f'min(CAST({c} AS DOUBLE))')} AS min, {_r(f'max(CAST({c} AS DOUBLE))')} AS max, count(*) - count({c}) AS null_count FROM f7" for c in ("returns", "ma_20", "volatility_20", "rsi", "z_score", "signal"))
    q |= {
        "q_initial_validation": f"WITH {_RAW} SELECT series_key, count(*) AS total_rows, min(timestamp) AS first_time, max(timestamp) AS last_time, count(*) - count(price) AS missing_prices, count(*) - count(DISTINCT timestamp) AS duplicate_timestamps, {_r('min(price)')} AS min_price, {_r('max(price)')} AS max_price FROM base GROUP BY 1",
        "q_duplicates": f"WITH {_RAW}, g AS (SELECT series_key, timestamp, count(*) AS n FROM base GROUP BY 1, 2), s AS (SELECT series_key, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS count, sum(n) AS rows FROM g GROUP BY 1) SELECT series_key, count, {_r('count * 100.0 / rows')} AS percentage, {_severity('count > 0', 'HIGH')} FROM s",
        "q_missing": f"WITH {_RAW}, g AS (SELECT series_key, count(*) AS n, count(*) - count(timestamp) AS missing_timestamp, count(*) - count(price) AS missing_price FROM base GROUP BY 1) SELECT series_key, missing_timestamp, missing_price, missing_timestamp + missing_price AS total, {_r('(missing_timestamp + missing_price) * 100.0 / (n * 2)')} AS percentage, {_severity('missing_timestamp + missing_price > 0', 'MEDIUM')} FROM g",
        "q_outliers": f"WITH {_DAILY}, s AS (SELECT series_key, avg(price) AS m, stddev_samp(price) AS sd, count(price) AS n FROM base GROUP BY 1), g AS (SELECT series_key, count(*) FILTER (abs((price - m) / nullif(sd, 0)) > {DEFAULTS.outlier_z}) AS count, max(n) AS n FROM base JOIN s USING (series_key) GROUP BY 1) SELECT series_key, count, {_r('count * 100.0 / nullif(n, 0)')} AS percentage, {_severity('count > 10', 'MEDIUM', 'LOW')} FROM g",
        "q_impossible": f"WITH {_RAW}, g AS (SELECT series_key, count(*) FILTER (price <= 0) AS negative_prices, count(*) FILTER (price < {lo}) AS below_min, count(*) FILTER (price > {hi}) AS above_max FROM base GROUP BY 1) SELECT *, {_severity('negative_prices + below_min + above_max > 0', 'HIGH')} FROM g",
        "q_spikes": f"WITH {_DAILY}, a AS (SELECT series_key, abs({_change()} * 100) AS c FROM base), g AS (SELECT series_key, count(*) FILTER (c > {DEFAULTS.spike_pct}) AS count, count(*) AS n, coalesce(max(c), 0) AS m FROM a GROUP BY 1) SELECT series_key, count, {_r('count * 100.0 / n')} AS percentage, {_r('m')} AS max_move, CASE WHEN count > 50 THEN 'HIGH' WHEN count > 10 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM g",
        "q_time_gaps": f"WITH {_DAILY}, a AS (SELECT series_key, date_diff('second', lag(timestamp) OVER ({_W}), timestamp) AS d FROM base), c AS (SELECT series_key, d, count(*) AS n FROM a WHERE d IS NOT NULL GROUP BY 1, 2), t AS (SELECT series_key, arg_min(d, (-n, d)) AS typical FROM c GROUP BY 1), g AS (SELECT k.series_key, coalesce(typical, 60) AS typical FROM (SELECT DISTINCT series_key FROM a) k LEFT JOIN t USING (series_key)) "
        f"SELECT a.series_key, count(*) FILTER (d > typical * 2) AS count, {_r('CAST(max(typical) AS DOUBLE)')} AS typical_seconds, {_r('CAST(max(d) AS DOUBLE)')} AS max_gap_seconds, {_severity('count(*) FILTER (d > typical * 2) > 20', 'MEDIUM', 'LOW')} FROM a JOIN g USING (series_key) GROUP BY 1",
        "q_flat_periods": f"WITH t0 AS (SELECT event_type AS series_key, event_id AS seq, ts AS timestamp, floor(value / 200) * 200.0 AS price FROM events), a AS (SELECT *, coalesce(price = {_lag()}, false) AS same FROM t0), b AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER ({_CUM}) AS run FROM a), c AS (SELECT series_key, run, count(*) FILTER (same) AS n FROM b GROUP BY 1, 2) SELECT series_key, count(*) FILTER (n > 3) AS num_long_flat_periods, max(n) AS max_consecutive_unchanged, {_severity('count(*) FILTER (n > 3) > 5', 'MEDIUM', 'LOW')} FROM c GROUP BY 1",
        "clean_dedup_last": f"WITH {_RAW} SELECT series_key, seq, timestamp, {_r('price')} AS price FROM base QUALIFY row_number() OVER (PARTITION BY series_key, timestamp ORDER BY seq DESC) = 1",
        "clean_ffill_limit": f"WITH t0 AS (SELECT event_type AS series_key, event_id AS seq, ts AS timestamp, CASE WHEN event_id % 13 >= 7 THEN value END AS price FROM events), a AS (SELECT series_key, seq, timestamp, last_value(price IGNORE NULLS) OVER ({_W} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS price FROM t0) SELECT series_key, seq, timestamp, {_r('price', 6)} AS price FROM a WHERE price IS NOT NULL",
        "clean_range": f"WITH {_RAW} SELECT series_key, seq, timestamp, {_r('price')} AS price FROM base WHERE price > 0 AND price BETWEEN {lo} AND {hi}",
        "clean_outliers": f"WITH {_DAILY}, s AS (SELECT series_key, avg(price) AS m, stddev_samp(price) AS sd FROM base GROUP BY 1) SELECT series_key, seq, timestamp, {_r('price')} AS price FROM base JOIN s USING (series_key) WHERE coalesce(abs((price - m) / nullif(sd, 0)) <= {z}, true)",
        "clean_spike_flag": f"WITH {_DAILY}, a AS (SELECT *, {_change()} * 100 AS c FROM base) SELECT series_key, seq, timestamp, {_r('price')} AS price, {_r('c')} AS price_change_pct, coalesce(abs(c) > {DEFAULTS.spike_pct}, false) AS potential_spike FROM a",
        "clean_full": f"WITH {_RAW}, a AS (SELECT * FROM base QUALIFY row_number() OVER (PARTITION BY series_key, timestamp ORDER BY seq DESC) = 1), b AS (SELECT * FROM a WHERE price BETWEEN {lo} AND {hi}), s AS (SELECT series_key, avg(price) AS m, stddev_samp(price) AS sd FROM b GROUP BY 1), c AS (SELECT b.* FROM b JOIN s USING (series_key) WHERE coalesce(abs((price - m) / nullif(sd, 0)) <= {z}, true)), e AS (SELECT *, {_change()} * 100 AS c FROM c) SELECT series_key, seq, timestamp, {_r('price')} AS price, {_r('c')} AS price_change_pct, coalesce(abs(c) > {spike}, false) AS potential_spike FROM e",
        "sig_mean_reversion": f"WITH {_SIGNALS} SELECT series_key, timestamp, signal_mean_reversion, {_r('mean_reversion_strength')} AS mean_reversion_strength, vol_regime_ok_global FROM signalled",
        "sig_momentum": f"WITH {_SIGNALS} SELECT series_key, timestamp, signal_momentum, {_r('momentum_strength')} AS momentum_strength FROM signalled",
        "sig_combined": f"WITH {_SIGNALS} SELECT series_key, timestamp, {_r('combined_strength')} AS combined_strength, signal_combined FROM signalled",
        "sig_summary": f"WITH {_SIGNALS} " + " UNION ALL ".join(f"SELECT series_key, '{c}' AS signal_name, " + ", ".join(f"count(*) FILTER ({c} = {v}) AS {k}_count, {_r(f'count(*) FILTER ({c} = {v}) * 100.0 / count(*)')} AS {k}_pct" for k, v in (("long", 1), ("short", -1), ("neutral", 0))) + " FROM signalled GROUP BY 1" for c in ("signal_mean_reversion", "signal_momentum", "signal_combined")),
        "sig_ma_cross": f"WITH {_FEATURED} SELECT series_key, ma_cross_signal, count(*) AS n FROM f7 GROUP BY 1, 2",
        "bt_equity": f"WITH {_SIGNALS}, {_equity('signal_mean_reversion')} SELECT series_key, timestamp, {_r('position')} AS position, {_r('strategy_returns_net')} AS strategy_returns_net, {_r('cum_strategy_returns')} AS cum_strategy_returns, {_r('cum_buy_hold')} AS cum_buy_hold FROM equity",
        "bt_summary": f"WITH {_SIGNALS}, {_equity('signal_mean_reversion')} {_summary()}",
        "bt_trades": f"WITH {_SIGNALS}, {_equity('signal_mean_reversion')} SELECT series_key, entry_time, exit_time, direction, {_r('entry_price')} AS entry_price, {_r('exit_price')} AS exit_price, {_r('duration_hours')} AS duration_hours, {_r('pnl')} AS pnl, {_r('CAST(cost AS DOUBLE)')} AS cost FROM trades",
        "bt_compare": " UNION ALL ".join(f"SELECT * FROM (WITH {_SIGNALS}, {_equity(f'signal_{n}')} " + _summary(f"'{n}' AS strategy, ") + ")" for n in ("mean_reversion", "momentum", "combined")),
        "bt_walk_forward": f"WITH {_SIGNALS}, wf AS (SELECT * EXCLUDE (c), CASE WHEN c < -0.5 THEN -1 WHEN c > 0.5 THEN 1 ELSE 0 END AS signal_wf FROM (SELECT *, CASE WHEN year(timestamp) % 2 = 0 THEN signal_mean_reversion * 0.8 + signal_momentum * 0.2 ELSE signal_mean_reversion * 0.3 + signal_momentum * 0.7 END AS c FROM signalled)), {_equity('signal_wf', 'wf')} {_summary()}",
        "m_returns": f"WITH {_DAILY}, a AS (SELECT *, {_change()} AS returns FROM base), b AS (SELECT *, {_product('returns')} AS cum FROM a), g AS (SELECT series_key, arg_max(struct_pack(v := cum), timestamp).v AS g, count(*) AS n, avg(returns) AS m, quantile_cont(returns, 0.5) AS med FROM b GROUP BY 1) SELECT series_key, {_r('(g - 1) * 100')} AS total_return_pct, {_r('(pow(g, 252.0 / n) - 1) * 100')} AS cagr_pct, {_r('m * 100')} AS avg_return_pct, {_r('m * 100 * 252')} AS avg_return_annual_pct, {_r('med * 100')} AS median_return_pct FROM g",
        "m_risk": f"WITH {_DAILY}, a AS (SELECT *, {_change()} AS r FROM base), c AS (SELECT series_key, quantile_cont(r, 0.05) AS cut FROM a GROUP BY 1), g AS (SELECT series_key, avg(r) AS m, stddev_samp(r) AS s, stddev_samp(r) FILTER (r < 0) AS d, skewness(r) AS skewness, kurtosis(r) AS kurtosis, max(cut) AS cut, avg(r) FILTER (r <= cut) AS tail FROM a JOIN c USING (series_key) GROUP BY 1) "
        f"SELECT series_key, {_r('s')} AS volatility, {_r('s * sqrt(252) * 100')} AS volatility_annual_pct, {_r('CASE WHEN s > 0 THEN m / s * sqrt(252) ELSE 0 END')} AS sharpe_ratio, {_r('CASE WHEN d > 0 THEN m / d * sqrt(252) ELSE 0 END')} AS sortino_ratio, {_r('skewness')} AS skewness, {_r('kurtosis')} AS kurtosis, {_r('cut * 100')} AS var_95_pct, {_r('tail * 100')} AS cvar_95_pct FROM g",
        "m_drawdown": f"WITH {_SIGNALS}, {_equity('signal_mean_reversion')}, {_DRAW} SELECT series_key, {_r('dd * 100')} AS max_drawdown_pct, worst_time AS max_drawdown_date, {_r('CASE WHEN dd <> 0 THEN (pow(growth, 252.0 / n) - 1) * 100 / abs(dd * 100) ELSE 0 END')} AS calmar_ratio, {_r('coalesce(d, 0)')} AS avg_drawdown_duration, CAST(coalesce(b - low, n - low + 1) AS INTEGER) AS max_recovery_time FROM worst LEFT JOIN len USING (series_key) LEFT JOIN back USING (series_key)",
        "m_trades": f"WITH {_SIGNALS}, {_equity('signal_mean_reversion')}, a AS (SELECT *, pnl > 0 AS win, lag(pnl > 0) OVER (PARTITION BY series_key ORDER BY entry_time) AS was FROM trades), b AS (SELECT *, sum(CASE WHEN was IS NOT NULL AND was <> win THEN 1 ELSE 0 END) OVER (PARTITION BY series_key ORDER BY entry_time) AS run FROM a), r AS (SELECT series_key, coalesce(max(n) FILTER (win), 0) AS max_win_streak, coalesce(max(n) FILTER (NOT win), 0) AS max_loss_streak FROM (SELECT series_key, run, first(win) AS win, count(*) AS n FROM b GROUP BY 1, 2) GROUP BY 1) "
        f"SELECT series_key, total_trades, winning_trades, losing_trades, {_r('winning_trades * 100.0 / total_trades')} AS win_rate_pct, {_r('aw')} AS avg_win_pct, {_r('al')} AS avg_loss_pct, {_r('coalesce(sw / nullif(abs(sl), 0), 0)')} AS profit_factor, {_r('dur')} AS avg_trade_duration_hours, {_r('best')} AS best_trade_pct, {_r('worst')} AS worst_trade_pct, max_win_streak, max_loss_streak FROM (SELECT series_key, count(*) AS total_trades, count(*) FILTER (pnl > 0) AS winning_trades, count(*) FILTER (pnl < 0) AS losing_trades, coalesce(avg(pnl) FILTER (pnl > 0), 0) AS aw, coalesce(avg(pnl) FILTER (pnl < 0), 0) AS al, coalesce(sum(pnl) FILTER (pnl > 0), 0) AS sw, sum(pnl) FILTER (pnl < 0) AS sl, avg(duration_hours) AS dur, max(pnl) AS best, min(pnl) AS worst FROM trades GROUP BY 1) JOIN r USING (series_key)",
        "m_benchmark": f"WITH {_DAILY}, a AS (SELECT *, {_change()} AS r FROM base), m AS (SELECT timestamp, CAST(sum(CAST(round(r, 9) AS DECIMAL(20,9))) AS DOUBLE) / nullif(count(r), 0) AS b FROM a GROUP BY 1), p AS (SELECT series_key, r, b, r - b AS x FROM a JOIN m USING (timestamp)), g AS (SELECT series_key, avg(x) AS m, stddev_samp(x) AS s, covar_samp(r, b) AS c, var_samp(b) FILTER (r IS NOT NULL) AS v FROM p GROUP BY 1) "
        f"SELECT series_key, {_r('CASE WHEN s > 0 THEN m / s * sqrt(252) ELSE 0 END')} AS information_ratio, {_r('s * sqrt(252) * 100')} AS tracking_error_pct, {_r('CASE WHEN v > 0 THEN c / v ELSE 0 END')} AS beta, {_r('m * 252 * 100')} AS mean_excess_annual_pct FROM g",
        "m_rolling": f"WITH {_SIGNALS}, {_equity('signal_mean_reversion')}, a AS (SELECT *, {_roll('avg', 'strategy_returns_net', 252)} AS m, {_roll('stddev_samp', 'strategy_returns_net', 252)} AS s, max(cum_strategy_returns) OVER ({_W} ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) AS top FROM equity) SELECT series_key, seq, timestamp, {_r('m / nullif(s, 0) * sqrt(252)')} AS rolling_sharpe, {_r('s * sqrt(252)')} AS rolling_volatility, {_r('(cum_strategy_returns - top) / nullif(top, 0)')} AS rolling_drawdown FROM a",
        "reg_univariate": f"WITH {_FEATURED}, a AS (SELECT *, lead(returns * 100) OVER ({_W}) AS y FROM f7), b AS (SELECT * FROM a WHERE y IS NOT NULL AND " + " AND ".join(f"{f} IS NOT NULL" for f in REGRESSORS) + "), s AS (" + " UNION ALL ".join(f"SELECT series_key, '{f}' AS feature, CAST(count(*) AS DOUBLE) AS n, stddev_pop({f}) AS s, covar_pop({f}, y) AS c, var_pop(y) AS v, corr({f}, y) AS k FROM b GROUP BY 1" for f in REGRESSORS)
        + f"), t AS (SELECT *, c / nullif(s, 0) AS slope, c / nullif(s, 0) * n / (n + 1) AS coef FROM s), u AS (SELECT *, v - 2 * coef * slope + coef * coef AS rest FROM t) SELECT series_key, feature, {_r('1 - rest / v')} AS r2, {_r('sqrt(rest)')} AS rmse, {_r('k')} AS correlation, {_r('coef')} AS coefficient, {_r('abs(k)')} AS abs_correlation FROM u",
        "describe": f"WITH {_FEATURED} " + " UNION ALL ".join(f"SELECT series_key, '{c}' AS \"column\", count({c}) AS count, {_r(f'avg({c})')} AS mean, {_r(f'stddev_samp({c})')} AS std, {_r(f'min({c})')} AS min, " + ", ".join(f"{_r(f'quantile_cont({c}, 0.{x})')} AS p{x}" for x in (25, 50, 75)) + f", {_r(f'max({c})')} AS max FROM f7 GROUP BY 1" for c in ("price", "returns", "rsi", "z_score")),
        "key_figures": f"WITH {_FEATURED}, a AS (SELECT *, max(price) OVER ({_CUM}) AS top FROM f7) SELECT series_key, count(*) AS final_rows, min(timestamp) AS first_time, max(timestamp) AS last_time, {_r('min(price)')} AS min_price, {_r('max(price)')} AS max_price, {_r('avg(returns) * 100')} AS avg_return_pct, {_r('stddev_samp(returns) * 100')} AS return_volatility_pct, {_r('avg(returns) / stddev_samp(returns) * sqrt(252)')} AS sharpe_ratio, {_r('(min(price / top) - 1) * 100')} AS max_drawdown_pct, "
        + ", ".join(f"{_r(f'count(*) FILTER (signal = {v}) * 100.0 / count(*)')} AS {k}_pct" for k, v in (("long", 1), ("short", -1), ("neutral", 0))) + " FROM a GROUP BY 1",
        "ch_drawdown": f"WITH {_DAILY}, a AS (SELECT *, {_change()} AS r FROM base), b AS (SELECT *, {_product('r')} AS cum FROM a), c AS (SELECT *, max(cum) OVER ({_CUM}) AS top FROM b) SELECT series_key, timestamp, {_r('(cum - top) / top * 100')} AS drawdown_pct FROM c",
        "ch_histogram": f"WITH {_TICK}, e AS (SELECT series_key, min(price) AS a, max(price) AS b, (max(price) - min(price)) / 50 AS w FROM base GROUP BY 1), h AS (SELECT series_key, a, w, CAST(CASE WHEN w > 0 THEN least(floor((price - a) / w), 49) ELSE 0 END AS INTEGER) AS bin, count(*) AS n FROM base JOIN e USING (series_key) GROUP BY 1, 2, 3, 4) SELECT series_key, bin, {_r('a + bin * w', 6)} AS low, {_r('a + (bin + 1) * w', 6)} AS high, n FROM h",
        "ch_monthly_pivot": f"WITH {_DAILY}, a AS (SELECT *, {_change()} AS r FROM base), m AS (SELECT series_key, CAST(year(timestamp) AS INTEGER) AS year, month(timestamp) AS month, (product(1 + r) - 1) * 100 AS r FROM a WHERE r IS NOT NULL GROUP BY 1, 2, 3) SELECT series_key, year, " + ", ".join(f"{_r(f'max(r) FILTER (month = {k})')} AS m{k}" for k in range(1, 13)) + " FROM m GROUP BY 1, 2",
        "ch_corr_matrix": f"WITH {_FEATURED} " + " UNION ALL ".join(f"SELECT series_key, '{b}' AS x, '{a}' AS y, {_r(f'corr({a}, {b})')} AS correlation FROM f7 GROUP BY 1" for k, a in enumerate(REGRESSORS) for b in REGRESSORS[k + 1 :]),
    }
    q |= regress_sql.twins(_FEATURED, _W, REGRESSORS, _r) | regress_sql.more_twins(_FEATURED, _W, REGRESSORS, _r, steps=8)
    every = [c for columns in FEATURES.values() for c in columns]
    dated = q["m_drawdown"].replace(f"{_SIGNALS}, {_equity('signal_mean_reversion')}", f"{_DAILY}, equity AS (SELECT *, {_change()} AS strategy_returns_net FROM base)")
    q |= {
        "src_standardized": f"SELECT 'ALL' AS series_key, CAST(0 AS BIGINT) AS seq, o_orderdate AS timestamp, {_r('o_totalprice')} AS price FROM orders",
        "feat_complete": f"WITH {_FEATURED} SELECT series_key, timestamp, {_r('price')} AS price, {_r('rsi')} AS rsi, signal FROM f7 WHERE price IS NOT NULL AND " + " AND ".join(f"{c} IS NOT NULL" for c in every),
        "clean_violations": f"WITH {_RAW}, a AS (SELECT *, timestamp <= {_lag('timestamp')} AS again FROM base) SELECT series_key, count(*) FILTER (timestamp IS NULL) AS null_timestamps, count(*) FILTER (price IS NULL) AS null_prices, count(*) FILTER (price <= 0) AS non_positive, count(*) FILTER (again) AS repeated_times FROM a GROUP BY 1",
        "q_largest_moves": f"WITH {_DAILY}, a AS (SELECT *, {_change()} * 100 AS c FROM base), b AS (SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY abs(c) DESC, timestamp, seq) AS rank FROM a WHERE c IS NOT NULL) SELECT series_key, CAST(rank AS INTEGER) AS rank, timestamp, {_r('c')} AS change_pct FROM b WHERE rank <= 3",
        "ch_price_signals": f"WITH {_FEATURED} SELECT series_key, timestamp, {_r('price')} AS price, {_r('ma_20')} AS ma_20, CASE signal WHEN 1 THEN 'LONG' WHEN -1 THEN 'SHORT' END AS marker FROM f7",
        "m_all": f"SELECT * FROM ({q['m_returns']}) JOIN ({q['m_risk']}) USING (series_key) JOIN ({dated}) USING (series_key)",
    }
    q |= _long_twins(q, dated) | _more_twins(q)
    full = q["clean_full"]
    q["clean_report"] = f"WITH {_RAW}, done AS ({full}) SELECT series_key, original_rows, final_rows, original_rows - final_rows AS removed, {_r('final_rows * 100.0 / original_rows')} AS retention_pct FROM (SELECT series_key, count(*) AS original_rows FROM base GROUP BY 1) JOIN (SELECT series_key, count(*) AS final_rows FROM done GROUP BY 1) USING (series_key)"
    return q


def _long_twins(q: dict[str, str], drawdown: str) -> dict[str, str]:
    """The SQL of queries of many series, for one series of all events."""
    every = _feature([c for columns in FEATURES.values() for c in columns])
    like = {"long_features": every, "long_equity": q["bt_equity"], "long_trades": q["bt_trades"], "long_drawdown": drawdown, "long_rolling": q["m_rolling"], "long_risk": q["m_risk"], "long_regimes": q["volatility_regimes"], "long_describe": q["describe"]}
    out = {name: sql.replace(_DAILY, _LONG) for name, sql in like.items()}
    out["long_trades"] = out["long_trades"].replace("date_diff('second', timestamp, exit_time) / 3600.0", "(epoch_us(exit_time) - epoch_us(timestamp)) / 3.6e9")
    signals = f"WITH {_SIGNALS} SELECT series_key, timestamp, signal_mean_reversion, signal_momentum, {_r('combined_strength')} AS combined_strength, signal_combined FROM signalled"
    out["long_signals"] = signals.replace(_DAILY, _LONG)
    out["long_price_drawdown"] = q["drawdown_analysis"].replace(_DAILY, _LONG).replace("dd < -0.5", "dd < -0.00003")
    out["long_spikes"] = q["q_spikes"].replace(_DAILY, _LONG).replace(f"c > {DEFAULTS.spike_pct}", "c > 0.01")
    one = "'ALL' AS series_key"
    out["long_flat_periods"] = q["q_flat_periods"].replace("event_type AS series_key", one).replace("floor(value / 200) * 200.0 AS price", "floor(((100 + value / 30011) - 100) * 150) / 150 AS price")
    out["long_fill"] = q["clean_ffill_limit"].replace("event_type AS series_key", one).replace("THEN value END", "THEN 100 + value / 30011 END")
    return out


def _more_twins(q: dict[str, str]) -> dict[str, str]:
    every = [c for columns in FEATURES.values() for c in columns]
    place = ", ".join(f"'{c}'" for c in every)
    values = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in every)
    long = f"WITH {_FEATURED}, n AS (SELECT series_key, row_number() OVER () AS id, {values} FROM f7), u AS MATERIALIZED (SELECT series_key, id, list_position([{place}], c) AS k, c, v FROM (UNPIVOT n ON {', '.join(every)} INTO NAME c VALUE v))"
    checks = {"duplicates": "q_duplicates", "missing_values": "q_missing", "price_outliers": "q_outliers", "price_spikes": "q_spikes", "time_gaps": "q_time_gaps", "flat_periods": "q_flat_periods", "impossible_values": "q_impossible"}
    figures = {
        "duplicates": ("count", "percentage"), "missing_values": ("missing_timestamp", "missing_price", "total", "percentage"), "price_outliers": ("count", "percentage"), "price_spikes": ("count", "percentage", "max_move"),
        "time_gaps": ("count", "typical_seconds", "max_gap_seconds"), "flat_periods": ("num_long_flat_periods", "max_consecutive_unchanged"), "impossible_values": ("negative_prices", "below_min", "above_max"),
    }
    parts = []
    for check, name in checks.items():
        sql = q[name].replace(_RAW, _DAILY)
        if name == "q_flat_periods":
            sql = sql.replace("t0 AS (SELECT event_type AS series_key, event_id AS seq, ts AS timestamp, floor(value / 200) * 200.0 AS price FROM events)", f"{_DAILY}, t0 AS (SELECT * FROM base)").replace("n > 3", f"n > {DEFAULTS.flat_run}")
        if name == "q_impossible":
            sql = sql.replace(f"price < {ORDERS.min_price}", f"price < {DEFAULTS.min_price}").replace(f"price > {ORDERS.max_price}", f"price > {DEFAULTS.max_price}")
        parts += [f"SELECT series_key, '{check}' AS \"check\", '{m}' AS metric, {_r(f'CAST({m} AS DOUBLE)')} AS value FROM ({sql})" for m in figures[check]]
    lo, hi = ORDERS.min_price, ORDERS.max_price
    holed = _RAW.replace("o_totalprice AS price", "CASE WHEN o_orderkey % 13 >= 7 THEN o_totalprice END AS price")
    steps = {"repeated time": "n - a", "no time": "a - t", "no price": "t - f", "impossible": "f - r", "outlier": "r - k", "kept": "k", "filled": "m"}
    text = (
        "t AS (SELECT CAST(o_orderkey AS VARCHAR) AS key, CASE WHEN o_orderkey % 70 = 3 THEN 'soon' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date, "
        "CASE WHEN o_orderkey % 40 = 1 THEN 'n/a' WHEN o_orderkey % 40 = 2 THEN ' ' ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END AS price, o_orderpriority AS priority FROM orders)"
    )
    from statistics import NormalDist

    points = ", ".join(f"({k / 100}, {NormalDist().inv_cdf(k / 100)!r})" for k in range(1, 100))
    return {
        "ch_corr_all": f"{long} SELECT a.series_key, a.c AS x, b.c AS y, count(*) AS n, {_r('CASE WHEN max(a.v) > min(a.v) AND max(b.v) > min(b.v) THEN corr(a.v, b.v) END')} AS correlation FROM u a JOIN u b ON a.id = b.id AND a.k > b.k GROUP BY 1, 2, 3",
        "ch_quantile_points": f"WITH {_DAILY}, a AS (SELECT series_key, {_change()} AS r FROM base), p(share, theoretical) AS (VALUES {points}) SELECT series_key, {_r('theoretical')} AS theoretical, {_r('q[CAST(round(share * 100) AS INTEGER)]')} AS sample "
        f"FROM (SELECT series_key, quantile_cont(r, [{', '.join(str(k / 100) for k in range(1, 100))}]) AS q FROM a GROUP BY 1), p",
        "reg_top_features": f"SELECT series_key, feature, weight, abs_weight FROM ({q['reg_importance']}) QUALIFY row_number() OVER (ORDER BY abs_weight DESC, feature) <= 7",
        "q_all_checks": " UNION ALL ".join(f"SELECT * FROM ({p})" for p in parts),
        "clean_steps": f"WITH {holed}, a AS (SELECT * FROM base QUALIFY row_number() OVER (PARTITION BY series_key, timestamp ORDER BY seq DESC) = 1), f0 AS (SELECT series_key, price AS before, last_value(price IGNORE NULLS) OVER ({_W} ROWS BETWEEN {DEFAULTS.fill_limit} PRECEDING AND CURRENT ROW) AS price FROM a WHERE timestamp IS NOT NULL), "
        f"f AS (SELECT * FROM f0 WHERE price IS NOT NULL), r AS (SELECT * FROM f WHERE price BETWEEN {lo} AND {hi}), s AS (SELECT series_key, avg(price) AS m, stddev_samp(price) AS sd FROM r GROUP BY 1), k AS (SELECT r.* FROM r JOIN s USING (series_key) WHERE coalesce(abs((price - m) / nullif(sd, 0)) <= {ORDERS.outlier_z}, true)), "
        + ", ".join(f"c_{n} AS (SELECT series_key, count(*) AS {n} FROM {source} GROUP BY 1)" for n, source in (("n", "base"), ("a", "a"), ("t", "f0"), ("f", "f"), ("r", "r"), ("k", "k"), ("m", "(SELECT * FROM f WHERE before IS NULL)")))
        + ", c AS (SELECT * FROM c_n JOIN c_a USING (series_key) JOIN c_t USING (series_key) JOIN c_f USING (series_key) JOIN c_r USING (series_key) JOIN c_k USING (series_key) JOIN c_m USING (series_key)) "
        + " UNION ALL ".join(f"SELECT series_key, '{step}' AS step, {e} AS rows FROM c" for step, e in steps.items()),
        "m_full": f"SELECT * FROM ({q['m_all']}) JOIN ({q['m_trades']}) USING (series_key) JOIN ({q['m_benchmark']}) USING (series_key)",
        "src_typed": f"WITH {text}, n AS (SELECT 'key' AS c, 'bigint' AS kind, count(key) AS v, count(TRY_CAST(key AS BIGINT)) AS f FROM t UNION ALL SELECT 'date', 'timestamp', count(nullif(trim(date), '')), count(TRY_CAST(date AS TIMESTAMP)) FROM t "
        "UNION ALL SELECT 'price', 'double', count(nullif(trim(price), '')), count(TRY_CAST(price AS DOUBLE)) FROM t UNION ALL SELECT 'priority', 'string', count(priority), count(priority) FROM t) SELECT c AS \"column\", kind, v AS \"values\", v - f AS failures FROM n",
        "src_rejected": f"WITH {text}, r AS (SELECT priority, price, concat_ws('; ', CASE WHEN date = 'soon' THEN 'date is no timestamp' END, CASE WHEN price = 'n/a' THEN 'price is no double' END) AS reasons FROM t) "
        "SELECT priority, CASE reasons WHEN '' THEN 'none' ELSE reasons END AS reasons, count(*) AS rows, count(*) FILTER (reasons = '' AND trim(price) <> '') AS prices FROM r GROUP BY 1, 2",
    }
