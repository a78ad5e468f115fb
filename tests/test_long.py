"""Long series: the same values as the operators that take a series whole, whatever the sizes of chunks and buckets."""

from __future__ import annotations

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from seriesloom.functions import chunks
from seriesloom.functions.blocks import compounded_in_blocks
from seriesloom.functions.chunks import PLACE
from seriesloom.functions.expr import KEY, series_window
from seriesloom.functions.quantiles import quantiles, quantiles_by_ranges
from seriesloom.operators import backtest, catalogue, clean, features, longseries, metrics, quality, signals, summary
from seriesloom.params import Params
from seriesloom.sources.series import tick, ticks

from .oracle import connect, difference

SF = "/root/testdata/sf0.001"
SIZES = [Params(chunk_rows=7, bucket_seconds=3_000, flat_run=2, metric_window=30), Params(chunk_rows=64, bucket_seconds=400_000, flat_run=2, metric_window=30)]


@pytest.fixture(scope="module", params=SIZES, ids=["tiny", "small"])
def p(request):
    return request.param


@pytest.fixture(scope="module")
def odd(spark):
    """Three series with missing prices and times, equal prices and equal times, and one of a single row."""
    rng, rows = random.Random(4), []
    for key, n in (("a", 230), ("b", 90), ("c", 1)):
        price = 100.0
        for k in range(n):
            price = price if rng.random() < 0.3 else max(1.0, price + rng.gauss(0, 2))
            t = None if rng.random() < 0.03 else f"2024-01-{1 + k // 24 % 28:02d} {k % 24:02d}:00:00"
            rows.append((key, k, t, None if rng.random() < 0.1 else price))
    df = spark.createDataFrame(rows, "series_key string, seq bigint, t string, price double")
    return df.select(KEY, "seq", F.to_timestamp("t").alias("timestamp"), "price").repartition(3).cache()


def same(got, want, digits=9):
    def text(v):
        return str(float(f"{v:.{digits}g}") + 0.0) if isinstance(v, float) else str(v)

    got, want = got.select(*want.columns), want
    a, b = (sorted(tuple(text(v) for v in r) for r in df.collect()) for df in (got, want))
    assert len(a) == len(b) and [x for x in zip(a, b) if x[0] != x[1]][:2] == []


def test_places(odd, p):
    at = chunks.placed(odd, p).withColumn("want", F.row_number().over(series_window()) - 1)
    assert at.count() == odd.count() and at.where("want <> _place").count() == 0
    assert at.groupBy(KEY, chunks.CHUNK).count().agg(F.max("count")).first()[0] <= p.chunk_rows


def test_features(spark, p):
    df = tick(spark, SF).withColumn("price", 100 + F.col("price") / 10)
    want = features.all_features(df, p, drop_warm_up=False)
    for sliding in (True, False)[: 1 + (p.chunk_rows > 7)]:
        same(longseries.features(df, p, sliding).drop("signal_strength"), want.drop("signal_strength"), 7)


def test_features_of_odd_rows(odd, p):
    want = features.all_features(odd, p, drop_warm_up=False)
    same(longseries.features(odd, p).select(KEY, "seq", "returns", "ma_50", "rsi", "vol_regime_ok", "entry_signal"), want.select(KEY, "seq", "returns", "ma_50", "rsi", "vol_regime_ok", "entry_signal"), 7)


def test_running_quantities(odd, p):
    r = features.add_returns(odd)
    columns = [KEY, "seq", "cum_returns", "running_max", "drawdown"]
    same(longseries.with_drawdown(r, p=p).select(columns), metrics.with_drawdown(r).select(columns))
    timed = r.where("timestamp is not null")
    same(longseries.drawdown_metrics(timed, p=p), metrics.drawdown_metrics(timed, p=p))
    same(longseries.flat_periods(odd, p), quality.flat_periods(odd, p))
    same(longseries.spikes(odd, p), quality.spikes(odd, p))
    same(longseries.fill_missing(odd, p), clean.fill_missing(odd, p))
    same(longseries.rolling_metrics(r, p=p), metrics.rolling_metrics(r, p=p))
    same(longseries.price_drawdown(odd, p=p, top=1000), catalogue.drawdown_analysis(odd, top=1000))


def test_growth_below_zero(spark, p):
    rows = [("a", k, k, [0.5, -3.0, 0.1, -1.5, None, 0.2, -2.5][k % 7]) for k in range(40)]
    r = spark.createDataFrame(rows, "series_key string, seq bigint, k bigint, returns double").select(KEY, "seq", F.timestamp_seconds("k").alias("timestamp"), "returns")
    columns = [KEY, "seq", "cum_returns", "running_max", "drawdown"]
    same(longseries.with_drawdown(r, p=p).select(columns), metrics.with_drawdown(r).select(columns))


def test_equal_drawdowns_whatever_the_chunks(spark):
    """Prices that come back to the same top and bottom: of equal drawdowns the first counts, and a second top is none."""
    rng, prices = random.Random(8), [100.0]
    for k in range(4000):
        prices.append([100.01, 99.99][k // 50 % 2] if k % 50 == 25 else 100 + rng.randrange(-900, 900) / 100_000)
    top, deepest, under = 0.0, (0.0, 0), []
    for k, price in enumerate(prices[1:], 1):
        top = max(top, price)
        deepest = min(deepest, ((price - top) / top, k))
        under.append(price < top)
    entries = sum(b and not a for a, b in zip([False, *under], under, strict=False))
    df = spark.createDataFrame([("a", k, k, x) for k, x in enumerate(prices)], "series_key string, seq bigint, k bigint, price double")
    r = features.add_returns(df.select(KEY, "seq", F.timestamp_seconds("k").alias("timestamp"), "price"))
    for rows in (7, 50, 64, 300):
        got = longseries.drawdown_metrics(r, p=Params(chunk_rows=rows, bucket_seconds=1_000)).first()
        assert got["max_drawdown_date"].timestamp() == deepest[1], rows
        assert got["avg_drawdown_duration"] == pytest.approx(sum(under) / entries)


def with_copies(tmp_path, copies, lowest):
    """A folder with events that come several times at the same time."""
    con = duckdb.connect()
    con.execute(f"COPY (SELECT event_id * {copies} + k AS event_id, ts, user_id, event_type, greatest(value, {lowest}) AS value, props FROM read_parquet('{SF}/events.parquet'), range({copies}) t(k)) TO '{tmp_path}/events.parquet'")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["long_drawdown", "long_features", "long_signals"])
def test_ties_fall_as_in_sql(spark, tmp_path, name):
    """Six equal prices in a row and a bottom that many rows share: averages that meet, volatilities at the quantile and
    drawdowns of one depth are decided by the last bits, so sums and products are taken in the SQL's order."""
    folder = with_copies(tmp_path, 6, 20)
    assert difference(queries()[name](spark, folder), connect(folder), oracle_sql()[name]) is None


def test_averages_that_meet_fall_as_in_sql(spark, tmp_path):
    """Prices that repeat after five rows: averages of 5 and 20 rows are equal, and only the order of sums tells them apart."""
    path = f"{tmp_path}/events.parquet"
    duckdb.connect().execute(f"COPY (SELECT event_id, ts, [101.13, 202.37, 53.83, 70.59, 7.13][event_id % 5 + 1]::DOUBLE AS value FROM read_parquet('{SF}/events.parquet')) TO '{path}'")
    assert difference(queries()["long_signals"](spark, str(tmp_path)), connect(str(tmp_path)), oracle_sql()["long_signals"]) is None


def test_growth_in_the_order_of_blocks(spark):
    """Products come out to the last bit as those of a tree of 16, over several pieces, with a missing return."""
    rng = random.Random(6)
    returns = [None if k in (0, 4500) else rng.gauss(0, 0.01) for k in range(9000)]
    levels = [[1.0 if r is None else 1 + r for r in returns]]
    while len(levels[-1]) > 1:
        levels.append([math.prod(levels[-1][k : k + 16], start=1.0) for k in range(0, len(levels[-1]), 16)])
    df = spark.createDataFrame(list(enumerate(returns)), f"{PLACE} bigint, returns double").withColumn(KEY, F.lit("a"))
    got = {r[PLACE]: r["c"] for r in compounded_in_blocks(df, "c", "returns").collect()}
    for k, r in enumerate(returns):
        end, parts = k + 1, []
        for level in levels:
            parts.insert(0, level[end // 16 * 16 : end])
            end //= 16
        assert got[k] == (None if r is None else math.prod([x for part in parts for x in part], start=1.0)), k


def test_signals_equity_and_trades(spark, p):
    df = tick(spark, SF).withColumn("price", 100 + F.col("price") / 10)
    want = signals.all_signals(features.add_volatility(features.add_returns(df)))
    got = longseries.all_signals(df, p)
    columns = [KEY, "seq", "signal_mean_reversion", "signal_momentum", "signal_combined", "combined_strength", "vol_regime_ok_global"]
    same(got.select(columns), want.select(columns), 7)
    a, b = backtest.with_equity(want, "signal_momentum"), longseries.with_equity(got, "signal_momentum", p)
    columns = [KEY, "seq", "position", "strategy_returns_net", "cum_strategy_returns", "cum_buy_hold"]
    same(b.select(columns), a.select(columns))
    log = backtest.trades(a)
    same(longseries.trades(b, p), log)
    same(longseries.trade_streaks(log, p), metrics.trade_metrics(log).select(KEY, "max_win_streak", "max_loss_streak"))


def test_dated_weights(spark, odd, p):
    df = odd.withColumns({"s1": (F.col("seq") % 3 - 1).cast("int"), "s2": (F.col("seq") % 2).cast("int")})
    weights = spark.createDataFrame([("a", "2024-01-03 05:00:00", 0.9, None), ("a", "2024-01-05 00:00:00", 0.1, 0.8), ("b", "2024-01-01 00:00:00", 1.0, 1.0)], "series_key string, d string, s1 double, s2 double")
    weights = weights.select(KEY, F.to_timestamp("d").alias("date"), "s1", "s2")
    want = backtest.with_dated_weights(df, weights, ["s1", "s2"], p)
    same(longseries.with_dated_weights(df, weights, ["s1", "s2"], p), want)


def test_no_task_orders_a_whole_series(spark):
    """No window of many rows is partitioned by the series alone: those that are have a row for each chunk or bucket."""
    plan = longseries.with_drawdown(features_of(spark), p=Params(chunk_rows=50))._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.splitlines():
        if "Window [" in line and "[series_key" in line.rsplit("], [", 1)[0].rsplit("[", 1)[-1]:
            assert "_chunk" in line or "_bucket" in line


def features_of(spark):
    return ticks(spark, SF).withColumn("returns", F.col("price") / 100 - 1)


SHARES = (0.0, 0.05, 0.25, 0.33, 0.5, 0.999, 1.0)


def test_quantiles_by_ranges(spark):
    rng = random.Random(1)
    rows = []
    for k in range(4000):
        wide = None if k % 11 == 0 else 0.0 if k % 7 == 0 else rng.choice([-1, 1]) * math.exp(rng.gauss(0, 8))
        rows.append((f"s{k % 3}", wide, round(rng.gauss(0, 1), 1) + 0.0, 1e6 + rng.random(), None, 7.0))
    rows.append(("lone", 1.5, None, -2.0, None, 7.0))
    df = spark.createDataFrame(rows, "series_key string, wide double, tied double, close double, none double, flat double")
    wanted = {f"{c}_{k}": (c, q) for c in df.columns[1:] for k, q in enumerate(SHARES)}
    a, b = (sorted(map(str, quantiles(df, wanted, p).select(KEY, *wanted).collect())) for p in (Params(), Params(long_series=True)))
    assert a == b
    assert quantiles_by_ranges(df.limit(0), wanted).collect() == []


def test_operators_with_quantiles_by_ranges(odd):
    long, r = Params(long_series=True), features.add_returns(odd)
    same(metrics.risk_metrics(r, p=long), metrics.risk_metrics(r))
    same(catalogue.volatility_regimes(odd, long), catalogue.volatility_regimes(odd))
    same(summary.describe(r, ["price", "returns"], long), summary.describe(r, ["price", "returns"]))
    v = features.add_volatility(r)
    same(signals.mean_reversion(v, long), signals.mean_reversion(v))


def test_quantiles_hold_no_values_in_a_buffer(odd):
    plan = quantiles_by_ranges(odd, {"m": ("price", 0.5)})._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan.lower() and "collect_list" not in plan
