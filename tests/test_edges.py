"""Hand-made series: missing values, ties, constants, short and empty inputs."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from seriesloom.functions.expr import clip, sample_kurtosis, sample_skew
from seriesloom.operators import backtest, catalogue, clean, features, metrics, quality, signals
from seriesloom.params import DEFAULTS, Params
from seriesloom.sources.series import as_series, parse_timestamps, standardize_columns

T0 = datetime(2024, 1, 1)
SCHEMA = "series_key string, seq bigint, timestamp timestamp, price double"


def series(spark, prices, key="a", step=timedelta(days=1)):
    return spark.createDataFrame([(key, k, T0 + k * step, p) for k, p in enumerate(prices)], SCHEMA)


def column(df, name, order=("timestamp", "seq")):
    return [r[name] for r in df.orderBy(*order).collect()]


def test_names_are_mapped_and_clashes_refused(spark):
    df = spark.createDataFrame([("2024-01-01", 1.0)], " Date string, CLOSE double")
    assert standardize_columns(df).columns == ["timestamp", "price"]
    with pytest.raises(ValueError, match="several columns"):
        standardize_columns(spark.createDataFrame([(1, 2, 3)], "date int, time int, price int"))
    with pytest.raises(ValueError, match="required"):
        standardize_columns(spark.createDataFrame([(1,)], "price int"))


def test_bad_timestamps_are_missing_and_count_as_duplicates(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00", 1.0), ("nonsense", 2.0), (None, float("nan"))], "timestamp string, price double")
    df = as_series(parse_timestamps(df))
    assert sorted(r["timestamp"] is None for r in df.collect()) == [False, True, True]
    assert quality.duplicates(df).first()["count"] == 2
    first = quality.initial_validation(df).first()
    assert (first["missing_prices"], first["duplicate_timestamps"]) == (1, 1)


def test_fill_stops_at_the_limit(spark):
    df = clean.fill_missing(series(spark, [1.0, *[None] * 7, 2.0]))
    assert column(df, "seq") == [0, 1, 2, 3, 4, 5, 8]


def test_last_of_a_timestamp_stays_in_any_input_order(spark):
    rows = [("a", s, T0, p) for s, p in ((2, 7.0), (0, 5.0), (1, 6.0))]
    for r in (rows, rows[::-1]):
        assert column(clean.dedup_keep_last(spark.createDataFrame(r, SCHEMA)), "price") == [7.0]


def test_constant_prices_have_no_deviation(spark):
    df = series(spark, [100.0] * 120)
    assert clean.drop_outliers(df).count() == 120
    f = features.all_features(df, drop_warm_up=False).orderBy("timestamp").collect()[-1]
    assert (f["rsi"], f["bb_percent"], f["price_position_20"], f["z_score"], f["signal"]) == (None, None, None, None, 0)
    assert quality.flat_periods(df).first()["max_consecutive_unchanged"] == 119
    assert quality.outliers(df).first()["count"] == 0


def test_rising_prices_have_full_strength(spark):
    f = features.add_rsi(series(spark, [float(k) for k in range(1, 61)]))
    rsi = column(f, "rsi")
    assert rsi[12] is None and rsi[13] == 100.0
    assert column(f, "rsi_overbought")[12:14] == [0, 1]


@pytest.mark.parametrize("prices", [[], [5.0]])
def test_tiny_series(spark, prices):
    df = features.all_features(series(spark, prices), drop_warm_up=False)
    assert df.count() == len(prices)
    assert features.all_features(series(spark, prices)).count() == 0
    for q in catalogue.run_all(df).values():
        q.collect()
    for check in quality.CHECKS.values():
        check(series(spark, prices)).collect()
    assert metrics.risk_metrics(df).count() == len(prices)
    e = backtest.with_equity(df, "signal")
    backtest.summary(e, backtest.trades(e)).collect()


def test_sixty_seven_features(spark):
    df = series(spark, [1.0])
    assert len(features.all_features(df).columns) - len(df.columns) == 67


def test_zero_price_is_no_error(spark):
    r = column(features.add_returns(series(spark, [1.0, 0.0, 2.0])), "returns")
    assert r == [None, -1.0, None]
    assert column(features.add_returns(series(spark, [1.0, 0.0, 2.0])), "log_returns") == [None, None, None]


def test_trades_of_a_position(spark):
    df = series(spark, [10.0, 11.0, 12.0, 13.0, 12.0, 11.0, 10.0, 9.0])
    df = df.withColumn("s", F.element_at(F.array(*map(F.lit, [0, 1, 1, -1, -1, 0, 1, 1])), (F.col("seq") + 1).cast("int")))
    e = backtest.with_equity(df, "s")
    log = backtest.trades(e).orderBy("entry_time").collect()
    assert [(r["direction"], r["entry_price"], r["exit_price"]) for r in log] == [("LONG", 12.0, 12.0), ("SHORT", 12.0, 10.0)]
    strict = backtest.trades(e, strict=True).orderBy("entry_time").collect()
    assert (strict[0]["direction"], strict[0]["entry_price"], len(strict)) == ("SHORT", 10.0, 3)
    with pytest.raises(ValueError, match="no signal column"):
        backtest.with_equity(df, "absent")


def test_a_trade_without_gain_is_in_a_losing_streak(spark):
    log = spark.createDataFrame([("a", T0 + timedelta(days=k), p, 24.0) for k, p in enumerate([1.0, 2.0, 0.0, -1.0])], "series_key string, entry_time timestamp, pnl double, duration_hours double")
    m = metrics.trade_metrics(log).first()
    assert (m["winning_trades"], m["losing_trades"], m["max_win_streak"], m["max_loss_streak"]) == (2, 1, 2, 2)


def test_sum_of_five_ahead_lacks_the_first_rows(spark):
    df = catalogue.forward_returns(series(spark, [1.0] * 8).withColumn("returns", F.lit(1.0)))
    assert column(df, "return_5_ahead") == [None] * 8
    df = catalogue.forward_returns(series(spark, [1.0] * 11).withColumn("returns", F.lit(1.0)))
    assert column(df, "return_5_ahead") == [None] * 4 + [5.0, 5.0] + [None] * 5


def test_other_series_do_not_matter(spark):
    a, b = series(spark, [1.0, 2.0, 4.0, 3.0] * 8), series(spark, [9.0, 1.0] * 16, key="b")
    one = features.add_momentum(a)
    both = features.add_momentum(a.unionByName(b)).where("series_key = 'a'")
    assert one.exceptAll(both).count() == 0 and both.exceptAll(one).count() == 0


def test_clip_keeps_missing_and_moments_are_corrected(spark):
    df = spark.createDataFrame([(x,) for x in (None, -5.0, 0.5, 3.0)], "x double").select(clip(F.col("x"), -2, 2).alias("y"))
    assert sorted((r["y"] for r in df.collect()), key=str) == sorted([None, -2.0, 0.5, 2.0], key=str)
    import pandas as pd

    x = pd.Series([1.0, 2.0, 2.5, 7.0, 11.0, 3.0])
    r = spark.createDataFrame([(v,) for v in x], "x double").agg(sample_skew(F.col("x")).alias("s"), sample_kurtosis(F.col("x")).alias("k")).first()
    assert r["s"] == pytest.approx(x.skew()) and r["k"] == pytest.approx(x.kurtosis())


def test_unknown_weights_are_refused(spark):
    df = signals.momentum(signals.mean_reversion(series(spark, [1.0] * 3)))
    with pytest.raises(ValueError, match="no such signals"):
        signals.combined(df, {"rsi": 1.0})


def test_all_checks_and_violations(spark):
    df = series(spark, [100.0, 100.0, 95.0, 200.0])
    got = {(r["check"], r["metric"]): r["value"] for r in quality.all_checks(df).collect()}
    assert got["impossible_values", "above_max"] == "1" and got["price_spikes", "count"] == "2"
    assert "PRICE SPIKES" in quality.report(quality.all_checks(df))
    done = clean.clean(df, Params(min_price=1.0, max_price=1000.0))
    assert all(v == 0 for k, v in clean.violations(done).first().asDict().items() if k != "series_key")
    report = clean.cleaning_report(df, clean.clean(df)).first()
    assert (report["original_rows"], report["final_rows"], report["removed"]) == (4, 3, 1)


def test_weights_hold_from_their_date(spark):
    df = series(spark, [1.0] * 5).withColumn("s", F.lit(1))
    w = spark.createDataFrame([("a", T0 + timedelta(days=1), 0.4), ("a", T0 + timedelta(days=3), 0.9)], "series_key string, date timestamp, s double")
    out = backtest.with_dated_weights(df, w, ["s"])
    assert column(out, "combined_signal_wf") == [0.0, 0.4, 0.4, 0.9, 0.9]
    assert column(out, "signal_wf") == [0, 0, 0, 1, 1]
    assert DEFAULTS.ensemble_threshold == 0.5
