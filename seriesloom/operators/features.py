"""The feature columns of a clean series, in groups that can be taken one by one.

All frames are bounded or running windows over one ordering, so a series is
shuffled and sorted once for all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.blocks import deviation_of_last, mean_of_last
from ..functions.expr import change, clip, flag, lag, log_ratio, ratio, roll, sign_of
from ..params import DEFAULTS, Params


def add_returns(df: DataFrame) -> DataFrame:
    return df.withColumns({"returns": change("price"), "log_returns": log_ratio(F.col("price"), lag("price"))})


def add_moving_averages(df: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    for n in p.ma_windows:
        df = df.withColumn(f"ma_{n}", mean_of_last(df, "price", n, p))
    return df.withColumns({f"price_to_ma_{n}": ratio(F.col("price") - F.col(f"ma_{n}"), F.col(f"ma_{n}")) for n in p.ma_windows})


def add_volatility(df: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Needs returns."""
    df = df.withColumns({f"volatility_{n}": deviation_of_last(df, "returns", n, p) for n in p.vol_windows})
    df = df.withColumns({f"volatility_{n}_annual": F.col(f"volatility_{n}") * F.sqrt(F.lit(p.annual_factor)) for n in p.vol_windows})
    return df.withColumn("vol_of_vol", roll(F.stddev_samp, "volatility_20", 20))


def add_momentum(df: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    new = {}
    for k in p.momentum_periods:
        new[f"momentum_{k}"] = F.col("price") - lag("price", k)
        new[f"momentum_{k}_pct"] = change("price", k) * 100
    return df.withColumns(new | {f"roc_{k}": change("price", k) * 100 for k in (5, 20)})


def add_rsi(df: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Simple averages; the first row counts as no change, so the index exists from the period's last row on."""
    step = F.col("price") - lag("price")
    df = df.withColumns({"_gain": F.when(step > 0, step).otherwise(0.0), "_loss": F.when(step < 0, -step).otherwise(0.0)})
    df = df.withColumns({"_gain": roll(F.avg, "_gain", p.rsi_period), "_loss": roll(F.avg, "_loss", p.rsi_period)})
    g, loss = F.col("_gain"), F.col("_loss")
    rsi = F.when((loss == 0) & (g > 0), F.lit(100.0)).when(loss > 0, 100 - 100 / (1 + ratio(g, loss)))
    df = df.withColumn("rsi", rsi).drop("_gain", "_loss")
    return df.withColumns({"rsi_oversold": flag(F.col("rsi") < 30), "rsi_overbought": flag(F.col("rsi") > 70)})


def add_bands(df: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    df = df.withColumns({"bb_middle": mean_of_last(df, "price", p.band_window, p), "_width": deviation_of_last(df, "price", p.band_window, p) * p.band_width})
    df = df.withColumns({"bb_upper": F.col("bb_middle") + F.col("_width"), "bb_lower": F.col("bb_middle") - F.col("_width")}).drop("_width")
    span = F.col("bb_upper") - F.col("bb_lower")
    return df.withColumns({"bb_bandwidth": ratio(span, F.col("bb_middle")), "bb_percent": ratio(F.col("price") - F.col("bb_lower"), span)})


def add_price_position(df: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    for n in p.range_windows:
        df = df.withColumns({f"high_{n}": roll(F.max, "price", n), f"low_{n}": roll(F.min, "price", n)})
    price, new = F.col("price"), {}
    for n in p.range_windows:
        high, low = F.col(f"high_{n}"), F.col(f"low_{n}")
        new[f"price_position_{n}"] = ratio(price - low, high - low)
        new[f"dist_from_high_{n}"] = ratio(high - price, price) * 100
        new[f"dist_from_low_{n}"] = ratio(price - low, price) * 100
    return df.withColumns(new)


def add_calendar(df: DataFrame) -> DataFrame:
    """Monday is 0; month end is day 28 or later."""
    t = F.col("timestamp")
    df = df.withColumns({"hour": F.hour(t), "day_of_week": F.weekday(t), "day_of_month": F.dayofmonth(t), "month": F.month(t), "quarter": F.quarter(t)})
    late = F.col("day_of_month") >= 28
    return df.withColumns({
        "is_month_end": flag(late), "is_quarter_end": flag(late & (F.col("month") % 3 == 0)),
        "is_monday": flag(F.col("day_of_week") == 0), "is_friday": flag(F.col("day_of_week") == 4),
    })


def add_z_score(df: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    df = df.withColumns({"deviation": F.col("price") - mean_of_last(df, "price", p.lookback, p), "rolling_std": deviation_of_last(df, "price", p.lookback, p)})
    return df.withColumn("z_score", ratio(F.col("deviation"), F.col("rolling_std")))


def add_signal(df: DataFrame, p: Params = DEFAULTS, cut: str | None = None) -> DataFrame:
    """Mean reversion with a rolling regime filter that looks back only. Needs returns, averages and volatility_20.

    cut: a column that already holds the rolling quantile of volatility_20."""
    df = add_z_score(df, p)
    z, n = F.col("z_score"), p.regime_window
    df = df.withColumns({
        "signal_raw": sign_of(z < -p.entry_z, z > p.entry_z),
        "signal_strength": clip(-z / p.entry_z, -2, 2),
        "_quiet": F.col(cut) if cut else roll(lambda c: F.percentile(c, p.regime_quantile), "volatility_20", n),
    })
    df = df.withColumn("vol_regime_ok", flag(F.col("volatility_20") < F.col("_quiet"))).drop("_quiet")
    fast, slow = (F.col(f"ma_{n}") for n in p.ma_windows[:2])
    df = df.withColumns({"signal": F.col("signal_raw") * F.col("vol_regime_ok"), "ma_cross_signal": sign_of(fast > slow, fast < slow)})
    df = df.withColumn("signal_change", (F.col("signal") - lag("signal")).cast("double"))
    return df.withColumn("entry_signal", (~F.col("signal_change").eqNullSafe(F.lit(0.0))).cast("int"))


def basic_features(df: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """All groups but the signal's."""
    df = add_returns(df)
    for step in (add_moving_averages, add_volatility, add_momentum, add_rsi, add_bands, add_price_position):
        df = step(df, p)
    return add_calendar(df)


def all_features(df: DataFrame, p: Params = DEFAULTS, drop_warm_up: bool = True) -> DataFrame:
    """The 67 feature columns; rows lacking one of them go, whatever other columns hold."""
    before = set(df.columns)
    df = add_signal(basic_features(df, p), p)
    return df.dropna("any", subset=["timestamp", "price", *[c for c in df.columns if c not in before]]) if drop_warm_up else df


def feature_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, mean, std, min, max, null_count) by one wide aggregate and an unpivot."""
    parts = [F.struct(F.lit(c).alias("feature"), F.avg(F.col(c).cast("double")).alias("mean"), F.stddev_samp(F.col(c).cast("double")).alias("std"), F.min(F.col(c).cast("double")).alias("min"), F.max(F.col(c).cast("double")).alias("max"), F.count_if(F.col(c).isNull()).alias("null_count")) for c in columns]
    return df.agg(F.array(*parts).alias("rows")).select(F.inline("rows"))
