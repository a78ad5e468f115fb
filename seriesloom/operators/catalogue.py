"""The ten analytical queries over keyed series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import KEY, change, correlation, day, lag, lead, log_ratio, ratio, roll, rows, series_window, so_far
from ..functions.quantiles import quantiles
from ..params import DEFAULTS, Params


def _bars(df: DataFrame) -> DataFrame:
    known = F.when(F.col("price").isNotNull(), F.struct("timestamp", "seq"))
    return df.where(F.col("timestamp").isNotNull()).groupBy(KEY, day().alias("trade_date")).agg(
        F.min_by("price", known).alias("open"), F.min("price").alias("low"), F.max("price").alias("high"), F.max_by("price", known).alias("close"),
        F.avg("price").alias("avg"), F.stddev_samp("price").alias("volatility"), F.count("price").alias("num_obs"),
    )


def daily_summary(df: DataFrame) -> DataFrame:
    return _bars(df).withColumn("daily_return", ratio(F.col("close") - F.col("open"), F.col("open")) * 100)


def moving_averages(df: DataFrame, windows: tuple[int, ...] = (5, 20, 50)) -> DataFrame:
    df = df.select(KEY, "seq", "timestamp", "price", *[roll(F.avg, "price", n).alias(f"ma_{n}") for n in windows])
    for n in windows:
        d = F.col("price") - F.col(f"ma_{n}")
        df = df.withColumns({f"deviation_from_ma_{n}": d, f"deviation_pct_{n}": ratio(d, F.col(f"ma_{n}")) * 100})
    return df


def returns_volatility(df: DataFrame, windows: tuple[int, ...] = (10, 20, 50), p: Params = DEFAULTS) -> DataFrame:
    df = df.select(KEY, "seq", "timestamp", "price", lag("price").alias("prev_price"))
    df = df.withColumns({"return_pct": ratio(F.col("price") - F.col("prev_price"), F.col("prev_price")) * 100, "log_return": log_ratio(F.col("price"), F.col("prev_price"))})
    df = df.withColumns({f"rolling_vol_{n}": roll(F.stddev_samp, "return_pct", n) for n in windows})
    return df.withColumns({f"rolling_vol_{n}_annual": F.col(f"rolling_vol_{n}") * F.sqrt(F.lit(float(p.annual_factor))) for n in windows})


def extreme_moves(df: DataFrame, percent: float = 1.0, top: int = 20) -> DataFrame:
    """The largest daily moves of all series; equal moves by date and series."""
    out = _bars(df).select(KEY, "trade_date", "open", "close", (ratio(F.col("close") - F.col("open"), F.col("open")) * 100).alias("daily_return_pct"))
    out = out.withColumn("abs_return_pct", F.abs("daily_return_pct")).where(F.col("abs_return_pct") > percent)
    return out.orderBy(F.col("abs_return_pct").desc(), "trade_date", KEY).limit(top)


def signal_performance(df: DataFrame, signal: str = "signal") -> DataFrame:
    """Mean returns after each signal value other than 0; prices ahead come from the whole series. Needs z_score."""
    ahead = {k: ratio(lead("price", k) - F.col("price"), F.col("price")) * 100 for k in (1, 5, 20)}
    df = df.withColumns({f"_r{k}": c for k, c in ahead.items()}).where(F.col(signal) != 0)
    return df.groupBy(KEY, F.col(signal).alias("signal")).agg(F.count(F.lit(1)).alias("signal_count"), *[F.avg(f"_r{k}").alias(f"avg_{k}period_return") for k in (1, 5, 20)], F.avg("z_score").alias("avg_z_score"))


def volatility_regimes(df: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Rows by volatility below the lower, below the upper quantile, or above; UNKNOWN where it is missing."""
    if "returns" not in df.columns:
        df = df.withColumn("returns", change("price"))
    if "volatility_20" not in df.columns:
        df = df.withColumn("volatility_20", roll(F.stddev_samp, "returns", 20))
    low, high = p.regime_cuts
    cuts = quantiles(df, {"_low": ("volatility_20", low), "_high": ("volatility_20", high)}, p)
    v = F.col("volatility_20")
    regime = F.when(v.isNull(), "UNKNOWN").when(v < F.col("_low"), "LOW_VOL").when(v < F.col("_high"), "MEDIUM_VOL").otherwise("HIGH_VOL")
    return df.join(cuts, KEY).groupBy(KEY, regime.alias("vol_regime")).agg(
        F.count("price").alias("observation_count"), F.avg("price").alias("avg_price"), F.stddev_samp("price").alias("price_std"), F.avg("returns").alias("avg_return"), F.stddev_samp("returns").alias("return_std"))


def time_patterns(df: DataFrame) -> DataFrame:
    if "returns" not in df.columns:
        df = df.withColumn("returns", change("price"))
    t = F.col("timestamp")
    return df.where(t.isNotNull()).groupBy(KEY, F.weekday(t).alias("day_of_week"), F.date_format(t, "EEEE").alias("day_name")).agg(
        F.count("returns").alias("observation_count"), F.avg("returns").alias("avg_return"), F.stddev_samp("returns").alias("return_volatility"), F.min("price").alias("min_price"), F.max("price").alias("max_price"))


def drawdown_analysis(df: DataFrame, percent: float = -0.5, top: int = 20) -> DataFrame:
    df = df.select(KEY, "seq", "timestamp", "price", F.max("price").over(so_far()).alias("running_max"))
    df = df.withColumn("drawdown", F.col("price") - F.col("running_max")).withColumn("drawdown_pct", ratio(F.col("drawdown"), F.col("running_max")) * 100)
    return df.where(F.col("drawdown_pct") < percent).orderBy(F.col("drawdown_pct").asc_nulls_last(), "timestamp", "seq", KEY).limit(top)


def mean_reversion_speed(df: DataFrame, reverted: float = 0.5, p: Params = DEFAULTS, unreverted: bool = False) -> DataFrame:
    """Rows from an extreme z-score to the first that is near zero, within the horizon; a window, not a self-join.

    Events without one are left out, or shown with a missing figure if asked for.
    """
    df = df.withColumn("_rn", F.row_number().over(series_window()))
    hit = F.min(F.when(F.abs("z_score") < reverted, F.col("_rn"))).over(rows(1, p.horizon))
    df = df.withColumn("reversion_days", hit - F.col("_rn")).where(F.abs("z_score") > p.entry_z)
    out = df.select(KEY, F.col("timestamp").alias("extreme_time"), "reversion_days")
    return out if unreverted else out.where(F.col("reversion_days").isNotNull())


def forward_returns(df: DataFrame) -> DataFrame:
    """return_1_ahead, and return_5_ahead: the sum of the next five returns, missing for the first four rows too."""
    five = F.when((F.count("returns").over(rows(1, 5)) == 5) & (F.row_number().over(series_window()) >= 5), F.sum("returns").over(rows(1, 5)))
    return df.withColumns({"return_1_ahead": lead("returns"), "return_5_ahead": five})


def feature_correlations(df: DataFrame, features: tuple[str, ...] = ("rsi", "z_score", "momentum_5", "volatility_20")) -> DataFrame:
    """(series_key, feature, correlation_1period, correlation_5period), by one aggregate."""
    df = forward_returns(df if "returns" in df.columns else df.withColumn("returns", change("price")))
    parts = [F.struct(F.lit(f).alias("feature"), *[correlation(f, f"return_{k}_ahead").alias(f"correlation_{k}period") for k in (1, 5)]) for f in features if f in df.columns]
    return df.groupBy(KEY).agg(F.array(*parts).alias("rows")).select(KEY, F.inline("rows"))


def run_all(df: DataFrame, p: Params = DEFAULTS) -> dict[str, DataFrame]:
    """All queries over a featured frame, lazily."""
    return {
        "daily_summary": daily_summary(df), "moving_averages": moving_averages(df), "returns_volatility": returns_volatility(df), "extreme_moves": extreme_moves(df),
        "signal_performance": signal_performance(df), "volatility_regimes": volatility_regimes(df, p), "time_patterns": time_patterns(df),
        "drawdown_analysis": drawdown_analysis(df), "mean_reversion_speed": mean_reversion_speed(df, p=p), "feature_correlations": feature_correlations(df),
    }
