"""Signals: mean reversion, momentum and their weighted sum."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.blocks import mean_of_last
from ..functions.expr import KEY, change, clip, flag, ratio, sign_of
from ..functions.quantiles import quantiles
from ..params import DEFAULTS, Params
from .features import add_z_score


def mean_reversion(df: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """signal_mean_reversion and its strength; where volatility_20 is present, quiet rows by the series' overall
    quantile only, which looks ahead by design (``vol_regime_ok_global``)."""
    if "z_score" not in df.columns:
        df = add_z_score(df, p)
    z = F.col("z_score")
    signal = sign_of(z < -p.entry_z, z > p.entry_z)
    df = df.withColumn("mean_reversion_strength", clip(-z / p.entry_z, -2, 2))
    if "volatility_20" in df.columns:
        cut = quantiles(df, {"_cut": ("volatility_20", p.regime_quantile)}, p)
        df = df.join(cut, KEY).withColumn("vol_regime_ok_global", flag(F.col("volatility_20") < F.col("_cut"))).drop("_cut")
        signal = signal * F.col("vol_regime_ok_global")
    return df.withColumn("signal_mean_reversion", signal)


def momentum(df: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """signal_momentum from two averages; a rate of change of the other sign sets it to 0, a missing one leaves it."""
    for n in (5, 20):
        if f"ma_{n}" not in df.columns:
            df = df.withColumn(f"ma_{n}", mean_of_last(df, "price", n, p))
    fast, slow = F.col("ma_5"), F.col("ma_20")
    roc = F.col("roc_20") if "roc_20" in df.columns else change("price", 20) * 100
    df = df.withColumns({"_s": sign_of(fast > slow, fast < slow), "_roc": roc, "momentum_strength": clip(ratio(fast - slow, slow) * 100, -2, 2)})
    s = F.col("_s")
    signal = F.when((s == 1) & (F.col("_roc") < 0), 0).when((s == -1) & (F.col("_roc") > 0), 0).otherwise(s)
    return df.withColumn("signal_momentum", signal).drop("_s", "_roc")


def combined(df: DataFrame, weights: dict[str, float] | None = None, p: Params = DEFAULTS) -> DataFrame:
    """combined_strength and signal_combined; weights by name, others are refused."""
    weights = dict(weights or p.ensemble_weights)
    if unknown := sorted(weights.keys() - p.ensemble_weights.keys()):
        raise ValueError(f"no such signals: {', '.join(unknown)}")
    both = {"mean_reversion_strength", "momentum_strength"} <= set(df.columns)
    names = ("mean_reversion_strength", "momentum_strength") if both else ("signal_mean_reversion", "signal_momentum")
    total = sum((F.col(n) * weights.get(k, 0.0) for n, k in zip(names, ("mean_reversion", "momentum"), strict=True)), F.lit(0.0))
    df = df.withColumn("combined_strength", total)
    return df.withColumn("signal_combined", sign_of(total > p.ensemble_threshold, total < -p.ensemble_threshold))


def all_signals(df: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    return combined(momentum(mean_reversion(df, p), p), None, p)


def signal_summary(df: DataFrame, columns: tuple[str, ...] = ("signal_mean_reversion", "signal_momentum", "signal_combined")) -> DataFrame:
    """(series_key, signal_name, long_count, short_count, neutral_count, and their shares of all rows in percent)."""
    parts = [F.struct(F.lit(c).alias("signal_name"), F.count_if(F.col(c) == 1).alias("long_count"), F.count_if(F.col(c) == -1).alias("short_count"), F.count_if(F.col(c) == 0).alias("neutral_count"), F.count(F.lit(1)).alias("n")) for c in columns]
    out = df.groupBy(KEY).agg(F.array(*parts).alias("rows")).select(KEY, F.inline("rows"))
    return out.select(KEY, "signal_name", "long_count", "short_count", "neutral_count", *[ratio(F.col(f"{k}_count") * 100.0, F.col("n")).alias(f"{k}_pct") for k in ("long", "short", "neutral")])


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(KEY, column).agg(F.count(F.lit(1)).alias("n"))
