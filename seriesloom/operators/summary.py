"""Descriptions of whole frames and the figures of the final report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import KEY, ratio, so_far
from ..functions.quantiles import quantiles_by_ranges
from ..params import DEFAULTS, Params


def describe(df: DataFrame, columns: list[str], p: Params = DEFAULTS) -> DataFrame:
    """(series_key, column, count, mean, std, min, p25, p50, p75, max) with exact quartiles, by one aggregate or, for long
    series, by ranges of values."""
    if p.long_series:
        return _described_by_ranges(df, columns)

    def one(c: str):
        x = F.col(c).cast("double")
        q = F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
        figures = (F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"))
        return F.struct(F.lit(c).alias("column"), *figures, *[F.get(q, F.lit(k)).alias(n) for k, n in enumerate(("p25", "p50", "p75"))], F.max(x).alias("max"))

    return df.groupBy(KEY).agg(F.array(*[one(c) for c in columns]).alias("rows")).select(KEY, F.inline("rows"))


def _described_by_ranges(df: DataFrame, columns: list[str]) -> DataFrame:
    shares = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
    cuts = quantiles_by_ranges(df, {f"{n}_{k}": (c, q) for k, c in enumerate(columns) for n, q in shares.items()})
    x = [F.col(c).cast("double") for c in columns]
    sums = df.groupBy(KEY).agg(*[f.alias(f"{n}_{k}") for k, c in enumerate(x) for n, f in (("count", F.count(c)), ("mean", F.avg(c)), ("std", F.stddev_samp(c)), ("min", F.min(c)), ("max", F.max(c)))])
    names = ["count", "mean", "std", "min", *shares, "max"]
    rows = [F.struct(F.lit(c).alias("column"), *[F.col(f"{n}_{k}").alias(n) for n in names]) for k, c in enumerate(columns)]
    return sums.join(cuts, KEY).select(KEY, F.inline(F.array(*rows)))


def key_figures(df: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Figures of a featured series: rows, dates, price range, returns, deepest price drawdown, shares of signals."""
    df = df.withColumn("_top", F.max("price").over(so_far()))
    r, n = F.col("returns"), F.count(F.lit(1))
    shares = [ratio(F.count_if(F.col("signal") == v) * 100.0, n).alias(f"{k}_pct") for k, v in (("long", 1), ("short", -1), ("neutral", 0))]
    return df.groupBy(KEY).agg(
        n.alias("final_rows"), F.min("timestamp").alias("first_time"), F.max("timestamp").alias("last_time"), F.min("price").alias("min_price"), F.max("price").alias("max_price"),
        (F.avg(r) * 100).alias("avg_return_pct"), (F.stddev_samp(r) * 100).alias("return_volatility_pct"), (ratio(F.avg(r), F.stddev_samp(r)) * F.sqrt(F.lit(float(p.annual_factor)))).alias("sharpe_ratio"),
        (F.min(ratio(F.col("price"), F.col("_top")) - 1) * 100).alias("max_drawdown_pct"), *shares,
    )


def feature_groups(columns: list[str]) -> dict[str, int]:
    """Numbers of features by parts of their names."""
    parts = {"moving averages": ("ma_",), "volatility": ("volatility",), "momentum": ("momentum",), "technical": ("rsi", "bb_")}
    return {k: sum(any(p in c for p in v) for c in columns) for k, v in parts.items()}


def final_report(figures: DataFrame, anomalies: DataFrame, cleaning: DataFrame, columns: list[str], source: str) -> str:
    """Text: a few rows for each series, read one series at a time."""
    found = anomalies.where(F.col("check").isin("duplicates", "price_outliers", "price_spikes") & (F.col("metric") == "count"))
    totals = found.groupBy(KEY).agg(F.sum(F.col("value").cast("bigint")).alias("total_anomalies"))
    rows = figures.join(totals, KEY, "left").join(cleaning.select(KEY, "original_rows", "retention_pct"), KEY, "left").orderBy(KEY)
    lines = ["FINAL REPORT", f"Input: {source}", f"Features: {len(columns)}", *[f"  {k}: {v}" for k, v in feature_groups(columns).items()]]
    for row in rows.toLocalIterator():
        lines += ["", str(row[KEY]), *[f"  {k}: {v:.4f}" if isinstance(v, float) else f"  {k}: {v}" for k, v in row.asDict().items() if k != KEY]]
    return "\n".join(lines)
