"""Data of charts; drawing is left to the caller."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import KEY, change, correlation, roll
from .metrics import with_drawdown


def price_and_signals(df: DataFrame, signal: str) -> DataFrame:
    marker = F.when(F.col(signal) == 1, "LONG").when(F.col(signal) == -1, "SHORT")
    return df.select(KEY, "timestamp", "price", roll(F.avg, "price", 20).alias("ma_20"), marker.alias("marker"))


def equity_curve(equity: DataFrame) -> DataFrame:
    return equity.select(KEY, "timestamp", F.col("cum_strategy_returns").alias("strategy"), F.col("cum_buy_hold").alias("buy_hold"))


def drawdown_curve(df: DataFrame, returns: str = "returns") -> DataFrame:
    return with_drawdown(df, returns).select(KEY, "timestamp", (F.col("drawdown") * 100).alias("drawdown_pct"))


def correlation_matrix(df: DataFrame, features: list[str]) -> DataFrame:
    """(series_key, x, y, correlation) of the lower triangle, pairwise complete, by one aggregate."""
    parts = [F.struct(F.lit(b).alias("x"), F.lit(a).alias("y"), correlation(a, b).alias("correlation")) for a, b in combinations(features, 2)]
    return df.groupBy(KEY).agg(F.array(*parts).alias("rows")).select(KEY, F.inline("rows"))


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """(series_key, bin from 0, low, high, n) of equal bins from the minimum to the maximum, which the last bin holds."""
    edges = df.groupBy(KEY).agg(F.min(column).alias("_a"), F.max(column).alias("_b"))
    width = (F.col("_b") - F.col("_a")) / bins
    at = F.when(width > 0, F.least(F.floor(F.try_divide(F.col(column) - F.col("_a"), width)), F.lit(bins - 1))).otherwise(0)
    out = df.where(F.col(column).isNotNull()).join(edges, KEY).groupBy(KEY, "_a", "_b", at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(KEY, "bin", (F.col("_a") + F.col("bin") * width).alias("low"), (F.col("_a") + (F.col("bin") + 1) * width).alias("high"), "n")


def monthly_returns(df: DataFrame, returns: str = "returns") -> DataFrame:
    """Compounded returns in percent, a row for each year and columns m1 to m12."""
    m = df.where(F.col(returns).isNotNull()).groupBy(KEY, F.year("timestamp").alias("year"), F.month("timestamp").alias("month")).agg(((F.product(1 + F.col(returns)) - 1) * 100).alias("r"))
    out = m.groupBy(KEY, "year").pivot("month", list(range(1, 13))).agg(F.first("r"))
    return out.select(KEY, "year", *[F.col(str(k)).alias(f"m{k}") for k in range(1, 13)])


def residuals(predictions: DataFrame) -> DataFrame:
    return predictions.withColumn("residual", F.col("actual") - F.col("prediction"))


def quantile_points(df: DataFrame, column: str, points: int = 99) -> DataFrame:
    """(series_key, theoretical, sample): exact quantiles against those of a normal curve, as many as asked for."""
    from statistics import NormalDist

    at = [(k + 1) / (points + 1) for k in range(points)]
    theory = F.array(*[F.lit(NormalDist().inv_cdf(x)) for x in at])
    out = df.groupBy(KEY).agg(F.percentile(column, F.array(*map(F.lit, at))).alias("q"))
    return out.select(KEY, F.inline(F.zip_with(theory, "q", lambda t, q: F.struct(t.alias("theoretical"), q.alias("sample")))))


def top_features(weights: DataFrame, n: int = 15) -> DataFrame:
    return weights.withColumn("abs_weight", F.abs("weight")).orderBy(F.col("abs_weight").desc_nulls_last(), "feature").limit(n)
