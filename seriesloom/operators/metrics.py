"""Risk, return and trade metrics of a returns column, one row for each series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import KEY, compounded, lag, lead, ratio, roll, rows, sample_kurtosis, sample_skew, series_window, so_far
from ..functions.quantiles import quantiles
from ..params import DEFAULTS, Params


def _or_zero(condition, value):
    return F.when(condition, value).otherwise(0.0)


def return_metrics(df: DataFrame, returns: str = "returns", p: Params = DEFAULTS) -> DataFrame:
    """The growth is missing where the last return is, as in a cumulative product's last row."""
    r = F.col(returns)
    df = df.withColumn("_cum", compounded(returns))
    out = df.groupBy(KEY).agg(F.max_by(F.struct("_cum"), F.struct("timestamp", "seq")).getField("_cum").alias("growth"), F.count(F.lit(1)).alias("n"), F.avg(r).alias("m"), F.percentile(r, F.lit(0.5)).alias("med"))
    years = F.col("n") / p.annual_factor
    return out.select(
        KEY, ((F.col("growth") - 1) * 100).alias("total_return_pct"), ((F.pow(F.col("growth"), 1 / years) - 1) * 100).alias("cagr_pct"),
        (F.col("m") * 100).alias("avg_return_pct"), (F.col("m") * 100 * p.annual_factor).alias("avg_return_annual_pct"), (F.col("med") * 100).alias("median_return_pct"),
    )


def risk_metrics(df: DataFrame, returns: str = "returns", p: Params = DEFAULTS) -> DataFrame:
    r = F.col(returns)
    cut = quantiles(df, {"_cut": (returns, 0.05)}, p)
    down = F.when(r < 0, r)
    out = df.join(cut, KEY).groupBy(KEY).agg(
        F.avg(r).alias("m"), F.stddev_samp(r).alias("s"), F.stddev_samp(down).alias("d"), sample_skew(r).alias("skewness"), sample_kurtosis(r).alias("kurtosis"),
        (F.max("_cut") * 100).alias("var_95_pct"), (F.avg(F.when(r <= F.col("_cut"), r)) * 100).alias("cvar_95_pct"),
    )
    root = F.sqrt(F.lit(float(p.annual_factor)))
    return out.select(
        KEY, F.col("s").alias("volatility"), (F.col("s") * root * 100).alias("volatility_annual_pct"), _or_zero(F.col("s") > 0, ratio(F.col("m"), F.col("s")) * root).alias("sharpe_ratio"),
        _or_zero(F.col("d") > 0, ratio(F.col("m"), F.col("d")) * root).alias("sortino_ratio"), "skewness", "kurtosis", "var_95_pct", "cvar_95_pct",
    )


def with_drawdown(df: DataFrame, returns: str = "returns") -> DataFrame:
    df = df.withColumn("cum_returns", compounded(returns))
    df = df.withColumn("running_max", F.max("cum_returns").over(so_far()))
    return df.withColumn("drawdown", ratio(F.col("cum_returns") - F.col("running_max"), F.col("running_max")))


def drawdown_metrics(df: DataFrame, returns: str = "returns", p: Params = DEFAULTS) -> DataFrame:
    """Deepest drawdown and its first row, mean length of drawdowns, rows to recover or, if it did not, rows left."""
    df = with_drawdown(df, returns).withColumn("_rn", F.row_number().over(series_window()))
    df = df.withColumn("_under", F.coalesce(F.col("drawdown") < 0, F.lit(False)))
    # the mean length of runs is rows by runs, and a run is known by its first row
    df = df.withColumn("_enters", F.col("_under") & ~F.coalesce(lag("_under"), F.lit(False)))
    order = F.when(F.col("drawdown").isNotNull(), F.struct("drawdown", "_rn"))
    worst = df.groupBy(KEY).agg(
        F.min("drawdown").alias("_dd"), F.min_by("timestamp", order).alias("max_drawdown_date"), F.min_by("_rn", order).alias("_worst"), F.max("_rn").alias("_n"),
        F.max_by(F.struct("cum_returns"), F.struct("timestamp", "seq")).getField("cum_returns").alias("_growth"), ratio(F.count_if("_under"), F.count_if("_enters")).alias("avg_drawdown_duration"),
    )
    back = df.join(worst.select(KEY, "_worst"), KEY).where((F.col("_rn") >= F.col("_worst")) & (F.col("drawdown") >= 0)).groupBy(KEY).agg(F.min("_rn").alias("_back"))
    out = worst.join(back, KEY, "left")
    cagr = (F.pow(F.col("_growth"), p.annual_factor / F.col("_n")) - 1) * 100
    return out.select(
        KEY, (F.col("_dd") * 100).alias("max_drawdown_pct"), "max_drawdown_date", F.when(F.col("_dd") != 0, cagr / F.abs(F.col("_dd") * 100)).otherwise(0.0).alias("calmar_ratio"),
        F.coalesce("avg_drawdown_duration", F.lit(0.0)).alias("avg_drawdown_duration"), F.coalesce(F.col("_back") - F.col("_worst"), F.col("_n") - F.col("_worst") + 1).alias("max_recovery_time"),
    )


def trade_metrics(log: DataFrame) -> DataFrame:
    """A trade of no gain is neither won nor lost, and counts in losing streaks."""
    df = log.select(KEY, F.col("entry_time").alias("timestamp"), F.lit(0).alias("seq"), "pnl", "duration_hours", F.coalesce(F.col("pnl") > 0, F.lit(False)).alias("win"))
    df = df.withColumn("_run", F.sum(F.when(F.col("win") != F.coalesce(lag("win"), ~F.col("win")), 1).otherwise(0)).over(so_far()))
    runs = df.groupBy(KEY, "_run").agg(F.first("win").alias("win"), F.count(F.lit(1)).alias("len")).groupBy(KEY).agg(
        F.coalesce(F.max(F.when(F.col("win"), F.col("len"))), F.lit(0)).alias("max_win_streak"), F.coalesce(F.max(F.when(~F.col("win"), F.col("len"))), F.lit(0)).alias("max_loss_streak"))
    pnl = F.col("pnl")
    won, lost = F.when(pnl > 0, pnl), F.when(pnl < 0, pnl)
    out = df.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("total_trades"), F.count(won).alias("winning_trades"), F.count(lost).alias("losing_trades"),
        ratio(F.count(won) * 100.0, F.count(F.lit(1))).alias("win_rate_pct"), F.coalesce(F.avg(won), F.lit(0.0)).alias("avg_win_pct"), F.coalesce(F.avg(lost), F.lit(0.0)).alias("avg_loss_pct"),
        F.coalesce(ratio(F.coalesce(F.sum(won), F.lit(0.0)), F.abs(F.sum(lost))), F.lit(0.0)).alias("profit_factor"), F.avg("duration_hours").alias("avg_trade_duration_hours"),
        F.max(pnl).alias("best_trade_pct"), F.min(pnl).alias("worst_trade_pct"),
    )
    return out.join(runs, KEY)


def benchmark_metrics(df: DataFrame, benchmark: DataFrame, returns: str = "returns", p: Params = DEFAULTS) -> DataFrame:
    """Against a benchmark (timestamp, benchmark_return [, series_key]); pairs with a missing side are skipped.

    mean_excess_annual_pct is the mean excess return, not Jensen's alpha.
    """
    on = [c for c in (KEY, "timestamp") if c in benchmark.columns]
    both = df.select(KEY, "timestamp", F.col(returns).alias("r")).join(benchmark.select(*on, F.col("benchmark_return").alias("b")), on)
    x = F.col("r") - F.col("b")
    out = both.groupBy(KEY).agg(F.avg(x).alias("m"), F.stddev_samp(x).alias("s"), F.covar_samp("r", "b").alias("cov"), F.var_samp(F.when(F.col("r").isNotNull(), F.col("b"))).alias("var"))
    root = F.sqrt(F.lit(float(p.annual_factor)))
    return out.select(KEY, _or_zero(F.col("s") > 0, ratio(F.col("m"), F.col("s")) * root).alias("information_ratio"), (F.col("s") * root * 100).alias("tracking_error_pct"), _or_zero(F.col("var") > 0, ratio(F.col("cov"), F.col("var"))).alias("beta"), (F.col("m") * p.annual_factor * 100).alias("mean_excess_annual_pct"))


def rolling_metrics(df: DataFrame, returns: str = "returns", p: Params = DEFAULTS, window: int | None = None) -> DataFrame:
    n, root = window or p.metric_window, F.sqrt(F.lit(252.0))
    df = df.withColumns({"_m": roll(F.avg, returns, n), "_s": roll(F.stddev_samp, returns, n), "_cum": compounded(returns)})
    df = df.withColumn("_top", F.max("_cum").over(rows(1 - n)))
    return df.select(KEY, "seq", "timestamp", (ratio(F.col("_m"), F.col("_s")) * root).alias("rolling_sharpe"), (F.col("_s") * root).alias("rolling_volatility"), ratio(F.col("_cum") - F.col("_top"), F.col("_top")).alias("rolling_drawdown"))


def all_metrics(df: DataFrame, returns: str = "returns", log: DataFrame | None = None, benchmark: DataFrame | None = None, p: Params = DEFAULTS) -> DataFrame:
    out = return_metrics(df, returns, p).join(risk_metrics(df, returns, p), KEY).join(drawdown_metrics(df, returns, p), KEY)
    if log is not None:
        out = out.join(trade_metrics(log), KEY, "left")
    return out if benchmark is None else out.join(benchmark_metrics(df, benchmark, returns, p), KEY, "left")


def report(metrics: DataFrame) -> str:
    """Text of one row of metrics for each series."""
    lines = ["PERFORMANCE REPORT"]
    for row in metrics.orderBy(KEY).toLocalIterator():
        lines += ["", str(row[KEY])]
        lines += [f"  {k}: {v:.4f}" if isinstance(v, float) else f"  {k}: {v}" for k, v in row.asDict().items() if k != KEY]
    return "\n".join(lines)
