"""The operators of one series that no task could hold: the same values, chunk by chunk.

What looks back a bounded number of rows runs unchanged on chunks with the rows
around them; what runs from the start of a series is carried over from chunk to
chunk by summaries; exact quantiles go by ranges of values. The names of columns
are those of the operators for many series.
"""

from __future__ import annotations

from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.blocks import compounded_in_blocks
from ..functions.chunks import CHUNK, PLACE, chunks_before, compounded_in_chunks, dropped, in_chunks, inside, last_known, last_row, placed, rows_of_chunk, run_numbers, running_max_in_chunks, with_carry
from ..functions.expr import KEY, lag, ratio, roll, rows, sign_of
from ..functions.quantiles import quantiles
from ..params import DEFAULTS, Params
from ..sources.scratch import settled
from . import backtest, clean, signals
from .features import add_returns, add_signal, add_volatility, all_features, basic_features


#: Growth of blocks is multiplied in another order than growth of rows: drawdowns that differ by less are the same.
SAME = 1e-11


def _long(p: Params) -> Params:
    return replace(p, long_series=True)


def reach(p: Params = DEFAULTS) -> int:
    """Rows that a feature looks back at most: the regime's quantile of a volatility of returns, and the change of its signal."""
    averages = max(*p.ma_windows, *p.range_windows, *p.momentum_periods, p.band_window, p.rsi_period, p.lookback)
    return max(averages, 20 + max(*p.vol_windows, 20), p.regime_window + max(p.vol_windows)) + 2


def features(df: DataFrame, p: Params = DEFAULTS, sliding: bool = True) -> DataFrame:
    """All feature columns of features.all_features, the warm-up included. sliding: the regime's quantile comes from
    rolling_quantile, between the features that it needs and those that need it; else from a window that sorts each frame."""
    if not sliding:
        return dropped(in_chunks(df, lambda d: all_features(d, p, drop_warm_up=False), reach(p), p=p))
    at = in_chunks(df, lambda d: basic_features(d, p), reach(p), p=p)
    at = rolling_quantile(at, "volatility_20", p.regime_quantile, p.regime_window, "_cut", p)
    return dropped(in_chunks(at, lambda d: add_signal(d, p, "_cut"), p.lookback + 1, p=p)).drop("_cut")


def rolling_quantile(df: DataFrame, column: str, q: float, n: int, name: str, p: Params = DEFAULTS) -> DataFrame:
    """Quantile of the last n rows, missing unless all have a value; keeps the places of rows.

    A chunk's rows go once through an ordered multiset that slides, so a row costs log n and not a sort of n values.
    """
    at = df if PLACE in df.columns else placed(df, p)
    place = F.col(PLACE)
    copies = at.select(KEY, PLACE, CHUNK, F.col(column).cast("double").alias(column), F.explode(F.sequence(F.col(CHUNK), F.floor((place + n - 1) / p.chunk_rows))).alias("_for"))

    def slide(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(PLACE)
        g[name] = g[column].rolling(n, min_periods=n).quantile(q, interpolation="linear")
        return g.loc[g["_for"] == g[CHUNK], [KEY, PLACE, name]]

    kinds = f"{KEY} {df.schema[KEY].dataType.simpleString()}, {PLACE} bigint, {name} double"
    return at.join(copies.groupBy(KEY, "_for").applyInPandas(slide, kinds), [KEY, PLACE])


def with_drawdown(df: DataFrame, returns: str = "returns", p: Params = DEFAULTS, same: float = SAME) -> DataFrame:
    """cum_returns, running_max and drawdown from the start of the series; keeps the places of rows.

    Growth is multiplied in the order of a tree of blocks, whatever the chunks. That is not the order of rows, so a drawdown
    of less than ``same`` is taken for none; 0 takes it as it comes out, as SQL does.
    """
    at = compounded_in_blocks(df if PLACE in df.columns else placed(df, p), "cum_returns", returns)
    at = running_max_in_chunks(at, "running_max", "cum_returns")
    down = ratio(F.col("cum_returns") - F.col("running_max"), F.col("running_max"))
    return at.withColumn("drawdown", F.when(F.abs(down) < same, 0.0).otherwise(down))


def drawdown_metrics(df: DataFrame, returns: str = "returns", p: Params = DEFAULTS, same: float = SAME) -> DataFrame:
    """As metrics.drawdown_metrics. Lengths of drawdowns need no runs: their mean is rows under water by entries into it. Of
    drawdowns that differ by ``same`` or less the first is the deepest, whatever the chunks."""
    # Written once: six reads follow, each of which would multiply the growth anew.
    at = settled(with_drawdown(df, returns, p, same).select(KEY, PLACE, CHUNK, "timestamp", "cum_returns", "drawdown"))
    at = at.withColumn("_under", F.coalesce(F.col("drawdown") < 0, F.lit(False)))
    at = with_carry(at, {"_b": last_row("_under")})
    was = F.coalesce(F.lag("_under").over(rows_of_chunk()), F.col("_b.v"), F.lit(False))
    worst = at.withColumn("_enters", F.col("_under") & ~was).groupBy(KEY).agg(
        F.min("drawdown").alias("_dd"), F.max(PLACE).alias("_last"),
        F.max_by(F.struct("cum_returns"), PLACE).getField("cum_returns").alias("_growth"), F.count_if("_under").alias("_rows"), F.count_if("_enters").alias("_times"),
    )
    deepest = at.select(KEY, PLACE, "timestamp", "drawdown").join(worst.select(KEY, "_dd"), KEY).where(F.col("drawdown") <= F.col("_dd") + same)
    deepest = deepest.groupBy(KEY).agg(F.min_by("timestamp", PLACE).alias("max_drawdown_date"), F.min(PLACE).alias("_worst"))
    worst = worst.join(deepest, KEY, "left")
    back = at.select(KEY, PLACE, "drawdown").join(worst.select(KEY, "_worst"), KEY).where((F.col(PLACE) >= F.col("_worst")) & (F.col("drawdown") >= 0)).groupBy(KEY).agg(F.min(PLACE).alias("_back"))
    out = worst.join(back, KEY, "left")
    cagr = (F.pow(F.col("_growth"), p.annual_factor / (F.col("_last") + 1)) - 1) * 100
    return out.select(
        KEY, (F.col("_dd") * 100).alias("max_drawdown_pct"), "max_drawdown_date", F.when(F.col("_dd") != 0, cagr / F.abs(F.col("_dd") * 100)).otherwise(0.0).alias("calmar_ratio"),
        F.coalesce(ratio(F.col("_rows"), F.col("_times")), F.lit(0.0)).alias("avg_drawdown_duration"), F.coalesce(F.col("_back") - F.col("_worst"), F.col("_last") - F.col("_worst") + 1).alias("max_recovery_time"),
    )


def price_drawdown(df: DataFrame, percent: float = -0.5, top: int = 20, p: Params = DEFAULTS) -> DataFrame:
    """As catalogue.drawdown_analysis."""
    at = running_max_in_chunks(placed(df.select(KEY, "seq", "timestamp", "price"), p), "running_max", "price")
    at = dropped(at).withColumn("drawdown", F.col("price") - F.col("running_max")).withColumn("drawdown_pct", ratio(F.col("drawdown"), F.col("running_max")) * 100)
    return at.where(F.col("drawdown_pct") < percent).orderBy(F.col("drawdown_pct").asc_nulls_last(), "timestamp", "seq", KEY).limit(top)


def all_signals(df: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """As signals.all_signals of a frame with returns and volatility_20, which are added; the regime's cut of a whole series
    is a quantile by ranges."""
    def step(d: DataFrame) -> DataFrame:
        d = add_volatility(add_returns(d), p)
        return signals.combined(signals.momentum(signals.mean_reversion(d.withColumnRenamed("volatility_20", "_v"), p), p), None, p)

    at = in_chunks(df, step, reach(p), p=p).withColumnRenamed("_v", "volatility_20")
    cut = quantiles(at, {"_cut": ("volatility_20", p.regime_quantile)}, _long(p))
    ok = F.coalesce(F.col("volatility_20") < F.col("_cut"), F.lit(False)).cast("int")
    at = at.join(cut, KEY).withColumn("vol_regime_ok_global", ok).drop("_cut")
    return at.withColumn("signal_mean_reversion", F.col("signal_mean_reversion") * F.col("vol_regime_ok_global"))


def with_equity(df: DataFrame, signal: str, p: Params = DEFAULTS) -> DataFrame:
    """As backtest.with_equity; keeps the places of rows."""
    at = in_chunks(df, lambda d: backtest.with_positions(d, signal, p), 2, p=p)
    return compounded_in_chunks(at, {"cum_strategy_returns": "strategy_returns_net", "cum_buy_hold": "returns"})


def trades(equity: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """As backtest.trades: the starts of positions are a series of their own, and each ends where the next one begins."""
    at = equity.select(KEY, "seq", "timestamp", "price", F.coalesce("position", F.lit(0.0)).alias("position"))
    starts = dropped(in_chunks(at, backtest.position_starts, 1, p=p))
    return backtest._logged(dropped(in_chunks(starts, backtest.with_exits, 0, 1, p)), p)


def flat_periods(df: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """As quality.flat_periods; only rows that repeat a price are grouped by run, and counted in each task first."""
    at = in_chunks(df.select(KEY, "seq", "timestamp", "price"), lambda d: d.withColumn("_same", F.coalesce(F.col("price") == lag("price"), F.lit(False))), 1, p=p)
    at = run_numbers(at, "_run", ~F.col("_same"))
    runs = at.where("_same").groupBy(KEY, "_run").agg(F.count(F.lit(1)).alias("n"))
    none = at.groupBy(KEY).agg(F.lit(None).cast("bigint").alias("_run"), F.lit(0).cast("bigint").alias("n"))
    out = runs.unionByName(none).groupBy(KEY).agg(F.count_if(F.col("n") > p.flat_run).alias("num_long_flat_periods"), F.max("n").alias("max_consecutive_unchanged"))
    return out.withColumn("severity", F.when(F.col("num_long_flat_periods") > 5, "MEDIUM").otherwise("LOW"))


def with_last_price(df: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """last_price: the last known price up to a row, price_before: up to the row before; keeps the places of rows."""
    at = with_carry(df if PLACE in df.columns else placed(df, p), {"_b": last_known("price")})
    upto = lambda last: F.coalesce(F.last("price", ignorenulls=True).over(inside(last=last)), F.col("_b"))
    return at.withColumns({"last_price": upto(0), "price_before": upto(-1)}).drop("_b")


def spikes(df: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """As quality.spikes."""
    at = with_last_price(df, p)
    at = at.withColumn("_c", F.abs(ratio(F.col("last_price") - F.col("price_before"), F.col("price_before")) * 100))
    out = at.groupBy(KEY).agg(F.count_if(F.col("_c") > p.spike_pct).alias("count"), F.count(F.lit(1)).alias("_n"), F.coalesce(F.max("_c"), F.lit(0.0)).alias("max_move"))
    severity = F.when(F.col("count") > 50, "HIGH").when(F.col("count") > 10, "MEDIUM").otherwise("LOW")
    return out.select(KEY, "count", ratio(F.col("count") * 100.0, F.col("_n")).alias("percentage"), "max_move", severity.alias("severity"))


def fill_missing(df: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """As clean.fill_missing."""
    return dropped(in_chunks(df.where(F.col("timestamp").isNotNull()), lambda d: clean.fill_missing(d, p), p.fill_limit, p=p))


def rolling_metrics(df: DataFrame, returns: str = "returns", p: Params = DEFAULTS, window: int | None = None) -> DataFrame:
    """As metrics.rolling_metrics: growth is carried over, the rest looks back by the window."""
    n, root = window or p.metric_window, F.sqrt(F.lit(252.0))
    at = compounded_in_chunks(df if PLACE in df.columns else placed(df, p), {"_cum": returns})

    def step(d: DataFrame) -> DataFrame:
        return d.withColumns({"_m": roll(F.avg, returns, n), "_s": roll(F.stddev_samp, returns, n), "_top": F.max("_cum").over(rows(1 - n))})

    at = in_chunks(at, step, n - 1, p=p)
    return at.select(KEY, "seq", "timestamp", (ratio(F.col("_m"), F.col("_s")) * root).alias("rolling_sharpe"), (F.col("_s") * root).alias("rolling_volatility"), ratio(F.col("_cum") - F.col("_top"), F.col("_top")).alias("rolling_drawdown"))


def trade_streaks(log: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """(series_key, max_win_streak, max_loss_streak) of a trade log, as in metrics.trade_metrics."""
    at = placed(log.select(KEY, F.col("entry_time").alias("timestamp"), F.lit(0).alias("seq"), F.coalesce(F.col("pnl") > 0, F.lit(False)).alias("win")), p)
    at = with_carry(at, {"_b": last_row("win")})
    was = F.coalesce(F.lag("win").over(rows_of_chunk()), F.col("_b.v"))
    at = run_numbers(at.withColumn("_was", was).drop("_b"), "_run", F.col("_was").isNull() | (F.col("_was") != F.col("win")))
    runs = at.groupBy(KEY, "_run", "win").agg(F.count(F.lit(1)).alias("n"))
    longest = lambda won: F.coalesce(F.max(F.when(won, F.col("n"))), F.lit(0))
    return runs.groupBy(KEY).agg(longest(F.col("win")).alias("max_win_streak"), longest(~F.col("win")).alias("max_loss_streak"))


def with_dated_weights(df: DataFrame, weights: DataFrame, names: list[str], p: Params = DEFAULTS) -> DataFrame:
    """As backtest.with_dated_weights: the weights that hold before a chunk are carried over to it."""
    ref = weights.select(KEY, F.col("date").cast("timestamp").alias("timestamp"), F.lit(None).cast("bigint").alias("seq"), F.struct(*[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in names]).alias("_w"))
    both = df.withColumn("_row", F.lit(1)).unionByName(ref.withColumn("_row", F.lit(0)), allowMissingColumns=True)
    # weights come before the rows of their time: of equal times the order is by this number, the rows' own number next
    at = placed(both.withColumnRenamed("seq", "_seq").withColumn("seq", F.struct(F.col("_row").alias("row"), F.col("_seq").alias("seq"))), p)
    at = with_carry(at, {"_b": last_known("_w")})
    at = at.withColumn("_w", F.coalesce(F.last("_w", ignorenulls=True).over(inside()), F.col("_b"))).where("_row = 1").drop("_row", "_b", "seq").withColumnRenamed("_seq", "seq")
    total = sum((F.col(c) * F.coalesce(F.col(f"_w.{c}"), F.lit(0.0)) for c in names), F.lit(0.0))
    out = dropped(at).withColumn("combined_signal_wf", F.when(F.col("_w").isNull(), F.lit(0.0)).otherwise(total)).drop("_w")
    c = F.col("combined_signal_wf")
    return out.withColumn("signal_wf", sign_of(c > p.ensemble_threshold, c < -p.ensemble_threshold))
