"""Backtests of signals: equity, trades and comparison, as plans over runs and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import KEY, change, compounded, lag, lead, ratio, series_window, sign_of
from ..params import DEFAULTS, Params

STRATEGY = "strategy"


def with_positions(df: DataFrame, signal: str, p: Params = DEFAULTS) -> DataFrame:
    """position is the row before's signal; net returns exist where the position before is known. Looks two rows back."""
    if signal not in df.columns:
        raise ValueError(f"no signal column {signal!r}")
    if "returns" not in df.columns:
        df = df.withColumn("returns", change("price"))
    df = df.withColumn("position", lag(signal).cast("double"))
    df = df.withColumn("position_change", F.abs(F.col("position") - lag("position")))
    df = df.withColumns({"strategy_returns": F.col("position") * F.col("returns"), "transaction_costs": F.col("position_change") * (p.total_cost_bps / 10_000)})
    return df.withColumn("strategy_returns_net", F.col("strategy_returns") - F.col("transaction_costs"))


def with_equity(df: DataFrame, signal: str, p: Params = DEFAULTS) -> DataFrame:
    df = with_positions(df, signal, p)
    return df.withColumns({"cum_strategy_returns": compounded("strategy_returns_net"), "cum_buy_hold": compounded("returns")})


def trades(equity: DataFrame, p: Params = DEFAULTS, strict: bool = False) -> DataFrame:
    """Trade log of a frame with equity: runs of one position, each left at the start of the next.

    A trade that is still open at the end is not logged. A position that is not 1 is called SHORT. A leading missing
    position is flat; strict takes it as an entry, which logs a trade of one row.
    """
    position = F.col("position") if strict else F.coalesce("position", F.lit(0.0))
    df = equity.select(KEY, "seq", "timestamp", "price", position.alias("position"))
    return _logged(with_exits(position_starts(df)), p)


def position_starts(df: DataFrame) -> DataFrame:
    """The first row of each run of one position; a missing position is a run of its own. Looks one row back."""
    before = lag("position")
    start = (F.row_number().over(series_window()) == 1) | F.col("position").isNull() | before.isNull() | (F.col("position") != before)
    return df.withColumn("_start", start).where("_start").drop("_start")


def with_exits(starts: DataFrame) -> DataFrame:
    return starts.withColumns({"exit_time": lead("timestamp"), "exit_price": lead("price")})


def _logged(runs: DataFrame, p: Params) -> DataFrame:
    runs = runs.where((F.col("position").isNull() | (F.col("position") != 0)) & F.col("exit_time").isNotNull())
    long = F.coalesce(F.col("position") == 1, F.lit(False))
    gain = F.when(long, F.col("exit_price") - F.col("price")).otherwise(F.col("price") - F.col("exit_price"))
    cost = p.total_cost_bps / 100
    return runs.select(
        KEY, F.col("timestamp").alias("entry_time"), "exit_time", F.when(long, "LONG").otherwise("SHORT").alias("direction"),
        F.col("price").alias("entry_price"), "exit_price", ((F.unix_micros("exit_time") - F.unix_micros("timestamp")) / 3.6e9).alias("duration_hours"),
        (ratio(gain, F.col("price")) * 100 - cost).alias("pnl"), F.lit(cost).alias("cost"),
    )


def summary(equity: DataFrame, log: DataFrame) -> DataFrame:
    """One row for each series: returns in percent, trades by turnover and by log, win rate, costs."""
    last = F.struct("timestamp", "seq")
    a = equity.groupBy(KEY).agg(
        ((F.max_by("cum_strategy_returns", last) - 1) * 100).alias("total_return"), ((F.max_by("cum_buy_hold", last) - 1) * 100).alias("total_return_bh"),
        F.floor(F.coalesce(F.sum("position_change"), F.lit(0.0)) / 2).alias("num_trades"), (F.coalesce(F.sum("transaction_costs"), F.lit(0.0)) * 100).alias("total_costs"),
    )
    b = log.groupBy(KEY).agg(F.count(F.lit(1)).alias("logged_trades"), F.count_if(F.col("pnl") > 0).alias("wins"))
    out = a.join(b, KEY, "left").withColumns({"logged_trades": F.coalesce("logged_trades", F.lit(0)), "wins": F.coalesce("wins", F.lit(0))})
    return out.select(
        KEY, "total_return", "total_return_bh", (F.col("total_return") - F.col("total_return_bh")).alias("excess_return"), "num_trades", "logged_trades",
        F.coalesce(ratio(F.col("wins") * 100.0, F.col("logged_trades")), F.lit(0.0)).alias("win_rate"), "total_costs",
    )


def compare(df: DataFrame, signals: dict[str, str], p: Params = DEFAULTS) -> DataFrame:
    """Summaries of several signals in one plan, the best of a series first: rows are unpivoted to one series for each key and strategy."""
    if "returns" not in df.columns:
        df = df.withColumn("returns", change("price"))
    pairs = F.array(*[F.struct(F.lit(name).alias("name"), F.col(c).cast("double").alias("signal")) for name, c in signals.items()])
    long = df.select(KEY, "seq", "timestamp", "price", "returns", F.inline(pairs))
    long = long.withColumn(KEY, F.to_json(F.struct(KEY, "name"))).drop("name")
    equity = with_equity(long, "signal", p)
    out = summary(equity, trades(equity, p))
    parts = F.from_json(KEY, f"{KEY} string, name string")
    out = out.select(parts[KEY].alias("_key"), parts["name"].alias(STRATEGY), *[c for c in out.columns if c != KEY]).withColumnRenamed("_key", KEY)
    return out.orderBy(KEY, F.col("total_return").desc_nulls_last(), STRATEGY)


def with_dated_weights(df: DataFrame, weights: DataFrame, signals: list[str], p: Params = DEFAULTS) -> DataFrame:
    """combined_signal_wf and signal_wf: weights (series_key, date, a column for each signal) hold from their date until
    the next one; before the first they are 0.

    Both sides are put in one ordering and the last weights are carried on, so there is no range join.
    """
    ref = weights.select(KEY, F.col("date").cast("timestamp").alias("timestamp"), F.struct(*[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in signals]).alias("_w"))
    both = df.withColumn("_row", F.lit(1)).unionByName(ref.withColumn("_row", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(KEY).orderBy(F.col("timestamp").asc_nulls_last(), "_row", F.col("seq").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_w", F.last("_w", ignorenulls=True).over(w)).where("_row = 1").drop("_row")
    total = sum((F.col(c) * F.coalesce(F.col(f"_w.{c}"), F.lit(0.0)) for c in signals), F.lit(0.0))
    out = both.withColumn("combined_signal_wf", F.when(F.col("_w").isNull(), F.lit(0.0)).otherwise(total)).drop("_w")
    c = F.col("combined_signal_wf")
    return out.withColumn("signal_wf", sign_of(c > p.ensemble_threshold, c < -p.ensemble_threshold))
