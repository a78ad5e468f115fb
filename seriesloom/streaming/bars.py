"""Daily bars of a stream of prices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import KEY, ratio


def daily_bars(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Open, low, high, close, mean and count of each series and day; a day is final ``late`` after its end.

    The same figures as the batch query for prices that are not later than that. State is one row for each open day.
    """
    order = F.when(F.col("price").isNotNull(), F.struct("timestamp", "seq"))
    bars = stream.withWatermark("timestamp", late).groupBy(KEY, F.window("timestamp", "1 day").alias("w")).agg(
        F.min_by("price", order).alias("open"), F.min("price").alias("low"), F.max("price").alias("high"), F.max_by("price", order).alias("close"),
        F.avg("price").alias("avg"), F.count("price").alias("num_obs"),
    )
    change = ratio(F.col("close") - F.col("open"), F.col("open")) * 100
    return bars.select(KEY, F.to_date("w.start").alias("trade_date"), "open", "low", "high", "close", "avg", "num_obs", change.alias("daily_return"))
