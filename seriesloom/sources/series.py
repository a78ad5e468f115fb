"""Canonical series: series_key, seq, timestamp, price; adapters from tables and raw files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Accepted names of the two required columns, after lower-casing and trimming. Fixed values.
ALIASES = {
    "date": "timestamp", "datetime": "timestamp", "time": "timestamp", "trade_time": "timestamp",
    "close": "price", "last": "price", "last_price": "price", "settlement": "price",
}


def standardize_columns(df: DataFrame) -> DataFrame:
    """Lower-cases and trims names and maps aliases; fails if two columns get one name or a required one is missing."""
    names = [ALIASES.get(n, n) for n in (c.strip().lower() for c in df.columns)]
    if twice := sorted({n for n in names if names.count(n) > 1}):
        raise ValueError(f"several columns are called {', '.join(twice)}")
    if lacking := [n for n in ("timestamp", "price") if n not in names]:
        raise ValueError(f"required columns are missing: {', '.join(lacking)}")
    return df.toDF(*names)


def parse_timestamps(df: DataFrame) -> DataFrame:
    """Timestamps in the session's zone (UTC); what cannot be parsed becomes NULL."""
    if dict(df.dtypes)["timestamp"] == "string":
        return df.withColumn("timestamp", F.try_to_timestamp("timestamp"))
    return df.withColumn("timestamp", F.col("timestamp").cast("timestamp"))


def as_series(df: DataFrame, key: str | None = None, seq: str | None = None) -> DataFrame:
    """Adds series_key and seq in front; NaN prices become NULL. Without seq, ties of a timestamp are ordered by price."""
    price = F.col("price").cast("double")
    rest = [c for c in df.columns if c not in {"timestamp", "price", "series_key", "seq"}]
    return df.select(
        (F.col(key).cast("string") if key else F.lit("ALL")).alias("series_key"),
        (F.col(seq).cast("bigint") if seq else F.lit(0).cast("bigint")).alias("seq"),
        "timestamp",
        F.when(~F.isnan(price), price).alias("price"),
        *rest,
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tick(spark: SparkSession, sf_dir: str, key: str = "event_type") -> DataFrame:
    """Event values as prices, one series for each event type."""
    e = table(spark, sf_dir, "events").select(F.col(key).alias("k"), "event_id", F.col("ts").cast("timestamp").alias("timestamp"), F.col("value").alias("price"))
    return as_series(e, "k", "event_id").drop("k", "event_id")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as one long series: an index of 100 and a point for 30,011 of the value."""
    e = table(spark, sf_dir, "events")
    return e.select(F.lit("ALL").alias("series_key"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("timestamp"), (100 + F.col("value") / 30_011).alias("price"))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of the mean order price of each day, one series for each priority: 100 at a mean of 150,000, and a point for
    100,000 more. Prices are summed in decimals, so their order does not matter."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("series_key"), F.col("o_orderdate").cast("timestamp").alias("timestamp"), F.col("o_totalprice").cast("decimal(18,2)").alias("p"))
    mean = F.sum("p").cast("double") / F.count("p")
    return o.groupBy("series_key", "timestamp").agg((100 + (mean - 150_000) / 100_000).alias("price")).select("series_key", F.lit(0).cast("bigint").alias("seq"), "timestamp", "price")


def raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as they are: several prices a day and priority, told apart by the order key."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderpriority").alias("series_key"), F.col("o_orderkey").alias("seq"), F.col("o_orderdate").cast("timestamp").alias("timestamp"), F.col("o_totalprice").alias("price"))
