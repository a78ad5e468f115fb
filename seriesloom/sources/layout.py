"""Price tables laid out for their readers: bucketed by series, partitioned by month.

Windows of a series and joins of two such tables find rows where they need them
and move none; readers of some months open those months alone; a corrected month
replaces itself and leaves the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import KEY

MONTH = "month"
BUCKETS = 64


def _with_month(df: DataFrame) -> DataFrame:
    """month as a date; rows without a time are of no month, and stay together in that partition."""
    rest = [c for c in df.columns if c != MONTH]
    return df.select(*rest, F.trunc("timestamp", "month").alias(MONTH))


def save_prices(df: DataFrame, name: str, buckets: int = BUCKETS) -> None:
    """Writes a new table. Rows are dealt out by bucket and month before they are written, so a task opens one file for each
    of its pairs and a month has at most one file a bucket."""
    rows = _with_month(df).repartition(buckets, KEY)
    rows.write.mode("overwrite").format("parquet").partitionBy(MONTH).bucketBy(buckets, KEY).sortBy(KEY, "timestamp").saveAsTable(name)


def replace_months(df: DataFrame, name: str) -> None:
    """Puts the months of df in the place of those months of the table; other months stay as they are."""
    spark = df.sparkSession
    columns = spark.table(name).columns
    conf = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "dynamic")
    try:
        _with_month(df).select(*columns).write.mode("overwrite").insertInto(name)
    finally:
        spark.conf.set(conf, before)


def prices(spark: SparkSession, name: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows of the table from start, and before end (dates as text); only their months are read."""
    df = spark.table(name)
    t = F.col("timestamp")
    if start:
        df = df.where((F.col(MONTH) >= F.trunc(F.lit(start).cast("date"), "month")) & (t >= F.lit(start).cast("timestamp")))
    if end:
        df = df.where((F.col(MONTH) <= F.trunc(F.lit(end).cast("date"), "month")) & (t < F.lit(end).cast("timestamp")))
    return df.drop(MONTH)
