"""Cleaning steps in their fixed order, and a report made in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.expr import KEY, flag, lag, ratio, rows
from ..params import DEFAULTS, Params


def dedup_keep_last(df: DataFrame) -> DataFrame:
    """Of rows with one timestamp the one with the largest seq stays; missing timestamps count as equal."""
    w = Window.partitionBy(KEY, "timestamp").orderBy(F.col("seq").desc_nulls_last(), F.col("price").desc_nulls_last())
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def fill_missing(df: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Drops rows without timestamp, fills prices from at most ``fill_limit`` rows before, drops what is still missing."""
    df = df.where(F.col("timestamp").isNotNull())
    return df.withColumn("price", F.last("price", ignorenulls=True).over(rows(-p.fill_limit))).where(F.col("price").isNotNull())


def keep_possible(df: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    return df.where((F.col("price") > 0) & F.col("price").between(p.min_price, p.max_price))


def drop_outliers(df: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Keeps prices within ``outlier_z`` deviations of their series' mean; all of them where there is no deviation."""
    stats = df.groupBy(KEY).agg(F.avg("price").alias("_m"), F.stddev_samp("price").alias("_s"))
    z = F.abs(ratio(F.col("price") - F.col("_m"), F.col("_s")))
    return df.join(stats, KEY).where(F.coalesce(z <= p.outlier_z, F.lit(True))).select(*df.columns)


def mark_spikes(df: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    df = df.withColumn("price_change_pct", ratio(F.col("price") - lag("price"), lag("price")) * 100)
    return df.withColumn("potential_spike", flag(F.abs("price_change_pct") > p.spike_pct).cast("boolean"))


def clean(df: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    for step in (fill_missing, keep_possible, drop_outliers, mark_spikes):
        df = step(dedup_keep_last(df) if step is fill_missing else df, p)
    return df


def violations(df: DataFrame) -> DataFrame:
    """Counts of broken promises of a clean series, for each series; all zero if it is clean."""
    again = df.withColumn("_again", F.col("timestamp") <= lag("timestamp"))
    return again.groupBy(KEY).agg(F.count_if(F.col("timestamp").isNull()).alias("null_timestamps"), F.count_if(F.col("price").isNull()).alias("null_prices"), F.count_if(F.col("price") <= 0).alias("non_positive"), F.count_if("_again").alias("repeated_times"))


def cleaning_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """(series_key, original_rows, final_rows, removed, retention_pct)."""
    a = before.groupBy(KEY).agg(F.count(F.lit(1)).alias("original_rows"))
    b = after.groupBy(KEY).agg(F.count(F.lit(1)).alias("final_rows"))
    out = a.join(b, KEY, "left").withColumn("final_rows", F.coalesce("final_rows", F.lit(0)))
    return out.withColumns({"removed": F.col("original_rows") - F.col("final_rows"), "retention_pct": ratio(F.col("final_rows") * 100.0, F.col("original_rows"))})


def clean_observed(df: DataFrame, p: Params = DEFAULTS) -> tuple[DataFrame, dict[str, Observation]]:
    """(clean(df), observations): whichever action computes the result also counts the rows after each step.

    Read ``step_counts`` after that action; there is no pass for the counts alone.
    """
    steps = {"raw": lambda d: d, "one row for a time": dedup_keep_last, "filled": lambda d: fill_missing(d, p), "possible": lambda d: keep_possible(d, p), "no outliers": lambda d: drop_outliers(d, p)}
    seen = {name: Observation() for name in steps}
    for name, step in steps.items():
        df = step(df).observe(seen[name], F.count(F.lit(1)).alias("rows"), F.count_if(F.col("price").isNull()).alias("missing"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))
    return mark_spikes(df, p), seen


def step_counts(seen: dict[str, Observation]) -> list[dict]:
    """[{step, rows, removed, missing, first, last}]; waits for an action on the observed frame."""
    out, before = [], None
    for name, o in seen.items():
        found = o.get
        out.append({"step": name, **found, "removed": 0 if before is None else before - found["rows"]})
        before = found["rows"]
    return out


STEPS = ("repeated time", "no time", "no price", "impossible", "outlier", "kept")


def cleaning_steps(df: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """(series_key, step, rows): for each row of each series the step that removes it, or kept; rows filled count as filled
    beside that. Removed rows are marked and not dropped, so one plan tells it for all series."""
    again = Window.partitionBy(KEY, "timestamp").orderBy(F.col("seq").desc_nulls_last(), F.col("price").desc_nulls_last())
    at = df.withColumn("_why", F.when(F.row_number().over(again) > 1, STEPS[0]).when(F.col("timestamp").isNull(), STEPS[1]))
    alive = F.col("_why").isNull()
    order = Window.partitionBy(KEY, alive).orderBy(F.col("timestamp").asc_nulls_last(), F.col("seq").asc_nulls_last()).rowsBetween(-p.fill_limit, 0)
    at = at.withColumn("_filled", F.last("price", ignorenulls=True).over(order))
    at = at.withColumns({"_mended": alive & F.col("price").isNull() & F.col("_filled").isNotNull(), "_why": F.when(~alive, F.col("_why")).when(F.col("_filled").isNull(), STEPS[2]).when(~((F.col("_filled") > 0) & F.col("_filled").between(p.min_price, p.max_price)), STEPS[3])})
    price = F.when(F.col("_why").isNull(), F.col("_filled"))
    stats = at.groupBy(KEY).agg(F.avg(price).alias("_m"), F.stddev_samp(price).alias("_s"))
    z = F.abs(ratio(F.col("_filled") - F.col("_m"), F.col("_s")))
    at = at.join(stats, KEY).withColumn("_why", F.coalesce("_why", F.when(z > p.outlier_z, STEPS[4]), F.lit(STEPS[5])))
    counts = [F.struct(F.lit(s).alias("step"), F.count_if(F.col("_why") == s).alias("rows")) for s in STEPS] + [F.struct(F.lit("filled").alias("step"), F.count_if("_mended").alias("rows"))]
    return at.groupBy(KEY).agg(F.array(*counts).alias("a")).select(KEY, F.inline("a"))
