"""Anomaly checks, each one row for each series, and all of them as rows of check, metric and value."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import KEY, lag, ratio, series_window, so_far
from ..params import DEFAULTS, Params


def share(n, total):
    return ratio(n * 100.0, total)


def initial_validation(df: DataFrame) -> DataFrame:
    distinct = F.count_distinct(F.struct(F.col("timestamp").isNull(), "timestamp"))
    return df.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("total_rows"), F.min("timestamp").alias("first_time"), F.max("timestamp").alias("last_time"),
        F.count_if(F.col("price").isNull()).alias("missing_prices"), (F.count(F.lit(1)) - distinct).alias("duplicate_timestamps"),
        F.min("price").alias("min_price"), F.max("price").alias("max_price"),
    )


def duplicates(df: DataFrame) -> DataFrame:
    """All rows that share a timestamp count, missing timestamps with each other."""
    n = df.groupBy(KEY, "timestamp").agg(F.count(F.lit(1)).alias("n"))
    out = n.groupBy(KEY).agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("count"), F.sum("n").alias("rows"))
    return out.select(KEY, "count", share(F.col("count"), F.col("rows")).alias("percentage"), F.when(F.col("count") > 0, "HIGH").otherwise("NONE").alias("severity"))


def missing(df: DataFrame, columns: tuple[str, ...] = ("timestamp", "price")) -> DataFrame:
    counts = [F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in columns]
    out = df.groupBy(KEY).agg(F.count(F.lit(1)).alias("rows"), *counts)
    total = reduce(lambda a, b: a + b, [F.col(f"missing_{c}") for c in columns])
    return out.select(KEY, *[f"missing_{c}" for c in columns], total.alias("total"), share(total, F.col("rows") * len(columns)).alias("percentage"), F.when(total > 0, "MEDIUM").otherwise("NONE").alias("severity"))


def outliers(df: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    stats = df.groupBy(KEY).agg(F.avg("price").alias("_m"), F.stddev_samp("price").alias("_s"), F.count("price").alias("_n"))
    far = F.abs(ratio(F.col("price") - F.col("_m"), F.col("_s"))) > p.outlier_z
    out = df.join(stats, KEY).groupBy(KEY).agg(F.count_if(far).alias("count"), F.max("_n").alias("_n"))
    return out.select(KEY, "count", share(F.col("count"), F.col("_n")).alias("percentage"), F.when(F.col("count") > 10, "MEDIUM").otherwise("LOW").alias("severity"))


def spikes(df: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Changes against the last price that is known."""
    df = df.withColumn("_p", F.last("price", ignorenulls=True).over(so_far()))
    df = df.withColumn("_c", F.abs(ratio(F.col("_p") - lag("_p"), lag("_p")) * 100))
    out = df.groupBy(KEY).agg(F.count_if(F.col("_c") > p.spike_pct).alias("count"), F.count(F.lit(1)).alias("_n"), F.coalesce(F.max("_c"), F.lit(0.0)).alias("max_move"))
    severity = F.when(F.col("count") > 50, "HIGH").when(F.col("count") > 10, "MEDIUM").otherwise("LOW")
    return out.select(KEY, "count", share(F.col("count"), F.col("_n")).alias("percentage"), "max_move", severity.alias("severity"))


def largest_moves(df: DataFrame, n: int = 3) -> DataFrame:
    """The n largest changes of each series by size, with their sign; of equal ones the earliest."""
    df = df.withColumn("change_pct", ratio(F.col("price") - lag("price"), lag("price")) * 100).where("change_pct is not null")
    w = Window.partitionBy(KEY).orderBy(F.abs("change_pct").desc(), "timestamp", "seq")
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select(KEY, "rank", "timestamp", "change_pct")


def time_gaps(df: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Gaps over ``gap_factor`` times the most frequent step; of equally frequent steps the smallest, else a minute."""
    seconds = F.unix_micros("timestamp") - F.unix_micros(lag("timestamp"))
    steps = df.select(KEY, seconds.alias("d"))
    counted = steps.groupBy(KEY, "d").agg(F.count(F.lit(1)).alias("n"))
    best = F.when(F.col("d").isNotNull(), F.struct(-F.col("n"), F.col("d")))
    typical = counted.groupBy(KEY).agg(F.coalesce(F.min_by("d", best), F.lit(60_000_000)).alias("typical"))
    out = counted.join(typical, KEY).groupBy(KEY, "typical").agg(F.coalesce(F.sum(F.when(F.col("d") > F.col("typical") * p.gap_factor, F.col("n"))), F.lit(0)).alias("count"), F.max("d").alias("max_gap"))
    return out.select(KEY, "count", (F.col("typical") / 1e6).alias("typical_seconds"), (F.col("max_gap") / 1e6).alias("max_gap_seconds"), F.when(F.col("count") > 20, "MEDIUM").otherwise("LOW").alias("severity"))


def flat_periods(df: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Runs of unchanged prices; a run's length counts the repeats."""
    same = F.coalesce(F.col("price") == lag("price"), F.lit(False))
    df = df.withColumn("_same", same)
    df = df.withColumn("_run", F.sum(F.when(F.col("_same"), 0).otherwise(1)).over(so_far()))
    runs = df.groupBy(KEY, "_run").agg(F.count_if("_same").alias("n"))
    out = runs.groupBy(KEY).agg(F.count_if(F.col("n") > p.flat_run).alias("num_long_flat_periods"), F.max("n").alias("max_consecutive_unchanged"))
    return out.withColumn("severity", F.when(F.col("num_long_flat_periods") > 5, "MEDIUM").otherwise("LOW"))


def impossible(df: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    price = F.col("price")
    out = df.groupBy(KEY).agg(F.count_if(price <= 0).alias("negative_prices"), F.count_if(price < p.min_price).alias("below_min"), F.count_if(price > p.max_price).alias("above_max"))
    return out.withColumn("severity", F.when(F.col("negative_prices") + F.col("below_min") + F.col("above_max") > 0, "HIGH").otherwise("NONE"))


CHECKS = {
    "duplicates": duplicates, "missing_values": missing, "price_outliers": outliers, "price_spikes": spikes,
    "time_gaps": time_gaps, "flat_periods": flat_periods, "impossible_values": impossible,
}


def all_checks(df: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """(series_key, check, metric, value as text): every figure of every check."""
    found = []
    for name, check in CHECKS.items():
        one = check(df) if check in (duplicates, missing) else check(df, p)
        pairs = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("string").alias("value")) for c in one.columns if c != KEY]
        found.append(one.select(KEY, F.lit(name).alias("check"), F.inline(F.array(*pairs))))
    return reduce(DataFrame.unionByName, found)


def report(checks: DataFrame) -> str:
    """Text from the figures of all checks: a few dozen rows for each series."""
    lines, last = ["ANOMALY DETECTION REPORT"], None
    for r in checks.orderBy(KEY, "check", "metric").toLocalIterator():
        if (head := (r[KEY], r["check"])) != last:
            lines += ["", f"{r[KEY]}: {r['check'].upper().replace('_', ' ')}"]
            last = head
        lines.append(f"  {r['metric']}: {r['value']}")
    return "\n".join(lines)
