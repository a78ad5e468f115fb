"""Exact quantiles of series, in one buffer or by ranges of values.

By ranges nothing holds all values of a series: values are counted in ranges that
grow with their size (64 for each power of two), which needs no look at the data
before; sums of counts tell which range holds a rank; values of those ranges
alone are counted in 4,096 equal parts of the range; and only the values of the
parts that hold a rank are sorted, equal ones as one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import DEFAULTS, Params
from ..sources.scratch import settled
from .expr import KEY

#: Ranges for each power of two, equal parts of such a range, and the most rows of a table of ranges that is broadcast.
PER_OCTAVE, PARTS, MOST = 64, 4096, 1_000_000
#: Above all exponents of doubles, times PER_OCTAVE.
_OFFSET = 1100 * PER_OCTAVE


def _range(x: Column) -> Column:
    """A whole number that never falls when x rises; 0 has its own."""
    size = F.floor(F.log2(F.abs(x)) * PER_OCTAVE) + _OFFSET
    return F.when(x > 0, size).when(x < 0, -size).otherwise(F.lit(0))


def _part(x: Column, low: Column, high: Column) -> Column:
    return F.least(F.floor(F.coalesce(F.try_divide(x - low, (high - low) / PARTS), F.lit(0.0))), F.lit(PARTS - 1))


def _small(df: DataFrame) -> DataFrame:
    """A settled table, to be broadcast if it has at most MOST rows."""
    return F.broadcast(df) if df.count() <= MOST else df


def _holding(counts: DataFrame, group: list[str], order: str, before: Column, ranks: Column) -> DataFrame:
    """The ranges (rows of counts: group, order, n, low, high) that hold one of the ranks, with the values below them."""
    below = before + F.sum("n").over(Window.partitionBy(*group).orderBy(order)) - F.col("n")
    found = counts.withColumn("below", below)
    held = F.filter(ranks, lambda r: (r >= F.col("below")) & (r < F.col("below") + F.col("n")))
    return found.withColumn("ranks", F.array_distinct(held)).where(F.size("ranks") > 0)


def quantiles_by_ranges(df: DataFrame, wanted: dict[str, tuple[str, float]], by: tuple[str, ...] = (KEY,)) -> DataFrame:
    """(by, a column for each name of wanted): the quantile of a column by linear interpolation, missing where all values are."""
    columns = list(dict.fromkeys(c for c, _ in wanted.values()))
    shares = sorted({q for _, q in wanted.values()})
    group = [*by, "_column"]
    pairs = F.array(*[F.struct(F.lit(k).alias("_column"), F.col(c).cast("double").alias("_x")) for k, c in enumerate(columns)])
    values = df.select(*by, F.inline(pairs)).where(F.col("_x").isNotNull()).withColumn("_range", _range(F.col("_x")))

    counts = values.groupBy(*group, "_range").agg(F.count(F.lit(1)).alias("n"), F.min("_x").alias("low"), F.max("_x").alias("high"))
    counts = counts.withColumn("total", F.sum("n").over(Window.partitionBy(*group)))
    at = [(F.col("total") - 1).cast("double") * q for q in shares]
    ranks = F.array(*[f(a).cast("bigint") for a in at for f in (F.floor, F.ceil)])
    first = settled(_holding(counts, group, "_range", F.lit(0), ranks))

    narrow = _small(first.select(*group, "_range", "low", "high", "below", "ranks", "total"))
    some = values.join(narrow, [*group, "_range"]).withColumn("_part", _part(F.col("_x"), F.col("low"), F.col("high")))
    inner = [*group, "_range", "_part"]
    finer = some.groupBy(*inner, "below", "ranks", "total").agg(F.count(F.lit(1)).alias("n"), F.min("_x").alias("low"), F.max("_x").alias("high"))
    second = settled(_holding(finer.withColumnRenamed("below", "start"), [*group, "_range"], "_part", F.col("start"), F.col("ranks")))

    few = some.select(*inner, "_x").join(_small(second.select(*inner, "below", "ranks", "total")), inner)
    equal = few.groupBy(*inner, "_x", "below", "ranks", "total").agg(F.count(F.lit(1)).alias("n"))
    upto = F.col("below") + F.sum("n").over(Window.partitionBy(*inner).orderBy("_x"))
    picked = equal.withColumn("upto", upto).select(*group, "_x", "total", F.explode(F.filter("ranks", lambda r: (r >= F.col("upto") - F.col("n")) & (r < F.col("upto")))).alias("rank"))

    def value(name: str) -> Column:
        column, q = wanted[name]
        position = (F.col("total") - 1).cast("double") * q
        own = F.col("_column") == columns.index(column)
        low, high = (F.max(F.when(own & (F.col("rank") == f(position)), F.col("_x"))) for f in (F.floor, F.ceil))
        over, under = F.max(F.when(own, position - F.floor(position))), F.max(F.when(own, F.ceil(position) - position))
        # as the aggregate that holds all values does it: both neighbours by their shares
        return F.when(low == high, low).otherwise(under * low + over * high).alias(name)

    found = picked.groupBy(*by).agg(*[value(n) for n in wanted])
    keys = df.select(*by).distinct()
    same = reduce(lambda a, b: a & b, [F.col(f"k.{c}").eqNullSafe(F.col(f"f.{c}")) for c in by])
    return keys.alias("k").join(found.alias("f"), same, "left").select(*[F.col(f"k.{c}") for c in by], *wanted)


def quantiles(df: DataFrame, wanted: dict[str, tuple[str, float]], p: Params = DEFAULTS) -> DataFrame:
    """(series_key, a column for each name): by ranges if the parameters say that series are long, else by one aggregate."""
    if p.long_series:
        return quantiles_by_ranges(df, wanted)
    return df.groupBy(KEY).agg(*[F.percentile(c, F.lit(q)).alias(n) for n, (c, q) in wanted.items()])
