"""Sums and products of rows in an order that neither chunks nor tasks change: that of a tree of blocks of 16 places.

Doubles that are added or multiplied in another order differ in their last bits, and comparisons of what would be equal
(averages that meet, drawdowns of one depth) then fall either way. DuckDB takes the frame of a window as whole blocks of
16 rows, counted from the start of the series, and single rows before and after them; blocks are combined in the same way.
Here the same is done, so that such comparisons come out as in the SQL twins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import Params
from .chunks import PLACE
from .expr import KEY, roll, rows

#: Children of a node; rows of a piece, whose levels are windows over rows; levels above, over a row for each piece.
FAN, PIECE, LEVELS = 16, 16**3, 6


def _frame(c: str, n: int) -> tuple[Column, Column, Column, Column]:
    """The values of the last n rows, in order, and how many of them stand before, in, and after a whole block."""
    after = ((F.col(PLACE) + 1) % FAN).cast("int")
    whole = F.when(n - after >= FAN, FAN).otherwise(0)
    return F.collect_list(c).over(rows(1 - n)), n - after - whole, whole, after


def _in_blocks(df: DataFrame, n: int, p: Params) -> bool:
    """Frames of 16 to 31 rows hold one whole block at most; shorter ones hold none, and their sums have one order."""
    return p.long_series and PLACE in df.columns and FAN <= n < 2 * FAN


def mean_of_last(df: DataFrame, c: str, n: int, p: Params) -> Column:
    """As roll(avg); of a long series' placed rows in the order of blocks."""
    if not _in_blocks(df, n, p):
        return roll(F.avg, c, n)
    values, before, whole, after = _frame(c, n)
    add = lambda start, part: F.aggregate(part, start, lambda s, x: s + x)
    none = F.lit(0.0)
    total = add(add(none, F.slice(values, F.lit(1), before)) + add(none, F.slice(values, before + 1, whole)), F.slice(values, before + whole + 1, after))
    return F.when(F.count(c).over(rows(1 - n)) >= n, total / n)


def _product_and_sum(a: Column, b: Column, c: Column) -> Column:
    """a b + c rounded once: products and sums are taken with what rounding leaves of them."""

    def halves(x: Column) -> tuple[Column, Column]:
        big = x * F.lit(134217729.0)
        high = big - (big - x)
        return high, x - high

    (ah, al), (bh, bl), p = halves(a), halves(b), a * b
    left = ((ah * bh - p) + ah * bl + al * bh) + al * bl
    s = c + p
    part = s - c
    return s + (((c - (s - part)) + (p - part)) + left)


def deviation_of_last(df: DataFrame, c: str, n: int, p: Params) -> Column:
    """As roll(stddev_samp); of a long series' placed rows in the order of blocks."""
    if not _in_blocks(df, n, p):
        return roll(F.stddev_samp, c, n)
    values, before, whole, after = _frame(c, n)

    def add(start: Column, part: Column) -> Column:
        """Row by row: number, mean and sum of squares."""

        def one(s: Column, x: Column) -> Column:
            mean = s["m"] + (x - s["m"]) / (s["n"] + 1)
            return F.struct((s["n"] + 1).alias("n"), mean.alias("m"), (s["q"] + (x - mean) * (x - s["m"])).alias("q"))

        return F.aggregate(part, start, one)

    none = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("m"), F.lit(0.0).alias("q"))

    def both(s: Column, t: Column) -> Column:
        n, apart = s["n"] + t["n"], t["m"] - s["m"]
        mean = _product_and_sum(apart, t["n"] / n, s["m"])
        return F.struct(n.alias("n"), mean.alias("m"), (t["q"] + s["q"] + apart * apart * t["n"] * s["n"] / n).alias("q"))

    # A lambda's argument is evaluated once, however often it is referred to.
    once = lambda x, f: F.transform(F.array(x), f)[0]
    first, block = add(none, F.slice(values, F.lit(1), before)), add(none, F.slice(values, before + 1, whole))
    pair = F.struct(first.alias("s"), block.alias("t"))
    joined = once(pair, lambda x: F.when(x["t"]["n"] == 0, x["s"]).when(x["s"]["n"] == 0, x["t"]).otherwise(both(x["s"], x["t"])))
    state = add(joined, F.slice(values, before + whole + 1, after))
    return F.when(F.count(c).over(rows(1 - n)) >= n, F.sqrt(state["q"] / (n - 1)))


def _ends(df: DataFrame, index: str, size: int) -> Column:
    return (F.col(index) + 1) % size == 0


def compounded_in_blocks(df: DataFrame, name: str, returns: str) -> DataFrame:
    """Placed rows with the running product of 1 + returns, missing where the return is. A task holds a piece of rows; of a
    whole series a row for each piece is ordered."""
    top = "_chunk_of_blocks"
    at = df.withColumns({top: F.floor(F.col(PLACE) / PIECE), "_f": F.coalesce(1 + F.col(returns), F.lit(1.0))})

    def over(parts: list[Column | str], order: str, last: int = 0):
        return Window.partitionBy(KEY, *parts).orderBy(order).rowsBetween(Window.unboundedPreceding, last)

    # Up: the product of a node is at its last row.
    sizes = [FAN, FAN**2, PIECE]
    value = "_f"
    for k, size in enumerate(sizes, 1):
        at = at.withColumn(f"_n{k}", F.when(_ends(at, PLACE, size), F.product(value).over(over([top, F.floor(F.col(PLACE) / size)], PLACE))))
        value = f"_n{k}"
    pieces = at.groupBy(KEY, top).agg(F.max("_n3").alias("_v0"))
    # The same over pieces; then down: what comes before a node, and up to its end.
    for k in range(1, LEVELS):
        pieces = pieces.withColumn(f"_v{k}", F.when(_ends(pieces, top, FAN**k), F.product(f"_v{k - 1}").over(over([F.floor(F.col(top) / FAN**k)], top))))
    pieces = pieces.withColumn("_before", F.lit(1.0)).withColumn("_upto", F.lit(None).cast("double"))
    for k in range(LEVELS - 1, -1, -1):
        pieces = _down(pieces, top, f"_v{k}", FAN**k, FAN ** (k + 1), lambda order, last, k=k: over([F.floor(F.col(top) / FAN ** (k + 1))], order, last))
    at = at.join(pieces.select(KEY, top, "_before", "_upto"), [KEY, top])
    for node, size in (("_n2", FAN**2), ("_n1", FAN), ("_f", 1)):
        at = _down(at, PLACE, node, size, size * FAN, lambda order, last, size=size: over([top, F.floor(F.col(PLACE) / (size * FAN))], order, last))
    out = at.withColumn(name, F.when(F.col(returns).isNotNull(), F.col("_upto")))
    return out.drop(top, "_f", "_n1", "_n2", "_n3", "_before", "_upto")


def _down(df: DataFrame, index: str, node: str, size: int, parent: int, over) -> DataFrame:
    """``_before``, what comes before the parent of a row, becomes what comes before its node; ``_upto``, the product up to
    the row's end, is set where a node of this level ends there and none of a higher one does."""
    first = F.col(index) % parent < size
    grown = F.when(first, F.col("_before") * F.col(node)).otherwise(F.col(node))
    df = df.withColumn("_g", F.when(_ends(df, index, size), grown))
    df = df.withColumns({"_p": F.product("_g").over(over(index, 0)), "_q": F.product("_g").over(over(index, -1))})
    upto = F.when(_ends(df, index, parent), F.col("_upto")).when(_ends(df, index, size), F.col("_p"))
    return df.withColumns({"_upto": upto, "_before": F.coalesce("_q", "_before")}).drop("_g", "_p", "_q")
