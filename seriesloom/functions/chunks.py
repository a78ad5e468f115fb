"""Series of any length, in chunks of rows.

Rows get their place in the series without a sort of the whole: places within a
time bucket, and counts of the buckets before. A chunk is a run of places.

Windows of bounded reach see a chunk and the rows next to it (``in_chunks``); what
runs from a series' start is a scan of two levels (``with_carry``): each chunk
comes to a short summary, summaries of the chunks before are combined, and every
chunk is finished by itself. So the most that one task sorts is a bucket or a
chunk, and the most that is ordered for a whole series is a row for each of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..params import DEFAULTS, Params
from .expr import KEY, ORDER

PLACE, CHUNK = "_place", "_chunk"
#: The bucket of rows without a time, which come last.
_LAST = 1 << 62


def placed(df: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """df with the place of each row in its series, from 0, and its chunk. Rows without a series are in none and go."""
    rows = df.withColumn("_bucket", F.coalesce(F.floor(F.unix_seconds(ORDER[0]) / p.bucket_seconds), F.lit(_LAST)))
    within = Window.partitionBy(KEY, "_bucket").orderBy(*[F.col(c).asc_nulls_last() for c in ORDER])
    before = Window.partitionBy(KEY).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(KEY, "_bucket").agg(F.count(F.lit(1)).alias("_n")).select(KEY, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_bucket_start"))
    rows = rows.withColumn("_at", F.row_number().over(within)).join(starts, [KEY, "_bucket"])
    place = F.col("_bucket_start") + F.col("_at") - 1
    return rows.withColumns({PLACE: place, CHUNK: F.floor(place / p.chunk_rows)}).drop("_bucket", "_at", "_bucket_start")


def dropped(df: DataFrame) -> DataFrame:
    return df.drop(PLACE, CHUNK)


def in_chunks(df: DataFrame, step: Callable[[DataFrame], DataFrame], before: int = 0, after: int = 0, p: Params = DEFAULTS) -> DataFrame:
    """step(df), computed chunk by chunk: right if what step makes of a row depends on at most so many rows before and after it.

    step may add columns and leave out rows, but keeps the columns it finds. Each chunk is a series of its own for it, and
    holds copies of the rows around it (of several chunks where those are short), which go again afterwards.
    """
    rows = df if PLACE in df.columns else placed(df, p)
    place = F.col(PLACE)
    first, last = F.floor(F.greatest(place - after, F.lit(0)) / p.chunk_rows), F.floor((place + before) / p.chunk_rows)
    rows = rows.withColumn("_for", F.explode(F.sequence(first, last)))
    rows = rows.withColumn(KEY, F.struct(F.col(KEY).alias("key"), F.col("_for").alias("chunk"))).drop("_for")
    out = step(rows).where(F.col(f"{KEY}.chunk") == F.col(CHUNK))
    return out.withColumn(KEY, F.col(f"{KEY}.key"))


def inside(first: int = Window.unboundedPreceding, last: int = Window.currentRow) -> WindowSpec:
    """Rows of the own chunk, up to the current one unless said otherwise."""
    return rows_of_chunk().rowsBetween(first, last)


def rows_of_chunk() -> WindowSpec:
    return Window.partitionBy(KEY, CHUNK).orderBy(PLACE)


def chunks_before() -> WindowSpec:
    """Over a row for each chunk: those before the current one."""
    return Window.partitionBy(KEY).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)


def with_carry(rows: DataFrame, summaries: dict[str, tuple[Column, Callable[[Column], Column]]]) -> DataFrame:
    """Placed rows with a column for each summary: what it comes to over all chunks before the own one, else missing.

    A summary is an aggregate of the rows of a chunk, and an aggregate that combines those of several chunks in order.
    """
    of_chunks = rows.groupBy(KEY, CHUNK).agg(*[c.alias(n) for n, (c, _) in summaries.items()])
    of_chunks = of_chunks.select(KEY, CHUNK, *[combine(F.col(n)).over(chunks_before()).alias(n) for n, (_, combine) in summaries.items()])
    return rows.join(of_chunks, [KEY, CHUNK])


def last_row(c: Column | str) -> tuple[Column, Callable[[Column], Column]]:
    """Summary: the value of the chunk's last row, missing or not; reads as ``name.v``."""
    c = F.col(c) if isinstance(c, str) else c
    return F.max_by(F.struct(c.alias("v")), F.col(PLACE)), F.last


def last_known(c: str) -> tuple[Column, Callable[[Column], Column]]:
    """Summary: the last value that is not missing."""
    return F.max_by(c, F.when(F.col(c).isNotNull(), F.col(PLACE))), lambda x: F.last(x, ignorenulls=True)


def compounded_in_chunks(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """Placed rows with running products of 1 + returns, named by names (product -> returns); missing where the return is."""
    factors = {f"_f_{n}": F.coalesce(1 + F.col(r), F.lit(1.0)) for n, r in names.items()}
    rows = rows.withColumns(factors)
    rows = with_carry(rows, {f"_b_{n}": (F.product(f"_f_{n}"), F.product) for n in names})
    grown = {n: F.when(F.col(r).isNotNull(), F.coalesce(f"_b_{n}", F.lit(1.0)) * F.product(f"_f_{n}").over(inside())) for n, r in names.items()}
    return rows.withColumns(grown).drop(*factors, *[f"_b_{n}" for n in names])


def running_max_in_chunks(rows: DataFrame, name: str, c: str) -> DataFrame:
    rows = with_carry(rows, {"_b": (F.max(c), F.max)})
    return rows.withColumn(name, F.greatest("_b", F.max(c).over(inside()))).drop("_b")


def run_numbers(rows: DataFrame, name: str, starts: Column) -> DataFrame:
    """Placed rows with the number of runs begun so far; starts is true on the first row of each."""
    rows = rows.withColumn("_s", F.coalesce(starts, F.lit(False)).cast("bigint"))
    rows = with_carry(rows, {"_b": (F.sum("_s"), F.sum)})
    return rows.withColumn(name, F.coalesce("_b", F.lit(0)) + F.sum("_s").over(inside())).drop("_b", "_s")
