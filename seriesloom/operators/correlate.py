"""Correlations of all pairs of many columns, pairwise complete, from one pass over the rows.

Thousands of single aggregates would be beyond code generation; here a task sums
up all pairs of its rows at once, as products of matrices of values and of masks,
and the sums of tasks are added up. Columns are centred at their series' mean
first, so that sums of squares keep their digits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import KEY, ratio

#: Series whose sums a task holds before it hands them on.
HELD = 64
_SUMS = ("n", "x", "y", "xx", "yy", "xy")


def correlation_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """(series_key, x, y, n, correlation) of each pair, x after y in columns; missing where a side does not vary among the
    rows that have both values."""
    means = df.groupBy(KEY).agg(*[F.avg(F.col(c).cast("double")).alias(f"_m{k}") for k, c in enumerate(columns)])
    centred = df.select(KEY, *columns).join(means, KEY).select(KEY, *[(F.col(c).cast("double") - F.col(f"_m{k}")).alias(f"c{k}") for k, c in enumerate(columns)])
    later, earlier = np.tril_indices(len(columns), -1)
    names = [KEY, *_SUMS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def handed_on() -> pa.RecordBatch:
            rows = pa.ListArray.from_arrays
            ends = pa.array(np.arange(len(held) + 1, dtype=np.int32) * len(later), pa.int32())
            sums = [rows(ends, pa.array(np.concatenate([h[k] for h in held.values()]))) for k in range(len(_SUMS))]
            return pa.RecordBatch.from_arrays([pa.array(list(held), kind), *sums], names)

        for b in batches:
            kind = b.column(0).type
            keys = b.column(0).dictionary_encode()
            at = keys.indices.fill_null(len(keys.dictionary)).to_numpy(zero_copy_only=False)
            values = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns[1:]], axis=1).astype(float) if b.num_rows else np.empty((0, len(columns)))
            for k in np.unique(at):
                x = values[at == k]
                there = ~np.isnan(x)
                m, x = there.astype(float), np.where(there, x, 0.0)
                n, sx, sxx, sxy = m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x
                new = [n[later, earlier], sx[later, earlier], sx[earlier, later], sxx[later, earlier], sxx[earlier, later], sxy[later, earlier]]
                key = keys.dictionary[k].as_py() if k < len(keys.dictionary) else None
                held[key] = [a + c for a, c in zip(held[key], new, strict=True)] if key in held else new
            if len(held) >= HELD:
                yield handed_on()
                held.clear()
        if held:
            yield handed_on()

    arrays = ", ".join(f"{n} array<double>" for n in _SUMS)
    partial = centred.mapInArrow(run, f"{KEY} {df.schema[KEY].dataType.simpleString()}, {arrays}")
    pairs = partial.select(KEY, F.posexplode(F.arrays_zip(*_SUMS)).alias("pair", "s")).select(KEY, "pair", "s.*")
    total = pairs.groupBy(KEY, "pair").agg(*[F.sum(c).alias(c) for c in _SUMS])
    n = F.col("n")
    vx, vy = n * F.col("xx") - F.col("x") * F.col("x"), n * F.col("yy") - F.col("y") * F.col("y")
    # what rounding leaves of a column that does not vary
    varies = (vx > 1e-12 * n * F.col("xx")) & (vy > 1e-12 * n * F.col("yy"))
    r = F.when(varies, ratio(n * F.col("xy") - F.col("x") * F.col("y"), F.sqrt(vx) * F.sqrt(vy)))
    label = lambda index: F.array(*[F.lit(columns[i]) for i in index])[F.col("pair")]
    return total.select(KEY, label(later).alias("x"), label(earlier).alias("y"), n.cast("bigint").alias("n"), r.alias("correlation"))
