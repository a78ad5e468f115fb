"""Product codes of vectors: integer Lloyd rounds with Hamerly's bounds.

Each vector becomes whole numbers (1024 times a component, rounded down) and is
cut into equal parts; a part position has a codebook of up to 256 entries. A
round assigns every part to its nearest entry and moves entries to the means.

Between rounds each part keeps one upper bound of the distance to its entry and
one lower bound of the distance to any other entry, in the table that the round
writes. After entries have moved, the bounds move by as much as entries did at
most. A part is left alone while its upper bound is strictly under its lower
bound, or under half the distance from its entry to the nearest other one;
otherwise the upper bound is made exact, and only if that does not help either
all entries are scanned, in integers, the first of equally near ones winning.
Bounds are doubles that are widened after each operation, so they never promise
more than is so; everything that is returned is computed in integers.

Codebooks (entries x dimension numbers) are all that the driver holds. Sums of a
task are summed up in the task before they are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch

#: Components are multiplied by this and rounded down.
SCALE = 1024
#: Equal consecutive parts of a vector, entries of a codebook, rounds.
PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Largest whole number of a component: squared distances of 2^13 components of this size still fit in a long.
LARGEST = 1 << 24
#: Parts that are scanned at once: bounds the table of distances of a task (2 MB with 256 entries).
BLOCK = 1024

_WIDER, _NARROWER = 1 + 1e-9, 1 - 1e-9


@dataclass(frozen=True)
class Codebooks:
    """entries[p] holds the entries of part p, a row each."""

    entries: tuple[np.ndarray, ...]

    @property
    def sha256(self) -> str:
        """Of all components in decimal, by part, entry and position, with commas between them."""
        return hashlib.sha256(",".join(str(v) for e in self.entries for v in e.ravel().tolist()).encode()).hexdigest()


def whole_vectors(df: DataFrame, vector: str = "embedding", parts: int = PARTS) -> DataFrame:
    """(vec_id, label, x): vectors as whole numbers. Rows go whose vector is null, empty, no multiple of the parts long, or
    holds a null or a component that is not finite; a label that the table lacks is null. Repeated rows all stay."""
    e = F.col(vector)
    fine = F.forall(e, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf"))), F.lit(False)))
    label = F.col("label") if "label" in df.columns else F.lit(None).cast("int")
    whole = F.transform(e, lambda c: F.floor(c.cast("double") * SCALE).cast("bigint"))
    kept = (F.size(e) > 0) & (F.size(e) % parts == 0) & fine
    return df.where(F.coalesce(kept, F.lit(False))).select("vec_id", label.alias("label"), whole.alias("x"))


def _first(rows: DataFrame, parts: int, entries: int) -> Codebooks:
    """The parts of the vectors with the smallest ids, ascending, null last; of equal ids the smaller vector first."""
    start = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    x = np.array([r["x"] for r in start], dtype=np.int64)
    return Codebooks(tuple(np.ascontiguousarray(p) for p in np.split(x, parts, axis=1)))


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all entries, exact: in doubles while every sum is under 2^53, else in integers."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    a, b = (x.astype(np.float64), entries.astype(np.float64)) if 4 * most * most * x.shape[1] < 2**53 else (x, entries)
    d = (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]
    return d.astype(np.int64)


def _own(x: np.ndarray, entries: np.ndarray, code: np.ndarray) -> np.ndarray:
    d = x - entries[code]
    return (d * d).sum(1)


def scan(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, upper, lower) of each row by all entries: the nearest, the first of equally near ones, and both bounds."""
    code, upper, lower = np.empty(len(x), np.int64), np.empty(len(x)), np.empty(len(x))
    for at in range(0, len(x), BLOCK):
        cut = slice(at, at + BLOCK)
        d = squared(x[cut], entries)
        code[cut] = c = d.argmin(1)
        rows = np.arange(len(c))
        upper[cut] = np.sqrt(d[rows, c]) * _WIDER
        d[rows, c] = np.iinfo(np.int64).max
        lower[cut] = np.sqrt(d.min(1)) * _NARROWER
    return code, upper, lower


@dataclass(frozen=True)
class Moved:
    """How far entries of a part went, the two longest ways, and half of each entry's distance to the nearest other one."""

    way: np.ndarray
    longest: int
    most: float
    second: float
    half: np.ndarray

    @staticmethod
    def between(old: np.ndarray, new: np.ndarray) -> Moved:
        way = np.sqrt(_own(new, old, np.arange(len(old)))) * _WIDER
        order = np.argsort(way)
        gaps = squared(new, new)
        np.fill_diagonal(gaps, np.iinfo(np.int64).max)
        return Moved(way, int(order[-1]), float(way[order[-1]]), float(way[order[-2]]) if len(way) > 1 else 0.0, np.sqrt(gaps.min(1)) / 2 * _NARROWER)


def reassign(x: np.ndarray, entries: np.ndarray, moved: Moved, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(code, upper, lower, rows scanned) after entries moved. Rows whose bounds are strictly apart keep their code."""
    upper = (upper + moved.way[code]) * _WIDER
    lower = (lower - np.where(code == moved.longest, moved.second, moved.most) * _WIDER) * _NARROWER
    lower = np.where(lower > 0, lower, 0.0)
    bound = np.maximum(lower, moved.half[code])
    open_ = np.flatnonzero(~(upper < bound))
    upper[open_] = np.sqrt(_own(x[open_], entries, code[open_])) * _WIDER
    open_ = open_[~(upper[open_] < bound[open_])]
    if len(open_):
        code[open_], upper[open_], lower[open_] = scan(x[open_], entries)
    return code, upper, lower, len(open_)


_STATE = "code array<int>, upper array<double>, lower array<double>"


def _matrix(column: pa.Array, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1) if len(column) else np.empty((0, 0), kind)


def _lists(m: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1], pa.int32()), pa.array(m.ravel(), kind))


def _assign(rows: DataFrame, books: Codebooks, before: Codebooks | None, final: bool = False) -> DataFrame:
    """rows with code, upper and lower; the last time with vec_id, label, code and error alone."""
    held = rows.sparkSession.sparkContext.broadcast((books, before))
    columns = ["vec_id", "label"] if final else ["vec_id", "label", "x"]
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, before = held.value
        moved = before and [Moved.between(a, b) for a, b in zip(before.entries, books.entries, strict=True)]
        for b in batches:
            if not b.num_rows:
                continue
            x = np.split(_matrix(b.column("x"), np.int64), len(books.entries), axis=1)
            if moved:
                code, upper, lower = (_matrix(b.column(c), k) for c, k in (("code", np.int64), ("upper", float), ("lower", float)))
                found = [reassign(x[p], e, moved[p], code[:, p].copy(), upper[:, p], lower[:, p])[:3] for p, e in enumerate(books.entries)]
            else:
                found = [scan(x[p], e) for p, e in enumerate(books.entries)]
            code, upper, lower = (np.stack(c, axis=1) for c in zip(*found, strict=True))
            kept = [b.column(c) for c in columns]
            if final:
                error = sum(_own(x[p], e, code[:, p]) for p, e in enumerate(books.entries))
                text = pa.array(["".join(f"{v:02x}" for v in r) for r in code.tolist()], pa.string())
                yield pa.RecordBatch.from_arrays([*kept, text, pa.array(error, pa.int64())], [*columns, "code", "error"])
            else:
                new = [_lists(code, pa.int32()), _lists(upper, pa.float64()), _lists(lower, pa.float64())]
                yield pa.RecordBatch.from_arrays([*kept, *new], [*columns, "code", "upper", "lower"])

    return rows.mapInArrow(run, f"{kinds}, code string, error bigint" if final else f"{kinds}, {_STATE}")


def _means(rows: DataFrame, books: Codebooks) -> Codebooks:
    """Every entry at the mean of its parts, rounded down; an entry without parts stays."""
    sizes = [e.shape for e in books.entries]
    width = sizes[0][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(s, np.int64) for s in sizes]
        counts = [np.zeros(s[0], np.int64) for s in sizes]
        for b in batches:
            if b.num_rows:
                code = _matrix(b.column("code"), np.int64)
                for p, x in enumerate(np.split(_matrix(b.column("x"), np.int64), len(sizes), axis=1)):
                    order = np.argsort(code[:, p], kind="stable")
                    used, at = np.unique(code[order, p], return_index=True)
                    sums[p][used] += np.add.reduceat(x[order], at, axis=0)
                    counts[p] += np.bincount(code[:, p], minlength=len(counts[p]))
        for p, s in enumerate(sums):
            used = np.flatnonzero(counts[p])
            if len(used):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), p), pa.int32()), pa.array(used, pa.int32()), pa.array(counts[p][used], pa.int64()), _lists(s[used], pa.int64())], ["part", "entry", "n", "sums"])

    partial = rows.select("x", "code").mapInArrow(run, "part int, entry int, n bigint, sums array<bigint>")
    total = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[k]) for k in range(width)]).alias("sums"))
    new = [e.copy() for e in books.entries]
    for r in total.collect():  # at most parts x entries rows
        new[r["part"]][r["entry"]] = np.array(r["sums"], np.int64) // r["n"]
    return Codebooks(tuple(new))


def product_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks]:
    """(vec_id, label, code, error) of all vectors (vec_id, label, x) of whole numbers, and the codebooks.

    Entries start as the parts of the vectors with the smallest ids, of which there may be fewer than entries. Repeated
    rows are coded each and weigh as often. An empty table gives an empty one and codebooks without entries. Vectors of
    different lengths, and components over ``LARGEST``, are an error.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two digits, so there are 1 to 256 entries")
    scratch = Scratch(vectors.sparkSession)
    now = scratch.write(vectors.select("vec_id", "label", "x"))
    widest = F.greatest(F.abs(F.array_max("x")), F.abs(F.array_min("x")))
    seen = now.agg(F.min(F.size("x")).alias("short"), F.max(F.size("x")).alias("long"), F.max(widest).alias("widest")).first()
    if seen["short"] is None:
        return now.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error")), Codebooks(())
    if seen["short"] != seen["long"]:
        raise ValueError(f"vectors are {seen['short']} to {seen['long']} long")
    if seen["widest"] > LARGEST or seen["long"] > 1 << 13:
        raise ValueError(f"components over {LARGEST // SCALE} in size, or over {1 << 13} of them: distances may exceed a long")
    books, before = _first(now, parts, entries), None
    for _ in range(rounds):
        after = scratch.write(_assign(now, books, before))
        scratch.drop(now)
        now, before, books = after, books, _means(after, books)
    out = scratch.write(_assign(now, books, before, final=True))
    scratch.drop(now)
    return out, books


def with_label_error(coded: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256): label_error is the error of all rows of the label, nulls being
    one label. Errors are summed up in each task first; a label that many rows share is split by adaptive execution."""
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    same: Column = F.col("a.label").eqNullSafe(F.col("b.label"))
    return coded.alias("a").join(sums.alias("b"), same).select("vec_id", "code", "error", "label_error", F.lit(books.sha256).alias("codebooks_sha256"))


def decoded(coded: DataFrame, books: Codebooks) -> DataFrame:
    """coded with ``decoded``, the vector of floats that its code stands for: lower ends of steps of 1 / 1024."""
    held = coded.sparkSession.sparkContext.broadcast(books)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in coded.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = held.value.entries
        for b in batches:
            if b.num_rows:
                code = np.array([list(bytes.fromhex(c)) for c in b.column("code").to_pylist()])
                x = np.concatenate([e[code[:, p]] for p, e in enumerate(entries)], axis=1) / SCALE
                yield pa.RecordBatch.from_arrays([*b.columns, _lists(x, pa.float64())], [*b.schema.names, "decoded"])

    return coded.mapInArrow(run, f"{kinds}, decoded array<double>")
