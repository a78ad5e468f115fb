"""Benchmark decontamination by one Aho-Corasick automaton.

Item texts are normalised to words (A-Z lower-cased, runs of letters, digits and
non-ASCII characters). Their windows of ``window`` consecutive words, or the
whole item if it is shorter, are the patterns. A document is normalised the same
way and scanned once; the end of every match is mapped back to word numbers, and
those to character offsets in the original text.

There is one automaton, whose windows come through the driver. Of a benchmark of
more than ``BENCHMARK_BYTES`` of text the windows are dealt to blocks of at most
that size by their hash; each block is an automaton and a scan, and the words and
items that the scans find in a text are united, so the result is that of one
automaton. Items and documents without words match nothing, nor does anything match
an empty benchmark. Null texts have no words; texts are scanned whole, however long.
Repeated items with equal ids count once; an item without id is found in the words,
but is none of the item ids. Repeated documents have a row each; other columns, of
any name, are not looked at; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, kept_by_text, quoted
from .text import alnum_words

WINDOW = 10
#: Text of a benchmark whose windows make one automaton: they take some fifty times that in the driver and in a worker.
BENCHMARK_BYTES = 8_000_000
_ORIGINAL = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


class WindowScanner:
    """The automaton over the windows of items; ``scan(words)`` gives (mask of hit words, set of item ids)."""

    def __init__(self, patterns: list[tuple[bytes, list]]):
        self.automaton = ahocorasick.Automaton()
        for text, items in patterns:
            # words with a space on each side; Latin-1 keeps one character for one byte
            self.automaton.add_word((b" " + text + b" ").decode("latin-1"), (text.count(b" ") + 1, tuple(items)))
        if patterns:
            self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[np.ndarray | None, set]:
        if not words or not len(self.automaton):
            return None, set()
        line = b" " + b" ".join(words) + b" "
        text = line.decode("latin-1")
        spans, items = [], set()
        for end, (n, ids) in self.automaton.iter(text):
            spans.append((end, n))
            items.update(ids)
        if not spans:
            return None, items
        # the word that ends before the space at ``end`` has as many spaces before it as its number
        after = np.cumsum(np.frombuffer(line, dtype=np.uint8) == 32) - 1
        ends, sizes = np.array(spans, dtype=np.int64).T
        stop = after[ends]
        edges = np.zeros(len(words) + 1, dtype=np.int64)
        np.add.at(edges, stop - sizes, 1)
        np.add.at(edges, stop, -1)
        return np.cumsum(edges)[:-1] > 0, items


def windows(items: list[tuple[object, str | None]], window: int = WINDOW) -> list[tuple[bytes, list]]:
    """Distinct windows of the items with the ids of the items that have them, in a fixed order."""
    found: dict[bytes, set] = {}
    for key, text in items:
        w = alnum_words(text)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            found.setdefault(b" ".join(w[k : k + window]), set()).update([] if key is None else [key])
    return [(k, sorted(v, key=str)) for k, v in sorted(found.items())]


_SCANNERS: dict[str, WindowScanner] = {}


def _scanner(key: str, patterns) -> WindowScanner:
    """One scanner per worker and benchmark."""
    if key not in _SCANNERS:
        _SCANNERS.clear()
        _SCANNERS[key] = WindowScanner(patterns.value)
    return _SCANNERS[key]


def _size(benchmark: DataFrame, text_col: str) -> int:
    return benchmark.agg(F.coalesce(F.sum(F.octet_length(quoted(text_col))), F.lit(0))).first()[0]


def _broadcast(rows: list[tuple[bytes, list]], window: int, spark) -> tuple[str, object]:
    return hashlib.sha256(repr((window, rows)).encode()).hexdigest(), spark.sparkContext.broadcast(rows)


def _patterns(benchmark: DataFrame, window: int, item_col: str, text_col: str):
    """The windows as a broadcast variable. The benchmark is the stated query set: a table of questions, not of documents;
    its size is checked before it comes to the driver."""
    rows = windows([tuple(r) for r in benchmark.select(quoted(item_col), quoted(text_col)).collect()], window)
    return _broadcast(rows, window, benchmark.sparkSession)


def _found_by_blocks(docs: DataFrame, benchmark: DataFrame, blocks: int, window: int, text_col: str, item_col: str, item_text_col: str) -> DataFrame:
    """(mark, spans, items) of each text, named by its digest, that has a window: word spans and item ids of all blocks.

    One block at a time comes to the driver and is scanned for; what it finds is written before the next.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(text, key) for item, t in zip(*(c.to_pylist() for c in b.columns), strict=True) for text, _ in windows([(item, t)], window) for key in [None if item is None else str(item)]]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.binary(), pa.string()), strict=True)], ["window", "item"])

    cuts = benchmark.select(quoted(item_col), quoted(item_text_col)).mapInArrow(cut, "window binary, item string").distinct()
    dealt = scratch.write(cuts.withColumn("block", F.pmod(F.xxhash64("window"), F.lit(blocks)).cast("int")))
    marked = docs.select(F.sha2(quoted(text_col), 256).alias("mark"), F.col(quoted(text_col)).alias("text")).where("text is not null")
    parts = []
    for block in range(blocks):
        found: dict[bytes, list] = {}
        for r in dealt.where(F.col("block") == block).select("window", "item").toLocalIterator():
            found.setdefault(bytes(r["window"]), []).extend([] if r["item"] is None else [r["item"]])
        key, patterns = _broadcast(sorted((w, sorted(i)) for w, i in found.items()), window, spark)
        parts.append(scratch.write(marked.mapInArrow(_scan_of(key, patterns), "mark string, spans array<array<int>>, items array<string>").distinct()))
        patterns.unpersist()
    every = reduce(DataFrame.unionByName, parts)
    out = every.groupBy("mark").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    out = Scratch(spark).write(out)
    scratch.drop()
    return out


def _scan_of(key: str, patterns) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(key, patterns)
        for b in batches:
            rows = []
            for mark, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                hit, items = scanner.scan(alnum_words(text))
                if hit is not None:
                    rows.append((mark, _runs(hit).tolist(), sorted(items)))
            if rows:
                kinds = [pa.string(), pa.list_(pa.list_(pa.int32())), pa.list_(pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["mark", "spans", "items"])

    return run


def _runs(hit: np.ndarray) -> np.ndarray:
    """(first, stop) of the runs of hit words."""
    return np.flatnonzero(np.diff(np.r_[False, hit, False])).reshape(-1, 2)


_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))]
_NAMES = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"]


def _row(text: str | None, n_words: int, hit: np.ndarray | None, items) -> tuple:
    spans = []
    if hit is not None:
        at = [m.span() for m in _ORIGINAL.finditer(text)]
        spans = [{"start": at[x][0], "stop": at[y - 1][1]} for x, y in _runs(hit)]
    n = int(hit.sum()) if hit is not None else 0
    return n_words, n, len(items), hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest(), n > 0, spans


def _table(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(_KINDS)
    return pa.RecordBatch.from_arrays([ids, *[pa.array(list(c), t) for c, t in zip(columns, _KINDS, strict=True)]], _NAMES)


def contamination_report(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans.

    spans: (start, stop) character offsets in the original text of the runs of hit words.
    """
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, spans array<struct<start: int, stop: int>>"
    texts = docs.select(F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(text_col)).alias("text"))
    if (size := _size(benchmark, item_text_col)) > BENCHMARK_BYTES:
        found = _found_by_blocks(docs, benchmark, -(-size // BENCHMARK_BYTES), window, text_col, item_col, item_text_col)
        both = texts.withColumn("mark", F.sha2("text", 256)).join(found, "mark", "left").select("doc_id", "text", "spans", "items")

        def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = []
                for text, spans, items in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                    hit, n = None, len(alnum_words(text))
                    if spans:
                        hit = np.zeros(n, bool)
                        for first, stop in spans:
                            hit[first:stop] = True
                    rows.append(_row(text, n, hit, items or []))
                yield _table(b.column(0), rows)

        return both.mapInArrow(unite, schema)
    key, patterns = _patterns(benchmark, window, item_col, item_text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(key, patterns)
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                words = alnum_words(text)
                rows.append(_row(text, len(words), *scanner.scan(words)))
            yield _table(b.column(0), rows)

    return texts.mapInArrow(run, schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents in which no window of the benchmark occurs, with all their columns."""
    if (size := _size(benchmark, item_text_col)) > BENCHMARK_BYTES:
        found = _found_by_blocks(docs, benchmark, -(-size // BENCHMARK_BYTES), window, text_col, item_col, item_text_col)
        plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
        digest = F.sha2(f"c{docs.columns.index(text_col)}", 256)
        return plain.join(found.select("mark"), digest == F.col("mark"), "left_anti").toDF(*docs.columns)
    key, patterns = _patterns(benchmark, window, item_col, item_text_col)
    return kept_by_text(docs, text_col, lambda texts: [_scanner(key, patterns).scan(alnum_words(t))[0] is None for t in texts])
