"""Stupid-backoff scores of documents by joins of n-gram counts.

The counts of all n-grams of 1 to ``order`` words come from the whole corpus, as
one grouped table hashed by n-gram: every n-gram counts, however rare and however
large the corpus. A word after its context scores log(c(n-gram) / c(context)); an
n-gram that the corpus lacks backs off to the next shorter one at the price of
log(alpha), and a single word to log(c(word) / N), where a word that the corpus
lacks counts as seen once. At a document's start contexts are as long as there
are words. Words are runs of letters, digits and non-ASCII characters, A-Z
lower-cased, named by 64-bit hashes.

Where documents are scored by their own corpus no n-gram is missing, and a
document's score is a plain sum: the logarithms of the counts of its longest
n-grams, less those of the contexts inside it, less log N. Then the table
needs no n-grams that occur once, since their logarithm is 0. The most frequent
n-grams are broadcast and summed up while a document is read, so a hot key is
never shuffled: those that make up a ``HOT_KEY``-th of all words, and of the others
one in ``HOT_SHARE`` of the table, ``HOT_ROWS`` at most. Each other n-gram is a row
(n-gram, document, sign) that meets the count table in a shuffle join, on small
tables too. How much is broadcast does not change a value.

Documents without words have n_words 0 and a null score. Rows that share an id
are scored as one document, null ids too. A very long text is read whole, in one
slice. Columns other than id and text, of any name, are not looked at; an empty
table of documents gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch
from .text import WordHashes, alnum_words, mix, shingle_hashes

ORDER = 2
ALPHA = 0.4
#: Rows of the count table that are broadcast at most, of 16 bytes each, besides hot keys.
HOT_ROWS = 2_000_000
#: At most one in so many rows of the count table is broadcast, besides hot keys.
HOT_SHARE = 8
#: An n-gram with this part of all words is a hot key; there are no more than that many of each size.
HOT_KEY = 4096
#: Documents that a task scores at once.
_SLICE = 500
_HASHES = WordHashes()


def _runs(h: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first places, hashes) of the runs of so many words inside one document."""
    if len(h) < size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    inside = doc[: len(h) - size + 1] == doc[size - 1 :]
    return np.flatnonzero(inside), shingle_hashes(h, size)[inside]


def _hashed(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes of all texts, the text of each, words of each text)."""
    each = [_HASHES.of(alnum_words(t)) for t in texts]
    size = np.array([len(x) for x in each], np.int64)
    return np.concatenate([np.zeros(0, np.uint64), *each]), np.repeat(np.arange(len(each), dtype=np.int32), size), size


def count_table(corpus: DataFrame, order: int = ORDER, text_col: str = "text") -> DataFrame:
    """(size, gram, c): the hashed n-grams of 1 to ``order`` words of the whole corpus, hashed by n-gram; the n-gram of no
    word, of size 0, counts all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 8 * _SLICE):
                h, doc, _ = _hashed(b.column(0).slice(k, 8 * _SLICE).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([0], pa.int64()), pa.array([len(h)], pa.int64())], ["size", "gram", "n"])
                for size in range(1, order + 1):
                    gram, n = np.unique(_runs(h, doc, size)[1], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), size, np.int32)), pa.array(gram.view(np.int64)), pa.array(n.astype(np.int64))], ["size", "gram", "n"])

    counted = corpus.select(F.col(text_col)).mapInArrow(run, "size int, gram bigint, n bigint")
    return counted.groupBy("size", "gram").agg(F.sum("n").alias("c"))


def _hot(counts: DataFrame, total: int, rows: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(n-grams, counts, least): the n-grams with a count of least or more, sorted; hot keys, and so many other rows at most."""
    step = F.floor(4 * F.log2("c")).cast("int")
    size = {r[0]: r[1] for r in counts.where("c >= 2").groupBy(step.alias("step")).count().collect()}
    lowest, n, rows = max(size, default=0) + 1, 0, min(rows, sum(size.values()) // HOT_SHARE)
    for k in sorted(size, reverse=True):
        n += size[k]
        if n > rows:
            break
        lowest = k
    top = counts.where("c >= 2").where((step >= lowest) | (F.col("c") * HOT_KEY >= total)).select("gram", "c").toArrow()
    gram, c = (top.column(k).to_numpy() for k in (0, 1))
    at = np.argsort(gram.view(np.uint64))
    least = int(c.min()) if len(c) else np.iinfo(np.int64).max
    return gram.view(np.uint64)[at], c[at], least


def _logs(grams: np.ndarray, names: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Logarithms of the counts; 0 where the table has none."""
    if not len(names) or not len(grams):
        return np.zeros(len(grams))
    known, place = np.unique(grams, return_inverse=True)
    at = np.minimum(np.searchsorted(names, known), len(names) - 1)
    return np.where(names[at] == known, np.log(c[at].astype(float)), 0.0)[place]


def _terms(h: np.ndarray, doc: np.ndarray, size: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, n-gram, sign) of the terms of the documents' scores, but for log N.

    Written out, each context but those inside the document stands once above and once below a fraction.
    """
    begin = np.cumsum(size) - size
    at, gram = _runs(h, doc, order)
    of, grams, sign = [doc[at]], [gram], [np.ones(len(at), np.int64)]
    if order > 1:
        at, gram = _runs(h, doc, order - 1)
        inner = (at > begin[doc[at]]) & (at + order - 1 < (begin + size)[doc[at]])
        of, grams, sign = [*of, doc[at][inner]], [*grams, gram[inner]], [*sign, -np.ones(int(inner.sum()), np.int64)]
    for n in range(1, order):  # a document of so few words is one n-gram
        at, gram = _runs(h, doc, n)
        whole = size[doc[at]] == n
        of, grams, sign = [*of, doc[at][whole]], [*grams, gram[whole]], [*sign, np.ones(int(whole.sum()), np.int64)]
    return np.concatenate(of), np.concatenate(grams), np.concatenate(sign)


def _scored(docs: DataFrame, hot, total: int, order: int, id_col: str, text_col: str) -> DataFrame:
    """For each document a row (words, repeated, value) of what the broadcast n-grams settle, sign null and gram anything
    that spreads, and a row (gram, sign) for each n-gram that is not among them."""
    kind, log_n = docs.schema[id_col].dataType.simpleString(), math.log(max(total, 1))
    names = ["doc_id", "gram", "sign", "words", "repeated", "value"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_names, hot_c = hot.value
        for b in batches:
            for k in range(0, b.num_rows, _SLICE):
                part = b.slice(k, _SLICE)
                h, doc, size = _hashed(part.column(1).to_pylist())
                of, gram, sign = _terms(h, doc, size, order)
                log, n = _logs(gram, hot_names, hot_c), part.num_rows
                found = log > 0
                value = np.bincount(of, log * sign, n).astype(float) - log_n * np.where(size > 0, size if order == 1 else 1, 0)
                repeated = np.bincount(of[found & (sign > 0)], minlength=n)
                spread = mix(np.arange(n, dtype=np.uint64) + size.astype(np.uint64) * np.uint64(_SLICE))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(spread.view(np.int64)), pa.nulls(n, pa.int64()), pa.array(size), pa.array(repeated.astype(np.int64)), pa.array(value)], names)
                of, gram, sign = of[~found], gram[~found], sign[~found]
                nulls = pa.nulls(len(of), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of)), pa.array(gram.view(np.int64)), pa.array(sign), nulls, nulls, pa.nulls(len(of), pa.float64())], names)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"doc_id {kind}, gram bigint, sign bigint, words bigint, repeated bigint, value double")


def _positions(docs: DataFrame, order: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, known, g1.., x2..) of each word: the n-grams that end there and their contexts, null where the document has
    too few words before; a document without words is a row of nulls."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", "known", *[f"g{n}" for n in range(1, order + 1)], *[f"x{n}" for n in range(2, order + 1)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, _SLICE):
                part = b.slice(k, _SLICE)
                h, doc, size = _hashed(part.column(1).to_pylist())
                empty = np.flatnonzero(size == 0)
                grams, contexts = [], []
                for n in range(1, order + 1):
                    at, gram = _runs(h, doc, n)
                    for out, place in ((grams, at + n - 1), (contexts, at + n)):
                        ok = (place < len(h)) & (doc[np.minimum(place, max(len(h) - 1, 0))] == doc[at]) if len(at) else np.zeros(0, bool)
                        value, there = np.zeros(len(h) + len(empty), np.uint64), np.zeros(len(h) + len(empty), bool)
                        value[place[ok]], there[place[ok]] = gram[ok], True
                        out.append(pa.array(value.view(np.int64), mask=~there))
                ids = part.column(0).take(pa.array(np.r_[doc, empty]))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.arange(len(h) + len(empty)) < len(h)), *grams, *contexts[: order - 1]], names)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, ", ".join([f"doc_id {kind}", "known boolean", *[f"{c} bigint" for c in names[2:]]]))


def _backed_off(docs: DataFrame, counts: DataFrame, total: int, order: int, alpha: float, id_col: str, text_col: str) -> DataFrame:
    """Scores by another corpus: a left join with the counts for each size of n-grams and contexts."""
    rows = _positions(docs, order, id_col, text_col)
    for c in rows.columns[2:]:
        size = int(c[1:]) - (c[0] == "x")
        rows = rows.join(counts.where(F.col("size") == size).select(F.col("gram").alias(c), F.col("c").alias(f"c_{c}")), c, "left")
    longest = reduce(lambda a, n: F.when(F.col(f"g{n}").isNotNull(), n).otherwise(a), range(1, order + 1), F.lit(0))
    score = F.log(F.coalesce("c_g1", F.lit(1)).cast("double")) - math.log(max(total, 1)) + (longest - 1) * math.log(alpha)
    repeated = F.lit(False)
    for n in range(2, order + 1):
        here = F.log(F.col(f"c_g{n}").cast("double")) - F.log(F.col(f"c_x{n}").cast("double")) + (longest - n) * math.log(alpha)
        score = F.when(F.col(f"c_g{n}").isNotNull(), here).otherwise(score)
    for n in range(1, order + 1):
        repeated = F.when(longest == n, F.coalesce(F.col(f"c_g{n}") >= 2, F.lit(False))).otherwise(repeated)
    return rows.select("doc_id", F.col("known").cast("bigint").alias("words"), repeated.cast("bigint").alias("repeated"), F.when(F.col("known"), score).otherwise(0.0).alias("value"))


def backoff_scores(
    docs: DataFrame, corpus: DataFrame | None = None, order: int = ORDER, alpha: float = ALPHA, id_col: str = "doc_id", text_col: str = "text", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """(doc_id, n_words, n_repeated, log_score, score): n_repeated are the document's n-grams that the corpus has twice or
    more, score is the mean of the words. corpus: the documents themselves where it is None.

    hot_rows says how much of the table is broadcast at most, besides hot keys; results don't depend on it.
    """
    scratch, own = Scratch(docs.sparkSession), corpus is None
    counts = count_table(docs if own else corpus, order, text_col)
    counts = scratch.write(counts.where("size = 0 or c >= 2") if own else counts)
    total = counts.where("size = 0").agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    counts = counts.where("size > 0")
    if own:
        names, c, least = _hot(counts, total, hot_rows)
        rest = counts.where(F.col("c") < least).select("gram", "c")
        rows = _scored(docs, docs.sparkSession.sparkContext.broadcast((names, c)), total, order, id_col, text_col)
        settled = F.col("sign").isNull()
        rows = rows.join(rest, "gram", "left").where(settled | F.col("c").isNotNull())
        value = F.when(settled, F.col("value")).otherwise(F.col("sign") * F.log(F.col("c").cast("double")))
        rows = rows.select("doc_id", F.coalesce("words", F.lit(0)).alias("words"), F.coalesce("repeated", (F.col("sign") > 0).cast("bigint")).alias("repeated"), value.alias("value"))
    else:
        rows = _backed_off(docs, counts, total, order, alpha, id_col, text_col)
    sums = rows.groupBy("doc_id").agg(F.sum("words").alias("n_words"), F.sum("repeated").alias("n_repeated"), F.sum("value").alias("log_score"))
    return sums.select("doc_id", "n_words", "n_repeated", F.when(F.col("n_words") > 0, F.col("log_score")).alias("log_score"), F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")).alias("score"))
