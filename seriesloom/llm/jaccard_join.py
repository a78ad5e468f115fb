"""Similarity self-join of documents on word n-grams, by PartEnum signatures.

A document's set is its distinct runs of ``size`` words (A-Z lower-cased, split
at ASCII white space), or its whole word sequence if that is shorter. Two
documents link when 100 |A and B| >= ``percent`` |A or B|.

Sizes are cut into bands so narrow that linked sets lie in one band or in two
next to each other; a set signs for its own band and the next. In a band of
sizes up to r, linked sets differ in at most k = 2r(100 - percent)/(100 +
percent) elements. The domain of elements is dealt into parts of three cells, and
each choice of two cells of a part is a signature: the elements of both. A part
with differences in x cells has 2 - x choices or more without them (3, 1 or none),
so 2 parts - k choices at least are equal, wherever the k differences lie. A
choice of two empty cells would be the same for unrelated sets and signs nothing:
a set with m = 2 parts - k or more of them signs again, dealt anew. If all equal
choices of two linked sets are empty, both sets sign again, so they share a
signature in the end. The number of parts is the one with the fewest signatures
to be expected. A band without differences (k = 0) needs no signature: its linked
sets are equal.

Sets of equal elements are one item, named by a 64-bit hash of the set; copies
are never paired. Parity bitmaps of the elements, 512 bits and for large sets more,
bound the difference of two sets from below, so that only likely pairs are
checked on the sets.
Null and empty texts have no set and link with nothing. A row with a null id
links as any other; a group's component is its smallest id that is not null, and
null if it has none. Rows that share an id count one by one, each with its own
text. Very long texts are sets like others. Columns other than id and text, of any
name, are not looked at, and an empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linking import link_groups, small
from .shared import Scratch, quoted
from .text import WordHashes, mix, shingle_hashes, space_words

SIZE = 3
PERCENT = 90
#: Cells of a part; a signature leaves out one of them.
CELLS = 3
_LONGS = 8
#: Sets with more elements have a wider bitmap too, of so many longs: the other one is full by then.
_WIDER = ((2000, 64), (600, 16))
_HASHES = WordHashes()


def element_set(text: str | None, size: int = SIZE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    return np.unique(shingle_hashes(_HASHES.of(space_words(text)), size))


def set_name(elements: np.ndarray) -> int:
    """A signed 64-bit hash of the whole set."""
    return int(mix(mix(elements ^ np.uint64(0xA0761D6478BD642F)).sum(keepdims=True) + np.uint64(len(elements))).view(np.int64)[0])


def parity_bits(elements: np.ndarray, longs: int = _LONGS) -> np.ndarray:
    """That many times 64 bits; a bit is the parity of the elements that fall on it."""
    odd = np.bincount((mix(elements ^ np.uint64(0x8BB84B93962EACC9)) % np.uint64(64 * longs)).astype(np.int64), minlength=64 * longs) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def bands(largest: int, percent: int = PERCENT) -> np.ndarray:
    """Last sizes of the bands, through the one after that of the largest size."""
    ends, first = [], 1
    while not ends or len(ends) < 2 or ends[-2] < largest:
        ends.append(first * 100 // percent)
        first = ends[-1] + 1
    return np.array(ends, dtype=np.int64)


@cache
def scheme(band: int, percent: int) -> tuple[int, int, int]:
    """(k, parts, m) of a band: the differences of linked sets, and the choices of cells that are equal at least."""
    first = 1
    for _ in range(band):
        first = first * 100 // percent + 1
    k = 2 * (first * 100 // percent) * (100 - percent) // (100 + percent)
    if k == 0:
        return 0, 0, 0
    least = max(1, -(-first * percent // 100))  # the smallest set that signs for the band
    best = (math.inf, 0, 0)
    for parts in range(k // 2 + 1, 2 * k + 12, max(1, k // 64)):
        choices, m = CELLS * parts, 2 * parts - k
        mean = choices * (1 - (CELLS - 1) / choices) ** least
        # the chance of fewer than m empty choices, as of a Poisson variable
        if mean < 30:
            fine = sum(math.exp(-mean) * mean**j / math.factorial(j) for j in range(m)) if m <= 150 else 1.0
        else:
            fine = 0.5 * math.erfc((mean - m + 0.5) / math.sqrt(2 * mean))
        best = min(best, (choices / max(fine, 1e-9), parts, m))
    return k, best[1], best[2]


def signatures(sets: list[np.ndarray], percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """(place of the set, signature) of all signatures of all sets, for its own and the next band."""
    if percent < 70:
        raise ValueError("under 70 percent, sets have too few common elements for the cells that differences leave")
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    places, out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if not sizes.sum():
        return places[0], out[0]
    ends = bands(int(sizes.max()), percent)
    own = np.searchsorted(ends, sizes)
    plans = np.array([scheme(b, percent) for b in range(int(own.max()) + 2)], dtype=np.int64)
    for step in (0, 1):
        band = own + step
        k, parts, equal = plans[band].T
        # the next band starts after the end of its own
        left = np.flatnonzero((sizes > 0) & (k > 0) & ((step == 0) | (sizes * 100 >= (ends[own] + 1) * percent)))
        deal = 0
        while len(left):
            size, n = sizes[left], CELLS * parts[left]
            seed = mix(band[left].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(deal))
            h = mix(np.concatenate([sets[i] for i in left]) ^ np.repeat(seed, size))
            begin = np.cumsum(n) - n
            at = np.repeat(begin, size) + ((h >> np.uint64(32)) * np.repeat(n, size).astype(np.uint64) >> np.uint64(32)).astype(np.int64)
            g = mix(h + np.uint64(0x5BE0CD19137E2179))
            low, high = (np.bincount(at, (x & np.uint64(0xFFFFFFFF)).astype(float), int(n.sum())).astype(np.uint64) for x in (g, g >> np.uint64(32)))
            # what a part holds without one of its cells
            low, high, held = ((x.reshape(-1, CELLS).sum(axis=1, keepdims=True) - x.reshape(-1, CELLS)).ravel() for x in (low, high, np.bincount(at, minlength=int(n.sum()))))
            full = np.flatnonzero(held)
            of = np.searchsorted(begin, full, side="right") - 1
            number = (full - begin[of]).astype(np.uint64)
            out.append(mix(mix(low[full] + number * np.uint64(0x9FB21C651E98DF25)) + mix(high[full] ^ seed[of])).view(np.int64))
            places.append(left[of])
            left = left[n - np.bincount(of, minlength=len(left)) >= equal[left]]
            deal += 1
    return np.concatenate(places), np.concatenate(out)


def _described(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, mark, id, n, bits, wide): mark is the text's hash; id null for documents without a set; bits where a task
    meets a set first, unless it forgot the set meanwhile, and wide for those of them that are large."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            sets = [element_set(t, size) for t in b.column(1).to_pylist()]
            names = [set_name(s) if len(s) else None for s in sets]
            bits, wide = [], []
            for s, name in zip(sets, names, strict=True):
                new = name is not None and name not in seen
                if new:
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add(name)
                longs = next((k for least, k in _WIDER if len(s) > least), 0)
                bits.append(parity_bits(s) if new else None)
                wide.append(parity_bits(s, longs) if new and longs else None)
            columns = [b.column(0), b.column(2), pa.array(names, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(bits, pa.list_(pa.int64())), pa.array(wide, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "id", "n", "bits", "wide"])

    return docs.select(F.col(quoted(id_col)), F.col(quoted(text_col)), F.xxhash64(quoted(text_col))).mapInArrow(run, f"doc_id {kind}, mark bigint, id bigint, n bigint, bits array<bigint>, wide array<bigint>")


def _keyed(docs: DataFrame, size: int, percent: int, text_col: str) -> DataFrame:
    """(key, id): the signatures of each set that a task meets, once unless it forgot the set meanwhile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            sets, names = [], []
            for t in b.column(0).to_pylist():
                s = element_set(t, size)
                if len(s) and (name := set_name(s)) not in seen:
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add(name)
                    sets.append(s)
                    names.append(name)
            for k in range(0, len(sets), 500):
                place, sig = signatures(sets[k : k + 500], percent)
                yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(np.array(names[k : k + 500], dtype=np.int64)[place])], ["key", "id"])

    return docs.select(F.col(quoted(text_col))).mapInArrow(run, "key bigint, id bigint")


def _sets_of(docs: DataFrame, wanted: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """(id, elements) of wanted (id, doc), from the document doc; from documents without id where doc is null."""
    docs = docs.select(F.col(quoted(id_col)).alias("doc"), F.col(quoted(text_col)).alias("text"))
    texts = docs.join(small(wanted.where("doc is not null").select("doc").distinct()), "doc", "left_semi").select("text")
    if wanted.where("doc is null").limit(1).count():
        texts = texts.unionByName(docs.where("doc is null").select("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [s for t in b.column(0).to_pylist() if len(s := element_set(t, size))]
            ends = np.cumsum([0, *[len(s) for s in sets]]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([set_name(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["id", "elements"])

    return texts.mapInArrow(run, "id bigint, elements array<bigint>").join(small(wanted.select("id")), "id", "left_semi").dropDuplicates(["id"])


def _components(docs: DataFrame, size: int, percent: int, id_col: str, text_col: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Written: (doc_id, mark, id, n, ...) of every row, and (id, root) of the sets that link with others."""
    described = scratch.write(_described(docs, size, id_col, text_col))
    reps = scratch.write(described.where("id is not null").groupBy("id").agg(F.min("doc_id").alias("doc")))

    def features(ids: DataFrame) -> DataFrame:
        return described.where("bits is not null").join(ids, "id").dropDuplicates(["id"]).select("id", "n", "bits", "wide")

    def may_link(left, right):
        def differing(name: str, longs: int):
            return sum((F.bit_count(left(name)[k].bitwiseXOR(right(name)[k])) for k in range(longs)), F.lit(0))

        limit = (left("n") + right("n")) * (100 - percent)
        few = differing("bits", _LONGS)
        for _, k in _WIDER:  # bitmaps of one size; a missing one has the size -1 or null
            few = F.when((F.size(left("wide")) == k) & (F.size(right("wide")) == k), differing("wide", k)).otherwise(few)
        return (F.least(left("n"), right("n")) * 100 >= F.greatest(left("n"), right("n")) * percent) & (few * (100 + percent) <= limit)

    def verify(pairs: DataFrame, _: DataFrame) -> DataFrame:
        wanted = scratch.write(reps.join(small(scratch.write(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())), "id"))
        sets = scratch.write(_sets_of(docs, wanted, size, id_col, text_col))
        both = pairs.join(sets.select(F.col("id").alias("a"), F.col("elements").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("elements").alias("y")), "b")
        common = F.size(F.array_intersect("x", "y"))
        return both.where(common * 100 >= (F.size("x") + F.size("y") - common) * percent).select("a", "b")

    return described, scratch.write(link_groups(_keyed(docs, size, percent, text_col), features, may_link, verify, width=192))


def jaccard_components(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id): the smallest doc_id that links reach, itself included."""
    scratch = Scratch(docs.sparkSession)
    described, groups = _components(docs, size, percent, id_col, text_col, scratch)
    each = described.where("id is not null").groupBy("id").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    linked = each.join(small(groups), "id", "left").where("root is not null or copies > 1").select("id", "least", F.coalesce("root", "id").alias("root"))
    linked = scratch.write(linked)
    lowest = scratch.write(linked.groupBy("root").agg(F.min("least").alias("component_id")))
    component = scratch.write(linked.join(small(lowest), "root").select("id", "component_id"))
    out = described.join(small(component), "id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def drop_near_copies(docs: DataFrame, size: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of linked rows stays, with all its columns: of the smallest id (null last), and of the smallest
    hash of a text where rows of one group share that id. Of equal rows of that id and text one stays. Rows without a
    set all stay."""
    scratch = Scratch(docs.sparkSession)
    described, groups = _components(docs, size, percent, id_col, text_col, scratch)
    # Equal rows first become one, so that no large group of copies meets in one task.
    places = described.where("id is not null").groupBy("id", "doc_id", "mark").agg(F.count(F.lit(1)).alias("times"))
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark")
    rooted = scratch.write(places.join(small(groups), "id", "left").select(F.coalesce("root", "id").alias("root"), "times", rank.alias("row")))
    kept = rooted.groupBy("root").agg(F.min("row").alias("kept"), F.count(F.lit(1)).alias("rows"))
    several = scratch.write(kept.where("rows > 1").select("root", "kept"))
    gone = scratch.write(rooted.join(small(several, width=48), "root").where("row != kept").select(F.col("row.doc_id").alias("_doc"), F.col("row.mark").alias("_mark")))
    stay = rooted.join(small(several, width=48), "root", "left").where("times > 1 and (kept is null or row = kept)")
    again = scratch.write(stay.select(F.col("row.doc_id").alias("_doc"), F.col("row.mark").alias("_mark")))

    row = F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row")  # names cannot clash in a struct
    whole = docs.select(row, F.col(quoted(id_col)).alias("doc"), F.xxhash64(quoted(text_col)).alias("mark"))
    same = F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("mark") == F.col("_mark"))
    left = whole.join(small(gone), same, "left_anti")
    if again.limit(1).count():
        repeated = left.join(small(again), same, "left_semi").dropDuplicates(["doc", "mark"])
        left = left.join(small(again), same, "left_anti").unionByName(repeated)
    return left.select(*[F.col("row")[c].alias(c) for c in docs.columns])
