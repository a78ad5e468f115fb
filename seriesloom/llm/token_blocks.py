"""Token ids in patched frame-of-reference blocks, written as a sharded binary table.

The ids of all documents, in ascending doc_id order, each document closed by an
end id, form one stream. It is cut into segments at document ends; a segment is
one binary value of this layout (all little-endian):

    magic "PFB1", block size u16, spare u16, ids u32, blocks u32, exceptions u32
    minimum u32[blocks]         subtracted from every id of the block
    width u8[blocks]            bits per packed id, chosen so that ``percentile`` of the block fits
    exceptions u16[blocks]      how many ids of the block do not fit
    start u32[blocks]           byte at which the block's packed ids start: the index for random access
    position u16[exceptions]    where in its block an exception stands
    value u32[exceptions]       its high bits
    packed ids                  block size x width bits, most significant bit first, whole bytes

Rows that share doc_id are ordered by a hash of their text; equal rows are
interchangeable. A null doc_id sorts first. Null and empty texts hold the end id
only; a very long text is one document of one segment. Columns other than id and
text, of any name, are not looked at, and an empty table gives an empty stream. The stream is dealt by a range of doc_id, so no task or driver holds it
whole; starts come from the sums of the shards, one row for each.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .pieces import DEFAULT_VOCABULARY, library_encoder

BLOCK = 128
PERCENTILE = 0.9
SEGMENT_IDS = 1 << 16
_HEAD = struct.Struct("<4sHHIII")


def _pack(values: np.ndarray, width: int) -> bytes:
    """Rows of values, each packed at ``width`` bits a value."""
    bits = np.unpackbits(values.astype(">u4" if width > 16 else ">u2").view(np.uint8).reshape(*values.shape, -1), axis=2)
    return np.packbits(bits[:, :, bits.shape[2] - width :].reshape(len(values), -1), axis=1).tobytes()


def _unpack(raw: np.ndarray, width: int, block: int) -> np.ndarray:
    bits = np.unpackbits(raw, axis=1)[:, : block * width].reshape(len(raw), block, width)
    size = 32 if width > 16 else 16
    wide = np.zeros((len(raw), block, size), dtype=np.uint8)
    wide[:, :, size - width :] = bits
    return np.packbits(wide, axis=2).view(f">u{size // 8}").reshape(len(raw), block).astype(np.uint32)


def pack_ids(ids: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> bytes:
    """Packs unsigned 32-bit ids; any values, any number of them."""
    ids = np.ascontiguousarray(ids, dtype=np.uint32)
    n, blocks = len(ids), -(-len(ids) // block)
    full = np.concatenate([ids, np.full(blocks * block - n, ids[-1] if n else 0, dtype=np.uint32)]).reshape(blocks, block)
    low = full.min(axis=1) if blocks else np.zeros(0, np.uint32)
    delta = full - low[:, None]
    cut = np.partition(delta, k := min(block - 1, int(np.ceil(percentile * block)) - 1), axis=1)[:, k] if blocks else low
    width = np.ceil(np.log2(cut.astype(np.float64) + 1)).astype(np.uint8)
    high = delta >> width.astype(np.uint32)[:, None] if blocks else delta
    high[width == 32] = 0
    where, position = np.nonzero(high)
    count = np.bincount(where, minlength=blocks).astype("<u2")
    lengths = -(-(width.astype(np.int64) * block) // 8)
    starts = np.cumsum(lengths) - lengths
    packed = bytearray(int(lengths.sum()))
    view = np.frombuffer(packed, dtype=np.uint8)
    kept = delta & ((np.uint64(1) << width.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)[:, None] if blocks else delta
    for w in np.unique(width[width > 0]):
        rows = np.flatnonzero(width == w)
        size = int(lengths[rows[0]])
        view[starts[rows][:, None] + np.arange(size)] = np.frombuffer(_pack(kept[rows], int(w)), np.uint8).reshape(len(rows), size)
    return b"".join([
        _HEAD.pack(b"PFB1", block, 0, n, blocks, len(where)), low.astype("<u4").tobytes(), width.tobytes(), count.tobytes(),
        starts.astype("<u4").tobytes(), position.astype("<u2").tobytes(), high[where, position].astype("<u4").tobytes(), bytes(packed),
    ])


def unpack_ids(data: bytes, only: int | None = None) -> np.ndarray:
    """All ids of a segment, or those of block ``only``, found by its start."""
    magic, block, _, n, blocks, exceptions = _HEAD.unpack_from(data)
    if magic != b"PFB1":
        raise ValueError("not a segment of token blocks")
    at = _HEAD.size
    parts = []
    for kind, k in (("<u4", blocks), ("u1", blocks), ("<u2", blocks), ("<u4", blocks), ("<u2", exceptions), ("<u4", exceptions)):
        parts.append(np.frombuffer(data, dtype=kind, count=k, offset=at))
        at += parts[-1].nbytes
    low, width, count, starts, position, value = parts
    packed = np.frombuffer(data, dtype=np.uint8, offset=at)
    chosen = np.arange(blocks) if only is None else np.array([only])
    out = np.zeros((len(chosen), block), dtype=np.uint32)
    for w in np.unique(width[chosen]):
        if w:
            rows = np.flatnonzero(width[chosen] == w)
            size = -(-int(w) * block // 8)
            out[rows] = _unpack(packed[starts[chosen[rows]].astype(np.int64)[:, None] + np.arange(size)], int(w), block)
    where = np.repeat(np.arange(blocks), count)
    mine = np.ones(len(where), dtype=bool) if only is None else where == only
    line = where[mine] if only is None else np.zeros(mine.sum(), dtype=np.int64)
    out[line, position[mine]] |= value[mine] << width[where[mine]].astype(np.uint32)
    out += low[chosen][:, None]
    return out.reshape(-1)[:n] if only is None else out[0][: n - only * block]


def write_token_blocks(
    docs: DataFrame, path: str, vocabulary: str = DEFAULT_VOCABULARY, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Encodes every text and writes segments (shard, segment, before, doc_ids, lengths, data) as Parquet under ``path``."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = library_encoder(vocabulary), int(end_id).to_bytes(4, "little")
        shard, segment = TaskContext.get().partitionId(), 0
        keys, parts, held, before = [], [], 0, 0
        names = ["shard", "segment", "before", "doc_ids", "lengths", "data"]
        id_type = None

        def row() -> pa.RecordBatch:
            data = pack_ids(np.frombuffer(b"".join(parts), dtype="<u4"))
            columns = [[shard], [segment], [before], [keys], [[len(p) // 4 for p in parts]], [data]]
            types = [pa.int32(), pa.int64(), pa.int64(), pa.list_(id_type), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        for b in batches:
            id_type = b.schema.field(0).type
            for key, ids in zip(b.column(0).to_pylist(), encoder.encode(b.column(1).to_pylist()), strict=True):
                keys.append(key)
                parts.append(ids + end)
                held += len(ids) // 4 + 1
                if held >= SEGMENT_IDS:
                    yield row()
                    segment, keys, parts, held, before = segment + 1, [], [], 0, before + held
        if keys:
            yield row()

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt.mapInArrow(run, f"shard int, segment bigint, before bigint, doc_ids array<{kind}>, lengths array<bigint>, data binary").write.parquet(path)


def read_token_blocks(spark: SparkSession, path: str, digest_only: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids array<bigint> or ids_crc32) per document, decoded from the files under ``path``.

    ``start`` counts the ids of all documents before it.
    """
    table = spark.read.parquet(path)
    kind = table.schema["doc_ids"].dataType.elementType.simpleString()
    # One row for each shard, of which there are as many as shuffle partitions: bounded, so it may be broadcast.
    sums = table.select("shard", F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n")).groupBy("shard").agg(F.sum("n").alias("n"))
    starts = sums.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                ids = unpack_ids(b.column("data")[k].as_py())
                lengths = np.array(b.column("lengths")[k].as_py(), dtype=np.int64)
                ends = np.cumsum(lengths)
                starts = ends - lengths
                if digest_only:
                    raw = ids.astype("<u4").tobytes()
                    last = pa.array([zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(starts.tolist(), ends.tolist())], pa.int64())
                else:
                    last = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(ids.astype(np.int64)))
                at = b.column("at")[k].as_py()
                yield pa.RecordBatch.from_arrays([b.column("doc_ids")[k].values, pa.array(at + starts), pa.array(lengths), last], ["doc_id", "start", "n_tokens", "ids_crc32" if digest_only else "ids"])

    placed = table.join(F.broadcast(starts), "shard").select("doc_ids", "lengths", "data", (F.col("shard_start") + F.col("before")).alias("at"))
    return placed.mapInArrow(run, f"doc_id {kind}, start bigint, n_tokens bigint, " + ("ids_crc32 bigint" if digest_only else "ids array<bigint>"))
