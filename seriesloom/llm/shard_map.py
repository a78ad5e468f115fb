"""Shards by jump consistent hashing: a key and a number of shards give the shard; no ring table is kept.

A key's 64-bit state starts as the first half of the MD5 digest of the key's
text. Each step multiplies the state by a fixed factor modulo 2^64, adds one and
jumps to the next number of shards at which the key would move; the last jump
before the number asked for is the shard. So a further shard takes each row with
probability 1 / (shards + 1), and rows move to the new shard only.

All of it is column expressions. The product modulo 2^64 is put together from
halves, because a long that overflows is an error in ANSI mode.

Slots number the rows of a shard from 0 without gaps. A shard is never sorted as
a whole: its rows fall in ``BUCKETS`` buckets by a hash of all their values, rows
are numbered inside a bucket, and a bucket starts where the counts of those
before it end. Equal rows are counted before anything is shuffled and dealt out
again at the end, so a row repeated any number of times is one row on the way.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import quoted

#: Fixed value: the multiplier of the state.
FACTOR = 2862933555777941757
#: Buckets of a shard, a power of two of at most 65,536. A bucket is what one task sorts at once; the table of their
#: counts has shards x buckets rows.
BUCKETS = 1024
#: Steps that every key may take before the rest is taken only by keys that need it: keys take ln(shards) + 0.6 on average.
STEPS = 32

_LOW = (1 << 32) - 1


def key_text(*keys: Column) -> Column:
    """The text that a key is hashed by; a missing key is the empty text."""
    return F.concat_ws(",", *[k.cast("string") for k in keys])


def _digits(text: Column, at: int, n: int) -> Column:
    """n hexadecimal digits from a place (from 1) of a digest, as a number."""
    return F.conv(F.substring(text, at, n), 16, 10).cast("bigint")


def _next(hi: Column, lo: Column) -> tuple[Column, Column]:
    """Both halves of (hi * 2^32 + lo) * FACTOR + 1 modulo 2^64; no product here exceeds a long."""
    top, mid, low = FACTOR >> 32, FACTOR >> 16 & 0xFFFF, FACTOR & 0xFFFF
    b = lo * mid
    t = lo * low + F.shiftleft(b.bitwiseAND(0xFFFF), 16) + 1
    h = F.shiftright(t, 32) + F.shiftright(b, 16) + hi * low + F.shiftleft((hi * mid).bitwiseAND(0xFFFF), 16) + (lo * top).bitwiseAND(_LOW)
    return h.bitwiseAND(_LOW), t.bitwiseAND(_LOW)


def _jump(s: Column, shards: int) -> Column:
    """One step of the state (b, j, hi, lo); a state whose j reached the number of shards stays."""
    hi, lo = _next(s["hi"], s["lo"])
    at = F.floor((s["j"] + 1).cast("double") * (F.lit(2.0**31) / (F.shiftright(hi, 1) + 1).cast("double")))
    return F.when(s["j"] < shards, F.struct(s["j"].alias("b"), at.cast("bigint").alias("j"), hi.alias("hi"), lo.alias("lo"))).otherwise(s)


def jump_shard(key: Column, shards: int) -> Column:
    """The shard, from 0, of a key given as text."""
    if shards < 1:
        raise ValueError("there has to be a shard")
    digest = F.md5(key)
    zero = F.lit(0).cast("bigint")
    start = F.struct(zero.alias("b"), zero.alias("j"), _digits(digest, 1, 8).alias("hi"), _digits(digest, 9, 8).alias("lo"))
    steps = min(shards, STEPS)
    state = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, lambda s, _: _jump(s, shards))
    if shards > steps:  # each step is a jump of one or more, so this many steps always suffice
        more = F.aggregate(F.sequence(F.lit(steps + 1), F.lit(shards)), state, lambda s, _: _jump(s, shards))
        return F.when(state["j"] >= shards, state["b"]).otherwise(more["b"]).cast("int")
    return state["b"].cast("int")


def assign_shards(df: DataFrame, keys: Sequence[str] = ("doc_id",), shards: int = 8, carry: Sequence[str] = (), shard_as: str = "shard", slot_as: str = "slot", grown_as: str = "grown_shard") -> DataFrame:
    """The key and carried columns of every row with its shard, its slot in the shard and its shard if there were one more.

    Keys of a null are those of the empty text; rows that share a key share a shard, whatever else they hold. Equal rows
    get a slot each. Slots follow (bucket, keys, carried columns), nulls first, and do not depend on how the input is
    split. Other columns, of any name, are left out; an empty table gives an empty one.
    """
    names = [*dict.fromkeys([*keys, *carry])]
    plain = df.select(*[F.col(quoted(c)).alias(f"c{k}") for k, c in enumerate(names)])
    own = [f"c{k}" for k in range(len(names))]
    rows = plain.groupBy(*own).agg(F.count(F.lit(1)).alias("n"))
    key = key_text(*[F.col(f"c{names.index(k)}") for k in keys])
    spread = _digits(F.md5(key_text(*map(F.col, own))), 1, 4) % BUCKETS
    never = F.lit(0)  # no text lacks a digest: said so, the counts of buckets read the same shuffle as the rows
    rows = rows.withColumns({"shard": F.coalesce(jump_shard(key, shards), never), "grown": jump_shard(key, shards + 1), "bucket": F.coalesce(spread, never)})
    within = Window.partitionBy("shard", "bucket").orderBy(*[F.col(c).asc_nulls_first() for c in own])
    rows = rows.withColumn("end", F.sum("n").over(within))
    # shards x BUCKETS rows at most, of two short columns: the running sum of a shard is over its buckets only
    sizes = rows.groupBy("shard", "bucket").agg(F.sum("n").alias("held"))
    before = F.sum("held").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("held")
    starts = sizes.select("shard", "bucket", before.alias("before"))
    starts = F.broadcast(starts) if shards * BUCKETS <= 1_000_000 else starts
    placed = rows.join(starts, ["shard", "bucket"]).withColumn("first", F.col("before") + F.col("end") - F.col("n"))
    slots = placed.withColumn("slot", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)))
    return slots.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(names)], F.col("shard").alias(shard_as), F.col("slot").alias(slot_as), F.col("grown").alias(grown_as))


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of documents sharded by doc_id.

    size is the UTF-8 bytes of the text and one; a null text has none, and the checksum of none. A null id is a key of
    its own. Texts are read once and do not travel.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text).cast("bigint") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = assign_shards(rows, ["doc_id"], shards, ["size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def write_shards(df: DataFrame, path: str, keys: Sequence[str] = ("doc_id",), shards: int = 8, files: int = 1) -> None:
    """Writes whole rows to one folder for each shard (``shard=k``), in ``files`` files each, without a pass to number them.

    A shard's rows are dealt to its files by a hash of all their keys, so no task writes more than its share.
    """
    if "shard" in (c.lower() for c in df.columns):
        raise ValueError("the table has a column that is called shard")
    key = key_text(*[F.col(quoted(k)) for k in keys])
    part = (_digits(F.md5(key), 17, 4) % files).alias("_file")
    df.withColumn("shard", jump_shard(key, shards)).repartition(shards * files, "shard", part).write.partitionBy("shard").parquet(path)


def taken_by_next(spark: SparkSession, path: str, keys: Sequence[str] = ("doc_id",), shards: int = 8) -> DataFrame:
    """The rows of a written folder that a further shard takes, with the shard each leaves (``shard``): shard ``shards`` of
    the new layout holds exactly these, and no other row moves."""
    key = key_text(*[F.col(quoted(k)) for k in keys])
    return spark.read.parquet(path).where(jump_shard(key, shards + 1) == shards)
