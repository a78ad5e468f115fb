"""Groups of similar items from shared keys, without listing the pairs inside a group.

Items that may be similar share at least one key. Two rounds find every group:

1. Each item is compared with the smallest item of each of its keys. One row per
   item and key, so a key with many items gives as many rows, not their pairs.
2. What is in one group by then needs no more comparing. Only keys whose items are
   still in different groups are joined with themselves, on items of different
   groups that pass a cheap test which no similar pair fails. This is quadratic in
   the groups that stay on one key: callers make keys that unrelated items do not
   share, and may say where in an item a key stands, so that only items that have it
   at about the same place are paired.

Both rounds drop a pair only by such a test or by the exact check, so the groups
are those of all similar pairs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch

#: Tables up to this size may be broadcast; above it, joins shuffle.
BROADCAST_BYTES = 16_000_000
#: Places of keys go to 1,023; they travel in the key's last bits.
PLACES = 1023


def small(df: DataFrame, rows: int | None = None, width: int = 16) -> DataFrame:
    """With a broadcast hint if the counted rows, of so many bytes each, are within the bound; df must be cheap to count,
    such as a written table."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n * width <= BROADCAST_BYTES else df


def connected(edges: DataFrame) -> DataFrame:
    """(id, root) for every id in the edges (a, b): root is the smallest id that links reach.

    Alternates large-star and small-star steps until nothing changes. A minimum is taken with partial sums in each task;
    the join that follows it is a plain one, so the rows of a hub are split where adaptive execution finds it skewed.
    Each round is written to the shared folder, and the round before it deleted.
    """
    scratch = Scratch(edges.sparkSession)
    now = scratch.write(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, now = now, scratch.write(low.select("u", F.col("m").alias("v")).unionByName(moved).distinct())
        scratch.drop(before)
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state or not seen[0]:
            break
        state = seen
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(roots)


def link_groups(
    keyed: DataFrame,
    features: Callable[[DataFrame], DataFrame],
    may_link: Callable[[Callable[[str], Column], Callable[[str], Column]], Column],
    verify: Callable[[DataFrame, DataFrame], DataFrame],
    hidden: tuple[str, ...] = (),
    width: int = 128,
    placed: bool = False,
) -> DataFrame:
    """(id, root) of all items in groups of two or more.

    keyed: (key, id), possibly with repeats, and with ``placed`` also place, from 1 to ``PLACES``, or 0 where a key has none. features(ids) gives (id, more columns) of a table of ids. may_link(l, r) is
    a condition on the features of two items that holds for every similar pair. verify(pairs, features) keeps the
    similar ones of distinct pairs (a, b); the columns named in hidden are for it alone. width: bytes of a
    row of the other features. The second round's may_link gets places as the feature ``at``, which is null in the first and
    where a key has no place.
    """
    scratch = Scratch(keyed.sparkSession)
    if not placed:
        dealt, place = keyed.select("key", "id").repartition("key"), []
    else:
        key, place = F.col("packed").bitwiseAND(F.lit(~PLACES)), ["place"]
        packed = keyed.select(F.col("key").bitwiseAND(F.lit(~PLACES)).bitwiseOR(F.col("place").cast("bigint")).alias("packed"), "id")
        dealt = packed.repartition(key).select(key.alias("key"), "id", F.col("packed").bitwiseAND(F.lit(PLACES)).cast("int").alias("place"))
    shared = dealt.groupBy("key").agg(F.min("id").alias("pivot"), F.max("id").alias("last")).where("pivot < last")
    # Grouping and join read the same shuffle: both need rows of a key together, and nothing else. Few keys are shared, one
    # row each, so a hash join spares sorting all rows.
    rows = scratch.write(dealt.join(shared.select("key", "pivot").hint("shuffle_hash"), "key").distinct())
    found = scratch.write(features(rows.select("id").distinct()))
    names = [c for c in found.columns if c not in ("id", *hidden)]
    count = found.count()

    def with_features(df: DataFrame, ids: list[str]) -> DataFrame:
        for c in ids:
            one = small(found.drop(*hidden), count, width).select(F.col("id").alias(c), *[F.col(n).alias(f"{c}_{n}") for n in names])
            df = df.join(one, c)
        return df

    def side(c: str, *there: str) -> Callable[[str], Column]:
        return lambda name: F.col(f"{c}_{name}") if name in there or name in names else F.lit(None)

    star = rows.where("id != pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    star = scratch.write(with_features(star, ["a", "b"]).where(may_link(side("a"), side("b"))).select("a", "b"))
    first = scratch.write(verify(star, found))
    group = scratch.write(connected(first))

    rooted = rows.join(small(group), "id", "left").select("key", "pivot", "id", *place, F.coalesce("root", "id").alias("root"))
    open_keys = rooted.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("key")
    rest = rooted.join(open_keys, "key").where("id != pivot")
    if placed:
        rest = rest.withColumn("a_at", F.when(F.col("place") > 0, F.col("place"))).drop("place")
    rest = scratch.write(with_features(rest.withColumnRenamed("id", "a"), ["a"]))
    other = rest.select("key", *[F.col(c).alias("b" + c.removeprefix("a")) for c in rest.columns if c.startswith("a")], F.col("root").alias("other_root"))
    pairs = rest.join(other, "key").where((F.col("root") != F.col("other_root")) & (F.col("a") < F.col("b")) & may_link(side("a", "at"), side("b", "at")))
    pairs = scratch.write(pairs.select("a", "b").distinct())
    out = connected(scratch.write(first.unionByName(verify(pairs, found))))
    scratch.drop()  # what connected returns is its own table
    return out
