"""Shards, vector codes and conversations: brute force, and nulls, empty, long, repeated and clashing input."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.llm import queries, shard_map, turn_repair, twins, vector_codes
from seriesloom.llm.shared import shared_folder
from tests.oracle import connect, difference

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_jump_shards", "op12_vector_codes", "op13_turn_repair"])
def test_same_as_sql(spark, name):
    assert difference(queries.queries()[name](spark, SF), connect(SF), queries.oracle_sql()[name]) is None


# ---- shards


def jump(key: int, shards: int) -> int:
    b, j = -1, 0
    while j < shards:
        b, key = j, (key * shard_map.FACTOR + 1) % 2**64
        j = int((b + 1) * (2.0**31 / ((key >> 33) + 1)))
    return b


def of_text(key: str, shards: int) -> int:
    return jump(int(hashlib.md5(key.encode()).hexdigest()[:16], 16), shards)


@pytest.mark.parametrize("shards", [1, 2, 8, 9, 33, 700])
def test_jump_hash_is_the_published_one(spark, shards):
    got = spark.range(3000).select(F.col("id").cast("string").alias("t")).select("t", shard_map.jump_shard(F.col("t"), shards).alias("s")).collect()
    assert all(r["s"] == of_text(r["t"], shards) for r in got)


def test_a_further_shard_takes_its_share_and_nothing_else_moves(spark):
    ids = spark.range(20_000).select(F.col("id").cast("string").alias("t"))
    for n in (3, 8, 40):
        moved = ids.select(shard_map.jump_shard(F.col("t"), n).alias("a"), shard_map.jump_shard(F.col("t"), n + 1).alias("b")).where("a <> b")
        to = [r["b"] for r in moved.collect()]
        assert set(to) == {n} and abs(len(to) - 20_000 / (n + 1)) < 5 * (20_000 / (n + 1)) ** 0.5


ODD = "doc_id bigint, text string, shard string, slot string, n bigint, `bucket` int, `a.b` string"


def test_shards_of_odd_rows(spark):
    rows = [(1, "é日", None, "x", 1, 1, "q"), (1, "é日", None, "x", 1, 1, "q"), (1, None, "s", None, None, None, None), (None, None, None, None, None, None, None), (None, "", None, None, None, None, None), (2, "x" * 300_000, None, None, None, None, None)]
    rows += [(7, "hot", None, None, None, None, None)] * 500
    got = shard_map.shard_documents(spark.createDataFrame(rows, ODD)).collect()
    want = sorted((str(d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), of_text("" if d is None else str(d), 8), of_text("" if d is None else str(d), 9)) for d, t, *_ in rows)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"], r["shard"], r["grown_shard"]) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert shard_map.shard_documents(spark.createDataFrame([], ODD)).collect() == []


def test_slots_do_not_depend_on_partitions(spark):
    docs = spark.range(2_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab"), (F.col("id") % 7).cast("int")).alias("text"))
    one, two = (sorted(map(tuple, shard_map.shard_documents(docs.repartition(n)).collect())) for n in (1, 13))
    assert one == two


def test_shards_carry_any_columns_and_keys_of_several(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (1, "a", 2.0), (2, None, None)], "`k.1` int, k2 string, v double")
    got = shard_map.assign_shards(df, ["k.1", "k2"], 5, ["v"]).collect()
    assert sorted((r["k.1"], r["v"] or 0, r["shard"]) for r in got) == [(1, 2.0, of_text("1,a", 5))] * 2 + [(2, 0, of_text("2", 5))]
    with pytest.raises(ValueError):
        shard_map.jump_shard(F.lit("a"), 0)


def test_shards_written_whole_and_grown(spark):
    docs = spark.createDataFrame([(k, None if k % 5 == 0 else f"text {k}") for k in range(400)] + [(None, "a")], "doc_id bigint, text string")
    path = shared_folder(spark)
    shard_map.write_shards(docs, path, files=2)
    back = spark.read.parquet(path)
    assert sorted(map(str, back.select("doc_id", "text").collect())) == sorted(map(str, docs.collect()))
    assert all(r["shard"] == of_text("" if r["doc_id"] is None else str(r["doc_id"]), 8) for r in back.collect())
    taken = shard_map.taken_by_next(spark, path).collect()
    assert {r["doc_id"] for r in taken} == {k for k in range(400) if of_text(str(k), 9) == 8} | ({None} if of_text("", 9) == 8 else set())
    with pytest.raises(ValueError):
        shard_map.write_shards(back, path)


def test_shards_run_no_python(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id bigint, text string")
    plan = shard_map.shard_documents(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


# ---- vector codes


def lloyd(rows: list[tuple], entries: int, rounds: int, parts: int = 4):
    """Codes, errors and codebooks by full scans in Python's integers."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    cut = [[r[2][p * len(r[2]) // parts : (p + 1) * len(r[2]) // parts] for r in rows] for p in range(parts)]
    books = [[list(x) for x in c[:entries]] for c in cut]

    def far(x, y):
        return sum((a - b) ** 2 for a, b in zip(x, y, strict=True))

    def assign():
        return [[min(range(len(books[p])), key=lambda e: (far(x, books[p][e]), e)) for x in cut[p]] for p in range(parts)]

    for _ in range(rounds):
        for p, codes in enumerate(assign()):
            for e in set(codes):
                own = [x for x, c in zip(cut[p], codes, strict=True) if c == e]
                books[p][e] = [sum(v) // len(own) for v in zip(*own, strict=True)]
    codes = assign()
    out = []
    for k, (i, label, _) in enumerate(rows):
        out.append((i, label, "".join(f"{codes[p][k]:02x}" for p in range(parts)), sum(far(cut[p][k], books[p][codes[p][k]]) for p in range(parts))))
    return out, books


@pytest.mark.parametrize(("spread", "entries"), [(2, 5), (400, 9), (1 << 23, 7), (3, 256)])
def test_codes_by_full_scans(spark, spread, entries):
    """Small spreads have many ties and equal vectors; large ones leave the range in which doubles are exact."""
    rng = random.Random(spread)
    rows = [(k if k % 11 else None, rng.choice([None, 1, 2]), [rng.randint(-spread, spread) for _ in range(8)]) for k in range(150)]
    rows += rows[:20]
    df = spark.createDataFrame(rows, "vec_id bigint, label int, x array<bigint>").repartition(5)
    coded, books = vector_codes.product_codes(df, entries=entries, rounds=4)
    want, want_books = lloyd(rows, entries, 4)
    assert [e.tolist() for e in books.entries] == want_books
    assert sorted(map(str, coded.collect())) == sorted(str(r) for r in spark.createDataFrame(want, coded.schema).collect())
    sums = defaultdict(int)
    for _, label, _, error in want:
        sums[label] += error
    assert sorted(r["label_error"] for r in vector_codes.with_label_error(coded, books).collect()) == sorted(sums[r[1]] for r in want)


def test_bounds_spare_scans_and_never_lie():
    rng = np.random.default_rng(3)
    centres = rng.integers(-4000, 4000, (20, 6))
    x = np.concatenate([c + rng.integers(-40, 40, (60, 6)) for c in centres]).astype(np.int64)
    books = x[rng.permutation(len(x))[:30]].copy()
    code, upper, lower = vector_codes.scan(x, books)
    scanned = 0
    for _ in range(6):
        new = books.copy()
        for e in np.unique(code):
            new[e] = x[code == e].sum(0) // (code == e).sum()
        moved = vector_codes.Moved.between(books, new)
        code, upper, lower, n = vector_codes.reassign(x, new, moved, code, upper, lower)
        books, scanned = new, scanned + n
        d = vector_codes.squared(x, books)
        assert (code == d.argmin(1)).all()
        assert (upper**2 >= d[np.arange(len(x)), code]).all()
        d[np.arange(len(x)), code] = np.iinfo(np.int64).max
        assert (lower**2 <= d.min(1)).all()
    assert scanned < 3 * len(x)


def test_odd_vectors(spark):
    schema = "vec_id bigint, embedding array<float>, label int, x string, code int, error double"
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [1.0, None, 0.0, 0.0], [nan, 0.0, 0.0, 0.0], [0.0, inf, 0.0, 0.0], [0.0, 0.0, -inf, 0.0], [0.0] * 6]
    rows = [(k, e, 1, "x", 2, 0.5) for k, e in enumerate(odd)] + [(100, [0.5, -0.0005, 0.0, 1.0], None, None, None, None), (None, [0.5, 0.25, 0.0, 1.0], 3, None, None, None)]
    whole = vector_codes.whole_vectors(spark.createDataFrame(rows, schema))
    assert sorted(str(tuple(r)) for r in whole.collect()) == sorted(str(r) for r in [(100, None, [512, -1, 0, 1024]), (None, 3, [512, 256, 0, 1024])])
    coded, books = vector_codes.product_codes(whole)
    assert sorted((r["code"], r["error"]) for r in coded.collect()) == [("00000000", 0), ("00010000", 0)]  # of equal parts the lower index
    assert sorted(map(tuple, (r["decoded"] for r in vector_codes.decoded(coded, books).collect()))) == [(0.5, -1 / 1024, 0.0, 1.0), (0.5, 0.25, 0.0, 1.0)]
    none, empty = vector_codes.product_codes(vector_codes.whole_vectors(spark.createDataFrame([], schema)))
    assert none.collect() == [] and empty.entries == () and vector_codes.with_label_error(none, empty).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    for bad in ([(1, None, [0] * 4), (2, None, [0] * 8)], [(1, None, [1 << 25, 0, 0, 0])]):
        with pytest.raises(ValueError):
            vector_codes.product_codes(spark.createDataFrame(bad, "vec_id bigint, label int, x array<bigint>"))


# ---- conversations


def cheapest(rows: list[tuple[str, bool, bool]]) -> tuple[int, str]:
    """Least (cost, audit) by Dijkstra's search over (row, state): rows are (initial, truncated, has to go)."""
    step = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
    heap, done = [(0, "", 0, 0)], set()
    while heap:
        cost, audit, i, q = heapq.heappop(heap)
        if i == len(rows) and q in (0, 3):
            return cost, audit
        if (i, q) in done:
            continue
        done.add((i, q))
        for role in "ua":
            if (role, q) in step:
                heapq.heappush(heap, (cost + 5, audit + "I", i, step[role, q]))
        if i < len(rows):
            initial, cut, gone = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, q))
            if not gone:
                if (initial, q) in step:
                    heapq.heappush(heap, (cost + 5 * cut, audit + "K", i + 1, step[initial, q]))
                for role in "ua":
                    if (role, q) in step:
                        heapq.heappush(heap, (cost + 1 + 5 * cut, audit + "R", i + 1, step[role, q]))


def test_signatures_by_search():
    rng = random.Random(5)
    letters = turn_repair.FINE + turn_repair.CUT + turn_repair.GONE
    for size in [*range(10), 17, 31, 32, 33, 64, 100, 257]:
        for _ in range(60 if size < 10 else 8):
            s = "".join(rng.choice(letters if rng.random() < 0.5 else "ua") for _ in range(size))
            assert turn_repair.solve_signature(s) == cheapest([(c.lower(), c in turn_repair.CUT, c == turn_repair.GONE) for c in s]), s


def test_long_signatures_are_solved():
    assert turn_repair.solve_signature("ua" * 100_000) == (0, "K" * 200_000)
    assert turn_repair.solve_signature("s" + "ua" * 70_000 + "u") == (2, "K" * 140_001 + "D")


def brute(rows: list[tuple], damage: bool) -> dict:
    conversations = defaultdict(list)
    for conv, turn, role, text in rows:
        kept = conversations[conv]
        role, text = (" " if v is None else v for v in (role, text))
        way = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        if way == 0:
            continue
        text = "" if way == 1 else re.sub("[.!?]", "", text) if way == 2 else text
        kept += [(turn, "user" if way == 4 else role, text)] * (2 if way == 3 else 1)
    out = {}
    for conv, kept in conversations.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        seen, faults = set(), []
        for _, role, text in kept:
            bare = text.strip(" \t\n\x0b\x0c\r")
            faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in kept if t is not None]
        cost, audit = cheapest([(r[:1], f == "t", f in ("b", "d")) for (_, r, _), f in zip(kept, faults, strict=True)])
        lines, at, last = [], 0, ""
        for edit in audit:
            other = "assistant" if last == "u" else "user"
            if edit == "I":
                lines.append(f"{other}:")
            else:
                if edit != "D":
                    lines.append(f"{kept[at][1] if edit == 'K' else other}:{kept[at][2]}")
                at += 1
            last = lines[-1][:1] if lines else ""
        pairs = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:], strict=False))
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"), pairs, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines)
    return out


SCHEMA = "conv_id bigint, turn bigint, role string, text string, letters string, n int, digest string, `kind.x` int"


def odd_conversations() -> list[tuple]:
    rng = random.Random(2)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "U"]
    texts = ["Fine.", "Well!", "cut", "cut \n", "Is it?\t ", "", "  \r\n", None, "日本。", "é.", "Fine.", "a\x0bb."]
    rows = [(c if c else None, rng.choice([None, *range(9)]), rng.choice(roles), rng.choice(texts)) for c in range(120) for _ in range(rng.randint(1, 9))]
    rows += [(500, t, "user" if t % 2 else "assistant", f"Line {t}." + "x" * (t % 3)) for t in range(700)]  # one long conversation
    rows += [(501, t, "user", "Again.") for t in range(300)] + [(502, 3, "user", "Same.")] * 90
    rows += [(503, 0, "user", "long " * 50_000 + "end."), (503, 5, "assistant", "x" * 200_000), (504, None, None, None)]
    return rows


@pytest.mark.parametrize("damage", [True, False])
def test_conversations_by_brute_force(spark, damage):
    rows = odd_conversations()
    df = spark.createDataFrame([(*r, "x", 1, "d", 3) for r in rows], SCHEMA).repartition(6)
    prepared = turn_repair.damaged(df) if damage else turn_repair.as_rows(df)
    got = {r["conv_id"]: tuple(r)[1:] for r in turn_repair.repair_report(prepared).collect()}
    assert got == {c: v[:-1] for c, v in brute(rows, damage).items()}


def test_repaired_rows(spark):
    rows = odd_conversations()
    df = spark.createDataFrame([(*r, None, None, None, None) for r in rows], SCHEMA)
    got = defaultdict(list)
    for r in turn_repair.repair(turn_repair.as_rows(df)).orderBy("conv_id", "position").collect():
        assert r["position"] == len(got[r["conv_id"]])
        got[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    assert got == {c: v[-1] for c, v in brute(rows, False).items() if v[-1]}


def test_conversations_lost_whole_and_empty_tables(spark):
    lost = next(c for c in range(10_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(lost, 0, "user", "Hi.", None, None, None, None)], SCHEMA)
    assert tuple(turn_repair.repair_report(turn_repair.damaged(df)).first()) == (lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert turn_repair.repair_report(turn_repair.damaged(spark.createDataFrame([], SCHEMA))).collect() == []


def test_long_conversations_are_put_together_from_stretches(spark):
    rows = spark.range(40_000).select(F.lit(1).cast("bigint").alias("conv_id"), F.expr("id div 3").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("Row "), F.col("id"), F.lit(".")).alias("text"), F.lit(1).alias("n"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = turn_repair._stretches(turn_repair._faults(rows))
        assert parts.count() > 1
        got = turn_repair.signatures(rows).first()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert got["gaps"] == 0 and len(got["letters"]) == 40_000


def test_twins_name_parameters_of_operators():
    assert str(shard_map.BUCKETS) in twins.shards() and str(vector_codes.SCALE) in twins.vector_code_rows()
