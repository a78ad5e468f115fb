"""Operators on Spark: brute force on small tables, and nulls, empty, long, repeated and clashing input."""

from __future__ import annotations

import math
import random
import re
import time
import zlib
from collections import Counter
from itertools import combinations, product

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.llm import (
    bpe_codec,
    contamination,
    fingerprints,
    jaccard_join,
    license_scan,
    line_dedup,
    linking,
    ngram_scores,
    quality,
    queries,
    shared,
    text,
    token_blocks,
    trie_counts,
)
from seriesloom.llm.pieces import DEFAULT_VOCABULARY, tokenizer
from seriesloom.llm.shared import shared_folder

SF = "/root/testdata/sf0.01"
LIBRARY = tokenizer(DEFAULT_VOCABULARY)
SCHEMA = "doc_id bigint, text string, lang string, score double, n_tokens bigint, id bigint, _doc string, h string, `key` string"
LONG = " ".join(random.Random(1).choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(k % 977) for k in range(60_000))
TEXTS = [None, "", " \n\t ", "One two three.", "One two three.", LONG, "x" * 30_000, "MIT License. Licensed under CC BY 4.0", "a\n\n b \na", "é́ 日本 <|endoftext|>"]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, a repeated row, null ids, and columns named as the operators' own."""
    rows = [(k, t, None, 0.5, 7, 1, "d", "h", "k") for k, t in enumerate(TEXTS)]
    rows += [rows[3], (None, "One two three.", "en", None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


BENCH = "item_id bigint, text string, doc_id bigint"


@pytest.mark.parametrize("run", [
    bpe_codec.encode_documents, bpe_codec.encode_digests, trie_counts.token_counts, fingerprints.media_table, fingerprints.media_digests,
    license_scan.scan_licenses, lambda d: quality.score_documents(d, quality.fit_rows([])),
    lambda d: contamination.contamination_report(d, d.sparkSession.createDataFrame([(1, "two three", 5), (2, None, 5), (3, "", 5)], BENCH)),
    jaccard_join.jaccard_components, line_dedup.dedup_lines,
])
def test_a_row_for_every_row(spark, odd, none, run):
    out = run(odd)
    assert out.count() == odd.count()
    assert Counter(r[0] for r in out.select("doc_id").collect()) == Counter(r[0] for r in odd.select("doc_id").collect())
    assert run(none).count() == 0
    assert run(none).dtypes == out.dtypes


def test_codes_and_decoded_text(odd):
    for r in bpe_codec.encode_documents(odd).join(odd.select("doc_id", "text").distinct(), "doc_id").collect():
        want = LIBRARY.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == want and r["decoded"] == LIBRARY.decode(want, skip_special_tokens=False)


def test_blocks_are_read_in_order(spark, odd, none):
    path = shared_folder(spark)
    token_blocks.write_token_blocks(odd, path)
    rows = token_blocks.read_token_blocks(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == sorted((r[0] for r in odd.select("doc_id").collect()), key=lambda x: (x is not None, x))
    at = 0
    for r in rows:
        assert r["start"] == at and len(r["ids"]) == r["n_tokens"]
        at += r["n_tokens"]
        if r["doc_id"] is not None:
            assert r["ids"] == [*LIBRARY.encode(TEXTS[r["doc_id"]] or "", add_special_tokens=False).ids, 1]
    digests = {(r["start"], r["ids_crc32"]) for r in token_blocks.read_token_blocks(spark, path, digest_only=True).collect()}
    assert digests == {(r["start"], zlib.crc32(np.array(r["ids"], "<u4").tobytes())) for r in rows}
    path = shared_folder(spark)
    token_blocks.write_token_blocks(none, path)
    assert token_blocks.read_token_blocks(spark, path).count() == 0


def test_contamination_of_the_test_tables(spark, docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [tuple(r) for r in bench.select("item_id", "text").collect()]
    windows = {}
    for key, t in items:
        w = text.alnum_words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(key)
    sizes = {len(w) for w in windows}
    found = 0
    for r in contamination.contamination_report(docs, bench).join(docs.select("doc_id", "text"), "doc_id").collect():
        words, hit, ids = text.alnum_words(r["text"]), set(), set()
        for n in sizes:
            for k in range(len(words) - n + 1):
                if tuple(words[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    ids |= windows[tuple(words[k : k + n])]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (len(words), len(hit), len(ids), bool(hit))
        assert sum(len(text.alnum_words(r["text"][s["start"] : s["stop"]])) for s in r["spans"]) == len(hit)
        found += bool(hit)
    assert found > 0
    assert contamination.drop_contaminated(docs, bench).count() == docs.count() - found
    assert contamination.drop_contaminated(docs, bench).schema == docs.schema


def test_held_out_quality(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(d, labels)
    scored = quality.score_documents(d, model).join(labels, "doc_id").where(quality.held_out(F.col("doc_id"))).toPandas()
    assert (scored["predicted"] == scored["quality"]).mean() > 0.98
    assert scored.loc[scored["quality"] == 1, "predicted"].mean() > 0.99
    assert set(quality.keep_good(d.where("doc_id < 300"), model).columns) == set(d.columns)
    assert not [c for c in (model.good, model.bad) if len(c) > quality.DICTIONARY_BYTES]


def test_scores_are_calibrated_whatever_share_is_drawn(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    n1, n0 = (labels.where(F.col("quality") == k).count() for k in (1, 0))
    model = quality.fit(d, labels, max_rows=min(n1, n0) // 2)  # as many of both labels
    scored = quality.score_documents(d, model).join(labels, "doc_id").where(quality.held_out(F.col("doc_id"))).toPandas()
    assert abs(scored["score"].mean() - scored["quality"].mean()) < 0.03
    for low, high in ((0, 0.3), (0.3, 0.9), (0.9, 1.01)):
        some = scored[(scored["score"] >= low) & (scored["score"] < high)]
        if len(some) >= 30:
            assert abs(some["score"].mean() - some["quality"].mean()) < 0.15


def test_the_sample_is_bounded_whatever_repeats(spark):
    docs = spark.createDataFrame([(1, "good text " * 50), *[(1, "other")] * 300, (2, "bad text " * 50), (3, None), (None, "x"), (8, "y" * 9000)], "doc_id bigint, text string, lang string".replace(", lang string", ""))
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 1), (None, 1), (8, 1), (8, 0), (9, 7)], "doc_id bigint, quality int")
    kept, original = [], quality.fit_rows
    try:
        quality.fit_rows = lambda rows, **k: kept.append((rows, k)) or original(rows, **k)
        quality.fit(docs, labels, max_chars=5000)
    finally:
        quality.fit_rows = original
    rows, more = kept[0]
    held = {k for k in (1, 2, 3) if zlib.crc32(str(k).encode()) % 4 == 2}
    assert sorted(rows) == sorted(x for k, x in ((1, ("good text " * 50, 1)), (2, ("bad text " * 50, 0))) if k not in held)
    assert more["of_all"] == (len({1, 3} - held), len({2} - held))


def jaccard_by_hand(rows, size, percent):
    sets = {i: set(jaccard_join.element_set(t, size).tolist()) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    order = sorted(sets)
    for k, a in enumerate(order):
        for b in order[:k]:
            if sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80)])
def test_components_with_a_large_group_of_near_copies(spark, size, percent):
    rnd = random.Random(7)
    base = [rnd.choice("abcdefghij") + str(rnd.randrange(200)) for _ in range(150)]
    rows = [(0, " ".join(base)), (1, None), (2, ""), (3, "a b"), (4, "A B"), (5, "a")]
    for k in range(6, 160):
        w = list(base)
        for _ in range(rnd.choice([0, 1, 1, 2, 3, 5, 9])):
            w[rnd.randrange(len(w))] = "n" + str(rnd.randrange(10**6))
        rows.append((k, " ".join(w)))
    rows += [(k, " ".join(rnd.choice("abcd") for _ in range(rnd.randrange(1, 9)))) for k in range(160, 260)]
    large = [f"w{rnd.randrange(5000)}" for _ in range(640)]
    for k in range(260, 300):  # around the size from which sets have a wide bitmap
        w = large[: rnd.randrange(560, 641)]
        for _ in range(rnd.choice([0, 2, 5, 9, 15])):
            w[rnd.randrange(len(w))] = f"n{rnd.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = {r[0]: (r[1], r[2]) for r in jaccard_join.jaccard_components(df, size, percent).collect()}
    want = jaccard_by_hand(rows, size, percent)
    assert got == want
    kept = jaccard_join.drop_near_copies(df, size, percent)
    assert {r[0] for r in kept.collect()} == {i for i, (_, c) in want.items() if c == i}


@pytest.mark.parametrize(("percent", "size"), [(80, 6), (80, 60), (80, 200), (80, 800), (80, 5000), (90, 12), (90, 200), (90, 3000)])
def test_unrelated_sets_share_no_signature_and_similar_sets_share_one(percent, size):
    rnd = np.random.default_rng(size)
    draw = lambda n: np.sort(rnd.integers(0, 2**63, n, dtype=np.int64).view(np.uint64))
    sets = [draw(size + k % 5) for k in range(300)]
    place, sig = jaccard_join.signatures(sets, percent)
    names, times = np.unique(np.unique(np.c_[sig, place], axis=0)[:, 0], return_counts=True)
    assert times.max() == 1
    k = jaccard_join.scheme(int(np.searchsorted(jaccard_join.bands(size, percent), size)), percent)[0]
    assert len(sig) < 300 * 4 * (k + 3)
    for s in sets[:100]:  # as far apart as links may be: elements go, come, or both
        allowed = int(len(s) * (100 - percent) / 100)
        come = int(rnd.integers(0, allowed // 2 + 1))
        go = int(allowed - come * percent / 100 - 1)
        t = np.sort(np.r_[rnd.permutation(s)[max(go, 0) :], draw(come)])
        common = len(np.intersect1d(s, t))
        if common * 100 >= percent * (len(s) + len(t) - common):
            both = [set(jaccard_join.signatures([x], percent)[1].tolist()) for x in (s, t)]
            assert both[0] & both[1] or np.array_equal(s, t)


def test_links_through_a_row_without_id_and_rows_that_repeat(spark):
    w = [f"w{k}" for k in range(60)]
    texts = [" ".join(w[:60]), " ".join(w[2:60]), " ".join(w[4:60])]  # the first and the last are linked by the middle only
    schema = "doc_id bigint, text string, `x.y` int, id int, kept int"
    rows = [(5, texts[0], 1, 1, 1), (None, texts[1], 2, 2, 2), (9, texts[2], 3, 3, 3), (9, texts[2], 3, 3, 3), (9, "another text of its own here", 4, 4, 4), (None, "lonely", 5, 5, 5), (None, "lonely", 6, 6, 6), (None, None, 7, 7, 7), (3, "twice twice", 8, 8, 8), (3, "twice twice", 8, 8, 8), (4, "Twice twice", 9, 9, 9)]
    df = spark.createDataFrame(rows, schema).repartition(3)
    got = sorted((str(r[0]), r[1], str(r[2])) for r in jaccard_join.jaccard_components(df, 3, 95).collect())
    assert got == sorted([("5", 58, "5"), ("None", 56, "5"), ("9", 54, "5"), ("9", 54, "5"), ("9", 4, "9"), ("None", 1, "None"), ("None", 1, "None"), ("None", 0, "None"), ("3", 1, "3"), ("3", 1, "3"), ("4", 1, "3")])
    kept = jaccard_join.drop_near_copies(df, 3, 95)
    assert kept.columns == df.columns
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter([(5, texts[0]), (9, "another text of its own here"), (None, "lonely"), (None, None), (3, "twice twice")])


def test_components_of_a_long_chain(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 101), (103, 102)]
    random.Random(2).shuffle(edges)
    got = dict(tuple(r) for r in linking.connected(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100, 102: 102, 103: 102}
    assert linking.connected(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def distance(a, b):
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
        before = now
    return before[-1]


def normal(line):
    return re.sub(r"[ \t\r]+", " ", line).strip(" ").lower()


def test_lines_as_by_brute_force(spark):
    """Blocks as counted by hand; groups as of all pairs that share a key and are near by edit distance."""
    rnd = random.Random(11)
    vocabulary = ["".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randrange(2, 9))) for _ in range(300)]
    bases = [[rnd.choice(vocabulary) for _ in range(rnd.choice([2, 3, 8, 12, 25, 32, 60]))] for _ in range(14)]
    rows = []
    for k in range(60):
        lines = []
        for _ in range(rnd.randrange(0, 7)):
            w = list(rnd.choice(bases))
            for _ in range(rnd.choice([0, 0, 0, 1, 1, 2])):
                w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
            lines.append(rnd.choice(["", " ", "\t"]) + rnd.choice([" ".join(w), " ".join(w).upper(), "  ".join(w)]))
        lines += [""] * rnd.randrange(2)
        rows.append((k, "\n".join(lines)))
    rows.append((60, None))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    places = line_dedup._lines(df, "doc_id", "text").collect()
    assert {r["line"] for r in places} == {normal(x) for _, t in rows if t for x in t.split("\n") if normal(x)}
    table = line_dedup.distinct_lines(df)
    found = {r["h"]: r for r in table.collect()}
    lines = {r["h"]: r["line"] for r in places}
    word_hash = {r["w"]: r["x"] % 2**64 for r in spark.createDataFrame([(w,) for w in {w for x in lines.values() for w in x.split(" ")}], "w string").select("w", F.xxhash64("w").alias("x")).collect()}
    for h, x in lines.items():
        hashes = [word_hash[w] for w in set(x.split(" "))]
        if len(hashes) < line_dedup.MIN_WORDS:
            assert found[h]["low"] is None
            continue
        for block in range(8):
            own = [y & 0xFFFF for y in hashes if y >> 61 == block]
            want = sum(1 << k for k in range(16) if 2 * sum(y >> k & 1 for y in own) > len(own))
            side = "low" if block < 4 else "high"
            assert (found[h][side] % 2**64 >> 16 * (block % 4) & 0xFFFF, found[h][side + "_n"] % 2**64 >> 16 * (block % 4) & 0xFFFF) == (want, len(own))
    keys = {}
    for r in line_dedup._keyed(table).unionByName(line_dedup._stretches(df, "doc_id", "text")).collect():
        keys.setdefault(r["id"], set()).add(r["key"])
    root = {h: h for h in lines}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    order, links = list(lines), 0
    for k, a in enumerate(order):
        for b in order[:k]:
            if keys.get(a, set()) & keys.get(b, set()) and distance(lines[a], lines[b]) * 100 <= 10 * max(len(lines[a]), len(lines[b])):
                root[max(find(a), find(b))] = min(find(a), find(b))
                links += 1
    assert links > 10
    first = {}
    for r in sorted(places, key=lambda r: (r["doc"], r["mark"], r["pos"])):
        first.setdefault(find(r["h"]), (r["doc"], r["pos"]))
    gone = {(r["doc"], r["pos"]) for r in places if first[find(r["h"])] != (r["doc"], r["pos"])}
    got = {r["doc_id"]: (r["text"], r["_dropped"]) for r in line_dedup.dedup_lines(df).collect()}
    for k, t in rows:
        kept = None if t is None else [x for p, x in enumerate(t.split("\n")) if (k, p) not in gone]
        assert got[k] == (None, 0) if t is None else got[k] == ("\n".join(kept), t.count("\n") + 1 - len(kept))


def test_choices_of_blocks_cover_the_edits_they_are_for():
    for (_, _, _, choices), equal in zip(line_dedup.CHOICES, (6, 4, 3), strict=True):
        for left in combinations(range(8), equal):
            assert any(set(c) <= set(left) for c in choices)


def test_distance_by_words_is_never_under_the_edit_distance(spark):
    rnd = random.Random(8)

    def line():
        return " ".join(rnd.choices(["a", "bb", "ccc", "dddd", "ab", "bc", ""], k=rnd.randrange(1, 7)))

    rows = [(line(), line()) for _ in range(1500)]
    rows += [("a b c d e f", "a b f"), ("b c", "a b c"), ("a b", "a b c d"), ("x" * 3000, "y" * 3000)]
    for r in line_dedup._by_words(spark.createDataFrame(rows, "x string, y string").withColumn("most", F.lit(50))).collect():
        exact = distance(r["x"], r["y"])
        assert r["bound"] >= exact
        x, y = r["x"].split(" "), r["y"].split(" ")
        if len(x) == len(y) and sum(v != w for v, w in zip(x, y, strict=True)) == 1 and exact <= 50:
            assert r["bound"] == exact
    got = {(r["x"], r["y"]): r["bound"] for r in line_dedup._by_words(spark.createDataFrame(rows[-4:-1], "x string, y string").withColumn("most", F.lit(50))).collect()}
    assert list(got.values()) == [6, 2, 4]


def edited(line, kind, rnd, vocabulary):
    w = line.split(" ")
    for _ in range(int(kind[0])):
        k = rnd.randrange(len(w))
        if kind.endswith("word"):
            w[k] = rnd.choice(vocabulary)
        else:
            at = rnd.randrange(len(w[k]))
            w[k] = w[k][:at] + rnd.choice("abcdefghijklmnopqrstuvwxyz") + w[k][at + rnd.randrange(2) :]
    return " ".join(w)


@pytest.mark.parametrize("kind", ["1 word", "2 word", "1 character", "2 character"])
def test_recall_of_edited_lines_against_edit_distance(spark, docs, kind):
    """Lines of the test table, each once as it is and once edited, in documents of their own: how many edited ones that
    are within a tenth of the length are found."""
    rnd = random.Random(5)
    lines = sorted({normal(x) for r in docs.collect() for x in (r["text"] or "").split("\n")})
    lines = [x for x in lines if len(set(x.split(" "))) >= 5 and len(x) < 400]
    lines, vocabulary = rnd.sample(lines, 250), sorted({w for x in lines for w in x.split(" ")})
    pairs = [(x, edited(x, kind, rnd, vocabulary)) for x in lines]
    pairs = [(x, y) for x, y in pairs if x != y and distance(x, y) * 100 <= 10 * max(len(x), len(y))]
    assert len(pairs) > 100
    df = spark.createDataFrame([row for k, (x, y) in enumerate(pairs) for row in ((k, x), (10**6 + k, y))], "doc_id bigint, text string")
    got = line_dedup.dedup_lines(df).where("doc_id >= 1000000 and _dropped = 1").count()
    assert got / len(pairs) >= 0.9


def test_recall_of_edits_that_grow_with_the_line(spark, docs):
    """Replaced, added and removed characters, blanks too, by share of the line's characters: how many pairs that are within
    a tenth by edit distance are in one group. README.md has the figures."""
    rnd = random.Random(7)
    lines = sorted({normal(x) for r in docs.collect() for x in (r["text"] or "").split("\n")})
    kinds = {"3-7 words": lambda x: 3 <= len(x.split(" ")) <= 7, "8-40 words": lambda x: 8 <= len(x.split(" ")) <= 40, "long": lambda x: 400 <= len(x) < 900}
    wanted = {("3-7 words", 2): 0.9, ("3-7 words", 4): 0.9, ("8-40 words", 2): 0.95, ("8-40 words", 4): 0.9, ("8-40 words", 6): 0.85, ("long", 2): 0.95, ("long", 4): 0.9, ("long", 6): 0.8}
    rows, pairs = [], []
    for (kind, percent), _ in wanted.items():
        for x in rnd.sample([x for x in lines if kinds[kind](x)], 80):
            y = list(x)
            for _ in range(max(1, len(x) * percent // 100)):
                k = rnd.randrange(len(y))
                y[k : k + rnd.choice([0, 1, 1])] = rnd.choice(["", "e", "q", "n"])
            y = normal("".join(y))
            if x != y and y and (len(x) > 400 or distance(x, y) * 100 <= 10 * max(len(x), len(y))):
                rows += [(2 * len(pairs), x), (2 * len(pairs) + 1, y)]
                pairs.append((kind, percent, x, y))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    table = line_dedup.Scratch(spark).write(line_dedup.distinct_lines(df))
    root = {r["id"]: r["root"] for r in line_dedup.line_groups(df, table).collect()}
    hashes = {r["line"]: r["h"] for r in line_dedup._lines(df, "doc_id", "text").collect()}
    all_, found = Counter(), Counter()
    for kind, percent, x, y in pairs:
        all_[kind, percent] += 1
        found[kind, percent] += root.get(hashes[x], x) == root.get(hashes[y], y)
    assert min(all_.values()) > 30
    assert {k: found[k] / all_[k] for k, least in wanted.items() if found[k] / all_[k] < least} == {}


def test_stretches_far_apart_are_not_paired(spark, monkeypatch):
    """Lines of the same letters and different words that share one stretch at six places: the second round compares only
    lines that have it at about the same place."""
    rnd = random.Random(3)
    words = ["".join(rnd.choices("etainosr", k=6)) for _ in range(30)]
    common = ["edge", "stone", "rind", "haste", "load", "trees", "under", "shore"]
    lines = []
    for k in range(24):
        own = ["".join(rnd.sample(w, len(w))) for w in words]
        lines.append(" ".join([*own[: k % 6 * 5], *common, *own[k % 6 * 5 :]]))
    # an edited line whose stretches are moved still links
    lines.append("ed ge " + lines[0])
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string")
    table = line_dedup.Scratch(spark).write(line_dedup.distinct_lines(df))
    pairs, link_groups = [], linking.link_groups

    def counting(keyed, features, may_link, verify, **more):
        def counted(found, texts):
            pairs.append(found.count())
            return verify(found, texts)

        return link_groups(keyed, features, may_link, counted, **more)

    monkeypatch.setattr(line_dedup, "link_groups", counting)
    root = {r["id"]: r["root"] for r in line_dedup.line_groups(df, table).collect()}
    assert len(root) == 2 and 0 < pairs[1] <= 6 * 6 + 4


def test_places_and_letters_travel_without_the_text(spark, monkeypatch):
    """A key's place is in characters, so the second round needs no text; counts of letters are packed in two longs, and
    only texts of pairs are joined."""
    rnd = random.Random(5)
    words = ["".join(rnd.choices("etainosrhlduxy", k=rnd.randrange(2, 9))) for _ in range(4_000)]
    base = [" ".join(rnd.sample(words, n)) for n in (12, 20, 60, 1_500)] + ["e" * 1_100 + " " + " ".join(rnd.sample(words, 40))]
    lines = [*base, *[x[:-3] + "q" + x[-2:] for x in base]]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string")
    hashes = {r["line"]: r["h"] for r in line_dedup._lines(df, "doc_id", "text").collect()}
    places = {}
    for r in line_dedup._stretches(df, "doc_id", "text").collect():
        places.setdefault(r["id"], set()).add(r["place"])
    for x in lines:
        starts = [k for k in range(len(x)) if k == 0 or x[k - 1] == " "]
        allowed = {p if (p := max(k - 1, 0) // line_dedup.GRAIN + 1) <= linking.PLACES else 0 for k in starts}  # without the blank before it
        assert places[hashes[x]] <= allowed and places[hashes[x]] - {0}

    table = line_dedup.Scratch(spark).write(line_dedup.distinct_lines(df))
    seen, link_groups = [], linking.link_groups

    def looking(keyed, features, may_link, verify, **more):
        def looked(ids):
            found = features(ids)
            seen.extend(found.collect())
            return found

        return link_groups(keyed, looked, may_link, verify, **more)

    monkeypatch.setattr(line_dedup, "link_groups", looking)
    groups = line_dedup.line_groups(df, table).collect()
    assert len(groups) == len(lines) and len({r["root"] for r in groups}) == len(base)
    assert {r["line"] for r in seen} == set(lines)
    for r in seen:
        assert set(r.asDict()) == {"id", "chars", "line", "letters0", "letters1"}
        for k, x in enumerate(line_dedup.LETTERS):
            assert r[f"letters{k % 2}"] >> 10 * (k // 2) & 1023 == min(r["line"].count(x), 1023)


def test_other_letters_tell_lines_apart_before_their_texts_are_joined(spark, monkeypatch):
    """Lines that share a stretch and the counts of the most frequent letters, but differ in others and in the numbers of
    words, never come to the edit distance; edited lines do."""
    rnd = random.Random(4)
    own = ["".join(rnd.choice("cgw" if k % 2 else line_dedup.LETTERS) for k in range(6)) for _ in range(30)]
    other = [w.translate(str.maketrans("cgw", "fmq")) for w in own]
    stretch = ["one", "two", "three", "four"]
    lines = [" ".join([*w[:10], *stretch, *w[10:]]) for w in (own, other)]
    lines += [x[:-3] + "0" + x[-2:] for x in lines]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string")
    table = line_dedup.Scratch(spark).write(line_dedup.distinct_lines(df))
    compared, by_words = [], line_dedup._by_words

    def counting(pairs):
        compared.append(pairs.count())
        return by_words(pairs.where(F.col("x").isNotNull()))

    monkeypatch.setattr(line_dedup, "_by_words", counting)
    monkeypatch.setattr(line_dedup, "ALIKE", 0)
    groups = line_dedup.line_groups(df, table).collect()
    assert len(groups) == 4 and len({r["root"] for r in groups}) == 2
    assert sum(compared) == 2


def test_a_full_heap_of_the_driver_is_collected_after_a_write(spark, monkeypatch):
    """Whatever earlier steps left in the driver's heap goes when a table is written, if it is more than a share of it."""
    runtime = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    used = lambda: runtime.totalMemory() - runtime.freeMemory()
    scratch = shared.Scratch(spark)
    for _ in range(20):
        spark.range(1).selectExpr("repeat('x', 10000000) AS x").collect()
    before = used()
    monkeypatch.setattr(shared, "HEAP_SHARE", 0.0)
    scratch.write(spark.range(1))
    assert used() < before


def test_lines_of_few_or_very_many_words_link(spark):
    """Lines of one and two words against brute force, lines without blanks, and lines of more words than blocks can count."""
    rnd = random.Random(11)
    lines = set()
    for size in [*range(8, 34), 45, 60]:
        for blank in (False, True):
            x = [rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(size)]
            if blank:
                x[size // 3] = " "
            for _ in range(3):
                y = list(x)
                for _ in range(max(1, size // 10)):
                    k = rnd.randrange(len(y))
                    y[k : k + rnd.choice([0, 1, 1])] = rnd.choice(["", "e", "q"])
                lines |= {normal("".join(x)), normal("".join(y))}
    lines = sorted(lines)
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string").repartition(3)
    table = line_dedup.Scratch(spark).write(line_dedup.distinct_lines(df))
    root = {r["id"]: r["root"] for r in line_dedup.line_groups(df, table).collect()}
    of = {r["line"]: root.get(r["h"], r["h"]) for r in line_dedup._lines(df, "doc_id", "text").collect()}
    pairs = [(a, b) for k, a in enumerate(lines) for b in lines[:k] if distance(a, b) * 100 <= 10 * max(len(a), len(b))]
    assert len(pairs) > 100 and [(a, b) for a, b in pairs if of[a] != of[b]] == []
    assert len(set(of.values())) >= 50

    many = [f"{rnd.randrange(16**6):x}" for _ in range(line_dedup.MAX_WORDS + 2_000)]
    none = "".join(chr(0x4E00 + rnd.randrange(2_000)) for _ in range(400))
    texts = [" ".join(many), " ".join([*many[:9_000], "and", *many[9_001:], "more"]), none, none[:100] + none[101:300] + "x" + none[300:]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert [r["_dropped"] for r in line_dedup.dedup_lines(df).orderBy("doc_id").collect()] == [0, 1, 0, 1]


def test_rows_of_a_batch_are_encoded_in_parts(spark):
    """More rows than are held at a time, in one batch: none is lost or out of place."""
    rows = [(k, None if k % 97 == 0 else f"row {k} of many") for k in range(2 * bpe_codec.AT_ONCE + 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    got = bpe_codec.encode_documents(df).select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))
    want = bpe_codec.encode_digests(df).select("doc_id", "n_tokens", "decoded_sha256")
    assert got.count() == len(rows) and got.exceptAll(want).count() == 0


def test_equal_rows_keep_the_same_lines(spark):
    df = spark.createDataFrame([(1, "a\nb"), (1, "a\nb"), (None, "b\nc"), (2, "a\nc\n\n")], "doc_id bigint, text string")
    got = sorted((str(r["doc_id"]), r["text"]) for r in line_dedup.dedup_lines(df).collect())
    assert got == [("1", "a"), ("1", "a"), ("2", "\n"), ("None", "b\nc")]


def test_licenses_as_by_brute_force(spark, docs, odd):
    both = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text").where("doc_id is not null").withColumn("doc_id", F.col("doc_id") + 10**6).distinct())
    texts = {r["doc_id"]: r["text"] for r in both.collect()}
    seen = 0
    for r in license_scan.scan_licenses(both).collect():
        w = [x.decode() for x in text.alnum_words(texts[r["doc_id"]])]
        at, labels = [], set()
        for phrase, label in license_scan.BASE:
            p = phrase.split()
            hits = [k for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
            at += hits
            labels |= {label} if hits else set()
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(at), min(at, default=None), max(at, default=None))
        assert r["base_labels"] == ",".join(sorted(labels))
        assert labels <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
        seen += bool(at)
    assert seen > 5


@pytest.mark.parametrize(("given", "labels", "spans"), [
    ("SPDX-License-Identifier: GPL-3.0-only", {"gpl-3.0"}, [(0, 7, "gpl-3.0")]),
    ("Licensed under the GNU Lesser General Public License, version 2.1.", {"lgpl-2.1"}, [(0, 11, "lgpl-2.1")]),
    ("under the mit license or Apache License 2.0", {"mit", "apache", "apache-2.0"}, [(2, 4, "mit"), (5, 9, "apache-2.0")]),
    ("CC-BY-NC-SA 4.0", {"cc-by", "cc-by-nc-sa"}, [(0, 6, "cc-by-nc-sa")]),
    ("All rights reserved.", {"proprietary"}, [(0, 3, "proprietary")]),
    ("to accord success with the committee", set(), []),
])
def test_longer_detections_hold_shorter_ones(spark, given, labels, spans):
    r = license_scan.scan_licenses(spark.createDataFrame([(1, given)], "doc_id bigint, text string")).first()
    assert set(filter(None, r["labels"].split(","))) == labels
    assert [(d["start"], d["stop"], d["label"]) for d in r["detections"]] == spans


def test_the_gate_hides_no_license(spark, docs, monkeypatch):
    given = {
        "All rights\nreserved": "proprietary", "Creative  Commons Attribution 4.0": "cc-by", "placed in the public-domain": "public-domain",
        "Redistribution and\nuse in source and binary forms, with or without modification, are permitted": "bsd", "Open-RAIL": "openrail",
        "the same\t2 terms; the same\nterms as Perl": "perl", "an all\x01rights*reserved text": "proprietary", "CC\u00a0 BY": "",
    }
    names = [re.sub(r"\(\?:|\)|\?", "", names.split("|")[0]) for _, _, names in license_scan.FAMILIES]
    clauses = [re.sub(r"\(\?:[^()]*\)\?|\(\?:|\)|\?", "", names) for _, _, names in license_scan.CLAUSES if not re.search(r"[\[{\\|]", names)]
    assert len(clauses) > 60
    names += clauses
    rows = [*enumerate(given), *[(100 + k, f"x {s.join(n.upper().split(' '))} y") for k, (n, s) in enumerate((n, s) for n in names for s in ("\n", " - "))]]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").unionByName(docs.where("doc_id % 20 = 0").select(F.col("doc_id") + 10**6, "text").toDF("doc_id", "text")).repartition(4)
    passed = {r[0] for r in df.where(license_scan._gate(F.lower("text"))).select("doc_id").collect()}
    monkeypatch.setattr(license_scan, "_gate", lambda lower: F.lit(True))
    found = {r[0]: r[1] for r in license_scan.scan_licenses(df).select("doc_id", "labels").collect()}
    assert [found[k] for k in range(len(given))] == list(given.values())
    assert {k for k, x in found.items() if x} <= passed


def test_detections_as_by_brute_force(spark, docs):
    """All matches of all rules by Python's re, then containment and priority pair by pair."""
    rnd = random.Random(8)
    phrases = ["licensed under the mit license", "gnu general public license version 2 or any later version", "apache license 2 0", "cc by sa 4 0", "all rights reserved", "the software is provided as is without warranty of any kind express or implied",
               "spdx license identifier gpl 3 0 only", "bsd 3 clause license", "redistributions of source code must retain the above copyright notice", "released under the terms of the gnu lesser general public license v2 1", "creativecommons org licenses by nc sa 4 0", "mozilla public license 2 0", "unlicense"]
    rows = [(k, " ".join(rnd.choice([*phrases, "word", "the", "license", "under", "public"]) for _ in range(rnd.randrange(1, 30)))) for k in range(40)]
    rows += [(1000 + r["doc_id"], r["text"]) for r in docs.where("doc_id % 10 = 0").collect()]
    forms = "|".join(b for _, _, _, b in license_scan.FORMS if b)
    rules = [(label, f"(?:{forms})?(?:{names})", names) for label, _, names in license_scan.FAMILIES] + [(label, f"(?:{names})", None) for label, _, names in license_scan.CLAUSES]
    keywords = [k for _, k, _ in license_scan.FAMILIES + license_scan.CLAUSES]
    several = 0
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()}
    for k, t in rows:
        norm = " " + " ".join(x.decode() for x in text.alnum_words(t)) + " "
        found = []
        for number, (label, pattern, names) in enumerate(rules):
            for m in re.finditer(f" {pattern}(?= )", norm) if keywords[number] in norm else ():
                start = norm[: m.start() + 1].count(" ") - 1
                form = next((p for _, p, _, b in license_scan.FORMS if re.fullmatch(f" (?:{b})(?:{names})", m.group())), license_scan.FORMS[-1][1]) if names else license_scan.CLAUSE[0]
                found.append((start, start + m.group().count(" "), form, number, label))
        def holds(x, y):  # noqa: E306
            return x[0] <= y[0] and x[1] >= y[1] and ((x[0], x[1]) != (y[0], y[1]) or x[2:4] < y[2:4])
        kept = sorted((d[0], d[1], d[4]) for d in found if not any(holds(x, d) for x in found))
        several += len(kept) > 1
        assert [(d["start"], d["stop"], d["label"]) for d in got[k]["detections"]] == kept
    assert several > 20


def test_a_megabyte_of_mentions_takes_seconds(spark):
    many = "this mit license covers it and apache license 2.0 covers that, " * 16_000
    began = time.time()
    r = license_scan.scan_licenses(spark.createDataFrame([(1, many)], "doc_id bigint, text string")).first()
    assert (r["n_base"], len(r["detections"])) == (32_000, 32_000)
    assert time.time() - began < 60


def test_hundreds_of_signatures():
    assert len(license_scan.FAMILIES) + len(license_scan.CLAUSES) > 190
    assert len({n for _, _, n in license_scan.FAMILIES + license_scan.CLAUSES}) > 190


def scores_by_hand(rows, corpus, order, alpha=0.4):
    """id -> (words, n-grams that occur twice, sum of logarithms), straight from the definition."""
    count = Counter(tuple(w[k : k + n]) for w in (text.alnum_words(t) for _, t in corpus) for n in range(1, order + 1) for k in range(len(w) - n + 1))
    total = max(sum(c for g, c in count.items() if len(g) == 1), 1)
    out = {}
    for i, t in rows:
        w = text.alnum_words(t)
        s, again = 0.0, 0
        for k in range(len(w)):
            longest = min(order, k + 1)
            n = next((n for n in range(longest, 1, -1) if count[tuple(w[k - n + 1 : k + 1])]), 1)
            gram = tuple(w[k - n + 1 : k + 1])
            s += (longest - n) * math.log(alpha) + math.log(max(count[gram], 1) / (count[gram[:-1]] if n > 1 else total))
            again += k + 1 >= min(order, len(w)) and count[tuple(w[k - longest + 1 : k + 1])] >= 2
        out[i] = (len(w), again, s)
    return out


def same_scores(got, want, repeated=True):
    for r in got:
        n, again, s = want[r["doc_id"]]
        assert r["n_words"] == n and (not repeated or r["n_repeated"] == again)
        assert r["log_score"] == (pytest.approx(s, abs=1e-9) if n else None)
        assert r["score"] == (pytest.approx(s / n, abs=1e-9) if n else None)
        assert not n or r["score"] < 1e-9
    assert len(got) == len(want)


@pytest.mark.parametrize(("order", "hot_rows"), [(1, 10), (2, 0), (2, 10**6), (3, 20)])
def test_scores_of_the_own_corpus_as_by_hand(spark, order, hot_rows):
    rnd = random.Random(3)
    rows = [(k, " ".join(f"w{min(int(rnd.paretovariate(0.6)), 60)}" for _ in range(rnd.randrange(40)))) for k in range(40)]
    rows += [(40, None), (41, ""), (42, "once"), (43, "only once here"), (44, "a b"), (45, "a b")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    same_scores(ngram_scores.backoff_scores(df, order=order, hot_rows=hot_rows).collect(), scores_by_hand(rows, rows, order))


def test_the_join_carries_counts_on_small_tables_and_hot_keys_are_broadcast(spark):
    rnd = random.Random(6)
    rows = [(k, " ".join(f"w{int(rnd.paretovariate(0.5)) % 3000}" for _ in range(60))) for k in range(400)]
    table = ngram_scores.count_table(spark.createDataFrame(rows, "doc_id bigint, text string")).where("size > 0 and c >= 2").persist()
    for rows_at_most in (0, 10**6):
        names, c, least = ngram_scores._hot(table, 24_000, rows_at_most)
        rest = [r["c"] for r in table.where(f"c < {least}").collect()]
        assert len(rest) > 500 and max(rest) * ngram_scores.HOT_KEY < 24_000 and len(names) + len(rest) == table.count()
        assert len(names) <= table.count() // ngram_scores.HOT_SHARE + table.where(f"c * {ngram_scores.HOT_KEY} >= 24000").count()
    table.unpersist()


def test_any_differences_within_the_scheme_leave_an_equal_choice_of_cells():
    rnd = np.random.default_rng(5)
    for band, percent in product(range(1, 40), (70, 80, 90)):
        k, parts, equal = jaccard_join.scheme(band, percent)
        for _ in range(20 * (k > 0)):
            cell = rnd.integers(0, rnd.integers(1, parts * jaccard_join.CELLS + 1), k)  # the cells of the differences
            differing = np.bincount(np.unique(cell) // jaccard_join.CELLS, minlength=parts)
            assert 3 * (differing == 0).sum() + (differing == 1).sum() >= equal > 0


@pytest.mark.parametrize("order", [1, 3])
def test_scores_of_another_corpus_back_off(spark, order):
    rnd = random.Random(4)
    make = lambda n: [(k, " ".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(9)))) for k in range(n)]
    rows, corpus = [*make(30), (30, "unseen a unseen b c")], [*make(25), (99, None)]
    a, b = (spark.createDataFrame(x, "doc_id bigint, text string") for x in (rows, corpus))
    same_scores(ngram_scores.backoff_scores(a, corpus=b, order=order).collect(), scores_by_hand(rows, corpus, order), repeated=False)


def test_rare_counts_do_not_depend_on_the_size_of_the_corpus(spark):
    filler = spark.range(2_000).select((F.col("id") + 10).alias("doc_id"), F.repeat(F.lit("the the "), 4000).alias("text"))
    two = spark.createDataFrame([(1, "the rare pair"), (2, "the rare pair")], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in ngram_scores.backoff_scores(filler.unionByName(two)).where("doc_id < 10").collect()}
    n = 2_000 * 8_000
    for k in (1, 2):
        assert got[k]["n_repeated"] == 2
        assert got[k]["log_score"] == pytest.approx(math.log((n + 2) / (n + 6)) + math.log(2 / (n + 2)))


def test_scores_of_odd_rows(odd, none):
    got = ngram_scores.backoff_scores(odd).collect()
    assert Counter(r["doc_id"] for r in got) == Counter([*range(len(TEXTS)), None])
    assert ngram_scores.backoff_scores(none).count() == 0


def test_media_table_holds_its_payload(spark):
    df = spark.createDataFrame([(1, "ab" * 3000), (2, "ab" * 3000), (3, None)], "doc_id bigint, text string")
    a, b, c = fingerprints.media_table(df).orderBy("doc_id").collect()
    assert fingerprints.wav_samples(bytes(a["media"]))[:6000] == b"ab" * 3000
    assert a["frames"] == b["frames"] and a["codes"] == b["codes"] and a["frames"] == sorted(a["frames"])
    assert (c["n_bytes"], c["codes"]) == (0, [])


@pytest.mark.parametrize("level", [0, 32, 97, 128, 255])
def test_silence_has_no_pairs(level):
    assert [len(x) for x in fingerprints.fingerprint(np.full(6400, level, np.uint8))] == [0, 0]


def test_peaks_and_pairs_as_by_brute_force():
    x = np.random.default_rng(2).integers(0, 256, 4000).astype(np.uint8)
    held = np.concatenate([x, np.full(96 + 256, x[-1])])  # to a whole number of hops and a frame more
    frames = [held[k : k + 256].astype(np.float32) for k in range(0, len(held) - 255, 128)]
    m = np.array([np.abs(np.fft.rfft((f - f.mean()) * fingerprints._HANN)).astype(np.float32) for f in frames])
    peaks = [(t, f) for t in range(m.shape[0]) for f in range(m.shape[1]) if m[t, f] > 1 and m[t, f] >= m[max(0, t - 3) : t + 4, max(0, f - 8) : f + 9].max()]
    got = fingerprints.peaks(x)
    assert list(zip(*(a.tolist() for a in got))) == peaks and len(peaks) > 20
    pairs = []
    for k, (t, f) in enumerate(peaks):
        pairs += [(t, f << 20 | g << 8 | (u - t)) for u, g in peaks[k + 1 : k + 4] if u - t <= 24]
    assert sorted(zip(*(a.tolist() for a in fingerprints.fingerprint(x)))) == sorted(pairs)


@pytest.mark.parametrize("tail", [0, 64])
def test_every_byte_of_a_payload_reaches_its_feature(spark, tail):
    rng = random.Random(tail)
    texts = []
    for size in [*range(1, 130), 448 + tail, 576 + tail, 2112 + tail, 5000]:
        text = "".join(rng.choice("abcdefgh ") for _ in range(size))
        texts += [text, text[:-1] + "z", "z" + text[1:]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["feature"] for r in fingerprints.media_digests(df).collect()}
    for k in range(0, len(texts), 3):
        assert all((texts[k] == texts[k + j]) == (got[k] == got[k + j]) for j in (1, 2)), texts[k]


def test_no_text_but_silence_has_no_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    empty = [r["text"] for r in fingerprints.media_table(docs).join(docs, "doc_id").where("size(codes) = 0").collect()]
    assert all(not t for t in empty)


def test_an_item_without_id_is_found_but_not_named(spark):
    docs = spark.createDataFrame([(1, "one two three four")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(None, "two three"), (7, "four"), (None, None)], "item_id bigint, text string")
    r = contamination.contamination_report(docs, bench).first()
    assert (r["n_hit"], r["n_items"], r["contaminated"]) == (3, 1, True)


def test_a_benchmark_of_any_size_is_as_one_automaton(spark, docs, odd, monkeypatch):
    """Items share words and windows, one has no id; documents repeat, with the same id and without one."""
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text")
    extra = spark.createDataFrame([(900, "one two three"), (901, "two three four"), (None, "delta"), (902, None), (903, "one two three")], "item_id bigint, text string")
    bench, more = bench.unionByName(extra), spark.createDataFrame([(5, "x one two three four y delta")] * 2 + [(None, "two three four")], "doc_id bigint, text string")
    both = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text")).unionByName(more)
    want = sorted(map(str, contamination.contamination_report(both, bench).collect()))
    kept = sorted(map(str, contamination.drop_contaminated(both, bench).collect()))
    size = contamination._size(bench, "text")
    monkeypatch.setattr(contamination, "BENCHMARK_BYTES", size // 5)
    assert sorted(map(str, contamination.contamination_report(both, bench).collect())) == want
    assert sorted(map(str, contamination.drop_contaminated(both, bench).collect())) == kept and 0 < len(kept) < len(want)


def test_an_empty_benchmark_matches_nothing(spark, odd):
    bench = spark.createDataFrame([], "item_id bigint, text string")
    assert {r["contaminated"] for r in contamination.contamination_report(odd, bench).collect()} == {False}
    assert contamination.drop_contaminated(odd, bench).count() == odd.count()


def test_without_labels_no_document_is_rejected(spark, odd, docs):
    for labels in ([], [(1, 1), (3, 1), (4, 0)], [(k, None) for k in range(10)]):
        model = quality.fit(docs, spark.createDataFrame(labels, "doc_id bigint, quality int"))
        assert quality.keep_good(odd, model).count() == odd.count()
        assert {round(r["score"], 3) for r in quality.score_documents(odd, model).collect()} <= {0.5, 0.6}


def test_queries_have_one_name_each():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{k}" for k in range(1, 14)]
    assert set(queries.oracle_sql()) <= set(queries.queries())
