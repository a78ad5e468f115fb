"""Per-row kernels against libraries, round trips and brute force."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from seriesloom.llm import bpe_codec, contamination, fingerprints, jaccard_join, pieces, quality, text, token_blocks, trie_counts
from seriesloom.llm.pieces import DEFAULT_VOCABULARY, LibraryEncoder, tokenizer

LIBRARY = tokenizer(DEFAULT_VOCABULARY)
OWN = bpe_codec.codec(DEFAULT_VOCABULARY)
ODD = [
    None, "", "  ", "İstanbul ΣΑΣ Σ'S it's I'LL don'T 12ab_c__d!!! a\x1cb\x00\x7f é é ́x \xa0a\xa0b",
    "<|endoftext|>x<|startoftext|> <|endoftext|> <|end", "a" * 3000, "ab" * 700 + " x", "😀😀 日本語 １２３ ½ Ⅷ ﬁ ẛ̣ İ", " x\u0085y\x0bz\x0c", "'s's'S 'rex", "日" * 400, "ÀÉß×÷ªºµÿ x</w>y </w>",
]


def ids_of(raw: bytes) -> list[int]:
    return np.frombuffer(raw, dtype="<u4").tolist()


def any_text(rnd, size):
    """Characters of all planes, but surrogates, with some of the usual ones and of white space."""
    return "".join(chr(c) for c in (rnd.choice([rnd.randrange(32, 127), rnd.choice(b" \t\n'sStT"), rnd.randrange(0x250), rnd.randrange(0xD800), rnd.randrange(0xE000, 0x110000)]) for _ in range(size)))


def test_any_text_is_encoded_as_by_the_library():
    rnd = random.Random(12)
    for _ in range(400):
        t = any_text(rnd, rnd.randrange(60))
        want = LIBRARY.encode(t, add_special_tokens=False).ids
        assert ids_of(OWN.encode([t])[0]) == want, t
        assert OWN.decode(want) == LIBRARY.decode(want, skip_special_tokens=False), t


@pytest.mark.parametrize("limit", [10, 100_000])
def test_odd_texts_and_a_full_cache(limit):
    want = [LIBRARY.encode(t or "", add_special_tokens=False).ids for t in ODD]
    for encoder in (LibraryEncoder(DEFAULT_VOCABULARY, limit=limit), bpe_codec.RankArrayBPE(DEFAULT_VOCABULARY, limit=limit)):
        assert [ids_of(i) for i in encoder.encode(ODD)] == want
    assert OWN.decode([1, 10**7, -1]) == LIBRARY.id_to_token(1)


@pytest.mark.parametrize("block", [1, 2, 7, 64, 128])
@pytest.mark.parametrize(("size", "top"), [(0, 1), (1, 2**32), (5, 1), (128, 2**32), (399, 2**17), (400, 2**32)])
def test_blocks_give_back_any_ids(size, top, block):
    rng = np.random.default_rng(size + block)
    ids = np.where(rng.random(size) < 0.1, 2**32 - 1, rng.integers(0, top, size)).tolist()
    a = np.array(ids, dtype=np.uint32)
    data = token_blocks.pack_ids(a, block)
    assert token_blocks.unpack_ids(data).tolist() == ids
    for k in range(-(-len(ids) // block)):
        assert token_blocks.unpack_ids(data, k).tolist() == ids[k * block : (k + 1) * block]


def test_blocks_are_narrow_but_for_exceptions():
    a = np.random.default_rng(1).integers(5000, 5016, 128 * 100).astype(np.uint32)
    a[::97] = 4_000_000_000
    assert len(token_blocks.pack_ids(a)) < len(a) * 4 / 5
    with pytest.raises(ValueError, match="not a segment"):
        token_blocks.unpack_ids(b"x" * 40)


def brute_hits(doc, items, size):
    words, hit, found = text.alnum_words(doc), set(), set()
    for key, item in items:
        w = text.alnum_words(item)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            window = w[k : k + size]
            for j in range(len(words) - len(window) + 1):
                if words[j : j + len(window)] == window:
                    hit.update(range(j, j + len(window)))
                    found.add(key)
    return words, hit, found


def test_texts_without_marks_side_by_side_are_split_without_the_pattern(monkeypatch):
    rnd, pattern = random.Random(4), pieces._PIECES
    texts = ["".join(rnd.choices(["a", "bc", " ", "  ", ".", ",", "-", "'", "'s", "7", "é", "\n", "\t"], k=rnd.randrange(12))) for _ in range(20_000)]
    assert [pieces.pieces(t) for t in texts] == [pattern.findall(t) for t in texts]
    monkeypatch.setattr(pieces, "_PIECES", None)
    assert pieces.pieces("One, two. Né-é 1234 (x)\n\nend") == ["one", ",", "two", ".", "né", "-", "é", "1", "2", "3", "4", "(", "x", ")", "end"]


def test_windows_as_by_brute_force():
    rnd = random.Random(5)
    word = lambda: rnd.choice(["a", "B", "é", "d1", "ab"])
    for _ in range(150):
        items = [(k, rnd.choice([" ", ", ", "\n"]).join(word() for _ in range(rnd.choice([0, 1, 2, 3, 5, 8])))) for k in range(3)]
        doc = " ".join(word() for _ in range(rnd.randrange(25)))
        scanner = contamination.WindowScanner(contamination.windows(items, 4))
        words, hit, found = brute_hits(doc, items, 4)
        mask, got = scanner.scan(text.alnum_words(doc))
        assert (set() if mask is None else set(np.flatnonzero(mask).tolist())) == hit
        assert got == found


def test_words_have_only_a_to_z_lowered():
    assert text.alnum_words("ÀB-c\x7fD É9_x") == ["Àb".encode(), b"c", b"d", "É9".encode(), b"x"]
    assert text.space_words("A\x0bb\x1cC D e") == [b"a", "b\x1cc d".encode(), b"e"]
    assert text.alnum_words(None) == text.space_words("") == []


def brute_tokens(word, logp, longest, byte_score):
    t = trie_counts.MARK + word
    best = [(0.0, 0)] + [None] * len(t)
    for end in range(1, len(t) + 1):
        size = len(t[end - 1].encode())
        options = [(best[end - 1][0] + size * byte_score, best[end - 1][1] + size)]
        options += [(best[s][0] + logp[t[s:end]], best[s][1] + 1) for s in range(max(0, end - longest), end) if t[s:end] in logp]
        best[end] = max(options, key=lambda x: x[0])
    return best[-1]


@pytest.mark.parametrize("words", [[], ["日"], *[["".join(random.Random(k * 100 + j).choices("abcé日", k=1 + (k + j) % 8)) for j in range(k % 13)] for k in range(40)]])
def test_trie_scores_as_word_by_word(words):
    rnd = random.Random(3)
    logp = {"".join(p): -rnd.random() * 5 for p in ["a", "b", "ab", "abc", "ca", "é", "bé", trie_counts.MARK, trie_counts.MARK + "a", "cab"]}
    c = trie_counts.TrieCounter(logp)
    got = c.totals([" ".join(words), None, ""])
    want = [brute_tokens(w, logp, c.longest, c.byte_score) for w in words]
    assert got[0][0] == len(words) and got[0][2] == pytest.approx(math.fsum(s for s, _ in want))
    assert got[1] == got[2] == (0, 0, 0.0)
    assert c.nodes <= sum(len(w) + 1 for w in set(words))


def test_trie_counts_its_own_best_cut():
    c = trie_counts.TrieCounter(trie_counts.log_probabilities(trie_counts.DEFAULT_PIECES))
    words = ["the", "theory", "theorem", "zzz日", "hello"]
    found = c.learn(words)
    for w in words:
        s, n = brute_tokens(w, c.logp, c.longest, c.byte_score)
        assert found[w][1] == pytest.approx(s) and found[w][0] == n


def test_media_round_trip_and_blocks(monkeypatch):
    for t in (None, "", "x", "é" * 5000, "ab" * 40_000):
        payload, n = fingerprints.padded(t)
        assert len(payload) % 64 == 0 and len(payload) > 0 and n == len((t or "").encode())
        assert fingerprints.wav_samples(fingerprints.wav_bytes(payload)) == payload
    noise = np.random.default_rng(2).integers(0, 256, 60_000).astype(np.uint8)
    whole = fingerprints.fingerprint(noise)
    monkeypatch.setattr(fingerprints, "_BLOCK", 37)
    parts = fingerprints.fingerprint(noise)
    assert len(whole[0]) > 100 and all((a == b).all() for a, b in zip(whole, parts, strict=True))
    assert len(fingerprints.fingerprint(np.full(5000, 128, np.uint8))[0]) == 0


def test_a_tone_has_its_peak():
    t = np.arange(8000)
    tone = (128 + 100 * np.sin(2 * np.pi * 1000 * t / fingerprints.RATE)).astype(np.uint8)
    assert 1000 * fingerprints.FRAME / fingerprints.RATE in set(fingerprints.peaks(tone)[1].tolist())


@pytest.mark.parametrize("seed", range(120))
def test_linked_sets_share_a_signature(seed):
    rnd = random.Random(seed)
    common, only_a, only_b = rnd.randrange(1, 121), rnd.randrange(15) if seed % 3 else 0, rnd.randrange(15) if seed % 2 else rnd.randrange(4)
    e = np.random.default_rng(seed).integers(0, 2**63, common + only_a + only_b, dtype=np.uint64)
    a, b = np.unique(e[: common + only_a]), np.unique(np.r_[e[:common], e[common + only_a :]])
    place, sig = jaccard_join.signatures([a, np.zeros(0, np.uint64), b])
    shared = set(sig[place == 0].tolist()) & set(sig[place == 2].tolist())
    union = common + only_a + only_b
    if 100 * common >= 90 * union:
        assert shared or np.array_equal(a, b)  # equal sets are one item and need no signature
        for longs in (8, 64):
            odd = jaccard_join.parity_bits(a, longs) ^ jaccard_join.parity_bits(b, longs)
            assert sum(bin(int(x) & (2**64 - 1)).count("1") for x in odd) <= only_a + only_b
    assert not (place == 1).any()


def test_quality_of_few_or_no_labels():
    assert quality.fit_rows([]).prior == 0.5
    one = quality.fit_rows([("a good text", 1)] * 3)
    assert one.scorer().scores(["", None, "x"]).tolist() == [0.8] * 3
    tiny = quality.fit_rows([("the cat sat on the mat again", 1), ("a dog lay by the door today", 1), ("%%% $$$ ###", 0), ("!!! *** &&&", 0)])
    assert ((s := tiny.scorer().scores(["", None, "the cat"])) >= 0).all() and (s <= 1).all()


def test_a_document_hash_is_plain():
    assert hashlib.sha256(b"".join([])).hexdigest().startswith("e3b0c442")
