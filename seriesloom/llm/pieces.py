"""Splits texts into pre-tokens and encodes each distinct one once per worker.

Texts of visible ASCII and Latin-1 letters are split by the file's own pattern,
written out for these characters. Any other text is cut at ASCII blanks: the
tokenizer's pattern never matches white space and its normaliser never composes
across it, so such a chunk can be encoded by itself. A worker keeps the first
pieces that it meets, up to a fixed number; later ones are encoded for the texts
at hand. The limit changes the time taken and never the result.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one core per Spark task

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

DEFAULT_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")

#: Visible ASCII, blanks and Latin-1 letters: each letter is one code point, in composed form, with one lower case.
_SIMPLE = re.compile(r"[\x20-\x7e\n\t\rÀ-ÖØ-öø-ÿ]*")
#: What the file's own pattern matches in such a text once it is lower-cased.
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ \n\t\r]+")
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def chunks(text: str | None) -> list[str]:
    """The parts of a text between spaces, tabs and line ends."""
    if not text:
        return []
    return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")


def is_simple(text: str) -> bool:
    return _SIMPLE.fullmatch(text) is not None and "<|" not in text


def _simple_pieces(text: str) -> list[str]:
    """What ``_PIECES`` matches in a simple text in lower case. Where no two marks stand side by side and there is no
    apostrophe, each mark and each digit is a piece and so is all else between blanks, which needs no pattern."""
    if "'" in text:
        return _PIECES.findall(text)
    apart = text
    for c in _MARKS:
        if c in text:
            apart = apart.replace(c, f"\0{c}\0")
    if "\0\0" in apart:
        return _PIECES.findall(text)
    apart = apart.replace("\0", " ")
    for c in "0123456789":
        if c in text:
            apart = apart.replace(c, f" {c} ")
    return apart.split()


def pieces(text: str | None) -> list[str]:
    """Pre-tokens where the rules are written out above, else chunks for the tokenizer's own rules."""
    if not text:
        return []
    if is_simple(text):
        return _simple_pieces(text.lower())
    out: list[str] = []
    for c in chunks(text):
        if is_simple(c):
            out += _simple_pieces(c.lower())
        else:
            out.append(c)
    return out


class Kept(dict):
    """The first ``limit`` values that are put in; what ``extra`` has is found as well."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.extra = limit, {}

    def __missing__(self, key):
        return self.extra[key]

    def put(self, new: dict) -> None:
        room = self.limit - len(self)
        if room >= len(new):
            self.update(new)
        else:
            items = iter(new.items())
            self.update(x for _, x in zip(range(room), items))
            self.extra.update(items)


class PieceEncoder:
    """Ids of texts as little-endian uint32 bytes; subclasses encode simple pieces and other chunks."""

    def __init__(self, path: str, limit: int = 350_000):
        self.tokenizer = tokenizer(path)
        self.known = Kept(limit)

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        raise NotImplementedError

    def encode_other(self, others: list[str]) -> list[bytes]:
        raise NotImplementedError

    def _learn(self, new: set[str]) -> None:
        simple, other = [], []
        for p in new:
            (simple if is_simple(p) else other).append(p)
        self.known.put(dict(zip(simple, self.encode_pieces(simple), strict=True)))
        self.known.put(dict(zip(other, self.encode_other(other), strict=True)))

    def encode(self, texts: list[str | None], at_once: int = 512) -> list[bytes]:
        out = []
        for k in range(0, len(texts), at_once):
            split = [pieces(t) for t in texts[k : k + at_once]]
            if new := set().union(*split) - self.known.keys():
                self._learn(new)
            get = self.known.__getitem__
            out += [b"".join(map(get, parts)) for parts in split]
            self.known.extra = {}
        return out


class LibraryEncoder(PieceEncoder):
    """By the tokenizers library. Simple pieces go to it many at a time, as the words of one text: each ends in the only
    token of it that carries the end-of-word mark, which tells the pieces apart again."""

    def __init__(self, path: str, **limits):
        super().__init__(path, **limits)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for k in range(0, len(pieces), 4096):
            group = pieces[k : k + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(group)], add_special_tokens=False)[0].ids, dtype="<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(group):  # a file whose tokens have no such mark
                out += self.encode_other(group)
                continue
            raw, at = ids.tobytes(), [0, *(stops * 4).tolist()]
            out += [raw[a:b] for a, b in zip(at, at[1:])]
        return out

    def encode_other(self, others: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(others, add_special_tokens=False)]


@lru_cache(maxsize=2)
def library_encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)
