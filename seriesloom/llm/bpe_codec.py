"""BPE encoding and decoding with a contiguous rank array per word.

A word is held as the boundaries of its parts and the merge rank of every
adjacent pair, in two plain lists. The lowest rank is found by a scan, its
boundary is deleted, and the two ranks beside it are looked up again, until no
pair can merge. Words longer than ``LONG_WORD`` symbols take the same merges
from a heap, since the scan would be quadratic there.

Null or empty texts have no ids and decode to the empty text. Repeated rows each
get their own result; null ids are kept. Only the two columns that are asked for
are read, so extra columns cannot clash.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import DEFAULT_VOCABULARY, PieceEncoder

LONG_WORD = 256
#: Rows whose ids and decoded texts are held at a time.
AT_ONCE = 1024
_NEVER = 1 << 60


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class RankArrayBPE(PieceEncoder):
    """Encoder and decoder for a byte-level BPE file whose words end with a suffix."""

    def __init__(self, path: str, **limits):
        super().__init__(path, **limits)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.ranks = {tuple(m.split(" ") if isinstance(m, str) else m): k for k, m in enumerate(model["merges"])}
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        known = self.vocab | self.special
        self.names: list[str | None] = [None] * (max(known.values()) + 1)
        for token, i in known.items():
            self.names[i] = token
        self.bytes = {token: i.to_bytes(4, "little") for token, i in known.items()}
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.normalize, self.split = self.tokenizer.normalizer.normalize_str, self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.letters = byte_alphabet()

    def parts(self, word: str) -> list[str]:
        """Merges the symbols of one pre-token, given in the byte alphabet."""
        if len(word) > LONG_WORD:
            return self._parts_by_heap(word)
        text = word + self.suffix
        n = len(word)
        bounds = [*range(n), len(text)]
        rank = self.ranks.get
        near = [rank((text[bounds[k] : bounds[k + 1]], text[bounds[k + 1] : bounds[k + 2]]), _NEVER) for k in range(n - 1)]
        while near:
            low = min(near)
            if low == _NEVER:
                break
            k = near.index(low)
            del bounds[k + 1], near[k]
            here = text[bounds[k] : bounds[k + 1]]
            if k:
                near[k - 1] = rank((text[bounds[k - 1] : bounds[k]], here), _NEVER)
            if k < len(near):
                near[k] = rank((here, text[bounds[k + 1] : bounds[k + 2]]), _NEVER)
        return [text[a:b] for a, b in zip(bounds, bounds[1:])]

    def _parts_by_heap(self, word: str) -> list[str]:
        symbols: list[str | None] = [*word[:-1], word[-1] + self.suffix]
        n = len(symbols)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap: list[tuple[int, int, str, str]] = []

        def offer(k: int) -> None:
            if k >= 0 and (j := after[k]) >= 0 and (r := self.ranks.get((symbols[k], symbols[j]))) is not None:
                heapq.heappush(heap, (r, k, symbols[k], symbols[j]))

        for k in range(n - 1):
            offer(k)
        while heap:
            _, k, left, right = heapq.heappop(heap)
            j = after[k]
            if symbols[k] != left or j < 0 or symbols[j] != right:
                continue  # one of the two has merged since
            symbols[k], symbols[j] = left + right, None
            after[k] = after[j]
            if after[k] >= 0:
                before[after[k]] = k
            offer(before[k])
            offer(k)
        return [s for s in symbols if s is not None]

    def _word(self, word: str) -> bytes:
        return b"".join([self.bytes[p] for p in self.parts(word)])

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        return [self._word(p if p.isascii() else "".join([self.letters[b] for b in p.encode()])) for p in pieces]

    def encode_other(self, others: list[str]) -> list[bytes]:
        out = []
        for chunk in others:
            ids = []
            for part in self.split_special.split(chunk) if self.split_special else [chunk]:
                if part in self.special:
                    ids.append(self.bytes[part])
                elif part:
                    ids += [self._word(p) for p, _ in self.split(self.normalize(part))]
            out.append(b"".join(ids))
        return out

    def decode(self, ids) -> str:
        """The tokens of the ids with a space between, special tokens included; ids without a token are skipped."""
        try:
            return " ".join(map(self.names.__getitem__, ids))
        except (IndexError, TypeError):
            return " ".join([self.names[i] for i in ids if 0 <= i < len(self.names) and self.names[i] is not None])


@lru_cache(maxsize=2)
def codec(path: str) -> RankArrayBPE:
    return RankArrayBPE(path)


def encode_documents(docs: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, decoded string) for every row; ids [] and decoded "" for null and empty texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(vocabulary)
        # A whole batch would hold texts, ids and decoded texts several times over.
        for b in (b.slice(k, AT_ONCE) for b in batches for k in range(0, b.num_rows, AT_ONCE)):
            got = bpe.encode(b.column(1).to_pylist())
            ends = np.cumsum([0, *[len(i) // 4 for i in got]], dtype=np.int32)
            flat = np.frombuffer(b"".join(got), dtype="<u4").astype(np.int32)
            decoded = [bpe.decode(np.frombuffer(i, dtype="<u4").tolist()) for i in got]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): what ``encode_documents`` gives, hashed where it is made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(vocabulary)
        for b in batches:
            got = bpe.encode(b.column(1).to_pylist())
            count = [len(i) // 4 for i in got]
            ids = [hashlib.sha256(i).hexdigest() for i in got]
            decoded = [hashlib.sha256(bpe.decode(np.frombuffer(i, dtype="<u4").tolist()).encode()).hexdigest() for i in got]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(count, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
