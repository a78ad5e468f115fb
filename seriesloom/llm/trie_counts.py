"""Token counts by dynamic programming over a trie of pre-tokens.

A pre-token is a run of characters between white space, with the mark U+2581 in
front. Its unigram tokens are the cut with the highest sum of log probabilities;
a character that no piece covers costs one byte token for each of its UTF-8
bytes. The best score of a prefix does not depend on what follows it, so the
distinct pre-tokens of a batch are put in a trie and the score of each node is
computed once, from its ancestors, however many pre-tokens pass through it; the
count at a terminal node is the pre-token's. Sorted order visits the trie depth
first, and only the branch at hand is held.

Log probabilities follow a rule: -ln(rank + 2.7) of the piece's place in the
vocabulary file. Equal scores prefer the longer last piece. Null and empty texts
have no tokens. A very long pre-token is a long branch, held alone. Repeated rows
have a row each; other columns, of any name, are not looked at, and an empty table
gives an empty one. No shuffle: each row is counted where it is read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_PIECES = public_tokenizers.path("piece_bpe_32k.model")
MARK = "▁"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def log_probabilities(path: str) -> dict[str, float]:
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return {
        model.id_to_piece(i): -math.log(i + 2.7)
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    }


class TrieCounter:
    """``learn(words)`` sets ``counts[word]`` to (tokens, score) for distinct pre-tokens."""

    def __init__(self, logp: dict[str, float], limit: int = 300_000):
        self.logp, self.limit = logp, limit
        self.longest = max(map(len, logp), default=1)
        self.byte_score = min(logp.values(), default=0.0) - 10.0
        self.counts: dict[str, tuple[int, float]] = {}
        self.nodes = 0

    def learn(self, words: list[str]) -> dict[str, tuple[int, float]]:
        """Scores every trie node of the words once; gives the terminals."""
        get, longest, found = self.logp.get, self.longest, {}
        best, count = [0.0], [0]  # along the branch at hand: node at depth k
        last = ""
        for w in sorted(words):
            text = MARK + w
            same = 0
            for x, y in zip(last, text):
                if x != y:
                    break
                same += 1
            del best[same + 1 :], count[same + 1 :]
            for end in range(same + 1, len(text) + 1):
                size = len(text[end - 1].encode())
                top, n = best[end - 1] + size * self.byte_score, count[end - 1] + size
                for start in range(end - 1, max(0, end - longest) - 1, -1):
                    p = get(text[start:end])
                    if p is not None and best[start] + p >= top:
                        top, n = best[start] + p, count[start] + 1
                best.append(top)
                count.append(n)
            self.nodes += len(text) - same
            last = text
            found[w] = (count[-1], best[-1])
        return found

    def totals(self, texts: list[str | None]) -> list[tuple[int, int, float]]:
        """(pre-tokens, tokens, summed score) of each text."""
        split = [_WORD.findall(t) if t else [] for t in texts]
        if len(self.counts) > self.limit:
            self.counts.clear()
        self.counts.update(self.learn(set().union(*split) - self.counts.keys()))
        out = []
        for words in split:
            pairs = [self.counts[w] for w in words]
            out.append((len(words), sum([n for n, _ in pairs]), math.fsum([s for _, s in pairs])))
        return out


@lru_cache(maxsize=1)
def _counter(path: str) -> TrieCounter:
    return TrieCounter(log_probabilities(path))


def token_counts(docs: DataFrame, pieces: str = DEFAULT_PIECES, id_col: str = "doc_id", text_col: str = "text", at_once: int = 2000) -> DataFrame:
    """(doc_id, n_pretokens, n_tokens, log_prob) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(pieces)
        for b in batches:
            texts = b.column(1).to_pylist()
            rows = [r for k in range(0, len(texts), at_once) for r in counter.totals(texts[k : k + at_once])]
            n, tokens, score = zip(*rows) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(tokens, pa.int64()), pa.array(np.array(score, dtype=float))], ["doc_id", "n_pretokens", "n_tokens", "log_prob"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"doc_id {kind}, n_pretokens bigint, n_tokens bigint, log_prob double")
