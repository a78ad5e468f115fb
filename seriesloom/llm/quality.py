"""Quality scores from compressed sizes.

Two zstandard dictionaries are trained, one on good and one on bad labelled
texts. A text is compressed with both, in windows of ``WINDOW`` bytes; the
normalised difference of the sizes, as a whole and over the windows, and the two
ratios go through a logistic curve fitted on labelled rows that the dictionaries
have not seen, which makes the score a probability of label 1.

Fitting collects a bounded sample of whole texts: the first ids of each label in
the order of a hash, at most ``max_rows`` and as many as ``max_chars`` characters
hold. The sample may have another share of good rows than the labels; the curve's
intercept is shifted back by the difference of the log odds. Scoring reads every
text whole. Rows without label, text or id are not learnt from, nor are ids whose
labels differ; an id of several rows gives one text, the smallest. With fewer than
two rows of one label the score is constant: the share of good rows, with one more
row of each. Null and empty texts are scored as the empty text, very long ones
window by window. Repeated rows get a score each; other columns, of any name, are
not looked at, and an empty table stays empty.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import kept_by_text, quoted

WINDOW = 2048
MAX_ROWS = 4000
MAX_CHARS = 32_000_000
DICTIONARY_BYTES = 112_640
LEVEL = 3


def windows(text: bytes, size: int = WINDOW) -> list[bytes]:
    """The text in pieces of ``size`` bytes; a last piece under a quarter of that joins the one before."""
    parts = [text[k : k + size] for k in range(0, len(text), size)] or [b""]
    if len(parts) > 1 and len(parts[-1]) < size // 4:
        last = parts.pop()
        parts[-1] += last
    return parts


def train_dictionary(texts: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary; with too few texts to train one, their last bytes as raw content."""
    samples = [w for t in texts for w in windows(t) if len(w) >= 64]
    try:
        return zstandard.train_dictionary(size, samples, k=512, d=8, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"\n".join(texts)[-size:]


@dataclass
class CompressionModel:
    good: bytes
    bad: bytes
    mean: list[float] = field(default_factory=list)
    scale: list[float] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    prior: float = 0.5
    key: str = ""

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    def __init__(self, model: CompressionModel):
        self.model = model
        self.sides = [self._compressor(d) for d in (model.good, model.bad)]

    @staticmethod
    def _compressor(raw: bytes) -> zstandard.ZstdCompressor:
        options = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        if len(raw) < 8:
            return zstandard.ZstdCompressor(**options)
        d = zstandard.ZstdCompressionDict(raw)
        d.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(dict_data=d, **options)

    def features(self, text: str | None) -> list[float]:
        parts = windows((text or "").encode())
        size = np.array([len(p) for p in parts], dtype=float)
        good, bad = (np.array([len(c.compress(p)) for p in parts], dtype=float) for c in self.sides)
        each = 2 * (bad - good) / (bad + good)
        n, g, b = size.sum() + 1, good.sum(), bad.sum()
        return [(b - g) / (b + g), (b - g) / n, float(np.average(each, weights=size + 1)), each.min(), each.max(), g / n, b / n]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        m = self.model
        if not m.weights:
            return np.full(len(texts), m.prior)
        x = (np.array([self.features(t) for t in texts]).reshape(len(texts), -1) - m.mean) / m.scale
        return 1 / (1 + np.exp(-np.clip(x @ np.array(m.weights[1:]) + m.weights[0], -40, 40)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 40) -> np.ndarray:
    a = np.c_[np.ones(len(x)), x]
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + ridge * np.eye(len(w)), a.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit_rows(rows: list[tuple[str, int]], dictionary_bytes: int = DICTIONARY_BYTES, of_all: tuple[int, int] | None = None) -> CompressionModel:
    """Learns from (text, label) rows: even places train the dictionaries, odd ones the curve. of_all: how many good and bad
    rows there are where the rows are a sample of another share."""
    texts = {k: [t.encode() for t, y in rows if y == k] for k in (1, 0)}
    n1, n0 = len(texts[1]), len(texts[0])
    model = CompressionModel(b"", b"", key=uuid.uuid4().hex)
    good, bad = of_all or (n1, n0)
    model.prior = (good + 1) / (good + bad + 2)
    if min(n1, n0) < 2:
        return model
    # Lines that good texts have too say nothing against a text.
    shared = {line for t in texts[1] for line in t.split(b"\n") if len(line) > 8}
    worse = [b"\n".join([line for line in t.split(b"\n") if line not in shared]) for t in texts[0][::2]]
    model.good, model.bad = train_dictionary(texts[1][::2], dictionary_bytes), train_dictionary(worse, dictionary_bytes)
    scorer = model.scorer()
    x = np.array([scorer.features(t.decode()) for k in (1, 0) for t in texts[k][1::2]])
    y = np.array([k for k in (1, 0) for _ in texts[k][1::2]], dtype=float)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    model.mean, model.scale = mean.tolist(), scale.tolist()
    model.weights = _logistic((x - mean) / scale, y).tolist()
    model.weights[0] += float(np.log(good / bad) - np.log(y.sum() / (len(y) - y.sum())))
    return model


def held_out(id_col: Column) -> Column:
    """crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> CompressionModel:
    """Fits on labelled rows that are not held out, at most ``max_rows`` and ``max_chars`` characters of each label."""
    known = labels.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(label_col)).cast("int").alias("y")).where("y in (0, 1)")
    known = known.where(F.col("id").isNotNull() & ~held_out(F.col("id")))
    known = known.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("top")).where("y = top").select("id", "y")
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    drawn = [known.where(F.col("y") == k).orderBy(F.xxhash64("id"), "id").limit(max_rows) for k in (1, 0)]
    sample = drawn[0].unionByName(drawn[1])
    texts = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text")).where("text is not null")
    # At most 2 x max_rows labels are broadcast; lengths tell which texts are drawn, and only those travel.
    sizes = texts.join(F.broadcast(sample), "id").groupBy("id", "y").agg(F.max(F.length("text")).alias("n"))
    so_far = F.sum("n").over(Window.partitionBy("y").orderBy(F.xxhash64("id"), "id"))
    drawn = sizes.withColumn("so_far", so_far).where(F.col("so_far") <= max_chars).select("id", "y").limit(2 * max_rows)
    rows = texts.join(F.broadcast(drawn), "id").groupBy("id", "y").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: (str(r["id"]), r["y"]))
    return fit_rows([(r["text"], r["y"]) for r in rows], of_all=(counts.get(1, 0), counts.get(0, 0)))


_SCORERS: dict[str, Scorer] = {}


def _scorer(model: CompressionModel) -> Scorer:
    if model.key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[model.key] = model.scorer()
    return _SCORERS[model.key]


def score_documents(docs: DataFrame, model: CompressionModel, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) for every row; only the text goes into the score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(model)
        for b in batches:
            s = scorer.scores(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def keep_good(docs: DataFrame, model: CompressionModel, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The documents whose score reaches the threshold, with all their columns. A model that saw fewer than two labels of a
    kind cannot tell texts apart: it rejects none."""
    if not model.weights:
        return docs
    return kept_by_text(docs, text_col, lambda texts: _scorer(model).scores(texts) >= threshold)
