"""Media columns: WAV bytes, spectra and time-coded fingerprints.

A payload is stored as 8-bit mono samples in a WAV file built by the ``wave``
module and read back by it. A short-time Fourier transform (Hann window) gives
magnitudes; peaks are bins that are the largest of their neighbourhood of
frames and bins; every peak is paired with the next peaks in a target zone. A
pair (f1, f2, dt) is one 32-bit code stored with the frame of its first peak.

Payloads of any length work: frames are transformed in blocks, so memory does
not grow with a text. A signal is held at its last sample until every sample
lies in two frames, so it has two frames or more. Each frame is taken without its
mean, so that the level of a signal makes no peaks: silence (any constant signal)
has no peaks and no pairs. Beside the pairs each hop of samples has its power, a
whole number that any change of one sample changes.
Equal payloads have equal features. Null texts are empty texts, repeated rows have
a row each, an empty table gives an empty one, and other columns of any name are
left out.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATE = 8000
FRAME, HOP = 256, 128
#: A peak is the largest of this many frames and bins on each side.
NEAR_FRAMES, NEAR_BINS = 3, 8
#: Pairs of a peak: with so many next ones (of its frame those of higher bins, then later frames), at most this many frames away.
FAN, ZONE = 3, 24
_BLOCK = 4096
_HANN = np.hanning(FRAME + 1)[:-1].astype(np.float32)


def wav_bytes(payload: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def wav_samples(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        if (r.getnchannels(), r.getsampwidth()) != (1, 1):
            raise ValueError("8-bit mono samples are expected")
        return r.readframes(r.getnframes())


def padded(text: str | None, unit: int = 64) -> tuple[bytes, int]:
    raw = (text or "").encode()
    return raw.ljust(max(1, -(-len(raw) // unit)) * unit, b"\0"), len(raw)


def _spectra(samples: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first frame, magnitudes of up to _BLOCK frames with NEAR_FRAMES more on each side that exists)."""
    samples = np.pad(samples, (0, -len(samples) % HOP + FRAME), mode="edge")
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    for k in range(0, len(frames), _BLOCK):
        part = frames[max(0, k - NEAR_FRAMES) : k + _BLOCK + NEAR_FRAMES].astype(np.float32)
        part -= part.mean(axis=1, keepdims=True)
        yield k, np.abs(np.fft.rfft(part * _HANN, axis=1)).astype(np.float32)


def _widest(x: np.ndarray, reach: int, axis: int) -> np.ndarray:
    """Maximum over ``reach`` places on each side, by doubling."""
    x = np.moveaxis(x, axis, 0)
    size, n, have = 2 * reach + 1, len(x), 1
    out = np.concatenate([np.full((reach, *x.shape[1:]), -1, x.dtype), x, np.full((reach, *x.shape[1:]), -1, x.dtype)])
    while have < size:
        step = min(have, size - have)
        out = np.maximum(out[:-step], out[step:])
        have += step
    return np.moveaxis(out[:n], 0, axis)


def peaks(samples: np.ndarray, floor: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """(frame, bin) of all peaks in order of time, then of frequency; neighbours that are equally large are all peaks."""
    times, bins = [], []
    for k, m in _spectra(samples):
        top = (m >= _widest(_widest(m, NEAR_BINS, 1), NEAR_FRAMES, 0)) & (m > floor)
        t, f = np.nonzero(top)
        t = t + max(0, k - NEAR_FRAMES)
        own = (t >= k) & (t < k + _BLOCK)
        times.append(t[own])
        bins.append(f[own])
    return np.concatenate(times), np.concatenate(bins)


def fingerprint(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frame of the first peak, code f1 << 20 | f2 << 8 | dt) of all pairs, in order of time; a lone peak is its own partner."""
    t, f = peaks(samples)
    n = len(t)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if n == 1:
        return t, f.astype(np.int64) << 20 | f.astype(np.int64) << 8
    at, code = [], []
    for j in range(FAN):
        k = np.arange(n) + j + 1  # peaks are sorted by frame, then by bin
        ok = k < n
        dt = np.where(ok, t[np.minimum(k, n - 1)] - t, ZONE + 1)
        ok &= dt <= ZONE
        at.append(np.flatnonzero(ok))
        code.append((f[ok].astype(np.int64) << 20) | (f[k[ok]].astype(np.int64) << 8) | dt[ok])
    order = np.argsort(np.concatenate(at), kind="stable")
    return t[np.concatenate(at)[order]], np.concatenate(code)[order]


def powers(samples: np.ndarray) -> np.ndarray:
    """Sum of squares of each hop of samples, the last one filled up with zeros."""
    x = np.pad(samples.astype(np.int64), (0, -len(samples) % HOP))
    return (x * x).reshape(-1, HOP).sum(axis=1)


def media_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media binary, frames array<int>, codes array<int>, powers array<int>): the stored form, its
    fingerprint and the power of each hop."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, text in enumerate(b.column(1).to_pylist()):
                payload, n = padded(text)
                media = wav_bytes(payload)
                x = np.frombuffer(wav_samples(media), np.uint8)
                t, c = fingerprint(x)
                columns = [b.column(0).slice(k, 1), pa.array([n], pa.int64()), pa.array([media], pa.binary()), pa.array([t.astype(np.int32)], pa.list_(pa.int32())), pa.array([c.astype(np.int32)], pa.list_(pa.int32())), pa.array([powers(x).astype(np.int32)], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "media", "frames", "codes", "powers"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"doc_id {kind}, n_bytes bigint, media binary, frames array<int>, codes array<int>, powers array<int>")


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What ``media_table`` stores, hashed where it is made; feature: pairs, different codes, and a hash of the
    time-coded arrays (frames, codes, powers)."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                payload, n = padded(text)
                media = wav_bytes(payload)
                back = wav_samples(media)
                x = np.frombuffer(back, np.uint8)
                t, c = fingerprint(x)
                code = hashlib.sha256(b"".join(a.astype("<i4").tobytes() for a in (t, c, powers(x)))).hexdigest()[:32]
                feature = f"{len(c)}:{len(np.unique(c))}:{code}"
                rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            columns = zip(*rows) if rows else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(list(c), t) for c, t in zip(columns, types, strict=True)]], names)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
