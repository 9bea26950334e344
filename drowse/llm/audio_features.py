"""Media column of 8-bit audio, and its features: polyphase resampling, overlapped log-mel frames, hysteresis segments.

Payload bytes become the samples of a mono 8-bit PCM wave file, unchanged, and are written to the shared folder. From the files read
back: samples are resampled from RATE to RATE * UP / DOWN by a windowed-sinc filter, of whose UP branches each makes every UP-th
output and no other value is computed; the result is cut into overlapping frames and turned into log-mel energies, in steps of
1 / STEPS. Each document's frames are stored as tensors of the fixed shape (FRAMES, MELS), with the time span of each; `tensor_column` is
their Arrow fixed-shape tensor array. The feature is made of the tensors read back. A segment starts where frame energy reaches a high
level and lasts until it drops below a low one.

A null text counts as empty: the payload is one unit of padding. Long texts are worked in blocks of frames; a very long one is one row, so
memory follows the longest text. Equal texts give equal values whatever rows are beside them, and repeated rows repeated rows. Ids,
null or not, pass unchanged; other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, materialize, slices, table

UNIT, PAD = 576, b"\xff"
RATE, UP, DOWN, TAPS = 16_000, 2, 3, 24
FRAME, HOP, FFT, MELS, FRAMES, STEPS = 256, 128, 256, 24, 8, 64
FLOOR = 1e-6
BLOCK = 4096  # frames worked at a time


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + PAD * (-len(raw) % UNIT if raw else UNIT)


def to_wave(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wave(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def low_pass(up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    n = np.arange(taps * up) - (taps * up - 1) / 2
    h = np.sinc(n / max(up, down)) * np.hamming(taps * up)
    return (h / h.sum() * up).astype(np.float32)


def resample(x: np.ndarray, start: int, stop: int, up: int = UP, down: int = DOWN) -> np.ndarray:
    """Outputs start..stop of x resampled by up/down: output m is branch (m * down) % up of the filter at input m * down // up. The
    outputs of a branch are `down` inputs apart."""
    h, y = low_pass(up, down), np.empty(stop - start, np.float32)
    padded = np.concatenate([np.zeros(TAPS - 1, np.float32), x, np.zeros(TAPS, np.float32)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, TAPS)  # row i ends at input i
    for p in range(up):
        first = (p - start) % up
        n = len(range(first, stop - start, up))
        if n:
            at = (start + first) * down // up
            y[first::up] = windows[at : at + (n - 1) * down + 1 : down] @ h[(start + first) * down % up :: up][::-1]
    return y


def mel_filters(rate: float = RATE * UP / DOWN) -> np.ndarray:
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(50), mel(rate / 2), MELS + 2) / 2595) - 1)
    f = np.arange(FFT // 2 + 1) * rate / FFT
    rise, fall = (f[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


FILTERS, WINDOW = mel_filters(), np.hanning(FRAME).astype(np.float32)


def log_mel(samples: np.ndarray) -> np.ndarray:
    """Frames x MELS from unsigned 8-bit samples."""
    x = (samples.astype(np.float32) - 128) / 128
    n = len(x) * UP // DOWN
    frames = max(1, 1 + (n - FRAME) // HOP)
    out = np.empty((frames, MELS), np.float32)
    for a in range(0, frames, BLOCK):
        b = min(frames, a + BLOCK)
        y = resample(x, a * HOP, (b - 1) * HOP + FRAME)
        cut = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP] * WINDOW
        spectrum = np.fft.rfft(cut, FFT, axis=1)
        out[a:b] = np.log((spectrum.real**2 + spectrum.imag**2) @ FILTERS + FLOOR)
    return np.rint(out * STEPS) / STEPS


def segments(mel: np.ndarray) -> list[tuple[int, int]]:
    """Frames [start, end) in which energy has reached the high level and not yet dropped below the low one."""
    e = mel.mean(axis=1)
    high, low = e.mean() + 0.5 * e.std(), e.mean() - 0.25 * e.std()
    turn = np.where(e >= high, 1, np.where(e < low, -1, 0))
    last = np.maximum.accumulate(np.where(turn != 0, np.arange(len(e)), -1))
    on = np.concatenate([[0], (last >= 0) & (turn[last] == 1), [0]]).astype(np.int8)
    edge = np.diff(on)
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))


def media_column(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_bytes, media: the wave file of each text."""

    def run(texts: list[str | None]) -> tuple[None, list[pa.Array]]:
        made = [payload_of(t) for t in texts]
        return None, [pa.array([n for n, _ in made], pa.int64()), pa.array([to_wave(p) for _, p in made], pa.binary())]

    return map_texts(docs, key, text, lambda: run, {"n_bytes": "long", "media": "binary"})


FACTS = {"payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string"}
TENSORS = {"n_frames": "long", "start_s": "array<double>", "end_s": "array<double>", "tensors": "array<array<float>>"}


def facts(media: bytes) -> tuple:
    payload = from_wave(media)
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest()


def tensors(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_bytes, FACTS, and the log-mel frames: n_frames, and start_s, end_s and values of each tensor. The last one is filled up with
    the floor."""
    step, kinds = HOP * DOWN / (RATE * UP), [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def of(m: bytes) -> tuple:
        mel = log_mel(np.frombuffer(from_wave(m), np.uint8))
        full = np.concatenate([mel, np.full((-len(mel) % FRAMES, MELS), np.rint(np.log(FLOOR) * STEPS) / STEPS, np.float32)])
        edges = [*range(0, len(mel), FRAMES), len(mel)]
        return len(mel), [a * step for a in edges[:-1]], [b * step for b in edges[1:]], full

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            media_ = b.column("media").to_pylist()
            told, made = [facts(m) for m in media_], [of(m) for m in media_]
            columns = [pa.array([t[i] for t in told], kind) for i, kind in enumerate(kinds)]
            columns += [pa.array([x[0] for x in made], pa.int64()), *[pa.array([x[i] for x in made], pa.list_(pa.float64())) for i in (1, 2)]]
            values = np.concatenate([np.empty((0, MELS), np.float32), *[x[3] for x in made]]).astype(np.float32)
            each = tensor_column(pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), FRAMES * MELS))
            ends = np.cumsum([0, *[len(x[1]) for x in made]])
            columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each.storage.cast(pa.list_(pa.float32()))))
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("n_bytes"), *columns], ["k", "n_bytes", *FACTS, *TENSORS])

    own = media.select(F.col(key).alias("k"), "n_bytes", "media")
    schema = ", ".join(f"{c} {kind}" for c, kind in ({"k": dict(own.dtypes)["k"], "n_bytes": "long"} | FACTS | TENSORS).items())
    return own.mapInArrow(run, schema).withColumnRenamed("k", key)


def tensor_column(values: pa.Array) -> pa.FixedShapeTensorArray:
    """An Arrow fixed-shape tensor array over lists of FRAMES * MELS values; any other length is an error."""
    kind = pa.fixed_shape_tensor(pa.float32(), [FRAMES, MELS])
    return pa.ExtensionArray.from_storage(kind, values.cast(kind.storage_type))


def features(stored: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_bytes, FACTS and feature, from the tensors of `tensors`: frames, segments, frames in segments, mean log-mel in hundredths."""

    def told(mel: np.ndarray) -> str:
        spans = segments(mel)
        means = ",".join(str(round(float(v) * 100)) for v in mel.mean(axis=0, dtype=np.float64))
        return f"{len(mel)}:{len(spans)}:{sum(b - a for a, b in spans)}:{means}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            lists, n = b.column("tensors"), b.column("n_frames").to_pylist()
            mel = tensor_column(lists.flatten()).to_numpy_ndarray().reshape(-1, MELS)
            starts = np.cumsum([0, *[-(-x // FRAMES) * FRAMES for x in n]])
            out = pa.array([told(mel[a : a + x]) for a, x in zip(starts, n, strict=False)], pa.string())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("k", "n_bytes", *FACTS)], out], ["k", "n_bytes", *FACTS, "feature"])

    own = stored.select(F.col(key).alias("k"), "n_bytes", *FACTS, "n_frames", "tensors")
    schema = ", ".join(f"{c} {kind}" for c, kind in ({"k": dict(own.dtypes)["k"], "n_bytes": "long"} | FACTS | {"feature": "string"}).items())
    return own.mapInArrow(run, schema).withColumnRenamed("k", key)


def op6_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = materialize(media_column(table(spark, sf_dir, "documents")), "media")
    return features(materialize(tensors(media), "tensors"))
