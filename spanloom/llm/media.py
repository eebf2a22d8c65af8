"""Media columns: bytes kept as WAV, read back by the wave module, with spectral-peak pair fingerprints.

A payload is a text's UTF-8 bytes, then bytes 255 up to a positive multiple of
FRAME. ``store`` writes it as 8-bit mono samples, a WAV file in a binary column of a table in the
shared folder. ``features`` reads such a column: short-time Fourier
transforms of HOP-spaced Hann windows, the strongest local peaks of each
spectrum, and pairs of a peak with those that follow it. A pair is a
64-bit code: frame number, both frequencies and the frames between them; an array of them
in order of time is a sound's fingerprint. All work is by row, so nothing is shuffled,
and spectra are taken BLOCK frames at a time whatever a sound's length.

Defined cases: a null or empty text gives FRAME bytes 255. Equal texts give equal values; repeated rows are
stored each. A null in the media column gives nulls. An empty table gives no rows. Columns other than
those named are ignored.
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
from pyspark.sql import types as T

from .common import column, written

FRAME, HOP, RATE = 576, 288, 8000
#: Peaks of a frame, later peaks that each is paired with, and the most frames between them.
PEAKS, FAN, REACH = 3, 3, 63
BLOCK = 1024
#: Bytes of the payload that tail_crc32 covers.
TAIL = 32

_WINDOW = np.hanning(FRAME + 1)[:-1]


def payload_of(text: bytes) -> bytes:
    return text + b"\xff" * (FRAME - len(text) % FRAME if len(text) % FRAME or not text else 0)


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        if (r.getnchannels(), r.getsampwidth()) != (1, 1):
            raise ValueError("not 8-bit mono")
        return r.readframes(r.getnframes())


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers and frequency bins of the strongest local peaks of each spectrum, by frame and frequency."""
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP] if len(samples) >= FRAME else np.zeros((0, FRAME), np.uint8)
    at, bins = [], []
    for low in range(0, len(frames), BLOCK):
        part = (frames[low : low + BLOCK].astype(np.float64) - 128) * _WINDOW
        power = np.abs(np.fft.rfft(part, axis=1)).astype(np.float32)
        local = np.zeros_like(power)
        inner = power[:, 1:-1]
        np.copyto(local[:, 1:-1], inner, where=(inner > power[:, :-2]) & (inner >= power[:, 2:]) & (inner > 1))
        top = np.sort(np.argpartition(local, -PEAKS, axis=1)[:, -PEAKS:], axis=1)
        there = np.take_along_axis(local, top, 1) > 0
        at.append(np.repeat(np.arange(low, low + len(part)), PEAKS)[there.ravel()])
        bins.append(top.ravel()[there.ravel()])
    return (np.concatenate(at), np.concatenate(bins)) if at else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def landmarks(samples: np.ndarray) -> np.ndarray:
    """Codes of peak pairs: frame << 32 | first bin << 20 | second bin << 8 | frames between."""
    at, bins = peaks(samples)
    out = []
    for k in range(1, FAN + 1):
        apart = at[k:] - at[:-k]
        near = apart <= REACH
        out.append((at[:-k] << 32 | bins[:-k] << 20 | bins[k:] << 8 | apart)[near])
    return np.sort(np.concatenate(out)).astype(np.int64)


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media of each row of docs (doc_id, text), as a table in the shared folder."""
    base = docs.select(column(docs, "doc_id", "long").alias("doc_id"), F.coalesce(column(docs, "text", "string"), F.lit("")).cast("binary").alias("text"))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, 1):
                media = [to_wav(payload_of(x.as_py())) for x in part.column(1)]
                lengths = [len(x.as_py()) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lengths, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return written(base.mapInArrow(kept, "doc_id long, n_bytes long, media binary"), "media")


def _parts(batch: pa.RecordBatch, at: int, rows: int = 256) -> Iterator[pa.RecordBatch]:
    for low in range(0, batch.num_rows, rows):
        yield batch.slice(low, rows)


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, landmarks array<long>"


def _feature(media: bytes | None) -> tuple:
    if media is None:
        return (None,) * 7
    payload = from_wav(media)
    codes = landmarks(np.frombuffer(payload, np.uint8))
    feature = f"{len(codes)}:{hashlib.sha256(codes.astype('<i8').tobytes()).hexdigest()}"
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-TAIL:]), len(media), hashlib.sha256(media).hexdigest(), feature, codes


def features(media: DataFrame) -> DataFrame:
    """The columns of media but for the sounds, and what is computed from each: digests, a feature string and the landmarks."""
    others = [c for c in media.columns if c != "media"]
    base = media.select(*[F.col(f"`{c}`") for c in others], "media")
    names = [x.split()[0] for x in FEATURES.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64())]

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, len(others)):
                columns = list(zip(*(_feature(x.as_py()) for x in part.column(len(others))), strict=True))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[*others, *names])

    return base.mapInArrow(measured, T.StructType([*base.schema.fields[:-1], *T.StructType.fromDDL(FEATURES).fields]))
