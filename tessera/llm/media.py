"""Texts as media columns: WAV payloads and spectral-peak fingerprints.

A payload of bytes is stored losslessly as 8-bit mono samples by the wave module and
read back from the stored form; everything else is computed from what was read.  The
samples go through a short-time Fourier transform, its strongest bins are paired with
those of the next frames, and each pair is a fingerprint with the time of its first
frame.  All work is per row, so nothing is shuffled.
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

from tessera.llm.common import pick

RATE, FRAME, HOP = 8000, 512, 256
#: Bands of bins of which each gives its strongest one, and how many frames ahead a peak is paired.
BANDS, AHEAD = ((1, 16), (16, 64), (64, 257)), 2
#: Frames transformed at once.
BLOCK = 4096
_HANN = np.hanning(FRAME).astype(np.float32)


def padded(data: bytes, unit: int = 64) -> bytes:
    """data and bytes 0 up to a positive multiple of `unit`."""
    return data + bytes(max(unit, -(-len(data) // unit) * unit) - len(data))


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored), "rb") as w:
        return w.readframes(w.getnframes())


def peaks(samples: bytes) -> np.ndarray:
    """frames x bands: the strongest bin of each band, the lowest of equal ones, 0 in a silent band."""
    x = np.frombuffer(samples, np.uint8).astype(np.float32) - 128
    if len(x) < FRAME + AHEAD * HOP:  # too short for a pair of frames: repeated
        x = np.resize(x, FRAME + AHEAD * HOP)
    frames = max(1, -(-(len(x) - FRAME) // HOP) + 1)
    x = np.pad(x, (0, max(0, FRAME + (frames - 1) * HOP - len(x))))
    windows = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    found = np.zeros((frames, len(BANDS)), np.int64)
    for at in range(0, frames, BLOCK):
        power = np.abs(np.fft.rfft(windows[at : at + BLOCK] * _HANN, axis=1))
        for b, (low, high) in enumerate(BANDS):
            band = power[:, low:high]
            found[at : at + BLOCK, b] = np.where(band.max(1) > 1e-2, band.argmax(1) + low, 0)
    return found


def fingerprints(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Times (frame numbers) and hashes: bin, later bin in the same or a neighbouring band, and distance."""
    found = peaks(samples)
    times, codes = [], []
    for ahead in range(1, AHEAD + 1):
        for b in range(len(BANDS)):
            c = (b + ahead - 1) % len(BANDS)
            first, second = found[:-ahead, b], found[ahead:, c]
            keep = (first > 0) & (second > 0)
            times.append(np.flatnonzero(keep))
            codes.append(((first << 12) | (second << 2) | ahead)[keep])
    times, codes = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((codes, times))
    return times[order], codes[order]


def _media(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns: list[list] = [[] for _ in range(6)]
        times, codes, ends = [], [], [0]
        for text in batch.column(1):
            data = (text.as_py() or "").encode()
            stored = to_wav(padded(data))
            payload = from_wav(stored)
            t, c = fingerprints(payload)
            for column, value in zip(columns, (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest()), strict=True):
                column.append(value)
            times.append(t)
            codes.append(c)
            ends.append(ends[-1] + len(t))
        flat = pa.StructArray.from_arrays([pa.array(np.concatenate([[], *times]).astype(np.int32)), pa.array(np.concatenate([[], *codes]).astype(np.int32))], ["frame", "code"])
        prints = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
        yield pa.record_batch(
            [batch.column(0), *(pa.array(v, k) for v, k in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)), prints],
            names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "fingerprints"],
        )


def media_columns(docs: DataFrame) -> DataFrame:
    """doc_id, sizes and digests of payload and WAV, and fingerprints array<struct<frame, code>>.

    One row for each row of docs.  A null text counts as empty: its payload is 64 bytes 0.
    Equal texts give equal values, wherever they stand.  Other columns are ignored; an
    empty table gives an empty result.
    """
    own = pick(docs, doc_id="long", text="string")
    return own.mapInArrow(_media, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, fingerprints array<struct<frame:int,code:int>>")


def wav_of(docs: DataFrame) -> DataFrame:
    """doc_id and the stored WAV itself, for writing out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([to_wav(padded((t.as_py() or "").encode())) for t in batch.column(1)], pa.binary())], names=["doc_id", "wav"])

    return pick(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, wav binary")


def digest(media: DataFrame) -> DataFrame:
    """media with the fingerprints as one string, frame:code joined by commas."""
    joined = F.array_join(F.transform("fingerprints", lambda p: F.concat_ws(":", p["frame"].cast("string"), p["code"].cast("string"))), ",")
    return media.withColumn("feature", joined).drop("fingerprints")
