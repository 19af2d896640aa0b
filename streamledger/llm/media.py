"""Media columns: WAV storage, short-time Fourier transforms and spectral-peak pair fingerprints (operator 2).

Bytes are stored as mono 8-bit samples in WAV form and read back by the wave
module, so a media column holds complete WAV files. The reader's samples are cut
into frames of `FRAME` samples, each half overlapping the next; a Hann window and
a real FFT give magnitudes. A frame's peaks are its local maxima over frequency
that stand above the frame's mean, strongest first, `PEAKS` a frame (equal
magnitudes: the lower frequency first). Every peak is paired with the weaker peaks
of its own frame and with the peaks of the next `REACH` frames; a pair is the code
f1 | f2 | dt, stored with the number of its first frame. That array of (time, code)
is the fingerprint; pairs within a frame give one to inputs of a single frame too, and a
peak that meets no other stands as a pair with itself.

Null and empty inputs give one frame of padding; silence has no peaks and an
empty fingerprint. Equal inputs give equal files and fingerprints; rows that repeat
are each stored, ids may be null, and extra columns are ignored. Very long inputs
are transformed `BLOCK` frames at a time.
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

from streamledger.llm.common import mapped, slices, table

UNIT, FRAME, HOP, PEAKS, REACH, RATE = 576, 576, 288, 3, 3, 8000
#: Frames transformed at once: bounds a task's memory for very long inputs.
BLOCK = 2048
WINDOW = np.hanning(FRAME)
SCHEMA = "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media binary, fingerprint array<struct<time:int,code:int>>"


def padded(data: bytes, unit: int = UNIT) -> bytes:
    """data with bytes 255 appended up to a positive multiple of unit."""
    return data + b"\xff" * (-len(data) % unit if data else unit)


def to_wav(data: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(data)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def peaks_of(magnitudes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames and frequencies of the peaks, by frame and falling magnitude."""
    inner = magnitudes[:, 1:-1]
    top = (inner > magnitudes[:, :-2]) & (inner >= magnitudes[:, 2:]) & (inner > magnitudes.mean(axis=1, keepdims=True))
    held = np.where(top, inner, -1.0)
    best = np.argsort(-held, axis=1, kind="stable")[:, :PEAKS]
    real = np.take_along_axis(held, best, axis=1) > 0
    frames, rank = np.nonzero(real)
    return frames, best[frames, rank] + 1


def stft(samples: np.ndarray, start: int, stop: int) -> np.ndarray:
    """Magnitudes of frames start to stop, rounded so that peaks do not hang on the last bits."""
    at = np.arange(start, stop)[:, None] * HOP + np.arange(FRAME)
    return np.abs(np.fft.rfft((samples[at].astype(np.float64) - 128.0) * WINDOW, axis=1)).round(6)


def fingerprint(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Times and codes of peak pairs, by time and code."""
    samples = np.frombuffer(data, np.uint8)
    n = max(0, (len(samples) - FRAME) // HOP + 1)
    found = [peaks_of(stft(samples, a, min(n, a + BLOCK))) for a in range(0, n, BLOCK)]
    if not found:
        return np.empty(0, np.int32), np.empty(0, np.int32)
    frame = np.concatenate([f + k * BLOCK for k, (f, _) in enumerate(found)])
    freq = np.concatenate([q for _, q in found])
    times, codes, paired = [], [], np.zeros(len(frame), bool)
    for step in range(1, REACH * PEAKS + PEAKS):  # peaks are in order of frames, so partners stand at most that far on
        near = frame[step:] - frame[:-step]
        ok = near <= REACH
        times.append(frame[:-step][ok])
        codes.append(freq[:-step][ok] << 13 | freq[step:][ok] << 3 | near[ok])
        paired[:-step] |= ok
        paired[step:] |= ok
    times.append(frame[~paired])
    codes.append(freq[~paired] << 13 | freq[~paired] << 3)
    t, c = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((c, t))
    return t[order].astype(np.int32), c[order].astype(np.int32)


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("data").to_pylist()
        for a, b in slices(texts):
            rows = []
            for data in texts[a:b]:
                media = to_wav(padded(data or b""))
                read = from_wav(media)
                rows.append((len(data or b""), len(read), hashlib.sha256(read).hexdigest(), zlib.crc32(read[-32:]), media, *fingerprint(read)))
            n, size, digest, crc, media, times, codes = zip(*rows, strict=True)
            offsets = pa.array(np.cumsum([0, *map(len, times)]), pa.int32())
            pairs = pa.StructArray.from_arrays([pa.array(np.concatenate(times)), pa.array(np.concatenate(codes))], ["time", "code"])
            cols = [batch.column("id").slice(a, b - a), pa.array(n, pa.int64()), pa.array(size, pa.int64()), pa.array(digest, pa.string()), pa.array(crc, pa.int64()), pa.array(media, pa.binary()), pa.ListArray.from_arrays(offsets, pairs)]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media", "fingerprint"])


def media_columns(rows: DataFrame, id_col: str, data_col: str) -> DataFrame:
    """One row for each of rows: its id, n_bytes (unpadded), payload_bytes, payload_sha256 and tail_crc32 (read back from the file), media (a WAV file) and fingerprint. data_col is binary."""
    picked = rows.select(F.col(id_col).alias("id"), F.col(data_col).alias("data"))
    out = mapped(picked, _store, f"id {picked.schema['id'].dataType.simpleString()}, {SCHEMA}")
    return out.withColumnRenamed("id", id_col)


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    out = media_columns(table(spark, sf_dir, "documents").select("doc_id", data.alias("data")), "doc_id", "data")
    feature = F.concat_ws(" ", F.transform("fingerprint", lambda p: F.concat_ws(":", F.lower(F.hex(p["time"])), F.lower(F.hex(p["code"])))))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.length("media").cast("bigint").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"))
