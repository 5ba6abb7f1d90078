"""Media columns: documents as 8-bit WAV, read back by the wave module, with spectral-peak pair fingerprints."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_arrow

FRAME = 576
#: Output rows wait until they hold so many bytes.
BATCH_BYTES = 8 << 20


def to_wav(payload: bytes, rate: int = 8000) -> bytes:
    """One channel of unsigned 8-bit samples."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("not one channel of 8-bit samples")
        return w.readframes(w.getnframes())


def padded(data: bytes, unit: int = FRAME, fill: int = 255) -> bytes:
    """data, filled up to a positive multiple of unit bytes."""
    return data + bytes([fill]) * (max(1, -(-len(data) // unit)) * unit - len(data))


def landmarks(samples: bytes, width: int = 192, hop: int = 96, peaks: int = 2, reach: int = 2, chunk: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of spectral peaks: the frame of the first peak, and a code of both frequencies and the frames between.

    Short-time Fourier transform with a Hann window of ``width`` samples; the peaks of a frame are its strongest
    local maxima. Each peak is paired with those of the next ``reach`` frames. Code: f1 * 2**12 + f2 * 2**4 + frames
    between. Chunks of frames bound the memory of the transform at any length.
    """
    frames = np.lib.stride_tricks.sliding_window_view(np.frombuffer(samples, dtype=np.uint8), width)[::hop]
    window = np.hanning(width).astype(np.float32)
    tops = np.full((len(frames) + reach, peaks), -1, dtype=np.int32)
    for at in range(0, len(frames), chunk):
        part = (frames[at : at + chunk].astype(np.float32) - 128) * window
        spectrum = np.fft.rfft(part, axis=1)
        power = spectrum.real**2 + spectrum.imag**2
        inner = power[:, 1:-1]
        crest = np.where((inner > power[:, :-2]) & (inner >= power[:, 2:]), inner, 0)
        for j in range(peaks):
            best = crest.argmax(axis=1)
            rows = np.arange(len(best))
            tops[at : at + len(best), j] = np.where(crest[rows, best] > 1e-3, best + 1, -1)
            crest[rows, best] = 0
    codes = np.full((len(frames), reach, peaks, peaks), -1, dtype=np.int32)
    for gap in range(1, reach + 1):
        a, b = tops[: len(frames), :, None], tops[gap : gap + len(frames), None, :]
        codes[:, gap - 1] = np.where((a >= 0) & (b >= 0), (a << 12) | (b << 4) | gap, -1)
    codes = codes.reshape(len(frames), -1)
    time, slot = np.nonzero(codes >= 0)
    return time.astype(np.int32), codes[time, slot]


def _work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", "n_bytes", "media", "payload", "landmark_time", "landmark_code"]

    def ready(rows):
        ids, sizes, media, payload, time, code = zip(*rows)
        return pa.record_batch([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(media, pa.binary()), pa.array(payload, pa.binary()), pa.array(time, pa.list_(pa.int32())), pa.array(code, pa.list_(pa.int32()))], names)

    rows, held = [], 0
    for batch in batches:
        for key, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            data = data.as_py() or b""
            media = to_wav(padded(data))
            back = from_wav(media)
            time, code = landmarks(back)
            rows.append((key, len(data), media, back, time, code))
            held += 2 * len(media) + 8 * len(time)
            if held > BATCH_BYTES:
                yield ready(rows)
                rows, held = [], 0
    if rows:
        yield ready(rows)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each whole text as a WAV file and what is read back from it.

    The UTF-8 bytes, filled up with 255 to a positive multiple of 576, become 8-bit samples. Returns the id, n_bytes
    (before filling), media (the WAV file), payload (samples read back from media), landmark_time and landmark_code
    (arrays<int> of the same length: the time-coded spectral-peak pairs of payload). No shuffle; a task holds one
    text and 8 MB of results. Null or empty text: one frame of 255. Silent or constant frames have no peaks.
    Null and repeated ids pass through; other columns of docs are not read; no rows: no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("data"))
    out = map_arrow(rows, _work, "id long, n_bytes long, media binary, payload binary, landmark_time array<int>, landmark_code array<int>")
    return out.withColumnRenamed("id", id_col)


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = media_columns(documents(spark, sf_dir))
    tail = F.expr("substring(payload, length(payload) - 31, 32)")
    feature = F.md5(F.concat_ws(";", F.concat_ws(",", F.col("landmark_time").cast("array<string>")), F.concat_ws(",", F.col("landmark_code").cast("array<string>"))))
    return m.select("doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(tail).alias("tail_crc32"), F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"), F.size("landmark_time").cast("long").alias("n_landmarks"))
