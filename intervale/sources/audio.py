"""The boundary to audio and models: WAV bytes to mono 16 kHz samples, and typed plug points for models.

Models are not part of this engine: a caller passes a function over Arrow batches.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship, shipped

RATE = 16_000


def decode_wav(data: bytes) -> np.ndarray:
    """The first channel of PCM WAV bytes as float32 in [-1, 1) at 16 kHz (linear interpolation)."""
    with wave.open(io.BytesIO(data)) as w:
        width, channels, rate = w.getsampwidth(), w.getnchannels(), w.getframerate()
        raw = w.readframes(w.getnframes())
    if width == 1:
        x = np.frombuffer(raw, np.uint8).astype(np.float32) - 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8).astype(np.float32)
    else:
        x = np.frombuffer(raw, f"<i{width}").astype(np.float32)
    x = x.reshape(-1, channels)[:, 0] / float(1 << (8 * width - 1))
    if rate == RATE or not len(x):
        return x.astype(np.float32)
    at = np.arange(round(len(x) * RATE / rate)) * (rate / RATE)
    return np.interp(at, np.arange(len(x)), x).astype(np.float32)


def read_audio(spark: SparkSession, path: str) -> DataFrame:
    """path, duration_ms (0 where the file cannot be read), samples (null there)."""
    schema = "path string, duration_ms long, samples array<float>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for p, c in zip(rows["path"], rows["content"]):
                try:
                    x = decode_wav(bytes(c))
                    out.append((p, len(x) * 1000 // RATE, x))
                except (wave.Error, EOFError, ValueError):
                    out.append((p, 0, None))
            yield pd.DataFrame(out, columns=["path", "duration_ms", "samples"])

    ship(spark)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def mel_basis(bands: int = 80, size: int = 512, rate: int = RATE) -> np.ndarray:
    """[band, frequency] weights of triangles of equal area, equally spaced on a scale that is linear up to 1 kHz and
    logarithmic above, 27 steps for a factor of 6.4."""
    step, knee = 200 / 3, 1000.0
    curve = np.log(6.4) / 27
    top = knee / step + np.log(max(rate / 2, knee) / knee) / curve if rate / 2 > knee else rate / 2 / step
    mels = np.linspace(0, top, bands + 2)
    hz = np.where(mels < knee / step, mels * step, knee * np.exp(curve * (mels - knee / step)))
    at = np.arange(size // 2 + 1) * rate / size
    rise = (at - hz[:-2, None]) / np.diff(hz)[:-1, None]
    fall = (hz[2:, None] - at) / np.diff(hz)[1:, None]
    return np.maximum(0, np.minimum(rise, fall)) * (2 / (hz[2:] - hz[:-2]))[:, None]


def log_mel(samples: np.ndarray, bands: int = 80, size: int = 512, window: int = 400, hop: int = 160, emphasis: float = 0.97) -> np.ndarray:
    """[band, frame] log energies of samples at 16 kHz, each band with mean 0 and deviation 1: pre-emphasis, frames
    centred by reflection, a periodic Hann window in front of zeros, power spectrum. No samples give no frames."""
    x = np.asarray(samples, np.float32)
    if not len(x):
        return np.zeros((bands, 0), np.float32)
    x = np.append(x[:1], x[1:] - np.float32(emphasis) * x[:-1])
    x = np.pad(np.pad(x, (0, max(0, size - len(x)))), size // 2, mode="reflect")
    frames = np.lib.stride_tricks.sliding_window_view(x, size)[::hop]
    shape = np.zeros(size, np.float32)
    shape[:window] = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(window) / window)
    power = np.abs(np.fft.rfft(frames * shape, axis=1)) ** 2
    out = np.log(power @ mel_basis(bands, size).T + 2.0**-24)
    return ((out - out.mean(0)) / (out.std(0) + 1e-5)).T.astype(np.float32)


def with_log_mel(audio: DataFrame) -> DataFrame:
    """path and mel, the log_mel of samples as an array of bands; null where there are no samples. What a batch holds is
    bounded by Spark, by rows and bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame({"path": rows["path"], "mel": [None if x is None or not len(x) else list(log_mel(np.asarray(x))) for x in rows["samples"]]})

    return shipped(audio).select("path", "samples").mapInPandas(run, "path string, mel array<array<float>>")


def with_model(rows: DataFrame, model: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """Rows through a caller's model (recogniser, embedder, aligner), batch by batch."""
    return rows.mapInPandas(model, schema)


def embedding_windows(segments: DataFrame, most_ms: int = 120_000) -> DataFrame:
    """Segments longer than most_ms as equal windows: part, parts, part_start, part_end (whole milliseconds)."""
    dur = F.col("end_ms") - F.col("start_ms")
    parts = F.greatest(F.lit(1).cast("long"), F.ceil(dur / most_ms))
    w = segments.withColumn("parts", parts).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    at = lambda k: F.col("start_ms") + F.floor(k * dur / F.col("parts"))
    return w.withColumn("part_start", at(F.col("part"))).withColumn("part_end", at(F.col("part") + 1))
