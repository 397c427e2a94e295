"""Audio files: listing, PCM WAV decoding and encoding, properties."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

INFO = "samplerate int, bitdepth int, channels int, duration double, format string"


def find_audio(spark: SparkSession, folder: str, stage: str = "all") -> DataFrame:
    """Files below ``folder`` whose suffix, in any case, fits: path, modificationTime, length, content.

    Listing without content reads no file: the content column is pruned.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.where(T.is_audio(F.col("path"), stage))


def read_wav(data: bytes) -> tuple[np.ndarray, int, int]:
    """Samples in [-1, 1] as (channels, n), rate and bits."""
    with wave.open(io.BytesIO(data)) as f:
        width, channels, rate = f.getsampwidth(), f.getnchannels(), f.getframerate()
        raw = np.frombuffer(f.readframes(f.getnframes()), np.uint8)
    if width == 1:
        ints = raw.astype(np.int32) - 128
    elif width == 3:
        b = raw.reshape(-1, 3).astype(np.int32)
        ints = (b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8
    else:
        ints = raw.view({2: "<i2", 4: "<i4"}[width])
    return (ints / float(2 ** (8 * width - 1))).reshape(-1, channels).T, rate, 8 * width


def write_wav(samples: np.ndarray, rate: int, bits: int = 24) -> bytes:
    """PCM of 16, 24 or 32 bits (16 for others); one channel, or (channels, n)."""
    bits = bits if bits in (16, 24, 32) else 16
    top = 2 ** (bits - 1)
    ints = np.clip(np.rint(np.atleast_2d(samples).T * top), -top, top - 1).astype("<i4")
    raw = ints.astype("<i2").tobytes() if bits == 16 else ints.tobytes()
    if bits == 24:
        raw = ints.reshape(-1, 1).view(np.uint8)[:, :3].tobytes()
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(np.atleast_2d(samples).shape[0])
        f.setsampwidth(bits // 8)
        f.setframerate(rate)
        f.writeframes(raw)
    return out.getvalue()


def decoded(files: DataFrame, rate: int | None = None, mono: bool = True) -> DataFrame:
    """(file_id, file_path, class, sr, samples, status, error): mean of the channels, resampled if asked."""
    from ..functions.kernels import resample

    @F.pandas_udf("struct<sr:int,samples:array<double>,status:string,error:string>")
    def run(content: pd.Series) -> pd.DataFrame:
        rows = []
        for data in content:
            try:
                y, sr, _ = read_wav(data)
                y = resample(y.mean(axis=0) if mono else y[0], sr, rate)
                rows.append((rate or sr, y.tolist(), "success", None))
            except Exception as e:  # an unreadable file is a row with an error
                rows.append((0, None, "failed", f"{type(e).__name__}: {e}"))
        return pd.DataFrame(rows, columns=["sr", "samples", "status", "error"])

    path = F.col("path")
    return files.select(T.stem(path).alias("file_id"), path.alias("file_path"), T.parent(path).alias("class"), run("content").alias("_r")).select(
        "file_id", "file_path", "class", "_r.*"
    )


def properties(files: DataFrame) -> DataFrame:
    """(file_id, file_path, samplerate, bitdepth, channels, duration, format, size_bytes); zeros and the format
    error for a file that can't be read."""

    @F.pandas_udf(INFO)
    def run(content: pd.Series) -> pd.DataFrame:
        rows = []
        for data in content:
            try:
                with wave.open(io.BytesIO(data)) as f:
                    rows.append((f.getframerate(), 8 * f.getsampwidth(), f.getnchannels(), f.getnframes() / f.getframerate(), "wav"))
            except Exception:
                rows.append((0, 0, 0, 0.0, "error"))
        return pd.DataFrame(rows, columns=["samplerate", "bitdepth", "channels", "duration", "format"])

    path = F.col("path")
    return files.select(T.stem(path).alias("file_id"), path.alias("file_path"), F.col("length").alias("size_bytes"), run("content").alias("_r")).select(
        "file_id", "file_path", "_r.*", "size_bytes"
    )


def encoded(clips: DataFrame, bits: int = 24) -> DataFrame:
    """``clips`` with ``wav``: the bytes of a file."""

    @F.pandas_udf("binary")
    def run(samples: pd.Series, rate: pd.Series) -> pd.Series:
        return pd.Series([write_wav(np.asarray(y, float), int(sr), bits) for y, sr in zip(samples, rate, strict=True)])

    return clips.withColumn("wav", run("samples", "sr"))


def wav_path(path: Column, base: str) -> Column:
    """Relative path below ``base`` with the suffix wav."""
    return T.with_suffix(T.relative(path, base), "wav")
