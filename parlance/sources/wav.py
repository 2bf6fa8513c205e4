"""WAV files as rows of samples, samples as WAV files, and resampling."""

from __future__ import annotations

import io
import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.sources import paths

RATE = 16000
TAPS, CUTOFF = 256, 0.95
CLIPS = "path string, sample_rate int, channels int, samples array<float>, error string"


def layout(f) -> tuple[int, int, int, int, int, int]:
    """(kind, channels, sample rate, bits, start of the samples, their bytes) of an open WAV file; only heads of chunks are read."""
    f.seek(0)
    head = f.read(12)
    if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form, data = 12, None, None
    while len(part := f.read(8)) == 8:
        name, size = part[:4], struct.unpack("<I", part[4:])[0]
        if name == b"fmt ":
            body = f.read(min(size, 40))
            form = struct.unpack("<HHIIHH", body[:16])
            if form[0] == 0xFFFE:  # the kind is in the extension
                form = (struct.unpack("<H", body[24:26])[0], *form[1:])
        elif name == b"data":
            data = at + 8, size
        at += 8 + size + size % 2
        f.seek(at)
    if form is None or data is None:
        raise ValueError("no format or no data")
    kind, channels, rate, _, _, bits = form
    if not (kind == 3 and bits == 32) and (kind != 1 or bits not in (8, 16, 24, 32)):
        raise ValueError(f"unsupported samples: kind {kind}, {bits} bits")
    return kind, channels, rate, bits, *data


def samples_of(kind: int, bits: int, data: bytes) -> np.ndarray:
    """Samples in [-1, 1] of raw bytes; a last part of a sample is left out."""
    width = bits // 8
    data = data[: len(data) // width * width]
    if kind == 3:
        return np.frombuffer(data, "<f4")
    if bits == 8:
        x = np.frombuffer(data, np.uint8).astype(np.int32) - 128
    elif bits == 24:
        raw = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)
        x = (raw[:, 0] << 8 | raw[:, 1] << 16 | raw[:, 2] << 24) >> 8
    else:
        x = np.frombuffer(data, f"<i{width}")
    return (x / float(1 << (bits - 1))).astype(np.float32)


def decode(body: bytes) -> tuple[int, int, np.ndarray]:
    """(sample rate, channels, interleaved samples in [-1, 1]) of integer PCM of 8 to 32 bits or 32-bit float."""
    kind, channels, rate, bits, at, size = layout(io.BytesIO(body))
    return rate, channels, samples_of(kind, bits, body[at : at + size])


def encode(samples: np.ndarray, rate: int, channels: int) -> bytes:
    """A WAV file of 16 bits: samples are clamped to [-1, 1], times 32767, cut to whole numbers."""
    pcm = np.trunc(np.clip(np.asarray(samples, np.float32), -1, 1) * np.float32(32767)).astype("<i2").tobytes()
    head = struct.pack("<HHIIHH", 1, channels, rate, rate * channels * 2, channels * 2, 16)
    return b"RIFF" + struct.pack("<I", 36 + len(pcm)) + b"WAVEfmt " + struct.pack("<I", 16) + head + b"data" + struct.pack("<I", len(pcm)) + pcm


def _opened(path: str):
    from pyarrow import fs

    where, name = (fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")) if path.startswith("file:") else fs.FileSystem.from_uri(path)
    return where.open_input_file(name)


FRAMES = "path string, seq long, sample_rate int, channels int, samples array<float>, error string"
RANGE_BYTES = 4 << 20


def read_frames(spark: SparkSession, path: str, frame: int, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, seq, sample_rate, channels, samples, error): long recordings as frames of ``frame`` samples of each channel, the last one shorter.

    A recording is read in byte ranges of whole frames by as many tasks, so no task holds more than a range, however long it
    is.  What is no WAV file has one row with the error.  Files are opened by pyarrow's file systems.
    """
    heads = "path string, kind int, channels int, rate int, bits int, at long, size long, error string"

    def look(batches):
        for pdf in batches:
            rows = []
            for name, length in zip(pdf["path"], pdf["length"]):
                try:
                    with _opened(name) as f:
                        kind, channels, rate, bits, at, size = layout(f)
                    rows.append((name, kind, channels, rate, bits, at, max(0, min(size, length - at)), None))
                except (ValueError, struct.error) as e:
                    rows.append((name, None, None, None, None, None, None, str(e)))
            out = pd.DataFrame(rows, columns=[x.split()[0] for x in heads.split(", ")])
            yield out.astype({x: "Int64" for x in ("kind", "channels", "rate", "bits", "at", "size")})

    def cut(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if r.error is not None:
                    yield pd.DataFrame([(r.path, None, None, None, None, r.error)], columns=[x.split()[0] for x in FRAMES.split(", ")]).astype({"seq": "Int64", "sample_rate": "Int64", "channels": "Int64"})
                    continue
                with _opened(r.path) as f:
                    f.seek(int(r.at + r.start))
                    x = samples_of(int(r.kind), int(r.bits), f.read(int(min(r.step, r.size - r.start))))
                wide, first = frame * int(r.channels), int(r.start) // int(r.frame_bytes)
                parts = [x[i : i + wide] for i in range(0, len(x), wide)]
                if not parts:
                    continue
                yield pd.DataFrame({"path": r.path, "seq": range(first, first + len(parts)), "sample_rate": int(r.rate), "channels": int(r.channels), "samples": parts, "error": None})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", "true").load(path).select("path", "length")
    found = files.mapInPandas(look, heads)
    frame_bytes = F.lit(frame).cast("long") * F.greatest(F.coalesce("channels", F.lit(1)), F.lit(1)) * F.coalesce(F.col("bits") / 8, F.lit(1)).cast("long")
    ranges = found.withColumn("frame_bytes", frame_bytes).withColumn("step", F.greatest(F.floor(F.lit(range_bytes) / F.col("frame_bytes")), F.lit(1)) * F.col("frame_bytes"))
    last = F.greatest(F.coalesce("size", F.lit(1)) - 1, F.lit(0))
    ranges = ranges.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"), F.col("step").cast("long"))))
    # Rows of ranges are small but what they read isn't, so their number of tasks is given, and not left to their size.
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return ranges.repartition(tasks, "path", "start").mapInPandas(cut, FRAMES)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, sample_rate, channels, samples, error): one clip a row; what is no WAV file has an error instead."""

    def clips(batches):
        for pdf in batches:
            rows = []
            for name, body in zip(pdf["path"], pdf["content"]):
                try:
                    rows.append((name, *decode(bytes(body)), None))
                except (ValueError, struct.error) as e:
                    rows.append((name, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "sample_rate", "channels", "samples", "error"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInPandas(clips, CLIPS)


@F.pandas_udf(T.BinaryType())
def wav_bytes(samples: pd.Series, rate: pd.Series, channels: pd.Series) -> pd.Series:
    return pd.Series([encode(s, int(r), int(c)) for s, r, c in zip(samples, rate, channels)])


def write(clips: DataFrame, folder: str) -> None:
    """Clips (name, sample_rate, channels, samples) as files ``<folder>/<name>.wav``."""
    body = wav_bytes(F.col("samples"), F.col("sample_rate"), F.col("channels")).alias("body")
    paths.write_files(clips.select(F.concat("name", F.lit(".wav")).alias("name"), body), folder)


def resampled(x: np.ndarray, rate: int, to: int = RATE) -> np.ndarray:
    """Band-limited: a windowed sinc of ``TAPS`` taps at ``CUTOFF`` of the lower rate; round(n to / rate) samples."""
    x = np.asarray(x, np.float64)
    if rate == to or not len(x):
        return x.astype(np.float32)
    n, ratio = int(round(len(x) * to / rate)), to / rate
    cut = CUTOFF * min(1.0, ratio)
    half = TAPS // 2
    padded = np.concatenate([np.zeros(half), x, np.zeros(half + 1)])
    out = np.empty(n, np.float32)
    window = np.arange(-half + 1, half + 1)
    for s in range(0, n, 1 << 14):
        at = np.arange(s, min(n, s + (1 << 14))) / ratio
        near = np.floor(at).astype(np.int64)
        off = (at - near)[:, None] - window
        kernel = cut * np.sinc(cut * off) * (0.5 + 0.5 * np.cos(np.pi * np.clip(off / half, -1, 1)))
        out[s : s + len(at)] = (padded[near[:, None] + window + half] * kernel).sum(1)
    return out


def resample(samples: Column, rate: Column, to: int = RATE) -> Column:
    """Mono samples at another rate."""

    @F.pandas_udf("array<float>")
    def run(samples: pd.Series, rate: pd.Series) -> pd.Series:
        return pd.Series([None if s is None else resampled(s, int(r), to) for s, r in zip(samples, rate)])

    return run(samples, rate)
