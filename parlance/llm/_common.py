"""Helpers shared by the corpus operators: a shared work folder, and hashing of bytes and words in numpy.

Hashes are polynomial fingerprints modulo 2**64 over a fixed table of random odd
numbers, finished by a multiply-xor mix.  They name strings for grouping.  ``row_key``
and fingerprints of windows have 64 bits, which is enough below about 1e9 names; beyond
that, wrong matches must be expected (see README).
"""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15

WORD_BREAKS = np.zeros(256, bool)
WORD_BREAKS[[0x20, *range(0x09, 0x0E)]] = True
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """A fresh path in the folder that the cluster shares (``spark.checkpoint.dir``).

    Only where no such folder is set and Spark runs within one machine, as in tests,
    one is made in the local temp folder; elsewhere executors couldn't see it.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = _LOCAL.setdefault(spark.sparkContext.applicationId, None) or f"file://{tempfile.mkdtemp(prefix='parlance-')}"
        _LOCAL[spark.sparkContext.applicationId] = top
    return f"{top.rstrip('/')}/parlance-{uuid.uuid4().hex}"


#: Local folders by application, and tables written since they were last cleared.
_LOCAL: dict[str, str | None] = {}
_WRITTEN: list[str] = []


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again, so that its lineage ends there."""
    path = work_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_stored(spark: SparkSession, since: int = 0, but_last: int = 0) -> None:
    """Deletes the tables that ``stored`` has written, from number ``since`` on; call it when results are written."""
    gone = _WRITTEN[since : len(_WRITTEN) - but_last]
    del _WRITTEN[since : len(_WRITTEN) - but_last]
    for x in gone:
        path = spark._jvm.org.apache.hadoop.fs.Path(x)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written() -> int:
    """How many tables ``stored`` has written that aren't deleted, as a mark for ``clear_stored``."""
    return len(_WRITTEN)


def released(f):
    """``f`` over a task's batches, after which the worker gives what it has freed back to the system.

    Workers are used again, and allocators keep freed memory for themselves, so a worker would stay as large as its
    largest task was, beside all others of its executor.
    """

    def run(batches):
        yield from f(batches)
        import ctypes

        import pyarrow as pa

        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return run


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have yet, in upper or lower case."""
    taken = {x.lower() for x in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_key(doc_id: str = "doc_id", text: str = "text"):
    """A key for joins that also holds when a doc_id is null or appears twice with other text."""
    return F.xxhash64(F.col(doc_id).cast("string"), F.length(text), F.col(text))


def _splitmix(seed: int, n: int) -> np.ndarray:
    out = np.empty(n, U64)
    for i in range(n):
        seed = (seed + BASE) & MASK
        z = seed
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & MASK
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & MASK
        out[i] = (z ^ (z >> 31)) | 1
    return out


BYTE_CODES = _splitmix(20240501, 256)


class _Powers:
    """Powers of an odd base modulo 2**64, and of its inverse, as long as yet needed."""

    def __init__(self, base: int):
        self.base, self.up, self.down = base, np.ones(1, U64), np.ones(1, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 4096)
            self.up = _powers(self.base, size)
            self.down = _powers(pow(self.base, -1, 1 << 64), size)
        return self.up[:n], self.down[:n]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, U64)
    out[0], k = 1, 1
    while k < n:
        m = min(k, n - k)
        np.multiply(out[:m], U64(pow(base, k, 1 << 64)), out=out[k : k + m])
        k += m
    return out


POWERS = _Powers(BASE)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U64(31))
    x = x * U64(0xBF58476D1CE4E5B9)
    return x ^ (x >> U64(29))


def prefix_sums(codes: np.ndarray) -> np.ndarray:
    """c with c[j] - c[i] fingerprinting codes[i:j] up to a power of the base."""
    up, _ = POWERS.upto(max(len(codes), 1))
    c = np.zeros(len(codes) + 1, U64)
    np.cumsum(codes * up[: len(codes)], out=c[1:])
    return c


def span_hash(c: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = POWERS.upto(len(c))
    return mix((c[ends] - c[starts]) * down[starts])


def rolling(c: np.ndarray, q: int) -> np.ndarray:
    """Fingerprints of all windows of q codes, from ``prefix_sums``."""
    n = len(c) - q
    if n <= 0:
        return np.zeros(0, U64)
    _, down = POWERS.upto(len(c))
    return mix((c[q:] - c[:-q]) * down[:n])


def word_spans(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` of a byte array."""
    if not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = np.zeros(len(b) + 2, np.int8)
    inside[1:-1] = ~WORD_BREAKS[b]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[::2], edge[1::2]


def word_hashes(b: np.ndarray) -> np.ndarray:
    """One 64-bit fingerprint a word."""
    starts, ends = word_spans(b)
    if not len(starts):
        return np.zeros(0, U64)
    return span_hash(prefix_sums(BYTE_CODES[b]), starts, ends) + (ends - starts).astype(U64)


def _slide(h: np.ndarray, w: int, f) -> np.ndarray:
    """f over each window of w values, by doubling."""
    n, k, m = len(h) - w + 1, 1, h
    while 2 * k <= w:
        m = f(m[:-k], m[k:])
        k *= 2
    return f(m[:n], m[w - k : w - k + n]) if k < w else m[:n]


def sync_points(h: np.ndarray, w: int) -> np.ndarray:
    """Positions that hold the least value of some window of w values (ties included).

    What is chosen in a window depends on that window alone, so equal stretches of
    text have equal sync points; each window of w values has at least one.
    """
    if len(h) < w:
        return np.zeros(0, np.int64)
    low = _slide(h, w, np.minimum)
    pad = np.zeros(w - 1, U64)
    return np.flatnonzero(_slide(np.concatenate([pad, low, pad]), w, np.maximum) == h)


def least_in(h: np.ndarray, w: int) -> np.ndarray:
    """The least value of each window of w values: a name for its first sync point."""
    return _slide(h, w, np.minimum) if len(h) >= w else np.zeros(0, U64)


def is_in(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values occur in a sorted array."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def stretches(key: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Half-open runs of equal key where wanted is true."""
    if not len(key):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.flatnonzero((key[1:] != key[:-1]) | (wanted[1:] != wanted[:-1])) + 1
    s = np.concatenate([[0], edge])
    e = np.concatenate([edge, [len(key)]])
    keep = wanted[s]
    return s[keep], e[keep]


def mask_runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Half-open runs of true."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return edge[::2], edge[1::2]


def cover(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n places lie in one of the half-open spans."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, starts, 1)
    np.add.at(d, ends, -1)
    return np.cumsum(d[:-1]) > 0


def binary_rows(col) -> list[np.ndarray]:
    """An Arrow binary column as one byte array a row; nulls are empty."""
    import pyarrow as pa

    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary())
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return [raw[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist())]


def list_rows(col, kind) -> list[np.ndarray]:
    """An Arrow list column of numbers as one array a row; nulls are empty."""
    import pyarrow as pa

    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.fill_null([]) if col.null_count else col
    at = np.asarray(col.offsets)
    flat = np.asarray(col.values).astype(kind, copy=False)
    return [flat[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist())]


def signed(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h, U64).view(np.int64)


def packed_texts(docs: DataFrame, text: str = "text", *keep: str) -> DataFrame:
    """Rows (row, *keep, packed): the key of a row and its text, compressed for the shuffle."""
    df = docs.select(row_key("doc_id", text).alias("row"), *keep, F.col(text).cast("binary").alias("body"))
    fields = [f for f in df.schema.fields if f.name != "body"]

    def pack(batches):
        import pyarrow as pa
        import zstandard

        zip_ = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            bodies = [zip_.compress(b.tobytes()) for b in binary_rows(batch.column("body"))]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in fields), pa.array(bodies, pa.binary())], [*(f.name for f in fields), "packed"]
            )

    from pyspark.sql import types as T

    return df.mapInArrow(released(pack), T.StructType([*fields, T.StructField("packed", T.BinaryType())]))


def unpacker():
    """What turns one packed text into its bytes."""
    import zstandard

    raw = zstandard.ZstdDecompressor()
    return lambda b: np.frombuffer(raw.decompress(b.tobytes()), np.uint8) if len(b) else b


def unpacked(col) -> list[np.ndarray]:
    raw = unpacker()
    return [raw(b) for b in binary_rows(col)]


def slices(batches, rows: int = 512):
    """Arrow batches of few rows each, so that what is derived from a batch of texts stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def runs_of(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of half-open spans."""
    if not len(starts):
        return starts, ends
    o = np.argsort(starts, kind="stable")
    s, e = starts[o], np.maximum.accumulate(ends[o])
    new = np.concatenate([[True], s[1:] > e[:-1]])
    first = np.flatnonzero(new)
    return s[first], e[np.concatenate([first[1:] - 1, [len(s) - 1]])]
