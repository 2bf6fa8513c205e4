"""Toxicity scores by a character n-gram linear classifier on naive Bayes features.

Features are the byte n-grams of ``GRAM`` bytes that a text has, A-Z lower-cased and
other ASCII non-letters as blanks, hashed into ``BUCKETS`` buckets.  Three steps:

1. Spark counts, over all labelled rows, in how many texts of either label each
   bucket occurs.  Each task adds up its rows, and sums by bucket are Spark's.
2. The log-count ratio of a bucket scales its feature.  The ``FEATURES`` buckets whose
   rates differ most surely between the labels, by a two-proportion z, are kept; Spark
   picks them, so only those come to the driver.
3. A logistic regression is fitted in numpy on at most ``SAMPLE_ROWS`` labelled rows,
   each of them only its kept buckets.  They are drawn by document, so copies of one
   text aren't drawn together.

A document with several labels counts as toxic if one says so; labels that are null or
for no known document teach nothing.  Null and empty texts have no feature: their score is
that of the intercept.  Without rows of both labels all scores are the smoothed rate
of toxic rows.  Texts of any length are read whole.  Repeated rows count as often as they
occur and get the same score.  Columns named like the results are replaced, all others kept.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import _common as c

GRAM = 5
BUCKETS = 1 << 20
FEATURES = 4096
LEAST_TEXTS = 5
SAMPLE_ROWS = 20_000
STEPS = 300
RIDGE = 1e-4

_LETTER = np.arange(256, dtype=np.uint8)
_LETTER[65:91] += 32
_LETTER[:65] = _LETTER[91:97] = _LETTER[123:128] = 32


def gram_buckets(b: np.ndarray) -> np.ndarray:
    """The bucket of the n-gram at each place, of the text between two blanks."""
    x = np.full(len(b) + 2, 32, np.uint32)
    x[1:-1] = _LETTER[b]
    n = len(x) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    h = x[:n]
    for i in range(1, GRAM):
        h = h * np.uint32(0x01000193) ^ x[i : i + n]
    return (h * np.uint32(0x9E3779B1) >> np.uint32(33 - BUCKETS.bit_length())).astype(np.int64)


@dataclass
class ToxicityModel:
    weights: np.ndarray  # by bucket: regression weight times log-count ratio, 0 for those not kept
    intercept: float

    def score(self, b: np.ndarray) -> float:
        g = gram_buckets(b)
        w = self.weights[g]
        hit = w != 0
        z = self.intercept + (float(self.weights[np.unique(g[hit])].sum()) if hit.any() else 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -700, 700))))


def _counts(rows: DataFrame) -> DataFrame:
    """(bucket, n0, n1): in how many texts of label 0 and of label 1 a bucket occurs."""

    def count(batches):
        import pyarrow as pa

        n = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for y, b in zip(batch.column("toxic").to_pylist(), c.unpacked(batch.column("packed"))):
                n[y, np.unique(gram_buckets(b))] += 1
        hit = np.flatnonzero(n.any(0))
        for i in range(0, len(hit), 1 << 16):
            k = hit[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(n[0, k]), pa.array(n[1, k])], ["bucket", "n0", "n1"])

    return rows.mapInArrow(c.released(count), "bucket int, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _surest(counts: DataFrame, totals: tuple[int, int], features: int) -> list:
    """The buckets whose rates differ most surely between the labels, in enough texts; ties to the smaller bucket."""
    t0, t1 = float(totals[0]), float(totals[1])
    pooled = (F.col("n0") + F.col("n1")) / (t0 + t1)
    sure = F.abs(F.col("n1") / t1 - F.col("n0") / t0) / F.sqrt(pooled * (1 - pooled) * (1 / t0 + 1 / t1) + 1e-12)
    return counts.filter(F.col("n0") + F.col("n1") >= LEAST_TEXTS).orderBy(sure.desc(), "bucket").limit(features).collect()


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """A model from documents (doc_id, text) and labels (doc_id, toxic)."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("toxic") != 0).cast("int")).alias("toxic"))
    # Labels grow with the corpus, so they are merged at every size, never broadcast.
    rows = c.packed_texts(docs.select("doc_id", "text"), "text", "doc_id").join(known.hint("merge"), "doc_id")
    rows = c.stored(rows.select("row", "toxic", "packed"))
    of = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    totals = (of.get(0, 0), of.get(1, 0))
    weights = np.zeros(BUCKETS, np.float32)
    prior = float(np.log((totals[1] + 1) / (totals[0] + 3)))
    found = sorted((r.bucket, r.n0, r.n1) for r in _surest(_counts(rows), totals, FEATURES)) if all(totals) else []
    if not found:
        return ToxicityModel(weights, prior)
    buckets, n0, n1 = np.array(found, np.int64).T
    ratio = np.log((n1 + 1) / (totals[1] + 2)) - np.log((n0 + 1) / (totals[0] + 2))
    place = np.full(BUCKETS, -1, np.int32)
    place[buckets] = np.arange(len(buckets))
    drawn = F.xxhash64("row")
    draw = F.pmod(drawn, F.lit(1 << 20)) < math.ceil(min(1.0, sample_rows / sum(totals)) * (1 << 20))

    def features(batches):
        import pyarrow as pa

        for batch in batches:
            out = [np.unique(p[p >= 0]) for p in (place[gram_buckets(b)] for b in c.unpacked(batch.column("packed")))]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), batch.column("drawn"), pa.array([x.astype("<i4").tobytes() for x in out], pa.binary())], ["toxic", "drawn", "features"])

    some = rows.filter(draw).select("toxic", "packed", drawn.alias("drawn")).mapInArrow(c.released(features), "toxic int, drawn long, features binary")
    sample = some.orderBy("drawn", "features", "toxic").limit(sample_rows).collect()
    sample.sort(key=lambda r: (r.toxic, bytes(r.features)))
    w, intercept = logistic([np.frombuffer(r.features, "<i4") for r in sample], np.array([r.toxic for r in sample], np.float64), ratio, prior)
    weights[buckets] = w * ratio
    return ToxicityModel(weights, intercept)


def logistic(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, intercept: float) -> tuple[np.ndarray, float]:
    """Weights and intercept of a ridge logistic regression on scaled 0/1 features, by Adam over all rows."""
    w, b = np.zeros(len(scale)), intercept
    if not len(y):
        return w, b
    at = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, STEPS + 1):
        z = np.bincount(owner, (w * scale)[at], minlength=len(y)) + b
        d = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y) / len(y)
        g = np.append(np.bincount(at, d[owner], minlength=len(w)) * scale + RIDGE * w, d.sum())
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-10)
        w -= step[:-1]
        b -= step[-1]
    return w, float(b)


def scored(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``docs`` with score and predicted."""
    docs = docs.drop("score", "predicted")
    keep = docs.columns
    body = c.free_name(docs, "body")

    def score(batches):
        import pyarrow as pa

        for batch in batches:
            s = [model.score(b) for b in c.binary_rows(batch.column(body))]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in keep), pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())], [*keep, "score", "predicted"])

    from pyspark.sql import types as T

    more = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return docs.withColumn(body, F.col("text").cast("binary")).mapInArrow(c.released(score), T.StructType([*docs.schema.fields, *more]))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.read_table(spark, sf_dir, "documents")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))
    model = fit(docs.filter(fold != 0), c.read_table(spark, sf_dir, "labels"))
    held = F.coalesce(fold == 0, F.lit(False))
    return scored(docs.select("doc_id", held.alias("held_out"), "text"), model).select("doc_id", "held_out", "score", "predicted")
