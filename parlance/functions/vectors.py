"""Vector scalars over arrays, computed in double."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPSILON = 1.1920929e-07  # of single precision: a vector of a smaller squared length has no direction


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector has no length."""
    a, b = doubles(a), doubles(b)
    na, nb = dot(a, a), dot(b, b)
    return F.when((na <= EPSILON) | (nb <= EPSILON), 0.0).otherwise(dot(a, b) / F.sqrt(na * nb))


def normalised(v: Column) -> Column:
    """Of length 1; a zero vector stays.

    The length is an argument of its own, as within a lambda it would be computed anew for each component.
    """
    v = doubles(v)
    n = F.sqrt(dot(v, v))
    return F.when(n > 0, F.zip_with(v, F.array_repeat(n, F.size(v)), lambda x, y: x / y)).otherwise(v)


def weighted_mean(a: Column, na: Column, b: Column, nb: Column) -> Column:
    """The normalised mean of two centroids by their counts."""
    return normalised(F.zip_with(doubles(a), doubles(b), lambda x, y: (x * na + y * nb) / (na + nb)))


def rms(samples: Column) -> Column:
    x = doubles(samples)
    return F.when(F.size(x) > 0, F.sqrt(dot(x, x) / F.size(x))).otherwise(0.0)


def mono(samples: Column, channels: int) -> Column:
    """The mean of the channels of interleaved frames; a partial last frame is dropped."""
    frames = F.floor(F.size(samples) / channels).cast("int")
    mean = lambda i: F.aggregate(F.slice(doubles(samples), i * channels + 1, F.lit(channels)), F.lit(0.0), lambda s, x: s + x) / channels
    return F.when(frames > 0, F.transform(F.sequence(F.lit(0), F.greatest(frames - 1, F.lit(0))), mean)).otherwise(F.array().cast("array<double>"))


def fixed_window(v: Column, size: int) -> Column:
    """Zeros to the right of a short vector; the middle of a long one."""
    n = F.size(v)
    crop = F.slice(v, F.floor((n - size) / 2).cast("int") + 1, F.lit(size))
    return F.when(n >= size, crop).otherwise(F.concat(v, F.array_repeat(F.lit(0.0), F.greatest(F.lit(size) - n, F.lit(0)))))


def pcm16(samples: Column) -> Column:
    return F.transform(samples, lambda x: (F.greatest(F.least(x, F.lit(1.0)), F.lit(-1.0)) * 32767).cast("smallint"))


def centroids(vectors: DataFrame, keys: list[str], vector: str, least: int = 2) -> DataFrame:
    """The normalised mean vector of each key with enough vectors: (*keys, n, centroid).

    Means are taken place by place, so that each key's sums combine before the shuffle.
    """
    n = vectors.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    places = vectors.select(*keys, F.posexplode(doubles(F.col(vector))).alias("place", "x")).groupBy(*keys, "place").agg(F.avg("x").alias("x"))
    mean = F.transform(F.array_sort(F.collect_list(F.struct("place", "x"))), lambda p: p["x"])
    return places.groupBy(*keys).agg(mean.alias("_mean")).join(n, keys).select(*keys, "n", normalised(F.col("_mean")).alias("centroid"))


#: Centroids that are broadcast at once.
BLOCK = 1000


def best_match(vectors: DataFrame, centres: DataFrame, vector: str, centroid: str, centre_id: str, block: int = BLOCK) -> DataFrame:
    """Each vector's most similar centroid, ties to the smaller id.

    Centroids are dealt by a hash of their id to blocks of about ``block``; each block is one broadcast row, against
    which every vector keeps its best so far.  So vectors are never shuffled, and no broadcast grows with the centroids.
    """
    blocks = max(1, -(-centres.count() // block))
    listed = F.array_sort(F.collect_list(F.struct(F.col(centre_id).alias("id"), F.col(centroid).alias("v"))))
    df = vectors.withColumn("_best", F.lit(None).cast("struct<sim: double, neg: bigint>"))
    for i in range(blocks):
        part = centres.filter(F.pmod(F.xxhash64(centre_id), F.lit(blocks)) == i).agg(listed.alias("_all"))
        scored = F.transform("_all", lambda c: F.struct(F.round(cosine(F.col(vector), c["v"]), 6).alias("sim"), (-c["id"]).cast("long").alias("neg")))
        df = df.crossJoin(F.broadcast(part)).withColumn("_best", F.greatest("_best", F.array_max(scored))).drop("_all")  # one row
    return df.withColumn("best", (-F.col("_best.neg")).cast(centres.schema[centre_id].dataType)).withColumn("sim", F.col("_best.sim")).drop("_best")
