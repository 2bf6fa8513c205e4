"""Pairs of vectors whose cosine similarity reaches a threshold, by bands of angles and triangular pairs of blocks.

The first components of a unit vector make an angle with the rest, theta = atan2(|rest|, |head|).  By Cauchy-Schwarz on both
parts, the similarity of two vectors is at most cos(theta_a - theta_b), so a pair that reaches t has angles within acos(t).
Vectors are dealt to bands of that width and, within a band, to blocks of about ``BLOCK``; a block meets the blocks
of its own band and the next one, each pair of blocks once, by a join on the band.  Blocks whose angles lie too far apart are not
paired.  So there is no cross join, and no row for a pair of vectors that isn't a result.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 512
HEAD = 0.5
#: What rounding may add to an angle.
SLACK = 1e-6


def similar_pairs(vectors: DataFrame, key: str, vector: str, least: float, block: int = BLOCK) -> DataFrame:
    """(a, b, similarity) with a < b and a similarity of ``least`` or more, which is above 0.

    Keys are whole numbers, one a row; null keys and vectors that are null, empty or zero have no pair.
    """
    if not 0 < least <= 1:
        raise ValueError("the threshold must be in (0, 1]")
    width = math.acos(min(1.0, least)) + 2 * SLACK
    square = lambda part: F.aggregate(part, F.lit(0.0), lambda a, e: a + e * e)
    df = vectors.filter(F.col(key).isNotNull() & (F.size(vector) > 0)).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter(square("v") > 0)
    cut = F.greatest(F.floor(F.size("v") * HEAD).cast("int"), F.lit(1))
    theta = F.atan2(F.sqrt(square(F.slice("v", cut + 1, F.size("v")))), F.sqrt(square(F.slice("v", F.lit(1), cut))))
    df = df.withColumn("theta", theta).withColumn("band", F.floor(F.col("theta") / width))
    deals = max(1, -(-df.count() // block))
    dealt = df.withColumn("deal", F.pmod(F.xxhash64("id"), F.lit(deals)))
    blocks = dealt.groupBy("band", "deal").agg(F.collect_list("id").alias("ids"), F.collect_list("v").alias("vs"), F.min("theta").alias("low"), F.max("theta").alias("high"))
    left = blocks.select(F.col("band"), F.col("band").alias("band_a"), *(F.col(c).alias(f"{c}_a") for c in ("deal", "ids", "vs", "low", "high")))
    right = blocks.select(F.explode(F.array(F.col("band"), F.col("band") - 1)).alias("band"), F.col("band").alias("band_b"), *(F.col(c).alias(f"{c}_b") for c in ("deal", "ids", "vs", "low", "high")))
    near = (F.col("low_b") <= F.col("high_a") + width) & (F.col("low_a") <= F.col("high_b") + width)
    once = (F.col("band_b") > F.col("band_a")) | (F.col("deal_a") <= F.col("deal_b"))
    meet = left.join(right, "band").filter(near & once).select((F.col("band_a") == F.col("band_b")).alias("banded"), "deal_a", "deal_b", "ids_a", "vs_a", "ids_b", "vs_b")

    def score(batches):
        import pyarrow as pa

        def unit(vectors):
            n = vectors.value_lengths().to_numpy()
            m = np.zeros((len(n), n.max()))
            m[np.arange(n.max()) < n[:, None]] = vectors.flatten().to_numpy()
            return m / np.sqrt((m * m).sum(1, keepdims=True))

        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i] for n in batch.schema.names}
                ids = [row[f"ids_{s}"].values.to_numpy() for s in "ab"]
                m = [unit(row[f"vs_{s}"].values) for s in "ab"]
                wide = min(x.shape[1] for x in m)  # what lies beyond is multiplied by zeros
                s = m[0][:, :wide] @ m[1][:, :wide].T
                # The two lists of a block that meets itself may be in different orders, so its pairs are told by their ids.
                itself = row["banded"].as_py() and row["deal_a"] == row["deal_b"]
                x, y = ids[0][:, None], ids[1][None]
                hit = (s >= least) & (x < y if itself else x != y)
                p, q = np.nonzero(hit)
                a, b = ids[0][p], ids[1][q]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(s[p, q])], ["a", "b", "similarity"])

    return meet.mapInArrow(score, "a long, b long, similarity double")
