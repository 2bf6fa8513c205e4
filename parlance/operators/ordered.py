"""Ordered picks: first rows by key, last rows, running offsets, edges and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key by an order."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rn).filter("_rn = 1").drop("_rn")


def last_rows(df: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    """The last k rows of each key by an order."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.desc(x) for x in order)))
    return df.withColumn("_rn", rn).filter(F.col("_rn") <= k).drop("_rn")


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """A running number from 0."""
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long"))


def offset_before(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """The sum of a value over all rows before this one."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(value).over(w), F.lit(0)).cast("long"))


def edges(df: DataFrame, keys: list[str], order: list[str], flag: str) -> DataFrame:
    """Rows where a flag differs from the row before; before the first row it's false."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_prior", F.lag(flag, 1, False).over(w)).filter(F.col(flag) != F.col("_prior")).drop("_prior")


def runs(df: DataFrame, keys: list[str], at: str, active: Column, least: int = 1) -> DataFrame:
    """Maximal runs of consecutive places that are active: (*keys, start, end, length)."""
    on = df.filter(active)
    island = F.col(at) - F.row_number().over(Window.partitionBy(*keys).orderBy(at))
    out = on.withColumn("_island", island).groupBy(*keys, "_island").agg(F.min(at).alias("start"), (F.max(at) + 1).alias("end"), F.count("*").alias("length"))
    return out.drop("_island").filter(F.col("length") >= least)


def speaker_spans(segments: DataFrame, key: str, at: str) -> DataFrame:
    """(key, speaker, start_ms, end_ms, place): a speaker's turns in a row as one span, numbered from 0 in the order of start, then speaker."""
    island = F.col(at) - F.row_number().over(Window.partitionBy(key, "speaker").orderBy(at))
    spans = segments.withColumn("_island", island).groupBy(key, "speaker", "_island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).drop("_island")
    return numbered(spans, [key], ["start_ms", "speaker", "end_ms"], "place").select(key, "speaker", "start_ms", "end_ms", "place")
