"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations alone.

Targets: sources in code point order (null last) weigh 5, 2, 1, repeating, and share
``share`` times the words of the corpus; no target exceeds ``most`` times its source,
and what lies above is shared again by weight.  That is the water level L at which
the sum of min(most * size, L * weight) is the total: sources ordered by size over
weight fill up one after the other, so a running sum finds L.

Documents: a source whose target is e times its size gives floor(e) complete epochs
before any fractional selection.  The rest is taken in the order of exponential keys
-ln(u) / w, with u a fingerprint of the doc_id and w the quality weight, until the
running sum of words comes nearest to what is left of the budget.

The running sum within a source is taken in two steps, so that a source which holds
a third of all rows is no single task: keys are cut into slices of about
``slice_rows`` documents, sums of slices give each slice its offset, and rows are
summed within their slice.  Slices are cut where the distribution of a source's keys,
a mixture of exponentials by its quality weights, puts equal shares, so that they are even
at any weights; weights that are close count as one there, which changes no result.

Null texts have size 0 and are never taken in part; a null source is a source of its
own.  Rows with equal doc_id share u and are ordered by size, rows without a doc_id get u
from their text; identical rows are interchangeable.  Texts of any length are counted
whole.  Reruns give the same rows.  Targets take one row for each source to one task.  Columns
named like the results are replaced, all others kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.llm import _common as c

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SLICE_ROWS = 2000
#: Quality weight by label: without one, a document counts as average.
QUALITY = {1: 2.0, 0: 0.5, None: 1.0}
WORDS = "[^\\x20\\x09-\\x0D]+"


def uniform(name: Column) -> Column:
    """A number in (0, 1) for each name, from 52 bits of its MD5."""
    bits = F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / float(1 << 52)


def with_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Rows (source, source_size) with the word budget ``target`` of each source."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (place % len(weights) + 1).cast("int"))
    df = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(most))
    full = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    rest = full.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy()) * float(share)
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    # Sources fill up in this order: the first one below its cap sets the level, and those after it are below too.
    df = df.withColumn("level", level).withColumn("below", F.col("level") * F.col("weight") <= F.col("cap"))
    df = df.withColumn("first", F.min(F.when(F.col("below"), F.struct(F.col("cap") / F.col("weight"), F.col("level").alias("level")))).over(Window.partitionBy()))
    target = F.least(F.col("cap"), F.coalesce(F.col("first.level"), F.lit(float("inf"))) * F.col("weight"))
    return df.select("source", "source_size", target.alias("target"))


def mixed(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Adds source_size, target and taken to rows with (doc_id, source, size, quality_weight), and u in (0, 1) or one by doc_id."""
    if "u" not in docs.columns:
        docs = docs.withColumn("u", uniform(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    keep = [x for x in docs.columns if x not in ("source_size", "target", "taken", "u")]
    row = F.struct(*(F.col(x) for x in keep)).alias("row")
    docs = docs.select(row, "doc_id", "source", "size", (-F.log("u") / F.col("quality_weight")).alias("key"), F.round(F.log2("quality_weight") * 2).alias("heft"))
    docs = c.stored(docs)  # it's read three times, and sizes take a pass over all texts
    parts = docs.groupBy("source", "heft").agg(F.sum("size").alias("words"), F.count("*").alias("docs"))
    sizes = parts.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum("docs").alias("docs"), F.collect_list(F.struct("heft", "docs")).alias("hefts"))
    targets = with_targets(sizes.select("source", "source_size"), weights, share, most)
    per = targets.join(sizes.select("source", "docs", "hefts"), targets["source"].eqNullSafe(sizes["source"])).select(
        targets["source"].alias("of"), "source_size", "target", "docs", "hefts", F.greatest(F.lit(1), F.ceil(F.col("docs") / slice_rows)).alias("slices")
    )
    df = docs.join(per, docs["source"].eqNullSafe(per["of"])).drop("of")
    upto = F.aggregate("hefts", F.lit(0.0), lambda a, x: a + x["docs"] * (1 - F.exp(-F.col("key") * F.pow(F.lit(2.0), x["heft"] / 2)))) / F.col("docs")
    df = df.withColumn("slice", F.floor(upto * F.col("slices"))).drop("hefts", "docs", "slices", "heft")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    df = df.withColumn("epochs", epochs.cast("long"))
    within = Window.partitionBy("source", "slice").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("upto", F.sum("size").over(within))
    slices = docs_slices(df)
    df = df.join(slices, df["source"].eqNullSafe(slices["of"]) & (df["slice"] == slices["of_slice"]))
    budget = F.col("target") - F.col("epochs") * F.col("source_size")
    part = (F.col("offset") + F.col("upto") - F.col("size") / 2.0 <= budget) & (budget > 0)
    taken = F.col("size") * (F.col("epochs") + part.cast("long"))
    return df.select("row.*", "source_size", "target", taken.cast("long").alias("taken"))


def docs_slices(df: DataFrame) -> DataFrame:
    """The words of a source before each of its slices."""
    sums = df.groupBy(F.col("source").alias("of"), F.col("slice").alias("of_slice")).agg(F.sum("size").alias("n"))
    before = Window.partitionBy("of").orderBy("of_slice").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("of", "of_slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))


def sized(docs: DataFrame, labels: DataFrame | None, *keep: str) -> DataFrame:
    """(doc_id, source, size, quality_weight, u, *keep) of documents; labels may lack or repeat a document."""
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORDS)), F.lit(0)).cast("long")
    name = F.coalesce(F.col("doc_id").cast("string"), F.md5("text"), F.lit("null"))
    df = docs.select("doc_id", "source", size.alias("size"), uniform(name).alias("u"), *keep)
    if labels is None:
        return df.withColumn("quality_weight", F.lit(QUALITY[None]))
    known = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    weight = F.when(F.col("quality") == 1, QUALITY[1]).when(F.col("quality") == 0, QUALITY[0]).otherwise(QUALITY[None])
    return df.join(known, "doc_id", "left").withColumn("quality_weight", weight).drop("quality")


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = sized(c.read_table(spark, sf_dir, "documents"), c.read_table(spark, sf_dir, "labels"))
    return mixed(docs).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = """
WITH known AS (SELECT doc_id, max(quality) AS quality FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
docs AS (
  SELECT d.doc_id, d.source, coalesce(len(regexp_extract_all(d.text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         CASE k.quality WHEN 1 THEN 2.0::DOUBLE WHEN 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS w,
         (('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM documents d LEFT JOIN known k ON d.doc_id = k.doc_id),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
weighed AS (
  SELECT source, source_size, source_size * 2.0::DOUBLE AS cap,
         (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::DOUBLE AS weight
  FROM sizes),
levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)),
targets AS (
  SELECT source, source_size,
         least(cap, coalesce((SELECT arg_min(level, cap / weight) FROM levels WHERE level * weight <= cap), 'inf'::DOUBLE) * weight) AS target
  FROM levels),
keyed AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target, -ln(d.u) / d.w AS key,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END::BIGINT AS epochs
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
summed AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto,
         target - epochs * source_size AS budget
  FROM keyed)
SELECT doc_id, size, source_size, target,
       (size * (epochs + CASE WHEN upto - size / 2.0::DOUBLE <= budget AND budget > 0 THEN 1 ELSE 0 END))::BIGINT AS taken
FROM summed
"""
