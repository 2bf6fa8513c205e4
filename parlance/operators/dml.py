"""Changes of tables as pure functions: (base, changes) -> new table.

Plain Parquet has no DELETE or MERGE, so a change is a new snapshot (see
``parlance.sources.store``).  ``seq`` orders the changes of one batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.text import trimmed
from parlance.operators.ordered import best_per_key

# Limits of the templates that users write; lengths are in bytes.
MOST_TEMPLATES, NAME_BYTES, PROMPT_BYTES = 50, 200, 10_000


def append_new(base: DataFrame, new: DataFrame, key: str, order: list) -> DataFrame:
    """Rows with new keys, the first of each; a key that's there already changes nothing."""
    return base.unionByName(best_per_key(new, [key], order).select(*base.columns).join(base.select(key), key, "left_anti").select(*base.columns))


def upsert_speakers(base: DataFrame, changes: DataFrame) -> DataFrame:
    """By (meeting_id, slot): the first id stays, and the last label that isn't null counts."""
    every = base.withColumn("seq", F.lit(-1).cast("long")).unionByName(changes)
    label = F.max_by("label", F.when(F.col("label").isNotNull(), F.col("seq")))
    return every.groupBy("meeting_id", "slot").agg(F.min_by("id", "seq").alias("id"), label.alias("label"))


def upsert_last(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """By key, the last row replaces all before, its id too."""
    every = base.withColumn("seq", F.lit(-1).cast("long")).unionByName(changes)
    return best_per_key(every, keys, [F.desc("seq")]).drop("seq")


def patched(base: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """Columns of ``patch`` that aren't null replace those of the base."""
    named = [c for c in patch.columns if c != key]
    p = patch.select(key, *(F.col(c).alias(f"_new_{c}") for c in named))
    df = base.join(p, key, "left")
    for c in named:
        df = df.withColumn(c, F.coalesce(f"_new_{c}", c))
    return df.select(*base.columns)


def set_where(base: DataFrame, where: Column, column: str, value: Column) -> DataFrame:
    """A column of the rows that match; null can be set too."""
    return base.withColumn(column, F.when(where, value).otherwise(F.col(column)))


def without(base: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't among those deleted."""
    return base.join(gone.select(key), key, "left_anti")


def delete_cascade(tables: dict[str, DataFrame], gone: DataFrame, key: str = "meeting_id") -> dict[str, DataFrame]:
    """All tables without the rows of the deleted meetings."""
    return {name: without(df, gone, key) for name, df in tables.items()}


def template_fault(name: Column, prompt: Column) -> Column:
    """What is wrong with a template's words, or null."""
    fault = F.lit(None).cast("string")
    for what, x, most in (("prompt", prompt, PROMPT_BYTES), ("name", name, NAME_BYTES)):
        t = trimmed(x)
        fault = F.when(F.octet_length(t) > most, f"template {what} exceeds {most} characters").otherwise(fault)
    for what, x in (("prompt", prompt), ("name", name)):
        fault = F.when(F.coalesce(trimmed(x), F.lit("")) == "", f"template {what} cannot be empty").otherwise(fault)
    return fault


def checked_template(row: DataFrame) -> tuple[DataFrame, str | None]:
    """A row (id, name, prompt) with trimmed words, and the first fault of any."""
    faults = row.select(template_fault(F.col("name"), F.col("prompt")).alias("fault")).filter("fault IS NOT NULL").limit(1).collect()
    return row.withColumns({"name": trimmed(F.col("name")), "prompt": trimmed(F.col("prompt"))}), faults[0].fault if faults else None
