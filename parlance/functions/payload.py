"""Structured answers of language models: the first JSON object in a text, and its typed content by template."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The fields of each template, as (kind, JSON field).  Text fields may be missing,
# the others are arrays that are empty if missing.
FIELDS = {
    "general": (("list", "keyPoints"), ("list", "decisions"), ("tasks", "actionItems"), ("list", "openQuestions")),
    "oneOnOne": (("list", "wins"), ("list", "blockers"), ("list", "growthFeedback"), ("tasks", "nextSteps"), ("list", "followUpTopics")),
    "sprintReview": (("list", "completedItems"), ("list", "carryOver"), ("list", "risks"), ("list", "nextSprintPriorities")),
    "interview": (("quotes", "quotes"), ("list", "themes"), ("list", "painPoints"), ("list", "opportunities")),
    "salesCall": (("text", "customerContext"), ("list", "painPoints"), ("list", "interestSignals"), ("list", "objections"), ("tasks", "nextSteps"), ("text", "dealStageIndicator")),
    "lecture": (("list", "conceptsCovered"), ("definitions", "definitions"), ("list", "examples"), ("list", "homeworkOrNext")),
}
#: Members of the structs in an array; those that an item must have as text come first, then how many these are.
MEMBERS = {"tasks": (("task", "owner", "due"), 1), "quotes": (("speaker", "quote", "context"), 2), "definitions": (("term", "definition"), 2)}
#: An answer that couldn't be parsed, and that to a user's own template: text as it is.
FREE_TEXT, CUSTOM = "freeText", "custom"
KINDS = {name: kind for fields in FIELDS.values() for kind, name in fields}


def first_object(text: Column) -> Column:
    """The first balanced JSON object of a text, or null; braces within strings don't count.

    From the first brace on, the text is cut into escapes, quotes, braces and what is between
    them, and an ordered fold over these finds where the object ends.
    """
    tail = F.substring(text, F.nullif(F.locate("{", text), F.lit(0)), F.length(text))
    pieces = F.regexp_extract_all(tail, F.lit('(?s)\\\\.?|["{}]|[^\\\\"{}]+'), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(0).alias("size"), F.lit(0).alias("end"))

    def step(s: Column, piece: Column) -> Column:
        # Outside of strings a backslash has no meaning, so what follows it counts.
        mark = F.when(~s["quoted"] & piece.startswith("\\"), F.substring(piece, 2, 1)).otherwise(piece)
        depth = s["depth"] + F.when(s["quoted"], 0).when(mark == "{", 1).when(mark == "}", -1).otherwise(0)
        size = s["size"] + F.length(piece)
        ended = ~s["quoted"] & (mark == "}") & (depth == 0)
        new = F.struct(depth.alias("depth"), (s["quoted"] != (mark == '"')).alias("quoted"), size.alias("size"), F.when(ended, size).otherwise(0).alias("end"))
        return F.when(s["end"] > 0, s).otherwise(new)

    # The fold's last step cuts the text, so that the fold isn't repeated where its end is read twice.
    return F.aggregate(pieces, start, step, lambda s: F.when(s["end"] > 0, F.substring(tail, F.lit(1), s["end"])))


def _text(v: Column, path: str) -> Column:
    """A member of a variant that is a string; null if it's of another type."""
    x = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(v, path, "string"))


def _items(v: Column, name: str) -> Column:
    found = F.try_variant_get(v, f"$.{name}", "variant")
    items = F.when(F.schema_of_variant(found).startswith("ARRAY"), F.try_variant_get(v, f"$.{name}", "array<variant>"))
    return F.filter(F.coalesce(items, F.array().cast("array<variant>")), lambda x: x.isNotNull())


def _field(v: Column, kind: str, name: str) -> Column:
    if kind == "text":
        return _text(v, f"$.{name}")
    if kind == "list":
        return F.filter(F.transform(_items(v, name), lambda x: _text(x, "$")), lambda x: x.isNotNull())
    members, needed = MEMBERS[kind]
    rows = F.transform(_items(v, name), lambda x: F.struct(*(_text(x, f"$.{m}").alias(m) for m in members)))
    return F.filter(rows, lambda x: F.array_size(F.filter(F.array(*(x[m] for m in members[:needed])), lambda y: y.isNull())) == 0)


def with_payload(df: DataFrame, template: Column, raw: Column, name: str) -> DataFrame:
    """``df`` with ``name``, struct<payload, error> of a model's answer: one of both is null.

    The payload has ``summary``, which must be a string, and the fields of all templates; those that
    aren't of this template are null.  Items of a wrong type, or without a member they need, are dropped.
    Templates ``freeText`` and ``custom`` take any answer as it is, as their ``text``.

    The object is found and parsed once, in columns of their own, as each field reads it.
    """
    free = F.coalesce(template.isin(FREE_TEXT, CUSTOM), F.lit(False))
    df = df.withColumns({"_template": template, "_raw": raw, "_free": free})
    df = df.withColumn("_block", F.when(~F.col("_free"), first_object(F.col("_raw"))))
    df = df.withColumn("_json", F.try_parse_json("_block"))
    df = df.withColumn("_summary", _text(F.col("_json"), "$.summary"))
    error = (
        F.when(F.col("_free"), None)
        .when(F.col("_block").isNull(), "no JSON object found in response")
        .when(F.col("_json").isNull(), "invalid JSON")
        .when(F.col("_summary").isNull(), "missing required field `summary`")
        .when(~F.col("_template").isin(*FIELDS), F.concat(F.lit("unknown template: "), "_template"))
    )
    of = lambda name: F.col("_template").isin(*(t for t, fs in FIELDS.items() if any(n == name for _, n in fs)))
    fields = [F.when(of(field), _field(F.col("_json"), kind, field)).alias(field) for field, kind in KINDS.items()]
    content = F.struct(F.col("_summary").alias("summary"), F.when(F.col("_free"), F.col("_raw")).alias("text"), *fields)
    df = df.withColumn("_error", error)
    both = F.struct(F.when(F.col("_error").isNull(), content).alias("payload"), F.col("_error").alias("error"))
    return df.withColumn(name, both).drop("_template", "_raw", "_free", "_block", "_json", "_summary", "_error")
