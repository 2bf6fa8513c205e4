"""Summaries by a language model: one call, a second one with the parser's error where the first answer can't be parsed, free text after that.

Every row goes through both calls as a column, and the model is asked a second time only where there is a second prompt, so
the rows are neither split nor asked twice.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.functions.payload import CUSTOM, FIELDS, FREE_TEXT, with_payload
from parlance.functions.render import custom_prompt, summary_prompt
from parlance.functions.text import trimmed


def _asked(df: DataFrame, prompt: Column, generate: Callable[[str], str], name: str) -> DataFrame:
    """``df`` with ``name``, struct<answer, error>: what the model says to a prompt; null where there is none."""
    df = df.withColumn("_prompt", prompt)
    schema = T.StructType([*df.drop("_prompt").schema.fields, T.StructField(name, T.StructType([T.StructField("answer", T.StringType()), T.StructField("error", T.StringType())]))])
    # The other columns go along as they are, packed, so that no type is lost on the way.
    kept = df.drop("_prompt").columns
    packed = df.select(F.to_json(F.struct(*kept)).alias("row"), "_prompt")

    def call(batches):
        for pdf in batches:
            out = []
            for prompt in pdf["_prompt"]:
                try:
                    out.append((None, None) if prompt is None else (generate(prompt), None))
                except Exception as e:  # a model may fail in any way
                    out.append((None, str(e)))
            yield pd.DataFrame({"row": pdf["row"], "answer": [a for a, _ in out], "error": [e for _, e in out]})

    rows = packed.mapInPandas(call, "row string, answer string, error string")
    inner = T.StructType(schema.fields[:-1])
    return rows.select(F.from_json("row", inner).alias("_row"), "answer", "error").select("_row.*", F.when(F.coalesce("answer", "error").isNotNull(), F.struct("answer", "error")).alias(name))


def summarised(asked: DataFrame, generate: Callable[[str], str], retry: bool = True) -> DataFrame:
    """(meeting_id, asked, template, raw, payload, calls, error): the summary of each row of ``asked``.

    ``asked`` has (meeting_id, template, transcript, language, notes, prompt): ``prompt`` is the user's own words of template
    ``custom``, otherwise null.  An unknown template and an empty transcript are errors without a call, and a failing model is
    one.  ``template`` is ``freeText`` where no answer could be parsed; then the last answer stands as it is.  Without ``retry``, as
    for answers that are shown while they come, the first is the last.
    """
    custom = F.col("asked") == CUSTOM
    wrong = F.when(~F.col("asked").isin(*FIELDS, CUSTOM), F.concat(F.lit("invalid template: "), "asked")).when(F.coalesce(trimmed(F.col("transcript")), F.lit("")) == "", "empty transcript")
    df = asked.select("meeting_id", F.col("template").alias("asked"), "transcript", "language", "notes", "prompt").withColumn("wrong", wrong)
    feedback = F.lit(None).cast("string")
    first = F.when(custom, custom_prompt(F.col("prompt"), F.col("transcript"), F.col("language"), F.col("notes"))).otherwise(summary_prompt(F.col("asked"), F.col("transcript"), F.col("language"), F.col("notes"), feedback))
    df = _asked(df, F.when(F.col("wrong").isNull(), first), generate, "first")
    answer = F.when(custom, trimmed(F.col("first.answer"))).otherwise(F.col("first.answer"))
    df = with_payload(df.withColumn("raw1", answer), F.when(F.col("raw1").isNotNull(), F.col("asked")), F.col("raw1"), "p1")
    fault = F.when(F.col("raw1").isNotNull(), F.col("p1.error"))
    df = df.withColumn("fault", fault).drop("p1")
    again = F.when(F.col("fault").isNotNull() & F.lit(retry), summary_prompt(F.col("asked"), F.col("transcript"), F.col("language"), F.col("notes"), F.col("fault")))
    df = _asked(df, again, generate, "second")
    last = F.coalesce("second.answer", "raw1")
    df = with_payload(df.withColumn("raw", last), F.col("asked"), F.col("raw"), "p2")
    failed = F.coalesce("wrong", "first.error", "second.error")
    fine = F.col("fault").isNull() | F.coalesce(F.col("second.answer").isNotNull() & F.col("p2.error").isNull(), F.lit(False))
    template = F.when(failed.isNull(), F.when(fine, F.col("asked")).otherwise(FREE_TEXT))
    df = df.withColumns({"failed": failed, "template": template, "calls": F.col("first").isNotNull().cast("int") + F.col("second").isNotNull().cast("int")}).drop("p2")
    df = with_payload(df, F.col("template"), F.when(F.col("template").isNotNull(), F.col("raw")), "p")
    return df.select("meeting_id", "asked", "template", F.when(F.col("template").isNotNull(), F.col("raw")).alias("raw"), F.when(F.col("template").isNotNull(), F.col("p.payload")).alias("payload"), "calls", F.col("failed").alias("error"))
