"""Queries over the catalogue of meetings: lists, labels, nested documents, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.text import speaker_name, trimmed
from parlance.operators.ordered import best_per_key


def newest_meetings(meetings: DataFrame, limit: int = 0) -> DataFrame:
    """Finished meetings, newest first; a limit of 0 is none."""
    df = meetings.filter("ended_ms IS NOT NULL").orderBy(F.desc("started_ms"), "meeting_id")
    return df.limit(limit) if limit else df


def header(meetings: DataFrame, meeting_id) -> DataFrame:
    return meetings.filter(F.col("meeting_id") == meeting_id)


def labelled_segments(segments: DataFrame, speakers: DataFrame, missing: Column | None = None) -> DataFrame:
    """Segments with the display name of their speaker; those without one stay."""
    names = speakers.select("meeting_id", "role", speaker_name(F.col("label"), F.col("slot")).alias("speaker"))
    df = segments.join(names, ["meeting_id", "role"], "left")
    return df if missing is None else df.withColumn("speaker", F.coalesce("speaker", missing))


def nested(meetings: DataFrame, segments: DataFrame, speakers: DataFrame, notes: DataFrame) -> DataFrame:
    """One row a meeting with its segments by time, speakers by slot and notes by time as arrays.

    Each child is grouped once on the meeting's key, so the joins need no more shuffles.
    """
    s = segments.groupBy("meeting_id").agg(F.array_sort(F.collect_list(F.struct("start_ms", "seg_id", "end_ms", "role", "text"))).alias("segments"))
    p = speakers.groupBy("meeting_id").agg(F.array_sort(F.collect_list(F.struct("slot", "role", "label"))).alias("speakers"))
    n = notes.groupBy("meeting_id").agg(F.array_sort(F.collect_list(F.struct("timestamp_ms", "note_id", "text"))).alias("notes"))
    df = meetings
    for child, name in ((s, "segments"), (p, "speakers"), (n, "notes")):
        df = df.join(child, "meeting_id", "left").withColumn(name, F.coalesce(name, F.array()))
    return df


def segment_counts(meetings: DataFrame, segments: DataFrame) -> DataFrame:
    """Distinct segments of each meeting, 0 for those without any."""
    n = segments.dropDuplicates(["seg_id"]).groupBy("meeting_id").agg(F.count("*").alias("segments"))
    return meetings.select("meeting_id").join(n, "meeting_id", "left").withColumn("segments", F.coalesce("segments", F.lit(0)))


def total_finished(meetings: DataFrame) -> DataFrame:
    return meetings.filter("ended_ms IS NOT NULL").agg(F.count("*").alias("meetings"))


def dominant(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The most frequent non-null value of each key; of ties the smallest."""
    n = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("votes"))
    return best_per_key(n, keys, [F.desc("votes"), F.col(value)])


def participants(speakers: DataFrame) -> DataFrame:
    pairs = F.array_sort(F.collect_list(F.struct("slot", F.coalesce("label", F.concat(F.lit("Speaker "), F.col("slot") + 1)).alias("name"))))
    return speakers.groupBy("meeting_id").agg(F.array_join(F.transform(pairs, lambda x: x["name"]), ", ").alias("participants"))


def joined_text(rows: DataFrame, key: str, order: list[str], text: Column, sep: str, name: str) -> DataFrame:
    """Texts of a key in order, those that are blank left out."""
    parts = rows.select(key, *order, text.alias("_t")).filter("_t <> ''")
    lists = F.array_sort(F.collect_list(F.struct(*order, "_t")))
    return parts.groupBy(key).agg(F.array_join(F.transform(lists, lambda x: x["_t"]), sep).alias(name))


def timeline(segments: DataFrame, notes: DataFrame) -> DataFrame:
    """Segments and notes of all meetings on one axis of milliseconds."""
    a = segments.select("meeting_id", F.col("start_ms").alias("at_ms"), F.lit("segment").alias("kind"), F.col("seg_id").alias("id"))
    b = notes.select("meeting_id", F.col("timestamp_ms").alias("at_ms"), F.lit("note").alias("kind"), F.col("note_id").alias("id"))
    return a.unionByName(b).orderBy("meeting_id", "at_ms", "kind", "id")


def latest_summary(summaries: DataFrame) -> DataFrame:
    return best_per_key(summaries, ["meeting_id"], [F.desc("created_at"), F.desc("summary_id")])


def question_status(asked: DataFrame, meetings: DataFrame, segments: DataFrame) -> DataFrame:
    """(meeting_id, status) of questions (meeting_id, question): ok, or why it can't be answered."""
    known = meetings.select("meeting_id", F.lit(True).alias("_known"))
    said = segments.filter(trimmed(F.col("text")) != "").groupBy("meeting_id").agg(F.lit(True).alias("_said"))
    status = (
        F.when(trimmed(F.coalesce("question", F.lit(""))) == "", "empty_question")
        .when(F.col("_known").isNull(), "not_found")
        .when(F.col("_said").isNull(), "empty_transcript")
        .otherwise("ok")
    )
    return asked.join(known, "meeting_id", "left").join(said, "meeting_id", "left").select("meeting_id", status.alias("status"))
