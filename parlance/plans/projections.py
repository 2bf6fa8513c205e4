"""The relations of recorded conversations, projected from the base tables.

Each projection has a DuckDB twin in ``SQL``, as a common table expression that
``with_sql`` puts before a query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One turn a row; it lasts ten milliseconds a character."""
    t = table(spark, sf_dir, "conversations")
    lasts = F.coalesce(F.length("text"), F.lit(0)) * 10
    upto = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.withColumn("end_ms", F.sum(lasts).over(upto).cast("long"))
    return t.select(
        (F.col("conv_id") * 100000 + F.col("turn")).alias("seg_id"), F.col("conv_id").alias("meeting_id"), "turn", "role", "text",
        (F.col("end_ms") - lasts).alias("start_ms"), "end_ms",
    )


def meetings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One conversation a row; every tenth is still being recorded.

    Turns follow each other, so a conversation lasts as long as its turns together, which is one sum without an order.
    """
    lasts = F.coalesce(F.length("text"), F.lit(0)) * 10
    t = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("meeting_id"))
    g = t.agg(F.count("*").alias("segment_count"), F.sum(lasts).cast("long").alias("duration_ms"))
    start = F.lit(1704067200000) + F.col("meeting_id") * 3600000
    return g.select(
        "meeting_id", F.concat(F.lit("Conversation "), F.col("meeting_id")).alias("title"), start.alias("started_ms"),
        F.when(F.col("meeting_id") % 10 != 0, start + F.col("duration_ms")).alias("ended_ms"), "duration_ms", "segment_count",
    )


def speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of a conversation in order of their first turn; the assistant has no label."""
    first = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("meeting_id"), "role").agg(F.min("turn").alias("first_turn"))
    slot = F.dense_rank().over(Window.partitionBy("meeting_id").orderBy("first_turn", "role")) - 1
    return first.select("meeting_id", "role", slot.alias("slot"), F.when(F.col("role") != "assistant", F.initcap("role")).alias("label"))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter("event_type = 'view'")
    ms = F.expr("unix_millis(CAST(ts AS TIMESTAMP)) - 1704067200000")
    return e.select(F.col("event_id").alias("note_id"), F.col("user_id").alias("meeting_id"), F.col("props").alias("text"), ms.alias("timestamp_ms"))


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON payload by document; its source is the meeting and its language picks the template."""
    d = table(spark, sf_dir, "documents")
    template = F.when(F.col("lang") == "en", "general").when(F.col("lang") == "de", "lecture").otherwise("interview")
    payload = F.to_json(F.struct(template.alias("template"), F.col("text").alias("summary")))
    return d.select(F.col("doc_id").alias("summary_id"), F.col("source").alias("meeting_id"), template.alias("template"), F.col("doc_id").alias("created_at"), payload.alias("payload"))


def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as those of a recording session, numbered in order of arrival."""
    e = table(spark, sf_dir, "events")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    kind = F.element_at(F.create_map(*(F.lit(x) for x in ("click", "chunk", "view", "chunk", "purchase", "skipped", "error", "paused", "signup", "resumed"))), F.col("event_type"))
    return e.select(F.col("user_id").alias("session_id"), "event_id", seq.cast("long").alias("seq"), kind.alias("type"), F.round(F.col("value") / 1000, 6).alias("rms"), F.floor(F.col("value") * 10).cast("long").alias("duration_ms"))


SQL = {
    "segments": """segments AS (
  SELECT conv_id * 100000 + turn AS seg_id, conv_id AS meeting_id, turn, role, text,
         (sum(coalesce(length(text), 0) * 10) OVER w - coalesce(length(text), 0) * 10)::BIGINT AS start_ms, (sum(coalesce(length(text), 0) * 10) OVER w)::BIGINT AS end_ms
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))""",
    "meetings": """meetings AS (
  SELECT meeting_id, 'Conversation ' || meeting_id AS title, 1704067200000 + meeting_id * 3600000 AS started_ms,
         CASE WHEN meeting_id % 10 <> 0 THEN 1704067200000 + meeting_id * 3600000 + max(end_ms) END AS ended_ms,
         max(end_ms) AS duration_ms, count(*) AS segment_count
  FROM segments GROUP BY meeting_id)""",
    "speakers": """speakers AS (
  SELECT meeting_id, role, (dense_rank() OVER (PARTITION BY meeting_id ORDER BY first_turn, role) - 1)::INTEGER AS slot,
         CASE WHEN role <> 'assistant' THEN upper(role[1]) || role[2:] END AS label
  FROM (SELECT conv_id AS meeting_id, role, min(turn) AS first_turn FROM conversations GROUP BY ALL))""",
    "notes": """notes AS (
  SELECT event_id AS note_id, user_id AS meeting_id, props AS text, epoch_us(ts) // 1000 - 1704067200000 AS timestamp_ms
  FROM events WHERE event_type = 'view')""",
    "summaries": """summaries AS (
  SELECT doc_id AS summary_id, source AS meeting_id, CASE lang WHEN 'en' THEN 'general' WHEN 'de' THEN 'lecture' ELSE 'interview' END AS template,
         doc_id AS created_at, text AS summary
  FROM documents)""",
    "session_events": """session_events AS (
  SELECT user_id AS session_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq,
         CASE event_type WHEN 'click' THEN 'chunk' WHEN 'view' THEN 'chunk' WHEN 'purchase' THEN 'skipped' WHEN 'error' THEN 'paused' WHEN 'signup' THEN 'resumed' END AS type,
         round(value / 1000, 6) AS rms, floor(value * 10)::BIGINT AS duration_ms
  FROM events)""",
}
SQL["frames"] = """frames AS (
  SELECT *, CASE WHEN paused THEN 0 ELSE 1 + event_id % 5 END AS n, seq = max(seq) OVER (PARTITION BY session_id) AND session_id % 3 <> 0 AS ended
  FROM (SELECT *, coalesce(last_value(CASE WHEN type IN ('paused', 'resumed') THEN type = 'paused' END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY seq), false) AS paused FROM session_events))"""
_NEEDS = {"meetings": ("segments",), "frames": ("session_events",)}


def with_sql(body: str, *relations: str) -> str:
    """``body`` after the common table expressions that it names."""
    names: list[str] = []
    for r in relations:
        names += [x for x in (*_NEEDS.get(r, ()), r) if x not in names]
    parts = [SQL[x] for x in names]
    head = body.strip()
    if head.upper().startswith("WITH "):
        return "WITH " + ",\n".join([*parts, head[5:]])
    return "WITH " + ",\n".join(parts) + "\n" + head
