"""From session events to meetings, speakers and segments, in batch and as a stream into a store.

A session exists from its ``started`` event on; events of unknown sessions, and those after the first
``stopped`` or ``failed``, are dropped.  A stopped session has the stream's totals; a failed one what was counted:
the clock takes the later of itself and a chunk's end, and adds what is skipped.  ``paused`` and ``resumed`` change nothing.

The stream is a fold by session.  Its state is a few counters, and what it gives are the changes of a store: a new
meeting, speakers, segments, a final patch.  So a micro-batch costs as much as the sessions in it, and what users have
changed meanwhile, such as a title or a speaker's label, stays.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.operators import dml

TERMINAL = ("stopped", "failed")
SEGMENT = "id: string, start_ms: bigint, end_ms: bigint, text: string, speaker_id: string, confidence: float"
CHANGES = (
    f"meeting_id string, seq long, kind string, title string, at timestamp, speaker_id string, slot int, segments array<struct<{SEGMENT}>>, "
    "duration_ms long, language string, segment_count long"
)
STATE = "last long, over boolean, clock long, segments long, votes string"


def accepted(events: DataFrame) -> DataFrame:
    """Events of started sessions up to their first terminal one, repeated deliveries once; sessions are shuffled once."""
    session = Window.partitionBy("session_id")
    by_seq = session.orderBy("seq")
    df = events.withColumn("_again", F.coalesce(F.lag("seq").over(by_seq) == F.col("seq"), F.lit(False))).filter("NOT _again").drop("_again")
    df = df.withColumn("_first", F.min(F.when(F.col("type") == "started", F.col("seq"))).over(session))
    over = F.col("type").isin(*TERMINAL) & (F.col("seq") > F.col("_first"))
    df = df.withColumn("_last", F.min(F.when(over, F.col("seq"))).over(session))
    return df.filter((F.col("seq") >= F.col("_first")) & (F.col("_last").isNull() | (F.col("seq") <= F.col("_last")))).drop("_first", "_last")


def _is(kind: str):
    return F.col("type") == kind


def _facts(events: DataFrame) -> DataFrame:
    """One row for each session of accepted events: its counters, and where it begins and ends."""
    skip = F.when(_is("skipped"), F.col("duration_ms")).otherwise(0)
    after = Window.partitionBy("session_id").orderBy("seq").rowsBetween(1, Window.unboundedFollowing)
    end = F.coalesce(F.array_max(F.transform("segments", lambda s: s["end_ms"])), F.lit(0))
    heard = F.when(_is("chunk") & (F.size("segments") > 0), F.element_at("segments", -1)["end_ms"] - F.col("offset_ms")).otherwise(0)
    n = F.when(_is("chunk"), F.greatest(F.size("segments"), F.lit(0))).otherwise(0)
    df = events.withColumns({"_skip": skip, "_end": end}).withColumn("_later", F.coalesce(F.sum("_skip").over(after), F.lit(0)))
    # The clock ends at the largest end of a chunk plus all that was skipped after it.
    clock = F.greatest(F.coalesce(F.max(F.when(_is("chunk"), F.col("_end") + F.col("_later"))), F.lit(0)), F.sum("_skip"))
    final = F.col("type").isin(*TERMINAL)
    of = lambda kind, *names: F.min_by(F.struct(*names), F.when(kind, F.col("seq")))
    return df.groupBy("session_id").agg(
        F.count_if(_is("chunk")).alias("chunks"), F.count_if(_is("skipped")).alias("skipped"), F.sum(n).cast("long").alias("segments"), F.sum(heard).cast("long").alias("audio_ms"),
        clock.cast("long").alias("fallback_ms"), F.mode(F.when(_is("chunk"), F.col("language")), True).alias("language"), F.max("at").alias("last_at"),
        of(_is("started"), "at", "message").alias("start"), of(final, "type", "at", "total_segments", "total_audio_ms").alias("stop"),
    )


def recorded(events: DataFrame, closed: bool = False) -> dict[str, DataFrame]:
    """The tables ``meetings``, ``speakers`` and ``segments`` of session events (``schema.EVENTS`` plus at, a timestamp).

    With ``closed`` no more events come: sessions without a terminal event count as failed at their last one.
    """
    df = accepted(events)
    chunks = df.filter("type = 'chunk'")
    said = chunks.select("session_id", "seq", F.explode("segments").alias("s"))
    segments = said.withColumn("rn", F.row_number().over(Window.partitionBy("s.id").orderBy("seq", "session_id"))).filter("rn = 1")
    segments = segments.select("s.id", F.col("session_id").alias("meeting_id"), "s.start_ms", "s.end_ms", "s.text", "s.speaker_id", F.col("s.confidence").cast("double").alias("confidence"))
    speakers = chunks.filter("speaker_id IS NOT NULL").groupBy(F.col("session_id").alias("meeting_id"), F.col("speaker_slot").alias("slot")).agg(F.min_by("speaker_id", "seq").alias("id"))
    speakers = speakers.select("id", "meeting_id", "slot", F.lit(None).cast("string").alias("label"))
    stopped, over = F.coalesce(F.col("stop.type") == "stopped", F.lit(False)), F.col("stop").isNotNull() | F.lit(closed)
    meetings = _facts(df).select(
        F.col("session_id").alias("id"), F.col("start.message").alias("title"), F.col("start.at").alias("started_at"), F.when(over, F.coalesce("stop.at", "last_at")).alias("ended_at"),
        F.when(stopped, F.col("stop.total_audio_ms")).when(over, F.col("fallback_ms")).otherwise(0).cast("long").alias("duration_ms"),
        F.when(over, F.col("language")).alias("language"), F.when(stopped, F.col("stop.total_segments")).otherwise(F.col("segments")).cast("long").alias("segment_count"),
    )
    return {"meetings": meetings, "speakers": speakers, "segments": segments}


def session_totals(events: DataFrame) -> DataFrame:
    """(session_id, chunks, skipped, segments, audio_ms, fallback_ms) of accepted events.

    A chunk adds to audio_ms the time from its offset to the end of its last segment.
    """
    at = events if "at" in events.columns else events.withColumn("at", F.lit(None).cast("timestamp"))
    return _facts(at).select("session_id", "chunks", "skipped", "segments", "audio_ms", "fallback_ms")


# --- as a stream --------------------------------------------------------------------------------


class Recording:
    """The fold of one session's events; ``out`` are the changes of the store that they make."""

    def __init__(self, session_id: str, state: tuple | None = None):
        self.id = session_id
        self.last, self.over, self.clock, self.segments, votes = state or (None, False, 0, 0, "{}")
        self.votes: dict[str, int] = json.loads(votes)
        self.out: list[dict] = []

    def state(self) -> tuple:
        return self.last, self.over, self.clock, self.segments, json.dumps(self.votes)

    def _language(self) -> str | None:
        return min(self.votes, key=lambda x: (-self.votes[x], x), default=None)

    def event(self, e: dict) -> None:
        """A repeated event, one that comes after a later one of its session, and one after the end change nothing."""
        known, kind, seq = self.last is not None, e["type"], e["seq"]
        if self.over or (not known and kind != "started") or (known and seq <= self.last):
            return
        self.last = seq
        change = {"meeting_id": self.id, "seq": seq, "at": e["at"]}
        if kind == "started" and not known:
            self.out.append({**change, "kind": "create", "title": e["message"]})
        elif kind == "chunk":
            parts = list(e["segments"]) if e["segments"] is not None else []
            self.clock = max([self.clock, *(s["end_ms"] for s in parts)])
            self.segments += len(parts)
            if e["language"] is not None:
                self.votes[e["language"]] = self.votes.get(e["language"], 0) + 1
            self.out.append({**change, "kind": "chunk", "segments": parts, "speaker_id": e["speaker_id"], "slot": e["speaker_slot"], "segment_count": self.segments})
        elif kind == "skipped":
            self.clock += e["duration_ms"] or 0
        elif kind in TERMINAL:
            self.over = True
            whole = kind == "stopped"
            self.out.append({**change, "kind": "final", "duration_ms": e["total_audio_ms"] if whole else self.clock, "segment_count": e["total_segments"] if whole else self.segments, "language": self._language()})


def _plain(x):
    return None if x is None or (not isinstance(x, (list, dict, str)) and pd.api.types.is_scalar(x) and pd.isna(x)) else x


def change_stream(events: DataFrame, forget_ms: int | None = None) -> DataFrame:
    """(``CHANGES``): the changes of a store that a stream of events makes.

    Events of a session come in order of seq, but for those within a micro-batch.  State is a session's counters.  With
    ``forget_ms``, that of a session that has ended goes after so long; until then late events of it are told as such.
    """
    names = ["type", "seq", "duration_ms", "language", "speaker_id", "speaker_slot", "segments", "total_segments", "total_audio_ms", "message", "at"]
    columns = [x.strip().split()[0] for x in CHANGES.replace(SEGMENT, "").split(", ")]

    def fold(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        r = Recording(key[0], state.get if state.exists else None)
        # Whole numbers with nulls come as floats, so numbers of segments and milliseconds are made whole again.
        for row in pd.concat(list(batches)).sort_values("seq")[names].to_dict("records"):
            e = {k: _plain(v) for k, v in row.items() if k != "segments"}
            e |= {k: int(e[k]) for k in ("seq", "duration_ms", "speaker_slot", "total_segments", "total_audio_ms") if e[k] is not None}
            r.event(e | {"segments": row["segments"]})
        if r.last is not None:
            state.update(r.state())
            if forget_ms and r.over:
                state.setTimeoutDuration(forget_ms)
        if r.out:
            pdf = pd.DataFrame({c: pd.Series([x.get(c) for x in r.out], dtype=object) for c in columns})
            for c in ("seq", "slot", "duration_ms", "segment_count"):
                pdf[c] = pdf[c].astype("Int64")
            pdf["at"] = pd.to_datetime(pdf["at"])
            yield pdf

    kept = events.select("session_id", *names)
    return kept.groupBy("session_id").applyInPandasWithState(fold, CHANGES, STATE, "append", "ProcessingTimeTimeout" if forget_ms else "NoTimeout")


def apply_changes(store, changes: DataFrame, mark: str, number: int) -> None:
    """Applies a batch of changes to a store, in one version; a batch that it has applied already changes nothing.

    New meetings are added, and those that are there stay; speakers are upserted without labels; segments with new ids are
    appended; what ends a session patches its meeting.  Only the buckets of the batch's meetings are read and written.
    """
    base = store.base()
    if base.marks.get(mark, -1) >= number:
        return
    changes = changes.persist()
    try:
        if not changes.limit(1).count():
            return
        meetings, buckets = store._touched(base, "meetings", changes, "meeting_id")
        fresh = changes.filter("kind = 'create'").select(F.col("meeting_id").alias("id"), "title", F.col("at").alias("started_at"))
        fresh = fresh.join(meetings.select("id"), "id", "left_anti").withColumns({"duration_ms": F.lit(0).cast("long"), "segment_count": F.lit(0).cast("long")})
        patch = changes.filter("kind <> 'create'").groupBy(F.col("meeting_id").alias("id")).agg(
            F.max(F.when(F.col("kind") == "final", F.col("at"))).alias("ended_at"), F.max_by("duration_ms", F.when(F.col("kind") == "final", F.col("seq"))).alias("duration_ms"),
            F.max_by("language", F.when(F.col("kind") == "final", F.col("seq"))).alias("language"), F.max_by("segment_count", "seq").alias("segment_count"),
        )
        heads = dml.patched(meetings.unionByName(fresh, allowMissingColumns=True), patch, "id")
        who = changes.filter("speaker_id IS NOT NULL AND slot IS NOT NULL").select("meeting_id", "slot", F.col("speaker_id").alias("id"), F.lit(None).cast("string").alias("label"), "seq")
        old, of = store._touched(base, "speakers", who, "meeting_id")
        known = [f.name for f in old.schema.fields]
        said = changes.filter("kind = 'chunk'").select("meeting_id", "seq", F.explode("segments").alias("s")).select("meeting_id", "seq", "s.*")
        said = store.new_segments(base, said, ["seq", "meeting_id"])
        store.data.changed(base, {"meetings": (heads, buckets), "speakers": (dml.upsert_speakers(old, who).select(*known), of)}, {"segments": said}, {mark: number})
    finally:
        changes.unpersist()


def record_stream(events: DataFrame, store, checkpoint: str, name: str = "recorder", forget_ms: int | None = None, **trigger):
    """Starts a query that keeps a store up to date with a stream of events.

    The store notes the number of the last micro-batch of the query ``name``, so one that is repeated after a failure is applied once.
    """
    write = lambda batch, number: apply_changes(store, batch, name, number)
    return change_stream(events, forget_ms).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
