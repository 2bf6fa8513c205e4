"""A store of meetings in bucketed, versioned tables (``sources.buckets``), with the changes of ``operators.dml``.

All that belongs to a meeting lies in the bucket of its id, so a change of one meeting writes one bucket of each table it
touches.  A change works against one version, read once before anything else, and fails with ``Conflict``
if another writer's came in between; whoever calls may then try again.  Files of old versions stay until ``vacuum``.
A segment's id is unique in the whole store: new ones are looked up among the ids of all segments, one column.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance import schema
from parlance.functions.payload import with_payload
from parlance.functions.render import exports
from parlance.functions.text import normal_label
from parlance.operators import dml, ordered
from parlance.operators.search import search, with_snippets
from parlance.sources.buckets import BUCKETS, Buckets, Version

SCHEMAS = {**schema.TABLES, "templates": schema.TEMPLATES}
LIMIT = 20


class NotFound(LookupError):
    pass


class Invalid(ValueError):
    pass


KEYS = {"meetings": "id", "templates": "id"}


class Store:
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root = spark, root.rstrip("/")
        self.data = Buckets(spark, self.root, {t: (s, KEYS.get(t, "meeting_id")) for t, s in SCHEMAS.items()}, buckets)

    # --- versions --------------------------------------------------------------------------

    def version(self) -> int:
        return self.data.latest()

    def base(self) -> Version:
        """The version that a change starts from."""
        return self.data.version(self.version())

    def table(self, name: str, version: int | Version | None = None) -> DataFrame:
        """A table as of a version, by default the last."""
        v = version if isinstance(version, Version) else self.data.version(self.version() if version is None else version)
        return self.data.read(name, v)

    def compact(self) -> None:
        """One file for each bucket that has several."""
        self.data.compacted(self.base())

    def vacuum(self, keep: int = 1) -> None:
        """Deletes files that none of the last versions uses."""
        self.data.vacuum(keep)

    def _part(self, name: str, base: Version, key) -> tuple[DataFrame, list[int]]:
        """The bucket of a table that holds a key."""
        buckets = self.data.buckets_of(base, [key])
        return self.data.read(name, base, buckets), buckets

    def _touched(self, base: Version, name: str, rows: DataFrame, key: str) -> tuple[DataFrame, list[int]]:
        """The buckets of a table that rows with this key lie in; there are no more than buckets of a table."""
        found = rows.select(self.data.bucket(name, base, F.col(key)).alias("b")).distinct().collect()
        buckets = sorted(r.b for r in found)
        return self.data.read(name, base, buckets), buckets

    def _rows(self, name: str, rows: list[dict]) -> DataFrame:
        empty = self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.createDataFrame([tuple(r.get(c) for c in empty.columns) for r in rows], empty.schema)

    def _has(self, name: str, base: Version, key, where) -> bool:
        return bool(self._part(name, base, key)[0].filter(where).limit(1).count())

    def _need(self, meeting_id: str, base: Version) -> None:
        if not self._has("meetings", base, meeting_id, F.col("id") == meeting_id):
            raise NotFound(f"meeting {meeting_id}")

    # --- meetings --------------------------------------------------------------------------

    def create(self, meeting_id: str, title: str, started_at, sample_rate_hz: int = 16000, channels: int = 1) -> None:
        """A meeting that isn't finished; its counters are 0."""
        base = self.base()
        if self._has("meetings", base, meeting_id, F.col("id") == meeting_id):
            raise Invalid(f"meeting {meeting_id} exists")
        row = {"id": meeting_id, "title": title, "started_at": started_at, "duration_ms": 0, "segment_count": 0, "sample_rate_hz": sample_rate_hz, "channels": channels}
        self.data.changed(base, added={"meetings": self._rows("meetings", [row])})

    def upsert_speakers(self, changes: DataFrame) -> None:
        """``changes`` (meeting_id, slot, id, label, seq): first id of a slot stays, last label that isn't null counts."""
        base = self.base()
        old, buckets = self._touched(base, "speakers", changes, "meeting_id")
        self.data.changed(base, {"speakers": (dml.upsert_speakers(old, changes), buckets)})

    def append_segments(self, segments: DataFrame) -> None:
        """Adds segments whose ids are new, and counts those of their meetings anew.  An empty batch changes nothing."""
        if not segments.limit(1).count():
            return
        base = self.base()
        new = self.new_segments(base, segments, ["start_ms", "end_ms", "text"])
        old, _ = self._touched(base, "segments", segments, "meeting_id")
        meetings, buckets = self._touched(base, "meetings", segments, "meeting_id")
        every = old.select("meeting_id").unionByName(new.select("meeting_id")).join(segments.select("meeting_id").distinct(), "meeting_id", "left_semi")
        counts = every.groupBy(F.col("meeting_id").alias("id")).agg(F.count("*").alias("segment_count"))
        self.data.changed(base, {"meetings": (dml.patched(meetings, counts, "id"), buckets)}, {"segments": new})

    def new_segments(self, base: Version, segments: DataFrame, order: list) -> DataFrame:
        """The first of each id that no segment of the store has."""
        first = ordered.best_per_key(segments, ["id"], order)
        return first.join(self.data.read("segments", base).select("id"), "id", "left_anti")

    def finalize(self, meeting_id: str, ended_at=None, duration_ms: int | None = None, language: str | None = None, segment_count: int | None = None) -> None:
        """Sets what is given; the rest stays."""
        base = self.base()
        self._need(meeting_id, base)
        patch = self._rows("meetings", [{"id": meeting_id, "ended_at": ended_at, "duration_ms": duration_ms, "language": language, "segment_count": segment_count}])
        old, buckets = self._part("meetings", base, meeting_id)
        self.data.changed(base, {"meetings": (dml.patched(old, patch.select("id", "ended_at", "duration_ms", "language", "segment_count"), "id"), buckets)})

    def list(self, limit: int = 0) -> DataFrame:
        """Finished meetings, newest first; a limit of 0 is none."""
        df = self.table("meetings").filter("ended_at IS NOT NULL").orderBy(F.desc("started_at"), "id")
        return df.limit(limit) if limit else df

    def header(self, meeting_id: str, base: Version | None = None) -> DataFrame:
        return self._part("meetings", base or self.base(), meeting_id)[0].filter(F.col("id") == meeting_id)

    def _of(self, name: str, meeting_id: str, base: Version | None = None) -> DataFrame:
        return self._part(name, base or self.base(), meeting_id)[0].filter(F.col("meeting_id") == meeting_id)

    def get(self, meeting_id: str) -> DataFrame:
        """One row: the meeting with its segments by time, speakers by slot and notes by time; none if there's no such meeting."""
        base = self.base()
        out = self.header(meeting_id, base)
        for name, order, rest in (("segments", ["start_ms", "id"], ["end_ms", "text", "speaker_id", "confidence"]), ("speakers", ["slot", "id"], ["label"]), ("notes", ["timestamp_ms", "id"], ["text", "created_at"])):
            rows = self._of(name, meeting_id, base).groupBy(F.col("meeting_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct(*order, *rest))).alias(name))
            out = out.join(rows, "id", "left").withColumn(name, F.coalesce(name, F.array()))
        return out

    def export(self, meeting_id: str, style: str = "markdown", template: str | None = None) -> DataFrame:
        """(meeting_id, body): the meeting with its last summary, of any template or of one, as a document."""
        base = self.base()
        self._need(meeting_id, base)
        names = self._of("speakers", meeting_id, base)
        said = self._of("segments", meeting_id, base).withColumnRenamed("id", "seg_id")
        label = names.select(F.col("id").alias("speaker_id"), F.coalesce("label", F.concat(F.lit("Speaker "), F.col("slot") + 1)).alias("speaker"))
        digests = with_payload(self.summary(meeting_id, template, base), F.col("template"), F.col("payload"), "parsed").select("meeting_id", "template", F.col("parsed.payload").alias("payload"))
        head = self.header(meeting_id, base).select(F.col("id").alias("meeting_id"), "title", F.date_format("started_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("started_at"), "duration_ms", "language", "segment_count")
        notes = self._of("notes", meeting_id, base).withColumnRenamed("id", "note_id")
        return exports(head, said.join(label, "speaker_id", "left"), names, notes, digests, style)

    def rename(self, meeting_id: str, title: str) -> bool:
        """Whether there is such a meeting."""
        base = self.base()
        mine = F.col("id") == meeting_id
        found = self._has("meetings", base, meeting_id, mine)
        if found:
            old, buckets = self._part("meetings", base, meeting_id)
            self.data.changed(base, {"meetings": (dml.set_where(old, mine, "title", F.lit(title)), buckets)})
        return found

    def delete(self, meeting_id: str) -> bool:
        """Removes a meeting and all that belongs to it; whether it was there."""
        base = self.base()
        mine = F.col("id") == meeting_id
        found = self._has("meetings", base, meeting_id, mine)
        if found:
            gone = self._rows("segments", [{"meeting_id": meeting_id}]).select("meeting_id")
            parts = {n: self._part(n, base, meeting_id) for n in ("segments", "speakers", "summaries", "notes")}
            rest = dml.delete_cascade({n: df for n, (df, _) in parts.items()}, gone)
            old, buckets = self._part("meetings", base, meeting_id)
            self.data.changed(base, {"meetings": (old.filter(~mine), buckets), **{n: (df, parts[n][1]) for n, df in rest.items()}})
        return found

    def status(self) -> dict:
        return {"version": self.version(), "schema": schema.VERSION, "meetings": self.list().count()}

    # --- speakers --------------------------------------------------------------------------

    def speakers(self, meeting_id: str) -> DataFrame:
        return self._of("speakers", meeting_id).orderBy("slot")

    def rename_speaker(self, meeting_id: str, speaker_id: str, label: str | None) -> bool:
        """Blank labels are null; a label of over 80 characters is refused.  Whether that meeting has that speaker."""
        stored, fine = self.spark.range(1).select(*normal_label(F.lit(label).cast("string"))).first()
        if not fine:
            raise Invalid("the label is too long")
        key = (F.col("meeting_id") == meeting_id) & (F.col("id") == speaker_id)
        base = self.base()
        found = self._has("speakers", base, meeting_id, key)
        if found:
            old, buckets = self._part("speakers", base, meeting_id)
            self.data.changed(base, {"speakers": (dml.set_where(old, key, "label", F.lit(stored).cast("string")), buckets)})
        return found

    # --- search ----------------------------------------------------------------------------

    def search(self, query: str, limit: int = LIMIT) -> DataFrame:
        """Ranked hits, one a meeting, with the meeting's title and a snippet."""
        base = self.base()
        s = self.table("segments", base).withColumnRenamed("id", "seg_id")
        hits = with_snippets(search(s, query, limit), query)
        heads = self.table("meetings", base).select(F.col("id").alias("meeting_id"), "title", "started_at")
        return hits.join(heads, "meeting_id").select("meeting_id", "title", "started_at", "seg_id", "start_ms", "snippet", "rank").orderBy("rank", "seg_id")

    # --- summaries and notes ---------------------------------------------------------------

    def upsert_summary(self, meeting_id: str, summary: dict) -> None:
        """One summary for each template of a meeting: a new one replaces all of the old, its id too."""
        base = self.base()
        self._need(meeting_id, base)
        row = self._rows("summaries", [{**summary, "meeting_id": meeting_id}]).withColumn("seq", F.lit(0).cast("long"))
        old, buckets = self._part("summaries", base, meeting_id)
        self.data.changed(base, {"summaries": (dml.upsert_last(old, row, ["meeting_id", "template"]), buckets)})

    def summary(self, meeting_id: str, template: str | None = None, base: Version | None = None) -> DataFrame:
        """The last summary of a meeting, of any template or of one; no row if there's none."""
        s = self._of("summaries", meeting_id, base)
        s = s if template is None else s.filter(F.col("template") == template)
        return ordered.best_per_key(s, ["meeting_id"], [F.desc("created_at"), F.desc("id")])

    def add_note(self, meeting_id: str, text: str, timestamp_ms: int, created_at=None) -> str:
        base = self.base()
        self._need(meeting_id, base)
        note = {"id": str(uuid.uuid4()), "meeting_id": meeting_id, "text": text, "timestamp_ms": timestamp_ms}
        row = self._rows("notes", [note]).withColumn("created_at", F.coalesce(F.lit(created_at).cast("timestamp"), F.timestamp_seconds(F.lit(time.time()))))
        self.data.changed(base, added={"notes": row})
        return note["id"]

    def notes(self, meeting_id: str) -> DataFrame:
        return self._of("notes", meeting_id).orderBy("timestamp_ms", "id")

    def delete_note(self, note_id: str) -> bool:
        """Whether there was such a note.  Its meeting isn't known, so it's looked up by id in all buckets; one is written."""
        base = self.base()
        found = self.data.read("notes", base).filter(F.col("id") == note_id).select("meeting_id").limit(1).collect()
        if found:
            old, buckets = self._part("notes", base, found[0].meeting_id)
            self.data.changed(base, {"notes": (old.filter(F.col("id") != note_id), buckets)})
        return bool(found)

    # --- templates -------------------------------------------------------------------------

    def templates(self) -> DataFrame:
        return self.table("templates").orderBy("name", "id")

    def save_template(self, name: str, prompt: str, template_id: str | None = None) -> str:
        """A new template, or new words for one that's there."""
        row = self._rows("templates", [{"id": template_id or str(uuid.uuid4()), "name": name, "prompt": prompt}])
        row, wrong = dml.checked_template(row)
        if wrong:
            raise Invalid(wrong)
        base = self.base()
        if template_id is None:
            if self.table("templates", base).count() >= dml.MOST_TEMPLATES:
                raise Invalid(f"there are {dml.MOST_TEMPLATES} templates already")
            self.data.changed(base, added={"templates": row})
        else:
            if not self._has("templates", base, template_id, F.col("id") == template_id):
                raise NotFound(f"template {template_id}")
            old, buckets = self._part("templates", base, template_id)
            self.data.changed(base, {"templates": (dml.patched(old, row, "id"), buckets)})
        return row.first()["id"]

    def delete_template(self, template_id: str) -> None:
        base = self.base()
        if not self._has("templates", base, template_id, F.col("id") == template_id):
            raise NotFound(f"template {template_id}")
        old, buckets = self._part("templates", base, template_id)
        self.data.changed(base, {"templates": (old.filter(F.col("id") != template_id), buckets)})
