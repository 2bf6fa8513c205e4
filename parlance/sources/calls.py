"""Calls on a store from outside, whose arguments are checked before anything is read or written.

An id must be there and be a UUID, whether in capitals or not; titles, notes and queries must be there, and the first two
must not be blank.  What fails is ``Invalid`` with the argument's name, and an unknown meeting, speaker or note is
``NotFound``.  Rows come back as DataFrames, so a long transcript needn't fit the driver.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions.text import UUID
from parlance.sources.store import Invalid, NotFound, Store

#: Hits of a search by default, and styles of an export.
HITS = 10
STYLES = {"txt": "text"}


def identifier(value, name: str) -> str:
    """A UUID in small letters."""
    if not isinstance(value, str):
        raise Invalid(f"{name} is missing")
    if not re.fullmatch(UUID.strip("^$"), value):
        raise Invalid(f"{name} isn't a UUID: {value}")
    return value.lower()


def words(value, name: str, blank: bool = False) -> str:
    if not isinstance(value, str):
        raise Invalid(f"{name} is missing")
    if not blank and not value.strip():
        raise Invalid(f"{name} is blank")
    return value


def whole(value, default: int) -> int:
    """A number that is whole and not negative; anything else counts as not given."""
    return value if isinstance(value, int) and not isinstance(value, bool) and value >= 0 else default


class Calls:
    def __init__(self, store: Store):
        self.store = store

    def _known(self, meeting_id) -> str:
        key = identifier(meeting_id, "meeting_id")
        if not self.store.header(key).limit(1).count():
            raise NotFound(f"meeting {key}")
        return key

    def get_meeting(self, meeting_id=None) -> DataFrame:
        return self.store.get(self._known(meeting_id))

    def search_meetings(self, query=None, limit=None) -> DataFrame:
        return self.store.search(words(query, "query", blank=True), whole(limit, HITS))

    def get_summary(self, meeting_id=None) -> DataFrame:
        """No row if there's none."""
        return self.store.summary(identifier(meeting_id, "meeting_id"))

    def list_notes(self, meeting_id=None) -> DataFrame:
        return self.store.notes(identifier(meeting_id, "meeting_id"))

    def get_speakers(self, meeting_id=None) -> DataFrame:
        """A speaker without a label is named by the slot, from 1."""
        rows = self.store.speakers(identifier(meeting_id, "meeting_id"))
        return rows.select("id", "slot", F.coalesce("label", F.concat(F.lit("Speaker "), F.col("slot") + 1)).alias("label"))

    def export_meeting(self, meeting_id=None, style=None) -> DataFrame:
        """As Markdown unless ``style`` is txt."""
        return self.store.export(self._known(meeting_id), STYLES.get(style, "markdown"))

    def rename_meeting(self, meeting_id=None, title=None) -> None:
        key, title = identifier(meeting_id, "meeting_id"), words(title, "title")
        if not self.store.rename(key, title):
            raise NotFound(f"meeting {key}")

    def delete_meeting(self, meeting_id=None) -> None:
        key = identifier(meeting_id, "meeting_id")
        if not self.store.delete(key):
            raise NotFound(f"meeting {key}")

    def rename_speaker(self, meeting_id=None, speaker_id=None, label=None) -> None:
        """Null takes the label away."""
        key, speaker = identifier(meeting_id, "meeting_id"), identifier(speaker_id, "speaker_id")
        if label is not None and not isinstance(label, str):
            raise Invalid("label must be text or null")
        if not self.store.rename_speaker(key, speaker, label):
            raise NotFound(f"speaker {speaker} of meeting {key}")

    def add_note(self, meeting_id=None, text=None, timestamp_ms=None) -> str:
        """The id of the note."""
        return self.store.add_note(identifier(meeting_id, "meeting_id"), words(text, "text"), whole(timestamp_ms, 0))

    def delete_note(self, note_id=None) -> None:
        key = identifier(note_id, "note_id")
        if not self.store.delete_note(key):
            raise NotFound(f"note {key}")
