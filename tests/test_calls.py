import uuid
from datetime import datetime

import pytest

from parlance.sources.calls import Calls
from parlance.sources.store import Invalid, NotFound, Store

ID, OTHER, VOICE = (str(uuid.UUID(int=n)) for n in (0xABC, 2, 3))


@pytest.fixture(scope="module")
def calls(spark, tmp_path_factory):
    store = Store(spark, str(tmp_path_factory.mktemp("calls")), buckets=2)
    store.create(ID, "First", datetime(2024, 1, 1))
    said = [("s1", ID, 0, 900, "budget of May", VOICE, None)]
    store.append_segments(spark.createDataFrame(said, "id string, meeting_id string, start_ms long, end_ms long, text string, speaker_id string, confidence double"))
    store.upsert_speakers(spark.createDataFrame([(ID, 0, VOICE, None, 1)], "meeting_id string, slot int, id string, label string, seq long"))
    return Calls(store)


def test_wrong_arguments_change_nothing(calls):
    before = calls.store.version()
    for f in (calls.get_meeting, calls.get_summary, calls.list_notes, calls.get_speakers, calls.export_meeting, calls.rename_meeting, calls.delete_meeting, calls.rename_speaker, calls.add_note):
        for wrong in (None, "", "m1", 7, ID[:-1], ID + "0", f" {ID}", f"{ID}\n", ID.replace("-", "")):
            with pytest.raises(Invalid, match="meeting_id"):
                f(wrong)
    for wrong in (None, "n1", ["x"]):
        with pytest.raises(Invalid, match="note_id"):
            calls.delete_note(wrong)
        with pytest.raises(Invalid, match="speaker_id"):
            calls.rename_speaker(ID, wrong, "Ana")
    for wrong in (None, "", " \t\n", 5):
        with pytest.raises(Invalid, match="title"):
            calls.rename_meeting(ID, wrong)
        with pytest.raises(Invalid, match="text"):
            calls.add_note(ID, wrong)
    for wrong in (None, 5):
        with pytest.raises(Invalid, match="query"):
            calls.search_meetings(wrong)
    with pytest.raises(Invalid, match="label"):
        calls.rename_speaker(ID, VOICE, 5)
    assert calls.store.version() == before


def test_what_is_unknown(calls):
    before = calls.store.version()
    for f in (calls.get_meeting, calls.export_meeting, calls.delete_meeting):
        with pytest.raises(NotFound):
            f(OTHER)
    for f in (lambda: calls.rename_meeting(OTHER, "x"), lambda: calls.add_note(OTHER, "x"), lambda: calls.rename_speaker(ID, OTHER, "x"), lambda: calls.delete_note(OTHER)):
        with pytest.raises(NotFound):
            f()
    assert [calls.get_summary(OTHER).count(), calls.list_notes(OTHER).count(), calls.get_speakers(OTHER).count()] == [0, 0, 0]
    assert calls.store.version() == before


def test_calls(calls):
    assert calls.get_speakers(ID.upper()).first().label == "Speaker 1"
    calls.rename_speaker(ID, VOICE, "Ana")
    assert calls.get_speakers(ID).first().label == "Ana"
    calls.rename_speaker(ID, VOICE)
    assert calls.get_speakers(ID).first().label == "Speaker 1"
    calls.rename_meeting(ID, "Plan")
    assert calls.get_meeting(ID).first().title == "Plan"
    assert [x.meeting_id for x in calls.search_meetings("budget", -1).collect()] == [ID] and calls.search_meetings("").count() == 0
    note = calls.add_note(ID, "later", "soon")
    assert [(x.id, x.text, x.timestamp_ms) for x in calls.list_notes(ID).collect()] == [(note, "later", 0)]
    assert "budget of May" in calls.export_meeting(ID).first().body and "**" not in calls.export_meeting(ID, "txt").first().body
    calls.delete_note(note)
    assert calls.list_notes(ID).count() == 0
    calls.delete_meeting(ID)
    with pytest.raises(NotFound):
        calls.get_meeting(ID)
