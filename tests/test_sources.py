"""The store's contract, and files in and out."""

import json
import math
import struct
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.functions import payload, render
from parlance.functions import text as t
from parlance.operators import dml
from parlance.sources import files, paths, wav
from parlance.sources.buckets import Conflict
from parlance.sources.store import Invalid, NotFound, Store

SEGMENT = "id string, meeting_id string, start_ms long, end_ms long, text string, speaker_id string, confidence double"


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    s = Store(spark, str(tmp_path_factory.mktemp("store")))
    s.create("m1", "First", datetime(2024, 1, 1))
    s.create("m2", "Second", datetime(2024, 1, 2))
    return s


def segments(spark, *rows):
    return spark.createDataFrame([(i, m, a, a + 10, x, None, None) for i, m, a, x in rows], SEGMENT)


def test_meetings(spark, store):
    assert store.list().count() == 0 and store.version() == 2
    store.append_segments(segments(spark, ("s1", "m1", 0, "budget for <b>May</b>"), ("s2", "m1", 10, "the plan"), ("s1", "m1", 0, "budget for <b>May</b>")))
    store.append_segments(segments(spark, ("s2", "m1", 10, "the plan"), ("s3", "m2", 5, "another budget")))
    before = store.version()
    store.append_segments(segments(spark).limit(0))
    assert store.version() == before
    assert [(r.id, r.segment_count) for r in store.table("meetings").orderBy("id").collect()] == [("m1", 2), ("m2", 1)]
    store.finalize("m1", ended_at=datetime(2024, 1, 1, 1), duration_ms=900, language="en")
    store.finalize("m1", duration_ms=1000)
    r = store.header("m1").first()
    assert (r.ended_at, r.duration_ms, r.language, r.segment_count) == (datetime(2024, 1, 1, 1), 1000, "en", 2)
    with pytest.raises(NotFound):
        store.finalize("none")
    with pytest.raises(Invalid):
        store.create("m1", "again", None)
    assert [x.id for x in store.list().collect()] == ["m1"]
    assert store.rename("m1", "Renamed") and not store.rename("none", "x")
    whole = store.get("m1").first()
    assert whole.title == "Renamed" and [x.id for x in whole.segments] == ["s1", "s2"] and whole.speakers == [] == whole.notes
    assert store.get("none").count() == 0
    # Old versions stay readable until they are cleared.
    assert store.table("meetings", 2).filter("segment_count > 0").count() == 0


def test_search_names_the_meeting(store):
    hits = store.search("budget").collect()
    assert {(h.meeting_id, h.title) for h in hits} == {("m1", "Renamed"), ("m2", "Second")}
    assert any("<mark>budget</mark> for &lt;b&gt;May" in h.snippet for h in hits)


def test_speakers(spark, store):
    changes = spark.createDataFrame([("m1", 0, "p1", None, 1), ("m1", 0, "p9", "Ana", 2), ("m1", 1, "p2", None, 1)], "meeting_id string, slot int, id string, label string, seq long")
    store.upsert_speakers(changes)
    assert [(r.id, r.slot, r.label) for r in store.speakers("m1").collect()] == [("p1", 0, "Ana"), ("p2", 1, None)]
    assert store.rename_speaker("m1", "p2", "  Bo ") and not store.rename_speaker("m2", "p2", "Bo")
    assert store.rename_speaker("m1", "p1", "  ")
    assert [r.label for r in store.speakers("m1").collect()] == [None, "Bo"]
    with pytest.raises(Invalid):
        store.rename_speaker("m1", "p1", "x" * 81)


def test_summaries_and_notes(store):
    for i, (template, at) in enumerate((("general", 1), ("lecture", 3), ("general", 2))):
        store.upsert_summary("m1", {"id": f"x{i}", "template": template, "created_at": datetime(2024, 1, at), "payload": "{}"})
    assert store.table("summaries").count() == 2
    assert store.summary("m1").first().id == "x1" and store.summary("m1", "general").first().id == "x2" and store.summary("m2").count() == 0
    with pytest.raises(NotFound):
        store.upsert_summary("none", {"id": "y", "template": "general"})
    late, early = store.add_note("m1", "late", 900), store.add_note("m1", "early", 5)
    assert [r.id for r in store.notes("m1").collect()] == [early, late]
    assert store.delete_note(late) and not store.delete_note(late)


def test_export_of_a_meeting(store):
    store.upsert_summary("m1", {"id": "z", "template": "general", "created_at": datetime(2024, 2, 1), "payload": '{"summary": "All good."}'})
    body = store.export("m1").first().body
    assert body.startswith("# Renamed\n\n**Date:** 2024-01-01T00:00:00Z  \n**Duration:** 1s  \n**Language:** en  \n**Segments:** 2\n\n**Participants:** Speaker 1, Bo\n\n---\n\n## Summary\n\nAll good.\n\n---")
    assert "**[00:00]** budget for <b>May</b>\n\n" in body and body.endswith("## Notes\n\n- **[00:00]** early\n\n")
    assert "NOTES\n-----\n\n[00:00] early\n" in store.export("m1", "text").first().body
    with pytest.raises(NotFound):
        store.export("none")


def test_templates(store):
    one = store.save_template("  Name ", " Prompt ")
    assert [(r.name, r.prompt) for r in store.templates().collect()] == [("Name", "Prompt")]
    assert store.save_template("New", "P", one) == one and store.templates().first()["name"] == "New"
    for name, prompt in ((" ", "x"), ("x", ""), ("é" * 101, "x"), ("x", "y" * 10_001)):
        with pytest.raises(Invalid):
            store.save_template(name, prompt)
    with pytest.raises(NotFound):
        store.save_template("x", "y", "none")
    store.delete_template(one)
    with pytest.raises(NotFound):
        store.delete_template(one)


def test_the_number_of_templates_is_limited(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(dml, "MOST_TEMPLATES", 1)
    s = Store(spark, str(tmp_path))
    s.save_template("a", "b")
    with pytest.raises(Invalid):
        s.save_template("c", "d")


def test_delete_cascades_and_vacuum(spark, store):
    assert store.delete("m1") and not store.delete("m1")
    assert [store.table(x).filter("meeting_id = 'm1'").count() for x in ("segments", "speakers", "summaries", "notes")] == [0] * 4
    assert store.table("segments").count() == 1
    store.vacuum()
    assert store.table("segments").count() == 1 and len(paths.names(spark, f"{store.root}/segments")) == 1
    assert store.status() == {"version": store.version(), "schema": 5, "meetings": 0}


def test_a_second_writer_fails(spark, tmp_path):
    a = Store(spark, str(tmp_path))
    a.create("m", "x", None)
    b = Store(spark, str(tmp_path))
    b.version = lambda: 0  # has read before a's commit
    with pytest.raises(FileExistsError):
        b.create("n", "y", None)
    assert [r.id for r in a.table("meetings").collect()] == ["m"]


def test_interleaved_writers(spark, tmp_path, monkeypatch):
    a, b = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    a.create("m", "x", None)
    plain = dml.set_where

    def late(*x):
        monkeypatch.setattr(dml, "set_where", plain)
        a.add_note("m", "between", 1)  # after b has read, before it writes
        return plain(*x)

    monkeypatch.setattr(dml, "set_where", late)
    with pytest.raises(Conflict):
        b.rename("m", "lost?")
    assert a.header("m").first().title == "x" and a.notes("m").count() == 1
    assert b.rename("m", "again") and a.header("m").first().title == "again" and a.notes("m").count() == 1


def test_a_change_writes_one_bucket(spark, tmp_path):
    s = Store(spark, str(tmp_path), buckets=8)
    for i in range(6):
        s.create(f"m{i}", "x", None)
    s.append_segments(segments(spark, *((f"s{i}", f"m{i}", 0, "x") for i in range(6))))
    before = s.base()
    s.append_segments(segments(spark, ("t", "m3", 1, "y")))
    after = s.base()
    (mine,) = s.data.buckets_of(after, ["m3"])
    for name in ("segments", "meetings"):
        assert {b for b, x in after.files[name].items() if x != before.files[name].get(b)} == {mine}
    assert len(after.files["segments"][mine]) == 2 and s.header("m3").first().segment_count == 2
    s.compact()
    assert all(len(x) == 1 for of in s.base().files.values() for x in of.values())
    assert sorted(r.id for r in s.table("segments").collect()) == sorted([*(f"s{i}" for i in range(6)), "t"])
    assert sorted(r.id for r in s.table("segments", before.number).collect()) == sorted(f"s{i}" for i in range(6))


# --- files --------------------------------------------------------------------------------------


def test_template_files(spark, tmp_path):
    path = f"{tmp_path}/templates.json"
    assert files.read_templates(spark, path).count() == 0
    rows = spark.createDataFrame([("1", "é", "p\n"), ("2", "b", "q")], "id string, name string, prompt string")
    files.write_templates(rows, path)
    files.write_templates(files.read_templates(spark, path), path)
    assert sorted(map(tuple, files.read_templates(spark, path).collect())) == [("1", "é", "p\n"), ("2", "b", "q")]
    paths.create(spark, path, "no json", replace=True)
    assert files.read_templates(spark, path).count() == 0


def test_exports_to_files(spark, tmp_path):
    home = str(tmp_path)
    for bad in ("a.md", f"{home}/../a.md", "/elsewhere/a.md"):
        with pytest.raises(ValueError):
            files.checked_target(bad, home)
    body = spark.createDataFrame([("m1", "# A\n\nb")], "meeting_id string, body string")
    files.export(body, f"{home}/a.md", home)
    assert (tmp_path / "a.md").read_text() == "# A\n\nb"
    files.export_all(body, f"{home}/all")
    assert (tmp_path / "all/m1.md").read_text() == "# A\n\nb"
    files.export_all(spark.createDataFrame([("../out", "x")], "meeting_id string, body string"), f"{home}/all")
    assert (tmp_path / "all/..%2Fout.md").read_text() == "x" and not (tmp_path / "out.md").exists()
    files.write_report({"wer": 0.1}, spark, f"{home}/r.json")
    assert json.loads((tmp_path / "r.json").read_text()) == {"wer": 0.1}
    assert json.loads(files.json_lines(spark.createDataFrame([(1, None)], "a int, b string")).first()["value"]) == {"a": 1, "b": None}


def test_fixture_pairs(spark, tmp_path):
    for name in ("transcripts/b.txt", "transcripts/a.txt", "transcripts/only.txt", "audio/a.wav", "audio/b.wav", "audio/lone.wav", "audio/c.mp3"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    assert [r.stem for r in files.fixture_pairs(spark, str(tmp_path)).collect()] == ["a", "b"]
    assert list(map(tuple, files.unpaired(spark, str(tmp_path)).collect())) == [("lone", "transcript"), ("only", "audio")]


def test_wav_round_trip(spark, tmp_path):
    x = [0.0, 0.5, -0.5, 1.5, -1.5, 0.99999]
    df = spark.createDataFrame([("a", 8000, 2, x), ("b", 16000, 1, [])], "name string, sample_rate int, channels int, samples array<float>")
    wav.write(df, str(tmp_path / "out"))
    (tmp_path / "out/bad.wav").write_bytes(b"RIFFxx")
    rows = {r.path.rsplit("/")[-1]: r for r in wav.read(spark, str(tmp_path / "out")).collect()}
    want = [math.trunc(float(np.float32(max(-1, min(1, v))) * np.float32(32767))) / 32768 for v in np.array(x, np.float32)]
    assert (rows["a.wav"].sample_rate, rows["a.wav"].channels) == (8000, 2) and np.allclose(rows["a.wav"].samples, want)
    assert rows["b.wav"].samples == [] and rows["bad.wav"].error and rows["bad.wav"].samples is None


@pytest.mark.parametrize("bits, kind", [(8, 1), (16, 1), (24, 1), (32, 1), (32, 3)])
def test_sample_formats(bits, kind):
    x = np.array([0.0, 0.25, -0.5, -1.0], np.float64)
    if kind == 3:
        data = x.astype("<f4").tobytes()
    elif bits == 8:
        data = (x * 128 + 128).astype(np.uint8).tobytes()
    else:
        data = b"".join(int(v * (1 << (bits - 1))).to_bytes(4, "little", signed=True)[: bits // 8] for v in x)
    form = struct.pack("<HHIIHH", kind, 1, 8000, 8000 * bits // 8, bits // 8, bits)
    body = b"RIFF\0\0\0\0WAVE" + b"LIST" + struct.pack("<I", 3) + b"abc\0" + b"fmt " + struct.pack("<I", 16) + form + b"data" + struct.pack("<I", len(data)) + data
    rate, channels, got = wav.decode(body)
    assert (rate, channels, got.tolist()) == (8000, 1, x.tolist())


@pytest.mark.parametrize("channels, seconds", [(1, 60.0), (2, 7.3)])
def test_long_recordings_are_read_in_ranges(spark, tmp_path, channels, seconds):
    x = np.random.default_rng(1).uniform(-1, 1, int(seconds * 8000) * channels).astype(np.float32)
    (tmp_path / "long.wav").write_bytes(wav.encode(x, 8000, channels))
    (tmp_path / "bad.wav").write_bytes(b"RIFFxxxxJUNK")
    (tmp_path / "none.wav").write_bytes(wav.encode(x[:0], 8000, channels))
    rows = wav.read_frames(spark, str(tmp_path), frame=800, range_bytes=50_000)
    ranges = rows.filter("path LIKE '%long.wav'").withColumn("task", F.spark_partition_id())
    assert ranges.select("task").distinct().count() > 1
    got = ranges.orderBy("seq").collect()
    assert [r.seq for r in got] == list(range(len(got))) and all(len(r.samples) == 800 * channels for r in got[:-1])
    want = wav.decode((tmp_path / "long.wav").read_bytes())
    assert (got[0].sample_rate, got[0].channels) == want[:2]
    assert np.array_equal(np.concatenate([r.samples for r in got]).astype(np.float32), want[2])
    (bad,) = rows.filter("error IS NOT NULL").collect()
    assert bad.path.endswith("bad.wav") and bad.error == "not a WAV file" and rows.filter("path LIKE '%none.wav'").count() == 0


@pytest.mark.parametrize("rate", [8000, 16000, 44100, 48000])
def test_resampling_keeps_a_tone(spark, rate):
    n = rate // 2
    x = np.sin(2 * np.pi * 440 * np.arange(n) / rate)
    y = np.array(spark.createDataFrame([(x.tolist(), rate)], "x array<float>, r int").select(wav.resample(F.col("x"), F.col("r"))).first()[0])
    assert len(y) == round(n * 16000 / rate)
    want = np.sin(2 * np.pi * 440 * np.arange(len(y)) / 16000)
    assert np.abs(y[400:-400] - want[400:-400]).max() < 0.02


# --- answers and documents ----------------------------------------------------------------------


@pytest.mark.parametrize("raw, want", [
    ('Here:\n\n```json\n{\n  "a": 1\n}\n```\nbye', '{\n  "a": 1\n}'), ('{ "a": "hello } world", "b": 1 }', '{ "a": "hello } world", "b": 1 }'), ("nothing", None), ("{ unbalanced", None),
    ('{"a": "q\\"}", "b": {}} {}', '{"a": "q\\"}", "b": {}}'), ('\\{"a": {"b": "\\\\"}} }', '{"a": {"b": "\\\\"}}'), ('{"open } ', None), ("}{}", "{}"), ("", None), (None, None), ('{\\"}"}', '{\\"}"}'),
])
def test_first_object(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "x string").select(payload.first_object(F.col("x"))).first()[0] == want


def test_first_object_of_a_long_text(spark):
    raw = '{"a": "' + "x\\n" * 200_000 + '"} tail'
    assert spark.createDataFrame([(raw,)], "x string").select(payload.first_object(F.col("x"))).first()[0] == raw[:-5]


def test_typed_payloads(spark):
    rows = [
        ("general", '{"summary": "s", "keyPoints": ["a", 1, null, {"b": 2}, true], "actionItems": [{"task": "t", "owner": 5}, {"owner": "o"}, "x", null], "decisions": "no list"}'),
        ("interview", '{"summary": "s", "quotes": [{"speaker": "a", "quote": "b"}, {"speaker": "a"}]}'), ("salesCall", '{"summary": "s", "customerContext": 4, "dealStageIndicator": "late"}'),
        ("lecture", '{"summary": 4}'), ("lecture", '{"summary": "s", }'), ("other", '{"summary": "s"}'), ("general", "none"), ("general", None),
    ]
    got = [r.p for r in payload.with_payload(spark.createDataFrame(rows, "t string, x string"), F.col("t"), F.col("x"), "p").collect()]
    assert [g.error for g in got] == [None] * 3 + ["missing required field `summary`", "invalid JSON", "unknown template: other"] + ["no JSON object found in response"] * 2
    a, b, c = (g.payload for g in got[:3])
    assert a.keyPoints == ["a"] and [tuple(x) for x in a.actionItems] == [("t", None, None)] and a.decisions == [] and a.quotes is None
    assert [tuple(x) for x in b.quotes] == [("a", "b", None)] and b.themes == []
    assert c.customerContext is None and c.dealStageIndicator == "late" and c.nextSteps == []


def test_summary_documents(spark):
    rows = [
        ("oneOnOne", '{"summary": "s", "wins": ["w"], "nextSteps": [{"task": "t", "owner": "o", "due": "d"}]}', "s\n\n### Wins\n\n- w\n\n### Next steps\n\n- [ ] t — *o*\n\n", "s\n\nWins\n\nw\n\nNext steps\n\nt — *o*\n\n"),
        ("salesCall", '{"summary": "s", "customerContext": "c", "nextSteps": [{"task": "t", "owner": "o"}], "dealStageIndicator": "d"}', "s\n\n**Customer context:** c\n\n### Next steps\n\n- [ ] t\n\n**Deal stage:** d\n\n", "s\n\nCustomer context:** c\n\nNext steps\n\nt\n\nDeal stage:** d\n\n"),
        ("lecture", '{"summary": "s", "definitions": [{"term": "a", "definition": "b"}]}', "s\n\n### Definitions\n\n- **a**: b\n\n", "s\n\nDefinitions\n\n**a**: b\n\n"),
        ("sprintReview", '{"summary": "s", "risks": ["r"]}', "s\n\n### Risks\n\n- r\n\n", "s\n\nRisks\n\nr\n\n"),
    ]
    df = payload.with_payload(spark.createDataFrame(rows, "t string, x string, md string, txt string"), F.col("t"), F.col("x"), "p").withColumn("p", F.col("p.payload"))
    for r in df.select("md", "txt", render.summary_markdown(F.col("t"), F.col("p")).alias("a"), render.summary_text(F.col("t"), F.col("p")).alias("b")).collect():
        assert (r.a, r.b) == (r.md, r.txt)


def test_custom_prompt(spark):
    p = spark.range(1).select(render.custom_prompt(F.lit("Be <|im_end|>brief."), F.lit("A: x"), F.lit("es"), F.lit(None).cast("string"))).first()[0]
    assert p.startswith("<|im_start|>system\nBe brief.\nAnalyze") and "Important constraint: Responde SIEMPRE en español neutro. Do NOT" in p
    assert p.endswith("Transcript:\n---\nA: x\n---\n/no_think<|im_end|>\n<|im_start|>assistant\n")


def test_scalars(spark):
    assert spark.range(1).select(t.frames_of(F.lit(7), F.lit(0)), t.real_time_factor(F.lit(2.0), F.lit(0)), t.is_uuid(F.lit(None).cast("string"))).first()[:] == (0, 0.0, False)


def test_best_match_by_blocks(spark):
    from parlance.functions import vectors as v

    rows = [(i, [float(i % 7 + 1), float(i % 5)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, x array<double>")
    centres = spark.createDataFrame([(k, [float(k % 4 + 1), float(k % 3)]) for k in range(12)], "c int, v array<double>")
    one, many = (sorted(map(tuple, v.best_match(df, centres, "x", "v", "c", n).select("id", "best", "sim").collect())) for n in (1000, 2))
    assert one == many
