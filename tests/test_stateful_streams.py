"""Streams with state by key give what batch gives for any cut into micro-batches, and their state goes."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.operators import cluster, sessions
from parlance.streaming import chunks, replies, voices


def streamed(spark, folder, batches, schema, f):
    """(rows, rows of state left) of f over a stream of these batches."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/{i:03d}")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    q = f(source).writeStream.format("parquet").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start(f"{folder}/out")
    q.awaitTermination()
    return spark.read.parquet(f"{folder}/out"), q.lastProgress["stateOperators"][0]["numRowsTotal"]


def cuts(rows, seq, n, again=True):
    """Rows in n batches by seq; each also repeats the end of the one before."""
    by = sorted(rows, key=lambda r: r[seq])
    size = -(-len(by) // n)
    return [by[max(0, i - 5 * again) : i + size] for i in range(0, len(by), size)]


def steps(levels, start, start_frames, end, end_frames):
    voiced, run, out = False, 0, []
    for x in levels:
        run = run + 1 if (x <= end if voiced else x >= start) else 0
        if run >= (end_frames if voiced else start_frames):
            voiced, run = not voiced, 0
        out.append(voiced)
    return out


def test_automaton_by_runs_is_the_one_by_steps():
    r = np.random.default_rng(3)
    for _ in range(300):
        levels = np.round(r.random(r.integers(0, 60)), 1)
        levels[r.random(len(levels)) < 0.05] = np.nan
        limits = (r.choice([0.3, 0.5]), int(r.integers(1, 5)), r.choice([0.2, 0.5, 0.7]), int(r.integers(1, 5)))
        want = steps(levels, *limits)
        voice, got, at = sessions.VoiceState(*limits), [], 0
        while at < len(levels):
            n = int(r.integers(1, 9))
            got += voice.over(levels[at : at + n])
            at += n
        assert got == want


PUSHES = "session_id string, seq long, samples array<float>, paused boolean"
LIMITS = (0.3, 2, 0.1, 3)


def pushes():
    r = random.Random(6)
    out = []
    for s in range(5):
        paused = False
        for i in range(60):
            paused = not paused if r.random() < 0.1 else paused
            loud = 0.8 if i // 9 % 2 else 0.05
            out.append((f"s{s}", i, [round(r.uniform(-loud, loud), 3) for _ in range(r.randint(0, 90))], paused))
    return [*out, ("none", 0, None, None), ("none", 1, [0.9] * 50, False)]


def by_samples(rows, frame):
    """Samples one by one."""
    out = {}
    for sid in {r[0] for r in rows}:
        buffer, voiced, run, was = [], False, 0, False
        start, start_frames, end, end_frames = LIMITS
        for _, seq, samples, paused in sorted((r for r in rows if r[0] == sid), key=lambda r: r[1]):
            if was and not paused:
                buffer, voiced, run = [], False, 0
            was = bool(paused)
            if paused:
                continue
            n, some = 0, False
            for x in samples or []:
                buffer.append(np.float32(x))
                if len(buffer) == frame:
                    level, buffer, n = float(np.sqrt(np.mean(np.square(np.array(buffer, np.float64))))), [], n + 1
                    run = run + 1 if (level <= end if voiced else level >= start) else 0
                    if run >= (end_frames if voiced else start_frames):
                        voiced, run = not voiced, 0
                    some |= voiced
            out[sid, seq] = (n, voiced, some or voiced)
    return out


@pytest.mark.parametrize("frame, parts", [(7, 2), (16, 7)])
def test_voice_stream_is_batch_and_plain_loop(spark, tmp_path, frame, parts):
    rows = pushes()
    want = by_samples(rows, frame)
    assert any(v for _, v, _ in want.values()) and any(s and not v for _, v, s in want.values())
    batch = voices.voiced_pushes(spark.createDataFrame(rows, PUSHES), frame, LIMITS)
    got = {(r.session_id, r.seq): (r.frames, r.state, r.voiced) for r in batch.collect()}
    assert got == want
    stream, _ = streamed(spark, tmp_path, cuts(rows, 1, parts), PUSHES, lambda df: voices.voice_stream(df, frame, LIMITS))
    assert sorted(map(tuple, stream.collect())) == sorted(map(tuple, batch.collect()))


def test_a_model_gives_the_levels(spark):
    df = spark.createDataFrame([("a", 0, [0.1, 0.9, 0.2, 0.1], False)], PUSHES)
    row = voices.voiced_pushes(df, 2, (0.5, 1, 0.25, 1), level=lambda frames: frames.max(1)).first()
    assert (row.frames, round(row.peak, 4), row.over_start, row.over_end, row.state, row.voiced) == (2, 0.9, 1, 1, False, True)


@pytest.mark.parametrize("parts", [2, 6])
def test_speaker_stream_is_batch(spark, tmp_path, parts):
    r = np.random.default_rng(5)
    centres = r.normal(size=(5, 8))
    vectors = (centres[r.integers(0, 5, 240)] + r.normal(scale=0.6, size=(240, 8))).astype(np.float32)
    rows = [(i % 3, i, v.tolist()) for i, v in enumerate(vectors)] + [(0, 500, []), (1, 501, None)]
    config = cluster.OnlineConfig(threshold=0.9, merge=0.8)
    schema = "session long, seq long, v array<float>"
    out, _ = streamed(spark, tmp_path, cuts(rows, 1, parts), schema, lambda df: cluster.speaker_stream(df, "session", "seq", "v", config))
    want, ends = [], []
    for s in range(3):
        c = cluster.OnlineClusters(config)
        mine = [(i, c.assign(v)) for k, i, v in rows if k == s and v]
        want += [(s, i, slot) for i, slot in mine]
        last = cluster.survivors(c.merged)
        ends += [(s, i, slot, last.get(slot, slot)) for i, slot in mine]
    assert any(x[2] != x[3] for x in ends)
    assert sorted(map(tuple, out.filter("into IS NULL").drop("into").collect())) == sorted(want)
    assert sorted(map(tuple, cluster.settled(out).collect())) == sorted(ends)
    online = cluster.online_speakers(spark.createDataFrame(rows, schema), "session", "seq", "v", config)
    assert sorted(map(tuple, online.filter("slot IS NOT NULL").collect())) == sorted(want)


def test_reply_state_goes_with_the_last_token(spark, tmp_path):
    rows = [(r, i, x, i == 4 and r != 3) for r in range(4) for i, x in enumerate(["<think>h", "m</think> a", f" b{r}", " STOP", " c"])]
    out, left = streamed(spark, tmp_path, cuts(rows, 1, 3, again=False), "reply_id long, seq long, token string, last boolean", lambda df: replies.shown_stream(df, ("STOP",)))
    assert left == 1  # reply 3 is open
    assert [r.delta for r in out.filter("reply_id = 1").orderBy("seq").collect()] == ["", "a", " b1", " "]


@pytest.mark.parametrize("parts", [1, 4])
def test_answer_stream_is_batch(spark, tmp_path, parts):
    asked = [(i, "m1", "broken" if i % 3 == 0 else None, ["1", "2"]) for i in range(6)]
    tokens = [(i, j, f"[seg:{(i + j) % 4}] w{j} ") for i in range(6) for j in range(i)]
    rows = []
    for i, model, error, ids in asked:
        body = [("started", model, ids), *(("token", t, None) for r, _, t in tokens if r == i), ("failed", error, None) if error else ("finished", None, None)]
        rows += [(i, n, *x) for n, x in enumerate(body)]
    schema = "reply_id long, seq long, kind string, body string, ids array<string>"
    out, left = streamed(spark, tmp_path, cuts(rows, 1, parts, again=False), schema, replies.answer_stream)
    batch = replies.answer_events(spark.createDataFrame(asked, "reply_id long, model string, error string, ids array<string>"), spark.createDataFrame(tokens, "reply_id long, seq long, delta string"))
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, batch.select(*out.columns).collect()), key=str)
    assert left == 0 and out.filter(F.size("citations") > 0).count() > 0


FRAMES = "session_id string, seq long, samples array<float>, ended boolean"


def frames_of(spark, folder):
    for i in range(6):
        rows = [(s, 2 * i + j, [float(i)] * n, s == "short" and i == 1 and j == 1) for s, n in (("a", 10), ("short", 3)) for j in range(2)]
        spark.createDataFrame(rows, FRAMES).coalesce(1).write.parquet(f"{folder}/in/{i}")
    return spark.readStream.schema(FRAMES).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")


def test_capture_stops_at_the_deadline_and_reports(spark, tmp_path):
    sink = lambda rows, number: rows.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={number}")
    report = chunks.capture(frames_of(spark, tmp_path), sink, 0.035, 1000, f"{tmp_path}/cp", sessions=2)
    out = spark.read.parquet(f"{tmp_path}/out")
    got = {r.session_id: (r.n, r.frames) for r in out.groupBy("session_id").agg(F.sum(F.size("samples")).alias("n"), F.count("*").alias("frames")).collect()}
    assert got == {"a": (40, 4), "short": (12, 4)}
    assert report == {"frames": 8, "total_samples": 52, "done": 2, "error": None, "audio_seconds": 0.052}


def test_a_failing_sink_stops_the_capture(spark, tmp_path):
    def sink(rows, number):
        if number == 1:
            raise OSError("disk full")
        rows.write.format("noop").mode("overwrite").save()

    report = chunks.capture(frames_of(spark, tmp_path), sink, 9, 1000, f"{tmp_path}/cp")
    assert "disk full" in report["error"] and report["frames"] == 4 and report["done"] == 0
