"""Streams give what batch gives: chunks, recordings, hidden thoughts; and the folds against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from parlance import queries
from parlance.operators import evaluate, sessions
from parlance.operators.cluster import STRICT, OnlineClusters, OnlineConfig, merges, refine, survivors
from parlance.sources.store import Store
from parlance.streaming import chunks, recorder, replies

FRAMES = "session_id string, seq long, samples array<float>, paused boolean, ended boolean"
SIZE, RATE = 10, 1000


def frames():
    r = random.Random(4)
    out = []
    for s in range(6):
        paused = False
        n = r.randint(3, 40)
        for i in range(n):
            paused = not paused if r.random() < 0.15 else paused
            out.append((f"s{s}", i, [round(r.random() * (0.01 if i // 8 % 2 else 1), 3) for _ in range(r.randint(0, 27))], paused, s % 3 != 0 and i == n - 1))
    out.append(("empty", 0, None, False, True))
    return out


def by_loop(rows, silence):
    """Samples one by one."""
    out = {}
    for sid in sorted({r[0] for r in rows}):
        ev, buf, was, k, ms = [], [], False, 0, 0

        def emit(x, length):
            nonlocal k, ms
            level = (sum(y * y for y in x) / len(x)) ** 0.5
            ev.append(("skipped" if level < silence else "chunk", k, ms, length, round(level, 5)))
            k, ms = k + 1, ms + length

        for _, _, samples, paused, ended in sorted(r for r in rows if r[0] == sid):
            if paused != was:
                ev.append(("paused" if paused else "resumed", None, None, None, None))
                was = paused
            for y in samples or []:
                if not paused:
                    buf.append(y)
                    if len(buf) == SIZE:
                        emit(buf, 10)
                        buf = []
            if paused:
                buf = []
            if ended:
                if buf:
                    emit(buf, len(buf))
                ev.append(("stopped", None, None, None, None))
        out[sid] = ev
    return out


def events_of(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.session_id, r.event)):
        assert r.event == len(out.setdefault(r.session_id, []))
        assert (r.samples is not None) == (r.type == "chunk")
        out[r.session_id].append((r.type, r.chunk_index, r.offset_ms, r.duration_ms, None if r.rms is None else round(r.rms, 5)))
    return out


def test_chunks_in_batch(spark):
    df = spark.createDataFrame(frames(), FRAMES)
    want = {k: v for k, v in by_loop(frames(), 0.02).items() if v}
    assert events_of(chunks.chunked(df, SIZE, RATE, silence=0.02).collect()) == want


def test_chunk_stream_is_batch(spark, tmp_path):
    rows = frames()
    for part in range(4):
        some = [r for r in rows if min(r[1] // 11, 3) == part]
        spark.createDataFrame(some, FRAMES).coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
    source = spark.readStream.schema(FRAMES).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = chunks.chunk_stream(source, SIZE, RATE, silence=0.02).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start(f"{tmp_path}/out")
    q.awaitTermination()
    got = events_of(spark.read.parquet(f"{tmp_path}/out").collect())
    want = events_of(chunks.chunked(spark.createDataFrame(rows, FRAMES), SIZE, RATE, silence=0.02).collect())
    assert got == want


def test_silent_sessions_fail_after_a_timeout(spark, tmp_path):
    import time

    spark.createDataFrame([("s", 0, [0.5] * 13, False, False)], FRAMES).coalesce(1).write.parquet(f"{tmp_path}/in/0")
    source = spark.readStream.schema(FRAMES).parquet(f"{tmp_path}/in/*")
    out = []
    q = chunks.chunk_stream(source, SIZE, RATE, timeout_ms=1000).writeStream.foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="1 second").start()
    until = time.time() + 60
    while time.time() < until and not any(r.type == "failed" for r in out):
        time.sleep(0.5)
    q.stop()
    assert [(r.event, r.type) for r in sorted(out, key=lambda r: r.event)] == [(0, "chunk"), (1, "failed")]


def test_capture_stops_at_the_deadline(spark):
    got = {r.session_id: r for r in chunks.captured(spark.createDataFrame(frames(), FRAMES), 0.05, RATE).collect()}
    for sid in {r[0] for r in frames() if r[2]}:
        want, n = [], 0
        for x in (r[2] for r in sorted(r for r in frames() if r[0] == sid)):
            if len(want) < 50:
                want, n = want + x, n + 1
        assert [round(v, 3) for v in got[sid].samples] == want and (got[sid].frames, got[sid].total_samples) == (n, len(want))


def test_failed_chunks_leave_the_others(spark):
    df = chunks.chunked(spark.createDataFrame(frames(), FRAMES), SIZE, RATE)

    def hear(x):
        if x[0] > 0.5:
            raise ValueError("loud")
        return [(-1, 3, "a", 0.1, "en"), (3, 5, "b", 0.7, "en")]

    rows = chunks.heard(df, hear).collect()
    loud = {(r.session_id, r.chunk_index) for r in df.filter("type = 'chunk' AND samples[0] > 0.5").collect()}
    assert {(r.session_id, r.chunk_index) for r in rows if r.error} == loud
    kept = [r for r in rows if not r.error]
    offsets = {(r.session_id, r.chunk_index): r.offset_ms for r in df.filter("type = 'chunk'").collect()}
    assert kept and all(r.text == "a" and r.start_ms == offsets[r.session_id, r.chunk_index] and r.end_ms == r.start_ms + 30 for r in kept)


EVENTS = "type string, session_id string, seq long, offset_ms long, duration_ms long, language string, speaker_id string, speaker_slot int, segments array<struct<id: string, start_ms: bigint, end_ms: bigint, text: string, speaker_id: string, confidence: float>>, total_segments long, total_audio_ms long, message string, at timestamp"


def recording():
    from datetime import datetime

    def e(kind, sid, seq, **more):
        cols = [c.split()[0] for c in EVENTS.replace("array<struct<", "array struct ").split(", ") if "id: " not in c]
        cols = ["type", "session_id", "seq", "offset_ms", "duration_ms", "language", "speaker_id", "speaker_slot", "segments", "total_segments", "total_audio_ms", "message", "at"]
        row = {"type": kind, "session_id": sid, "seq": seq, "at": datetime(2024, 1, 1, 0, 0, seq % 60)} | more
        return tuple(row.get(c) for c in cols)

    seg = lambda i, a, b: (i, a, b, f"text {i}", "p1", 0.5)
    return [
        e("started", "a", 0, message="A"), e("chunk", "a", 1, offset_ms=0, duration_ms=100, language="en", speaker_id="p1", speaker_slot=0, segments=[seg("1", 0, 50), seg("2", 50, 90)]),
        e("skipped", "a", 2, duration_ms=30), e("paused", "a", 3), e("chunk", "a", 4, offset_ms=100, duration_ms=100, language="es", speaker_id="p2", speaker_slot=0, segments=[seg("3", 100, 110)]),
        e("chunk", "a", 5, offset_ms=200, duration_ms=100, language="es", segments=[]), e("skipped", "a", 6, duration_ms=7), e("failed", "a", 7, message="broken"), e("chunk", "a", 8, segments=[seg("9", 0, 1)]),
        e("chunk", "ghost", 0, segments=[seg("5", 0, 1)]), e("started", "b", 0, message="B"), e("chunk", "b", 1, offset_ms=0, segments=[seg("6", 0, 10)], language="en", speaker_id="q", speaker_slot=1),
        e("stopped", "b", 2, total_segments=4, total_audio_ms=500), e("started", "c", 0, message="C"), e("chunk", "c", 1, offset_ms=0, segments=[seg("7", 0, 10), seg("6", 0, 10)]),
    ]


def tables(t):
    return {
        "meetings": sorted(map(tuple, t["meetings"].select("id", "title", F.col("ended_at").isNotNull(), "duration_ms", "language", "segment_count").collect())),
        "speakers": sorted(map(tuple, t["speakers"].select("meeting_id", "slot", "id").collect())),
        "segments": sorted(map(tuple, t["segments"].select("id", "meeting_id", "start_ms", "end_ms").collect())),
    }


def test_recorder(spark):
    df = spark.createDataFrame(recording() + recording()[:4], EVENTS)
    t = tables(recorder.recorded(df))
    # The clock of a: 90, + 30, max(120, 110), max(120, 0), + 7.
    assert t["meetings"] == [("a", "A", True, 127, "es", 3), ("b", "B", True, 500, "en", 4), ("c", "C", False, 0, None, 2)]
    assert t["speakers"] == [("a", 0, "p1"), ("b", 1, "q")]
    assert [s[0] for s in t["segments"]] == ["1", "2", "3", "6", "7"]
    closed = tables(recorder.recorded(df, closed=True))["meetings"]
    assert closed[2] == ("c", "C", True, 10, None, 2)


def test_record_stream_is_batch(spark, tmp_path):
    rows = recording()
    for part in range(3):
        spark.createDataFrame([r for r in rows if min(r[2] // 2, 2) == part], EVENTS).coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
    store = Store(spark, f"{tmp_path}/store")
    source = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    recorder.record_stream(source, store, f"{tmp_path}/cp").awaitTermination()
    got = tables({n: store.table(n) for n in ("meetings", "speakers", "segments")})
    assert got == tables(recorder.recorded(spark.createDataFrame(rows, EVENTS)))


def test_record_stream_keeps_what_users_change(spark, tmp_path):
    rows = recording()
    store = Store(spark, f"{tmp_path}/store")
    parts = [[r for r in rows if min(r[2] // 2, 2) == part] for part in range(3)]
    read = lambda: spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    for i, part in enumerate([parts[0], parts[1] + parts[0], parts[2] + parts[1]]):  # each batch repeats the one before
        spark.createDataFrame(part, EVENTS).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        recorder.record_stream(read(), store, f"{tmp_path}/cp").awaitTermination()
        if i == 0:
            store.rename_speaker("a", "p1", "Ana")
            store.rename("c", "My title")
    got = tables({n: store.table(n) for n in ("meetings", "speakers", "segments")})
    want = tables(recorder.recorded(spark.createDataFrame(rows, EVENTS)))
    want["meetings"] = [(m[0], "My title" if m[0] == "c" else m[1], *m[2:]) for m in want["meetings"]]
    assert got == want
    assert [r.label for r in store.speakers("a").collect()] == ["Ana"]


def test_a_repeated_batch_is_applied_once_and_touches_its_buckets(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    for i in range(4):
        store.create(f"old{i}", "x", None)
    row = lambda **x: tuple(x.get(c) for c in ("meeting_id", "seq", "kind", "title", "at", "speaker_id", "slot", "segments", "duration_ms", "language", "segment_count"))
    batch = spark.createDataFrame([row(meeting_id="new", seq=0, kind="create", title="T"), row(meeting_id="new", seq=1, kind="chunk", speaker_id="p", slot=0, segments=[("s", 0, 5, "hi", "p", 0.5)], segment_count=1)], recorder.CHANGES)
    before = store.base()
    recorder.apply_changes(store, batch, "q", 0)
    after = store.base()
    recorder.apply_changes(store, batch, "q", 0)
    assert store.base() == after and after.number == before.number + 1 and after.marks == {"q": 0}
    (mine,) = store.data.buckets_of(after, ["new"])
    assert {b for b, x in after.files["meetings"].items() if x != before.files["meetings"].get(b)} == {mine}
    assert set(after.files["segments"]) == set(after.files["speakers"]) == {mine}
    assert store.table("meetings").count() == 5 and store.get("new").first().segments[0].text == "hi"


def test_the_plan_of_recordings_shuffles_sessions_once(spark):
    df = spark.createDataFrame(recording(), EVENTS)
    plan = recorder.recorded(df)["meetings"]._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("tokens, stops, want", [
    (["a <think>x", "y</think>", " b"], (), "a  b"), (["<think>x</think>\nb", " c STOP d", "e"], ("STOP",), "\nb c "), (["<think>", "x", "</think>  b"], (), "b"),
    (["ab", "cS", "TOPd"], ("STOP", "z"), "abcS"), (["<think>never"], (), ""), (["plain"], (), "plain"),
])
def test_thoughts_and_stops(spark, tmp_path, tokens, stops, want):
    f = replies.ReplyFilter(stops)
    assert "".join(f.push(x) for x in tokens) == want


def test_replies_are_the_same_in_any_batches(spark):
    """A filter that takes tokens in batches, with its state between, shows what one that takes them singly shows."""
    r = random.Random(9)
    parts = ["<think>", "</think>", "STOP", "ST", "OP", "END", " ", "a", "\n", "<th", "ink>", "</"]
    for _ in range(3000):
        tokens = ["".join(r.choice(parts) for _ in range(r.randint(0, 3))) for _ in range(r.randint(0, 6))]
        stops = r.choice([(), ("STOP",), ("END", "STOP", ""), ("OP",)])
        one, some, got, at = replies.ReplyFilter(stops), replies.ReplyFilter(stops), [], 0
        want = [one.push(x) for x in tokens]
        while at < len(tokens):
            n = r.randint(1, 3)
            some = replies.ReplyFilter(stops, some.state())
            got += some.take(tokens[at : at + n])
            at += n
        assert got == want[: len(got)] and not any(want[len(got) :]) and one.stopped == some.stopped
    df = spark.createDataFrame([(1, 0, "a"), (1, 1, None), (1, 2, "b")], "reply_id long, seq long, token string")
    assert [x.delta for x in replies.shown(df, ("", "x")).orderBy("seq").collect()] == ["a", "", "b"]


def test_reply_stream_is_batch(spark, tmp_path):
    rows = [(r, i, x) for r in range(4) for i, x in enumerate(["<think>h", "m</think> a", f" b{r}", " STOP", " c"])]
    schema = "reply_id long, seq long, token string"
    for part in range(3):
        spark.createDataFrame([x for x in rows if min(x[1] // 2, 2) == part], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    replies.shown_stream(source, ("STOP",)).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()))
    assert got == sorted(map(tuple, replies.shown(spark.createDataFrame(rows, schema), ("STOP",)).collect()))
    assert [x[2] for x in got if x[0] == 1] == ["", "a", " b1", " "]


# --- folds against plain versions ---------------------------------------------------------------


def plain_alignment(ref, hyp):
    best = {}
    for i in range(len(ref) + 1):
        for j in range(len(hyp) + 1):
            ways = [(0, 0, 0, 0)] if i == j == 0 else []
            if i and j:
                c, s, d, n = best[i - 1, j - 1]
                ways.append((c, s, d, n) if ref[i - 1] == hyp[j - 1] else (c + 1, s + 1, d, n))
            if i:
                c, s, d, n = best[i - 1, j]
                ways.append((c + 1, s, d + 1, n))
            if j:
                c, s, d, n = best[i, j - 1]
                ways.append((c + 1, s, d, n + 1))
            best[i, j] = min(ways, key=lambda w: w[0])  # the first of equal costs
    return best[len(ref), len(hyp)][1:]


def test_alignment():
    r = random.Random(1)
    for _ in range(400):
        a, b = ([r.choice("abcd") for _ in range(r.randint(0, 9))] for _ in range(2))
        assert evaluate.align(a, b) == plain_alignment(a, b)
    words = [str(r.randint(0, 50)) for _ in range(3000)]
    assert evaluate.align(words, words[:1500] + words[1501:]) == (0, 1, 0)


def test_alignment_of_many_pairs_at_once(monkeypatch):
    r = random.Random(2)
    pairs = [tuple([r.choice("abcdefgh"[:k]) for _ in range(r.randint(0, 12))] for _ in range(2)) for k in (1, 2, 4, 8) for _ in range(150)]
    pairs += [([], []), ([], ["a"]), (["a", "b"], []), (["x"] * 300, ["x", "y"] * 140)]
    want = [evaluate.align(*p) for p in pairs]
    assert want[:300] == [plain_alignment(*p) for p in pairs[:300]]
    for cells, long in ((1, 1 << 15), (500, 1 << 15), (1 << 15, 1 << 15), (1 << 15, 6)):
        monkeypatch.setattr(evaluate, "CELLS", cells)
        monkeypatch.setattr(evaluate, "LONG", long)
        assert evaluate.align_all(pairs) == want
    assert evaluate.align_all([]) == []


def test_a_report_aligns_clips_at_most_three_times(spark):
    df = queries.QUERIES["ev1_wer_report"](spark, "/root/testdata/sf0.001")
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("ArrowEvalPython") <= 3


def test_report(spark):
    clips = [("a", 10, 10, 1, 0, 0, 5.0, 1.0), ("b", 100, 90, 0, 10, 0, 50.0, 5.0), ("c", 0, 2, 0, 0, 2, 0.0, 1.0), ("d", 10, 10, 0, 0, 0, 4.0, 2.0)]
    df = spark.createDataFrame(clips, "clip string, reference_words int, hypothesis_words int, substitutions int, deletions int, insertions int, audio_seconds double, elapsed_seconds double")
    r = evaluate.report(df).first()
    assert (r.reference_words, r.clips, r.audio_seconds, r.elapsed_seconds) == (120, 4, 59.0, 9.0)
    speeds = sorted([0.2, 0.1, 1e6, 0.5])
    assert r.wer == 13 / 120 and r.rtf_p50 == speeds[round(1.5 + 1e-9)] and r.rtf_p95 == speeds[3]
    assert evaluate.passes(evaluate.report(df)) and not evaluate.passes(evaluate.report(df), 0.1)
    with pytest.raises(ValueError):
        evaluate.passes(evaluate.report(df), 1.5)
    e = evaluate.report(df.limit(0)).first()
    assert (e.wer, e.clips, e.rtf_p50, e.audio_seconds) == (0.0, 0, 0.0, 0.0)


def test_percentiles_in_ranges(spark):
    """One key with most rows is cut into ranges; null keys, ties, NaN, infinities and empty tables have results."""
    r = random.Random(5)
    rows = [("hot", r.choice([r.gauss(0, 1), 0.25, float(r.randint(-3, 3))])) for _ in range(4000)]
    rows += [(k, float(v)) for k in ("few", None) for v in (3, 1, 2, 2)] + [("none", None), ("odd", float("nan")), ("odd", float("-inf")), ("odd", 1.0)]
    df = spark.createDataFrame(rows, "k string, x double").withColumn("_rank", F.lit(1))
    shares = {"low": 0.0, "mid": 0.5, "high": 0.95, "top": 1.0}

    def plain(values):
        v = sorted(values, key=lambda x: (x != x, x))
        return [v[int((len(v) - 1) * p + 0.5)] for p in shares.values()]

    want = {k: plain([x for key, x in rows if key == k and x is not None]) for k in ("hot", "few", None, "odd")}
    for ranges, few in ((8, 10), (128, 1), (4, 10_000)):
        out = evaluate.nearest_rank(df, ["k"], "x", shares, ranges, few)
        assert {x.k: list(map(str, x[1:])) for x in out.collect()} == {k: list(map(str, v)) for k, v in want.items()}
    one = evaluate.nearest_rank(df.filter("k = 'hot'"), [], "x", shares, 8, 10).collect()
    assert [list(x) for x in one] == [want["hot"]]
    assert evaluate.nearest_rank(df.limit(0), ["k"], "x", shares).count() == 0
    assert evaluate.nearest_rank(df.limit(0), [], "x", shares).first()[:] == (None,) * 4


def test_voice_state():
    levels = [0.0, 0.03, 0.03, 0.0, 0.03, 0.03, 0.03, 0.02, 0.005, 0.015, 0.005, 0.005, 0.03]
    assert sessions.VoiceState(0.02, 3, 0.01, 2).over(levels) == [False] * 6 + [True] * 5 + [False] * 2


def test_a_vector_keeps_the_slot_it_was_given():
    c = OnlineClusters(OnlineConfig(threshold=0.9, merge=0.7))
    assert [c.assign(v) for v in ([1.0, 0.0], [0.8, 0.6])] == [0, 1]
    assert c.merged == [(1, 0)] and c.slots == [0] and c.last == 0 and c.counts == [2]
    assert c.assign([0.9, 0.3]) == 0


def test_strict_speakers_arent_merged():
    c = OnlineClusters(STRICT)
    assert [c.assign(v) for v in ([1.0, 0.0], [0.71, 0.7], [0.7, 0.71], [1.0, 0.05])] == [0, 1, 1, 0]
    assert c.merged == []


def test_the_last_speaker_sticks():
    c = OnlineClusters(OnlineConfig(threshold=0.5, merge=1.0, most_speakers=2))
    assert [c.assign(v) for v in ([1.0, 0.0], [0.0, 1.0], [0.71, 0.70])] == [0, 1, 1]  # a little nearer to the first
    assert c.assign([-1.0, -1.0]) in (0, 1)  # no more speakers than are allowed


def test_refinement_goldens():
    x, y, z = [1.0, 0.0, 0.0], [0.95, 0.3, 0.0], [0.0, 0.0, 1.0]
    found = refine([0, 0, 1, 1, 1, 2, 2, 3], [x, x, y, y, y, z, z, x])
    assert found == [(0, 1)] and survivors(found) == {0: 1}  # the larger one survives; a single vector is no speaker
    assert refine([0, 0, 1, 1], [x, x, y, y]) == [(1, 0)]  # of equal counts the earlier one
    assert merges({}, {}, 0.75) == []
