"""Fixed-size chunks of sample streams: in batch by windows, and as a stateful stream with the same events.

Frames are rows (session_id, seq, samples, paused, ended) in order of seq.  A chunk is emitted whenever
``size`` samples are there.  While a session is paused its samples are dropped, those of an unfinished chunk
too, and its clock stands; each edge gives one event ``paused`` or ``resumed``.  What is left at the end is a last,
shorter chunk, and then comes ``stopped``.  A chunk whose level is below ``silence`` is ``skipped`` and has no
samples.  ``event`` numbers the events of a session from 0.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from parlance.functions.vectors import rms

EVENTS = "session_id string, event long, type string, chunk_index long, offset_ms long, duration_ms long, rms double, samples array<float>, total_audio_ms long"
STATE = "buffer binary, paused boolean, chunks long, total_ms long, events long"
CHUNK_MS = 5000


def _ms(samples: int, rate: int, channels: int) -> int:
    return samples // channels * 1000 // rate if channels and rate else 0


def chunked(frames: DataFrame, size: int, rate: int, channels: int = 1, silence: float = 0.0, chunk_ms: int | None = None) -> DataFrame:
    """All events of finished or open sessions, by windows over frames; a frame is cut where chunks begin.

    Sessions are spread over tasks, and no more than a chunk's pieces meet in one row.
    """
    ms = _ms(size, rate, channels) if chunk_ms is None else chunk_ms
    w = Window.partitionBy("session_id").orderBy("seq")
    df = frames.select(F.col("session_id").cast("string"), "seq", F.coalesce("samples", F.array().cast("array<float>")).cast("array<float>").alias("samples"), F.coalesce("paused", F.lit(False)).alias("paused"), F.coalesce("ended", F.lit(False)).alias("ended"))
    edge = F.col("paused") != F.lag("paused", 1, False).over(w)
    df = df.withColumn("edge", edge).withColumn("epoch", F.sum(F.col("edge").cast("long")).over(w)).withColumn("n", F.size("samples").cast("long"))
    run = Window.partitionBy("session_id", "epoch").orderBy("seq")
    live = df.filter("NOT paused").withColumn("at", F.coalesce(F.sum("n").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # Chunks that were full in the epochs before give a chunk its number and its place in time.
    epochs = live.groupBy("session_id", "epoch").agg(F.sum("n").alias("total"), F.max("ended").alias("closed"), F.max("seq").alias("last_seq"))
    epochs = epochs.withColumn("full", F.floor(F.col("total") / size))
    before = Window.partitionBy("session_id").orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    epochs = epochs.withColumn("done", F.coalesce(F.sum("full").over(before), F.lit(0)))
    pieces = live.filter("n > 0").withColumn("k", F.explode(F.sequence(F.floor(F.col("at") / size), F.floor((F.col("at") + F.col("n") - 1) / size))))
    lo = F.greatest(F.col("k") * size, F.col("at"))
    hi = F.least((F.col("k") + 1) * size, F.col("at") + F.col("n"))
    piece = F.slice("samples", (lo - F.col("at") + 1).cast("int"), (hi - lo).cast("int"))
    chunks = pieces.groupBy("session_id", "epoch", "k").agg(F.array_sort(F.collect_list(F.struct(lo.alias("at"), piece.alias("x")))).alias("parts"), F.max("seq").alias("seq"))
    chunks = chunks.withColumn("samples", F.flatten(F.transform("parts", lambda p: p["x"]))).join(epochs, ["session_id", "epoch"])
    whole = F.col("k") < F.col("full")
    index, duration = F.col("done") + F.col("k"), F.when(whole, ms).otherwise(F.floor(F.floor(F.size("samples") / channels) * 1000 / rate))
    level = rms(F.col("samples"))
    quiet = F.lit(silence > 0) & (level < silence)
    none = lambda kind: F.lit(None).cast(kind)
    out = chunks.filter(whole | F.col("closed")).select(
        "session_id", "seq", (1 + F.col("k")).alias("rank"), F.when(quiet, "skipped").otherwise("chunk").alias("type"), index.alias("chunk_index"), (index * ms).alias("offset_ms"),
        duration.cast("long").alias("duration_ms"), level.alias("rms"), F.when(~quiet, F.col("samples")).alias("samples"), none("long").alias("total_audio_ms"),
    )
    edges = df.filter("edge").select("session_id", "seq", F.lit(0).cast("long").alias("rank"), F.when(F.col("paused"), "paused").otherwise("resumed").alias("type"))
    left = F.max(F.when(F.col("closed"), F.floor(F.floor((F.col("total") - F.col("full") * size) / channels) * 1000 / rate)).otherwise(0))
    totals = epochs.groupBy("session_id").agg((F.sum("full") * ms + left).alias("total_audio_ms"))
    ends = df.groupBy("session_id").agg(F.max(F.when(F.col("ended"), F.col("seq"))).alias("seq")).filter("seq IS NOT NULL").join(totals, "session_id", "left")
    ends = ends.select("session_id", "seq", F.lit(1 << 62).alias("rank"), F.lit("stopped").alias("type"), F.coalesce("total_audio_ms", F.lit(0)).alias("total_audio_ms"))
    every = out.unionByName(edges, allowMissingColumns=True).unionByName(ends, allowMissingColumns=True)
    number = F.row_number().over(Window.partitionBy("session_id").orderBy("seq", "rank")) - 1
    names = [x.split()[0] for x in EVENTS.split(", ")]
    return every.withColumn("event", number.cast("long")).select(*names)


class Chunker:
    """The fold of one session's frames."""

    def __init__(self, size: int, rate: int, channels: int, silence: float, chunk_ms: int | None = None, state: tuple | None = None):
        self.size, self.rate, self.channels, self.silence = size, rate, channels, silence
        self.chunk_ms = _ms(size, rate, channels) if chunk_ms is None else chunk_ms
        buffer, self.paused, self.chunks, self.total_ms, self.events = state or (b"", False, 0, 0, 0)
        self.buffer = np.frombuffer(bytes(buffer), "<f4")
        self.out: list[tuple] = []

    def state(self) -> tuple:
        return self.buffer.astype("<f4").tobytes(), self.paused, self.chunks, self.total_ms, self.events

    def _emit(self, kind: str, *rest) -> None:
        self.out.append((self.events, kind, *(rest or (None,) * 6)))
        self.events += 1

    def _chunk(self, x: np.ndarray, ms: int) -> None:
        level = float(np.sqrt((x.astype(np.float64) ** 2).mean())) if len(x) else 0.0
        quiet = 0 < self.silence and level < self.silence
        self._emit("skipped" if quiet else "chunk", self.chunks, self.total_ms, ms, level, None if quiet else x.tolist(), None)
        self.chunks += 1
        self.total_ms += ms

    def frame(self, samples, paused: bool, ended: bool) -> None:
        if paused != self.paused:
            self._emit("paused" if paused else "resumed")
            self.paused = paused
        if paused:
            self.buffer = self.buffer[:0]
        elif samples is not None and len(samples):
            x = np.concatenate([self.buffer, np.asarray(samples, np.float32)])
            for i in range(len(x) // self.size):
                self._chunk(x[i * self.size : (i + 1) * self.size], self.chunk_ms)
            self.buffer = x[len(x) // self.size * self.size :]
        if ended:
            if len(self.buffer):
                self._chunk(self.buffer, _ms(len(self.buffer), self.rate, self.channels))
                self.buffer = self.buffer[:0]
            self._emit("stopped", None, None, None, None, None, self.total_ms)


def chunk_stream(frames: DataFrame, size: int, rate: int, channels: int = 1, silence: float = 0.0, chunk_ms: int | None = None, timeout_ms: int | None = None) -> DataFrame:
    """The same events of a stream of frames.  State is the samples of at most one chunk for each session.

    With a timeout, a session that gets no frame for so long without having ended gives ``failed``.
    """

    def fold(key, batches, state):
        names = [x.split()[0] for x in EVENTS.split(", ")]
        c = Chunker(size, rate, channels, silence, chunk_ms, state.get if state.exists else None)
        if state.hasTimedOut:
            c._emit("failed", None, None, None, None, None, c.total_ms)
            state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values("seq")
            ended = False
            for x, paused, end in zip(rows["samples"], rows["paused"], rows["ended"]):
                c.frame(x, bool(paused), bool(end))
                ended |= bool(end)
            if ended:
                state.remove()
            else:
                state.update(c.state())
                if timeout_ms:
                    state.setTimeoutDuration(timeout_ms)
        if c.out:
            pdf = pd.DataFrame(c.out, columns=names[1:])
            pdf.insert(0, "session_id", key[0])
            for n in ("chunk_index", "offset_ms", "duration_ms", "total_audio_ms"):
                pdf[n] = pdf[n].astype("Int64")
            yield pdf

    df = frames.select(F.col("session_id").cast("string"), "seq", F.col("samples").cast("array<float>"), F.coalesce("paused", F.lit(False)).alias("paused"), F.coalesce("ended", F.lit(False)).alias("ended"))
    return df.groupBy("session_id").applyInPandasWithState(fold, EVENTS, STATE, "append", "ProcessingTimeTimeout" if timeout_ms else "NoTimeout")


def captured(frames: DataFrame, seconds: float, rate: int, channels: int = 1) -> DataFrame:
    """(session_id, samples, frames, total_samples, audio_seconds): each session's samples up to a deadline, as one clip.

    The clip stops with the frame that reaches the deadline, or at the session's end; ``wav.write`` is its sink.
    """
    w = Window.partitionBy("session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    df = frames.select(F.col("session_id").cast("string"), "seq", F.col("samples").cast("array<float>").alias("samples")).filter("samples IS NOT NULL")
    df = df.withColumn("before", F.coalesce(F.sum(F.size("samples")).over(w), F.lit(0))).filter(F.col("before") < int(seconds * rate) * channels)
    parts = F.array_sort(F.collect_list(F.struct("before", "samples")))
    out = df.groupBy("session_id").agg(parts.alias("parts"), F.count("*").alias("frames"))
    out = out.select("session_id", F.flatten(F.transform("parts", lambda p: p["samples"])).alias("samples"), "frames")
    return out.withColumn("total_samples", F.size("samples").cast("long")).withColumn("audio_seconds", F.col("total_samples") / channels / rate)


CAPTURED = "session_id string, seq long, samples array<float>, total_samples long, done boolean"


def capture_stream(frames: DataFrame, seconds: float, rate: int, channels: int = 1) -> DataFrame:
    """(``CAPTURED``): each session's frames up to the one that reaches the deadline or ends it, which is ``done``; later ones are dropped.

    State is a number of samples for each session.  Frames come in order of seq, but for those within a micro-batch.
    """
    most = int(seconds * rate) * channels

    def fold(key, batches, state):
        total, at, done = state.get if state.exists else (0, None, False)
        rows = []
        for seq, samples, ended in pd.concat(list(batches)).sort_values("seq")[["seq", "samples", "ended"]].itertuples(index=False):
            if done or (at is not None and seq <= at):
                continue
            n = 0 if samples is None else len(samples)
            total, at = total + n, int(seq)
            done = total >= most or bool(ended)
            rows.append((key[0], at, samples if n else [], total, done))
        state.update((total, at, done))
        yield pd.DataFrame(rows, columns=["session_id", "seq", "samples", "total_samples", "done"])

    rows = frames.select(F.col("session_id").cast("string"), "seq", F.col("samples").cast("array<float>"), F.coalesce("ended", F.lit(False)).alias("ended"))
    return rows.groupBy("session_id").applyInPandasWithState(fold, CAPTURED, "total long, seq long, done boolean", "append", "NoTimeout")


def capture(frames: DataFrame, sink, seconds: float, rate: int, checkpoint: str, channels: int = 1, sessions: int = 1, poll: float = 0.2, **trigger) -> dict:
    """Captures a stream of frames into ``sink(rows, number)`` until so many sessions are done, and reports what it took.

    The report has frames, total_samples, audio_seconds (of one channel), done and error.  A sink that fails ends the capture, with its
    error in the report; so does the end of the stream.
    """
    report = {"frames": 0, "total_samples": 0, "done": 0, "error": None}

    def put(batch: DataFrame, number: int) -> None:
        seen = Observation(f"capture-{number}")
        sizes = F.sum(F.size("samples")).cast("long")
        sink(batch.observe(seen, F.count("*").alias("frames"), F.coalesce(sizes, F.lit(0)).alias("total_samples"), F.count_if("done").alias("done")), number)
        for name, x in seen.get.items():
            report[name] += x

    query = capture_stream(frames, seconds, rate, channels).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "0 seconds"})).start()
    try:
        while not query.awaitTermination(poll):
            if report["done"] >= sessions:
                query.stop()
    except StreamingQueryException as e:
        report["error"] = str(e)
    report["audio_seconds"] = report["total_samples"] / channels / rate
    return report


def heard(chunks: DataFrame, transcribe, most_silence: float = 0.6) -> DataFrame:
    """(session_id, chunk_index, start_ms, end_ms, text, language, error): what a model hears in each chunk.

    ``transcribe(samples)`` gives rows (start_cs, end_cs, text, no_speech, language).  A chunk on which it fails has one
    row with the error instead, and the others go on.  Segments that are likelier silence are dropped, and times become
    those of the session.
    """
    schema = "session_id string, chunk_index long, offset_ms long, start_cs long, end_cs long, text string, no_speech double, language string, error string"

    def run(batches):
        for pdf in batches:
            rows = []
            for sid, k, at, x in zip(pdf["session_id"], pdf["chunk_index"], pdf["offset_ms"], pdf["samples"]):
                try:
                    rows += [(sid, k, at, *seg, None) for seg in transcribe(np.asarray(x, np.float32))]
                except Exception as e:  # a model may fail in any way, and a failed chunk must not end the stream
                    rows.append((sid, k, at, None, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    df = chunks.filter("type = 'chunk'").select("session_id", "chunk_index", "offset_ms", "samples").mapInPandas(run, schema)
    at = lambda c: F.col("offset_ms") + from_centiseconds(F.col(c))
    df = df.filter(F.col("error").isNotNull() | (F.coalesce("no_speech", F.lit(0.0)) <= most_silence))
    return df.select("session_id", "chunk_index", at("start_cs").alias("start_ms"), at("end_cs").alias("end_ms"), "text", "language", "error")


def from_centiseconds(x):
    """Milliseconds; times before 0 are 0."""
    return F.greatest(x, F.lit(0)) * 10
