"""Recording sessions in batch form: recorder totals, energy gates, voice hysteresis, the recording state machine."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.operators.ordered import edges

#: Thresholds and lengths of runs of a neural detector's probabilities: (start, frames, end, frames).
NEURAL = (0.35, 1, 0.20, 16)
STATES = ("idle", "starting", "recording", "paused", "stopping", "persisted", "error", "fatal")
#: (state, action) -> state; all other pairs leave the state.  ``fatal`` is an error that can't be retried.
TRANSITIONS = {
    ("idle", "START_REQUESTED"): "starting",
    ("starting", "STREAMING_STARTED"): "recording",
    ("starting", "BACKEND_ERROR"): "error",
    ("starting", "STREAMING_FAILED"): "error",
    ("recording", "STOP_REQUESTED"): "stopping",
    ("recording", "STREAMING_PAUSED"): "paused",
    ("recording", "STREAMING_FAILED"): "error",
    ("recording", "STREAMING_STOPPED"): "persisted",
    ("paused", "STREAMING_RESUMED"): "recording",
    ("paused", "STOP_REQUESTED"): "stopping",
    ("paused", "STREAMING_FAILED"): "error",
    ("paused", "STREAMING_STOPPED"): "persisted",
    ("stopping", "STREAMING_STOPPED"): "persisted",
    ("stopping", "STREAMING_FAILED"): "fatal",
    ("stopping", "BACKEND_ERROR"): "fatal",
    ("persisted", "ACKNOWLEDGE"): "idle",
    ("persisted", "START_REQUESTED"): "starting",
    ("error", "ACKNOWLEDGE"): "idle",
    ("error", "START_REQUESTED"): "starting",
    ("fatal", "ACKNOWLEDGE"): "idle",
}


def final_state(actions: Column, start: str = "idle") -> Column:
    """The state after an ordered array of actions."""
    step = F.create_map(*(F.lit(x) for (s, a), t in TRANSITIONS.items() for x in (f"{s} {a}", t)))
    return F.aggregate(actions, F.lit(start), lambda s, a: F.coalesce(F.try_element_at(step, F.concat_ws(" ", s, a)), s))


def silence_gate(rms: Column, threshold: float, has_vad: bool = False) -> Column:
    """Whether a chunk is skipped as silent."""
    return F.lit(False) if has_vad or threshold <= 0 else rms < threshold


def recorder_totals(events: DataFrame) -> DataFrame:
    """Of each session: chunks, skipped chunks, and the fallback duration.

    The recorder takes the later of its clock and a chunk's end, and adds the length of a
    skipped chunk.  So the clock ends at the largest end of a chunk plus all that was
    skipped after it, which a window gives without a fold.  ``at_ms`` is a chunk's end.
    """
    skipped = F.when(F.col("type") == "skipped", F.col("duration_ms")).otherwise(0)
    after = Window.partitionBy("session_id").orderBy("seq").rowsBetween(1, Window.unboundedFollowing)
    df = events.withColumn("_skip", skipped).withColumn("_after", F.coalesce(F.sum("_skip").over(after), F.lit(0)))
    end = F.when(F.col("type") == "chunk", F.col("at_ms") + F.col("_after"))
    return df.groupBy("session_id").agg(
        F.count_if(F.col("type") == "chunk").alias("chunks"), F.count_if(F.col("type") == "skipped").alias("skipped"),
        F.greatest(F.coalesce(F.max(end), F.lit(0)), F.sum("_skip")).cast("long").alias("duration_ms"),
    )


def pause_edges(events: DataFrame) -> DataFrame:
    """Rows at which a session becomes paused or resumes, each edge once."""
    flagged = events.filter(F.col("type").isin("paused", "resumed")).withColumn("paused", F.col("type") == "paused")
    return edges(flagged, ["session_id"], ["seq"], "paused")


def hysteresis(frames: DataFrame, session: str, seq: str, level: str, start: float, start_frames: int, end: float, end_frames: int) -> DataFrame:
    """(session, seq, voiced): voice begins after so many frames at ``start`` or more in a row, and ends
    after so many at ``end`` or less.  An ordered fold: a session's rows come in order to one task, which holds a batch
    of them and the automaton's state."""

    def fold(batches):
        import pyarrow as pa

        at, voice = None, None
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            levels = batch.column(2).to_numpy(zero_copy_only=False).astype(float)
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            voiced = []
            for i, j in zip(cuts[:-1], cuts[1:]):
                if j > i and (voice is None or keys[i] != at):
                    at, voice = keys[i], VoiceState(start, start_frames, end, end_frames)
                voiced.append(voice.states(levels[i:j]) if j > i else np.zeros(0, bool))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(voiced))], ["session", "seq", "voiced"])

    rows = frames.select(F.col(session).cast("long"), F.col(seq).cast("long"), F.col(level).cast("double"))
    return rows.repartition(session).sortWithinPartitions(session, seq).mapInArrow(fold, "session long, seq long, voiced boolean")


class VoiceState:
    """The two-threshold automaton of a voice detector.  ``run`` counts the frames in a row that speak for a change."""

    def __init__(self, start: float, start_frames: int, end: float, end_frames: int, voiced: bool = False, run: int = 0):
        self.limits, self.voiced, self.run = (start, start_frames, end, end_frames), voiced, run

    def over(self, levels) -> list[bool]:
        return self.states(levels).tolist()

    def states(self, levels) -> np.ndarray:
        """The state after each of some frames.  Only changes of state are stepped through; where one can be is looked up in run lengths."""
        x = np.asarray(levels, float)
        n = len(x)
        out = np.empty(n, bool)
        if not n:
            return out
        start, start_frames, end, end_frames = self.limits
        need = {False: max(1, start_frames), True: max(1, end_frames)}
        runs = {}
        for voiced, hit in ((False, x >= start), (True, x <= end)):
            since = np.maximum.accumulate(np.where(hit, -1, np.arange(n)))
            runs[voiced] = np.arange(n) - since + np.where((since < 0) & (voiced == self.voiced), self.run, 0)
            runs[voiced][~hit] = 0
        ready = {v: np.flatnonzero(r >= need[v]) for v, r in runs.items()}
        at, fresh = 0, True
        while True:
            # A run that goes on from the frames before counts at the first frame; later ones begin anew after a change.
            first = at if fresh else at + need[self.voiced] - 1
            k = np.searchsorted(ready[self.voiced], first)
            if k == len(ready[self.voiced]):
                out[at:] = self.voiced
                last = int(runs[self.voiced][-1])
                self.run = last if fresh else min(last, n - at)
                return out
            j = int(ready[self.voiced][k])
            out[at:j] = self.voiced
            self.voiced = not self.voiced
            out[j] = self.voiced
            at, fresh, self.run = j + 1, False, 0
            if at == n:
                return out


def dominant_speaker(segments: DataFrame, chunk: list[str]) -> DataFrame:
    """The speaker of the longest single segment of each chunk; of ties the earlier."""
    best = F.max(F.struct((F.col("end_ms") - F.col("start_ms")).alias("length"), (-F.col("start_ms")).alias("neg"), F.col("speaker")))
    return segments.groupBy(*chunk).agg(best.alias("_b")).select(*chunk, F.col("_b.speaker").alias("speaker"))
