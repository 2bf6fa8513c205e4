"""Voice detection over a stream of samples: frames of a fixed length whatever the cut, and the detector's automaton.

Rows (session_id, seq, samples, paused) in order of seq are pushed to a detector.  Samples that don't fill a frame are carried
to the next push, also over micro-batches.  While a session is paused its samples are dropped, and when it goes on the
detector begins anew: silent, and without what it carried.  A push is voiced if any frame in it was, or else by the
state at its end.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.operators.sessions import VoiceState

#: Of energy levels: threshold and frames to begin, threshold and frames to end.
ENERGY = (0.02, 3, 0.01, 10)
FRAME_MS = 30
PUSHES = "session_id string, seq long, frames long, peak double, mean double, over_start long, over_end long, state boolean, voiced boolean"
STATE = "carry binary, voiced boolean, run long, paused boolean, seq long"


class Detector:
    """The fold of one session's pushes.  ``level`` gives the level of each frame, a row of a matrix."""

    def __init__(self, frame: int, limits: tuple = ENERGY, level=None, state: tuple | None = None):
        carry, voiced, run, self.paused, self.seq = state or (b"", False, 0, False, None)
        self.frame, self.limits, self.level = max(1, frame), limits, level or energy
        self.carry = np.frombuffer(bytes(carry), "<f4")
        self.voice = VoiceState(*limits, voiced=voiced, run=run)

    def state(self) -> tuple:
        return self.carry.astype("<f4").tobytes(), self.voice.voiced, self.voice.run, self.paused, self.seq

    def push(self, seq: int, samples, paused: bool) -> tuple | None:
        """(frames, peak, mean, over_start, over_end, state, voiced); none for what is paused or repeated."""
        if self.seq is not None and seq <= self.seq:
            return None
        self.seq = seq
        if self.paused and not paused:
            self.carry, self.voice = self.carry[:0], VoiceState(*self.limits)
        self.paused = paused
        if paused:
            return None
        x = np.concatenate([self.carry, np.asarray(samples if samples is not None else [], np.float32)])
        n = len(x) // self.frame
        self.carry = x[n * self.frame :]
        levels = np.asarray(self.level(x[: n * self.frame].reshape(n, self.frame)), float)
        states = self.voice.states(levels)
        start, _, end, _ = self.limits
        peak, mean = (float(levels.max()), float(levels.mean())) if n else (0.0, 0.0)
        return n, peak, mean, int((levels >= start).sum()), int((levels >= end).sum()), self.voice.voiced, bool(states.any()) or self.voice.voiced


def energy(frames: np.ndarray) -> np.ndarray:
    """The root mean square of each frame."""
    return np.sqrt((frames.astype(np.float64) ** 2).mean(1)) if len(frames) else np.zeros(0)


def frame_length(rate: int, frame_ms: int = FRAME_MS) -> int:
    return max(1, rate * frame_ms // 1000)


def _pushed(detector: Detector, session, pdf: pd.DataFrame) -> list[tuple]:
    out = []
    for seq, samples, paused in pdf.sort_values("seq")[["seq", "samples", "paused"]].itertuples(index=False):
        row = detector.push(int(seq), samples, bool(paused))
        if row is not None:
            out.append((session, int(seq), *row))
    return out


_NAMES = [x.split()[0] for x in PUSHES.split(", ")]


def _rows(frames: DataFrame) -> DataFrame:
    return frames.select(F.col("session_id").cast("string"), F.col("seq").cast("long"), F.col("samples").cast("array<float>"), F.coalesce("paused", F.lit(False)).alias("paused"))


def voiced_pushes(frames: DataFrame, frame: int, limits: tuple = ENERGY, level=None) -> DataFrame:
    """(``PUSHES``) of all sessions: each session's rows come in order to one task, which holds a batch of them."""

    def fold(batches):
        at, detector = None, None
        for pdf in batches:
            out = []
            new = (pdf["session_id"] != pdf["session_id"].shift()).cumsum()
            for _, part in pdf.groupby(new):
                session = part["session_id"].iloc[0]
                if detector is None or session != at:
                    at, detector = session, Detector(frame, limits, level)
                out += _pushed(detector, session, part)
            yield pd.DataFrame(out, columns=_NAMES)

    return _rows(frames).repartition("session_id").sortWithinPartitions("session_id", "seq").mapInPandas(fold, PUSHES)


def voice_stream(frames: DataFrame, frame: int, limits: tuple = ENERGY, level=None, forget_ms: int | None = None) -> DataFrame:
    """The same over a stream.  State is less than a frame of samples and the automaton's; with ``forget_ms`` that of a session goes after so long without a push."""

    def fold(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        detector = Detector(frame, limits, level, state.get if state.exists else None)
        out = _pushed(detector, key[0], pd.concat(list(batches)))
        state.update(detector.state())
        if forget_ms:
            state.setTimeoutDuration(forget_ms)
        if out:
            yield pd.DataFrame(out, columns=_NAMES)

    return _rows(frames).groupBy("session_id").applyInPandasWithState(fold, PUSHES, STATE, "append", "ProcessingTimeTimeout" if forget_ms else "NoTimeout")
