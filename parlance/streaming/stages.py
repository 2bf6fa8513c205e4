"""A chain of stages over the chunks of sessions, with a rule for each stage's failure.

Chunks (session_id, chunk_index, offset_ms, duration_ms, samples and what else a stage reads) go through the stages in order.
A stage may change a chunk, skip it, or fail; what it does then is its rule: the chunk goes on without it, or is dropped.
Nothing that fails ends the session or the job, and each chunk tells the errors it has met.  Detectors and diarisers
have a state for each session, so a session's chunks come in order to one task, which holds one chunk at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEGMENT = "start_ms: bigint, end_ms: bigint, text: string, speaker_id: string"
HEARD = (
    f"session_id string, chunk_index long, offset_ms long, duration_ms long, type string, segments array<struct<{SEGMENT}>>, language string, "
    "speaker_id string, speaker_slot int, errors array<struct<stage: string, message: string>>"
)
GO_ON, DROP = "go on", "drop"


class Skip(Exception):
    """What a stage raises for a chunk that isn't worth the next ones."""


@dataclass(frozen=True)
class Stage:
    """``make()`` gives, for each session, a function from a chunk (a dict) to what it changes in it."""

    name: str
    make: Callable[[], Callable[[dict], dict]]
    on_error: str = GO_ON


def resampling(to_mono: Callable) -> Stage:
    """``to_mono(samples)``; a chunk on which it fails is dropped."""
    return Stage("resampler", lambda: lambda c: {"samples": to_mono(c["samples"])}, DROP)


def detecting(make: Callable) -> Stage:
    """``make()(samples)`` tells if there is a voice; without one the chunk is skipped, and a failing detector lets all through."""

    def stage():
        voiced = make()

        def step(c: dict) -> dict:
            if not voiced(c["samples"]):
                raise Skip
            return {}

        return step

    return Stage("detector", stage)


def diarising(make: Callable) -> Stage:
    """``make()(samples)`` gives (speaker_id, slot) or None; if it fails the chunk has no speaker."""

    def stage():
        assign = make()

        def step(c: dict) -> dict:
            found = assign(c["samples"])
            return {} if found is None else {"speaker_id": found[0], "speaker_slot": found[1]}

        return step

    return Stage("diariser", stage)


def transcribing(transcribe: Callable) -> Stage:
    """``transcribe(samples)`` gives (language, [(start_ms, end_ms, text)]); times become those of the session, and a chunk on which it fails is dropped."""

    def step(c: dict) -> dict:
        language, parts = transcribe(c["samples"])
        at = c["offset_ms"]
        return {"language": language, "segments": [{"start_ms": a + at, "end_ms": b + at, "text": t, "speaker_id": c.get("speaker_id")} for a, b, t in parts]}

    return Stage("transcriber", lambda: step, DROP)


def punctuating(punctuate: Callable) -> Stage:
    """``punctuate(text, language)`` for each segment; if it fails texts stay as they were heard."""
    return Stage("punctuator", lambda: lambda c: {"segments": [{**s, "text": punctuate(s["text"], c["language"])} for s in c["segments"]]})


def staged(chunks: DataFrame, stages: list[Stage]) -> DataFrame:
    """(``HEARD``): one row for each chunk, of type ``chunk``, ``skipped`` or ``dropped``."""
    names = [x.strip().split()[0] for x in HEARD.replace(SEGMENT, "").replace("stage: string, message: string", "").split(", ")]

    def through(steps: list, chunk: dict) -> dict:
        chunk |= {"type": "chunk", "errors": []}
        for stage, step in zip(stages, steps):
            try:
                chunk |= step(chunk)
            except Skip:
                return {**chunk, "type": "skipped", "segments": None}
            except Exception as e:  # a port may fail in any way, and that must not end the session
                chunk["errors"].append({"stage": stage.name, "message": str(e)})
                if stage.on_error == DROP:
                    return {**chunk, "type": "dropped", "segments": None}
        return chunk

    def run(batches):
        at, steps = None, []
        for pdf in batches:
            rows = []
            for chunk in pdf.to_dict("records"):
                if not steps or chunk["session_id"] != at:
                    at, steps = chunk["session_id"], [s.make() for s in stages]
                rows.append(through(steps, chunk))
            out = pd.DataFrame({n: pd.Series([r.get(n) for r in rows], dtype=object) for n in names})
            for n in ("chunk_index", "offset_ms", "duration_ms", "speaker_slot"):
                out[n] = out[n].astype("Int64")
            yield out

    rows = chunks.filter(F.col("samples").isNotNull()).withColumn("session_id", F.col("session_id").cast("string"))
    return rows.repartition("session_id").sortWithinPartitions("session_id", "chunk_index").mapInPandas(run, HEARD)
