"""Chains of stages with faults in each, and the control flow of summaries."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.functions import render
from parlance.operators import summaries
from parlance.streaming import stages

CHUNK = "session_id string, chunk_index long, offset_ms long, duration_ms long, samples array<float>"


def chunks(spark):
    rows = [(f"s{s}", i, i * 100, 100, [float(s), float(i)]) for s in range(4) for i in range(6)] + [("s0", 99, 0, 0, None)]
    return spark.createDataFrame(rows, CHUNK).repartition(5)


def chain(fault=None):
    def failing(name, f):
        def g(*x):
            if fault == name:
                raise ValueError(f"{name} broke")
            return f(*x)

        return g

    def counting():
        seen = []

        def assign(x):  # by session, in order of chunks
            seen.append(int(x[1]))
            return None if x[1] == 2 else (f"p{len(seen) % 2}", len(seen) % 2)

        return failing("diariser", assign)

    return [
        stages.resampling(failing("resampler", lambda x: np.asarray(x))), stages.detecting(lambda: failing("detector", lambda x: x[1] != 4)), stages.diarising(counting),
        stages.transcribing(failing("transcriber", lambda x: ("en", [(0, 50, f"said {int(x[1])}")]))), stages.punctuating(failing("punctuator", lambda t, lang: t.capitalize() + ".")),
    ]


@pytest.mark.parametrize("fault", [None, "resampler", "detector", "diariser", "transcriber", "punctuator"])
def test_each_stage_fails_by_its_rule(spark, fault):
    rows = {(r.session_id, r.chunk_index): r for r in stages.staged(chunks(spark), chain(fault)).collect()}
    assert len(rows) == 24
    dropped = fault in ("resampler", "transcriber")
    for (_, i), r in rows.items():
        skipped = i == 4 and fault not in ("detector", "resampler")
        assert r.type == ("skipped" if skipped else "dropped" if dropped else "chunk")
        assert [e.stage for e in r.errors] == ([fault] if fault and (not skipped or fault == "detector") else [])
        if r.type != "chunk":
            assert r.segments is None
            continue
        (segment,) = r.segments
        assert (segment.start_ms, segment.end_ms) == (i * 100, i * 100 + 50) and r.language == "en"
        assert segment.text == (f"said {i}" if fault == "punctuator" else f"Said {i}.")
        n = i + 1 if fault == "detector" or i < 4 else i  # the skipped chunk isn't diarised
        want = None if fault == "diariser" or i == 2 else (f"p{n % 2}", n % 2)
        assert (None if r.speaker_id is None else (r.speaker_id, r.speaker_slot)) == want and segment.speaker_id == r.speaker_id


ASKED = "meeting_id string, template string, transcript string, language string, notes string, prompt string"


def test_summaries_are_asked_again_only_where_the_first_answer_fails(spark, tmp_path):
    log = str(tmp_path / "calls")

    def generate(prompt):
        which = prompt.split("case:")[1].split(" ")[0]
        again = "could not be parsed" in prompt
        with open(log, "a") as f:
            f.write(f"{which} {int(again)}\n")
        if which == "broken" or (which == "late" and again):
            raise RuntimeError("no model")
        fine = '{"summary": "ok", "keyPoints": ["a"]}'
        return {"good": fine, "second": fine if again else "prose", "never": f"prose {int(again)}", "late": "prose", "own": "  my text\n"}[which]

    names = ["good", "second", "never", "late", "broken"]
    rows = [(n, "general", f"case:{n} said", "en", None, None) for n in names]
    rows += [("own", "custom", "case:own said", None, "n", "Do it"), ("what", "nope", "case:good said", "en", None, None), ("empty", "general", " \n", "en", None, None)]
    df = spark.createDataFrame(rows, ASKED)
    got = {r.meeting_id: r for r in summaries.summarised(df, generate).collect()}
    assert {k: (r.template, r.calls, r.error) for k, r in got.items()} == {
        "good": ("general", 1, None), "second": ("general", 2, None), "never": ("freeText", 2, None), "late": (None, 2, "no model"), "broken": (None, 1, "no model"),
        "own": ("custom", 1, None), "what": (None, 0, "invalid template: nope"), "empty": (None, 0, "empty transcript"),
    }
    assert sorted(open(log).read().split("\n")[:-1]) == sorted(["good 0", "second 0", "second 1", "never 0", "never 1", "late 0", "late 1", "broken 0", "own 0"])
    assert got["second"].payload.keyPoints == ["a"] and got["never"].payload.text == "prose 1" and got["own"].payload.text == "my text"
    os.remove(log)
    shown = {r.meeting_id: r for r in summaries.summarised(df, generate, retry=False).collect()}
    assert (shown["second"].template, shown["second"].raw, shown["second"].calls) == ("freeText", "prose", 1)
    md = summaries.summarised(df, generate).filter("meeting_id = 'never'").select(render.summary_markdown(F.col("template"), F.col("payload"))).first()[0]
    assert md == "prose 1\n\n"
