"""Token streams of language models: hidden thoughts, stop sequences, and the events of an answer."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions.text import citations

OPEN, CLOSE = "<think>", "</think>"
SHOWN = "reply_id long, seq long, delta string, stopped boolean"
STATE = "text string, places array<long>, stopped boolean"


class ReplyFilter:
    """What of each token may be shown: nothing of a first thought, nothing from a stop sequence on.

    A token is a span of the reply's text, and what it may show follows from where marks and stop sequences first stand in the
    text: ``places``, -1 for what isn't there yet.  Each is looked for once in each place, however the text is cut.
    """

    def __init__(self, stops: tuple[str, ...] = (), state: tuple | None = None):
        self.marks = (OPEN, CLOSE, *(s for s in stops if s))
        text, places, stopped = state or ("", [-1] * len(self.marks), False)
        self.text, self.places, self.stopped = text, list(places), stopped

    def state(self) -> tuple:
        return self.text, self.places, self.stopped

    def push(self, token: str) -> str:
        return "".join(self.take([token]))

    def take(self, tokens: list[str]) -> list[str]:
        """What each of the next tokens shows, up to the one that stops the reply."""
        at = len(self.text)
        self.text += "".join(tokens)
        self.places = [p if p >= 0 else self.text.find(m, max(0, at - len(m) + 1)) for m, p in zip(self.marks, self.places)]
        out = []
        for token in tokens:
            if self.stopped:
                break
            out.append(self._span(at, at := at + len(token)))
        return out

    def _span(self, a: int, b: int) -> str:
        """A thought is known to begin and end with the tokens that complete its marks.

        The end's may stand first in the text. The token that ends a thought searches what it shows for stop sequences in their
        order; others take the first in the text, hidden or not.
        """
        opened, closed = self.places[:2]
        known = opened + len(OPEN) if opened >= 0 else None
        after = closed + len(CLOSE)
        over = max(known, after) if known and closed >= 0 else None
        begins = known is not None and a < known <= b
        if over is not None and a < over <= b:
            text = self.text[a:opened] + self.text[after:b] if begins else self.text[after:b].lstrip()
            cut = next((text.index(s) for s in self.marks[2:] if s in text), None)
            self.stopped = cut is not None
            return text[:cut]
        if begins:
            return self.text[a:opened]
        if known is not None and known <= a and (over is None or b < over):
            return ""
        stops = [p for s, p in zip(self.marks[2:], self.places[2:]) if 0 <= p <= b - len(s)]
        self.stopped = bool(stops)
        return self.text[a : min([b, *stops])]


def _shown(f: ReplyFilter, reply, pdf: pd.DataFrame) -> list[tuple]:
    pdf = pdf.sort_values("seq")
    if f.stopped:
        return []
    shown = f.take(pdf["token"].tolist())
    return [(reply, seq, delta, f.stopped and i + 1 == len(shown)) for i, (seq, delta) in enumerate(zip(pdf["seq"].tolist(), shown))]


def shown(tokens: DataFrame, stops: tuple[str, ...] = ()) -> DataFrame:
    """(reply_id, seq, delta, stopped): an ordered fold over each reply's tokens; a reply is as long as a model's answer.

    A null token is an empty one, and an empty stop sequence is none.
    """

    def fold(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_shown(ReplyFilter(stops), key[0], pdf), columns=["reply_id", "seq", "delta", "stopped"])

    return tokens.select("reply_id", "seq", F.coalesce("token", F.lit("")).alias("token")).groupBy("reply_id").applyInPandas(fold, SHOWN)


def shown_stream(tokens: DataFrame, stops: tuple[str, ...] = (), forget_ms: int | None = None) -> DataFrame:
    """The same over a stream; state is a reply's text so far.

    A token that has ``last`` set, where ``tokens`` has that column, ends its reply and its state; with ``forget_ms`` state also goes
    after so long without a token.
    """
    last = F.coalesce(F.col("last"), F.lit(False)) if "last" in tokens.columns else F.lit(False)

    def fold(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        f = ReplyFilter(stops, state.get if state.exists else None)
        pdf = pd.concat(list(batches))
        rows = _shown(f, key[0], pdf)
        if pdf["last"].any():
            if state.exists:
                state.remove()
        else:
            state.update(f.state())
            if forget_ms:
                state.setTimeoutDuration(forget_ms)
        yield pd.DataFrame(rows, columns=["reply_id", "seq", "delta", "stopped"])

    rows = tokens.select("reply_id", "seq", F.coalesce("token", F.lit("")).alias("token"), last.alias("last"))
    return rows.groupBy("reply_id").applyInPandasWithState(fold, SHOWN, STATE, "append", "ProcessingTimeTimeout" if forget_ms else "NoTimeout")


def answer_text(tokens: DataFrame) -> DataFrame:
    """(reply_id, text): deltas in order, as one text."""
    parts = F.array_sort(F.collect_list(F.struct("seq", "delta")))
    return tokens.groupBy("reply_id").agg(F.array_join(F.transform(parts, lambda x: x["delta"]), "").alias("text"))


def answer_events(replies: DataFrame, tokens: DataFrame) -> DataFrame:
    """Events of answers: ``started`` with the model, one ``token`` each, and ``finished`` or ``failed``.

    ``replies`` has (reply_id, model, error, ids), with ids those that may be cited; tokens are numbered from 0.  A finished
    answer has its text and valid citations, a failed one its tokens and then the error.
    """
    none = F.lit(None).cast("array<string>").alias("citations")
    started = replies.select("reply_id", F.lit(0).cast("long").alias("event"), F.lit("started").alias("type"), F.col("model").alias("text"), none)
    body = tokens.select("reply_id", (F.col("seq") + 1).cast("long").alias("event"), F.lit("token").alias("type"), F.col("delta").alias("text"), none)
    last = tokens.groupBy("reply_id").agg(F.max("seq").alias("seq"))
    ends = replies.join(answer_text(tokens), "reply_id", "left").join(last, "reply_id", "left")
    failed, text = F.col("error").isNotNull(), F.coalesce("text", F.lit(""))
    cited = F.when(~failed, F.array_intersect(citations(text), "ids")).alias("citations")
    event = (F.coalesce("seq", F.lit(-1)) + 2).cast("long").alias("event")
    ends = ends.select("reply_id", event, F.when(failed, "failed").otherwise("finished").alias("type"), F.when(failed, F.col("error")).otherwise(text).alias("text"), cited)
    return started.unionByName(body).unionByName(ends)


def answer_stream(parts: DataFrame, forget_ms: int | None = None) -> DataFrame:
    """The events of ``answer_events`` over a stream of parts (reply_id, seq, kind, body, ids).

    ``started`` has the model as its body and the ids that may be cited, ``token`` a delta, ``finished`` nothing and ``failed`` the
    error.  Parts come in order of seq, but for those within a micro-batch; repeated ones are told by their seq.  State is the text so far; it
    goes with the terminal event, or, with ``forget_ms``, after so long without a part, which then fails the answer.
    """
    schema = "reply_id long, event long, type string, text string, ids array<string>"

    def fold(key, batches, state):
        events, text, ids, at = state.get if state.exists else (0, "", "", -1)
        rows, over = [], state.hasTimedOut
        if over:
            rows.append((key[0], events, "failed", "no part came in time", None))
        else:
            known = ids.split("\x00") if ids else []
            for seq, kind, body, some in pd.concat(list(batches)).sort_values("seq")[["seq", "kind", "body", "ids"]].itertuples(index=False):
                if over or seq <= at:
                    continue
                at = int(seq)
                if kind == "started":
                    known = list(some) if some is not None else []
                text += body if kind == "token" else ""
                over = kind in ("finished", "failed")
                rows.append((key[0], events, kind, text if kind == "finished" else body, known if kind == "finished" else None))
                events += 1
            ids = "\x00".join(known)
        if not over:
            state.update((events, text, ids, at))
            if forget_ms:
                state.setTimeoutDuration(forget_ms)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(rows, columns=["reply_id", "event", "type", "text", "ids"])

    out = parts.select("reply_id", "seq", "kind", "body", "ids").groupBy("reply_id").applyInPandasWithState(fold, schema, "events long, text string, ids string, seq long", "append", "ProcessingTimeTimeout" if forget_ms else "NoTimeout")
    return out.select("reply_id", "event", "type", "text", F.when(F.col("ids").isNotNull(), F.array_intersect(citations(F.col("text")), "ids")).alias("citations"))
