"""Full-text search over segments: folding tokeniser, phrases, BM25, one hit a meeting, snippets."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.operators.ordered import best_per_key

K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
OVERFETCH = 4
SNIPPET_TOKENS = 16
_DROPPED = '"*()^:+-~'


def _folding() -> tuple[str, str]:
    """Lower-case letters with a diacritic that decompose to one base letter, and those letters."""
    pairs = {}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        ch = chr(code)
        base = unicodedata.normalize("NFD", ch)[0]
        if base != ch and unicodedata.category(ch) == "Ll" and base.isalpha():
            pairs[ch] = base
    return "".join(pairs), "".join(pairs.values())


FOLD_FROM, FOLD_TO = _folding()


def sanitised(query: str) -> list[str]:
    """The words of a query without operator characters; an empty list matches nothing."""
    words = ("".join(ch for ch in w if ch not in _DROPPED) for w in query.split())
    return [w for w in words if w]


def folded(text: str) -> str:
    return text.lower().translate(str.maketrans(FOLD_FROM, FOLD_TO))


def py_tokens(text: str) -> list[str]:
    out, word = [], []
    for ch in folded(text):
        if unicodedata.category(ch)[0] in "LN":
            word.append(ch)
        elif word:
            out.append("".join(word))
            word = []
    return out + (["".join(word)] if word else [])


def phrases(query: str) -> list[list[str]]:
    """Each word of the query as the adjacent tokens it stands for; words without letters are ignored."""
    return [p for p in (py_tokens(w) for w in sanitised(query)) if p]


def tokens(text: Column) -> Column:
    """Case-folded runs of letters and digits without Latin diacritics."""
    plain = F.translate(F.lower(text), FOLD_FROM, FOLD_TO)
    return F.filter(F.split(plain, "[^\\p{L}\\p{N}]+"), lambda x: x != "")


def phrase_count(toks: Column, phrase: list[str]) -> Column:
    """How often the phrase starts in an array of tokens."""
    if len(phrase) == 1:
        return F.size(F.filter(toks, lambda x: x == phrase[0]))
    want = F.array(*(F.lit(x) for x in phrase))
    starts = F.sequence(F.lit(1), F.greatest(F.size(toks) - len(phrase) + 1, F.lit(1)))
    return F.size(F.filter(starts, lambda i: F.slice(toks, i, len(phrase)) == want))


def scored(segments: DataFrame, query: str) -> DataFrame:
    """Segments that hold every phrase, with ``rank``: negative BM25, smaller is better.

    The corpus statistics are one grouped pass with partial sums; the one row that
    comes of it is joined back by broadcast.
    """
    wanted = phrases(query)
    df = segments.withColumn("tokens", tokens(F.col("text"))).withColumn("dl", F.size("tokens"))
    if not wanted:
        return df.withColumn("rank", F.lit(0.0)).filter("false").drop("tokens", "dl")
    tf = [f"tf{i}" for i in range(len(wanted))]
    for name, p in zip(tf, wanted):
        df = df.withColumn(name, phrase_count(F.col("tokens"), p))
    df = df.drop("tokens")
    stats = df.agg(F.count("*").alias("N"), F.avg("dl").alias("avgdl"), *(F.sum((F.col(t) > 0).cast("long")).alias(f"n{t}") for t in tf))
    hits = df
    for t in tf:
        hits = hits.filter(F.col(t) > 0)
    hits = hits.crossJoin(F.broadcast(stats))  # one row
    rank = F.lit(0.0)
    for t in tf:
        idf = F.log((F.col("N") - F.col(f"n{t}") + 0.5) / (F.col(f"n{t}") + 0.5))
        idf = F.when(idf > 0, idf).otherwise(IDF_FLOOR)
        rank = rank - idf * F.col(t) * (K1 + 1) / (F.col(t) + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return hits.withColumn("rank", F.round(rank, 9)).drop("N", "avgdl", "dl", *tf, *(f"n{t}" for t in tf))


def search(segments: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """At most ``limit`` best hits, one a meeting: (meeting_id, seg_id, start_ms, text, rank).

    Four times as many segments are ranked before meetings are told apart, so fewer
    than ``limit`` hits can come of many in one meeting.  A limit of 0 is none.
    """
    hits = scored(segments, query)
    if limit:
        hits = hits.orderBy("rank", "seg_id").limit(OVERFETCH * limit)
    best = best_per_key(hits, ["meeting_id"], [F.col("rank"), F.col("seg_id")])
    best = best.orderBy("rank", "seg_id")
    return best.limit(limit) if limit else best


def with_snippets(hits: DataFrame, query: str) -> DataFrame:
    """Adds ``snippet`` to the few rows of a result."""
    wanted = phrases(query)

    @F.pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: snippet(t or "", wanted))

    return hits.withColumn("snippet", cut("text"))


def _spans(text: str) -> list[tuple[int, int, str]]:
    """Tokens with their places.  Folding goes letter by letter, so places hold in the text itself."""
    out, start = [], None
    for i, ch in enumerate(text + " "):
        if unicodedata.category(ch)[0] in "LN":
            start = i if start is None else start
        elif start is not None:
            out.append((start, i, folded(text[start:i])))
            start = None
    return out


def snippet(text: str, wanted: list[list[str]], width: int = SNIPPET_TOKENS) -> str:
    """The best window of tokens, escaped, with its phrases in <mark>."""
    spans = _spans(text)
    words = [w for *_, w in spans]
    found = sorted((i, k) for k, p in enumerate(wanted) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p)
    n = len(words)

    def score(at):
        seen, total = set(), 0
        for o, k in found:
            if at <= o < at + width:
                total += 1 if k in seen else 1000
                seen.add(k)
        return total

    def centred(o):
        inside = [(x, k) for x, k in found if o <= x < o + width]
        end = max(x + len(wanted[k]) for x, k in inside)
        return max(0, min(o - int((width - (end - o)) / 2), n - width))

    starts = [i for i, (s, _, _) in enumerate(spans) if i == 0 or (text[s - 1].isspace() and text[:s].rstrip()[-1:] in (".", ":"))]
    best, at = -1, 0
    for o, _ in found:
        options = [(score(o), centred(o))]
        before = [f for f in starts if f <= o]
        if n > width and before and before[-1] < o:
            f = before[-1]
            options.append((score(f) + (120 if f == 0 else 100), f))
        for s, where in options:
            if s > best:
                best, at = s, where
    marks: list[list[int]] = []
    for o, k in found:
        a, b = spans[o][0], spans[min(o + len(wanted[k]), n) - 1][1]
        if at <= o < at + width:
            if marks and a <= marks[-1][1]:
                marks[-1][1] = max(marks[-1][1], b)
            else:
                marks.append([a, b])
    last = at + width - 1
    begin = spans[at][0] if at > 0 else 0
    end = len(text) if last >= n - 1 else spans[last][1]
    out, i = ["…" if at > 0 else ""], begin
    for a, b in marks:
        b = min(b, end)
        out += [_escaped(text[i:a]), "<mark>", _escaped(text[a:b]), "</mark>"]
        i = b
    return "".join([*out, _escaped(text[i:end]), "…" if last < n - 1 else ""])


def _escaped(text: str) -> str:
    return html.escape(text, quote=False).replace('"', "&quot;")


def plain_snippet(s: Column) -> Column:
    """For a terminal: without marks and line breaks."""
    return F.regexp_replace(F.regexp_replace(s, "</?mark>", ""), "[\\r\\n]+", " ")
