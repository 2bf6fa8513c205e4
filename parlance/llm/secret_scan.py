"""Secrets by patterns, and by the format that labelled credentials are inferred to have.

The patterns find the base spans: leftmost, non-overlapping matches of each kind, the whole match.
What they match labels credentials (of ``assign`` the value alone), and from these a format is inferred for each kind:

1. A sample of distinct values becomes a prefix tree whose states count visits, ends and outgoing characters.
2. States are visited by evidence, then in short-lex order, and merged with the first settled state that is
   statistically compatible (Hoeffding's bound at ``ALPHA`` on ends, on each character, and on all
   that follow); a state that is compatible with none is settled itself.  What is left is a
   probabilistic automaton.  Characters that a state has never seen get ``SMOOTH`` of the
   probability of their class there.
3. Every token (a run of ``[A-Za-z0-9+/_.=-]`` of ``LEAST`` or more) that touches no base
   span is a candidate, and all are scored: it is a secret if the automaton makes it ``ODDS``
   times likelier than ordinary tokens' trigrams do, and if its mean log-likelihood is at most
   ``DEVIATIONS`` standard deviations below that of labelled values held back.  The likeliest kind names it:
   ``like_assign``, ``like_access``, ``like_hex``.

Automata are inferred on the driver from at most ``SAMPLE`` values a kind of at most ``VALUE_BYTES``, those with the
smallest hashes, and ordinary tokens from ``ORDINARY`` distinct ones; each task sends no more ordinary tokens than that.
A value that is repeated thousands of times teaches once.  Texts are scanned whole, at any length, in one pass without a shuffle.

A null text is empty and has no span; a null doc_id stays; repeated rows get the same result each.  Without
labelled values of a kind it has no automaton, and without any there are only base spans.  Spans count code
points, and their order is by start, then kind as listed.  Columns other than doc_id and text aren't read.
"""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import _common as c

ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32
BASE = ("assign", "access", "hex")
KINDS = (*BASE, *(f"like_{x}" for x in BASE))
LEAST = 8
SAMPLE, ORDINARY, VALUE_BYTES = 2000, 20_000, 128
ALPHA, SMOOTH = 0.05, 0.02
ODDS, DEVIATIONS = math.log(1e6), 6.0
#: Visits below which a state isn't settled on its own, as nothing could be told of it.
LEAST_VISITS = 20

_TOKEN = np.zeros(256, bool)
_TOKEN[np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-", np.uint8)] = True
_HEX = np.zeros(256, bool)
_HEX[np.frombuffer(b"0123456789abcdef", np.uint8)] = True
#: The characters of tokens by number, and the class of each: lower and upper letters, digits, others.
_SYMBOLS = np.flatnonzero(_TOKEN)
_CODE = np.full(256, len(_SYMBOLS), np.int64)
_CODE[_SYMBOLS] = np.arange(len(_SYMBOLS))
_CLASS = np.array([0 if 97 <= x <= 122 else 1 if 65 <= x <= 90 else 2 if 48 <= x <= 57 else 3 for x in _SYMBOLS])
_END = len(_SYMBOLS)


# --- grammar inference ------------------------------------------------------------------------


class PrefixTree:
    """Counts of a sample of values by prefix, whose states are merged into an automaton."""

    def __init__(self, values: list[bytes]):
        self.next: list[dict[int, int]] = [{}]
        self.along: list[dict[int, int]] = [{}]
        self.ends, self.visits = [0], [0]
        for value in values:
            at = 0
            self.visits[0] += 1
            for x in value:
                if x not in self.next[at]:
                    self.next[at][x] = len(self.next)
                    self.next.append({})
                    self.along.append({})
                    self.ends.append(0)
                    self.visits.append(0)
                self.along[at][x] = self.along[at].get(x, 0) + 1
                at = self.next[at][x]
                self.visits[at] += 1
            self.ends[at] += 1

    def _differ(self, n1: int, m1: int, n2: int, m2: int) -> bool:
        return abs(n1 / m1 - n2 / m2) > self.width * (m1**-0.5 + m2**-0.5)

    def compatible(self, a: int, b: int) -> bool:
        """Whether what follows two states can't be told apart by Hoeffding's bound."""
        open_ = [(a, b)]
        while open_:
            a, b = open_.pop()
            m1, m2 = self.visits[a], self.visits[b]
            if not m1 or not m2:
                continue
            if self._differ(self.ends[a], m1, self.ends[b], m2):
                return False
            for x in self.along[a].keys() | self.along[b].keys():
                if self._differ(self.along[a].get(x, 0), m1, self.along[b].get(x, 0), m2):
                    return False
            open_ += [(self.next[a][x], y) for x, y in self.next[b].items() if x in self.next[a] and self.next[a][x] != y]
        return True

    def fold(self, red: int, blue: int) -> None:
        """Adds a subtree to a state and, along the same characters, to what follows it."""
        open_ = [(red, blue)]
        while open_:
            a, b = open_.pop()
            self.visits[a] += self.visits[b]
            self.ends[a] += self.ends[b]
            for x, n in self.along[b].items():
                self.along[a][x] = self.along[a].get(x, 0) + n
                if x in self.next[a]:
                    open_.append((self.next[a][x], self.next[b][x]))
                else:
                    self.next[a][x] = self.next[b][x]

    def merged(self, alpha: float = ALPHA, least: int = LEAST_VISITS) -> list[int]:
        """Merges compatible states; returns the settled ones, the root first."""
        self.width = math.sqrt(0.5 * math.log(2 / alpha))
        red, settled = [0], {0}
        while True:
            blue = [(r, x) for r in red for x in sorted(self.next[r]) if self.next[r][x] not in settled]
            if not blue:
                return red
            r, x = max(blue, key=lambda e: self.visits[self.next[e[0]][e[1]]])  # most evidence first, short-lex among equals
            b = self.next[r][x]
            into = next((a for a in red if self.compatible(a, b)), None)
            if into is None and self.visits[b] < least:
                into = red[-1]
            if into is None:
                red.append(b)
                settled.add(b)
            else:
                self.next[r][x] = into
                self.fold(into, b)


@dataclass
class Automaton:
    """Logarithms of a state's probabilities by character (the last column: end), and the state that follows."""

    log: np.ndarray
    next: np.ndarray

    @classmethod
    def inferred(cls, values: list[bytes]) -> Automaton:
        tree = PrefixTree([_CODE[np.frombuffer(v, np.uint8)].tolist() for v in values])
        states = tree.merged()
        place = {s: i for i, s in enumerate(states)}
        n = np.zeros((len(states), _END + 1))
        follow = np.zeros((len(states), _END), np.int32)
        for i, s in enumerate(states):
            n[i, _END] = tree.ends[s]
            for x, k in tree.along[s].items():
                n[i, x], follow[i, x] = k, place[tree.next[s][x]]
            # A character that was never seen here leads where the most frequent one does.
            follow[i, n[i, :_END] == 0] = place[tree.next[s][max(tree.along[s], key=tree.along[s].get)]] if tree.along[s] else i
        p = n / np.maximum(n.sum(1, keepdims=True), 1)
        by_class = np.stack([p[:, :_END][:, _CLASS == k].sum(1) / (_CLASS == k).sum() for k in range(4)], 1)
        spread = np.concatenate([0.9 * by_class[:, _CLASS] + 0.1 / _END, np.full((len(p), 1), 0.01)], 1)
        p = (1 - SMOOTH) * p + SMOOTH * spread
        return cls(np.log(p / p.sum(1, keepdims=True)), follow)

    def scores(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Log-likelihood of each span of a text's codes."""
        size = ends - starts
        order = np.argsort(-size, kind="stable")
        at, left = starts[order], size[order]
        state, out = np.zeros(len(order), np.int32), np.zeros(len(order))
        step, n = 0, len(order)
        while True:
            n = int(np.searchsorted(-left[:n], -step, side="left"))  # those longer than step
            if not n:
                break
            x = codes[at[:n] + step]
            out[:n] += self.log[state[:n], x]
            state[:n] = self.next[state[:n], x]
            step += 1
        out += self.log[state, _END]
        back = np.empty(len(order))
        back[order] = out
        return back


@dataclass
class Trigrams:
    """Logarithms of the probabilities of a character (the last: end) after two others (or the start)."""

    log: np.ndarray

    @classmethod
    def counted(cls, values: list[bytes]) -> Trigrams:
        k = _END + 1
        three = np.zeros((k, k, k))
        for v in values:
            x = np.concatenate([[_END, _END], _CODE[np.frombuffer(v, np.uint8)], [_END]])
            np.add.at(three, (x[:-2], x[1:-1], x[2:]), 1)
        two, one = three.sum(0), three.sum((0, 1))

        def backed(n: np.ndarray, shorter: np.ndarray) -> np.ndarray:
            """One of each count goes to the shorter context, so what only a single token has, such as a credential among them, isn't learnt."""
            less = np.maximum(n - 1, 0)
            total = n.sum(-1, keepdims=True)
            return (less + (total - less.sum(-1, keepdims=True) + 1) * shorter) / (total + 1)

        p1 = (one + 1) / (one.sum() + k)
        return cls(np.log(backed(three, backed(two, p1))))

    def scores(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Codes have two ends before the first span and one after each."""
        if not len(starts):
            return np.zeros(0)
        each = np.concatenate([[0.0], np.cumsum(self.log[codes[:-2], codes[1:-1], codes[2:]])])  # each[i]: up to place i + 2
        # The first two characters stand after the start, whatever is there before the token.
        total = each[ends - 1] - each[starts]
        one, two = codes[starts], codes[starts + 1]
        return total + self.log[_END, _END, one] + self.log[_END, one, two]


@dataclass
class SecretModel:
    automata: list[Automaton | None]
    least: list[float]
    ordinary: Trigrams | None

    def judged(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(kind or -1, log odds) of each candidate."""
        kind, best = np.full(len(starts), -1), np.full(len(starts), -np.inf)
        if self.ordinary is None or not len(starts):
            return kind, best
        base = self.ordinary.scores(codes, starts, ends)
        for i, (automaton, least) in enumerate(zip(self.automata, self.least)):
            if automaton is not None:
                fit = automaton.scores(codes, starts, ends)
                odds = fit - base
                take = (odds >= ODDS) & (fit / (ends - starts) >= least) & (odds > best)
                kind[take], best[take] = i, odds[take]
        return kind, best


def _codes(b: np.ndarray) -> np.ndarray:
    return np.concatenate([[_END, _END], _CODE[b], [_END]])


# --- scanning ---------------------------------------------------------------------------------


def base_spans(raw: bytes, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(kind, start, end, start of the value) of the base spans of some bytes, by start, then kind."""
    rows = [(m.start(), 0, m.end(), m.start(1)) for m in ASSIGN.finditer(raw) if m.end(1) - m.start(1) >= ASSIGN_LEAST]
    rows += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(raw) if m.end() - m.start() >= ACCESS_LEAST]
    s, e = c.mask_runs(_HEX[b])
    long = e - s >= HEX_LEAST
    rows += [(i, 2, j, i) for i, j in zip(s[long].tolist(), e[long].tolist())]
    start, kind, end, value = np.array(sorted(rows), np.int64).reshape(-1, 4).T
    return kind, start, end, value


def candidates(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that touch none of the given spans."""
    s, e = c.mask_runs(_TOKEN[b])
    long = e - s >= LEAST
    s, e = s[long], e[long]
    covered = np.concatenate([[0], np.cumsum(c.cover(len(b), starts, ends))]) if len(starts) else np.zeros(len(b) + 1, np.int64)
    free = covered[e] == covered[s]
    return s[free], e[free]


def _texts(batch) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The texts of a batch in one, with a line end after each, and where each starts and ends."""
    rows = c.binary_rows(batch.column("body"))
    raw = b"".join(x.tobytes() + b"\n" for x in rows)
    end = np.cumsum([len(x) + 1 for x in rows]).astype(np.int64) - 1
    return raw, np.concatenate([[0], end[:-1] + 1]).astype(np.int64)[: len(rows)], end


def _batches(batches, most: int = 4 << 20):
    """Batches of few rows and of about that many bytes of text."""
    for batch in c.slices(batches):
        size = np.cumsum([len(x) for x in c.binary_rows(batch.column("body"))])
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most)))
            yield batch.slice(at, to - at)
            at = to


def _hash(values: list[bytes]) -> list[int]:
    return [int.from_bytes(hashlib.blake2b(v, digest_size=8).digest(), "big") >> 1 for v in values]


def _labelled(docs: DataFrame) -> DataFrame:
    """(kind, value, h): values of base spans, and each task's ordinary tokens of the smallest hashes (kind -1)."""

    def find(batches):
        import pyarrow as pa

        ordinary: dict[bytes, int] = {}
        for batch in _batches(batches):
            raw, _, _ = _texts(batch)
            b = np.frombuffer(raw, np.uint8)
            kind, start, end, value = base_spans(raw, b)
            short = end - value <= VALUE_BYTES
            values = [raw[i:j] for i, j in zip(value[short].tolist(), end[short].tolist())]
            found = dict(zip(zip(kind[short].tolist(), values), _hash(values)))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int32()), pa.array([v for _, v in found], pa.binary()), pa.array(list(found.values()), pa.int64())], ["kind", "value", "h"])
            s, e = candidates(b, start, end)
            tokens = {raw[i:j] for i, j in zip(s.tolist(), e.tolist()) if j - i <= VALUE_BYTES} - ordinary.keys()
            ordinary |= zip(tokens := list(tokens), _hash(tokens))
            if len(ordinary) > 2 * ORDINARY:
                ordinary = dict(sorted(ordinary.items(), key=lambda x: x[1])[:ORDINARY])
        rows = sorted(ordinary.items(), key=lambda x: x[1])[:ORDINARY]
        yield pa.RecordBatch.from_arrays([pa.array([-1] * len(rows), pa.int32()), pa.array([v for v, _ in rows], pa.binary()), pa.array([h for _, h in rows], pa.int64())], ["kind", "value", "h"])

    return docs.select(F.col("text").cast("binary").alias("body")).mapInArrow(c.released(find), "kind int, value binary, h long").distinct()


def train(values: list[list[bytes]], ordinary: list[bytes]) -> SecretModel:
    """A model of values by kind.  Every fifth is held back for the least likelihood, if there are enough."""
    if not ordinary:
        return SecretModel([None] * len(values), [0.0] * len(values), None)
    automata, least = [], []
    for known in values:
        if not known:
            automata.append(None)
            least.append(0.0)
            continue
        fit = [v for i, v in enumerate(known) if i % 5] if len(known) >= 50 else known
        held = known[::5] if len(known) >= 50 else known
        a = Automaton.inferred(fit)
        b = np.frombuffer(b"\n".join(held) + b"\n", np.uint8)
        ends = np.cumsum([len(v) + 1 for v in held]) - 1
        starts = ends - [len(v) for v in held]
        mean = a.scores(_CODE[b], starts, ends) / (ends - starts)
        automata.append(a)
        least.append(float(mean.mean() - DEVIATIONS * mean.std()))
    return SecretModel(automata, least, Trigrams.counted(ordinary))


def fit(docs: DataFrame) -> SecretModel:
    """Infers the formats from what the patterns label in ``docs``."""
    mark = c.written()
    rows = c.stored(_labelled(docs))
    part = lambda kind, n: [r.value for r in rows.filter(F.col("kind") == kind).orderBy("h", "value").limit(n).collect()]
    values = [[bytes(v) for v in part(k, SAMPLE)] for k in range(len(BASE))]
    model = train(values, [bytes(v) for v in part(-1, ORDINARY)])
    c.clear_stored(docs.sparkSession, mark)
    return model


def secrets(docs: DataFrame, model: SecretModel) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end, odds>>), one a row of ``docs``; ``odds`` is null for base spans."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches):
        import pyarrow as pa

        for batch in _batches(batches):
            raw, first, last = _texts(batch)
            b = np.frombuffer(raw, np.uint8)
            kind, start, end, _ = base_spans(raw, b)
            s, e = candidates(b, start, end)
            # Two places more before the text, as the trigrams need them.
            like, odds = shared.value.judged(_codes(b), s + 2, e + 2)
            hit = like >= 0
            kind = np.concatenate([kind, like[hit] + len(BASE)])
            odds = np.concatenate([np.full(len(start), np.nan), odds[hit]])
            start, end = np.concatenate([start, s[hit]]), np.concatenate([end, e[hit]])
            order = np.lexsort((kind, start))
            kind, odds, start, end = kind[order], odds[order], start[order], end[order]
            row = np.searchsorted(last, start, side="left")
            points = np.concatenate([[0], np.cumsum((b & 0xC0) != 0x80)])
            of = points[first[row]] if len(row) else np.zeros(0, np.int64)
            spans = pa.StructArray.from_arrays(
                [pa.array(KINDS).take(pa.array(kind)), pa.array(points[start] - of), pa.array(points[end] - of), pa.array(odds, from_pandas=True)], ["kind", "start", "end", "odds"]
            )
            at = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=batch.num_rows))])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(at, pa.int32()), spans)], ["doc_id", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("body"))
    return rows.mapInArrow(c.released(scan), f"doc_id {kind}, spans array<struct<kind:string,start:long,end:long,odds:double>>")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def _of(*kinds: str) -> Column:
    return F.filter("spans", lambda x: x["kind"].isin(*kinds))


def _count(name: str, *kinds: str) -> Column:
    return F.size(_of(*kinds)).cast("long").alias(name)


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.read_table(spark, sf_dir, "documents")
    n = [_count(f"n_{kind}", kind) for kind in BASE]
    added = _count("n_added", *KINDS[len(BASE) :])
    return secrets(docs, fit(docs)).select("doc_id", *n, F.sha2(_joined(_of(*BASE)), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), added)
