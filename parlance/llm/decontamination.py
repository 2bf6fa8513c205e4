"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

An item of m characters occurs in a document with at most e edits only if some
diagonal band of the comparison, e wide, holds at least m - q + 1 - q e of the item's
q-grams.  So for each document the shared character q-grams are counted in
overlapping bands of diagonals; regions that meet the bound are kept and verified by
a banded alignment of the item against the region, free at the region's two ends.
The edit budget is ``EDITS`` of an item's characters.

Texts are compared in lower case with runs of white space as one blank; spans and
lengths are of that form.  Benchmark items go to the tasks in blocks of at most
``BLOCK_CHARS`` characters, so what is broadcast is bounded and any number of items is
searched.  Where the bound would be 0 or less for ``Q`` (20 to 23 characters), shorter
q-grams of ``SHORT_Q`` are counted.  An item of fewer than ``Q`` characters has no edit
budget: it is searched whole, and counts where neither neighbour is a letter or digit.
Null and blank items are skipped, null documents have no hit, and whole texts are searched
however long: shared q-grams are expanded ``EXPAND`` at a time, and counted
by diagonal, so memory grows with the text and not with how often its q-grams repeat.  Repeated rows have the
same hits each; of equally good places the first counts; a null doc_id or item_id stays
null.  Columns other than those named aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import _common as c

Q, SHORT_Q = 12, 8
EDITS = 0.05
#: Shared q-grams of a document that are at hand at once while they're counted by item.
EXPAND = 1 << 21
#: Diagonals whose hits are counted at once; one item's are, however many.
HISTOGRAM = 1 << 20
BLOCK_CHARS = 2_000_000
_FILTER_BITS = 22


def normalised(text: str) -> np.ndarray:
    return np.frombuffer(" ".join(text.lower().split()).encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(x: np.ndarray, q: int) -> np.ndarray:
    n = len(x) - q + 1
    if n <= 0:
        return np.zeros(0, c.U64)
    h = np.zeros(n, c.U64)
    for i in range(q):
        h = h * c.U64(0x100000001B3) + x[i : i + n]
    return c.mix(h)


def budget(m: int) -> int:
    return int(EDITS * m)


def gram_length(m: int, q: int) -> int:
    """The length of q-grams that an item of m characters is counted by; its own if it has no room for them."""
    if m < q:
        return m
    return q if m - q + 1 - q * budget(m) > 0 else min(SHORT_Q, q)


@dataclass
class Grams:
    """The q-grams of some items, ordered by fingerprint."""

    q: int
    names: np.ndarray
    of: np.ndarray
    at: np.ndarray
    seen: np.ndarray

    @classmethod
    def build(cls, items: dict[int, np.ndarray], q: int) -> Grams:
        g = {i: grams(x, q) for i, x in items.items()}
        names = np.concatenate([*g.values(), np.zeros(0, c.U64)])
        of = np.repeat(np.array(list(g), np.int64), [len(x) for x in g.values()])
        at = np.concatenate([*(np.arange(len(x)) for x in g.values()), np.zeros(0, np.int64)])
        order = np.argsort(names, kind="stable")
        seen = np.zeros(1 << _FILTER_BITS, bool)
        seen[(names >> c.U64(64 - _FILTER_BITS)).astype(np.int64)] = True
        return cls(q, names[order], of[order], at[order].astype(np.int64), seen)

    def shared(self, x: np.ndarray):
        """(item, place in the item, place in x) of shared q-grams, in parts of about ``EXPAND``."""
        g = grams(x, self.q)
        p = np.flatnonzero(self.seen[(g >> c.U64(64 - _FILTER_BITS)).astype(np.int64)])
        lo, hi = np.searchsorted(self.names, g[p]), np.searchsorted(self.names, g[p], side="right")
        p, lo, n = p[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
        part = (np.cumsum(n) - n) // EXPAND
        for s, t in zip(*c.stretches(part, np.ones(len(part), bool))):
            q, low, many = p[s:t], lo[s:t], n[s:t]
            k = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
            yield self.of[k], self.at[k], np.repeat(q, many)


@dataclass
class Index:
    """A block of items, by what each is searched by."""

    items: list[np.ndarray]
    counted: list[Grams]
    whole: list[Grams]
    need: np.ndarray

    @classmethod
    def build(cls, texts: list[str], q: int = Q) -> Index:
        items = [normalised(t) for t in texts]
        by: dict[int, dict[int, np.ndarray]] = {}
        for i, x in enumerate(items):
            if len(x):
                by.setdefault(gram_length(len(x), q), {})[i] = x
        long = {k: {i: x for i, x in part.items() if len(x) >= q} for k, part in by.items()}
        short = {k: {i: x for i, x in part.items() if len(x) < q} for k, part in by.items()}
        sizes = [(len(x), gram_length(len(x), q)) for x in items]
        need = np.array([max(1, m - k + 1 - k * budget(m)) for m, k in sizes], np.int64)
        return cls(items, [Grams.build(x, k) for k, x in long.items() if x], [Grams.build(x, k) for k, x in short.items() if x], need)

    def hits(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, start, end, edits) of the items that occur in the text within their budget."""
        x = normalised(text)
        out = [h for g in self.counted for h in self._counted(g, x)]
        return sorted(out + [h for g in self.whole for h in self._whole(g, x)])

    def _counted(self, g: Grams, x: np.ndarray):
        counts = np.zeros(len(self.items), np.int64)
        for item, _, _ in g.shared(x):
            counts += np.bincount(item, minlength=len(counts))
        enough = np.flatnonzero(counts >= self.need)
        longest = max((len(self.items[i]) for i in enough), default=0)
        span = len(x) + longest  # diagonals from -longest to the text's end
        # Hits are counted by diagonal, for a few items at a time, so what is held grows with the text, not with items times text.
        for at in range(0, len(enough), max(1, HISTOGRAM // span) if span else 1):
            some = enough[at : at + max(1, HISTOGRAM // span)]
            slot = np.full(len(self.items), -1)
            slot[some] = np.arange(len(some))
            hits = np.zeros(len(some) * span, np.int32)
            for item, place, where in g.shared(x):
                mine = slot[item]
                keep = mine >= 0
                hits += np.bincount(mine[keep] * span + where[keep] - place[keep] + longest, minlength=len(hits)).astype(np.int32)
            for i, row in zip(some.tolist(), hits.reshape(len(some), span)):
                e = budget(len(self.items[i]))
                best = None
                for start, end in bands(row, int(self.need[i]), e):
                    found = aligned(self.items[i], x, start - longest, end - longest, e)
                    if found and (best is None or found[2] < best[2]):
                        best = found
                if best:
                    yield i, *best

    def _whole(self, g: Grams, x: np.ndarray):
        first: dict[int, int] = {}
        for item, _, place in g.shared(x):
            for i, p in zip(item.tolist(), place.tolist()):
                end = p + g.q
                if i not in first and (x[p:end] == self.items[i]).all() and not (p and chr(x[p - 1]).isalnum()) and not (end < len(x) and chr(x[end]).isalnum()):
                    first[i] = p
        for i, p in first.items():
            yield i, p, p + g.q, 0


def bands(hits: np.ndarray, need: int, e: int) -> list[tuple[int, int]]:
    """Ranges of diagonals covered by overlapping bands, e + 1 wide, that hold at least ``need`` of the hits, given their number on each diagonal."""
    first = np.flatnonzero(hits)
    upto = np.cumsum(hits[first], dtype=np.int64)
    # The hits of a band that begins on a diagonal, from each of those on it, are the next ``need``: the last such that still fits counts.
    reach = np.searchsorted(first, first + e, side="right") - 1
    begin = np.minimum(upto - 1, upto[reach] - need)
    ok = begin >= upto - hits[first]
    if not ok.any():
        return []
    last = first[np.searchsorted(upto, begin[ok] + need - 1, side="right")]
    # A path of at most e edits stays within e of the diagonals that its band holds.
    s, t = c.runs_of(first[ok] - e, last + e + 1)
    return list(zip(s.tolist(), t.tolist()))


def aligned(item: np.ndarray, x: np.ndarray, lo: int, hi: int, most: int) -> tuple[int, int, int] | None:
    """(start, end, edits) of the best occurrence of item in x on the diagonals [lo, hi), if within ``most`` edits."""
    m, width = len(item), hi - lo
    off = np.arange(width)
    far = most + 1
    # cost[d]: edits up to row i on diagonal lo + d; start[d]: where in x that path begins.
    begin = lo + off
    cost = np.where((begin >= 0) & (begin <= len(x)), 0, far)
    start = begin.copy()
    padded = np.full(m + width + 1, np.iinfo(np.uint32).max, np.uint32)
    a, b = max(lo, 0), min(lo + m + width, len(x))
    if b > a:
        padded[a - lo : b - lo] = x[a:b]
    for i in range(m):
        same = cost + (padded[i : i + width] != item[i])
        drop = np.append(cost[1:] + 1, far)  # a character of the item is missing
        new = np.where(drop < same, drop, same)
        new_start = np.where(drop < same, np.append(start[1:], 0), start)
        j = lo + i + 1 + off
        new = np.where((j >= 0) & (j <= len(x)), new, far)
        # An extra character moves one diagonal on: a running minimum of new[d] - d.
        shifted = new - off
        best = np.minimum.accumulate(shifted)
        source = np.maximum.accumulate(np.where(shifted == best, off, 0))
        cost, start = best + off, new_start[source]
        cost = np.minimum(cost, far)
        if cost.min() > most:
            return None
    d = int(cost.argmin())
    return (int(start[d]), lo + m + d, int(cost[d])) if cost[d] <= most else None


def contaminated(docs: DataFrame, benchmark: DataFrame, q: int = Q, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Rows (doc_id, item_id, start, end, edits): the best occurrence of an item in a document."""
    found = None
    for block in _item_blocks(benchmark, block_chars):
        part = _search(docs.select("doc_id", "text"), block, q)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = docs.select("doc_id").filter("false").selectExpr("doc_id", "CAST(NULL AS BIGINT) AS item_id", "0L AS start", "0L AS end", "0 AS edits")
    return found


def clean(docs: DataFrame, benchmark: DataFrame, q: int = Q, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` without the rows that hold an item within its edit budget."""
    for block in _item_blocks(benchmark, block_chars):
        docs = docs.mapInArrow(c.released(_without(docs.sparkSession.sparkContext.broadcast([t for _, t in block]), q)), docs.schema)
    return docs


def _without(shared, q: int):
    def without(batches):
        import pyarrow as pa

        index = Index.build(shared.value, q)
        for batch in batches:
            yield batch.filter(pa.array([not (t and index.hits(t)) for t in batch.column("text").to_pylist()], pa.bool_()))

    return without


def _item_blocks(benchmark: DataFrame, block_chars: int):
    """Lists of (item_id, text), each bounded; only one is held at a time."""
    block, size = [], 0
    for r in benchmark.filter(F.col("text").rlike("\\S")).select(F.col("item_id").cast("long").alias("item_id"), "text").toLocalIterator():
        block.append((r.item_id, r.text))
        size += len(r.text)
        if size >= block_chars:
            yield block
            block, size = [], 0
    if block:
        yield block


def _search(docs: DataFrame, block: list, q: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(block)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def search(batches):
        import pyarrow as pa

        index = Index.build([t for _, t in shared.value], q)
        ids = [i for i, _ in shared.value]
        for batch in batches:
            rows = [(n, *h) for n, t in enumerate(batch.column("text").to_pylist()) if t for h in index.hits(t)]
            at, item, start, end, edits = zip(*rows) if rows else [[]] * 5
            cols = [batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array([ids[i] for i in item], pa.int64()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(edits, pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "item_id", "start", "end", "edits"])

    return docs.mapInArrow(c.released(search), f"doc_id {kind}, item_id long, start long, end long, edits int")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(c.read_table(spark, sf_dir, "documents"), c.read_table(spark, sf_dir, "benchmark"))
