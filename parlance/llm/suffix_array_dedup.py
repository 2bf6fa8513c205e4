"""Substring removal by sparse prefix doubling over the suffixes of a whole corpus.

Every byte covered by a string of ``length`` bytes that also starts anywhere else
in the corpus is removed.  The textbook form sorts one (position, rank) row for
each byte in every round, which was measured to shuffle 22 times the input and to write
44 times the input between rounds (see README).  Here the rounds start from long prefixes, and each
round only carries what the one before left undecided:

1. Round at ``gram`` bytes, over sync points.  A window of ``length`` bytes is
   named by the least fingerprint among the grams that start in it.  Equal windows
   have equal names, so it's enough to rank one gram a window: Spark counts the
   distinct names, and the windows whose name occurs once are unique and retire.
2. Undecided windows are shuffled by that rank, each run of windows with the same
   name as one row with its bytes, equal runs combined before the shuffle.
3. Within a rank, positions are paired with the rank at growing offsets (``length``
   / 4, / 2, whole), sorted and ranked again; unique pairs retire in each round.
   A rank too large for one task goes on as Spark rows, one a window, which are
   combined before they are shuffled.

A window is thus reported if it is unique, and all else that was undecided repeats.

Nulls and texts shorter than ``length`` keep all bytes.  Rows with a null or repeated
doc_id count as documents of their own; a repeated row repeats all its windows.  Texts of
any length are read whole; each is held by one task at a time.  Columns other than doc_id and text aren't read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import _common as c

LENGTH = 200
GRAM = 32
#: Bytes of runs that a task ranks at once, and of one rank from which its windows go on as rows.
BATCH_BYTES = 4 << 20
RANK_BYTES = 64 << 20
#: Bytes of runs that a task holds to combine equal ones before the shuffle.
COMBINE_BYTES = 48 << 20


def repeated_substrings(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, rank_bytes: int = RANK_BYTES) -> DataFrame:
    """Rows (doc_id, kept binary, removed array<struct<start, end>>), one a row of ``docs``.

    ``removed`` holds the maximal removed runs as half-open byte spans of the text.
    """
    if not 0 < gram <= length // 2:
        raise ValueError("gram must be positive and at most half of length")
    points = c.stored(_names(docs, length, gram))
    known = points.groupBy("name").agg(F.sum("n").alias("n")).filter("n > 1").select("name")
    per_doc = c.stored(points.join(known, "name").groupBy("row").agg(F.collect_set("name").alias("names")))
    runs = c.packed_texts(docs).join(per_doc, "row").select("row", "packed", "names").mapInArrow(c.released(_runs(length, gram)), "name long, n int, row long, at long, body binary")
    ranked = c.stored(
        runs.repartition("name").sortWithinPartitions("name").mapInArrow(c.released(_rank(length, rank_bytes)), "row long, start long, end long, h1 long, h2 long, n int")
    )
    windows = ranked.filter("n > 0").groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.min("row").alias("row"), F.min("start").alias("start"))
    unique = ranked.filter("n = 0").select("row", "start", "end").unionByName(windows.filter("n = 1").selectExpr("row", "start", "start + 1 AS end"))
    unique = unique.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("unique"))
    whole = c.packed_texts(docs, "text", "doc_id").join(per_doc, "row", "left").join(unique, "row", "left")
    whole = whole.select("doc_id", "packed", "names", F.col("unique.start").alias("starts"), F.col("unique.end").alias("ends"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, kept binary, removed array<struct<start: bigint, end: bigint>>"
    return whole.mapInArrow(c.released(_cut(length, gram)), schema)


def _names(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(row, name, n): the names of each document's windows; n is 2 if two places in it have the name."""
    width = length - gram + 1

    def names(batches):
        import pyarrow as pa

        for batch in batches:
            rows, found, times = [], [], []
            for row, b in zip(batch.column("row").to_pylist(), c.binary_rows(batch.column("body"))):
                if len(b) < length:
                    continue
                h = c.rolling(c.prefix_sums(c.BYTE_CODES[b]), gram)
                u, n = np.unique(h[c.sync_points(h, width)], return_counts=True)
                rows.append(np.full(len(u), row))
                found.append(u)
                times.append(np.minimum(n, 2))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(rows)), pa.array(c.signed(np.concatenate(found))), pa.array(np.concatenate(times).astype(np.int32))], ["row", "name", "n"]
                )

    texts = docs.select(c.row_key().alias("row"), F.col("text").cast("binary").alias("body"))
    return texts.mapInArrow(c.released(names), "row long, name long, n int")


def _undecided(b: np.ndarray, names: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The name of each window of a text, and whether another place has it too."""
    if len(b) < length or not len(names):
        e = np.zeros(0, c.U64)
        return e, np.zeros(0, bool)
    low = c.least_in(c.rolling(c.prefix_sums(c.BYTE_CODES[b]), gram), length - gram + 1)
    return low, c.is_in(low, np.sort(names))


def _runs(length: int, gram: int):
    def runs(batches):
        import pyarrow as pa

        held: dict[tuple[int, bytes], list] = {}
        size = 0

        def out():
            rows = [(name, n, row, at, body) for (name, body), (n, row, at) in held.items()]
            for i in range(0, len(rows), 4096):
                names, n, row, at, body = zip(*rows[i : i + 4096])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array(names, c.U64).view(np.int64)), pa.array(n, pa.int32()), pa.array(row, pa.int64()), pa.array(at, pa.int64()), pa.array(body, pa.binary())],
                    ["name", "n", "row", "at", "body"],
                )

        for batch in batches:
            for row, b, names in zip(batch.column("row").to_pylist(), c.unpacked(batch.column("packed")), c.list_rows(batch.column("names"), np.int64)):
                low, again = _undecided(b, names.view(c.U64), length, gram)
                whole = b.tobytes()
                starts, ends = c.stretches(low, again)
                for name, s, e in zip(low[starts].tolist(), starts.tolist(), ends.tolist()):
                    key = (name, whole[s : e + length - 1])
                    one = held.get(key)
                    if one is None:
                        held[key] = [1, row, s]
                        size += len(key[1]) + 200
                    else:
                        one[0] = 2
                if size > COMBINE_BYTES:
                    yield from out()
                    held, size = {}, 0
        yield from out()

    return runs


def _rank(length: int, rank_bytes: int):
    """Rows of one name come together; yields runs of unique windows (n = 0), or windows of too large a rank."""

    def rank(batches):
        import pyarrow as pa

        names = ["row", "start", "end", "h1", "h2", "n"]

        def rows(*cols):
            n = len(cols[0])
            cols = [np.broadcast_to(np.asarray(x, np.int64), n) for x in cols]
            for i in range(0, n, 1 << 16):
                yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(x[i : i + (1 << 16)])) for x in cols[:5]), pa.array(cols[5][i : i + (1 << 16)].astype(np.int32))], names)

        def decided(group):
            if group:
                yield from rows(*_unique_runs(group, length), 0, 0, 0)

        def as_rows(group):
            for n, row, at, body in group:
                b = np.frombuffer(body, np.uint8)
                codes = c.BYTE_CODES[b]
                h1 = c.rolling(c.prefix_sums(codes), length)
                h2 = c.rolling(c.prefix_sums(c.mix(codes)), length)
                s = at + np.arange(len(h1))
                yield from rows(np.full(len(h1), row), s, s + 1, c.signed(h1), c.signed(h2), n)

        done, size = [], 0  # whole ranks, not yet sorted
        group, held, name, large = [], 0, None, False
        for batch in batches:
            for k, n, row, at, body in zip(*(batch.column(x).to_pylist() for x in ("name", "n", "row", "at", "body"))):
                if k != name:
                    if len(group) > 1:
                        done += group
                        size += held
                    elif group:
                        yield from decided(group) if group[0][0] == 1 else ()
                    group, held, name, large = [], 0, k, False
                    if size > BATCH_BYTES:
                        yield from decided(done)
                        done, size = [], 0
                group.append((n, row, at, body))
                held += len(body)
                if large or held > rank_bytes:
                    large = True
                    yield from as_rows(group)
                    group, held = [], 0
        yield from decided(done + group)

    return rank


def _unique_runs(group: list[tuple[int, int, int, bytes]], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs (row, start, end) of the windows whose string starts nowhere else in the group.

    Prefix doubling: the rank of a window's first h bytes and that of the h bytes
    after them are paired, sorted and ranked again, until unique or of full length.
    """
    merged: dict[bytes, list] = {}
    for n, row, at, body in group:
        one = merged.get(body)
        if one is None:
            merged[body] = [n, row, at]
        else:
            one[0] = 2
    bodies = list(merged)
    weight = np.array([x[0] for x in merged.values()], np.int64)
    sizes = np.array([len(x) for x in bodies], np.int64)
    base = np.concatenate([[0], np.cumsum(sizes)])
    sums = c.prefix_sums(c.BYTE_CODES[np.frombuffer(b"".join(bodies), np.uint8)])
    counts = sizes - length + 1
    owner = np.repeat(np.arange(len(bodies)), counts)
    inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    at = base[owner] + inner
    left = np.arange(len(at))  # not yet unique
    h = -(-length // 4)
    rank = c.span_hash(sums, at, at + h)
    while len(left):
        step = min(h, length - h)
        if step:
            p = at[left] + step
            rank = c.mix(rank * c.U64(c.BASE) + c.span_hash(sums, p, p + h))
            h += step
        _, which = np.unique(rank, return_inverse=True)
        many = np.bincount(which, weight[owner[left]])[which] > 1
        left, rank = left[many], rank[many]
        if h >= length:
            break
    alone = np.ones(len(at), bool)
    alone[left] = False
    s, e = c.stretches(owner, alone)
    rows, first = (np.array([x[i] for x in merged.values()], np.int64) for i in (1, 2))
    o = owner[s]
    return rows[o], first[o] + inner[s], first[o] + inner[e - 1] + 1


def _cut(length: int, gram: int):
    def cut(batches):
        import pyarrow as pa

        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            kept, spans, size, first = [], [], 0, 0
            texts = c.unpacked(batch.column("packed"))
            parts = [c.list_rows(batch.column(x), k) for x, k in (("names", np.int64), ("starts", np.int64), ("ends", np.int64))]
            for i, (b, names, starts, ends) in enumerate(zip(texts, *parts)):
                low, again = _undecided(b, names.view(c.U64), length, gram)
                if again.any():
                    again &= ~c.cover(len(low), starts, ends)
                    s, e = c.mask_runs(again)
                    s, e = c.runs_of(s, e + length - 1)
                    kept.append(b[~c.cover(len(b), s, e)].tobytes())
                    spans.append([{"start": x, "end": y} for x, y in zip(s.tolist(), e.tolist())])
                else:
                    kept.append(b.tobytes())
                    spans.append([])
                size += len(kept[-1])
                if size > BATCH_BYTES or i + 1 == len(texts):
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, i + 1 - first), pa.array(kept, pa.binary()), pa.array(spans, pa.list_(span))], ["doc_id", "kept", "removed"])
                    kept, spans, size, first = [], [], 0, i + 1

    return cut


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_substrings(c.read_table(spark, sf_dir, "documents"))
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return found.select(
        "doc_id",
        (F.octet_length("kept") + n_removed).cast("long").alias("n_bytes"),
        n_removed.alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
