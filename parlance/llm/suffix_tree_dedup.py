"""Removal of repeated passages by suffix trees over windows, partitioned by a gram within them.

A window is ``window`` consecutive words of one document.  Each word covered by a
window whose word sequence also starts in a document with a smaller doc_id is
removed, so of each repeated passage the copy in the first document stays.

One suffix tree over a corpus doesn't fit into any machine, so suffixes are dealt by
what is called their prefix here: the least fingerprint among the grams of ``gram`` words
in the window they start, which equal windows share.  It's no leading prefix: neighbours
would have different ones, and each suffix would travel alone with its whole window (see
README for figures).  A prefix seen in one document only has
a tree without inner nodes between documents and is dropped first.  The suffixes of
one prefix come to one task, which sorts them, takes the longest common prefixes of
neighbours, and so has the subtree: its inner nodes of string depth ``window`` or
more are the repeats.  A prefix with more suffixes than ``tree_windows`` is made
longer, to the whole window, and its windows go on as Spark rows that are combined
before they are shuffled.

Null, empty and short texts lose nothing; texts of any length are read whole.  A null doc_id counts as larger than any
other; rows with equal doc_id don't remove each other's words.  Columns other than
doc_id and text aren't read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.llm import _common as c

WINDOW = 50
GRAM = 8
#: Suffixes that a task sorts at once, and of one prefix from which it's made longer.
BATCH_WINDOWS = 40_000
TREE_WINDOWS = 400_000
#: Bytes of runs that a task holds to combine equal ones before the shuffle.
COMBINE_BYTES = 48 << 20
LAST = (1 << 63) - 1


def repeated_passages(
    docs: DataFrame, window: int = WINDOW, gram: int = GRAM, tree_windows: int = TREE_WINDOWS, carry: tuple[str, ...] = (), verbatim: bool = False
) -> DataFrame:
    """Rows (doc_id, kept binary, n_words, removed array<struct<start, end>>), one a row of ``docs``.

    ``kept`` holds the kept words joined by one space, ``removed`` the maximal removed
    runs as half-open spans of word numbers.  With ``verbatim``, ``kept`` holds the text as
    it is but for the removed runs.  Columns named in ``carry`` come along.
    """
    if not 0 < gram <= window:
        raise ValueError("gram must be positive and at most window")
    keyed = docs.withColumn("first_doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)))
    points = c.stored(_prefixes(keyed, window, gram))
    known = points.groupBy("prefix").agg(F.min("first_doc").alias("a"), F.max("first_doc").alias("b")).filter("a < b").select("prefix")
    per_doc = c.stored(points.join(known, "prefix").groupBy("row").agg(F.collect_set("prefix").alias("prefixes")))
    runs = c.packed_texts(keyed, "text", "first_doc").join(per_doc, "row").select("row", "first_doc", "packed", "prefixes")
    runs = runs.mapInArrow(c.released(_runs(window, gram)), "prefix long, first_doc long, row long, at long, body binary")
    trees = c.stored(
        runs.repartition("prefix").sortWithinPartitions("prefix", "body", "first_doc").mapInArrow(c.released(_trees(window, tree_windows)), "row long, start long, end long, h1 long, h2 long, first_doc long")
    )
    longer = trees.filter("h1 IS NOT NULL")
    least = longer.groupBy("h1", "h2").agg(F.min("first_doc").alias("first_doc"))
    first = trees.filter("h1 IS NULL").select("row", "start", "end").unionByName(longer.join(least, ["h1", "h2", "first_doc"]).select("row", "start", "end"))
    first = first.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("first"))
    whole = c.packed_texts(docs, "text", "doc_id", *carry).join(per_doc, "row", "left").join(first, "row", "left")
    whole = whole.select("doc_id", *carry, "packed", "prefixes", F.col("first.start").alias("starts"), F.col("first.end").alias("ends"))
    own = [T.StructField(x, docs.schema[x].dataType) for x in ("doc_id", *carry)]
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    more = [T.StructField("kept", T.BinaryType()), T.StructField("n_words", T.LongType()), T.StructField("removed", T.ArrayType(span))]
    return whole.mapInArrow(c.released(_cut(window, gram, ("doc_id", *carry), verbatim)), T.StructType([*own, *more]))


def _window_prefixes(b: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all grams of a text, and the prefix of each window."""
    h = c.rolling(c.prefix_sums(c.word_hashes(b)), gram)
    return h, c.least_in(h, window - gram + 1)


def _prefixes(docs: DataFrame, window: int, gram: int) -> DataFrame:
    def prefixes(batches):
        import pyarrow as pa

        for batch in batches:
            rows, docs_, found = [], [], []
            for row, doc, b in zip(batch.column("row").to_pylist(), batch.column("first_doc").to_pylist(), c.binary_rows(batch.column("body"))):
                _, low = _window_prefixes(b, window, gram)
                if len(low):
                    u = np.unique(low[np.concatenate([[True], low[1:] != low[:-1]])])
                    rows.append(np.full(len(u), row))
                    docs_.append(np.full(len(u), doc))
                    found.append(u)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rows)), pa.array(np.concatenate(docs_)), pa.array(c.signed(np.concatenate(found)))], ["row", "first_doc", "prefix"])

    texts = docs.select(c.row_key().alias("row"), "first_doc", F.col("text").cast("binary").alias("body"))
    return texts.mapInArrow(c.released(prefixes), "row long, first_doc long, prefix long")


def _undecided(b: np.ndarray, prefixes: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The prefix of each window, and whether another document has it too."""
    if not len(prefixes):
        e = np.zeros(0, c.U64)
        return e, np.zeros(0, bool)
    _, low = _window_prefixes(b, window, gram)
    return low, c.is_in(low, np.sort(prefixes))


def _runs(window: int, gram: int):
    """Windows with the same prefix as one row with their words; of equal runs, those of the first document stay."""

    def runs(batches):
        import pyarrow as pa

        held: dict[tuple[int, bytes], list] = {}
        size = 0

        def out():
            rows = [(prefix, doc, row, at, body) for (prefix, body), (doc, places) in held.items() for row, at in places]
            for i in range(0, len(rows), 4096):
                prefix, doc, row, at, body = zip(*rows[i : i + 4096])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array(prefix, c.U64).view(np.int64)), *(pa.array(x, pa.int64()) for x in (doc, row, at)), pa.array(body, pa.binary())],
                    ["prefix", "first_doc", "row", "at", "body"],
                )

        for batch in batches:
            cols = batch.column("row").to_pylist(), batch.column("first_doc").to_pylist(), c.unpacked(batch.column("packed")), c.list_rows(batch.column("prefixes"), np.int64)
            for row, doc, b, prefixes in zip(*cols):
                low, again = _undecided(b, prefixes.view(c.U64), window, gram)
                starts, ends = c.stretches(low, again)
                if not len(starts):
                    continue
                words = b.tobytes().split()
                for prefix, s, e in zip(low[starts].tolist(), starts.tolist(), ends.tolist()):
                    key = (prefix, b" ".join(words[s : e + window - 1]))
                    one = held.get(key)
                    if one is None or doc < one[0]:
                        size += (len(key[1]) + 200) * (one is None)
                        held[key] = [doc, [(row, s)]]
                    elif doc == one[0]:
                        one[1].append((row, s))
                        size += 100
                if size > COMBINE_BYTES:
                    yield from out()
                    held, size = {}, 0
        yield from out()

    return runs


def _trees(window: int, tree_windows: int):
    """Rows of one prefix come together, equal runs side by side; yields runs of windows that start in no earlier document.

    Of a prefix that is made longer, a task passes on only the windows that are first among those it has held at once.
    """

    def trees(batches):
        import pyarrow as pa

        names = ["row", "start", "end", "h1", "h2", "first_doc"]

        def rows(row, start, end, h1=None, h2=None, doc=None):
            for i in range(0, len(row), 1 << 16):
                n = len(row[i : i + (1 << 16)])
                yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()) if x is None else pa.array(np.asarray(x[i : i + (1 << 16)], np.int64)) for x in (row, start, end, h1, h2, doc)], names)

        def decided(group):
            if group:
                yield from rows(*first_windows(group, window))

        def as_rows(group):
            parts = []
            for doc, row, at, body in group:
                h = c.word_hashes(np.frombuffer(body, np.uint8))
                h1, h2 = c.rolling(c.prefix_sums(h), window), c.rolling(c.prefix_sums(c.mix(h)), window)
                parts.append((h1, h2, np.full(len(h1), doc), np.full(len(h1), row), at + np.arange(len(h1))))
            h1, h2, doc, row, s = map(np.concatenate, zip(*parts))
            o = np.lexsort((doc, h2, h1))
            h1, h2, doc, row, s = h1[o], h2[o], doc[o], row[o], s[o]
            new = np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
            first = doc == doc[new][np.cumsum(new) - 1]
            yield from rows(row[first], s[first], s[first] + 1, c.signed(h1[first]), c.signed(h2[first]), doc[first])

        done, size = [], 0
        group, held, prefix, large, last = [], 0, None, False, (None, None)
        for batch in batches:
            for k, doc, row, at, body in zip(*(batch.column(x).to_pylist() for x in ("prefix", "first_doc", "row", "at", "body"))):
                if k != prefix:
                    if large and group:
                        yield from as_rows(group)
                    elif not large:
                        done += group
                        size += held
                    group, held, prefix, large, last = [], 0, k, False, (None, None)
                    if size > BATCH_WINDOWS:
                        yield from decided(done)
                        done, size = [], 0
                if body == last[0]:
                    if doc > last[1]:
                        continue  # equal runs that other tasks have sent; the first document's come first
                else:
                    last = body, doc
                    held += body.count(b" ") + 2 - window
                group.append((doc, row, at, last[0]))
                if held > tree_windows:
                    large = True
                    yield from as_rows(group)
                    group, held = [], 0
        if large and group:
            yield from as_rows(group)
        yield from decided(done if large else done + group)

    return trees


def first_windows(group: list[tuple[int, int, int, bytes]], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs (row, start, end) of the windows that start in no document before their own."""
    numbers: dict[bytes, int] = {}
    number = numbers.setdefault
    bodies: dict[bytes, int] = {}
    least: list[int] = []
    for doc, _, _, body in group:
        k = bodies.setdefault(body, len(least))
        if k == len(least):
            least.append(doc)
        elif doc < least[k]:
            least[k] = doc
    ids, counts = [], []
    for body in bodies:
        w = [number(x, len(numbers)) for x in body.split(b" ")]
        ids += w
        counts.append(len(w) - window + 1)
    ids, counts, least = np.array(ids, ">u4"), np.array(counts, np.int64), np.array(least, np.int64)
    owner = np.repeat(np.arange(len(counts)), counts)
    before = np.cumsum(counts) - counts
    inner = np.arange(len(owner)) - before[owner]
    starts = inner + before[owner] + owner * (window - 1)
    order, lcp = suffix_array(ids, starts, window)
    node = np.cumsum(np.concatenate([[0], lcp < window]))  # leaves below one inner node of that depth
    docs = least[owner[order]]
    lowest = np.full(node[-1] + 1, LAST)
    np.minimum.at(lowest, node, docs)
    first = np.zeros(len(order), bool)
    first[order] = docs == lowest[node]
    s, e = c.stretches(owner, first)
    o, a, b = owner[s], inner[s], inner[e - 1] + 1
    by_body: dict[int, list[tuple[int, int]]] = {}
    for k, x, y in zip(o.tolist(), a.tolist(), b.tolist()):
        by_body.setdefault(k, []).append((x, y))
    out = [(row, at + x, at + y) for doc, row, at, body in group if doc == least[k := bodies[body]] for x, y in by_body.get(k, ())]
    return tuple(np.array(out, np.int64).reshape(-1, 3).T)


def suffix_array(ids: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of suffixes by their first ``depth`` big-endian numbers, and the common prefix of neighbours, at most depth."""
    rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(ids, depth)[starts])
    order = np.argsort(rows.view(np.dtype((np.void, 4 * depth))).ravel(), kind="stable")
    rows = rows[order]
    differ = rows[1:] != rows[:-1]
    return order, np.where(differ.any(1), differ.argmax(1), depth)


def _cut(window: int, gram: int, own: tuple[str, ...], verbatim: bool):
    def cut(batches):
        import pyarrow as pa

        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            kept, counts, spans, size, first = [], [], [], 0, 0
            texts = c.unpacked(batch.column("packed"))
            parts = [c.list_rows(batch.column(x), np.int64) for x in ("prefixes", "starts", "ends")]
            for i, (b, prefixes, starts, ends) in enumerate(zip(texts, *parts)):
                low, again = _undecided(b, prefixes.view(c.U64), window, gram)
                again &= ~c.cover(len(low), starts, ends)
                s, e = c.mask_runs(again)
                s, e = c.runs_of(s, e + window - 1)
                spans.append([{"start": x, "end": y} for x, y in zip(s.tolist(), e.tolist())])
                if verbatim:
                    begin, end = c.word_spans(b)
                    counts.append(len(begin))
                    kept.append(b[~c.cover(len(b), begin[s], end[e - 1])].tobytes() if len(s) else b.tobytes())
                else:
                    words = b.tobytes().split()
                    counts.append(len(words))
                    left, at = [], 0
                    for x, y in zip(s.tolist(), e.tolist()):
                        left += words[at:x]
                        at = y
                    kept.append(b" ".join(left + words[at:] if at else words))
                size += len(kept[-1])
                if size > 4 << 20 or i + 1 == len(texts):
                    part = slice(first, i + 1)
                    cols = [*(batch.column(x)[part] for x in own), pa.array(kept, pa.binary()), pa.array(counts, pa.int64()), pa.array(spans, pa.list_(span))]
                    yield pa.RecordBatch.from_arrays(cols, [*own, "kept", "n_words", "removed"])
                    kept, counts, spans, size, first = [], [], [], 0, i + 1

    return cut


def op10_suffix_tree_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return repeated_passages(c.read_table(spark, sf_dir, "documents")).select("doc_id", "n_words", n_removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))
