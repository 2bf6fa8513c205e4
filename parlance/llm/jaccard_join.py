"""Similarity join of n-gram sets by exact Jaccard similarity: a size-aware heavy-light join.

Documents with equal sets are one class.  Two classes link when
``den * |intersection| >= num * |union|``.  A set of n members can lose at most
``n - ceil(n * num / den)`` of them to a partner, which gives two exact ways to meet:

* small sets (at most ``boundary`` members) enumerate their subsets of each fixed
  size that a partner may share; linked sets have such a subset in common;
* large sets, and small ones near the boundary, enter the inverted lists of their
  first members in one global order; linked sets share one of those.

The boundary is chosen by cost: the subsets that sets of a size would emit, against
the lengths of the lists that they would scan.  The global order is by fingerprint,
but the ``common`` most frequent members come last, so that a line which a tenth of
all documents share is no list.  That list has a fixed bound; it changes cost only.

Lists with the same members give the same pairs, so one of them stands for all.
Long lists of a group of near copies have almost the same members: those with equal
values of two min-hashes are merged, which keeps all their pairs and makes one list
of dozens.  Members are compared by sketches: a bitmap in which each member of a set
flips one bit.  Two sketches differ in at most as many bits as the sets in members, so
a pair whose sketches differ in too many can't link.

In the first round a list is dealt to blocks of about ``tile`` members, and a long
one a second time by another hash.  A block yields a spanning forest of the pairs
that remain, closest first; whole texts verify them exactly.  Pairs left out of a
block's forest join classes which it connects already, unless an edge of it fails.
So the second round takes the lists in which an edge failed, and long ones that lie
in several components still, and verifies each pair between two components that
isn't refuted yet.  There, only members outside a list's largest component visit
all of its blocks, which are larger (``wide`` members), since a block's comparisons cost
less than the rows that visit it.  No link is lost.  A group whose members aren't
linked still has all its pairs of sketches compared, within blocks.

Null, empty and blank texts have the empty set, which links with nothing.  Texts of
fewer words than n are one whole shingle.  Rows with a null doc_id get a component
too; only non-null ids can be its name.  Classes named by the same least doc_id
(a repeated id with other text) count as one; repeated rows are one class.  Texts of any
length are read whole.  Other columns aren't read.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import _common as c
from parlance.llm.components import components

SHINGLE, NUM, DEN = 3, 90, 100
#: Members that come last in the global order, and how frequent they are at least.
COMMON, COMMON_LEAST = 100_000, 40
TILE = 256
WIDE = 2048
SKETCH_WORDS = 4
#: Bits of a sketch for each member in which two linked sets of that size can differ.
SKETCH_BITS = 4.5
MAX_SUBSETS = 64
#: Sets that a task which verifies pairs keeps at hand, in bytes.
CACHE_BYTES = 1 << 24


def shingle_set(b: np.ndarray, k: int) -> np.ndarray:
    """The ordered fingerprints of the distinct shingles of k words, A-Z lower-cased."""
    h = c.word_hashes(c.ASCII_LOWER[b])
    if not len(h):
        return h
    k = min(k, len(h))
    n = len(h) - k + 1
    out = np.full(n, k, c.U64)
    for i in range(k):
        out = c.mix(out * c.U64(c.BASE) + h[i : i + n])
    return np.unique(out)


def most_lost(n: int, num: int, den: int) -> int:
    """Members that a set of n may lose to a set it links with."""
    return n - -(-n * num // den)


def sketch(s: np.ndarray, num: int, den: int) -> np.ndarray:
    """A bitmap in which each member flips a bit; it's doubled until it tells unlike sets of this size apart."""
    size, differ = 64 * SKETCH_WORDS, 2 * len(s) * (den - num) / (den + num)
    while size < SKETCH_BITS * differ:
        size *= 2
    bits = np.bincount((s & c.U64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(c.U64)


def folded(sketches: list[np.ndarray], words: int) -> np.ndarray:
    """Sketches as if made with so many words: those that are longer, folded in halves."""
    out = np.zeros((len(sketches), words), c.U64)
    for i, x in enumerate(sketches):
        out[i] = np.bitwise_xor.reduce(x.reshape(-1, words), 0) if len(x) >= words else 0
    return out


def subsets(s: np.ndarray, lost: int) -> np.ndarray:
    """Fingerprints of the subsets that leave out up to ``lost`` members."""
    terms = c.mix(s * c.U64(c.BASE))
    sums, last = np.array([terms.sum()]), np.array([-1])
    out = [sums + c.U64(len(s))]
    for k in range(1, lost + 1):
        grown = [(sums[i] - terms[last[i] + 1 :], np.arange(last[i] + 1, len(s))) for i in range(len(sums))]
        sums, last = (np.concatenate(x) for x in zip(*grown))
        out.append(sums + c.U64(len(s) - k))
    return c.mix(np.unique(np.concatenate(out)))


def _each_set(docs: DataFrame, k: int, f, schema: str) -> DataFrame:
    """f(row keys, doc ids, sets) gives Arrow columns for each batch of documents."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        import pyarrow as pa

        for batch in c.slices(batches):
            sets = [shingle_set(b, k) for b in c.binary_rows(batch.column("body"))]
            yield pa.RecordBatch.from_arrays(f(pa, batch.column("row"), batch.column("doc_id"), sets), names)

    texts = docs.select(c.row_key().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("body"))
    return texts.mapInArrow(c.released(run), schema)


def _lists(pa, rows: list[np.ndarray]):
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int32)), pa.array(c.signed(np.concatenate([*rows, np.zeros(0, c.U64)]))))


def _classes(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(row, doc_id, class, n, head): the class of a set, and its first members by fingerprint."""

    def cols(pa, row, doc, sets):
        import xxhash

        heads = [s[: most_lost(len(s), num, den) + 1] for s in sets]
        return [row, doc, pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), _lists(pa, heads)]

    return _each_set(docs, k, cols, "row long, doc_id long, class binary, n long, head array<long>")


def _signatures(docs: DataFrame, k: int, num: int, den: int, boundary: int, common: np.ndarray) -> DataFrame:
    """(row, n, keys, sketch): what a set meets its partners by."""
    ratio = Fraction(num, den)

    def keys(s):
        n = len(s)
        lost = most_lost(n, num, den)
        out = []
        if n and n <= boundary:
            # A set that may lose no member can still be contained in a larger one that may.
            out.append(subsets(s, lost) if lost or n * den // num > n else s[:0])
        if n > math.ceil(boundary * ratio) - 1:
            late = c.is_in(s, common)
            out.append(np.concatenate([s[~late], s[late]])[: lost + 1])
        return np.unique(np.concatenate(out)) if out else s[:0]

    def cols(pa, row, doc, sets):
        return [row, pa.array([len(s) for s in sets], pa.int64()), _lists(pa, [keys(s) for s in sets]), pa.array([sketch(s, num, den).tobytes() for s in sets], pa.binary())]

    return _each_set(docs, k, cols, "row long, n long, keys array<long>, sketch binary")


def boundary_by_cost(sizes: list[tuple[int, int, int]], num: int, den: int, most: int = MAX_SUBSETS) -> int:
    """The largest size up to which enumerating subsets costs less than scanning lists.

    ``sizes`` has (set size, sets, sum of the lengths of the lists of their first members).
    """
    best, saved, total = 0, 0, 0
    for n, sets, scans in sorted(sizes):
        emitted = sum(math.comb(n, i) for i in range(most_lost(n, num, den) + 1))
        if emitted > most:
            break
        total += scans - sets * emitted
        if total >= saved:
            best, saved = n, total
    return best


def similar_sets(docs: DataFrame, shingle: int = SHINGLE, num: int = NUM, den: int = DEN, tile: int = TILE, wide: int = WIDE, common: int = COMMON, boundary: int | None = None) -> DataFrame:
    """Rows (row, doc_id, n_shingles, component_id), one a row of ``docs``."""
    if not 0 < num <= den or shingle < 1:
        raise ValueError("the threshold must be in (0, 1] and shingles have a word at least")
    sets = c.stored(_classes(docs, shingle, num, den))
    # The member with the least doc_id speaks for a class; where all ids are null, a fingerprint names it.
    classes = sets.groupBy("class").agg(F.min("doc_id").alias("id"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("m"), F.max("n").alias("n"))
    classes = c.stored(classes.select("class", F.coalesce("id", F.xxhash64("class")).alias("node"), F.col("m.row").alias("row"), "n"))
    # In one pass: a row for each frequent key, and one for all others.
    lists = sets.select(F.explode("head").alias("key")).groupBy("key").agg(F.count("*").alias("length"))
    frequent = F.when(F.col("length") >= COMMON_LEAST, F.col("key")).alias("key")
    lists = c.stored(lists.groupBy(frequent).agg(F.sum("length").alias("length"), F.sum(F.col("length") * F.col("length")).alias("scans")))
    top = lists.filter("key IS NOT NULL").orderBy(F.desc("length"), "key").limit(common)
    late = np.sort(np.array([r.key for r in top.collect()], np.int64).view(c.U64))
    if boundary is None:
        per = sets.filter(F.col("n") <= MAX_SUBSETS).groupBy("n").agg(F.count("*").alias("sets"), F.sum(F.size("head")).alias("heads")).collect()
        scan = lists.filter("key IS NULL").agg(F.sum("scans") / F.sum("length")).first()[0] or 1
        boundary = boundary_by_cost([(r.n, r.sets, int(r.heads * scan)) for r in per], num, den)
    # Only one row of each class goes on.
    speakers = classes.filter("n > 0").select("row", "node").groupBy("row").agg(F.min("node").alias("node"))
    signed = c.stored(_signatures(docs, shingle, num, den, boundary, late).filter(F.size("keys") > 0).dropDuplicates(["row"]).join(speakers, "row"))
    members = c.stored(_lists_of(signed, tile))

    pairs = c.stored(_forests(members, num, den, tile))
    edges = _verified(docs, pairs.drop("key").distinct(), shingle, num, den)
    found = components(edges.filter("linked"))
    bad = edges.filter("NOT linked").select("a", "b")
    again = pairs.join(bad, ["a", "b"]).select("key").unionByName(members.filter(F.col("length") > tile).select("key")).distinct()
    if again.limit(1).count():
        again = members.select("key", "node", "row", "n").join(again, "key", "left_semi")
        more = _between_components(again, signed.select("row", "sketch"), found, num, den, wide)
        more = more.drop("key").distinct().join(bad, ["a", "b"], "left_anti")
        more = _verified(docs, more, shingle, num, den)
        found = components(edges.unionByName(more).filter("linked"))
    ids = classes.select("class", "node", F.col("node").alias("own")).join(found, "node", "left")
    out = sets.select("row", "doc_id", "n", "class").join(ids.select("class", F.coalesce("component", "own").alias("component")), "class")
    # A component is named by its least doc_id; a fingerprint that stands for null ids is no name.
    named = out.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    name = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.join(named, "component").select("row", "doc_id", F.col("n").alias("n_shingles"), name.alias("component_id"))


def _lists_of(signed: DataFrame, tile: int) -> DataFrame:
    """(key, length, node, row, n, sketch): the members of the lists that more than one set is in."""
    postings = signed.select(F.explode("keys").alias("key"), "row")
    # Most keys are one set's only. They go before anything is counted but how many sets have them.
    several = c.stored(postings.groupBy("key").agg(F.count("*").alias("sets")).filter("sets > 1").select("key"))
    postings = c.stored(postings.join(several, "key", "left_semi"))
    # Two independent fingerprints of all members, and two min-hashes of them.
    hashes = [F.xxhash64("row", F.lit(i)) for i in range(4)]
    named = postings.groupBy("key").agg(
        F.count("*").alias("length"), F.bit_xor(hashes[0]).alias("x"), F.bit_xor(hashes[1]).alias("y"), F.min(hashes[2]).alias("u"), F.min(hashes[3]).alias("v")
    )
    named = c.stored(named)
    short = named.filter(F.col("length") <= tile).groupBy("length", "x", "y").agg(F.min("key").alias("key")).select("key", "length")
    short = postings.join(short, "key").select("key", "length", "row")
    least = named.filter(F.col("length") > tile).groupBy("u", "v").agg(F.min("key").alias("least"), F.collect_list("key").alias("keys"))
    long = postings.join(least.select(F.explode("keys").alias("key"), "least"), "key").select(F.col("least").alias("key"), "row").distinct()
    long = c.stored(long)
    long = long.join(long.groupBy("key").agg(F.count("*").alias("length")), "key").select("key", "length", "row")
    return short.unionByName(long).join(signed.select("row", "node", "n", "sketch"), "row").select("key", "length", "node", "row", "n", "sketch")


TILE_COLUMNS = ("key", "i", "j", "node", "row", "n", "sketch", "component", "side")
PAIR_SCHEMA = "key long, a long, row_a long, b long, row_b long"
#: How a row takes part in a tile: residents meet visitors; where all are peers, each meets each.
RESIDENT, VISITOR, PEER = 0, 1, 2


def _dealt(salt, blocks):
    return F.pmod(F.xxhash64("node", salt), blocks).cast("int")


def _forests(members: DataFrame, num: int, den: int, tile: int) -> DataFrame:
    """Pairs (key, a, row_a, b, row_b) of classes: spanning forests of the blocks of lists."""
    blocks = F.ceil(F.col("length") / tile).cast("int")
    deals = F.when(F.col("length") > tile, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    df = members.withColumn("j", F.explode(deals)).withColumn("i", _dealt("j", blocks))
    df = df.withColumn("component", F.lit(0).cast("long")).withColumn("side", F.lit(PEER))
    return _compared(df, num, den, forest=True)


def _between_components(members: DataFrame, sketches: DataFrame, found: DataFrame, num: int, den: int, tile: int) -> DataFrame:
    """All pairs of a list that lie in two components and aren't refuted by their sketches, which only what is left of the lists gets."""
    df = members.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    parts = df.groupBy("key", "component").agg(F.count("*").alias("m"))
    lists = parts.groupBy("key").agg(F.max(F.struct("m", "component")).alias("top"), F.sum("m").alias("length"), F.count("*").alias("parts")).filter("parts > 1")
    df = df.join(lists.select("key", "length", F.col("top.component").alias("main"), (F.col("length") - F.col("top.m")).alias("rest")), "key")
    blocks, visits = (F.ceil(F.col(x) / tile).cast("int") for x in ("length", "rest"))
    place = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    resident = F.transform(F.sequence(F.lit(0), visits - 1), lambda j: place(_dealt(F.lit(0), blocks), j, RESIDENT))
    visitor = F.transform(F.sequence(F.lit(0), blocks - 1), lambda i: place(i, _dealt(F.lit(2), visits), VISITOR))
    places = F.when(F.col("length") <= tile, F.array(place(F.lit(0), F.lit(0), PEER)))
    places = places.when(F.col("component") == F.col("main"), resident).otherwise(F.concat(resident, visitor))
    df = df.join(sketches, "row").withColumn("place", F.explode(places)).select("*", "place.*")
    return _compared(df, num, den, forest=False)


def _compared(df: DataFrame, num: int, den: int, forest: bool) -> DataFrame:
    spread = df.select(*TILE_COLUMNS).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return spread.mapInArrow(c.released(_tiles(num, den, forest)), PAIR_SCHEMA)


def _tiles(num: int, den: int, forest: bool):
    def tiles(batches):
        import pyarrow as pa

        out: list[tuple] = []

        def flush():
            rows = list(dict.fromkeys(out))
            out.clear()
            cols = list(zip(*rows)) or [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], ["key", "a", "row_a", "b", "row_b"])

        def compare(group, key):
            if len(group) < 2:
                return
            node, row, n, comp, side = (np.array([g[x] for g in group], np.int64) for x in (0, 1, 2, 4, 5))
            o = np.argsort(n, kind="stable")
            node, row, n, comp, side = node[o], row[o], n[o], comp[o], side[o]
            sketches = [np.frombuffer(group[i][3], c.U64) for i in o.tolist()]
            bits = {w: folded(sketches, w) for w in {len(x) for x in sketches}}
            upto = np.searchsorted(n, n * den // num, side="right")
            left, right, far = [], [], []
            for x in range(len(n) - 1):
                ys = np.arange(x + 1, upto[x])
                if not forest:
                    ys = ys[(comp[ys] != comp[x]) & ((side[x] == PEER) | (side[ys] != side[x]))]
                if not len(ys):
                    continue
                same = bits[len(sketches[x])]  # larger sets have no shorter sketches
                d = np.bitwise_count(same[ys] ^ same[x]).sum(1, dtype=np.int64)
                both = n[x] + n[ys]
                may = d <= both - 2 * (-(-both * num // (num + den)))
                left.append(np.full(may.sum(), x))
                right.append(ys[may])
                far.append(d[may])
            if not left:
                return
            left, right, far = map(np.concatenate, (left, right, far))
            if forest:
                o = np.lexsort((node[right], node[left], far))
                root = list(range(len(n)))

                def top(v):
                    while root[v] != v:
                        root[v] = v = root[root[v]]
                    return v

                for x, y in zip(left[o].tolist(), right[o].tolist()):
                    p, q = top(x), top(y)
                    if p != q:
                        root[p] = q
                        add(key, node, row, x, y)
            else:
                for x, y in zip(left.tolist(), right.tolist()):
                    add(key, node, row, x, y)

        def add(key, node, row, x, y):
            if node[x] != node[y]:
                x, y = (x, y) if node[x] < node[y] else (y, x)
                out.append((key, int(node[x]), int(row[x]), int(node[y]), int(row[y])))

        group, key = [], None
        for batch in batches:
            for *k, node, row, n, bits, comp, side in zip(*(batch.column(x).to_pylist() for x in TILE_COLUMNS)):
                if k != key:
                    if group:
                        compare(group, key[0])
                    group, key = [], k
                    if len(out) > 50_000:
                        yield flush()
                group.append((node, row, n, bits, comp, side))
        if group:
            compare(group, key[0])
        yield flush()

    return tiles


def _verified(docs: DataFrame, pairs: DataFrame, shingle: int, num: int, den: int) -> DataFrame:
    """(a, b, linked) for pairs, by the whole texts of the two classes."""
    pairs = c.stored(pairs)
    ends = pairs.select(F.explode(F.array("row_a", "row_b")).alias("row")).distinct()
    texts = c.stored(c.packed_texts(docs).join(ends, "row").dropDuplicates(["row"]))
    df = pairs.join(texts.select(F.col("row").alias("row_a"), F.col("packed").alias("text_a")), "row_a")
    df = df.join(texts.select(F.col("row").alias("row_b"), F.col("packed").alias("text_b")), "row_b")

    def verify(batches):
        import pyarrow as pa

        raw = c.unpacker()
        kept: dict[int, np.ndarray] = {}
        held = 0

        def set_of(row: int, packed: np.ndarray) -> np.ndarray:
            nonlocal held
            if row not in kept:
                if held > CACHE_BYTES:
                    kept.clear()
                    held = 0
                kept[row] = shingle_set(raw(packed), shingle)
                held += kept[row].nbytes
            return kept[row]

        for batch in batches:
            rows = (batch.column(x).to_pylist() for x in ("row_a", "row_b"))
            texts = (c.binary_rows(batch.column(x)) for x in ("text_a", "text_b"))
            linked = []
            for a, b, text_a, text_b in zip(*rows, *texts):
                x, y = set_of(a, text_a), set_of(b, text_b)
                both = int(c.is_in(x, y).sum())
                linked.append(den * both >= num * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    return c.stored(df.select("a", "b", "row_a", "row_b", "text_a", "text_b").mapInArrow(c.released(verify), "a long, b long, linked boolean"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_sets(c.read_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
