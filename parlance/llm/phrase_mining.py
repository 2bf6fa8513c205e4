"""Phrase collocations by hierarchical pair naming.

Level by level, adjacent frequent (k-1)-grams are replaced by the name of their pair:

1. Texts are cut into words and packed into blocks; a block holds its text as numbers of its
   distinct words, by language, and sends these with their counts, packed, to the
   buckets of a hash.  A bucket adds up the counts of all blocks and names the frequent words.
2. The names go back to the blocks that have them.  Neighbours that are both frequent
   (k-1)-grams are one k-gram; a block sends its distinct pairs of names to the buckets, which
   name the frequent ones, and so on up to ``LONGEST`` words.

A phrase that occurs ``LEAST`` times has parts that occur as often, so no candidate is missed, and
a pair's two names are pointers to its parents.  Counts of first and last parts, which the cuts need, are
handed down along the pointers, and what a longer phrase covers is looked up by its
pointers: a phrase in a longer one is also in a parent of it that occurs at least as often.

What is shuffled is a block's distinct words and pairs, not their places, so a very frequent
word or phrase is one entry a block.  Blocks hold about ``BLOCK_BYTES`` of text, or one text if it's longer, and
there is a bucket for each ``BUCKET_BYTES`` of all text, so a bucket's entries stay about as many at any size.
The best of each language are taken from groups of at most about ``GROUP`` candidates
first, so no language is sorted in one task.  Counts cover all documents, copies and repeated rows too.

A null text is empty, a null language is ``und`` (and the same as that name); an empty
language is its own.  Empty tables, texts without words and columns with any other names do no harm.
Scores are exact whole numbers (decimals of 38 digits).  Rows with equal score and count are ordered by their phrase in UTF-8.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.llm import _common as c

LEAST, LONGEST, TOP = 30, 4, 2000
COVERED = (80, 100)
SCALE = 2_000_000
BLOCK_BYTES, BUCKET_BYTES = 8 << 20, 24 << 20
GROUP = 200_000
UNKNOWN = "und"

_FORM = c.ASCII_LOWER.copy()
_FORM[0x09] = 0x20
_FORM[[0x2E, 0x2C, 0x3B, 0x3A, 0x21, 0x3F, *range(0x0A, 0x0E)]] = 0x0A
#: A block's text (``seq``, in a row of its own), or what it sends to a bucket: words of a language or pairs of names
#: (packed), and how often it has each and all; ``base`` is the number of the first.  A level has either words or pairs.
LEVEL = "block long, seq binary, bucket int, lang string, base int, words binary, lefts binary, rights binary, counts binary, total long"
#: What a bucket names, and what it sends back to a block: the numbers of the frequent ones and their names.
NAMES = "block long, numbers binary, ids binary, named array<struct<id:long,lang:string,word:string,left:long,right:long,f:long>>"


def packed(x: np.ndarray) -> bytes:
    """Whole numbers, compressed by planes of equal weight."""
    import zstandard

    x = np.ascontiguousarray(x)
    return zstandard.ZstdCompressor(level=3).compress(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes())


def unpacked(b: bytes, kind=np.int64) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _batch(schema: str, rows: list[dict]):
    import pyarrow as pa

    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    named = pa.list_(pa.struct([("id", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("left", pa.int64()), ("right", pa.int64()), ("f", pa.int64())]))
    columns = [x.split(" ", 1) for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(x) for r in rows], kinds.get(t, named)) for x, t in columns], [x for x, _ in columns])


def _words(x: np.ndarray):
    """(words as an Arrow dictionary array, their starts) of bytes in ``_FORM``."""
    import pyarrow as pa

    inside = (x != 0x20) & (x != 0x0A)
    starts, ends = c.mask_runs(inside)
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(x[inside].tobytes())])
    return words.dictionary_encode(), starts


def _ranked(bucket: np.ndarray, *then: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order by bucket and the other keys, rank of each, where another bucket or first other key starts)."""
    order = np.lexsort((*then[::-1], bucket))
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    return order, rank, bucket[order]


def word_rows(texts: list[np.ndarray], langs: list[str], block: int, buckets: int) -> list[dict]:
    """The rows of a block of texts: -1 in its seq is a cut between pieces."""
    raw = np.frombuffer(b"\n".join(x.tobytes() for x in texts), np.uint8)
    x = _FORM[raw]
    coded, starts = _words(x)
    piece = np.cumsum(x == 0x0A, dtype=np.int32)[starts]
    document = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, side="right")
    known = sorted(set(langs))
    number = {y: i for i, y in enumerate(known)}
    of_doc = np.array([number[y] for y in langs], np.int64)
    size = max(1, len(coded.dictionary))
    found, place, n = np.unique(of_doc[document] * size + np.asarray(coded.indices), return_inverse=True, return_counts=True)
    lang, word = np.divmod(found, size)
    distinct = [y.as_py() for y in coded.dictionary]
    bucket = np.array([zlib.crc32(y) for y in distinct], np.int64)[word] % buckets if len(word) else word
    order, rank, of = _ranked(bucket, lang)
    seq = rank[place]
    seq = np.insert(seq, np.flatnonzero(piece[1:] != piece[:-1]) + 1, -1)
    rows = [{"block": block, "seq": packed(seq)}]
    key = of * len(known) + lang[order]
    for s, e in zip(*c.stretches(key, np.ones(len(key), bool))):
        some = order[s:e]
        rows.append({"block": block, "bucket": int(of[s]), "lang": known[lang[some[0]]], "base": int(s), "words": zlib.compress(b"\n".join([distinct[i] for i in word[some].tolist()]), 1), "counts": packed(n[some]), "total": int(n[some].sum())})
    return rows


def word_level(docs: DataFrame, block_bytes: int, buckets: int) -> DataFrame:
    def pack(batches):
        from pyspark import TaskContext

        block, texts, langs, held = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in c.slices(batches):
            for text, lang in zip(c.binary_rows(batch.column("body")), batch.column("lang").to_pylist()):
                texts.append(text.copy())
                langs.append(lang)
                held += len(text) + 1
                if held >= block_bytes:
                    yield _batch(LEVEL, word_rows(texts, langs, block, buckets))
                    block, texts, langs, held = block + 1, [], [], 0
        if texts:
            yield _batch(LEVEL, word_rows(texts, langs, block, buckets))

    rows = docs.select(F.coalesce("text", F.lit("")).cast("binary").alias("body"), F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"))
    return rows.mapInArrow(c.released(pack), LEVEL)


def pair_rows(at: np.ndarray, numbers: np.ndarray, ids: np.ndarray, block: int, buckets: int, last: bool) -> list[dict]:
    """A block's rows of the next level: its pairs of neighbours that are both frequent."""
    frequent = np.zeros(max(int(at.max(initial=-1)), int(numbers.max(initial=-1))) + 2, bool)  # its last place is for cuts, -1
    frequent[numbers] = True
    name = np.zeros(len(frequent), np.int64)
    name[numbers] = ids
    both = frequent[at[:-1]] & frequent[at[1:]]
    key = at[:-1].astype(np.int64)[both] * len(frequent) + at[1:][both]
    found, place, n = np.unique(key, return_inverse=True, return_counts=True)
    left, right = (name[x] for x in np.divmod(found, len(frequent)))
    bucket = (c.mix(left.view(c.U64) * c.U64(c.BASE) + right.view(c.U64)) % c.U64(buckets)).astype(np.int64)
    order, rank, of = _ranked(bucket, left, right)
    rows = []
    if not last and len(found):
        seq = np.full(len(both), -1, np.int32)
        seq[both] = rank[place]
        rows.append({"block": block, "seq": packed(seq[both | np.concatenate([[True], both[:-1]])])})  # a run of cuts is one
    for s, e in zip(*c.stretches(of, np.ones(len(of), bool))):
        some = order[s:e]
        rows.append({"block": block, "bucket": int(of[s]), "base": int(s), "lefts": packed(np.diff(left[some], prepend=0)), "rights": packed(right[some]), "counts": packed(n[some])})
    return rows


def pair_level(level: DataFrame, names: DataFrame, buckets: int, last: bool) -> DataFrame:
    def pair(texts, known):
        import pyarrow as pa

        if not texts.num_rows or not known.num_rows:
            return pa.Table.from_batches([_batch(LEVEL, [])])
        numbers, ids = (np.concatenate([unpacked(b) for b in known.column(x).to_pylist()]) for x in ("numbers", "ids"))
        rows = pair_rows(unpacked(texts.column("seq")[0].as_py(), np.int32), numbers, ids, texts.column("block")[0].as_py(), buckets, last)
        return pa.Table.from_batches([_batch(LEVEL, rows)])

    texts = level.filter("seq IS NOT NULL").select("block", "seq")
    known = names.filter("block IS NOT NULL").select(F.col("block").alias("home"), "numbers", "ids")
    return texts.groupBy("block").cogroup(known.groupBy("home")).applyInArrow(pair, LEVEL)


def _same(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(the number of each row's distinct key, the first row of each key), keys in ascending order."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for x in columns:
        new[1:] |= x[order[1:]] != x[order[:-1]]
    key = np.empty(len(order), np.int64)
    key[order] = np.cumsum(new) - 1
    return key, order[new]


def named(level: DataFrame, least: int, words: bool) -> DataFrame:
    """The frequent words or pairs of a level by name, and for each block which of its own they are (see ``NAMES``)."""

    def name(key, rows):
        import pyarrow as pa

        # In the order of blocks, so that a bucket that is made again has the same names.
        rows = rows.sort_by([("block", "ascending"), ("base", "ascending")]).to_pydict()
        counts = [unpacked(b) for b in rows["counts"]]
        n = np.concatenate(counts)
        at = np.concatenate([[0], np.cumsum([len(x) for x in counts])])
        if words:
            lists = [zlib.decompress(b).split(b"\n") for b in rows["words"]]
            flat = [w for x in lists for w in x]
            coded = pa.array(flat, pa.binary()).dictionary_encode()
            langs = sorted(set(rows["lang"]))
            lang = np.repeat(np.array([langs.index(x) for x in rows["lang"]], np.int64), np.diff(at))
            columns = [lang, np.asarray(coded.indices).astype(np.int64)]
        else:
            columns = [np.concatenate([np.cumsum(unpacked(b)) for b in rows["lefts"]]), np.concatenate([unpacked(b) for b in rows["rights"]])]
        same, first = _same(columns)
        f = np.zeros(len(first), np.int64)
        np.add.at(f, same, n)
        frequent = np.flatnonzero(f >= least)
        ids = np.full(len(first), -1, np.int64)
        ids[frequent] = (int(key[0].as_py()) << 32) + np.arange(len(frequent))
        ids = ids[same]
        one = first[frequent]
        if words:
            entries = [{"id": i, "lang": langs[x], "word": flat[k].decode(), "f": y} for i, x, k, y in zip(ids[one].tolist(), columns[0][one].tolist(), one.tolist(), f[frequent].tolist())]
        else:
            entries = [{"id": i, "left": x, "right": z, "f": y} for i, x, z, y in zip(ids[one].tolist(), columns[0][one].tolist(), columns[1][one].tolist(), f[frequent].tolist())]
        out = [{"named": entries}]
        for block, base, s, e in zip(rows["block"], rows["base"], at[:-1].tolist(), at[1:].tolist()):
            hit = np.flatnonzero(ids[s:e] >= 0)
            if len(hit):
                out.append({"block": block, "numbers": packed(hit + base), "ids": packed(ids[s:e][hit])})
        return pa.Table.from_batches([_batch(NAMES, out)])

    sent = level.filter("bucket IS NOT NULL").select("bucket", "block", "lang", "base", "words", "lefts", "rights", "counts")
    return sent.groupBy("bucket").applyInArrow(name, NAMES)


def _enriched(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """Language, words and counts of all first and last parts of named pairs, from those of their parents."""
    left = parts.select(F.col("id").alias("left"), "lang", F.col("words").alias("lw"), F.col("f").alias("lf"), F.col("firsts").alias("l_firsts"))
    right = parts.select(F.col("id").alias("right"), F.col("words").alias("rw"), F.col("f").alias("rf"), F.col("lasts").alias("r_lasts"))
    return pairs.join(left, "left").join(right, "right").select(
        "id", "left", "right", "lang", "f", F.concat("lw", F.slice("rw", -1, 1)).alias("words"),
        F.concat("l_firsts", F.array("lf")).alias("firsts"), F.concat("r_lasts", F.array("rf")).alias("lasts"),
    )


#: The cut after k words has the counts of the first k words and of the remaining ones.
_CUT = """array_min(transform(sequence(1, size(firsts)), k -> struct(
  (CAST({scale} * CAST(f AS DECIMAL(19, 0)) AS DECIMAL(38, 0)) DIV CAST(CAST(firsts[k - 1] AS DECIMAL(19, 0)) + lasts[size(firsts) - k] AS DECIMAL(38, 0))) AS score,
  k AS cut, firsts[k - 1] AS l, lasts[size(firsts) - k] AS r)))"""


def candidates(
    docs: DataFrame, least: int = LEAST, longest: int = LONGEST, covered: tuple[int, int] = COVERED, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES
) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, a, cut, l, r, score) of all candidates that no longer one covers, (lang, n))."""
    mark = c.written()
    buckets = 1 + (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // bucket_bytes
    first = level = c.stored(word_level(docs, block_bytes, buckets))
    names = c.stored(named(level, least, words=True))
    nothing, empty = F.lit(None).cast("long"), F.array().cast("array<long>")
    words = names.select(F.explode("named").alias("x")).select("x.*")
    grams = words.select("id", nothing.alias("left"), nothing.alias("right"), "lang", "f", F.array("word").alias("words"), empty.alias("firsts"), empty.alias("lasts"))
    levels = []
    for k in range(2, longest + 1):
        level = c.stored(pair_level(level, names, buckets, last=k == longest))
        names = c.stored(named(level, least, words=False))
        pairs = names.select(F.explode("named").alias("x")).select("x.id", "x.left", "x.right", "x.f")
        grams = c.stored(_enriched(pairs, grams))
        levels.append(grams)
    num, den = covered
    found = None
    for i, grams in enumerate(levels):
        if i + 1 < len(levels):
            inside = [levels[i + 1].select(F.col(x).alias("id"), F.col("f").alias("longer")) for x in ("left", "right")]
            most = inside[0].unionByName(inside[1]).groupBy("id").agg(F.max("longer").alias("longer"))
            keeps = F.col("longer").isNull() | (F.col("longer").cast("decimal(19,0)") * den < F.col("f").cast("decimal(19,0)") * num)
            grams = grams.join(most, "id", "left").filter(keeps)
        part = grams.select("lang", "words", "f", F.expr(_CUT.format(scale=SCALE)).alias("x")).select("lang", F.concat_ws(" ", "words").alias("phrase"), F.col("f").alias("a"), "x.cut", "x.l", "x.r", "x.score")
        found = part if found is None else found.unionByName(part)
    found = c.stored(found)
    sizes = c.stored(first.filter("bucket IS NOT NULL").groupBy("lang").agg(F.sum("total").alias("n")))
    c.clear_stored(docs.sparkSession, mark, but_last=2)
    return found, sizes


def collocations(docs: DataFrame, top: int = TOP, group: int = GROUP, **how) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score, cut): the first ``top`` phrases of each language."""
    found, sizes = candidates(docs, **how)
    best = (F.desc("score"), F.desc("a"), "phrase")
    groups = max(1, -(-found.count() // group))
    rank = F.row_number().over(Window.partitionBy("lang", "deal").orderBy(*best))
    some = found.withColumn("deal", F.pmod(F.xxhash64("phrase"), F.lit(groups))).withColumn("rank", rank).filter(F.col("rank") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")
    return some.withColumn("rank", rank).filter(F.col("rank") <= top).join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "cut")


def op13_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(c.read_table(spark, sf_dir, "documents")).drop("cut")


ORACLE_SQL = rf"""
WITH d AS (SELECT coalesce(lang, '{UNKNOWN}') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS MATERIALIZED (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM (
  SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
g AS MATERIALIZED (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM (
  SELECT lang, k, w, unnest(range(1, greatest(len(w) - k + 2, 1))) AS i FROM p, (VALUES (1), (2), (3), (4)) t(k)) GROUP BY lang, k, phrase HAVING count(*) >= {LEAST}),
s AS (SELECT lang, k, phrase, f, string_split(phrase, ' ') AS w FROM g WHERE k > 1),
cuts AS (SELECT lang, k, phrase, f, c, array_to_string(w[1:c], ' ') AS first, array_to_string(w[c + 1:], ' ') AS rest FROM (SELECT *, unnest(range(1, k)) AS c FROM s)),
scored AS (SELECT x.lang, x.k, x.phrase, x.f AS a, x.c, l.f AS l, r.f AS r, ({SCALE}::HUGEINT * x.f // (l.f::HUGEINT + r.f))::BIGINT AS score
  FROM cuts x JOIN g l ON l.lang = x.lang AND l.phrase = x.first JOIN g r ON r.lang = x.lang AND r.phrase = x.rest),
one AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
parts AS (SELECT lang, f, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM (
  SELECT lang, f, w, m, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM s))),
longer AS (SELECT lang, phrase, max(f) AS most FROM parts GROUP BY lang, phrase),
kept AS (SELECT o.* FROM one o LEFT JOIN longer USING (lang, phrase) WHERE most IS NULL OR {COVERED[1]} * most < {COVERED[0]} * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN n USING (lang) WHERE rank <= {TOP}
"""
