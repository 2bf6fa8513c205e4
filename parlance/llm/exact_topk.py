"""Exact top-k inner products over vectors sorted by length, with rotated partial sums.

Candidates are dealt by descending length into packed blocks of rows, queries into blocks
of their own.  A block of candidates goes to several blocks of queries at once, and no side is broadcast
but the one block of the longest candidates (``BLOCK_BYTES`` twice at most), so both may grow.

1. Each block of queries meets the block of the longest candidates.  The k-th best score
   found there, with its id, is the floor of each query, and stays one for the rest.
2. A query q can find something in a block only if |q| times the block's longest vector
   reaches q's floor (Cauchy-Schwarz).  Pairs of blocks in which no query can are never
   made.  In the others, candidates come by descending length in strips.  Vectors are
   rotated by the right singular vectors of the candidates (from their Gram matrix,
   summed over all partitions), which gathers what matters in the first components:
   after h of them, the partial sum plus the lengths of what is left of both bounds q.v.
   A candidate whose bound is below the query's k-th best score so far is pruned; the
   rest get their exact integer score.
3. What reaches a query's floor is merged over the blocks.

Vectors that are null or hold a null, NaN or infinite component take no part, and
neither do rows with a null id.  Shorter vectors, empty ones too, count as zero beyond
their end.  Scores are exact integers at any size: where lengths don't rule out that a
sum passes 2**52, products are summed as whole numbers; a score beyond a long counts
as the largest or smallest long.
Ties go to the smaller id; rows with equal id are candidates of their own and rank
side by side, but none is a candidate for the query of its own id.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.llm import _common as c

K = 20
QUERY_BLOCK = 2048
BLOCK = 8192
#: Candidates that a task bounds at once.
STRIP = 1024
PARTIAL = 16
#: What a block of candidates may weigh (a block of queries a quarter), however wide its vectors; and how many blocks of
#: queries a task holds beside a block of candidates.
BLOCK_BYTES = 16 << 20
TOGETHER = 16
#: Tasks that sum the Gram matrix, each some of its rows.
GRAM_PARTS = 16
SCALE = 64
#: What rounding may add to a bound, as a share; and below which product of lengths doubles add exactly.
SLACK = 1e-6
EXACT = float(1 << 52)


def integer_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v array<double>) with v = floor(scale * x); rows that take no part are gone."""
    fine = F.col("embedding").isNotNull()
    x = F.transform("embedding", lambda e: e.cast("double"))
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return vectors.filter(F.col("vec_id").isNotNull() & fine & F.coalesce(finite, F.lit(False))).select("vec_id", F.transform(x, lambda e: F.floor(e * scale).cast("double")).alias("v"))


def _matrix(col, width: int | None = None) -> np.ndarray:
    rows = c.list_rows(col, np.float64)
    out = np.zeros((len(rows), width or max((len(r) for r in rows), default=0)))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _gram(vectors: DataFrame, width: int) -> np.ndarray:
    """The Gram matrix, summed within partitions, then row by row in ``GRAM_PARTS`` tasks; the driver takes one row a component."""

    def out(rows):
        import pyarrow as pa

        for i, g in rows:
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([g], pa.list_(pa.float64()))], ["i", "g"])

    def gram(batches):
        g = np.zeros((width, width))
        for batch in batches:
            m = _matrix(batch.column("v"), width)
            g += m.T @ m
        yield from out(enumerate(g))

    def sums(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, g in zip(batch.column("i").to_pylist(), c.list_rows(batch.column("g"), np.float64)):
                held[i] = held[i] + g if i in held else g.copy()
        yield from out(held.items())

    rows = vectors.select("v").mapInArrow(c.released(gram), "i int, g array<double>")
    rows = rows.repartition(GRAM_PARTS, "i").mapInArrow(c.released(sums), "i int, g array<double>").collect()
    whole = np.zeros((width, width))
    for r in rows:
        whole[r.i] = r.g
    return whole


def _blocks(vectors: DataFrame, rows: int, width: int, order) -> DataFrame:
    """(block, ids array<binary>, m array<binary>, longest): packed rows by the given order; block counts from 0.

    No block has twice ``rows`` vectors, the first has at least ``rows`` (or all), and there are about as many as that takes, into
    however many partitions Spark deals them: neighbouring pieces of partitions are put together by the running count of vectors before them, which is
    taken over one short row a piece.
    """
    n = vectors.count()
    parts = max(1, -(-n // rows))
    dealt = vectors.withColumn("len", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    dealt = dealt.repartitionByRange(parts, *order).sortWithinPartitions(*order) if parts > 1 else dealt.coalesce(1).sortWithinPartitions(*order)

    def pack(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, k, held, ids, ms = TaskContext.get().partitionId(), 0, 0, [], []

        def out():
            body = np.concatenate(ms)
            longest = float(np.sqrt((body * body).sum(1)).max())
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([k], pa.int32()), pa.array([len(body)], pa.int64()), pa.array([np.concatenate(ids).astype("<i8").tobytes()], pa.binary()), pa.array([body.astype("<f8").tobytes()], pa.binary()), pa.array([longest])],
                ["part", "k", "n", "ids", "m", "longest"],
            )

        for batch in batches:
            at = 0
            while at < len(batch):
                take = min(rows - held, len(batch) - at)
                ids.append(np.asarray(batch.column("vec_id")[at : at + take]))
                ms.append(_matrix(batch.column("v").slice(at, take), width))
                held, at = held + take, at + take
                if held == rows:
                    yield out()
                    k, held, ids, ms = k + 1, 0, [], []
        if ids:
            yield out()

    packed = c.stored(dealt.select("vec_id", "v").mapInArrow(c.released(pack), "part int, k int, n long, ids binary, m binary, longest double"))
    before = F.sum("n").over(Window.orderBy("part", "k").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    names = packed.select("part", "k", "n").withColumn("block", F.floor(before / rows).cast("int")).drop("n")
    pieces = packed.join(names, ["part", "k"]).groupBy("block").agg(F.array_sort(F.collect_list(F.struct("part", "k", "ids", "m"))).alias("p"), F.max("longest").alias("longest"))
    return pieces.select("block", F.col("p.ids").alias("ids"), F.col("p.m").alias("m"), "longest")


def top_k(queries: DataFrame, candidates: DataFrame, k: int = K, query_block: int = QUERY_BLOCK, block: int = BLOCK) -> DataFrame:
    """Rows (query_id, rank, vec_id, score) for (vec_id, v) tables of integer-valued vectors."""
    found = "query_id long, vec_id long, score long"
    wide = candidates.select(F.size("v").alias("n")).unionByName(queries.select(F.size("v").alias("n"))).agg(F.max("n")).first()[0]
    if wide is None:
        return queries.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    wide = max(1, wide)
    block = max(1, min(block, BLOCK_BYTES // (8 * wide)))
    query_block = max(1, min(query_block, BLOCK_BYTES // (32 * wide)))
    gram = _gram(candidates, wide)
    rotation = np.linalg.eigh(gram)[1][:, ::-1].copy() if np.isfinite(gram).all() else np.eye(wide)
    v = c.stored(_blocks(candidates, block, wide, [F.desc("len"), "vec_id"]))
    q = _blocks(queries, query_block, wide, ["vec_id"]).select(F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("m").alias("q_m"))
    shapes = (("q_ids", "<i8", -1), ("q_m", "<f8", (-1, wide)), ("ids", "<i8", -1), ("m", "<f8", (-1, wide)))

    def arrays(batch, names):
        cols = [(batch.column(x).to_pylist(), t, s) for x, t, s in shapes if x in names]
        for row in zip(*(x for x, _, _ in cols)):
            yield tuple(np.frombuffer(b"".join(x), t).reshape(s) for x, (_, t, s) in zip(row, cols))

    def seed(batches):
        """The k-th best score of each query in one block, and the least length that could still reach it."""
        import pyarrow as pa

        for batch in batches:
            for i, (q_ids, qm, ids, m) in enumerate(arrays(batch, {"q_ids", "q_m", "ids", "m"})):
                floor, last = floors(q_ids, qm, ids, m, k, rotation)
                size = np.sqrt((qm * qm).sum(1))
                reach = np.where(size > 0, (floor - SLACK * (1 + size)) / np.maximum(size, 1), np.where(floor > 0, np.inf, -np.inf))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("q_block").slice(i, 1), pa.array([floor.astype("<f8").tobytes()], pa.binary()), pa.array([last.astype("<i8").tobytes()], pa.binary()), pa.array([float(reach.min()) if len(reach) else np.inf])],
                    ["q_block", "floor", "last", "reach"],
                )

    def search(asked, held):
        import pyarrow as pa

        (ids, m), out = next(arrays(held, {"ids", "m"})), []
        for floor, last, row in zip(asked.column("floor").to_pylist(), asked.column("last").to_pylist(), arrays(asked, {"q_ids", "q_m"})):
            limits = np.frombuffer(floor, "<f8"), np.frombuffer(last, "<i8")
            out.append(best_of(*row, ids, m, k, rotation, limits))
        return pa.table([pa.array(np.concatenate(x), pa.int64()) for x in zip(*out)], ["query_id", "vec_id", "score"])

    longest = v.filter("block = 0").select("ids", "m")  # one row of fewer than twice ``block`` vectors
    floor = c.stored(q.join(F.broadcast(longest), F.lit(True)).select("q_block", "q_ids", "q_m", "ids", "m").mapInArrow(c.released(seed), "q_block int, floor binary, last binary, reach double"))
    # Each block of candidates meets those blocks of queries that it can reach, some at a time.
    meet = v.select("block", "longest").join(floor.select("q_block", "reach"), F.col("longest") * (1 + SLACK) >= F.col("reach"))
    meet = c.stored(meet.select("block", "q_block", F.floor(F.col("q_block") / TOGETHER).alias("some")))
    asked = meet.join(q, "q_block").join(floor.select("q_block", "floor", "last"), "q_block").select("block", "some", "q_ids", "q_m", "floor", "last")
    held = meet.select(F.col("block").alias("home"), F.col("some").alias("share")).distinct().join(v.select(F.col("block").alias("home"), "ids", "m"), "home")
    near = asked.groupBy("block", "some").cogroup(held.groupBy("home", "share")).applyInArrow(search, found)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def floors(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, m: np.ndarray, k: int, rotation: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Score and id of the k-th best of each query in a block; -inf where it has fewer."""
    query, found, score = best_of(q_ids, q, ids, m, k, rotation, None, rows=True)
    out, last = np.full(len(q), -np.inf), np.full(len(q), np.iinfo(np.int64).max)
    n = np.bincount(query, minlength=len(q))
    at = np.cumsum(n)
    full = n >= k
    out[full], last[full] = score[at[full] - 1], found[at[full] - 1]
    return out, last


def best_of(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, m: np.ndarray, k: int, rotation: np.ndarray, floor: tuple[np.ndarray, np.ndarray] | None = None, rows: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of each query's k best in one block that reach its floor, ties to the smaller id.

    At the floor's own score, an id must be at most the floor's, so that many equal vectors give no rows.

    With ``rows``, queries are named by their place.
    """
    length = np.sqrt((m * m).sum(1))
    order = np.lexsort((ids, -length))
    ids, m, length = ids[order], m[order], length[order]
    q_length = np.sqrt((q * q).sum(1))
    names = np.arange(len(q)) if rows else q_ids
    if len(ids) and len(q) and not q_length.max() * length[0] < EXACT:
        return _whole_numbers(q_ids, names, q, ids, m, k)
    h = min(PARTIAL, m.shape[1])
    rm, rq = m @ rotation, q @ rotation
    rest_m, rest_q = np.sqrt((rm[:, h:] ** 2).sum(1)), np.sqrt((rq[:, h:] ** 2).sum(1))
    slack = SLACK * (1 + q_length[:, None] * (length[0] if len(length) else 0))
    least, last = (np.full(len(q), -np.inf), np.full(len(q), np.iinfo(np.int64).max)) if floor is None else floor
    top_s = np.full((len(q), 0), -np.inf)
    top_i = np.zeros((len(q), 0), np.int64)
    for i in range(0, len(ids), STRIP):
        s = slice(i, i + STRIP)
        now = np.maximum(least, top_s[:, k - 1]) if top_s.shape[1] >= k else least
        live = np.flatnonzero(q_length * length[i] + slack[:, 0] >= now)
        if not len(live):
            break  # all that come later are shorter still
        bound = rq[live, :h] @ rm[s, :h].T + rest_q[live, None] * rest_m[None, s] + slack[live]
        may = bound >= now[live, None]
        some, cols = may.any(1), may.any(0)
        if not some.any():
            continue
        live, may = live[some], may[some][:, cols]
        score = q[live] @ m[s][cols].T
        tied = (score == least[live, None]) & (ids[s][cols][None] <= last[live, None])
        may &= (tied | (score > least[live, None])) & (q_ids[live, None] != ids[s][cols][None])
        score = np.where(may, score, -np.inf)
        both_s = np.concatenate([top_s[live], score], 1)
        both_i = np.concatenate([top_i[live], np.broadcast_to(ids[s][cols], score.shape)], 1)
        take = np.lexsort((both_i, -both_s))[:, :k] if both_s.shape[1] <= 2 * k else _best(both_s, both_i, k)
        new_s, new_i = np.take_along_axis(both_s, take, 1), np.take_along_axis(both_i, take, 1)
        if new_s.shape[1] > top_s.shape[1]:
            grow = new_s.shape[1] - top_s.shape[1]
            top_s = np.pad(top_s, ((0, 0), (0, grow)), constant_values=-np.inf)
            top_i = np.pad(top_i, ((0, 0), (0, grow)))
        top_s[live], top_i[live] = new_s, new_i
    fine = np.isfinite(top_s)
    return np.repeat(names, fine.sum(1)), top_i[fine], np.rint(top_s[fine]).astype(np.int64)


def _whole_numbers(q_ids: np.ndarray, names: np.ndarray, q: np.ndarray, ids: np.ndarray, m: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``best_of``, for components whose products a double can't hold."""
    whole = [[int(x) for x in row] for row in m.tolist()]
    out = []
    for name, q_id, row in zip(names.tolist(), q_ids.tolist(), q.tolist()):
        row = [int(x) for x in row]
        scores = ((max(-(1 << 63), min(sum(a * b for a, b in zip(row, v)), (1 << 63) - 1)), i) for v, i in zip(whole, ids.tolist()) if i != q_id)
        out += [(name, i, s) for s, i in sorted(scores, key=lambda x: (-x[0], x[1]))[:k]]
    return tuple(np.array(x, np.int64) for x in (zip(*out) if out else ((), (), ())))


def _best(s: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each row.  All that tie with the k-th are ordered by id before the cut."""
    cut = -np.partition(-s, k - 1, axis=1)[:, k - 1 : k]
    n = max(k, int((s >= cut).sum(1).max()))
    some = np.argpartition(-s, min(n, s.shape[1]) - 1, axis=1)[:, :n]
    o = np.lexsort((np.take_along_axis(ids, some, 1), -np.take_along_axis(s, some, 1)))
    return np.take_along_axis(some, o, 1)[:, :k]


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = c.stored(integer_vectors(c.read_table(spark, sf_dir, "embeddings")))
    return top_k(vectors.filter("vec_id % 20 = 0"), vectors)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 64)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""
