"""Exact k-means over integer vectors by Drake's adaptive bounds.

Each vector stores an upper bound of the distance to its centroid, the lower bounds of
its several nearest other centroids in ascending order, and one remainder bound that
holds for all centroids beyond these.  After an update every bound moves by what its centroid moved.

* If the upper bound is below all lower bounds, the assignment is certified.
* Otherwise the distance to the own centroid is computed, and the test is made again.
* If that distance is below the remainder bound, only the stored centroids are scanned.
* Else, where the order can't be certified, all centroids are.

As many bounds are kept as some vector needed in the round before, at least
``LEAST_BOUNDS``.  Scans compare exact integer distances, ties go to the smaller number, and
the bounds certify only what is strictly nearer beyond rounding, so the result is that of
plain k-means.  Vectors lie in packed blocks with their bounds; a round is one pass over
the blocks without a shuffle, written to the shared folder, and what reaches the driver is k
sums of components.  So neither equal vectors nor large clusters meet in one task.

Rows take part whose ``embedding`` has exactly ``dim`` components, none of them null or non-finite;
component x becomes floor(scale * x), and beyond a long counts as the largest or smallest
long.  A vec_id may be null (such a row is never a seed while others have ids) or repeat;
each row is assigned on its own.  With fewer vectors than k there are as many centroids as
vectors, and without any the result is empty.  A distance or inertia beyond a long
counts as the largest long.  Other columns aren't read.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import _common as c

K, ROUNDS, DIM, SCALE, SEED = 8, 10, 64, 1024, 3
BLOCK = 8192
LEAST_BOUNDS = 2
#: What rounding may add to a bound, as a share of the longest vector and centroid.
SLACK = 1e-9
MOST = (1 << 63) - 1
STATE = "ids array<long>, m binary, cluster binary, upper binary, near binary, low binary, rest binary, sums array<string>, counts array<long>, scanned array<long>, depth int"


def integer_vectors(vectors: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(vec_id, v array<long>) of the rows that take part."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    kept = vectors.filter((F.size("embedding") == dim) & F.coalesce(finite, F.lit(False)))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e * scale).cast("long")).alias("v"))


def seeds(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest hashes of their ids; rows of one id in the order of their components."""
    by_hash = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select(by_hash.alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64)


def squared(m: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Exact squared distances by row; whole numbers of any size where longs may not hold them."""
    n = max(1, m.shape[1])
    if float(np.abs(m.astype(float)).max(initial=0)) + float(np.abs(centre.astype(float)).max(initial=0)) < (2**61 / n) ** 0.5:
        d = m - centre
        return np.einsum("ij,ij->i", d, d)
    d = m.astype(object) - centre.astype(object)
    return (d * d).sum(1)


def _nearest(m: np.ndarray, centres: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The listed centroids of each row by ascending distance, ties to the smaller number; (numbers, distances)."""
    some = np.sort(some, axis=1)
    d = np.stack([squared(m, centres[some[:, j]]) for j in range(some.shape[1])], 1)
    order = np.argsort(d, axis=1, kind="stable")
    return np.take_along_axis(some, order, 1), np.sqrt(np.take_along_axis(d, order, 1).astype(float))


class Bounds:
    """Assignment and bounds of a block of vectors."""

    def __init__(self, m: np.ndarray, centres: np.ndarray, bounds: int):
        n, k = len(m), len(centres)
        self.m, self.b = m, min(bounds, k - 1)
        self.cluster, self.upper = np.zeros(n, np.int32), np.zeros(n)
        self.near, self.low = np.zeros((n, self.b), np.int32), np.zeros((n, self.b))
        self.rest = np.full(n, np.inf)
        self.scanned = [0, 0, 0]  # vectors certified, compared with the stored centroids, with all
        self.depth = 0
        self._scan_all(np.arange(n), centres)

    @classmethod
    def restored(cls, m, cluster, upper, near, low, rest) -> Bounds:
        self = cls.__new__(cls)
        n = len(m)
        self.m, self.cluster, self.upper, self.rest = m, cluster.copy(), upper.copy(), rest.copy()
        self.near, self.low = near.reshape(n, -1).copy(), low.reshape(n, -1).copy()
        self.b, self.scanned, self.depth = self.near.shape[1], [0, 0, 0], 0
        return self

    def shrink(self, bounds: int) -> None:
        if bounds < self.b:
            self.rest = np.minimum(self.rest, self.low[:, bounds:].min(1))
            self.near, self.low, self.b = self.near[:, :bounds], self.low[:, :bounds], bounds

    def _put(self, rows: np.ndarray, who: np.ndarray, far: np.ndarray) -> None:
        self.cluster[rows], self.upper[rows] = who[:, 0], far[:, 0]
        self.near[rows], self.low[rows] = who[:, 1 : self.b + 1], far[:, 1 : self.b + 1]

    def _scan_all(self, rows: np.ndarray, centres: np.ndarray) -> None:
        if not len(rows):
            return
        who, far = _nearest(self.m[rows], centres, np.broadcast_to(np.arange(len(centres)), (len(rows), len(centres))))
        self._put(rows, who, far)
        self.rest[rows] = far[:, self.b + 1] if far.shape[1] > self.b + 1 else np.inf
        self.scanned[2] += len(rows)

    def move(self, centres: np.ndarray, drift: np.ndarray) -> None:
        """Assigns to the centroids after each of them has moved by at most its ``drift``."""
        lengths = [np.sqrt((x.astype(float) ** 2).sum(1)).max(initial=0) for x in (self.m, centres)]
        slack = SLACK * (1 + sum(lengths))
        self.upper += drift[self.cluster] + slack
        self.low -= drift[self.near] + slack
        self.rest -= drift.max() + slack
        least = np.minimum(self.low.min(1, initial=np.inf), self.rest)
        rows = np.flatnonzero(~(self.upper + slack < least))
        self.upper[rows] = np.sqrt(squared(self.m[rows], centres[self.cluster[rows]]).astype(float))
        rows = rows[~(self.upper[rows] + slack < least[rows])]
        known = self.upper[rows] + slack < self.rest[rows]
        some, every = rows[known], rows[~known]
        self.scanned[0] += len(self.m) - len(rows)
        self.scanned[1] += len(some)
        self.depth = self.b if len(every) else int((self.low[some] <= self.upper[some, None] + slack).sum(1).max(initial=0))
        if len(some):
            who, far = _nearest(self.m[some], centres, np.concatenate([self.cluster[some, None], self.near[some]], 1))
            self._put(some, who, far)
        self._scan_all(every, centres)

    def row(self, k: int) -> tuple:
        """The block's own columns of the state, from m on."""
        exact = self.m if float(np.abs(self.m.astype(float)).max(initial=0)) * len(self.m) < 2**62 else self.m.astype(object)
        sums = [str(int(x)) for j in range(k) for x in exact[self.cluster == j].sum(0)]
        parts = (self.m, self.cluster, self.upper, self.near, self.low, self.rest)
        return (*(np.ascontiguousarray(x).tobytes() for x in parts), sums, np.bincount(self.cluster, minlength=k).tolist(), self.scanned, self.depth)


def _state_batch(ids, row: tuple):
    import pyarrow as pa

    m, cluster, upper, near, low, rest, sums, counts, scanned, depth = row
    blobs = [pa.array([x], pa.binary()) for x in (m, cluster, upper, near, low, rest)]
    lists = [pa.array([sums], pa.list_(pa.string())), pa.array([counts], pa.list_(pa.int64())), pa.array([scanned], pa.list_(pa.int64()))]
    names = [x.strip().split(" ")[0] for x in STATE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), *blobs, *lists, pa.array([depth], pa.int32())], names)


def _first(centres: np.ndarray, bounds: int, block: int):
    """Packs vectors into blocks and assigns them."""

    def pack(batches):
        ids, ms, held = [], [], 0

        def out():
            return _state_batch(ids, Bounds(np.concatenate(ms), centres, bounds).row(len(centres)))

        for batch in c.slices(batches, block):
            ids += batch.column("vec_id").to_pylist()
            flat = np.asarray(batch.column("v").flatten(), np.int64)
            ms.append(flat.reshape(batch.num_rows, -1))
            held += batch.num_rows
            if held >= block:
                yield out()
                ids, ms, held = [], [], 0
        if held:
            yield out()

    return pack


KINDS = (("m", np.int64), ("cluster", np.int32), ("upper", float), ("near", np.int32), ("low", float), ("rest", float))


def _arrays(batch, width: int):
    """(ids, parts of the state) of each block of a batch."""
    for i in range(batch.num_rows):
        m, *rest = (np.frombuffer(batch.column(x)[i].as_py(), t) for x, t in KINDS)
        yield batch.column("ids")[i].as_py(), (m.reshape(-1, width), *rest)


def _moved(centres: np.ndarray, drift: np.ndarray, bounds: int):
    def move(batches):
        for batch in batches:
            for ids, parts in _arrays(batch, centres.shape[1]):
                state = Bounds.restored(*parts)
                state.shrink(bounds)
                state.move(centres, drift)
                yield _state_batch(ids, state.row(len(centres)))

    return move


def _assigned(centres: np.ndarray):
    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            for ids, (m, cluster, *_) in _arrays(batch, centres.shape[1]):
                d = squared(m, centres[cluster])
                d = d if d.dtype != object else np.minimum(d, MOST).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(cluster), pa.array(d)], ["vec_id", "cluster", "distance"])

    return rows


def _updated(state: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Floors of the means, and how far each centroid moved; empty ones stay."""
    totals = state.select(F.posexplode("sums").alias("at", "x")).groupBy("at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()
    counts = dict(state.select(F.posexplode("counts").alias("at", "n")).groupBy("at").agg(F.sum("n")).collect())
    k, width = centres.shape
    new = centres.copy()
    for r in totals:
        if counts[r.at // width]:
            new[r.at // width, r.at % width] = int(r.x) // counts[r.at // width]
    return new, np.sqrt(squared(new, centres).astype(float)) * (1 + SLACK)


def clustered(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED, bounds: int | None = None, block: int = BLOCK) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance) rows of a (vec_id, v) table, centroids) after ``rounds`` updates and a last assignment."""
    spark = vectors.sparkSession
    centres = seeds(vectors, k, seed)
    if not len(centres):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), centres
    bounds = max(LEAST_BOUNDS + 1, k // 4) if bounds is None else bounds
    mark = c.written()
    state = c.stored(vectors.mapInArrow(c.released(_first(centres, bounds, block)), STATE))
    for _ in range(rounds):
        centres, drift = _updated(state, centres)
        if drift.any():
            state = c.stored(state.mapInArrow(c.released(_moved(centres, drift, bounds)), STATE))
            c.clear_stored(spark, mark, but_last=1)
            bounds = max(LEAST_BOUNDS, min(bounds, state.agg(F.max("depth")).first()[0]))
    out = c.stored(state.mapInArrow(c.released(_assigned(centres)), "vec_id long, cluster int, distance long"))
    c.clear_stored(spark, mark, but_last=1)
    return out, centres


def _by_cluster(values: list, kind: str) -> Column:
    return F.element_at(F.array(*(F.lit(x).cast(kind) for x in values)), F.col("cluster") + 1)


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centres = clustered(integer_vectors(c.read_table(spark, sf_dir, "embeddings")))
    sums = {r.cluster: int(r.x) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("x")).collect()}
    inertia = [min(sums.get(j, 0), MOST) for j in range(max(1, len(centres)))]
    hashes = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in centres.tolist()] or [""]
    return rows.select(
        "vec_id", "cluster", "distance", _by_cluster(inertia, "long").alias("cluster_inertia"), F.lit(min(sum(sums.values()), MOST)).cast("long").alias("inertia"), _by_cluster(hashes, "string").alias("centroid_sha256")
    )


def _oracle() -> str:
    steps = [f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIM}),
x AS MATERIALIZED (SELECT row, unnest(range({DIM})) AS j, unnest(v) AS x FROM kept),
first AS (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) - 1 AS k, v FROM kept ORDER BY k LIMIT {K}),
c0 AS MATERIALIZED (SELECT k, unnest(range({DIM})) AS j, unnest(v) AS y FROM first)"""]
    for i in range(ROUNDS + 1):
        steps.append(f"""
a{i} AS MATERIALIZED (
  SELECT row, min(struct_pack(d := d, k := k)) AS best FROM (SELECT row, k, sum((x - y) * (x - y)) AS d FROM x JOIN c{i} USING (j) GROUP BY row, k) GROUP BY row)""")
        if i < ROUNDS:
            steps.append(f"""
m{i} AS (SELECT a.best.k AS k, j, sum(x) AS s, count(*) AS n FROM a{i} a JOIN x USING (row) GROUP BY ALL),
c{i + 1} AS MATERIALIZED (SELECT k, j, coalesce(((s - ((s % n) + n) % n) // n)::BIGINT, y) AS y FROM c{i} LEFT JOIN m{i} USING (k, j))""")
    last = f"""
h AS (SELECT k, sha256(string_agg(y::VARCHAR, ',' ORDER BY j)) AS h FROM c{ROUNDS} GROUP BY k)
SELECT vec_id, best.k::INTEGER AS cluster, best.d::BIGINT AS distance, (sum(best.d) OVER (PARTITION BY best.k))::BIGINT AS cluster_inertia,
  (sum(best.d) OVER ())::BIGINT AS inertia, h AS centroid_sha256 FROM a{ROUNDS} JOIN kept USING (row) JOIN h ON h.k = best.k"""
    return ",".join([*steps, last])


ORACLE_SQL = _oracle()
