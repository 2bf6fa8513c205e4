import hashlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.llm import centroid_clustering as m

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, cluster int, v string"


def brute(points, k, rounds):
    """Plain k-means in whole numbers of any size; points are (vec_id, list of whole numbers)."""
    seeds = sorted(points, key=lambda p: (p[0] is None, hashlib.sha256(f"{m.SEED}:{p[0]}".encode()).hexdigest(), p[1]))[:k]
    centres = [list(p[1]) for p in seeds]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for r in range(rounds + 1):
        who = [min(range(len(centres)), key=lambda j: (far(v, centres[j]), j)) for _, v in points]
        if r < rounds:
            for j in range(len(centres)):
                own = [v for (_, v), w in zip(points, who) if w == j]
                if own:
                    centres[j] = [sum(x) // len(own) for x in zip(*own)]
    return sorted(((i, w, min(far(v, centres[w]), m.MOST)) for (i, v), w in zip(points, who)), key=str), centres


def rows(dim=4):
    rng = np.random.default_rng(5)
    middle = rng.normal(size=(9, dim)) * 3
    x = (middle[rng.integers(0, 9, 500)] + rng.normal(size=(500, dim))).tolist()
    out = [(i, v, 1, "x") for i, v in enumerate(x)]
    out += [(1000 + i, x[3], 0, "") for i in range(200)]  # a heap of equal vectors
    out += [(7, x[8], None, None), (7, x[8], None, None), (None, x[9], 3, "x")]
    nan = float("nan")
    bad = [(2000, None, 1, ""), (2001, [], 1, ""), (2002, [0.0] * (dim + 1), 1, ""), (2003, [None] * dim, 1, ""), (2004, [nan] * dim, 1, ""), (2005, [float("inf")] * dim, 1, "")]
    return out, bad


def whole(rows, scale=1024):
    return [(r[0], [int(np.floor(x * scale)) for x in r[1]]) for r in rows]


@pytest.mark.parametrize(("k", "bounds", "block"), [(8, None, 8192), (8, 3, 64), (12, 5, 50), (1, None, 100), (2, 1, 100)])
def test_matches_brute_force(spark, k, bounds, block):
    fine, bad = rows()
    v = m.integer_vectors(spark.createDataFrame(fine + bad, SCHEMA), dim=4)
    got, centres = m.clustered(v, k=k, bounds=bounds, block=block)
    want, want_centres = brute(whole(fine), k, m.ROUNDS)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert centres.tolist() == want_centres


def test_ties_go_to_the_smaller_number_and_empty_centroids_stay(spark):
    same = [(i, [1.0, 1.0], 0, "") for i in range(20)] + [(100 + i, [float(i % 3), 0.0], 0, "") for i in range(30)]
    v = m.integer_vectors(spark.createDataFrame(same, SCHEMA), dim=2)
    got, centres = m.clustered(v, k=8)
    want, want_centres = brute(whole(same), 8, m.ROUNDS)
    assert sorted(map(tuple, got.collect()), key=str) == want and centres.tolist() == want_centres


def test_large_components_are_exact(spark):
    big = [(i, [float(i % 7) * 1e12 + i, -1e13 * (i % 3)], 0, "") for i in range(60)]
    v = m.integer_vectors(spark.createDataFrame(big, SCHEMA), dim=2)
    got, centres = m.clustered(v, k=5)
    want, want_centres = brute(whole(big), 5, m.ROUNDS)
    assert sorted(map(tuple, got.collect()), key=str) == want and centres.tolist() == want_centres


def test_few_and_no_vectors(spark):
    two = [(i, [1.0 * i, 2.0], 0, "") for i in range(2)]
    got, centres = m.clustered(m.integer_vectors(spark.createDataFrame(two, SCHEMA), dim=2))
    assert len(centres) == 2 and sorted(r.distance for r in got.collect()) == [0, 0]
    got, centres = m.clustered(m.integer_vectors(spark.createDataFrame([], SCHEMA), dim=2))
    assert len(centres) == 0 and got.count() == 0


def test_bounds_hold_and_save_scans():
    rng = np.random.default_rng(2)
    middle = rng.normal(size=(20, 16)) * 4000
    x = np.floor(middle[rng.integers(0, 20, 3000)] + rng.normal(size=(3000, 16)) * 200).astype(np.int64)
    centres = x[:20].copy()
    state = m.Bounds(x, centres, 5)
    for r in range(8):
        new = np.stack([x[state.cluster == j].sum(0) // (state.cluster == j).sum() for j in range(20)])
        drift = np.sqrt(m.squared(new, centres).astype(float)) * (1 + m.SLACK)
        if r == 4:
            state.shrink(3)
        centres = new
        state.scanned = [0, 0, 0]
        state.move(centres, drift)
        d = np.stack([m.squared(x, y) for y in centres], 1)
        assert (state.cluster == d.argmin(1)).all()
        far = np.sqrt(d.astype(float))
        assert (state.upper >= far.min(1) - 1e-6).all()
        assert (np.take_along_axis(far, state.near, 1) >= state.low - 1e-6).all()
        others = far.copy()
        np.put_along_axis(others, np.concatenate([state.cluster[:, None], state.near], 1), np.inf, 1)
        assert (others.min(1) >= state.rest - 1e-6).all()
    assert sum(state.scanned) == 3000 and state.scanned[0] > 2900


def test_query_against_duckdb(spark):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    rel = duck.sql(m.ORACLE_SQL)
    got = m.op12_centroid_clustering(spark, SF).select(*rel.columns)
    assert sorted(map(tuple, got.collect())) == sorted(rel.fetchall())
    assert got.agg(F.countDistinct("cluster")).first()[0] > 1
