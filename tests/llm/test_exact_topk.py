import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.llm import exact_topk as m

SCHEMA = "vec_id long, embedding array<float>, label int, v string"


def rows():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 12)) * rng.uniform(0.1, 4, (300, 1)) * np.linspace(2, 0.1, 12)
    out = [(i, [float(y) for y in r], 1, "x") for i, r in enumerate(x)]
    out += [(300 + i, out[5][1], 1, "x") for i in range(60)] + [(7, out[3][1], 2, None)]
    nan, inf = float("nan"), float("inf")
    return [*out, (900, None, 1, None), (920, [], 1, None), (940, [None] * 12, 1, ""), (960, [nan] * 12, 1, ""), (980, [1.0] * 11 + [inf], 1, ""), (None, out[0][1], 1, ""), (1000, [0.0] * 12, None, None)]


def brute(rows, k):
    v = [(r[0], np.floor(np.array(r[1] + [0.0] * (12 - len(r[1])), np.float32).astype(float) * 64)) for r in rows if r[0] is not None and r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    out = []
    for q, x in v:
        if q % 20 == 0:
            best = sorted((-int(x @ y), i) for i, y in v if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("block", [8192, 64])
def test_matches_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(m, "STRIP", 16 if block == 64 else 1024)
    v = m.integer_vectors(spark.createDataFrame(rows(), SCHEMA))
    got = sorted(map(tuple, m.top_k(v.filter("vec_id % 20 = 0"), v, 20, 7 if block == 64 else 2048, block).collect()))
    assert got == brute(rows(), 20)


def test_floors_leave_few_rows(spark):
    """A block that can't reach a query's floor gives it no row, so blocks don't multiply the rows that are merged."""
    rng = np.random.default_rng(6)
    q = rng.normal(size=(40, 8)).round(2) * 10
    x = np.floor(rng.normal(size=(800, 8)) * np.geomspace(100, 0.1, 800)[:, None] * 64)
    rotation = np.linalg.eigh(x.T @ x)[1][:, ::-1].copy()
    floor = m.floors(np.arange(40) + 5000, np.floor(q), np.arange(100), x[:100], 5, rotation)
    later = m.best_of(np.arange(40) + 5000, np.floor(q), np.arange(100, 800), x[100:], 5, rotation, floor)
    want = sum(min(5, int(((np.floor(q)[i] @ x[100:].T) > floor[0][i]).sum())) for i in range(40))
    assert len(later[0]) == want < 40 * 5
    same = np.repeat(x[:1], 300, 0)  # equal vectors tie with the floor and have larger ids
    floor = m.floors(np.arange(40) + 5000, np.floor(q), np.arange(100), same[:100], 5, rotation)
    assert not len(m.best_of(np.arange(40) + 5000, np.floor(q), np.arange(100, 300), same[100:], 5, rotation, floor)[0])
    assert len(m.best_of(np.arange(40) + 5000, np.floor(q), np.arange(-200, 0), same[100:], 5, rotation, floor)[0]) == 200


def test_blocks_are_full_however_spark_deals(spark):
    """Pieces of many small partitions make full blocks in order; wide vectors make smaller ones."""
    v = m.integer_vectors(spark.createDataFrame(rows(), SCHEMA)).repartition(37)
    n = v.count()
    frame = type(v)
    dealt, frame.repartitionByRange = frame.repartitionByRange, lambda self, n, *by: dealt(self, 37, *by)
    try:
        blocks = m._blocks(v, 100, 12, [F.desc("len"), "vec_id"]).orderBy("block").collect()
        got = sorted(map(tuple, m.top_k(v.filter("vec_id % 20 = 0"), v, 20, 7, 100).collect()))
    finally:
        frame.repartitionByRange = dealt
    sizes = [sum(len(x) // 8 for x in b.ids) for b in blocks]
    assert sum(sizes) == n and sizes[0] >= 100 and max(sizes) < 200 and [b.block for b in blocks] == list(range(4))
    lengths = np.concatenate([np.sqrt((np.frombuffer(b"".join(b.m)).reshape(-1, 12) ** 2).sum(1)) for b in blocks])
    assert (np.diff(lengths) <= 1e-9).all()
    assert got == brute(rows(), 20)


def test_wide_vectors(spark, monkeypatch):
    """One vector far wider than the rest makes blocks of few rows, and nothing else changes."""
    monkeypatch.setattr(m, "BLOCK_BYTES", 1 << 14)
    wide = [*rows(), (2000, [0.5] * 300, 1, "")]
    v = m.integer_vectors(spark.createDataFrame(wide, SCHEMA))
    got = sorted(map(tuple, m.top_k(v.filter("vec_id % 20 = 0"), v, 5).collect()))
    pad = [(i, None if x is None else [*x, *[0.0] * (300 - len(x))] if x and all(y is not None and np.isfinite(y) for y in x) else x, a, b) for i, x, a, b in wide]
    whole = {}
    for i, x, _, _ in pad:
        if i is not None and x is not None and all(y is not None and np.isfinite(y) for y in x):
            whole.setdefault(i, []).append(np.floor(np.array(list(x) + [0.0] * (300 - len(x)), np.float32).astype(float) * 64))
    want = []
    for q in (i for i in whole if i % 20 == 0):
        for x in whole[q]:
            best = sorted((-int(x @ y), i) for i, ys in whole.items() if i != q for y in ys)[:5]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert got == sorted(want)


def test_large_components_are_exact(spark):
    big = [(i, [float((i + 1) * 10**6), 1e15, -3.0 * i], 1, "") for i in range(50)] + [(100, [1e18, 1e18, 0.0], 1, "")]
    v = m.integer_vectors(spark.createDataFrame(big, "vec_id long, embedding array<double>, label int, v string"))
    got = sorted(map(tuple, m.top_k(v.filter("vec_id = 20"), v, 5).collect()))
    whole = {i: [int(np.floor(64 * y)) for y in x] for i, x, _, _ in big}
    top = sorted((-min(sum(a * b for a, b in zip(whole[20], x)), 2**63 - 1), i) for i, x in whole.items() if i != 20)[:5]
    assert got == [(20, n + 1, i, -s) for n, (s, i) in enumerate(top)]


def test_strips_prune(monkeypatch):
    monkeypatch.setattr(m, "STRIP", 8)
    rng = np.random.default_rng(2)
    x = np.floor(rng.normal(size=(500, 24)) * 64 * np.linspace(2, 0.05, 24))
    rotation = np.linalg.eigh(x.T @ x)[1][:, ::-1].copy()
    q, i, s = m.best_of(np.arange(50), x[:50], np.arange(500), x, 20, rotation)
    score = x[:50] @ x.T
    for a in range(50):
        want = sorted((-int(score[a, b]), b) for b in range(500) if b != a)[:20]
        assert [(-int(y), int(b)) for b, y in zip(i[q == a], s[q == a])] == want


def test_empty_and_few(spark):
    few = m.integer_vectors(spark.createDataFrame([(0, [1.0, 2.0], 1, ""), (20, [0.5], 1, ""), (3, [-1.0, 0.0], 1, "")], SCHEMA))
    assert sorted(map(tuple, m.top_k(few.filter("vec_id % 20 = 0"), few).collect())) == [(0, 1, 20, 2048), (0, 2, 3, -4096), (20, 1, 0, 2048), (20, 2, 3, -2048)]
    assert m.top_k(few.limit(0), few.limit(0)).count() == 0


def test_matches_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    assert sorted(map(tuple, m.op9_exact_topk(spark, sf).collect())) == sorted(con.sql(m.ORACLE_SQL).fetchall())
