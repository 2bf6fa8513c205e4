import numpy as np
import pytest

from parlance import queries as q
from parlance.operators import cluster, similar

ROWS = 8500


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    r = np.random.default_rng(5)
    centres = r.normal(size=(7, 8))
    x = (centres[r.integers(0, 7, ROWS)] + r.normal(scale=0.4, size=(ROWS, 8))).astype(np.float32)
    rows = [(i, x[i].tolist(), int(r.integers(0, 9))) for i in range(ROWS)]
    sf = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{sf}/embeddings.parquet")
    return sf, rows


def sessions(rows):
    out = {}
    for row in rows:
        out.setdefault(row[0] // 1000, []).append(row)
    return out


def test_online_sessions_are_bounded(spark, table):
    sf, rows = table
    want = []
    for s, part in sessions(rows).items():
        clusters = cluster.OnlineClusters()
        want += [(s, i, clusters.assign(v)) for i, v, _ in part]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "300")  # sessions go over batches
    try:
        df = q.QUERIES["st07_online_speakers"](spark, sf)
        assert "FlatMapGroups" not in df._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, df.collect())) == sorted(want)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_refined_sessions_are_bounded(spark, table):
    sf, rows = table
    want = []
    for s, part in sessions(rows).items():
        found = cluster.survivors(cluster.refine([x[2] for x in part], [x[1] for x in part]))
        want += [(s, i, k, found.get(k, k)) for i, _, k in part]
    assert any(x[2] != x[3] for x in want)
    assert sorted(map(tuple, q.QUERIES["st10_refined_speakers"](spark, sf).collect())) == sorted(want)


def test_refined_keeps_rows_without_session_or_slot(spark):
    rows = [(None, 1, [1.0, 0.0]), (None, 1, [1.0, 0.1]), (None, 0, [1.0, 0.0]), (None, 0, [1.0, 0.1]), (1, None, [0.0, 1.0]), (1, 3, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "session long, slot int, v array<double>")
    out = cluster.refined_speakers(df, "session", "slot", "v").select("session", "slot", "refined")
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(None, 1, 0), (None, 1, 0), (None, 0, 0), (None, 0, 0), (1, None, None), (1, 3, 3)], key=str)


@pytest.mark.parametrize("least, block", [(0.2, 16), (0.8, 512), (0.95, 7), (1.0, 16)])
def test_similar_pairs_are_those_of_brute_force(spark, least, block):
    r = np.random.default_rng(9)
    x = np.concatenate([r.normal(size=(200, 6)), r.normal(size=(1, 6)) + r.normal(scale=0.2, size=(60, 6))])
    x[20:25] = x[3]  # equal vectors
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x)] + [(900, None, ""), (901, [], ""), (902, [0.0] * 6, ""), (None, x[0].tolist(), "")]
    df = spark.createDataFrame(rows, "id long, vec array<double>, band string")
    out = similar.similar_pairs(df, "id", "vec", least, block)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    got = sorted((p.a, p.b) for p in out.collect())
    clear = {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if s[i, j] >= least + 1e-9}
    possible = {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if s[i, j] >= least - 1e-9}
    assert len(got) == len(set(got)) and clear <= set(got) <= possible


def test_similar_pairs_do_not_rest_on_the_order_of_rows(spark):
    """Both sides of the join of blocks read the rows, which come in another order each time."""
    x = np.random.default_rng(4).normal(size=(300, 6))

    def shuffled(frames):
        for f in frames:
            yield f.sample(frac=1, random_state=np.random.default_rng().integers(1 << 30))

    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>").mapInPandas(shuffled, "id long, vec array<double>")
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        got = sorted((p.a, p.b) for p in similar.similar_pairs(rows, "id", "vec", 0.8).collect())
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert got == sorted(zip(*(i.tolist() for i in np.nonzero(np.triu(u @ u.T >= 0.8, 1)))))
