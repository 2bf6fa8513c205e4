import duckdb
import pytest
from pyspark.sql import functions as F

from parlance.llm import source_mixing as m

SCHEMA = "doc_id long, source string, text string, lang string, size int"
ROWS = [(i, s, None if i % 17 == 0 else "w " * (i % 40 + 1), "en", 1) for i, s in enumerate((["b"] * 300) + (["a"] * 40) + ([None] * 25) + (["empty"] * 3))]
ROWS = [(d, s, "" if s == "empty" else t, x, y) for d, s, t, x, y in ROWS] + [(7, "b", "w w w", "en", 1)] * 3 + [(None, "b", "w", None, None), (None, None, None, None, None)]
LABELS = [(1, 1, 0), (1, 1, 0), (2, 0, 1), (None, 1, 1), (3, None, None)]


def sized(spark, rows):
    return m.sized(spark.createDataFrame(rows, SCHEMA).drop("size"), spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int"))


def filled(sizes, weights, total, most):
    """Shares by weight; what lies above a cap is shared again until none is above."""
    left, out = dict(sizes), {}
    while left:
        level = (total - sum(out.values())) / sum(weights[s] for s in left)
        over = [s for s in left if level * weights[s] > most * sizes[s]]
        for s in over or list(left):
            out[s] = most * sizes[s] if over else level * weights[s]
            del left[s]
    return out


@pytest.mark.parametrize("slice_rows", [10, 2000])
def test_targets_and_budgets(spark, slice_rows):
    rows = m.mixed(sized(spark, ROWS), slice_rows=slice_rows).collect()
    assert len(rows) == len(ROWS)
    sizes, taken, targets, largest = {}, {}, {}, {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
        largest[r.source] = max(largest.get(r.source, 0), r["size"])
        targets[r.source] = r.target
        assert r.taken <= 2 * r["size"] and (not r["size"] or r.taken % r["size"] == 0)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = filled(sizes, {s: m.WEIGHTS[i % 3] for i, s in enumerate(order)}, 1.5 * sum(sizes.values()), 2)
    for s, t in want.items():
        assert targets[s] == pytest.approx(t) and abs(taken[s] - t) <= largest[s] / 2 + 1e-6
    for r in rows:
        assert r.source_size == sizes[r.source]


def test_slices_and_reruns_agree(spark):
    a, b, again = (sorted(map(str, m.mixed(sized(spark, rows), slice_rows=n).collect())) for rows, n in ((ROWS, 10), (ROWS[::-1], 2000), (ROWS, 10)))
    assert a == b == again


def test_higher_quality_is_taken_first(spark):
    docs = spark.createDataFrame([(i, "a", 1, 1.0 if i % 2 else 9.0) for i in range(4000)] + [(9999, "b", 40000, 1.0)], "doc_id long, source string, size long, quality_weight double")
    rows = [r for r in m.mixed(docs, weights=(1, 40)).collect() if r.source == "a"]
    good, bad = (sum(r.taken for r in rows if (r.quality_weight > 1) == g) for g in (True, False))
    assert good > 2 * bad


def test_slices_are_even_at_any_weights(spark, monkeypatch):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), F.lit(1).cast("long").alias("size"), F.when(F.col("id") % 3 == 0, 7.3).otherwise(0.5).alias("quality_weight"))
    seen = []
    plain = m.docs_slices
    monkeypatch.setattr(m, "docs_slices", lambda df: seen.append(df.groupBy("slice").count().collect()) or plain(df))
    m.mixed(docs, slice_rows=1000)
    sizes = [r["count"] for r in seen[0]]
    assert len(sizes) == 30 and max(sizes) < 1300 and min(sizes) > 700


def test_rows_without_an_id_and_clashing_columns(spark):
    rows = [(None, "a", f"w{i} " * (i % 9 + 1), "x", i) for i in range(600)] + [(1, "a", "long " * 100_000, "x", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, slice string, upto int")
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    sized_ = m.sized(docs, labels, "slice", "upto")
    assert sized_.select("u").distinct().count() > 590
    got = m.mixed(sized_.withColumns({"target": F.lit("old"), "key": F.lit("k"), "row": F.lit("r")}), share=1.0).collect()
    assert len(got) == 601 and {(r.slice, r.key, r.row) for r in got} == {("x", "k", "r")} and {type(r.target) for r in got} == {float}
    assert sum(r.taken for r in got) > 0


def test_empty_table(spark):
    assert m.mixed(sized(spark, [])).count() == 0


def test_matches_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    assert sorted(map(tuple, m.op8_source_mixing(spark, sf).collect())) == sorted(con.sql(m.ORACLE_SQL).fetchall())
