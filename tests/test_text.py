"""Text functions beside their SQL."""

import duckdb

from parlance import queries as q

DOCUMENTS = [(i, x, "de") for i, x in enumerate(("ßeite und so", "ßeite!", "ǰa", "ﬁn", "ᾳ", "ᾳδης", "ᾠδή", "über", "Ähre.", "ωmega", "", " ", "1a"))]


def test_a_capital_is_one_letter_as_in_the_sql(spark, tmp_path):
    spark.createDataFrame(DOCUMENTS, "doc_id long, text string, lang string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = q.QUERIES["t06_punctuated"](spark, str(tmp_path)).select("doc_id", "sentence").collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(q.ORACLE_SQL["t06_punctuated"]).fetchall())
