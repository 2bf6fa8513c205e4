import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from parlance.llm import warc_revisit as m

SCHEMA = "record_id long, url string, at long, revisit boolean, etag string, last_modified string, headers map<string,string>, outcome string"


def key(url):
    if url is None or "://" not in url:
        return None
    rest = url.split("://", 1)[1].split("#", 1)[0]
    head, _, query = rest.partition("?")
    host, slash, path = head.partition("/")
    host = re.sub(":(80|443)$", "", re.sub(r"^www\.", "", host.lower()))
    path = (slash + path)[:-1] if (slash + path).endswith("/") else slash + path
    query = "&".join(x for x in query.split("&") if not x.startswith("utm_"))
    return (host + path + ("?" + query if query else "")) if rest else None


def brute(rows):
    out = []
    for i, url, at, revisit, etag, date, headers, _ in rows:
        if not revisit:
            continue
        full = [r for r in rows if not r[3] and key(url) is not None and at is not None and r[2] is not None and key(r[1]) == key(url) and r[2] < at]
        if not full:
            out.append((i, key(url), at, None, "no_response", None))
            continue
        r = max(full, key=lambda r: (r[2], r[0]))
        weak = lambda x: x.removeprefix("W/")
        if etag is not None and r[4] is not None:
            same = weak(etag) == weak(r[4])
        else:
            same = date == r[5] if date is not None and r[5] is not None else None
        low = lambda h: {k.lower(): v for k, v in sorted((h or {}).items())}
        merged = low(r[6]) | {k: v for k, v in low(headers).items() if k not in m.KEPT}
        out.append((i, key(url), at, r[0], {True: "resolved", False: "mismatch", None: "unverified"}[same], merged if same is not False else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("slice_rows", [3, 2000])
def test_matches_brute_force(spark, slice_rows):
    r = random.Random(8)
    urls = ["http://a.org/x", "https://WWW.a.org/x/", "https://a.org:443/x?utm_source=f#t", "http://a.org/x?b=1", "http://a.org/x?utm_a=1&b=1", "http://c.org", "nope", "", None]
    rows = []
    for i in range(400):
        url = urls[0] if i % 3 == 0 else r.choice(urls)
        headers = r.choice([None, {}, {"Content-Type": "text/html", "Date": str(i)}, {"ETag": "x", "content-length": "5", "DATE": "1", "Date": "2"}])
        rows.append((i, url, r.choice([None, *range(60)]), r.random() < 0.5, r.choice([None, '"a"', 'W/"a"', '"b"']), r.choice([None, "mon", "tue"]), headers, "x"))
    rows += [rows[0], rows[1], rows[2]]
    got = m.resolved(spark.createDataFrame(rows, SCHEMA), slice_rows).collect()
    assert sorted(((*x[:5], dict(sorted(x[5].items())) if x[5] is not None else None) for x in got), key=str) == sorted(((*x[:5], dict(sorted(x[5].items())) if x[5] is not None else None) for x in brute(rows)), key=str)


def test_a_burst_is_cut_again(spark, monkeypatch):
    rows = [(i, "http://a.org/x", 10**9 + i, i % 2 == 1, None, None, None, "x") for i in range(900)] + [(5000, "http://a.org/x", 0, False, None, None, None, "x"), (5001, "http://a.org/x", 10**9, True, None, None, None, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(tuple(x[:4]) for x in m.resolved(df, 30).collect())
    assert got == sorted(x[:4] for x in brute(rows))
    plan = m.as_of(df.withColumn("url_key", m.canonical_url(F.col("url"))), 30)._jdf.queryExecution().analyzed().toString()
    assert plan.count("slice") and plan.count("part")


def test_responses_of_one_record_id_that_differ(spark):
    rows = [(1, "http://a.org/x", 5, False, e, None, {"A": e}, "x") for e in ('"a"', '"b"', '"a"')] + [(2, "http://a.org/x", 9, True, '"b"', None, {"L" * 50_000: "v"}, "x")] * 2
    got = m.resolved(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 2 and {(r.response_id, r.outcome, r.headers["a"], len(r.headers)) for r in got} == {(1, "resolved", '"b"', 2)}


def test_rows_without_record_id(spark):
    """A revisit without an id finds its response; a response without one can't be named, so an older one that can is found."""
    x = "http://a.org/x"
    rows = [(1, x, 5, False, '"a"', None, {"A": "1"}, "x"), (None, x, 6, False, '"b"', None, {"A": "2"}, "x")]
    rows += [(None, x, 9, True, '"a"', None, {"B": "3"}, "x")] * 2 + [(7, x, 9, True, '"b"', None, None, "x"), (None, x, 5, True, None, None, None, "x"), (None, None, 9, True, None, None, None, "x")]
    got = m.resolved(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(((r.record_id, r.at, r.response_id, r.outcome) for r in got), key=str) == sorted(
        [(None, 9, 1, "resolved")] * 2 + [(7, 9, 1, "mismatch"), (None, 5, None, "no_response"), (None, 9, None, "no_response")], key=str
    )


def test_empty_table(spark):
    assert m.resolved(spark.createDataFrame([], SCHEMA)).count() == 0


def test_matches_sql(spark):
    sf = "/root/testdata/sf0.1"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    got = sorted(map(tuple, m.op4_warc_revisit(spark, sf).collect()))
    assert got == sorted(con.sql(m.ORACLE_SQL).fetchall())
    assert {"resolved", "mismatch", "unverified"} <= {r[3] for r in got}
