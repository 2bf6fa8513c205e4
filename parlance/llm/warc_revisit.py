"""Resolution of not-modified WARC revisits to the full response that they confirm.

A revisit record says that a server answered "304 Not Modified", so its payload is
that of an earlier capture.  Each revisit is joined as of its time to the latest
strictly earlier full response (status 200) of the same canonical url; of responses
at one time the larger record_id counts.  Its validators are checked as HTTP does: entity
tags if both sides have one (compared weakly), else the dates of last modification.
The headers of a resolved revisit are those of the response, updated by the headers
of the 304 except those that describe the payload (``KEPT``).

Outcomes: ``resolved``, ``unverified`` (no validator on both sides; the response and
merged headers are given all the same), ``mismatch`` (the payload had changed in
between) and ``no_response``.

The as-of join is cut by time: each url's captures are dealt to slices of about
``slice_rows`` records, the last response before each slice is carried over, and only
within slices are rows put in order.  A url with a third of all records is so many
slices, even in time, and a slice that holds a burst is cut once more.  A null url or time
resolves to nothing; a revisit without record_id is resolved like any other, but a response without one can't be
named and takes no part; header names are lower-cased; null headers are none; urls and headers
may have any length; other columns are left out.  Repeated rows are resolved alike, and of
responses that share a record_id but differ the greatest (time, tag, date, headers) counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.llm import _common as c

SLICE_ROWS = 2000
#: Headers of a stored response that a 304 can't replace.
KEPT = ("content-encoding", "content-length", "content-range", "content-type", "transfer-encoding", "trailer")


def canonical_url(url: Column) -> Column:
    """Without scheme, www, default port, fragment, tracking parameters and a closing slash; the host in lower case."""
    rest = F.regexp_replace(F.regexp_extract(url, "(?s)^.*?://(.*)$", 1), "#.*$", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, "^[^/?]*", 0)), "^www\\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^/?]*([^?]*)", 1), "/$", "")
    query = F.regexp_replace(F.regexp_extract(rest, "\\?(.*)$", 1), "(^|&)utm_[^&]*", "")
    query = F.regexp_replace(query, "^&", "")
    return F.when(rest != "", F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def as_of(records: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Revisits (record_id, url_key, at) with response_id, the latest earlier response of their url, or null."""
    rows = records.filter("url_key IS NOT NULL AND at IS NOT NULL")
    keys = ["url_key"]
    for level in ("slice", "part"):
        size = rows.groupBy(*keys).agg(F.min("at").alias("lo"), F.max("at").alias("hi"), F.ceil(F.count("*") / slice_rows).alias("slices"))
        place = F.floor((F.col("at") - F.col("lo")).cast("double") * F.col("slices") / (F.col("hi") - F.col("lo") + 1))
        rows = rows.join(size, keys).withColumn(level, place).drop("lo", "hi", "slices")
        keys.append(level)
    full = F.when(~F.col("revisit") & F.col("record_id").isNotNull(), F.struct("at", "record_id"))
    last = rows.groupBy(*keys).agg(F.max(full).alias("last"))
    before = Window.partitionBy("url_key").orderBy("slice", "part").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(*keys, F.max("last").over(before).alias("carried"))
    within = Window.partitionBy(*keys).orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("near", F.max(full).over(within)).filter("revisit").join(carried, keys)
    return rows.select("record_id", "url_key", "at", F.coalesce("near", "carried")["record_id"].alias("response_id"))


def lower_keys(headers: Column) -> Column:
    """Header names in lower case; of names that become equal, the last value in name order counts."""
    entries = F.array_sort(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))))
    keys = F.transform(entries, lambda e: F.lower(e["key"]))
    one = F.filter(F.arrays_zip(keys.alias("k"), entries.alias("e"), F.sequence(F.lit(1), F.greatest(F.size(keys), F.lit(1))).alias("i")), lambda x: x["k"].isNotNull() & (F.size(F.filter(F.slice(keys, x["i"] + 1, F.size(keys)), lambda k: k == x["k"])) == 0))
    return F.map_from_arrays(F.transform(one, lambda x: x["k"]), F.transform(one, lambda x: x["e"]["value"]))


def merged_headers(stored: Column, fresh: Column) -> Column:
    fresh = F.map_filter(fresh, lambda k, v: ~k.isin(*KEPT))
    own = F.map_filter(stored, lambda k, v: ~F.map_contains_key(fresh, k))
    return F.map_concat(own, fresh)


def resolved(records: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Rows (record_id, url_key, at, response_id, outcome, headers), one a revisit.

    ``records`` has record_id, url, at (long), revisit (boolean), etag, last_modified and
    headers (map of strings).
    """
    df = records.select("record_id", canonical_url(F.col("url")).alias("url_key"), "at", "revisit", "etag", "last_modified", lower_keys(F.col("headers")).alias("headers"))
    revisits = df.filter("revisit")
    found = as_of(df.select("record_id", "url_key", "at", "revisit"), slice_rows).filter("response_id IS NOT NULL").groupBy("record_id", "url_key", "at").agg(F.max("response_id").alias("response_id"))
    found = found.withColumnsRenamed({x: f"found_{x}" for x in ("record_id", "url_key", "at")})
    entries = F.array_sort(F.map_entries("headers")).alias("entries")
    full = df.filter("NOT revisit").groupBy(F.col("record_id").alias("response_id")).agg(F.max(F.struct("at", "etag", "last_modified", entries)).alias("full"))
    full = full.select("response_id", F.col("full.etag").alias("full_etag"), F.col("full.last_modified").alias("full_last_modified"), F.map_from_entries("full.entries").alias("full_headers"))
    same_row = (F.col("url_key") == F.col("found_url_key")) & (F.col("at") == F.col("found_at")) & F.col("record_id").eqNullSafe(F.col("found_record_id"))
    out = revisits.join(found, same_row, "left").join(full, "response_id", "left")
    weak = lambda x: F.regexp_replace(x, "^W/", "")
    tags, dates = F.col("etag").isNotNull() & F.col("full_etag").isNotNull(), F.col("last_modified").isNotNull() & F.col("full_last_modified").isNotNull()
    same = F.when(tags, weak(F.col("etag")) == weak(F.col("full_etag"))).when(dates, F.col("last_modified") == F.col("full_last_modified"))
    outcome = F.when(F.col("response_id").isNull(), "no_response").when(same, "resolved").when(~same, "mismatch").otherwise("unverified")
    out = out.withColumn("outcome", outcome)
    headers = F.when(F.col("outcome").isin("resolved", "unverified"), merged_headers(F.col("full_headers"), F.col("headers")))
    return out.select("record_id", "url_key", "at", "response_id", "outcome", headers.alias("headers"))


def captures(pages: DataFrame) -> DataFrame:
    """WARC records from crawled pages: a full capture of each, in the order of page_id, and a
    conditional one that starts 64 captures later and finds the page not modified.

    A site changes its pages every 512 captures.  One full capture in five and one
    conditional one in seven has a date instead of an entity tag.
    """

    def records(revisit: bool) -> DataFrame:
        p = F.col("page_id")
        at = p * 2 + 129 if revisit else p * 2
        version = F.floor(at / 1024).cast("string")
        etag = F.concat(F.lit('"'), F.substring(F.md5(F.concat(F.lit("v"), version)), 1, 16), F.lit('"'))
        dated = F.coalesce(p % (7 if revisit else 5) == 0, F.lit(False))
        size = F.lit("0") if revisit else F.coalesce(F.length("html"), F.lit(0)).cast("string")
        headers = F.create_map(F.lit("Date"), at.cast("string"), F.lit("Content-Length"), size, F.lit("X-Version"), version)
        return pages.select(
            (p * 2 + int(revisit)).alias("record_id"), "url", at.alias("at"), F.lit(revisit).alias("revisit"),
            F.when(~dated, etag).alias("etag"), F.when(dated, version).alias("last_modified"), headers.alias("headers"),
        )

    return records(False).unionByName(records(True))


def op4_warc_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolved(captures(c.read_table(spark, sf_dir, "pages")))
    text = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    page = lambda x: F.shiftright(x, 1)
    return found.select(page("record_id").alias("page_id"), "url_key", page("response_id").alias("response_id"), "outcome", text.alias("headers"))


ORACLE_SQL = r"""
WITH cut AS (
  SELECT page_id, html, regexp_replace(regexp_extract(url, '(?s)^.*?://(.*)$', 1), '#.*$', '') AS rest FROM pages),
parts AS (
  SELECT page_id, html, rest,
         regexp_replace(regexp_replace(lower(regexp_extract(rest, '^[^/?]*')), '^www\.', ''), ':(80|443)$', '') AS host,
         regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/$', '') AS path,
         regexp_replace(regexp_replace(regexp_extract(rest, '\?(.*)$', 1), '(^|&)utm_[^&]*', '', 'g'), '^&', '') AS query
  FROM cut),
keyed AS (
  SELECT page_id, CASE WHEN rest <> '' THEN host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS url_key, coalesce(length(html), 0)::VARCHAR AS size FROM parts),
records AS (
  SELECT page_id, url_key, 2 * page_id AS moment, false AS revisit, page_id % 5 = 0 AS dated, (2 * page_id // 1024)::VARCHAR AS version, size FROM keyed
  UNION ALL
  SELECT page_id, url_key, 2 * page_id + 129, true, page_id % 7 = 0, ((2 * page_id + 129) // 1024)::VARCHAR, '0' FROM keyed),
found AS (
  SELECT *, CASE WHEN url_key IS NOT NULL THEN max(CASE WHEN NOT revisit THEN page_id END) OVER (PARTITION BY url_key ORDER BY moment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS response_id
  FROM records),
joined AS (
  SELECT f.*, r.version AS full_version, r.dated AS full_dated, r.size AS full_size,
         CASE WHEN f.response_id IS NULL THEN 'no_response' WHEN f.dated <> r.dated THEN 'unverified'
              WHEN f.version = r.version THEN 'resolved' ELSE 'mismatch' END AS outcome
  FROM found f LEFT JOIN records r ON f.response_id = r.page_id AND NOT r.revisit WHERE f.revisit)
SELECT page_id, url_key, response_id, outcome,
       CASE WHEN outcome IN ('resolved', 'unverified')
            THEN 'content-length=' || full_size || ';date=' || moment || ';x-version=' || version END AS headers
FROM joined
"""
