"""URL verdicts by rules, and by a tree of path templates where no rule fits.

A rule ``domain/path`` fits its host and all subdomains of it, if the path of the url
starts with the rule's; the longest rule that fits wins.  Verdicts of rules are the
labels from which a tree of path templates is learnt for each host.  Going down the
tree by one segment at a time:

* where the segments below a parent are at least ``LEAST`` and at least ``VARIED`` of its
  distinct paths, those of fewer than ``LEAST`` paths are variable.  Variable segments without a
  label become the wildcard ``*``, and so do those with one if at least ``LEAST`` of them, and ``VARIED`` of all
  variable ones, have labels: only labels spread over the values of a segment say something of its other values;
* of the others, those without any label are one branch, ``*0``;
* those with labels are put in order of their rates of blocked pages; neighbours whose
  rates a two-proportion z-test at ``Z`` doesn't tell apart are merged (``*1``, ``*2`` and
  so on in that order), and a branch that merges with none stays literal (``=`` and the
  segment).  So a few labelled pages never decide for a section that has none.

A template's purity is its rate of blocked among labelled pages, smoothed by
``SMOOTH`` of either kind; templates of a purity of ``REJECT`` or more are blocked, and
all others allowed.

Only distinct paths go through the tree, with their counts, so a host with a third of
all pages is no hot group; rates are put in order by distinct pairs of counts.  Each level
is a grouped sum and a join; levels go on until every path has ended, and what lies
beyond ``DEPTH`` segments is one last segment.  A null url, or one without ``://``, has
empty host and path, like all others without them.  Repeated rows are judged alike; null
page_ids stay; urls may have any length.  Columns other than page_id and url aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.llm import _common as c

RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)
LEAST, VARIED, Z = 5, 0.5, 1.96
DEPTH = 32
SMOOTH, REJECT = 1.0, 0.8
_URL = "(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    host, path = (F.coalesce(F.regexp_extract(url, _URL, i), F.lit("")) for i in (1, 2))
    return F.translate(host, _UPPER, _LOWER), path


def rule_for(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null without one."""
    rule = verdict = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        domain, slash, start = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def branches(rows: DataFrame) -> DataFrame:
    """(host, template, segment, part): the branch that each segment below a parent takes."""
    counts = [F.sum(x).alias(x) for x in ("blocked", "labelled")]
    child = rows.groupBy("host", "template", "segment").agg(F.count("*").alias("paths"), *counts)
    parent = child.groupBy("host", "template").agg(F.count("*").alias("kinds"), F.sum("paths").alias("all_paths"))
    variable = (F.col("kinds") >= LEAST) & (F.col("kinds") >= F.col("all_paths") * VARIED) & (F.col("paths") < LEAST)
    child = child.join(parent, ["host", "template"]).withColumn("variable", variable)
    spread = child.filter("variable").groupBy("host", "template").agg(F.count("*").alias("values"), F.count_if(F.col("labelled") > 0).alias("known"))
    told = (F.col("known") >= LEAST) & (F.col("known") >= F.col("values") * VARIED)
    child = child.join(spread.filter(told).select("host", "template", F.lit(True).alias("told")), ["host", "template"], "left")
    child = child.withColumn("variable", F.col("variable") & ((F.col("labelled") == 0) | F.col("told").isNotNull()))
    child = c.stored(child.drop("kinds", "all_paths", "paths", "told"))
    # Branches with the same counts can't be told apart, so a parent has one row for each pair of counts.
    alike = child.filter("NOT variable AND labelled > 0").groupBy("host", "template", "blocked", "labelled").agg(F.count("*").alias("same"))
    by_rate = Window.partitionBy("host", "template").orderBy(F.col("blocked") / F.col("labelled"), "blocked", "labelled")
    b, m = F.col("blocked") * F.col("same"), F.col("labelled") * F.col("same")
    b0, m0 = F.lag(b).over(by_rate), F.lag(m).over(by_rate)
    pooled = (b + b0) / (m + m0)
    z2 = (b / m - b0 / m0) ** 2 / F.nullif(pooled * (1 - pooled) * (1 / m + 1 / m0), F.lit(0.0))
    told = F.when(m0.isNull() | (z2 >= Z * Z), 1).otherwise(0)
    alike = alike.withColumn("told", told).withColumn("group", F.sum("told").over(by_rate))
    alike = alike.withColumn("members", F.sum("same").over(Window.partitionBy("host", "template", "group"))).drop("told", "same")
    child = child.join(alike, ["host", "template", "blocked", "labelled"], "left")
    part = F.when(F.col("variable"), "*").when(F.col("labelled") == 0, "*0")
    part = part.when(F.col("members") == 1, F.concat(F.lit("="), "segment")).otherwise(F.concat(F.lit("*"), "group"))
    return child.select("host", "template", "segment", part.alias("part"))


def path_templates(paths: DataFrame) -> DataFrame:
    """(host, path, template) for distinct (host, path) rows with counts n, blocked and labelled."""
    rows = paths.withColumn("rest", F.split(F.regexp_replace("path", "^/", ""), "/", DEPTH)).withColumn("template", F.lit(""))
    ended = []
    while True:
        rows = c.stored(rows)
        ended.append(rows.filter(F.size("rest") == 0).select("host", "path", "template", "blocked", "labelled"))
        rows = rows.filter(F.size("rest") > 0).withColumn("segment", F.element_at("rest", 1))
        if not rows.limit(1).count():
            break
        rows = rows.join(branches(rows), ["host", "template", "segment"])
        rows = rows.withColumn("template", F.concat_ws("/", "template", "part")).withColumn("rest", F.slice("rest", 2, F.size("rest"))).drop("segment", "part")
    out = ended[0]
    for more in ended[1:]:
        out = out.unionByName(more)
    return out


def judged(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """Rows (page_id, host, path, rule, verdict, template, purity), one a row of ``pages``."""
    host, path = host_and_path(F.col("url"))
    df = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    df = df.withColumn("rule", rule).withColumn("of_rule", verdict)
    paths = df.groupBy("host", "path").agg(
        F.count("*").alias("n"), F.count_if(F.col("of_rule") == "block").alias("blocked"), F.count("of_rule").alias("labelled")
    )
    templates = c.stored(path_templates(paths))
    purity = (F.sum("blocked") + SMOOTH) / (F.sum("labelled") + 2 * SMOOTH)
    known = templates.groupBy("host", "template").agg(purity.alias("purity"))
    by_path = templates.select("host", "path", "template").join(known, ["host", "template"])
    out = df.join(by_path, ["host", "path"])
    learnt = F.when(F.col("purity") >= REJECT, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("of_rule", learnt).alias("verdict"), "template", "purity")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(c.read_table(spark, sf_dir, "pages"))
