"""File sources and sinks: template files, exports, fixture pairs, reports."""

from __future__ import annotations

import json
import posixpath
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.schema import TEMPLATES
from parlance.sources import paths


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, prompt) of a JSON array of templates; a file that is missing or no JSON holds none."""
    folder, _, name = path.rpartition("/")
    if name not in paths.names(spark, folder):
        return spark.createDataFrame([], TEMPLATES)
    raw = spark.read.text(path, wholetext=True)
    rows = raw.select(F.explode(F.from_json("value", f"array<struct<{TEMPLATES.replace(' ', ':')}>>".replace(",:", ","))).alias("t")).select("t.*")
    return rows.filter("id IS NOT NULL")


def write_templates(templates: DataFrame, path: str) -> None:
    """A JSON array, replaced as a whole.  There are at most 50 templates (``dml.MOST_TEMPLATES``)."""
    rows = [r.asDict() for r in templates.orderBy("id").collect()]
    paths.create(templates.sparkSession, path, json.dumps(rows, ensure_ascii=False, indent=2), replace=True)


def checked_target(path: str, home: str) -> str:
    """The path of an export: absolute, without .., and below a folder."""
    if not path.startswith("/"):
        raise ValueError("the path must be absolute")
    if ".." in path.split("/"):
        raise ValueError("the path must not contain ..")
    if not posixpath.normpath(path).startswith(home.rstrip("/") + "/"):
        raise ValueError(f"the path must be below {home}")
    return posixpath.normpath(path)


def export(bodies: DataFrame, target: str, home: str) -> None:
    """One document (meeting_id, body) as a text file."""
    rows = bodies.select("body").limit(2).collect()
    if len(rows) != 1:
        raise ValueError("an export is one meeting")
    paths.create(bodies.sparkSession, checked_target(target, home), rows[0].body, replace=True)


def export_all(bodies: DataFrame, folder: str, suffix: str = ".md") -> None:
    """Any number of documents (meeting_id, body) as files of a folder, written by the executors.

    What an id has besides letters, digits and ``.-*_`` is encoded in its file's name, so no file leaves the folder.
    """
    name = F.concat(F.url_encode(F.col("meeting_id").cast("string")), F.lit(suffix))
    paths.write_files(bodies.select(name.alias("name"), F.col("body").cast("binary").alias("body")), folder)


def stem(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]+)\\.[^./]+$", 1)


def fixture_pairs(spark: SparkSession, root: str) -> DataFrame:
    """(stem, transcript, audio): ``transcripts/*.txt`` and ``audio/*.wav`` of one name, in order of names.

    A clip or transcript without its other half is left out; ``unpaired`` lists those.
    """
    texts, clips = _fixtures(spark, root)
    return texts.join(clips, "stem").orderBy("stem")


def unpaired(spark: SparkSession, root: str) -> DataFrame:
    texts, clips = _fixtures(spark, root)
    return texts.join(clips, "stem", "full").filter("transcript IS NULL OR audio IS NULL").select("stem", F.when(F.col("audio").isNull(), "audio").otherwise("transcript").alias("missing")).orderBy("stem")


def _fixtures(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    def listed(folder: str, suffix: str, name: str) -> DataFrame:
        found = [x for x in paths.names(spark, f"{root}/{folder}") if x.endswith(suffix)]
        return spark.createDataFrame([(re.sub(r"\.[^.]*$", "", x), f"{root}/{folder}/{x}") for x in found], f"stem string, {name} string")

    return listed("transcripts", ".txt", "transcript"), listed("audio", ".wav", "audio")


def write_report(report: dict, spark: SparkSession, path: str) -> None:
    """A report as indented JSON."""
    paths.create(spark, path, json.dumps(report, ensure_ascii=False, indent=2), replace=True)


def json_lines(df: DataFrame) -> DataFrame:
    """Each row as one JSON text, for sinks of text; null fields are written too."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
