"""Small file operations through Spark's own file systems, so that they also work on a cluster's storage."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, in order; none if it doesn't exist."""
    fs, p = _fs(spark, folder)
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def create(spark: SparkSession, path: str, text: str, replace: bool = False) -> None:
    """A small file with this text, whole or not at all; fails if it's there, unless it may be replaced.

    It's written beside its place and renamed in one step, which replaces what is there or fails if something is; readers see
    the old file or the new one.  File systems whose renames aren't atomic, such as object stores, don't give that.
    """
    fs, p = _fs(spark, path)
    jvm = spark._jvm
    part = jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{p.getName()}.{uuid.uuid4().hex}.part")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE if replace else rename.NONE
    full = fs.makeQualified(p)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(full.toUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(part), full, how)
    except Py4JJavaError as e:
        fs.delete(part, False)
        if "FileAlreadyExistsException" in str(e.java_exception):
            raise FileExistsError(path) from e
        raise


def read(spark: SparkSession, path: str) -> str:
    return "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())


def delete(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.delete(p, True)


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(read(spark, path))


def write_files(files: DataFrame, folder: str) -> None:
    """Rows (name, body binary) as files of a folder, each whole or not at all.

    Executors write them by pyarrow's file systems, so the folder must be one that all of them share: one without a scheme
    is on the default file system, and a local one is refused where Spark runs on more than one machine.
    """
    spark = files.sparkSession
    fs_, p = _fs(spark, folder)
    folder = fs_.makeQualified(p).toString()
    if folder.startswith("file:") and not spark.sparkContext.master.startswith("local"):
        raise ValueError("executors don't share a local folder")

    def put(rows):
        from pyarrow import fs

        target, top = (fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")) if folder.startswith("file:") else fs.FileSystem.from_uri(folder)
        target.create_dir(top, recursive=True)
        for r in rows:
            with target.open_output_stream(f"{top}/.{r.name}.part") as out:
                out.write(bytes(r.body))
            target.move(f"{top}/.{r.name}.part", f"{top}/{r.name}")

    files.select("name", "body").foreachPartition(put)
