"""Versioned tables whose rows lie in hash buckets of a key, so that a change writes only the buckets that it touches.

A table is a folder of files, and a version a manifest that names the files of each bucket.  A change is made
against the version it has read: it writes whole new buckets and then the next manifest, which fails if
another writer was first.  So readers see a change whole or not at all, and what a change costs
follows the buckets it touches.  Rows can also be added beside a bucket's files, and ``compacted`` makes one file of
each bucket that has several.  A manifest may carry marks, such as the last batch of a stream that it holds.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.sources import paths

BUCKETS = 64


class Conflict(FileExistsError):
    """Another writer's change came first."""


@dataclass(frozen=True)
class Version:
    """What a manifest says: its number, and by table and bucket the files, as paths below the root."""

    number: int = 0
    buckets: int = BUCKETS
    files: dict[str, dict[int, list[str]]] = field(default_factory=dict)
    marks: dict[str, int] = field(default_factory=dict)


class Buckets:
    """Tables of a root folder; ``tables`` gives the schema and the key of each."""

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, tuple[str, str]], buckets: int = BUCKETS):
        self.spark, self.root, self.tables, self.buckets = spark, root.rstrip("/"), tables, buckets

    # --- versions --------------------------------------------------------------------------

    def latest(self) -> int:
        found = [x.removesuffix(".json") for x in paths.names(self.spark, f"{self.root}/versions") if x.endswith(".json") and not x.startswith(".")]
        return max(map(int, found), default=0)

    def version(self, number: int | None = None) -> Version:
        n = self.latest() if number is None else number
        if not n:
            return Version(buckets=self.buckets)
        body = paths.read_json(self.spark, f"{self.root}/versions/{n:09d}.json")
        return Version(n, body["buckets"], {t: {int(b): x for b, x in of.items()} for t, of in body["files"].items()}, body["marks"])

    # --- reading ---------------------------------------------------------------------------

    def bucket(self, table: str, base: Version, key: Column | None = None) -> Column:
        name = self.tables[table][1]
        return F.pmod(F.xxhash64((F.col(name) if key is None else key).cast("string")), F.lit(base.buckets)).cast("int")

    def buckets_of(self, base: Version, keys: Iterable) -> list[int]:
        """The buckets of a few keys."""
        one = lambda k: self.spark.sql("SELECT pmod(xxhash64(:k), CAST(:n AS INT)) AS b", {"k": str(k), "n": base.buckets}).first().b
        return sorted({int(one(k)) for k in keys})

    def read(self, table: str, base: Version, buckets: Iterable[int] | None = None) -> DataFrame:
        """A table as of a version, or only these buckets of it."""
        schema = self.tables[table][0]
        of = base.files.get(table, {})
        wanted = sorted(of) if buckets is None else sorted(set(buckets) & set(of))
        found = [f"{self.root}/{x}" for b in wanted for x in of[b]]
        return self.spark.read.schema(schema).parquet(*found) if found else self.spark.createDataFrame([], schema)

    # --- changes ---------------------------------------------------------------------------

    def _write(self, table: str, rows: DataFrame, base: Version) -> dict[int, list[str]]:
        """Files of rows by bucket.  A bucket is cut over tasks by a salt as well, so a large one isn't one task's."""
        wanted = self.spark.createDataFrame([], self.tables[table][0]).schema
        name = f"{table}/{uuid.uuid4().hex}"
        typed = rows.select(*(F.col(f.name).cast(f.dataType) for f in wanted)).withColumn("_bucket", self.bucket(table, base))
        typed.repartition("_bucket", F.pmod(F.xxhash64(*wanted.names), F.lit(4))).write.partitionBy("_bucket").parquet(f"{self.root}/{name}")
        parts = [x for x in paths.names(self.spark, f"{self.root}/{name}") if x.startswith("_bucket=")]
        return {int(x.removeprefix("_bucket=")): [f"{name}/{x}"] for x in parts}

    def changed(self, base: Version, replaced: dict[str, tuple[DataFrame, Iterable[int]]] | None = None, added: dict[str, DataFrame] | None = None, marks: dict[str, int] | None = None) -> Version:
        """The next version after ``base``: in some tables these rows instead of what was in these buckets, in some these beside it.

        Fails with ``Conflict`` if there is such a version already.
        """
        files = {t: dict(of) for t, of in base.files.items()}
        for table, (rows, buckets) in (replaced or {}).items():
            new = self._write(table, rows, base)
            gone = set(buckets)
            if stray := set(new) - gone:
                raise ValueError(f"rows of {table} lie in other buckets: {sorted(stray)}")
            files[table] = {**{b: x for b, x in files.get(table, {}).items() if b not in gone}, **new}
        for table, rows in (added or {}).items():
            of = files.setdefault(table, {})
            for b, x in self._write(table, rows, base).items():
                of[b] = [*of.get(b, []), *x]
        new = Version(base.number + 1, base.buckets, files, {**base.marks, **(marks or {})})
        body = json.dumps({"buckets": new.buckets, "files": new.files, "marks": new.marks})
        try:
            paths.create(self.spark, f"{self.root}/versions/{new.number:09d}.json", body)
        except FileExistsError as e:
            raise Conflict(f"version {new.number} exists") from e
        return new

    def compacted(self, base: Version, most: int = 1) -> Version:
        """The next version, in which no bucket has more than so many parts; the same version if none has."""
        changes = {}
        for table, of in base.files.items():
            if many := [b for b, x in of.items() if len(x) > most]:
                changes[table] = (self.read(table, base, many), many)
        return self.changed(base, changes) if changes else base

    def vacuum(self, keep: int = 1) -> None:
        """Deletes the files that none of the last versions names."""
        last = self.latest()
        used = {x for n in range(max(1, last - keep + 1), last + 1) for of in self.version(n).files.values() for xs in of.values() for x in xs}
        for table in self.tables:
            for name in paths.names(self.spark, f"{self.root}/{table}"):
                for part in paths.names(self.spark, f"{self.root}/{table}/{name}"):
                    if part.startswith("_bucket=") and f"{table}/{name}/{part}" not in used:
                        paths.delete(self.spark, f"{self.root}/{table}/{name}/{part}")
                if not any(x.startswith(f"{table}/{name}/") for x in used):
                    paths.delete(self.spark, f"{self.root}/{table}/{name}")
