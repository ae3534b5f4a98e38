"""Records with their history: a base table and an append-only log of changes, merged when they are read.

An edit writes its changes, not the table. Each append is a folder of Parquet files and then a manifest
with the next version's number, whose creation fails if another writer was first; readers see
versions that have a manifest, so a writer that is lost leaves nothing that counts. A snapshot
as of a version takes the last change of each id up to it. After ``OPEN`` versions the log is
folded into a new base; older versions stay readable, as their files do.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

PUT, DELETE = "put", "delete"
OPEN = 16


class ChangeLog:
    """``folder``: a path of any file system that Spark reads. Records have an id; changes have op (put or delete), row (their order) and the columns of records."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    @classmethod
    def created(cls, records: DataFrame, folder: str) -> ChangeLog:
        """A log with ``records`` as version 0."""
        log = cls(records.sparkSession, folder)
        log._commit(0, "base", records)
        return log

    def _path(self, path: str) -> tuple[object, object]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _commit(self, version: int, kind: str, rows: DataFrame) -> None:
        path = f"{self.folder}/data/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        fs, p = self._path(f"{self.folder}/versions/{version:09d}.{kind}.json")
        out = fs.create(p, False)  # an error if it is there
        out.write(json.dumps({"path": path, "schema": rows.schema.json()}).encode())
        out.close()

    def _manifests(self) -> list[tuple[int, str, str]]:
        """(version, kind, file) in order."""
        fs, p = self._path(f"{self.folder}/versions")
        names = sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []
        return [(int(n.split(".")[0]), n.split(".")[1], f"{self.folder}/versions/{n}") for n in names if n.endswith(".json")]

    def _rows(self, file: str) -> DataFrame:
        made = json.loads(self.spark.read.text(file, wholetext=True).first()["value"])
        return self.spark.read.schema(StructType.fromJson(json.loads(made["schema"]))).parquet(made["path"])

    @property
    def version(self) -> int:
        found = self._manifests()
        if not found:
            raise FileNotFoundError(self.folder)
        return max(v for v, _, _ in found)

    def append(self, changes: DataFrame) -> int:
        """Commits changes; their version. Another writer's commit in between is an error, and nothing of this one counts."""
        found = self._manifests()
        version = max(v for v, _, _ in found) + 1
        self._commit(version, "log", changes)
        if version - max(v for v, kind, _ in found if kind == "base") >= OPEN:
            self._commit(version, "base", self.as_of(version))
        return version

    def as_of(self, version: int | None = None) -> DataFrame:
        """The records of a version (the last one without): ids that were put and not deleted since."""
        found = self._manifests()
        version = max(v for v, _, _ in found) if version is None else version
        bases = [(v, file) for v, kind, file in found if kind == "base" and v <= version]
        if not bases:
            raise ValueError(f"no version {version}")
        start, file = max(bases)
        base = self._rows(file)
        logs = [self._rows(f).withColumn("_version", F.lit(v)) for v, kind, f in found if kind == "log" and start < v <= version]
        if not logs:
            return base
        changes = reduce(lambda a, b: a.unionByName(b), logs)
        columns = [c for c in base.columns if c != "id"]
        last = changes.groupBy("id").agg(F.max_by(F.struct("op", *columns), F.struct("_version", "row")).alias("_c"))
        merged = base.select("id", F.struct(*columns).alias("_r")).join(last, "id", "full")
        kept = merged.where(F.col("_c").isNull() | (F.col("_c.op") != DELETE))
        new = F.struct(*[F.col(f"_c.{c}").alias(c) for c in columns])
        return kept.select("id", F.when(F.col("_c").isNotNull(), new).otherwise(F.col("_r")).alias("_r")).select("id", "_r.*").select(*base.columns)

    def history(self, id_: str) -> DataFrame:
        """(version, op, row) of every change of an id."""
        logs = [self._rows(f).where(F.col("id") == id_).select(F.lit(v).cast("long").alias("version"), "op", F.col("row").cast("long").alias("row")) for v, kind, f in self._manifests() if kind == "log"]
        empty = self.spark.createDataFrame([], StructType([StructField("version", LongType()), StructField("op", StringType()), StructField("row", LongType())]))
        return reduce(lambda a, b: a.unionByName(b), logs, empty)
