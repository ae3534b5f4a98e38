"""Run folders: artifacts, the audit log, and what is complete."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from datetime import UTC, datetime
from os import PathLike

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmatch.sources.records import exists, load_json, save_json
from quillmatch.streaming.audit import append, read_log

NAME = re.compile(r"session_[\w\-]+")
ARTIFACTS = ("annotations", "fields", "matches")
#: The phases that each phase needs, and those that a change of it makes stale.
NEEDS = {1: (), 2: (1,), 3: (1, 2), 4: (3,)}
STALE = {1: (3, 4), 2: (3, 4), 3: (4,), 4: ()}


def valid_name(name: str) -> bool:
    return len(name) <= 64 and NAME.fullmatch(name) is not None


def _of(path: str | PathLike, spark: SparkSession | None = None) -> tuple[object, object]:
    """(file system, path) in the session's Hadoop file systems, where Spark writes too; on a cluster a driver's own disk is none of them."""
    spark = spark or SparkSession.active()
    p = spark._jvm.org.apache.hadoop.fs.Path(str(path))
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


class Session:
    """``base`` is a path of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, base: str | PathLike, name: str | None = None) -> None:
        self.spark, self.base = spark, str(base).rstrip("/")
        self.name = name or f"session_{datetime.now(UTC):%Y%m%d_%H%M%S}_{uuid.uuid4().hex[:8]}"
        self.folder = f"{self.base}/{self.name}"
        fs, p = _of(self.folder, spark)
        if name is None and fs.exists(p):
            raise FileExistsError(self.folder)
        fs.mkdirs(p)

    @classmethod
    def open(cls, spark: SparkSession, folder: str | PathLike) -> Session:
        if not exists(spark, str(folder)):
            raise FileNotFoundError(folder)
        base, _, name = str(folder).rstrip("/").rpartition("/")
        return cls(spark, base, name)

    @staticmethod
    def names(base: str | PathLike) -> list[str]:
        """Newest first."""
        fs, p = _of(base)
        found = fs.listStatus(p) if fs.exists(p) else []
        return sorted((name for f in found if f.isDirectory() and (name := f.getPath().getName()).startswith("session_")), reverse=True)

    @classmethod
    def latest(cls, spark: SparkSession, base: str | PathLike) -> Session | None:
        found = next((n for n in cls.names(base) if exists(spark, f"{base}/{n}/annotations.json")), None)
        return cls.open(spark, f"{base}/{found}") if found else None

    @staticmethod
    def rename(folder: str | PathLike, name: str) -> str:
        if not valid_name(name):
            raise ValueError(f"{name!r} can't name a session")
        fs, old = _of(folder)
        path = f"{str(folder).rstrip('/').rpartition('/')[0]}/{name}"
        new = _of(path)[1]
        if fs.exists(new):
            raise FileExistsError(path)
        if not fs.rename(old, new):
            raise OSError(f"{folder} wasn't renamed")
        return path

    @staticmethod
    def delete(folder: str | PathLike) -> None:
        fs, p = _of(folder)
        fs.delete(p, True)

    def _at(self, kind: str) -> str:
        return f"{self.folder}/{kind}.json"

    def save(self, records: DataFrame, kind: str) -> None:
        save_json(records, self._at(kind), kind)

    def load(self, kind: str) -> DataFrame:
        return load_json(self.spark, self._at(kind), kind)

    def save_report(self, report: DataFrame) -> None:
        report.write.mode("overwrite").json(self._at("qc_report"))

    def load_report(self) -> DataFrame:
        if not exists(self.spark, self._at("qc_report")):
            raise FileNotFoundError(self._at("qc_report"))
        return self.spark.read.json(self._at("qc_report"))

    def log(self, action: str, details: dict) -> None:
        append(self.spark, f"{self.folder}/audit_log", action, details)

    def audit(self) -> DataFrame:
        return read_log(self.spark, f"{self.folder}/audit_log")

    def keep_profile(self, path: str | PathLike) -> None:
        """A copy of a profile on the driver's disk."""
        fs, p = _of(self.folder, self.spark)
        fs.copyFromLocalFile(self.spark._jvm.org.apache.hadoop.fs.Path(str(path)), p)

    # A phase is complete if its entry in the manifest still has the fingerprint of what it was made from.

    def _manifest(self) -> dict[str, str]:
        path = f"{self.folder}/manifest.json"
        return json.loads(self.spark.read.text(path, wholetext=True).first()["value"]) if exists(self.spark, path) else {}

    def _write(self, manifest: dict[str, str]) -> None:
        fs, p = _of(f"{self.folder}/manifest.json", self.spark)
        out = fs.create(p, True)
        out.write(json.dumps(manifest, sort_keys=True).encode())
        out.close()

    def complete(self, phase: int, fingerprint: str = "") -> None:
        if not all(self.is_complete(n) for n in NEEDS[phase]):
            raise ValueError(f"phase {phase} needs phases {NEEDS[phase]}")
        self._write({k: v for k, v in self._manifest().items() if int(k) not in STALE[phase]} | {str(phase): fingerprint})

    def invalidate(self, *phases: int) -> None:
        self._write({k: v for k, v in self._manifest().items() if int(k) not in phases})

    def is_complete(self, phase: int, fingerprint: str | None = None) -> bool:
        made = self._manifest().get(str(phase))
        return made is not None and fingerprint in (None, made)

    def unlocked(self, phase: int) -> bool:
        return all(self.is_complete(n) for n in NEEDS[phase])

    def state(self) -> dict[str, DataFrame | None]:
        """Each artifact, None where it was never made."""
        return {k: self.load(k) if exists(self.spark, self._at(k)) else None for k in ARTIFACTS}


def fingerprint(records: DataFrame) -> str:
    """Of the rows in any order: a sum and a count of hashes."""
    row = records.agg(F.count("*").alias("n"), F.sum(F.xxhash64(F.to_json(F.struct(*records.columns))).cast("decimal(38,0)")).alias("h")).first()
    return hashlib.sha256(f"{row['n']} {row['h']}".encode()).hexdigest()
