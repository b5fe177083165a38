"""Versioned tables: each version is a folder of its own, and a pointer file says which one counts."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``; only a local master may go without that setting."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    found = "file://" + tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


class VersionedTable:
    """A table whose versions are never changed. A version becomes the current one by the rename of its pointer, which replaces no file."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        folder = self._path(f"{self.root}/pointers")
        names = [s.getPath().getName() for s in self._files.listStatus(folder)] if self._files.exists(folder) else []
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def publish(self, rows: DataFrame, partition: list[str] | None = None) -> int:
        """Writes ``rows`` as the next version. A run that dies leaves a folder that no pointer names; a lost race is an error and changes nothing."""
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        rows.write.partitionBy(*partition or []).parquet(folder)
        version = max(self.versions(), default=0) + 1
        part = self._path(f"{self.root}/pointers/.{uuid.uuid4().hex}")
        out = self._files.create(part)
        out.write(bytearray(json.dumps({"folder": folder, "schema": rows.schema.json()}).encode()))
        out.close()
        if not self._files.rename(part, self._path(f"{self.root}/pointers/v{version:09d}.json")):
            raise RuntimeError(f"version {version} was published by another writer")
        return version

    def _pointer(self, version: int) -> dict:
        text = self.spark.read.text(f"{self.root}/pointers/v{version:09d}.json", wholetext=True).first()["value"]
        return json.loads(text)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, by default the newest one."""
        from pyspark.sql.types import StructType

        versions = self.versions()
        if not versions:
            raise ValueError(f"nothing was published to {self.root}")
        found = self._pointer(version or versions[-1])
        return self.spark.read.schema(StructType.fromJson(json.loads(found["schema"]))).parquet(found["folder"])

    def prune(self, keep: int = 20) -> int:
        """Deletes all but the newest ``keep`` versions; returns how many."""
        gone = self.versions()[: -max(1, keep)]
        for version in gone:
            folder = self._pointer(version)["folder"]
            self._files.delete(self._path(f"{self.root}/pointers/v{version:09d}.json"), False)
            self._files.delete(self._path(folder), True)
        return len(gone)
