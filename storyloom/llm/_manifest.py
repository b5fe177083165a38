"""Versioned manifests in a folder of the shared file system, committed by an atomic rename."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class CommitConflict(RuntimeError):
    """Another writer has committed the version."""


class Manifests:
    """``root``/manifests holds one JSON file for each version. A version is never changed; the newest one counts."""

    def __init__(self, spark: SparkSession, root: str):
        self.root = root.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._new_array = spark.sparkContext._gateway.new_array
        self._utf8 = spark.sparkContext._jvm.java.nio.charset.StandardCharsets.UTF_8
        self._read_all = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString

    def path(self, name: str):
        return self._hadoop.fs.Path(name)

    def files(self):
        return self.path(self.root).getFileSystem(self._conf)

    def versions(self) -> list[int]:
        folder, files = self.path(f"{self.root}/manifests"), self.files()
        names = [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def read(self, version: int) -> dict:
        stream = self.files().open(self.path(f"{self.root}/manifests/v{version:012d}.json"))
        try:
            return json.loads(self._read_all(stream, self._utf8))
        finally:
            stream.close()

    def current(self) -> tuple[int, dict | None]:
        """The newest version and what it says; version 0 and None if there is none."""
        versions = self.versions()
        return (versions[-1], self.read(versions[-1])) if versions else (0, None)

    def commit(self, base: int, content: dict) -> int:
        """Makes ``content`` the version after ``base``. The rename replaces no file, so of two writers with one base the second fails."""
        version = base + 1
        part = self.path(f"{self.root}/manifests/.{uuid.uuid4().hex}")
        out = self.files().create(part)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        context = self._hadoop.fs.FileContext.getFileContext(part.toUri() if part.toUri().getScheme() else self.files().getUri(), self._conf)
        options = self._new_array(self._hadoop.fs.Options.Rename, 0)
        try:
            context.rename(part, self.path(f"{self.root}/manifests/v{version:012d}.json"), options)
        except Exception as e:
            self.files().delete(part, False)
            if "FileAlreadyExists" in str(e):
                raise CommitConflict(str(version)) from e
            raise
        return version

    def forget(self, before: int) -> None:
        """Deletes the manifests of versions below ``before``."""
        for version in self.versions():
            if version < before:
                self.files().delete(self.path(f"{self.root}/manifests/v{version:012d}.json"), False)
