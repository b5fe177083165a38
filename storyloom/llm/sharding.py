"""Sharding by size-tiered compaction.

Arrivals are appended as small immutable Parquet shards. Shards of like size form tiers; when a tier has enough of them,
they are merged into larger ones, up to a target size. A manifest lists the shards of a version; a version becomes visible by
one atomic rename, which fails if another writer has taken that version.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.llm._manifest import CommitConflict, Manifests

TARGET_BYTES = 128 << 20
FANOUT = 4
#: Sizes below it are one tier; each next tier is FANOUT times as large.
LEAST_BYTES = 1 << 20
#: Commits that are tried again after another writer was first.
TRIES = 20
#: Files that no kept version lists are deleted at this age: younger ones may be arrivals that are not committed yet.
GRACE_SECONDS = 24 * 3600


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int


@dataclass(frozen=True)
class Manifest:
    version: int
    shards: tuple[Shard, ...]
    #: The rows' schema as JSON; None before the first append.
    schema: str | None = None


def unused(names: list[str], wanted: str) -> str:
    """``wanted``, with underscores in front until no column has that name, in any case."""
    taken = {n.lower() for n in names}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


class ShardStore:
    """A folder with ``data/`` (shards, never changed) and ``manifests/`` (one JSON file for each version).

    Rows are kept as they come: nulls, repeated rows, empty and very long texts and any column names. All appends have
    the schema of the first one. Reading an empty store that has a schema yields no rows; without one it is a ValueError. A writer that
    dies leaves files that no manifest lists; ``expire`` deletes them once they are older than the grace period.
    """

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT, least_bytes: int = LEAST_BYTES):
        self.spark, self.root = spark, root.rstrip("/")
        self.target_bytes, self.fanout, self.least_bytes = target_bytes, fanout, least_bytes
        self.manifests = Manifests(spark, root)

    def at(self, version: int) -> Manifest:
        found = self.manifests.read(version)
        return Manifest(version, tuple(Shard(**x) for x in found["shards"]), found["schema"])

    def current(self) -> Manifest:
        """The newest version; version 0 without shards if there is none."""
        versions = self.manifests.versions()
        return self.at(versions[-1]) if versions else Manifest(0, ())

    def commit(self, base: Manifest, shards: tuple[Shard, ...], schema: str | None = None) -> Manifest:
        """Makes ``shards`` the version after ``base``; a CommitConflict if another writer has made it."""
        schema = base.schema or schema
        version = self.manifests.commit(base.version, {"shards": [asdict(x) for x in shards], "schema": schema})
        return Manifest(version, shards, schema)

    def _retried(self, change: Callable[[Manifest], tuple[Shard, ...] | None], schema: str | None = None) -> Manifest | None:
        """Commits what ``change`` makes of the newest version, again if another writer was first; None if it makes nothing."""
        for last in range(TRIES, 0, -1):
            base = self.current()
            shards = change(base)
            if shards is None:
                return None
            try:
                return self.commit(base, shards, schema)
            except CommitConflict:
                if last == 1:
                    raise
                time.sleep(0.05)

    def _write(self, rows: DataFrame) -> tuple[Shard, ...]:
        """Writes ``rows``, a file for each partition, in a folder of its own. Files of a run that dies are in no manifest."""
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").parquet(folder)
        found = self.manifests.files().listStatus(self.manifests.path(folder))
        return tuple(Shard(s.getPath().toString(), s.getLen()) for s in found if s.getPath().getName().endswith(".parquet"))

    def append(self, rows: DataFrame) -> Manifest:
        """Adds the files that Spark's partitions of ``rows`` make; no shuffle, so an arrival is as cheap as its scan."""
        base = self.current()
        if base.schema is not None:
            kept = T.StructType.fromJson(json.loads(base.schema))
            if [(f.name, f.dataType) for f in kept.fields] != [(f.name, f.dataType) for f in rows.schema.fields]:
                raise ValueError(f"rows have {rows.schema.simpleString()}, the store {kept.simpleString()}")
        shards = self._write(rows)
        return self._retried(lambda now: now.shards + shards, rows.schema.json())

    def tier(self, size: int) -> int:
        k, bound = 0, self.least_bytes
        while size >= bound and bound < self.target_bytes:
            k, bound = k + 1, bound * self.fanout
        return k

    def plan(self, shards: tuple[Shard, ...]) -> list[list[Shard]]:
        """Groups of ``fanout`` or more shards of one tier, each of about the target size at most. Shards of half the target size or more are done."""
        groups = []
        by: dict[int, list[Shard]] = {}
        for s in sorted(shards, key=lambda s: s.path):
            if 2 * s.bytes < self.target_bytes:
                by.setdefault(self.tier(s.bytes), []).append(s)
        for _, same in sorted(by.items()):
            now: list[Shard] = []
            size = 0
            for s in same:
                if now and size + s.bytes > self.target_bytes:
                    groups.append(now)
                    now, size = [], 0
                now.append(s)
                size += s.bytes
            groups.append(now)
        return [g for g in groups if len(g) >= self.fanout]

    def compact(self) -> Manifest:
        """Merges what ``plan`` finds until nothing is left to merge; one version for each round.

        All groups of a round are merged by one job: each shard is read with its group's number and rows are dealt by it. Groups
        are of bounded size, so no task gets more than about a target file. Shards that other writers append meanwhile stay; if another
        compaction has merged one of the same shards first, this round's result is dropped and planned anew.
        """
        while groups := self.plan((base := self.current()).shards):
            by_group = {s.path.rsplit("/", 2)[-2] + "/" + s.path.rsplit("/", 1)[-1]: k for k, g in enumerate(groups) for s in g}
            old = {s for g in groups for s in g}
            rows = self._rows(base, tuple(sorted(old, key=lambda s: s.path)))
            file, group = unused(rows.columns, "_file"), unused(rows.columns, "_group")
            # one row for each shard that is merged, as in the manifest that the driver holds anyway: broadcast, so that rows are shuffled once, when they are dealt
            names = self.spark.createDataFrame(sorted(by_group.items()), f"`{file}` string, `{group}` int")
            parts = F.split(F.input_file_name(), "/")
            tagged = rows.withColumn(file, F.concat_ws("/", F.element_at(parts, -2), F.element_at(parts, -1)))
            dealt = tagged.join(F.broadcast(names), file).repartitionByRange(len(groups), F.col(f"`{group}`"))
            merged = self._write(dealt.drop(file, group))
            self._retried(lambda now: tuple(s for s in now.shards if s not in old) + merged if old <= set(now.shards) else None)
        return self.current()

    def _rows(self, manifest: Manifest, shards: tuple[Shard, ...]) -> DataFrame:
        if manifest.schema is None:
            raise ValueError(f"nothing was appended to {self.root}")
        schema = T.StructType.fromJson(json.loads(manifest.schema))
        if not shards:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[s.path for s in shards])

    def read(self, manifest: Manifest | None = None) -> DataFrame:
        """The rows of a version; readers of older versions are not disturbed by later ones."""
        manifest = manifest or self.current()
        return self._rows(manifest, manifest.shards)

    def expire(self, keep_versions: int = 1, grace_seconds: float = GRACE_SECONDS) -> int:
        """Deletes files that none of the last ``keep_versions`` versions lists and that are older than ``grace_seconds``; returns how many.

        An arrival that is written but not committed yet is younger than the grace period, which must be longer than any write takes.
        Older manifests are deleted first, so that no version is left that lists a deleted file.
        """
        versions = self.manifests.versions()
        kept = versions[-max(1, keep_versions) :]
        keep = {s.path for v in kept for s in self.at(v).shards}
        self.manifests.forget(kept[0] if kept else 0)
        files, n = self.manifests.files(), 0
        folder = self.manifests.path(f"{self.root}/data")
        before = time.time() - grace_seconds
        for one in files.listStatus(folder) if files.exists(folder) else []:
            for s in files.listStatus(one.getPath()):
                if s.getPath().getName().endswith(".parquet") and s.getPath().toString() not in keep and s.getModificationTime() / 1000 <= before:
                    n += files.delete(s.getPath(), False)
        return n
