"""Incremental substring dedup over a log-structured fingerprint index.

A document's fingerprints are hashes of short word runs, thinned by winnowing: each window of ``WINDOW`` words has one, its run of the smallest hash,
and equal windows have the same one. The index keeps fingerprints in immutable runs, sorted and bucketed by hash, and so it keeps
digests of windows. Each new batch becomes a run and is merge-joined with the older runs; runs of like size are compacted. Only windows whose
fingerprint repeats, in the batch or in what was indexed before, are compared, by a 128-bit digest of their words. The windows of a fingerprint are
read from the texts once, when it first repeats; from then on their digests are in the index.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from storyloom.llm._manifest import Manifests
from storyloom.llm._spark import discard, fresh_path, written
from storyloom.llm._words import WordHashes, run_hashes
from storyloom.llm.token_output import slices

WINDOW = 20
#: Words of a fingerprint's run. Fewer words: fewer fingerprints, but more that repeat by chance.
GRAM = 9
#: Text that one slice holds; within it, repeats are found without a shuffle.
SLICE = 8 << 20
#: Runs of one tier that are merged into one.
FANOUT = 4


def _split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def winnow(grams: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places of the smallest hash (the first of equal ones) in each ``reach`` consecutive ones; for each the first such stretch and their number."""
    if len(grams) < reach:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    stretches = np.lib.stride_tricks.sliding_window_view(grams, reach)
    return np.unique(stretches.argmin(axis=1) + np.arange(len(stretches)), return_index=True, return_counts=True)


def _first_of(keys: np.ndarray) -> np.ndarray:
    """Whether each key is the first of its equals."""
    first = np.zeros(len(keys), dtype=bool)
    first[np.unique(keys, return_index=True)[1]] = True
    return first


def _digest(window: int):
    """Of each document: words, digest of all words, its fingerprints that are new in this slice, with the windows that have them (``n`` from ``at`` on), and the windows of the others."""
    gram = min(GRAM, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered = WordHashes()
        for big in batches:
            for batch in slices(big, "text", SLICE):
                rows, hashes, starts, counts = [], [], [], []
                for text in batch.column("text").to_pylist():
                    words = _split(text)
                    rows.append((len(words), hashlib.sha256(b" ".join(words)).hexdigest()))
                    # a document of fewer words than a window has no window
                    grams = run_hashes(remembered.of(words), gram) if len(words) >= window else np.zeros(0, np.uint64)
                    places, start, count = winnow(grams, window - gram + 1)
                    hashes.append(grams[places])
                    starts.append(start)
                    counts.append(count)
                flat = np.concatenate(hashes)
                _, number, many = np.unique(flat, return_inverse=True, return_counts=True)
                new, repeated = _first_of(flat), many[number] > 1
                ends = np.cumsum([len(x) for x in hashes])
                out = []
                for begin, end, start, count in zip(np.concatenate(([0], ends[:-1])), ends, starts, counts):
                    part = slice(begin, end)
                    keep = new[part]
                    out.append((flat[part][keep].view(np.int64), start[keep], count[keep], repeated[part][keep], start[~keep], count[~keep]))
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.int32())
                lists = [pa.array([x[k] for x in out], pa.list_(kind)) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("version"), pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows]), *lists],
                    ["doc_id", "version", "n_words", "sha", "hash", "at", "n", "again", "known_at", "known_n"],
                )

    return run


DIGEST = "doc_id long, version long, n_words long, sha string, hash array<long>, at array<int>, n array<int>, again array<boolean>, known_at array<int>, known_n array<int>"
#: The columns of the runs of both kinds, and the column that they are bucketed and sorted by.
RUNS = {
    "fingerprints": ("hash", "hash LONG, doc_id LONG, version LONG, at INT, n INT, again BOOLEAN"),
    "windows": ("one", "one LONG, two LONG, doc_id LONG, version LONG, p INT, n INT, old BOOLEAN, first BOOLEAN"),
}


class FingerprintIndex:
    """Immutable runs in a folder, each a table that is bucketed and sorted by its hash: fingerprints with their windows, and digests of windows.

    A manifest lists the runs and the texts of the batches so far; a session that opens the folder later goes on from there. A batch
    becomes visible by the manifest's atomic rename, so a run that dies half-way leaves the index as it was. A fingerprint of which there was only one so far is in one
    row without ``again``, which says where to read its windows; all windows of others are among the digests.

    ``texts`` is a table (doc_id, text) that holds all documents of former batches, where the caller has one; otherwise each batch's texts are kept in the folder.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, buckets: int | None = None, fanout: int = FANOUT, texts: DataFrame | None = None):
        self.spark, self.fanout, self.texts = spark, fanout, texts
        self.root = (root or fresh_path(spark, "fingerprints")).rstrip("/")
        self.manifests = Manifests(spark, self.root)
        self.version, found = self.manifests.current()
        found = found or {"buckets": buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), "fingerprints": [], "windows": [], "texts": []}
        self.buckets: int = found["buckets"]
        self.runs: dict[str, list[dict]] = {kind: found[kind] for kind in RUNS}  # tier, path
        self.kept: list[str] = found["texts"]

    def _name(self, run: dict) -> str:
        return f"index_run_{hashlib.sha256(run['path'].encode()).hexdigest()[:24]}"

    def table(self, kind: str, run: dict) -> DataFrame:
        """The run as a bucketed table; a session that does not know it yet registers it by its path."""
        key, columns = RUNS[kind]
        if not self.spark.catalog.tableExists(self._name(run)):
            self.spark.sql(f"CREATE TABLE {self._name(run)} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {self.buckets} BUCKETS LOCATION '{run['path']}'")
        return self.spark.table(self._name(run))

    def dealt(self, kind: str, rows: DataFrame) -> DataFrame:
        """``rows`` dealt to the buckets of a kind, so that runs may be joined with them where they lie."""
        return rows.repartition(self.buckets, RUNS[kind][0])

    def write(self, kind: str, rows: DataFrame, tier: int = 0) -> dict:
        """Writes dealt rows as a run that no manifest lists yet."""
        run = {"tier": tier, "path": f"{self.root}/{kind}/{uuid.uuid4().hex}"}
        writer = rows.write.bucketBy(self.buckets, RUNS[kind][0]).sortBy(RUNS[kind][0])
        writer.option("compression", "zstd").option("path", run["path"]).saveAsTable(self._name(run))
        return run

    def history(self) -> DataFrame | None:
        """(doc_id, text) of the documents of former batches."""
        if self.texts is not None or not self.kept:
            return self.texts
        return self.spark.read.schema("doc_id long, text string").parquet(*self.kept)

    def known(self, new: DataFrame) -> DataFrame | None:
        """The fingerprints of all runs whose hash is in ``new`` (hash): each run is merge-joined by itself, so that it is not shuffled."""
        found = None
        for run in self.runs["fingerprints"]:
            hits = self.table("fingerprints", run).join(new, "hash", "left_semi")
            found = hits if found is None else found.union(hits)
        return found

    def commit(self, fingerprints: dict, windows: dict, texts: str | None) -> None:
        """Makes written runs and their batch's texts part of the index, then compacts."""
        self.runs = {"fingerprints": [*self.runs["fingerprints"], fingerprints], "windows": [*self.runs["windows"], windows]}
        self.kept = [*self.kept, *[texts] * (texts is not None)]
        self._save()
        self.compact()

    def _save(self) -> None:
        self.version = self.manifests.commit(self.version, {"buckets": self.buckets, **self.runs, "texts": self.kept})

    def compact(self) -> None:
        """Merges the runs of a tier into one of the next, as long as a tier has ``fanout`` of them: one row for each hash or digest is left."""
        for kind in RUNS:
            tier = 0
            while any(r["tier"] >= tier for r in self.runs[kind]):
                same = [r for r in self.runs[kind] if r["tier"] == tier]
                if len(same) >= self.fanout:
                    run = self.write(kind, self._merged(kind, same), tier + 1)
                    self.runs = self.runs | {kind: [r for r in self.runs[kind] if r not in same] + [run]}
                    self._save()
                    self.manifests.forget(self.version)
                    self._delete(same)
                tier += 1

    def _merged(self, kind: str, runs: list[dict]) -> DataFrame:
        rows = self.table(kind, runs[0])
        for run in runs[1:]:
            rows = rows.union(self.table(kind, run))
        if kind == "windows":
            digests = self.dealt(kind, rows.where("first").select("one", "two")).distinct()
            return digests.selectExpr("one", "two", "CAST(NULL AS LONG) AS doc_id", "CAST(NULL AS LONG) AS version", "CAST(NULL AS INT) AS p", "0 AS n", "true AS old", "true AS first")
        # dealt out before the aggregation: a union of bucketed tables is not bucketed
        place = F.min(F.struct("doc_id", "version", "at", "n")).alias("place")
        return self.dealt(kind, rows).groupBy("hash").agg(place, (F.bool_or("again") | (F.count("*") > 1)).alias("again")).select("hash", "place.*", "again")

    def _delete(self, runs: list[dict]) -> None:
        for run in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._name(run)}")
            self.manifests.files().delete(self.manifests.path(run["path"]), True)

    def drop(self) -> None:
        """Deletes the index."""
        for kind in RUNS:
            self._delete(self.runs[kind])
        self.manifests.files().delete(self.manifests.path(self.root), True)
        self.runs, self.kept = {kind: [] for kind in RUNS}, []


def _windows(window: int):
    """The windows of places (``n`` from ``at`` on): rows to compare (n = 0), and ranges of n windows that an earlier one in the slice equals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in slices(big, "text", SLICE):
                rows = sorted(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "version", "text", "places"))), key=lambda r: r[:2])
                docs, versions, starts, digests = [], [], [], []
                for doc, version, text, wanted in rows:
                    words = _split(text)
                    many = len(words) - window + 1
                    if many <= 0:
                        continue
                    near = np.zeros(many, bool)
                    for place in wanted:
                        near[place["at"] : place["at"] + place["n"]] = True
                    places = np.flatnonzero(near)
                    joined = memoryview(b" ".join(words))
                    begins = np.cumsum([0, *[len(w) + 1 for w in words]])
                    digests += [
                        hashlib.blake2b(joined[a:b], digest_size=16).digest() for a, b in zip(begins[places].tolist(), (begins[places + window] - 1).tolist())
                    ]
                    docs.append(np.full(len(places), doc, np.int64))
                    versions.append(np.full(len(places), version, np.int64))
                    starts.append(places)
                if not docs:
                    continue
                doc, version, at = map(np.concatenate, (docs, versions, starts))
                both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                one, two = both[:, 0], both[:, 1]
                new = _first_of(one ^ two)
                # repeats within the slice, as ranges of consecutive windows of one document
                d, v, p = doc[~new], version[~new], at[~new]
                cut = np.flatnonzero(np.concatenate(([True], (np.diff(d) != 0) | (np.diff(v) != 0) | (np.diff(p) != 1)))) if len(d) else np.zeros(0, np.int64)
                n = np.diff(np.append(cut, len(d)))
                out = (np.concatenate((one[new], d[cut] * 7919 + p[cut])), np.concatenate((two[new], v[cut])), np.concatenate((doc[new], d[cut])), np.concatenate((version[new], v[cut])),
                       np.concatenate((at[new], p[cut])).astype(np.int32), np.concatenate((np.zeros(int(new.sum())), n)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["one", "two", "doc_id", "version", "p", "n"])

    return run


WINDOWS = "one long, two long, doc_id long, version long, p int, n int"


def _removed(window: int):
    """n_removed, the digest of what is kept and the kept words, from a text and its ranges of repeated windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in slices(big, "text"):
                out = []
                for text, ranges in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist()):
                    words = _split(text)
                    gone = np.zeros(len(words) + 1, np.int64)
                    for r in ranges:
                        gone[r["p"]] += 1
                        gone[r["p"] + max(1, r["n"]) - 1 + window] -= 1
                    keep = np.cumsum(gone[:-1]) == 0
                    kept = b" ".join([w for w, k in zip(words, keep.tolist()) if k])
                    out.append((len(words) - int(keep.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass")))
                columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.string(), pa.string()))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("version"), *columns], [*KEY, "n_removed", "kept_sha256", "kept"])

    return run


#: Tells documents apart: rows that agree in both are one document.
KEY = ["doc_id", "version"]


def _identified(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("version"), text.alias("text"))


def _placed(texts: DataFrame, places: DataFrame, name: str) -> DataFrame:
    """(doc_id, version, text, places) of the documents with places (at, n); only their texts are read from here on."""
    own = places.groupBy(*KEY).agg(F.collect_set(F.struct("at", "n")).alias("places"))
    return written(_identified(texts).join(own, KEY).dropDuplicates(KEY), name)


def add_batch(docs: DataFrame, index: FingerprintIndex, window: int = WINDOW, texts: bool = False) -> DataFrame:
    """Adds ``docs`` (doc_id, text) to ``index`` and returns (doc_id, n_words, n_removed, kept_sha256) of each row.

    Each word is removed that a window of ``window`` words covers whose words also start earlier: in a document of a former batch, in
    a smaller doc_id of this one, or before in the same document. Windows are judged on the texts as they came, not on what is left of them.
    Null texts and texts without words have no words. Documents of fewer words than a window lose none.
    Rows that repeat a doc_id with the same text are one document, which is judged once for all of them; with other texts, they are documents in the order of a hash of
    their texts. Rows with a null doc_id are compared with none. An empty table yields no rows. A batch that was added before is judged as a copy of itself.
    With ``texts``, a column ``kept`` has the kept words of documents that lose some (null for the others).
    """
    source = _identified(docs)
    digest = written(source.mapInArrow(_digest(window), DIGEST), "digest")
    named = digest.where("doc_id IS NOT NULL")
    marks = named.select(*KEY, F.explode(F.arrays_zip("hash", "at", "n", "again")).alias("x")).select("x.hash", *KEY, "x.at", "x.n", "x.again")
    fingerprints = index.write("fingerprints", index.dealt("fingerprints", marks))
    new = index.table("fingerprints", fingerprints)
    counts = written(new.groupBy("hash").agg((F.bool_or("again") | (F.count("*") > 1)).alias("again")), "counts")
    repeated, former, found = counts.where("again").select("hash"), None, index.known(counts.select("hash"))
    if found is not None:
        place = F.min(F.struct(*KEY, "at", "n")).alias("place")
        found = written(found.groupBy("hash").agg(place, (F.bool_or("again") | (F.count("*") > 1)).alias("again")), "found")
        repeated = repeated.union(found.select("hash")).distinct()
        # fingerprints that were alone so far: their windows are read now
        former = _placed(index.history(), found.where("NOT again").select("place.*"), "former")
    places = new.join(repeated, "hash", "left_semi").select(*KEY, "at", "n")
    more = named.where(F.size("known_at") > 0).select(*KEY, F.explode(F.arrays_zip("known_at", "known_n")).alias("x")).select(*KEY, F.col("x.known_at").alias("at"), F.col("x.known_n").alias("n"))
    store = _placed(docs, places.union(more), "store")
    rows = store.mapInArrow(_windows(window), WINDOWS).withColumn("old", F.lit(False))
    if former is not None:
        rows = rows.union(former.mapInArrow(_windows(window), WINDOWS).where("n = 0").withColumn("old", F.lit(True)))
    rows = index.dealt("windows", rows).withColumn("known", F.lit(False))
    for run in index.runs["windows"]:
        seen = index.table("windows", run).where("first").select(F.col("one").alias("o"), F.col("two").alias("t"))
        rows = rows.join(seen, (F.col("one") == F.col("o")) & (F.col("two") == F.col("t")), "left").withColumn("known", F.col("known") | F.col("o").isNotNull()).drop("o", "t")
    # former documents come first; of each window only the first place is kept as it is
    rank = F.row_number().over(Window.partitionBy("one", "two").orderBy(F.col("n") > 0, ~F.col("old"), *KEY, "p"))
    ranked = rows.withColumn("first", (rank == 1) & (F.col("n") == 0) & ~F.col("known"))
    windows = index.write("windows", ranked.select("one", "two", *KEY, "p", "n", "old", "first"))
    repeats = index.table("windows", windows).where("NOT old AND NOT first")
    ranges = written(repeats.groupBy(*KEY).agg(F.collect_list(F.struct("p", "n")).alias("ranges")), "ranges")
    changed = store.select(*KEY, "text").join(ranges, KEY).mapInArrow(_removed(window), "doc_id long, version long, n_removed long, kept_sha256 string, kept string")
    changed = written(changed.drop(*["kept"] * (not texts)), "changed")
    result = digest.select(*KEY, "n_words", "sha").join(changed, KEY, "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"), *["kept"] * texts
    )
    result = written(result, "result")
    kept = None
    if index.texts is None:
        kept = f"{index.root}/texts/{uuid.uuid4().hex}"
        source.where("doc_id IS NOT NULL").select("doc_id", "text").write.option("compression", "zstd").parquet(kept)
    index.commit(fingerprints, windows, kept)
    discard(digest, counts, store, ranges, changed, *[x for x in (found, former) if x is not None])
    return result


def substring_dedup(docs: DataFrame, window: int = WINDOW, batches: int = FANOUT, index: FingerprintIndex | None = None, texts: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of each row of ``docs`` (doc_id, text), by ``add_batch`` in ``batches`` by ascending doc_id.

    Without ``index``, an index of these documents only is made, and deleted in the end. The rows are those of one batch with all documents, whatever ``batches`` is: an earlier document is in the same batch or in a former one.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    own = index is None
    index = index or FingerprintIndex(docs.sparkSession, texts=docs)
    low, high = ids.agg(F.min("doc_id"), F.max("doc_id")).first()
    cuts: list = [None, None]
    if low != high and batches > 1:
        cuts[1:1] = sorted(set(ids.where("doc_id IS NOT NULL").approxQuantile("doc_id", [k / batches for k in range(1, batches)], 0.01)))
    out = None
    for k, (start, stop) in enumerate(zip(cuts, cuts[1:])):
        part = F.lit(True) if start is None else F.col("doc_id").cast("long") > int(start)
        if stop is not None:
            part = part & (F.col("doc_id").cast("long") <= int(stop))
        if k == 0:
            part = part | F.col("doc_id").isNull()
        found = add_batch(docs.where(part), index, window, texts)
        out = found if out is None else out.union(found)
    if own:
        index.drop()
    return out
