"""A positional inverted index over fields of documents, in immutable segments, and phrase search on it.

A posting is a token in a field with its places in the documents of one block and the documents that they are in, numbers counted from the block's first, so that nothing is added up when they are read. Postings are dealt to folders by a hash of their token and sorted by it, so
a search reads the folders of its tokens, and of these the row groups whose range holds them; a token that very many documents have is in many blocks, so it is in many rows of a bounded length.
New documents become a new segment; deleted and replaced ones are named in a segment's tombstones. Segments are merged into one on request.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.operators.search import phrases
from storyloom.sources.shared import shared_folder

#: Folders that tokens are dealt to, and documents of a block.
BUCKETS, BLOCK = 64, 4096
POSTINGS = "token string, field int, block long, docs array<int>, places array<int>"
#: Parts of a folder's tokens that are dealt to tasks, words that a task packs at once, and documents of a word of a bitmap.
PARTS, PACKED, BITS = 8, 1_000_000, 64


def _bucket(token: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def packed(block: int):
    """Rows of POSTINGS out of batches of (doc, fields...), some thousand documents at once: what a block has of a token may be in several rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = {}, 0
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        names = ["token", "field", "block", "docs", "places"]

        def out():
            rows = [(*key, *found[key]) for key in sorted(found)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 5, kinds)], names)

        for batch in batches:
            docs, *fields = [c.to_pylist() for c in batch.columns]
            for k, doc in enumerate(docs):
                b = doc // block
                for field, texts in enumerate(fields):
                    words = [w for w in (texts[k] or "").split(" ") if w]
                    for place, token in enumerate(words):
                        at, places = found.setdefault((token, field, b), ([], []))
                        at.append(doc - b * block)
                        places.append(place)
                    n += len(words)
                if n >= PACKED:
                    yield out()
                    found, n = {}, 0
        yield out()

    return run


def moved(back: int):
    return lambda place: place - back


class TextIndex:
    """An index in a folder of the shared file system. ``fields`` are the columns that are searched, in their order; they hold searchable texts.

    Documents are numbers that do not repeat within the index: a document that comes again replaces the former one. A batch becomes visible when its segment's file of facts is there, which is written last.
    """

    def __init__(self, spark: SparkSession, fields: list[str], path: str | None = None, buckets: int = BUCKETS, block: int = BLOCK):
        self.spark, self.fields, self.buckets, self.block = spark, fields, buckets, block
        self.path = (path or f"{shared_folder(spark)}/text-index-{uuid.uuid4().hex}").rstrip("/")
        self.read = 0

    def _files(self):
        jvm = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        folder = jvm.Path(self.path)
        return jvm, folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def segments(self) -> list[int]:
        """The numbers of the segments that count, oldest first: those that no later one says it replaces."""
        jvm, files = self._files()
        folder = jvm.Path(f"{self.path}/facts")
        found = {int(s.getPath().getName()): json.loads(self.spark.read.text(str(s.getPath())).first()[0]) for s in (files.listStatus(folder) if files.exists(folder) else [])}
        gone = {n for fact in found.values() for n in fact["replaces"]}
        return sorted(n for n in found if n not in gone)

    def _commit(self, segment: int, replaces: list[int]) -> None:
        jvm, files = self._files()
        out = files.create(jvm.Path(f"{self.path}/facts/{segment}"), False)
        out.write(bytearray(json.dumps({"replaces": replaces}).encode()))
        out.close()

    def _dealt(self, postings: DataFrame) -> DataFrame:
        """Postings dealt to tasks as they are written, by ``part``: those of a token stand together."""
        return postings.withColumn("part", F.pmod(F.xxhash64("token"), F.lit(self.buckets * PARTS)).cast("int")).repartition("part")

    def _write(self, dealt: DataFrame, segment: int) -> None:
        rows = dealt.withColumn("bucket", F.col("part") % self.buckets).drop("part").sortWithinPartitions("bucket", "token", "field", "block")
        rows.write.partitionBy("bucket").option("compression", "zstd").parquet(f"{self.path}/postings/segment={segment}")

    def add(self, documents: DataFrame, key: str) -> int:
        """Indexes ``documents`` (``key``, fields) as a segment and returns its number. Documents that the index has already are replaced; null keys are left out."""
        rows = documents.where(F.col(key).isNotNull())
        segment = max(self.segments(), default=0) + 1
        # a document's postings come out of its own row, and are shuffled once, many of a token in one row
        texts = rows.select(F.col(key).cast("long").alias("doc"), *self.fields)
        self._write(self._dealt(texts.mapInArrow(packed(self.block), POSTINGS)), segment)
        rows.select(F.col(key).cast("long").alias("doc")).distinct().write.parquet(f"{self.path}/documents/segment={segment}")
        self._commit(segment, [])
        return segment

    def delete(self, documents: DataFrame, key: str) -> int:
        """Takes documents out of the index, by a segment of tombstones alone."""
        segment = max(self.segments(), default=0) + 1
        documents.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc")).distinct().write.parquet(f"{self.path}/documents/segment={segment}")
        self._commit(segment, [])
        return segment

    def _stored(self, tokens: list[str] | None = None) -> DataFrame | None:
        """POSTINGS and ``segment`` as they are stored; of ``tokens`` only, whose folders alone are listed and read. None if there are none."""
        live, found = self.segments(), None
        jvm, files = self._files()
        for segment in live:
            folder = f"{self.path}/postings/segment={segment}"
            if not files.exists(jvm.Path(folder)):
                continue
            part = self.spark.read.schema(f"{POSTINGS}, bucket int").parquet(folder).withColumn("segment", F.lit(segment).cast("long"))
            if tokens is not None:
                buckets = [r[0] for r in self.spark.createDataFrame([(t,) for t in tokens], "t string").select(_bucket(F.col("t"), self.buckets)).distinct().collect()]
                part = part.where(F.col("bucket").isin(*buckets) & F.col("token").isin(*tokens))
            found = part if found is None else found.union(part)
        return None if found is None else found.select("token", "field", "segment", "block", "docs", "places")

    def postings(self, tokens: list[str] | None = None) -> DataFrame:
        """(token, field, segment, doc, places) of the segments that count; of ``tokens`` only, whose folders alone are listed and read."""
        found = self._stored(tokens)
        if found is None:
            return self.spark.createDataFrame([], "token string, field int, segment long, doc long, places array<int>")
        # a document's places stand together: it goes from where it begins to where the next one does
        opens = found.withColumn("opens", F.filter(F.sequence(F.lit(0), F.size("docs") - 1), lambda i: (i == 0) | (F.get("docs", i) != F.get("docs", i - 1))))
        of_doc = lambda i, k: F.struct(F.get("docs", i).alias("doc"), F.slice("places", i + 1, F.coalesce(F.get("opens", k + 1), F.size("docs")) - i).alias("places"))
        each = opens.select("token", "field", "segment", "block", F.explode(F.transform("opens", of_doc)).alias("x"))
        return each.select("token", "field", "segment", (F.col("block") * self.block + F.col("x.doc")).alias("doc"), F.col("x.places").alias("places"))

    def newest(self) -> DataFrame | None:
        """(doc, segment): the last segment that names each document; None if one segment has all."""
        live = self.segments()
        if len(live) < 2:
            return None
        rows = reduce(DataFrame.union, [self.spark.read.schema("doc long").parquet(f"{self.path}/documents/segment={n}").withColumn("segment", F.lit(n).cast("long")) for n in live])
        return rows.groupBy("doc").agg(F.max("segment").alias("segment"))

    def search(self, query: str | None) -> DataFrame:
        """(doc): documents in which each phrase of ``query`` stands in one of the fields; none for a query without phrases.

        A phrase's tokens follow each other in one field: places of each token are moved back by its number in the phrase and meet, the rarest token first. Phrases meet by document.
        """
        wanted = [p.split(" ") for p in dict.fromkeys(phrases(query))]
        nothing = self.spark.createDataFrame([], "doc long")
        if not wanted or not self.segments():
            return nothing
        read = self.postings(sorted({w for p in wanted for w in p}))
        counts = {r["token"]: r["n"] for r in read.groupBy("token").agg(F.count("*").alias("n")).collect()}
        if any(w not in counts for p in wanted for w in p):
            return nothing
        of_phrase = []
        for phrase in wanted:
            found = None
            for at in sorted(range(len(phrase)), key=lambda k: counts[phrase[k]]):
                starts = read.where(F.col("token") == phrase[at]).select("field", "segment", "doc", F.transform("places", moved(at)).alias("starts"))
                if found is None:
                    found = starts
                else:
                    met = found.join(starts.withColumnRenamed("starts", "more"), ["field", "segment", "doc"])
                    found = met.select("field", "segment", "doc", F.array_intersect("starts", "more").alias("starts")).where(F.size("starts") > 0)
            of_phrase.append((min(counts[w] for w in phrase), found.select("doc", "segment").distinct()))
        of_phrase.sort(key=lambda x: x[0])
        found = reduce(lambda a, b: a.join(b, ["doc", "segment"], "left_semi"), [f for _, f in of_phrase])
        newest = self.newest()
        return (found if newest is None else found.join(newest, ["doc", "segment"], "left_semi")).select("doc")

    def gone(self) -> DataFrame:
        """(segment, block, bits): the documents of a block that a later segment names, as bits of whole numbers; only blocks that have some."""
        rows = reduce(DataFrame.union, [self.spark.read.schema("doc long").parquet(f"{self.path}/documents/segment={n}").withColumn("segment", F.lit(n).cast("long")) for n in self.segments()])
        per_doc = rows.groupBy("doc").agg(F.array_sort(F.collect_set("segment")).alias("s")).where(F.size("s") > 1)
        block = F.expr(f"(doc - pmod(doc, {self.block})) div {self.block}")
        each = per_doc.select(block.alias("block"), F.pmod("doc", F.lit(self.block)).cast("int").alias("at"), F.explode(F.expr("slice(s, 1, size(s) - 1)")).alias("segment"))
        words = each.groupBy("segment", "block", F.floor(F.col("at") / BITS).cast("int").alias("k")).agg(F.bit_or(F.expr(f"shiftleft(1L, at % {BITS})")).alias("b"))
        of_block = words.groupBy("segment", "block").agg(F.map_from_entries(F.collect_list(F.struct("k", "b"))).alias("m"))
        return of_block.select("segment", "block", F.transform(F.sequence(F.lit(0), F.lit((self.block - 1) // BITS)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0).cast("long"))).alias("bits"))

    def merge(self) -> None:
        """Makes one segment of all: postings of replaced and deleted documents go, those of a token and block are put together."""
        live, newest = self.segments(), self.newest()
        if newest is None:
            return
        segment, stored = live[-1] + 1, self._stored()
        if stored is not None:
            # documents that are gone are taken out of a posting's arrays: postings are neither taken apart nor joined by document
            there = F.expr(f"filter(arrays_zip(docs, places), e -> (shiftright(bits[e.docs div {BITS}], cast(e.docs % {BITS} as int)) & 1L) = 0L)")
            left = stored.join(self.gone(), ["segment", "block"], "left").withColumn("x", F.when(F.col("bits").isNotNull(), there))
            left = left.select("token", "field", "block", F.coalesce("x.docs", "docs").alias("docs"), F.coalesce("x.places", "places").alias("places")).where(F.size("docs") > 0)
            whole = self._dealt(left).groupBy("part", "token", "field", "block").agg(F.collect_list(F.struct("docs", "places")).alias("x"))
            whole = whole.withColumn("x", F.array_sort(F.arrays_zip(F.flatten("x.docs").alias("docs"), F.flatten("x.places").alias("places"))))
            self._write(whole.select("part", "token", "field", "block", "x.docs", "x.places"), segment)
        newest.select("doc").write.parquet(f"{self.path}/documents/segment={segment}")
        self._commit(segment, live)

    def expire(self) -> None:
        """Deletes what segments hold that do not count any more. Searches that began before a merge must have ended."""
        jvm, files = self._files()
        live = self.segments()
        for kind in ("postings", "documents"):
            folder = jvm.Path(f"{self.path}/{kind}")
            for old in files.listStatus(folder) if files.exists(folder) else []:
                if int(old.getPath().getName().split("=")[1]) < min(live):
                    files.delete(old.getPath(), True)

    def drop(self) -> None:
        jvm, files = self._files()
        files.delete(jvm.Path(self.path), True)
