"""Benchmark decontamination with one Aho-Corasick automaton over normalised test items.

The patterns are windows of consecutive item words, as numbers of a vocabulary of the items' words, so that the automaton has a state for each word and
not for each character. A document is normalised once, word by word, and scanned once; the ends of matches are words of the document and are mapped, on
request, to offsets in the original text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.llm._spark import WHOLE, whole, written
from storyloom.llm.token_output import slices

WINDOW = 13
#: Bytes of item text that one automaton holds: about 2 million states and 150 MB. More items are scanned in blocks of about this size.
BLOCK_BYTES = 1 << 20
#: Tells the scanned rows apart if there are several blocks.
ROW = "_scanned_row"
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: Maps A-Z to a-z and every byte that is in no word to a space.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(NORMAL).split()


class Automaton:
    def __init__(self, items: list[tuple[str, str | None]], window: int):
        import ahocorasick

        self.numbers: dict[bytes, int] = {}  # 0 stands for words that are in no item
        owners: dict[tuple[int, ...], list[str]] = {}
        for item, text in items:
            words = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in normal_words(text)]
            # an item of fewer words than a window is one pattern; without words it is none
            for pattern in dict.fromkeys(tuple(words[k : k + window]) for k in range(max(1, len(words) - window + 1)) if words):
                owners.setdefault(pattern, []).append(item)
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for pattern, of in owners.items():
            self.machine.add_word(pattern, (len(pattern), tuple(of)))
        self.any = bool(owners)
        if self.any:
            self.machine.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """The hit word ranges, merged and in order, and the items whose windows occur."""
        if not self.any or not words:
            return [], set()
        found, items = [], set()
        for end, (n, of) in self.machine.iter(tuple([self.numbers.get(w, 0) for w in words])):
            found.append((end + 1 - n, end + 1))
            items.update(of)
        merged: list[tuple[int, int]] = []
        for a, b in sorted(found):
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        return merged, items


def _scanner(shared, window: int, spans: bool):
    def original(text: str, ranges: list[tuple[int, int]]) -> list[dict]:
        raw = text.encode("utf-8", "surrogatepass")
        places = [m.span() for m in WORD.finditer(raw)]
        chars = lambda at: len(raw[:at].decode("utf-8", "surrogatepass"))
        return [{"first": chars(places[a][0]), "last": chars(places[b - 1][1])} for a, b in ranges]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Automaton(shared.value, window)  # for this task only, so that no worker keeps it for later stages
        span = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
        for big in batches:
            for batch in slices(big, "text"):
                out = {"n_words": [], "hits": [], "items": [], "spans": []}
                for text in batch.column("text").to_pylist():
                    words = normal_words(text)
                    ranges, items = machine.scan(words)
                    out["n_words"].append(len(words))
                    out["hits"].append([{"first": a, "last": b} for a, b in ranges])
                    out["items"].append(sorted(items))
                    out["spans"].append(original(text, ranges) if spans and ranges else [])
                columns = [pa.array(out["n_words"], pa.int64()), pa.array(out["hits"], span), pa.array(out["items"], pa.list_(pa.string())), pa.array(out["spans"], span)]
                keep = [c for c in batch.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + columns, [*keep, "n_words", "hits", "items", "spans"])

    return run


def scan(docs: DataFrame, items: DataFrame, window: int = WINDOW, spans: bool = False, block_bytes: int = BLOCK_BYTES, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys``, n_words, hits (word ranges), items (ids as strings) and spans (ranges of characters) of each row of ``docs``.

    Null and empty texts have no words and no hits. Items without words are no pattern. Rows of ``items`` that repeat
    an id add up to one item; a null id is the empty id. The size of the items is measured first: up to ``block_bytes`` they
    are broadcast as one automaton; beyond that, documents are written with a row id and scanned once for each block of items, and the ranges
    of a row are merged by that id. Every row of ``docs`` is kept as a row of its own in both cases, whatever its ``keys``: they may repeat or be null.
    """
    spark = docs.sparkSession
    texts = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("string").alias("text"))

    def count_blocks() -> int:
        bytes_ = texts.agg(F.sum(F.octet_length("text") + F.octet_length("item") + 32)).first()[0]
        return max(1, -(-(bytes_ or 0) // block_bytes))

    blocks = count_blocks()
    if blocks > 1:  # equal rows add nothing to an item, and one block would get all of them
        texts = written(texts.distinct(), "items")
        blocks = count_blocks()
    ranges = "array<struct<first: int, last: int>>"
    found = f"n_words long, hits {ranges}, items array<string>, spans {ranges}"
    source = docs.select(*keys, F.col("text").cast("string").alias("text"))

    def scanned(rows: DataFrame, block: DataFrame, kept: list[T.StructField]) -> DataFrame:
        patterns = [(r["item"], r["text"]) for r in block.collect()]  # about block_bytes
        return rows.mapInArrow(_scanner(spark.sparkContext.broadcast(patterns), window, spans), T.StructType([*kept, *T.StructType.fromDDL(found).fields]))

    if blocks == 1:
        return scanned(source, texts, [docs.schema[k] for k in keys])
    source = written(source.withColumn(ROW, F.monotonically_increasing_id()), "scanned")
    every = None
    for k in range(blocks):
        # by id and text, so that an id with very many rows is spread over blocks
        part = scanned(source.select(ROW, "text"), texts.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k), [T.StructField(ROW, T.LongType())])
        every = part if every is None else every.union(part.where(F.size("hits") > 0))  # the first block has every row
    pair = "struct<first: int, last: int, begin: int, end: int>"
    placed = F.transform(
        F.arrays_zip("hits", "spans"),
        lambda x: F.struct(x["hits"]["first"].alias("first"), x["hits"]["last"].alias("last"), x["spans"]["first"].alias("begin"), x["spans"]["last"].alias("end")),
    )
    merged = F.aggregate(
        "placed",
        F.expr(f"cast(array() as array<{pair}>)"),
        lambda done, x: F.when(
            (F.size(done) > 0) & (F.element_at(done, F.greatest(F.size(done), F.lit(1))).getField("last") >= x["first"]),
            F.concat(
                F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))),
                F.array(
                    F.struct(
                        F.element_at(done, -1)["first"].alias("first"), F.greatest(F.element_at(done, -1)["last"], x["last"]).alias("last"),
                        F.element_at(done, -1)["begin"].alias("begin"), F.greatest(F.element_at(done, -1)["end"], x["end"]).alias("end"),
                    )
                ),
            ),
        ).otherwise(F.concat(done, F.array(x))),
    )
    by_row = every.select(ROW, "n_words", placed.alias("placed"), "items").groupBy(ROW).agg(
        F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("placed"))).alias("placed"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    ).withColumn("placed", merged)
    by_row = by_row.select(
        F.col(ROW).alias("_row"), "n_words", F.transform("placed", lambda x: F.struct(x["first"].alias("first"), x["last"].alias("last"))).alias("hits"), "items",
        (F.transform("placed", lambda x: F.struct(x["begin"].alias("first"), x["end"].alias("last"))) if spans else F.expr(f"cast(array() as {ranges})")).alias("spans"),
    )
    mine = source.drop("text").toDF(*[f"_k{i}" for i in range(len(keys))], ROW)  # names of keys may be those of results
    joined = mine.join(by_row, mine[ROW] == by_row["_row"])
    return joined.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], "n_words", "hits", "items", "spans")


def report(scanned: DataFrame) -> DataFrame:
    """Adds n_hit, n_items, items_sha256 and contaminated: at least one word in twenty lies in a window of an item."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda s, x: s + x["last"] - x["first"])
    return (
        scanned.withColumn("n_hit", n_hit)
        .withColumn("n_items", F.size("items").cast("long"))
        .withColumn("items_sha256", F.sha2(F.array_join("items", ","), 256))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    )


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that are not contaminated.

    Scanning carries all columns along as one, so no join is needed, repeated rows stay as they are and any names may be there.
    """
    scanned = report(scan(docs.select("text", whole(docs)), items, keys=(WHOLE,)))
    return scanned.where(~F.col("contaminated")).select(f"{WHOLE}.*")
