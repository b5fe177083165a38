"""Token-ID output: documents as one concatenated id array with Elias-Fano document boundaries.

The file format is a Parquet dataset of *blocks*. A block holds the ids of consecutive documents as one packed
array, the document ends as an Elias-Fano sequence with select samples, and the document ids as another one. A
block never splits a document. Blocks are ordered by (part, block); parts follow the order of document ids.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from storyloom.llm._spark import fresh_path

#: Ids in a block, unless one document alone has more.
BLOCK_IDS = 1 << 20
#: One select sample for so many documents.
SAMPLE = 64
#: Values whose low bits are packed at once, a multiple of 8.
RUN = 1 << 12
#: Words whose ids a worker remembers, about 40 MB; beyond it, the memory is emptied.
REMEMBERED = 200_000
#: Text that is encoded at once.
SLICE = 2 << 20
END_ID = 1

BLOCK_SCHEMA = (
    "part int, block int, part_start long, n_docs long, n_ids long, n_unnamed long, first_doc long, id_bytes int, ids binary, "
    "end_low_bits int, end_low binary, end_high binary, end_samples binary, "
    "doc_low_bits int, doc_low binary, doc_high binary, doc_samples binary"
)
ROW_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


class EliasFano:
    """A sequence of non-decreasing non-negative integers below ``universe`` in about 2 + log2(universe/n) bits each.

    The low bits are packed as they are. The high bits are written in unary into a bit array: the i-th value
    sets bit ``high + i``. ``samples`` holds the place of each 64th set bit in 32 bits, so that ``select`` looks at a short
    stretch only. An empty sequence has no bytes.
    """

    def __init__(self, low_bits: int, low: bytes, high: bytes, samples: bytes, n: int):
        self.low_bits, self.low, self.high, self.samples, self.n = low_bits, low, high, samples, n

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        if not n:
            return cls(0, b"", b"", b"", 0)
        low_bits = max(0, int(np.floor(np.log2(max(1, (int(values[-1]) + 1) / n)))))
        places = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(places[-1]) + 1, dtype=np.uint8)
        bits[places] = 1
        return cls(
            low_bits,
            cls._packed(values, low_bits),
            np.packbits(bits, bitorder="little").tobytes(),
            places[::SAMPLE].astype("<u4").tobytes(),
            n,
        )

    @staticmethod
    def _packed(values: np.ndarray, low_bits: int) -> bytes:
        """The low bits of all values, one after the other. Runs of ``RUN`` values end at whole bytes, so they are packed run by run."""
        shifts, out = np.arange(low_bits, dtype=np.uint64), []
        for at in range(0, len(values) if low_bits else 0, RUN):
            bits = (values[at : at + RUN, None] >> shifts[None, :]).astype(np.uint8) & 1
            out.append(np.packbits(bits.ravel(), bitorder="little").tobytes())
        return b"".join(out)

    def _low(self, first: int, count: int) -> np.ndarray:
        out = np.zeros(count, dtype=np.int64)
        weights = np.int64(1) << np.arange(self.low_bits, dtype=np.int64)
        for at in range(0, count if self.low_bits else 0, RUN):
            many = min(RUN, count - at)
            start, stop = (first + at) * self.low_bits, (first + at + many) * self.low_bits
            packed = np.frombuffer(self.low, dtype=np.uint8)[start // 8 : (stop + 7) // 8]
            bits = np.unpackbits(packed, bitorder="little")[start % 8 :][: stop - start].reshape(many, self.low_bits)
            out[at : at + many] = bits @ weights
        return out

    def select(self, i: int) -> int:
        """The i-th value, without decoding the others: from the sample before it, bytes are skipped by the number of their set bits."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place = int.from_bytes(self.samples[i // SAMPLE * 4 : i // SAMPLE * 4 + 4], "little")
        left, byte = i % SAMPLE, place // 8
        bits = self.high[byte] >> place % 8 << place % 8
        while (ones := bits.bit_count()) <= left:
            left -= ones
            byte += 1
            bits = self.high[byte]
        for _ in range(left):
            bits &= bits - 1
        high = 8 * byte + (bits & -bits).bit_length() - 1 - i
        first = i * self.low_bits
        low = int.from_bytes(self.low[first // 8 : (first + self.low_bits + 7) // 8], "little") >> first % 8 & (1 << self.low_bits) - 1
        return high << self.low_bits | low

    def range(self, i: int) -> tuple[int, int]:
        """Where document i begins and ends, if the values are the documents' ends."""
        return (self.select(i - 1) if i else 0), self.select(i)

    def decode(self) -> np.ndarray:
        if not self.n:
            return np.zeros(0, dtype=np.int64)
        places = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, dtype=np.uint8), bitorder="little"))[: self.n]
        return ((places - np.arange(self.n)) << self.low_bits) | self._low(0, self.n)


def _byte_letters() -> dict[int, str]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, then those from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


#: ASCII marks that end a run of letters whatever follows; the apostrophe is not one, since it may begin a suffix.
MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and c != 39)


class WordEncoder:
    """Encodes texts word by word and remembers the ids of words it has seen.

    Splitting at space, tab and line ends is exact for tokenizers that never form a token across them, as the
    ones with a pre-tokenizer that drops white space; other tokenizers need ``by_word=False``. If the tokenizer lower-cases
    and takes runs of letters as pre-tokens, a new word of Latin-1 letters goes to its model without the regular expressions before it, and marks
    after the letters are encoded apart.
    """

    def __init__(self, path: str, by_word: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks fill the cores
        from tokenizers import Tokenizer

        self.tokenizer, self.by_word = Tokenizer.from_file(path), by_word
        self.known: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.type = np.dtype("<u2") if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.dtype("<u4")
        about = json.loads(self.tokenizer.to_str())
        steps = [x["type"] for x in (about["normalizer"] or {}).get("normalizers", [])]
        before = (about["pre_tokenizer"] or {}).get("pretokenizers", [])
        pattern = before[0].get("pattern", {}).get("Regex", "") if before else ""
        letters = "|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
        self.by_letters = steps == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in before] == ["Split", "ByteLevel"] and pattern.endswith(letters)
        self.model, self.table = self.tokenizer.model, _byte_letters()

    def _ids(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype=self.type).tobytes() for x in found]

    def _piece(self, word: str) -> bytes:
        """The ids of a word of Latin-1 letters in lower case."""
        raw = word if word.isascii() else word.encode().decode("latin1").translate(self.table)
        return b"".join([x.id.to_bytes(self.type.itemsize, "little") for x in self.model.tokenize(raw)])

    def _new(self, words: set[str]) -> None:
        known, pieces, rest = self.known, self.pieces, []
        for word in words:
            core = word.rstrip(MARKS)
            if not self.by_letters or not core.isalpha() or max(core) > "\xff":
                rest.append(word)
                continue
            tail, core = word[len(core) :], core.lower()
            ids = pieces.get(core)
            if ids is None:
                ids = pieces[core] = self._piece(core)
            if tail:
                if tail not in pieces:
                    pieces[tail] = self._ids([tail])[0]
                ids += pieces[tail]
            known[word] = ids
        for at in range(0, len(rest), 4096):
            part = rest[at : at + 4096]
            known.update(zip(part, self._ids(part)))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The packed ids of each text."""
        if not self.by_word:
            return self._ids(texts)
        split = [x.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for x in texts]
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        if len(self.pieces) > REMEMBERED:
            self.pieces.clear()
        self._new({w for words in split for w in words if w not in known})
        return [b"".join([known[w] for w in words]) for words in split]


_encoders: dict[tuple, WordEncoder] = {}


def _encoder(path: str, by_word: bool) -> WordEncoder:
    """One encoder for each Python worker, which serves many tasks."""
    if (path, by_word) not in _encoders:
        _encoders[path, by_word] = WordEncoder(path, by_word)
    return _encoders[path, by_word]


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of ``batch`` in which ``column`` has about ``most`` bytes, so that memory follows bytes and not rows."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(lengths) // most
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    for start, stop in zip(starts, [*starts[1:], len(group)]):
        yield batch.slice(start, stop - start)


def _blocks(path: str, by_word: bool, end_id: int, block_ids: int):
    def block(part: int, number: int, start: int, docs: list[int], ends: list[int], ids: list[bytes], width: int) -> dict:
        named = [x for x in docs if x is not None]  # null ids come last
        first = named[0] if named else 0
        end = EliasFano.encode(np.array(ends))
        doc = EliasFano.encode(np.array(named, dtype=object) - first)
        return {
            "part": part, "block": number, "part_start": start, "n_docs": len(docs), "n_ids": ends[-1], "n_unnamed": len(docs) - len(named), "first_doc": first,
            "id_bytes": width, "ids": b"".join(ids),
            "end_low_bits": end.low_bits, "end_low": end.low, "end_high": end.high, "end_samples": end.samples,
            "doc_low_bits": doc.low_bits, "doc_low": doc.low, "doc_high": doc.high, "doc_samples": doc.samples,
        }

    schema = pa.schema(
        [(n, {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in BLOCK_SCHEMA.split(", "))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, by_word)
        width, stop = encoder.type.itemsize, np.array([end_id], dtype=encoder.type).tobytes()
        part, number, written = TaskContext.get().partitionId(), 0, 0
        docs: list[int] = []
        ends: list[int] = []
        kept: list[bytes] = []
        for big in batches:
            for batch in slices(big, "text", SLICE):
                texts = [x or "" for x in batch.column("text").to_pylist()]
                for doc, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(texts)):
                    size = len(ids) // width + 1
                    if docs and ends[-1] + size > block_ids:
                        yield pa.RecordBatch.from_pylist([block(part, number, written, docs, ends, kept, width)], schema)
                        number, written, docs, ends, kept = number + 1, written + ends[-1], [], [], []
                    ends.append((ends[-1] if ends else 0) + size)
                    docs.append(doc)
                    kept += (ids, stop)
        if docs:
            yield pa.RecordBatch.from_pylist([block(part, number, written, docs, ends, kept, width)], schema)

    return run


def write_tokens(
    docs: DataFrame, to: str, tokenizer: str, by_word: bool = True, end_id: int = END_ID, block_ids: int = BLOCK_IDS
) -> None:
    """Writes ``docs`` (doc_id, text; other columns are ignored) in ascending doc_id order in the block format to ``to``.

    A null text counts as empty and yields the end id alone. Rows without a doc_id come last; they keep their null. Rows that repeat a
    doc_id, or have none, are all written, next to each other, and ranges split them by a hash of their texts. An empty table writes a dataset without blocks. One range
    shuffle puts documents in order; the ids are made behind it, so that no step encodes a text twice.
    """
    spark = docs.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .repartitionByRange(parts, F.col("doc_id").asc_nulls_last(), F.xxhash64("text"))
        .sortWithinPartitions(F.col("doc_id").asc_nulls_last(), "text")
        .mapInArrow(_blocks(tokenizer, by_word, end_id, block_ids), BLOCK_SCHEMA)
        .write.option("compression", "none")
        .parquet(to)
    )


class Block:
    """One block of a dataset as it is read: documents by number, each found by ``select`` alone."""

    def __init__(self, row: dict):
        self.n, self.n_named, self.first_doc = row["n_docs"], row["n_docs"] - row["n_unnamed"], row["first_doc"]
        self.ends = EliasFano(row["end_low_bits"], row["end_low"], row["end_high"], row["end_samples"], self.n)
        self.docs = EliasFano(row["doc_low_bits"], row["doc_low"], row["doc_high"], row["doc_samples"], self.n_named)
        self.ids = np.frombuffer(row["ids"], dtype=f"<u{row['id_bytes']}")

    def doc_id(self, i: int) -> int | None:
        return self.docs.select(i) + self.first_doc if i < self.n_named else None

    def tokens(self, i: int) -> np.ndarray:
        start, end = self.ends.range(i)
        return self.ids[start:end]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            # ids stay where Arrow has them; no block is copied
            x = {name: batch.column(name)[k] for name in batch.schema.names}
            x = {name: cell.as_buffer() if name == "ids" else cell.as_py() for name, cell in x.items()}
            block, start, out = Block(x), 0, ([], [], [], [])
            for i in range(block.n):
                end = block.ends.select(i)
                for cells, value in zip(out, (block.doc_id(i), x["base"] + start, end - start, zlib.crc32(block.ids[start:end].astype("<u4")))):
                    cells.append(value)
                start = end
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks of a dataset with ``base``, the number of ids in all blocks before each one.

    A block knows the ids before it in its part. Across parts, a window adds up one row for each part; the
    writer's partition count bounds their number, so that table may be broadcast.
    """
    blocks = spark.read.parquet(path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("total"))
    parts = parts.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("part_base"))
    return blocks.join(F.broadcast(parts), "part").withColumn("base", F.col("part_base") + F.col("part_start"))


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, read from the files alone."""
    return read_blocks(spark, path).mapInArrow(_rows, ROW_SCHEMA)


def token_output(docs: DataFrame, tokenizer: str, to: str | None = None, **options) -> DataFrame:
    to = to or fresh_path(docs.sparkSession, "tokens")
    write_tokens(docs, to, tokenizer, **options)
    return read_rows(docs.sparkSession, to)
