"""Chat formatting: layouts are told apart by schema fingerprints and mapped to canonical turns.

A fingerprint is a hash of the sorted nested field paths of a table schema or of a JSON record. The registry maps
fingerprints to declarative mappings: which paths hold the conversation id, the roles and the texts. Canonical turns
are written in one template whose control strings are escaped inside texts, so the output can be read back.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURNS = "conv_id long, turn long, role string, text string"
OPEN, CLOSE = "### ", "</turn>"


def schema_paths(kind: T.DataType, at: str = "") -> set[str]:
    """The nested field paths of a Spark type; ``[]`` stands for the elements of an array."""
    if isinstance(kind, T.StructType):
        return {p for f in kind.fields for p in schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)}
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{at}[]")
    return {at}


def record_paths(value, at: str = "") -> set[str]:
    """The nested field paths of a parsed JSON record. Empty arrays and objects count as leaves."""
    if isinstance(value, dict) and value:
        return {p for k, v in value.items() for p in record_paths(v, f"{at}.{k}" if at else k)}
    if isinstance(value, list) and value:
        return {p for v in value for p in record_paths(v, f"{at}[]")}
    return {at}


def fingerprint(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its parts.

    ``paths``: the field paths that make the layout; ``optional``: others that may be there too.
    ``turns``: (role, path) pairs in order, for layouts with one field for each turn; a role that starts with ``@``
    is a field beside the text. ``each``: the array whose elements are the turns, if there is one.
    """

    name: str
    conv_id: str
    paths: tuple[str, ...]
    turns: tuple[tuple[str, str], ...]
    each: str = ""
    optional: tuple[str, ...] = ()
    roles: dict = field(default_factory=dict, hash=False)

    def fingerprints(self) -> set[str]:
        found = [set(self.paths)]
        for extra in self.optional:
            found += [x | {extra} for x in found]
        return {fingerprint(x) for x in found}


SHARE_GPT = {"human": "user", "gpt": "assistant"}
MAPPINGS = (
    Mapping("turn_rows", "conv_id", ("conv_id", "turn", "role", "text"), (("@role", "text"),)),
    Mapping("messages", "id", ("id", "messages[].role", "messages[].content"), (("@role", "content"),), each="messages"),
    Mapping("share_gpt", "id", ("id", "conversations[].from", "conversations[].value"), (("@from", "value"),), each="conversations", roles=SHARE_GPT),
    Mapping("instruction", "id", ("id", "instruction", "output"), (("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output")), optional=("input", "system")),
    Mapping("prompt_response", "id", ("id", "prompt", "response"), (("system", "system"), ("user", "prompt"), ("assistant", "response")), optional=("system",)),
    Mapping("prompt_completion", "id", ("id", "prompt", "completion"), (("system", "system"), ("user", "prompt"), ("assistant", "completion")), optional=("system",)),
    Mapping("question_answer", "id", ("id", "question", "answer"), (("user", "question"), ("assistant", "answer"))),
)


def registry(mappings: tuple[Mapping, ...] = MAPPINGS) -> dict[str, Mapping]:
    return {key: m for m in mappings for key in m.fingerprints()}


def turns_from_table(table: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Canonical turns (conv_id, turn, role, text) of a table with one turn a row.

    The mapping is chosen by the fingerprint of the table's schema. Columns that no mapping names are ignored: the
    largest set of columns that is a known layout counts. A null role or text becomes empty; a null conv_id is
    a conversation of its own id null; an unknown layout is an error.
    """
    for m in mappings:
        columns = [c for c in table.columns if c in set(m.paths)]
        if not m.each and len(columns) == len(set(columns)) == len(m.paths) and fingerprint(schema_paths(table.select(*columns).schema)) in m.fingerprints() and "turn" in m.paths:
            (role, text), = m.turns
            return table.select(
                F.col(m.conv_id).cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                F.coalesce(F.col(role[1:]).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
            )
    raise ValueError(f"no mapping for the layout with fields {sorted(schema_paths(table.schema))}")


TURN_TYPES = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())


def whole_number(value) -> int:
    """``value`` as a 64-bit integer; a ValueError for anything else, fractions and truth values, too."""
    if isinstance(value, str) and re.fullmatch(r"\s*[+-]?[0-9]{1,19}\s*", value):
        value = int(value)
    if not isinstance(value, int) or isinstance(value, bool) or not -(1 << 63) <= value < 1 << 63:
        raise ValueError(value)
    return value


def turns_from_records(records: DataFrame, column: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Canonical turns, and ``layout``, of JSON records of several layouts in one column.

    Each record's own fingerprint selects its mapping. Fields that are null or absent yield no turn, except that a
    turn in an array keeps its place with an empty text. Records that do not parse, that nest too deeply, whose id is not a whole number of 64 bits (as a
    number or as digits in a string), or of an unknown layout yield one row with null conv_id and turn, the record as text and layout
    ``unknown``, so that none is lost unseen and none ends the job.
    """
    known = registry(mappings)

    def turns_of(raw: str | None) -> list[tuple]:
        try:
            x = json.loads(raw)
            m = known[fingerprint(record_paths(x))]
            conv = whole_number(x[m.conv_id])
            turns = []
            for y in x[m.each] if m.each else [x]:
                for role, path in m.turns:
                    said = y.get(path)
                    if said is None and not m.each:
                        continue
                    role = str(y.get(role[1:]) or "") if role[:1] == "@" else role
                    turns.append((m.roles.get(role, role), "" if said is None else str(said)))
            return [(conv, k, role, text, m.name) for k, (role, text) in enumerate(turns)]
        except (TypeError, ValueError, KeyError, AttributeError, RecursionError):
            return [(None, None, "", raw or "", "unknown")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [turn for raw in batch.column(0).to_pylist() for turn in turns_of(raw)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(TURN_TYPES)], ["conv_id", "turn", "role", "text", "layout"])

    return records.select(F.col(column).cast("string")).mapInArrow(run, TURNS + ", layout string")


# Template: "### role: text</turn>\n". A backslash before a control string or another backslash makes it plain text.
CONTROLS = re.compile(r"\\(\\|###|</turn>|:)|</turn>\n|###\x20")


def escape(text, role: bool = False):
    """The text as a column expression in which no control string is left bare; in a role the colon is one too."""
    for plain in ("\\", "###", CLOSE, *[":"] * role):
        text = F.replace(text, F.lit(plain), F.lit("\\" + plain))
    return text


def format_turns(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Adds ``piece``, the formatted turn, and the loss span of its text in code points (``loss_from`` to ``loss_to``)."""
    body, role = escape(F.col("text")), escape(F.col("role"), role=True)
    head = F.concat(F.lit(OPEN), role, F.lit(": "))
    start = F.length(head)
    stop = F.when(F.col("role") == loss_role, start + F.length(body)).otherwise(start)
    return turns.withColumn("piece", F.concat(head, body, F.lit(CLOSE + "\n"))).withColumn("loss_from", start).withColumn("loss_to", stop)


def unescape(text: str) -> str:
    return re.sub(r"\\(\\|###|</turn>|:)", r"\1", text)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    turns, at, role = [], 0, None
    for m in CONTROLS.finditer(formatted):
        if m[0] == CLOSE + "\n" and role is not None:
            turns.append((unescape(role), unescape(formatted[at : m.start()])))
            role = None
        elif m[0] == OPEN and role is None:
            colon = re.compile(r"(?:[^\\:]|\\(?:\\|###|</turn>|:))*").match(formatted, m.end()).end()
            role, at = formatted[m.end() : colon], colon + 2
    return turns


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


DIGEST_TYPES = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation, from formatted turns that come in order. Holds the hashes of one conversation only."""
    conv, state = None, None

    def row() -> tuple:
        return (conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

    def sent(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(DIGEST_TYPES)], [x.split()[0] for x in DIGEST.split(", ")])

    for batch in batches:
        out = []
        for key, piece, start, stop in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "piece", "loss_from", "loss_to"))):
            if state is None or key != conv:
                if state:
                    out.append(row())
                conv, state = key, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text in parse(piece):
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            lost = unescape(piece[start:stop])
            state[2] += len(lost)
            state[3].update(lost.encode("utf-8", "surrogatepass"))
            state[4] += len(piece)
        yield sent(out)
    if state:
        yield sent([row()])


def digests(formatted: DataFrame) -> DataFrame:
    """What each formatted conversation holds, read back from its pieces in the order of turns.

    Turns that repeat a number are ordered by role and text. One shuffle brings the turns of a conversation together, sorted; a
    long conversation streams through its task and is never held as one row. An empty table yields no rows.
    """
    return (
        formatted.repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .select("conv_id", "piece", "loss_from", "loss_to")
        .mapInArrow(_digests, DIGEST)
    )
