"""Answers of models: JSON that was cut off or wrapped is repaired, then each field is checked by itself."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.sources.batches import slices

CLOSING = {"{": "}", "[": "]"}


def repaired(text: str | None) -> str | None:
    """The first JSON object of an answer, made whole: a push-down scan closes an open string and all open brackets, and takes out commas before closing brackets, keys without a value at a cut, and what follows the object.

    Null if there is no opening brace. Line ends inside strings become their escapes. A cut value of letters or digits is completed if it is a beginning of true, false or null, and stays as it is if it is a number.
    """
    if not text or "{" not in text:
        return None
    out: list[str] = []
    stack: list[str] = []
    string = False
    at, many = text.index("{"), len(text)
    while at < many:
        c = text[at]
        if string:
            if c == "\\" and at + 1 < many:
                out.append(text[at : at + 2])
                at += 2
                continue
            if c == "\\":
                break  # a cut escape
            out.append({"\n": "\\n", "\r": "\\r", "\t": "\\t"}.get(c, c))
            string = c != '"'
        elif c == '"':
            out.append(c)
            string = True
        elif c in "{[":
            stack.append(c)
            out.append(c)
        elif c in "}]":
            while stack and CLOSING[stack[-1]] != c:  # one that was forgotten
                _trim(out)
                out.append(CLOSING[stack.pop()])
            if stack:
                _trim(out)
                out.append(c)
                stack.pop()
            if not stack:
                return "".join(out)
        else:
            out.append(c)
        at += 1
    if string:
        out.append('"')
    while stack:
        if stack[-1] == "{":
            _finish(out)
        _word(out)
        _trim(out)
        out.append(CLOSING[stack.pop()])
    return "".join(out)


def _trim(out: list[str]) -> None:
    while out and (out[-1].isspace() or out[-1] == ","):
        out.pop()


def _word(out: list[str]) -> None:
    """Completes a cut true, false or null, and takes off what a number cannot end with."""
    while out and out[-1] in (".", "-", "+", "e", "E") and "".join(out[-4:]) not in ("true", "alse"):
        if out[-1] in "eE" and (len(out) < 2 or not out[-2].isdigit()):
            break
        out.pop()
    k = len(out)
    while k and out[k - 1].isalpha() and len(out[k - 1]) == 1:
        k -= 1
    word = "".join(out[k:])
    for full in ("true", "false", "null"):
        if word and full.startswith(word):
            out[k:] = list(full)


def _finish(out: list[str]) -> None:
    """Takes a key without a value off the end of an object."""
    k = len(out)
    while k and (out[k - 1].isspace() or out[k - 1] == ","):
        k -= 1
    colon = k and out[k - 1] == ":"
    if colon:
        k -= 1
        while k and out[k - 1].isspace():
            k -= 1
    if k and out[k - 1] == '"':
        begin = k - 2
        while begin >= 0 and out[begin] != '"':
            begin -= 1
        before = begin - 1
        while before >= 0 and out[before].isspace():
            before -= 1
        if before >= 0 and (colon or out[before] in "{,"):
            del out[begin:]
    elif colon:
        del out[k:]


def salvaged(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(key, answer): the repaired object of each answer, null if there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in slices(big, column):
                yield pa.RecordBatch.from_arrays([batch.column(key), pa.array([repaired(x) for x in batch.column(column).to_pylist()], pa.string())], [key, "answer"])

    return rows.select(key, column).mapInArrow(run, f"`{key}` {dict(rows.dtypes)[key]}, answer string")


def _field(value: Column, name: str) -> tuple[Column, Column]:
    """A field and whether it is there; a JSON null is not."""
    found = F.try_variant_get(value, f"$.{name}", "variant")
    return found, found.isNotNull() & (F.schema_of_variant(found) != "VOID")


def _short(value: Column, most: int) -> Column:
    """A text that is not blank and has at most ``most`` characters, else null."""
    text = F.when(F.schema_of_variant(value) == "STRING", value.cast("string"))
    return F.when((F.length(F.trim(text)) > 0) & (F.length(text) <= most), text)


def checked(answers: DataFrame, key: str) -> DataFrame:
    """(key, why, angle, points, questions, tag, hashtags, entity, theater, error, dropped) of repaired answers (key, answer).

    ``error`` tells why an answer does not count: it is no object, or its reason (whyItMatters) is missing, blank or longer than 1000 characters. Every other field is dropped by itself if it is of another kind or too long, and
    ``dropped`` names it; of lists, entries that are no good are dropped one by one. Tags get their mark.
    """
    v = F.col("v")
    tagged = lambda t: F.when(t.startswith("#"), t).otherwise(F.concat(F.lit("#"), F.regexp_replace(t, r"\s+", "")))
    rows = answers.select(key, F.try_parse_json("answer").alias("v"))
    is_object = v.isNotNull() & F.schema_of_variant(v).startswith("OBJECT")
    reason, _ = _field(v, "whyItMatters")
    why = _short(reason, 1000)
    columns, dropped = {"why": F.trim(why)}, []
    for name, field, most in (("angle", "strategicAngle", 1000), ("tag", "primaryTag", 100), ("entity", "focalEntity", 200), ("theater", "operationalTheater", 200)):
        value, there = _field(v, field)
        text = _short(value, most)
        kept = F.trim(text)
        columns[name] = tagged(kept) if name == "tag" else F.when(~F.lower(kept).isin("null", "none", "n/a"), kept) if name in ("entity", "theater") else kept
        dropped.append(F.when(there & text.isNull(), field))
    for name, field, most in (("points", "gdLecturettePoints", 500), ("questions", "potentialInterviewQuestions", 500), ("hashtags", "hashtags", 100)):
        value, there = _field(v, field)
        entries = F.when(F.schema_of_variant(value).startswith("ARRAY"), F.try_variant_get(value, "$", "array<variant>"))
        good = F.filter(F.transform(entries, _limited(most)), lambda x: x.isNotNull())
        good = F.transform(good, lambda x: F.trim(x))
        good = F.transform(good, tagged) if name == "hashtags" else good
        columns[name] = F.when(F.size(good) > 0, good)
        dropped.append(F.when(there & entries.isNull(), field).when(F.size(good) != F.size(entries), f"{field}[invalid entries]"))
    error = F.when(~F.coalesce(is_object, F.lit(False)), "root").when(why.isNull(), "whyItMatters")
    found = rows.select(key, *[c.alias(n) for n, c in columns.items()], error.alias("error"), F.filter(F.array(*dropped), lambda d: d.isNotNull()).alias("dropped"))
    good = F.col("error").isNull()
    return found.select(key, *[F.when(good, F.col(n)).alias(n) for n in columns], "error", F.when(good, F.col("dropped")).otherwise(F.array().cast("array<string>")).alias("dropped"))


def _limited(most: int):
    return lambda x: _short(x, most)
