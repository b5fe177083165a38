"""Ordered folds: operators whose next state depends on the one before. Rows of a key stream, sorted, through one task; only the key's state is held."""

from __future__ import annotations

import re
from bisect import insort
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fold(rows: DataFrame, keys: list[str], order: list[str], step: Callable[[object, tuple], tuple[object, list[tuple]]], schema: str, last: Callable[[object], list[tuple]] | None = None) -> DataFrame:
    """What ``step`` gives for each row of each of ``keys`` in ``order``, and ``last`` for its state in the end, with the columns ``schema``.

    ``step(state, row)`` takes the state (None for a key's first row) and a row's columns, and returns the next state and rows to give. Keys are
    dealt to tasks; a key's rows are never gathered, so a hot key costs time but no memory beyond its state.
    """
    names = rows.columns
    kinds = T.StructType.fromDDL(schema)
    at = [names.index(k) for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(kinds)
        key, state, begun = None, None, False

        def sent(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(arrow)], schema=arrow)

        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(batch.column(c).to_pylist() for c in names)):
                own = tuple(row[k] for k in at)
                if not begun or own != key:
                    if begun and last:
                        out += last(state)
                    key, state, begun = own, None, True
                state, given = step(state, row)
                out += given
            yield sent(out)
        if begun and last:
            yield sent(last(state))

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, kinds)


def rate_limited(events: DataFrame, key: str, ts: str, tie: str, limit: int, seconds: int) -> DataFrame:
    """(tie, allowed, remaining) of each event: a window of ``seconds`` begins with the first event after the one before has ended, and lets ``limit`` events pass."""

    def step(state, row):
        _, second, event = row
        if state is None or second >= state[0] + seconds:
            state = (second, 0)
        start, count = state
        allowed = count < limit
        count += allowed
        return (start, count), [(event, allowed, limit - count)]

    rows = events.select(key, F.unix_seconds(F.col(ts).cast("timestamp")).alias("_s"), tie)
    return fold(rows, [key], ["_s", tie], step, f"{tie} long, allowed boolean, remaining long")


def breaker(events: DataFrame, key: str, ts: str, tie: str, failed: Column, limit: int = 5, cooldown: int = 24 * 3600) -> DataFrame:
    """(tie, state, failures) after each event of a feed: CLOSED, OPEN after ``limit`` failures in a row, HALF-OPEN for the first event after ``cooldown`` seconds.

    A failure in HALF-OPEN opens the circuit again; a success closes it. The state before an event that comes after the cooldown is HALF-OPEN.
    """

    def step(state, row):
        _, second, event, bad = row
        now, failures, last = state or ("CLOSED", 0, 0)
        if now == "OPEN" and second - last >= cooldown:
            now = "HALF-OPEN"
        if bad:
            failures += 1
            now, last = ("OPEN" if now == "HALF-OPEN" or failures >= limit else now), second
        else:
            now, failures = "CLOSED", 0
        return (now, failures, last), [(event, now, failures)]

    rows = events.select(key, F.unix_seconds(F.col(ts).cast("timestamp")).alias("_s"), tie, F.coalesce(failed, F.lit(False)).alias("_bad"))
    return fold(rows, [key], ["_s", tie], step, f"{tie} long, state string, failures long")


@lru_cache(4096)
def _words(title: str) -> frozenset[str]:
    return frozenset(w for w in re.split(r"\W+", (title or "").lower(), flags=re.A) if len(w) > 3)


FACTS = ("budget", "timeline", "share")


def milestones_merged(rows: DataFrame, key: str, days: int = 30, shared: int = 2) -> DataFrame:
    """Milestones without repeats: newest first, each joins the first kept one of its entity with the same address, or at most ``days`` away with ``shared`` common words.

    ``rows``: id, ``key``, day (days since 1970), title, url, official, tier, budget, timeline, share, status. A merged milestone takes the official one's values (else those of the
    smaller tier, else of the kept one) and fills gaps from both; ``merged`` counts its members, ``from_id`` is the kept one's id. An entity's state has one entry for each milestone that is left.
    """
    names = ["id", key, "day", "title", "url", "official", "tier", "budget", "timeline", "share", "status"]
    schema = f"`{key}` {rows.schema[key].dataType.simpleString()}, from_id long, id long, day int, official boolean, budget double, timeline string, share double, status string, merged long"

    def merge(a: dict, b: dict) -> dict:
        canon = a if a["official"] else b if b["official"] else a if a["tier"] <= b["tier"] else b
        out = dict(canon)
        for fact in FACTS:
            out[fact] = next((x[fact] for x in (canon, a, b) if x[fact] is not None), None)
        out["status"] = canon["status"] if canon["status"] != "general" else b["status"]
        return out | {"from_id": a["from_id"], "merged": a["merged"] + 1, "words": _words(canon["title"]), "place": a["place"]}

    # The state: milestones by place; places, in order, that may still be near, as days fall; and places by address. A merged milestone's day or address may be another, so it is noted anew.
    def noted(state, m: dict, url: str | None = None) -> None:
        kept, near, places = state
        if m["place"] not in near:
            insort(near, m["place"])
        if url and url != m["url"]:
            places[url].discard(m["place"])
        if m["url"]:
            places.setdefault(m["url"], set()).add(m["place"])

    def step(state, row):
        x = dict(zip(names, row)) | {"from_id": row[0], "merged": 1}
        x["words"] = _words(x["title"])
        state = state or ([], [], {})
        kept, near, places = state
        near[:] = [k for k in near if kept[k]["day"] - x["day"] <= days]
        first = next((k for k in near if x["day"] - kept[k]["day"] <= days and len(kept[k]["words"] & x["words"]) >= shared), None)
        same = min(places.get(x["url"]) or (), default=None) if x["url"] else None
        k = min((p for p in (first, same) if p is not None), default=None)
        if k is None:
            x["place"] = len(kept)
            kept.append(x)
            noted(state, x)
        else:
            former = kept[k]["url"]
            kept[k] = merge(kept[k], x)
            noted(state, kept[k], former)
        return state, []

    def last(state):
        return [(m[key], m["from_id"], m["id"], m["day"], m["official"], m["budget"], m["timeline"], m["share"], m["status"], m["merged"]) for m in state[0]]

    ordered = rows.select(*names).withColumn("_newest", -F.col("day"))
    return fold(ordered, [key], ["_newest", "id"], lambda s, r: step(s, r[:-1]), schema, last)
