"""Quality classifier: a sparse rule ensemble.

Small boosted trees over text statistics give candidate rules, the conjunctions along their paths. A logistic
regression with an L1 penalty keeps few of them. The kept rules are compiled into one Spark column expression.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.llm.token_output import slices

#: Labelled rows to learn from; this bounds what is broadcast and what the driver gets.
SAMPLE_ROWS = 8000
TREES, DEPTH, SHRINK, BINS, LEAST_ROWS = 40, 3, 0.2, 32, 20
PENALTY = 2e-3
THRESHOLD = 0.7

#: Frequent words of four languages.
COMMON = frozenset(
    b"the of and to in is that it was for on with as are at from der die und das den von ist im zu mit nicht ein eine auf "
    b"le la les des du et en un une est pour dans que qui sur avec el los las de y se su por con del al".split()
)
STATS = (
    "log_bytes", "log_words", "word_bytes", "upper", "digit", "stop_mark", "symbol", "bang", "non_ascii", "line_bytes",
    "line_repeat", "word_variety", "top_word", "common", "odd_end", "bare_line", "capital_words",
)
_bytes = np.arange(256)
CLASSES = np.stack(
    [
        (_bytes >= 65) & (_bytes <= 90),
        (_bytes >= 48) & (_bytes <= 57),
        np.isin(_bytes, list(b".,;:?'\"-()")),
        np.isin(_bytes, list(b"#$%&*+/<=>@[\\]^_`{|}~")),
        _bytes == 33,
        _bytes >= 128,
    ]
).T.astype(np.float64)
ODD_END = re.compile(rb"[^\w\s\x80-\xff]{2,}(?=\s|$)")
CAPITALS = re.compile(rb"\b[A-Z]{2,}")


def statistics(text: str | None) -> list[float]:
    """The values of STATS for a whole text; a null or empty text has zeros."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.lower().split()
    if not words:
        return [float(np.log1p(len(raw))), *[0.0] * (len(STATS) - 1)]
    n, m = len(raw), len(words)
    upper, digit, stop, symbol, bang, other = (np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ CLASSES / n).tolist()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    counts = Counter(words)
    common = sum(counts[w] for w in COMMON if w in counts)
    return [
        float(np.log1p(n)), float(np.log1p(m)), n / m, upper, digit, stop, symbol, bang, other, n / len(lines),
        1 - len(set(lines)) / len(lines), len(counts) / m, max(counts.values()) / m, common / m, len(ODD_END.findall(raw)) / m,
        sum(x.rstrip()[-1:] not in b".!?" for x in lines) / len(lines), len(CAPITALS.findall(raw)) / m,
    ]


def with_statistics(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys`` and the columns of STATS for each row of ``docs``; whole texts, where they stand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in slices(big, "text"):
                found = np.array([statistics(x) for x in batch.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(k) for k in keys] + [pa.array(np.ascontiguousarray(c)) for c in found.T], [*keys, *STATS])

    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + "".join(f", {s} double" for s in STATS)
    return docs.select(*keys, F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


#: (statistic, whether it must be above, threshold) for each condition
Rule = tuple[tuple[int, bool, float], ...]


@dataclass
class Model:
    bias: float
    rules: list[tuple[Rule, float]]


def _paths(x: np.ndarray, cuts: list[np.ndarray], pull: np.ndarray, rows: np.ndarray, path: Rule, out: list, step: np.ndarray) -> None:
    """Grows one regression tree on ``pull`` by histograms of ``x`` (bin numbers) and puts the path of each node but the root in ``out``."""
    if path:
        out.append(path)
    best = (1e-9, 0, 0)
    if len(path) < DEPTH and len(rows) >= 2 * LEAST_ROWS:
        total, n = pull[rows].sum(), len(rows)
        for j in range(x.shape[1]):
            count = np.bincount(x[rows, j], minlength=BINS).cumsum()[:-1]
            sums = np.bincount(x[rows, j], weights=pull[rows], minlength=BINS).cumsum()[:-1]
            fits = (count >= LEAST_ROWS) & (n - count >= LEAST_ROWS)
            if fits.any():
                gain = np.where(fits, sums**2 / np.maximum(count, 1) + (total - sums) ** 2 / np.maximum(n - count, 1) - total**2 / n, 0)
                k = int(gain.argmax())
                best = max(best, (float(gain[k]), j, k))
    if best[0] <= 1e-9:
        step[rows] = pull[rows].mean() if len(rows) else 0.0
        return
    _, j, k = best
    high = x[rows, j] > k
    for above in (False, True):
        _paths(x, cuts, pull, rows[high == above], (*path, (j, above, float(cuts[j][k]))), out, step)


def _simple(path: Rule) -> Rule:
    """One condition for each statistic and side: the strictest."""
    found: dict[tuple[int, bool], float] = {}
    for j, above, cut in path:
        found[j, above] = (max if above else min)(cut, found.get((j, above), cut))
    return tuple((j, above, cut) for (j, above), cut in sorted(found.items()))


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for j, above, cut in rule:
        out &= x[:, j] > cut if above else x[:, j] <= cut
    return out


def train(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY) -> Model:
    """Rules from boosted trees, weighed by lasso logistic regression (accelerated proximal gradient)."""
    rate = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    base = float(np.log(rate / (1 - rate)))
    if len(set(y.tolist())) < 2:
        return Model(base, [])
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    bins = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    cuts = [np.append(c, np.full(BINS - len(c), np.inf)) for c in cuts]
    found: list[Rule] = []
    margin = np.full(len(y), base)
    for _ in range(TREES):
        p, step = 1 / (1 + np.exp(-margin)), np.zeros(len(y))
        _paths(bins, cuts, y - p, np.arange(len(y)), (), found, step)
        margin += SHRINK * step / max(1e-6, float((p * (1 - p)).mean()))
    rules = sorted({_simple(r) for r in found})
    r = np.stack([holds(rule, x) for rule in rules], axis=1).astype(np.float64)
    _, first = np.unique(r, axis=1, return_index=True)
    rules, r = [rules[k] for k in sorted(first)], r[:, sorted(first)]
    scale = np.maximum(r.std(axis=0), 1e-6)
    z = (r - r.mean(axis=0)) / scale
    step = 4 / (np.linalg.norm(z, 2) ** 2 / len(y) + 1e-9)
    w, ahead, bias, t = np.zeros(z.shape[1]), np.zeros(z.shape[1]), base, 1.0
    for _ in range(400):
        pull = (1 / (1 + np.exp(-(z @ ahead + bias))) - y) / len(y)
        new = ahead - step * (z.T @ pull)
        new = np.sign(new) * np.maximum(0, np.abs(new) - step * penalty)
        bias -= 2.0 * float(pull.sum())
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead, w = new + (before - 1) / t * (new - w), new
    weights = w / scale
    return Model(float(bias - weights @ r.mean(axis=0)), [(rule, float(a)) for rule, a in zip(rules, weights) if abs(a) > 1e-9])


def score(model: Model, names: tuple[str, ...] = STATS) -> Column:
    """The model as one column expression over the statistics' columns."""
    total = F.lit(model.bias)
    for rule, weight in model.rules:
        terms = [F.col(names[j]) > cut if above else F.col(names[j]) <= cut for j, above, cut in rule]
        every = terms[0]
        for term in terms[1:]:
            every = every & term
        total = total + F.when(every, F.lit(weight)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-total))


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learns from labelled rows outside the held-out quarter; without any, all scores are one half.

    About ``sample_rows`` of them are drawn by a hash of their ids. Their ids and labels are broadcast: two numbers for each of
    at most ``2 * sample_rows`` rows, and one text of each comes back as statistics. Labels that are null, or neither 0 nor 1, are left out; of a document with several
    labels, the largest counts, and of several texts of one id, the one of the least hash.
    """
    known = labels.where(~held_out() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    n = known.count()
    if not n:
        return Model(0.0, [])
    order = F.xxhash64(F.lit("sample"), "doc_id")
    drawn = known.where(F.pmod(order, F.lit(1 << 30)) < min(1 << 30, int(sample_rows / n * (1 << 30)) + 1))
    drawn = drawn.orderBy(F.pmod(order, F.lit(1 << 30)), "doc_id").limit(2 * sample_rows)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(drawn), "doc_id")
    texts = texts.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = with_statistics(texts, ("doc_id", "quality")).collect()
    rows = sorted(rows, key=lambda r: r["doc_id"])
    if not rows:
        return Model(0.0, [])
    return train(np.array([[r[s] for s in STATS] for r in rows]), np.array([float(r["quality"]) for r in rows]))


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of ``docs``; null and empty texts are scored by their statistics, too."""
    return with_statistics(docs).select(
        "doc_id", held_out().alias("held_out"), score(model).alias("score"), (score(model) >= THRESHOLD).cast("int").alias("predicted")
    )
