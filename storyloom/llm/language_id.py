"""Language ID with a bidirectional gated recurrent network over bytes, trained in numpy.

A text's bytes are cut into strips of ``STRIP`` bytes, each read from a state of its own; a cut may fall inside a word or a character. Two GRUs of ``HIDDEN`` units read each strip, one from either end; a softmax
over both states labels every position. A document's probabilities are the means over its letters. Piecewise linear
gates and a rational candidate keep the network cheap enough to read all bytes of a corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.llm.token_output import slices

STRIP, HIDDEN = 64, 8
#: Labelled documents to learn from, and windows of so many characters from each. This bounds what the driver gets.
SAMPLE_DOCS, SAMPLE_WINDOWS, SAMPLE_CHARS = 3000, 4, 200
STEPS, BATCH, LEARNING_RATE = 400, 256, 0.01
#: Strips that inference handles at once.
LANES = 2048
UNDETERMINED = "und"

#: Bytes that count as letters: ASCII letters and all bytes of other characters.
LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])


@dataclass
class Model:
    languages: list[str]
    weights: dict[str, np.ndarray]


def start(languages: list[str], seed: int = 5) -> Model:
    """Random weights. ``E``: what each byte adds to the two gates and the candidate; ``U``: what the state adds; ``V``: from state to languages."""
    rng = np.random.default_rng(seed)
    weights = {"bias": np.zeros((len(languages), 1), np.float32)}
    gates = 2 * HIDDEN
    for way in "fb":
        for name, shape in (("E", (3 * HIDDEN, 256)), ("U", (3 * HIDDEN, HIDDEN)), ("V", (len(languages), HIDDEN))):
            weights[name + way] = (rng.standard_normal(shape) * 0.3).astype(np.float32)
        weights["E" + way][:gates] = weights["E" + way][:gates] / 4 + 0.5
        weights["U" + way][:gates] /= 4
    return Model(languages, weights)


def _read(w: dict, way: str, x: np.ndarray) -> Iterator[tuple]:
    """Reads strips, (steps, n) byte values, one way: (step, state before, gates z and r, u, candidate, state after).

    States are (HIDDEN, n), so that each operation runs over contiguous lanes. Gates are piecewise linear and the
    candidate's activation is v / (1 + |v|).
    """
    steps, n = x.shape
    from_byte, from_state = w["E" + way], w["U" + way]
    h = np.zeros((HIDDEN, n), from_byte.dtype)
    a = np.empty((3 * HIDDEN, n), from_byte.dtype)
    for t in range(steps)[:: 1 if way == "f" else -1]:
        from_byte.take(x[t], axis=1, out=a, mode="clip")
        g = from_state @ h
        gates = g[: 2 * HIDDEN]
        gates += a[: 2 * HIDDEN]
        np.clip(gates, 0, 1, out=gates)
        z, r, u = g[:HIDDEN], g[HIDDEN : 2 * HIDDEN], g[2 * HIDDEN :]
        c = r * u
        c += a[2 * HIDDEN :]
        size = np.abs(c)
        size += 1
        c /= size
        after = h - c
        after *= z
        after += c
        yield t, h, z, r, u, c, after
        h = after


def _soft(logits: np.ndarray) -> np.ndarray:
    """Probabilities over the languages, the axis before the last."""
    e = np.exp(logits - logits.max(axis=-2, keepdims=True))
    return e / e.sum(axis=-2, keepdims=True)


def gradients(model: Model, strips: np.ndarray, labels: np.ndarray) -> tuple[float, dict]:
    """Mean cross entropy over all positions and its gradients, by back-propagation through time."""
    w, (n, steps) = model.weights, strips.shape
    x = np.ascontiguousarray(strips.T).astype(np.intp)
    kept = {way: list(_read(w, way, x)) for way in "fb"}
    logits = np.empty((steps, len(model.languages), n), w["bias"].dtype)
    logits[:] = w["bias"]
    for way in "fb":
        for t, *_, after in kept[way]:
            logits[t] += w["V" + way] @ after
    p = _soft(logits)
    lanes = np.arange(n)
    loss = -float(np.log(p[:, labels, lanes] + 1e-9).mean())
    d = p
    d[:, labels, lanes] -= 1
    d /= n * steps
    g = {k: np.zeros_like(v) for k, v in w.items()}
    g["bias"] = d.sum(axis=(0, 2))[:, None]
    flat = x.ravel()
    for way in "fb":
        back = np.zeros((HIDDEN, n), d.dtype)
        from_bytes = np.empty((3 * HIDDEN, steps, n), d.dtype)
        for t, h, z, r, u, c, after in reversed(kept[way]):
            g["V" + way] += d[t] @ after.T
            dh = w["V" + way].T @ d[t] + back
            dz = dh * (h - c) * ((z > 0) & (z < 1))
            dc = dh * (1 - z) * (1 - np.abs(c)) ** 2
            dr = dc * u * ((r > 0) & (r < 1))
            from_bytes[:HIDDEN, t], from_bytes[HIDDEN : 2 * HIDDEN, t], from_bytes[2 * HIDDEN :, t] = dz, dr, dc
            dg = np.concatenate((dz, dr, dc * r))
            g["U" + way] += dg @ h.T
            back = dh * z + w["U" + way].T @ dg
        for row, values in enumerate(from_bytes.reshape(3 * HIDDEN, -1)):
            g["E" + way][row] = np.bincount(flat, weights=values, minlength=256)
    return loss, g


def train(texts: list[str], labels: list[str], steps: int = STEPS, seed: int = 5) -> Model:
    """Fits the network by Adam on strips drawn at random, each language as often as any other."""
    languages = sorted(set(labels))
    model = start(languages, seed)
    rng = np.random.default_rng(seed)
    strips = [strips_of([x.encode("utf-8", "surrogatepass")])[0] for x in texts]
    by = [np.concatenate([s for s, y in zip(strips, labels) if y == one]) for one in languages]
    m = {k: np.zeros_like(v) for k, v in model.weights.items()}
    v = {k: np.zeros_like(x) for k, x in model.weights.items()}
    for step in range(1, steps + 1):
        y = rng.integers(len(languages), size=BATCH)
        x = np.stack([by[k][rng.integers(len(by[k]))] for k in y])
        _, g = gradients(model, x, y)
        size = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
        rate = LEARNING_RATE * (1 if step < 0.7 * steps else 0.25)
        for k, weight in model.weights.items():
            a = g[k] * min(1.0, 1.0 / (size + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * a
            v[k] = 0.99 * v[k] + 0.01 * a * a
            weight -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)
    return model


def strips_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as strips, each filled up with spaces, and the number of strips of each text (at least one)."""
    counts = np.array([max(1, -(-len(x) // STRIP)) for x in texts])
    joined = b"".join(x.ljust(int(n) * STRIP) for x, n in zip(texts, counts))
    return np.frombuffer(joined, dtype=np.uint8).reshape(-1, STRIP), counts


def _logits(w: dict, strips: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(steps, languages, n) of ``strips``, and their byte values as (steps, n)."""
    x = np.ascontiguousarray(strips.T)
    at = x.astype(np.intp)
    out = np.empty((len(x), len(w["bias"]), len(strips)), np.float32)
    out[:] = w["bias"]
    for way in "fb":
        for t, *_, after in _read(w, way, at):
            out[t] += w["V" + way] @ after
    return out, x


def strip_sums(model: Model, strips: np.ndarray) -> np.ndarray:
    """For each strip, the summed probabilities of its letters' positions."""
    out = np.empty((len(strips), len(model.languages)), np.float32)
    for at in range(0, len(strips), LANES):
        part = strips[at : at + LANES]
        p, x = _logits(model.weights, part)
        np.exp(np.minimum(p, 40, out=p), out=p)
        p *= (LETTER[x] / p.sum(axis=1))[:, None, :]
        out[at : at + LANES] = p.sum(axis=0).T
    return out


def position_labels(model: Model, text: str) -> list[str]:
    """The language of each byte of ``text``."""
    raw = text.encode("utf-8", "surrogatepass")
    p, _ = _logits(model.weights, strips_of([raw])[0])
    return [model.languages[k] for k in p.argmax(axis=1).T.ravel()[: len(raw)]]


def predict_batch(model: Model, texts: list[str]) -> tuple[list[str], list[float]]:
    raw = [x.encode("utf-8", "surrogatepass") for x in texts]
    strips, counts = strips_of(raw)
    sums = strip_sums(model, strips)
    pooled = np.add.reduceat(sums.astype(np.float64), np.concatenate(([0], np.cumsum(counts)[:-1])), axis=0)
    letters = pooled.sum(axis=1)
    best = pooled.argmax(axis=1)
    says = [model.languages[k] if n > 0 and has_letter(x) else UNDETERMINED for k, n, x in zip(best, letters, texts)]
    scores = [float(min(1.0, p[k] / n)) if y != UNDETERMINED else 0.0 for p, k, n, y in zip(pooled, best, letters, says)]
    return says, scores


def has_letter(text: str) -> bool:
    """Whether any character of ``text`` is a letter, by Unicode's categories. Stops at the first one."""
    return any(map(str.isalpha, text))


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 1


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model | None:
    """Learns from documents with a language and outside the held-out third; None if there is none.

    About ``sample_docs`` of them are drawn by a hash of their ids, an equal number of each language as far as there are so many, so that rare languages
    are learned, too. From each, windows at places that are drawn alike are taken, so at most ``2 * sample_docs`` rows of a bounded length come
    to the driver, whatever the corpus size.
    """
    known = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    counts = known.groupBy("lang").agg(F.count("*").alias("n"))
    languages = counts.count()
    if not languages:
        return None
    share = sample_docs / languages / F.col("n") * (1 << 30) + 1
    # so many languages are counted rows of a known bound; of more, Spark decides by size
    counts = F.broadcast(counts) if languages <= SAMPLE_DOCS else counts
    drawn = known.join(counts, "lang").where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) < share)
    starts = [(F.pmod(F.xxhash64(F.lit(k), "doc_id"), F.greatest(F.lit(1), F.length("text") - SAMPLE_CHARS)) + 1).cast("int") for k in range(SAMPLE_WINDOWS)]
    windows = F.concat_ws(" ", *[F.substring("text", s, F.lit(SAMPLE_CHARS)) for s in starts])
    rows = drawn.select(windows.alias("text"), "lang").limit(2 * sample_docs).collect()
    rows = sorted(rows, key=lambda r: (r["lang"], r["text"]))
    return train([r["text"] for r in rows], [r["lang"] for r in rows]) if rows else None


def predict(docs: DataFrame, model: Model | None, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys``, lang_pred and score of each row of ``docs``.

    ``und`` with score 0 stands for a null text, a text without letters and for all texts if there is no model. Whole
    texts are read. Rows are handled one by one where they stand, without a shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few dozen kB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        for big in batches:
            for batch in slices(big, "text", 1 << 20):
                texts = [x or "" for x in batch.column("text").to_pylist()]
                says, scores = predict_batch(found, texts) if found else ([UNDETERMINED] * len(texts), [0.0] * len(texts))
                yield pa.RecordBatch.from_arrays([batch.column(k) for k in keys] + [pa.array(says, pa.string()), pa.array(scores, pa.float64())], [*keys, "lang_pred", "score"])

    schema = T.StructType([*[docs.schema[k] for k in keys], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select(*keys, *[F.col("text").cast("string")] * ("text" not in keys)).mapInArrow(run, schema)
