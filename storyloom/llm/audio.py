"""Media columns: audio features from 8-bit samples.

Audio is stored as WAV (RIFF, PCM, one channel, 8 bits). Reading it back, samples are resampled by a polyphase filter,
turned into overlapped log-mel frames and cut into segments by energy with hysteresis. Frames are stored in patches of a
fixed shape (``PATCH`` frames by ``MELS`` bands) with time spans; features are computed from the patches that are read back.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm._spark import written
from storyloom.llm.token_output import slices

RATE, UP, DOWN = 8000, 3, 4
FRAME, HOP, MELS, PATCH = 512, 256, 24, 32
#: Samples that are handled at once; parts overlap by what filters and frames need.
BLOCK = 1 << 20
UNIT = 192
#: Segments open above the first energy and close below the second (natural logarithm of the mean square).
ENERGY_ON, ENERGY_OFF = -2.2, -2.8


def wav(samples: bytes, rate: int = RATE) -> bytes:
    """A WAV file; an odd number of samples gets the pad byte that RIFF asks for."""
    n, pad = len(samples), len(samples) % 2
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n + pad, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", n)
    return head + samples + b"\0" * pad


def wav_samples(stored: bytes) -> tuple[bytes, int]:
    """The samples and the rate; chunks other than the format and the data are skipped."""
    if stored[:4] != b"RIFF" or stored[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(stored):
        kind, n = struct.unpack_from("<4sI", stored, at)
        if kind == b"fmt ":
            coding, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", stored, at + 8)
            if (coding, channels, bits) != (1, 1, 8):
                raise ValueError("not 8-bit PCM with one channel")
        elif kind == b"data":
            return stored[at + 8 : at + 8 + n], rate
        at += 8 + n + n % 2
    raise ValueError("no data chunk")


def _low_pass(up: int, down: int, half: int = 8) -> np.ndarray:
    """The filter's ``up`` phases, one a row: a Hann-windowed sinc that cuts at the lower of both Nyquist rates."""
    widest = max(up, down)
    t = np.arange(-half * widest, half * widest + 1)
    taps = np.sinc(t / widest) * np.hanning(len(t) + 2)[1:-1]
    taps = np.append(taps * up / taps.sum(), np.zeros(-len(taps) % up))
    return taps.reshape(-1, up).T.astype(np.float32)


PHASES = _low_pass(UP, DOWN)
LAG = 8 * max(UP, DOWN)  # the filter's centre, in samples at UP times the rate


def resample(x: np.ndarray) -> np.ndarray:
    """``x`` at UP/DOWN times its rate: only the outputs that are kept are computed, each by the phase it falls on."""
    n = -(-len(x) * UP // DOWN)
    taps = PHASES.shape[1]
    padded = np.concatenate((np.zeros(taps, np.float32), x, np.zeros(taps, np.float32)))
    out = np.empty(n, dtype=np.float32)
    for first in range(min(UP, n)):  # outputs first, first + UP, ... fall on one phase and are DOWN samples apart
        place = first * DOWN + LAG
        phase, start = place % UP, place // UP - taps + 1 + taps
        windows = np.lib.stride_tricks.sliding_window_view(padded, taps)[start::DOWN]
        many = len(range(first, n, UP))
        out[first::UP] = windows[:many] @ PHASES[phase][::-1]
    return out


def _mel_bank() -> np.ndarray:
    """Triangular filters, evenly spaced in mel, over the bins of a frame's spectrum."""
    rate = RATE * UP / DOWN
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), MELS + 2) / 2595) - 1)
    bins = np.arange(FRAME // 2 + 1) * rate / FRAME
    rise = (bins[None, :] - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    fall = (edges[2:, None] - bins[None, :]) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(rise, fall)).T.astype(np.float32)


MEL_BANK, HANN = _mel_bank(), np.hanning(FRAME).astype(np.float32)


def log_mel(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(frames x MELS log-mel values, log energy of each frame). The last frame is filled with zeros.

    Long audio is handled in blocks of whole frames with the overlap that filter and frames need, so memory stays bounded.
    """
    raw = np.frombuffer(samples, dtype=np.uint8)
    total = -(-len(raw) * UP // DOWN)
    frames = max(1, -(-(total - FRAME) // HOP) + 1) if total else 0
    step = BLOCK * UP // DOWN // HOP
    mels, energies = [], []
    margin = 16 * DOWN
    for first in range(0, frames, step):
        last = min(frames, first + step)
        need = (first * HOP, min(total, (last - 1) * HOP + FRAME))
        begin = max(0, need[0] * DOWN // UP - margin) // DOWN * DOWN
        part = raw[begin : min(len(raw), need[1] * DOWN // UP + margin)]
        y = resample((part.astype(np.float32) - 128) / 128)
        offset = need[0] - begin * UP // DOWN
        y = y[offset : offset + need[1] - need[0]]
        y = np.concatenate((y, np.zeros((last - first - 1) * HOP + FRAME - len(y), np.float32)))
        cut = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP]
        energies.append(np.log(np.mean(cut * cut, axis=1) + np.float32(1e-6)))
        power = np.abs(np.fft.rfft(cut * HANN, axis=1)).astype(np.float32) ** 2
        mels.append(np.log(power @ MEL_BANK + np.float32(1e-6)))
    if not mels:
        return np.zeros((0, MELS), np.float32), np.zeros(0, np.float32)
    return np.concatenate(mels), np.concatenate(energies)


def segments(energy: np.ndarray, on: float = ENERGY_ON, off: float = ENERGY_OFF) -> list[tuple[int, int]]:
    """Frame ranges that begin above ``on`` and go on until the energy falls below ``off``."""
    mark = np.where(energy >= on, 1, np.where(energy < off, -1, 0))
    places = np.flatnonzero(mark)
    if not len(places):
        return []
    held = np.repeat(mark[places], np.diff(np.append(places, len(mark))))
    state = np.concatenate((np.zeros(places[0], np.int64), held > 0, [0]))
    change = np.flatnonzero(np.diff(np.concatenate(([0], state))))
    return list(zip(change[::2].tolist(), change[1::2].tolist()))


def feature_string(mel: np.ndarray, cuts: list[tuple[int, int]]) -> str:
    """Frames, segments (ranges of frames), their time, mean log-mel values and a digest of all values rounded to 1/16.

    Sums run in double precision over each text alone, so equal texts have equal strings.
    """
    mean = mel.mean(axis=0, dtype=np.float64) if len(mel) else np.zeros(MELS)
    digest = hashlib.sha256(np.rint(mel * 16).astype("<i2").tobytes()).hexdigest()[:16]
    ms = 1000 * HOP * DOWN // (RATE * UP)
    return f"frames={len(mel)};segments={len(cuts)};voiced_ms={sum(b - a for a, b in cuts) * ms};mel={','.join(f'{x:.2f}' for x in mean[:8])};sha={digest}"


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for big in batches:
        for batch in slices(big, "text"):
            texts = [(x or "").encode("utf-8", "surrogatepass") for x in batch.column("text").to_pylist()]
            media = [wav(x + b" " * ((-len(x) % UNIT) if x else UNIT)) for x in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(x) for x in texts], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"]
            )


def store_texts(docs: DataFrame) -> DataFrame:
    """(row, doc_id, n_bytes, media): each text's bytes, filled with spaces to a positive multiple of 192, as WAV files.

    ``row`` tells rows apart, whatever their doc_id. The media column is written to the shared folder and read back. Null and empty texts become 192 spaces.
    """
    media = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_store, "doc_id long, n_bytes long, media binary")
    return written(media.select(F.monotonically_increasing_id().alias("row"), "*"), "media")


#: What the stored media hold; each patch of a row repeats it.
FACTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string"
SUMMARY = f"{FACTS}, feature string"
SPANS = "array<struct<from_s: double, to_s: double>>"
PLACE = f"row long, patch int, patches int, frames int, from_s double, to_s double, voiced double, spans {SPANS}, tensor array<float>"
PATCHES = f"{FACTS}, {PLACE}"
FACT_NAMES = [x.split()[0] for x in FACTS.split(", ")]
FACT_TYPES = [pa.int64() if x.endswith("long") else pa.string() for x in FACTS.split(", ")]
PLACE_NAMES = ["row", "patch", "patches", "frames", "from_s", "to_s", "voiced", "spans", "tensor"]
SPAN_TYPE = pa.list_(pa.struct([("from_s", pa.float64()), ("to_s", pa.float64())]))
PLACE_TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), SPAN_TYPE]
#: Patches that one Arrow batch holds before it is sent on.
SENT = 1024


def _second(rate: int) -> float:
    """Seconds from one frame to the next."""
    return HOP * DOWN / (UP * rate)


def _patches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    size = PATCH * MELS

    def sent(rows: list[tuple], tensors: list[np.ndarray]) -> pa.RecordBatch:
        # the storage of an Arrow fixed-shape tensor: one run of PATCH x MELS values for each row
        tensor = pa.ExtensionArray.from_storage(
            pa.fixed_shape_tensor(pa.float32(), (PATCH, MELS)), pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(tensors).ravel()), size)
        )
        columns = [pa.array(x, t) for x, t in zip(zip(*rows), FACT_TYPES + PLACE_TYPES)]
        return pa.RecordBatch.from_arrays([*columns, tensor.storage.cast(pa.list_(pa.float32()))], FACT_NAMES + PLACE_NAMES)

    rows, kept = [], []
    for big in batches:
        for batch in slices(big, "media"):
            for row, doc, n, stored in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "n_bytes", "media"))):
                samples, rate = wav_samples(stored)
                mel, energy = log_mel(samples)
                facts = (doc, n, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(stored), hashlib.sha256(stored).hexdigest())
                cuts, second = segments(energy), _second(rate)
                # audio without samples has one patch without frames
                many = max(1, -(-len(mel) // PATCH))
                full = np.concatenate((mel, np.full((many * PATCH - len(mel), MELS), np.log(1e-6), np.float32)))
                for k in range(many):
                    first, last = k * PATCH, min(k * PATCH + PATCH, len(mel))
                    inside = [(max(a, first), min(b, last)) for a, b in cuts if a < last and b > first]
                    end = (last * HOP - HOP + FRAME) * DOWN / (UP * rate)
                    spans = [{"from_s": a * second, "to_s": b * second} for a, b in inside]
                    rows.append((*facts, row, k, many, last - first, first * second, end, sum(b - a for a, b in inside) / PATCH, spans))
                kept.append(full.reshape(many, size))
                if len(rows) >= SENT:
                    yield sent(rows, kept)
                    rows, kept = [], []
    if rows:
        yield sent(rows, kept)


def patches(media: DataFrame) -> DataFrame:
    """Log-mel patches of the fixed shape PATCH x MELS, row-major, with time spans, of each row of ``media`` (row, doc_id, n_bytes, media).

    ``row`` is unlike for any two rows of ``media``; ``patch`` counts from 0 to ``patches`` - 1 in it. ``from_s`` and ``to_s`` are the patch's time, ``spans``
    the segments' times in it and ``voiced`` their share. The last patch is filled with the value of silence after its ``frames``.
    Spark has no tensor type, so ``tensor`` has the tensors' storage; ``pa.fixed_shape_tensor(pa.float32(), (PATCH, MELS))`` takes it as it is.
    """
    return media.select("row", "doc_id", "n_bytes", "media").mapInArrow(_patches, PATCHES)


def _feature(parts: list[tuple]) -> str:
    """The feature string of all patches (frames, spans, tensor) of a row, in order. Spans that meet where a patch ends are one segment."""
    mel = np.concatenate([tensor.reshape(PATCH, MELS)[:frames] for frames, _, tensor in parts])
    second, cuts = _second(RATE), []
    for span in (x for _, spans, _ in parts for x in spans):
        a, b = round(span["from_s"] / second), round(span["to_s"] / second)
        if cuts and cuts[-1][1] == a:
            cuts[-1] = (cuts[-1][0], b)
        else:
            cuts.append((a, b))
    return feature_string(mel, cuts)


def _derived(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of patches that stand together get their feature; patches of other rows go on as they are, without a feature."""
    names = FACT_NAMES + PLACE_NAMES[:-1]
    types = [*FACT_TYPES, *PLACE_TYPES, pa.list_(pa.float32()), pa.string()]

    def sent(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], [*names, "tensor", "feature"])

    at = {c: names.index(c) for c in names}
    held, out = [], []  # patches of one row, in order

    def close() -> None:
        if held and len(held) == held[0][0][at["patches"]]:
            feature = _feature([(x[at["frames"]], x[at["spans"]], tensor) for x, tensor in held])
            out.append((*held[0][0][: len(FACT_NAMES)], held[0][0][at["row"]], *[None] * (len(PLACE_TYPES) - 1), None, feature))
        else:
            out.extend((*x, tensor, None) for x, tensor in held)
        held.clear()

    for batch in batches:
        tensors = batch.column("tensor").flatten().to_numpy(zero_copy_only=False).reshape(-1, PATCH * MELS)
        for k, x in enumerate(zip(*(batch.column(c).to_pylist() for c in names))):
            if held and (x[at["row"]] != held[0][0][at["row"]] or x[at["patch"]] != len(held)):
                close()
            held.append((x, tensors[k].copy()))
            if x[at["patch"]] != len(held) - 1:  # a row's first patches are elsewhere
                close()
        if len(out) >= SENT:
            yield sent(out)
            out.clear()
    close()
    if out:
        yield sent(out)


def features(stored: DataFrame) -> DataFrame:
    """What the media of the written patches hold and a feature string, one row for each ``row`` of ``stored`` (columns of ``patches``).

    A row's patches were written side by side; only those that a split of the files parts are dealt out again by row.
    """
    found = written(stored.mapInArrow(_derived, f"{PATCHES}, feature string"), "features")
    parted = found.where("feature IS NULL").drop("feature").repartition("row").sortWithinPartitions("row", "patch").mapInArrow(_derived, f"{PATCHES}, feature string")
    names = [*FACT_NAMES, "feature"]
    return found.where("feature IS NOT NULL").select(*names).union(parted.select(*names))


def summarize(media: DataFrame) -> DataFrame:
    """What the stored media hold and a feature string, one row for each row of ``media``.

    Tensors and time spans of all rows are written to the shared folder; the feature string is derived from those that are read back.
    """
    return features(written(patches(media), "patches"))
