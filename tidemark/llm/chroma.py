"""Media columns (operator 3): chroma fingerprints of recordings, and their alignment.

A recording is a WAV column. Its samples are mixed to one channel, brought to ``RATE`` and cut into overlapping frames;
the power of each frame's spectrum is folded into 12 pitch classes, smoothed over time and set to length one. Over the
integral image of pitch class x frame, 16 filters compare sums of rectangles in a window of up to 12 frames; each
answer, quantised to two Gray-coded bits, packs into one integer of 32 bits for each window. Neighbouring windows share
most of their frames, so similar sound has similar integers.

Alignment: recordings with the same integers are one class, so copies cost one row. The queries are the classes that
hold an id divisible by ``EVERY``. An integer's keys are its bits in any three of five blocks, so that a window with
several wrong bits still shares a key. The queries' keys are sorted and broadcast in blocks of at most
``BLOCK_WINDOWS`` windows; the classes' windows (of a run of equal integers, as of silence, the first) are looked up
where they are, in steps of bounded size, so a hot key is never gathered. A place where a key is shared is a candidate
if the integers there and 12 and 24 windows before and after differ in at most ``NEAR_ERROR`` of their bits. Every
candidate offset of a pair is settled by comparing all the integers that overlap there: a match needs ``OVERLAP``
windows and at most ``BIT_ERROR`` of their bits different; of a pair's, the one with fewest is given. Candidates are
found by keys, so not every alignment near ``BIT_ERROR`` is certain to be found: recall against brute force over all
offsets is measured in the tests with noisy and cut copies over the whole range up to ``BIT_ERROR`` (at least 0.9).
The work grows with queries times classes where keys are common, as with the table's random melodies.

The tables have no sound. ``render`` plays an embedding as a melody, a tone for each number, so that the operator has
recordings of the table's size: that is the query's intended input.

Results are rows of two kinds. ``member``: every row of the table with its class (smallest id with the same integers);
``match``: a query class, another class, offset (windows by which the other is later), windows compared and share of
different bits.

Defined cases: null, empty or broken WAV bytes, and sound shorter than one window, have no integers: they are members
without a class (null) and never match; repeated rows are members each; a null id is a member, and is no query; an
empty table gives no rows.
"""

from __future__ import annotations

import io
import uuid
import wave
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, cut, table

RATE, FRAME, HOP = 4000, 1024, 512
LOW, HIGH = 55.0, 1760.0
WINDOW = 12
EVERY, OVERLAP, BIT_ERROR, HOT = 50, 24, 0.2, 500
#: Bits that may differ around a candidate; windows of the queries that are broadcast at once; shared keys of a step for each of ``hot``.
NEAR_ERROR, BLOCK_WINDOWS, STEP = 0.2, 250_000, 2000
NEAR = (-24, -12, 0, 12, 24)
#: An integer's keys: any three of five blocks of its bits.
_BLOCKS = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in ((0, 6), (6, 12), (12, 19), (19, 25), (25, 32))]
KEYS = np.array([sum(x) for x in combinations(_BLOCKS, 3)], np.uint32)
#: The filters: (kind, first pitch class, pitch classes, frames). Kinds compare halves of a rectangle: by pitch (0), by
#: time (1), quarters crosswise (2), the middle third by pitch (3) or time (4).
FILTERS = ((0, 0, 12, 12), (0, 0, 6, 8), (0, 6, 6, 8), (0, 3, 6, 4), (1, 0, 12, 12), (1, 0, 4, 8), (1, 4, 4, 8), (1, 8, 4, 8), (2, 0, 12, 12), (2, 0, 6, 8), (2, 6, 6, 8), (3, 0, 12, 8), (3, 0, 6, 6), (3, 6, 6, 6), (4, 0, 6, 12), (4, 6, 6, 12))
#: Quantiser borders for the log ratio of two sums.
BORDERS = np.array([-0.35, 0.0, 0.35])
_GRAY = np.array([0, 1, 3, 2], np.uint32)


def samples_of(raw: bytes | None) -> np.ndarray:
    """Samples of WAV bytes (8, 16 or 32 bits) at ``RATE``, one channel, -1 to 1; none if the bytes are no WAV."""
    if not raw:
        return np.zeros(0)
    try:
        with wave.open(io.BytesIO(raw)) as w:
            width, channels, rate, data = w.getsampwidth(), w.getnchannels(), w.getframerate(), w.readframes(w.getnframes())
    except (wave.Error, EOFError, ValueError):
        return np.zeros(0)
    if width not in (1, 2, 4) or not rate or not channels:
        return np.zeros(0)
    data = data[: len(data) // (width * channels) * width * channels]
    x = np.frombuffer(data, {1: "u1", 2: "<i2", 4: "<i4"}[width]).astype(np.float64)
    x = (x - 128) / 128 if width == 1 else x / float(1 << (8 * width - 1))
    x = x.reshape(-1, channels).mean(axis=1)
    if rate == RATE or not len(x):
        return x
    if rate > RATE:  # a moving average keeps what RATE can't hold from folding back
        k = max(1, round(rate / RATE))
        x = np.convolve(x, np.ones(k) / k, "same")
    at = np.arange(int(len(x) * RATE / rate)) * (rate / RATE)
    return np.interp(at, np.arange(len(x)), x)


def _folding() -> np.ndarray:
    """Spectrum bin -> pitch class, as a matrix."""
    hz = np.fft.rfftfreq(FRAME, 1 / RATE)
    out = np.zeros((len(hz), 12))
    use = (hz >= LOW) & (hz <= HIGH)
    out[np.flatnonzero(use), np.round(12 * np.log2(hz[use] / 440)).astype(int) % 12] = 1
    return out


_FOLD, _HANN = _folding(), np.hanning(FRAME)


def chroma_of(x: np.ndarray) -> np.ndarray:
    """Pitch-class frames (frames x 12), smoothed, each of length one (silence: nought)."""
    n = 1 + (len(x) - FRAME) // HOP if len(x) >= FRAME else 0
    if not n:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[:: HOP][:n]
    out = np.empty((n, 12))
    for at in range(0, n, 512):
        spectrum = np.fft.rfft(frames[at : at + 512] * _HANN, axis=1)
        out[at : at + 512] = (spectrum.real**2 + spectrum.imag**2) @ _FOLD
    padded = np.concatenate((out[:1], out, out[-1:]))
    out = 0.25 * padded[:-2] + 0.5 * padded[1:-1] + 0.25 * padded[2:]
    size = np.sqrt((out**2).sum(axis=1, keepdims=True))
    return np.where(size > 1e-9, out / np.maximum(size, 1e-9), 0.0)


def integers_of(chroma: np.ndarray) -> np.ndarray:
    """One packed integer for each window of ``WINDOW`` frames."""
    n = len(chroma) - WINDOW + 1
    if n < 1:
        return np.zeros(0, np.uint32)
    image = np.zeros((len(chroma) + 1, 13))
    image[1:, 1:] = chroma.cumsum(axis=0).cumsum(axis=1)

    def area(t: int, p: int, frames: int, pitches: int) -> np.ndarray:
        a, b = image[t : t + n], image[t + frames : t + frames + n]
        return b[:, p + pitches] - b[:, p] - a[:, p + pitches] + a[:, p]

    out = np.zeros(n, np.uint32)
    for kind, p, pitches, frames in FILTERS:
        if kind == 0:
            h = pitches // 2
            one, two = area(0, p, frames, h), area(0, p + h, frames, pitches - h)
        elif kind == 1:
            h = frames // 2
            one, two = area(0, p, h, pitches), area(h, p, frames - h, pitches)
        elif kind == 2:
            h, g = frames // 2, pitches // 2
            one = area(0, p, h, g) + area(h, p + g, frames - h, pitches - g)
            two = area(0, p + g, h, pitches - g) + area(h, p, frames - h, g)
        elif kind == 3:
            h = pitches // 3
            two = area(0, p + h, frames, h)
            one = area(0, p, frames, pitches) - two
        else:
            h = frames // 3
            two = area(h, p, h, pitches)
            one = area(0, p, frames, pitches) - two
        value = np.log1p(np.maximum(one, 0)) - np.log1p(np.maximum(two, 0))
        out = out << np.uint32(2) | _GRAY[np.searchsorted(BORDERS, value)]
    return out


def render(values: list[float] | None) -> bytes | None:
    """An embedding as a WAV melody: a tone of ``HOP`` samples for each number, its pitch from the number."""
    if values is None:
        return None
    v = np.nan_to_num(np.array([0.0 if x is None else x for x in values], np.float64))
    hz = 220.0 * 2 ** (np.clip(np.round(v * 64), -24, 36) / 12)
    phase = np.repeat(hz, HOP).cumsum() * (2 * np.pi / RATE)
    x = 0.6 * np.sin(phase) + 0.2 * np.sin(2 * phase)
    sink = io.BytesIO()
    with wave.open(sink, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(RATE)
        w.writeframes((x * 32767).astype("<i2").tobytes())
    return sink.getvalue()


def recordings(embeddings: DataFrame) -> DataFrame:
    """id and wav of each row."""
    kind = embeddings.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array([render(v) for v in part.column("embedding").to_pylist()], pa.binary())], ["id", "wav"])

    return embeddings.select("vec_id", "embedding").mapInArrow(run, f"id {kind}, wav binary")


def fingerprints(media: DataFrame) -> DataFrame:
    """id and ints (packed integers, as signed) of each row of ``media`` (id, wav)."""
    bounded_batches(media.sparkSession)
    kind = media.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ints = [integers_of(chroma_of(samples_of(w))).view(np.int32).tolist() for w in batch.column("wav").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(ints, pa.list_(pa.int32()))], ["id", "ints"])

    return media.select("id", "wav").mapInArrow(run, f"id {kind}, ints array<int>")


class Windows:
    """The windows of some recordings in one array, with those around each."""

    def __init__(self, ints: list[np.ndarray]) -> None:
        self.size = np.array([len(x) for x in ints], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.concatenate([*ints, np.zeros(0, np.uint32)]).astype(np.uint32)
        self.owner = np.repeat(np.arange(len(ints)), self.size)
        self.at = np.arange(len(self.flat)) - self.start[self.owner]
        self.near, self.there = np.zeros((len(self.flat), len(NEAR)), np.uint32), np.zeros((len(self.flat), len(NEAR)), bool)
        for k, d in enumerate(NEAR):
            there = (self.at + d >= 0) & (self.at + d < self.size[self.owner])
            self.near[there, k], self.there[:, k] = self.flat[np.flatnonzero(there) + d], there


class Asked:
    """A block of queries, its windows sorted by each key."""

    def __init__(self, ints: list[np.ndarray]) -> None:
        self.windows = Windows(ints)
        self.order = [np.argsort(self.windows.flat & m, kind="stable").astype(np.int32) for m in KEYS]
        self.sorted = [(self.windows.flat & m)[o] for m, o in zip(KEYS, self.order)]

    def candidates(self, told: Windows, step: int) -> np.ndarray:
        """Rows (query, recording of ``told``, offset), each once."""
        ours, found = self.windows, []
        first = np.flatnonzero((told.at == 0) | (told.flat != np.roll(told.flat, 1)))
        for m, order, keys in zip(KEYS, self.order, self.sorted):
            own = told.flat[first] & m
            low = np.searchsorted(keys, own, "left")
            n = np.searchsorted(keys, own, "right") - low
            total, at = np.cumsum(n), 0
            while at < len(first):
                stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + step, "right")))
                k = n[at:stop]
                j = np.repeat(first[at:stop], k)
                i = order[np.repeat(low[at:stop] - (np.cumsum(k) - k), k) + np.arange(len(j))]
                at = stop
                offset = told.at[j] - ours.at[i]
                q, c = ours.owner[i], told.owner[j]
                long = np.minimum(ours.size[q], told.size[c] - offset) - np.maximum(0, -offset) >= OVERLAP
                i, j, q, c, offset = i[long], j[long], q[long], c[long], offset[long]
                both = ours.there[i] & told.there[j]
                wrong = (np.bitwise_count(ours.near[i] ^ told.near[j]) * both).sum(axis=1, dtype=np.int64)
                good = wrong <= NEAR_ERROR * 32 * both.sum(axis=1)
                found.append(np.stack((q[good], c[good], offset[good]), axis=1))
        return np.unique(np.concatenate([*found, np.zeros((0, 3), np.int64)]), axis=0)

    def matches(self, told: Windows, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The best accepted offset of each pair: rows (query, recording, offset), windows, share of different bits."""
        tried, kept = self.candidates(told, step), []
        for at in range(0, len(tried), most := max(1, step // 64)):
            part = tried[at : at + most]
            q, c, offset = part.T
            start = np.maximum(0, -offset)
            n = np.minimum(self.windows.size[q], told.size[c] - offset) - start
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            a = self.windows.flat[np.repeat(self.windows.start[q] + start, n) + k]
            b = told.flat[np.repeat(told.start[c] + start + offset, n) + k]
            wrong = np.add.reduceat(np.bitwise_count(a ^ b).astype(np.int64), np.cumsum(n) - n)
            ok = wrong / (32 * n) <= BIT_ERROR
            kept.append((part[ok], n[ok], (wrong / (32 * n))[ok]))
        rows, n, error = (np.concatenate(x) for x in zip(*kept)) if kept else (tried, np.zeros(0, np.int64), np.zeros(0))
        order = np.lexsort((rows[:, 2], np.abs(rows[:, 2]), error, rows[:, 1], rows[:, 0]))
        rows, n, error = rows[order], n[order], error[order]
        best = np.ones(len(rows), bool)
        best[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
        return rows[best], n[best], error[best]


_ASKED: dict = {}


def _ints(column: pa.Array) -> list[np.ndarray]:
    return [x.values.to_numpy(zero_copy_only=False).view(np.uint32) for x in column]


def align(prints: DataFrame, every: int = EVERY, hot: int = HOT) -> DataFrame:
    """Rows (kind, id, class_id, other_class, offset, windows, bit_error) from (id, ints).

    ``hot`` bounds how many shared keys are held at once (``STEP`` times as many).
    """
    spark = prints.sparkSession
    bounded_batches(spark)
    prints = cut(prints, "chroma-prints")
    some = prints.where(F.size("ints") > 0)
    classes = some.groupBy("ints").agg(F.min("id").alias("class_id"), F.max(F.coalesce(F.col("id") % every == 0, F.lit(False))).alias("query"))
    classes = cut(classes.where("class_id is not null"), "chroma-classes")
    members = prints.join(classes.select("ints", "class_id"), "ints", "left").select(F.lit("member").alias("kind"), "id", "class_id")
    id_kind = prints.schema["id"].dataType
    queries = classes.where("query").select("class_id", "ints")
    blocks = -(-queries.agg(F.coalesce(F.sum(F.size("ints")), F.lit(0))).first()[0] // BLOCK_WINDOWS)
    schema = f"kind string, id {id_kind.simpleString()}, class_id {id_kind.simpleString()}, other_class {id_kind.simpleString()}, offset int, windows int, bit_error double"
    found = [members]
    for block in range(blocks):
        asked = queries.where(F.pmod(F.xxhash64("class_id"), F.lit(blocks)) == block).toArrow().combine_chunks()
        sent = spark.sparkContext.broadcast((uuid.uuid4().hex, asked.column("class_id").to_pylist(), [np.array(x, np.int32).view(np.uint32) for x in asked.column("ints").to_pylist()]))
        matches = classes.select("class_id", "ints").mapInArrow(_matcher(sent, hot * STEP), schema)
        found.append(cut(matches, "chroma-matches") if blocks > 1 else matches)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)


def _matcher(sent, step: int):
    """Matches of the classes of a batch with the queries of a broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, ids, ints = sent.value
        if name not in _ASKED:
            _ASKED.clear()
            _ASKED[name] = Asked(ints)
        asked = _ASKED[name]
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                part = batch.slice(at, 250)
                others = part.column("class_id").to_pylist()
                rows, n, error = asked.matches(Windows(_ints(part.column("ints"))), step)
                own = np.array([ids[q] != others[c] for q, c in rows[:, :2].tolist()], bool)
                rows, n, error = rows[own], n[own], error[own]
                kind = part.column("class_id").type
                yield pa.RecordBatch.from_arrays(
                    [pa.array(["match"] * len(rows), pa.string()), pa.nulls(len(rows), kind), pa.array([ids[q] for q in rows[:, 0].tolist()], kind), pa.array([others[c] for c in rows[:, 1].tolist()], kind), pa.array(rows[:, 2].astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(error)],
                    ["kind", "id", "class_id", "other_class", "offset", "windows", "bit_error"],
                )

    return run


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(fingerprints(recordings(table(spark, sf_dir, "embeddings"))))
