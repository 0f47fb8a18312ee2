"""Open Ephys files: byte layouts and a Spark data source.

``spark.read.format("openephys").option("kind", "continuous").load(folder)`` gives one row for each record of each
channel file: partitions are (file, range of records), so large files are read in parallel; filters on ``channel`` and
``record`` are pushed into the reader and prune files and ranges.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

HEADER_BYTES = 1024
MARKER = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 255], np.uint8)
EVENT = np.dtype([("timestamp", "<i8"), ("sample", "<i2"), ("type", "u1"), ("node", "u1"), ("id", "u1"), ("channel", "u1"), ("recording", "<u2")])
_NUMBERS = {"bitVolts": float, "sampleRate": float, "blockLength": int, "bufferSize": int, "header_bytes": int}


def parse_header(raw: bytes) -> dict:
    """``header.key = value;`` pairs, numbers as numbers."""
    out = {}
    for line in raw.decode("latin-1").replace("\0", "").split(";"):
        m = re.match(r"\s*header\.(\w+)\s*=\s*(.*?)\s*$", line, re.S)
        if m:
            key, value = m[1], m[2].strip().strip("'")
            out[key] = _NUMBERS[key](float(value)) if key in _NUMBERS else value
    return out


def read_header(path: str | Path) -> dict:
    with open(path, "rb") as f:
        return parse_header(f.read(HEADER_BYTES))


def record_type(samples: int) -> np.dtype:
    return np.dtype([("timestamp", "<i8"), ("n", "<u2"), ("recording", ">u2"), ("samples", ">i2", (samples,)), ("marker", "u1", (10,))])


def record_count(path: str | Path, samples: int) -> int:
    """Records of a file; the rest must be none."""
    size, each = Path(path).stat().st_size - HEADER_BYTES, record_type(samples).itemsize
    if size % each:
        raise ValueError(f"{path}: {size} bytes are no whole number of records")
    return size // each


def read_records(path: str | Path, start: int = 0, stop: int | None = None, samples: int = 1024) -> np.ndarray:
    """Records of a continuous file; a wrong length or marker is an error that names the record."""
    dtype = record_type(samples)
    stop = record_count(path, samples) if stop is None else stop
    out = np.fromfile(path, dtype, max(0, stop - start), offset=HEADER_BYTES + start * dtype.itemsize)
    bad = np.flatnonzero((out["n"] != samples) | (out["marker"] != MARKER).any(axis=1))
    if len(bad):
        raise ValueError(f"{path}: record {start + bad[0]} is broken")
    return out


def read_events(path: str | Path) -> np.ndarray:
    """Every event of an events file, the last one too."""
    return np.fromfile(path, EVENT, offset=HEADER_BYTES)


def spike_type(channels: int, samples: int) -> np.dtype:
    return np.dtype([("type", "u1"), ("timestamp", "<i8"), ("software", "<i8"), ("source", "<u2"), ("channels", "<u2"), ("samples", "<u2"), ("sorted_id", "<u2"), ("electrode", "<u2"), ("channel", "<u2"), ("color", "u1", (3,)), ("pc", "<f4", (2,)), ("rate", "<u2"), ("waveform", "<u2", (channels, samples)), ("gain", "<f4", (channels,)), ("threshold", "<u2", (channels,)), ("recording", "<u2")])


def read_spikes(path: str | Path) -> np.ndarray:
    """Spikes of one electrode; waveforms are counts (``spike_volts`` converts)."""
    with open(path, "rb") as f:
        f.seek(HEADER_BYTES + 19)
        head = np.frombuffer(f.read(4), "<u2")
    return np.fromfile(path, spike_type(*head), offset=HEADER_BYTES) if len(head) == 2 else np.zeros(0, spike_type(1, 1))


def spike_volts(spikes: np.ndarray) -> np.ndarray:
    return (spikes["waveform"].astype(float) - 32768) / (spikes["gain"][:, :, None] / 1000)


def write_continuous(path: str | Path, samples: np.ndarray, per_record: int = 1024, bit_volts: float = 0.195, rate: float = 30000.0) -> None:
    """The inverse of the reader (whole records)."""
    header = f"header.format = 'Open Ephys Data Format'; header.version = 0.4; header.header_bytes = 1024; header.sampleRate = {rate}; header.blockLength = {per_record}; header.bufferSize = {per_record}; header.bitVolts = {bit_volts};"
    n = len(samples) // per_record
    out = np.zeros(n, record_type(per_record))
    out["timestamp"], out["n"], out["marker"] = np.arange(n) * per_record, per_record, MARKER
    out["samples"] = samples[: n * per_record].reshape(n, per_record)
    with open(path, "wb") as f:
        f.write(header.encode().ljust(HEADER_BYTES))
        out.tofile(f)


def write_events(path: str | Path, events: np.ndarray) -> None:
    with open(path, "wb") as f:
        f.write(b"header.format = 'Open Ephys Data Format'; header.version = 0.4;".ljust(HEADER_BYTES))
        events.astype(EVENT).tofile(f)


def channel_files(folder: str | Path, source: str | None = None, kind: str = "CH") -> list[tuple[int, Path]]:
    """(channel number, file) of a folder's continuous files, in numeric order."""
    out = []
    for p in Path(folder).glob("*.continuous"):
        m = re.match(r"(\d+)_(?:\w+_)?(CH|ADC|AUX)(\d+)(?:_\d+)?$", p.stem)
        if m and m[2] == kind and (source is None or m[1] == source):
            out.append((int(m[3]), p))
    return sorted(out)


def common_header(files: list[Path]) -> dict:
    """The header that the files agree on (numbers nearly, dates within a second); else an error."""
    heads = [read_header(p) for p in files]
    for h in heads[1:]:
        for key in ("sampleRate", "bitVolts", "bufferSize", "blockLength"):
            if key in heads[0] and not np.isclose(heads[0][key], h.get(key, np.nan)):
                raise ValueError(f"files differ in {key}")
    return heads[0] if heads else {}


def pack(folder: str | Path, out: str | Path, channels: list[int] | None = None, reference: str | list[int] | None = None, chunk: int = 4000, kind: str = "CH") -> None:
    """A folder as one flat int16 file in sample-major order, less a reference (channels, or their average)."""
    files = [(c, p) for c, p in channel_files(folder, kind=kind) if channels is None or c in channels]
    samples = int(common_header([p for _, p in files]).get("blockLength", 1024))
    n = record_count(files[0][1], samples)
    with open(out, "wb") as sink:
        for at in range(0, n, chunk):
            data = np.stack([read_records(p, at, min(n, at + chunk), samples)["samples"].ravel() for _, p in files]).astype(np.int32)
            if reference is not None:
                own = slice(None) if reference == "average" else [k for k, (c, _) in enumerate(files) if c in reference]
                data = data - np.round(data[own].mean(axis=0)).astype(np.int32)
            data.T.astype("<i2").tofile(sink)


def probe_json(mapping: list[int]) -> str:
    """A channel map as the text of a probe file."""
    import json

    return json.dumps({"0": {"mapping": [c + 1 for c in mapping], "reference": [-1] * len(mapping), "enabled": [True] * len(mapping)}})


class _Part(InputPartition):
    def __init__(self, path: str, channel: int, start: int, stop: int, samples: int, scale: float) -> None:
        self.path, self.channel, self.start, self.stop, self.samples, self.scale = path, channel, start, stop, samples, scale


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.kind, self.folder = options.get("kind", "continuous"), options["path"]
        self.channel_kind, self.each = options.get("channels", "CH"), int(options.get("recordspersplit", 4000))
        self.ignore_last = options.get("ignorelastrecord", "true").lower() == "true"
        self.bounds: dict[str, list] = {"channel": [0, 1 << 31], "record": [0, 1 << 62]}

    def pushFilters(self, filters: list) -> Iterator:  # noqa: N802
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name in self.bounds:
                b = self.bounds[name]
                if isinstance(f, (EqualTo, GreaterThanOrEqual)):
                    b[0] = max(b[0], f.value)
                if isinstance(f, (EqualTo, LessThanOrEqual)):
                    b[1] = min(b[1], f.value + 1)
                if isinstance(f, GreaterThan):
                    b[0] = max(b[0], f.value + 1)
                if isinstance(f, LessThan):
                    b[1] = min(b[1], f.value)
            yield f  # Spark checks again; the reader only leaves out what can't match

    def partitions(self) -> list[_Part]:
        if self.kind != "continuous":
            return [_Part(str(p), 0, 0, 0, 0, 1.0) for p in sorted(Path(self.folder).glob(f"*.{self.kind}"))]
        out = []
        (low, high), (first, last) = self.bounds["channel"], self.bounds["record"]
        for channel, p in channel_files(self.folder, kind=self.channel_kind):
            if not low <= channel < high:
                continue
            head = read_header(p)
            samples = int(head.get("blockLength", 1024))
            n = record_count(p, samples) - self.ignore_last
            for at in range(max(0, first), min(n, last), self.each):
                out.append(_Part(str(p), channel, at, min(n, last, at + self.each), samples, head.get("bitVolts", 1.0)))
        return out or [_Part("", 0, 0, 0, 1, 1.0)]

    def read(self, part: _Part) -> Iterator:
        if self.kind == "events":
            e = read_events(part.path)
            yield pa.RecordBatch.from_arrays([pa.array(e[c].astype(np.int64)) for c in EVENT.names], list(EVENT.names))
        elif self.kind == "spikes":
            s = read_spikes(part.path)
            volts = spike_volts(s)
            yield pa.RecordBatch.from_arrays([*(pa.array(s[c].astype(np.int64)) for c in ("timestamp", "source", "electrode", "sorted_id")), pa.array(volts.tolist(), pa.list_(pa.list_(pa.float64()))), pa.array(s["gain"].astype(float).tolist(), pa.list_(pa.float64())), pa.array(s["threshold"].astype(float).tolist(), pa.list_(pa.float64()))], ["timestamp", "source", "electrode", "sorted_id", "waveform", "gain", "threshold"])
        elif part.path:
            for at in range(part.start, part.stop, 256):
                rec = read_records(part.path, at, min(part.stop, at + 256), part.samples)
                flat = pa.array(rec["samples"].astype(np.int16).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rec) + 1, dtype=np.int32) * part.samples), flat)
                yield pa.RecordBatch.from_arrays([pa.array([part.channel] * len(rec), pa.int64()), pa.array(np.arange(at, at + len(rec))), pa.array(rec["timestamp"].astype(np.int64)), pa.array([part.scale] * len(rec)), lists], ["channel", "record", "timestamp", "bit_volts", "samples"])


class OpenEphys(DataSource):
    """Options: path, kind (continuous, events, spikes), channels (CH, ADC, AUX), recordsPerSplit, ignoreLastRecord."""

    @classmethod
    def name(cls) -> str:
        return "openephys"

    def schema(self) -> str:
        return {
            "continuous": "channel long, record long, timestamp long, bit_volts double, samples array<smallint>",
            "events": ", ".join(f"`{c}` long" for c in EVENT.names),
            "spikes": "timestamp long, source long, electrode long, sorted_id long, waveform array<array<double>>, gain array<double>, threshold array<double>",
        }[self.options.get("kind", "continuous")]

    def reader(self, schema) -> DataSourceReader:
        return _Reader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(OpenEphys)


def signal(records, microvolts: bool = True):
    """Records as a signal (channel, t, value), scaled late so that pruning still works."""
    from pyspark.sql import functions as F

    rows = records.select("channel", "record", "bit_volts", F.size("samples").alias("_n"), F.posexplode("samples").alias("_k", "raw"))
    value = F.col("raw").cast("double")
    return rows.select("channel", (F.col("record") * F.col("_n") + F.col("_k")).alias("t"), (value * F.col("bit_volts") if microvolts else value).alias("value"))
