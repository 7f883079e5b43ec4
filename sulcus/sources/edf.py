"""EDF recordings as a Spark data source: `spark.read.format("edf")`, files split by ranges of data records.

A recording is a header and records of equal size, each with some samples of every channel one after another.  The driver lists
files and their sizes only; each partition reads the header and its own range of records, so a file larger than a task's memory
is read in parts, parts of small files go to one task together, and a part is cut into rows of about `row_bytes` of samples.  Options: `path` (a folder, searched with all
folders below, or a file; any file system that pyarrow reaches), `containing` (part of the path that files must have),
`channels` (names, comma-separated; others are not decoded), `headers` (true: one row per channel without samples, and nothing
but headers is read), `split_bytes` and `row_bytes`.
"""

from __future__ import annotations

import dataclasses
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: One row per channel and range of samples; a file that can't be read is one row whose status says why.
SCHEMA = "path string, channel long, name string, sfreq double, first long, samples array<double>, status string"
_ARROW = pa.schema([("path", pa.string()), ("channel", pa.int64()), ("name", pa.string()), ("sfreq", pa.float64()), ("first", pa.int64()), ("samples", pa.list_(pa.float64())), ("status", pa.string())])

#: The fields of a header's channel part, and their widths in bytes.
FIELDS = (("label", 16), ("transducer", 80), ("unit", 8), ("pmin", 8), ("pmax", 8), ("dmin", 8), ("dmax", 8), ("filter", 80), ("n", 8), ("reserved", 32))
HEAD = 256
#: Bytes that could be read while a file is opened, and that a task should read; tasks that there are before parts are put together.
OPEN, TASK, TASKS = 1 << 20, 64 << 20, 128


@dataclasses.dataclass
class Header:
    size: int
    records: int
    seconds: float
    names: list[str]
    per_record: np.ndarray
    gain: np.ndarray
    offset: np.ndarray

    @property
    def record_bytes(self) -> int:
        return 2 * int(self.per_record.sum())


def header(f, length: int) -> Header:
    """Of an open file of `length` bytes; ValueError if it isn't one."""
    text = lambda raw, a, n: raw[a : a + n].decode("latin-1").strip()
    raw = f.read(HEAD)
    if len(raw) < HEAD:
        raise ValueError("the file ends within its header")
    records, seconds, channels = int(text(raw, 236, 8)), float(text(raw, 244, 8)), int(text(raw, 252, 4))
    if channels < 1 or not seconds > 0:
        raise ValueError(f"a header of {channels} channels and records of {seconds:g} seconds")
    raw = f.read(HEAD * channels)
    if len(raw) < HEAD * channels:
        raise ValueError("the file ends within its header")
    cols, at = {}, 0
    for name, width in FIELDS:
        cols[name] = [text(raw, at + k * width, width) for k in range(channels)]
        at += width * channels
    per = np.array([int(v) for v in cols["n"]])
    lo, hi, dlo, dhi = (np.array([float(v) for v in cols[c]]) for c in ("pmin", "pmax", "dmin", "dmax"))
    signal = np.array(["annotation" not in v.lower() for v in cols["label"]])
    if (per < 1).any() or (dhi == dlo)[signal].any():
        raise ValueError("a channel without samples or without a digital range")
    size = HEAD * (1 + channels)
    gain = (hi - lo) / np.where(dhi == dlo, 1, dhi - dlo)
    h = Header(size, records, seconds, cols["label"], per, gain, lo - dlo * gain)
    whole = (length - size) // h.record_bytes
    if records < 0:  # still being recorded: as many as there are
        h.records = whole
    elif whole < records:
        raise ValueError(f"{records} records are announced, and {whole} are there")
    return h


@dataclasses.dataclass
class Part(InputPartition):
    path: str
    length: int
    part: int
    parts: int

    @property
    def cost(self) -> int:
        """Bytes to read, and what it takes to open a file."""
        return self.length // self.parts + OPEN


@dataclasses.dataclass
class Bundle(InputPartition):
    """What one task reads: one large part, or parts of many small files."""

    parts: list[Part]


def bundles(parts: list[Part], most: int) -> list[Bundle]:
    """Neighbours put together as long as they cost no more than `most`."""
    out: list[Bundle] = []
    total = 0
    for p in parts:
        total += p.cost
        if not out or total > most:
            out.append(Bundle([]))
            total = p.cost
        out[-1].parts.append(p)
    return out


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path within it."""
    if re.match(r"[a-z][a-z0-9+.-]*:", path):
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return fs.LocalFileSystem(), path


class EdfReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"].rstrip("/")
        self.containing = options.get("containing", "")
        self.channels = {c.strip() for c in options["channels"].split(",")} if "channels" in options else None
        self.headers = options.get("headers", "false").lower() == "true"
        self.split = int(options.get("split_bytes", 64 << 20))
        self.row = int(options.get("row_bytes", 8 << 20))
        if self.split < 1 or self.row < 1:
            raise ValueError("split_bytes and row_bytes must be positive")

    def partitions(self) -> list[Bundle]:
        system, at = file_system(self.path)
        at = at.rstrip("/")
        info = system.get_file_info(at)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at, recursive=True))
        local = isinstance(system, fs.LocalFileSystem)
        out = []
        for f in sorted(found, key=lambda f: f.path):
            if f.type == fs.FileType.File and f.path.lower().endswith(".edf") and self.containing in f.path:
                path = f"file:{f.path}" if local else self.path + f.path[len(at) :]  # as Spark's own sources name files
                parts = 1 if self.headers else max(1, -(-f.size // self.split))
                out += [Part(path, f.size, k, parts) for k in range(parts)]
        return bundles(out, min(TASK, sum(p.cost for p in out) // TASKS)) or [Bundle([])]

    def read(self, partition: Bundle) -> Iterator[pa.RecordBatch]:
        for p in partition.parts:
            try:
                yield from self._rows(p)
            except (ValueError, OSError) as e:
                if p.part == 0:  # every part of a file meets its faults; one row says so
                    yield pa.RecordBatch.from_pylist([{"path": p.path, "status": str(e)}], _ARROW)

    def _rows(self, p: Part) -> Iterator[pa.RecordBatch]:
        system, at = file_system(p.path)
        with system.open_input_file(at) as f:
            h = header(f, p.length)
            wanted = [k for k, name in enumerate(h.names) if "annotation" not in name.lower() and (self.channels is None or name in self.channels)]
            number = {k: c for c, k in enumerate(k for k, name in enumerate(h.names) if "annotation" not in name.lower())}
            edge = np.concatenate([[0], np.cumsum(h.per_record)])
            if self.headers:
                yield pa.RecordBatch.from_pylist([{"path": p.path, "channel": number[k], "name": h.names[k], "sfreq": h.per_record[k] / h.seconds, "first": 0, "samples": [], "status": "ok"} for k in wanted], _ARROW)
                return
            first, last = h.records * p.part // p.parts, h.records * (p.part + 1) // p.parts
            step = max(1, self.row // h.record_bytes)
            for r in range(first, last, step):
                n = min(step, last - r)
                f.seek(h.size + r * h.record_bytes)
                raw = np.frombuffer(f.read(n * h.record_bytes), dtype="<i2").reshape(n, -1)
                rows = {name: [] for name in _ARROW.names}
                for k in wanted:
                    x = raw[:, edge[k] : edge[k + 1]].ravel() * h.gain[k] + h.offset[k]
                    values = (p.path, number[k], h.names[k], h.per_record[k] / h.seconds, r * int(h.per_record[k]), x, "ok")
                    for name, v in zip(rows, values):
                        rows[name].append(v)
                yield pa.RecordBatch.from_arrays([pa.array(v, kind.type) for v, kind in zip(rows.values(), _ARROW)], schema=_ARROW)


class EdfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "edf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> EdfReader:
        if "path" not in self.options:
            raise ValueError("edf: a path is needed")
        return EdfReader(dict(self.options))


def register(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(EdfSource)
    return spark
