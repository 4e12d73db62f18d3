"""SER video as a Spark data source, one row a frame.

    spark.dataSource.register(SerDataSource)
    spark.read.format("ser").option("path", "scan.ser").load()

Partitions are ranges of frames, each read by seeking to its own bytes.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

HEADER = 178
SCHEMA = "scan_id string, frame int, width int, height int, px array<float>"


@dataclass(frozen=True)
class SerHeader:
    color_id: int
    width: int
    height: int
    bit_depth: int
    frame_count: int
    observer: str
    instrument: str
    telescope: str
    date_time: int
    date_time_utc: int

    @property
    def bytes_per_px(self) -> int:
        return 2 if self.bit_depth > 8 else 1

    @property
    def frame_bytes(self) -> int:
        return self.width * self.height * self.bytes_per_px


def read_header(path: str) -> SerHeader:
    """The header; ValueError for colour video, a short file or a cut-off body."""
    with open(path, "rb") as f:
        raw = f.read(HEADER)
    if len(raw) < HEADER:
        raise ValueError(f"{path}: shorter than a SER header")
    color, _, width, height, depth, count = struct.unpack_from("<6i", raw, 18)
    text = [raw[a : a + 40].decode("utf-8", "replace").rstrip("\0 ") for a in (42, 82, 122)]
    stamp = struct.unpack_from("<2q", raw, 162)
    header = SerHeader(color, width, height, depth, count, *text, *stamp)
    if color > 19:
        raise ValueError(f"{path}: colour video (id {color}) is not supported")
    if width <= 0 or height <= 0 or count < 0:
        raise ValueError(f"{path}: bad frame size or count")
    if os.path.getsize(path) < HEADER + header.frame_bytes * count:
        raise ValueError(f"{path}: truncated body")
    return header


def read_frames(path: str, header: SerHeader, start: int, count: int) -> np.ndarray:
    """Frames as float32 (count, height, width); 8-bit values are scaled by 257."""
    with open(path, "rb") as f:
        f.seek(HEADER + start * header.frame_bytes)
        raw = f.read(count * header.frame_bytes)
    px = np.frombuffer(raw, "<u2" if header.bytes_per_px == 2 else "u1").astype(np.float32)
    return (px if header.bytes_per_px == 2 else px * 257).reshape(count, header.height, header.width)


def write_ser(path: str, frames: np.ndarray, observer: str = "", instrument: str = "", telescope: str = "", ticks: int = 0) -> None:
    """16-bit mono video of frames (count, height, width)."""
    n, h, w = frames.shape
    with open(path, "wb") as f:
        f.write(b"LUCAM-RECORDER" + struct.pack("<7i", 0, 0, 0, w, h, 16, n))
        for text in (observer, instrument, telescope):
            f.write(text.encode()[:40].ljust(40, b"\0"))
        f.write(struct.pack("<2q", ticks, ticks))
        f.write(np.clip(frames, 0, 65535).astype("<u2").tobytes())


@dataclass
class FrameRange(InputPartition):
    path: str
    start: int
    stop: int


class SerReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p.strip() for p in options["path"].split(",") if p.strip()]
        self.per = int(options.get("framesPerPartition", "64"))
        self.first = int(options.get("firstFrame", "0"))
        self.last = int(options.get("lastFrame", str(1 << 31)))

    def partitions(self) -> list[FrameRange]:
        out = []
        for path in self.paths:
            stop = min(read_header(path).frame_count, self.last)
            out += [FrameRange(path, a, min(a + self.per, stop)) for a in range(self.first, stop, self.per)]
        return out

    def read(self, partition: FrameRange) -> Iterator[pa.RecordBatch]:
        header = read_header(partition.path)
        size = header.width * header.height
        step = max(1, (4 << 20) // (4 * size))
        for a in range(partition.start, partition.stop, step):
            n = min(step, partition.stop - a)
            px = read_frames(partition.path, header, a, n).reshape(-1)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([partition.path] * n),
                    pa.array(np.arange(a, a + n, dtype=np.int32)),
                    pa.array(np.full(n, header.width, np.int32)),
                    pa.array(np.full(n, header.height, np.int32)),
                    pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * size), pa.array(px)),
                ],
                ["scan_id", "frame", "width", "height", "px"],
            )


class PushingSerReader(SerReader):
    """Takes conditions on `frame` into the ranges that are read; they are tested again on the rows."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) == ("frame",):
                v = getattr(f, "value", None)
                if isinstance(f, EqualTo):
                    self.first, self.last = max(self.first, v), min(self.last, v + 1)
                elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.first = max(self.first, v + isinstance(f, GreaterThan))
                elif isinstance(f, (LessThan, LessThanOrEqual)):
                    self.last = min(self.last, v + isinstance(f, LessThanOrEqual))
            yield f


class SerDataSource(DataSource):
    """Options: path (or several, by commas), framesPerPartition, firstFrame,
    lastFrame; pushdown=true where the session has
    spark.sql.python.filterPushdown.enabled.  A scan's id is its path."""

    @classmethod
    def name(cls) -> str:
        return "ser"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SerReader:
        return (PushingSerReader if self.options.get("pushdown", "false").lower() == "true" else SerReader)(self.options)
