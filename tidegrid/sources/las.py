"""LAS records: the layout of a file, its reference system, and a data source that splits large files by records."""

from __future__ import annotations

import glob
import io
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of the longest header.
HEADER = 375


@dataclass(frozen=True)
class Layout:
    """Where the point records of a file are, and how they are scaled."""

    start: int
    size: int
    count: int
    wide: bool
    scale: tuple[float, ...]
    offset: tuple[float, ...]

    @classmethod
    def of(cls, head: bytes) -> Layout | None:
        """The layout by the first `HEADER` bytes; None where they are not those of a LAS file."""
        if head[:4] != b"LASF":
            return None
        (start,) = struct.unpack_from("<I", head, 96)
        kind, size, n = struct.unpack_from("<BHI", head, 104)
        if head[25] >= 4 and not n:
            (n,) = struct.unpack_from("<Q", head, 247)
        return cls(start, size, n, kind & 0x3F >= 6, struct.unpack_from("<3d", head, 131), struct.unpack_from("<3d", head, 155))

    def points(self, raw, count: int, start: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Coordinates and classes of `count` records that begin at byte `start` of `raw`."""
        record = np.dtype({"names": ["xyz", "class"], "formats": ["(3,)<i4", "u1"], "offsets": [0, 16 if self.wide else 15], "itemsize": self.size})
        rows = np.frombuffer(raw, record, count, start)
        return rows["xyz"] * np.array(self.scale) + np.array(self.offset), rows["class"] if self.wide else rows["class"] & 0x1F


def _records(f, at: int, count: int, wide: bool):
    """(owner, number, body) of variable records, read one by one; `wide`: those after the points, with longer headers."""
    head = 60 if wide else 54
    for _ in range(count):
        f.seek(at)
        raw = f.read(head)
        if len(raw) < head:
            return
        owner, number, length = raw[2:18].rstrip(b"\0"), *struct.unpack_from("<HQ" if wide else "<HH", raw, 18)
        # bodies of other owners are passed over
        yield owner, number, f.read(length) if owner == b"LASF_Projection" else b""
        at += head + length


def reference_system_of(f) -> str | None:
    """The reference system that the variable records of an opened file name, before or after its points: well-known text, else EPSG:code of a projected or
    geographic system; None without one."""
    head = f.read(HEADER)
    if head[:4] != b"LASF":
        return None
    (start,), (n,) = struct.unpack_from("<H", head, 94), struct.unpack_from("<I", head, 100)
    ranges = [(start, n, False)]
    if head[25] >= 4 and start >= HEADER:
        ranges.append((*struct.unpack_from("<QI", head, 235), True))
    codes = {}
    for at, count, wide in ranges:
        for owner, number, body in _records(f, at, count, wide):
            if owner == b"LASF_Projection" and number == 2112:
                return body.rstrip(b"\0").decode("utf-8", "replace")
            if owner == b"LASF_Projection" and number == 34735:
                keys = np.frombuffer(body, "<u2", len(body) // 8 * 4).reshape(-1, 4)[1:]
                # a key whose second field is 0 holds its value
                codes |= {int(k): int(v) for k, place, _, v in keys if place == 0}
    code = codes.get(3072) or codes.get(2048)
    return f"EPSG:{code}" if code else None


def reference_system(raw: bytes) -> str | None:
    """The same of a whole file in memory."""
    return reference_system_of(io.BytesIO(raw))


@dataclass
class Records(InputPartition):
    """Records `first` to `first + count` of a file."""

    path: str
    first: int
    count: int


class LasRecords(DataSource):
    """x, y, z and classification of LAS files, a task for every `records` of them (2,000,000 if not given). Tasks read their own bytes of a file, so
    `path`, a file or pattern, must be in a folder that driver and executors mount; `readers.read_las` takes any folder of Spark's, a file a task. A file
    without all its records is an error.

    spark.dataSource.register(LasRecords); spark.read.format("las_records").option("path", ..).load()
    """

    @classmethod
    def name(cls) -> str:
        return "las_records"

    def schema(self) -> str:
        return "x double, y double, z double, classification int"

    def reader(self, schema) -> DataSourceReader:
        return LasRecordsReader(self.options["path"], int(self.options.get("records", 2_000_000)))


class LasRecordsReader(DataSourceReader):
    def __init__(self, path: str, records: int):
        self.path, self.records = path.removeprefix("file://"), records

    def partitions(self) -> list[Records]:
        found = []
        for path in sorted(glob.glob(self.path)):
            with open(path, "rb") as f:
                layout = Layout.of(f.read(HEADER))
            if layout:
                if os.path.getsize(path) < layout.start + layout.count * layout.size:
                    raise ValueError(f"{path}: shorter than its header says")
                found += [Records(path, i, min(self.records, layout.count - i)) for i in range(0, layout.count, self.records)]
        return found

    def read(self, part: Records) -> Iterator[pa.RecordBatch]:
        if part is None:  # no file, or none with records
            return
        with open(part.path, "rb") as f:
            layout = Layout.of(f.read(HEADER))
            f.seek(layout.start + part.first * layout.size)
            for i in range(0, part.count, 100_000):
                n = min(100_000, part.count - i)
                xyz, classes = layout.points(f.read(n * layout.size), n)
                columns = [pa.array(np.ascontiguousarray(c)) for c in xyz.T]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(classes.astype(np.int32))], names=["x", "y", "z", "classification"])
