"""A data source for uncompressed LAS tiles: ``spark.read.format("las").load(path)``.

The columns are those of ``schema.POINTS``; dimensions that a point format lacks are NULL. Each
file is split into ranges of points. Compressed tiles need a decoder that is not part of this
library: convert them to Parquet first.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schema import POINTS

# Fixed values of the LAS format: bytes of each point format, place of the classification and of colours.
SIZES = {0: 20, 1: 28, 2: 26, 3: 34, 4: 57, 5: 63, 6: 30, 7: 36, 8: 38, 9: 59, 10: 67}
COLOURS = {2: 20, 3: 28, 5: 28, 7: 30, 8: 30, 10: 30}
POINTS_A_PARTITION = 1_000_000


@dataclass
class Header:
    points: int
    offset: int
    kind: int
    size: int
    scale: tuple[float, float, float]
    origin: tuple[float, float, float]


def header(raw: bytes) -> Header:
    if raw[:4] != b"LASF":
        raise ValueError("this is no LAS file")
    minor, kind = raw[25], raw[104]
    if kind & 0x80 or kind not in SIZES:
        raise ValueError(f"point format {kind & 0x7F} is compressed or not supported")
    offset, size, old = struct.unpack_from("<I", raw, 96)[0], struct.unpack_from("<H", raw, 105)[0], struct.unpack_from("<I", raw, 107)[0]
    count = struct.unpack_from("<Q", raw, 247)[0] if minor >= 4 else old
    return Header(count or old, offset, kind, size, struct.unpack_from("<3d", raw, 131), struct.unpack_from("<3d", raw, 155))


def decode(raw: bytes, head: Header, tile: str, first: int) -> pa.RecordBatch:
    """A batch of the points in ``raw``."""
    n = len(raw) // head.size
    data = np.frombuffer(raw, np.uint8, n * head.size).reshape(n, head.size)
    field = lambda at, kind: np.ascontiguousarray(data[:, at : at + np.dtype(kind).itemsize]).view(kind)[:, 0]
    axes = [field(4 * k, "<i4") * head.scale[k] + head.origin[k] for k in range(3)]
    flags = data[:, 14].astype(np.int32)
    new = head.kind >= 6
    classes = data[:, 16] if new else data[:, 15] & 31
    returns = (flags & 15, flags >> 4) if new else (flags & 7, (flags >> 3) & 7)
    at = COLOURS.get(head.kind)
    colours = [field(at + 2 * k, "<u2").astype(float) if at else None for k in range(3)] + [field(36, "<u2").astype(float) if head.kind in (8, 10) else None]
    number = lambda x: pa.nulls(n, pa.float64()) if x is None else pa.array(x.astype(float))
    columns = [pa.array(np.arange(first, first + n)), pa.array([tile] * n), *[pa.array(a) for a in axes], pa.array(classes.astype(np.int32)), number(field(12, "<u2")), *[number(c) for c in colours], *[number(r) for r in returns]]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in POINTS.split(", ")])


def _open(path: str):
    fs, at = pa.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    return fs, at


@dataclass
class Range(InputPartition):
    path: str
    first: int
    count: int
    number: int


class LasReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Range]:
        fs, at = _open(self.path)
        info = fs.get_file_info(at)
        prefix = self.path[: len(self.path) - len(at)] if self.path.endswith(at) else ""
        paths = [at] if info.is_file else sorted(f.path for f in fs.get_file_info(pa.fs.FileSelector(at)) if f.path.endswith(".las"))
        if not paths:
            raise FileNotFoundError(f"no LAS file in {self.path}")
        found, number = [], 0
        for path in paths:
            with fs.open_input_stream(path) as f:
                total = header(f.read(375)).points
            for first in range(0, total, POINTS_A_PARTITION):
                found.append(Range(prefix + path, first, min(POINTS_A_PARTITION, total - first), number + first))
            number += total
        return found

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        fs, at = _open(partition.path)
        with fs.open_input_file(at) as f:
            head = header(f.read(375))
            for start in range(0, partition.count, 65_536):
                n = min(65_536, partition.count - start)
                f.seek(head.offset + (partition.first + start) * head.size)
                yield decode(f.read(n * head.size), head, partition.path.rsplit("/", 1)[-1], partition.number + start)


class LasSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        return POINTS

    def reader(self, schema) -> LasReader:
        return LasReader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LasSource)
