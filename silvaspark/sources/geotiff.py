"""GeoTIFF files: a data source that reads their blocks in tasks, and a writer that compresses blocks in tasks.

``spark.read.format("geotiff").load(path)`` gives ``file, row, col`` and a double column for each
band, NULL where it holds nodata or NaN; a path may be a file, a folder or a glob. Read are plain
and DEFLATE blocks, in strips or tiles, of one sample a pixel or of bands side by side or apart.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from fnmatch import fnmatch
from xml.sax.saxutils import escape, unescape

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.graph import written
from ..operators.grid import RasterMeta
from .files import find_files

# Fixed values of the format: tags, bytes of field types, compressions.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, ROWS, STRIP_SIZES, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_SIZES, FORMAT = 322, 323, 324, 325, 339
SCALE, TIEPOINT, GEO_KEYS, METADATA, NODATA = 33550, 33922, 34735, 42112, 42113
FIELDS = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 6: ("b", 1), 8: ("h", 2), 9: ("i", 4), 11: ("f", 4), 12: ("d", 8), 16: ("Q", 8)}
PLAIN, DEFLATE = (1,), (8, 32946)
KINDS = {"u1": (1, 8), "i2": (2, 16), "u2": (1, 16), "i4": (2, 32), "f4": (3, 32), "f8": (3, 64)}
#: Blocks that a task reads; the side of the blocks that are written.
BLOCKS_A_PARTITION, SIDE = 64, 256


@dataclass
class Header:
    """What a task needs to decode blocks."""

    order: str
    width: int
    height: int
    bands: int
    kind: str
    block: tuple[int, int]
    offsets: list[int]
    sizes: list[int]
    apart: bool
    packed: bool
    predictor: int
    meta: RasterMeta
    names: list[str] = field(default_factory=list)


def _fs(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def header(path: str) -> Header:
    """The first directory of a file."""
    fs, at = _fs(path)
    with fs.open_input_file(at) as f:
        read = lambda place, n: (f.seek(place), f.read(n))[1]
        head = read(0, 16)
        order = {b"II": "<", b"MM": ">"}.get(head[:2])
        if order is None or struct.unpack(order + "H", head[2:4])[0] not in (42, 43):
            raise ValueError(f"{path} is no TIFF file")
        big = struct.unpack(order + "H", head[2:4])[0] == 43
        start = struct.unpack(order + ("Q" if big else "I"), head[8:16] if big else head[4:8])[0]
        wide, count_of, entry = ("Q", "Q", 20) if big else ("I", "H", 12)
        room = struct.calcsize(wide)
        n = struct.unpack(order + count_of, read(start, struct.calcsize(count_of)))[0]
        raw, tags = read(start + struct.calcsize(count_of), n * entry), {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HH" + wide, raw, k * entry)
            if kind not in FIELDS:
                continue
            letter, size = FIELDS[kind]
            place = k * entry + entry - room
            data = raw[place : place + room] if size * count <= room else read(struct.unpack_from(order + wide, raw, place)[0], size * count)
            tags[tag] = data[:count].rstrip(b"\0").decode("utf-8", "replace") if letter == "s" else list(struct.unpack_from(f"{order}{count}{letter}", data))
    one = lambda tag, default=None: tags[tag][0] if tag in tags else default
    compression = one(COMPRESSION, 1)
    if compression not in PLAIN + DEFLATE or one(PREDICTOR, 1) not in (1, 2):
        raise ValueError(f"{path}: compression {compression} with predictor {one(PREDICTOR, 1)} is not supported")
    kind = {1: "u", 2: "i", 3: "f"}[one(FORMAT, 1)] + str(one(BITS, 8) // 8)
    tiled, bands = TILES in tags, one(SAMPLES, 1)
    block = (one(TILE_HEIGHT), one(TILE_WIDTH)) if tiled else (min(one(ROWS, 1 << 31), one(HEIGHT)), one(WIDTH))
    scale, tie = tags.get(SCALE, [1.0, 1.0]), tags.get(TIEPOINT, [0.0] * 6)
    keys = tags.get(GEO_KEYS, [])
    codes = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4)}
    code = codes.get(3072) or codes.get(2048)
    nodata = float(tags[NODATA].strip()) if tags.get(NODATA, "").strip() else None
    meta = RasterMeta(tie[3] - tie[0] * scale[0], scale[0], tie[4] + tie[1] * scale[1], -scale[1], one(WIDTH), one(HEIGHT), f"EPSG:{code}" if code else "", nodata)
    found = {int(k): unescape(v) for k, v in re.findall(r'<Item name="DESCRIPTION" sample="(\d+)" role="description">(.*?)</Item>', tags.get(METADATA, ""))}
    names = [found.get(k) or (f"band_{k + 1}" if bands > 1 else "value") for k in range(bands)]
    return Header(order, one(WIDTH), one(HEIGHT), bands, kind, block, tags.get(TILES) or tags[STRIPS], tags.get(TILE_SIZES) or tags[STRIP_SIZES], one(PLANAR, 1) == 2, compression in DEFLATE, one(PREDICTOR, 1), meta, names)


def read_meta(spark: SparkSession, path: str) -> RasterMeta:
    """Origin, pixel size, extent, reference system and nodata of a file, or of the first file of a glob."""
    return header(find_files(spark, path)[0]).meta


def decode(raw: bytes, head: Header, samples: int) -> np.ndarray:
    """The pixels of a block: rows, columns, samples."""
    height, width = head.block
    data = np.frombuffer(zlib.decompress(raw) if head.packed else raw, head.order + head.kind)
    rows = min(height, len(data) // (width * samples))  # the last strip may be short
    data = data[: rows * width * samples].reshape(rows, width, samples)
    return np.cumsum(data, axis=1, dtype=data.dtype) if head.predictor == 2 else data


@dataclass
class Blocks(InputPartition):
    path: str
    first: int
    last: int


class GeoTiffReader(DataSourceReader):
    def __init__(self, paths: list[str], names: list[str]):
        self.paths, self.names = paths, names

    def partitions(self) -> list[InputPartition]:
        parts = []
        for path in self.paths:
            head = header(path)
            if head.names != self.names:
                raise ValueError(f"{path} has the bands {head.names}, the first file has {self.names}")
            n = len(head.offsets) // (head.bands if head.apart else 1)
            parts += [Blocks(path, k, min(k + BLOCKS_A_PARTITION, n)) for k in range(0, n, BLOCKS_A_PARTITION)]
        return parts

    def read(self, partition: Blocks) -> Iterator[pa.RecordBatch]:
        head = header(partition.path)
        height, width = head.block
        across, n = -(-head.width // width), len(head.offsets) // (head.bands if head.apart else 1)
        fs, at = _fs(partition.path)
        with fs.open_input_file(at) as f:
            for k in range(partition.first, partition.last):
                row0, col0 = k // across * height, k % across * width
                rows, cols = min(height, head.height - row0), min(width, head.width - col0)
                planes = []
                for block in [k + b * n for b in range(head.bands)] if head.apart else [k]:
                    samples = 1 if head.apart else head.bands
                    if not head.sizes[block]:  # a block that was never written
                        planes.append(np.full((rows, cols, samples), np.nan))
                        continue
                    f.seek(head.offsets[block])
                    data = decode(f.read(head.sizes[block]), head, samples)[:rows, :cols].astype(np.float64)
                    planes.append(np.where(data == head.meta.nodata, np.nan, data) if head.meta.nodata is not None else data)
                values = np.concatenate(planes, axis=2).reshape(-1, head.bands)
                places = [np.repeat(np.arange(row0, row0 + rows, dtype=np.int32), cols), np.tile(np.arange(col0, col0 + cols, dtype=np.int32), rows)]
                columns = [pa.array([partition.path] * len(values)), *map(pa.array, places), *[pa.array(values[:, b], from_pandas=True) for b in range(head.bands)]]
                yield pa.RecordBatch.from_arrays(columns, names=["file", "row", "col", *head.names])


class GeoTiff(DataSource):
    """Registered by ``register``; the bands of the first file give the columns."""

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def paths(self) -> list[str]:
        """The files of the path, sorted; Spark asks for them in a process without a session."""
        pattern = self.options["path"].rstrip("/")
        fs, at = _fs(pattern)
        head = pattern[: len(pattern) - len(at)] if pattern.endswith(at) else ""
        info = fs.get_file_info(at)
        if info.type == pa.fs.FileType.File:
            return [pattern]
        folder, last = (at, "*") if info.type == pa.fs.FileType.Directory else at.rsplit("/", 1)
        found = sorted(head + i.path for i in fs.get_file_info(pa.fs.FileSelector(folder)) if i.path.lower().endswith((".tif", ".tiff")) and fnmatch(i.base_name, last))
        if not found:
            raise FileNotFoundError(f"no GeoTIFF file matches {pattern}")
        return found

    def schema(self) -> str:
        return "file string, row int, col int, " + ", ".join(f"`{n}` double" for n in header(self.paths()[0]).names)

    def reader(self, schema) -> GeoTiffReader:
        paths = self.paths()
        return GeoTiffReader(paths, header(paths[0]).names)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GeoTiff)


def directory(meta: RasterMeta, names: list[str], kind: str, nodata: float | None, sizes: list[int]) -> bytes:
    """A file's bytes before its blocks: header, directory and what it points to; wide offsets where they are needed."""
    n, total = len(sizes), sum(sizes)
    big = total + 64 * n + (1 << 16) > 1 << 32
    letter, wide, room, entry = ("Q", 16, 8, 20) if big else ("I", 4, 4, 12)
    number, bits = KINDS[kind]
    code = int(meta.crs.split(":")[1]) if meta.crs.startswith("EPSG:") else 0
    keys = [1, 1, 0, 2, 1024, 0, 1, 1, 3072, 0, 1, code] if code else []
    named = "".join(f'<Item name="DESCRIPTION" sample="{k}" role="description">{escape(name)}</Item>' for k, name in enumerate(names))
    tags = [
        (WIDTH, 4, [meta.n_cols]), (HEIGHT, 4, [meta.n_rows]), (BITS, 3, [bits] * len(names)), (COMPRESSION, 3, [8]), (PHOTOMETRIC, 3, [1]), (SAMPLES, 3, [len(names)]),
        (PLANAR, 3, [2 if len(names) > 1 else 1]), (TILE_WIDTH, 3, [SIDE]), (TILE_HEIGHT, 3, [SIDE]), (TILES, wide, [0] * n), (TILE_SIZES, wide, sizes), (FORMAT, 3, [number] * len(names)),
        (SCALE, 12, [meta.px_w, -meta.px_h, 0.0]), (TIEPOINT, 12, [0.0, 0.0, 0.0, meta.x0, meta.y0, 0.0]),
    ]
    tags += [(GEO_KEYS, 3, keys)] * bool(code) + [(METADATA, 2, f"<GDALMetadata>{named}</GDALMetadata>".encode() + b"\0")] * (len(names) > 1)
    if nodata is not None:
        tags.append((NODATA, 2, ("nan" if nodata != nodata else f"{nodata:.17g}").encode() + b"\0"))
    start = 16 if big else 8
    extra = start + (8 if big else 2) + entry * len(tags) + room
    placed, lengths = {}, {tag: len(v) if k == 2 else len(v) * FIELDS[k][1] for tag, k, v in tags}
    for tag, _, _ in tags:
        if lengths[tag] > room:
            extra += -extra % 8
            placed[tag] = extra
            extra += lengths[tag]
    at, offsets = extra, []
    for size in sizes:
        offsets.append(at if size else 0)
        at += size
    out = bytearray(extra)
    out[:start] = struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16) if big else struct.pack("<2sHI", b"II", 42, 8)
    struct.pack_into("<Q" if big else "<H", out, start, len(tags))
    for k, (tag, kind_of, values) in enumerate(tags):
        values = offsets if tag == TILES else values
        data = values if kind_of == 2 else struct.pack(f"<{len(values)}{FIELDS[kind_of][0]}", *values)
        place = start + (8 if big else 2) + entry * k
        struct.pack_into("<HH" + letter, out, place, tag, kind_of, len(values))
        if tag in placed:
            struct.pack_into("<" + letter, out, place + entry - room, placed[tag])
            out[placed[tag] : placed[tag] + len(data)] = data
        else:
            out[place + entry - room : place + entry - room + len(data)] = data
    return bytes(out)


def write(raster: DataFrame, path: str, meta: RasterMeta, names: list[str] | None = None, kind: str = "f4", nodata: float | None = -9999.0) -> None:
    """One file of the columns ``names`` of ``row, col, ...``; NULL and missing cells are ``nodata``.

    Blocks of 256 x 256 pixels are filled and compressed in tasks; the driver learns their sizes
    and appends them one by one. Blocks without cells take no space. Rows run from the north, so the
    pixel height is negative; cells off the raster are left out.
    """
    names = names or ["value"]
    down, across = -(-meta.n_rows // SIDE), -(-meta.n_cols // SIDE)
    fill = 0.0 if nodata is None else nodata

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        tile = int(frame["_tile"].iloc[0])
        place = frame["row"].to_numpy() % SIDE, frame["col"].to_numpy() % SIDE
        rows = []
        for k, name in enumerate(names):
            block = np.full((SIDE, SIDE), fill, np.float64)
            values = frame[name].to_numpy(np.float64, na_value=np.nan)
            block[place] = np.where(np.isnan(values), fill, values)
            rows.append((k * down * across + tile, zlib.compress(block.astype("<" + kind).tobytes(), 6)))
        return pd.DataFrame(rows, columns=["block", "data"])

    inside = raster.filter(F.col("row").between(0, meta.n_rows - 1) & F.col("col").between(0, meta.n_cols - 1))
    tiles = inside.select("row", "col", *names, (F.floor(F.col("row") / SIDE) * across + F.floor(F.col("col") / SIDE)).alias("_tile"))
    blocks = written(tiles.groupBy("_tile").applyInPandas(pack, "block long, data binary"), "tiff-blocks")
    sizes = [0] * (down * across * len(names))
    for r in blocks.select("block", F.octet_length("data").alias("n")).collect():  # one number for a block
        sizes[r["block"]] = r["n"]
    fs, at = _fs(path)
    with fs.open_output_stream(at) as f:
        f.write(directory(meta, names, kind, nodata, sizes))
        for r in blocks.orderBy("block").toLocalIterator():
            f.write(bytes(r["data"]))
