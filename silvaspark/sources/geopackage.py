"""Points and polygons of a GeoPackage file, read and written with the standard library on the driver.

A GeoPackage is one SQLite file that only its host can open, so this is a way in and out for layers
of treetops, crowns or training polygons; large layers belong in Parquet. Rows are read in ranges
of their number, each written before the next is read, and written one by one.
"""

from __future__ import annotations

import sqlite3
import struct
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from ..operators.graph import shared_folder

#: Rows that the driver holds at once.
ROWS = 50_000
# Bytes of the envelope by its code in the header's flags.
ENVELOPES = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}
KINDS = {"INTEGER": "long", "INT": "long", "MEDIUMINT": "long", "SMALLINT": "long", "TINYINT": "long", "BOOLEAN": "long", "REAL": "double", "DOUBLE": "double", "FLOAT": "double"}


def well_known(raw: bytes) -> tuple[float, float] | list[list[tuple[float, float]]]:
    """A point, or the rings of a polygon (of the only part of a multipolygon), from well-known binary."""
    order = "<" if raw[0] == 1 else ">"
    kind = struct.unpack_from(order + "I", raw, 1)[0]
    size = 8 * (2 + (kind // 1000 in (1, 2)) + 2 * (kind // 1000 == 3))
    base, at = kind % 1000, 5
    if base == 1:
        return struct.unpack_from(order + "2d", raw, at)
    if base == 6:
        if struct.unpack_from(order + "I", raw, at)[0] != 1:
            raise ValueError("multipolygons of several parts are not supported")
        return well_known(raw[9:])
    if base != 3:
        raise ValueError(f"geometry type {kind} is not supported")
    rings, count = [], struct.unpack_from(order + "I", raw, at)[0]
    at += 4
    for _ in range(count):
        n = struct.unpack_from(order + "I", raw, at)[0]
        at += 4
        rings.append([struct.unpack_from(order + "2d", raw, at + size * k) for k in range(n)])
        at += size * n
    return rings


def geometry(blob: bytes | None):
    """The geometry of a GeoPackage blob; None if it is missing or empty."""
    if blob is None:
        return None
    if blob[:2] != b"GP":
        raise ValueError("this is no GeoPackage geometry")
    flags = blob[3]
    return None if flags & 16 else well_known(blob[8 + ENVELOPES[(flags >> 1) & 7] :])


def read(spark: SparkSession, path: str, layer: str | None = None) -> DataFrame:
    """A layer, the first by default: its fields, and ``x``, ``y`` for points or ``rings`` for polygons."""
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        there = dict(db.execute("select c.table_name, g.column_name from gpkg_contents c join gpkg_geometry_columns g using (table_name) order by c.rowid"))
        if not there:
            raise ValueError(f"no layer in {path}")
        if layer is not None and layer not in there:
            raise ValueError(f"no layer {layer} in {path}; there are {', '.join(there)}")
        layer = layer or next(iter(there))
        quoted = layer.replace('"', '""')
        fields = [(name, KINDS.get(kind.upper().split("(")[0], "string")) for _, name, kind, *_ in db.execute(f'pragma table_info("{quoted}")')]
        where = [name for name, _ in fields].index(there[layer])
        kind = (db.execute("select geometry_type_name from gpkg_geometry_columns where table_name = ?", (layer,)).fetchone() or [""])[0] if _has(db, "geometry_type_name") else ""
        shape_at = lambda row: geometry(row[where])
        first = next((s for (b,) in db.execute(f'select "{there[layer]}" from "{quoted}" where "{there[layer]}" is not null') if (s := geometry(b)) is not None), None)
        polygons = isinstance(first, list) or first is None and "POLYGON" in (kind or "").upper()
        plain = [(n.replace("`", ""), k) for i, (n, k) in enumerate(fields) if i != where]
        schema = ", ".join(f"`{n}` {k}" for n, k in plain) + (", rings array<array<struct<x: double, y: double>>>" if polygons else ", x double, y double")

        def rows(some: list[tuple]) -> list[tuple]:
            shapes = [shape_at(r) for r in some]
            return [tuple(v for i, v in enumerate(r) if i != where) + ((s,) if polygons else tuple(s or (None, None))) for r, s in zip(some, shapes, strict=True)]

        cursor = db.execute(f'select * from "{quoted}"')
        part = cursor.fetchmany(ROWS)
        more = cursor.fetchmany(ROWS)
        if not more:
            return spark.createDataFrame(rows(part), schema)
        folder = f"{shared_folder(spark)}/gpkg-{uuid.uuid4().hex}"
        while part:
            spark.createDataFrame(rows(part), schema).write.mode("append").parquet(folder)
            part, more = more, cursor.fetchmany(ROWS)
        return spark.read.schema(schema).parquet(folder)


def _has(db: sqlite3.Connection, column: str) -> bool:
    return any(r[1] == column for r in db.execute("pragma table_info(gpkg_geometry_columns)"))


def blob(shape, code: int) -> bytes | None:
    """The GeoPackage geometry of a point ``(x, y)`` or of rings; None stays None."""
    if shape is None:
        return None
    head = b"GP\0\1" + struct.pack("<i", code)
    if not isinstance(shape, list):
        return head + struct.pack("<BI2d", 1, 1, *shape)
    parts = [struct.pack("<BII", 1, 3, len(shape))]
    for ring in shape:
        closed = ring if ring[0] == ring[-1] else [*ring, ring[0]]
        parts += [struct.pack("<I", len(closed)), *[struct.pack("<2d", *p) for p in closed]]
    return head + b"".join(parts)


def _shapes(layer: DataFrame, polygons: bool) -> Iterator[tuple[list, object]]:
    fields = [c for c in layer.columns if c not in ({"rings"} if polygons else {"x", "y"})]
    for r in layer.toLocalIterator():
        if polygons:
            shape = None if r["rings"] is None else [[(p["x"], p["y"]) for p in ring] for ring in r["rings"]]
        else:
            shape = None if r["x"] is None or r["y"] is None else (r["x"], r["y"])
        yield [r[c] for c in fields], shape


def write(layer: DataFrame, path: str, name: str, crs: str = "") -> int:
    """Write a layer with ``x``, ``y`` or ``rings`` to a file, made if it is missing; the number of rows.

    A layer of the same name is replaced and others stay, all in one transaction. ``fid`` is the key
    if it is there, else rows are numbered from 1.
    """
    polygons, code = "rings" in layer.columns, int(crs.split(":")[1]) if crs.startswith("EPSG:") else 0
    fields = [(n, t) for n, t in layer.dtypes if n not in ({"rings"} if polygons else {"x", "y"})]
    quote = lambda n: '"' + n.replace('"', '""') + '"'
    sql_type = lambda t: "INTEGER" if t in ("int", "bigint", "smallint", "tinyint", "boolean") else "REAL" if t in ("double", "float") or t.startswith("decimal") else "TEXT"
    columns = ["fid INTEGER PRIMARY KEY" + " AUTOINCREMENT" * all(n != "fid" for n, _ in fields), f"geom {'POLYGON' if polygons else 'POINT'}", *[f"{quote(n)} {sql_type(t)}" for n, t in fields if n != "fid"]]
    with sqlite3.connect(path) as db:
        db.executescript(
            # Fixed values of the format: the file's marks and its own tables.
            """pragma application_id = 1196444487; pragma user_version = 10300;
            create table if not exists gpkg_spatial_ref_sys (srs_name text not null, srs_id integer primary key, organization text not null, organization_coordsys_id integer not null, definition text not null, description text);
            create table if not exists gpkg_contents (table_name text not null primary key, data_type text not null, identifier text unique, description text default '', last_change datetime not null default (strftime('%Y-%m-%dT%H:%M:%fZ','now')), min_x double, min_y double, max_x double, max_y double, srs_id integer);
            create table if not exists gpkg_geometry_columns (table_name text not null, column_name text not null, geometry_type_name text not null, srs_id integer not null, z tinyint not null, m tinyint not null, primary key (table_name, column_name));"""
        )
        known = [("undefined cartesian", -1, "NONE", -1, "undefined"), ("undefined geographic", 0, "NONE", 0, "undefined")] + [(crs, code, "EPSG", code, crs)] * bool(code)
        db.executemany("insert or ignore into gpkg_spatial_ref_sys values (?, ?, ?, ?, ?, null)", known)
        db.execute(f"drop table if exists {quote(name)}")
        for table in ("gpkg_contents", "gpkg_geometry_columns"):
            db.execute(f"delete from {table} where table_name = ?", (name,))
        db.execute(f"create table {quote(name)} ({', '.join(columns)})")
        db.execute("insert into gpkg_contents (table_name, data_type, identifier, srs_id) values (?, 'features', ?, ?)", (name, name, code))
        db.execute("insert into gpkg_geometry_columns values (?, 'geom', ?, ?, 0, 0)", (name, "POLYGON" if polygons else "POINT", code))
        order = [n for n, _ in fields]
        marks = f"insert into {quote(name)} ({', '.join(['geom', *map(quote, order)])}) values ({', '.join('?' * (1 + len(order)))})"
        n = 0
        for values, shape in _shapes(layer, polygons):
            db.execute(marks, [blob(shape, code), *values])
            n += 1
        return n
