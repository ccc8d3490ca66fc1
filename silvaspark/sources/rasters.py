"""Rasters as Parquet with their header beside them, and the way in from GeoTIFF or Parquet."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession

from ..operators.grid import RasterMeta
from . import geotiff, layers

HEADER = "x0 double, px_w double, y0 double, px_h double, n_cols int, n_rows int, crs string, nodata double"


def write(raster: DataFrame, path: str, meta: RasterMeta, nodata: float, kind: str = "float", columns: tuple[str, ...] = ("value",)) -> None:
    """A raster's columns with nodata as a number of ``kind``, in ranges of rows, and its header."""
    layers.raster_table(raster, path, nodata, kind, columns)
    header = asdict(meta) | {"nodata": float(nodata)}
    raster.sparkSession.createDataFrame([tuple(header[c.split()[0]] for c in HEADER.split(", "))], HEADER).coalesce(1).write.mode("overwrite").parquet(f"{path}.header")


def read(spark: SparkSession, path: str) -> tuple[DataFrame, RasterMeta]:
    """A raster with nodata as NULL, and its header: a Parquet table with one, or GeoTIFF files on one grid."""
    from pyspark.sql import functions as F

    if path.lower().endswith((".tif", ".tiff")):
        geotiff.register(spark)
        return spark.read.format("geotiff").load(path).drop("file"), geotiff.read_meta(spark, path)
    meta = RasterMeta(**spark.read.parquet(f"{path}.header").first().asDict())
    raster = spark.read.parquet(path)
    values = [c for c in raster.columns if c not in ("row", "col")]
    return raster.withColumns({c: F.nullif(F.col(c).cast("double"), F.lit(meta.nodata)) for c in values}), meta


def placed_tiles(spark: SparkSession, folder: str) -> tuple[DataFrame, RasterMeta]:
    """The GeoTIFF tiles of a folder on one grid: ``tile, row, col, value`` and the header over all of them.

    Tiles are numbered in the order of their names. They must share pixel size and system and be apart by whole pixels.
    """
    from pyspark.sql import functions as F

    from .files import find_files

    geotiff.register(spark)
    paths = [p for p in find_files(spark, f"{folder}/*") if p.lower().endswith((".tif", ".tiff"))]
    if not paths:
        raise FileNotFoundError(f"no GeoTIFF tile in {folder}")
    metas = [geotiff.read_meta(spark, p) for p in paths]
    one = metas[0]
    if any((m.px_w, m.px_h, m.crs) != (one.px_w, one.px_h, one.crs) for m in metas):
        raise ValueError(f"the tiles in {folder} differ in pixel size or reference system")
    left, top = min(m.x0 for m in metas), max(m.y0 for m in metas)
    at = [(round((top - m.y0) / -one.px_h), round((m.x0 - left) / one.px_w)) for m in metas]
    meta = RasterMeta(left, one.px_w, top, one.px_h, max(c + m.n_cols for (_, c), m in zip(at, metas, strict=True)), max(r + m.n_rows for (r, _), m in zip(at, metas, strict=True)), one.crs, one.nodata)
    # one row for a tile
    moves = spark.createDataFrame([(p.rsplit("/", 1)[-1], k, r, c) for k, (p, (r, c)) in enumerate(zip(paths, at, strict=True))], "file string, tile int, r int, c int")
    cells = spark.read.format("geotiff").load(folder).withColumn("file", F.substring_index("file", "/", -1))
    band = next(c for c in cells.columns if c not in ("file", "row", "col"))
    cells = cells.select("file", "row", "col", F.col(band).alias("value")).join(F.broadcast(moves), "file")
    return cells.select("tile", (F.col("row") + F.col("r")).alias("row"), (F.col("col") + F.col("c")).alias("col"), "value"), meta
