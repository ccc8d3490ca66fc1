"""Grids: cells of points, neighbours of cells, and headers of rasters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOUR = ((-1, 0), (1, 0), (0, -1), (0, 1))
EIGHT = tuple((r, c) for r in (-1, 0, 1) for c in (-1, 0, 1) if r or c)


@dataclass(frozen=True)
class RasterMeta:
    """Origin, pixel size (the height is negative for rows that run south), extent and nodata of a raster."""

    x0: float
    px_w: float
    y0: float
    px_h: float
    n_cols: int
    n_rows: int
    crs: str = ""
    nodata: float | None = None

    @property
    def extent(self) -> tuple[float, float, float, float]:
        """xmin, xmax, ymin, ymax."""
        xs, ys = sorted((self.x0, self.x0 + self.n_cols * self.px_w)), sorted((self.y0, self.y0 + self.n_rows * self.px_h))
        return xs[0], xs[1], ys[0], ys[1]

    def buffer(self, metres: float = 500.0) -> tuple[float, float, float, float]:
        xmin, xmax, ymin, ymax = self.extent
        return xmin - metres, xmax + metres, ymin - metres, ymax + metres

    def same_grid(self, other: RasterMeta) -> None:
        if (self.n_cols, self.n_rows) != (other.n_cols, other.n_rows):
            raise ValueError(f"rasters differ in size: {self.n_cols} x {self.n_rows} and {other.n_cols} x {other.n_rows}")


def unused(names: tuple[str, ...], *tables: DataFrame) -> list[str]:
    """Names like ``names`` that no column of the tables has, in any case of letters."""
    taken, found = {c.lower() for t in tables for c in t.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        found.append(name)
    return found


def cell(x: Column, y: Column, meta: RasterMeta) -> tuple[Column, Column]:
    """Row and column of a place. Offsets are cut towards zero, so a place less than a pixel outside is in cell 0."""
    return ((y - F.lit(meta.y0)) / F.lit(meta.px_h)).cast("long"), ((x - F.lit(meta.x0)) / F.lit(meta.px_w)).cast("long")


def with_cell(points: DataFrame, meta: RasterMeta, x: str = "x", y: str = "y", clip: bool = True, names: tuple[str, str] = ("row", "col")) -> DataFrame:
    """Points with ``row`` and ``col``, or other ``names``; ``clip`` drops points outside the raster and of a NULL place."""
    row, col = cell(F.col(x), F.col(y), meta)
    out = points.withColumns({names[0]: row.cast("int"), names[1]: col.cast("int")})
    if clip:
        out = out.filter(F.col(names[0]).between(0, meta.n_rows - 1) & F.col(names[1]).between(0, meta.n_cols - 1))
    return out


def neighbours(cells: DataFrame, offsets=FOUR, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each cell and offset: the neighbour's ``row`` and ``col`` and the columns ``keep``."""
    steps = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in offsets]))
    moved = cells.select("row", "col", *keep, steps.alias("_s"))
    return moved.select((F.col("row") + F.col("_s.r")).alias("row"), (F.col("col") + F.col("_s.c")).alias("col"), *keep)


def dilate(cells: DataFrame, meta: RasterMeta, iterations: int = 2) -> DataFrame:
    """Binary dilation with a cross, repeated: all cells within that many steps, clipped to the raster."""
    reach = range(-iterations, iterations + 1)
    offsets = [(r, c) for r in reach for c in reach if abs(r) + abs(c) <= iterations]
    grown = neighbours(cells.select("row", "col"), offsets)
    return grown.filter(F.col("row").between(0, meta.n_rows - 1) & F.col("col").between(0, meta.n_cols - 1)).distinct()


def dense(spark, meta: RasterMeta) -> DataFrame:
    """Every cell of a raster: ``row``, ``col``."""
    cells = spark.range(meta.n_rows * meta.n_cols)
    return cells.select(F.floor(F.col("id") / meta.n_cols).cast("int").alias("row"), (F.col("id") % meta.n_cols).cast("int").alias("col"))
