"""Joins of points and polygons by cells: an equality on cells, then the exact test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import bounds, contains, edges
from .graph import written
from .grid import RasterMeta, unused


def box_cells(boxes: DataFrame, size: float, x0: Column | float = 0.0, y0: Column | float = 0.0, names: tuple[str, str] = ("_cx", "_cy")) -> DataFrame:
    """A row for each cell of ``size`` that a box ``xmin..ymax`` overlaps, in the columns ``names``; none for a box with a NULL side."""
    at = lambda name, origin: F.floor((F.col(name) - origin) / size)
    across = F.explode(F.sequence(at("xmin", x0), at("xmax", x0)))
    whole = boxes.dropna(subset=["xmin", "xmax", "ymin", "ymax"])
    return whole.withColumn(names[0], across).withColumn(names[1], F.explode(F.sequence(at("ymin", y0), at("ymax", y0))))


def distinct_shapes(polygons: DataFrame, columns: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """The different shapes ``_shape, *columns`` of polygons, and ``fid, _shape`` of each; what repeats a shape need not meet the points again.

    Shapes are equal if all ``columns`` are, whatever the size of a group. Polygons that share a ``fid`` are one
    shape of several rows; those with a NULL in ``columns`` meet no points and have none.
    """
    parts = F.sort_array(F.collect_list(F.struct(*columns))).alias("_parts")
    of = written(polygons.dropna(subset=list(columns)).groupBy("fid").agg(parts), "parts")
    shapes = written(of.select("_parts").distinct().withColumn("_shape", F.monotonically_increasing_id()), "shapes")
    return shapes.select("_shape", F.explode("_parts").alias("_p")).select("_shape", "_p.*"), of.join(shapes, "_parts").select("fid", "_shape")


def points_in_boxes(points: DataFrame, boxes: DataFrame, size: float = 50.0) -> DataFrame:
    """Points strictly inside axis-parallel boxes; a point in several boxes gives as many rows.

    Points of a NULL place and boxes with a NULL side meet nothing; columns of points keep their values.
    """
    cx, cy = unused(("_cx", "_cy"), points, boxes)
    placed = points.withColumns({cx: F.floor(F.col("x") / size), cy: F.floor(F.col("y") / size)})
    inside = (F.col("x") > F.col("xmin")) & (F.col("x") < F.col("xmax")) & (F.col("y") > F.col("ymin")) & (F.col("y") < F.col("ymax"))
    return placed.join(box_cells(boxes, size, names=(cx, cy)), [cx, cy]).filter(inside).drop(cx, cy)


def points_in_polygons(points: DataFrame, polygons: DataFrame, size: float = 50.0) -> DataFrame:
    """Points strictly inside polygons ``fid, rings``; what is on an edge is outside. NULL rings and places meet nothing."""
    cx, cy = unused(("_cx", "_cy"), points, polygons)
    boxed = polygons.filter("rings is not null").withColumn("_b", bounds(F.col("rings"))).select("*", "_b.*").drop("_b")
    placed = points.withColumns({cx: F.floor(F.col("x") / size), cy: F.floor(F.col("y") / size)})
    # the box first, as it is cheap to test
    near = (F.col("x") > F.col("xmin")) & (F.col("x") < F.col("xmax")) & (F.col("y") > F.col("ymin")) & (F.col("y") < F.col("ymax"))
    joined = placed.join(box_cells(boxed, size, names=(cx, cy)), [cx, cy]).filter(near)
    return joined.filter(contains(F.col("rings"), F.col("x"), F.col("y"))).drop(cx, cy, "xmin", "xmax", "ymin", "ymax", "rings")


def points_in_crowns(points: DataFrame, cells: DataFrame, x0: float, y0: float, pixel: float) -> DataFrame:
    """Points inside crowns made of cells: an equality join; points on a grid line belong to the cell after it."""
    placed = points.withColumn("row", F.floor((F.lit(y0) - F.col("y")) / pixel).cast("int")).withColumn("col", F.floor((F.col("x") - F.lit(x0)) / pixel).cast("int"))
    return placed.join(cells.select("fid", "row", "col"), ["row", "col"])


def box_centres(boxes: DataFrame, pixel: float = 1.0) -> DataFrame:
    """Boxes as cells whose centres they hold: ``row``, ``col``, rows counted upwards from 0."""
    first = lambda low: F.ceil(F.col(low) / pixel - 0.5)
    last = lambda high: F.ceil(F.col(high) / pixel - 0.5) - 1
    some = boxes.filter((first("xmin") <= last("xmax")) & (first("ymin") <= last("ymax")))
    wide = some.withColumn("col", F.explode(F.sequence(first("xmin"), last("xmax"))))
    return wide.withColumn("row", F.explode(F.sequence(first("ymin"), last("ymax")))).withColumn("row", F.col("row").cast("int")).withColumn("col", F.col("col").cast("int"))


def polygon_cells(polygons: DataFrame, meta: RasterMeta) -> DataFrame:
    """Cells ``fid, row, col`` of a raster whose centres lie in polygons ``fid, rings`` of any shape, holes left out.

    Each edge is cut by the centre lines of the rows that it crosses; along a row the crossings,
    in order, begin and end stretches of cells by turns. A centre on an edge belongs to the stretch
    that begins there. ``fid`` is a key; polygons without rings or off the raster have no cells.
    """
    sides = polygons.filter("rings is not null").select("fid", F.explode(F.flatten(F.transform("rings", edges))).alias("e"))
    across, down = lambda x: (x - F.lit(meta.x0)) / F.lit(meta.px_w), lambda y: (y - F.lit(meta.y0)) / F.lit(meta.px_h)
    sides = sides.select("fid", across(F.col("e.x0")).alias("u0"), down(F.col("e.y0")).alias("v0"), across(F.col("e.x1")).alias("u1"), down(F.col("e.y1")).alias("v1"))
    first = F.greatest(F.lit(0), F.ceil(F.least("v0", "v1") - 0.5))
    last = F.least(F.lit(meta.n_rows), F.ceil(F.greatest("v0", "v1") - 0.5)) - 1
    cuts = sides.filter(first <= last).withColumn("row", F.explode(F.sequence(first, last)))
    cuts = cuts.withColumn("u", F.col("u0") + (F.col("row") + 0.5 - F.col("v0")) * (F.col("u1") - F.col("u0")) / (F.col("v1") - F.col("v0")))
    rows = cuts.groupBy("fid", "row").agg(F.sort_array(F.collect_list("u")).alias("us"))
    turns = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.floor(F.size("us") / 2).cast("int") - 1)))
    low = F.greatest(F.lit(0), F.ceil(F.col("us")[F.col("k") * 2] - 0.5))
    high = F.least(F.lit(meta.n_cols), F.ceil(F.col("us")[F.col("k") * 2 + 1] - 0.5)) - 1
    return turns.filter(low <= high).select("fid", F.col("row").cast("int").alias("row"), F.explode(F.sequence(low.cast("int"), high.cast("int"))).alias("col"))
