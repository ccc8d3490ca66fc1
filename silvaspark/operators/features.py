"""Structural and spectral metrics of crowns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import CROWN_FIELDS
from .graph import written
from .spatial import box_cells, distinct_shapes, points_in_boxes, points_in_polygons


def rugosity(z: str = "z") -> Column:
    """Population deviation over range plus 0.001; 0 under three points."""
    return F.when(F.count(z) >= 3, F.stddev_pop(z) / (F.max(z) - F.min(z) + 0.001)).otherwise(0.0)


def vertical(points: DataFrame, key: str = "fid", limits: DataFrame | None = None) -> DataFrame:
    """Shares of points in the top quarter, the middle and the bottom quarter of a group's range.

    (0, 1, 0) under three points or for a range under 0.1. ``limits`` (key, _low, _range, _n) may be
    known already; groups without limits are left out. They are joined back, so a group of any
    size is spread over tasks.
    """
    if limits is None:
        limits = points.groupBy(key).agg(F.min("z").alias("_low"), (F.max("z") - F.min("z")).alias("_range"), F.count("*").alias("_n"))
    of = points.join(limits, key)
    top, bottom = F.col("z") >= F.col("_low") + 0.75 * F.col("_range"), F.col("z") <= F.col("_low") + 0.25 * F.col("_range")
    shares = of.groupBy(key).agg(F.first("_n").alias("_n"), F.first("_range").alias("_range"), F.avg(top.cast("double")).alias("_t"), F.avg(bottom.cast("double")).alias("_b"))
    flat = (F.col("_n") < 3) | (F.col("_range") < 0.1)
    pick = lambda a, b: F.when(flat, F.lit(a)).otherwise(b)
    return shares.select(key, pick(0.0, F.col("_t")).alias("vert_dist_top25"), pick(1.0, 1 - F.col("_t") - F.col("_b")).alias("vert_dist_mid50"), pick(0.0, F.col("_b")).alias("vert_dist_bot25"))


def edge_flag(crowns: DataFrame, extent: tuple[float, float, float, float], buffer: float = 1.0) -> DataFrame:
    """``is_edge``: 1 where a crown's box comes within ``buffer`` of the raster's border."""
    xmin, xmax, ymin, ymax = extent
    near = (F.col("xmin") <= xmin + buffer) | (F.col("xmax") >= xmax - buffer) | (F.col("ymin") <= ymin + buffer) | (F.col("ymax") >= ymax - buffer)
    return crowns.withColumn("is_edge", near.cast("int"))


def candidates(crowns: DataFrame, points: DataFrame, size: float = 50.0, layers: dict[str, Column] | None = None) -> DataFrame:
    """``fid`` of crowns whose box meets a cell of ``size`` that holds a point; cells start at the points' least x and y.

    ``layers`` are conditions, each of which makes a grid of its own from the points that meet it;
    a crown counts if any grid has a cell. A grid is one scan and one aggregate. Without points there are none.
    """
    layers = layers or {"all": F.lit(True)}
    least = [F.min(F.when(on, F.col(axis))).alias(f"{axis}{k}") for k, on in enumerate(layers.values()) for axis in "xy"]
    origins = points.agg(*least)
    boxes = crowns.select("fid", "xmin", "xmax", "ymin", "ymax")
    found = None
    for k, on in enumerate(layers.values()):
        x0, y0 = origins.select(f"x{k}").scalar(), origins.select(f"y{k}").scalar()
        held = points.filter(on).select(F.floor((F.col("x") - x0) / size).alias("_cx"), F.floor((F.col("y") - y0) / size).alias("_cy")).distinct()
        part = box_cells(boxes.filter(x0.isNotNull()), size, x0, y0).join(held, ["_cx", "_cy"]).select("fid")
        found = part if found is None else found.union(part)
    return found.distinct()


def crown_metrics(crowns: DataFrame, points: DataFrame, extent: tuple[float, float, float, float], edge_buffer: float = 1.0, size: float = 5.0, fields: tuple[str, ...] = CROWN_FIELDS) -> DataFrame:
    """Crown ``fields``, by default all: ``crowns`` are boxes ``fid, xmin..ymax, area``, or polygons if they have ``rings`` too; ``points`` are all points with ``height, intensity, ndvi``.

    ``height`` is above the ground, and NULL for points that are no vegetation or over no ground.
    Points are written once. They are joined to the different boxes or polygons, not to crowns, which
    take the metrics of their shape: all points for the first aggregate, those of vegetation again, with
    its limits, for the shares of the quarters, if any of these is among the fields. Counts are of points strictly
    inside. Under three points of vegetation only the edge flag, counts and their ratio are given;
    without a point in a cell near its box a crown has NULLs only. ``size`` is the side of the
    join's cells, best near a crown's width. Empty tables of points give NULLs, of crowns no rows.
    """
    cloud = written(points.select("x", "y", F.col("height").alias("z"), "intensity", "ndvi"), "cloud")
    sides = ("xmin", "xmax", "ymin", "ymax")
    shapes, shape_of = distinct_shapes(crowns, (*sides, "rings") if "rings" in crowns.columns else sides)

    def within(some: DataFrame) -> DataFrame:
        if "rings" in crowns.columns:
            return points_in_polygons(some, shapes.select("_shape", "rings"), size)
        return points_in_boxes(some, shapes, size).drop(*sides)

    of = lambda c: F.when(F.col("z").isNotNull(), F.col(c))
    main = within(cloud).groupBy("_shape").agg(
        F.count("*").alias("n_points_all"), F.count("z").alias("n_points"), F.avg("z").alias("mean_height"), F.min("z").alias("_low"), F.max("z").alias("max_height"),
        F.avg(of("intensity")).alias("mean_intensity"), F.avg(of("ndvi")).alias("mean_ndvi"), rugosity().alias("rugosity"),
    )
    main = written(main, "metrics")
    metrics = main
    if any(f.startswith("vert_dist") for f in fields):
        limits = main.filter("n_points >= 3").select("_shape", "_low", (F.col("max_height") - F.col("_low")).alias("_range"), F.col("n_points").alias("_n"))
        shares = vertical(within(cloud.filter("z is not null").select("x", "y", "z")).select("_shape", "z"), "_shape", limits)
        metrics = main.join(shares, "_shape", "left")
    known = candidates(shapes.withColumnRenamed("_shape", "fid"), cloud, layers={"vegetation": F.col("z").isNotNull(), "all": F.lit(True)}).select(F.col("fid").alias("_shape"), F.lit(True).alias("_known"))
    found = written(known.join(metrics, "_shape", "left"), "shape-metrics")
    out = edge_flag(crowns, extent, edge_buffer).join(shape_of.join(found, "_shape"), "fid", "left")
    n, n_all = F.coalesce("n_points", F.lit(0)), F.coalesce("n_points_all", F.lit(0))
    width = F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"))
    enough = lambda c: F.when((n >= 3) & F.col("_known"), c)
    seen = lambda c: F.when(F.col("_known"), c)
    made = {
        "mean_height": enough(F.col("mean_height")),
        "max_height": enough(F.col("max_height")),
        "crown_area_m2": enough(F.col("area")),
        "crown_width_m": enough(width),
        "height_width_ratio": enough(F.when(width > 0, F.col("max_height") / width).otherwise(0.0)),
        "mean_intensity": enough(F.col("mean_intensity")),
        "mean_ndvi": enough(F.col("mean_ndvi")),
        "point_density": enough(F.when(F.col("area") > 0, n / F.col("area")).otherwise(0.0)),
        "n_points": seen(n).cast("int"),
        "n_points_all": seen(n_all).cast("int"),
        "is_edge": seen(F.col("is_edge")),
        "pct_high_veg": seen(F.when(n_all > 0, 100.0 * n / n_all).otherwise(0.0)),
    }
    return out.select("fid", *[(made[c] if c in made else enough(F.col(c))).alias(c) for c in fields])
