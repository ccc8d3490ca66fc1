"""Point clouds: heights above ground, filters, masks and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import written
from .grid import RasterMeta, dilate, with_cell


def of_class(points: DataFrame, *classes: int) -> DataFrame:
    """Points of the classes; a NULL class is none of them."""
    return points.filter(F.col("classification").isin(*classes))


def normalise_heights(points: DataFrame, terrain: DataFrame, meta: RasterMeta, drop: bool = True) -> DataFrame:
    """``z`` above the terrain cell under each point. ``drop``: without points over no ground; else ``good`` tells.

    Points that repeat stay; a NULL place has no ground. Columns of points keep their values.
    """
    ground = terrain.filter("value is not null").select(F.col("row").alias("_row"), F.col("col").alias("_col"), F.col("value").alias("_ground"))
    joined = with_cell(points, meta, clip=drop, names=("_row", "_col")).join(ground, ["_row", "_col"], "inner" if drop else "left")
    if not drop:
        joined = joined.withColumn("good", F.col("_ground").isNotNull())
    return joined.withColumn("z", F.col("z") - F.col("_ground")).drop("_ground", "_row", "_col")


def terrain_under(points: DataFrame, terrain: DataFrame, meta: RasterMeta) -> DataFrame:
    """The terrain cells within the rows and columns that points span, written; none without points.

    One aggregate of the points. What is left may be small enough to be broadcast, so that the points stay where they are.
    """
    row, col = F.col("_row"), F.col("_col")
    span = with_cell(points, meta, clip=False, names=("_row", "_col")).agg(F.min(row), F.max(row), F.min(col), F.max(col)).first()
    if None in span:
        return terrain.filter("false")
    return written(terrain.filter(F.col("row").between(span[0], span[1]) & F.col("col").between(span[2], span[3])), "terrain")


def vegetation_heights(points: DataFrame, terrain: DataFrame, meta: RasterMeta, classes: tuple[int, ...] = (5,), under: bool = True) -> DataFrame:
    """All points with ``height`` above the ground, NULL for other classes and over no ground.

    Only points of the classes meet the terrain, with ``under`` only the terrain that these span; the others, a
    NULL class among them, are not shuffled. ``under`` may change the order of the points, and so the last bit of their sums.
    """
    chosen = F.coalesce(F.col("classification").isin(*classes), F.lit(False))
    ground = terrain_under(points.filter(chosen), terrain, meta) if under else terrain
    placed = normalise_heights(points.filter(chosen).withColumn("_z", F.col("z")), ground, meta, drop=False)
    above = placed.withColumn("height", F.when(F.col("good"), F.col("z"))).withColumn("z", F.col("_z")).drop("_z", "good")
    others = points.filter(~chosen).withColumn("height", F.lit(None).cast(above.schema["height"].dataType))
    return above.unionByName(others)


def exact_percentile(points: DataFrame, share: float, column: str = "z", most: int = 100_000) -> float | None:
    """A percentile of all values with linear interpolation; NULL and no values give None.

    Approximate percentiles bracket the place, what lies below the bracket is counted, and the
    bracket is narrowed until it holds at most ``most`` different values; these are counted one by
    one. So no buffer grows with the table, and the result is exact.
    """
    values = points.select(F.col(column).alias("v")).filter("v is not null and not isnan(v)")
    n = values.count()
    if not n:
        return None
    place = share * (n - 1)
    first, last, below = int(place), min(int(place) + 1, n - 1), 0  # ranks to find, and values under the bracket
    low, high = None, None
    inside = values
    while True:
        counted = inside.groupBy("v").agg(F.count("*").alias("k"))
        if inside is not values or n > most:
            inner = inside.count() if inside is not values else n
            if inner > most and counted.count() > most:
                margin = 2.0 / 10_000
                at = [max(0.0, (first - below) / inner - margin), min(1.0, (last - below) / inner + margin)]
                low, high = inside.agg(F.percentile_approx("v", at, 10_000)).first()[0]
                below += inside.filter(F.col("v") < low).count()
                inside = inside.filter(F.col("v").between(low, high))
                continue
        ends, total = [], below
        for row in counted.orderBy("v").toLocalIterator():
            total += row["k"]
            while len(ends) < 2 and total > (first, last)[len(ends)]:
                ends.append(row["v"])
            if len(ends) == 2:
                break
        return ends[0] + (ends[1] - ends[0]) * (place - first)


def percentiles(table: DataFrame, column: str, shares: tuple[float, ...] = (0.25, 0.5, 0.75)) -> dict[float, float | None]:
    """Exact percentiles of a column, each as ``exact_percentile`` gives it."""
    return {share: exact_percentile(table, share, column) for share in shares}


def without_outliers(points: DataFrame, upper_percentile: float = 99.9) -> DataFrame:
    """Points up to a percentile of z over all points, exact with linear interpolation. Give it a written table: it is read more than once."""
    limit = exact_percentile(points, upper_percentile / 100)
    return points.filter(F.col("z") <= F.lit(limit).cast("double"))


def at_least(points: DataFrame, minheight: float = 2.0) -> DataFrame:
    """Points of ``minheight`` or more; those of a NULL height go."""
    return points.filter(F.col("z") >= minheight)


def colours(points: DataFrame) -> DataFrame:
    """Colours of 16 bits scaled to 0..1 if any red is over 255, and ``ndvi``, 0 where near infrared and red are not positive."""
    wide = points.agg(F.max("red")).scalar() > 255
    scaled = points
    for band in ("red", "nir"):
        scaled = scaled.withColumn(band, F.when(wide, F.col(band) / 65535.0).otherwise(F.col(band)))
    both = F.col("nir") + F.col("red")
    return scaled.withColumn("ndvi", F.when(both > 0, (F.col("nir") - F.col("red")) / both).otherwise(0.0))


def vegetation_mask(points: DataFrame, meta: RasterMeta, classes: tuple[int, ...] = (4, 5), dilations: int = 2, minheight: float | None = None) -> DataFrame:
    """Cells with a point of the classes, dilated; heights are not tested unless ``minheight`` is given."""
    chosen = of_class(points, *classes)
    if minheight is not None:
        chosen = at_least(chosen, minheight)
    cells = with_cell(chosen, meta).select("row", "col").distinct()
    return dilate(cells, meta, dilations) if dilations else cells


def counts(points: DataFrame, meta: RasterMeta, classes: tuple[int, ...] = (4, 5)) -> DataFrame:
    """Points in all, of the classes, and of these within the raster, by tile and over all (tile NULL)."""
    placed = with_cell(points, meta, clip=False)
    chosen = F.col("classification").isin(*classes)
    within = F.col("row").between(0, meta.n_rows - 1) & F.col("col").between(0, meta.n_cols - 1)
    found = placed.rollup("tile").agg(F.count("*").alias("n_points"), F.count_if(chosen).alias("n_class"), F.count_if(chosen & within).alias("n_inside"))
    return found.withColumn("pct_class", F.round(100.0 * F.col("n_class") / F.col("n_points"), 8))
