"""Treetops: local maxima in a radius that grows with height, and suppression by distance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import written
from .grid import unused


def local_maxima(points: DataFrame, radius_a: float = 0.5, radius_b: float = 0.05) -> DataFrame:
    """Points without a higher point within a + b·z of their own height (distance and radius may be equal).

    Places are cut into cells of the greatest radius, so what may outdo a point lies in its own or
    the eight cells around: an equality join on cells, with the distance as its condition. Points
    of one place are one rival there, the highest. Equal heights do not outdo each other. An empty
    table stays empty; columns of points keep their values.
    """
    cx, cy, r2 = unused(("_cx", "_cy", "_r2"), points)
    size = points.agg(F.greatest(F.lit(radius_a) + F.lit(radius_b) * F.max("z"), F.lit(1e-6))).scalar()
    placed = points.withColumns({cx: F.floor(F.col("x") / size), cy: F.floor(F.col("y") / size), r2: F.pow(F.lit(radius_a) + F.lit(radius_b) * F.col("z"), F.lit(2))})
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    rivals = placed.select(F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("z").alias("_z"), cx, cy, around.alias("_a")).select("_x", "_y", "_z", (F.col(cx) + F.col("_a.i")).alias("_cx"), (F.col(cy) + F.col("_a.j")).alias("_cy"))
    rivals = rivals.groupBy("_cx", "_cy", "_x", "_y").agg(F.max("_z").alias("_z"))
    far = (F.col("p.x") - F.col("q._x")) * (F.col("p.x") - F.col("q._x")) + (F.col("p.y") - F.col("q._y")) * (F.col("p.y") - F.col("q._y"))
    near = (F.col("q._z") > F.col("p.z")) & (far <= F.col(f"p.{r2}"))
    left = placed.alias("p").join(rivals.alias("q"), (F.col(f"p.{cx}") == F.col("q._cx")) & (F.col(f"p.{cy}") == F.col("q._cy")) & near, "left_anti")
    return left.drop(cx, cy, r2)


def suppress(points: DataFrame, mindist: float, order: tuple[str, ...]) -> DataFrame:
    """The points that stay when, from the highest down, each kept point removes lower ones nearer than ``mindist``.

    ``order`` is a unique key that ranks points of one height. In a round the undecided points
    without a higher undecided neighbour are kept, and their neighbours go; this ends with the
    result of the sequential rule. Links between neighbours are made once, by cells of ``mindist``.
    Without a distance, and for an empty table, all points stay.
    """
    if mindist <= 0:
        return points
    key = F.struct(F.negative("z").alias("h"), *order)
    placed = written(points.withColumn("_k", key).withColumn("_cx", F.floor(F.col("x") / mindist)).withColumn("_cy", F.floor(F.col("y") / mindist)), "suppress")
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    other = placed.select(F.col("_k").alias("_o"), F.col("x").alias("_x"), F.col("y").alias("_y"), "_cx", "_cy", around.alias("_a")).select("_o", "_x", "_y", (F.col("_cx") + F.col("_a.i")).alias("_cx"), (F.col("_cy") + F.col("_a.j")).alias("_cy"))
    near = (F.col("x") - F.col("_x")) * (F.col("x") - F.col("_x")) + (F.col("y") - F.col("_y")) * (F.col("y") - F.col("_y")) < mindist * mindist
    links = written(placed.join(other, ["_cx", "_cy"]).filter(near & (F.col("_o") < F.col("_k"))).select("_k", "_o"), "suppress-links")
    gone = None
    while not links.isEmpty():
        # higher points that nothing undecided outdoes are kept; what is near them goes
        kept = links.select(F.col("_o").alias("_k")).distinct().join(links.select("_k"), "_k", "left_anti")
        out = written(links.join(kept.withColumnRenamed("_k", "_o"), "_o", "left_semi").select("_k").distinct(), "suppress-out")
        gone = out if gone is None else gone.union(out)
        links = written(links.join(out, "_k", "left_anti").join(out.withColumnRenamed("_k", "_o"), "_o", "left_anti").select("_k", "_o"), "suppress-links")
    rest = placed if gone is None else placed.join(gone, "_k", "left_anti")
    return rest.drop("_k", "_cx", "_cy")


def numbered(points: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """The treetop layer: ids from 1 in the order of columns ``by`` (with `` desc`` where it falls), heights to the millimetre.

    Ids come from counts of ranges of the order, so no single task sorts all rows.
    """
    order = [F.desc(b.removesuffix(" desc")) if b.endswith(" desc") else F.asc(b) for b in by]
    ranged = points.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(ranged.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()), "numbered")
    before = placed.groupBy("_p").agg(F.count("*").alias("_n")).withColumn("_base", F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).select("_p", "_base")
    numbered = placed.join(F.broadcast(before), "_p").withColumn("tree_id", (F.col("_base") + F.row_number().over(Window.partitionBy("_p").orderBy("_i"))).cast("int"))
    return numbered.select("tree_id", F.round("z", 3).alias("height_m"), F.lit(0).alias("crown_px"), "x", "y")
