"""Which crowns count, and correlations of their features."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import written


def reasons(crowns: DataFrame, features: list[str], min_points: int = 30) -> DataFrame:
    """``reason`` a crown is not used, the first that holds of edge, low_points, null; else used."""
    missing = F.lit(False)
    for f in features:
        missing = missing | F.col(f).isNull()
    reason = F.when(F.col("is_edge") == 1, "edge").when(F.col("n_points").isNull() | (F.col("n_points") < min_points), "low_points").when(missing, "null").otherwise("used")
    return crowns.withColumn("reason", reason)


def used(crowns: DataFrame, features: list[str], min_points: int = 30) -> DataFrame:
    """The features of crowns that are used, without NULLs."""
    return reasons(crowns, features, min_points).filter("reason = 'used'").select(*features)


def ranks(frame: DataFrame, features: list[str]) -> DataFrame:
    """Average ranks of each feature, over rows without NULLs.

    Counts of different values of all features go through one range partitioning; a rank is the
    number of rows in the ranges before, one number for a feature and range, and those before it in
    its range. No task sorts a whole feature.
    """
    rows = written(frame.select(*features).withColumn("_id", F.monotonically_increasing_id()), "features")
    long = rows.select("_id", F.explode(F.array(*[F.struct(F.lit(k).alias("_f"), F.col(f).cast("double").alias("_v")) for k, f in enumerate(features)])).alias("_c")).select("_id", "_c.*")
    counts = long.groupBy("_f", "_v").agg(F.count("*").alias("_n")).repartitionByRange("_f", "_v").withColumn("_p", F.spark_partition_id())
    counts = written(counts, "rank-counts")
    sums = counts.groupBy("_f", "_p").agg(F.sum("_n").alias("_s"))
    # one row for a feature and range
    before = sums.withColumn("_base", F.sum("_s").over(Window.partitionBy("_f").orderBy("_p")) - F.col("_s")).select("_f", "_p", "_base")
    within = F.sum("_n").over(Window.partitionBy("_f", "_p").orderBy("_v"))
    ranked = counts.withColumn("_within", within).join(F.broadcast(before), ["_f", "_p"]).select("_f", "_v", (F.col("_base") + F.col("_within") - (F.col("_n") - 1) / 2).alias("_r"))
    wide = long.join(ranked, ["_f", "_v"]).groupBy("_id").agg(*[F.max(F.when(F.col("_f") == k, F.col("_r"))).alias(f) for k, f in enumerate(features)])
    return wide.select(*features)


def correlations(frame: DataFrame, features: list[str], method: str = "pearson") -> DataFrame:
    """The matrix in long form ``feature_i, feature_j, r``; NULL beside a constant feature. One aggregate for all pairs."""
    if method == "spearman":
        frame = ranks(frame, features)
    elif method != "pearson":
        raise ValueError(f"no such method: {method}")
    pairs = list(combinations_with_replacement(range(len(features)), 2))
    moments = [F.covar_pop(features[i], features[j]).alias(f"c{i}_{j}") for i, j in pairs]
    spread = [F.max(f).alias(f"max{i}") for i, f in enumerate(features)] + [F.min(f).alias(f"min{i}") for i, f in enumerate(features)]
    one = frame.agg(*moments, *spread)
    varies = lambda i: F.col(f"max{i}") > F.col(f"min{i}")
    r = lambda i, j: F.when(varies(i) & varies(j), F.try_divide(F.col(f"c{min(i, j)}_{max(i, j)}"), F.sqrt(F.col(f"c{i}_{i}")) * F.sqrt(F.col(f"c{j}_{j}"))))
    cells = [F.struct(F.lit(a).alias("feature_i"), F.lit(b).alias("feature_j"), F.lit(i).alias("i"), F.lit(j).alias("j"), r(i, j).alias("r")) for i, a in enumerate(features) for j, b in enumerate(features)]
    return one.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def high_pairs(matrix: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Pairs of different features correlated beyond a threshold, and their sign."""
    return matrix.filter(f"i < j and abs(r) > {threshold}").select("feature_i", "feature_j", "r", F.when(F.col("r") > 0, "positive").otherwise("negative").alias("sign"))


def heatmap(matrix: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Cells of a heat map, and whether they are framed."""
    return matrix.select("feature_i", "feature_j", F.round("r", 4).alias("r"), F.coalesce((F.col("i") != F.col("j")) & (F.abs("r") > threshold), F.lit(False)).alias("highlight"))
