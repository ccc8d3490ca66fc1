"""Land cover: training samples, a stratified split, a random forest and its diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..params import Landscape
from ..schema import CLASSES
from . import forest


def class_map(spark) -> DataFrame:
    return spark.createDataFrame([(label, i, name, colour) for label, i, name, colour in CLASSES], "label string, class_id int, class_name string, rgb string")


def with_class(training: DataFrame, field: str = "type") -> DataFrame:
    """``class_id`` by the trimmed label, exactly or else whatever its case; NULL if there is none. The map has a few rows."""
    classes = class_map(training.sparkSession).select("label", "class_id")
    low = classes.groupBy(F.lower("label").alias("_low")).agg(F.min("class_id").alias("_by_low"))
    trimmed = training.withColumn("_label", F.trim(F.col(field).cast("string")))
    found = trimmed.join(F.broadcast(classes), F.col("_label") == F.col("label"), "left").join(F.broadcast(low), F.lower("_label") == F.col("_low"), "left")
    return found.withColumn("class_id", F.coalesce("class_id", "_by_low")).drop("_label", "label", "_low", "_by_low")


def with_name(df: DataFrame, column: str = "class_id") -> DataFrame:
    names = class_map(df.sparkSession).select(F.col("class_id").alias("_id"), "class_name")
    joined = df.join(F.broadcast(names), F.col(column) == F.col("_id"), "left").drop("_id")
    return joined.withColumn("class_name", F.coalesce("class_name", F.concat(F.lit("class_"), F.col(column).cast("string"))))


def samples(cells: DataFrame, stack: DataFrame, features: list[str]) -> DataFrame:
    """Complete pixels under training cells ``fid, class_id, row, col``; polygons that overlap repeat a pixel.

    Cells of a NULL class, off the stack or with a NULL feature give none.
    """
    return cells.join(stack, ["row", "col"]).filter("class_id is not null").dropna(how="any", subset=features)


def class_counts(df: DataFrame, column: str = "class_id") -> DataFrame:
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return with_name(counts.withColumn("pct", 100.0 * F.col("n") / total), column)


def balanced_weights(train: DataFrame, column: str = "class_id") -> DataFrame:
    """``weight`` of each class: rows / (classes · rows of the class)."""
    counts = train.groupBy(column).agg(F.count("*").alias("n"))
    return counts.select(column, "n", (counts.agg(F.sum("n")).scalar() / (counts.agg(F.count("*")).scalar() * F.col("n"))).alias("weight"))


def stratified_split(df: DataFrame, order: tuple[str, ...], test_size: float = 0.25, column: str = "class_id", group: str | None = None) -> DataFrame:
    """``is_test`` for the first rounded share of each class in ``order``, an order that must be total.

    Ranks are by class, so a task sorts the training pixels of one class: those under hand-drawn
    polygons, not the scene. With a ``group``, such as the polygon, its pixels stay together:
    groups go to the test, in the order of their first pixel, until it has the share.
    """
    sizes = df.groupBy(column).agg(F.count("*").alias("_n"))
    if group:
        first = F.min(F.struct(*[F.expr(o).alias(f"_{k}") for k, o in enumerate(order)]))
        groups = df.groupBy(column, group).agg(F.count("*").alias("_k"), first.alias("_first"))
        before = F.coalesce(F.sum("_k").over(Window.partitionBy(column).orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        chosen = groups.withColumn("_before", before).join(F.broadcast(sizes), column).select(column, group, (F.col("_before") < F.round(F.col("_n") * test_size)).alias("is_test"))
        return df.join(chosen, [column, group]).select(*df.columns, "is_test")
    place = F.row_number().over(Window.partitionBy(column).orderBy(*[F.expr(o) for o in order]))
    return df.withColumn("_place", place).join(F.broadcast(sizes), column).withColumn("is_test", F.col("_place") <= F.round(F.col("_n") * test_size)).drop("_place", "_n")


def train_forest(train: DataFrame, features: list[str], params: Landscape = Landscape()) -> forest.Forest:
    """A balanced random forest; trees are at most 30 deep. Trees stay in the shared folder."""
    whole = train.dropna(how="any", subset=[*features, "class_id"])
    weighted = whole.join(F.broadcast(balanced_weights(whole).select("class_id", "weight")), "class_id")
    return forest.train(weighted, features, params.n_estimators, min(params.max_depth or 30, 30), params.min_samples_leaf, params.seed)


def predict(model: forest.Forest, stack: DataFrame, features: list[str]) -> DataFrame:
    """``prediction`` and ``confidence`` of complete rows; others keep NULLs."""
    return forest.predict(model, stack)


def confusion(scored: DataFrame) -> DataFrame:
    """Counts ``n`` of each ``class_id`` and ``prediction`` that occur together; no rows for no samples."""
    return scored.groupBy("class_id", "prediction").agg(F.count("*").alias("n"))


def report(matrix: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of each class, their means, and the accuracy, from a confusion matrix."""
    right = matrix.filter("class_id = prediction").groupBy("class_id").agg(F.sum("n").alias("hit"))
    true = matrix.groupBy("class_id").agg(F.sum("n").alias("support"))
    said = matrix.groupBy(F.col("prediction").alias("class_id")).agg(F.sum("n").alias("said"))
    each = true.join(said, "class_id", "full").join(right, "class_id", "left").na.fill(0)
    each = each.withColumn("precision", F.coalesce(F.try_divide("hit", "said"), F.lit(0.0))).withColumn("recall", F.coalesce(F.try_divide("hit", "support"), F.lit(0.0)))
    each = each.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))
    scores = ("precision", "recall", "f1")
    weighted = [(F.sum(F.col(s) * F.col("support")) / F.sum("support")).alias(s) for s in scores]
    kinds = each.select(F.col("class_id").cast("string").alias("name"), *scores, "support")
    return kinds.unionByName(each.agg(F.lit("macro avg").alias("name"), *[F.avg(s).alias(s) for s in scores], F.sum("support").alias("support"))).unionByName(each.agg(F.lit("weighted avg").alias("name"), *weighted, F.sum("support").alias("support"))).unionByName(each.agg(F.lit("accuracy").alias("name"), *[(F.sum("hit") / F.sum("support")).alias(s) for s in scores], F.sum("support").alias("support")))


def importances(spark, model: RandomForestClassificationModel, features: list[str]) -> DataFrame:
    found = sorted(zip(features, model.importances(), strict=True), key=lambda x: -x[1])
    return spark.createDataFrame([(f, round(v, 6)) for f, v in found], "feature string, importance double")


def legend(spark) -> DataFrame:
    """Class id, name, colour and its hexadecimal form, with a row for nodata."""
    part = lambda k: F.lower(F.lpad(F.hex(F.split("rgb", ",")[k].cast("int")), 2, "0"))
    rows = class_map(spark).select("class_id", "class_name", "rgb").union(spark.createDataFrame([(-1, "NoData", "0,0,0")], "class_id int, class_name string, rgb string"))
    return rows.withColumn("hex", F.concat(F.lit("#"), part(0), part(1), part(2)))
