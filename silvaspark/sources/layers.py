"""Named layers in a folder of Parquet tables, and rasters as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def names(spark: SparkSession, folder: str) -> list[str]:
    fs, at = _system(spark, folder)
    if not fs.exists(at):
        raise FileNotFoundError(folder)
    return sorted(f.getPath().getName().removeprefix("layer=") for f in fs.listStatus(at) if f.isDirectory() and f.getPath().getName().startswith("layer="))


def read(spark: SparkSession, folder: str, name: str | None = None) -> DataFrame:
    """A layer, the first one by default; an unknown name is an error that lists the layers."""
    there = names(spark, folder)
    if not there:
        raise ValueError(f"no layer in {folder}")
    if name is not None and name not in there:
        raise ValueError(f"no layer {name} in {folder}; there are {', '.join(there)}")
    return spark.read.parquet(f"{folder}/layer={name or there[0]}")


def write(layer: DataFrame, folder: str, name: str) -> None:
    """Write a layer; one of the same name is replaced, others stay.

    The new table is complete before the old one goes, so a layer may be made from itself.
    """
    spark, target, fresh = layer.sparkSession, f"{folder}/layer={name}", f"{folder}/_new-{name}"
    layer.write.mode("overwrite").parquet(fresh)
    fs, at = _system(spark, target)
    fs.delete(at, True)
    fs.rename(_system(spark, fresh)[1], at)


def update(layer: DataFrame, metrics: DataFrame, key: str = "fid") -> DataFrame:
    """A layer with the columns of ``metrics`` added, or replaced where they exist."""
    fields = [c for c in metrics.columns if c != key]
    return layer.drop(*fields).join(metrics, key, "left")


def raster_table(raster: DataFrame, path: str, nodata: float, kind: str = "float", columns: tuple[str, ...] = ("value",)) -> None:
    """A raster as Parquet, in ranges of rows, with nodata as a number of its kind (float, int, short) in each of its columns."""
    filled = raster.select("row", "col", *[F.coalesce(F.col(c), F.lit(nodata)).cast(kind).alias(c) for c in columns])
    filled.repartitionByRange("row", "col").sortWithinPartitions("row", "col").write.mode("overwrite").parquet(path)
