"""Listings of input files, through Spark's own file systems."""

from __future__ import annotations

from pyspark.sql import SparkSession


def find_files(spark: SparkSession, pattern: str) -> list[str]:
    """The sorted paths that match a glob; an error if there are none."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    paths = sorted(f.getPath().toString() for f in found or [])
    if not paths:
        raise FileNotFoundError(f"no file matches {pattern}")
    return paths


def find_point_tiles(spark: SparkSession, directory: str, suffix: str = "laz") -> list[str]:
    """Point tiles of a folder, without cloud-optimised copies."""
    try:
        paths = find_files(spark, f"{directory}/*.{suffix}")
    except FileNotFoundError:
        paths = []
    kept = [p for p in paths if ".copc." not in p.rsplit("/", 1)[-1]]
    if not kept:
        raise FileNotFoundError(f"no .{suffix} tile in {directory}")
    return kept


def find_band_file(spark: SparkSession, directory: str, pattern: str) -> str:
    """The first of the files that end with a pattern."""
    return find_files(spark, f"{directory}/*{pattern}")[0]
