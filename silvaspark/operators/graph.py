"""Tables kept between the rounds of a loop, and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a local one only where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="silvaspark-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame, name: str) -> DataFrame:
    """A DataFrame written to the shared folder and read back: its lineage ends there."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``id`` and ``component``, the least id that it reaches, of nodes ``id`` and links ``a``, ``b``.

    In a round each root takes its least neighbour for a parent if that is less than itself, and
    paths are halved until all ids point to roots; links between different roots remain. A root
    that keeps a link to a lesser one goes, so the rounds grow with the logarithm of a component.
    """
    edges = written(links.select("a", "b").filter("a <> b").distinct(), "links")
    found = nodes.select("id", F.col("id").alias("component"))
    while not edges.isEmpty():
        parents = written(edges.union(edges.select("b", "a")).groupBy("a").agg(F.min("b").alias("p")).filter("p < a").withColumnRenamed("a", "id"), "parents")
        while True:
            up = parents.select(F.col("id").alias("p"), F.col("p").alias("up"))
            higher = written(parents.join(up, "p", "left").select("id", F.coalesce("up", "p").alias("p"), F.col("up").isNotNull().alias("moved")), "parents")
            parents = higher.select("id", "p")
            if higher.filter("moved").isEmpty():
                break
        root = lambda name: parents.select(F.col("id").alias(name), F.col("p").alias(f"root_{name}"))
        found = written(found.join(root("component"), "component", "left").select("id", F.coalesce("root_component", "component").alias("component")), "components")
        moved = edges.join(root("a"), "a", "left").join(root("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
        edges = written(moved.filter("a <> b").distinct(), "links")
    return found
