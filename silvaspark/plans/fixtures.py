"""Inputs of the engine shaped from general tables, by the same expressions in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.grid import RasterMeta
from ..schema import BANDS

POINTS = (
    "l_orderkey*8+l_linenumber as point_key", "cast(l_partkey%4 as int) as tile", "(l_partkey%200)*0.5e0+l_discount*4e0 as x", "(l_orderkey%200)*0.5e0+l_tax*5e0 as y",
    "l_quantity*0.5e0+l_extendedprice*1e-5 as z", "cast(2+l_linenumber%5 as int) as classification", "l_extendedprice as intensity", "(l_suppkey%50)*1000e0 as red", "(l_partkey%60)*1000e0 as nir",
)
CELL = ("cast((o_orderkey-o_orderkey%100)/100 as int) as row", "cast(o_orderkey%100 as int) as col")
DTM = (*CELL, "case when o_orderstatus='P' and o_orderkey%10=3 then -9999e0 else o_totalprice*2e-6 end as value")
MDS = (*CELL, "case when o_orderkey%37=5 then -9999e0 else (o_custkey%30)*0.5e0 end as value")
SEGMENTS = (*CELL, "cast(case when o_custkey%3=0 then 0 else 1+(o_orderkey%100-o_orderkey%10)/10+10*((o_orderkey-o_orderkey%1000)/1000) end as int) as crown_id")
CROWNS = ("p_partkey as fid", "cast((p_partkey*7)%96 as double) as xmin", "cast((p_partkey*13)%96 as double) as ymin", "cast((p_partkey*7)%96+1+p_size%4 as double) as xmax", "cast((p_partkey*13)%96+1+p_size%3 as double) as ymax")
TRAINING = (*CROWNS, "case p_size%8 when 0 then '213' when 1 then ' 311 ' when 2 then '312' when 3 then '313' when 4 then '321' when 5 then '410' when 6 then '999' else null end as type")
PIXEL = ("cast((vec_id-vec_id%20)/20 as int) as row", "cast(vec_id%20 as int) as col", "cast(vec_id%12 as int) as scl", "cast(label%6+1 as int) as class_id")
TABLES = {"points": ("lineitem", POINTS), "dtm": ("orders", DTM), "mds": ("orders", MDS), "segments": ("orders", SEGMENTS), "crowns": ("part", CROWNS), "training": ("part", TRAINING)}
#: The crowns' raster: 100 x 100 cells of one metre.
EXTENT = (0.0, 100.0, 0.0, 100.0)


def _bands(element: str) -> list[str]:
    return [f"(cast({element.format(i)} as double)+1e0)*5000e0 as {b}" for i, b in enumerate(BANDS, 1)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "bands":
        return spark.read.parquet(f"{sf_dir}/embeddings.parquet").selectExpr(*PIXEL, *_bands("element_at(embedding,{})"))
    source, columns = TABLES[name]
    return spark.read.parquet(f"{sf_dir}/{source}.parquet").selectExpr(*columns)


def sql(*names: str) -> str:
    """Common table expressions of the named inputs."""
    parts = [f"bands as (select {', '.join([*PIXEL, *_bands('embedding[{}]')])} from embeddings)" if n == "bands" else f"{n} as (select {', '.join(TABLES[n][1])} from {TABLES[n][0]})" for n in names]
    return "with " + ",\n".join(parts)


def terrain_meta(spark: SparkSession, sf_dir: str) -> RasterMeta:
    """The header of the terrain raster: rows count upwards from 0, 100 columns of one metre."""
    rows = -(-spark.read.parquet(f"{sf_dir}/orders.parquet").count() // 100)
    return RasterMeta(0.0, 1.0, 0.0, 1.0, 100, rows, nodata=-9999.0)


CROWN_META = RasterMeta(0.0, 1.0, 0.0, 1.0, 100, 100)
