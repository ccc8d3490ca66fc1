"""Command lines of the stages: ``python -m silvaspark.cli STAGE --data FOLDER [options]``.

Under the folder lie ``las`` or ``points`` (Parquet), ``surface`` and ``terrain`` (GeoTIFF tiles), ``scene``
(one GeoTIFF for each band and the scene classes) and ``training.gpkg``; results go to ``processed``: rasters
and layers as Parquet, and the files that other programs read beside them. Each stage reads what the ones
before it wrote. Options have the names and defaults of the stage's parameters.
"""

from __future__ import annotations

import argparse
import os
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geometry, spectral
from .operators import classify, raster, spatial
from .operators import crowns as crown_ops
from .operators.graph import written
from .operators.grid import RasterMeta, dense
from .params import Correlation, Crowns, Features, Landscape, Prepare, Treetops
from .plans import stages
from .schema import BANDS, CORRELATION_FEATURES, INDICES
from .session import session
from .sources import files, geopackage, geotiff, las, layers, rasters, reports


class Folder:
    """The places of a data folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.out = f"{self.root}/processed"
        os.makedirs(self.out, exist_ok=True)

    def cloud(self) -> DataFrame:
        if os.path.isdir(f"{self.root}/points"):
            return self.spark.read.parquet(f"{self.root}/points")
        files.find_point_tiles(self.spark, f"{self.root}/las", "las")
        las.register(self.spark)
        return self.spark.read.format("las").load(f"{self.root}/las")

    def raster(self, name: str) -> tuple[DataFrame, RasterMeta]:
        return rasters.read(self.spark, f"{self.out}/{name}")

    def save(self, table: DataFrame, name: str, meta: RasterMeta, nodata: float, kind: str = "float", tiff: str = "f4", columns: tuple[str, ...] = ("value",)) -> None:
        """A raster as Parquet and as one GeoTIFF file."""
        rasters.write(table, f"{self.out}/{name}", meta, nodata, kind, columns)
        geotiff.write(rasters.read(self.spark, f"{self.out}/{name}")[0], f"{self.out}/{name}.tif", meta, list(columns), tiff, nodata)


def prepare(data: Folder, params: Prepare, log) -> None:
    surface, meta = rasters.placed_tiles(data.spark, f"{data.root}/surface")
    terrain, other = rasters.placed_tiles(data.spark, f"{data.root}/terrain")
    meta.same_grid(other)
    made = stages.prepare(surface, terrain, data.cloud(), meta, params)
    for name in ("surface", "terrain", "ndsm"):
        data.save(made[name], name, meta, -9999.0)
    mask = dense(data.spark, meta).join(made["mask"].withColumn("value", F.lit(1)), ["row", "col"], "left").na.fill(0, ["value"])
    data.save(mask, "mask", meta, 255.0, "short", "u1")
    log.info(f"Heights: {raster.statistics(data.raster('ndsm')[0]).first().asDict()}")


def treetops(data: Folder, params: Treetops, log) -> None:
    terrain, meta = data.raster("terrain")
    layers.write(stages.detect_treetops(data.cloud(), terrain, meta, params), f"{data.out}/treetops", params.layer)
    n = geopackage.write(layers.read(data.spark, f"{data.out}/treetops", params.layer), f"{data.out}/treetops.gpkg", params.layer, meta.crs)
    log.info(f"Treetops: {n}, layer {params.layer}")


def crowns(data: Folder, params: Crowns, log) -> None:
    name = params.treetops_layer or layers.names(data.spark, f"{data.out}/treetops")[0]
    (ndsm, meta), (mask, _) = data.raster("ndsm"), data.raster("mask")
    made = stages.segment_crowns(layers.read(data.spark, f"{data.out}/treetops", name), ndsm, mask.filter("value = 1"), meta, params)
    data.save(made["segments"].withColumnRenamed("crown_id", "value"), params.raster(name), meta, 0.0, "int", "i4")
    layers.write(made["crowns"], f"{data.out}/crown_cells", params.layer(name))
    cells = layers.read(data.spark, f"{data.out}/crown_cells", params.layer(name))
    layers.write(crown_ops.outlines(cells, meta), f"{data.out}/crowns", params.layer(name))
    n = geopackage.write(layers.read(data.spark, f"{data.out}/crowns", params.layer(name)), f"{data.out}/crowns.gpkg", params.layer(name), meta.crs)
    log.info(f"Crowns: {n}, layer {params.layer(name)}; cleaned {[r.asDict() for r in made['actions'].collect()]}; holes {[r.asDict() for r in made['holes'].collect()]}")


def features(data: Folder, params: Features, log) -> None:
    name = params.crowns_layer or layers.names(data.spark, f"{data.out}/crowns")[0]
    terrain, meta = data.raster("terrain")
    layer = layers.read(data.spark, f"{data.out}/crowns", name)
    shapes = layer.select("fid", "rings", geometry.polygon_area(F.col("rings")).alias("area"), geometry.bounds(F.col("rings")).alias("b")).select("fid", "rings", "area", "b.*")
    layers.write(layers.update(layer, stages.crown_features(shapes, data.cloud(), terrain, meta, params)), f"{data.out}/crowns", name)
    n = geopackage.write(layers.read(data.spark, f"{data.out}/crowns", name), f"{data.out}/crowns.gpkg", name, meta.crs)
    log.info(f"Crowns with metrics: {n}, layer {name}")


def correlation(data: Folder, params: Correlation, log) -> None:
    name = params.crowns_layer or layers.names(data.spark, f"{data.out}/crowns")[0]
    made, chosen = stages.feature_correlation(layers.read(data.spark, f"{data.out}/crowns", name), params), list(CORRELATION_FEATURES)
    reports.correlation_csv(made["matrix"], chosen, f"{data.out}/{params.name(name)}.csv")
    reports.heatmap_svg(made["matrix"], chosen, f"{params.method} correlation, {name}", f"{data.out}/{params.name(name)}.svg")
    for r in made["high"].collect():
        log.info(f"{r['feature_i']} and {r['feature_j']}: {r['r']:.3f}, {r['sign']}")


def landscape(data: Folder, params: Landscape, log) -> None:
    grids, target = [], None
    for name in (*BANDS, "SCL"):
        path = files.find_band_file(data.spark, f"{data.root}/scene", f"{name.split('_')[0]}.tif")
        band, meta = rasters.read(data.spark, path)
        target = target or meta
        column = "scl" if name == "SCL" else name
        grids.append((band.withColumnRenamed("value", column), meta, (column,)))
    mask, fine = data.raster("mask")
    fraction = raster.vegetation_fraction(mask, max(1, round(target.px_w / fine.px_w)), params.mask_threshold)
    polygons = classify.with_class(geopackage.read(data.spark, f"{data.root}/training.gpkg"))
    cells = spatial.polygon_cells(polygons, target).join(polygons.select("fid", "class_id"), "fid")
    bands = written(raster.band_stack(grids, target), "bands")
    names = [*BANDS, *INDICES]
    stack = spectral.reflectance(spectral.masked_by_scene(bands)).withColumns(spectral.indices())
    rasters.write(stack, f"{data.out}/stack", target, float("nan"), "float", tuple(names))
    whole = data.spark.read.parquet(f"{data.out}/stack")
    geotiff.write(whole, f"{data.out}/sentinel2_stack.tif", target, list(BANDS), "f4", float("nan"))
    for index in INDICES:
        geotiff.write(whole, f"{data.out}/s2_{index}.tif", target, [index], "f4", float("nan"))
    for index, (low, high) in reports.extremes(stack, list(INDICES)).items():
        log.info(f"{index}: {low} to {high}")
    made = stages.landscape(bands, written(fraction, "fraction"), written(cells, "training-cells"), params)
    data.save(made["scene"].withColumnRenamed("prediction", "value"), f"classification_{params.suffix}", target, -1.0, "short", "i2")
    data.save(made["scene"].withColumnRenamed("confidence", "value"), f"confidence_{params.suffix}", target, -9999.0)
    reports.confusion_csv(made["confusion"], f"{data.out}/confusion_matrix_{params.suffix}.csv")
    reports.importance_csv(made["importances"], f"{data.out}/feature_importance_{params.suffix}.csv")
    reports.report_txt(made["report"], f"{data.out}/classification_report_{params.suffix}.txt")
    reports.legend_csv(f"{data.out}/landscape_legend_{params.suffix}.csv")
    reports.style_qml(f"{data.out}/classification_{params.suffix}.qml")


STAGES = {"prepare": (prepare, Prepare), "treetops": (treetops, Treetops), "crowns": (crowns, Crowns), "features": (features, Features), "correlation": (correlation, Correlation), "landscape": (landscape, Landscape)}


def _kind(annotation: str):
    if "None" in annotation:
        base = int if "int" in annotation else str
        return lambda text: None if text.lower() == "none" else base(text)
    return {"int": int, "float": float, "str": str}[annotation]


def parser() -> argparse.ArgumentParser:
    found = argparse.ArgumentParser(prog="silvaspark", description=__doc__.split("\n")[0])
    kinds = found.add_subparsers(dest="stage", required=True)
    for name, (_, params) in STAGES.items():
        one = kinds.add_parser(name)
        one.add_argument("--data", required=True, help="the data folder")
        for f in fields(params):
            one.add_argument(f"--{f.name.replace('_', '-')}", f"--{f.name}", dest=f.name, type=_kind(str(f.type)), default=f.default, help=f"default: {f.default}")
    return found


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    given = vars(parser().parse_args(arguments))
    stage, root = given.pop("stage"), given.pop("data")
    run, params = STAGES[stage]
    data = Folder(spark or session(), root)
    run(data, params(**given), reports.logger(stage, f"{data.root}/logs"))


if __name__ == "__main__":
    main()
