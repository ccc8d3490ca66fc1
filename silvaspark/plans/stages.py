"""The stages from tiles to crowns, land cover and correlations, each a lazy plan over its inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import spectral
from ..operators import classify, correlate, crowns, features, points, raster, treetops
from ..operators.graph import written
from ..operators.grid import RasterMeta, dense
from ..params import Correlation, Crowns, Features, Landscape, Prepare, Treetops
from ..schema import BANDS, CORRELATION_FEATURES, INDICES


def prepare(surface_tiles: DataFrame, terrain_tiles: DataFrame, cloud: DataFrame, meta: RasterMeta, params: Prepare = Prepare()) -> dict[str, DataFrame]:
    """Mosaics ``surface`` and ``terrain``, their difference ``ndsm``, and the vegetation ``mask``."""
    surface, terrain = (raster.mosaic(raster.from_nodata(t, meta.nodata)) for t in (surface_tiles, terrain_tiles))
    return {"surface": surface, "terrain": terrain, "ndsm": raster.height_model(surface, terrain, params.min_ndsm), "mask": points.vegetation_mask(cloud, meta, dilations=params.dilations)}


def detect_treetops(cloud: DataFrame, terrain: DataFrame, meta: RasterMeta, params: Treetops = Treetops(), order: tuple[str, ...] = ("point_id",)) -> DataFrame:
    """The treetop layer; ids follow the input's order, or fall with height where treetops are suppressed."""
    heights = written(points.normalise_heights(points.of_class(cloud, 5), terrain, meta), "heights")
    high = points.at_least(points.without_outliers(heights, params.upper_percentile), params.minheight)
    tops = treetops.local_maxima(high, params.radius_a, params.radius_b)
    if params.mindist <= 0:
        return treetops.numbered(tops, order)
    return treetops.numbered(treetops.suppress(tops, params.mindist, order), ("z desc", *order))


def segment_crowns(tops: DataFrame, ndsm: DataFrame, mask: DataFrame, meta: RasterMeta, params: Crowns = Crowns()) -> dict[str, DataFrame]:
    """``segments`` (row, col, crown_id, filled), ``crowns`` (fid, crown_id, row, col, cleaned), and ``actions``, counts of what cleaning did.

    Without a treetop on the raster there is no crown: every segment is 0.
    """
    seeds = crowns.seeds(tops, meta, "tree_id")
    relief = raster.inverted(raster.vegetation_cells(ndsm, mask, params.minheight))
    flooded = crowns.watershed(relief, seeds, meta, params.compactness)
    every = dense(tops.sparkSession, meta).join(flooded, ["row", "col"], "left").na.fill(0, ["crown_id"])
    segments = crowns.fill_holes(every, meta)
    cells = crowns.clean_small(crowns.polygonise(segments, meta), meta.px_w, params.min_area)
    return {"segments": segments, "crowns": cells.filter("row is not null").drop("action"), "actions": crowns.action_counts(cells), "holes": crowns.hole_counts(every, meta)}


def crown_features(boxes: DataFrame, cloud: DataFrame, terrain: DataFrame, meta: RasterMeta, params: Features = Features()) -> DataFrame:
    """All crown fields of ``boxes`` (fid, xmin..ymax, area) from a cloud and the terrain under it."""
    return features.crown_metrics(boxes, points.vegetation_heights(points.colours(cloud), terrain, meta), meta.extent, params.edge_buffer)


def feature_correlation(metrics: DataFrame, params: Correlation = Correlation()) -> dict[str, DataFrame]:
    chosen = list(CORRELATION_FEATURES)
    matrix = correlate.correlations(correlate.used(metrics, chosen, params.min_points), chosen, params.method)
    return {"matrix": matrix, "high": correlate.high_pairs(matrix), "heatmap": correlate.heatmap(matrix)}


def landscape(bands: DataFrame, fraction: DataFrame, training_cells: DataFrame, params: Landscape = Landscape()) -> dict[str, DataFrame]:
    """``scene`` (prediction, confidence) and the ``confusion``, ``report`` and ``importances`` on held-out samples.

    ``bands`` has ``scl`` and raw band values, ``training_cells`` fid, class_id, row, col. Without a
    complete training sample there is no model: predictions are NULL, the other tables are empty.
    """
    names = [*BANDS, *INDICES]
    stack = spectral.reflectance(spectral.masked_by_scene(bands)).withColumns(spectral.indices())
    stack = written(raster.masked(stack, fraction, names), "stack")
    samples = written(classify.samples(training_cells, stack, names), "samples")
    split = classify.stratified_split(samples, (f"xxhash64(row, col, fid, {params.seed})", "row", "col", "fid"), params.test_size)
    train = split.filter("not is_test")
    if train.isEmpty():
        none = lambda schema: bands.sparkSession.createDataFrame([], schema)
        scene = stack.select("row", "col", F.lit(None).cast("short").alias("prediction"), F.lit(None).cast("double").alias("confidence"))
        confusion = none("class_id int, prediction int, n long")
        return {"scene": scene, "confusion": confusion, "report": classify.report(confusion), "importances": none("feature string, importance double")}
    model = classify.train_forest(train, names, params)
    matrix = written(classify.confusion(classify.predict(model, split.filter("is_test"), names)), "confusion")
    scene = written(classify.predict(model, stack, names).select("row", "col", F.col("prediction").cast("short").alias("prediction"), "confidence"), "scene")
    return {"scene": scene, "confusion": matrix, "report": classify.report(matrix), "importances": classify.importances(bands.sparkSession, model, names)}
