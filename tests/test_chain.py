"""The stages from tiles to correlation through files, and the files themselves."""

import csv
import sqlite3
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from silvaspark import cli
from silvaspark.functions import geometry
from silvaspark.operators import crowns
from silvaspark.operators.grid import RasterMeta
from silvaspark.schema import BANDS, CROWN_FIELDS, INDICES
from silvaspark.sources import geopackage, geotiff, layers, rasters, reports

META = RasterMeta(1000.0, 0.5, 2060.0, -0.5, 120, 120, "EPSG:3763", -9999.0)
TREES = [(1012.2, 2047.9, 12.0), (1030.3, 2030.4, 15.0), (1045.1, 2046.2, 9.0), (1014.7, 2014.1, 11.0), (1047.4, 2013.3, 14.0)]


def height(x, y):
    return np.maximum.reduce([h - 0.9 * np.hypot(x - a, y - b) for a, b, h in TREES] + [np.zeros_like(x)])


def test_tiff_files_come_back(spark, tmp_path):
    geotiff.register(spark)
    rng = np.random.default_rng(1)
    meta = RasterMeta(500.0, 10.0, 9000.0, -10.0, 300, 270, "EPSG:32629", -9999.0)
    cells = [(int(r), int(c), float(v), None if v < 0.1 else float(v * 3)) for r, c, v in zip(rng.integers(0, 270, 900), rng.integers(0, 300, 900), rng.random(900), strict=True)]
    table = spark.createDataFrame(cells, "row int, col int, a double, b double").dropDuplicates(["row", "col"])
    path = str(tmp_path / "two.tif")
    geotiff.write(table, path, meta, ["a", "b"], "f8")
    assert geotiff.read_meta(spark, path) == meta and geotiff.header(path).names == ["a", "b"]
    found = spark.read.format("geotiff").load(path)
    assert found.count() == 270 * 300
    expected = sorted((r.row, r.col, r.a, r.b) for r in table.collect())
    assert sorted((r.row, r.col, r.a, r.b) for r in found.filter("a is not null or b is not null").collect()) == expected
    for kind, nodata in (("u1", 255.0), ("i2", -1.0), ("i4", 0.0), ("f4", float("nan"))):
        geotiff.write(spark.createDataFrame([(0, 0, 7.0), (269, 299, 3.0), (400, 1, 9.0)], "row int, col int, value double"), path, meta, None, kind, nodata)
        assert sorted((r.row, r.col, r.value) for r in spark.read.format("geotiff").load(path).filter("value is not null").collect()) == [(0, 0, 7.0), (269, 299, 3.0)]


def test_tiff_strips(spark, tmp_path):
    """A plain file of strips, as other programs write it."""
    data = np.arange(12, dtype="<u2").reshape(4, 3)
    tags = [(256, 3, 3), (257, 3, 4), (258, 3, 16), (259, 3, 1), (273, 4, 200), (277, 3, 1), (278, 3, 4), (279, 4, 24)]
    raw = struct.pack("<2sHI", b"II", 42, 8) + struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, k, 1, v) for t, k, v in tags) + struct.pack("<I", 0)
    (tmp_path / "s.tif").write_bytes(raw.ljust(200, b"\0") + data.tobytes())
    geotiff.register(spark)
    found = spark.read.format("geotiff").load(str(tmp_path / "s.tif")).orderBy("row", "col").collect()
    assert [r.value for r in found] == list(range(12))
    (tmp_path / "x.tif").write_bytes(b"nothing")
    with pytest.raises(ValueError, match="no TIFF"):
        geotiff.header(str(tmp_path / "x.tif"))


def test_geopackages_come_back(spark, tmp_path):
    path = str(tmp_path / "l.gpkg")
    tops = spark.createDataFrame([(1, 12.5, 4.0, 5.0), (2, 3.0, None, None)], "tree_id int, height_m double, x double, y double")
    square = [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)], [(1.0, 1.0), (1.0, 2.0), (2.0, 2.0), (2.0, 1.0)]]
    shapes = spark.createDataFrame([(7, 3, square), (9, 4, None)], "fid long, crown_id int, rings array<array<struct<x: double, y: double>>>")
    assert geopackage.write(tops, path, "tops", "EPSG:3763") == 2 and geopackage.write(shapes, path, "crowns") == 2
    geopackage.write(tops.filter("tree_id = 1"), path, "tops", "EPSG:3763")
    assert [(r.fid, r.tree_id, r.x, r.y) for r in geopackage.read(spark, path, "tops").collect()] == [(1, 1, 4.0, 5.0)]
    found = {r.fid: r for r in geopackage.read(spark, path, "crowns").collect()}
    assert [[(p.x, p.y) for p in ring][:-1] for ring in found[7].rings] == square and found[9].rings is None and found[7].crown_id == 3
    with sqlite3.connect(path) as db:
        assert db.execute("select srs_id from gpkg_contents where table_name = 'tops'").fetchone() == (3763,)
    geopackage.ROWS, was = 1, geopackage.ROWS
    try:
        assert geopackage.read(spark, path, "crowns").count() == 2
    finally:
        geopackage.ROWS = was


def test_outlines(spark):
    """A ring with a hole, and two blocks that touch at a corner and are joined elsewhere."""
    meta = RasterMeta(0.0, 1.0, 0.0, 1.0, 20, 20)
    ring = [(1, r, c) for r in range(3) for c in range(3) if (r, c) != (1, 1)]
    corner = [(2, r, c) for r, c in ((10, 10), (10, 11), (11, 12), (10, 12), (11, 10), (12, 10), (12, 11))]
    cells = spark.createDataFrame([(f, f, r, c) for f, r, c in ring + corner], "fid long, crown_id int, row int, col int")
    found = {r.fid: r for r in crowns.outlines(cells, meta).withColumn("area", geometry.polygon_area(F.col("rings"))).collect()}
    assert found[1].area == 8 and len(found[1].rings) == 2 and len(found[1].rings[0]) == 4
    assert found[2].area == 7


def test_edges_and_corners(spark):
    """Polygons 1 and 2 share an edge only; 1 and 3 share an edge and touch at a corner apart from it."""
    cells = [(1, 0, 0), (1, 0, 1), (1, 0, 2), (1, 0, 3), (2, 1, 0), (3, 1, 2), (3, 2, 3), (3, 2, 2), (3, 1, 4), (3, 2, 4)]
    table = spark.createDataFrame([(f, r, c) for f, r, c in cells], "fid long, row int, col int")
    pairs = lambda **k: {(r.fid, r.other) for r in crowns.shared_edges(table, **k).collect()}
    assert pairs() == {(1, 2), (2, 1), (1, 3), (3, 1)} and pairs(corners=False) == {(1, 2), (2, 1)}


def test_codes_are_not_blended(spark):
    from silvaspark.operators import raster

    coarse = spark.createDataFrame([(0, 0, 4.0, 0.0), (0, 1, 8.0, 1.0)], "row int, col int, scl double, b double")
    grids = [(coarse, RasterMeta(0.0, 2.0, 0.0, 2.0, 2, 1), ("scl", "b"))]
    target = RasterMeta(0.0, 1.0, 0.0, 1.0, 4, 2)
    found = raster.band_stack(grids, target, codes=("scl",)).filter("row = 0").orderBy("col").collect()
    assert [r.scl for r in found] == [4, 4, 8, 8] and [r.b for r in found] == [0, 0.25, 0.75, 1]
    assert [r.scl for r in raster.band_stack(grids, target).filter("row = 0").orderBy("col").collect()] == [4, 5, 7, 8]


def test_groups_stay_together(spark):
    from silvaspark.operators import classify

    rows = spark.range(200).selectExpr("cast(id % 2 as int) as class_id", "id div 10 as fid", "id")
    found = classify.stratified_split(rows, ("id",), 0.25, group="fid").groupBy("class_id", "fid").agg(F.min("is_test").alias("a"), F.max("is_test").alias("b"), F.count("*").alias("n")).collect()
    assert all(r.a == r.b for r in found) and sum(r.n for r in found) == 200 and sum(r.n for r in found if r.a) == 50


def test_reports(spark, tmp_path):
    path = str(tmp_path / "r")
    matrix = spark.createDataFrame([(1, 1, 8), (1, 9, 2), (2, 2, 5)], "class_id int, prediction int, n long")
    reports.confusion_csv(matrix, path)
    rows = list(csv.reader(open(path)))
    assert rows[0] == ["", "Olive grove", "Cork/Holm oak montado", "class_9"] and rows[1] == ["Olive grove", "8", "0", "2"] and rows[3][0] == "class_9"
    from silvaspark.operators import classify

    reports.report_txt(classify.report(matrix), path)
    assert open(path).read().startswith("Overall accuracy: 86.7%")
    reports.importance_csv(spark.createDataFrame([("a", 0.25), ("b", 0.75)], "feature string, importance double"), path)
    assert [r[0] for r in csv.reader(open(path))] == ["feature", "b", "a"]
    reports.legend_csv(path)
    assert list(csv.reader(open(path)))[-1] == ["-1", "NoData", "0,0,0"]
    reports.style_qml(path)
    assert 'value="1" label="Olive grove" color="#ffc800"' in open(path).read()


def test_options():
    given = cli.parser().parse_args(["landscape", "--data", "x", "--max-depth", "none", "--n-estimators", "7"])
    assert given.max_depth is None and given.n_estimators == 7
    assert cli.parser().parse_args(["treetops", "--data", "x", "--radius_a", "0.7"]).radius_a == 0.7


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    """Five trees on sloping ground: two tiles each of surface and terrain, and points."""
    root = tmp_path_factory.mktemp("data")
    for name in ("surface", "terrain"):
        (root / name).mkdir()
        for k, (first, last) in enumerate(((0, 70), (60, 120))):  # tiles overlap
            meta = RasterMeta(META.x0, 0.5, META.y0 - 0.5 * first, -0.5, 120, last - first, META.crs, -9999.0)
            r, c = np.mgrid[first:last, 0:120]
            x, y = META.x0 + 0.5 * (c + 0.5), META.y0 - 0.5 * (r + 0.5)
            value = 100 + 0.1 * (x - 1000) + (height(x, y) if name == "surface" else 0)
            rows = list(zip((r - first).ravel().tolist(), c.ravel().tolist(), value.ravel().tolist(), strict=True))
            geotiff.write(spark.createDataFrame(rows, "row int, col int, value double"), str(root / name / f"t{k}.tif"), meta, None, "f8")
    rng = np.random.default_rng(5)
    x, y = rng.uniform(1000.5, 1059.5, 20_000), rng.uniform(2000.5, 2059.5, 20_000)
    up = height(x, y) * rng.choice([1.0, 0.3], 20_000, p=[0.8, 0.2])
    kind = np.where(up > 1, 5, 2)
    rows = [(k, "t", *map(float, p)) for k, p in enumerate(zip(x, y, up + 100 + 0.1 * (x - 1000), strict=True))]
    points = spark.createDataFrame([(*r, int(c), 50.0, 100.0, 100.0, 100.0, float(rng.integers(1000, 60000)), 1.0, 1.0) for r, c in zip(rows, kind, strict=True)], "point_id long, tile string, x double, y double, z double, classification int, intensity double, red double, green double, blue double, nir double, return_number double, number_of_returns double")
    points.write.parquet(str(root / "points"))
    return root


def test_from_tiles_to_correlation(spark, data):
    run = lambda *a: cli.main([a[0], "--data", str(data), *a[1:]], spark)
    out = f"{data}/processed"
    run("prepare")
    ndsm, meta = rasters.read(spark, f"{out}/ndsm")
    assert (meta.n_rows, meta.n_cols, meta.crs, meta.x0, meta.y0) == (120, 120, "EPSG:3763", 1000.0, 2060.0)
    assert ndsm.agg(F.max("value")).first()[0] == pytest.approx(15, abs=0.5)
    run("treetops", "--radius-a", "3", "--minheight", "5", "--mindist", "4")
    name = layers.names(spark, f"{out}/treetops")[0]
    tops = layers.read(spark, f"{out}/treetops", name).collect()
    assert len(tops) == 5 and all(min(np.hypot(t.x - a, t.y - b) for a, b, _ in TREES) < 2 for t in tops)
    run("crowns")
    crown = layers.names(spark, f"{out}/crowns")[0]
    shapes = layers.read(spark, f"{out}/crowns", crown)
    assert shapes.select("crown_id").distinct().count() == 5
    run("features")
    run("features")  # fields that are there are replaced
    full = layers.read(spark, f"{out}/crowns", crown)
    assert set(CROWN_FIELDS) < set(full.columns) and full.filter("n_points > 30 and mean_height > 1").count() >= 5
    assert geopackage.read(spark, f"{out}/crowns.gpkg").count() == full.count()
    run("correlation", "--min-points", "3")
    rows = list(csv.reader(open(f"{out}/correlation_{crown}_pearson_mp3.csv")))
    assert len(rows) == 11 and float(rows[1][1]) == pytest.approx(1)


def test_land_cover(spark, data):
    """Bands of two kinds of cover, training polygons of any shape, and all files of the stage."""
    root = data
    if not (root / "processed" / "mask").exists():
        cli.main(["prepare", "--data", str(root)], spark)
    (root / "scene").mkdir()
    rng = np.random.default_rng(3)
    for name in (*BANDS, "SCL"):
        side = 10.0 if name in BANDS[:4] else 20.0
        n = int(600 / side)
        meta = RasterMeta(1000.0 - 270, side, 2060.0 + 270, -side, n, n, "EPSG:3763", None)
        r, c = np.mgrid[0:n, 0:n]
        value = np.full((n, n), 4.0) if name == "SCL" else np.where(c < n / 2, 2000.0, 6000.0) + rng.normal(0, 100, (n, n))
        geotiff.write(spark.createDataFrame(list(zip(r.ravel().tolist(), c.ravel().tolist(), value.ravel().tolist(), strict=True)), "row int, col int, value double"), str(root / "scene" / f"x_{name.split('_')[0]}.tif"), meta, None, "f4", None)
    left = [[(740.0, 2320.0), (990.0, 2300.0), (980.0, 1750.0), (745.0, 1760.0)]]
    right = [[(1040.0, 2320.0), (1320.0, 2300.0), (1310.0, 1750.0), (1045.0, 1760.0)]]
    training = spark.createDataFrame([(1, "213", left), (2, " 311 ", right)], "fid long, type string, rings array<array<struct<x: double, y: double>>>")
    geopackage.write(training, str(root / "training.gpkg"), "areas", "EPSG:3763")
    # the vegetation mask covers all: every block of the fine mask has data
    wide = RasterMeta(730.0, 10.0, 2330.0, -10.0, 60, 60, "EPSG:3763", 255.0)
    mask = spark.range(3600).selectExpr("cast(id div 60 as int) as row", "cast(id % 60 as int) as col", "1.0D as value")
    rasters.write(mask, f"{root}/processed/mask", wide, 255.0, "short")
    cli.main(["landscape", "--data", str(root), "--n-estimators", "5", "--max-depth", "4"], spark)
    out = f"{root}/processed"
    scene, _ = rasters.read(spark, f"{out}/classification_ne5_md4_msl5_mt0.3")
    found = {(r.side, r.value): r.n for r in scene.groupBy((F.col("col") < 29).alias("side"), "value").agg(F.count("*").alias("n")).collect()}
    assert found[True, 1.0] > 1500 and found[False, 2.0] > 1500
    assert geotiff.header(f"{out}/sentinel2_stack.tif").names == list(BANDS)
    for name in [f"s2_{i}.tif" for i in INDICES] + ["confusion_matrix_ne5_md4_msl5_mt0.3.csv", "feature_importance_ne5_md4_msl5_mt0.3.csv", "classification_report_ne5_md4_msl5_mt0.3.txt", "classification_ne5_md4_msl5_mt0.3.qml"]:
        assert (root / "processed" / name).exists(), name
