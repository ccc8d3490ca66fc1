import sqlite3
import struct

import numpy as np
import pytest

from silvaspark.functions import spectral
from silvaspark.operators import classify, correlate
from silvaspark.params import Correlation, Crowns, Landscape, Treetops
from silvaspark.schema import BANDS
from silvaspark.sources import files, geopackage, las, layers


def test_names():
    assert Treetops().layer == "treetops_lidar_ra0.5_rb0.05_mh2.0_md_0.0"
    assert Crowns().layer("t") == "crowns_t_c0.001_mh2.0_ma1.0" and Crowns().raster("t") == "crown_segments_t_c0.001_mh2.0_ma1.0"
    assert Landscape().suffix == "ne200_mdNone_msl5_mt0.3" and Correlation().name("c") == "correlation_c_pearson_mp30"


def test_labels(spark):
    training = spark.createDataFrame([(1, " 311 "), (2, "213"), (3, "999"), (4, None)], "fid long, type string")
    assert {r.fid: r.class_id for r in classify.with_class(training).collect()} == {1: 2, 2: 1, 3: None, 4: None}
    assert classify.with_name(spark.createDataFrame([(9,)], "class_id int")).first().class_name == "class_9"


def test_indices_of_zero_denominators(spark):
    zero = spark.createDataFrame([tuple([0.0] * 10)], ", ".join(f"{b} double" for b in BANDS)).withColumns(spectral.indices()).first()
    assert zero.NDVI is None and zero.NBR is None and zero.EVI == 0.0


def test_scene_classes(spark):
    codes = spark.createDataFrame([(float(i),) for i in range(12)] + [(8.5,)], "scl double")
    assert [r.scl for r in codes.filter(spectral.scene_valid(codes.scl)).orderBy("scl").collect()] == [4.0, 5.0, 6.0, 7.0, 8.5]


def test_reasons_in_order(spark):
    rows = [(1, 50, 1.0), (0, None, 1.0), (0, 5, None), (0, 50, None), (None, 50, 1.0), (None, 3, 1.0)]
    found = correlate.reasons(spark.createDataFrame(rows, "is_edge int, n_points int, f double"), ["f"]).collect()
    assert [r.reason for r in found] == ["edge", "low_points", "low_points", "null", "used", "low_points"]


@pytest.mark.parametrize("method", ["pearson", "spearman"])
def test_correlations(spark, method):
    x = np.random.default_rng(1).normal(size=(200, 2)).round(1)
    frame = spark.createDataFrame([(float(a), float(a + b), 1.0) for a, b in x], "a double, b double, c double")
    found = {(r.feature_i, r.feature_j): r.r for r in correlate.correlations(frame, ["a", "b", "c"], method).collect()}
    import pandas as pd

    expected = pd.DataFrame({"a": x[:, 0], "b": x.sum(axis=1)})
    if method == "spearman":
        expected = pd.DataFrame([(r.a, r.b) for r in frame.collect()], columns=["a", "b"]).rank()
    assert found["a", "b"] == pytest.approx(expected.corr().loc["a", "b"]) and found["a", "a"] == pytest.approx(1.0) and found["a", "c"] is None


def test_report(spark):
    matrix = spark.createDataFrame([(1, 1, 8), (1, 2, 2), (2, 2, 5), (2, 1, 5)], "class_id int, prediction int, n long")
    found = {r["name"]: r for r in classify.report(matrix).collect()}
    assert found["1"].precision == pytest.approx(8 / 13) and found["2"].recall == 0.5 and found["accuracy"].f1 == pytest.approx(0.65) and found["macro avg"].recall == pytest.approx(0.65)


def test_forest_learns_what_is_apart(spark):
    rng = np.random.default_rng(2)
    rows = [(int(c), i, float(c + rng.normal(0, 0.2)), float(rng.normal())) for i, c in enumerate(rng.integers(1, 4, 240))]
    split = classify.stratified_split(spark.createDataFrame(rows, "class_id int, i int, u double, v double"), ("i",))
    model = classify.train_forest(split.filter("not is_test"), ["u", "v"], Landscape(n_estimators=10, max_depth=6))
    scored = classify.predict(model, split.filter("is_test"), ["u", "v"])
    assert scored.filter("class_id = prediction").count() / scored.count() > 0.9
    gap = classify.predict(model, spark.createDataFrame([(1.0, None)], "u double, v double"), ["u", "v"]).first()
    assert gap.prediction is None


def test_layers_replace_their_name_only(spark, tmp_path):
    folder = str(tmp_path / "layers")
    layers.write(spark.range(3), folder, "a")
    layers.write(spark.range(5), folder, "b")
    layers.write(layers.read(spark, folder, "a").filter("id > 0"), folder, "a")
    assert layers.names(spark, folder) == ["a", "b"]
    assert layers.read(spark, folder).count() == 2 and layers.read(spark, folder, "b").count() == 5
    with pytest.raises(ValueError, match="there are a, b"):
        layers.read(spark, folder, "c")


def test_listing(spark, tmp_path):
    for name in ("b.laz", "a.laz", "a.copc.laz", "x_B02.jp2"):
        (tmp_path / name).touch()
    assert [p.rsplit("/", 1)[-1] for p in files.find_point_tiles(spark, str(tmp_path))] == ["a.laz", "b.laz"]
    assert files.find_band_file(spark, str(tmp_path), "_B02.jp2").endswith("x_B02.jp2")
    with pytest.raises(FileNotFoundError):
        files.find_files(spark, f"{tmp_path}/*.tif")


def test_las_files(spark, tmp_path):
    head = bytearray(375)
    head[:4], head[24], head[25], head[104] = b"LASF", 1, 4, 8
    struct.pack_into("<I", head, 96, 375)
    struct.pack_into("<H", head, 105, 38)
    struct.pack_into("<6d", head, 131, 0.01, 0.01, 0.01, 100.0, 200.0, 0.0)
    struct.pack_into("<Q", head, 247, 2)
    record = lambda x, y, z, c: struct.pack("<iiiH", x, y, z, 77) + bytes([0x21, 0, c, 0]) + bytes(14 - 4) + struct.pack("<4H", 10, 20, 30, 40)
    points = [record(100, 200, 300, 5), record(-100, 0, 50, 2)]
    assert len(points[0]) <= 38
    points = [p[:18] + bytes(12) + struct.pack("<4H", 10, 20, 30, 40) for p in points]
    (tmp_path / "t.las").write_bytes(bytes(head) + b"".join(points))
    las.register(spark)
    found = spark.read.format("las").load(str(tmp_path)).orderBy("point_id").collect()
    assert [(r.x, r.y, r.z, r.classification, r.nir, r.return_number, r.number_of_returns) for r in found] == [(101.0, 202.0, 3.0, 5, 40.0, 1.0, 2.0), (99.0, 200.0, 0.5, 2, 40.0, 1.0, 2.0)]


def test_geopackages(spark, tmp_path):
    path = str(tmp_path / "l.gpkg")
    blob = b"GP\0\1" + struct.pack("<i", 3763) + struct.pack("<BI2d", 1, 1, 4.0, 5.0)
    with sqlite3.connect(path) as db:
        db.executescript("create table gpkg_contents (table_name text); create table gpkg_geometry_columns (table_name text, column_name text); insert into gpkg_contents values ('tops'); insert into gpkg_geometry_columns values ('tops', 'geom'); create table tops (fid integer primary key, geom blob, height_m real)")
        db.execute("insert into tops values (1, ?, 12.5), (2, null, 3.0)", (blob,))
    found = geopackage.read(spark, path).orderBy("fid").collect()
    assert [(r.fid, r.height_m, r.x, r.y) for r in found] == [(1, 12.5, 4.0, 5.0), (2, 3.0, None, None)]
    with pytest.raises(ValueError, match="there are tops"):
        geopackage.read(spark, path, "crowns")
