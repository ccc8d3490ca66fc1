import random

import pytest
from pyspark.sql import functions as F

from silvaspark.functions import geometry
from silvaspark.operators import crowns, features, points, raster, spatial, treetops
from silvaspark.operators.graph import components
from silvaspark.operators.grid import EIGHT, FOUR, RasterMeta, dilate, with_cell

META = RasterMeta(0.0, 1.0, 0.0, 1.0, 12, 12)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def grid(spark, cells, columns="row int, col int, crown_id int"):
    return spark.createDataFrame(cells, columns)


def flood_regions(cells, offsets):
    """Regions of equal value by a plain search."""
    value, found = {(r, c): v for r, c, v in cells}, {}
    for start in sorted(value):
        if start in found:
            continue
        todo, found[start] = [start], start
        while todo:
            r, c = todo.pop()
            for dr, dc in offsets:
                to = (r + dr, c + dc)
                if to in value and to not in found and value[to] == value[start]:
                    found[to] = start
                    todo.append(to)
    return found


def test_cells_are_cut_towards_zero(spark):
    p = spark.createDataFrame([(-0.7, 0.5), (-1.2, 0.5), (11.9, 3.0), (12.0, 3.0)], "x double, y double")
    assert rows(with_cell(p, META).select("x", "row", "col")) == [(-0.7, 0, 0), (11.9, 3, 11)]


def test_north_up_rows(spark):
    p = spark.createDataFrame([(0.5, 9.5), (0.5, 0.5)], "x double, y double")
    assert rows(with_cell(p, RasterMeta(0, 1, 10, -1, 1, 10)).select("y", "row")) == [(0.5, 9), (9.5, 0)]


def test_dilation_is_a_diamond_and_is_clipped(spark):
    found = rows(dilate(grid(spark, [(0, 0), (6, 6)], "row int, col int"), META))
    expected = sorted({(r, c) for r in range(12) for c in range(12) if r + c <= 2 or abs(r - 6) + abs(c - 6) <= 2})
    assert found == expected


def test_components_of_random_graphs(spark):
    rng = random.Random(1)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)]
    nodes = sorted({x for e in links for x in e} | {999})
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    found = dict(rows(components(spark.createDataFrame([(n,) for n in nodes], "id long"), spark.createDataFrame(links, "a long, b long"))))
    assert found == {n: find(n) for n in nodes}


@pytest.mark.parametrize("offsets", [FOUR, EIGHT])
def test_regions_across_tiles(spark, offsets):
    rng = random.Random(2)
    cells = [(r, c, rng.randint(0, 1)) for r in range(12) for c in range(12)]
    found = {(r, c): k for r, c, _, k in rows(crowns.regions(grid(spark, cells), META, offsets, "crown_id", tile=5))}
    assert found == {at: s[0] * 12 + s[1] for at, s in flood_regions(cells, offsets).items()}


def test_holes(spark):
    label = {(r, c): 0 for r in range(12) for c in range(12)}
    label |= {(r, c): 1 for r in range(1, 6) for c in range(1, 6)} | {(r, c): 2 for r in range(6, 10) for c in range(1, 6)}
    label |= {(3, 3): 0, (6, 3): 0, (5, 3): 0}  # one hole in crown 1, one between 1 and 2
    label |= {(0, 8): 3, (1, 7): 3, (1, 9): 3, (2, 8): 3, (1, 8): 0}
    found = {(r, c): k for r, c, k in rows(crowns.fill_holes(grid(spark, [(*k, v) for k, v in label.items()]), META))}
    assert found[3, 3] == 1 and found[6, 3] == 0 and found[5, 3] == 0 and found[1, 8] == 3 and found[0, 0] == 0


def test_diagonal_parts_are_two_polygons_of_one_crown(spark):
    found = rows(crowns.polygonise(grid(spark, [(0, 0, 7), (1, 1, 7), (1, 2, 7)]), META))
    assert found == [(0, 7, 0, 0), (13, 7, 1, 1), (13, 7, 1, 2)]


def test_small_polygons(spark):
    big = [(0, 1, r, c) for r in range(4) for c in range(4)] + [(8, 2, r, c) for r in range(4) for c in range(5, 9)]
    small = [(4, 3, 0, 4), (48, 4, 4, 0), (100, 5, 8, 4), (60, 6, 5, 0)]  # two neighbours; one; none; beside 48
    found = crowns.clean_small(spark.createDataFrame(big + small, "fid long, crown_id int, row int, col int"), 1.0, 1.0)
    actions = {r.fid: r.action for r in found.filter("action is not null").collect()}
    # 48 has two neighbours (0 and 60) and goes; 60 then has none
    assert actions == {4: "removed", 48: "removed", 100: "removed", 60: "removed"}
    single = crowns.clean_small(spark.createDataFrame([*big, (48, 4, 4, 0)], "fid long, crown_id int, row int, col int"), 1.0, 1.0)
    assert (0, 1, 4, 0) in rows(single.filter("action is null").select("fid", "crown_id", "row", "col"))
    assert [r.action for r in single.filter("action is not null").collect()] == ["merged"]


def brute_flood(value, seeds, compactness):
    import heapq

    label, queue, age = {}, [], 0
    for at in sorted(seeds):
        if at in value:
            heapq.heappush(queue, (value[at], age, at, seeds[at], at))
            age += 1
    while queue:
        _, _, at, s, origin = heapq.heappop(queue)
        if at in label:
            continue
        label[at] = s
        for dr, dc in EIGHT:
            to = (at[0] + dr, at[1] + dc)
            if to in value and to not in label:
                price = value[to] + compactness * ((to[0] - origin[0]) ** 2 + (to[1] - origin[1]) ** 2) ** 0.5
                heapq.heappush(queue, (price, age, to, s, origin))
                age += 1
    return {at: label.get(at, 0) for at in value}


@pytest.mark.parametrize("compactness", [0.0, 0.001, 0.5])
def test_watershed_by_regions_is_the_whole_flood(spark, compactness):
    rng = random.Random(int(compactness * 1000))
    value = {(r, c): float(rng.randint(0, 63)) + rng.random() / 1024 // (1 / 4096) / 4096 for r in range(12) for c in range(12) if rng.random() < 0.7}
    seeds = {at: i + 1 for i, at in enumerate(sorted(rng.sample(sorted(value), 8)))}
    relief = spark.createDataFrame([(*k, v) for k, v in value.items()], "row int, col int, value double")
    found = {(r, c): k for r, c, k in rows(crowns.watershed(relief, spark.createDataFrame([(*k, v) for k, v in seeds.items()], "row int, col int, seed_id int"), META, compactness))}
    assert found == brute_flood(value, seeds, compactness)


def test_seeds_take_the_last(spark):
    tops = spark.createDataFrame([(1, 2.2, 3.3), (2, 2.9, 3.1), (3, 50.0, 1.0)], "seed_id int, x double, y double")
    assert rows(crowns.seeds(tops, META)) == [(3, 2, 2)]


def test_local_maxima_against_all_pairs(spark):
    rng = random.Random(3)
    cloud = [(i, rng.uniform(0, 20), rng.uniform(0, 20), float(rng.randint(2, 25))) for i in range(300)] + [(300, 5.0, 5.0, 30.0), (301, 7.0, 5.0, 29.0), (302, 5.0, 5.0, 30.0)]
    found = {r.point_id for r in treetops.local_maxima(spark.createDataFrame(cloud, "point_id long, x double, y double, z double")).collect()}
    expected = {i for i, x, y, z in cloud if not any(w > z and (x - u) ** 2 + (y - v) ** 2 <= (0.5 + 0.05 * z) ** 2 for _, u, v, w in cloud)}
    assert found == expected and {300, 302} <= found


def test_suppression_is_the_sequential_rule(spark):
    rng = random.Random(4)
    cloud = [(i, rng.uniform(0, 15), rng.uniform(0, 15), float(rng.randint(2, 12))) for i in range(150)] + [(900, 50.0, 0.0, 9.0), (901, 51.5, 0.0, 8.0), (902, 53.0, 0.0, 7.0), (903, 55.0, 0.0, 6.0)]
    kept = []
    for p in sorted(cloud, key=lambda p: (-p[3], p[0])):
        if all((p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2 >= 4.0 for q in kept):
            kept.append(p)
    found = treetops.suppress(spark.createDataFrame(cloud, "point_id long, x double, y double, z double"), 2.0, ("point_id",))
    assert {r.point_id for r in found.collect()} == {p[0] for p in kept}
    assert {900, 902, 903} <= {p[0] for p in kept} and 901 not in {p[0] for p in kept}


def test_numbers_follow_the_order(spark):
    tops = spark.createDataFrame([(5, 1.0, 1.0, 3.14159), (2, 2.0, 1.0, 9.0), (9, 3.0, 1.0, 9.0)], "point_id long, x double, y double, z double")
    assert rows(treetops.numbered(tops, ("point_id",)).select("tree_id", "height_m")) == [(1, 9.0), (2, 3.142), (3, 9.0)]
    assert rows(treetops.numbered(tops, ("z desc", "point_id")).select("tree_id", "x")) == [(1, 2.0), (2, 3.0), (3, 1.0)]


def test_mosaic_takes_the_last_tile_with_data(spark):
    tiles = spark.createDataFrame([(1, 0, 0, 5.0), (2, 0, 0, None), (1, 0, 1, 1.0), (2, 0, 1, 2.0)], "tile int, row int, col int, value double")
    assert rows(raster.mosaic(tiles)) == [(0, 0, 5.0), (0, 1, 2.0)]


def test_height_model_keeps_nodata(spark):
    s = spark.createDataFrame([(0, 0, 5.0), (0, 1, 1.0), (0, 2, None)], "row int, col int, value double")
    t = spark.createDataFrame([(0, 0, 2.0), (0, 1, 3.0), (0, 2, 1.0)], "row int, col int, value double")
    assert [tuple(r) for r in raster.height_model(s, t).orderBy("col").collect()] == [(0, 0, 3.0), (0, 1, 0.0), (0, 2, None)]
    with pytest.raises(ValueError, match="differ in size"):
        raster.height_model(s, t, metas=(META, RasterMeta(0, 1, 0, 1, 3, 3)))


def test_rasters_of_other_sizes(spark):
    src = spark.createDataFrame([(r, c, float(r * 10 + c)) for r in range(4) for c in range(4)], "row int, col int, value double")
    same = raster.bilinear(src, RasterMeta(0, 1, 0, 1, 4, 4), RasterMeta(0, 1, 0, 1, 4, 4))
    assert rows(same) == rows(src)
    half = {(r, c): v for r, c, v in rows(raster.bilinear(src, RasterMeta(0, 1, 0, 1, 4, 4), RasterMeta(0, 2, 0, 2, 2, 2)))}
    assert half[0, 0] == pytest.approx(5.5)


def test_places_go_round(spark):
    p = spark.createDataFrame([(0.0, 0.0), (60_000.0, -150_000.0), (-50_000.0, 90_000.0)], "x double, y double")
    there = geometry.reprojected(p.withColumns({"x0": F.col("x"), "y0": F.col("y")}), geometry.NATIONAL_GRID, geometry.UTM_29N)
    back = geometry.reprojected(there, geometry.UTM_29N, geometry.NATIONAL_GRID).collect()
    assert all(abs(r.x - r.x0) < 1e-3 and abs(r.y - r.y0) < 1e-3 for r in back)


def test_polygons_hold_points_strictly(spark):
    outer, hole = [(0.0, 0.0), (8.0, 0.0), (8.0, 8.0), (0.0, 8.0), (0.0, 0.0)], [(2.0, 2.0), (4.0, 2.0), (4.0, 4.0), (2.0, 4.0)]
    poly = spark.createDataFrame([(1, [outer, hole])], "fid long, rings array<array<struct<x: double, y: double>>>")
    p = spark.createDataFrame([(1.0, 1.0), (3.0, 3.0), (0.0, 5.0), (8.0, 8.0), (2.0, 3.0), (9.0, 1.0), (6.0, 4.0)], "x double, y double")
    assert rows(spatial.points_in_polygons(p, poly, 3.0).select("x", "y")) == [(1.0, 1.0), (6.0, 4.0)]
    assert poly.select(geometry.polygon_area(F.col("rings")).alias("a")).first().a == 60.0


def test_vertical_shares_of_flat_and_small_groups(spark):
    p = spark.createDataFrame([(1, 5.0), (1, 9.0), (2, 5.0), (2, 5.05), (2, 5.0), (3, 0.0), (3, 2.5), (3, 5.0), (3, 10.0)], "fid long, z double")
    found = {r[0]: tuple(r)[1:] for r in features.vertical(p).collect()}
    assert found == {1: (0.0, 1.0, 0.0), 2: (0.0, 1.0, 0.0), 3: (0.25, 0.25, 0.5)}


def test_colours_are_scaled_by_the_greatest_red(spark):
    wide = points.colours(spark.createDataFrame([(65535.0, 0.0), (0.0, 0.0)], "red double, nir double")).collect()
    assert sorted((r.red, r.ndvi) for r in wide) == [(0.0, 0.0), (1.0, -1.0)]
    narrow = points.colours(spark.createDataFrame([(200.0, 100.0)], "red double, nir double")).first()
    assert narrow.red == 200.0


def test_empty_tables(spark):
    none = spark.createDataFrame([], "point_id long, x double, y double, z double")
    assert treetops.local_maxima(points.without_outliers(none)).count() == 0
    assert treetops.suppress(none, 1.0, ("point_id",)).count() == 0
    assert crowns.fill_holes(spark.createDataFrame([], "row int, col int, crown_id int"), META).count() == 0
