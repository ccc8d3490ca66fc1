"""Crowns: seeds, watershed, holes, polygons as sets of cells, and cleaning of small ones."""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components, written
from .grid import EIGHT, FOUR, RasterMeta, neighbours, with_cell


def seeds(treetops: DataFrame, meta: RasterMeta, seed: str = "seed_id") -> DataFrame:
    """Seed cells: of the treetops in a cell the last one counts; ids go on for those outside."""
    return with_cell(treetops, meta).groupBy("row", "col").agg(F.max(seed).alias("seed_id"))


def cell_id(meta: RasterMeta):
    return (F.col("row").cast("long") * F.lit(meta.n_cols) + F.col("col")).alias("id")


def regions(cells: DataFrame, meta: RasterMeta, offsets=FOUR, value: str | None = None, tile: int = 256) -> DataFrame:
    """``cells`` with ``component``, the least cell number of its connected region (of equal ``value``).

    Cells are labelled within tiles first, each tile a group of bounded size; only links across
    tile borders, between labels, go through the distributed components.
    """
    keep = [] if value is None else [value]
    placed = cells.select("row", "col", *keep).withColumn("_tr", F.floor(F.col("row") / tile)).withColumn("_tc", F.floor(F.col("col") / tile))
    kind = f", {value} {cells.schema[value].dataType.simpleString()}" if value else ""
    n_cols = meta.n_cols

    def label(frame: pd.DataFrame) -> pd.DataFrame:
        number = frame["row"].to_numpy(np.int64) * n_cols + frame["col"].to_numpy(np.int64)
        frame = frame.iloc[np.argsort(number, kind="stable")]
        rows, cols = frame["row"].to_numpy(np.int64), frame["col"].to_numpy(np.int64)
        number = rows * n_cols + cols
        a, b = beside(rows, cols, [o for o in offsets if o > (0, 0)])
        if value:
            values = frame[value].to_numpy()
            same = values[a] == values[b]
            a, b = a[same], b[same]
        return frame[["row", "col", *keep]].assign(local=number[least(len(frame), a, b)])

    local = written(placed.groupBy("_tr", "_tc").applyInPandas(label, f"row int, col int{kind}, local long"), "regions")
    # a region never has more labels than tiles; only cells at a tile's border link them
    border = local.filter(f"row % {tile} in (0, {tile - 1}) or col % {tile} in (0, {tile - 1})")
    moved = neighbours(border.withColumnRenamed("local", "a"), offsets, ("a", *keep))
    links = moved.join(border.select("row", "col", *keep, F.col("local").alias("b")), ["row", "col", *keep]).filter("a <> b").select("a", "b")
    names = components(local.select(F.col("local").alias("id")).distinct(), links)
    return local.join(names.withColumnRenamed("id", "local"), "local").select("row", "col", *keep, "component")


def beside(rows: np.ndarray, cols: np.ndarray, offsets) -> tuple[np.ndarray, np.ndarray]:
    """The places of cells and of those of their neighbours that are there; cells are sorted by row and column, and differ."""
    span = int(cols.max(initial=0) - cols.min(initial=0)) + 3
    key = rows * span + (cols - cols.min(initial=0) + 1)
    found = []
    for dr, dc in offsets:
        to = key + dr * span + dc
        at = np.searchsorted(key, to)
        at[at == len(key)] = 0
        hit = np.flatnonzero(key[at] == to)
        found.append((hit, at[hit]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def least(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` places the least one that links ``a``, ``b`` reach: roots take lesser roots, then paths are halved."""
    parent = np.arange(n)
    while len(a):
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
    return parent


def watershed(relief: DataFrame, seed_cells: DataFrame, meta: RasterMeta, compactness: float = 0.001) -> DataFrame:
    """Labels ``row, col, crown_id`` by flooding from seeds over ``relief`` (row, col, value), lowest first.

    Water spreads to eight neighbours and never leaves the mask, so regions of the mask flood apart.
    With a compactness the price of a cell is its value plus that many times the distance to its
    seed. Equal prices go by age; seeds start in the order of rows and columns. Cells that no
    seed reaches have 0; seeds outside the mask are dropped; seed ids are positive. A closed canopy is one region, and
    its flood, which goes cell by cell, one task.
    """
    cells = regions(relief, meta, EIGHT).join(relief.select("row", "col", F.col("value").cast("float").cast("double").alias("value")), ["row", "col"])
    marked = cells.join(seed_cells.select("row", "col", "seed_id"), ["row", "col"], "left").select("component", "row", "col", "value", "seed_id")

    def flood(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["row", "col"])
        row, col = frame["row"].to_numpy(np.int64), frame["col"].to_numpy(np.int64)
        n = len(frame)
        around = np.full((n, len(EIGHT)), -1)
        for k, offset in enumerate(EIGHT):
            a, b = beside(row, col, [offset])
            around[a, k] = b
        near, value, rows, cols = around.tolist(), frame["value"].tolist(), row.tolist(), col.tolist()
        label, queue = [0] * n, []
        for i, s in enumerate(frame["seed_id"].tolist()):
            if s == s and s is not None:
                queue.append((value[i], len(queue), i, int(s), i))
        heapq.heapify(queue)
        age = len(queue)
        while queue:
            _, _, i, s, of = heapq.heappop(queue)
            if label[i]:
                continue
            label[i] = s
            r0, c0 = rows[of], cols[of]
            for j in near[i]:
                if j >= 0 and not label[j]:
                    price = value[j] + compactness * ((rows[j] - r0) ** 2 + (cols[j] - c0) ** 2) ** 0.5
                    heapq.heappush(queue, (price, age, j, s, of))
                    age += 1
        return pd.DataFrame({"row": frame["row"], "col": frame["col"], "crown_id": label}).astype({"row": "int32", "col": "int32", "crown_id": "int32"})

    return marked.groupBy("component").applyInPandas(flood, "row int, col int, crown_id int")


def fill_holes(segments: DataFrame, meta: RasterMeta) -> DataFrame:
    """Background regions off the raster's border that touch one crown only get its id: ``row, col, crown_id``.

    ``segments`` has every cell; background is 0. All holes are judged on the unfilled labels.
    """
    background = segments.filter("crown_id = 0").select("row", "col")
    holes = regions(background, meta)
    edge = F.max(((F.col("row") == 0) | (F.col("col") == 0) | (F.col("row") == meta.n_rows - 1) | (F.col("col") == meta.n_cols - 1)).cast("int"))
    inner = holes.groupBy("component").agg(edge.alias("_edge")).filter("_edge = 0").select("component")
    beside = neighbours(holes.join(inner, "component", "left_semi"), FOUR, ("component",)).join(segments.filter("crown_id > 0"), ["row", "col"])
    single = beside.groupBy("component").agg(F.min("crown_id").alias("fill"), F.max("crown_id").alias("_most")).filter("fill = _most").select("component", "fill")
    filled = holes.join(single, "component").select("row", "col", "fill")
    return segments.join(filled, ["row", "col"], "left").select("row", "col", F.coalesce("fill", "crown_id").cast("int").alias("crown_id"))


def hole_counts(segments: DataFrame, meta: RasterMeta) -> DataFrame:
    """How many background regions are ``filled``, ``left`` (several crowns or none beside them) or at the ``edge``: ``action, n``."""
    holes = regions(segments.filter("crown_id = 0").select("row", "col"), meta)
    edge = ((F.col("row") == 0) | (F.col("col") == 0) | (F.col("row") == meta.n_rows - 1) | (F.col("col") == meta.n_cols - 1)).cast("int")
    at_edge = holes.groupBy("component").agg(F.max(edge).alias("_edge"))
    beside = neighbours(holes, FOUR, ("component",)).join(segments.filter("crown_id > 0"), ["row", "col"]).groupBy("component").agg((F.min("crown_id") == F.max("crown_id")).alias("_one"))
    action = F.when(F.col("_edge") == 1, "edge").when(F.col("_one"), "filled").otherwise("left")
    return at_edge.join(beside, "component", "left").groupBy(action.alias("action")).agg(F.count("*").alias("n"))


def action_counts(cleaned: DataFrame) -> DataFrame:
    """How many small polygons ``clean_small`` merged and removed: ``action, n``."""
    return cleaned.filter("action is not null").groupBy("action").agg(F.count("*").alias("n"))


def distinct_ids(cells: DataFrame, column: str = "crown_id") -> DataFrame:
    """The number of different ids other than background: ``n``."""
    return cells.filter(F.col(column) > 0).agg(F.count_distinct(column).alias("n"))


def polygonise(segments: DataFrame, meta: RasterMeta) -> DataFrame:
    """Crown cells ``fid, crown_id, row, col``: a polygon is a region of cells with one id that share edges; fid is its least cell."""
    cells = regions(segments.filter("crown_id > 0"), meta, FOUR, "crown_id")
    return cells.select(F.col("component").alias("fid"), "crown_id", "row", "col")


def shared_edges(cells: DataFrame, corners: bool = True) -> DataFrame:
    """Pairs of polygons ``fid``, ``other`` that share an edge of a cell.

    With ``corners`` False, pairs that touch at a corner too, apart from their common edges, do not count.
    """
    beside = neighbours(cells.select("row", "col", "fid"), FOUR, ("fid",))
    pairs = beside.join(cells.select("row", "col", F.col("fid").alias("other")), ["row", "col"]).filter("fid <> other").select("fid", "other").distinct()
    if corners:
        return pairs
    # corners of cells are numbered by row and column; a side has two
    spots = lambda spread: F.explode(F.array(*[F.struct((F.col("row") + r).alias("r"), (F.col("col") + c).alias("c")) for r, c in spread]))
    own = cells.select("fid", spots([(0, 0), (0, 1), (1, 0), (1, 1)]).alias("p")).select("fid", "p.r", "p.c").distinct()
    touch = own.join(own.withColumnRenamed("fid", "other"), ["r", "c"]).filter("fid <> other")
    ends = None
    for (dr, dc), spread in (((0, 1), [(0, 0), (1, 0)]), ((1, 0), [(0, 0), (0, 1)])):  # the neighbour's side towards the cell
        one = cells.select((F.col("row") + dr).alias("row"), (F.col("col") + dc).alias("col"), "fid").join(cells.select("row", "col", F.col("fid").alias("other")), ["row", "col"]).filter("fid <> other")
        part = one.select("fid", "other", spots(spread).alias("p")).select("fid", "other", "p.r", "p.c")
        both = part.union(part.select(F.col("other").alias("fid"), F.col("fid").alias("other"), "r", "c"))
        ends = both if ends is None else ends.union(both)
    apart = touch.join(ends.distinct(), ["fid", "other", "r", "c"], "left_anti").select("fid", "other").distinct()
    return pairs.join(apart, ["fid", "other"], "left_anti")


def outlines(cells: DataFrame, meta: RasterMeta) -> DataFrame:
    """Polygons made of cells as ``fid, crown_id, rings``: the outer ring first, then holes, in the raster's coordinates.

    Only sides of cells without a cell of the same polygon beside them go into a task, so a task
    holds the outline of one polygon. Inside lies on the left; where two corners touch, rings part.
    """
    placed = cells.select("fid", "crown_id", "row", "col")
    own = placed.select("fid", F.col("row").alias("_row"), F.col("col").alias("_col"))
    # a side runs from corner to corner (row, column), with the cell on its left
    sides = [((-1, 0), (0, 1), (0, 0)), ((0, -1), (0, 0), (1, 0)), ((1, 0), (1, 0), (1, 1)), ((0, 1), (1, 1), (0, 1))]
    every = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("dr", "dc", "r0", "c0", "r1", "c1"), (*d, *a, *b), strict=True)]) for d, a, b in sides]))
    spread = placed.withColumn("s", every).withColumn("_row", F.col("row") + F.col("s.dr")).withColumn("_col", F.col("col") + F.col("s.dc"))
    rim = spread.join(own, ["fid", "_row", "_col"], "left_anti").select("fid", "crown_id", *[(F.col(axis) + F.col(f"s.{axis[0]}{k}")).alias(f"{axis[0]}{k}") for k in (0, 1) for axis in ("row", "col")])

    def chain(frame: pd.DataFrame) -> pd.DataFrame:
        after: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        for r0, c0, r1, c1 in zip(frame["r0"].tolist(), frame["c0"].tolist(), frame["r1"].tolist(), frame["c1"].tolist(), strict=True):
            after[r0, c0].append((r1, c1))
        rings = []
        for start in sorted(after):
            while after[start]:
                ring, at, to = [start], start, after[start].pop()
                while to != start:
                    step = (to[0] - at[0], to[1] - at[1])
                    at = to
                    ring.append(at)
                    # of two ways the one that turns left, so that rings that touch part there
                    ways = after[at]
                    left = (at[0] - step[1], at[1] + step[0])
                    to = ways.pop(ways.index(left)) if len(ways) > 1 and left in ways else ways.pop()
                rings.append(ring)
        corners = [[p for k, p in enumerate(ring) if (p[0] - ring[k - 1][0]) * (ring[(k + 1) % len(ring)][1] - p[1]) != (p[1] - ring[k - 1][1]) * (ring[(k + 1) % len(ring)][0] - p[0])] for ring in rings]
        size = lambda ring: abs(sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(ring, ring[1:] + ring[:1], strict=True)))
        corners.sort(key=lambda ring: (-size(ring), ring))
        shape = [[(meta.x0 + c * meta.px_w, meta.y0 + r * meta.px_h) for r, c in ring] for ring in corners]
        return pd.DataFrame({"fid": [frame["fid"].iloc[0]], "crown_id": [frame["crown_id"].iloc[0]], "rings": [[[{"x": x, "y": y} for x, y in ring] for ring in shape]]})

    return rim.groupBy("fid").applyInPandas(chain, "fid long, crown_id int, rings array<array<struct<x: double, y: double>>>")


def polygon_measures(cells: DataFrame, pixel: float) -> DataFrame:
    """Area and extent of polygons made of cells."""
    return cells.groupBy("fid").agg(F.first("crown_id").alias("crown_id"), (F.count("*") * pixel * pixel).alias("area"), F.min("row").alias("row0"), F.max("row").alias("row1"), F.min("col").alias("col0"), F.max("col").alias("col1"))


def clean_small(cells: DataFrame, pixel: float, min_area: float = 1.0) -> DataFrame:
    """Small polygons (area up to ``min_area``) join their only edge neighbour, or go: ``fid, crown_id, row, col, action``.

    They go in the order of fid, each looked at beside the polygons of that moment; what joins
    is the shape that the small polygon had at first. So a small polygon changes what others see
    only for those that touch it: groups are linked by edges between small ones alone, and a
    large polygon takes part in each group by its cells beside it.
    """
    areas = cells.groupBy("fid").agg((F.count("*") * pixel * pixel).alias("_area"))
    sized = written(cells.join(areas, "fid").withColumn("small", F.col("_area") <= min_area).drop("_area"), "clean")
    small = sized.filter("small")
    near = shared_edges(small)
    groups = components(small.select(F.col("fid").alias("id")).distinct(), near.select(F.col("fid").alias("a"), F.col("other").alias("b")))
    own = written(small.join(groups.withColumnRenamed("id", "fid"), "fid").select("component", "fid", "row", "col", "small"), "clean-groups")
    rim = neighbours(own.select("row", "col", "component"), FOUR, ("component",)).distinct().join(sized.filter("not small"), ["row", "col"])
    part = own.unionByName(rim.select("component", "fid", "row", "col", "small"))

    def replay(frame: pd.DataFrame) -> pd.DataFrame:
        at: dict[tuple[int, int], set[int]] = defaultdict(set)
        shape: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for f, r, c in zip(frame["fid"], frame["row"], frame["col"], strict=True):
            at[r, c].add(f)
            shape[f].append((r, c))
        now = {f: list(s) for f, s in shape.items()}
        order = sorted(set(frame.loc[frame["small"], "fid"]))
        actions = {}
        for f in order:
            touching = {g for r, c in shape[f] for dr, dc in FOUR for g in at.get((r + dr, c + dc), ()) if g != f}
            for rc in now.pop(f):
                at[rc].discard(f)
            if len(touching) == 1:
                to = touching.pop()
                for rc in shape[f]:
                    if to not in at[rc]:
                        at[rc].add(to)
                        now[to].append(rc)
                actions[f] = "merged"
            else:
                actions[f] = "removed"
        small_cells = {rc for f in order for rc in shape[f]}
        out = [(g, r, c) for g, cs in now.items() for r, c in cs if (r, c) in small_cells]
        rows = [(int(g), int(r), int(c), None) for g, r, c in out] + [(int(f), -1, -1, a) for f, a in actions.items()]
        return pd.DataFrame(rows, columns=["fid", "row", "col", "action"]).astype({"fid": "int64", "row": "int32", "col": "int32", "action": object})

    done = written(part.groupBy("component").applyInPandas(replay, "fid long, row int, col int, action string"), "clean-replay")
    ids = sized.select("fid", "crown_id").distinct()
    gained = done.filter("action is null").join(ids, "fid").select("fid", "crown_id", "row", "col", F.lit(None).cast("string").alias("action"))
    actions = done.filter("action is not null").join(ids, "fid").select("fid", "crown_id", F.lit(None).cast("int").alias("row"), F.lit(None).cast("int").alias("col"), "action")
    return sized.filter("not small").select("fid", "crown_id", "row", "col", F.lit(None).cast("string").alias("action")).unionByName(gained).unionByName(actions)
