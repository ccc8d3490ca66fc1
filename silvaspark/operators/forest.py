"""A random forest whose trees are grown in tasks and stay in the shared folder; the driver never holds one.

Features become bins, ``BINS`` for each at most, between approximate percentiles of all rows. A task
gets the bins of all training rows, a byte for each feature and one for the class, and grows a few
trees level by level from histograms of nodes. So a task's memory grows with the training rows, by
about 12 bytes and 40 more while a tree is grown. To predict, each group of trees meets all rows, in
blocks, and the sums of a block's votes are added up.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import written

#: Bins of a feature, rows of a block, trees of a task, nodes whose histograms are made at once.
BINS, BLOCK, TREES, NODES = 64, 4096, 5, 2048


def _parts(total: np.ndarray) -> np.ndarray:
    """Sum of squares over sum of the last axis, 0 for nothing."""
    size = total.sum(axis=-1)
    return np.divide((total * total).sum(axis=-1), size, out=np.zeros_like(size), where=size > 0)


def grow(bins: np.ndarray, classes: np.ndarray, weights: np.ndarray, cuts: list[np.ndarray], seed: tuple[int, int], depth: int, least: int) -> dict:
    """A tree on a bootstrap of the rows: arrays of features (-1: a leaf), limits (at most: left), left children and class shares.

    The square root of the features, rounded up, is tried at a node; a leaf has ``least`` rows of the
    bootstrap or more. Splits lower the weighted Gini impurity most.
    """
    rng, n_features, n_classes = np.random.default_rng(seed), bins.shape[1], len(weights)
    times = rng.poisson(1.0, len(classes))
    rows = np.flatnonzero(times)
    node = np.zeros(len(rows), np.int64)
    tried, width = int(np.ceil(np.sqrt(n_features))), max([len(c) for c in cuts], default=0) + 1
    out: dict[str, list] = {"feature": [], "limit": [], "left": [], "share": []}
    gains, count, known = np.zeros(n_features), 1, 0
    for level in range(depth + 1):
        if not count:
            break
        b, y, t = bins[rows], classes[rows], times[rows].astype(np.float64)
        whole = np.bincount(node * n_classes + y, t, count * n_classes).reshape(count, n_classes)
        best, feature, at = np.zeros(count), np.full(count, -1), np.zeros(count, np.int64)
        open_ = (whole.sum(axis=1) >= 2 * least) & ((whole > 0).sum(axis=1) > 1) & (level < depth)
        chosen = rng.random((count, n_features)).argsort(axis=1)[:, :tried]
        starts = np.searchsorted(node, np.arange(count + 1))  # rows are in the order of their nodes
        for low in range(0, count, NODES):
            high = min(low + NODES, count)
            if not open_[low:high].any():
                continue
            part = slice(starts[low], starts[high])
            here, m = node[part] - low, high - low
            total = whole[low:high] * weights
            before = _parts(total)
            for k in range(tried):
                f = chosen[low:high, k]
                value = b[part][np.arange(len(here)), f[here]]
                left = np.bincount((here * width + value) * n_classes + y[part], t[part], m * width * n_classes).reshape(m, width, n_classes).cumsum(axis=1)
                n_left, n = left.sum(axis=2), whole[low:high].sum(axis=1)[:, None]
                left *= weights
                gain = _parts(left) + _parts(total[:, None] - left) - before[:, None]
                gain[(n_left < least) | (n - n_left < least) | ~open_[low:high, None]] = 0
                place = gain.argmax(axis=1)
                value_of = gain[np.arange(m), place]
                better = value_of > np.maximum(best[low:high], 1e-9)
                best[low:high][better], feature[low:high][better], at[low:high][better] = value_of[better], f[better], place[better]
        split = feature >= 0
        np.add.at(gains, feature[split], best[split])
        next_ = known + count
        order = np.cumsum(split) - 1
        limit = np.array([cuts[f][a] if f >= 0 else np.nan for f, a in zip(feature.tolist(), at.tolist(), strict=True)])
        total = whole * weights
        out["feature"].append(feature.astype(np.int16))
        out["limit"].append(limit)
        out["left"].append(np.where(split, next_ + 2 * order, 0))
        out["share"].append((total / np.maximum(total.sum(axis=1, keepdims=True), 1e-300)).astype(np.float32))
        stay = split[node]
        rows, node, b = rows[stay], node[stay], b[stay]
        child = 2 * order[node] + (b[np.arange(len(node)), feature[node]] > at[node])
        turn = np.argsort(child, kind="stable")
        rows, node = rows[turn], child[turn]
        known, count = next_, 2 * int(split.sum())
    return {k: np.concatenate(v) for k, v in out.items()} | {"gains": gains / gains.sum() if gains.any() else gains}


def shares(tree: dict, x: np.ndarray) -> np.ndarray:
    """The class shares of the leaf of each row."""
    at = np.zeros(len(x), np.int64)
    moving = np.arange(len(x))
    while len(moving):
        feature = tree["feature"][at[moving]]
        moving, feature = moving[feature >= 0], feature[feature >= 0]
        node = at[moving]
        at[moving] = tree["left"][node] + ~(x[moving, feature] <= tree["limit"][node])
    return tree["share"][at].astype(np.float64)


def _matrix(part: pa.RecordBatch, features: list[str]) -> np.ndarray:
    return np.stack([part.column(f).to_numpy(zero_copy_only=False) for f in features], axis=1).astype(np.float64)


def _blocks(rows: DataFrame, features: list[str], make: Callable[[pa.RecordBatch, np.ndarray], tuple[bytes, bytes]]) -> DataFrame:
    """``block``, ``a``, ``b``: two byte strings for each stretch of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK):
                part = batch.slice(low, BLOCK)
                a, b = make(part, _matrix(part, features))
                yield pa.RecordBatch.from_arrays([pa.array([part.column("_id")[0].as_py()], pa.int64()), pa.array([a], pa.binary()), pa.array([b], pa.binary())], names=["block", "a", "b"])

    return rows.mapInArrow(run, "block long, a binary, b binary")


def _numbered(rows: DataFrame, features: list[str]) -> DataFrame:
    return rows.select("*", F.monotonically_increasing_id().alias("_id")).withColumns({f: F.col(f).cast("double") for f in features})


@dataclass
class Forest:
    """A forest: ``trees`` is a table ``g, tree, data, gains`` in the shared folder."""

    trees: DataFrame
    features: list[str]
    classes: list[int]
    params: dict

    @property
    def getNumTrees(self) -> int:  # noqa: N802 - the name of the library's models
        return self.params["numTrees"]

    def getOrDefault(self, name: str) -> object:  # noqa: N802
        return self.params[name]

    def importances(self) -> list[float]:
        """Shares of the impurity that splits by each feature take away, the mean of the trees."""
        sums = self.trees.select(F.posexplode("gains").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v"))
        found = {r["k"]: r["v"] for r in sums.collect()}  # one row for a feature
        total = sum(found.values()) or 1.0
        return [found.get(k, 0.0) / total for k in range(len(self.features))]

    def votes(self, rows: DataFrame) -> DataFrame:
        """``_id``, ``prediction`` and ``confidence`` of rows with ``_id`` and complete features."""
        features, classes, groups = self.features, np.array(self.classes), -(-self.params["numTrees"] // TREES)
        blocks = written(_blocks(rows.select("_id", *features), features, lambda part, x: (part.column("_id").to_numpy().astype(np.int64).tobytes(), x.tobytes())), "forest-rows")
        spread = blocks.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select("g", "block", "a", "b")
        # a group's trees come before all blocks
        both = self.trees.select("g", F.lit(-1).cast("long").alias("block"), F.lit(b"").alias("a"), F.col("data").alias("b")).union(spread)
        dealt = both.repartitionById(groups, F.col("g")).sortWithinPartitions("g", "block")

        def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[dict] = []
            last = None
            for batch in batches:
                for g, block, a, b in zip(*(batch.column(k).to_pylist() for k in ("g", "block", "a", "b")), strict=True):
                    if g != last:
                        held, last = [], g
                    if block < 0:
                        held.append(pickle.loads(b))
                        continue
                    x = np.frombuffer(b, np.float64).reshape(-1, len(features))
                    total = sum(shares(tree, x) for tree in held)
                    yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([block], pa.int64()), pa.array([a], pa.binary()), pa.array([total.tobytes()], pa.binary())], names=["g", "block", "a", "b"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, total, last = b"", None, None

            def done() -> pa.RecordBatch:
                share = total / total.sum(axis=1, keepdims=True)
                return pa.RecordBatch.from_arrays([pa.array(np.frombuffer(ids, np.int64)), pa.array(classes[share.argmax(axis=1)], pa.int32()), pa.array(share.max(axis=1))], names=["_id", "prediction", "confidence"])

            for batch in batches:
                for block, a, b in zip(*(batch.column(k).to_pylist() for k in ("block", "a", "b")), strict=True):
                    some = np.frombuffer(b, np.float64).reshape(-1, len(classes))
                    if block == last:
                        total = total + some
                        continue
                    if last is not None:
                        yield done()
                    ids, total, last = a, some, block
            if last is not None:
                yield done()

        voted = dealt.mapInArrow(vote, "g int, block long, a binary, b binary")
        return voted.repartition("block").sortWithinPartitions("block", "g").mapInArrow(add, "_id long, prediction int, confidence double")


def train(rows: DataFrame, features: list[str], n_trees: int, depth: int, least: int, seed: int) -> Forest:
    """A forest on rows ``class_id, weight`` and complete features; ``weight`` is one number for a class."""
    kinds = rows.groupBy("class_id").agg(F.first("weight").alias("w")).orderBy("class_id").collect()  # one row for a class
    classes, weights = [r["class_id"] for r in kinds], np.array([r["w"] for r in kinds], float)
    if not classes:
        raise ValueError("no training rows")
    kept = written(_numbered(rows.select("class_id", *features), features), "forest-training")
    at = [k / BINS for k in range(1, BINS)]
    found = kept.agg(*[F.percentile_approx(f, at, 10_000).alias(f) for f in features]).first()
    cuts = [np.unique(found[f]) for f in features]

    def coded(part: pa.RecordBatch, x: np.ndarray) -> tuple[bytes, bytes]:
        bins = np.stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(cuts)], axis=1).astype(np.uint8)
        return bins.tobytes(), np.searchsorted(classes, part.column("class_id").to_numpy()).astype(np.uint16).tobytes()

    groups = -(-n_trees // TREES)
    blocks = written(_blocks(kept, features, coded), "forest-blocks")
    dealt = blocks.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).repartitionById(groups, F.col("g")).sortWithinPartitions("g", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, bytes]] = []
        last = None

        def trees(g: int) -> Iterator[pa.RecordBatch]:
            bins = np.frombuffer(b"".join([a for a, _ in held]), np.uint8).reshape(-1, len(features))
            kind = np.frombuffer(b"".join([b for _, b in held]), np.uint16)
            held.clear()
            for tree in range(g * TREES, min(n_trees, (g + 1) * TREES)):
                made = grow(bins, kind, weights, cuts, (seed, tree), depth, least)
                gains = made.pop("gains").tolist()
                yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([tree], pa.int32()), pa.array([pickle.dumps(made)], pa.binary()), pa.array([gains], pa.list_(pa.float64()))], names=["g", "tree", "data", "gains"])

        for batch in batches:
            for g, a, b in zip(*(batch.column(k).to_pylist() for k in ("g", "a", "b")), strict=True):
                if last is not None and g != last:
                    yield from trees(last)
                last = g
                held.append((a, b))
        if last is not None:
            yield from trees(last)

    grown = written(dealt.select("g", "a", "b").mapInArrow(run, "g int, tree int, data binary, gains array<double>"), "forest-trees")
    return Forest(grown, list(features), classes, {"numTrees": n_trees, "maxDepth": depth, "minInstancesPerNode": least})


def predict(model: Forest, rows: DataFrame) -> DataFrame:
    """``rows`` with ``confidence`` and ``prediction``; NULL where a feature is."""
    numbered = written(rows.withColumn("_id", F.monotonically_increasing_id()), "forest-scene")
    whole = numbered.select("_id", *[F.col(f).cast("double").alias(f) for f in model.features]).dropna(how="any")
    return numbered.join(model.votes(whole), "_id", "left").select(*rows.columns, "confidence", "prediction")
