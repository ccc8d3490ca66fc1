"""A quality classifier: regularised quadratic discriminant over document statistics.

Means and covariances of both classes are sums over all labelled rows of the training split,
made by aggregates. Each covariance is shrunk towards the pooled diagonal; the driver factors the
two small matrices once (Cholesky), and a score is the difference of the two Gaussian
log densities, from Mahalanobis lengths under the cached factors, as a probability.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, map_slices, texts_of, written

STATISTICS = (
    "log_chars", "upper", "digits", "punctuation", "symbols", "exclamation", "bars", "spaces", "lines",
    "word_length", "word_spread", "long_words", "distinct_words", "repeated_lines", "compression", "high_bytes",
)
SYMBOLS = b"#$%&*@^~<>{}[]\\+=_"
PUNCTUATION = b".,;:?'\"()-/!"


def statistics(text: str) -> list[float]:
    """The transformed statistics of a whole text; all 0 for an empty one."""
    if not text:
        return [0.0] * len(STATISTICS)
    raw = text.encode()
    of = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n, words, lines = len(text), text.split(), text.split("\n")
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    upper, lower = of[65:91].sum(), of[97:123].sum()
    share = lambda x: float(np.sqrt(x / len(raw)))
    return [
        float(np.log1p(n)),
        float(np.sqrt(upper / max(1, upper + lower))),
        share(of[48:58].sum()),
        share(of[list(PUNCTUATION)].sum()),
        share(of[list(SYMBOLS)].sum()),
        share(of[ord("!")]),
        share(of[ord("|")]),
        share(of[32] + of[9:14].sum()),
        float(np.log1p(100 * (len(lines) - 1) / n)),
        float(np.log1p(lengths.mean())),
        float(np.log1p(lengths.std())),
        float(np.sqrt((lengths > 15).mean())),
        float(np.log1p(len(set(words))) / np.log1p(len(words))) if words else 0.0,
        float(np.sqrt(1 - len(set(lines)) / len(lines))),
        float(np.log(min(1.5, (len(zlib.compress(raw, 1)) + 1) / (len(raw) + 1)))),
        share(of[128:].sum()),
    ]


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and ``x``, the array of a row's statistics; null texts count as empty."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([statistics(t) for t in texts_of(batch)], pa.list_(pa.float64()))], names=["doc_id", "x"])

        return run

    return map_slices(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), make, "doc_id long, x array<double>")


@dataclass
class Discriminant:
    """Per class: prior, mean, inverse Cholesky factor and half log determinant of the covariance."""

    classes: list[tuple[float, np.ndarray, np.ndarray, float]]
    constant: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 for rows of statistics."""
        if self.constant is not None:
            return np.full(len(x), self.constant)
        log = [np.log(prior) - half - 0.5 * np.square((x - mean) @ inverse.T).sum(axis=1) for prior, mean, inverse, half in self.classes]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def fit(stats: DataFrame, labels: DataFrame, shrinkage: float = 0.1) -> Discriminant:
    """Fit on every labelled row outside the held-out split; its sums are one aggregate by class.

    With one class only, the score is that class; without labels it is 0.5.
    """
    d = len(STATISTICS)
    truth = labels.filter("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("y"))
    rows = stats.filter(~held_out()).join(truth, "doc_id").select("y", *[F.col("x")[i].alias(f"x{i}") for i in range(d)])
    sums = [F.count("*").alias("n"), *[F.avg(f"x{i}").alias(f"m{i}") for i in range(d)], *[F.covar_pop(f"x{i}", f"x{j}").alias(f"c{i}_{j}") for i in range(d) for j in range(i + 1)]]
    found = {r["y"]: r for r in rows.groupBy("y").agg(*sums).collect()}
    if len(found) < 2:
        return Discriminant([], float(next(iter(found), 0.5)))
    total = sum(r["n"] for r in found.values())
    covariances = {}
    for y, r in found.items():
        lower = np.array([[r[f"c{max(i, j)}_{min(i, j)}"] for j in range(d)] for i in range(d)], float)
        covariances[y] = lower
    pooled = sum(found[y]["n"] / total * covariances[y] for y in (0, 1))
    target = np.diag(np.diag(pooled) + 1e-4)
    classes = []
    for y in (0, 1):
        # a class of few rows leans further on the pooled diagonal
        lean = max(shrinkage, d / (d + found[y]["n"]))
        factor = np.linalg.cholesky((1 - lean) * covariances[y] + lean * target)
        classes.append((found[y]["n"] / total, np.array([found[y][f"m{i}"] for i in range(d)]), np.linalg.inv(factor), float(np.log(np.diag(factor)).sum())))
    return Discriminant(classes)


def score(docs: DataFrame, labels: DataFrame, shrinkage: float = 0.1, keep_from: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row: 1 from ``keep_from`` on.

    Statistics are made in one scan and written as a narrow table, which serves the fit and the
    scores. Null texts are empty; an empty text is scored like any other. Rows with equal or null
    doc_id each give a row; a doc_id with several labels counts as 1 if one of them is. An empty
    table gives no rows. Other columns are ignored, whatever their names.
    """
    stats = written(document_statistics(docs), "quality-statistics")
    model = fit(stats, labels, shrinkage)

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = np.array(batch.column("x").to_pylist(), float).reshape(-1, len(STATISTICS))
            p = model.score(x)
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p, pa.float64()), pa.array((p >= keep_from).astype(np.int32), pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

        return run

    return map_slices(stats.select("doc_id", held_out().alias("held_out"), "x"), make, "doc_id long, held_out boolean, score double, predicted int", 8192)
