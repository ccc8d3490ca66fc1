"""Small reports that the driver writes as text: one row for a class or feature, whatever the size of the scene."""

from __future__ import annotations

import csv
import io
import logging
import os
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import CLASSES

# The row and the colour of pixels without a class.
NODATA_ROW = (-1, "NoData", "0,0,0")
NAMES = {class_id: name for _, class_id, name, _ in CLASSES}


def logger(name: str, folder: str = "logs") -> logging.Logger:
    """Messages to the console as they are, and to a file of its own with times and levels."""
    found = logging.getLogger(f"silvaspark.{name}")
    found.setLevel(logging.DEBUG)
    if not found.handlers:
        os.makedirs(folder, exist_ok=True)
        path = os.path.join(folder, f"{datetime.now():%Y%m%d_%H%M%S}_{name}.log")
        console, file = logging.StreamHandler(), logging.FileHandler(path, encoding="utf-8")
        console.setLevel(logging.INFO)
        console.setFormatter(logging.Formatter("%(message)s"))
        file.setFormatter(logging.Formatter("%(asctime)s [%(levelname)s] %(message)s", "%Y-%m-%d %H:%M:%S"))
        found.addHandler(console)
        found.addHandler(file)
        found.info(f"Log: {path}")
    return found


def _save(path: str, text: str) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", newline="", encoding="utf-8") as f:
        f.write(text)


def _table(rows: list[tuple]) -> str:
    out = io.StringIO()
    csv.writer(out).writerows(rows)
    return out.getvalue()


def class_name(class_id: int) -> str:
    return NAMES.get(class_id, f"class_{class_id}")


def confusion_csv(matrix: DataFrame, path: str) -> None:
    """Counts of true classes (rows) and predictions, for the classes that occur; a blank corner."""
    counts = {(r["class_id"], r["prediction"]): r["n"] for r in matrix.collect()}
    ids = sorted({i for pair in counts for i in pair if i is not None})
    _save(path, _table([("", *map(class_name, ids)), *[(class_name(i), *[counts.get((i, j), 0) for j in ids]) for i in ids]]))


def importance_csv(importances: DataFrame, path: str) -> None:
    """Features and their importance to 6 places, the greatest first."""
    rows = sorted(((r["feature"], r["importance"]) for r in importances.collect()), key=lambda r: -r[1])
    _save(path, _table([("feature", "importance"), *[(f, round(v, 6)) for f, v in rows]]))


def report_txt(report: DataFrame, path: str) -> None:
    """The accuracy, then precision, recall, F1 and support of each class and their means."""
    rows = {r["name"]: r for r in report.collect()}
    accuracy = rows["accuracy"]
    kinds = sorted((n for n in rows if n.lstrip("-").isdigit()), key=int)
    label = {n: class_name(int(n)) for n in kinds}
    wide = max(len("weighted avg"), *[len(v) for v in label.values()]) if label else len("weighted avg")
    line = lambda name, *cells: f"{name:>{wide}} " + " ".join(f"{c:>9}" for c in cells) + "\n"
    scores = lambda r: (f"{r['precision']:.2f}", f"{r['recall']:.2f}", f"{r['f1']:.2f}", r["support"])
    text = f"Overall accuracy: {100 * accuracy['f1']:.1f}%\n\n" + line("", "precision", "recall", "f1-score", "support") + "\n"
    text += "".join(line(label[n], *scores(rows[n])) for n in kinds) + "\n" + line("accuracy", "", "", f"{accuracy['f1']:.2f}", accuracy["support"])
    _save(path, text + "".join(line(n, *scores(rows[n])) for n in ("macro avg", "weighted avg")))


def legend_csv(path: str) -> None:
    _save(path, _table([("class_id", "class_name", "color_rgb"), *[(i, name, rgb) for _, i, name, rgb in CLASSES], NODATA_ROW]))


def style_qml(path: str) -> None:
    """A style of unique values for the class raster: a palette with the classes' names and colours, nodata clear."""
    entries = []
    for class_id, name, rgb in [(i, name, rgb) for _, i, name, rgb in CLASSES] + [NODATA_ROW]:
        colour = "#" + "".join(f"{int(v):02x}" for v in rgb.split(","))
        entries.append(f'<paletteEntry value="{class_id}" label="{name}" color="{colour}" alpha="{0 if class_id < 0 else 255}"/>')
    body = "".join(f"\n        {e}" for e in entries)
    _save(path, f"<!DOCTYPE qgis>\n<qgis styleCategories=\"Symbology\">\n  <pipe>\n    <rasterrenderer type=\"paletted\" band=\"1\" opacity=\"1\">\n      <colorPalette>{body}\n      </colorPalette>\n    </rasterrenderer>\n  </pipe>\n</qgis>\n")


def correlation_csv(matrix: DataFrame, features: list[str], path: str) -> None:
    """The matrix to 4 places; empty cells beside a constant feature."""
    cells = {(r["feature_i"], r["feature_j"]): r["r"] for r in matrix.collect()}
    show = lambda v: "" if v is None else round(v, 4)
    _save(path, _table([("", *features), *[(a, *[show(cells.get((a, b))) for b in features]) for a in features]]))


def heatmap_svg(matrix: DataFrame, features: list[str], title: str, path: str, threshold: float = 0.8) -> None:
    """A picture of the matrix: red above and blue below 0, each cell with its number, strong pairs framed."""
    cells, side, left = {(r["feature_i"], r["feature_j"]): r["r"] for r in matrix.collect()}, 64, 150
    shade = lambda r: "#dddddd" if r is None else f"rgb({int(255 * (1 + min(r, 0)))},{int(255 * (1 - abs(r)))},{int(255 * (1 - max(r, 0)))})"
    parts = [f'<text x="10" y="20" font-size="15">{title}</text>']
    for i, a in enumerate(features):
        parts.append(f'<text x="{left - 6}" y="{60 + side * i + side / 2}" text-anchor="end" font-size="11">{a}</text>')
        parts.append(f'<text x="{left + side * i + side / 2}" y="{72 + side * len(features)}" text-anchor="end" font-size="11" transform="rotate(-45 {left + side * i + side / 2} {72 + side * len(features)})">{a}</text>')
        for j, b in enumerate(features):
            r = cells.get((a, b))
            frame = 'stroke="black" stroke-width="2"' if r is not None and i != j and abs(r) > threshold else 'stroke="white"'
            parts.append(f'<rect x="{left + side * j}" y="{50 + side * i}" width="{side}" height="{side}" fill="{shade(r)}" {frame}/>')
            parts.append(f'<text x="{left + side * j + side / 2}" y="{50 + side * i + side / 2 + 4}" text-anchor="middle" font-size="11">{"" if r is None else f"{r:.2f}"}</text>')
    size = left + side * len(features) + 20
    _save(path, f'<svg xmlns="http://www.w3.org/2000/svg" width="{size}" height="{size + 60}" font-family="sans-serif">' + "".join(parts) + "</svg>\n")


def extremes(raster: DataFrame, columns: list[str]) -> dict[str, tuple[float | None, float | None]]:
    """Least and greatest value of each column, by one aggregate."""
    row = raster.agg(*[f(c).alias(f"{c}_{k}") for c in columns for k, f in (("low", F.min), ("high", F.max))]).first()
    return {c: (row[f"{c}_low"], row[f"{c}_high"]) for c in columns}
