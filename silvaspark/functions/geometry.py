"""Planar geometry as columns: rings are arrays of structs ``x, y``, closed or not."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _next(ring: Column) -> Column:
    """The ring turned by one, so that element i is the end of edge i."""
    return F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))


def edges(ring: Column) -> Column:
    return F.zip_with(ring, _next(ring), lambda a, b: F.struct(a["x"].alias("x0"), a["y"].alias("y0"), b["x"].alias("x1"), b["y"].alias("y1")))


def ring_area(ring: Column) -> Column:
    doubled = F.aggregate(edges(ring), F.lit(0.0), lambda s, e: s + e["x0"] * e["y1"] - e["x1"] * e["y0"])
    return F.abs(doubled) / 2


def polygon_area(rings: Column) -> Column:
    """Area of an outer ring less its holes."""
    areas = F.transform(rings, ring_area)
    return F.element_at(areas, 1) - F.aggregate(F.slice(areas, 2, F.greatest(F.size(areas), F.lit(1))), F.lit(0.0), lambda s, a: s + a)


def bounds(rings: Column) -> Column:
    points = F.flatten(rings)
    of = lambda axis, f: f(F.transform(points, lambda p: p[axis]))
    return F.struct(of("x", F.array_min).alias("xmin"), of("x", F.array_max).alias("xmax"), of("y", F.array_min).alias("ymin"), of("y", F.array_max).alias("ymax"))


def contains(rings: Column, x: Column, y: Column) -> Column:
    """Whether a point is strictly inside a polygon: crossings are odd, and no edge holds the point."""
    all_edges = F.flatten(F.transform(rings, edges))
    cross = lambda e: (e["x1"] - e["x0"]) * (y - e["y0"]) - (x - e["x0"]) * (e["y1"] - e["y0"])
    on_edge = lambda e: (cross(e) == 0) & x.between(F.least(e["x0"], e["x1"]), F.greatest(e["x0"], e["x1"])) & y.between(F.least(e["y0"], e["y1"]), F.greatest(e["y0"], e["y1"]))
    crosses = lambda e: ((e["y0"] > y) != (e["y1"] > y)) & ((cross(e) > 0) == (e["y1"] > e["y0"]))
    return ~F.exists(all_edges, on_edge) & (F.size(F.filter(all_edges, crosses)) % 2 == 1)


def ring_from_bounds(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(F.array(corner(xmin, ymin), corner(xmax, ymin), corner(xmax, ymax), corner(xmin, ymax)))


# The GRS 80 ellipsoid.
_A, _F = 6_378_137.0, 1 / 298.257222101


class TransverseMercator:
    """Forward and inverse projection as columns, by series in the third flattening to the fourth order."""

    def __init__(self, lon0: float, lat0: float = 0.0, k0: float = 1.0, x0: float = 0.0, y0: float = 0.0):
        self.lon0, self.k0, self.x0 = math.radians(lon0), k0, x0
        n = _F / (2 - _F)
        self.n = n
        self.radius = _A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
        self.alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49_561 * n**4 / 161_280)
        self.beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161_280)
        self.delta = (2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630)
        self.y0 = y0 - self.k0 * self.radius * self._meridian(math.radians(lat0))

    def _meridian(self, lat: float) -> float:
        c = 2 * math.sqrt(self.n) / (1 + self.n)
        t = math.sinh(math.atanh(math.sin(lat)) - c * math.atanh(c * math.sin(lat)))
        xi = math.atan2(t, 1.0)
        return xi + sum(a * math.sin(2 * (j + 1) * xi) for j, a in enumerate(self.alpha))

    def forward(self, df: DataFrame, lat: str, lon: str, x: str = "x", y: str = "y") -> DataFrame:
        """Adds x and y of latitudes and longitudes in radians. Steps are columns, so none is computed twice."""
        c = 2 * math.sqrt(self.n) / (1 + self.n)
        df = df.withColumn("_t", F.sinh(F.atanh(F.sin(lat)) - c * F.atanh(c * F.sin(lat)))).withColumn("_away", F.col(lon) - self.lon0)
        df = df.withColumn("_xi", F.atan2(F.col("_t"), F.cos("_away"))).withColumn("_eta", F.atanh(F.sin("_away") / F.sqrt(1 + F.col("_t") * F.col("_t"))))
        easting, northing = F.col("_eta"), F.col("_xi")
        for j, a in enumerate(self.alpha, 1):
            easting = easting + a * F.cos(2 * j * F.col("_xi")) * F.sinh(2 * j * F.col("_eta"))
            northing = northing + a * F.sin(2 * j * F.col("_xi")) * F.cosh(2 * j * F.col("_eta"))
        return df.withColumns({x: self.x0 + self.k0 * self.radius * easting, y: self.y0 + self.k0 * self.radius * northing}).drop("_t", "_away", "_xi", "_eta")

    def inverse(self, df: DataFrame, x: str, y: str, lat: str = "lat", lon: str = "lon") -> DataFrame:
        """Adds latitudes and longitudes in radians."""
        df = df.withColumn("_xi", (F.col(y) - self.y0) / (self.k0 * self.radius)).withColumn("_eta", (F.col(x) - self.x0) / (self.k0 * self.radius))
        xi1, eta1 = F.col("_xi"), F.col("_eta")
        for j, b in enumerate(self.beta, 1):
            xi1 = xi1 - b * F.sin(2 * j * F.col("_xi")) * F.cosh(2 * j * F.col("_eta"))
            eta1 = eta1 - b * F.cos(2 * j * F.col("_xi")) * F.sinh(2 * j * F.col("_eta"))
        df = df.withColumns({"_xi1": xi1, "_eta1": eta1}).withColumn("_chi", F.asin(F.sin("_xi1") / F.cosh("_eta1")))
        latitude = F.col("_chi")
        for j, d in enumerate(self.delta, 1):
            latitude = latitude + d * F.sin(2 * j * F.col("_chi"))
        return df.withColumns({lat: latitude, lon: self.lon0 + F.atan2(F.sinh("_eta1"), F.cos("_xi1"))}).drop("_xi", "_eta", "_xi1", "_eta1", "_chi")


# The two systems of the satellite scenes and of the national grid.
UTM_29N = TransverseMercator(-9.0, 0.0, 0.9996, 500_000.0, 0.0)
NATIONAL_GRID = TransverseMercator(-8.133108333333333, 39.66825833333333, 1.0, 0.0, 0.0)


def reprojected(df: DataFrame, source: TransverseMercator, target: TransverseMercator) -> DataFrame:
    """Places ``x``, ``y`` of one system in the other."""
    return target.forward(source.inverse(df, "x", "y", "_lat", "_lon"), "_lat", "_lon").drop("_lat", "_lon")
