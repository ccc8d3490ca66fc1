"""Parameters of each stage and the names of what it writes."""

from __future__ import annotations

from dataclasses import dataclass


def _number(x: float | int | None) -> str:
    return str(x)


@dataclass(frozen=True)
class Prepare:
    minheight: float = 1.0
    min_ndsm: float = 0.0
    dilations: int = 2


@dataclass(frozen=True)
class Treetops:
    radius_a: float = 0.5
    radius_b: float = 0.05
    minheight: float = 2.0
    mindist: float = 0.0
    upper_percentile: float = 99.9

    @property
    def layer(self) -> str:
        return f"treetops_lidar_ra{_number(self.radius_a)}_rb{_number(self.radius_b)}_mh{_number(self.minheight)}_md_{_number(self.mindist)}"


@dataclass(frozen=True)
class Crowns:
    treetops_layer: str | None = None
    compactness: float = 0.001
    minheight: float = 2.0
    min_area: float = 1.0

    def layer(self, treetops: str) -> str:
        return f"crowns_{treetops}_c{_number(self.compactness)}_mh{_number(self.minheight)}_ma{_number(self.min_area)}"

    def raster(self, treetops: str) -> str:
        return f"crown_segments_{treetops}_c{_number(self.compactness)}_mh{_number(self.minheight)}_ma{_number(self.min_area)}"


@dataclass(frozen=True)
class Landscape:
    n_estimators: int = 200
    max_depth: int | None = None
    min_samples_leaf: int = 5
    test_size: float = 0.25
    mask_threshold: float = 0.3
    seed: int = 42

    @property
    def suffix(self) -> str:
        return f"ne{self.n_estimators}_md{_number(self.max_depth)}_msl{self.min_samples_leaf}_mt{_number(self.mask_threshold)}"


@dataclass(frozen=True)
class Features:
    crowns_layer: str | None = None
    edge_buffer: float = 1.0


@dataclass(frozen=True)
class Correlation:
    crowns_layer: str | None = None
    min_points: int = 30
    method: str = "pearson"

    def name(self, layer: str) -> str:
        return f"correlation_{layer}_{self.method}_mp{self.min_points}"
