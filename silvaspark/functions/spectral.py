"""Spectral indices and scene masks as columns. A zero denominator or a missing band gives NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import BANDS, SCL_MASKED


def divide(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def difference(a: str, b: str) -> Column:
    """The normalised difference of two bands."""
    return divide(F.col(a) - F.col(b), F.col(a) + F.col(b))


def indices() -> dict[str, Column]:
    evi = 2.5 * divide(F.col("B08_nir") - F.col("B04_red"), F.col("B08_nir") + 6 * F.col("B04_red") - 7.5 * F.col("B02_blue") + 1)
    return {"NDVI": difference("B08_nir", "B04_red"), "NDRE": difference("B05_re1", "B04_red"), "NDWI": difference("B03_green", "B08_nir"), "NBR": difference("B8A_nir2", "B12_swir2"), "EVI": evi}


def reflectance(stack: DataFrame, scale: float = 10_000.0) -> DataFrame:
    return stack.withColumns({b: F.col(b) / scale for b in BANDS})


def scene_valid(code: Column) -> Column:
    """Whether a scene class (which may be a blend after resampling) is none of the masked ones."""
    return ~code.isin(*SCL_MASKED)


def masked_by_scene(stack: DataFrame, scl: str = "scl") -> DataFrame:
    """Bands NULL where the scene class is masked or missing."""
    valid = F.coalesce(scene_valid(F.col(scl)), F.lit(False))
    return stack.withColumns({b: F.when(valid, F.col(b)) for b in BANDS})
