"""Vegetation candidates from colour imagery, without a model."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from groundcheck import fixed_values as V
from groundcheck.lineage import cut_lineage
from groundcheck.operators import morphology, pixels as P
from groundcheck.plans.footprints import regions_to_features


def vegetation(
    pixels: DataFrame, place, origin: tuple[float, float],
    threshold: float = V.EXCESS_GREEN_THRESHOLD, min_area: float = 5.0, opening: int = 0,
    closing: int = 0, kind: str = "uint8", alpha: str | None = "alpha",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(features, outlines, summary)`` of connected green regions with their mean index."""
    if not 0 <= min_area <= 100_000:
        raise ValueError("min_area must be between 0 and 100000")
    index = cut_lineage(P.excess_green(pixels, threshold, kind, alpha).select(
        "prow", "pcol", "exg", "v"))
    mask = morphology.open_close(index, opening, closing)
    features, outlines, summary = regions_to_features(
        mask, place, origin, min_area, "GREEN-EXG-", 4, index, "exg", fallback=None, area_places=2)
    features = features.select(
        "feature_id", F.lit("greenery_candidate").alias("feature_type"),
        F.lit("rgb_excess_green_heuristic").alias("source"), "component", "pixels", "area_sqm",
        F.bround("mean", 4).alias("mean_excess_green"),
        F.lit(float(threshold)).alias("index_threshold"), F.lit("unverified").alias("review_status"))
    return features, outlines, summary
