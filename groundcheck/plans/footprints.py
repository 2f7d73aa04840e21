"""Imagery to building footprints: tiles, probabilities, mask, regions, features."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from groundcheck import fixed_values as V
from groundcheck.lineage import cut_lineage
from groundcheck.operators import components as C, inference, morphology, pixels as P, tiles as T


def _blended(scored: DataFrame, pixels: DataFrame, size: int, weighting: str) -> DataFrame:
    full = scored.select(
        (F.col("y0") + F.col("i")).alias("prow"), (F.col("x0") + F.col("j")).alias("pcol"),
        "i", "j", "p")
    valid = pixels.filter("valid").select("prow", "pcol")
    return T.blend(full.join(valid, ["prow", "pcol"], "left_semi"), size, weighting)


def _cores(scored: DataFrame, pixels: DataFrame, width: int, height: int, size: int, stride: int) -> DataFrame:
    plan = T.tile_plan(
        pixels.sparkSession.range(1).select(F.lit(width).alias("width"), F.lit(height).alias("height")),
        size, stride).select("y0", "x0", "core_y0", "core_y1", "core_x0", "core_x1")
    row, col = F.col("y0") + F.col("i"), F.col("x0") + F.col("j")
    kept = scored.join(plan, ["y0", "x0"]).filter(
        (row >= F.col("core_y0")) & (row < F.col("core_y1"))
        & (col >= F.col("core_x0")) & (col < F.col("core_x1")))
    valid = pixels.filter("valid").select("prow", "pcol")
    return kept.select(row.alias("prow"), col.alias("pcol"), "p").join(
        valid, ["prow", "pcol"], "left_semi")


def blended_probability(
    pixels: DataFrame, width: int, height: int, load: Callable, size: int = V.TILE_SIZE,
    stride: int = V.TILE_STRIDE, weighting: str = "hann",
) -> DataFrame:
    """Probability per valid pixel from overlapping tiles.  ``pixels`` carry ``r, g, b, valid``."""
    tiled = T.pixels_to_tiles(pixels, width, height, size, stride)
    return _blended(inference.predict_tiles(tiled, load, size), pixels, size, weighting)


def core_probability(
    pixels: DataFrame, width: int, height: int, load: Callable, size: int = V.TILE_SIZE,
    stride: int = V.TILE_STRIDE,
) -> DataFrame:
    """Probability per valid pixel taken from the one tile whose core holds the pixel."""
    tiled = T.pixels_to_tiles(pixels, width, height, size, stride)
    return _cores(inference.predict_tiles(tiled, load, size), pixels, width, height, size, stride)


def probability_mask(
    pixels: DataFrame, probability: DataFrame, threshold: float, opening: int = 0, closing: int = 0,
) -> DataFrame:
    """Cleaned 0/1 mask on every pixel; invalid pixels stay 0 even after closing."""
    base = pixels.select("prow", "pcol", "valid").join(probability, ["prow", "pcol"], "left")
    raw = base.withColumn("v", F.coalesce(F.col("p") >= threshold, F.lit(False)).cast("int"))
    if not opening and not closing:
        return raw.select("prow", "pcol", "v")
    clean = morphology.open_close(raw, opening, closing)
    return clean.join(base.filter("valid").select("prow", "pcol", F.lit(1).alias("ok")),
                      ["prow", "pcol"], "left").select(
        "prow", "pcol", F.when(F.col("ok") == 1, F.col("v")).otherwise(0).alias("v"))


def regions_to_features(
    mask: DataFrame, place, origin: tuple[float, float], min_area: float, prefix: str, digits: int,
    values: DataFrame | None = None, value: str = "p", places: int = 3,
    fallback: float | None = 0.75, area_places: int = 1,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Regions of a mask as features: ``(features, outlines, summary)``.

    ``place(x, y)`` maps pixel corners into a metric plane.  Regions below ``min_area`` square metres
    are left out and only counted in ``summary``.
    """
    if values is not None:  # each pixel's value goes into its run's sum
        mask = mask.select("prow", "pcol", "v").join(values.select("prow", "pcol", value), ["prow", "pcol"], "left")
    runs = cut_lineage(C.label_runs(mask, value=None if values is None else value))
    pieces = C.outline(runs)
    area = C.outline_area(pieces, place, origin)
    kept = cut_lineage(area.filter(F.col("area_sqm") >= min_area))
    if values is not None:
        kept = kept.join(C.zonal_runs(runs, places=places, fallback=fallback), "component")
    features = C.numbered(kept, prefix, digits).withColumn(
        "area_sqm", F.bround("area_sqm", area_places))
    summary = area.agg(
        F.count(F.lit(1)).alias("raw_polygon_count"),
        F.count_if(F.col("area_sqm") >= min_area).alias("filtered_polygon_count"))
    outlines = pieces.join(kept.select("component"), "component", "left_semi")
    return features, outlines, summary


def run_summary(
    features: DataFrame, summary: DataFrame, tile_count: int, failed_tiles: int = 0,
) -> DataFrame:
    """One row of figures for a run record."""
    return summary.withColumn("tile_count", F.lit(tile_count)).withColumn(
        "failed_tiles", F.lit(failed_tiles))


def extract_footprints(
    pixels: DataFrame, width: int, height: int, load: Callable, place, origin: tuple[float, float],
    threshold: float = 0.5, min_area: float = 10.0, size: int = V.TILE_SIZE,
    stride: int = V.TILE_STRIDE, weighting: str | None = "hann", opening: int = 0, closing: int = 0,
    prefix: str = "AI-WHU-", digits: int = 3, fallback: float = 0.85,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Whole job.  ``weighting``: ``hann`` or ``uniform`` blends tiles, ``None`` cuts tile cores."""
    if not 0 <= threshold <= 1 or min_area < 0:
        raise ValueError("threshold must be in 0-1 and min_area not negative")
    if weighting is None:
        p = core_probability(pixels, width, height, load, size, stride)
    else:
        p = blended_probability(pixels, width, height, load, size, stride, weighting)
    p = cut_lineage(p)  # the predictor is the dear part: run it once
    mask = probability_mask(pixels, p, threshold, opening, closing)
    return regions_to_features(
        mask, place, origin, min_area, prefix, digits, p, fallback=fallback)


@dataclass
class ProjectRun:
    """What one run over a raster gives: features, their outlines, one row of figures, and the tiles that failed."""

    features: DataFrame
    outlines: DataFrame
    summary: DataFrame
    failed: DataFrame


def area_window(area: DataFrame | None, width: int, height: int, to_pixel) -> tuple[int, int, int, int]:
    """``row0, row1, col0, col1`` of an area of interest (edges ``x1, y1, x2, y2``), the whole raster without one."""
    if area is None:
        return 0, height, 0, width
    found = T.window_of_area(area, width, height, to_pixel).first()  # one row
    if found is None:
        raise ValueError(V.AOI_MISSES)
    return int(found["row0"]), int(found["row1"]), int(found["col0"]), int(found["col1"])


def extract_project(
    pixels: DataFrame, width: int, height: int, load: Callable, place, origin: tuple[float, float],
    target: tuple[int, int] | None = None, area: DataFrame | None = None, to_pixel=None,
    threshold: float = 0.5, min_area: float = 10.0, size: int = V.TILE_SIZE, stride: int = V.TILE_STRIDE,
    weighting: str | None = None, opening: int = 0, closing: int = 0, scale: str = "byte",
    prefix: str = "AI-WHU-", digits: int = 3, fallback: float = 0.85,
) -> ProjectRun:
    """Footprints of a project's raster: resample, cut to the area of interest, predict tiles, extract.

    ``target`` (width, height) is the grid to predict on; pixels are averaged onto it.  ``area`` holds edges
    of the area of interest and ``to_pixel(x, y)`` their place on that grid; tiles are laid out inside its
    window alone, and an area that misses the raster is an error.  ``place`` maps corners of the grid.
    ``weighting`` is ``hann``, ``uniform`` or ``None`` (tile cores); ``scale`` is passed to the predictor.

    A tile whose prediction fails is counted and listed (``y0, x0, error``, places on the grid) and its pixels have the
    probability that other tiles give them, or none; the run goes on.
    """
    if not 0 <= threshold <= 1 or min_area < 0:
        raise ValueError("threshold must be in 0-1 and min_area not negative")
    if target is not None:
        bands = ("r", "g", "b")
        pixels = P.resample_average(pixels, (width, height), target, bands, "alpha")
        pixels = pixels.withColumns({c: F.floor(F.col(c) + 0.5).cast("int") for c in bands}).withColumn("valid", P.valid_pixel())
        width, height = target
    row0, row1, col0, col1 = area_window(area, width, height, to_pixel)
    inside = pixels.filter((F.col("prow") >= row0) & (F.col("prow") < row1) & (F.col("pcol") >= col0) & (F.col("pcol") < col1))
    inside = cut_lineage(inside.withColumns({"prow": F.col("prow") - row0, "pcol": F.col("pcol") - col0}))
    wide, high = col1 - col0, row1 - row0
    tiled = T.pixels_to_tiles(inside, wide, high, size, stride)
    # the predictor is the dear part: run it once, for probabilities and failures alike
    scored = cut_lineage(inference.predict_tiles(tiled, load, size, scale=scale, on_error="skip"))
    good = scored.filter("error is null")
    p = _cores(good, inside, wide, high, size, stride) if weighting is None else _blended(good, inside, size, weighting)

    def back(cells: DataFrame) -> DataFrame:
        return cells.withColumns({"prow": F.col("prow") + row0, "pcol": F.col("pcol") + col0})

    p, grid = cut_lineage(back(p)), back(inside)
    mask = probability_mask(grid, p, threshold, opening, closing)
    features, outlines, summary = regions_to_features(
        mask, place, origin, min_area, prefix, digits, p, fallback=fallback)
    plan = pixels.sparkSession.range(1).select(F.lit(wide).alias("width"), F.lit(high).alias("height"))
    failed = scored.filter("error is not null").select(
        (F.col("y0") + row0).alias("y0"), (F.col("x0") + col0).alias("x0"), "error")
    figures = summary.join(T.tile_plan(plan, size, stride).agg(F.count("*").alias("tile_count"))).join(
        failed.agg(F.count("*").alias("failed_tiles")))
    return ProjectRun(features, outlines, figures, failed)
