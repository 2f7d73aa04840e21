"""Pixel tables: one row per pixel with ``prow, pcol`` and bands."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from groundcheck import fixed_values as V
from groundcheck.operators.selection import first_n, seeded_key
from groundcheck.operators.tiles import pixels_to_tiles


def valid_pixel(r="r", g="g", b="b", alpha: str | None = "alpha") -> Column:
    """Some band is not 0, and the pixel is not transparent."""
    lit = (F.col(r) != 0) | (F.col(g) != 0) | (F.col(b) != 0)
    return lit if alpha is None else lit & (F.col(alpha) > 0)


def to_byte(v: Column) -> Column:
    return F.least(F.greatest(v, F.lit(0)), F.lit(255)).cast("int")


def unit_value(v: Column, kind: str, maximum: Column | None = None) -> Column:
    """Band value on 0-1: ``uint8``/``uint16`` by type range, ``int`` clipped to a byte, ``float`` by
    the global ``maximum`` of the raster."""
    if kind == "int":
        out = F.least(F.greatest(v, F.lit(0)), F.lit(255)) / 255.0
    elif kind in ("uint8", "uint16"):
        out = v / (255.0 if kind == "uint8" else 65535.0)
    elif kind == "float":
        out = F.when(maximum > 1, v / F.when(maximum <= 255, 255.0).otherwise(maximum)).otherwise(v)
    else:
        raise ValueError(f"unknown band kind {kind}")
    return F.least(F.greatest(out.cast("double"), F.lit(0.0)), F.lit(1.0))


def global_maximum(pixels: DataFrame, bands=("r", "g", "b")) -> DataFrame:
    """One-row ``maximum`` over all bands, for float rasters (null when there is no pixel)."""
    values = [F.nanvl(F.col(c).cast("double"), F.lit(float("-inf"))) for c in bands]
    return pixels.agg(F.max(F.array_max(F.array(*values))).alias("maximum"))


def normalized_band(v: Column, band: int, scale: str) -> Column:
    """Model input value: ``unit`` is v/255, ``imagenet`` also removes mean and spread."""
    if scale == "unit":
        return v / 255.0
    if scale == "imagenet":
        return (v / 255.0 - V.IMAGENET_MEAN[band]) / V.IMAGENET_STD[band]
    raise ValueError("scale must be unit or imagenet")


def excess_green(
    pixels: DataFrame, threshold: float = V.EXCESS_GREEN_THRESHOLD, kind: str = "uint8",
    alpha: str | None = "alpha",
) -> DataFrame:
    """Add ``exg`` and the 0/1 mask ``v`` of valid, bright-enough, green pixels.

    With an alpha band the mask follows alpha alone; without one, all-black pixels are not valid.
    """
    if not -1.0 <= threshold <= 2.0:
        raise ValueError("threshold must be between -1 and 2")
    peak = None
    if kind == "float":
        pixels = pixels.join(F.broadcast(global_maximum(pixels)))
        peak = F.col("maximum")
    r, g, b = (unit_value(F.col(c), kind, peak) for c in ("r", "g", "b"))
    total = r + g + b
    share = [F.when(total > 1e-6, band / total).otherwise(0.0) for band in (r, g, b)]
    ok = F.col(alpha) > 0 if alpha else valid_pixel(alpha=None)
    out = pixels.withColumn("exg", 2.0 * share[1] - share[0] - share[2])
    out = out.withColumn("v", (
        (F.col("exg") >= threshold) & ok & (total > V.MIN_CHANNEL_SUM)).cast("int"))
    return out.drop("maximum") if kind == "float" else out


def analysis_size(width: Column, height: Column, budget: int) -> Column:
    """``struct<width,height>`` shrunk to at most ``budget`` pixels, keeping proportions."""
    scale = F.least(F.lit(1.0), F.sqrt(budget / (width.cast("double") * height)))
    side = lambda v: F.greatest(F.lit(1), F.bround(v * scale).cast("int"))
    return F.struct(side(width).alias("width"), side(height).alias("height"))


def resample_average(
    pixels: DataFrame, source: tuple[int, int], target: tuple[int, int],
    bands: tuple[str, ...] = ("r", "g", "b"), alpha: str | None = None, by: tuple[str, ...] = (),
) -> DataFrame:
    """Area-weighted mean of the source pixels under each target pixel.

    ``source``/``target`` are (width, height).  A source pixel spreads over the target cells it
    overlaps, at most two a side when shrinking.  ``alpha`` is taken from the source pixel at the
    target cell's centre.
    """
    scale = {"pcol": target[0] / source[0], "prow": target[1] / source[1]}
    out = pixels
    for axis, ratio in scale.items():
        lo, hi = F.col(axis) * ratio, (F.col(axis) + 1) * ratio
        cells = F.sequence(F.floor(lo + 1e-9), F.greatest(
            F.floor(lo + 1e-9), F.ceil(hi - 1e-9) - 1))
        out = out.withColumn(f"t_{axis}", F.explode(cells)).withColumn(
            f"w_{axis}", F.least(hi, F.col(f"t_{axis}") + 1) - F.greatest(lo, F.col(f"t_{axis}")))
    w = F.col("w_pcol") * F.col("w_prow")
    aggs = [(F.sum(F.col(c) * w) / F.sum(w)).alias(c) for c in bands]
    if alpha:
        here = reduce(lambda p, q: p & q, [
            F.floor((F.col(f"t_{a}") + 0.5) / ratio) == F.col(a) for a, ratio in scale.items()])
        aggs.append(F.max(F.when(here, F.col(alpha))).alias(alpha))
    return out.groupBy(*by, F.col("t_prow").alias("prow"), F.col("t_pcol").alias("pcol")).agg(*aggs)


def _rates(tp: Column, fp: Column, fn: Column) -> list[Column]:
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return [p.alias("precision"), r.alias("recall"), ratio(tp, tp + fp + fn).alias("iou"),
            ratio(2 * p * r, p + r).alias("f1")]


def threshold_sweep(
    pixels: DataFrame, thresholds=V.SWEEP_THRESHOLDS, p: str = "p", truth: str = "truth",
    valid: str | None = "valid",
) -> DataFrame:
    """Pixel confusion at every threshold, from one pass over the pixels.

    Rows: ``threshold, tp, fp, fn, precision, recall, iou, f1``.
    """
    rows = pixels if valid is None else pixels.filter(F.col(valid))
    ref = F.col(truth).cast("boolean")
    wanted = sorted(set(float(t) for t in thresholds))
    counts = rows.agg(*[
        F.struct(
            F.lit(t).alias("threshold"),
            F.count_if((F.col(p) >= t) & ref).alias("tp"),
            F.count_if((F.col(p) >= t) & ~ref).alias("fp"),
            F.count_if((F.col(p) < t) & ref).alias("fn")).alias(f"t{i}")
        for i, t in enumerate(wanted)])
    table = counts.select(F.inline(F.array(*[f"t{i}" for i in range(len(wanted))])))
    return table.select("*", *_rates(F.col("tp"), F.col("fp"), F.col("fn")))


def patch_flags(
    pixels: DataFrame, width: int, height: int, size: int, stride: int,
) -> DataFrame:
    """``y0, x0, positive`` of patches holding a valid pixel.  Pixels carry ``valid`` and ``v``."""
    return pixels_to_tiles(pixels, width, height, size, stride).groupBy("y0", "x0").agg(
        F.max("valid").alias("any_valid"), F.max(F.col("v") > 0).alias("positive")).filter(
        "any_valid").drop("any_valid")


def sample_patches(patches: DataFrame, seed: int = 26012, floor: int = 12) -> DataFrame:
    """All positive patches and max(``floor``, as many) negatives, chosen by a seeded hash."""
    n = patches.filter("positive").count()
    if n == 0:
        raise ValueError("no label pixel falls on valid imagery")
    chosen = first_n(patches.filter(~F.col("positive")), max(floor, n), seeded_key(seed, "y0", "x0"), ("y0", "x0"))
    return patches.filter("positive").unionByName(chosen)


def class_balance(pixels: DataFrame) -> DataFrame:
    """Positive and negative pixel counts and the positive class weight (1 to 5)."""
    positive = F.greatest(F.lit(1), F.count_if(F.col("valid") & (F.col("v") > 0)))
    negative = F.greatest(F.lit(1), F.count_if(F.col("valid")) - positive)
    return pixels.agg(positive.alias("positive"), negative.alias("negative")).withColumn(
        "positive_weight", F.least(F.lit(5.0), F.greatest(
            F.lit(1.0), F.col("negative") / F.col("positive"))))


def label_audit(pixels: DataFrame, patches: DataFrame, labels: DataFrame) -> DataFrame:
    """One row describing labels against imagery before a fit."""
    px = pixels.agg(
        F.count_if("valid").alias("valid_pixel_count"),
        F.count_if(F.col("valid") & (F.col("v") > 0)).alias("building_label_pixel_count"))
    pt = patches.agg(
        F.count(F.lit(1)).alias("training_patch_count"),
        F.count_if("positive").alias("positive_patch_count"),
        F.count_if(~F.col("positive")).alias("negative_patch_count"))
    lb = labels.agg(F.count(F.lit(1)).alias("label_feature_count"))
    fraction = F.when(F.col("valid_pixel_count") > 0, F.col(
        "building_label_pixel_count") / F.col("valid_pixel_count")).otherwise(0.0)
    return px.join(pt).join(lb).withColumn("building_label_fraction_of_valid_pixels", fraction)

