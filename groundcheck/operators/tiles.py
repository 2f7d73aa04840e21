"""Tile plans over rasters and the pixels that belong to each tile."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from groundcheck.fixed_values import TILE_SIZE, TILE_STRIDE


def tile_starts(length: Column, size: int = TILE_SIZE, stride: int = TILE_STRIDE) -> Column:
    """Sorted tile offsets covering ``length`` pixels: every stride, and one flush with the end."""
    last = F.greatest(F.lit(0), length - size).cast("int")
    regular = F.sequence(F.lit(0), last, F.lit(stride))
    return F.concat(regular, F.when(last % stride > 0, F.array(last)).otherwise(F.array().cast("array<int>")))


def estimated_tiles(length: Column, size: int = TILE_SIZE, stride: int = TILE_STRIDE) -> Column:
    """Tile count along one side as the area estimate shows it."""
    over = F.greatest(F.lit(0), length - size)
    return F.greatest(F.lit(1), (F.ceil(over / stride) + 1).cast("int"))


def core_intervals(starts: Column, length: Column, size: int = TILE_SIZE) -> Column:
    """``array<struct<start,lower,upper>>``: each tile keeps up to the middle of its overlaps."""
    def intervals(known: Column) -> Column:
        n = F.size(known)

        def interval(s: Column, i: Column) -> Column:
            before = F.get(known, F.greatest(i - 1, F.lit(0)))
            after = F.get(known, F.least(i + 1, n - 1))
            lower = F.when(i == 0, 0).otherwise(F.floor((before + size + s) / 2))
            upper = F.when(i == n - 1, length).otherwise(F.floor((s + size + after) / 2))
            return F.struct(s.alias("start"), lower.cast("int").alias("lower"),
                            F.least(length, upper).cast("int").alias("upper"))

        return F.transform(known, interval)

    # bound once: an expression named inside the function would be worked out again for every tile
    return F.transform(F.array(starts), intervals)[0]


def tile_plan(
    rasters: DataFrame, size: int = TILE_SIZE, stride: int = TILE_STRIDE,
) -> DataFrame:
    """One row per tile with its window and core; ``rasters`` has ``width`` and ``height``."""
    axis = lambda c: core_intervals(tile_starts(F.col(c), size, stride), F.col(c), size)
    # both axes are worked out once per raster, not the second one for every tile of the first; no axis is empty,
    # and the outer form spares a filter that works both out again before the rows are spread
    out = rasters.withColumns({"_ys": axis("height"), "_xs": axis("width")}).withColumn(
        "_y", F.explode_outer("_ys")).withColumn("_x", F.explode_outer("_xs"))
    return out.select(
        *rasters.columns, F.col("_y.start").alias("y0"), F.col("_x.start").alias("x0"),
        F.least(F.lit(size), F.col("height") - F.col("_y.start")).alias("h"),
        F.least(F.lit(size), F.col("width") - F.col("_x.start")).alias("w"),
        F.col("_y.lower").alias("core_y0"), F.col("_y.upper").alias("core_y1"),
        F.col("_x.lower").alias("core_x0"), F.col("_x.upper").alias("core_x1"))


def covering_starts(at: Column, length: Column, size: int, stride: int) -> Column:
    """Offsets of the tiles that contain pixel ``at``; work grows with the overlap, not the raster."""
    last = F.greatest(F.lit(0), length - size).cast("int")
    first_k = F.greatest(F.lit(0), F.ceil((at - size + 1) / stride)).cast("int")
    last_k = F.floor(F.least(at, last) / stride).cast("int")
    regular = F.when(first_k <= last_k, F.transform(
        F.sequence(first_k, last_k), lambda k: k * stride)).otherwise(F.array().cast("array<int>"))
    tail = F.when(at >= last, F.array(last)).otherwise(F.array().cast("array<int>"))
    return F.array_union(regular, tail)


def pixels_to_tiles(
    pixels: DataFrame, width: Column | int, height: Column | int, size: int = TILE_SIZE,
    stride: int = TILE_STRIDE,
) -> DataFrame:
    """Every pixel once per tile containing it: adds ``y0, x0`` and in-tile ``i, j``."""
    w, h = (F.lit(v) if isinstance(v, int) else v for v in (width, height))
    return (
        pixels.withColumn("y0", F.explode(covering_starts(F.col("prow"), h, size, stride)))
        .withColumn("x0", F.explode(covering_starts(F.col("pcol"), w, size, stride)))
        .withColumn("i", (F.col("prow") - F.col("y0")).cast("int"))
        .withColumn("j", (F.col("pcol") - F.col("x0")).cast("int")))


def window_of_area(edges: DataFrame, width: int, height: int, to_pixel) -> DataFrame:
    """Pixel window of an area of interest: rounded bounds cut to the raster.

    ``edges`` holds one or more areas as rows ``x1,y1,x2,y2``; ``to_pixel(x, y)`` gives
    ``struct<col,row>``.  No row comes back when the area misses the raster.
    """
    p = to_pixel(F.col("x1"), F.col("y1"))
    b = edges.agg(
        F.min(p["col"]).alias("c0"), F.max(p["col"]).alias("c1"),
        F.min(p["row"]).alias("r0"), F.max(p["row"]).alias("r1"))
    c0, r0 = F.floor(F.col("c0") + 0.001), F.floor(F.col("r0") + 0.001)
    c1 = c0 + F.ceil(F.col("c1") - F.col("c0") - 0.001)
    r1 = r0 + F.ceil(F.col("r1") - F.col("r0") - 0.001)
    cut = b.select(
        F.greatest(F.lit(0), c0).alias("col0"), F.least(F.lit(width), c1).alias("col1"),
        F.greatest(F.lit(0), r0).alias("row0"), F.least(F.lit(height), r1).alias("row1"))
    return cut.filter((F.col("col1") > F.col("col0")) & (F.col("row1") > F.col("row0")))


def hann(i: Column, n: int) -> Column:
    return 0.5 - 0.5 * F.cos(2 * math.pi * i / (n - 1))


def blend(
    tile_probabilities: DataFrame, size: int, weighting: str = "hann", by: tuple[str, ...] = (),
) -> DataFrame:
    """One probability per pixel from overlapping tiles: ``prow, pcol, p``.

    Input rows carry ``prow, pcol, i, j, p``.  ``hann`` weights the tile centre, ``uniform`` all
    alike.  Rows of invalid pixels should be left out; such pixels then get no row, meaning 0.
    """
    if weighting not in ("hann", "uniform"):
        raise ValueError("weighting must be hann or uniform")
    w = hann(F.col("i"), size) * hann(F.col("j"), size) + 1e-5 if weighting == "hann" else F.lit(1.0)
    return tile_probabilities.withColumn("_w", w).groupBy(*by, "prow", "pcol").agg(
        (F.sum(F.col("p") * F.col("_w")) / F.sum("_w")).alias("p"))
