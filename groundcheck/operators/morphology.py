"""Opening and closing of binary masks with square kernels.

The mask is cut into blocks with a margin as wide as all kernels together reach.  One shuffle places
blocks; every erosion and dilation then runs as two sliding windows inside its block, and the margin is
thrown away at the end.  A kernel hanging over the raster border uses the part inside.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from groundcheck.fixed_values import MORPHOLOGY_KERNELS

BLOCK = 256


def check_kernel(size: int, name: str) -> int:
    if isinstance(size, bool) or size not in MORPHOLOGY_KERNELS:
        raise ValueError(f"{name} must be one of {MORPHOLOGY_KERNELS}")
    return int(size)


def open_close(
    mask: DataFrame, opening: int = 0, closing: int = 0, by: tuple[str, ...] = (),
    block: int = BLOCK,
) -> DataFrame:
    """``prow, pcol, v`` after opening, then closing; 0 leaves a step out.

    ``mask`` has one row per raster pixel with ``v`` (anything above 0 is foreground).
    """
    opening, closing = check_kernel(opening, "opening"), check_kernel(closing, "closing")
    binary = mask.select(*by, "prow", "pcol", (F.col("v") > 0).cast("int").alias("v"))
    if not opening and not closing:
        return binary
    steps = [(F.min, opening), (F.max, opening)] if opening else []
    steps += [(F.max, closing), (F.min, closing)] if closing else []
    margin = sum(k // 2 for _, k in steps)

    def blocks(axis: str):
        return F.sequence(
            F.floor((F.col(axis) - margin) / block), F.floor((F.col(axis) + margin) / block))

    keys = [*by, "brow", "bcol"]
    df = binary.withColumn("brow", F.explode(blocks("prow"))).withColumn(
        "bcol", F.explode(blocks("pcol"))).repartition(*keys)
    for fn, k in steps:
        for along, across in (("pcol", "prow"), ("prow", "pcol")):
            w = Window.partitionBy(*keys, across).orderBy(along).rangeBetween(-(k // 2), k // 2)
            df = df.withColumn("v", fn("v").over(w))
    home = (F.floor(F.col("prow") / block) == F.col("brow")) & (
        F.floor(F.col("pcol") / block) == F.col("bcol"))
    return df.filter(home).select(*by, "prow", "pcol", "v")
