"""Burning polygons into a pixel grid: a pixel belongs to a polygon that holds its centre."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def rasterize(edges: DataFrame, width: int, height: int, by: tuple[str, ...] = ()) -> DataFrame:
    """``prow, pcol`` of covered pixels.

    ``edges`` has ``x1,y1,x2,y2`` in pixel coordinates (rows growing downwards) of oriented rings, all
    polygons together.  Each edge adds +1 or -1 from its crossing to the right on every pixel row it
    spans; the running sum along a row is the number of polygons there.  A row is at most one raster
    width of events after they are summed per pixel.
    """
    up = F.col("y1") > F.col("y2")
    top, bottom = F.least("y1", "y2"), F.greatest("y1", "y2")
    first = F.greatest(F.lit(0), F.ceil(top - 0.5)).cast("int")
    last = F.least(F.lit(height - 1), F.ceil(bottom - 0.5) - 1).cast("int")
    spans = edges.filter(F.col("y1") != F.col("y2")).withColumn("_a", first).withColumn("_b", last)
    spans = spans.filter(F.col("_a") <= F.col("_b")).withColumn(
        "prow", F.explode(F.sequence("_a", "_b")))
    x = F.col("x1") + (F.col("prow") + 0.5 - F.col("y1")) * (F.col("x2") - F.col("x1")) / (
        F.col("y2") - F.col("y1"))
    start = F.greatest(F.lit(0), F.least(F.lit(width), F.ceil(x - 0.5))).cast("int")
    events = spans.withColumn("pcol", start).withColumn(
        "way", F.when(up, -1).otherwise(1)).groupBy(*by, "prow", "pcol").agg(
        F.sum("way").alias("way"))
    row = Window.partitionBy(*by, "prow").orderBy("pcol")
    level = F.sum("way").over(row.rowsBetween(Window.unboundedPreceding, 0))
    return (
        events.withColumn("level", level)
        .withColumn("until", F.coalesce(F.lead("pcol").over(row), F.lit(width)))
        .filter((F.col("level") != 0) & (F.col("until") > F.col("pcol")))
        .select(*by, "prow", F.explode(F.sequence(F.col("pcol"), F.col("until") - 1)).alias("pcol")))
