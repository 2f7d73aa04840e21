"""Connected regions of a mask, their outlines and per-region figures.

Runs of pixels are found and joined inside square blocks, each block in one task's memory; only regions
that touch a block's border are linked to their neighbours, and that small graph is contracted round by round.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from groundcheck.lineage import cut_lineage

BLOCK = 512


def _joined(u: np.ndarray, v: np.ndarray, count: int) -> np.ndarray:
    """The smallest node that each of ``count`` nodes reaches over the links ``u, v``."""
    parent = np.arange(count)
    while True:
        a, b = parent[u], parent[v]
        apart = a != b
        if not apart.any():
            return parent
        np.minimum.at(parent, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (parent[parent] != parent).any():
            parent = parent[parent]


def block_runs(
    mask: DataFrame, by: tuple[str, ...] = (), block: int = BLOCK, value: str | None = None,
) -> DataFrame:
    """Horizontal runs of foreground inside blocks: ``prow, c0, c1, local``, and with ``value`` its ``total`` and ``held``.

    ``local`` names the run's region inside its block by the first run (top row, then leftmost) as a sortable
    number.  A block of ``block`` x ``block`` pixels is one group, so no group grows with the raster.
    """
    types = {f.name: f.dataType.simpleString() for f in mask.schema}
    names = [*by, "prow", "c0", "c1", "local", *(("total", "held") if value else ())]
    schema = ", ".join([*[f"`{k}` {types[k]}" for k in by], "prow long", "c0 long", "c1 long", "local long",
                        *(["total double", "held long"] if value else [])])

    def one_block(pdf: pd.DataFrame) -> pd.DataFrame:
        row, col = pdf["prow"].to_numpy(np.int64), pdf["pcol"].to_numpy(np.int64)
        order = np.lexsort((col, row))
        row, col = row[order], col[order]
        first = np.flatnonzero(np.concatenate([[True], (np.diff(row) != 0) | (np.diff(col) != 1)]))
        last = np.concatenate([first[1:], [len(row)]]) - 1
        r, c0, c1 = row[first], col[first], col[last]
        # runs of the next row that share a column
        wide = int(col.max()) + 2
        low = np.searchsorted(r * wide + c1, (r + 1) * wide + c0)
        high = np.maximum(np.searchsorted(r * wide + c0, (r + 1) * wide + c1, "right"), low)
        up = np.repeat(np.arange(len(r)), high - low)
        down = np.arange(len(up)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + np.repeat(low, high - low)
        top = _joined(up, down, len(r))
        out = {**{k: pdf[k].iloc[0] for k in by}, "prow": r, "c0": c0, "c1": c1, "local": (r[top] << 31) + c0[top]}
        if value:
            v = pdf[value].to_numpy(np.float64, na_value=np.nan)[order]
            known = ~np.isnan(v)
            out["total"] = np.add.reduceat(np.where(known, v, 0.0), first)
            out["held"] = np.add.reduceat(known.astype(np.int64), first)
        return pd.DataFrame(out)[names]

    on = mask.filter(F.col("v") > 0).select(
        *by, "prow", "pcol", *([value] if value else []), F.floor(F.col("prow") / block).alias("_br"),
        F.floor(F.col("pcol") / block).alias("_bc"))
    return on.groupBy(*by, "_br", "_bc").applyInPandas(one_block, schema)


def _border_links(runs: DataFrame, by: tuple[str, ...], block: int) -> DataFrame:
    """Pairs of block regions that touch across a border (4-connected)."""
    bottom = runs.filter((F.col("prow") + 1) % block == 0).select(
        *by, (F.col("prow") + 1).alias("prow"), F.floor(F.col("c0") / block).alias("bc"), F.col("c0").alias("a0"),
        F.col("c1").alias("a1"), F.col("local").alias("src"))
    top = runs.filter(F.col("prow") % block == 0).select(
        *by, "prow", F.floor(F.col("c0") / block).alias("bc"), F.col("c0").alias("b0"), F.col("c1").alias("b1"),
        F.col("local").alias("dst"))
    vertical = bottom.join(top, [*by, "prow", "bc"]).filter((F.col("a0") <= F.col("b1")) & (F.col("b0") <= F.col("a1")))
    right = runs.filter((F.col("c1") + 1) % block == 0).select(*by, "prow", (F.col("c1") + 1).alias("at"), F.col("local").alias("src"))
    left = runs.filter(F.col("c0") % block == 0).select(*by, "prow", F.col("c0").alias("at"), F.col("local").alias("dst"))
    sideways = right.join(left, [*by, "prow", "at"])
    return vertical.select(*by, "src", "dst").unionByName(sideways.select(*by, "src", "dst")).distinct()


def contract(links: DataFrame, by: tuple[str, ...] = ()) -> DataFrame | None:
    """``node, label`` (label = smallest node of the region) for nodes that have a link.

    Each round points every node at its smallest neighbour, follows pointers a few steps, and rewrites
    the links between the nodes pointed at.  Nodes at least halve every round.
    """
    keys = list(by)
    links = cut_lineage(links)
    labels: DataFrame | None = None
    while not links.isEmpty():
        both = links.select(*keys, F.col("src").alias("node"), F.col("dst").alias("near")).unionByName(
            links.select(*keys, F.col("dst").alias("node"), F.col("src").alias("near")))
        parent = both.groupBy(*keys, "node").agg(
            F.least(F.col("node"), F.min("near")).alias("parent"))
        for _ in range(2):
            step = parent.select(*keys, F.col("node").alias("parent"), F.col("parent").alias("next"))
            parent = parent.join(step, [*keys, "parent"]).select(
                *keys, "node", F.col("next").alias("parent"))
        parent = cut_lineage(parent)
        if labels is None:
            labels = parent.withColumnRenamed("parent", "label")
        else:
            renamed = parent.select(*keys, F.col("node").alias("label"), F.col("parent").alias("to"))
            labels = labels.join(renamed, [*keys, "label"], "left").select(
                *keys, "node", F.coalesce("to", "label").alias("label"))
            labels = cut_lineage(labels)
        src = parent.select(*keys, F.col("node").alias("src"), F.col("parent").alias("s"))
        dst = parent.select(*keys, F.col("node").alias("dst"), F.col("parent").alias("d"))
        links = cut_lineage(
            links.join(src, [*keys, "src"]).join(dst, [*keys, "dst"])
            .filter(F.col("s") != F.col("d"))
            .select(*keys, F.least("s", "d").alias("src"), F.greatest("s", "d").alias("dst"))
            .distinct())
    return labels


def label_runs(
    mask: DataFrame, by: tuple[str, ...] = (), block: int = BLOCK, value: str | None = None,
) -> DataFrame:
    """Runs with the region they belong to: ``prow, c0, c1, component``, and with ``value`` its ``total`` and ``held``.

    ``component`` is the region's first run (top row, then leftmost), as a sortable number.  Runs end at the
    borders of blocks.  With ``value`` (a column of ``mask``) each run has its sum and the count of pixels that have one.
    """
    runs = cut_lineage(block_runs(mask, by, block, value))
    labels = contract(_border_links(runs, by, block), by)
    kept = [*by, "prow", "c0", "c1", *(("total", "held") if value else ())]
    if labels is None:
        return runs.select(*kept, F.col("local").alias("component"))
    # a region has a label per block it touches at most, so no key holds more runs than a block
    return runs.join(labels.withColumnRenamed("node", "local"), [*by, "local"], "left").select(
        *kept, F.coalesce("label", "local").alias("component"))


def label_pixels(mask: DataFrame, by: tuple[str, ...] = (), block: int = BLOCK) -> DataFrame:
    """``prow, pcol, component`` of every foreground pixel."""
    return label_runs(mask, by, block).select(
        *by, "prow", F.explode(F.sequence("c0", "c1")).alias("pcol"), "component")


def zonal(
    labels: DataFrame, values: DataFrame, value: str, by: tuple[str, ...] = (), places: int = 3,
    fallback: float | None = None,
) -> DataFrame:
    """Pixel count and mean of ``value`` per region, kept in 0-1 and rounded when it is a confidence."""
    mean = F.avg(value)
    df = labels.join(values.select(*by, "prow", "pcol", value), [*by, "prow", "pcol"], "left").groupBy(
        *by, "component").agg(F.count(F.lit(1)).alias("pixels"), mean.alias("mean"))
    if fallback is not None:
        ok = F.coalesce(F.when(~F.isnan("mean"), F.col("mean")), F.lit(fallback))
        df = df.withColumn("mean", F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ok)), places))
    return df


def zonal_runs(
    runs: DataFrame, by: tuple[str, ...] = (), places: int = 3, fallback: float | None = None,
) -> DataFrame:
    """As :func:`zonal`, from the sums that :func:`label_runs` keeps per run; they are combined before the shuffle."""
    df = runs.groupBy(*by, "component").agg(
        F.sum(F.col("c1") - F.col("c0") + 1).alias("pixels"),
        F.when(F.sum("held") > 0, F.sum("total") / F.sum("held")).alias("mean"))
    if fallback is not None:
        ok = F.coalesce(F.when(~F.isnan("mean"), F.col("mean")), F.lit(fallback))
        df = df.withColumn("mean", F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ok)), places))
    return df


def outline(runs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Straight outline pieces of every region in pixel corners: ``component, x1, y1, x2, y2``.

    The region lies left of each piece when y points up, so holes come out clockwise by themselves.
    Pieces along one line are merged.
    """
    key = [*by, "component"]
    left = runs.select(*key, F.col("c0").alias("line"), F.col("prow").alias("at"), F.lit(1).alias("way"))
    right = runs.select(
        *key, (F.col("c1") + 1).alias("line"), F.col("prow").alias("at"), F.lit(-1).alias("way"))
    # adjoining runs of one row (a block border) cancel here, as do rows above each other below
    vertical = left.unionByName(right)
    cells = runs.select(*key, "prow", F.explode(F.sequence("c0", "c1")).alias("at"))
    top = cells.select(*key, F.col("prow").alias("line"), "at", F.lit(-1).alias("way"))
    bottom = cells.select(*key, (F.col("prow") + 1).alias("line"), "at", F.lit(1).alias("way"))
    horizontal = top.unionByName(bottom)

    def merged(sides: DataFrame) -> DataFrame:
        single = sides.groupBy(*key, "line", "at").agg(F.sum("way").alias("way")).filter("way <> 0")
        place = F.row_number().over(Window.partitionBy(*key, "line", "way").orderBy("at"))
        return single.withColumn("grp", F.col("at") - place).groupBy(*key, "line", "way", "grp").agg(
            F.min("at").alias("lo"), (F.max("at") + 1).alias("hi"))

    first, last = F.when(F.col("way") > 0, F.col("lo")).otherwise(F.col("hi")), F.when(
        F.col("way") > 0, F.col("hi")).otherwise(F.col("lo"))
    v = merged(vertical).select(
        *key, F.col("line").alias("x1"), first.alias("y1"), F.col("line").alias("x2"), last.alias("y2"))
    h = merged(horizontal).select(
        *key, first.alias("x1"), F.col("line").alias("y1"), last.alias("x2"), F.col("line").alias("y2"))
    return v.unionByName(h)


def outline_area(pieces: DataFrame, place, origin: tuple[float, float], by: tuple[str, ...] = ()):
    """Area per region after ``place(x, y) -> struct<x,y>`` maps corners into the metric plane.

    ``origin`` is a point of that plane near the raster; it keeps the sums small.
    """
    p, q = place(F.col("x1"), F.col("y1")), place(F.col("x2"), F.col("y2"))
    df = pieces.select(*by, "component", p.alias("p"), q.alias("q"))
    ox, oy = origin
    cross = (F.col("p.x") - ox) * (F.col("q.y") - oy) - (F.col("q.x") - ox) * (F.col("p.y") - oy)
    return df.groupBy(*by, "component").agg(F.abs(F.sum(cross) / 2).alias("area_sqm"))


def numbered(regions: DataFrame, prefix: str, digits: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Add ``feature_id`` = prefix + running number in scan order, starting at 1 in each raster.

    Ranks come from per-bucket counts of the sort key, so no task sorts all regions.
    """
    number = _dense_position(regions, F.col("component"), by)
    return number.withColumn("feature_id", F.concat(
        F.lit(prefix), F.when(F.length(F.col("number").cast("string")) >= digits,
                              F.col("number").cast("string")).otherwise(
            F.lpad(F.col("number").cast("string"), digits, "0"))))


def _dense_position(df: DataFrame, key: Column, by: tuple[str, ...]) -> DataFrame:
    """1-based position by ``key``, from counts per band of rows and a sort inside each band."""
    band = F.shiftright(key, 31 + 6)  # 64 raster rows
    banded = df.withColumn("_band", band)
    counts = banded.groupBy(*by, "_band").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(
        (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("_band").rowsBetween(
            Window.unboundedPreceding, -1))
    offsets = counts.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_n")
    inner = F.row_number().over(Window.partitionBy(*by, "_band").orderBy(key))
    return banded.join(offsets, [*by, "_band"]).withColumn(
        "number", F.col("_before") + inner).drop("_band", "_before")
