"""Raster queries: masks, regions, tiles, resampling, scores on pixels."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from driver import layers as L
from groundcheck import fixed_values as V
from groundcheck.lineage import checkpoint_folder
from groundcheck.operators import components as C, morphology, pixels as P, tiles as T
from groundcheck.operators.rasterize import rasterize
from groundcheck.plans import footprints, greenery
from groundcheck.sources import raster_tables

WIDTH = 100
PIXEL = 0.5  # metres

_PX = L.duck(L.PIXELS)
_EXG = f"""px as materialized (select *, 2.0e0*g/(r+g+b) - 1.0e0*r/(r+g+b) - 1.0e0*b/(r+g+b) as exg
  from ({_PX}) t),
m0 as materialized (select *, case when exg >= 0.15 and alpha > 0 then 1 else 0 end as v from px)"""


def _pixels(spark, sf_dir) -> DataFrame:
    return L.run(spark, sf_dir, L.PIXELS).withColumn("valid", P.valid_pixel())


def _height(pixels: DataFrame) -> int:
    return pixels.agg(F.max("prow")).first()[0] + 1


def _place(x, y):
    """Pixel corner to a plane in metres with y upwards."""
    return F.struct((x * PIXEL).alias("x"), (y * -PIXEL).alias("y"))


def valid_mask(spark, sf_dir) -> DataFrame:
    return _pixels(spark, sf_dir).select("id", "valid")


def excess_green_mask(spark, sf_dir) -> DataFrame:
    return P.excess_green(_pixels(spark, sf_dir)).select("id", F.round("exg", 6).alias("exg"), "v")


def _green(spark, sf_dir) -> DataFrame:
    return P.excess_green(_pixels(spark, sf_dir)).select("prow", "pcol", "exg", "v")


def mask_open_close(spark, sf_dir) -> DataFrame:
    return morphology.open_close(_green(spark, sf_dir), 3, 5)


def mask_components(spark, sf_dir) -> DataFrame:
    labels = C.label_pixels(_green(spark, sf_dir))
    return labels.groupBy("component").agg(F.count(F.lit(1)).alias("pixels")).select(
        F.shiftright("component", 31).alias("first_row"),
        (F.col("component") % (1 << 31)).alias("first_col"), "pixels")


def zonal_mean(spark, sf_dir) -> DataFrame:
    green = _green(spark, sf_dir)
    z = C.zonal_runs(C.label_runs(green, value="exg"))
    return z.select(
        F.shiftright("component", 31).alias("first_row"),
        (F.col("component") % (1 << 31)).alias("first_col"), "pixels",
        F.round("mean", 6).alias("mean_exg"))


def component_area(spark, sf_dir) -> DataFrame:
    """Area and outline length of every green region from its outline."""
    pieces = C.outline(C.label_runs(_green(spark, sf_dir)))
    area = C.outline_area(pieces, _place, (0.0, 0.0))
    length = pieces.groupBy("component").agg(
        (F.sum(F.abs(F.col("x2") - F.col("x1")) + F.abs(F.col("y2") - F.col("y1"))) * PIXEL).alias(
            "outline_m"))
    return area.join(length, "component").select(
        F.shiftright("component", 31).alias("first_row"),
        (F.col("component") % (1 << 31)).alias("first_col"),
        F.round("area_sqm", 6).alias("area_sqm"), F.round("outline_m", 6).alias("outline_m"))


def vegetation_candidates(spark, sf_dir) -> DataFrame:
    f, _, _ = greenery.vegetation(
        _pixels(spark, sf_dir), _place, (0.0, 0.0), min_area=5.0, opening=3)
    return f.select("feature_id", "area_sqm", F.round("mean_excess_green", 4).alias("mean_exg"),
                    "pixels", "feature_type")


def _stub():
    def predict(image):
        return image[1] / 255.0

    return predict


def _unit_stub():
    def predict(image):
        return image[1]

    return predict


def _failing_stub():
    def predict(image):
        if int(image[0].sum()) % 3 == 0:
            raise RuntimeError("out of memory")
        return image[1] / 255.0

    return predict


def predict_tiles_stub(spark, sf_dir) -> DataFrame:
    """Tile predictions blended back; the stand-in model returns green as a probability."""
    px = _pixels(spark, sf_dir)
    p = footprints.blended_probability(px, WIDTH, _height(px), _stub, 32, 16, "hann")
    return p.select("prow", "pcol", F.round("p", 6).alias("p"))


def core_tiles_stub(spark, sf_dir) -> DataFrame:
    """Tile predictions cut to tile cores."""
    px = _pixels(spark, sf_dir)
    p = footprints.core_probability(px, WIDTH, _height(px), _stub, 32, 16)
    return p.select("prow", "pcol", F.round("p", 6).alias("p"))


def footprint_extraction(spark, sf_dir) -> DataFrame:
    px = _pixels(spark, sf_dir)
    f, _, _ = footprints.extract_footprints(
        px, WIDTH, _height(px), _stub, _place, (0.0, 0.0), threshold=0.6, min_area=2.0,
        size=32, stride=16, weighting="uniform")
    return f.select("feature_id", "area_sqm", F.col("mean").alias("confidence"), "pixels")


def footprint_summary(spark, sf_dir) -> DataFrame:
    px = _pixels(spark, sf_dir)
    _, _, s = footprints.extract_footprints(
        px, WIDTH, _height(px), _stub, _place, (0.0, 0.0), threshold=0.6, min_area=2.0,
        size=32, stride=16, weighting=None)
    return s


def _area(px: DataFrame) -> DataFrame:
    """Edges of a slanted area of interest in metres, over the middle of the raster."""
    h = px.agg((F.max("prow") + 1).alias("h"))
    corners = [("6.3", "h * 0.1"), ("38.2", "h * 0.17"), ("33.9", "h * 0.4"), ("4.1", "h * 0.33")]
    return h.selectExpr("inline(array(" + ", ".join(
        f"struct({a[0]}D as x1, double({a[1]}) as y1, {b[0]}D as x2, double({b[1]}) as y2)"
        for a, b in zip(corners, corners[1:] + corners[:1])) + "))")


def _metres_to_pixel(x, y):
    return F.struct((x / PIXEL).alias("col"), (y / PIXEL).alias("row"))


def tile_table_pruned(spark, sf_dir) -> DataFrame:
    """Pixels of an area of interest, read from a table stored in blocks."""
    px = _pixels(spark, sf_dir)
    path = f"{checkpoint_folder(spark)}/raster-{uuid.uuid4().hex}"
    raster_tables.write_raster(px.drop("valid"), path, "07", block=16)
    window = T.window_of_area(_area(px), WIDTH, _height(px), _metres_to_pixel).withColumn("raster_id", F.lit("07"))
    return raster_tables.read_raster(spark, path, window, block=16).select("raster_id", "id", "prow", "pcol", "g")


def raster_outputs(spark, sf_dir) -> DataFrame:
    """Probability and mask of a run, stored in blocks and read again."""
    px = _pixels(spark, sf_dir)
    folder = f"{checkpoint_folder(spark)}/run-{uuid.uuid4().hex}"
    raster_tables.write_probability(px.filter("valid").select("prow", "pcol", (F.col("g") / 255.0).alias("p")), f"{folder}/p", "r", 32)
    raster_tables.write_mask(_green(spark, sf_dir), f"{folder}/v", "r", 32)
    p, v = raster_tables.read_raster(spark, f"{folder}/p"), raster_tables.read_raster(spark, f"{folder}/v")
    both = raster_tables.with_cells(px.select("prow", "pcol"), p.drop("raster_id"), v.drop("raster_id"))
    return both.select("prow", "pcol", F.round(F.coalesce(F.col("p").cast("double"), F.lit(0.0)), 4).alias("p"),
                       F.coalesce(F.col("v").cast("int"), F.lit(0)).alias("v"))


def footprints_aoi(spark, sf_dir) -> DataFrame:
    """Footprints inside an area of interest; tiles are laid out in its window."""
    px = _pixels(spark, sf_dir)
    run = footprints.extract_project(
        px, WIDTH, _height(px), _stub, _place, (0.0, 0.0), area=_area(px), to_pixel=_metres_to_pixel,
        threshold=0.6, min_area=2.0, size=32, stride=16)
    return run.features.select("feature_id", "area_sqm", F.col("mean").alias("confidence"), "pixels")


def footprints_resampled(spark, sf_dir) -> DataFrame:
    """Regions found on a coarser grid, with unit floats given to the predictor."""
    px = _pixels(spark, sf_dir)
    h = _height(px)
    run = footprints.extract_project(
        px, WIDTH, h, _unit_stub, lambda x, y: F.struct(x.alias("x"), (-y).alias("y")), (0.0, 0.0),
        target=(40, h * 3 // 10), threshold=0.5, min_area=1.5, size=16, stride=8, scale="unit", weighting="uniform")
    return run.features.select("feature_id", "area_sqm", "pixels")


def failed_tiles(spark, sf_dir) -> DataFrame:
    """Figures of a run whose predictor fails on some tiles, and what their pixels are left with."""
    px = _pixels(spark, sf_dir)
    run = footprints.extract_project(
        px, WIDTH, _height(px), _failing_stub, _place, (0.0, 0.0), threshold=0.6, min_area=2.0, size=20, stride=20)
    return run.summary.select("tile_count", "failed_tiles", "raw_polygon_count", "filtered_polygon_count")


def saved_vegetation(spark, sf_dir) -> DataFrame:
    """The saved vegetation result before and after a run."""
    path = f"{checkpoint_folder(spark)}/vegetation-{uuid.uuid4().hex}"
    _, before = raster_tables.saved_vegetation(spark, path)
    before = before.collect()
    raster_tables.save_vegetation(greenery.vegetation(_pixels(spark, sf_dir), _place, (0.0, 0.0), min_area=5.0, opening=3)[0], path)
    _, after = raster_tables.saved_vegetation(spark, path)
    return spark.createDataFrame(before, after.schema).unionByName(after)


def tile_plan(spark, sf_dir) -> DataFrame:
    """Tile grid of one raster per part."""
    r = _rasters(spark, sf_dir)
    s = T.tile_starts(F.col("width"))
    return r.select(
        "raster_id", F.array_join(s.cast("array<string>"), ",").alias("starts"),
        F.size(s).alias("n"), T.estimated_tiles(F.col("width")).alias("estimate"))


_RASTERS = """select p_partkey as raster_id, cast((p_partkey*37) % 3000 + 100 as int) as width,
  cast(p_size*40 + 50 as int) as height from {part}"""


def _rasters(spark, sf_dir) -> DataFrame:
    # the table's file is one split here; rasters are spread before they become tiles
    return L.run(spark, sf_dir, _RASTERS).repartition(spark.sparkContext.defaultParallelism, "raster_id")


def core_intervals(spark, sf_dir) -> DataFrame:
    return T.tile_plan(_rasters(spark, sf_dir)).groupBy(
        "raster_id", "x0", "core_x0", "core_x1", "w").agg(F.count(F.lit(1)).alias("rows"))


def tile_blend(spark, sf_dir) -> DataFrame:
    """Hann blend of made-up tile probabilities over the valid pixels."""
    px = _pixels(spark, sf_dir)
    t = T.pixels_to_tiles(px.filter("valid"), WIDTH, _height(px), 32, 16)
    tile = F.col("y0") * 1000 + F.col("x0")
    p = ((F.col("prow") * 13 + F.col("pcol") * 7 + tile * 3) % 100) / 100.0
    return T.blend(t.withColumn("p", p), 32).select("prow", "pcol", F.round("p", 6).alias("p"))


def resample_avg(spark, sf_dir) -> DataFrame:
    px = _pixels(spark, sf_dir)
    h = _height(px)
    out = P.resample_average(px, (WIDTH, h), (40, h * 3 // 10), ("r", "g", "b"), "alpha")
    return out.select("prow", "pcol", *[F.round(c, 6).alias(c) for c in ("r", "g", "b")],
                      F.col("alpha").cast("int").alias("alpha"))


def _scored(spark, sf_dir) -> DataFrame:
    return P.excess_green(_pixels(spark, sf_dir)).withColumn(
        "p", ((F.col("id") * 7919) % 1000) / 1000.0).withColumn("truth", F.col("v") == 1)


def threshold_sweep(spark, sf_dir) -> DataFrame:
    s = P.threshold_sweep(_scored(spark, sf_dir), thresholds=(0.25, 0.35, 0.45, 0.5, 0.65, 0.8))
    return s.select("threshold", "tp", "fp", "fn", *[
        F.round(c, 6).alias(c) for c in ("precision", "recall", "iou", "f1")])


def pixel_confusion(spark, sf_dir) -> DataFrame:
    return P.threshold_sweep(_scored(spark, sf_dir), thresholds=(0.5,)).select(
        "tp", "fp", "fn", F.round("iou", 6).alias("iou"))


def _patches(spark, sf_dir) -> DataFrame:
    px = _pixels(spark, sf_dir)
    green = P.excess_green(px)
    return P.patch_flags(green, WIDTH, _height(px), 4, 4)


def patch_flags(spark, sf_dir) -> DataFrame:
    return _patches(spark, sf_dir).select("y0", "x0", "positive")


def patch_sample(spark, sf_dir) -> DataFrame:
    return P.sample_patches(_patches(spark, sf_dir)).select("y0", "x0", "positive")


def class_balance(spark, sf_dir) -> DataFrame:
    return P.class_balance(P.excess_green(_pixels(spark, sf_dir))).withColumn(
        "positive_weight", F.round("positive_weight", 6))


def label_audit(spark, sf_dir) -> DataFrame:
    green = P.excess_green(_pixels(spark, sf_dir))
    labels = L.run(spark, sf_dir, L.BUILDINGS)
    return P.label_audit(green, _patches(spark, sf_dir), labels).withColumn(
        "building_label_fraction_of_valid_pixels",
        F.round("building_label_fraction_of_valid_pixels", 6))


def rasterize_polygons(spark, sf_dir) -> DataFrame:
    """Buildings burned into 1 m pixels; one line per pixel row."""
    b = L.boxes(spark, sf_dir, L.BUILDINGS).select(F.explode("edges").alias("e")).select(
        *[(F.col(f"e.{c}") / 100.0).alias(c) for c in ("x1", "y1", "x2", "y2")])
    size = L.run(spark, sf_dir, L.BUILDINGS).agg(F.max("x1"), F.max("y1")).first()
    burned = rasterize(b, size[0] // 100 + 1, size[1] // 100 + 1)
    return burned.groupBy("prow").agg(
        F.count(F.lit(1)).alias("n"), F.min("pcol").alias("first"), F.max("pcol").alias("last"),
        F.sum(F.col("pcol").cast("bigint")).alias("total"))


# ---- oracle SQL --------------------------------------------------------------------------------
def _window(source: str, target: str, fn: str, along: str, across: str, reach: int) -> str:
    return (f"{target} as materialized (select prow, pcol, {fn}(v) over (partition by {across} "
            f"order by {along} range between {reach} preceding and {reach} following) as v "
            f"from {source})")


def _morphology(source: str, steps: list[tuple[str, int]], name: str) -> str:
    parts, last = [], source
    for i, (fn, k) in enumerate(steps):
        for along, across in (("pcol", "prow"), ("prow", "pcol")):
            nxt = f"{name}{i}{along}"
            parts.append(_window(last, nxt, fn, along, across, k // 2))
            last = nxt
    parts.append(f"{name} as materialized (select * from {last})")
    return ", ".join(parts)


def _regions(mask: str) -> str:
    """Region label per pixel: the smallest pixel number that reaches it."""
    return f"""on_ as materialized (select prow, pcol, prow*100 + pcol as px from {mask} where v = 1),
seeds as (select px from on_ a where not exists (select 1 from on_ b where b.px = a.px - 100)
  and not exists (select 1 from on_ b where b.px = a.px - 1 and b.prow = a.prow)),
nb as materialized (select a.px, b.px as other from on_ a join on_ b
  on (b.pcol = a.pcol and abs(b.prow - a.prow) = 1) or (b.prow = a.prow and abs(b.pcol - a.pcol) = 1)),
reach(px, label) as (select px, px from seeds
  union select nb.other, reach.label from reach join nb using (px)),
lab as materialized (select px, min(label) as label from reach group by px)"""


_FIRST = "cast(floor(label/100) as bigint) as first_row, cast(label % 100 as bigint) as first_col"
_GREEN_REGIONS = f"with recursive {_EXG}, {_regions('m0')}"
_FOOT = f"""with recursive px as materialized ({_PX}),
m0 as materialized (select *, case when g = 200 and alpha > 0 then 1 else 0 end as v from px),
{_regions('m0')}, k as (select label, count(*) as n from lab group by label)"""
_VALID_SQL = f"select * from ({_PX}) t where alpha > 0"
_AREA_WINDOW = """h as (select max(prow)+1 as h from px),
area as (select least(6.3, 4.1)/0.5e0 as c0, 38.2e0/0.5 as c1, h*0.1e0/0.5 as r0, h*0.4e0/0.5 as r1 from h),
win as (select greatest(0, floor(c0+0.001)) as c0, least(100, floor(c0+0.001) + ceil(c1-c0-0.001)) as c1,
  greatest(0, floor(r0+0.001)) as r0, least(h, floor(r0+0.001) + ceil(r1-r0-0.001)) as r1 from area, h)"""
_RESAMPLED = f"""with px as materialized ({_PX}),
h as (select max(prow)+1 as h, cast(floor((max(prow)+1)*3/10) as bigint) as th from px),
cx as (select c, t, least((c+1)*0.4e0, t+1) - greatest(c*0.4e0, t) as w from
  (select unnest(range(0, 100)) as c) a cross join (select unnest(range(0, 40)) as t) b
  where c*0.4e0 < t+1 - 1e-9 and (c+1)*0.4e0 > t + 1e-9),
ry as (select r, t, least((r+1)*th/cast(h as double), t+1) - greatest(r*th/cast(h as double), t) as w
  from (select unnest(range(0, h)) as r, h, th from h) a
  cross join (select unnest(range(0, th)) as t from h) b
  where r*th/cast(h as double) < t+1 - 1e-9 and (r+1)*th/cast(h as double) > t + 1e-9),
near as (select b.t as tr, a.t as tc, alpha from (select unnest(range(0, 40)) as t) a
  cross join (select unnest(range(0, th)) as t, h, th from h) b
  join px on px.pcol = floor((a.t+0.5e0)/0.4e0)
    and px.prow = floor((b.t+0.5e0)/(th/cast(h as double))))
select ry.t as prow, cx.t as pcol, round(sum(px.r*cx.w*ry.w)/sum(cx.w*ry.w), 6) as r,
  round(sum(px.g*cx.w*ry.w)/sum(cx.w*ry.w), 6) as g, round(sum(px.b*cx.w*ry.w)/sum(cx.w*ry.w), 6) as b,
  cast(max(near.alpha) as integer) as alpha
from px join cx on cx.c = px.pcol join ry on ry.r = px.prow
left join near on near.tr = ry.t and near.tc = cx.t group by ry.t, cx.t"""

QUERIES = {
    "valid_mask": (valid_mask, f"select id, (r+g+b > 0 and alpha > 0) as valid from ({_PX}) t"),
    "excess_green_mask": (
        excess_green_mask, f"with {_EXG} select id, round(exg, 6) as exg, v from m0"),
    "mask_open_close": (mask_open_close, f"""with {_EXG}, {_morphology(
        "m0", [("min", 3), ("max", 3), ("max", 5), ("min", 5)], "oc")}
select prow, pcol, v from oc"""),
    "mask_components": (mask_components, f"""{_GREEN_REGIONS}
select {_FIRST}, count(*) as pixels from lab group by label"""),
    "zonal_mean": (zonal_mean, f"""{_GREEN_REGIONS}
select {_FIRST}, count(*) as pixels, round(avg(m0.exg), 6) as mean_exg
from lab join m0 on m0.prow*100 + m0.pcol = lab.px group by label"""),
    "component_area": (component_area, f"""{_GREEN_REGIONS},
d as (select label, count(*) as n, (select count(*) from nb join lab l2 using (px)
  where l2.label = lab.label) as inner_sides from lab group by label)
select {_FIRST}, round(n*0.25e0, 6) as area_sqm,
  round((4*n - inner_sides)*0.5e0, 6) as outline_m
from d"""),
    "vegetation_candidates": (vegetation_candidates, f"""with recursive {_EXG}, {_morphology(
        "m0", [("min", 3), ("max", 3)], "op")}, {_regions('op')},
k as (select label, count(*) as n, avg(m0.exg) as e from lab
  join m0 on m0.prow*100 + m0.pcol = lab.px group by label having count(*)*0.25 >= 5.0)
select printf('GREEN-EXG-%04d', row_number() over (order by label)) as feature_id,
  n*0.25e0 as area_sqm, round(e, 4) as mean_exg, n as pixels,
  'greenery_candidate' as feature_type from k"""),
    "predict_tiles_stub": (
        predict_tiles_stub, f"select prow, pcol, round(g/255.0e0, 6) as p from ({_VALID_SQL}) t"),
    "core_tiles_stub": (
        core_tiles_stub, f"select prow, pcol, round(g/255.0e0, 6) as p from ({_VALID_SQL}) t"),
    "footprint_extraction": (footprint_extraction, f"""{_FOOT}
select printf('AI-WHU-%03d', row_number() over (order by label)) as feature_id,
  round_even(n*0.25e0, 1) as area_sqm, round(200/255.0e0, 3) as confidence, n as pixels
from k where n*0.25 >= 2.0"""),
    "footprint_summary": (footprint_summary, f"""{_FOOT}
select count(*) as raw_polygon_count, count(*) filter (n*0.25 >= 2.0) as filtered_polygon_count
from k"""),
    "tile_table_pruned": (tile_table_pruned, f"""with px as ({_PX}), {_AREA_WINDOW}
select '07' as raster_id, id, prow, pcol, g from px, win where prow >= r0 and prow < r1 and pcol >= c0 and pcol < c1"""),
    "raster_outputs": (raster_outputs, f"""with {_EXG}
select prow, pcol, case when r+g+b > 0 and alpha > 0 then round(g/255.0e0, 4) else 0.0e0 end as p, v from m0"""),
    "footprints_aoi": (footprints_aoi, f"""with recursive px as materialized ({_PX}), {_AREA_WINDOW},
m0 as materialized (select px.*, case when g = 200 and alpha > 0 then 1 else 0 end as v from px, win
  where prow >= r0 and prow < r1 and pcol >= c0 and pcol < c1),
{_regions('m0')}, k as (select label, count(*) as n from lab group by label)
select printf('AI-WHU-%03d', row_number() over (order by label)) as feature_id,
  round_even(n*0.25e0, 1) as area_sqm, round(200/255.0e0, 3) as confidence, n as pixels
from k where n*0.25 >= 2.0"""),
    "footprints_resampled": (footprints_resampled, f"""with recursive small as ({_RESAMPLED}),
m0 as materialized (select prow, pcol, case when floor(g + 0.5) >= 127.5 and alpha > 0 then 1 else 0 end as v from small),
{_regions('m0')}, k as (select label, count(*) as n from lab group by label)
select printf('AI-WHU-%03d', row_number() over (order by label)) as feature_id, n*1.0e0 as area_sqm, n as pixels
from k where n >= 1.5"""),
    "failed_tiles": (failed_tiles, f"""with recursive px as materialized ({_PX}), h as (select max(prow)+1 as h from px),
ys as (select y0, row_number() over (order by y0) as n, coalesce(lag(y0) over (order by y0), -20) as before from (
  select unnest(list_distinct(list_concat(range(0, greatest(0, h-20)+1, 20), [greatest(0, h-20)]))) as y0 from h)),
xs as (select unnest(range(0, 81, 20)) as x0),
bad as (select y0, x0 from px join ys on y0 <= prow and prow < y0+20 join xs on x0 <= pcol and pcol < x0+20
  group by y0, x0 having sum(r) % 3 = 0 and count(*) filter (r+g+b > 0 and alpha > 0) > 0),
tiles as (select y0, x0, case when n = 1 then 0 else floor((before + 20 + y0)/2) end as top,
  coalesce(lead(floor((before + 20 + y0)/2)) over (partition by x0 order by y0), (select h from h)) as bottom from ys, xs),
m0 as materialized (select px.*, case when g = 200 and alpha > 0 and b.y0 is null then 1 else 0 end as v from px
  join tiles t on top <= prow and prow < bottom and t.x0 <= pcol and pcol < t.x0+20
  left join bad b on b.y0 = t.y0 and b.x0 = t.x0),
{_regions('m0')}, k as (select label, count(*) as n from lab group by label)
select (select count(*) from tiles) as tile_count, (select count(*) from bad) as failed_tiles,
  count(*) as raw_polygon_count, count(*) filter (n*0.25 >= 2.0) as filtered_polygon_count from k"""),
    "saved_vegetation": (saved_vegetation, f"""with recursive {_EXG}, {_morphology(
        "m0", [("min", 3), ("max", 3)], "op")}, {_regions('op')},
k as (select label, count(*) as n from lab group by label having count(*)*0.25 >= 5.0)
select '{V.VEGETATION_NAME}' as name, '{V.VEGETATION_NOT_RUN}' as status, 0 as candidate_count
union all select '{V.VEGETATION_NAME}', '{V.VEGETATION_DONE}', count(*) from k"""),
    "tile_plan": (tile_plan, f"""with r as ({L.duck(_RASTERS)}), s as (select *,
  list_sort(list_distinct(list_concat(range(0, greatest(0, width-512)+1, 256),
    [cast(greatest(0, width-512) as bigint)]))) as st from r)
select raster_id, array_to_string(st, ',') as starts, cast(len(st) as integer) as n,
  cast(greatest(1, ceil(greatest(0, width-512)/256.0)+1) as integer) as estimate from s"""),
    "core_intervals": (core_intervals, f"""with r as ({L.duck(_RASTERS)}), s as (select *,
  list_sort(list_distinct(list_concat(range(0, greatest(0, width-512)+1, 256),
    [cast(greatest(0, width-512) as bigint)]))) as st,
  len(list_distinct(list_concat(range(0, greatest(0, height-512)+1, 256),
    [cast(greatest(0, height-512) as bigint)]))) as rows from r),
u as (select raster_id, width, rows, unnest(st) as x0 from s),
z as (select *, lag(x0) over w as b, lead(x0) over w as a from u
  window w as (partition by raster_id order by x0))
select raster_id, cast(x0 as integer) as x0,
  cast(case when b is null then 0 else floor((b + 512 + x0)/2) end as integer) as core_x0,
  cast(case when a is null then width else least(width, floor((x0 + 512 + a)/2)) end as integer)
    as core_x1, cast(least(512, width - x0) as integer) as w, rows from z"""),
    "tile_blend": (tile_blend, f"""with px as ({_VALID_SQL}),
h as (select max(prow)+1 as h from ({_PX}) t),
ys as (select unnest(list_distinct(list_concat(range(0, greatest(0, h-32)+1, 16),
  [greatest(0, h-32)]))) as y0 from h),
xs as (select unnest([0, 16, 32, 48, 64, 68]) as x0),
t as (select prow, pcol, ((prow*13 + pcol*7 + (y0*1000 + x0)*3) % 100)/100.0e0 as p,
  (0.5-0.5*cos(2*pi()*(prow-y0)/31))*(0.5-0.5*cos(2*pi()*(pcol-x0)/31)) + 1e-5 as w
  from px join ys on y0 <= prow and prow < y0+32 join xs on x0 <= pcol and pcol < x0+32)
select prow, pcol, round(sum(p*w)/sum(w), 6) as p from t group by prow, pcol"""),
    "resample_avg": (resample_avg, _RESAMPLED),
    "threshold_sweep": (threshold_sweep, f"""with {_EXG},
s as (select *, ((id*7919) % 1000)/1000.0e0 as p from m0 where r+g+b > 0 and alpha > 0),
k as (select t as threshold, count(*) filter (p >= t and v = 1) as tp,
  count(*) filter (p >= t and v = 0) as fp, count(*) filter (p < t and v = 1) as fn
  from s cross join (select unnest([0.25e0, 0.35e0, 0.45e0, 0.5e0, 0.65e0, 0.8e0]) as t) q group by t),
j as (select *, tp/cast(tp+fp as double) as pr, tp/cast(tp+fn as double) as re from k)
select threshold, tp, fp, fn, round(pr, 6) as precision, round(re, 6) as recall,
  round(tp/cast(tp+fp+fn as double), 6) as iou, round(2*pr*re/(pr+re), 6) as f1 from j"""),
    "pixel_confusion": (pixel_confusion, f"""with {_EXG},
s as (select *, ((id*7919) % 1000)/1000.0e0 as p from m0 where r+g+b > 0 and alpha > 0),
k as (select count(*) filter (p >= 0.5 and v = 1) as tp, count(*) filter (p >= 0.5 and v = 0) as fp,
  count(*) filter (p < 0.5 and v = 1) as fn from s)
select *, round(tp/cast(tp+fp+fn as double), 6) as iou from k"""),
    "patch_flags": (patch_flags, f"""with {_EXG}, h as (select max(prow)+1 as h from px),
ys as (select unnest(list_distinct(list_concat(range(0, greatest(0, h-4)+1, 4),
  [greatest(0, h-4)]))) as y0 from h),
xs as (select unnest(range(0, 97, 4)) as x0)
select cast(y0 as integer) as y0, cast(x0 as integer) as x0, max(v) > 0 as positive from m0
join ys on y0 <= prow and prow < y0+4 join xs on x0 <= pcol and pcol < x0+4
group by y0, x0 having max(alpha) > 0"""),
    "patch_sample": (patch_sample, f"""with {_EXG}, h as (select max(prow)+1 as h from px),
ys as (select unnest(list_distinct(list_concat(range(0, greatest(0, h-4)+1, 4),
  [greatest(0, h-4)]))) as y0 from h),
xs as (select unnest(range(0, 97, 4)) as x0),
f as (select y0, x0, max(v) > 0 as positive from m0
join ys on y0 <= prow and prow < y0+4 join xs on x0 <= pcol and pcol < x0+4
group by y0, x0 having max(alpha) > 0),
k as (select *, row_number() over (partition by positive order by
  cast('0x' || substr(md5(concat('26012:', y0, ':', x0)), 1, 15) as bigint), y0, x0) as rn,
  count(*) filter (positive) over () as np from f)
select cast(y0 as integer) as y0, cast(x0 as integer) as x0, positive from k where positive or rn <= greatest(12, np)"""),
    "class_balance": (class_balance, f"""with {_EXG},
k as (select greatest(1, count(*) filter (alpha > 0 and v = 1)) as positive,
  count(*) filter (alpha > 0) as n from m0)
select positive, greatest(1, n - positive) as negative,
  round(least(5.0e0, greatest(1.0e0, greatest(1, n-positive)/cast(positive as double))), 6)
    as positive_weight from k"""),
    "label_audit": (label_audit, f"""with {_EXG}, h as (select max(prow)+1 as h from px),
ys as (select unnest(list_distinct(list_concat(range(0, greatest(0, h-4)+1, 4),
  [greatest(0, h-4)]))) as y0 from h),
xs as (select unnest(range(0, 97, 4)) as x0),
f as (select y0, x0, max(v) > 0 as positive from m0
join ys on y0 <= prow and prow < y0+4 join xs on x0 <= pcol and pcol < x0+4
group by y0, x0 having max(alpha) > 0),
k as (select count(*) filter (alpha > 0) as vp, count(*) filter (alpha > 0 and v = 1) as bp from m0)
select vp as valid_pixel_count, bp as building_label_pixel_count,
  (select count(*) from f) as training_patch_count,
  (select count(*) from f where positive) as positive_patch_count,
  (select count(*) from f where not positive) as negative_patch_count,
  (select count(*) from orders) as label_feature_count,
  round(bp/cast(vp as double), 6) as building_label_fraction_of_valid_pixels from k"""),
    "rasterize_polygons": (rasterize_polygons, f"""with b as ({L.duck(L.BUILDINGS)}),
r as (select unnest(range(greatest(0, cast(ceil(y0/100.0-0.5) as bigint)),
  cast(ceil(y1/100.0-0.5) as bigint))) as prow, x0, x1 from b),
c as (select distinct prow, unnest(range(greatest(0, cast(ceil(x0/100.0-0.5) as bigint)),
  cast(ceil(x1/100.0-0.5) as bigint))) as pcol from r)
select cast(prow as integer) as prow, count(*) as n, cast(min(pcol) as integer) as first,
  cast(max(pcol) as integer) as last, cast(sum(pcol) as bigint) as total from c group by prow"""),
}
