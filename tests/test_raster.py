import numpy as np
import pytest
from pyspark.sql import functions as F

from groundcheck.operators import components as C, inference, morphology, pixels as P, tiles as T
from groundcheck.operators.rasterize import rasterize
from groundcheck.plans import footprints, greenery
from groundcheck.sources import raster_tables


def table(spark, a, name="v"):
    return spark.createDataFrame(
        [(int(r), int(c), int(a[r, c])) for r in range(a.shape[0]) for c in range(a.shape[1])],
        f"prow long, pcol long, {name} int")


def dense(df, shape, name="v"):
    out = np.zeros(shape, dtype=int)
    for r in df.collect():
        out[r.prow, r.pcol] = r[name]
    return out


def sliding(a, k, fn):
    p = np.pad(a, k // 2, mode="edge")
    return fn(np.lib.stride_tricks.sliding_window_view(p, (k, k)), axis=(2, 3))


def test_morphology_small_masks(spark):
    m = np.zeros((11, 11), int)
    m[3:8, 3:8] = 1
    speck, hole = m.copy(), m.copy()
    speck[1, 1], hole[5, 5] = 1, 0
    assert (dense(morphology.open_close(table(spark, speck)), (11, 11)) == speck).all()
    opened = dense(morphology.open_close(table(spark, speck), opening=3), (11, 11))
    assert opened[1, 1] == 0 and opened[4, 4] == 1
    assert dense(morphology.open_close(table(spark, hole), closing=3), (11, 11))[5, 5] == 1
    with pytest.raises(ValueError):
        morphology.open_close(table(spark, m), opening=4)


def test_morphology_blocks_equal_whole(spark):
    a = (np.random.default_rng(4).random((40, 37)) < 0.6).astype(int)
    want = sliding(sliding(sliding(sliding(a, 3, np.min), 3, np.max), 5, np.max), 5, np.min)
    got = dense(morphology.open_close(table(spark, a), 3, 5, block=8), a.shape)
    assert (got == want).all()


def flood(a):
    lab, nxt = np.zeros(a.shape, int), 0
    for r in range(a.shape[0]):
        for c in range(a.shape[1]):
            if a[r, c] and not lab[r, c]:
                nxt += 1
                todo = [(r, c)]
                while todo:
                    y, x = todo.pop()
                    if 0 <= y < a.shape[0] and 0 <= x < a.shape[1] and a[y, x] and not lab[y, x]:
                        lab[y, x] = nxt
                        todo += [(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)]
    return lab


def test_components_equal_flood_fill(spark):
    a = (np.random.default_rng(7).random((45, 45)) < 0.58).astype(int)
    lab = flood(a)
    got = C.label_pixels(table(spark, a), block=8).collect()
    assert len(got) == a.sum()
    seen = {}
    for r in got:
        assert seen.setdefault(r.component, lab[r.prow, r.pcol]) == lab[r.prow, r.pcol]
    assert len(seen) == lab.max()
    numbered = C.numbered(spark.createDataFrame([(k,) for k in seen], "component long"), "X-", 3)
    order = [r.feature_id for r in numbered.orderBy("component").collect()]
    assert order == [f"X-{i + 1:03d}" for i in range(len(order))]


def test_one_region_over_most_of_a_wide_raster(spark):
    """A comb over many blocks is one region; its runs carry the sums of their pixels."""
    a = np.zeros((9, 600), int)
    a[4, :] = 1
    a[:, ::3] = 1
    a[4, 300] = 0
    a[:4, 300] = 0
    a[8, 298:303] = 1
    mask = table(spark, a).withColumn("p", F.when(F.col("pcol") % 2 == 0, F.col("pcol") / 600.0))
    runs = C.label_runs(mask, block=4, value="p").cache()
    want = flood(a)
    seen = np.zeros_like(a)
    for r in runs.collect():
        seen[r.prow, r.c0:r.c1 + 1] = r.component + 1
    assert len(set(map(tuple, zip(seen.ravel(), want.ravel())))) == len(set(want.ravel()))
    big = C.zonal_runs(runs).orderBy(F.desc("pixels")).first()
    inside = want == np.bincount(want[want > 0]).argmax()
    even = [c / 600 for c in np.nonzero(inside)[1] if c % 2 == 0]
    assert big.pixels == inside.sum() > 2000 and big["mean"] == pytest.approx(np.mean(even))
    assert C.label_runs(mask.filter("v > 5"), block=4).count() == 0


def test_outline_with_hole(spark):
    a = np.ones((6, 7), int)
    a[2:4, 2:5] = 0
    runs = C.label_runs(table(spark, a), block=4)
    pieces = C.outline(runs)
    place = lambda x, y: F.struct((x * 2.0).alias("x"), (y * -2.0).alias("y"))
    assert C.outline_area(pieces, place, (0.0, 0.0)).first().area_sqm == 4.0 * a.sum()
    assert pieces.count() == 8  # four sides outside, four around the hole
    assert C.label_runs(table(spark, a * 0)).count() == 0


def test_rasterize_pixel_centres(spark):
    ring = [(1.0, 1.0), (9.3, 2.2), (8.1, 8.7), (2.4, 7.9)]
    hole = [(4.0, 4.0), (4.0, 6.0), (6.0, 6.0), (6.0, 4.0)]

    def edges(pts):
        return [(*p, *q) for p, q in zip(pts, pts[1:] + pts[:1])]

    df = spark.createDataFrame(edges(ring) + edges(hole), "x1 double, y1 double, x2 double, y2 double")

    def inside(pts, x, y):
        hit = False
        for (x1, y1), (x2, y2) in zip(pts, pts[1:] + pts[:1]):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                hit = not hit
        return hit

    want = {(r, c) for r in range(10) for c in range(10)
            if inside(ring, c + .5, r + .5) and not inside(hole, c + .5, r + .5)}
    assert {(r.prow, r.pcol) for r in rasterize(df, 10, 10).collect()} == want


def test_tile_starts_and_cores(spark):
    df = spark.createDataFrame([(100,), (512,), (700,), (1024,)], "n int")
    got = {r.n: r for r in df.select("n", T.tile_starts(F.col("n")).alias("s"), T.core_intervals(
        T.tile_starts(F.col("n")), F.col("n")).alias("c")).collect()}
    assert got[100].s == [0] and got[512].s == [0] and got[700].s == [0, 188]
    assert got[1024].s == [0, 256, 512]
    assert [(c.lower, c.upper) for c in got[1024].c] == [(0, 384), (384, 640), (640, 1024)]


def test_tile_plan_works_an_axis_out_once(spark):
    rasters = spark.createDataFrame([(1, 700, 1100), (1, 700, 1100), (2, None, 5), (None, 512, 1024)], "id int, width int, height int")
    plan = T.tile_plan(rasters)
    got = sorted((r.y0, r.x0, r.core_y0, r.core_y1, r.core_x0, r.core_x1) for r in plan.filter("id = 1").collect())
    ys, xs = [(0, 0, 384), (256, 384, 640), (512, 640, 806), (588, 806, 1100)], [(0, 0, 350), (188, 350, 700)]
    assert got == sorted(2 * [(y, x, a, b, c, d) for y, a, b in ys for x, c, d in xs])
    assert plan.filter("id is null").count() == 3 and plan.filter("id = 2").count() == 1
    # one sequence of starts for each axis, however often a tile's neighbours are looked up
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("sequence(") == 2 and "array_union" not in text


def test_covering_tiles_match_plan(spark):
    px = spark.range(70).select(F.lit(0).alias("prow"), F.col("id").alias("pcol"))
    got = {(r.pcol, r.x0) for r in T.pixels_to_tiles(px, 70, 1, 32, 16).collect()}
    assert got == {(c, s) for c in range(70) for s in (0, 16, 32, 38) if s <= c < s + 32}


def test_resample_keeps_the_mean(spark):
    a = np.random.default_rng(1).integers(0, 255, (10, 10))
    df = table(spark, a, "r").withColumns({"g": F.col("r"), "b": F.col("r"), "alpha": F.lit(255)})
    out = P.resample_average(df, (10, 10), (5, 5), alpha="alpha").collect()
    for r in out:
        assert r.r == pytest.approx(a[2 * r.prow:2 * r.prow + 2, 2 * r.pcol:2 * r.pcol + 2].mean())
        assert r.alpha == 255


def test_wrong_prediction_shape_fails(spark):
    px = table(spark, np.ones((4, 4), int), "r").withColumns({"g": F.col("r"), "b": F.col("r")})
    tiles = T.pixels_to_tiles(px, 4, 4, 4, 4)
    with pytest.raises(Exception, match="returned shape"):
        inference.predict_tiles(tiles, lambda: lambda t: t[0, :2], 4, name="bad").collect()


def image(spark, side=32):
    green = (F.col("prow").between(8, 23)) & (F.col("pcol").between(8, 23))
    return spark.range(side * side).select(
        F.floor(F.col("id") / side).alias("prow"), (F.col("id") % side).alias("pcol")).select(
        "*", F.when(green, 20).otherwise(100).alias("r"), F.when(green, 200).otherwise(100).alias("g"),
        F.when(green, 20).otherwise(100).alias("b"), F.lit(255).alias("alpha"), F.lit(True).alias("valid"))


def place(x, y):
    return F.struct((x * 0.5).alias("x"), (y * -0.5).alias("y"))


def test_vegetation_block(spark):
    f, outline, summary = greenery.vegetation(image(spark), place, (0.0, 0.0), min_area=1.0)
    row = f.first()
    assert f.count() == 1 and row.feature_id == "GREEN-EXG-0001" and row.area_sqm == 64.0
    assert outline.count() == 4 and summary.first().filtered_polygon_count == 1


def test_footprints_from_stub(spark):
    def load():
        return lambda t: (t[1] > 150).astype(float) * 0.95

    for weighting in ("hann", "uniform", None):
        f, _, s = footprints.extract_footprints(
            image(spark), 32, 32, load, place, (0.0, 0.0), size=16, stride=8, weighting=weighting)
        row = f.first()
        assert (row.area_sqm, row.feature_id) == (64.0, "AI-WHU-001")
        assert row["mean"] == pytest.approx(0.95)
        assert s.first().raw_polygon_count == 1


def test_unit_values(spark):
    df = spark.createDataFrame([(300.0,), (-5.0,), (100.0,)], "v double")
    assert [r[0] for r in df.select(P.unit_value(F.col("v"), "int")).collect()] == [1.0, 0.0, 100 / 255]
    f = df.join(P.global_maximum(df, ("v",))).select(P.unit_value(F.col("v"), "float", F.col("maximum")))
    assert [r[0] for r in f.collect()] == [1.0, 0.0, 100 / 300]


def test_raster_table_opens_only_the_blocks_of_a_window(spark, tmp_path):
    path = str(tmp_path / "raster")
    cells = spark.range(40 * 40).selectExpr("int(id / 40) as prow", "int(id % 40) as pcol", "id as v")
    raster_tables.write_raster(cells, path, "007", block=10)
    raster_tables.write_raster(cells.withColumn("v", F.lit(-1).cast("long")), path, "8", block=10)
    windows = spark.createDataFrame([("007", 5, 12, 8, 9), ("007", 5, 7, 8, 11), ("007", -4, 1, -9, 1), ("8", 3, 3, 0, 9)],
                                    "raster_id string, row0 int, row1 int, col0 int, col1 int")
    read = raster_tables.read_raster(spark, path, windows, block=10)
    want = {(r, c) for r in range(5, 12) for c in (8,)} | {(r, c) for r in (5, 6) for c in (8, 9, 10)} | {(0, 0)}
    got = read.collect()
    assert len(got) == len(want) and {(r.prow, r.pcol) for r in got} == want
    assert {r.raster_id for r in got} == {"007"} and all(r.v == r.prow * 40 + r.pcol for r in got)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan and "PartitionFilters: [" in plan
    # without a name a window is looked up in every raster; without windows all cells come back
    both = raster_tables.read_raster(spark, path, windows.drop("raster_id").limit(1), block=10)
    assert both.count() == 14 and raster_tables.read_raster(spark, path).count() == 3200
    # a rerun replaces the blocks it touches and leaves the others
    raster_tables.write_raster(cells.filter("prow = 0 and pcol = 0").withColumn("v", F.lit(5).cast("long")), path, "007", block=10)
    again = raster_tables.read_raster(spark, path).filter("raster_id = '007'")
    assert again.count() == 1500 + 1 and again.filter("v = 5").count() == 1


def test_small_blocks_share_a_file(spark, tmp_path):
    path = str(tmp_path / "raster")
    raster_tables.write_raster(spark.createDataFrame([], "prow int, pcol int, v long"), path, "1", block=4)
    cells = spark.range(300 * 20).selectExpr("int(id / 20) as prow", "int(id % 20) as pcol", "id as v")
    raster_tables.write_raster(cells, path, "1", block=4)
    assert len(spark.read.parquet(path).inputFiles()) == 1
    # two blocks are replaced, all others stay, and a shelf that nothing touches is not opened
    raster_tables.write_raster(cells.filter("prow in (0, 9) and pcol = 0").withColumn("v", F.lit(-1).cast("long")), path, "1", block=4)
    raster_tables.write_raster(cells.filter("prow < 4").withColumn("prow", F.col("prow") + 1024), path, "1", block=4)
    got = raster_tables.read_raster(spark, path)
    assert got.count() == 6000 - 32 + 2 + 80 and got.filter("v = -1").count() == 2
    assert {(r.prow, r.pcol) for r in got.filter("prow < 12 and pcol < 4").collect()} == {(0, 0), (9, 0)} | {
        (r, c) for r in range(4, 8) for c in range(4)}
    assert len(spark.read.parquet(path).inputFiles()) == 2


def test_cells_are_joined_without_a_broadcast(spark):
    cells = spark.createDataFrame([(0, 0), (0, 0), (0, 1), (None, 1)], "prow int, pcol int")
    p = spark.createDataFrame([(0, 0, 0.5)], "prow int, pcol int, p double")
    v = spark.createDataFrame([(0, 1, 1), (0, 1, 2)], "prow int, pcol int, v int")
    both = raster_tables.with_cells(cells, p, v)
    assert sorted(map(str, ((r.prow, r.pcol, r.p, r.v) for r in both.collect()))) == sorted(map(str, [
        (0, 0, 0.5, None), (0, 0, 0.5, None), (0, 1, None, 1), (0, 1, None, 2), (None, 1, None, None)]))
    assert "Broadcast" not in both._jdf.queryExecution().executedPlan().toString()


def test_probability_and_mask_tables(spark, tmp_path):
    p = spark.createDataFrame([(0, 0, 0.25), (0, 1, 1.0)], "prow int, pcol int, p double")
    raster_tables.write_probability(p, str(tmp_path / "p"), "r")
    assert raster_tables.read_raster(spark, str(tmp_path / "p")).select("p").dtypes == [("p", "float")]
    for bad in (1.5, float("nan"), None, -0.1):
        with pytest.raises(Exception, match="not between 0 and 1"):
            raster_tables.write_probability(
                spark.createDataFrame([(0, 0, bad)], "prow int, pcol int, p double"), str(tmp_path / "q"), "r")
    raster_tables.write_mask(spark.createDataFrame([(0, 0, 1), (0, 1, 0)], "prow int, pcol int, v int"), str(tmp_path / "v"), "r")
    assert [tuple(r) for r in raster_tables.read_raster(spark, str(tmp_path / "v")).select("prow", "pcol", "v").collect()] == [(0, 0, 1)]
    with pytest.raises(ValueError):
        raster_tables.write_raster(p.withColumn("block_r", F.lit(1)), str(tmp_path / "x"), "r")
    empty, state = raster_tables.saved_vegetation(spark, str(tmp_path / "none"))
    assert empty.count() == 0 and empty.columns[0] == "feature_id" and state.first()["status"] == "not_run"


def test_project_run_counts_failed_tiles_and_keeps_to_its_area(spark):
    cells = [(r, c, 10 if (r, c) != (3, 3) else 99, 200, 0, 255) for r in range(24) for c in range(24)]
    px = spark.createDataFrame(cells, "prow int, pcol int, r int, g int, b int, alpha int").withColumn("valid", F.lit(True))

    def load():
        def predict(image):
            if (image[0] == 99).any():
                raise MemoryError("no room")
            return image[1] / 255.0
        return predict

    def run(**kw):
        return footprints.extract_project(px, 24, 24, load, place, (0.0, 0.0), threshold=0.5, min_area=0.0, size=8, stride=8, **kw)

    whole = run()
    assert [tuple(r) for r in whole.failed.collect()] == [(0, 0, "MemoryError: no room")]
    assert whole.summary.first().asDict() == {
        "raw_polygon_count": 1, "filtered_polygon_count": 1, "tile_count": 9, "failed_tiles": 1}
    assert whole.features.first()["pixels"] == 24 * 24 - 64
    edges = spark.createDataFrame([(10.0, 9.0, 20.0, 22.0), (20.0, 22.0, 10.0, 9.0)], "x1 double, y1 double, x2 double, y2 double")
    part = run(area=edges, to_pixel=lambda x, y: F.struct(x.alias("col"), y.alias("row")))
    assert part.features.first()["pixels"] == 130 and part.summary.first()["failed_tiles"] == 0
    with pytest.raises(ValueError, match="does not intersect"):
        run(area=edges.selectExpr("x1 + 90 as x1", "y1", "x2 + 90 as x2", "y2"), to_pixel=lambda x, y: F.struct(x.alias("col"), y.alias("row")))


def test_predictor_input_scales(spark):
    px = spark.createDataFrame([(0, 0, 51, 102, 255)], "prow int, pcol int, r int, g int, b int")
    tiles = T.pixels_to_tiles(px, 1, 1, 2, 2)
    seen = {}
    for scale in ("byte", "unit", "imagenet"):
        rows = inference.predict_tiles(tiles, lambda: lambda t: t[0].astype(float), 2, name=scale, scale=scale)
        seen[scale] = rows.first()["p"]
    assert seen["byte"] == 51 and seen["unit"] == pytest.approx(0.2)
    assert seen["imagenet"] == pytest.approx((0.2 - 0.485) / 0.229, abs=1e-6)
    with pytest.raises(ValueError):
        inference.predict_tiles(tiles, lambda: None, 2, scale="half")
