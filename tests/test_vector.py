import json
import math
import random

import pytest
from pyspark.sql import functions as F

from groundcheck import fixed_values as V
from groundcheck.functions import geometry as G, text
from groundcheck.operators import gridjoin, matching, polygons, scoring, topology
from groundcheck.operators.nearest import nearest
from groundcheck.plans import discrepancy, parcels, validation
from groundcheck.sources import fixtures, normalize

SCHEMA = "ord long, geom_type string, coords_json string"


def shapes(spark, rows, convert=None):
    df = spark.createDataFrame([(i, t, json.dumps(c)) for i, (t, c) in enumerate(rows)], SCHEMA)
    return polygons.shape_table(G.add_shape(df, convert))


def box(x0, y0, x1, y1):
    return ("Polygon", [[[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]]])


def measures(spark, rows, pairs, **kw):
    s = shapes(spark, rows).cache()
    p = spark.createDataFrame(pairs, "a_ord long, b_ord long")
    return {(r.a_ord, r.b_ord): r for r in polygons.pair_measures(p, s, s, **kw).collect()}


HOLED = ("Polygon", [[[0, 0], [20, 0], [20, 20], [0, 20], [0, 0]],
                     [[5, 5], [15, 5], [15, 15], [5, 15], [5, 5]]])
PAIRS = [
    (box(0, 0, 10, 10), box(5, 5, 15, 15), 25.0),
    (("Polygon", [[[0, 0], [10, 0], [10, 4], [4, 4], [4, 10], [0, 10], [0, 0]]]),
     ("Polygon", [[[2, 2], [9, 3], [8, 9], [3, 8], [2, 2]]]), 15.516667),
    (("Polygon", [[[0, 0], [6, 1], [9, 7], [3, 9], [0, 0]]]),
     ("Polygon", [[[8, 8], [1, 6], [2, -1], [7, 2], [8, 8]]]), 34.810763),
    (HOLED, box(6, 6, 14, 14), 0.0),
    (HOLED, box(0, 0, 20, 10), 150.0),
]


def test_pair_areas(spark):
    rows = [s for a, b, _ in PAIRS for s in (a, b)]
    got = measures(spark, rows, [(2 * i, 2 * i + 1) for i in range(len(PAIRS))])
    for i, (_, _, want) in enumerate(PAIRS):
        assert got[(2 * i, 2 * i + 1)].area == pytest.approx(want, abs=1e-6)
    assert not got[(6, 7)].meets  # wholly inside the hole


def test_large_shapes_are_cut_into_strips(spark, monkeypatch):
    """A wavy ring with many edges gives the same figures cut into strips as whole."""
    import math

    ring = [[10 + (8 + math.sin(7 * t)) * math.cos(t), 10 + (8 + math.cos(5 * t)) * math.sin(t)]
            for t in [2 * math.pi * k / 200 for k in range(200)]]
    rows = [("Polygon", [ring + [ring[0]]]), box(3, 3, 12, 9), box(9, 9, 11, 11), box(30, 0, 31, 1), HOLED]
    pairs = [(0, 1), (0, 2), (0, 3), (0, 4), (1, 4)]
    whole = measures(spark, rows, pairs)
    monkeypatch.setattr(polygons, "STRIP_EDGES", 16)
    s = shapes(spark, rows)
    assert s.filter("strips > 1").count() == 1
    cut = measures(spark, rows, pairs)
    for k, r in whole.items():
        assert cut[k].area == pytest.approx(r.area, rel=1e-9) and cut[k].meets == r.meets
    assert polygons.validity(s).count() == 0


def test_touching_and_lines(spark):
    rows = [box(0, 0, 10, 10), box(10, 0, 20, 10), box(10, 10, 12, 12), ("LineString", [[2, 2], [3, 3]]),
            ("LineString", [[-5, 5], [15, 5]]), ("Point", [5, 5]), ("Point", [50, 5])]
    got = measures(spark, rows, [(0, i) for i in range(1, 7)])
    assert [got[(0, i)].meets if (0, i) in got else False for i in range(1, 7)] == [
        True, True, True, True, True, False]
    assert all(r.area == 0 for r in got.values())
    s = shapes(spark, rows)
    c = polygons.pair_centroids(spark.createDataFrame([(0, 1)], "a_ord long, b_ord long"), s, s).first()
    assert (c.cx, c.cy) == (10.0, 5.0)


def test_validity_reasons(spark):
    rows = [
        box(0, 0, 1, 1), ("Polygon", [[[0, 0], [1, 1], [0, 1], [1, 0], [0, 0]]]),
        ("Polygon", [[[0, 0], [1, 1], [0, 0]]]), ("Polygon", []), HOLED,
        ("Polygon", [HOLED[1][0], [[25, 5], [35, 5], [35, 15], [25, 5]]]),
        ("MultiPolygon", [[HOLED[1][0]], [[[5, 5], [15, 5], [15, 15], [5, 5]]]]),
        ("MultiPolygon", [[box(0, 0, 1, 1)[1][0]], [box(2, 2, 3, 3)[1][0]]]),
        ("Polygon", [[[0, 0], [4, 0], [2, 2], [4, 4], [0, 4], [2, 2], [0, 0]]]),
        ("Polygon", [[[0, 0], [4, 0], [4, 0], [4, 4], [0, 4]]]),
    ]
    s = shapes(spark, rows)
    got = {r.ord: r.reason for r in polygons.validity(s).collect()}
    assert got == {1: "Self-intersection", 5: "Hole lies outside shell", 6: "Nested shells",
                   8: "Ring Self-intersection"}
    flags = {r.ord: (r.empty, r.corrupt) for r in s.select("ord", "empty", "corrupt").collect()}
    assert flags[2] == (False, True) and flags[3] == (True, False) and flags[0] == (False, False)


SHELL = box(0, 0, 20, 20)[1][0]
CIRCLE = [[[4, 4], [8, 2], [12, 4], [4, 4]], [[12, 4], [14, 10], [8, 10], [12, 4]], [[8, 10], [2, 10], [4, 4], [8, 10]]]


@pytest.mark.parametrize("edges", [256, 2])
def test_touching_rings_cut_the_interior_apart_where_they_close_a_circle(spark, monkeypatch, edges):
    monkeypatch.setattr(polygons, "STRIP_EDGES", edges)
    twice = [[0, 10], [10, 5], [20, 10], [10, 15], [0, 10]]
    spokes = [[[8, 8], [7, 4], [9, 4], [8, 8]], [[8, 8], [12, 7], [12, 9], [8, 8]], [[8, 8], [4, 9], [4, 7], [8, 8]]]
    rows = [
        ("Polygon", [SHELL, twice]),
        ("Polygon", [SHELL, [[0, 10], [10, 5], [19, 10], [10, 15], [0, 10]]]),
        ("Polygon", [SHELL, *CIRCLE]),
        ("Polygon", [SHELL, *CIRCLE[:2], [[8, 10], [2, 10], [4, 5], [8, 10]]]),
        ("Polygon", [SHELL, *spokes]),
        ("Polygon", [SHELL, box(2, 2, 18, 18)[1][0], box(5, 5, 8, 8)[1][0]]),
        ("MultiPolygon", [[box(0, 0, 4, 4)[1][0]], [[[4, 1], [6, 0], [6, 4], [4, 3], [5, 2], [4, 1]]]]),
        ("MultiPolygon", [[box(50, 0, 54, 4)[1][0]], [SHELL, twice]]),
    ]
    s = shapes(spark, rows)
    got = {r.ord: r.reason for r in polygons.validity(s).collect()}
    assert got == {0: "Interior is disconnected", 2: "Interior is disconnected", 5: "Holes are nested",
                   7: "Interior is disconnected"}
    assert polygons.validity(s.limit(0)).count() == 0


def test_metric_golden_values(spark):
    ring = [[72.75728365790725, 23.04002668761225], [72.75731772292114, 23.04002919486646],
            [72.75732057507217, 23.039996387280304], [72.75728651005828, 23.039993879198835],
            [72.75728365790725, 23.04002668761225]]
    s = shapes(spark, [("Polygon", [ring]), ("Point", [72.757, 23.040]), ("Point", [72.758, 23.040])],
               G.metric_43n)
    area = s.select(G.area(F.col("edges"))).first()[0]
    assert area == pytest.approx(12.773, abs=1e-3)
    d = polygons.pair_distances(
        spark.createDataFrame([(1, 2)], "a_ord long, b_ord long"), s, s).first().distance
    assert d == pytest.approx(102.518, abs=1e-3)


def random_boxes(n, seed):
    r = random.Random(seed)
    out = []
    for i in range(n):
        x, y = r.randint(0, 400), r.randint(0, 400)
        w, h = r.choice([(0, 0), (1, 1), (5, 8), (300, 2), (2, 250), (60, 60), (7, 7)])
        out.append((i, float(x), float(y), float(x + w), float(y + h)))
    out += [(n + k, 50.0, 50.0, 57.0, 57.0) for k in range(12)]
    return out


def brute(a, b, self_join=False):
    return {(p[0], q[0]) for p in a for q in b
            if (not self_join or p[0] < q[0])
            and p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4]}


@pytest.mark.parametrize("block", [16384, 3])
def test_grid_join_equals_brute_force(spark, monkeypatch, block):
    """Small blocks force every cell to be split; pairs stay complete and unrepeated."""
    monkeypatch.setattr(gridjoin, "BLOCK_ROWS", block)
    a, b = random_boxes(150, 1), random_boxes(120, 2)
    cols = "ord long, minx double, miny double, maxx double, maxy double"
    da, db = spark.createDataFrame(a, cols), spark.createDataFrame(b, cols)
    got = [(r.a_ord, r.b_ord) for r in gridjoin.grid_pairs(da, db).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(a, b)
    got = [(r.a_ord, r.b_ord) for r in gridjoin.grid_pairs(da).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(a, a, True)


def test_every_geometry_type_is_read(spark):
    rows = [("MultiLineString", [[[0, 0], [4, 0]], [[0, 5], [4, 5]]]), ("MultiPoint", [[1, 1], [8, 8]]), ("Point", [2, 2]),
            ("LineString", [[0, 3], [9, 3]]), ("MultiPolygon", [box(0, 0, 1, 1)[1], box(7, 7, 9, 9)[1]]), box(0, 0, 3, 3),
            ("GeometryCollection", None), ("Circle", [1, 1]), ("MultiLineString", [[[0, 0]]]), ("MultiPoint", [[[1, 1]]]),
            ("MultiPoint", [])]
    s = shapes(spark, rows)
    flags = {r.ord: (r.empty, r.corrupt, len(r.edges)) for r in s.collect()}
    assert [flags[i] for i in range(6)] == [(False, False, n) for n in (2, 2, 1, 1, 8, 4)]
    assert flags[6][:2] == (True, False) and flags[10][:2] == (True, False)
    assert all(flags[i] == (False, True, 0) for i in (7, 8, 9))
    pairs = [(5, i) for i in range(5)] + [(4, 1), (0, 3)]
    got = measures(spark, rows, pairs)
    assert all(got[p].meets for p in pairs[:-1]) and ((0, 3) not in got or not got[(0, 3)].meets)
    assert got[(5, 4)].area == pytest.approx(1.0) and got[(5, 0)].area == 0 and got[(5, 1)].area == 0


def test_nearest_equals_brute_force(spark):
    r = random.Random(5)
    left = [box(x := r.randint(0, 90), y := r.randint(0, 90), x + 2, y + 2) for _ in range(25)]
    left.append(box(5000, 5000, 5001, 5001))
    right = [box(x := r.randint(0, 40), y := r.randint(0, 40), x + 3, y + 1) for _ in range(20)]
    a, b = shapes(spark, left), shapes(spark, right)

    def gap(p, q):
        (x0, y0), (x1, y1) = p[1][0][0], p[1][0][2]
        (u0, v0), (u1, v1) = q[1][0][0], q[1][0][2]
        return (max(0, u0 - x1, x0 - u1) ** 2 + max(0, v0 - y1, y0 - v1) ** 2) ** 0.5

    got = {r.a_ord: (r.b_ord, r.distance) for r in nearest(a, b).collect()}
    assert len(got) == len(left)
    for i, p in enumerate(left):
        d, j = min((round(gap(p, q), 9), j) for j, q in enumerate(right))
        assert got[i][1] == pytest.approx(d, abs=1e-9) and got[i][0] == j
    assert nearest(a, b.limit(0)).count() == 0


def test_nearest_of_far_clusters_measures_few_pairs(spark):
    """Two dense fields far apart: the pairs that are measured grow far slower than all pairs."""
    from groundcheck.operators import nearest as N

    def field(n, x, y):
        return [box(x + 10 * (i % n), y + 10 * (i // n), x + 10 * (i % n) + 6, y + 10 * (i // n) + 4) for i in range(n * n)]

    kept = {}
    for n in (8, 16):
        left, right = field(n, 0, 0) + [box(4e5, 1e5, 4e5 + 1, 1e5 + 1)], field(n, 1e6, 3e5) + [box(-7e5, 2e5, -7e5 + 3, 2e5 + 3)]
        a, b = shapes(spark, left), shapes(spark, right)
        found = N.far_candidates(a, b, 6.0).collect()
        kept[n] = len(found)
        gap = {}
        for i, p in enumerate(left):
            (x0, y0), (x1, y1) = p[1][0][0], p[1][0][2]
            for j, q in enumerate(right):
                (u0, v0), (u1, v1) = q[1][0][0], q[1][0][2]
                gap[i, j] = (max(0, u0 - x1, x0 - u1) ** 2 + max(0, v0 - y1, y0 - v1) ** 2) ** 0.5
        for r in found:
            assert r.low <= gap[r.a_ord, r.b_ord] * (1 + 1e-9)
            assert min(gap[r.a_ord, j] for j in range(len(right))) <= r.high * (1 + 1e-9)
        want = {i: min((gap[i, j], j) for j in range(len(right))) for i in range(len(left))}
        assert {i: j for i, (_, j) in want.items()}.items() <= {**{r.a_ord: r.b_ord for r in nearest(a, b).collect()}}.items()
    assert kept[8] <= 16 * 65 and kept[16] <= 8 * kept[8] and kept[16] < 257 * 257 / 8


def test_nearest_of_far_strips_keeps_few_pairs_of_cells(spark, monkeypatch):
    """Two strips side by side, far apart: the pairs of cells that are kept on the way grow with the strips' length."""
    from groundcheck.operators import nearest as N

    kept = []

    def counted(df, real=N.cut_lineage):
        out = real(df)
        if "b_cx" in df.columns:
            kept.append(out.count())
        return out

    monkeypatch.setattr(N, "cut_lineage", counted)
    n = 150
    left = [box(3 * (i % 3), 10 * i, 3 * (i % 3) + 6, 10 * i + 7) for i in range(n)]
    right = [box(1e5 + 2 * (i % 2), 10 * i + 3, 1e5 + 9, 10 * i + 9) for i in range(n)]
    got = {r.a_ord: (r.b_ord, r.distance) for r in nearest(shapes(spark, left), shapes(spark, right)).collect()}
    assert max(kept) <= 20 * n
    for i, p in enumerate(left):
        (x0, y0), (x1, y1) = p[1][0][0], p[1][0][2]
        d, j = min((math.hypot(q[1][0][0][0] - x1, max(0, q[1][0][0][1] - y1, y0 - q[1][0][2][1])), j) for j, q in enumerate(right))
        assert got[i][0] == j and got[i][1] == pytest.approx(d, rel=1e-12)


def test_layers_are_spread_before_they_get_edges(spark, tmp_path, monkeypatch):
    """What is shuffled to spread a layer holds no edges; they are made behind it."""
    from driver import layers as L

    plans = []
    monkeypatch.setattr(L, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or df)
    spark.range(5).selectExpr("id as p_partkey").write.parquet(str(tmp_path / "part.parquet"))
    rows = L.boxes(spark, str(tmp_path), L.PARCELS).collect()
    assert {r.ord for r in rows} == set(range(5)) and all(len(r.edges) == 4 for r in rows)
    above, below = plans[0].split("RepartitionByExpression", 1)
    assert "edges" in above and "edges" not in below


def test_a_long_chain_of_candidates_takes_few_rounds(spark, monkeypatch):
    """Each pair of a chain waits for the one before it; components are solved whole instead."""
    rows = [(i // 2, (i + 1) // 2, f"A{i // 2:03d}", f"B{(i + 1) // 2:03d}", 0.4 + i / 1000) for i in range(200)]
    chain = spark.createDataFrame(rows, "a_ord long, b_ord long, a_id string, b_id string, iou double")
    steps = []
    plain = matching.cut_lineage
    monkeypatch.setattr(matching, "cut_lineage", lambda df: (steps.append(1), plain(df))[1])

    def greedy(order, a, b):
        used, out = set(), set()
        for r in sorted(rows, key=order):
            if r[a] not in used and r[b] not in used:
                used |= {r[a], r[b]}
                out.add(r[2:4])
        return out

    got = {(r.a_id, r.b_id) for r in matching.match_best_first(chain).collect()}
    assert got == greedy(lambda r: (-r[4], r[2], r[3]), 2, 3) and len(steps) <= 12
    got = {(r.a_id, r.b_id) for r in matching.match_in_order(chain).collect()}
    used, want = set(), set()
    for r in sorted(rows, key=lambda r: (r[0], -r[4], r[1])):
        if ("a", r[0]) not in used and ("b", r[1]) not in used:
            used |= {("a", r[0]), ("b", r[1])}
            want.add(r[2:4])
    assert got == want


def test_smallest_keys_by_histogram(spark):
    from groundcheck.operators import selection

    r = random.Random(3)
    keys = [r.choice([r.randrange(2**60), r.randrange(50)]) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(keys)), "i int, k long")
    for n in (0, 1, 37, 399, 400, 500):
        got = {x.i for x in selection.first_n(df, n, F.col("k"), ("i",)).collect()}
        assert got == {i for i, _ in sorted(enumerate(keys), key=lambda p: (p[1], p[0]))[:n]}
    key = df.select(selection.seeded_key(7, "i").alias("h")).collect()
    assert len({x.h for x in key}) == 400 and all(0 <= x.h < 2**60 for x in key)


def test_matching_rounds_equal_greedy(spark):
    for seed in (1, 2):
        r = random.Random(seed)
        pairs = {(r.randint(0, 12), r.randint(0, 12)): r.choice([0.4, 0.5, 0.6, 0.7]) for _ in range(60)}
        rows = [(p, g, f"p{p:02d}", f"g{g:02d}", v) for (p, g), v in pairs.items()]
        c = spark.createDataFrame(rows, "a_ord long, b_ord long, a_id string, b_id string, iou double")
        used_p, used_g, want = set(), set(), set()
        for p, g, pid, gid, v in sorted(rows, key=lambda t: (-t[4], t[2], t[3])):
            if p not in used_p and g not in used_g:
                used_p.add(p), used_g.add(g), want.add((pid, gid))
        assert {(m.a_id, m.b_id) for m in matching.match_best_first(c).collect()} == want
        used_g, want = set(), set()
        for p in sorted({t[0] for t in rows}):
            free = [t for t in rows if t[0] == p and t[1] not in used_g]
            if free:
                best = min(free, key=lambda t: (-t[4], t[1]))
                used_g.add(best[1]), want.add((best[2], best[3]))
        assert {(m.a_id, m.b_id) for m in matching.match_in_order(c).collect()} == want


def layer(spark, rows, source=V.REFERENCE_SOURCE, kind="building", prefix="F"):
    s = shapes(spark, rows)
    s = s.withColumns({
        "feature_id": F.concat(F.lit(prefix), F.col("ord").cast("string")), "source": F.lit(source),
        "feature_type": F.lit(kind), "confidence": F.lit(None).cast("double"),
        "area_sqm": G.area(F.col("edges"))})
    return topology.with_validity(s)


def test_benchmark_metrics(spark):
    pred = layer(spark, [box(0, 0, 10, 10)], prefix="P")
    ref = layer(spark, [box(0, 0, 10, 10), box(20, 20, 30, 30)], prefix="R")
    m = discrepancy.object_benchmark(pred, ref).first()
    assert (m.true_positives, m.false_positives, m.false_negatives, m.f1_score) == (1, 0, 1, 0.6667)
    none = discrepancy.object_benchmark(pred, ref.limit(0)).first()
    assert (none.false_positives, none.false_negatives, none.total_predictions) == (1, 0, None)
    t = discrepancy.discrepancy(pred, ref, 0.35)
    assert [r.feature_id for r in t["reference_only"].collect()] == ["R1"]
    assert discrepancy.report_heads(t)["matched"].first().iou == 1.0
    with pytest.raises(ValueError):
        discrepancy.discrepancy(pred, ref, 0.99)


def test_demo_layer_warnings(spark):
    """The demonstration layer raises exactly the documented warnings."""
    feats = normalize.normalize(fixtures.demo_features(spark), "building", "synthetic_test")
    syn = topology.with_validity(polygons.shape_table(G.add_shape(feats, G.metric_43n)))
    none = syn.limit(0)
    w = {r.warning_id: r for r in validation.all_warnings(none, none, none, syn).collect()}
    want = {
        "W-EMPTY-SYN-EMPTY-GEOM-1": None, "W-INVALID-SYN-INVALID-GEOM-1": None,
        "W-OVERLAP-SYN-BLD-OVERLAP-1-SYN-BLD-OVERLAP-2": 170.3439,
        "W-OVERLAP-SYN-BLD-ROAD-INT-1-SYN-ROAD-CORRIDOR-1": 227.1249,
        "W-OVERLAP-SYN-BLD-PARCEL-CROSS-1-SYN-PARCEL-DEMO-1": 425.8577,
        "W-RD-OVERLAP-SYN-BLD-ROAD-INT-1-SYN-ROAD-CORRIDOR-1": 227.1249,
        "W-PARCEL-CROSS-SYN-BLD-PARCEL-CROSS-1-SYN-PARCEL-DEMO-1": 425.8578}
    assert set(w) == set(want)
    for k, v in want.items():
        if v is not None:
            assert w[k].measured_value == pytest.approx(v, rel=1e-5)
    assert {r.severity for k, r in w.items() if "RD-OVERLAP" not in k} == {"high"}
    assert w["W-RD-OVERLAP-SYN-BLD-ROAD-INT-1-SYN-ROAD-CORRIDOR-1"].severity == "low"
    assert "170.3 m²" in w["W-OVERLAP-SYN-BLD-OVERLAP-1-SYN-BLD-OVERLAP-2"].explanation


def test_outside_parcel_rule(spark):
    """Gap between the documented parcel and building boxes."""
    def deg(x0, y0, x1, y1):
        s = shapes(spark, [box(x0, y0, x1, y1)], G.metric_43n)
        return topology.with_validity(s.withColumns({
            "feature_id": F.lit(f"X{x0}"), "source": F.lit("project_vaayu_sample"),
            "feature_type": F.lit("building"), "confidence": F.lit(None).cast("double")}))

    b, p = deg(72.752, 23.040, 72.753, 23.041), deg(72.750, 23.040, 72.751, 23.041)
    w = topology.outside_warnings(b, p, 11).first()
    assert w.measured_value == pytest.approx(102.518, abs=0.01) and w.severity == "high"
    assert topology.outside_warnings(b, p.limit(0), 11).count() == 0


WARNINGS = ("warning_id string, feature_ids array<string>, rule_rank int, ord_a long, ord_b long, "
            "warning_type string, evidence " + topology.EVIDENCE_TYPE)


def test_scores(spark):
    f = spark.createDataFrame([
        ("A", "building", "project_vaayu_sample", "unverified", None, 120.0),
        ("B", "building", "project_vaayu_sample", "unverified", None, 850.0),
        ("C", "building", "project_vaayu_sample", "approved", None, 120.0),
        ("D", "building", "ai_building_model", "unverified", 0.5, None),
        ("E", "building", "ai", "unverified", 0.5, 100.0)],
        "feature_id string, feature_type string, source string, review_status string, "
        "confidence double, area_sqm double")
    many = [(f"W-OVERLAP-{i:03d}", ["B", "Z"], 5, i, 0, "overlapping_polygons",
             [("overlap_area_m2", 2.0, None)]) for i in range(40)]
    w = spark.createDataFrame(many + [("W-INVALID-D", ["D"], 1, 0, 0, "invalid_geometry", [])], WARNINGS)
    s = {r.feature_id: r for r in scoring.review_scores(f, w).collect()}
    assert {k: r.total_score for k, r in s.items()} == {"A": 10, "B": 60, "C": 0, "D": 70, "E": 10}
    assert s["D"].priority == "high" and s["B"].priority == "medium"
    text_b = [r.description for r in s["B"].rules if r.rule_id == "R_SPATIAL_OVERLAP_WARNING"][0]
    assert text_b.endswith("(40 warnings active: W-OVERLAP-000, W-OVERLAP-001, W-OVERLAP-002)")
    detail = scoring.feature_detail(scoring.review_scores(f, w), w, "B").first()
    assert len(detail.warning_ids) == 40
    assert detail.measured_evidence.startswith("W-OVERLAP-000: overlap_area_m2=2.0; W-OVERLAP-001")


def test_parcel_status(spark):
    p = layer(spark, [box(0, 0, 20, 20), box(100, 0, 120, 20)], "synthetic_test", "parcel", "P")
    b = layer(spark, [box(1, 1, 12, 12), box(18, 18, 22, 22), box(101, 1, 113, 12)])
    w = topology.crossing_warnings(b, p, 10)
    r = {x.parcel_id: x for x in parcels.parcel_report(p, b, None, w).collect()}
    assert r["P0"].rag_status == "RED" and r["P0"].intersecting_building_count == 2
    assert r["P1"].rag_status == "GREEN" and r["P1"].parcel_score == 10
    assert parcels.evaluation_status(p.limit(0)).first().status == "not_evaluated"


def test_fixed_text_matches_python(spark):
    r = random.Random(3)
    vals = [r.uniform(0, 5000) for _ in range(200)] + [k / 1000 for k in range(0, 3000, 5)] + [
        0.25, 12.25, 12.75, 0.95, 9.995, 1e-9, 123456.05]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    got = df.select("v", *[text.fixed(F.col("v"), d).alias(f"d{d}") for d in (1, 2, 3)]).collect()
    for row in got:
        assert (row.d1, row.d2, row.d3) == (f"{row.v:.1f}", f"{row.v:.2f}", f"{row.v:.3f}")


def test_fixed_text_rounds_ties_by_the_stored_value(spark):
    values = [0.0005, 0.0015, 0.05, 0.15, 0.25, 2.5005, 1024.0625, -0.03125, 999.9995, 95097677440844.52, 1099511627776.1875, 2.0**60]
    values += [k * 0.0005 for k in range(300)] + [k / 16 for k in range(100)]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", *[
        text.fixed(F.col("v"), d).alias(f"d{d}") for d in (1, 2, 3)]).collect()
    assert all(r[d] == f"{r.v:.{d}f}" for r in got for d in (1, 2, 3))
    # a number of evidence is not worked out once for each of its digits' parts
    plan = spark.range(1).select(text.fixed(F.col("id") + 0.5, 3))._jdf.queryExecution().optimizedPlan().toString()
    assert "format_number(" in plan


def test_narration_templates(spark):
    tol = "struct<name:string,value:double,unit:string,flag:string>"
    df = spark.createDataFrame([
        ("W-1", "overlap", ["A", "B"], "Template.", [("overlap_area_m2", 3.25, None)],
         ("overlap_area_m2", 1.0, "m2", None), ("desk_review", "Check both boundaries.")),
        ("W-2", "overlap", ["A"], "Two polygons overlap spatially.", [], None, None)],
        f"warning_id string, warning_type string, feature_ids array<string>, explanation string, "
        f"evidence {topology.EVIDENCE_TYPE}, tolerance {tol}, "
        "suggested_action struct<action_type:string,text:string>")
    n = {r.warning_id: r.narrative for r in topology.narratives(df).collect()}
    assert n["W-1"] == (
        "Overlap for feature(s) A, B. Measured evidence: overlap area: 3.25 m2. "
        "Review tolerance: overlap area m2 is 1 m2. Suggested action: Check both boundaries.")
    assert n["W-2"] == "Two polygons overlap spatially."


def test_boxes_visit_few_cells_and_only_crowded_counters_are_counted_by_cell(spark, monkeypatch):
    visited, stored, visits, cut = [], [], gridjoin._visits, gridjoin.cut_lineage

    def counting(df, text):
        out = visits(df, text)
        visited.append(out.count())
        return out

    def storing(df):
        out = cut(df)
        stored.append((out.columns, out.count()))
        return out

    monkeypatch.setattr(gridjoin, "_visits", counting)
    monkeypatch.setattr(gridjoin, "cut_lineage", storing)
    monkeypatch.setattr(gridjoin, "BLOCK_ROWS", 12)
    monkeypatch.setattr(gridjoin, "COUNTED", 1)
    ends = [(100 * (i // 20) + 5 * (i % 20), 40 * i, 3) for i in range(400)] + [(9, 17, 3)] * 30
    s = spark.createDataFrame([(i, float(x), float(y), float(x + w), float(y + w)) for i, (x, y, w) in enumerate(ends)],
                              "ord long, minx double, miny double, maxx double, maxy double").cache()
    got = {(r.a_ord, r.b_ord) for r in gridjoin.grid_pairs(s).collect()}
    want = {(i, j) for i, (x, y, w) in enumerate(ends) for j, (u, v, _) in enumerate(ends)
            if i < j and abs(x - u) <= w and abs(y - v) <= w}
    assert got == want and len(want) >= 435
    assert max(visited) < 2 * len(ends)
    assert stored[0][0] == ["counter"] and 1 <= stored[0][1] <= 8  # of some 500 cells


def test_nearest_among_long_strips_compares_few_pairs(spark, monkeypatch):
    """Long thin shapes are looked for within their width, not within their length."""
    from groundcheck.operators import nearest as N

    counts, pairs = [], N.grid_pairs

    def counted(*args, **kw):
        found = pairs(*args, **kw)
        counts.append(found.count())
        return found

    monkeypatch.setattr(N, "grid_pairs", counted)
    strips = shapes(spark, [box(i % 3, 20 * i, 1000 + i % 3, 20 * i + 2) for i in range(60)]).cache()
    places = [(37 * i % 900, 61 * i % 1180) for i in range(40)]
    got = {r.a_ord: (r.b_ord, r.distance) for r in nearest(shapes(spark, [box(x, y, x + 4, y + 4) for x, y in places]), strips).collect()}
    for i, (x, y) in enumerate(places):
        gap, at = min((math.hypot(max(j % 3 - x - 4, 0), max(20 * j - y - 4, y - 20 * j - 2, 0)), j) for j in range(60))
        assert got[i][0] == at and got[i][1] == pytest.approx(gap)
    assert max(counts) < 80  # 2,400 before


def test_warning_summary_moves_links_once(spark):
    links = spark.createDataFrame(
        [("f", 5, k, 0, f"W-OVERLAP-{9 - k}") for k in range(5)] + [("f", 1, 0, 0, "W-INVALID-f"), ("f", 1, 0, 0, "W-EMPTY-f"),
         ("g", 1, 0, 0, "W-CORRUPT-g"), ("h", 7, 2, 1, "W-b"), ("h", 7, 2, 1, "W-a")],
        "feature_id string, rule_rank int, ord_a long, ord_b long, warning_id string")
    summary = scoring.warning_summary(links)
    assert summary._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert {r.feature_id: tuple(r)[1:] for r in summary.collect()} == {
        "f": (7, 1, 1, 5, ["W-OVERLAP-9", "W-OVERLAP-8", "W-OVERLAP-7"]), "g": (1, 1, 0, 0, None), "h": (2, 0, 0, 2, ["W-a", "W-b"])}


def test_parcel_report_stores_each_layer_once(spark, tmp_path, monkeypatch):
    from driver import layers as L, vector

    for name, column, n in (("orders", "o_orderkey", 60), ("part", "p_partkey", 12), ("supplier", "s_suppkey", 3)):
        spark.range(1, n + 1).toDF(column).write.parquet(str(tmp_path / f"{name}.parquet"))
    stored, boxes = [], L.boxes
    monkeypatch.setattr(L, "boxes", lambda s, d, text: stored.append(text) or boxes(s, d, text))
    assert vector.parcel_rag(spark, str(tmp_path)).count() == 12
    assert len(stored) == len(set(stored)) == 4


def test_touching_rings_are_judged_in_batches():
    """One call sees many parts; a part may begin in one batch and end in the next."""
    import pyarrow as pa

    cycle = [(0, 1.0, 1.0), (1, 1.0, 1.0), (0, 2.0, 2.0), (1, 2.0, 2.0)]
    tree = [(0, 1.0, 1.0), (1, 1.0, 1.0), (2, 1.0, 1.0)]
    rows = [(ord_, part, *t) for ord_, part, touches in ((7, 0, cycle), (8, 0, tree), (8, 1, tree), (2**60 + 1, 0, cycle))
            for t in touches]
    for size in (1, 3, 100):
        batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i:i + size])], ["ord", "part", "ring", "tx", "ty"])
                   for i in range(0, len(rows), size)]
        assert [v for b in polygons._cut_apart(iter(batches)) for v in b.column("ord").to_pylist()] == [7, 2**60 + 1]


def _random_shapes(spark, seed, count, size):
    rng = random.Random(seed)
    rows = []
    for i in range(count):
        x, y = rng.uniform(0, 60), rng.uniform(0, 60)
        w, h = rng.uniform(1, size), rng.uniform(1, size)
        rows.append([("Polygon", [[[x, y], [x + w, y + h / 3], [x + w / 2, y + h], [x, y]]]), box(x, y, x + w, y + h), HOLED,
                     ("LineString", [[x, y], [x + w, y + h]]), ("Point", [x, y])][i % 5])
    s = shapes(spark, rows).withColumn("feature_id", F.concat(F.lit("F-"), "ord")).withColumn("source", F.lit("s"))
    return topology.with_validity(s)


@pytest.mark.parametrize("large", [False, True])
def test_measured_pairs_equal_pairs_measured_apart(spark, large):
    a, b = _random_shapes(spark, 1, 60, 9).cache(), _random_shapes(spark, 2, 20, 40).cache()
    for right in (None, b):
        other = a if right is None else right
        want = {(r.a_ord, r.b_ord): (round(r.area, 9), r.meets)
                for r in polygons.pair_measures(gridjoin.grid_pairs(a, right), a, other, False).collect()}
        got = polygons.measured_pairs(a, right, ("feature_id",), ("feature_id",), large).collect()
        assert {(r.a_ord, r.b_ord): (round(r.area, 9), r.meets) for r in got} == want and len(got) == len(want) > 50
        assert all((r.a_feature_id, r.b_feature_id) == (f"F-{r.a_ord}", f"F-{r.b_ord}") for r in got)


def test_packed_edges_come_back_whole(spark):
    s = _random_shapes(spark, 3, 15, 9)
    back = polygons.packed(s).selectExpr("ord", "minx", "miny", "maxx", "maxy", f"{polygons.unpacked()} as edges", *[
        f"{e} as p_{c}" for c, e in polygons._PACKED_BOX.items()]).collect()
    assert {r.ord: r.edges for r in back} == {r.ord: r.edges for r in s.collect()}
    assert all(r[c] == r[f"p_{c}"] for r in back for c in polygons._PACKED_BOX)


def test_shapes_are_dealt_once_for_a_rule(spark):
    """Neither pairs nor names are shuffled again, and the rules on one layer deal it alike."""
    a, b = (_random_shapes(spark, seed, 40, 9).cache() for seed in (1, 2))
    for pairs in (topology.overlap_pairs(a, large=False), topology.road_pairs(a, b, large=False),
                  topology.parcel_contacts(a, b, large=False)):
        plan = pairs._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("RepartitionByExpression") == 2
        assert plan.count("Join Inner") == 1 and plan.count("Aggregate [") == 1


def test_wide_boxes_go_to_the_cells_of_many_small_ones(spark):
    small = shapes(spark, [box(3 * i, 0, 3 * i + 2, 2) for i in range(400)])
    wide = shapes(spark, [box(0, 3 * i, 1200, 3 * i + 10) for i in range(3)])
    a, b = (gridjoin._home_level(df) for df in (small, wide))
    assert gridjoin._left_stays(a, b, *(gridjoin._stats(df)[1] for df in (a, b)))
    assert not gridjoin._left_stays(a.limit(5), b, *(gridjoin._stats(df)[1] for df in (a, b)))
    want = {(i, 0) for i in range(400)}
    assert {(r.a_ord, r.b_ord) for r in gridjoin.grid_pairs(small, wide).collect()} == want
    assert gridjoin.grid_pairs(small, wide).count() == 400


def test_pairs_of_a_repeated_ord_are_joined_by_it(spark):
    rows = shapes(spark, [box(0, 0, 10, 10), box(5, 5, 15, 15)])
    s = topology.with_validity(rows.withColumn("feature_id", F.col("ord").cast("string")).withColumn("source", F.lit("s")))
    twice = s.unionByName(s.filter("ord = 0")).cache()
    assert polygons.repeats(s, twice) and not polygons.repeats(s, s)
    joined = polygons.pair_measures(gridjoin.grid_pairs(twice), twice, twice, False).first()
    got = topology.overlap_pairs(twice, large=False).collect()
    assert [(r.a_ord, r.b_ord, r.area) for r in got] == [(0, 1, joined.area)] * 2
