import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from groundcheck.functions import geometry as G
from groundcheck.lineage import cut_lineage
from groundcheck.operators import polygons, topology
from groundcheck.plans import review, validation
from groundcheck.sources import catalog, fixtures, geojson, imagery, normalize
from groundcheck.streaming import revalidate, review_log

DOC = {"type": "FeatureCollection", "name": "demo", "features": [
    {"type": "Feature", "id": "B-1", "geometry": {"type": "Polygon", "coordinates": [
        [[0, 0], [1, 0], [1, 1], [0, 0]]]},
     "properties": {"owner_name": "X", "property_card_no": "9", "valid_field": "kept",
                    "source": "manual_visual_reference", "area_sqm": 12.5, "warning_ids": ["W"]}},
    {"type": "Feature", "id": "B-2", "geometry": None, "properties": {"no_floors": 2, "source": "OSM"}}]}


def test_read_and_normalize(spark, tmp_path):
    (tmp_path / "a.geojson").write_text(json.dumps(DOC))
    raw = geojson.read_collection(spark, str(tmp_path / "a.geojson"))
    rows = normalize.normalize(raw, "building").orderBy("ord").collect()
    a, b = rows
    assert (a.source, a.extra, a.area_sqm, a.warning_ids) == (
        "project_vaayu_sample", {"valid_field": "kept"}, 12.5, ["W"])
    assert (b.source, b.source_date, b.no_floors, b.extra, b.geom_type) == (
        "osm", "2026-09-28", 2, None, None)
    assert geojson.polygon_labels(raw).count() == 1
    with pytest.raises(ValueError):
        geojson.polygon_labels(raw.filter("ord = 1"))


def test_broken_collections(spark):
    docs = [("[1]",), ('{"type":"Feature"}',), ('{"type":"FeatureCollection"}',), (json.dumps(DOC),)]
    errors = [r.error for r in geojson.collection_errors(
        spark.createDataFrame(docs, "text string")).collect()]
    assert errors[3] is None and all(errors[:3])
    assert geojson.parse_collections(spark.createDataFrame(docs, "text string"), "skip").count() == 2


def test_bundle_round_trip(spark, tmp_path):
    feats = normalize.normalize(fixtures.demo_features(spark), "building", "synthetic_test")
    out = str(tmp_path / "bundle")
    geojson.write_bundle(geojson.export_bundle({"synthetic": feats, "parcels": feats}), out)
    back = geojson.import_bundle(spark.read.text(out).select("value"))
    assert back.groupBy("layer").count().collect()[0]["count"] == 8
    again = normalize.normalize(back, "building", "synthetic_test")

    def rows(df):
        return sorted((r.feature_id, r.source, str(json.loads(r.coords_json)), r.area_sqm or 0.0)
                      for r in df.collect())

    assert rows(again) == rows(feats)
    lines = geojson.read_lines(spark, out)
    assert lines.filter("ord is not null").count() == 8
    quoted = feats.limit(1).withColumn("feature_id", F.lit('a"]\\b'))
    assert geojson.import_bundle(geojson.export_bundle({"drafts": quoted})).first().id == 'a"]\\b'


def events(spark, rows):
    t0 = datetime(2024, 1, 1)
    return spark.createDataFrame(
        [(i, t0 + timedelta(hours=h), f, a, s, w, n) for i, h, f, a, s, w, n in rows],
        "event_id long, ts timestamp, feature_id string, action string, new_status string, "
        "reviewer string, notes string")


LOG = [
    (1, 1, "A", "status_update", "under_review", "r1", "look"), (2, 2, "A", "geometry_edit", None, "r2", None),
    (3, 3, "A", "revert_geometry", None, "r3", None), (4, 4, "A", "status_update", "approved", "r1", None),
    (4, 4, "A", "status_update", "approved", "r1", None), (5, 5, "B", "geometry_edit", None, "r2", None),
    (6, 6, "B", "status_update", "nonsense", "r2", None)]


def test_review_state_and_history(spark):
    s = {r.feature_id: r for r in review.review_state(events(spark, LOG)).collect()}
    a = s["A"]
    assert (a.review_status, a.notes, a.edited_by, a.is_manually_edited, a.n_status) == (
        "approved", "look", "r1", False, 2)
    assert "Reverted" in a.edit_reason
    assert s["B"].is_manually_edited and s["B"].review_status == "unverified"
    h = review.audit_history(events(spark, LOG)).filter("feature_id = 'A'").orderBy("position").collect()
    assert [r.position for r in h] == [1, 2, 3, 4] and h[2].reviewer is None


def test_stream_fold_equals_batch(spark, tmp_path):
    """Files arriving out of order, with a repeated event, end in the batch state."""
    src = tmp_path / "in"
    all_events = events(spark, LOG).select("*").cache()
    for i, part in enumerate(("event_id in (4, 5)", "event_id in (1, 4)", "event_id in (2, 3, 6)")):
        all_events.filter(part).coalesce(1).write.mode("append").parquet(f"{src}/f={i}")
        stream = spark.readStream.schema(all_events.schema).parquet(f"{src}/f=*")
        q = review_log.run_fold(stream, str(tmp_path / "state"), str(tmp_path / "ck"), delay="30 days")
        q.awaitTermination()
    got = review_log.read_state(spark, str(tmp_path / "state"))
    want = review.review_state(all_events)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert review_log.read_late(spark, str(tmp_path / "state")).count() == 0
    late = review_log.late_events(all_events, delay_days=0.15)
    assert {r.event_id for r in late.collect()} == {1, 2}


def test_stream_splits_late_rows_and_rewrites_only_touched_buckets(spark, tmp_path):
    """Kept, repeated and late rows are all rows; a batch that is run again changes nothing."""
    folder, src = str(tmp_path / "state"), tmp_path / "in"
    batches = [[(1, 10, "A", "status_update", "approved", "r", None), (2, 11, "B", "geometry_edit", None, "r", None)],
               [(1, 10, "A", "status_update", "approved", "r", None), (3, 30, "A", "status_update", "rejected", "r", None),
                (3, 30, "A", "status_update", "rejected", "r", None)],
               [(4, 27, "C", "status_update", "approved", "r", None), (5, 31, "D", "geometry_edit", None, "r", None),
                (1, 10, "A", "status_update", "approved", "r", None), (3, 30, "A", "status_update", "rejected", "r", None)]]
    calls = []
    for i, rows in enumerate(batches):
        events(spark, rows).coalesce(1).write.parquet(f"{src}/f={i}")
        stream = spark.readStream.schema(events(spark, rows).schema).parquet(f"{src}/f=*")
        review_log.run_fold(stream, folder, str(tmp_path / "ck"), delay="2 hours", buckets=4,
                            after=lambda s, ids, b: calls.append((b, {r[0] for r in ids.collect()}, s.count()))).awaitTermination()
    assert calls == [(0, {"A", "B"}, 2), (1, {"A"}, 2), (2, {"D"}, 3)]
    late = sorted((r["event_id"], r["b"]) for r in review_log.read_late(spark, folder).collect())
    assert late == [(1, 2), (4, 2)]
    kept = events(spark, [batches[0][0], batches[0][1], batches[1][1], batches[2][1]])
    want = sorted(map(str, review.review_state(kept).collect()))
    assert sorted(map(str, review_log.read_state(spark, folder).collect())) == want
    record = review_log._record(spark, folder)
    assert record["version"] == 2 and len(set(record["buckets"].values())) > 1 and set(record["recent"]) == {1, 2}
    # the last batch once more, from the record before it
    before = review_log._record(spark, folder, before=2)
    assert before["version"] == 1 and set(before["recent"]) == {1}


def test_apply_state_restores_shape(spark):
    f = spark.createDataFrame(
        [("A", "unverified", "edited", "orig"), ("B", "unverified", "orig", "orig"), ("C", "rejected", "x", "x")],
        "feature_id string, review_status string, coords_json string, original_coords_json string")
    ev = events(spark, LOG).withColumn("coords_json", F.when(F.col("event_id") == 5, "new"))
    out = {r.feature_id: r for r in review.apply_state(f, review.review_state(ev)).collect()}
    assert (out["A"].coords_json, out["A"].review_status) == ("orig", "approved")
    assert (out["B"].coords_json, out["C"].review_status) == ("new", "rejected")


def test_incremental_equals_full(spark):
    def layer(shift):
        rows = [(i, "Polygon", json.dumps([[[x, 0], [x + 6, 0], [x + 6, 5], [x, 5], [x, 0]]]))
                for i in range(20) for x in [i * 5 + (shift if i % 7 == 0 else 0)]]
        df = spark.createDataFrame(rows, "ord long, geom_type string, coords_json string")
        s = polygons.shape_table(G.add_shape(df)).withColumns({
            "feature_id": F.concat(F.lit("F"), F.col("ord").cast("string")),
            "source": F.lit("project_vaayu_sample"), "feature_type": F.lit("building")})
        return cut_lineage(topology.with_validity(s))

    before, after = layer(0), layer(9)
    changed = after.filter("ord % 7 = 0").select("feature_id")
    got = revalidate.refresh_overlaps(cut_lineage(topology.overlap_warnings(before, 5)), after, changed)
    cols = ("warning_id", "measured_value")
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(
        map(tuple, topology.overlap_warnings(after, 5).select(*cols).collect()))


def _project(spark, rows):
    """Validated layers by name from ``(layer, feature_id, feature_type, source, confidence, coordinates)``."""
    out = {}
    for name in ("buildings", "roads", "parcels", "synthetic"):
        mine = [(i, *r[1:5], "Polygon", r[5]) for i, r in enumerate(rows) if r[0] == name]
        df = spark.createDataFrame(mine, "ord long, feature_id string, feature_type string, source string, "
                                         "confidence double, geom_type string, coords_json string")
        out[name] = cut_lineage(topology.with_validity(polygons.shape_table(G.add_shape(df))))
    return out


def _box(x, y, w, h):
    return json.dumps([[[x, y], [x + w, y], [x + w, y + h], [x, y + h], [x, y]]])


def test_delta_of_an_edit_equals_a_full_run_for_every_rule(spark):
    r = random.Random(6)

    def rows(edit):
        out = []
        for i in range(30):
            x, y = r0.randint(0, 120), r0.randint(0, 60)
            moved = edit and i % 6 == 0
            shape = _box(x + 15 * moved, y, 9, 7)
            if i in (3, 12):
                shape = json.dumps([[[x, y], [x + 9, y + 7], [x + 9, y], [x, y + 7], [x, y]]]) if not edit or i == 3 else shape
            if i == 4:
                shape = "[]" if edit else shape
            if i == 5:
                shape = "[[1" if edit else shape
            if i == 7 and edit:
                continue
            out.append(("buildings", f"B{i}", "building", "ai_model" if i % 2 else "survey", 0.5 + 0.3 * (edit and i % 10 == 1), shape))
        for i in range(4):
            out.append(("roads", f"R{i}", "village_road_polygon", "survey", None, _box(0, 14 * i + 5 * (edit and i == 2), 130, 3)))
        for i in range(12):
            if i == 9 and not edit or i == 10 and edit:
                continue
            out.append(("parcels", f"P{i}", "parcel", "survey", None, _box(40 * (i % 4) + 25 * (edit and i % 5 == 0), 25 * (i // 4), 20, 12)))
        for i in range(12):
            kind = ("synthetic_building", "synthetic_road_corridor", "synthetic_parcel")[i % 3]
            out.append(("synthetic", f"S{i}", kind, "synthetic_test", None,
                        _box(r0.randint(0, 30) + 4 * (edit and i in (0, 2)), r0.randint(0, 20), 12, 9)))
        return out

    seed = r.random()
    r0 = random.Random(seed)
    old_rows = rows(False)
    r0 = random.Random(seed)
    new_rows = rows(True)
    before, after = _project(spark, old_rows), _project(spark, new_rows)
    changed = {}
    for name in before:
        a, b = ({x[1]: x[2:] for x in side if x[0] == name} for side in (old_rows, new_rows))
        ids = [k for k in a.keys() | b.keys() if a.get(k) != b.get(k)]
        changed[name] = spark.createDataFrame([(k,) for k in ids], "feature_id string")
    kw = {"large": False, "centre": False}
    old = cut_lineage(validation.all_warnings(*before.values(), stored=True, **kw))
    want = cut_lineage(validation.all_warnings(*after.values(), stored=True, **kw))
    delta = revalidate.revalidate(old, before, after, changed, **kw)
    cols = ("warning_id", "warning_type", "severity", "explanation", "rule_rank", "measured_value")

    def seen(df):
        return sorted((*[str(v) for v in row[:5]], None if row[5] is None else round(row[5], 6)) for row in map(tuple, df.select(*cols).collect()))

    assert seen(delta.apply(old)) == seen(want)
    assert {row.rule_rank for row in want.collect()} == set(range(1, 12)) - {2, 3}  # no broken road or synthetic shape
    assert delta.insert.count() < want.count()
    with pytest.raises(ValueError):
        revalidate.revalidate(old, before, {"buildings": after["buildings"]}, changed)


def test_snapshot_versions_and_unfinished_commits(spark, tmp_path):
    from groundcheck.sources import snapshots

    rows = [("A", "buildings", 0, "unverified", "", "x", "x"), ("A", "roads", 0, "unverified", "", "x", "x"),
            ("P", "ai_predictions", 0, "unverified", "", "p", "p")]
    cols = "feature_id string, layer string, ord int, review_status string, notes string, coords_json string, original_coords_json string"
    loaded = spark.createDataFrame(rows, cols)
    folder = str(tmp_path / "s")
    assert snapshots.restore_state(loaded, folder).count() == 3
    edited = spark.createDataFrame([("A", "buildings", 0, "approved", "seen", "y", "x"), ("D", "drafts", 0, "under_review", "", "d", "d"),
                                    ("Q", "ai_predictions", 0, "unverified", "", "q", "q")], cols)
    assert snapshots.publish_state(edited, folder, "c1") == 1 == snapshots.publish_state(loaded, folder, "c1")
    got = {(r.layer, r.feature_id, r.review_status, r.coords_json) for r in snapshots.restore_state(loaded, folder).collect()}
    # predictions without a source stay those loaded; an id in two layers gets the saved values in both
    assert got == {("buildings", "A", "approved", "y"), ("roads", "A", "approved", "y"), ("drafts", "D", "under_review", "d"),
                   ("ai_predictions", "P", "unverified", "p")}
    assert snapshots.publish_state(edited, folder, "c2", {"source_mode": "model", "provider_id": "mock"}) == 2
    again = {(r.layer, r.feature_id) for r in snapshots.restore_state(loaded, folder).collect()}
    assert {("ai_predictions", "Q"), ("ai_mock_predictions", "Q")} <= again and ("ai_predictions", "P") not in again
    # data without a manifest is not seen, and the commit can be tried again
    edited.limit(0).write.parquet(f"{folder}/data/c=c3/changed")
    assert snapshots.manifests(spark, folder).count() == 2
    assert snapshots.publish_state(loaded, folder, "c3") == 3
    assert {r.layer for r in snapshots.restore_state(loaded, folder, 1).collect()} == {"buildings", "roads", "drafts", "ai_predictions"}
    for bad in (lambda: snapshots.restore_state(loaded, folder, 9), lambda: snapshots.publish_state(loaded, folder, "../x"),
                lambda: snapshots.read_run_record(spark, folder, "p", "none")):
        with pytest.raises(ValueError):
            bad()


def test_drafts_and_lookup(spark):
    d = spark.createDataFrame([(0, "Polygon", "[]", ""), (1, "LineString", "[]", "n")],
                              "ord long, geom_type string, coords_json string, notes string")
    rows = review.draft_features(d, existing=998).collect()
    assert [r.feature_id for r in rows] == ["DRAFT-999", "DRAFT-1000"]
    assert rows[0].notes.startswith("User-created") and rows[1].feature_type == "draft_line"


def test_raster_rules_and_runs(spark):
    good = dict(epsg=3857, bands=4, width=10, height=10, a=0.3, b=0.0, c=1.0, d=0.0, e=-0.3, f=1.0,
                minx=0.0, miny=0.0, maxx=3.0, maxy=3.0, dtypes=["uint8"] * 4,
                colors=["blue", "green", "red", "alpha"])
    bad = {**good, "epsg": None, "maxx": 0.0, "dtypes": ["uint8", "uint8", "uint16", "uint8"]}
    schema = ("epsg int, bands int, width int, height int, a double, b double, c double, d double, "
              "e double, f double, minx double, miny double, maxx double, maxy double, "
              "dtypes array<string>, colors array<string>")
    g, b = catalog.check_rasters(spark.createDataFrame([good, bad], schema)).collect()
    assert g.errors == [] and g.rgb_band_mapping == [3, 2, 1] and g.alpha_band == 4
    assert len(b.errors) == 3
    p = {r.provider_id: r for r in catalog.providers(spark, {"whu": None}).collect()}
    assert p["whu"].enabled and not p["deeplab_spacenet"].enabled and p["deeplab_spacenet"].reason


def test_saved_run_must_belong_together(spark):
    pred = spark.createDataFrame([(0.5, "in_sample_full_AOI_fit_not_held_out")],
                                 "threshold double, metric_status string")
    audit = spark.createDataFrame([(317, "h")], "label_feature_count int, model_input_sha256 string")
    ok = spark.createDataFrame([("h",)], "input_raster_sha256 string")
    assert catalog.saved_run(pred, audit, ok, 317).first().provenance_ok
    with pytest.raises(Exception, match="provenance"):
        catalog.saved_run(pred, audit, ok.select(F.lit("z").alias("input_raster_sha256")), 317).collect()


def test_pairs_and_split(spark, tmp_path):
    for name in ("images/austin1.tif", "gt/austin1.tif", "images/vienna1.tif", "gt/vienna1.tif", "images/austin2.tif"):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(b"x")
    files = imagery.list_files(spark, str(tmp_path))
    pairs = {r.stem: r for r in imagery.pair_files(files).collect()}
    assert pairs["austin2"].error == "missing building mask" and pairs["vienna1"].error is None
    good = imagery.pair_files(files).filter("error is null")
    s = imagery.manifest_summary(imagery.split_by_city(good)).first()
    assert (s.status, s.validation_city, s.train_count, s.validation_count) == (
        "READY_FOR_TRAINING", "vienna", 1, 1)
    assert imagery.file_hashes(spark, str(tmp_path / "gt")).count() == 2


def test_scrub_nested(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1, nan, [1.0, nan], (float("inf"), "k"))],
                               "i int, d double, a array<double>, s struct<x:double,y:string>")
    r = normalize.scrub(df).first()
    assert r.d is None and r.a == [1.0, None] and r.s.x is None and r.s.y == "k"


def _document(name, kind="FeatureCollection"):
    return ('{"type":"%s","features":[{"type":"Feature","id":"%s","geometry":{"type":"Polygon",'
            '"coordinates":[[[0,0],[1,0],[1,1],[0,0]]]},"properties":{}}]}') % (kind, name)


def test_a_folder_of_documents_has_one_order_and_no_silent_loss(spark, tmp_path):
    for name in ("b", "a"):
        (tmp_path / f"{name}.geojson").write_text(_document(name))
    raw = geojson.read_collection(spark, str(tmp_path))
    assert [r.id for r in raw.orderBy("ord").collect()] == ["a", "b"]
    assert raw.select("ord").distinct().count() == 2
    (tmp_path / "c.geojson").write_text(_document("c", "Topology"))
    with pytest.raises(Exception, match="received type: Topology"):
        geojson.read_collection(spark, str(tmp_path)).collect()
    assert geojson.read_collection(spark, str(tmp_path), "skip").count() == 2
    rejected = geojson.collection_errors(geojson.read_documents(spark, str(tmp_path))).filter("error is not null")
    assert [r.path.rsplit("/", 1)[1] for r in rejected.collect()] == ["c.geojson"]


def test_broken_feature_lines_are_told(spark, tmp_path):
    (tmp_path / "x.txt").write_text('{"ord":4,"type":"Feature","id":"a","properties":{}}\nnot json\n{"type":"Feature"}\n')
    with pytest.raises(Exception, match="Line"):
        geojson.read_lines(spark, str(tmp_path)).collect()
    assert [r.ord for r in geojson.read_lines(spark, str(tmp_path), "skip").collect()] == [4]
    errors = geojson.line_errors(spark.read.text(str(tmp_path))).filter("error is not null")
    assert sorted(r.error for r in errors.collect()) == ["Line has no ord.", "Line is no JSON object."]


def test_a_retried_run_overwrites_its_own_rows(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1)], "feature_id string, ord long")
    for run in ("r-1", "r-1", "r-2"):
        catalog.write_run(spark, rows, "whu", run, str(tmp_path / "runs"))
    got = spark.read.parquet(str(tmp_path / "runs"))
    assert sorted((r["mode"], r["run_id"]) for r in got.collect()) == [("whu", "r-1"), ("whu", "r-2")]
    with pytest.raises(ValueError):
        catalog.write_run(spark, rows, "a/b", "a/b", str(tmp_path / "runs"))
