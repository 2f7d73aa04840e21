"""Queries over features, events and catalogs: normalization, bundles, review state, manifests."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from driver import layers as L
from groundcheck import fixed_values as V
from groundcheck.functions import crs, geometry
from groundcheck.lineage import checkpoint_folder, cut_lineage
from groundcheck.operators import topology
from groundcheck.operators.polygons import shape_table
from groundcheck.plans import review
from groundcheck.sources import catalog, geojson, imagery, normalize as N, snapshots
from groundcheck.streaming import review_log

# ---- raw features from customers ---------------------------------------------------------------
_RAW = """select c_custkey as ord, case when c_custkey % 7 <> 0 then concat('C-', cast(c_custkey as string)) end as id,
  c_name, c_mktsegment, c_acctbal, c_custkey % 5 as k5, c_custkey % 3 as k3, c_custkey as k
from {customer}"""


def _raw(spark, sf_dir) -> DataFrame:
    df = L.run(spark, sf_dir, _RAW)
    source = F.when(F.col("k5") == 0, "manual_visual_reference").when(F.col("k5") == 1, "OSM extract").when(
        F.col("k5") == 2, "synthetic_v2").when(F.col("k5") == 3, "survey")
    props = F.map_from_entries(F.array_compact(F.array(
        F.struct(F.lit("owner_name").alias("k"), F.col("c_name").alias("v")),
        F.struct(F.lit("property_card_no").alias("k"), F.col("k").cast("string").alias("v")),
        F.struct(F.lit("segment").alias("k"), F.col("c_mktsegment").alias("v")),
        F.when(F.col("k") % 2 == 0, F.struct(
            F.lit("building_id").alias("k"), F.concat(F.lit("BLD-"), F.col("k").cast("string")).alias("v"))),
        F.when(source.isNotNull(), F.struct(F.lit("source").alias("k"), source.alias("v"))),
        F.when(F.col("k3") == 0, F.struct(
            F.lit("area_sqm").alias("k"), F.col("c_acctbal").cast("string").alias("v"))),
        F.when(F.col("k3") == 1, F.struct(
            F.lit("locality").alias("k"), F.lit("Elsewhere").alias("v"))))))
    coords = F.concat(*[F.lit(t) if isinstance(t, str) else t.cast("string") for t in (
        "[[[", F.col("k"), ",0],[", F.col("k") + 1, ",0],[", F.col("k") + 1, ",1],[", F.col("k"), ",0]]]")])
    return df.select("ord", "id", props.alias("props"), F.lit("Polygon").alias("geom_type"),
                     coords.alias("coords_json"))


def normalize_features(spark, sf_dir) -> DataFrame:
    return N.normalize(_raw(spark, sf_dir), "building").select(
        "ord", "feature_id", "feature_type", "source", "source_date", "review_status", "notes",
        "locality", "lgd_village_code", F.round("area_sqm", 6).alias("area_sqm"),
        (F.col("coords_json") == F.col("original_coords_json")).alias("snapshot"))


def pii_scrub(spark, sf_dir) -> DataFrame:
    n = N.normalize(_raw(spark, sf_dir), "building")
    return n.select("ord", F.array_join(F.array_sort(F.map_keys("extra")), ",").alias("extra_keys"),
                    F.col("extra")["segment"].alias("segment"))


def source_correction(spark, sf_dir) -> DataFrame:
    raw = _raw(spark, sf_dir)
    out = None
    for kind, layer in (("building", V.REFERENCE_SOURCE), ("village_road_polygon", V.REFERENCE_SOURCE),
                        ("road", "osm"), ("parcel", "official_reference")):
        part = raw.select(F.lit(kind).alias("kind"), N.corrected_source(
            F.col("props")["source"], kind, layer).alias("source"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("kind", "source").agg(F.count(F.lit(1)).alias("n"))


def scrub_non_finite(spark, sf_dir) -> DataFrame:
    df = L.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.when(F.col("l_quantity") > 45, F.lit(float("nan"))).when(
            F.col("l_quantity") < 5, F.lit(float("inf"))).otherwise(F.col("l_quantity")).alias("q"),
        F.array(F.col("l_tax"), F.when(F.col("l_linenumber") == 1, F.lit(float("-inf"))).otherwise(
            F.col("l_discount"))).alias("arr"))
    clean = N.scrub(df)
    return clean.select("l_orderkey", "l_linenumber", "q", F.get("arr", F.lit(1)).alias("d"))


def collection_errors(spark, sf_dir) -> DataFrame:
    """Documents of several kinds made from customers, with the reason they cannot be read."""
    df = L.run(spark, sf_dir, _RAW)
    text = F.when(F.col("k5") == 0, '{"type":"FeatureCollection","features":[]}').when(
        F.col("k5") == 1, F.concat(F.lit('{"type":"'), "c_mktsegment", F.lit('","features":[]}'))).when(
        F.col("k5") == 2, '{"type":"FeatureCollection"}').when(
        F.col("k5") == 3, '{"type":"FeatureCollection","features":[],"crs":{"properties":{"name":"EPSG:3857"}}}'
    ).otherwise("[1, 2]")
    return geojson.collection_errors(df.select("ord", text.alias("text"))).select("ord", "error")


def _ring(*points) -> F.Column:
    """Coordinate text of a ring, moved east by the row's number."""
    parts = []
    for i, (x, y) in enumerate(points):
        parts += [F.lit("," if i else ""), F.lit("["), (F.col("k") + x).cast("string"), F.lit(f",{y}]")]
    return F.concat(F.lit("["), *parts, F.lit("]"))


def geometry_checks(spark, sf_dir) -> DataFrame:
    """Good, crossing, short, empty and hole-outside polygons read from coordinate text."""
    df = L.run(spark, sf_dir, _RAW)
    k, ring = F.col("k"), _ring
    box = ring((0, 0), (10, 0), (10, 10), (0, 10), (0, 0))
    one = lambda r: F.concat(F.lit("["), r, F.lit("]"))
    coords = (
        F.when(F.col("k5") == 0, one(box))
        .when(F.col("k5") == 1, one(ring((0, 0), (10, 10), (10, 0), (0, 10), (0, 0))))
        .when(F.col("k5") == 2, one(ring((0, 0), (1, 1), (0, 0))))
        .when(F.col("k5") == 3, F.lit("[]"))
        .otherwise(F.concat(F.lit("["), box, F.lit(","), ring((20, 0), (22, 0), (22, 2), (20, 0)),
                            F.lit("]"))))
    layer = df.select(
        "ord", F.concat(F.lit("G-"), k.cast("string")).alias("feature_id"),
        F.when(F.col("k3") == 0, "synthetic_test").otherwise(V.REFERENCE_SOURCE).alias("source"),
        F.lit("Polygon").alias("geom_type"), coords.alias("coords_json"))
    shapes = cut_lineage(shape_table(geometry.add_shape(layer)))
    w = topology.geometry_warnings(topology.with_validity(shapes, large=False), 1)
    return w.select("warning_id", "warning_type", "severity", "source",
                    F.get(F.filter("evidence", lambda e: e["name"] == "validity_reason"),
                          F.lit(0))["text"].alias("reason"))


def interior_checks(spark, sf_dir) -> DataFrame:
    """Polygons whose holes touch: at one point, at two, in a circle, one in another, and all in one point."""
    df = L.run(spark, sf_dir, _RAW)
    shell = _ring((0, 0), (20, 0), (20, 20), (0, 20), (0, 0))
    west = _ring((4, 4), (8, 2), (12, 4), (4, 4))
    holes = (
        (_ring((0, 10), (10, 5), (19, 10), (10, 15), (0, 10)),),
        (_ring((0, 10), (10, 5), (20, 10), (10, 15), (0, 10)),),
        (west, _ring((12, 4), (14, 10), (8, 10), (12, 4)), _ring((8, 10), (2, 10), (4, 4), (8, 10))),
        (_ring((2, 2), (18, 2), (18, 18), (2, 18), (2, 2)), _ring((5, 5), (8, 5), (8, 8), (5, 8), (5, 5))),
        (_ring((8, 8), (7, 4), (9, 4), (8, 8)), _ring((8, 8), (12, 7), (12, 9), (8, 8)),
         _ring((8, 8), (4, 9), (4, 7), (8, 8))))
    coords = F.coalesce(*[F.when(F.col("k5") == i, F.concat(
        F.lit("["), F.concat_ws(",", shell, *h), F.lit("]"))) for i, h in enumerate(holes)])
    layer = df.select("ord", F.lit("Polygon").alias("geom_type"), coords.alias("coords_json"))
    shapes = cut_lineage(shape_table(geometry.add_shape(layer)))
    return topology.with_validity(shapes).select("ord", F.col("invalid_reason").alias("reason"))


# ---- bundles and layers ------------------------------------------------------------------------
def _features(spark, sf_dir) -> DataFrame:
    return N.normalize(_raw(spark, sf_dir), "building")


def export_import_roundtrip(spark, sf_dir) -> DataFrame:
    """Feature rows written as GeoJSON text in memory and read back."""
    f = _features(spark, sf_dir)
    halves = {"buildings": f.filter("ord % 2 = 0"), "drafts": f.filter("ord % 2 = 1")}
    back = geojson.import_bundle(geojson.export_bundle(halves))
    return back.select(
        "layer", "ord", F.col("id").alias("feature_id"), F.col("props")["source"].alias("source"),
        F.col("props")["locality"].alias("locality"), "geom_type", "coords_json")


def bundle_header(spark, sf_dir) -> DataFrame:
    f = _features(spark, sf_dir)
    warnings = topology.low_confidence_warnings(
        L.boxes(spark, sf_dir, L.PREDICTIONS), 4)
    return geojson.bundle_header(
        geojson.export_bundle({"buildings": f, "parcels": f}), warnings, "demo").select(
        "project_id", "total_features", "open_warnings_count")


def _layered(spark, sf_dir) -> DataFrame:
    out = None
    for name, sql in (("buildings", L.BUILDINGS), ("ai_predictions", L.PREDICTIONS),
                      ("parcels", L.PARCELS), ("roads", L.ROADS)):
        part = L.run(spark, sf_dir, sql).withColumn("layer", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def layer_counts(spark, sf_dir) -> DataFrame:
    return review.layer_counts(_layered(spark, sf_dir)).select(
        "layer", "label", "kind", "visible_default", "feature_count")


def project_manifest(spark, sf_dir) -> DataFrame:
    only = _layered(spark, sf_dir).filter(F.col("layer") != "buildings")
    return review.project_manifest(only).select("position", "layer", "feature_count")


def set_predictions(spark, sf_dir) -> DataFrame:
    """Replace active predictions by the confident ones, also in the provider's own layer."""
    f = _layered(spark, sf_dir)
    new = f.filter((F.col("layer") == "ai_predictions") & (F.col("confidence") >= 0.7)).drop("layer")
    return review.set_predictions(f, new, "whu").groupBy("layer").agg(F.count(F.lit(1)).alias("n"))


def import_replaces_layers(spark, sf_dir) -> DataFrame:
    f = _layered(spark, sf_dir)
    incoming = f.filter((F.col("layer") == "roads") & (F.col("ord") % 2 == 0))
    return geojson.replace_layers(f, incoming).groupBy("layer").agg(F.count(F.lit(1)).alias("n"))


def find_feature(spark, sf_dir) -> DataFrame:
    """Earliest layer holding each id when ids repeat across layers."""
    f = _layered(spark, sf_dir).withColumn("feature_id", F.col("ord").cast("string"))
    return review.find_features(f, f.select("feature_id")).select("feature_id", "layer")


_COPIED = f"""select x0, y0, x1, y1 from ({L.PREDICTIONS}) p
union all select x0, y0, x1, y1 from ({L.BUILDINGS}) b where ord % 10 = 0"""


def geometry_fingerprints(spark, sf_dir) -> DataFrame:
    """Detections, some copied from buildings, whose box also exists among the buildings."""
    def key(sql: str) -> DataFrame:
        return L.run(spark, sf_dir, sql).select(imagery.fingerprint(
            F.concat_ws(",", "x0", "y0", "x1", "y1")).alias("fingerprint"))

    return key(_COPIED).intersect(key(L.BUILDINGS))


# ---- review log --------------------------------------------------------------------------------
def _events(spark, sf_dir) -> DataFrame:
    return L.run(spark, sf_dir, L.EVENTS)


_STATE = ("feature_id", "review_status", "edited_by", "edited_at", "edit_reason", "is_manually_edited",
          "n_status", "n_edit", "n_revert")


def review_state(spark, sf_dir) -> DataFrame:
    return review.review_state(_events(spark, sf_dir)).select(*_STATE)


def audit_history(spark, sf_dir) -> DataFrame:
    return review.audit_history(_events(spark, sf_dir)).select(
        "feature_id", "position", "event_id", "action", "reviewer", "new_status", "notes", "edit_reason")


def _as_review(raw: DataFrame) -> DataFrame:
    return raw.select(
        "event_id", "ts", F.concat(F.lit("B-"), F.col("user_id").cast("string")).alias("feature_id"),
        F.when(F.col("event_type") == "click", "geometry_edit").when(
            F.col("event_type") == "signup", "revert_geometry").otherwise("status_update").alias("action"),
        F.when(F.col("event_type") == "view", "under_review").when(
            F.col("event_type") == "purchase", "approved").when(
            F.col("event_type") == "error", "rejected").alias("new_status"),
        F.concat(F.lit("reviewer-"), (F.col("user_id") % 7).cast("string")).alias("reviewer"))


def _delivered(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """State and late rows of a stream in four batches by time, with repeats and rows that come a long time after."""
    rows = L.table(spark, sf_dir, "events")
    ends = rows.agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    part = F.least(F.lit(3), F.floor(4 * (seconds("ts") - seconds("t0")) / (seconds("t1") - seconds("t0")))).cast("int")
    dealt = rows.join(F.broadcast(ends)).withColumn("part", F.when(F.col("event_id") % 97 == 0, 3).otherwise(part))
    again = dealt.filter("event_id % 10 = 1").withColumn("part", F.least(F.lit(3), F.col("part") + 1))
    dealt = cut_lineage(dealt.unionByName(again).drop("t0", "t1"))
    base = f"{checkpoint_folder(spark).rstrip('/')}/fold-{uuid.uuid4().hex}"
    for k in range(4):
        dealt.filter(F.col("part") == k).drop("part").write.parquet(f"{base}/in/k={k}")
        raw = spark.readStream.schema(rows.schema).parquet(f"{base}/in/k=*")
        review_log.run_fold(_as_review(raw), f"{base}/state", f"{base}/progress", delay="5 days").awaitTermination()
    return review_log.read_state(spark, f"{base}/state"), review_log.read_late(spark, f"{base}/state")


def review_state_batches(spark, sf_dir) -> DataFrame:
    """State after several batches with repeats and late events."""
    state, _ = _delivered(spark, sf_dir)
    return state.withColumn("edited_at", F.col("edited_at").cast("timestamp_ntz")).select(*_STATE)


def review_late_rows(spark, sf_dir) -> DataFrame:
    """The rows that the same job set aside as late."""
    _, late = _delivered(spark, sf_dir)
    return late.groupBy("event_id", F.col("b").cast("int").alias("batch")).agg(F.count(F.lit(1)).alias("n"))


def review_state_stream(spark, sf_dir) -> DataFrame:
    """The same state, folded by a stream over the events file."""
    schema = L.table(spark, sf_dir, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    events = _as_review(raw)
    base = f"{checkpoint_folder(spark).rstrip('/')}/fold-{uuid.uuid4().hex}"
    review_log.run_fold(
        events, f"{base}/state", f"{base}/progress", delay="60 days").awaitTermination()
    state = review_log.read_state(spark, f"{base}/state")
    return state.withColumn("edited_at", F.col("edited_at").cast("timestamp_ntz")).select(*_STATE)


def apply_review_state(spark, sf_dir) -> DataFrame:
    f = L.run(spark, sf_dir, L.BUILDINGS).withColumns({
        "coords_json": F.concat(F.lit("["), F.col("x0").cast("string"), F.lit("]")),
        "original_coords_json": F.lit("[0]")})
    out = review.apply_state(f, review.review_state(_events(spark, sf_dir)))
    return out.groupBy("review_status", (F.col("coords_json") == "[0]").alias("original")).agg(
        F.count(F.lit(1)).alias("n"))


def state_overlay(spark, sf_dir) -> DataFrame:
    """Saved rows over loaded ones: only the keys that were saved replace."""
    f = L.run(spark, sf_dir, L.BUILDINGS).select("feature_id", "review_status", "area_sqm")
    saved = L.table(spark, sf_dir, "events").filter("event_id % 4 = 0").select(
        F.concat(F.lit("B-"), F.col("event_id").cast("string")).alias("feature_id"),
        F.lit("under_review").alias("review_status"), F.col("value").alias("area_sqm"),
        F.when(F.col("event_id") % 8 == 0, F.array(F.lit("review_status"), F.lit("area_sqm"))).otherwise(
            F.array(F.lit("review_status"))).alias("present"))
    out = review.overlay(f, saved, ("review_status", "area_sqm"))
    return out.select("feature_id", "review_status", F.round("area_sqm", 6).alias("area_sqm"))


def changed_features(spark, sf_dir) -> DataFrame:
    f = _layered(spark, sf_dir).withColumns({
        "notes": F.when(F.col("ord") % 13 == 0, "checked").otherwise(""),
        "coords_json": F.col("x0").cast("string"),
        "original_coords_json": F.when(F.col("ord") % 17 == 0, F.lit("old")).otherwise(
            F.col("x0").cast("string"))})
    return review.changed_features(f).groupBy("layer").agg(F.count(F.lit(1)).alias("n"))


def state_snapshot(spark, sf_dir) -> DataFrame:
    """State saved twice (the second try of a commit adds nothing), restored over freshly loaded layers."""
    loaded = _layered(spark, sf_dir).withColumns({
        "notes": F.lit(""), "coords_json": F.col("x0").cast("string"), "original_coords_json": F.col("x0").cast("string")})
    k = F.col("ord")
    edited = loaded.withColumns({
        "review_status": F.when(k % 13 == 0, "under_review").otherwise(F.col("review_status")),
        "notes": F.when(k % 17 == 0, "checked").otherwise(""),
        "coords_json": F.when(k % 19 == 0, "moved").otherwise(F.col("coords_json"))})
    drafts = edited.filter("layer = 'buildings' and ord % 100 = 1").withColumns({
        "layer": F.lit("drafts"), "feature_id": F.concat(F.lit("D"), k.cast("string"))})
    folder = f"{checkpoint_folder(spark)}/state-{uuid.uuid4().hex}"
    meta = {"source_mode": "model", "provider_id": "whu", "run_id": "run-1"}
    snapshots.publish_state(edited, folder, "first", None)
    for _ in range(2):
        snapshots.publish_state(edited.unionByName(drafts), folder, "second", meta)
    both = snapshots.restore_state(loaded, folder).withColumn("version", F.lit(2)).unionByName(
        snapshots.restore_state(loaded, folder, 1).withColumn("version", F.lit(1)))
    return both.groupBy("version", "layer").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("review_status") == "under_review").alias("n_review"),
        F.count_if(F.col("notes") != "").alias("n_notes"), F.count_if(F.col("coords_json") == "moved").alias("n_moved"))


def run_records(spark, sf_dir) -> DataFrame:
    """Records of runs, one of them written again, read one by one."""
    o = L.table(spark, sf_dir, "nation").select(
        F.concat(F.lit("p"), (F.col("n_regionkey")).cast("string")).alias("project_id"),
        F.concat(F.lit("run-"), F.col("n_nationkey").cast("string")).alias("run_id"), F.col("n_name").alias("name"))
    folder = f"{checkpoint_folder(spark)}/records-{uuid.uuid4().hex}"
    snapshots.write_run_record(o, folder)
    snapshots.write_run_record(o.filter("run_id = 'run-3'").withColumn("name", F.lit("again")), folder)
    wanted = o.filter("run_id in ('run-3', 'run-7')").select("project_id", "run_id").orderBy("run_id").collect()
    read = [snapshots.read_run_record(spark, folder, *w) for w in wanted]
    return read[0].unionByName(read[1])


# ---- catalogs ----------------------------------------------------------------------------------
def run_latest(spark, sf_dir) -> DataFrame:
    o = L.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("p"), (F.col("o_custkey") % 20).cast("string")).alias("provider_id"),
        F.when(F.col("o_orderkey") % 9 == 0, F.lit("run-x")).otherwise(
            F.concat(F.lit("run-"), F.col("o_orderkey").cast("string"))).alias("run_id"),
        (F.col("o_orderkey") % 5).alias("tile_count"), F.col("o_totalprice").alias("elapsed_seconds"),
        F.col("o_orderpriority").alias("device"))
    return catalog.latest_timing(o).select(
        "provider_id", "run_id", "tile_count", F.round("seconds_per_tile", 6).alias("seconds_per_tile"))


def run_list(spark, sf_dir) -> DataFrame:
    o = L.table(spark, sf_dir, "orders").select(
        F.lit("demo").alias("project_id"),
        F.when(F.col("o_orderkey") % 10 > 0, F.col("o_orderkey").cast("string")).alias("run_id"),
        F.col("o_orderdate").alias("created_at"))
    return catalog.list_runs(o, "demo").select("run_id", "created_at")


def safe_ids(spark, sf_dir) -> DataFrame:
    c = L.table(spark, sf_dir, "supplier")
    name = F.concat(F.lit("  /"), F.col("s_name"), F.lit(" & co/"), F.col("s_suppkey").cast("string"), F.lit("? "))
    return c.select("s_suppkey", catalog.safe_id(name).alias("project_id"))


def project_upsert(spark, sf_dir) -> DataFrame:
    s = L.table(spark, sf_dir, "supplier")
    pid = F.concat(F.lit("proj-"), F.col("s_suppkey").cast("string"))
    raster = lambda k, v: F.create_map(F.lit("width"), F.lit("10"), F.lit(k), v)
    old = s.filter("s_suppkey % 3 <> 0").select(
        pid.alias("project_id"), F.col("s_name").alias("name"), F.lit("Old town").alias("locality"),
        F.lit("t0").alias("created_at"), F.lit("active").alias("status"),
        raster("crs", F.lit("EPSG:3857")).alias("raster"))
    new = s.filter("s_suppkey % 2 = 0").select(
        pid.alias("project_id"), F.when(F.col("s_suppkey") % 4 == 0, "").otherwise("Renamed").alias("name"),
        F.lit("").alias("locality"), F.lit("t1").alias("created_at"),
        raster("height", F.lit("20")).alias("raster"))
    out = catalog.upsert_projects(old, new)
    return out.select("project_id", "name", "locality", "created_at", "status",
                      F.col("raster")["crs"].alias("crs"), F.col("raster")["height"].alias("height"))


def raster_check(spark, sf_dir) -> DataFrame:
    p = L.table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    d = lambda c: c.cast("double")
    r = p.select(
        k.alias("raster_id"),
        F.when(k % 11 == 0, None).when(k % 7 == 0, 4326).otherwise(3857).cast("int").alias("epsg"),
        F.when(k % 5 == 0, 1).otherwise(4).alias("bands"),
        (F.col("p_size") * 1000).cast("int").alias("width"), F.lit(12000).alias("height"),
        F.when(k % 13 == 0, 0.0).otherwise(0.3).alias("a"), d(F.lit(0)).alias("b"), d(k).alias("c"),
        d(F.lit(0)).alias("d"), F.lit(-0.4).alias("e"), d(k).alias("f"),
        d(k).alias("minx"), d(k).alias("miny"), d(k + F.when(k % 17 == 0, 0).otherwise(9)).alias("maxx"),
        d(k + 9).alias("maxy"),
        F.when(k % 19 == 0, F.array(*[F.lit("uint16")] * 4)).otherwise(
            F.array(*[F.lit("uint8")] * 4)).alias("dtypes"),
        F.when(k % 2 == 0, F.array(*[F.lit(c) for c in ("blue", "green", "red", "alpha")])).otherwise(
            F.array(*[F.lit("gray")] * 4)).alias("colors"))
    c = catalog.check_rasters(r)
    return c.select("raster_id", F.size("errors").alias("n_errors"),
                    F.array_join(F.col("rgb_band_mapping").cast("array<string>"), ",").alias("mapping"),
                    "alpha_band", F.round("gsd_x", 6).alias("gsd_x"), F.array_join("errors", " | ").alias("texts"))


def manifest_split(spark, sf_dir) -> DataFrame:
    files = L.table(spark, sf_dir, "part").select(_stem().alias("stem"))
    rec = files.withColumn("city", imagery.city(F.col("stem"))).filter(F.col("city").isNotNull())
    return imagery.split_by_city(rec).groupBy("city", "split").agg(F.count(F.lit(1)).alias("n"))


def _stem():
    i = F.col("p_partkey") % 6
    names = ("austin", "Chicago", "kitsap", "tyrol-w", "vienna", "boston")
    pick = F.element_at(F.array(*[F.lit(n) for n in names]), (i + 1).cast("int"))
    return F.concat(pick, F.col("p_partkey").cast("string"))


def pair_files(spark, sf_dir) -> DataFrame:
    """Image and mask paths made from parts: some masks in a second place, some missing."""
    p = L.table(spark, sf_dir, "part").select("p_partkey", _stem().alias("stem"))
    k = F.col("p_partkey")
    image = F.concat(F.lit("/d/images/"), "stem", F.lit(".tif"))
    mask = F.when(k % 4 == 0, F.concat(F.lit("/d/gt/"), "stem", F.lit(".tif"))).when(
        k % 4 == 1, F.concat(F.lit("/d/ground_truth/"), "stem", F.lit(".tif"))).when(
        k % 4 == 2, F.concat(F.lit("/d/gt/"), "stem", F.lit(".tif")))
    images, masks = p.select(image.alias("path")), p.select(mask.alias("path")).dropna()
    return imagery.pair_files(images, masks).select("path", "mask", "city", "error")


# ---- scalar functions --------------------------------------------------------------------------
def _spots(spark, sf_dir) -> DataFrame:
    return L.table(spark, sf_dir, "part").select(
        "p_partkey", (F.col("p_partkey") * 0.17 % 360 - 180).alias("lon"),
        (F.col("p_partkey") * 0.083 % 160 - 80).alias("lat"))


def utm_zone(spark, sf_dir) -> DataFrame:
    return _spots(spark, sf_dir).select(
        "p_partkey", crs.utm_zone(F.col("lon")).alias("zone"),
        crs.utm_epsg(F.col("lon"), F.col("lat")).alias("epsg"))


def utm_points(spark, sf_dir) -> DataFrame:
    """Forward to UTM 43N near its centre, and back again."""
    p = L.table(spark, sf_dir, "part").select("p_partkey", F.array(F.struct(
        (72.0 + F.col("p_partkey") % 1000 / 500.0).alias("x"),
        (20.0 + F.col("p_partkey") % 700 / 100.0).alias("y"))).alias("pts"))
    p = p.withColumn("utm", crs.utm_forward_points(F.col("pts"), 43)).withColumn(
        "back", crs.utm_inverse_points(F.col("utm"), 43))
    return p.select(
        "p_partkey", F.round(F.col("utm")[0]["x"], 3).alias("easting"),
        F.round(F.col("utm")[0]["y"], 3).alias("northing"),
        F.round(F.col("back")[0]["x"], 6).alias("lon"), F.round(F.col("back")[0]["y"], 6).alias("lat"))


def mercator_bounds(spark, sf_dir) -> DataFrame:
    p = L.table(spark, sf_dir, "part")
    x, y = F.col("p_partkey") * 25000.0 - 20030000, F.col("p_partkey") * 17000.0 - 17000000
    b = crs.wgs84_bounds(x, y, x + 9000, y + 8000)
    return p.select("p_partkey", *[F.round(b[k], 6).alias(k) for k in ("south", "west", "north", "east")])


def xyz_bounds(spark, sf_dir) -> DataFrame:
    p = L.table(spark, sf_dir, "part")
    z = (F.col("p_partkey") % 18 + 1).cast("int")
    b = crs.xyz_bounds(z, F.col("p_partkey") % 2, F.col("p_partkey") % 3 % 2)
    t = crs.xyz_tile(z, b["minx"] + 0.5, b["maxy"] - 0.5)
    return p.select("p_partkey", *[F.round(b[k], 3).alias(k) for k in ("minx", "miny", "maxx", "maxy")],
                    t["x"].alias("tile_x"), t["y"].alias("tile_y"))


def native_zoom(spark, sf_dir) -> DataFrame:
    p = L.table(spark, sf_dir, "part")
    x = F.when(F.col("p_partkey") % 9 == 0, F.lit(float("nan"))).otherwise(F.col("p_retailprice") / 5000)
    y = F.when(F.col("p_partkey") % 5 == 0, F.lit(0.0)).otherwise(F.col("p_size") / 100.0)
    return p.select("p_partkey", crs.native_zoom(x, y).alias("zoom"))


def resampling_parameters(spark, sf_dir) -> DataFrame:
    p = _spots(spark, sf_dir)
    r = crs.resampling_parameters(F.col("p_partkey") % 50 / 100.0, F.col("lat"), F.lit(0.3))
    return p.select(
        "p_partkey", F.round(r["source_ground_resolution_m"], 6).alias("ground"),
        F.round(r["resampling_factor"], 6).alias("factor"), r["coarse_source"].alias("coarse"))


# ---- oracle SQL --------------------------------------------------------------------------------
_C = L.duck(_RAW)
_SRC = """case k5 when 0 then 'manual_visual_reference' when 1 then 'OSM extract'
  when 2 then 'synthetic_v2' when 3 then 'survey' end"""
_COORD = "concat('[[[', k, ',0],[', k+1, ',0],[', k+1, ',1],[', k, ',0]]]')"
_FIXED_SRC = """case k5 when 1 then 'osm' when 2 then 'synthetic_test' else 'project_vaayu_sample' end"""
_EV = L.duck(L.EVENTS)
#: Every delivery of an event, its batch, whether it is the first, and whether it comes too late there.
_DELIVERED = """select event_id, part, first, coalesce(ts < newest - interval 5 days, false) as late from (
  select *, max(m) over (order by part range between unbounded preceding and 1 preceding) as newest from (
    select *, max(ts) over (partition by part) as m from (
      select event_id, ts, part, true as first from dealt
      union all select event_id, ts, least(3, part + 1), false from dealt where event_id % 10 = 1) u) w) x"""
_DELIVERED = _DELIVERED.replace("from dealt", """from (select event_id, ts, case when event_id % 97 = 0 then 3 else
  cast(least(3, floor(4*(epoch_us(ts) - epoch_us(min(ts) over ()))/(epoch_us(max(ts) over ()) - epoch_us(min(ts) over ())))) as integer)
  end as part from events) d""")
_LAYERED = f"""select 'buildings' as layer, feature_id, ord, confidence, review_status, x0
  from ({L.duck(L.BUILDINGS)}) b
union all select 'ai_predictions', feature_id, ord, confidence, review_status, x0 from ({L.duck(L.PREDICTIONS)}) a
union all select 'parcels', feature_id, ord, confidence, review_status, x0 from ({L.duck(L.PARCELS)}) p
union all select 'roads', feature_id, ord, confidence, review_status, x0 from ({L.duck(L.ROADS)}) r"""
_STATE_CTE = f"""with e as ({_EV}), k as (select feature_id,
  arg_max(new_status, (ts, event_id)) filter (action = 'status_update') as review_status,
  arg_max(reviewer, (ts, event_id)) filter (action <> 'revert_geometry') as edited_by,
  max(ts) filter (action <> 'revert_geometry') as edited_at,
  arg_max(action, (ts, event_id)) filter (action <> 'status_update') as last_shape,
  count(*) filter (action = 'status_update') as n_status,
  count(*) filter (action = 'geometry_edit') as n_edit,
  count(*) filter (action = 'revert_geometry') as n_revert from e group by feature_id)"""
_STATE_SQL = f"""{_STATE_CTE}
select feature_id, coalesce(review_status, 'unverified') as review_status, edited_by, edited_at,
  case last_shape when 'geometry_edit' then 'Manual geometry refinement'
    when 'revert_geometry' then 'Reverted to unedited original baseline' end as edit_reason,
  coalesce(last_shape = 'geometry_edit', false) as is_manually_edited, n_status, n_edit, n_revert from k"""
_a, _b = crs._ALPHA, crs._BETA  # noqa: SLF001
_UTM_SQL = f"""with p as (select p_partkey, 72.0e0 + (p_partkey % 1000)/500.0e0 as lon,
  20.0e0 + (p_partkey % 700)/100.0e0 as lat from part),
s as (select *, sinh(atanh(sin(radians(lat))) - {crs._ECC!r}*atanh({crs._ECC!r}*sin(radians(lat)))) as t,
  radians(lon - 75) as d from p),
q as (select *, atan2(t, cos(d)) as xi, atanh(sin(d)/sqrt(1+t*t)) as eta from s)
select p_partkey, round(500000 + {crs._SCALE!r}*(eta + {" + ".join(
    f"{a!r}*cos({2*j}*xi)*sinh({2*j}*eta)" for j, a in enumerate(_a, 1))}), 3) as easting,
  round({crs._SCALE!r}*(xi + {" + ".join(
    f"{a!r}*sin({2*j}*xi)*cosh({2*j}*eta)" for j, a in enumerate(_a, 1))}), 3) as northing,
  round(lon, 6) as lon, round(lat, 6) as lat from q"""
_labels = V.LAYER_SPECS
_SPECS_SQL = " union all ".join(
    f"select {i} as position, '{n}' as layer, '{_labels[n][0]}' as label, '{_labels[n][1]}' as kind, "
    f"{str(_labels[n][2]).lower()} as visible_default" for i, n in enumerate(V.LAYER_ORDER))
_STEM = """concat(list_extract(['austin','Chicago','kitsap','tyrol-w','vienna','boston'],
  cast(p_partkey % 6 + 1 as integer)), p_partkey)"""
_CITY = "nullif(regexp_extract(lower(stem), '^(austin|chicago|kitsap|tyrol|vienna)[_-]?', 1), '')"
_ORIGIN = "20037508.342789244"

QUERIES = {
    "normalize_features": (normalize_features, f"""with c as ({_C})
select ord, coalesce(id, case when k % 2 = 0 then concat('BLD-', k) end, concat('BUILDING-AUTO-', ord))
    as feature_id, 'building' as feature_type, {_FIXED_SRC} as source,
  case when k5 = 1 then '2026-09-28' end as source_date, 'unverified' as review_status, '' as notes,
  case when k3 = 1 then 'Elsewhere' else 'Lalpur' end as locality, '511638' as lgd_village_code,
  case when k3 = 0 then round(c_acctbal, 6) end as area_sqm, true as snapshot from c"""),
    "pii_scrub": (pii_scrub, f"""with c as ({_C})
select ord, 'segment' as extra_keys, c_mktsegment as segment from c"""),
    "source_correction": (source_correction, f"""with c as (select *, {_SRC} as s from ({_C}) t),
u as (select 'building' as kind, case when s = 'manual_visual_reference' then 'project_vaayu_sample'
    when lower(s) like '%osm%' then 'osm' when lower(s) like '%synthetic%' then 'synthetic_test'
    else 'project_vaayu_sample' end as source from c
union all select 'village_road_polygon', case when lower(s) like '%osm%' then 'osm'
    when lower(s) like '%synthetic%' then 'synthetic_test' else 'project_vaayu_sample' end from c
union all select 'road', 'osm' from c
union all select 'parcel', case when lower(s) like '%osm%' then 'osm'
    when lower(s) like '%synthetic%' then 'synthetic_test' else 'official_reference' end from c)
select kind, source, count(*) as n from u group by kind, source"""),
    "scrub_non_finite": (scrub_non_finite, """
select l_orderkey, l_linenumber, case when l_quantity > 45 or l_quantity < 5 then null
  else l_quantity end as q, case when l_linenumber = 1 then null else l_discount end as d from lineitem"""),
    "collection_errors": (collection_errors, f"""with c as ({_C})
select ord, case k5 when 1 then concat('Expected FeatureCollection, received type: ', c_mktsegment)
  when 2 then 'Missing ''features'' array in FeatureCollection.'
  when 3 then 'CRS mismatch: Expected EPSG:4326/CRS84, found EPSG:3857'
  when 4 then 'Root must be a JSON object.' end as error from c"""),
    "geometry_checks": (geometry_checks, f"""with c as ({_C})
select concat(case k5 when 2 then 'W-CORRUPT-' when 3 then 'W-EMPTY-' else 'W-INVALID-' end, 'G-', k)
    as warning_id, case when k5 = 3 then 'empty_geometry' else 'invalid_geometry' end as warning_type,
  case when k5 = 3 then 'high' when k5 = 2 then 'critical' when k3 = 0 then 'high' else 'critical' end
    as severity, case when k3 = 0 then 'synthetic_test' else 'project_vaayu_sample' end as source,
  case k5 when 1 then 'Self-intersection' when 4 then 'Hole lies outside shell' end as reason
from c where k5 > 0"""),
    "interior_checks": (interior_checks, f"""with c as ({_C})
select ord, case k5 when 1 then 'Interior is disconnected' when 2 then 'Interior is disconnected'
  when 3 then 'Holes are nested' end as reason from c"""),
    "export_import_roundtrip": (export_import_roundtrip, f"""with c as ({_C})
select case when ord % 2 = 0 then 'buildings' else 'drafts' end as layer, ord,
  coalesce(id, case when k % 2 = 0 then concat('BLD-', k) end, concat('BUILDING-AUTO-', ord))
    as feature_id, {_FIXED_SRC} as source,
  case when k3 = 1 then 'Elsewhere' else 'Lalpur' end as locality, 'Polygon' as geom_type,
  {_COORD} as coords_json from c"""),
    "bundle_header": (bundle_header, f"""
select 'demo' as project_id, (select count(*) from customer) as total_features,
  (select count(*) from ({L.duck(L.PREDICTIONS)}) a where confidence < 0.7) as open_warnings_count"""),
    "layer_counts": (layer_counts, f"""with f as ({_LAYERED}), s as ({_SPECS_SQL})
select layer, label, kind, visible_default, (select count(*) from f where f.layer = s.layer)
  as feature_count from s"""),
    "project_manifest": (project_manifest, f"""with f as ({_LAYERED}), s as ({_SPECS_SQL})
select cast(-1 as integer) as position, 'orthomosaic' as layer, cast(1 as bigint) as feature_count
union all select cast(position as integer), layer, (select count(*) from f where f.layer = s.layer)
from s where layer <> 'buildings'"""),
    "set_predictions": (set_predictions, f"""with f as ({_LAYERED})
select layer, count(*) as n from f where layer <> 'ai_predictions' group by layer
union all select unnest(['ai_predictions', 'ai_whu_predictions']), count(*) from f
  where layer = 'ai_predictions' and confidence >= 0.7"""),
    "import_replaces_layers": (import_replaces_layers, f"""with f as ({_LAYERED})
select layer, count(*) as n from f where layer <> 'roads' or ord % 2 = 0 group by layer"""),
    "find_feature": (find_feature, f"""with f as ({_LAYERED}),
g as (select cast(ord as varchar) as feature_id, layer, row_number() over (partition by ord
  order by case layer when 'buildings' then 1 when 'roads' then 2 when 'parcels' then 4 else 7 end) as rn from f)
select feature_id, layer from g where rn = 1"""),
    "geometry_fingerprints": (geometry_fingerprints, f"""
select sha256(concat_ws(',', x0, y0, x1, y1)) as fingerprint from ({L.duck(_COPIED)}) a
intersect select sha256(concat_ws(',', x0, y0, x1, y1)) from ({L.duck(L.BUILDINGS)}) b"""),
    "review_state": (review_state, _STATE_SQL),
    "review_state_stream": (review_state_stream, _STATE_SQL),
    "review_state_batches": (review_state_batches, _STATE_SQL.replace(_EV, f"""select v.* from ({_EV}) v
  join (select distinct event_id from ({_DELIVERED}) t where not late) q using (event_id)""")),
    "review_late_rows": (review_late_rows, f"""
select event_id, cast(part as integer) as batch, count(*) as n from ({_DELIVERED}) t where late group by event_id, part"""),
    "audit_history": (audit_history, f"""with e as ({_EV})
select feature_id, row_number() over (partition by feature_id order by ts, event_id) as position,
  event_id, action, case when action <> 'revert_geometry' then reviewer end as reviewer, new_status,
  case when action = 'revert_geometry' then 'Reverted to unedited original baseline' end as notes,
  case when action = 'geometry_edit' then 'Manual geometry refinement' end as edit_reason from e"""),
    "apply_review_state": (apply_review_state, f"""{_STATE_CTE}, b as ({L.duck(L.BUILDINGS)})
select coalesce(k.review_status, b.review_status) as review_status,
  coalesce(last_shape = 'revert_geometry', false) or x0 = 0 as original, count(*) as n
from b left join k using (feature_id) group by 1, 2"""),
    "state_overlay": (state_overlay, f"""with b as ({L.duck(L.BUILDINGS)}),
s as (select concat('B-', event_id) as feature_id, event_id, value from events where event_id % 4 = 0)
select feature_id, case when s.event_id is null then review_status else 'under_review' end as review_status,
  round(case when s.event_id % 8 = 0 then value else area_sqm end, 6) as area_sqm
from b left join s using (feature_id)"""),
    "changed_features": (changed_features, f"""with f as ({_LAYERED})
select layer, count(*) as n from f where layer <> 'ai_predictions'
  and (review_status <> 'unverified' or ord % 13 = 0 or ord % 17 = 0) group by layer"""),
    "state_snapshot": (state_snapshot, f"""with f as ({_LAYERED}),
e as (select layer, feature_id, ord, case when ord % 13 = 0 then 'under_review' else review_status end as s,
  ord % 17 = 0 as noted, ord % 19 = 0 as moved, review_status as own from f),
v as (select unnest([1, 2]) as version),
r as (select version, layer, s, noted, moved from e, v where layer <> 'ai_predictions'
  union all select version, layer, case when version = 2 then s else own end, version = 2 and noted, version = 2 and moved
    from e, v where layer = 'ai_predictions'
  union all select 2, 'ai_whu_predictions', s, noted, moved from e where layer = 'ai_predictions'
  union all select 2, 'drafts', s, noted, moved from e where layer = 'buildings' and ord % 100 = 1)
select cast(version as integer) as version, layer, count(*) as n, count(*) filter (s = 'under_review') as n_review,
  count(*) filter (noted) as n_notes, count(*) filter (moved) as n_moved from r group by version, layer"""),
    "run_records": (run_records, """select concat('p', n_regionkey) as project_id, concat('run-', n_nationkey) as run_id,
  case when n_nationkey = 3 then 'again' else n_name end as name from nation where n_nationkey in (3, 7)"""),
    "run_latest": (run_latest, """with o as (select concat('p', o_custkey % 20) as provider_id,
  case when o_orderkey % 9 = 0 then 'run-x' else concat('run-', o_orderkey) end as run_id,
  case when o_orderkey % 9 = 0 then -1 else o_orderkey end as no, o_orderkey % 5 as tile_count,
  o_totalprice as s from orders where o_orderkey % 5 > 0),
r as (select *, row_number() over (partition by provider_id order by no desc) as rn from o)
select provider_id, run_id, tile_count, round(s/tile_count, 6) as seconds_per_tile from r where rn = 1"""),
    "run_list": (run_list, """select cast(o_orderkey as varchar) as run_id, o_orderdate as created_at from orders
where o_orderkey % 10 > 0 order by o_orderdate desc, cast(o_orderkey as varchar) desc"""),
    "safe_ids": (safe_ids, """select s_suppkey, regexp_replace(regexp_replace(
  concat('  /', s_name, ' & co/', s_suppkey, '? '), '[^A-Za-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g')
  as project_id from supplier"""),
    "project_upsert": (project_upsert, """
select concat('proj-', s_suppkey) as project_id,
  case when s_suppkey % 2 = 0 and s_suppkey % 4 <> 0 then 'Renamed' when s_suppkey % 3 <> 0 then s_name
    else concat('proj-', s_suppkey) end as name,
  case when s_suppkey % 3 <> 0 then 'Old town' else 'Unknown locality' end as locality,
  case when s_suppkey % 3 <> 0 then 't0' else 't1' end as created_at, 'active' as status,
  case when s_suppkey % 3 <> 0 then 'EPSG:3857' end as crs,
  case when s_suppkey % 2 = 0 then '20' end as height
from supplier where s_suppkey % 3 <> 0 or s_suppkey % 2 = 0"""),
    "raster_check": (raster_check, """with r as (select p_partkey as k, p_size from part),
e as (select *, k % 11 = 0 as e1, k % 11 <> 0 and k % 7 = 0 as e2, k % 5 = 0 as e3,
  p_size*1000*12000 > 500000000 as e4, k % 13 = 0 as e5, k % 17 = 0 as e6, k % 19 = 0 as e7 from r)
select k as raster_id, cast(e1::int + e2::int + e3::int + e4::int + e5::int + e6::int + e7::int
    as integer) as n_errors, case when k % 2 = 0 then '3,2,1' else '1,2,3' end as mapping,
  case when k % 2 = 0 then 4 end as alpha_band,
  case when k % 13 = 0 then 0.0e0 else 0.3e0 end as gsd_x,
  concat_ws(' | ', case when e1 then 'GeoTIFF has no CRS. Assign a valid CRS before upload.' end,
    case when e2 then 'This build can display project rasters only in EPSG:3857.' end,
    case when e3 then 'RGB GeoTIFF required: at least three raster bands must be present.' end,
    case when e4 then 'Raster dimensions exceed the supported 500-million-pixel limit.' end,
    case when e5 then 'GeoTIFF has no usable spatial transform.' end,
    case when e6 then 'GeoTIFF has invalid or empty spatial bounds.' end,
    case when e7 then 'This build requires uint8 RGB bands; convert other data types before upload.' end) as texts
from e"""),
    "manifest_split": (manifest_split, f"""with f as (select {_STEM} as stem from part),
c as (select {_CITY} as city from f)
select city, case when city = (select max(city) from c) then 'validation' else 'train' end as split,
  count(*) as n from c where city is not null group by city"""),
    "pair_files": (pair_files, f"""with f as (select {_STEM} as stem, p_partkey as k from part)
select concat('/d/images/', stem, '.tif') as path,
  case when k % 4 in (0, 2) then concat('/d/gt/', stem, '.tif')
    when k % 4 = 1 then concat('/d/ground_truth/', stem, '.tif') end as mask, {_CITY} as city,
  case when {_CITY} is null then 'city cannot be identified'
    when k % 4 = 3 then 'missing building mask' end as error from f"""),
    "utm_zone": (utm_zone, """with s as (select p_partkey, p_partkey*0.17e0 % 360 - 180 as lon,
  p_partkey*0.083e0 % 160 - 80 as lat from part),
z as (select *, cast(greatest(1, least(60, floor((lon+180)/6)+1)) as integer) as zone from s)
select p_partkey, zone, cast(case when lat >= 0 then 32600 else 32700 end + zone as integer) as epsg from z"""),
    "utm_points": (utm_points, _UTM_SQL),
    "mercator_bounds": (mercator_bounds, """with s as (select p_partkey, p_partkey*25000.0e0-20030000 as x,
  p_partkey*17000.0e0-17000000 as y from part),
b as (select p_partkey, degrees(2*atan(exp(y/6378137))-pi()/2) as s, degrees(x/6378137) as w,
  degrees(2*atan(exp((y+8000)/6378137))-pi()/2) as n, degrees((x+9000)/6378137) as e from s),
v as (select *, abs(s) <= 90 and abs(n) <= 90 and abs(w) <= 180 and abs(e) <= 180 as ok from b)
select p_partkey, case when ok then round(s, 6) end as south, case when ok then round(w, 6) end as west,
  case when ok then round(n, 6) end as north, case when ok then round(e, 6) end as east from v"""),
    "xyz_bounds": (xyz_bounds, f"""with s as (select p_partkey, 2*{_ORIGIN}e0/pow(2, p_partkey % 18 + 1) as span,
  p_partkey % 2 as x, p_partkey % 3 % 2 as y from part)
select p_partkey, round(x*span-{_ORIGIN}e0, 3) as minx, round({_ORIGIN}e0-(y+1)*span, 3) as miny,
  round((x+1)*span-{_ORIGIN}e0, 3) as maxx, round({_ORIGIN}e0-y*span, 3) as maxy,
  x as tile_x, y as tile_y from s"""),
    "native_zoom": (native_zoom, """with s as (select p_partkey,
  case when p_partkey % 9 <> 0 then p_retailprice/5000 end as x,
  case when p_partkey % 5 <> 0 then p_size/100.0e0 end as y from part)
select p_partkey, cast(coalesce(greatest(0, least(24, round_even(log2(
  156543.03392804097e0/case when x is null then y when y is null then x else least(x, y) end), 0))), 21)
  as integer) as zoom from s"""),
    "resampling_parameters": (resampling_parameters, """with s as (select p_partkey,
  (p_partkey % 50)/100.0e0 as g, p_partkey*0.083e0 % 160 - 80 as lat from part),
r as (select *, g*abs(cos(radians(lat))) as ground from s)
select p_partkey, case when g > 0 then round(ground, 6) end as ground,
  case when g > 0 then round(ground/0.3, 6) end as factor,
  case when g > 0 then ground > 1.5*0.3 end as coarse from r"""),
}
