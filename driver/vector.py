"""Vector queries: rules, scores, parcel status, matching."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from driver import layers as L
from groundcheck import fixed_values as V
from groundcheck.functions import geometry
from groundcheck.lineage import cut_lineage
from groundcheck.operators import matching, scoring, topology
from groundcheck.operators.gridjoin import grid_pairs
from groundcheck.operators.nearest import nearest
from groundcheck.operators.polygons import pair_measures, shape_table
from groundcheck.plans import discrepancy as D, validation
from groundcheck.plans.parcels import parcel_report
from groundcheck.streaming import revalidate

KW = {"unit_area": L.UNIT_AREA, "large": False}
ALL = {**KW, "unit_length": L.UNIT_LENGTH, "stored": True}

# ---- SQL building blocks -----------------------------------------------------------------------
_B, _A, _P, _R = (L.duck(s) for s in (L.BUILDINGS, L.PREDICTIONS, L.PARCELS, L.ROADS))
_CTE = f"""with b as ({_B}), a as ({_A}), p as ({_P}), r as ({_R}),
ba as (select *, 0 as rank from b union all select *, 1 as rank from a)"""
_W = "(least(l.x1, q.x1) - greatest(l.x0, q.x0))"
_H = "(least(l.y1, q.y1) - greatest(l.y0, q.y0))"
_AREA = f"cast({_W} as double)*{_H}/10000.0"
_HIT = "l.x0 <= q.x1 and q.x0 <= l.x1 and l.y0 <= q.y1 and q.y0 <= l.y1"
_POINT = """(greatest(l.x0, q.x0) + least(l.x1, q.x1))/2.0 as cx,
  (greatest(l.y0, q.y0) + least(l.y1, q.y1))/2.0 as cy"""
_SEV = "case when {0} >= 5 then 'high' when {0} >= 2 then 'medium' else 'low' end"

_OVERLAP = f"""
select concat('W-OVERLAP-', l.feature_id, '-', q.feature_id) as warning_id, l.feature_id as id_a,
  q.feature_id as id_b, {_AREA} as v, {_POINT}, l.rank*1e9 + l.ord as oa, q.rank*1e9 + q.ord as ob
from ba l join ba q on (l.rank < q.rank or (l.rank = q.rank and l.ord < q.ord)) and {_HIT}
where {_AREA} >= 1.0"""
_ROAD = f"""
select concat('W-RD-OVERLAP-', l.feature_id, '-', q.feature_id) as warning_id, l.feature_id as id_a,
  q.feature_id as id_b, {_AREA} as v, {_POINT}, l.rank*1e9 + l.ord as oa, q.ord*1e0 as ob
from ba l join r q on {_HIT}"""
_CROSS = f"""
select concat('W-PARCEL-CROSS-', l.feature_id, '-', q.feature_id) as warning_id,
  l.feature_id as id_a, q.feature_id as id_b, l.area_sqm - {_AREA} as v, {_POINT}, l.source,
  l.rank*1e9 + l.ord as oa, q.ord*1e0 as ob
from ba l join p q on {_HIT} where l.area_sqm - {_AREA} > 0.5"""
_GAP = """sqrt(pow(greatest(0, q.x0 - l.x1, l.x0 - q.x1), 2)
  + pow(greatest(0, q.y0 - l.y1, l.y0 - q.y1), 2))/100.0"""
_SQUARE = """cast(pow(greatest(0, q.x0 - l.x1, l.x0 - q.x1), 2)
  + pow(greatest(0, q.y0 - l.y1, l.y0 - q.y1), 2) as bigint)"""
_OUTSIDE = f"""
select concat('W-OUTSIDE-PARCEL-', id_a) as warning_id, id_a, id_b, v, source, oa, 0e0 as ob, cx, cy from (
  select (l.x0 + l.x1)/2.0 as cx, (l.y0 + l.y1)/2.0 as cy, l.feature_id as id_a, q.feature_id as id_b, l.source, l.rank*1e9 + l.ord as oa, {_GAP} as v,
    row_number() over (partition by l.feature_id order by {_GAP}, q.ord) as rn
  from (select * from ba l where not exists (select 1 from p q where {_HIT})) l cross join p q) t
where rn = 1 and v > 0.5"""
_LOW = """
select concat('W-LOW-CONFIDENCE-', feature_id) as warning_id, feature_id as id_a, confidence as v,
  source, rank*1e9 + ord as oa, 0e0 as ob
from ba where lower(source) like '%ai%' and confidence < 0.7"""

_ALL = f"""{_CTE},
ov as ({_OVERLAP}), rd as ({_ROAD}), cr as ({_CROSS}), ou as ({_OUTSIDE}), lo as ({_LOW}),
w as (
  select 4 as rk, oa, ob, warning_id, 'low_confidence_detection' as warning_type, id_a,
    cast(null as varchar) as id_b, source, cast(null as double) as cx, cast(null as double) as cy, v,
    0.7/greatest(v, 1e-9) as ratio,
    greatest(0.0, 0.7 - v) as exceed,
    concat('AI detection confidence is ', printf('%.2f', v),
      ', below the 0.70 review threshold.') as explanation from lo
  union all
  select 5, oa, ob, warning_id, 'overlapping_polygons', id_a, id_b, 'project_vaayu_sample', cx, cy, v, v,
    v - 1.0, concat('Spatial overlap detected between polygon ', id_a, ' and polygon ', id_b,
      ' (approx ', printf('%.1f', v), ' m²). Review boundaries visually.') from ov
  union all
  select 7, oa, ob, warning_id, 'building_road_spatial_overlap', id_a, id_b, 'project_vaayu_sample',
    cx, cy, v, 1.0, v, concat('Spatial overlap detected between building ', id_a, ' and road corridor ', id_b,
      ' (approx ', printf('%.1f', v), ' m²)—review visually. Road corridors and centerlines are ',
      'spatial references, not legal rights-of-way.') from rd
  union all
  select 10, oa, ob, warning_id, 'building_crosses_parcel', id_a, id_b, source, cx, cy, v, v/0.5, v - 0.5,
    concat('Building footprint ', id_a, ' crosses parcel boundary ', id_b,
      '. Review boundaries visually against imagery.') from cr
  union all
  select 11, oa, ob, warning_id, 'building_outside_parcel', id_a, id_b, source, cx, cy, v, v/0.5, v - 0.5,
    concat('Building footprint ', id_a, ' is ', printf('%.2f', v),
      ' m from the nearest loaded parcel boundary ', id_b, '.') from ou)"""


# ---- Spark side --------------------------------------------------------------------------------
def _buildings(spark, sf_dir) -> DataFrame:
    return L.boxes(spark, sf_dir, L.BUILDINGS)


def _stacked(spark, sf_dir) -> DataFrame:
    return validation.stack_layers(_buildings(spark, sf_dir), L.boxes(spark, sf_dir, L.PREDICTIONS))


def _warnings(spark, sf_dir, centre: bool = False) -> DataFrame:
    """All warnings; counts, scores and texts read no centres."""
    return validation.all_warnings(
        _stacked(spark, sf_dir), L.boxes(spark, sf_dir, L.ROADS), L.boxes(spark, sf_dir, L.PARCELS),
        centre=centre, **ALL)


def _scores(spark, sf_dir) -> DataFrame:
    features = _stacked(spark, sf_dir)
    _, scores = validation.validate_and_score(
        features.select("feature_id", "ord", "feature_type", "source", "review_status", "confidence",
                        "area_sqm"),
        features, L.boxes(spark, sf_dir, L.ROADS), L.boxes(spark, sf_dir, L.PARCELS), centre=False, **ALL)
    return scores


def overlap_pairs(spark, sf_dir) -> DataFrame:
    """Overlapping reference buildings with area, severity and centroid."""
    w = topology.overlap_warnings(_buildings(spark, sf_dir), 5, **KW)
    return w.select(
        "warning_id", F.round("measured_value", 6).alias("overlap_area_m2"), "severity",
        F.round("affected.x", 3).alias("cx"), F.round("affected.y", 3).alias("cy"))


def road_overlaps(spark, sf_dir) -> DataFrame:
    w = topology.road_warnings(_stacked(spark, sf_dir), L.boxes(spark, sf_dir, L.ROADS), 7, **KW)
    return w.select(
        "warning_id", F.round("measured_value", 6).alias("overlap_area_m2"), "severity", "source",
        F.round("exceed_ratio", 6).alias("exceed_ratio"))


def road_types(spark, sf_dir) -> DataFrame:
    """Buildings against roads given as points, lines, polygons and their multi types."""
    at = lambda x, y: F.format_string("[%d,%d]", F.col(x), F.col(y))
    join = lambda *c: F.concat(F.lit("["), F.concat_ws(",", *c), F.lit("]"))
    corner = {c: at(*c) for c in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))}
    box = join(join(*corner.values(), corner["x0", "y0"]))
    kind = F.col("kind")
    part = F.when(kind.endswith("Point"), corner["x0", "y0"]).when(
        kind.endswith("LineString"), join(corner["x0", "y0"], corner["x1", "y0"])).otherwise(box)
    roads = L.run(spark, sf_dir, L.ROAD_PARTS).withColumn("part", part).groupBy("k", "kind").agg(
        F.array_sort(F.collect_list("part")).alias("parts"))
    roads = roads.select(
        F.col("k").alias("ord"), F.concat(F.lit("R-"), F.col("k").cast("string")).alias("feature_id"),
        F.lit(V.REFERENCE_SOURCE).alias("source"), kind.alias("geom_type"),
        F.when(kind.startswith("Multi"), join("parts")).otherwise(F.col("parts")[0]).alias("coords_json"))
    roads = cut_lineage(shape_table(geometry.add_shape(roads)))
    w = topology.road_warnings(_buildings(spark, sf_dir), topology.with_validity(roads, large=False), 7, centre=False, **KW)
    return w.select("warning_id", F.round("measured_value", 6).alias("overlap_area_m2"))


def parcel_crossings(spark, sf_dir) -> DataFrame:
    w = topology.crossing_warnings(
        _buildings(spark, sf_dir), L.boxes(spark, sf_dir, L.PARCELS), 10, **KW)
    return w.select(
        "warning_id", F.round("measured_value", 6).alias("outside_area_m2"), "severity",
        F.round("exceed_value", 6).alias("exceed_m2"), "source",
        F.round("affected.x", 3).alias("cx"), F.round("affected.y", 3).alias("cy"))


def outside_parcels(spark, sf_dir) -> DataFrame:
    pairs = topology.outside_pairs(
        _buildings(spark, sf_dir), L.boxes(spark, sf_dir, L.PARCELS),
        unit_length=L.UNIT_LENGTH, **KW)
    return pairs.select(
        F.col("a_id").alias("building_id"), F.col("b_id").alias("nearest_parcel_id"),
        F.round("distance", 6).alias("distance_m"))


def nearest_road(spark, sf_dir) -> DataFrame:
    """Nearest road corridor of every parcel, 0 when they touch."""
    parcels, roads = L.boxes(spark, sf_dir, L.PARCELS), L.boxes(spark, sf_dir, L.ROADS)
    near = nearest(parcels, roads)
    return near.join(parcels.select(F.col("ord").alias("a_ord"), "feature_id"), "a_ord").join(
        roads.select(F.col("ord").alias("b_ord"), F.col("feature_id").alias("road_id")), "b_ord",
    ).select("feature_id", "road_id", F.round(F.col("distance") / 100.0, 6).alias("distance_m"))


def nearest_far_clusters(spark, sf_dir) -> DataFrame:
    """Nearest parcel of every building when the parcels lie a hundred kilometres away."""
    parcels = L.boxes(spark, sf_dir, L.FAR_PARCELS)
    buildings = _buildings(spark, sf_dir)
    near = nearest(buildings, parcels)
    return near.join(buildings.select(F.col("ord").alias("a_ord"), "feature_id"), "a_ord").join(
        parcels.select(F.col("ord").alias("b_ord"), F.col("feature_id").alias("parcel_id")), "b_ord",
    ).select("feature_id", "parcel_id", F.round(F.col("distance") / 100.0, 4).alias("distance_m"))


def warnings_all(spark, sf_dir) -> DataFrame:
    return _warnings(spark, sf_dir, centre=True).select(
        "warning_id", "warning_type", "severity", "source", "explanation",
        F.array_join("feature_ids", ",").alias("feature_ids"),
        F.round("measured_value", 6).alias("measured_value"),
        F.round("exceed_value", 6).alias("exceed_value"),
        F.round("exceed_ratio", 6).alias("exceed_ratio"),
        F.round("affected.x", 3).alias("cx"), F.round("affected.y", 3).alias("cy"))


def _edited(sql: str, where: str = "true", **columns: str) -> str:
    """A layer text after an edit: rows that stay, and columns that differ."""
    names = ("feature_id", "ord", "x0", "y0", "x1", "y1", "area_sqm", "feature_type", "source", "confidence", "review_status")
    return f"""
select {", ".join(f"{columns[c]} as {c}" if c in columns else c for c in names)} from ({sql}) e where {where}"""


#: Per layer its text before and after the edit, and which features the edit touched.
EDITS = {
    "buildings": (_edited(L.BUILDINGS), _edited(
        L.BUILDINGS, x0="x0 + case when ord % 50 = 0 then 200 else 0 end", x1="x1 + case when ord % 50 = 0 then 200 else 0 end"),
        "ord % 50 = 0"),
    "predictions": (_edited(L.PREDICTIONS), _edited(
        L.PREDICTIONS, confidence="case when ord % 60 = 7 then 1.0 - confidence else confidence end"), "ord % 60 = 7"),
    "roads": (_edited(L.ROADS), _edited(
        L.ROADS, y0="y0 + case when ord % 3 = 0 then 150 else 0 end", y1="y1 + case when ord % 3 = 0 then 150 else 0 end"),
        "ord % 3 = 0"),
    # some parcels move, some appear and some go
    "parcels": (_edited(L.PARCELS, "ord % 200 <> 14"), _edited(
        L.PARCELS, "ord % 200 <> 13", x0="x0 + case when ord % 40 = 9 then 400 when ord % 40 = 7 then 900 else 0 end",
        x1="x1 + case when ord % 40 = 9 then 400 when ord % 40 = 7 then 900 else 0 end"),
        "ord % 40 in (7, 9) or ord % 200 in (13, 14)"),
}


def incremental_revalidation(spark, sf_dir) -> DataFrame:
    """All warnings after an edit of every layer, from those before it and what lies around the edit."""
    box = {n: [L.boxes(spark, sf_dir, text) for text in texts[:2]] for n, texts in EDITS.items()}

    def layers(i: int) -> dict[str, DataFrame]:
        return {"buildings": cut_lineage(validation.stack_layers(box["buildings"][i], box["predictions"][i])),
                "roads": box["roads"][i], "parcels": box["parcels"][i]}

    def touched(*names: str) -> DataFrame:
        ids = [side.filter(EDITS[n][2]).select("feature_id") for n in names for side in box[n]]
        return reduce(DataFrame.unionByName, ids).distinct()

    before, after = layers(0), layers(1)
    old = cut_lineage(validation.all_warnings(*before.values(), centre=False, **ALL))
    changed = {"buildings": touched("buildings", "predictions"), "roads": touched("roads"), "parcels": touched("parcels")}
    delta = revalidate.revalidate(old, before, after, changed, unit_length=L.UNIT_LENGTH, centre=False, **KW)
    return delta.apply(old).select(
        "warning_id", "warning_type", "explanation", F.array_join("feature_ids", ",").alias("feature_ids"),
        F.round("measured_value", 6).alias("measured_value"), F.round("exceed_value", 6).alias("exceed_value"))


def warning_counts(spark, sf_dir) -> DataFrame:
    return validation.warning_counts(_warnings(spark, sf_dir))


def severity_and_actions(spark, sf_dir) -> DataFrame:
    return _warnings(spark, sf_dir).groupBy(
        "warning_type", "severity", F.col("suggested_action.action_type").alias("action_type"),
        F.col("tolerance.name").alias("tolerance_name"),
        F.col("tolerance.value").alias("tolerance_value"), F.col("tolerance.unit").alias("unit"),
    ).agg(F.count(F.lit(1)).alias("n"))


def low_confidence(spark, sf_dir) -> DataFrame:
    w = topology.low_confidence_warnings(_stacked(spark, sf_dir), 4)
    return w.select(
        "warning_id", "severity", "explanation", F.round("measured_value", 6).alias("confidence"),
        F.round("exceed_value", 6).alias("exceed_value"),
        F.round("exceed_ratio", 6).alias("exceed_ratio"))


def narration(spark, sf_dir) -> DataFrame:
    return topology.narratives(_warnings(spark, sf_dir))


def review_scores(spark, sf_dir) -> DataFrame:
    return _scores(spark, sf_dir).select(
        "feature_id", "feature_type", "total_score", "priority",
        F.col("n_warnings").cast("bigint").alias("n_warnings"),
        F.array_join(F.transform("rules", lambda r: r["rule_id"]), ",").alias("rule_ids"))


def score_rules(spark, sf_dir) -> DataFrame:
    """One row per triggered rule with its wording."""
    return _scores(spark, sf_dir).select("feature_id", F.explode("rules").alias("r")).select(
        "feature_id", "r.rule_id", "r.points", "r.description")


def score_evidence(spark, sf_dir) -> DataFrame:
    return scoring.score_evidence(_warnings(spark, sf_dir)).select("feature_id", "measured")


def parcel_rag(spark, sf_dir) -> DataFrame:
    # the report and the rules read the same stored layers
    buildings, roads, parcels = (L.boxes(spark, sf_dir, text) for text in (L.BUILDINGS, L.ROADS, L.PARCELS))
    features = validation.stack_layers(buildings, L.boxes(spark, sf_dir, L.PREDICTIONS))
    warnings = validation.all_warnings(features, roads, parcels, centre=False, **ALL)
    report = parcel_report(parcels, buildings, roads, warnings, large=False)
    return report.select(
        "parcel_id", "is_synthetic", "rag_status", "rag_label", "parcel_score",
        "intersecting_building_count", "intersecting_road_count", "warning_count",
        F.array_join("contributing_reasons", "|").alias("reasons"))


def parcel_rag_all_pairs(spark, sf_dir) -> DataFrame:
    parcels, buildings = L.boxes(spark, sf_dir, L.PARCELS), _buildings(spark, sf_dir)
    crossings = topology.crossing_warnings(buildings, parcels, 10, **KW)
    return scoring.parcel_status_all_pairs(
        parcels.select("feature_id", "source"), buildings, crossings).select(
        "parcel_id", "rag_status", "parcel_score", "intersecting_building_count", "warning_count")


def iou_candidates(spark, sf_dir) -> DataFrame:
    c = matching.iou_candidates(
        L.boxes(spark, sf_dir, L.PREDICTIONS), _buildings(spark, sf_dir), 0.05, large=False)
    return c.select("a_id", "b_id", F.round("iou", 6).alias("iou"))


def _discrepancy(spark, sf_dir) -> dict[str, DataFrame]:
    return D.discrepancy(
        L.boxes(spark, sf_dir, L.PREDICTIONS), _buildings(spark, sf_dir), 0.35, large=False)


def match_greedy(spark, sf_dir) -> DataFrame:
    return _discrepancy(spark, sf_dir)["matched"].select(
        "a_id", "b_id", F.round("iou", 6).alias("iou"))


def match_pred_order(spark, sf_dir) -> DataFrame:
    c = matching.iou_candidates(
        L.boxes(spark, sf_dir, L.PREDICTIONS), _buildings(spark, sf_dir), 0.35, large=False)
    return matching.match_in_order(c).select("a_id", "b_id", F.round("iou", 6).alias("iou"))


def discrepancy_metrics(spark, sf_dir) -> DataFrame:
    return _discrepancy(spark, sf_dir)["metrics"]


def discrepancy_unmatched(spark, sf_dir) -> DataFrame:
    t = _discrepancy(spark, sf_dir)
    return t["model_only"].select("feature_id", F.lit("model_only").alias("side")).unionByName(
        t["reference_only"].select("feature_id", F.lit("reference_only").alias("side")))


def polygon_pair_area(spark, sf_dir) -> DataFrame:
    """Common area of diamonds around buildings and predictions: slanted edges on both sides."""

    def diamond(sql: str) -> DataFrame:
        df = L.run(spark, sf_dir, sql)
        mx, my = (F.col("x0") + F.col("x1")) / 2.0, (F.col("y0") + F.col("y1")) / 2.0
        corners = F.array(
            F.struct(F.col("x1").cast("double").alias("x"), my.alias("y")),
            F.struct(mx.alias("x"), F.col("y1").cast("double").alias("y")),
            F.struct(F.col("x0").cast("double").alias("x"), my.alias("y")),
            F.struct(mx.alias("x"), F.col("y0").cast("double").alias("y")))
        rings = geometry.oriented_rings(F.array(F.array(corners)), F.lit(True))
        df = df.withColumn("edges", geometry.ring_edges(rings, F.lit(True)))
        return cut_lineage(shape_table(df.withColumn("box", geometry.bounds(F.col("edges")))))

    a, b = diamond(L.PREDICTIONS), diamond(L.BUILDINGS)
    pairs = cut_lineage(grid_pairs(a, b))
    m = pairs.join(pair_measures(pairs, a, b, large=False), ["a_ord", "b_ord"], "left")
    return m.select("a_ord", "b_ord", F.round(F.greatest(F.coalesce("area", F.lit(0.0)), F.lit(0.0)) / 10000.0, 6).alias("area_m2"))


def footprint_area(spark, sf_dir) -> DataFrame:
    """Area and centroid from edges, beside the stored attribute."""
    df = _buildings(spark, sf_dir)
    c = geometry.centroid(F.col("edges"))
    return df.select(
        "feature_id", F.round(geometry.area(F.col("edges")) / 10000.0, 6).alias("edge_area_m2"),
        F.round("area_sqm", 6).alias("area_sqm"),
        F.round(c["x"], 3).alias("cx"), F.round(c["y"], 3).alias("cy"))


# ---- oracle SQL --------------------------------------------------------------------------------
_OVB = _OVERLAP.replace("ba l join ba q", "(select * from ba where rank = 0) l join "
                        "(select * from ba where rank = 0) q")
_CRB = _CROSS.replace("ba l join p q", "(select * from ba where rank = 0) l join p q")
_OUB = _OUTSIDE.replace("from ba l where", "from ba l where rank = 0 and")

_FEATURES = """, f as (select * from ba),
link as (select rk, oa, ob, warning_id, id_a as feature_id from w
  union all select rk, oa, ob, warning_id, id_b from w where id_b is not null),
s as (select feature_id, count(*) as n from link group by feature_id),
top as (select feature_id, string_agg(warning_id, ', ' order by rn) as ids from (
  select *, row_number() over (partition by feature_id order by rk, oa, ob, warning_id) as rn
  from link) t where rn <= 3 group by feature_id),
x as (select f.*, coalesce(s.n, 0) as n, top.ids,
  (f.source = 'ai_building_model' and f.confidence < 0.7) as low,
  (f.area_sqm > 0 and (f.area_sqm < 10 or f.area_sqm > 600)) as extreme
  from f left join s using (feature_id) left join top using (feature_id))"""

_SCORE_SQL = f"""{_ALL}{_FEATURES},
y as (select *, greatest(0, least(100, 10 + case when n > 0 then 35 else 0 end
  + case when low then 20 else 0 end + case when extreme then 15 else 0 end
  + case review_status when 'approved' then -30 when 'rejected' then -20 else 0 end)) as total from x)
select feature_id, feature_type, cast(total as integer) as total_score,
  case when total >= 70 then 'high' when total >= 40 then 'medium' else 'low' end as priority,
  cast(n as bigint) as n_warnings,
  concat_ws(',', case when source = 'project_vaayu_sample' then 'R_UNVERIFIED_SOURCE' end,
    case when n > 0 then 'R_SPATIAL_OVERLAP_WARNING' end,
    case when low then 'R_LOW_AI_CONFIDENCE' end,
    case when extreme then 'R_EXTREME_DIMENSIONS' end,
    case review_status when 'approved' then 'R_HUMAN_APPROVED'
      when 'rejected' then 'R_HUMAN_REJECTED' end) as rule_ids
from y"""

_words = {k: v[2].replace("'", "''") for k, v in V.SCORE_RULES.items()}
_RULES_SQL = f"""{_ALL}{_FEATURES}
select feature_id, 'R_UNVERIFIED_SOURCE' as rule_id, 0 as points,
  '{_words["R_UNVERIFIED_SOURCE"]}' as description from x where source = 'project_vaayu_sample'
union all select feature_id, 'R_SPATIAL_OVERLAP_WARNING', 35, concat(
  '{_words["R_SPATIAL_OVERLAP_WARNING"]} (', n, ' warnings active: ', ids, ')') from x where n > 0
union all select feature_id, 'R_LOW_AI_CONFIDENCE', 20, concat('Model confidence (',
  printf('%.2f', confidence), ') is below 0.70 threshold.') from x where low
union all select feature_id, 'R_EXTREME_DIMENSIONS', 15, concat('Footprint area (',
  printf('%.1f', area_sqm),
  ' m²) is outside typical residential building envelope (10-600 m²).') from x where extreme
union all select feature_id, 'R_HUMAN_APPROVED', -30, '{_words["R_HUMAN_APPROVED"]}' from x
  where review_status = 'approved'
union all select feature_id, 'R_HUMAN_REJECTED', -20, '{_words["R_HUMAN_REJECTED"]}' from x
  where review_status = 'rejected'"""

_num = "regexp_replace(printf('%.3f', {0}), '\\.?0+$', '')"
_acts = {k: v[1].rstrip(".!?") for k, v in V.ACTIONS.items()}
_NARRATION_SQL = f"""{_ALL}
select warning_id, concat(
  case warning_type when 'low_confidence_detection' then 'Low confidence detection'
    when 'overlapping_polygons' then 'Overlapping polygons'
    when 'building_road_spatial_overlap' then 'Building road spatial overlap'
    when 'building_crosses_parcel' then 'Building crosses parcel'
    else 'Building outside parcel' end,
  ' for feature(s) ', concat_ws(', ', id_a, id_b), '. Measured evidence: ',
  case warning_type
    when 'low_confidence_detection' then concat('confidence: ', {_num.format("v")},
      '; confidence threshold: 0.7')
    when 'building_crosses_parcel' then concat('outside area: ', {_num.format("v")}, ' m2')
    when 'building_outside_parcel' then concat('distance to parcel: ', {_num.format("v")}, ' m')
    else concat('overlap area: ', {_num.format("v")}, ' m2; intersection area: ',
      {_num.format("v")}, ' m2') end,
  '. Review tolerance: ',
  case warning_type
    when 'low_confidence_detection' then 'confidence threshold is 0.7 ratio'
    when 'overlapping_polygons' then 'overlap area m2 is 1 m2'
    when 'building_road_spatial_overlap' then 'overlap area m2 is 0 m2'
    when 'building_crosses_parcel' then 'outside area m2 is 0.5 m2'
    else 'distance to parcel m is 0.5 m' end,
  '. Suggested action: ',
  case warning_type {" ".join(
      f"when '{k}' then '{_acts[k]}'" for k in (
          "low_confidence_detection", "overlapping_polygons", "building_road_spatial_overlap",
          "building_crosses_parcel", "building_outside_parcel"))} end, '.') as narrative
from w"""

_RAG_SQL = f"""{_ALL},
nb as (select q.feature_id, count(*) as n, count(*) filter (
    coalesce(l.area_sqm, 0) > 600 or coalesce(l.area_sqm, 0) < 10) as u
  from b l join p q on {_HIT} group by 1),
nr as (select q.feature_id, count(*) as n from r l join p q on {_HIT} group by 1),
nw as (select id_b as feature_id, count(*) as n from w where id_b like 'P-%' group by 1),
t as (select p.feature_id, p.source like '%synthetic%' as synth, coalesce(nb.n, 0) as bn,
    coalesce(nb.u, 0) as bu, coalesce(nr.n, 0) as rn, coalesce(nw.n, 0) as wn
  from p left join nb using (feature_id) left join nr using (feature_id)
  left join nw using (feature_id)),
u as (select *, least(100, 10 + least(50, wn*25) + case when rn > 0 then 20 else 0 end
  + case when bu > 0 then 15 else 0 end) as score from t),
v as (select *, case when score >= 60 or wn > 0 then 'RED' when score >= 30 then 'AMBER'
  else 'GREEN' end as rag from u)
select feature_id as parcel_id, synth as is_synthetic, rag as rag_status,
  case rag when 'RED' then 'Requires Survey Priority Review'
    when 'AMBER' then 'Secondary Visual Inspection' else 'Clear / Low Conflict' end as rag_label,
  cast(score as integer) as parcel_score, bn as intersecting_building_count,
  rn as intersecting_road_count, wn as warning_count,
  concat_ws('|', case when synth then 'Demonstration fixture: synthetic parcel' end,
    case when wn > 0 then concat(wn, ' active topology warnings (', least(50, wn*25), ' pts)') end,
    case when rn > 0 then concat('Intersects ', rn, ' road corridor(s) (+20 pts)') end,
    case when bu > 0 then concat(bu, ' building(s) with unusual dimensions (+15 pts)') end) as reasons
from v"""

_IOU = f"""{_CTE}, i as (
select l.feature_id as a_id, q.feature_id as b_id, l.ord as a_ord, q.ord as b_ord,
  {_AREA}/(l.area_sqm + q.area_sqm - {_AREA}) as iou
from a l join b q on {_HIT} where {_AREA} > 0)"""

# A pair matches when it is the best of both members among pairs not blocked by a better match; the
# recursion settles one "wave" of mutual first choices at a time.
_MATCH_ROUNDS = 12


def _match_sql(order_a: str, order_b: str, threshold: float, last: str) -> str:
    """Rounds of mutual first choices, unrolled; the final round is empty on these inputs."""
    parts = [f"{_IOU}, c0 as materialized (select * from i where iou >= {threshold})"]
    for k in range(_MATCH_ROUNDS):
        parts.append(f"""
m{k} as materialized (select * from (select *,
    row_number() over (partition by a_id order by {order_a}) as ra,
    row_number() over (partition by b_id order by {order_b}) as rb from c{k}) t
  where ra = 1 and rb = 1),
c{k + 1} as materialized (select * from c{k}
  where a_id not in (select a_id from m{k}) and b_id not in (select b_id from m{k}))""")
    matched = " union all ".join(
        f"select a_id, b_id, iou from m{k}" for k in range(_MATCH_ROUNDS))
    parts.append(f" matched as ({matched})")
    return ",".join(parts) + last


_BEST = "-iou, a_id, b_id"
_METRICS_TAIL = """, t as (select (select count(*) from matched) as tp, (select count(*) from a) as np,
  (select count(*) from b) as nr),
u as (select *, tp/cast(np as double) as pr, tp/cast(nr as double) as re from t)
select round(pr, 4) as precision, round(re, 4) as recall, round(2*pr*re/(pr+re), 4) as f1_score,
  tp as true_positives, np - tp as false_positives, nr - tp as false_negatives,
  nr as total_ground_truth, np as total_predictions, 0.35e0 as iou_threshold,
  cast(0 as bigint) as invalid_prediction_count, cast(0 as bigint) as invalid_reference_count from u"""



def _diamond_edges(layer: str) -> str:
    """Edges of the diamond in each box, counter-clockwise, with mid-points mx, my."""
    c = [("x1", "my"), ("mx", "y1"), ("x0", "my"), ("mx", "y0")]
    return " union all ".join(
        f"select ord, {a} as px, {b} as py, {c2} as qx, {d} as qy from "
        f"(select *, (x0+x1)/2.0e0 as mx, (y0+y1)/2.0e0 as my from {layer}) t"
        for (a, b), (c2, d) in zip(c, c[1:] + c[:1]))


_DIAMOND_SQL = f"""{_CTE}, ea as ({_diamond_edges("a")}), eb as ({_diamond_edges("b")}),
h as (select l.ord as a_ord, q.ord as b_ord, greatest(l.y0, q.y0) as oy from a l join b q on {_HIT}),
t as (select h.a_ord, h.b_ord, greatest(least(e.px, e.qx), least(g.px, g.qx)) as l,
  least(greatest(e.px, e.qx), greatest(g.px, g.qx)) as r,
  sign(e.px - e.qx)*sign(g.px - g.qx) as s, e.px as ex, e.py - oy as ey, g.px as gx, g.py - oy as gy,
  (e.qy - e.py)/(e.qx - e.px) as em, (g.qy - g.py)/(g.qx - g.px) as gm
  from h join ea e on e.ord = h.a_ord join eb g on g.ord = h.b_ord),
u as (select *, ey + em*(l-ex) as el, ey + em*(r-ex) as er, gy + gm*(l-gx) as gl, gy + gm*(r-gx) as gr
  from t where l < r),
v as (select a_ord, b_ord, sum(s*((r-l)*(least(el, gl) + least(er, gr))/2
  + case when (el-gl)*(er-gr) < 0
    then (r-l)*abs(el-gl)*abs(er-gr)/(2*(abs(el-gl)+abs(er-gr))) else 0 end)) as area
  from u group by a_ord, b_ord)
select h.a_ord, h.b_ord, round(greatest(coalesce(area, 0), 0)/10000.0, 6) as area_m2 from h left join v using (a_ord, b_ord)"""

_EDITED_CTE = "with " + ", ".join(
    f"{name} as ({L.duck(EDITS[layer][1])})" for name, layer in zip("bapr", ("buildings", "predictions", "parcels", "roads"))
) + """,
ba as (select *, 0 as rank from b union all select *, 1 as rank from a)"""

QUERIES = {
    "overlap_pairs": (overlap_pairs, f"""{_CTE}, o as ({_OVB})
select warning_id, round(v, 6) as overlap_area_m2, {_SEV.format("v")} as severity,
  round(cx, 3) as cx, round(cy, 3) as cy from o"""),
    "road_overlaps": (road_overlaps, f"""{_CTE}, o as ({_ROAD})
select warning_id, round(v, 6) as overlap_area_m2, 'low' as severity,
  'project_vaayu_sample' as source, 1.0e0 as exceed_ratio from o"""),
    "road_types": (road_types, f"""with b as ({_B}), q as ({L.duck(L.ROAD_PARTS)})
select concat('W-RD-OVERLAP-', l.feature_id, '-R-', q.k) as warning_id, round(sum({_AREA}), 6) as overlap_area_m2
from b l join q on {_HIT} group by l.feature_id, q.k"""),
    "parcel_crossings": (parcel_crossings, f"""{_CTE}, o as ({_CRB})
select warning_id, round(v, 6) as outside_area_m2, {_SEV.format("v/0.5")} as severity,
  round(v - 0.5, 6) as exceed_m2, source, round(cx, 3) as cx, round(cy, 3) as cy
from o"""),
    "outside_parcels": (outside_parcels, f"""{_CTE}, o as ({_OUB})
select id_a as building_id, id_b as nearest_parcel_id, round(v, 6) as distance_m from o"""),
    "nearest_road": (nearest_road, f"""{_CTE}
select feature_id, road_id, round(v, 6) as distance_m from (
  select l.feature_id, q.feature_id as road_id, {_GAP} as v,
    row_number() over (partition by l.feature_id order by {_GAP}, q.ord) as rn
  from p l cross join r q) t where rn = 1"""),
    "nearest_far_clusters": (nearest_far_clusters, f"""with b as ({_B}), p as ({L.duck(L.FAR_PARCELS)}),
best as (select l.feature_id, min(struct_pack(d := {_SQUARE}, ord := q.ord, id := q.feature_id)) as m
  from b l cross join p q group by l.feature_id)
select feature_id, m.id as parcel_id, round(sqrt(m.d)/100.0, 4) as distance_m from best"""),
    "warnings_all": (warnings_all, f"""{_ALL}
select warning_id, warning_type, {_SEV.format("ratio")} as severity, source, explanation,
  concat_ws(',', id_a, id_b) as feature_ids, round(v, 6) as measured_value,
  round(exceed, 6) as exceed_value, round(ratio, 6) as exceed_ratio,
  round(cx, 3) as cx, round(cy, 3) as cy from w"""),
    "incremental_revalidation": (incremental_revalidation, f"""{_ALL.replace(_CTE, _EDITED_CTE)}
select warning_id, warning_type, explanation, concat_ws(',', id_a, id_b) as feature_ids, round(v, 6) as measured_value,
  round(exceed, 6) as exceed_value from w"""),
    "warning_counts": (warning_counts, f"""{_ALL}
select count(*) as total_warnings,
  count(*) filter (source like '%synthetic%') as synthetic_warning_count,
  count(*) filter (source not like '%synthetic%') as real_warning_count from w"""),
    "severity_and_actions": (severity_and_actions, f"""{_ALL}, z as (select *,
  {_SEV.format("ratio")} as severity from w)
select warning_type, severity,
  case warning_type {" ".join(f"when '{k}' then '{v[0]}'" for k, v in V.ACTIONS.items())} end
    as action_type,
  case warning_type {" ".join(f"when '{k}' then '{v[0]}'" for k, v in V.TOLERANCES.items())} end
    as tolerance_name,
  cast(case warning_type {" ".join(f"when '{k}' then {v[1]}" for k, v in V.TOLERANCES.items())} end
    as double) as tolerance_value,
  case warning_type {" ".join(f"when '{k}' then '{v[2]}'" for k, v in V.TOLERANCES.items())} end
    as unit, count(*) as n from z group by all"""),
    "low_confidence": (low_confidence, f"""{_ALL}
select warning_id, {_SEV.format("ratio")} as severity, explanation, round(v, 6) as confidence,
  round(exceed, 6) as exceed_value, round(ratio, 6) as exceed_ratio from w
where warning_type = 'low_confidence_detection'"""),
    "narration": (narration, _NARRATION_SQL),
    "review_scores": (review_scores, _SCORE_SQL),
    "score_rules": (score_rules, _RULES_SQL),
    "score_evidence": (score_evidence, f"""{_ALL}, e as (select *, concat(warning_id, ': ',
  case warning_type when 'building_crosses_parcel' then concat('outside_area_m2=', v)
    when 'building_outside_parcel' then concat('distance_to_parcel_m=', v)
    when 'low_confidence_detection' then concat('confidence=', v, ', confidence_threshold=0.7')
    else concat('overlap_area_m2=', v, ', intersection_area_m2=', v) end) as measured from w)
select id_a as feature_id, measured from e union all select id_b, measured from e where id_b is not null"""),
    "parcel_rag": (parcel_rag, _RAG_SQL),
    "parcel_rag_all_pairs": (parcel_rag_all_pairs, f"""{_CTE}, o as ({_CRB}),
nw as (select id_b as feature_id, count(*) as n from o group by 1),
tot as (select count(*) as bn, count(*) filter (area_sqm > 600 or area_sqm < 10) as bu from b),
t as (select p.feature_id, coalesce(nw.n, 0) as wn, bn,
  least(100, 10 + least(50, coalesce(nw.n, 0)*25) + case when bu > 0 then 15 else 0 end) as score
  from p left join nw using (feature_id) cross join tot)
select feature_id as parcel_id, case when score >= 60 or wn > 0 then 'RED' when score >= 30
  then 'AMBER' else 'GREEN' end as rag_status, cast(score as integer) as parcel_score,
  bn as intersecting_building_count, wn as warning_count from t"""),
    "iou_candidates": (iou_candidates, f"""{_IOU}
select a_id, b_id, round(iou, 6) as iou from i where iou >= 0.05"""),
    "match_greedy": (match_greedy, _match_sql(
        _BEST, _BEST, 0.35, " select a_id, b_id, round(iou, 6) as iou from matched")),
    "match_pred_order": (match_pred_order, _match_sql(
        "-iou, b_ord", "a_ord", 0.35, " select a_id, b_id, round(iou, 6) as iou from matched")),
    "discrepancy_metrics": (discrepancy_metrics, _match_sql(_BEST, _BEST, 0.35, _METRICS_TAIL)),
    "discrepancy_unmatched": (discrepancy_unmatched, _match_sql(_BEST, _BEST, 0.35, """
select feature_id, 'model_only' as side from a
where feature_id not in (select a_id from matched)
union all select feature_id, 'reference_only' from b
where feature_id not in (select b_id from matched)""")),
    "footprint_area": (footprint_area, f"""{_CTE}
select feature_id, round(cast((x1-x0)*(y1-y0) as double)/10000.0, 6) as edge_area_m2,
  round(area_sqm, 6) as area_sqm, round((x0+x1)/2.0, 3) as cx, round((y0+y1)/2.0, 3) as cy from b"""),
    "polygon_pair_area": (polygon_pair_area, _DIAMOND_SQL),
}
