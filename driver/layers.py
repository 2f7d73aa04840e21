"""Feature layers, pixels and review events derived from the relational test tables.

The same SQL text runs in Spark and in DuckDB.  Layers are boxes with integer centimetre corners, so
areas are exact in both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from groundcheck.functions import geometry
from groundcheck.lineage import cut_lineage
from groundcheck.operators.polygons import shape_table

UNIT_AREA = 10000.0  # square centimetres in a square metre
UNIT_LENGTH = 100.0

_BUILDING_BOXES = """
  select o_orderkey as ord,
    (cast(floor(o_orderkey/8) as bigint) % 50)*3000 + (o_orderkey % 4)*700
      + (o_orderkey*37) % 150 - 60 as x0,
    cast(floor(o_orderkey/400) as bigint)*3000 + cast(floor((o_orderkey % 8)/4) as bigint)*1400
      + (o_orderkey*53) % 200 - 80 as y0,
    400 + (o_orderkey*17) % 500 as w, 500 + (o_orderkey*29) % 1000 as h
  from {orders}"""

BUILDINGS = f"""
select concat('B-', cast(ord as string)) as feature_id, ord, x0, y0, x0+w as x1, y0+h as y1,
  cast(w*h as double)/10000.0 as area_sqm, 'building' as feature_type,
  'project_vaayu_sample' as source, cast(null as double) as confidence,
  case when ord % 11 = 0 then 'approved' when ord % 11 = 1 then 'rejected' else 'unverified' end
    as review_status
from ({_BUILDING_BOXES}) t"""

PREDICTIONS = f"""
select concat('A-', cast(ord as string)) as feature_id, ord,
  x0 + (ord*41) % 700 - 350 as x0, y0 + (ord*43) % 200 - 100 as y0,
  x1 + (ord*41) % 700 - 350 as x1, y1 + (ord*43) % 200 - 100 as y1,
  area_sqm, 'building' as feature_type, 'ai_building_model' as source,
  cast((ord*7919) % 1000 as double)/1000.0 as confidence, 'unverified' as review_status
from ({BUILDINGS}) b"""

PARCELS = """
select concat('P-', cast(p_partkey as string)) as feature_id, p_partkey as ord,
  (p_partkey % 50)*3000 as x0, cast(floor(p_partkey/50) as bigint)*3000 as y0,
  (p_partkey % 50)*3000 + case when p_partkey % 10 = 9 then 30 else 2800 end as x1,
  cast(floor(p_partkey/50) as bigint)*3000 + case when p_partkey % 10 = 9 then 30 else 2800 end as y1,
  case when p_partkey % 10 = 9 then 0.09e0 else 784.0e0 end as area_sqm, 'parcel' as feature_type,
  case when p_partkey % 2 = 0 then 'synthetic_test' else 'official_reference' end as source,
  cast(null as double) as confidence, 'unverified' as review_status
from {part}"""

FAR_PARCELS = f"""
select feature_id, ord, x0 + 10000000 as x0, y0 + 3000000 as y0, x1 + 10000000 as x1, y1 + 3000000 as y1,
  area_sqm, feature_type, source, confidence, review_status from ({PARCELS}) p"""

ROADS = """
select concat('R-', cast(s_suppkey as string)) as feature_id, s_suppkey as ord,
  (s_suppkey % 5)*10000 as x0, s_suppkey*1200 + 2700 as y0,
  (s_suppkey % 5)*10000 + 90000 as x1, s_suppkey*1200 + 3000 + (s_suppkey % 3)*100 as y1,
  cast(90000*(300 + (s_suppkey % 3)*100) as double)/10000.0 as area_sqm,
  'village_road_polygon' as feature_type, 'project_vaayu_sample' as source,
  cast(null as double) as confidence, 'unverified' as review_status
from {supplier}"""

#: Parts of roads of every geometry type: points, lines along x, and boxes.
ROAD_PARTS = """
select k, j, kind, x0, y0,
  case when kind in ('Point', 'MultiPoint') then x0 else x0 + 30000 end as x1,
  case when kind in ('Polygon', 'MultiPolygon') then y0 + 100 else y0 end as y1
from (select s_suppkey as k, j, (s_suppkey % 5)*10000 + j*45000 as x0, s_suppkey*1200 + 2700 + j*150 as y0,
  case s_suppkey % 6 when 0 then 'MultiLineString' when 1 then 'MultiPoint' when 2 then 'LineString' when 3 then 'Point'
    when 4 then 'MultiPolygon' else 'Polygon' end as kind
  from (select s_suppkey, 0 as j from {supplier} union all select s_suppkey, 1 from {supplier}) s) p
where j = 0 or kind in ('MultiLineString', 'MultiPoint', 'MultiPolygon')"""

PIXELS = """
select event_id as id, cast(floor(event_id/100) as bigint) as prow, event_id % 100 as pcol,
  case when b = 0 or event_id % 97 = 0 then 20 else 100 + (event_id*31) % 30 end as r,
  case when b = 0 or event_id % 97 = 0 then 200 else 100 + (event_id*17) % 30 end as g,
  case when b = 0 or event_id % 97 = 0 then 20 else 100 + (event_id*13) % 30 end as b,
  case when event_id % 53 = 0 then 0 else 255 end as alpha
from (select event_id, cast(floor(floor(event_id/100)/8) + floor((event_id % 100)/8) as bigint) % 3
  as b from {events}) t"""

EVENTS = """
select event_id, ts, concat('B-', cast(user_id as string)) as feature_id,
  case event_type when 'click' then 'geometry_edit' when 'signup' then 'revert_geometry'
    else 'status_update' end as action,
  case event_type when 'view' then 'under_review' when 'purchase' then 'approved'
    when 'error' then 'rejected' end as new_status,
  concat('reviewer-', cast(user_id % 7 as string)) as reviewer
from {events}"""

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run a layer text on Spark: ``{orders}`` and the like become the Parquet tables."""
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql, **used)


def duck(sql: str) -> str:
    """The same text for DuckDB, where the tables are views of the same name."""
    for t in TABLES:
        sql = sql.replace("{" + t + "}", t)
    return sql.replace("as string)", "as varchar)")


def boxes(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A box layer as a stored, validated shape table (boxes are valid by construction)."""
    # a layer file is one split here; spread it so that stored layers have even parts, before rows get their edges
    df = run(spark, sf_dir, sql).repartition(spark.sparkContext.defaultParallelism, "ord")
    df = df.withColumns({
        "edges": geometry.box_edges("x0", "y0", "x1", "y1"),
        "minx": F.col("x0").cast("double"), "miny": F.col("y0").cast("double"),
        "maxx": F.col("x1").cast("double"), "maxy": F.col("y1").cast("double"),
        "geom_type": F.lit("Polygon"), "empty": F.lit(False), "corrupt": F.lit(False),
        "areal": F.lit(True), "valid": F.lit(True),
        "invalid_reason": F.lit(None).cast("string")})
    return cut_lineage(shape_table(df))
