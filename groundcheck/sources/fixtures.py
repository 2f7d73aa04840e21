"""Demonstration features for trying the rules without data."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

_RAW = "ord bigint, id string, props map<string,string>, geom_type string, coords_json string"


def _box(w: float, s: float, e: float, n: float) -> list:
    return [[[w, s], [e, s], [e, n], [w, n], [w, s]]]


# fixed values: id, feature type, stored area, ring coordinates (longitude, latitude)
DEMO_FEATURES = [
    ("SYN-BLD-OVERLAP-1", "synthetic_building", 725.0, _box(72.75880, 23.03880, 72.75910, 23.03905)),
    ("SYN-BLD-OVERLAP-2", "synthetic_building", 725.0, _box(72.75900, 23.03890, 72.75930, 23.03915)),
    ("SYN-INVALID-GEOM-1", "synthetic_building", 0.0, [[
        [72.75820, 23.03880], [72.75850, 23.03905], [72.75850, 23.03880], [72.75820, 23.03905],
        [72.75820, 23.03880]]]),
    ("SYN-EMPTY-GEOM-1", "synthetic_building", 0.0, []),
    ("SYN-BLD-ROAD-INT-1", "synthetic_building", 530.0, _box(72.75780, 23.03920, 72.75805, 23.03940)),
    ("SYN-ROAD-CORRIDOR-1", "synthetic_road_corridor", None,
     _box(72.75760, 23.03930, 72.75830, 23.03938)),
    ("SYN-BLD-PARCEL-CROSS-1", "synthetic_building", 680.0,
     _box(72.75850, 23.03955, 72.75880, 23.03980)),
    ("SYN-PARCEL-DEMO-1", "synthetic_parcel", None, _box(72.75865, 23.03950, 72.75920, 23.04000)),
]
# fixed values: id, confidence, stored area, box
DEMO_PREDICTIONS = [
    ("AI-BLD-001", 0.92, 41.5, _box(72.75685, 23.04105, 72.75705, 23.04122)),
    ("AI-BLD-002", 0.86, 53.2, _box(72.75715, 23.04130, 72.75738, 23.04148)),
    ("AI-BLD-003", 0.64, 35.8, _box(72.75745, 23.04080, 72.75765, 23.04096)),
]


def demo_features(spark: SparkSession) -> DataFrame:
    rows = []
    for i, (fid, kind, area, coords) in enumerate(DEMO_FEATURES):
        props = {"feature_id": fid, "feature_type": kind, "source": "synthetic_test"}
        if area is not None:
            props["area_sqm"] = str(area)
        rows.append((i, fid, props, "Polygon", json.dumps(coords)))
    return spark.createDataFrame(rows, _RAW)


def demo_predictions(spark: SparkSession, threshold: float = 0.5) -> DataFrame:
    """Detections at or above a confidence."""
    rows = [
        (i, fid, {"feature_type": "building", "source": "ai_building_model", "confidence": str(c),
                  "area_sqm": str(area)}, "Polygon", json.dumps(coords))
        for i, (fid, c, area, coords) in enumerate(DEMO_PREDICTIONS)]
    return spark.createDataFrame(rows, _RAW).filter(
        F.col("props")["confidence"].cast("double") >= threshold)


def no_parcels(spark: SparkSession) -> DataFrame:
    """The parcel layer of an area without cadastral data: right columns, no rows."""
    return spark.createDataFrame([], _RAW)
