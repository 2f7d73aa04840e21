"""Raw features to the shared feature schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from groundcheck import fixed_values as V

# property name: type; the default is null unless DEFAULTS names one
PROPERTIES = {
    "feature_id": "string", "feature_type": "string", "source": "string", "source_date": "string",
    "model_name": "string", "model_version": "string", "confidence": "double",
    "verification_status": "string", "review_status": "string", "review_score": "int",
    "warning_ids": "array<string>", "parent_feature_ids": "array<string>", "edited_by": "string",
    "edited_at": "string", "notes": "string", "edit_reason": "string", "area_sqm": "double",
    "roof_type": "string", "no_floors": "int", "highway": "string", "locality": "string",
    "lgd_village_code": "string", "provenance_citation": "string",
}
DEFAULTS = {
    "verification_status": "unverified", "review_status": "unverified", "notes": "",
    "locality": V.DEFAULT_LOCALITY, "lgd_village_code": V.DEFAULT_VILLAGE_CODE,
}


def drop_personal(props: Column) -> Column:
    """A property map without personal keys."""
    return F.map_filter(props, lambda k, _: ~k.isin(*V.PERSONAL_KEYS))


def extra_properties(props: Column) -> Column:
    """Keys outside the schema, or null when there is none."""
    known = (*PROPERTIES, *V.IDENTITY_KEYS, *V.PERSONAL_KEYS)
    rest = F.map_filter(props, lambda k, _: ~k.isin(*known))
    return F.when(F.size(rest) > 0, rest)


def corrected_source(original: Column, feature_type: str, layer_source: str) -> Column:
    """The layer's source, except for known kinds named by the original."""
    named = F.coalesce(original, F.lit(layer_source))
    rule = F.when(F.lower(named).contains("osm") | F.lit(feature_type == "road"), "osm").when(
        F.lower(named).contains("synthetic"), "synthetic_test").otherwise(layer_source)
    if feature_type == "building":
        rule = F.when(named == "manual_visual_reference", V.REFERENCE_SOURCE).otherwise(rule)
    return rule


def finite(v: Column) -> Column:
    """Null for NaN and infinities."""
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def scrub(df: DataFrame) -> DataFrame:
    """Replace NaN and infinities by null in every float column, also inside arrays and structs."""

    def clean(c: Column, t: T.DataType) -> Column:
        if isinstance(t, (T.DoubleType, T.FloatType)):
            return finite(c)
        if isinstance(t, T.ArrayType):
            return F.transform(c, lambda x: clean(x, t.elementType))
        if isinstance(t, T.MapType):
            return F.transform_values(c, lambda _, x: clean(x, t.valueType))
        if isinstance(t, T.StructType):
            fields = [clean(c[f.name], f.dataType).alias(f.name) for f in t.fields]
            return F.when(c.isNotNull(), F.struct(*fields))
        return c

    def has_float(t: T.DataType) -> bool:
        kids = (t.fields if isinstance(t, T.StructType) else [])
        inner = getattr(t, "elementType", None) or getattr(t, "valueType", None)
        return isinstance(t, (T.DoubleType, T.FloatType)) or any(
            has_float(f.dataType) for f in kids) or (inner is not None and has_float(inner))

    return df.select(*[
        clean(F.col(f.name), f.dataType).alias(f.name) if has_float(f.dataType) else F.col(f.name)
        for f in df.schema.fields])


def normalize(
    raw: DataFrame, feature_type: str, layer_source: str = V.REFERENCE_SOURCE,
) -> DataFrame:
    """Raw rows (``ord, id, props MAP<STRING,STRING>, geom_type, coords_json``) to feature rows.

    Values in ``props`` are text, lists as JSON text.  Unknown keys stay in ``extra``; personal keys
    are dropped; the geometry read is also kept as the original.
    """
    p = F.col("props")
    clean = raw.withColumn("props", drop_personal(F.coalesce(p, F.expr(
        "cast(map() as map<string,string>)"))))

    def value(key: str) -> Column:
        kind, text = PROPERTIES[key], F.col("props")[key]
        if kind.startswith("array"):
            out = F.coalesce(F.from_json(text, kind), F.array().cast(kind))
        elif kind == "double":
            out = finite(F.expr(f"try_cast(props['{key}'] as double)"))
        elif kind == "int":
            out = F.expr(f"try_cast(props['{key}'] as int)")
        else:
            out = text
        # a key that is present keeps its value, even null; only a missing key takes the default
        if key in DEFAULTS:
            out = F.when(F.map_contains_key("props", F.lit(key)), out).otherwise(DEFAULTS[key])
        return out

    filled = lambda c: F.nullif(c, F.lit(""))
    fid = F.coalesce(
        filled(F.col("id")), filled(F.col("props")["building_id"]), filled(F.col("props")["road_id"]),
        F.concat(F.lit(f"{feature_type.upper()}-AUTO-"), F.col("ord").cast("string")))
    source = corrected_source(F.col("props")["source"], feature_type, layer_source)
    special = {
        "feature_id": fid, "source": source,
        "feature_type": F.coalesce(F.col("props")["feature_type"], F.lit(feature_type)),
        "source_date": F.when(F.map_contains_key("props", F.lit("source_date")), F.col("props")[
            "source_date"]).otherwise(F.when(source == "osm", V.OSM_SOURCE_DATE)),
        "provenance_citation": F.lit(V.PROVENANCE),
    }
    cols = [(special[k] if k in special else value(k)).alias(k) for k in PROPERTIES]
    return clean.select(
        "ord", *cols, extra_properties(F.col("props")).alias("extra"), "geom_type", "coords_json",
        F.col("coords_json").alias("original_coords_json"))
