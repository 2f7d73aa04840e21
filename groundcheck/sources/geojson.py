"""Reading and writing GeoJSON feature collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from groundcheck import fixed_values as V

_FEATURE = ("struct<type:string,id:string,geometry:struct<type:string,coordinates:string>,"
            "properties:map<string,string>>")
_LINE = _FEATURE.replace("struct<type", "struct<ord:bigint,type", 1)
_COLLECTION = (f"struct<type:string,name:string,features:array<{_FEATURE}>,"
               "crs:struct<properties:struct<name:string>>>")


def _feature_columns(f: Column) -> list[Column]:
    return [
        f["id"].alias("id"), f["properties"].alias("props"), f["geometry"]["type"].alias("geom_type"),
        f["geometry"]["coordinates"].alias("coords_json")]


def collection_errors(texts: DataFrame, expected_crs: str = "4326") -> DataFrame:
    """Add ``error`` to documents (``text``): null when the collection can be read."""
    head = F.from_json("text", "struct<type:string,features:string,crs:struct<properties:struct<name:string>>>")
    crs = F.coalesce(F.col("_head.crs.properties.name"), F.lit(""))
    return texts.withColumn("_head", head).withColumn("error", F.when(
        ~F.ltrim("text").startswith("{") | F.col("_head").isNull(), "Root must be a JSON object.",
    ).when(
        ~F.col("_head.type").eqNullSafe(F.lit("FeatureCollection")),
        F.concat(F.lit("Expected FeatureCollection, received type: "),
                 F.coalesce("_head.type", F.lit("None"))),
    ).when(
        ~F.coalesce(F.ltrim("_head.features").startswith("["), F.lit(False)),
        "Missing 'features' array in FeatureCollection.",
    ).when(
        F.lit("4326" in expected_crs) & crs.contains("3857"),
        F.concat(F.lit("CRS mismatch: Expected EPSG:4326/CRS84, found "), crs))).drop("_head")


def _checked(name: str, on_error: str) -> Column:
    """The text where it has no ``error``; else null or, with ``fail``, a failure with that error."""
    if on_error not in ("fail", "skip"):
        raise ValueError("on_error must be fail or skip")
    good = F.when(F.col("error").isNull(), F.col(name))
    return good if on_error == "skip" else good.otherwise(F.raise_error(F.col("error")).cast("string"))


def parse_collections(texts: DataFrame, on_error: str = "fail") -> DataFrame:
    """Documents (``text``, and ``rank`` where there are several) to raw features with load order ``ord``.

    Features keep their order within a document, and documents that of ``rank`` (below 2**23), so no two
    features share an ``ord``.  A document that can't be read fails the job with its error; with
    ``on_error="skip"`` it gives no rows, and ``collection_errors`` lists it.
    """
    checked = collection_errors(texts)
    text = _checked("text", on_error)
    if on_error == "skip":
        checked = checked.filter(F.col("error").isNull())
    rank = F.col("rank").cast("bigint") if "rank" in texts.columns else F.lit(0).cast("bigint")
    doc = checked.select(rank.alias("rank"), F.from_json(text, _COLLECTION).alias("d"))
    return doc.select("rank", F.posexplode("d.features").alias("place", "f")).select(
        (F.shiftleft("rank", 40) + F.col("place")).alias("ord"), *_feature_columns(F.col("f")))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``path, text, rank`` of every file: one GeoJSON document each, ranked by path.

    The ranking sees one row per file, never the documents' features.
    """
    texts = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    ranks = texts.select("path").withColumn(
        "rank", F.row_number().over(Window.orderBy("path")).cast("bigint") - 1)
    return texts.join(ranks, "path")


def read_collection(spark: SparkSession, path: str, on_error: str = "fail") -> DataFrame:
    """One GeoJSON document per file; features of all files in the order of the paths."""
    return parse_collections(read_documents(spark, path), on_error)


def read_lines(spark: SparkSession, path: str, on_error: str = "fail") -> DataFrame:
    """One feature per line: the form to use beyond a few hundred megabytes, as it can be split.

    Each line needs a numeric ``ord`` beside the feature members, because a distributed read keeps no
    order of its own.  A line that is no such feature fails the job, or is left out with
    ``on_error="skip"``; ``line_errors`` lists them.
    """
    lines = line_errors(spark.read.text(path))
    value = _checked("value", on_error)
    if on_error == "skip":
        lines = lines.filter(F.col("error").isNull())
    return lines.select(F.from_json(value, _LINE).alias("f")).select(
        F.col("f.ord").alias("ord"), *_feature_columns(F.col("f")))


def line_errors(lines: DataFrame) -> DataFrame:
    """Add ``error`` to feature lines (``value``): null when the line can be read."""
    f = F.from_json("value", _LINE)
    return lines.withColumn("error", F.when(
        ~F.coalesce(F.ltrim("value").startswith("{"), F.lit(False)) | f.isNull(), "Line is no JSON object."
    ).when(f["ord"].isNull(), "Line has no ord."))


def polygon_labels(raw: DataFrame) -> DataFrame:
    """Features usable as labels: polygons with coordinates.  Raises when none is left."""
    kept = raw.filter(
        F.col("geom_type").isin("Polygon", "MultiPolygon")
        & ~F.trim(F.coalesce("coords_json", F.lit("[]"))).isin("", "[]", "null"))
    if kept.isEmpty():
        raise ValueError("no polygon labels were found")
    return kept


def feature_json(layer: Column | None = None) -> Column:
    """A feature row as GeoJSON text; coordinate numbers are passed through as text."""
    from groundcheck.sources.normalize import PROPERTIES

    props = [F.col(k) for k in PROPERTIES] + [F.col("extra")]
    if layer is not None:
        props.append(layer.alias("layer"))
    body = F.to_json(F.struct(*props))
    geometry = F.when(F.col("geom_type").isNull(), F.lit("null")).otherwise(F.concat(
        F.lit('{"type":"'), "geom_type", F.lit('","coordinates":'),
        F.coalesce("coords_json", F.lit("[]")), F.lit("}")))
    return F.concat(
        F.lit('{"type":"Feature","id":'), F.expr(
            "trim(trailing ']' from substr(to_json(array(feature_id)), 2))"),
        F.lit(',"ord":'), F.col("ord").cast("string"), F.lit(',"geometry":'), geometry,
        F.lit(',"properties":'), body, F.lit("}"))


def export_bundle(layers: dict[str, DataFrame]) -> DataFrame:
    """Reviewed layers as feature lines, each tagged with its layer, in layer order."""
    out = None
    for i, name in enumerate(V.EXPORT_LAYERS):
        if name not in layers:
            continue
        part = layers[name].select(
            F.lit(i).alias("layer_rank"), "ord", F.lit(name).alias("layer"),
            feature_json(F.lit(name)).alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


def bundle_header(bundle: DataFrame, warnings: DataFrame, project_id: str) -> DataFrame:
    """One row describing an export; every warning counts as open."""
    return bundle.agg(F.count(F.lit(1)).alias("total_features")).join(
        warnings.agg(F.count(F.lit(1)).alias("open_warnings_count"))).select(
        F.lit(project_id).alias("project_id"), "total_features", "open_warnings_count",
        F.lit("EPSG:4326 (WGS 84 / RFC 7946)").alias("target_crs"),
        F.lit(V.PROVENANCE).alias("provenance_disclaimer"))


def import_bundle(lines: DataFrame) -> DataFrame:
    """Feature lines (``value``) back to raw rows with the ``layer`` they belong to."""
    f = F.from_json("value", _LINE)
    rows = lines.select(f.alias("f")).select(
        F.col("f.ord").alias("ord"), *_feature_columns(F.col("f")))
    named = F.coalesce(F.col("props")["layer"], F.lit("buildings"))
    return rows.withColumn("layer", F.when(
        named.isin(*V.IMPORT_LAYERS), named).otherwise("buildings"))


def write_bundle(bundle: DataFrame, path: str) -> None:
    """Partitioned by layer; rows of a layer sort by load order inside each file."""
    bundle.sortWithinPartitions("layer_rank", "ord").select("layer", "value").write.mode(
        "overwrite").partitionBy("layer").text(path)


def replace_layers(current: DataFrame, imported: DataFrame) -> DataFrame:
    """Layers present in the import replace those of the store; other layers stay."""
    present = imported.select("layer").distinct()
    return current.join(F.broadcast(present), "layer", "left_anti").unionByName(
        imported, allowMissingColumns=True)
