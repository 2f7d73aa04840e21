"""Projects, rasters, model runs and providers as tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from groundcheck import fixed_values as V


def safe_id(c: Column) -> Column:
    """Identifier with other characters folded to ``-``; ``project`` when nothing is left."""
    cleaned = F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "-"), r"^-+|-+$", "")
    return F.when(F.length(cleaned) > 0, cleaned).otherwise("project")


def usable_projects(records: DataFrame) -> DataFrame:
    """Project records whose id is safe, equals its folder, and that describe a raster."""
    return records.filter(
        F.col("project_id").isNotNull() & (F.col("project_id") == safe_id(F.col("project_id")))
        & (F.col("project_id") == F.col("folder")) & F.col("raster").isNotNull())


def upsert_projects(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Insert or update: blank incoming text keeps the old value, raster maps are merged."""
    new = incoming.select(
        safe_id(F.col("project_id")).alias("project_id"),
        F.nullif("name", F.lit("")).alias("_name"), F.nullif("locality", F.lit("")).alias("_loc"),
        F.col("raster").alias("_raster"), F.col("created_at").alias("_created"))
    df = current.join(new, "project_id", "full_outer")
    empty = F.expr("cast(map() as map<string,string>)")
    old = F.map_filter(F.coalesce("raster", empty), lambda k, _: ~F.coalesce(
        F.map_contains_key("_raster", k), F.lit(False)))
    return df.select(
        "project_id", F.coalesce("_name", "name", "project_id").alias("name"),
        F.coalesce("_loc", "locality", F.lit("Unknown locality")).alias("locality"),
        F.coalesce("created_at", "_created").alias("created_at"),
        F.coalesce("status", F.lit("active")).alias("status"),
        F.map_concat(old, F.coalesce("_raster", empty)).alias("raster"))


def check_rasters(rasters: DataFrame, max_pixels: int = V.MAX_RASTER_PIXELS) -> DataFrame:
    """Add ``errors``, band mapping and ground sampling distance to raster descriptions.

    Input: ``epsg, bands, width, height, a, b, c, d, e, f`` (affine), ``minx, miny, maxx, maxy``,
    ``dtypes ARRAY<STRING>``, ``colors ARRAY<STRING>`` (interpretation per band).
    """
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    affine = ("a", "b", "c", "d", "e", "f")
    position = lambda color: F.array_position("colors", color)
    named = (position("red") > 0) & (position("green") > 0) & (position("blue") > 0)
    mapping = F.when(named, F.array(*[position(c).cast("int") for c in ("red", "green", "blue")])
                     ).otherwise(F.array(F.lit(1), F.lit(2), F.lit(3)))
    all_finite = finite("a")
    for c in affine[1:]:
        all_finite = all_finite & finite(c)
    flat = F.col("a") * F.col("e") - F.col("b") * F.col("d") == 0
    identity = F.struct(*affine) == F.struct(*[F.lit(v).alias(k) for k, v in zip(
        affine, (1.0, 0.0, 0.0, 0.0, 1.0, 0.0))])
    box = finite("minx") & finite("miny") & finite("maxx") & finite("maxy") & (
        F.col("maxx") > F.col("minx")) & (F.col("maxy") > F.col("miny"))
    pixels = F.col("width").cast("bigint") * F.col("height")

    def rule(bad: Column, words: str) -> Column:
        return F.when(F.coalesce(bad, F.lit(True)), words)

    df = rasters.withColumn("rgb_band_mapping", mapping)
    types = F.transform("rgb_band_mapping", lambda i: F.get("dtypes", i - 1))
    return df.withColumn("errors", F.array_compact(F.array(
        rule(F.col("epsg").isNull(), "GeoTIFF has no CRS. Assign a valid CRS before upload."),
        F.when(F.col("epsg") != 3857, "This build can display project rasters only in EPSG:3857."),
        rule(F.col("bands") < 3, "RGB GeoTIFF required: at least three raster bands must be present."),
        rule((F.col("width") <= 0) | (F.col("height") <= 0) | (pixels > max_pixels),
             "Raster dimensions exceed the supported 500-million-pixel limit."),
        rule(~all_finite | flat | identity, "GeoTIFF has no usable spatial transform."),
        rule(~box, "GeoTIFF has invalid or empty spatial bounds."),
        rule(F.exists(types, lambda t: t.isNull() | (t != "uint8")),
             "This build requires uint8 RGB bands; convert other data types before upload."),
    ))).withColumns({
        "gsd_x": F.hypot("a", "d"), "gsd_y": F.hypot("b", "e"),
        "alpha_band": F.when(position("alpha") > 0, position("alpha").cast("int"))})


def write_run(spark: SparkSession, features: DataFrame, mode: str, run_id: str, path: str) -> None:
    """Prediction artifact of one run, in a partition of its own that a retried run overwrites."""
    for part in (mode, run_id):
        if not re.fullmatch(r"[A-Za-z0-9._-]+", part):
            raise ValueError(f"not a safe identifier: {part!r}")
    features.drop("mode", "run_id").write.mode("overwrite").parquet(f"{path}/mode={mode}/run_id={run_id}")


def list_runs(runs: DataFrame, project_id: str | None = None) -> DataFrame:
    """Readable run records, newest first."""
    good = runs.filter(F.col("run_id").isNotNull() & F.col("created_at").isNotNull())
    if project_id is not None:
        good = good.filter(F.col("project_id") == project_id)
    return good.orderBy(F.desc("created_at"), F.desc("run_id"))


def latest_timing(runs: DataFrame) -> DataFrame:
    """Per provider the usable timing sample with the highest run number.

    ``runs``: ``provider_id, run_id, tile_count, elapsed_seconds, device``.
    """
    number = F.coalesce(
        F.expr("try_cast(nullif(regexp_extract(run_id, '-([0-9]+)$', 1), '') as bigint)"), F.lit(-1))
    usable = runs.filter(
        (F.col("tile_count") > 0) & (F.col("elapsed_seconds") > 0)
        & ~F.isnan("elapsed_seconds") & (F.col("elapsed_seconds") < float("inf")))
    best = usable.groupBy("provider_id").agg(F.max_by(
        F.struct("run_id", "tile_count", "elapsed_seconds", "device"),
        F.struct(number, F.col("run_id"))).alias("s"))
    return best.select(
        "provider_id", "s.*", (F.col("s.elapsed_seconds") / F.col("s.tile_count")).alias(
            "seconds_per_tile"))


def providers(spark: SparkSession, available: dict[str, str | None]) -> DataFrame:
    """Provider table.  ``available`` maps a provider to null, or to what it is missing."""
    rows = []
    for pid, (label, resolution, threshold, min_area) in V.PROVIDERS.items():
        reason = available.get(pid, "Model file is not present.")
        rows.append((pid, label, resolution, threshold, min_area, reason is None, reason))
    return spark.createDataFrame(
        rows, "provider_id string, label string, expected_resolution_m double, "
        "default_threshold double, default_min_area_m2 double, enabled boolean, reason string")


def saved_run(
    prediction: DataFrame, audit: DataFrame, report: DataFrame, label_count: int,
    threshold: float = 0.5, metric_status: str = "in_sample_full_AOI_fit_not_held_out",
) -> DataFrame:
    """Join the three one-row records of a saved run and refuse runs that do not belong together.

    ``prediction``: ``threshold, metric_status``; ``audit``: ``label_feature_count,
    model_input_sha256``; ``report``: ``input_raster_sha256`` and figures.
    """
    joined = prediction.join(audit).join(report)
    ok = (
        (F.col("threshold") == threshold) & (F.col("metric_status") == metric_status)
        & (F.col("label_feature_count") == label_count)
        & (F.col("model_input_sha256") == F.col("input_raster_sha256")))
    checked = F.when(F.coalesce(ok, F.lit(False)), True).otherwise(F.raise_error(
        F.lit("saved run provenance does not match")).cast("boolean"))
    return joined.withColumn("provenance_ok", checked)


def scoring_tables(spark: SparkSession) -> dict[str, DataFrame]:
    """Rules, tolerances and actions as tables, for reports and overrides."""
    return {
        "rules": spark.createDataFrame(
            [(k, *v) for k, v in V.SCORE_RULES.items()],
            "rule_id string, rule_name string, points int, description string"),
        "tolerances": spark.createDataFrame(
            [(k, *v) for k, v in V.TOLERANCES.items()],
            "warning_type string, name string, value double, unit string"),
        "actions": spark.createDataFrame(
            [(k, *v) for k, v in V.ACTIONS.items()],
            "warning_type string, action_type string, text string"),
    }
