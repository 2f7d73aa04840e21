"""Review work: the event log folded to current state, layers, snapshots, drafts.

Edits are appended as events (``event_id, ts, feature_id, action, new_status, reviewer`` and optional
``notes, edit_reason, coords_json``).  The state of a feature is an aggregate over its events, so any
number of events on one feature is combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from groundcheck import fixed_values as V

STATUS, EDIT, REVERT = "status_update", "geometry_edit", "revert_geometry"
OPTIONAL = ("notes", "edit_reason", "coords_json")


def complete_events(events: DataFrame) -> DataFrame:
    """Add optional columns that are missing and mark events that may not be applied."""
    for c in OPTIONAL:
        if c not in events.columns:
            events = events.withColumn(c, F.lit(None).cast("string"))
    status_ok = F.col("new_status").isin(*V.REVIEW_STATUSES)
    error = F.when(
        ~F.coalesce(F.col("action").isin(STATUS, EDIT, REVERT), F.lit(False)), "unknown action",
    ).when(
        (F.col("action") == STATUS) & ~F.coalesce(status_ok, F.lit(False)),
        F.concat(F.lit("Invalid review_status '"), F.coalesce("new_status", F.lit("None")), F.lit("'")))
    return events.withColumn("error", error)


def _partial(events: DataFrame) -> DataFrame:
    """Per-feature latest values as mergeable ``(when, value)`` pairs."""
    at = F.struct("ts", "event_id")

    def last(value: Column, *actions: str, present: Column | None = None) -> Column:
        hit = F.col("action").isin(*actions)
        hit = hit if present is None else hit & present
        return F.max(F.when(hit, F.struct(at.alias("at"), value.alias("value"))))

    reason = F.when(F.col("action") == REVERT, V.REVERT_REASON).otherwise(
        F.coalesce("edit_reason", F.lit(V.DEFAULT_EDIT_REASON)))
    return events.groupBy("feature_id").agg(
        last(F.col("new_status"), STATUS).alias("status"),
        last(F.col("notes"), STATUS, present=F.col("notes").isNotNull()).alias("notes"),
        # a revert leaves reviewer and time of the last real edit alone
        last(F.struct("reviewer", "ts"), STATUS, EDIT).alias("edited"),
        last(reason, EDIT, REVERT).alias("reason"),
        last(F.struct((F.col("action") == EDIT).alias("is_edit"), "coords_json"), EDIT, REVERT)
        .alias("shape"),
        F.count_if(F.col("action") == STATUS).alias("n_status"),
        F.count_if(F.col("action") == EDIT).alias("n_edit"),
        F.count_if(F.col("action") == REVERT).alias("n_revert"))


def merge_state(old: DataFrame, new: DataFrame) -> DataFrame:
    """Combine two partial states; events are taken once each."""
    latest = ("status", "notes", "edited", "reason", "shape")
    return old.unionByName(new).groupBy("feature_id").agg(
        *[F.max(c).alias(c) for c in latest],
        *[F.sum(c).alias(c) for c in ("n_status", "n_edit", "n_revert")])


def partial_state(events: DataFrame) -> DataFrame:
    """Mergeable state of a batch of events; repeated ``event_id`` count once."""
    once = complete_events(events).filter(F.col("error").isNull()).dropDuplicates(["event_id"])
    return _partial(once)


def present_state(partial: DataFrame) -> DataFrame:
    """Reader-facing columns of a partial state."""
    return partial.select(
        "feature_id", F.coalesce("status.value", F.lit("unverified")).alias("review_status"),
        F.col("notes.value").alias("notes"), F.col("edited.value.reviewer").alias("edited_by"),
        F.col("edited.value.ts").alias("edited_at"), F.col("reason.value").alias("edit_reason"),
        F.coalesce("shape.value.is_edit", F.lit(False)).alias("is_manually_edited"),
        F.when(F.col("shape.value.is_edit"), F.col("shape.value.coords_json")).alias("coords_json"),
        "n_status", "n_edit", "n_revert")


def review_state(events: DataFrame) -> DataFrame:
    """Current status, notes, editor, reason and shape of every reviewed feature."""
    return present_state(partial_state(events))


def audit_history(events: DataFrame) -> DataFrame:
    """One row per applied event with its place in the feature's history.

    Kept as rows: a feature may have any number of events.  The place is counted per day first, so one
    busy feature is spread over its days.
    """
    good = complete_events(events).filter(F.col("error").isNull()).dropDuplicates(["event_id"])
    day = good.withColumn("_day", F.to_date("ts"))
    counts = day.groupBy("feature_id", "_day").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("feature_id").orderBy("_day").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("feature_id", "_day", before.alias("_before"))
    inner = F.row_number().over(Window.partitionBy("feature_id", "_day").orderBy("ts", "event_id"))
    return day.withColumn("_inner", inner).join(offsets, ["feature_id", "_day"]).select(
        "feature_id", (F.col("_before") + F.col("_inner")).alias("position"), "event_id", "ts",
        "action", F.when(F.col("action") != REVERT, F.col("reviewer")).alias("reviewer"),
        F.when(F.col("action") == STATUS, F.col("new_status")).alias("new_status"),
        F.when(F.col("action") == REVERT, V.REVERT_REASON).otherwise(F.when(
            F.col("action") == STATUS, F.col("notes"))).alias("notes"),
        F.when(F.col("action") == EDIT, F.coalesce(
            "edit_reason", F.lit(V.DEFAULT_EDIT_REASON))).alias("edit_reason"))


def overlay(features: DataFrame, saved: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Saved values over loaded ones, matched by id.

    ``saved`` has ``feature_id``, ``columns`` and optionally ``present ARRAY<STRING>`` naming the keys
    that were saved; without it every non-null value counts.
    """
    marked = saved.select(
        "feature_id", *[F.col(c).alias(f"_s_{c}") for c in columns],
        *(["present"] if "present" in saved.columns else []))
    df = features.join(marked, "feature_id", "left")
    for c in columns:
        if "present" in saved.columns:
            use = F.coalesce(F.array_contains("present", c), F.lit(False))
            df = df.withColumn(c, F.when(use, F.col(f"_s_{c}")).otherwise(F.col(c)))
        else:
            df = df.withColumn(c, F.coalesce(F.col(f"_s_{c}"), F.col(c)))
    return df.select(*features.columns)


def changed_features(features: DataFrame) -> DataFrame:
    """Reference rows worth saving: reviewed, annotated, or with an edited shape."""
    return features.filter(
        F.col("layer").isin(*V.REFERENCE_LAYERS)
        & ((F.col("review_status") != "unverified") | (F.coalesce("notes", F.lit("")) != "")
           | (F.col("original_coords_json").isNotNull()
              & ~F.col("original_coords_json").eqNullSafe(F.col("coords_json")))))


def apply_state(features: DataFrame, state: DataFrame) -> DataFrame:
    """Features with the folded review state; a revert brings the original shape back."""
    s = state.select("feature_id", *[F.col(c).alias(f"_s_{c}") for c in (
        "review_status", "notes", "edited_by", "edit_reason", "is_manually_edited", "coords_json",
        "n_edit", "n_revert", "n_status")])
    df = features.join(s, "feature_id", "left")
    touched = F.coalesce(F.col("_s_n_edit") + F.col("_s_n_revert"), F.lit(0)) > 0
    shape = F.when(F.col("_s_is_manually_edited"), F.coalesce("_s_coords_json", "coords_json")).when(
        touched, F.coalesce("original_coords_json", "coords_json")).otherwise(F.col("coords_json"))
    status = F.when(F.coalesce("_s_n_status", F.lit(0)) > 0, F.col("_s_review_status")).otherwise(
        F.col("review_status"))
    out = df.withColumns({"coords_json": shape, "review_status": status})
    for c in ("notes", "edited_by", "edit_reason"):
        if c in features.columns:
            out = out.withColumn(c, F.coalesce(f"_s_{c}", c))
    return out.select(*features.columns)


def find_features(features: DataFrame, ids: DataFrame) -> DataFrame:
    """The features with the given ids (``feature_id``); the earliest layer in the fixed order wins."""
    wanted = ids.select("feature_id").distinct()
    return _first_in_layers(features.join(wanted, "feature_id", "left_semi"))


def find_feature(features: DataFrame, feature_id: str) -> DataFrame:
    """The feature with an id; the earliest layer in the fixed order wins."""
    return _first_in_layers(features.filter(F.col("feature_id") == feature_id))


def _first_in_layers(features: DataFrame) -> DataFrame:
    rank = F.array_position(F.array(*[F.lit(n) for n in V.LAYER_ORDER]), F.col("layer"))
    rest = [c for c in features.columns if c != "feature_id"]
    return features.groupBy("feature_id").agg(
        F.min_by(F.struct(*rest), F.struct(rank, F.col("ord"))).alias("r")).select("feature_id", "r.*")


def draft_features(drafts: DataFrame, existing: int, reviewer: str = "demo-reviewer") -> DataFrame:
    """Newly drawn shapes (``ord, geom_type, coords_json, notes``) as numbered draft features.

    Drafts come from one person's session, so numbering them is a small window.
    """
    number = (F.row_number().over(Window.orderBy("ord")) + existing).cast("string")
    fid = F.concat(F.lit("DRAFT-"), F.when(F.length(number) >= 3, number).otherwise(
        F.lpad(number, 3, "0")))
    notes = F.coalesce(F.nullif("notes", F.lit("")), F.lit(V.DEFAULT_DRAFT_NOTES))
    return drafts.select(
        "ord", fid.alias("feature_id"),
        F.when(F.col("geom_type") == "LineString", "draft_line").otherwise("draft_polygon").alias(
            "feature_type"),
        F.lit("manual_visual_reference").alias("source"),
        F.lit("unverified").alias("verification_status"),
        F.lit("under_review").alias("review_status"), notes.alias("notes"),
        F.lit(reviewer).alias("edited_by"), F.lit(V.DEFAULT_LOCALITY).alias("locality"),
        F.lit(V.DRAFT_PROVENANCE).alias("provenance_citation"), "geom_type", "coords_json",
        F.col("coords_json").alias("original_coords_json"), F.lit("drafts").alias("layer"))


def layer_counts(features: DataFrame, hide_empty: bool = False) -> DataFrame:
    """Manifest rows: every known layer with label, kind, flags and feature count."""
    spark = features.sparkSession
    specs = spark.createDataFrame(
        [(i, n, *V.LAYER_SPECS[n]) for i, n in enumerate(V.LAYER_ORDER)],
        "position int, layer string, label string, kind string, visible_default boolean, "
        "read_only boolean")
    counts = features.groupBy("layer").agg(F.count(F.lit(1)).alias("feature_count"))
    out = specs.join(counts, "layer", "left").withColumn(
        "feature_count", F.coalesce("feature_count", F.lit(0).cast("bigint")))
    return out.filter(F.col("feature_count") > 0) if hide_empty else out


def project_manifest(features: DataFrame) -> DataFrame:
    """Manifest of an imported project: raster first, no building row without reference buildings."""
    rows = layer_counts(features).filter(
        (F.col("layer") != "buildings") | (F.col("feature_count") > 0))
    raster = features.sparkSession.createDataFrame(
        [(-1, "orthomosaic", "Orthomosaic", "reference", True, True, 1)],
        "position int, layer string, label string, kind string, visible_default boolean, "
        "read_only boolean, feature_count bigint")
    return raster.unionByName(rows.select(*raster.columns))


def set_predictions(features: DataFrame, predictions: DataFrame, provider_id: str) -> DataFrame:
    """Replace the active predictions, and the provider's own layer when it has one."""
    targets = ["ai_predictions"] + [
        V.PROVIDER_LAYERS[provider_id]] * (provider_id in V.PROVIDER_LAYERS)
    out = features.filter(~F.col("layer").isin(*targets))
    for layer in targets:
        out = out.unionByName(
            predictions.withColumn("layer", F.lit(layer)), allowMissingColumns=True)
    return out


def append_predictions(features: DataFrame, predictions: DataFrame) -> DataFrame:
    """Add predictions to the active layer; a missing original shape becomes the current one."""
    rows = predictions.withColumn("layer", F.lit("ai_predictions"))
    if "original_coords_json" not in predictions.columns:
        rows = rows.withColumn("original_coords_json", F.col("coords_json"))
    return features.unionByName(rows, allowMissingColumns=True)


def clear_predictions(features: DataFrame) -> DataFrame:
    return features.filter(F.col("layer") != "ai_predictions")


def prediction_status(features: DataFrame, metadata: dict | None) -> DataFrame:
    """One row: which prediction source is active and how many features it has."""
    selected = bool(metadata)
    m = metadata or {}
    return features.agg(F.count_if(F.col("layer") == "ai_predictions").alias("n")).select(
        F.lit(selected).alias("selected"),
        F.lit(m.get("source_mode")).cast("string").alias("source_mode"),
        F.lit(m.get("run_id")).cast("string").alias("run_id"),
        (F.col("n") if selected else F.lit(0).cast("bigint")).alias("prediction_count"),
        F.lit(bool(m.get("is_mock", False))).alias("is_mock"))
