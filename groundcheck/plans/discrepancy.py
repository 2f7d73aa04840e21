"""Detections against reference footprints: who matches, who is alone, and the rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from groundcheck.operators import matching as M

MIN_THRESHOLD, MAX_THRESHOLD = 0.05, 0.95


def discrepancy(
    predictions: DataFrame, references: DataFrame, threshold: float = 0.35, large: bool | None = None,
) -> dict[str, DataFrame]:
    """``matched, model_only, reference_only, metrics`` tables.

    Both layers are validated shape tables.  Shapes that are empty, unreadable or invalid take no part
    and are counted in ``metrics``.
    """
    if not MIN_THRESHOLD <= threshold <= MAX_THRESHOLD:
        raise ValueError(f"threshold must be between {MIN_THRESHOLD} and {MAX_THRESHOLD}")
    good_p, good_r = predictions.filter("valid"), references.filter("valid")
    matched = M.match_best_first(M.iou_candidates(good_p, good_r, threshold, large))
    model_only = M.unmatched(good_p, matched.select(F.col("a_id").alias("feature_id")))
    reference_only = M.unmatched(good_r, matched.select(F.col("b_id").alias("feature_id")))
    invalid = predictions.agg(F.count_if(~F.col("valid")).alias("invalid_prediction_count")).join(
        references.agg(F.count_if(~F.col("valid")).alias("invalid_reference_count")))
    metrics = M.match_metrics(matched, good_p, good_r, threshold).join(invalid)
    return {"matched": matched, "model_only": model_only, "reference_only": reference_only,
            "metrics": metrics}


def report_heads(tables: dict[str, DataFrame], rows: int = 20) -> dict[str, DataFrame]:
    """The leading rows a report shows: matches best first, the others in load order."""
    best = tables["matched"].orderBy(F.desc("iou"), "a_id", "b_id").limit(rows)
    return {
        "matched": best.select("a_id", "b_id", F.bround("iou", 4).alias("iou")),
        "model_only": tables["model_only"].orderBy("ord").select("feature_id").limit(rows),
        "reference_only": tables["reference_only"].orderBy("ord").select("feature_id").limit(rows)}


def object_benchmark(
    predictions: DataFrame, references: DataFrame, threshold: float = 0.5, large: bool | None = None,
) -> DataFrame:
    """Detection rates when predictions choose in list order."""
    pairs = M.match_in_order(M.iou_candidates(predictions, references, threshold, large))
    return M.match_metrics(pairs, predictions, references, threshold)
