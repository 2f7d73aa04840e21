"""Published snapshots of the review state, and run records.

Tables are written under a commit's own folder first; a manifest that names them is written last and is
what makes the commit exist.  Readers see whole commits alone, the newest or one they ask for.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from groundcheck import fixed_values as V
from groundcheck.plans import review
from groundcheck.sources.raster_tables import exists

_MANIFEST = ("version long, commit_id string, saved_at timestamp, provider_id string, run_id string, source_mode string, "
             "is_mock boolean, has_predictions boolean")


def _safe(name: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9._-]+", name):
        raise ValueError(f"not a safe identifier: {name!r}")
    return name


def manifests(spark: SparkSession, folder: str) -> DataFrame:
    """One row per commit; a folder without commits gives none."""
    path = f"{folder}/manifests"
    return spark.read.schema(_MANIFEST).parquet(f"{path}/c=*") if exists(spark, path) else spark.createDataFrame([], _MANIFEST)


def publish_state(features: DataFrame, folder: str, commit_id: str, prediction: dict | None = None) -> int:
    """Save what reviewers changed, their drafts and the active predictions; returns the commit's version.

    ``prediction`` is the metadata of the active predictions (``source_mode``, ``provider_id``, ``run_id``, ``is_mock``).
    A commit that is tried again under its id adds nothing: its manifest is found, or its folder is written
    anew.  Commits of one folder are made one after another.
    """
    spark = features.sparkSession
    done = manifests(spark, folder)
    earlier = done.filter(F.col("commit_id") == _safe(commit_id)).first()
    if earlier is not None:
        return earlier["version"]
    version = (done.agg(F.max("version")).first()[0] or 0) + 1
    data = f"{folder}/data/c={commit_id}"
    parts = {"changed": review.changed_features(features), "drafts": features.filter(F.col("layer") == "drafts"),
             "predictions": features.filter(F.col("layer") == "ai_predictions")}
    for name, part in parts.items():
        part.write.mode("overwrite").parquet(f"{data}/{name}")
    meta = prediction or {}
    row = spark.createDataFrame(
        [(version, commit_id, meta.get("provider_id"), meta.get("run_id"), meta.get("source_mode"), bool(meta.get("is_mock", False)),
          bool(meta.get("source_mode")))],
        "version long, commit_id string, provider_id string, run_id string, source_mode string, is_mock boolean, has_predictions boolean")
    row.select("version", "commit_id", F.current_timestamp().alias("saved_at"), "provider_id", "run_id", "source_mode", "is_mock",
               "has_predictions").coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifests/c={commit_id}")
    return version


def restore_state(features: DataFrame, folder: str, version: int | None = None) -> DataFrame:
    """Freshly loaded features with a saved state over them (the newest, or ``version``).

    Changed rows replace the loaded ones of the same id in reference layers; drafts are those saved.
    Predictions become active only if their source was saved with them (``source_mode``): otherwise the loaded ones
    stay.  A known provider's own layer gets a copy.  Without a commit the features come back as they are.
    """
    spark = features.sparkSession
    commits = manifests(spark, folder)
    one = commits.filter(F.col("version") == version) if version is not None else commits
    commit = one.orderBy(F.desc("version")).first()
    if commit is None:
        if version is not None:
            raise ValueError(f"there is no version {version}")
        return features
    data = f"{folder}/data/c={commit['commit_id']}"
    saved = {n: spark.read.parquet(f"{data}/{n}") for n in ("changed", "drafts", "predictions")}
    replaced = ["drafts"]
    added = [saved["drafts"]]
    if commit["has_predictions"]:
        replaced.append("ai_predictions")
        added.append(saved["predictions"])
        own = V.PROVIDER_LAYERS.get(commit["provider_id"])
        if own:
            replaced.append(own)
            added.append(saved["predictions"].withColumn("layer", F.lit(own)))
    reference = F.col("layer").isin(*V.REFERENCE_LAYERS)
    loaded = features.filter(~F.col("layer").isin(*replaced))
    values = [c for c in features.columns if c not in ("feature_id", "layer", "ord")]
    changed = saved["changed"].dropDuplicates(["feature_id"]).select(
        F.col("feature_id"), F.struct(*[F.col(c) for c in values]).alias("_saved"))
    kept = loaded.filter(reference).join(changed, "feature_id", "left").select(
        *[F.when(F.col("_saved").isNotNull(), F.col("_saved")[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c)
          for c in features.columns])
    out = kept.unionByName(loaded.filter(~F.coalesce(reference, F.lit(False))))
    for part in added:
        out = out.unionByName(part.select(*features.columns))
    return out


def write_run_record(record: DataFrame, folder: str) -> None:
    """Store run records (``project_id, run_id`` and any fields), one partition a run, replacing only those given."""
    (record.repartition("project_id", "run_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("project_id", "run_id").parquet(folder))


def read_run_record(spark: SparkSession, folder: str, project_id: str, run_id: str) -> DataFrame:
    """The record of one run; only its partition is read.  A run that is not there is an error."""
    path = f"{folder}/project_id={_safe(project_id)}/run_id={_safe(run_id)}"
    if not exists(spark, path):
        raise ValueError(f"unknown run {run_id!r} of project {project_id!r}")
    return spark.read.parquet(path).select(F.lit(project_id).alias("project_id"), F.lit(run_id).alias("run_id"), "*")
