"""Image and mask files of a training set: pairing, checks, split, hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from groundcheck import fixed_values as V


def list_files(spark: SparkSession, root: str, pattern: str = "*.{tif,tiff}") -> DataFrame:
    """Paths and sizes under a folder, without reading contents."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option(
        "pathGlobFilter", pattern).load(root).select("path", "length")


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(
        "path", F.sha2("content", 256).alias("sha256"))


def city(stem: Column) -> Column:
    """City named at the start of a file stem, null when unknown."""
    names = "|".join(V.HOLDOUT_CITIES)
    return F.nullif(F.regexp_extract(F.lower(stem), f"^({names})[_-]?", 1), F.lit(""))


def _parts(files: DataFrame) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    folder = F.expr("substring(path, 1, length(path) - length(substring_index(path, '/', -1)) - 1)")
    return files.select(
        "path", name.alias("name"), folder.alias("folder"),
        F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"),
        F.regexp_extract(name, r"(\.[^.]*)$", 1).alias("suffix"))


def pair_files(files: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Images with the first mask that exists, and what is wrong with them in ``error``.

    ``files`` lists the scanned folder; everything outside a ``gt`` folder is an image.  A mask is
    looked for in ``../gt``, then ``../ground_truth``, then beside the image as ``<stem>_gt``, among
    ``existing`` (the scanned files when not given), which may reach beyond the scanned folder.
    """
    images = _parts(files).filter(
        ~F.exists(F.split(F.lower("folder"), "/"), lambda p: p == "gt")).withColumn(
        "key", F.lower("stem"))
    parent = F.regexp_replace("folder", "/[^/]*$", "")
    wanted = images.select("path", F.posexplode(F.array(
        F.concat(parent, F.lit("/gt/"), "name"),
        F.concat(parent, F.lit("/ground_truth/"), "name"),
        F.concat("folder", F.lit("/"), "stem", F.lit("_gt"), "suffix"))).alias("rank", "mask"))
    known = (files if existing is None else existing).select(F.col("path").alias("mask"))
    best = wanted.join(known, "mask").groupBy("path").agg(F.min_by("mask", "rank").alias("mask"))
    repeats = images.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    out = images.join(best, "path", "left").join(repeats, "key")
    return out.select(
        "path", "mask", "stem", city(F.col("stem")).alias("city"),
        F.when(city(F.col("stem")).isNull(), "city cannot be identified")
        .when(F.col("n") > 1, "duplicate image stem")
        .when(F.col("mask").isNull(), "missing building mask").alias("error"))


def check_pairs(pairs: DataFrame, width: int = 5000, height: int = 5000) -> DataFrame:
    """Errors of described pairs: bands, sizes, reference system, resolution, mask values.

    Input columns: ``bands, width, height, mask_width, mask_height, crs, res_x, res_y,
    mask_values ARRAY<INT>``.
    """
    return pairs.withColumn("errors", F.array_compact(F.array(
        F.when(F.col("bands") != 3, "expected 3 RGB bands"),
        F.when((F.col("width") != width) | (F.col("height") != height)
               | (F.col("mask_width") != width) | (F.col("mask_height") != height),
               "unexpected image size"),
        F.when(F.col("crs").isNull(), "image CRS is missing"),
        F.when((F.col("res_x") <= 0) | (F.col("res_y") <= 0), "image resolution is invalid"),
        F.when(F.size(F.array_except("mask_values", F.array(*[F.lit(v) for v in (0, 1, 255)]))) > 0,
               "unexpected mask values"))))


def mask_figures(mask_pixels: DataFrame, by: str = "path") -> DataFrame:
    """Distinct values (a byte mask has at most 256) and foreground count per mask."""
    return mask_pixels.groupBy(by).agg(
        F.array_sort(F.collect_set("v")).alias("mask_values"),
        F.count_if(F.col("v") > 0).alias("building_pixels"))


def split_by_city(records: DataFrame) -> DataFrame:
    """Hold the alphabetically last city out for validation."""
    last = records.agg(F.max("city").alias("_last"))
    return records.join(F.broadcast(last)).withColumn(
        "split", F.when(F.col("city") == F.col("_last"), "validation").otherwise("train")).drop("_last")


def manifest_summary(records: DataFrame) -> DataFrame:
    """One row: status and counts; waiting when there is no tile yet."""
    return records.agg(
        F.count(F.lit(1)).alias("tile_count"), F.count_if(F.col("split") == "train").alias("train_count"),
        F.count_if(F.col("split") == "validation").alias("validation_count"),
        F.max(F.when(F.col("split") == "validation", F.col("city"))).alias("validation_city"),
    ).withColumn("status", F.when(F.col("tile_count") == 0, "WAITING_FOR_USER_DOWNLOAD").otherwise(
        "READY_FOR_TRAINING"))


def fingerprint(coords: Column) -> Column:
    """Key of a geometry for comparing or deduplicating layers."""
    return F.sha2(coords, 256)
