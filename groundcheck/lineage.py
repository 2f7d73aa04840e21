"""Cutting long plans.

Iterative jobs (matching, components, nearest parcel) would otherwise carry every earlier round in
their plan.  Each round is written as a Parquet table in the shared checkpoint folder and read back,
so a lost executor re-reads the table instead of replaying the rounds.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_local_folder: str | None = None


def checkpoint_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a private one only in local mode."""
    global _local_folder
    folder = spark.conf.get(_KEY, None)
    if folder:
        return folder
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError(f"set {_KEY} to a folder every executor can reach")
    if _local_folder is None:
        _local_folder = tempfile.mkdtemp(prefix="groundcheck-")
    return _local_folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once and return it as a fresh scan."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark).rstrip('/')}/groundcheck/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that :func:`cut_lineage` returned, once everything made from them is itself stored."""
    for table in tables:
        spark = table.sparkSession
        for file in table.inputFiles()[:1]:
            folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            if "/groundcheck/" in folder.toString():
                folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def release(spark: SparkSession) -> None:
    """Have the shuffle files of finished jobs removed: Spark deletes them when the driver collects their plans as garbage."""
    spark._jvm.java.lang.System.gc()
