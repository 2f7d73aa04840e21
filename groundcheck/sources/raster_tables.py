"""Rasters as Parquet tables: pixels, probabilities and masks in square blocks, read by area of interest.

A table is partitioned by raster and shelf (``raster_id, shelf_r, shelf_c``), one file per shelf, so a window reads only
the folders it touches.  A shelf is a block, or as many small blocks as make a square of about ``BLOCK`` cells a side, so
the number of files follows the cells, not the block size.  A rerun replaces only the blocks it writes.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from groundcheck import fixed_values as V
from groundcheck.lineage import cut_lineage

#: Rows and columns of a block.
BLOCK = 1024
KEYS = ("raster_id", "shelf_r", "shelf_c")
#: Cells of a task where cells are joined.
TASK_CELLS = 1 << 20
#: Shelves whose keys may be broadcast to prune the table; more are joined without a broadcast.
BROADCAST_SHELVES = 200_000

VEGETATION = "feature_id string, area_sqm double, mean_excess_green double, pixels long, feature_type string"


def write_raster(cells: DataFrame, path: str, raster_id: str | None = None, block: int = BLOCK) -> None:
    """Store cells (``prow, pcol`` and any values) in blocks of ``block`` x ``block``.

    ``raster_id`` names the raster; without it ``cells`` must have that column.  Only the blocks that
    ``cells`` touch are replaced, so a job that is run again leaves the same table; other blocks on their
    shelves are written again as they were.  A shelf is one task's work, at most ``BLOCK`` or ``block``
    squared cells, whatever the raster's size.  Jobs that write one table at the same time must keep to
    different shelves.
    """
    if raster_id is not None:
        cells = cells.withColumn("raster_id", F.lit(raster_id))
    clash = {"block_r", "block_c", *KEYS[1:]} & set(cells.columns)
    if clash:
        raise ValueError(f"cells may not have the columns {sorted(clash)}")
    spark = cells.sparkSession
    cells = cells.withColumn("raster_id", F.col("raster_id").cast("string"))
    placed = _placed(cells, block)
    kept = _untouched(spark, path, placed, block) if exists(spark, path) else None
    if kept is not None:
        placed = placed.unionByName(kept, allowMissingColumns=True)
    (placed.repartition(*KEYS).sortWithinPartitions(*KEYS, *_BLOCK_OF, "prow", "pcol").drop(*_BLOCK_OF).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(*KEYS).parquet(path))


_BLOCK_OF = ("block_r", "block_c")


def _shelf(block: int) -> int:
    """Rows and columns of a shelf of blocks."""
    return block * max(1, BLOCK // block)


def _placed(cells: DataFrame, block: int) -> DataFrame:
    """Cells with the numbers of their block and shelf."""
    return cells.withColumns({
        f"{name}_{axis}": (F.floor(F.col(at) / side)).cast("int")
        for name, side in (("block", block), ("shelf", _shelf(block))) for axis, at in (("r", "prow"), ("c", "pcol"))})


def _untouched(spark: SparkSession, path: str, placed: DataFrame, block: int) -> DataFrame | None:
    """Stored cells on the shelves of new cells, but in other blocks; stored apart, as their shelves are written over."""
    if not spark.read.schema(placed.drop(*_BLOCK_OF).schema).parquet(path).inputFiles():
        return None
    keys = [*KEYS, *_BLOCK_OF]
    touched = placed.select(*[F.col(c).alias(f"t_{c}") for c in keys]).distinct()
    kept = _placed(_table(spark, path).drop(*KEYS[1:]), block)

    def same(columns: list[str]):
        return reduce(and_, [F.col(c).eqNullSafe(F.col(f"t_{c}")) for c in columns])

    return cut_lineage(kept.join(touched, same(list(KEYS)), "left_semi").join(touched, same(keys), "left_anti"))


def write_probability(probability: DataFrame, path: str, raster_id: str, block: int = BLOCK) -> None:
    """Store ``prow, pcol, p`` as 32-bit floats; cells that are left out mean 0."""
    bad = F.col("p").isNull() | F.isnan("p") | (F.col("p") < 0) | (F.col("p") > 1)
    p = F.when(bad, F.raise_error(F.lit("a probability is not between 0 and 1")).cast("double")).otherwise(F.col("p"))
    write_raster(probability.select("prow", "pcol", p.cast("float").alias("p")), path, raster_id, block)


def write_mask(mask: DataFrame, path: str, raster_id: str, block: int = BLOCK) -> None:
    """Store ``prow, pcol, v`` as bytes of 0 and 1; only cells of 1 are kept, the others mean 0."""
    write_raster(mask.filter("v <> 0").select("prow", "pcol", F.lit(1).cast("tinyint").alias("v")), path, raster_id, block)


def read_raster(spark: SparkSession, path: str, windows: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """The cells of a table, or those inside any of the ``windows``.

    ``windows`` has ``row0, row1, col0, col1`` (ends excluded, as ``tiles.window_of_area`` gives them) and
    may have ``raster_id``; without it a window is looked up in every raster.  The shelves that windows
    touch are joined to the table on its partition columns, so other folders are never opened
    (dynamic partition pruning); a cell in several windows comes back once.
    """
    table = _table(spark, path)
    if windows is None:
        return table.drop(*KEYS[1:])
    named = ["raster_id"] if "raster_id" in windows.columns else []
    ends = ("row0", "row1", "col0", "col1")
    wanted = windows.select(*[F.col(c).cast("string").alias(f"w_{c}") for c in named], *ends).filter(
        "row1 > row0 and col1 > col0 and row1 > 0 and col1 > 0")

    side = _shelf(block)

    def shelves(low: str, high: str):
        return F.explode(F.sequence(F.floor(F.greatest(F.col(low), F.lit(0)) / side).cast("int"),
                                    F.floor((F.col(high) - 1) / side).cast("int")))

    keys = wanted.withColumn("w_r", shelves("row0", "row1")).withColumn("w_c", shelves("col0", "col1"))
    if keys.limit(BROADCAST_SHELVES + 1).count() <= BROADCAST_SHELVES:
        keys = F.broadcast(keys)  # its size was just checked
    on = (F.col("shelf_r") == F.col("w_r")) & (F.col("shelf_c") == F.col("w_c"))
    for c in named:
        on = on & (F.col(c) == F.col(f"w_{c}"))
    inside = (F.col("prow") >= F.col("row0")) & (F.col("prow") < F.col("row1")) & (
        F.col("pcol") >= F.col("col0")) & (F.col("pcol") < F.col("col1"))
    return table.join(keys, on & inside, "left_semi").drop(*KEYS[1:])


def _table(spark: SparkSession, path: str) -> DataFrame:
    stored = spark.read.parquet(path).schema
    # an id of digits stays text
    fields = [StructField(f.name, StringType()) if f.name == "raster_id" else f for f in stored.fields]
    return spark.read.schema(StructType(fields)).parquet(path)


def with_cells(cells: DataFrame, *tables: DataFrame) -> DataFrame:
    """Left-join tables of cells to ``cells`` by ``prow, pcol``.

    Cells pack so well in files that sizes there say little about memory: tables are never broadcast, and tasks are
    as many as the cells ask for, so a task's memory does not grow with the raster.
    """
    at = ("prow", "pcol")
    parts = max(cells.sparkSession.sparkContext.defaultParallelism, cells.count() // TASK_CELLS + 1)
    out = cells.repartition(parts, *at)
    for table in tables:
        out = out.join(table.repartition(parts, *at).hint("merge"), list(at), "left")
    return out


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder of any file system that Spark knows is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)


def save_vegetation(candidates: DataFrame, path: str) -> None:
    """Store the vegetation candidates of the last run in place of earlier ones."""
    candidates.select(*[f.name for f in StructType.fromDDL(VEGETATION).fields]).write.mode("overwrite").parquet(path)


def saved_vegetation(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The saved candidates and one row ``name, status, candidate_count``; typed and empty before the first run."""
    done = exists(spark, path)
    table = spark.read.schema(VEGETATION).parquet(path) if done else spark.createDataFrame([], VEGETATION)
    status = F.lit(V.VEGETATION_DONE if done else V.VEGETATION_NOT_RUN)
    return table, table.agg(F.lit(V.VEGETATION_NAME).alias("name"), status.alias("status"), F.count("*").alias("candidate_count"))
