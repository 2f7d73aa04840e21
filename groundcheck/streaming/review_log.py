"""The review-event log as a stream: late and repeated events, current state, revalidation.

One job does it all.  Per batch it splits off late rows, drops repeats, and folds the rest into a state
that is kept in buckets of features, so a batch rewrites only the buckets its events fall into.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from groundcheck.plans import review

#: Buckets of the state; a feature stays in one for ever, so this may not change while a folder is in use.
BUCKETS = 64
_RECORD = "version long, newest timestamp, buckets map<int,long>, recent map<long,timestamp>"


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("feature_id"), F.lit(buckets)).cast("int")


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), path


def _record(spark: SparkSession, folder: str, before: int | None = None):
    """The latest complete record (before a batch), one row; null when there is none."""
    system, path = _files(spark, f"{folder}/versions")
    if not system.exists(path):
        return None
    done = [int(s.getPath().getName()[2:]) for s in system.listStatus(path)
            if system.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    done = [v for v in done if before is None or v < before]
    return spark.read.schema(_RECORD).parquet(f"{folder}/versions/b={max(done)}").first() if done else None


def _forget(spark: SparkSession, folder: str, batch_id: int, keep: int = 8) -> None:
    """Drop records that no rerun can ask for any more; each holds all that the next one needs."""
    system, path = _files(spark, f"{folder}/versions")
    for s in system.listStatus(path):
        if int(s.getPath().getName()[2:]) < batch_id - keep:
            system.delete(s.getPath(), True)


def _partials(spark: SparkSession, folder: str, places: dict[int, int]) -> DataFrame | None:
    """Partial states of the buckets, each in the version that wrote it last (at most one path a bucket)."""
    paths = [f"{folder}/state/v={v}/bucket={b}" for b, v in sorted(places.items())]
    return spark.read.parquet(*paths) if paths else None


def read_state(spark: SparkSession, folder: str) -> DataFrame | None:
    """Current review state kept by :func:`run_fold` (null before the first batch)."""
    record = _record(spark, folder)
    partial = None if record is None else _partials(spark, folder, record["buckets"])
    return None if partial is None else review.present_state(partial)


def read_late(spark: SparkSession, folder: str) -> DataFrame | None:
    """The rows that :func:`run_fold` set aside as too late, with the batch ``b`` that brought them."""
    system, path = _files(spark, f"{folder}/late")
    return spark.read.parquet(f"{folder}/late") if system.exists(path) else None


def run_fold(
    events: DataFrame, folder: str, checkpoint: str, delay: str = "7 days",
    after: Callable[[DataFrame, DataFrame, int], None] | None = None, buckets: int = BUCKETS, **trigger,
) -> StreamingQuery:
    """Fold a stream of review events into a bucketed, versioned state under ``folder``.

    In every batch, in this order:

    * an event older than the newest one of all earlier batches by more than ``delay`` is late and goes, as it
      is, to ``folder/late``; what is late is decided here and nowhere else, so kept, repeated and late rows
      together are all rows;
    * of the others, an ``event_id`` seen in this batch or in an earlier one within ``delay`` is a repeat and dropped
      (so is a row without an id); ids are read from the batches that ``delay`` reaches back to;
    * the rest is combined per feature and merged into the buckets it falls into.  The state keeps the
      latest ``(ts, event_id)``, so events may arrive in any order.

    Each batch writes late rows, ids and buckets under its own id and its record last.  A record names the version of
    every bucket; a batch that is run again starts from the record before it and rewrites its own
    parts, so nothing is applied twice.  ``after(state, changed_ids, batch_id)`` runs once the record is written.
    Replaced bucket versions are left to a retention rule on the folder.
    """
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        record = _record(spark, folder, before=batch_id)
        newest = None if record is None else record["newest"]
        places = {} if record is None else dict(record["buckets"])
        recent = {} if record is None else dict(record["recent"])
        limit = F.lit(newest).cast("timestamp") - F.expr(f"interval {delay}")
        batch = batch.persist()
        try:
            late = F.coalesce(F.col("ts") < limit, F.lit(False))
            batch.filter(late).write.mode("overwrite").parquet(f"{folder}/late/b={batch_id}")
            timely = batch.filter(~late)
            known = timely.filter("event_id is not null").dropDuplicates(["event_id"])
            if recent:
                seen = spark.read.parquet(*[f"{folder}/ids/b={b}" for b in sorted(recent)])
                known = known.join(seen, "event_id", "left_anti").select(*timely.columns)
            known = known.persist()
            known.select("event_id").write.mode("overwrite").parquet(f"{folder}/ids/b={batch_id}")
            # one row; at most one entry a bucket
            found = known.agg(F.collect_set(_bucket(buckets)).alias("touched"), F.max("ts").alias("newest")).first()
            new = review.partial_state(known).withColumn("bucket", _bucket(buckets))
            old = [b for b in found["touched"] if b in places]
            if old:
                before = _partials(spark, folder, {b: places[b] for b in old})
                new = review.merge_state(before, new.drop("bucket")).withColumn("bucket", _bucket(buckets))
            if found["touched"]:
                new.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/state/v={batch_id}")
            places.update({b: batch_id for b in found["touched"]})
            newest = max((t for t in (newest, found["newest"]) if t is not None), default=None)
            if found["newest"] is not None:
                recent[batch_id] = found["newest"]
            row = spark.createDataFrame([(batch_id, newest, places, recent)], _RECORD)
            # ids of batches whose newest event would be late now can't be asked for any more
            edge = F.col("newest") - F.expr(f"interval {delay}")
            row.withColumn("recent", F.map_filter("recent", lambda b, t: t >= edge)).coalesce(1).write.mode(
                "overwrite").parquet(f"{folder}/versions/b={batch_id}")
            _forget(spark, folder, batch_id)
            if after is not None:
                state = _partials(spark, folder, places)
                if state is not None:
                    after(review.present_state(state), known.select("feature_id").distinct(), batch_id)
            known.unpersist()
        finally:
            batch.unpersist()

    writer = events.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def late_events(events: DataFrame, delay_days: float = 7) -> DataFrame:
    """Events older than the newest one by more than the delay: the side table for late data."""
    newest = events.agg(F.max("ts").alias("newest"))
    limit = F.expr(f"newest - make_dt_interval(0, 0, 0, {delay_days * 86400})")
    return events.join(F.broadcast(newest)).filter(F.col("ts") < limit).drop("newest")
