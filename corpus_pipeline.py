"""The corpus pipeline: stages over ``documents``, each written and read again as the next one's input."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from groundcheck.lineage import checkpoint_folder
from groundcheck.llm import ngram_join, passages, queries, toxicity
from groundcheck.llm.common import limit_batches


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine, learned from ``labels``, does not call toxic."""
    limit_batches(spark)  # the caller writes what a stage returns, so this holds for the session
    model = queries.toxicity_model(spark, docs, sf_dir, held_out=False)
    notes = docs.select(F.col("doc_id").alias("event_id"), F.col("text").alias("notes"), "lang", "source", "n_chars")
    scored = toxicity.score_notes(notes, model, keep=("notes", "lang", "source", "n_chars"))
    return scored.filter("predicted = 0").select(
        F.col("event_id").alias("doc_id"), F.col("notes").alias("text"), "lang", "source", "n_chars")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the smallest id, of every group of near copies."""
    limit_batches(spark)
    groups = ngram_join.link_notes(queries.notes(docs), width=5, percent=80)
    kept = groups.filter("component is null or event_id = component").select(F.col("event_id").alias("kept")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("kept")), "left_semi").dropDuplicates(["doc_id", "text"])


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the passages that an earlier one has."""
    limit_batches(spark)
    cut = passages.drop_repeated_passages(docs, key="doc_id", text="text")
    return cut.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample, with repeats, whose tokens have the target shares by source, language and topic."""
    held = queries.mixed(docs.withColumn("doc", F.struct(*docs.columns)), keep=("doc",)).filter("kept")
    return held.select("doc", F.explode(F.sequence(F.lit(1), "copies"))).select("doc.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document that is left, cut and packed into sequences.

    Mixing repeats documents, so every row gets a number, ``copy``, that its pieces carry.
    """
    return queries.packed(docs.withColumn("copy", F.monotonically_increasing_id()), keep=("copy",))


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_copies),
    ("substring dedup", cut_passages),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack),
]

#: Learned models, seeded hashes and packing are no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_folder(spark).rstrip('/')}/pipeline/{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
