"""Helpers that several operators share."""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from groundcheck.lineage import cut_lineage, discard

#: ASCII white space: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]+"
#: Edges that a task of :func:`components` contracts at once; bounds its memory, not the graph.
CHUNK_EDGES = 1 << 18


def ranked(df: DataFrame, groups: list[str], order: list[str], rank: str = "rank") -> tuple[DataFrame, dict]:
    """Number the rows of every group from 0, without a window over the group.

    The rows are range-partitioned by group and order and written; a row's number is its place in its
    file plus the rows that earlier files hold of the group.  A group of any size is so dealt over many
    tasks.  The driver sees one count per file and group, so the groups must be bounded.

    Returns the numbered rows and the count of each group (keyed by the tuple of its values).
    """
    spark = df.sparkSession
    if not df.columns or "_file" in df.columns:
        raise ValueError("a column may not be called _file")
    once = cut_lineage(df)  # dealing by range reads its input twice
    table = cut_lineage(once.repartitionByRange(*groups, *order).sortWithinPartitions(*groups, *order))
    discard(once)
    placed = table.select("*", F.col("_metadata.file_name").alias("_file"),
                          F.col("_metadata.row_index").alias("_row"))
    parts = (placed.groupBy(*groups, "_file").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
             .collect())
    totals: dict = {}
    shifts = []
    for p in sorted(parts, key=lambda p: p["_file"]):
        group = tuple(p[g] for g in groups)
        before = totals.get(group, 0)
        shifts.append((*group, p["_file"], before - p["_first"]))
        totals[group] = before + p["_n"]
    schema = ", ".join([*(f"`_g{i}` {table.schema[g].dataType.simpleString()}" for i, g in enumerate(groups)),
                        "`_in` string", "`_shift` long"])
    small = spark.createDataFrame(shifts, schema)
    on = F.col("_file") == F.col("_in")
    for i, g in enumerate(groups):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    # one row per file and group
    out = placed.join(F.broadcast(small), on).select(
        *table.columns, (F.col("_row") + F.col("_shift")).alias(rank))
    return out, totals


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also where the body is evaluated per element."""
    return F.transform(F.array(value), body)[0]


def _contracted(edges: DataFrame) -> DataFrame:
    """``u, v``: the same reachability with fewer edges; every task joins up what it reads, ``CHUNK_EDGES`` at a time."""
    def forest(table: pa.Table) -> pa.RecordBatch:
        u, v = (table.column(c).combine_chunks() for c in ("u", "v"))
        coded = pa.concat_arrays([u, v]).dictionary_encode()
        order = pc.sort_indices(coded.dictionary)
        rank = np.empty(len(order), np.int64)
        rank[order.to_numpy()] = np.arange(len(order))
        x, y = np.split(rank[coded.indices.to_numpy()], 2)
        root = np.arange(len(order))
        while True:  # the larger root of every edge hangs itself on the smallest one that it meets
            x, y = root[x], root[y]
            apart = x != y
            if not apart.any():
                break
            x, y = x[apart], y[apart]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
        names = coded.dictionary.take(order)
        below = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([names.take(pa.array(below)), names.take(pa.array(root[below]))], names=["u", "v"])

    def run(batches):
        held, count = [], 0
        for batch in slices(batches, CHUNK_EDGES):
            if count + batch.num_rows > CHUNK_EDGES:
                yield forest(pa.Table.from_batches(held))
                held, count = [], 0
            held.append(batch)
            count += batch.num_rows
        if count:
            yield forest(pa.Table.from_batches(held))

    return edges.mapInArrow(run, edges.schema)


def components(links: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``node, component`` (smallest reachable node) for every node of the undirected links.

    Alternates star contractions: every node hands the smallest of its neighbourhood to its larger
    neighbours, then to its smaller ones.  Before each round every task contracts the edges that it reads,
    which needs no shuffle.  A hub's neighbours are only summed up (a minimum per node before the shuffle),
    never gathered; each round is a table, so a lost executor re-reads it.
    """
    edges = links.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).filter("u <> v")
    while True:
        edges = cut_lineage(_contracted(edges))
        none = F.lit(None).cast(edges.schema["v"].dataType)
        nodes = cut_lineage(edges.select(F.col("u").alias("node"), "v", F.lit(False).alias("above")).unionByName(
            edges.select(F.col("v").alias("node"), none.alias("v"), F.lit(True).alias("above"))).groupBy("node").agg(
            F.min("v").alias("low"), F.max("v").alias("high"), F.max("above").alias("above")))
        best = nodes.select("node", F.coalesce("low", "node").alias("component"))
        # every node hangs on exactly one smaller node that itself has no smaller one: done
        if not nodes.filter("low is not null and (low <> high or above)").limit(1).count():
            discard(edges)
            return best
        # larger neighbours get the smallest of the neighbourhood
        large = cut_lineage(edges.join(best, F.col("v") == F.col("node")).select("u", F.col("component").alias("v")))
        discard(edges, nodes)
        # smaller neighbours and the node itself get it too
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        edges = large.join(low, "u").select(
            F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                              F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")
        ).select("e.*").filter("u <> v")


#: Rows and bytes that go to Python at once under :func:`small_batches`.
BATCH_ROWS, BATCH_BYTES = 256, 4 << 20


def limit_batches(spark) -> dict[str, str]:
    """Set how much goes to Python at once in this session; a smaller number of rows stays.  Returns the settings before."""
    before = {k: spark.conf.get(f"spark.sql.execution.arrow.{k}") for k in ("maxRecordsPerBatch", "maxBytesPerBatch")}
    rows = int(before["maxRecordsPerBatch"])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS if rows <= 0 else min(rows, BATCH_ROWS)))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return before


@contextmanager
def small_batches(spark):
    """Rows with texts go to Python a few hundred at once: a batch is held by the JVM and by Python, in each task."""
    before = limit_batches(spark)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(f"spark.sql.execution.arrow.{k}", v)


def slices(batches, rows: int = 500):
    """The batches in slices of at most ``rows``, so that a task holds little at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_text(df: DataFrame, text: str, make, fields: str, rows: int = 500) -> DataFrame:
    """Replace the column ``text`` by ``fields``; all other columns pass through unchanged.

    ``make()`` runs once per task and returns a function from a list of texts (or None) to one list or
    array per field and, where rows multiply or vanish, the places of the texts they come from.  It is
    given at most ``rows`` texts at once.
    """
    kept = [c for c in df.columns if c != text]
    added = StructType.fromDDL(fields)
    schema = StructType([*(df.schema[c] for c in kept), *added.fields])

    def run(batches):
        work = make()
        for batch in slices(batches, rows):
            columns, places = work(batch.column(batch.schema.get_field_index(text)).to_pylist())
            held = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            if places is not None:
                at = pa.array(places, pa.int64())
                held = [h.take(at) for h in held]
            new = [c if isinstance(c, pa.Array) else pa.array(c, kinds[i]) for i, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays([*held, *new], names=[*kept, *added.names])

    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(f.dataType) for f in added.fields]
    return df.mapInArrow(run, schema)
