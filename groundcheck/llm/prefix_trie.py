"""The prefix tree of review histories: shared beginnings, and subtree totals by parallel tree contraction."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from groundcheck.lineage import cut_lineage, discard
from groundcheck.llm.common import ranked

#: Name of the textless root among nodes.
ROOT = "root"
#: Ids that one piece of a node's list of members may hold.
PIECE = 1 << 16


def number_turns(events: DataFrame, thread: str = "feature_id", order: str = "event_id", role: str = "reviewer",
                 text: str = "notes") -> DataFrame:
    """``thread, at, role, text``: the turns of every thread in order, numbered from 1.

    A thread is the review history of a feature.  Nulls of ``order`` come first, ties go by role and text;
    a null role or text becomes empty.  Rows without a thread take no part.  Turns are numbered by their
    place in a table dealt by range, so a thread of any length lies in many tasks.
    """
    empty = F.lit("")
    turns = events.select(F.col(thread).alias("thread"), F.col(order).alias("order"),
                          F.coalesce(F.col(role).cast("string"), empty).alias("role"),
                          F.coalesce(F.col(text).cast("string"), empty).alias("text")).filter("thread is not null")
    placed, _ = ranked(turns, [], ["thread", "order", "role", "text"], "place")
    first = placed.groupBy("thread").agg(F.min("place").alias("first"))
    return placed.join(first, "thread").select("thread", (F.col("place") - F.col("first") + 1).alias("at"), "role", "text")


def _prefixes(turns: DataFrame) -> DataFrame:
    """``thread, depth, node, parent, chars``: the node that every turn of a thread leads to.

    A node is named by sums over its turns' hashes (each with its number), 128 bits in all, so prefixes of a
    long thread are summed in parts: inside the files of a table dealt by range, then over the files.
    """
    a, b = F.xxhash64("at", "role", "text"), F.xxhash64(F.lit(11), "text", "role", "at")
    low = F.lit(0xFFFFFFFF)
    halves = [F.shiftrightunsigned(a, 32), a.bitwiseAND(low), F.shiftrightunsigned(b, 32), b.bitwiseAND(low)]
    names = [f"s{i}" for i in range(4)]
    hashed = cut_lineage(turns.select("thread", "at", F.char_length("text").cast("long").alias("chars"),
                                      *(h.alias(n) for h, n in zip(halves, names))))
    dealt = cut_lineage(hashed.repartitionByRange("thread", "at").sortWithinPartitions("thread", "at"))
    discard(hashed)
    rows = dealt.withColumn("file", F.col("_metadata.file_name"))
    # a thread that lies in several files brings the sums of the earlier ones along
    parts = rows.groupBy("thread", "file").agg(F.min("at").alias("start"), *(F.sum(n).alias(n) for n in names))
    several = parts.groupBy("thread").agg(F.count("*").alias("files")).filter("files > 1").select("thread")
    earlier = Window.partitionBy("thread").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.join(several, "thread").select(
        "thread", "file", *(F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"c{n}") for n in names))
    inside = Window.partitionBy("file", "thread").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.select("thread", "at", "chars", "file", *names, *(F.sum(n).over(inside).alias(f"p{n}") for n in names))
    whole = summed.join(carried, ["thread", "file"], "left").select(
        "thread", "at", "chars", *names, *((F.col(f"p{n}") + F.coalesce(f"c{n}", F.lit(0))).alias(f"p{n}") for n in names))

    def name(depth: Column, sums: list[Column]) -> Column:
        return F.when(depth == 0, ROOT).otherwise(F.md5(F.concat_ws(",", depth, *sums)))

    own = [F.col(f"p{n}") for n in names]
    before = [F.col(f"p{n}") - F.col(n) for n in names]
    return cut_lineage(whole.select("thread", F.col("at").alias("depth"), name(F.col("at"), own).alias("node"),
                                    name(F.col("at") - 1, before).alias("parent"), "chars"))


def _ends(ends: DataFrame) -> DataFrame:
    """``node, sha``: SHA-256 of the comma-joined thread ids (ascending) that end at a node.

    Ids are sorted over many tasks and joined in pieces there; the hash of a node then runs over its
    pieces in order, holding one at a time.
    """
    def join(batches):
        for batch in batches:
            nodes = batch.column(0).to_pylist()
            ids = batch.column(1).to_pylist()
            at = 0
            out: tuple[list, list, list] = ([], [], [])
            while at < len(nodes):
                to = at + 1
                while to < len(nodes) and nodes[to] == nodes[at] and to - at < PIECE:
                    to += 1
                out[0].append(nodes[at])
                out[1].append(ids[at])
                out[2].append(",".join(map(str, ids[at:to])))
                at = to
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], batch.column(1).type),
                                              pa.array(out[2], pa.string())], names=["node", "first", "ids"])

    def digest(batches):
        now, sha = None, None
        for batch in batches:
            names, shas = [], []
            for node, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if node == now:
                    sha.update(b",")
                else:
                    if sha is not None:
                        names.append(now)
                        shas.append(sha.hexdigest())
                    now, sha = node, hashlib.sha256()
                sha.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(shas, pa.string())], names=["node", "sha"])
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([sha.hexdigest()])], names=["node", "sha"])

    kind = ends.schema["thread"].dataType.simpleString()
    stored = cut_lineage(ends)
    pieces = cut_lineage(stored.repartitionByRange("node", "thread").sortWithinPartitions("node", "thread")
                         .mapInArrow(join, f"node string, first {kind}, ids string"))
    discard(stored)
    return pieces.repartition("node").sortWithinPartitions("node", "first").mapInArrow(digest, "node string, sha string")


def subtree_totals(nodes: DataFrame, values: dict[str, str], node: str = "node", parent: str = "parent",
                   depth: str = "depth") -> DataFrame:
    """Sums of columns over the subtree of every node, the node included, by parallel tree contraction.

    ``values`` maps a new name to the long column that it sums.  Every round *rakes* all leaves (they are
    summed per parent before the shuffle, so a parent of millions of leaves is no hot spot) and then
    *compresses* chains: of the nodes with one child, those with a bit set whose parent has it not set are
    taken out, and their sum stays on the edge of their child.  The first rounds look at the bits of the depth,
    which halves a chain every round, later ones at hashed bits; so a tree of any shape is gone after a
    number of rounds that grows with the logarithm of its nodes.  Nodes that were taken out are put back
    in reverse order, each one's sum from its child's.

    The parent of a root is null.  Returns ``node`` and the sums; a forest is allowed, an empty table gives no rows.
    """
    names = list(values)
    accs, edges = [f"acc_{n}" for n in names], [f"edge_{n}" for n in names]
    active = cut_lineage(nodes.select(
        F.col(node).alias("id"), F.col(parent).alias("up"), F.col(depth).cast("long").alias("depth"),
        *(F.col(values[n]).cast("long").alias(a) for n, a in zip(names, accs)), *(F.lit(0).cast("long").alias(e) for e in edges)))
    raked: list[DataFrame] = []
    spliced: list[DataFrame] = []
    for turn in range(10_000):
        kids = active.filter("up is not null").groupBy(F.col("up").alias("id")).agg(F.count("*").alias("kids"))
        counted = cut_lineage(active.join(kids, "id", "left").withColumn("kids", F.coalesce("kids", F.lit(0))))
        discard(active)
        leaves = counted.filter("kids = 0")
        raked.append(leaves.select("id", *(F.col(a).alias(n) for n, a in zip(names, accs))))
        gifts = leaves.filter("up is not null").groupBy(F.col("up").alias("id")).agg(
            F.count("*").alias("gone"), *(F.sum(F.col(a) + F.col(e)).alias(f"gift_{a}") for a, e in zip(accs, edges)))
        bit = F.shiftright("depth", turn) % 2 if turn < 16 else F.xxhash64("id", F.lit(turn)) % 2
        left = cut_lineage(counted.filter("kids > 0").join(gifts, "id", "left").select(
            "id", "up", "depth", *((F.col(a) + F.coalesce(f"gift_{a}", F.lit(0))).alias(a) for a in accs), *edges,
            ((F.col("kids") - F.coalesce("gone", F.lit(0)) == 1) & F.col("up").isNotNull()).alias("chain"),
            (bit != 0).alias("bit")))
        size = left.agg(F.count("*").alias("n"), F.count_if("chain").alias("chain")).first()
        if not size["n"]:
            break
        if not size["chain"]:
            active = left.drop("chain", "bit")
            continue
        above = left.select(F.col("id").alias("up"), (F.col("chain") & F.col("bit")).alias("held"))
        out = cut_lineage(left.filter("chain and bit").join(above, "up").filter("not held").select(
            F.col("id").alias("up"), F.col("up").alias("over"),
            *((F.col(a) + F.col(e)).alias(f"pass_{e}") for a, e in zip(accs, edges)),
            *(F.col(a).alias(f"own_{a}") for a in accs)))
        joined = cut_lineage(left.join(out, "up", "left").join(
            out.select(F.col("up").alias("id"), F.lit(True).alias("taken")), "id", "left"))
        discard(left)
        # a node that goes knows its sum but for its child's
        spliced.append(cut_lineage(joined.filter("over is not null").select(
            F.col("up").alias("id"), F.col("id").alias("child"),
            *((F.col(f"own_{a}") + F.col(e)).alias(n) for n, a, e in zip(names, accs, edges)))))
        active = cut_lineage(joined.filter("taken is null").select(
            "id", F.coalesce("over", "up").alias("up"), "depth", *accs,
            *((F.col(e) + F.coalesce(f"pass_{e}", F.lit(0))).alias(e) for e in edges)))
        discard(joined, out)
    totals = raked[0]
    for more in raked[1:]:
        totals = totals.unionByName(more)
    totals = cut_lineage(totals)
    parts = [totals]
    for gone in reversed(spliced):
        known = parts[0]
        for more in parts[1:]:
            known = known.unionByName(more)
        known = known.select(F.col("id").alias("child"), *(F.col(n).alias(f"of_{n}") for n in names))
        parts.append(cut_lineage(gone.join(known, "child").select(
            "id", *((F.col(n) + F.col(f"of_{n}")).alias(n) for n in names))))
    totals = parts[0]
    for more in parts[1:]:
        totals = totals.unionByName(more)
    return totals.withColumnRenamed("id", node)


def prefix_trie(turns: DataFrame, threads: DataFrame) -> DataFrame:
    """The prefix tree of threads, a node per distinct sequence of first turns.

    ``turns`` (``thread, at, role, text``) are numbered from 1 without gaps, as :func:`number_turns` gives them
    for review histories; ``threads`` (``thread``) lists all threads, also those without turns.  A node of depth
    ``d`` stands for one sequence of ``d`` turns (role and text); the root, of depth 0, for none.  Its members
    are the threads that begin with it.

    Returns per node ``first_thread`` (smallest member), ``depth``, ``parent_thread`` (the parent's smallest member; null
    for the root), ``n_threads``, ``n_children``, ``n_leaves`` (childless nodes of the subtree), ``saved_chars`` (over the
    subtree, members but one times the characters of a node's last text: what storing shared turns once saves) and
    ``ends_sha256`` (SHA-256 of the ascending ids, comma-joined, of the threads that end at the node).

    A null role or text counts as empty.  Repeated threads are one; threads without an id take no part;
    without threads there are no nodes.  Turns must belong to listed threads.  Further columns are not read.
    """
    known = cut_lineage(threads.select("thread").filter("thread is not null").distinct())
    rows = turns.select("thread", F.col("at").cast("long").alias("at"), F.coalesce("role", F.lit("")).alias("role"),
                        F.coalesce("text", F.lit("")).alias("text")).filter("thread is not null")
    places = _prefixes(rows)
    root = known.agg(F.min("thread").alias("first_thread"), F.count("*").alias("n_threads")).filter("n_threads > 0").select(
        F.lit(ROOT).alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("depth"),
        "first_thread", "n_threads", F.lit(0).cast("long").alias("chars"))
    nodes = places.groupBy("node").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("thread").alias("first_thread"),
        F.count("*").alias("n_threads"), F.max("chars").alias("chars")).unionByName(root)
    nodes = cut_lineage(nodes)
    kids = nodes.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    tree = cut_lineage(nodes.join(kids, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))).withColumn(
        "leaf", (F.col("n_children") == 0).cast("long")).withColumn("saved", (F.col("n_threads") - 1) * F.col("chars")))
    totals = subtree_totals(tree, {"n_leaves": "leaf", "saved_chars": "saved"})
    length = places.groupBy("thread").agg(F.max(F.struct("depth", "node")).alias("end"))
    ends = known.join(length, "thread", "left").select(F.coalesce("end.node", F.lit(ROOT)).alias("node"), "thread")
    above = tree.select(F.col("node").alias("parent"), F.col("first_thread").alias("parent_thread"))
    nothing = hashlib.sha256().hexdigest()
    return tree.join(above, "parent", "left").join(totals, "node").join(_ends(ends), "node", "left").select(
        "first_thread", "depth", "parent_thread", "n_threads", "n_children", "n_leaves", "saved_chars",
        F.coalesce("sha", F.lit(nothing)).alias("ends_sha256"))
