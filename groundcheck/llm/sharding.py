"""Sharding review notes on a consistent-hash ring with bounded loads."""

from __future__ import annotations

from collections import deque
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from groundcheck.llm.common import ranked


def ring_points(shards: int, virtual_nodes: int) -> list[tuple[int, int]]:
    """``(position, shard)`` of every virtual node, clockwise; a shard's points do not depend on the others."""
    points = []
    for shard in range(shards):
        for node in range(virtual_nodes):
            digest = blake2b(f"{shard}/{node}".encode(), digest_size=8).digest()
            points.append((int.from_bytes(digest, "big", signed=True), shard))
    return sorted(points)


def fill_ring(loads: dict[int, int], owners: list[int], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Deal the keys of every arc: ``(arc, first, end, shard, slot)`` by the keys' numbers within the arc.

    An arc's keys go to its shard while that has room; the rest walk on clockwise to the next shard with
    room.  ``room`` must hold all keys.
    """
    room, slots, out, waiting = list(room), [0] * len(room), [], deque()

    def put(arc: int, first: int, end: int, shard: int) -> int:
        n = min(end - first, room[shard])
        if n:
            out.append((arc, first, first + n, shard, slots[shard]))
            room[shard] -= n
            slots[shard] += n
        return first + n

    for arc, shard in enumerate(owners):  # own keys come before those that walk
        n = loads.get(arc, 0)
        at = put(arc, 0, n, shard)
        if at < n:
            waiting.append([arc, at, n])
    walkers = {arc: [arc, at, n] for arc, at, n in waiting}
    moving: deque = deque()
    for _ in range(2):
        for arc, shard in enumerate(owners):
            while moving and room[shard]:
                piece = moving[0]
                piece[1] = put(piece[0], piece[1], piece[2], shard)
                if piece[1] == piece[2]:
                    moving.popleft()
            if arc in walkers:
                moving.append(walkers.pop(arc))
    if moving or walkers:
        raise ValueError("the shards have less room than there are keys")
    return out


def shard_notes(events: DataFrame, key: str = "event_id", text: str = "notes", shards: int = 16,
                virtual_nodes: int = 64) -> DataFrame:
    """Put every review event into one of ``shards`` shards of equal row counts.

    Each shard owns ``virtual_nodes`` points of a hash ring.  An event starts at the hash of its note, so
    equal notes start together, and belongs to the next point clockwise.  No shard takes more than its
    even part (counts differ by one at most); what a full shard can't take walks on clockwise.  Only the
    overflow moves, and a shard's points stay where they are when shards are added.

    The counts per arc (``shards * virtual_nodes`` of them at most) are dealt on the driver; rows are
    numbered within their arc by :func:`ranked`, so an arc that holds a third of all rows is no hot task.

    Returns ``key, size (UTF-8 bytes of the note, 0 for none, plus 1), text_crc32, law ('rows'), shard,
    slot (gapless from 0 within the shard)``.

    Null or empty notes share one place each on the ring (their checksum is that of no bytes); rows that repeat a key are rows
    of their own; an empty table gives no rows.
    """
    if shards < 1 or virtual_nodes < 1:
        raise ValueError("shards and virtual_nodes must be positive")
    points = ring_points(shards, virtual_nodes)
    positions, owners = np.array([p for p, _ in points], np.int64), [s for _, s in points]

    @F.pandas_udf("int")
    def arc_of(place: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(positions, place.to_numpy()) % len(positions), dtype="int32")

    note = F.col(text).cast("string")
    rows = events.select(
        F.col(key).alias("k"), (F.coalesce(F.octet_length(note), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(note, F.lit(""))).alias("crc"), F.xxhash64(note).alias("place"))
    rows = rows.select("k", "size", "crc", arc_of("place").alias("arc"), F.xxhash64("k").alias("h"))
    rows, counts = ranked(rows, ["arc"], ["h", "k"])
    loads = {arc: n for (arc,), n in counts.items()}
    total = sum(loads.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    segments = rows.sparkSession.createDataFrame(
        fill_ring(loads, owners, room), "a int, first long, last long, shard int, slot long")
    # at most two segments per arc and shard
    return rows.join(F.broadcast(segments), (F.col("arc") == F.col("a")) & (F.col("rank") >= F.col("first"))
                     & (F.col("rank") < F.col("last"))).select(
        F.col("k").alias(key), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard",
        (F.col("slot") + F.col("rank") - F.col("first")).alias("slot"))
