"""Bitmaps of sets of hashes: a cheap, safe bound on how much two sets can share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from groundcheck.lineage import cut_lineage


def bitmap(hashes: np.ndarray) -> bytes:
    """One bit per hash, in a width that is a power of two, 64 at least and no less than the set's size."""
    width = 64
    while width < len(hashes):
        width *= 2
    bits = np.zeros(width, bool)
    bits[(hashes & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _folded(bits: np.ndarray, size: int) -> np.ndarray:
    """The bitmap that the same set has in a smaller width."""
    while len(bits) > size:
        half = len(bits) // 2
        bits = bits[:half] | bits[half:]
    return bits


def _parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a binary column without nulls, and where each value begins."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def least_differences(x: pa.Array, y: pa.Array) -> np.ndarray:
    """Per pair of bitmaps, how many elements at least are in one set only: every bit that differs has one."""
    out = np.zeros(len(x), np.int64)
    if not len(x):
        return out
    (a, at), (b, bt) = _parts(x), _parts(y)
    equal = np.diff(at) == np.diff(bt)
    for i in np.flatnonzero(~equal):
        p, q = a[at[i]:at[i + 1]], b[bt[i]:bt[i + 1]]
        size = min(len(p), len(q))
        out[i] = np.bitwise_count(_folded(p, size) ^ _folded(q, size)).sum()
    same = np.flatnonzero(equal)
    if len(same):
        if len(same) < len(x):
            (a, at), (b, _) = _parts(x.take(pa.array(same))), _parts(y.take(pa.array(same)))
        out[same] = np.add.reduceat(np.bitwise_count(a ^ b).astype(np.int64), at[:-1])
    return out


def plausible(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose sets may reach a Jaccard similarity of ``percent``, as a stored table without repeats.

    ``sketches`` has ``id, n, bits``: the size of a set and its :func:`bitmap`.  No pair that reaches the
    similarity is lost: sets that differ in ``d`` elements share ``(n + m - d) / 2``, and ``d`` is at least the
    number of bits that differ.
    """
    def run(batches):
        for batch in batches:
            total = batch.column("n").to_numpy() + batch.column("m").to_numpy()
            d = least_differences(batch.column("x"), batch.column("y"))
            at = pa.array(np.flatnonzero((100 + percent) * (total - d) >= 2 * percent * total))
            yield pa.RecordBatch.from_arrays([batch.column("a").take(at), batch.column("b").take(at)], names=["a", "b"])

    left, right = (sketches.select(F.col("id").alias(i), F.col("n").cast("long").alias(n), F.col("bits").alias(s))
                   for i, n, s in (("a", "n", "x"), ("b", "m", "y")))
    both = pairs.select("a", "b").distinct().join(left, "a").join(right, "b").select("a", "b", "n", "m", "x", "y")
    return cut_lineage(both.mapInArrow(run, "a long, b long"))
