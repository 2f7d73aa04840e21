"""Words of whole Arrow text columns: found and hashed in numpy, without a Python object per word."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes that are hashed at once; bounds the memory of a task, not the texts.
CHUNK = 1 << 20

_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 1 << 64)
_BYTES = np.random.default_rng(20).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(count: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``count`` powers of the hash's base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < count:
        for i, base in enumerate((_P, _P_INVERSE)):
            steps = np.full(count, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers[0], _powers[1]


def mixed(h: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values so that their order is that of chance."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def word_bytes(*ranges: tuple[int, int]) -> np.ndarray:
    """Table of the bytes (of lower-cased text) that belong to words."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low:high + 1] = True
    return table


@dataclass
class Words:
    """Words of several texts in order: hash, text number, and place in the lower-cased bytes."""

    data: np.ndarray
    hashes: np.ndarray
    text: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def find_words(column: pa.Array, table: np.ndarray, lead: int | None = None) -> Words:
    """The words of every text of ``column``; A-Z are lower-cased and no word crosses texts.

    A word is a maximal run of bytes of ``table``; with ``lead`` also of that UTF-8 lead byte and the
    byte after it.  Null texts must have been replaced by empty ones.
    """
    column = column.cast(pa.large_string())
    if not len(column):
        empty = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint8), np.zeros(0, np.uint64), empty, empty, empty)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0]:offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    data = _LOWER[data]
    inside = table[data]
    if lead is not None:
        second = data == lead
        inside |= second
        inside[1:] |= second[:-1]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    firsts = offsets[:-1][offsets[:-1] < len(data)]
    begins[firsts] = inside[firsts]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    lasts = offsets[1:][offsets[1:] > 0] - 1
    stops[lasts] = inside[lasts]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    hashes = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(int(np.searchsorted(ends, starts[at] + CHUNK, "right")), at + 1)
        low, high = starts[at], ends[to - 1]
        up, down = powers(int(high - low) + 1)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_BYTES[data[low:high]] * up[:high - low], out=sums[1:])
        s, e = starts[at:to] - low, ends[at:to] - low
        hashes[at:to] = (sums[e] - sums[s]) * down[s]
        at = to
    text = np.searchsorted(offsets, starts, "right") - 1
    return Words(data, mixed(hashes), text, starts, ends)


def byte_slices(batches, text: int, size: int):
    """The batches cut by rows so that the texts in column ``text`` of a slice have at most ``size`` bytes (or one row)."""
    for batch in batches:
        column = batch.column(text).cast(pa.large_string())
        if not batch.num_rows:
            continue
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
        at = 0
        while at < batch.num_rows:
            to = max(int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1, at + 1)
            yield batch.slice(at, to - at)
            at = to
