"""Packing review notes into sequences by cutting-stock column generation."""

from __future__ import annotations

import os
import unicodedata
import zlib

import numpy as np
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from groundcheck.llm.common import map_text, ranked

_workers: dict = {}


class WordEncoder:
    """Token ids of texts, word by word.

    The vocabulary never joins words across white space, so a text's ids are those of its words in order.
    Words of letters skip the normalizer and the splitter (they would leave them as they are); all
    other words take the tokenizer's whole way.  At most ``limit`` words are remembered.
    """

    def __init__(self, path: str, limit: int = 700_000):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.limit, self.known = limit, {}
        self.points = {c: self._whole([c])[0] for c in ".,"}
        self.bytes = self._byte_letters()
        self.by_letter = self._letters_stay()

    @staticmethod
    def _byte_letters() -> list[str]:
        """The letter that byte-level vocabularies write for each byte."""
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        names = {b: chr(b) for b in kept}
        for b in range(256):
            if b not in names:
                names[b] = chr(256 + b - sum(1 for k in kept if k < b))
        return [names[b] for b in range(256)]

    def _whole(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes()
                for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _model(self, word: str) -> bytes:
        if not word.isascii():
            word = "".join([self.bytes[b] for b in word.encode()])
        return np.array([t.id for t in self.tokenizer.model.tokenize(word)], "<u4").tobytes()

    def _letters_stay(self) -> bool:
        """Whether this vocabulary lower-cases and encodes words of letters as the short way does."""
        probe = ["water", "Water", "zqxv", "straße", "été", "naïve"]
        return all(self._model(w.lower()) == full for w, full in zip(probe, self._whole(probe))) and \
            self._whole(["water.", "water,"]) == [self._model("water") + self.points[c] for c in ".,"]

    def _learn(self, words: set[bytes]) -> None:
        if len(self.known) + len(words) > self.limit:
            self.known.clear()
        rest = []
        for raw in words:
            w = raw.decode()
            tail = w[-1] if w[-1] in ".," else ""
            core = w[:-1] if tail else w
            if self.by_letter and core.isalpha() and (core.isascii() or (
                    core == core.lower() and unicodedata.is_normalized("NFC", core))):
                self.known[raw] = self._model(core.lower()) + (self.points[tail] if tail else b"")
            else:
                rest.append(raw)
        self.known.update(zip(rest, self._whole([r.decode() for r in rest])))

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        words = text.encode().split()  # at ASCII white space alone
        try:
            return b"".join(map(self.known.__getitem__, words))
        except KeyError:
            new = set(words).difference(self.known)
            self._learn(new)
            if not all(w in self.known for w in words):  # the memory was emptied
                self._learn(set(words))
            return b"".join(map(self.known.__getitem__, words))


def _encoder(path: str) -> WordEncoder:
    if path not in _workers:
        _workers[path] = WordEncoder(path)
    return _workers[path]


def _cutter(path: str, end_id: int, length: int):
    def make():
        encoder, end = _encoder(path), np.array([end_id], "<u4").tobytes()
        step = 4 * length

        def run(texts):
            rows, places = [], []
            for i, text in enumerate(texts):
                raw = (encoder.encode(text) if text else b"") + end
                n = len(raw) // 4
                for a in range(0, len(raw), step):
                    piece = raw[a:a + step]
                    rows.append((a // 4, len(piece) // 4, zlib.crc32(piece), n))
                    places.append(i)
            return list(zip(*rows)) or [[], [], [], []], places

        return run

    return make


def _best_pattern(prices: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """The pattern of highest price that fits: an unbounded knapsack by dynamic programming."""
    value, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room, fits in enumerate(np.searchsorted(sizes, np.arange(capacity + 1), side="right").tolist()):
        if not room:
            continue
        value[room], last[room] = value[room - 1], -2
        if fits:
            offers = value[room - sizes[:fits]] + prices[:fits]
            i = int(offers.argmax())
            if offers[i] > value[room] + 1e-12:
                value[room], last[room] = offers[i], i
    pattern, room = np.zeros(len(sizes), np.int64), capacity
    while room > 0 and last[room] != -1:
        if last[room] == -2:
            room -= 1
        else:
            pattern[last[room]] += 1
            room -= sizes[last[room]]
    return pattern, float(value[capacity])


def cutting_patterns(demand: dict[int, int], capacity: int, gap: float = 1e-3) -> list[tuple[dict[int, int], int]]:
    """``(pattern, times)`` that cover the demanded pieces (size -> count) with few bins of ``capacity``.

    The linear program starts from one pattern per size; the knapsack prices new patterns until the
    best one's price is at most ``1 + gap``, which bounds the bins above the optimum by that share, or
    the solution has stopped improving.
    Patterns are used the whole times of the solution; the pieces left over, fewer than a bin per
    pattern, are filled largest first.
    """
    sizes = np.array(sorted(s for s, n in demand.items() if n > 0), np.int64)
    if not len(sizes):
        return []
    need = np.array([demand[int(s)] for s in sizes], float)
    m = len(sizes)
    # slightly uneven demands keep the simplex method from turning in circles
    need *= 1 + 1e-4 * np.random.default_rng(0).random(m)
    best, since = np.inf, 0
    columns = np.diag(capacity // sizes).astype(float)
    inverse, x = np.diag(1.0 / np.diag(columns)), need / np.diag(columns)
    while True:
        prices = inverse.sum(axis=0)
        pattern, value = _best_pattern(prices, sizes, capacity)
        bins = float(x.sum())
        best, since = (bins, 0) if bins < best * (1 - 1e-5) else (best, since + 1)
        if value <= 1 + gap or since > 2 * m + 50:
            break
        move = inverse @ pattern
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(move > 1e-9, x / move, np.inf)
        out = int(ratio.argmin())
        amount = ratio[out]
        x = np.maximum(x - amount * move, 0)
        x[out] = amount
        columns[:, out] = pattern
        row = inverse[out] / move[out]
        inverse -= np.outer(move, row)
        inverse[out] = row
    left, used = np.array([demand[int(s)] for s in sizes], np.int64), []
    for j in range(m):
        pattern = columns[:, j].astype(np.int64)
        held = pattern > 0
        times = int(min(np.floor(x[j] + 1e-6), (left[held] // pattern[held]).min()))
        if times > 0:
            used.append((pattern, times))
            left -= times * pattern
    while left.any():
        pattern, room = np.zeros(m, np.int64), capacity
        for i in range(m - 1, -1, -1):
            pattern[i] = min(left[i], room // sizes[i])
            room -= pattern[i] * sizes[i]
        held = pattern > 0
        times = int((left[held] // pattern[held]).min())
        used.append((pattern, times))
        left -= times * pattern
    return [({int(sizes[i]): int(p[i]) for i in np.flatnonzero(p)}, t) for p, t in used]


def pack_notes(events: DataFrame, tokenizer: str, key: str = "event_id", text: str = "notes", length: int = 2048,
               end_id: int = 1, unit: int = 8, keep: tuple[str, ...] = ()) -> DataFrame:
    """Pack every note into sequences of at most ``length`` tokens with little padding.

    A note's tokens are its ids by the vocabulary file ``tokenizer`` and ``end_id``.  They are cut into
    full pieces of ``length`` and a rest.  The histogram of piece lengths, in units of ``unit`` tokens
    (``length / unit`` classes at most), is packed on the driver by :func:`cutting_patterns`; the pieces
    of a class are numbered by :func:`ranked` and take the places of the patterns in that order.

    Returns per piece ``key, start (the note's ids before it), length, ids_crc32 (of the ids as
    little-endian unsigned 32-bit), doc_tokens, sequence_id, offset``, and the columns of ``keep`` (a number of the copy,
    where rows repeat a key).  Offsets are gapless from 0.

    A null or empty note is the end id alone; rows that repeat a key are packed each; further columns are
    not read; an empty table gives no rows.  A note of any length is cut, never shortened.
    """
    if length % unit:
        raise ValueError("length must be a multiple of unit")
    made = ("text", "start", "length", "ids_crc32", "doc_tokens", "class", "rank", "size", "first", "last", "each", "sequence",
            "sequence_id", "offset", "key", key)
    if taken := {*keep} & {*made}:
        raise ValueError(f"{sorted(taken)} can't be kept")
    pieces = map_text(events.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), *keep), "text",
                      _cutter(tokenizer, end_id, length),
                      "start long, length long, ids_crc32 long, doc_tokens long")
    pieces = pieces.withColumn("class", F.ceil(F.col("length") / unit).cast("int"))
    pieces, counts = ranked(pieces, ["class"], ["key", *keep, "start", "ids_crc32"])
    places, at, sequence = [], {}, 0
    for pattern, times in cutting_patterns({c: n for (c,), n in counts.items()}, length // unit):
        for size, n in pattern.items():
            first = at.get(size, 0)
            at[size] = first + n * times
            places.append((size, first, at[size], n, sequence))
        sequence += times
    plan = pieces.sparkSession.createDataFrame(places, "size int, first long, last long, each long, sequence long")
    # at most a row per pattern and class
    placed = pieces.join(F.broadcast(plan), (F.col("class") == F.col("size")) & (F.col("rank") >= F.col("first"))
                         & (F.col("rank") < F.col("last"))).select(
        "key", *keep, "start", "length", "ids_crc32", "doc_tokens",
        (F.col("sequence") + F.floor((F.col("rank") - F.col("first")) / F.col("each"))).alias("sequence_id"))
    before = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "key", *keep, "start").rowsBetween(
        Window.unboundedPreceding, -1)
    return placed.select(F.col("key").alias(key), "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
                         F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"), *keep)
