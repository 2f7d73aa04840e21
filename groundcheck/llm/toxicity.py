"""Toxic review notes: a factorization machine over hashed terms."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from groundcheck.llm.common import map_text

#: Stripped from both ends of a word.
EDGES = ".,;:!?\"'()[]{}<>*#%&-_/\\"
PREFIXES = (4, 5, 6)
_MEMORY = 400_000


def term_ids(word: str, dims: int) -> tuple[int, ...]:
    """Hashed ids of the word and of its beginnings, which stand for its inflected forms."""
    word = word.strip(EDGES)
    if not word:
        return ()
    parts = [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) > n)]
    return tuple(zlib.crc32(p.encode("utf-8", "replace")) % dims for p in parts)


@dataclass
class ToxicityModel:
    """``score = sigmoid(bias + sum w_i + sum_{i<j} <v_i, v_j>)`` over a note's distinct known terms."""

    dims: int
    bias: float
    ids: np.ndarray  # known term ids, sorted
    weights: np.ndarray
    factors: np.ndarray

    def score(self, rows: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Scores of notes whose terms are given as places in ``ids``, note after note up to ``ends``."""
        return 1 / (1 + np.exp(-np.clip(_raw(self.bias, self.weights, self.factors, rows, ends)[0], -30, 30)))


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return np.diff(total[np.concatenate([[0], ends])], axis=0)


def _raw(bias, weights, factors, rows, ends):
    v = factors[rows].astype(np.float64)
    s = _sums(v, ends)
    pairs = 0.5 * (s**2 - _sums(v**2, ends)).sum(axis=1)
    return bias + _sums(weights[rows], ends) + pairs, s, v


def _informative(notes: list[np.ndarray], labels: np.ndarray, dims: int, least_gain: float) -> np.ndarray:
    """Terms that toxic notes have more often, by a likelihood-ratio statistic of at least ``least_gain``."""
    def counts(value):
        return np.bincount(np.concatenate([np.zeros(0, np.int64), *(n for n, y in zip(notes, labels) if y == value)]),
                           minlength=dims).astype(float)

    bad, good = counts(1), counts(0)
    share = labels.mean() if len(labels) else 0.0
    seen = np.maximum(bad + good, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = 2 * (np.where(bad > 0, bad * np.log(bad / (seen * share)), 0)
                    + np.where(good > 0, good * np.log(good / (seen * (1 - share))), 0))
    return np.flatnonzero((bad > seen * share) & (gain >= least_gain))


def train(notes: list[np.ndarray], labels: np.ndarray, dims: int, factors: int = 4, epochs: int = 40,
          least_gain: float = 15.0, rate: float = 0.05, decay: float = 2e-5, seed: int = 7) -> ToxicityModel:
    """Fit by Adam on the logistic loss, over the terms that tell the classes apart."""
    rng = np.random.default_rng(seed)
    toxic = float(labels.sum())
    ids = _informative(notes, labels, dims, least_gain) if 0 < toxic < len(labels) else np.zeros(0, np.int64)
    bias = float(np.log((toxic + 0.5) / (len(labels) - toxic + 1.5)))
    state = [np.array([bias]), np.zeros(len(ids)), rng.normal(0, 0.02, (len(ids), factors))]
    if 0 < toxic < len(labels) and len(ids):
        known = np.full(dims, -1)
        known[ids] = np.arange(len(ids))
        docs = [r[r >= 0] for r in (known[n] for n in notes)]
        one, two, step = [np.zeros_like(p) for p in state], [np.zeros_like(p) for p in state], 0
        for _ in range(epochs):
            order = rng.permutation(len(docs))
            for a in range(0, len(order), 256):
                part = order[a:a + 256]
                rows = np.concatenate([docs[i] for i in part])
                sizes = np.array([len(docs[i]) for i in part])
                y, s, v = _raw(state[0][0], state[1], state[2], rows, np.cumsum(sizes))
                g = (1 / (1 + np.exp(-np.clip(y, -30, 30))) - labels[part]) / len(part)
                each = np.repeat(g, sizes)
                moves = [np.array([g.sum()]), np.bincount(rows, each, len(ids)), np.stack(
                    [np.bincount(rows, each * (np.repeat(s[:, f], sizes) - v[:, f]), len(ids))
                     for f in range(factors)], axis=1)]
                step += 1
                for i, p in enumerate(state):
                    m = moves[i] + (decay * p if i else 0)
                    one[i] = 0.9 * one[i] + 0.1 * m
                    two[i] = 0.99 * two[i] + 0.01 * m * m
                    p -= rate * (0.2 if i == 2 else 1) * (one[i] / (1 - 0.9**step)) / (
                        np.sqrt(two[i] / (1 - 0.99**step)) + 1e-8)
    return ToxicityModel(dims, float(state[0][0]), ids, state[1], state[2])


def fit_toxicity(events: DataFrame, labels: DataFrame, key: str = "event_id", text: str = "notes",
                 label: str = "toxic", toxic_rows: int = 2500, clean_rows: int = 6000,
                 dims: int = 1 << 18) -> ToxicityModel:
    """Learn from at most ``toxic_rows`` and ``clean_rows`` labelled events (those of the smallest key hash).

    ``labels`` has ``key`` and ``label`` (1 or 0); other values and null keys are not used.  Only the
    bounded sample's hashed terms reach the driver.  Without both classes the model is a constant.
    """
    marks = labels.filter(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(label).cast("int").alias("y"))
    sample = None
    for value, rows in ((1, toxic_rows), (0, clean_rows)):
        part = marks.filter(F.col("y") == value).orderBy(F.xxhash64("k"), "k").limit(rows)
        sample = part if sample is None else sample.unionByName(part)
    sample = sample.groupBy("k").agg(F.max("y").alias("y"))

    def terms(frames):
        for frame in frames:
            out = [sorted({i for w in set((t or "").lower().split()) for i in term_ids(w, dims)}) for t in frame["t"]]
            yield pd.DataFrame({"k": frame["k"].astype(str), "y": frame["y"], "ids": out})

    rows = (events.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
            .join(F.broadcast(sample), "k").dropDuplicates(["k"])
            .mapInPandas(terms, "k string, y int, ids array<int>").toPandas().sort_values("k"))
    return train([np.asarray(i, np.int64) for i in rows["ids"]], rows["y"].to_numpy(np.float64), dims)


def score_notes(events: DataFrame, model: ToxicityModel, key: str = "event_id", text: str = "notes",
                threshold: float = 0.5, keep: tuple[str, ...] = ()) -> DataFrame:
    """Score every whole note: ``key, score (0 to 1), predicted (1 from the threshold on)`` and ``keep`` columns.

    A null or empty note has no terms and gets the score of the bias alone.  Rows that repeat a key are
    scored each; equal notes get equal scores; an empty table gives no rows.  The model's size is bounded
    by its ``dims``.
    """
    held = events.sparkSession.sparkContext.broadcast(model)
    kept = [F.col(c).alias(f"_{i}") for i, c in enumerate(keep)]

    def scorer():
        m, known = held.value, {}
        place = {int(i): at for at, i in enumerate(m.ids)}

        def run(texts):
            rows, ends = [], []
            for t in texts:
                found = set()
                for w in set((t or "").lower().split()):
                    ids = known.get(w)
                    if ids is None:
                        if len(known) > _MEMORY:
                            known.clear()
                        ids = known[w] = tuple(place[i] for i in term_ids(w, m.dims) if i in place)
                    found.update(ids)
                rows += sorted(found)
                ends.append(len(rows))
            return [m.score(np.array(rows, np.int64), np.array(ends, np.int64))], None

        return run

    scored = map_text(events.select(F.col(key).alias("k"), *kept, F.col(text).cast("string").alias("t")), "t",
                      scorer, "score double")
    return scored.select(F.col("k").alias(key), *(F.col(f"_{i}").alias(c) for i, c in enumerate(keep)), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
