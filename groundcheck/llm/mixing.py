"""Mixing review notes to target weights: iterative proportional fitting and calibrated sampling."""

from __future__ import annotations

from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

#: Stands for every value that a target does not name, nulls included.
REST = "*"
WORD = r"[^\x20\x09-\x0D]+"


def rake(tokens: np.ndarray, targets: list[np.ndarray], rounds: int = 200, tolerance: float = 1e-9) -> np.ndarray:
    """Scale a table of token counts until its sums along every axis have the target shares.

    Values without tokens can't be weighted; their share goes to the others in proportion.  Where the
    targets contradict the table's empty cells the last round's fit is returned.
    """
    fit = tokens / max(tokens.sum(), 1)
    goals = []
    for axis, goal in enumerate(targets):
        held = fit.sum(axis=tuple(a for a in range(fit.ndim) if a != axis)) > 0
        goal = np.where(held, goal, 0)
        goals.append(goal / goal.sum() if goal.sum() else np.zeros_like(goal))
    for _ in range(rounds):
        worst = 0.0
        for axis, goal in enumerate(goals):
            others = tuple(a for a in range(fit.ndim) if a != axis)
            have = fit.sum(axis=others)
            factor = np.divide(goal, have, out=np.zeros_like(have), where=have > 0)
            worst = max(worst, float(np.abs(goal - have).max(initial=0)))
            fit = fit * np.expand_dims(factor, others)
        if worst < tolerance:
            break
    return fit


def copy_weights(tokens: np.ndarray, fit: np.ndarray, share: float) -> np.ndarray:
    """Mean copies in proportion to fitted over actual weight that leave ``share`` of all tokens in at least one copy."""
    ratio = np.divide(fit * tokens.sum(), tokens, out=np.zeros_like(fit), where=tokens > 0)
    low, high = 0.0, 1.0 / max(ratio[ratio > 0].min(initial=np.inf), 1e-12) if (ratio > 0).any() else 0.0
    for _ in range(100):
        scale = (low + high) / 2
        if (tokens * np.minimum(1, scale * ratio)).sum() < share * tokens.sum():
            low = scale
        else:
            high = scale
    return high * ratio


def keep_probabilities(tokens: np.ndarray, fit: np.ndarray, share: float) -> np.ndarray:
    """Probabilities of at least one copy: ``share`` of all tokens has one."""
    return np.minimum(1, copy_weights(tokens, fit, share))


def _goal(target: dict[str, float], values: list[str], tokens: np.ndarray) -> np.ndarray:
    """Shares of the values; an unnamed :data:`REST` has its actual share and the others share what is left."""
    goal = np.array([target.get(v, 0.0) for v in values])
    if REST in target:
        return goal
    goal, rest = np.where(tokens > 0, goal, 0), np.array([v == REST for v in values])
    own = tokens[rest].sum() / max(tokens.sum(), 1)
    return np.where(rest, own, goal * (1 - own) / (goal.sum() or 1))


def mix_notes(events: DataFrame, targets: dict[str, dict[str, float]], share: float = 0.8,
              key: str = "event_id", text: str = "notes", seed: int = 42,
              keep: tuple[str, ...] = ()) -> DataFrame:
    """Sample notes so that the tokens of all copies have the target shares by every column of ``targets``.

    ``targets`` maps columns (the reviewer or source, the language, the topic) to shares per value, with
    :data:`REST` for all values not named, so the cross table is as small as the caller's lists.  Its
    token counts (words) are summed over all rows, raked on the driver, and turned into one weight per
    cell, so that ``share`` of the tokens stay on average.  A note is taken as many times as the whole part
    of its cell's weight says, and once more if the hash of its key falls below the remainder, so cells
    that are short of their target are repeated, and the draw repeats exactly and does not depend on the
    partitions.  Only what is counted ``copies`` times has the target shares; the ``kept`` notes counted once
    do not where a weight is over 1.

    Returns ``key``, the columns ``keep``, the target columns (as grouped), ``tokens, probability`` (of at
    least one copy), ``kept, copies`` for every row.

    A null value counts under :data:`REST`.  Where that is not named it takes its actual share of the tokens,
    and the named shares are of the others.  Null and empty notes have no tokens and their cell's
    probability, which is 1 where the cell has none at all (0 if a value of it is named with share 0);
    rows that repeat a key share one draw; an empty table gives no rows.
    """
    if not 0 < share <= 1 or any(v < 0 for t in targets.values() for v in t.values()):
        raise ValueError("share must be in (0, 1] and target shares not negative")
    names, lists = list(targets), [sorted({*t, REST}) for t in targets.values()]

    def grouped(i: int) -> Column:
        value = F.col(names[i]).cast("string")
        return F.when(value.isin([v for v in lists[i] if v != REST]), value).otherwise(F.lit(REST)).alias(f"d{i}")

    if taken := {*keep} & {key, *names, "tokens", "probability", "kept", "copies"}:
        raise ValueError(f"columns to keep may not be called {sorted(taken)}")
    rows = events.select(
        F.col(key).alias("k"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(keep)), *(grouped(i) for i in range(len(names))),
        F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("tokens"))
    dims = [f"d{i}" for i in range(len(names))]
    table = np.zeros([len(v) for v in lists])
    for r in rows.groupBy(*dims).agg(F.sum("tokens").alias("n")).collect():
        table[tuple(v.index(r[d]) for v, d in zip(lists, dims))] = r["n"]
    goals = [_goal(t, v, table.sum(axis=tuple(a for a in range(table.ndim) if a != i)))
             for i, (t, v) in enumerate(zip(targets.values(), lists))]
    weights = copy_weights(table, rake(table, goals), share)
    # rows of a cell without tokens move no share: they stay unless a target of 0 is named
    barred = [np.array([t.get(v, 1.0) == 0 for v in values]) for t, values in zip(targets.values(), lists)]
    weights = np.where(table > 0, weights, ~np.any(np.meshgrid(*barred, indexing="ij"), axis=0))
    cells = [(*values, float(weights[tuple(v.index(x) for v, x in zip(lists, values))])) for values in product(*lists)]
    plan = events.sparkSession.createDataFrame(
        cells, ", ".join([*(f"{d} string" for d in dims), "w double"]))
    draw = F.shiftrightunsigned(F.xxhash64("k", F.lit(seed)), 11) / F.lit(float(2**53))
    copies = F.floor("w") + (draw < F.col("w") - F.floor("w")).cast("long")
    # one row for each cell of the caller's lists
    return rows.join(F.broadcast(plan), dims).withColumn("copies", copies).select(
        F.col("k").alias(key), *(F.col(f"c{i}").alias(c) for i, c in enumerate(keep)),
        *(F.col(d).alias(n) for d, n in zip(dims, names)), "tokens", F.least("w", F.lit(1.0)).alias("probability"),
        (F.col("copies") > 0).alias("kept"), "copies")
