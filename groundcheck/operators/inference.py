"""Running a user's segmentation function on tiles."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from groundcheck import fixed_values as V

_loaded: dict[str, Callable] = {}


def predict_tiles(
    tiles: DataFrame, load: Callable[[], Callable[[np.ndarray], np.ndarray]], size: int,
    name: str = "predictor", by: tuple[str, ...] = (), scale: str = "byte", on_error: str = "fail",
) -> DataFrame:
    """``y0, x0, i, j, p`` from ``load()(tile)``.

    ``tiles`` comes from ``pixels_to_tiles`` with bands ``r, g, b``; a group is one tile, so it is at
    most ``size``² pixels.  ``load`` runs once per Python worker; the function it returns maps a
    ``(3, size, size)`` byte array (0 outside the raster) to ``(size, size)`` probabilities.  With a
    ``valid`` column, tiles without a valid pixel are not predicted.

    ``scale`` is what the function is given: ``byte`` values, ``unit`` (floats 0-1) or ``imagenet`` (mean and
    spread of the training images removed).  With ``on_error="skip"`` a column ``error`` is added: a tile whose
    prediction raises, or has a wrong shape, gives one row with the message and nothing else, in the same
    pass over the tiles, and the job goes on.
    """
    if on_error not in ("fail", "skip"):
        raise ValueError("on_error must be fail or skip")
    if scale not in ("byte", "unit", "imagenet"):
        raise ValueError("scale must be byte, unit or imagenet")
    mean, spread = (np.array(v, np.float32)[:, None, None] for v in (V.IMAGENET_MEAN, V.IMAGENET_STD))
    types = {f.name: f.dataType.simpleString() for f in tiles.schema}
    loader = f"{name}-{hashlib.sha256(cloudpickle.dumps(load)).hexdigest()}"
    keys = [*by, "y0", "x0"]
    names = [*keys, "i", "j", "p", *(["error"] if on_error == "skip" else [])]
    schema = ", ".join([*[f"`{k}` {types[k]}" for k in keys], "i int", "j int", "p double",
                        *(["error string"] if on_error == "skip" else [])])

    def one_tile(pdf: pd.DataFrame) -> pd.DataFrame:
        if "valid" in pdf.columns and not pdf["valid"].any():
            return pd.DataFrame({k: [] for k in names})
        # the module's own memory: one that travels with this function would be empty in every task
        from groundcheck.operators.inference import _loaded

        if loader not in _loaded:
            _loaded[loader] = load()
        i, j = pdf["i"].to_numpy(), pdf["j"].to_numpy()
        image = np.zeros((3, size, size), dtype=np.uint8)
        for band, column in enumerate(("r", "g", "b")):
            image[band, i, j] = np.clip(pdf[column].to_numpy(), 0, 255)
        if scale != "byte":
            image = image.astype(np.float32) / 255
        if scale == "imagenet":
            image = (image - mean) / spread
        out = {k: pdf[k].iloc[0] for k in keys}
        try:
            p = np.asarray(_loaded[loader](image), dtype=np.float64)
            if p.shape != (size, size):
                raise ValueError(f"the predictor returned shape {p.shape}, expected {(size, size)}")
        except Exception as problem:
            if on_error == "fail":
                raise
            return pd.DataFrame({**{k: [v] for k, v in out.items()}, "i": [None], "j": [None], "p": [None],
                                 "error": [f"{type(problem).__name__}: {problem}"]})[names]
        found = pd.DataFrame({**out, "i": i, "j": j, "p": p[i, j]})
        return (found.assign(error=None) if on_error == "skip" else found)[names]

    return tiles.groupBy(*keys).applyInPandas(one_tile, schema)


def require_provider(providers: DataFrame, provider_id: str) -> None:
    """Fail unless the provider exists and is enabled; there is no silent fallback."""
    row = providers.filter(providers.provider_id == provider_id).first()
    if row is None:
        raise ValueError(f"unknown provider {provider_id!r}")
    if not row["enabled"]:
        raise RuntimeError(row["reason"] or f"provider {provider_id!r} is unavailable")
