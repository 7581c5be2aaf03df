"""Model inference as a hook: named builders of functions from pandas batches to pandas batches."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Model = Callable[[pd.DataFrame], pd.DataFrame]
_BUILDERS: dict[str, Callable[..., Model]] = {}


def register(name: str) -> Callable[[Callable[..., Model]], Callable[..., Model]]:
    """Registers a builder; a task calls it once and applies what it returns to every batch."""

    def put(builder: Callable[..., Model]) -> Callable[..., Model]:
        _BUILDERS[name] = builder
        return builder

    return put


def names() -> list[str]:
    return sorted(_BUILDERS)


def build(name: str, **options) -> Model:
    """An unknown name is a KeyError, an option the builder doesn't have a TypeError."""
    if name not in _BUILDERS:
        raise KeyError(f"no model {name!r}; there are {names()}")
    inspect.signature(_BUILDERS[name]).bind(**options)
    return _BUILDERS[name](**options)


def inferred(rows: DataFrame, builder: Callable[..., Model], schema: str, **options) -> DataFrame:
    """Applies a model to all rows in Arrow batches; nothing is gathered, so any number of executors may take part."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = builder(**options)
        for batch in batches:
            yield model(batch)

    return rows.mapInPandas(run, schema)


@register("mean_encoder")
def mean_encoder(channels: int = 8) -> Model:
    """A stand-in encoder for tests: mu is the mean of each of ``channels`` equal parts of a patch."""

    def encode(batch: pd.DataFrame) -> pd.DataFrame:
        mu = [np.asarray(v, np.float64).reshape(channels, -1).mean(axis=1).tolist() for v in batch["xct"]]
        return pd.DataFrame({"vec_id": batch["vec_id"], "mu": mu})

    return encode
