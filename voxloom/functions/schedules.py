"""Schedules: a learning rate by step, and how validation windows spread over an epoch, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def learning_rate(step: Column, base: float, least: float, warmup: int, total: int, start: float = 0.01) -> Column:
    """A linear warm-up from ``start`` times the base rate, then half a cosine down to ``least``."""
    rise = base * (start + (1 - start) * F.least(step, F.lit(warmup)) / max(1, warmup))
    turn = F.least(step - warmup, F.lit(total - warmup)) / max(1, total - warmup)
    return F.when(step < warmup, rise).otherwise(least + (base - least) * (1 + F.cos(math.pi * turn)) / 2)


def windows_of(batches: Column, window: Column, least: int = 1) -> Column:
    """How many windows of ``window`` batches, ``least`` at least, cover so many batches."""
    return F.ceil(batches / F.greatest(window, F.lit(least)))


def steps_between(train_steps: Column, windows: Column) -> Column:
    """Training steps from one window to the next, so that an epoch goes through all of them; one step at least."""
    return F.greatest(F.floor(train_steps / F.greatest(windows, F.lit(1))), F.lit(1))
