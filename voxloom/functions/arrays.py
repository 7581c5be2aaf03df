"""Column expressions over patches: arrays of voxels in z, y, x order, or of latent values by channel."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def total(a: Column | str) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v)


def total_of(a: Column | str, f: Callable[[Column], Column]) -> Column:
    """Sum of f over an array."""
    return F.aggregate(a, F.lit(0.0), lambda acc, v: acc + f(v))


def total_pair(a: Column | str, b: Column | str, f: Callable[[Column, Column], Column]) -> Column:
    """Sum of f over two arrays of equal length."""
    return total(F.zip_with(a, b, f))


def mean(a: Column | str) -> Column:
    return total(a) / F.size(a)


def mean_pair(a: Column | str, b: Column | str, f: Callable[[Column, Column], Column]) -> Column:
    return total_pair(a, b, f) / F.size(a)


def sharpness(a: Column, side: int) -> Column:
    """Mean absolute finite difference along each axis of a cube, averaged over the three axes."""

    def along(step: int) -> Column:
        # The neighbour of position i is i + step, unless i lies in the last layer of the axis.
        inside = F.filter(F.sequence(F.lit(0), F.lit(side**3 - 1)), lambda i: F.floor(i / step) % side < side - 1)
        return F.aggregate(inside, F.lit(0.0), lambda acc, i: acc + F.abs(F.get(a, i + step) - F.get(a, i))) / F.size(inside)

    return (along(side * side) + along(side) + along(1)) / 3


def gradient_density(mask: Column, side: int) -> Column:
    """The same of a mask: how much of it is boundary."""
    return sharpness(mask, side)


def central_slice(a: Column, side: int, axis: int) -> Column:
    """The middle layer (index side // 2) of a cube along an axis."""
    step = side ** (2 - axis)
    return F.transform(F.filter(F.sequence(F.lit(0), F.lit(side**3 - 1)), lambda i: F.floor(i / step) % side == side // 2), lambda i: F.get(a, i))


def channel_means(mu: Column, channels: int) -> Column:
    """The spatial mean of each channel of a channel-major array."""
    size = (F.size(mu) / channels).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(channels - 1)), lambda c: mean(F.slice(mu, c * size + 1, size)))
