"""Scalar expressions over columns; all stay inside Spark's generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("z", "y", "x")


def micrometres(axis: str, voxel: tuple[float, float, float], prefix: str = "") -> Column:
    """A coordinate in micrometres; the factor is a double, so nothing turns into a decimal."""
    return F.col(prefix + axis) * F.lit(float(voxel[AXES.index(axis)]))


def distance(a: str, b: str, voxel: tuple[float, float, float]) -> Column:
    """Euclidean distance in micrometres of the points with column prefixes ``a`` and ``b``."""
    parts = [(F.col(a + c) - F.col(b + c)) * F.lit(s) for c, s in zip(AXES, voxel, strict=True)]
    return F.sqrt(parts[0] * parts[0] + parts[1] * parts[1] + parts[2] * parts[2])


def half_even(c: Column) -> Column:
    """Rounded to an int, halves to the even neighbour."""
    return F.bround(c.cast("double"), 0).cast("int")


def toward_zero(c: Column) -> Column:
    """Cut to an int toward zero."""
    return c.cast("int")


def wider_than(cosine: Column, degrees: float) -> Column:
    """Whether an angle, by its cosine, is at least ``degrees``."""
    return cosine <= F.lit(math.cos(math.radians(degrees)))


def clipped_angle(dot: Column, norms: Column) -> Column:
    """The angle in degrees of two vectors by their dot product and the product of their norms."""
    return F.degrees(F.acos(F.greatest(F.least(dot / (norms + 1e-9), F.lit(1.0)), F.lit(-1.0))))


def predicted(position: Column, velocity: Column, blend: float) -> Column:
    """Where constant velocity, weighed by ``blend``, takes a position."""
    return position + F.lit(blend) * F.coalesce(velocity, F.lit(0.0))


def scaled_between(value: Column, low: Column, high: Column) -> Column:
    """0 to 1 between two bounds, clipped."""
    return F.least(F.greatest((value - low) / (high - low + 1e-6), F.lit(0.0)), F.lit(1.0))


def safe_ratio(top: Column, bottom: Column, empty: float | None = 0.0) -> Column:
    """top / bottom, or ``empty`` where bottom is 0."""
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(empty).cast("double"))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def intensity_jitter(value: Column, gamma: float, contrast: float, brightness: float, noise: Column) -> Column:
    """Gamma, contrast and brightness, noise, clipped to 0..1."""
    return F.least(F.greatest(F.pow(value, F.lit(gamma)) * contrast + brightness + noise, F.lit(0.0)), F.lit(1.0))


def uniform(seed: int, *parts: Column) -> Column:
    """A number from 0 to below 1 that the seed and the text of ``parts`` fix, so that a task run again draws the same."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def normal(seed: int, *parts: Column) -> Column:
    """A standard normal number that the seed and the text of ``parts`` fix."""
    return F.sqrt(-2.0 * F.ln(1.0 - uniform(seed, F.lit("r"), *parts))) * F.cos(2.0 * math.pi * uniform(seed, F.lit("a"), *parts))


def cosine_rate(epoch: Column, epochs: int, base: float, least: float) -> Column:
    """The learning rate of a cosine schedule."""
    return F.lit(least) + F.lit(0.5 * (base - least)) * (1 + F.cos(F.pi() * epoch / F.lit(float(epochs))))


def stem_of(path: Column) -> Column:
    """A file's name without folders and without its last suffix."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
