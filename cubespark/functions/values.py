"""Units, scaling, profiles, harmonics and small array helpers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Thickness of the six soil layers, cm.
THICKNESS = (5, 10, 15, 30, 40)


def convert_units(name: str, x: Column) -> Column:
    """Kelvin to degrees Celsius for t2m, metres to millimetres for tp; others as they are."""
    return x - 273.15 if name == "t2m" else x * 1000 if name == "tp" else x


def invert_units(name: str, x: Column) -> Column:
    """The inverse of ``convert_units``."""
    return x + 273.15 if name == "t2m" else x / 1000 if name == "tp" else x


def normalize(x: Column, mean: Column, std: Column, invert: bool = False, is_uncertainty: bool = False) -> Column:
    """(x - mean) / std and its inverse; uncertainties are only scaled."""
    shift = F.lit(0.0) if is_uncertainty else mean
    return x * std + shift if invert else (x - shift) / std


def layer_profile_mean(layers: list[Column]) -> Column:
    """The trapezoid mean over depth of six layer values."""
    return sum((a + b) / 2 * t for a, b, t in zip(layers, layers[1:], THICKNESS, strict=False)) / sum(THICKNESS)


def finite(x: Column) -> Column:
    """neither null nor NaN nor infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def valid_nonzero(x: Column) -> Column:
    """F9"""
    return x.isNotNull() & (x != 0)


def harmonics(t: Column, k_cos: int, k_sin: int, period: float) -> list[Column]:
    """0.5, cos(2 pi k t / T) for 0 < k < k_cos, sin(2 pi k t / T) for 1 <= k <= k_sin; an odd number in all."""
    if (k_cos + k_sin) % 2 == 0:
        raise ValueError("the number of terms must be odd")
    angle = lambda k: F.lit(2 * math.pi * k / period) * t
    return [F.lit(0.5), *(F.cos(angle(k)) for k in range(1, k_cos)), *(F.sin(angle(k)) for k in range(1, k_sin + 1))]


def dot(values: list[Column], amplitudes: Column) -> Column:
    return sum(v * amplitudes[i] for i, v in enumerate(values))


def flat_to_seq(x: Column, n: int) -> Column:
    """A flat array into rows of n values; another length is an error."""
    bad = F.raise_error(F.lit(f"length is no multiple of {n}")).cast("array<array<double>>")
    rows = F.transform(F.sequence(F.lit(0), (F.size(x) / n - 1).cast("int")), lambda i: F.slice(x, (i * n + 1).cast("int"), n))
    return F.when(F.size(x) % n == 0, F.when(F.size(x) == 0, F.array().cast("array<array<double>>")).otherwise(rows)).otherwise(bad)


def seq_to_flat(x: Column) -> Column:
    return F.flatten(x)


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def count_upto(ascending: Column, x: Column) -> Column:
    """How many elements of an ascending array are not above x, by bisection; 0 for a null x."""

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        below = F.get(ascending, middle) <= x
        low, high = F.when(below, middle + 1).otherwise(s["low"]), F.when(below, s["high"]).otherwise(middle)
        return F.when(s["low"] < s["high"], F.struct(low.alias("low"), high.alias("high"))).otherwise(s)

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(ascending) + 1)).cast("int"))
    found = F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.size(ascending).alias("high")), halve)["low"]
    return F.when(x.isNull(), 0).otherwise(found)
