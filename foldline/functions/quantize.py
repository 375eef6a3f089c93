"""Quantizers as columns: finite scalar levels, distances to a codebook, normalisation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the fifty letters of the alphabet, without X and x.
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWYZabcdefghijklmnopqrstuvwyz"
INVALID = "X"


def basis(levels: list[int]) -> list[int]:
    return [math.prod(levels[k + 1 :]) for k in range(len(levels))]


def fsq_digit(z: Column, n: int, corrected: bool = False) -> Column:
    """Level 0..n-1 of one latent component, rounded half to even.

    For an even n the plain map is not the inverse of its grid; corrected=True makes it so.
    """
    t = F.tanh(z)
    if n % 2:
        level = F.rint((t + 1.0) / 2.0 * float(n - 1))
    elif corrected:
        level = F.floor((t + 1.0) / 2.0 * float(n))
    else:
        level = F.rint((t + 1.0 - 1.0 / n) / 2.0 * float(n - 1))
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), level.cast("int")))


def fsq_state(z: list[Column], levels: list[int], corrected: bool = False) -> Column:
    return sum((fsq_digit(c, n, corrected) * b for c, n, b in zip(z, levels, basis(levels))), F.lit(0)).cast("int")


def fsq_grid(n: int) -> list[float]:
    if n % 2:
        return [0.0] if n == 1 else [-1 + 2 * k / (n - 1) for k in range(n)]
    return [-1 + 1 / n + 2 * k / n for k in range(n)]


def fsq_codebook(spark: SparkSession, levels: list[int]) -> DataFrame:
    """state, vec: the Cartesian product of the grids, the first component slowest."""
    out = spark.range(math.prod(levels)).select(F.col("id").cast("int").alias("state"))
    parts = [F.get(F.array(*map(F.lit, fsq_grid(n))), (F.floor(F.col("state") / b) % n).cast("int")) for n, b in zip(levels, basis(levels))]
    return out.select("state", F.array(*parts).alias("vec"))


def distance2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def length(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def normalised(a: Column) -> Column:
    size = F.greatest(length(a), F.lit(1e-12))
    return F.transform(a, lambda x: x / size)


def letter(state: Column) -> Column:
    """A state's letter; null or negative states are invalid."""
    return F.when(state.isNull() | (state < 0), INVALID).otherwise(F.substring(F.lit(LETTERS), state + 1, 1))
