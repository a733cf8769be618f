"""Column functions of the search: softmax, grid cells, positions, concision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stands for a position of zero or less.
FLOOR = 1e-6


def softmax(values: Column) -> Column:
    """Array to array, shifted by its maximum."""
    top = F.array_max(values)
    powers = F.transform(values, lambda v: F.exp(v - top))
    return F.transform(powers, lambda p: p / F.aggregate(powers, F.lit(0.0), lambda a, b: a + b))


def log_softmax(values: Column) -> Column:
    top = F.array_max(values)
    total = F.aggregate(F.transform(values, lambda v: F.exp(v - top)), F.lit(0.0), lambda a, b: a + b)
    return F.transform(values, lambda v: v - top - F.log(total))


def relu(values: Column) -> Column:
    return F.transform(values, lambda v: F.greatest(v, F.lit(0.0)))


def elu(values: Column) -> Column:
    return F.transform(values, lambda v: F.when(v > 0, v).otherwise(F.exp(v) - 1))


def argmax(values: Column) -> Column:
    """Place (from 0) of the first maximum."""
    return F.array_position(values, F.array_max(values)) - 1


def grid_cell(position: Column, epsilon: float) -> Column:
    """floor(log base 1 + epsilon); positions of zero or less count as ``FLOOR``."""
    p = F.when(position <= 0, F.lit(FLOOR)).otherwise(position)
    return F.floor(F.log(p) / F.log(F.lit(1.0 + epsilon))).cast("int")


def relative_size(n_edges: Column, subg_size: Column) -> Column:
    """log of a size over log of the ego's size; 0 where the ego is too small to tell."""
    return F.when(subg_size > 1, F.log(n_edges.cast("double")) / F.log(subg_size.cast("double"))).otherwise(F.lit(0.0))
