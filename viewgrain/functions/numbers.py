"""Number functions: bins and hexagons."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def bin_numeric(x: str | Column, size: float) -> Column:
    """Lower bound of the bin of width ``size``; negative values go to the bin below."""
    c = F.col(x) if isinstance(x, str) else x
    return F.floor(c / F.lit(size)) * F.lit(size)


def square(x: Column) -> Column:
    return x * x


def hexbin(x: Column, y: Column) -> tuple[Column, Column]:
    """Centre (x, y) of the nearest unit-side hexagon.

    Hexagon centres form two interleaved rectangular lattices; the nearer of the two
    rounded candidates is the centre.
    """
    wide, high = math.sqrt(3.0), 3.0
    ax, ay = F.floor(x / wide + 0.5) * wide, F.floor(y / high + 0.5) * high
    bx, by = (F.floor(x / wide) + 0.5) * wide, (F.floor(y / high) + 0.5) * high
    to_a = square(x - ax) + square(y - ay)
    to_b = square(x - bx) + square(y - by)
    return F.when(to_a <= to_b, ax).otherwise(bx), F.when(to_a <= to_b, ay).otherwise(by)
