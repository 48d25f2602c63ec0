"""Comparisons of floating-point numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def isclose(a: Column, b: Column, relative: float = 1e-9, absolute: float = 0.0) -> Column:
    """Whether two numbers are equal or differ by no more than either tolerance allows; infinities only equal themselves."""
    finite = (F.abs(a) < float("inf")) & (F.abs(b) < float("inf")) & ~F.isnan(a) & ~F.isnan(b)
    near = F.abs(a - b) <= F.greatest(F.greatest(F.abs(a), F.abs(b)) * relative, F.lit(absolute))
    return (a == b) | (finite & near)
