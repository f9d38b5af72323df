"""Calendar features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: mean length of a year in days.
YEAR_DAYS = 365.25


def day_of_year(day: Column) -> Column:
    return F.dayofyear(day)


def distance_from_midyear(day: Column) -> Column:
    return F.abs(F.dayofyear(day).cast("double") - YEAR_DAYS / 2.0)


def year_number(day: Column) -> Column:
    return F.year(day).cast("double")


def one_hot(value: Column, classes, prefix: str) -> list[Column]:
    """One 0/1 column per fitted class; a value outside them gives all zeros."""
    return [F.when(value == c, 1.0).otherwise(0.0).alias(f"{prefix}{c}") for c in classes]
