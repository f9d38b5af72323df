"""Rounding of computed doubles in query results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def r(column, digits: int = 6) -> Column:
    column = F.col(f"`{column}`") if isinstance(column, str) else column
    return F.round(column, digits)


def rounded(df: DataFrame, columns=None, digits: int = 6) -> DataFrame:
    """Rounds the named (default: all) double columns."""
    doubles = [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)]
    chosen = set(doubles if columns is None else columns)
    return df.select(
        *[(r(c, digits).alias(c) if c in chosen else F.col(f"`{c}`")) for c in df.columns]
    )
