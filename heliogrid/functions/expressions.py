"""Feature arithmetic as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Result of dividing a non-zero number by zero, and the exponent and
# operand lists of the three feature presets.
DIVISION_SENTINEL = 1e15

DEFAULT_OPS = (
    ("tcolc_eatm", "pow", 0.15),
    ("apcp_sfc", "pow", 0.15),
    ("uswrf_sfc", "/", "dswrf_sfc"),
    ("ulwrf_sfc", "/", "dlwrf_sfc"),
    ("ulwrf_sfc", "/", "uswrf_sfc"),
    ("dlwrf_sfc", "/", "dswrf_sfc"),
    ("tmax_2m", "-", "tmin_2m"),
    ("tmp_2m", "-", "tmp_sfc"),
    ("apcp_sfc", "-", "pwat_eatm"),
    ("apcp_sfc", "/", "pwat_eatm"),
)
BASELINE_OPS = (
    ("uswrf_sfc", "/", "dswrf_sfc"),
    ("ulwrf_sfc", "/", "dlwrf_sfc"),
    ("ulwrf_sfc", "/", "uswrf_sfc"),
    ("dlwrf_sfc", "/", "dswrf_sfc"),
)
STATION_OPS = (
    ("uswrf_sfc", "/", "dswrf_sfc"),
    ("ulwrf_sfc", "/", "dlwrf_sfc"),
    ("ulwrf_sfc", "/", "uswrf_sfc"),
    ("dlwrf_sfc", "/", "dswrf_sfc"),
    ("tmax_2m", "-", "tmin_2m"),
    ("tmax_2m", "/", "tmin_2m"),
    ("tmp_2m", "-", "tmp_sfc"),
    ("tmp_2m", "/", "tmp_sfc"),
    ("apcp_sfc", "-", "pwat_eatm"),
    ("apcp_sfc", "/", "pwat_eatm"),
    ("uswrf_sfc", "/", "dlwrf_sfc"),
    ("ulwrf_sfc", "/", "dswrf_sfc"),
)
FEATURE_PRESETS = {"default": DEFAULT_OPS, "baseline": BASELINE_OPS, "station": STATION_OPS}


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def ratio(left: Column, right: Column) -> Column:
    """left / right with 0/0 = 0 and x/0 = 1e15, whatever the sign of x."""
    return (
        F.when((left == 0) & (right == 0), F.lit(0.0))
        .when((right == 0) & left.isNotNull(), F.lit(DIVISION_SENTINEL))
        .when(right != 0, left / right)
    )


def power(base: Column, exponent: float) -> Column:
    """base ** exponent; NULL where that is not a real number."""
    return nan_to_null(F.pow(base, F.lit(float(exponent))))


def feature_op(left: Column, op: str, right) -> Column:
    """One (left, op, right) step; ``right`` is a Column, or a number for ``pow``."""
    if op == "pow":
        return power(left, right)
    if op == "/":
        return ratio(left, right)
    if op == "-":
        return left - right
    raise ValueError(f"unknown feature operation {op!r}")


def op_name(left: str, op: str, right) -> str:
    return f"{left}{op}{right}"


def quoted(name: str) -> Column:
    """Column by exact name, also when it holds dots or slashes."""
    return F.col("`" + name.replace("`", "``") + "`")


def derived_columns(ops, source=quoted) -> list[Column]:
    """Named columns for a list of operations; ``source`` maps a feature name to a Column."""
    return [
        feature_op(source(left), op, right if op == "pow" else source(right)).alias(op_name(left, op, right))
        for left, op, right in ops
    ]
