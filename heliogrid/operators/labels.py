"""Label cleaning and previous-day values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: genuine labels are multiples of this step, imputed ones mostly are not.
LABEL_STEP = 100.0


def previous_values(df: DataFrame, keys: list[str], values: list[str], day: str = "day", prefix: str = "prev_") -> DataFrame:
    """Value of the preceding row in day order per key, as ``prev_<name>`` columns.

    (keys, day) must be unique, so a key has at most one row for each day of the calendar: a window over
    it is bounded by the years covered, not by the rows, and the input is read once.
    """
    before = Window.partitionBy(*keys).orderBy(day)
    kept = [F.col(f"`{c}`") for c in df.columns]
    return df.select(*kept, *[F.lag(F.col(f"`{v}`")).over(before).alias(f"{prefix}{v}") for v in values])


def with_history(df: DataFrame, keys: list[str], values: list[str], suffix: str, day: str = "day") -> DataFrame:
    """Adds previous-day features; the first day of a key keeps its own value."""
    lagged = previous_values(df, keys, values, day, prefix="_p_")
    added = [F.coalesce(F.col(f"`_p_{v}`"), F.col(f"`{v}`")).alias(f"{v}{suffix}") for v in values]
    return lagged.select(*[F.col(f"`{c}`") for c in df.columns], *added)


def mark_imputed(labels: DataFrame, label: str = "y") -> DataFrame:
    """Adds ``is_masked``: repeated from the day before, or not a multiple of 100, or missing."""
    lagged = previous_values(labels, ["stid"], [label])
    y = F.col(label)
    repeated = F.coalesce(y == F.col(f"prev_{label}"), F.lit(False))
    masked = y.isNull() | repeated | (F.pmod(y, F.lit(LABEL_STEP)) != 0)
    return lagged.withColumn("is_masked", masked).drop(f"prev_{label}")


def with_external_mask(marked: DataFrame, external: DataFrame, flag: str = "hard") -> DataFrame:
    """Also masks the samples flagged in another (day, stid) table."""
    joined = marked.join(external.select("day", "stid", flag), ["day", "stid"], "left")
    return joined.withColumn("is_masked", F.col("is_masked") | F.coalesce(F.col(flag), F.lit(False))).drop(flag)


def drop_masked(marked: DataFrame) -> DataFrame:
    return marked.where(~F.col("is_masked"))


def mask_counts(marked: DataFrame) -> DataFrame:
    return marked.agg(F.count("*").alias("n"), F.count_if("is_masked").alias("n_masked"))
