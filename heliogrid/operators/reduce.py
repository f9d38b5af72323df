"""Ensemble, hour and prediction reductions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


CUBE_KEYS = ["day", "fx", "ens", "hour", "lat_i", "lon_i"]


def spread(column) -> Column:
    """Population standard deviation."""
    return F.stddev_pop(column)


REDUCERS = {"mean": F.avg, "std": spread}


def reduce_axis(df: DataFrame, axis: str, how: str, value: str = "value", axes=None) -> DataFrame:
    """Removes one key from a long table, reducing its values by mean or std."""
    keys = [c for c in (axes or df.columns) if c not in (axis, value)]
    return df.groupBy(*keys).agg(REDUCERS[how](value).alias(value))


def mean_and_std(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Mean and population std of a value per key in one pass."""
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), spread(value).alias("std"))


def ensemble_stats(cube: DataFrame) -> DataFrame:
    return mean_and_std(cube, ["day", "fx", "hour", "lat_i", "lon_i"])


def hour_then_ensemble(cube: DataFrame, hour_how: str, ens_how: str) -> DataFrame:
    """Hours reduced first, members second; the order matters when values are missing."""
    by_hour = reduce_axis(cube, "hour", hour_how)
    return reduce_axis(by_hour, "ens", ens_how)


def ensemble_then_hour_mean(cube: DataFrame) -> DataFrame:
    """Member mean, then hour mean, per day, feature and cell."""
    return reduce_axis(reduce_axis(cube, "ens", "mean"), "hour", "mean")


def cell_columns(features, n_lat: int, n_lon: int) -> list[str]:
    return [f"{fx}_{i}_{j}" for fx in features for i in range(n_lat) for j in range(n_lon)]


def widen_cells(df: DataFrame, keys: list[str], features, n_lat: int, n_lon: int, value: str = "value") -> DataFrame:
    """One row per key with one column per (feature, cell); the column list is known ahead."""
    label = F.concat_ws("_", "fx", "lat_i", "lon_i")
    return (
        df.withColumn("_cell", label)
        .groupBy(*keys)
        .pivot("_cell", cell_columns(features, n_lat, n_lon))
        .agg(F.first(value, ignorenulls=True))
    )


def widen(df: DataFrame, keys: list[str], label: Column, names: list[str], values: dict[str, str]) -> DataFrame:
    """Long to wide on known names: column '<prefix><name>' for every value column.

    ``values`` maps a value column to the prefix of its wide columns.
    """
    present = [c for c in values if c in df.columns]
    picks = [
        F.first(F.when(F.col("_k") == n, F.col(c)), ignorenulls=True).alias(f"{values[c]}{n}")
        for c in present
        for n in names
    ]
    if len(present) == 1:
        (only,) = present
        wide = df.withColumn("_k", label).groupBy(*keys).pivot("_k", names).agg(F.first(only, ignorenulls=True))
        return wide.select(*keys, *[F.col(f"`{n}`").alias(f"{values[only]}{n}") for n in names])
    return df.withColumn("_k", label).groupBy(*keys).agg(*picks)


def mean_prediction(pred: DataFrame, keys=("day", "stid"), value: str = "pred") -> DataFrame:
    """Average of predictions over members, corners, station copies or seeds."""
    return pred.groupBy(*keys).agg(F.avg(value).alias(value))


def climatology(labels: DataFrame) -> DataFrame:
    """Mean label by month and station."""
    return labels.groupBy(F.month("day").alias("month"), "stid").agg(F.avg("y").alias("climate"))


def climate_lookup(df: DataFrame, table: DataFrame) -> DataFrame:
    """Predicts each (day, station) by its monthly mean; NULL where none was fitted.

    The join is left to the size estimates of Spark: both sides may be large.
    """
    keyed = df.withColumn("month", F.month("day"))
    return keyed.join(table, ["month", "stid"], "left").drop("month").withColumnRenamed("climate", "pred")


def moments(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population std per column (one row of numbers); zero spread scales by one."""
    aggs = []
    for i, c in enumerate(columns):
        col = F.col(f"`{c}`")
        aggs += [F.avg(col).alias(f"m{i}"), spread(col).alias(f"s{i}")]
    row = df.agg(*aggs).first()
    return {c: (row[f"m{i}"], row[f"s{i}"] or 1.0) for i, c in enumerate(columns)}


def standardise(df: DataFrame, fitted_on: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / std with moments of ``fitted_on``; other columns are kept.

    The moments enter as constants: as subqueries they would be planned once per column.
    """
    stats = moments(fitted_on, columns)

    def scaled(c):
        mean, sd = stats[c]
        return ((F.col(f"`{c}`") - F.lit(mean)) / F.lit(sd)).alias(c)

    return df.select(*[scaled(c) if c in stats else F.col(f"`{c}`") for c in df.columns])


def label_moments(labels: DataFrame, label: str = "y") -> DataFrame:
    sd = spread(label)
    return labels.groupBy("stid").agg(
        F.avg(label).alias("y_mean"), F.when(sd == 0, 1.0).otherwise(sd).alias("y_std")
    )


def standardise_labels(labels: DataFrame, fitted: DataFrame, with_std: bool = True, label: str = "y") -> DataFrame:
    """Per-station centring (and scaling) of labels."""
    centred = F.col(label) - F.col("y_mean")
    scaled = centred / F.col("y_std") if with_std else centred
    return labels.join(fitted, "stid").withColumn(label, scaled).drop("y_mean", "y_std")


def restore_labels(pred: DataFrame, fitted: DataFrame, with_std: bool = True, column: str = "pred") -> DataFrame:
    value = F.col(column) * F.col("y_std") if with_std else F.col(column)
    return pred.join(fitted, "stid").withColumn(column, value + F.col("y_mean")).drop("y_mean", "y_std")


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Equal-width histogram over the whole range, empty bins included."""
    span = df.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi")).alias("s")).scalar()
    width = (span.getField("hi") - span.getField("lo")) / float(bins)
    at = F.when(width > 0, F.floor((F.col(value) - span.getField("lo")) / F.when(width > 0, width).otherwise(1.0)))
    index = F.least(F.coalesce(at, F.lit(0)), F.lit(bins - 1)).cast("int")
    counted = df.where(F.col(value).isNotNull()).groupBy(index.alias("bin")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counted, "bin", "left").select(
        "bin",
        (span.getField("lo") + F.col("bin") * width).alias("left_edge"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
    )
