"""Scores and error breakdowns of predictions against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scored_pairs(labels: DataFrame, pred: DataFrame) -> DataFrame:
    """Labels and predictions side by side; hash or broadcast is left to Spark."""
    return labels.join(pred, ["day", "stid"])


def _score_columns(keep: Column) -> list[Column]:
    y = F.when(keep, F.col("y"))
    error = F.when(keep, F.col("y") - F.col("pred"))
    square_sum = F.sum(error * error)
    total = F.count(error) * F.var_pop(y)
    return [
        F.count(error).alias("n"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        (F.lit(1.0) - square_sum / F.when(total != 0, total)).alias("r2"),
    ]


def scores(pairs: DataFrame, by: list[str] = ()) -> DataFrame:
    """n, MAE, RMSE and R2, over all rows or per group."""
    known = F.col("y").isNotNull() & F.col("pred").isNotNull()
    return pairs.groupBy(*by).agg(*_score_columns(known))


def scores_with_mask(pairs: DataFrame) -> DataFrame:
    """Scores over all samples and over the unmasked ones, in one pass."""
    known = F.col("y").isNotNull() & F.col("pred").isNotNull()
    all_rows = F.struct(*_score_columns(known))
    clean = F.struct(*_score_columns(known & ~F.col("is_masked")))
    both = pairs.agg(all_rows.alias("a"), clean.alias("c"))
    named = F.array(
        F.struct(F.lit("all").alias("samples"), F.col("a").alias("s")),
        F.struct(F.lit("unmasked").alias("samples"), F.col("c").alias("s")),
    )
    return both.select(F.explode(named).alias("r")).select("r.samples", "r.s.*")


def residuals(pairs: DataFrame) -> DataFrame:
    """y - pred per (day, station); NULL where the label is masked."""
    value = F.when(~F.col("is_masked"), F.col("y") - F.col("pred"))
    return pairs.select("day", "stid", value.alias("residual"))


def _absolute() -> Column:
    return F.abs(F.col("residual"))


def mae_by_day(res: DataFrame) -> DataFrame:
    return res.groupBy("day").agg(F.avg(_absolute()).alias("mae"))


def _daily_sum(res: DataFrame) -> DataFrame:
    # a day whose stations are all masked sums to zero
    return res.groupBy("day").agg(F.coalesce(F.sum(_absolute()), F.lit(0.0)).alias("ae"))


def ae_by_day_of_year(res: DataFrame) -> DataFrame:
    return _daily_sum(res).groupBy(F.dayofyear("day").alias("doy")).agg(F.avg("ae").alias("ae"))


def ae_by_month(res: DataFrame) -> DataFrame:
    return _daily_sum(res).groupBy(F.month("day").alias("month")).agg(F.avg("ae").alias("ae"))


def mae_by_station(res: DataFrame) -> DataFrame:
    return res.groupBy("stid").agg(F.avg(_absolute()).alias("mae"))


def mae_by_location(stations: DataFrame, res: DataFrame) -> DataFrame:
    """Stations with their MAE and its share of the largest MAE among them."""
    placed = stations.join(mae_by_station(res), "stid", "left")
    top = placed.agg(F.max("mae").alias("top")).scalar()
    return placed.withColumn("rel_mae", F.col("mae") / F.when(top != 0, top))


def mae_over_under(pairs: DataFrame) -> DataFrame:
    """MAE where the prediction is too high, and where it is not (ties included)."""
    known = pairs.where(F.col("y").isNotNull() & F.col("pred").isNotNull())
    error = F.abs(F.col("y") - F.col("pred"))
    high = F.col("pred") > F.col("y")
    return known.agg(
        F.avg(F.when(high, error)).alias("upper_mae"), F.avg(F.when(~high, error)).alias("lower_mae")
    )


def worst_stations(res: DataFrame, k: int = 10) -> DataFrame:
    """Residual series of the k stations with the largest MAE."""
    worst = mae_by_station(res).orderBy(F.col("mae").desc_nulls_last(), "stid").limit(k)
    return res.join(F.broadcast(worst.select("stid")), "stid", "left_semi")


def top_features(importances: DataFrame, k: int = 50) -> DataFrame:
    """The k most important features, relative to the first."""
    top = importances.agg(F.max("importance").alias("top")).scalar()
    relative = F.col("importance") / F.when(top > 0, top).otherwise(1.0)
    return importances.withColumn("importance", relative).orderBy(F.col("importance").desc(), "feature").limit(k)
