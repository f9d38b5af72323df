"""Evaluation of models: train/test runs, folds, learning curves and submissions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliogrid.operators import draws, metrics, sampling
from heliogrid.operators.joins import union_all
from heliogrid.operators.labels import mark_imputed
from heliogrid.operators.reduce import label_moments, restore_labels, standardise_labels
from heliogrid.operators.ridge import gram_table, predict_keyed, solve_left_out, solve_table
from heliogrid.session import settled
from heliogrid.sources import tables


def with_folds(df: DataFrame, folds: int = 5, seed: int = 0) -> DataFrame:
    """Adds the test fold of each row's day."""
    return df.join(sampling.assign_folds(df, folds, seed), "day")


def out_of_fold_climatology(labels: DataFrame, folds: int = 5, seed: int = 0) -> DataFrame:
    """Per (day, station): the monthly station mean over all other folds.

    One pass of sums per (month, station, fold); a fold's training mean is the total
    less its own share, so nothing is fitted fold by fold.
    """
    tagged = with_folds(labels, folds, seed).withColumn("month", F.month("day"))
    by_fold = tagged.groupBy("month", "stid", "fold").agg(F.sum("y").alias("s"), F.count("y").alias("n"))
    total = by_fold.groupBy("month", "stid").agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    rest = F.col("tn") - F.col("n")
    left = by_fold.join(total, ["month", "stid"]).select(
        "month", "stid", "fold", F.when(rest > 0, (F.col("ts") - F.col("s")) / F.when(rest > 0, rest)).alias("pred")
    )
    return tagged.join(left, ["month", "stid", "fold"], "left").select("day", "stid", "fold", "y", "pred")


def split_day(labels: DataFrame, fraction: float = 0.5):
    """The first test day, as a value, so that it filters scans by day."""
    one = labels.sparkSession.range(1).select(sampling.cutoff_day(labels, fraction).alias("cut"))
    return one.first()["cut"]


@dataclass(frozen=True)
class Evaluation:
    """Predictions of the test days with labels, mask and scores; what needs the labelled predictions is made when asked for."""

    predictions: DataFrame
    test: DataFrame
    at_labels: Callable

    @cached_property
    def labelled(self) -> DataFrame:
        """The predictions that have a label."""
        return self.at_labels()

    @cached_property
    def pairs(self) -> DataFrame:
        return metrics.scored_pairs(mark_imputed(self.test), self.labelled)

    @cached_property
    def scores(self) -> DataFrame:
        return metrics.scores_with_mask(self.pairs)

    def residuals(self) -> DataFrame:
        return metrics.residuals(self.pairs)


def train_test(model, data, labels: DataFrame, fraction: float = 0.5, cut=None, scale_labels: bool = False) -> Evaluation:
    """Fits on the earlier days, predicts the later ones, scores with and without masked labels."""
    cut = split_day(labels, fraction) if cut is None else cut
    train, test = labels.where(F.col("day") < F.lit(cut)), labels.where(F.col("day") >= F.lit(cut))
    if scale_labels:
        fitted_scale = label_moments(train)
        fitted = model.fit(data.before(cut), standardise_labels(train, fitted_scale, with_std=False))
        restored = lambda pred: restore_labels(pred, fitted_scale, with_std=False)
    else:
        fitted, restored = model.fit(data.before(cut), train), lambda pred: pred
    pred = restored(fitted.predict(data.since(cut)))
    return Evaluation(pred, test, lambda: restored(_at_labels(fitted, data.since(cut), test)))


def _at_labels(fitted, data, labels: DataFrame) -> DataFrame:
    """Predictions where there are labels; models of station rows make no other rows."""
    from heliogrid.plans.models import FittedModel

    if not isinstance(fitted, FittedModel):
        return fitted.predict(data)
    return fitted.predict(data, labels.groupBy("day", "stid").agg(F.first("y").alias("y")))


def submit(model, train_data, test_data, labels: DataFrame, scale_labels: bool = False) -> DataFrame:
    """Fits on all labelled days and predicts the days of ``test_data``."""
    if not scale_labels:
        return model.fit(train_data, labels).predict(test_data)
    moments = label_moments(labels)
    fitted = model.fit(train_data, standardise_labels(labels, moments))
    return restore_labels(fitted.predict(test_data), moments)


def submit_blocks(model, train_data, test_data, labels: DataFrame, places: DataFrame, width: int, scale_labels: bool = False) -> DataFrame:
    """``submit`` as the wide rows of ``tables.submission_blocks``; station models with a linear estimator make them row by row."""
    from heliogrid.plans.models import FittedModel

    moments = label_moments(labels) if scale_labels else None
    fitted = model.fit(train_data, standardise_labels(labels, moments) if scale_labels else labels)
    if isinstance(fitted, FittedModel):
        values = fitted.predict_blocks(test_data, places, width, moments)
        if values is not None:
            return tables.wide_blocks(values, [F.get("values", F.lit(i)) for i in range(width)])
    pred = fitted.predict(test_data)
    return tables.submission_blocks(restore_labels(pred, moments) if scale_labels else pred, places, width)


# ---------------------------------------------------------------- cross-validation


def ridge_fold_models(rows: DataFrame, alpha: float, normalise: bool = True) -> DataFrame:
    """(fold, intercept, coef) fitted on all other folds, from one pass over the rows."""
    return solve_left_out(gram_table(rows, ["fold"], few_keys=True), ["fold"], alpha, normalise)


def ridge_out_of_fold(rows: DataFrame, alpha: float = 1e-5, normalise: bool = True) -> DataFrame:
    """Adds ``pred``: each row predicted by the model that has not seen its fold."""
    ready = settled(rows)
    models = settled(ridge_fold_models(ready, alpha, normalise))
    return predict_keyed(ready, models, ["fold"])


def fold_scores(pairs: DataFrame) -> DataFrame:
    """MAE per fold."""
    return metrics.scores(pairs, ["fold"]).select("fold", "n", "mae")


def score_summary(by_fold: DataFrame) -> DataFrame:
    """Mean of the fold MAEs and twice their population std."""
    return by_fold.agg(F.avg("mae").alias("mae"), (F.stddev_pop("mae") * 2.0).alias("two_std"))


def cross_val(model, data, labels: DataFrame, folds: int = 5, seed: int = 0) -> DataFrame:
    """Out-of-fold predictions of any model: (day, stid, fold, y, is_masked, pred).

    Station models make their design once, for all days, and write it; a fold is a filter on it, and previous days are those of
    the calendar. Other models are fitted on the cube and labels of all other days. The fold table has one row per day.
    """
    from dataclasses import replace

    from heliogrid.plans.models import FittedModel, StationModel

    assigned = settled(sampling.assign_folds(labels, folds, seed))
    parts = []
    if isinstance(model, StationModel):
        train = settled(model.training_rows(data, labels).join(assigned, "day"))
        wanted = labels.groupBy("day", "stid").agg(F.first("y").alias("y"))  # other predictions meet no label
        rows = settled(model.predict_rows(data, wanted).join(assigned, "day"))
    for fold in range(folds):
        inside, outside = assigned.where(F.col("fold") == fold), assigned.where(F.col("fold") != fold)
        known = labels.join(outside.select("day"), "day", "left_semi")
        if isinstance(model, StationModel):
            fitted = FittedModel(model, model.estimator.fit(train.where(F.col("fold") != fold).drop("fold")), known)
            parts.append(fitted.predict_rows(rows.where(F.col("fold") == fold).drop("fold")))
        else:
            restrict = lambda days: replace(data, cube=data.cube.join(days.select("day"), "day", "left_semi"))
            parts.append(model.fit(restrict(outside), known).predict(restrict(inside)))
    return mark_imputed(labels).join(union_all(parts), ["day", "stid"]).join(assigned, "day")


# ---------------------------------------------------------------- learning curves


_CURVE = {
    "mae": "abs_error / n",
    "mse": "squared_error / n",
    "rmse": "sqrt(squared_error / n)",
}


def ridge_learning_curve(train: DataFrame, test: DataFrame, keys: list[str], bins: int = 10, repetitions: int = 10, alpha: float = 1.0, normalise: bool = True, score: str = "mae") -> DataFrame:
    """Train and test score per training size: mean and population std over repetitions.

    The training rows are written once with a digest of their keys. A task adds a row to the matrices of all samples it
    belongs to, and scores it by all their models; no sample is written.
    """
    value = _CURVE[score]
    train, test = settled(draws.with_digest(train, keys)), settled(test)
    plan = draws.with_limits(train, sampling.learning_curve_draws(train.count(), bins, repetitions))
    models = solve_table(draws.draw_grams(train, plan), ["draw"], alpha, normalise).collect()  # a model for each size and repetition
    plan = [(m, plan[m["draw"]]) for m in sorted(models, key=lambda m: m["draw"])]
    known = [d for _, d in plan]
    intercepts, coefs = np.array([m["intercept"] for m, _ in plan]), np.array([m["coef"] for m, _ in plan])
    parts = [draws.draw_scores(rows, known, intercepts, coefs, own).select("draw", F.expr(value).alias(name)) for rows, own, name in ((train, True, "train"), (test, False, "test"))]
    tags = train.sparkSession.createDataFrame([(i, m["draw"] // repetitions, d.size) for i, (m, d) in enumerate(plan)], "draw long, size_no int, n_samples long")
    both = parts[0].join(parts[1], "draw").join(F.broadcast(tags), "draw")
    return both.groupBy("size_no", "n_samples").agg(
        F.avg("train").alias("train_mean"),
        F.stddev_pop("train").alias("train_std"),
        F.avg("test").alias("test_mean"),
        F.stddev_pop("test").alias("test_std"),
    )


def learning_curve(
    estimator, train: DataFrame, test: DataFrame, keys: list[str], sizes=None, bins: int = 10, repetitions: int = 10, score: str = "mae"
) -> DataFrame:
    """The same for any estimator with fit and transform, and any list of training sizes.

    Without ``sizes`` the training rows in ``bins`` equal steps. Every (size, repetition) is a fit of its own on a
    sample that a digest of the keys draws; the rows are written once and read by all fits.
    """
    train, test = settled(draws.with_digest(train, keys)), settled(test)
    n = train.count()
    steps = list(sizes) if sizes is not None else [n * (i + 1) // bins for i in range(bins)]
    plan = draws.with_limits(train, [draws.Draw(i * 1000 + j, size) for i, size in enumerate(steps) for j in range(repetitions)])
    value = {"mae": F.col("mae"), "rmse": F.col("rmse"), "mse": F.col("rmse") * F.col("rmse")}[score]
    parts = []
    for i, size in enumerate(steps):
        for j in range(repetitions):
            sample = train.where(draws.is_drawn(plan[i * repetitions + j])).drop(draws.DIGEST)
            fitted = estimator.fit(sample)
            names = [F.lit(i).alias("size_no"), F.lit(size).cast("bigint").alias("n_samples")]
            for rows, name in ((sample, "train"), (test, "test")):
                parts.append(metrics.scores(fitted.transform(rows)).select(*names, F.lit(name).alias("rows"), value.alias("v")))
    every = settled(union_all(parts))
    of = lambda name: F.when(F.col("rows") == name, F.col("v"))
    return every.groupBy("size_no", "n_samples").agg(
        *[f(of(name)).alias(f"{name}_{kind}") for name in ("train", "test") for kind, f in (("mean", F.avg), ("std", F.stddev_pop))]
    )


# ---------------------------------------------------------------- importances and stages


def coefficient_importances(spark, names: list[str], coef: np.ndarray) -> DataFrame:
    """Absolute coefficients by feature name."""
    rows = [(n, float(abs(w))) for n, w in zip(names, coef)]
    return spark.createDataFrame(rows, "feature string, importance double")


def stage_table(spark, train_loss: list[float], test_loss: list[float]) -> DataFrame:
    rows = [(i + 1, float(a), float(b)) for i, (a, b) in enumerate(zip(train_loss, test_loss))]
    return spark.createDataFrame(rows, "stage int, train double, test double")
