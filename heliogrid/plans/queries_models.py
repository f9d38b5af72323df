"""Queries: models and their evaluation.

Tree ensembles run with the tree counts and depths named below, the sizes used
throughout the registered queries; the estimators default to the full sizes.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from heliogrid.operators import boosting, encode, extra_trees, features, labels, metrics, reduce, ridge, sampling, shared_ridge, trees
from heliogrid.operators.blocks import features_array
from heliogrid.plans import evaluation, models
from heliogrid.plans.queries_reduce import station_slots
from heliogrid.plans.queries_spatial import OPS
from heliogrid.plans.queries_tables import OBS_VALUES, daily_obs
from heliogrid.plans.rounding import rounded
from heliogrid.session import settled
from heliogrid.sources import driver_tables as dt
from heliogrid.sources import tables

TREES = {"trees": 8, "depth": 4, "rate": 0.1, "max_features": "all"}
#: A stage is depth + 1 passes over the rows, 0.1 to 0.2 s each however small they are; the reference's 2000 stages of depth 6 would take
#: half an hour a query on the test tables. Rate and stages are scaled together.
BOOSTED = {"trees": 12, "depth": 4, "rate": 0.15, "max_features": 30}
RIDGE = ridge.Ridge(alpha=1.0)


def forecast_data(spark, sf):
    return models.ForecastData(
        dt.nwp(spark, sf), dt.stations(spark, sf), dt.grid(spark), dt.GRID, dt.FEATURES, dt.HOURS, OPS, OPS
    )


def _test_predictions(spark, sf, model):
    return evaluation.train_test(model, forecast_data(spark, sf), dt.energy_nwp(spark, sf)).predictions


def station_rows(spark, sf):
    """(day, stid, features, y): bilinear station features with labels."""
    energy = dt.energy_nwp(spark, sf)
    table = features.station_design(station_slots(spark, sf, energy), dt.stations(spark, sf), dt.FEATURES, dt.HOURS, OPS, with_solar=True)
    return models.packed(table if "y" in table.columns else table.join(energy, ["day", "stid"]), ["day", "stid", "y"])


def station_feature_names(spark, sf):
    table = features.station_design(station_slots(spark, sf), dt.stations(spark, sf), dt.FEATURES, dt.HOURS, OPS, with_solar=True)
    return models.design_names(table, ["day", "stid"])


def obs_rows(spark, sf):
    """(stid, day, features, y): daily observation features with labels, for volume."""
    daily = daily_obs(spark, sf).withColumn("center", F.abs(F.dayofyear("day").cast("double") - 182.625))
    packed = features_array(daily, [*OBS_VALUES, "center"], ["stid", "day"])
    return packed.join(dt.energy(spark, sf), ["stid", "day"])


# ---------------------------------------------------------------- linear models


def ridge_normalised(spark, sf):
    rows = settled(obs_rows(spark, sf))
    fitted = ridge.Ridge(alpha=0.1).fit(rows)
    return rounded(fitted.transform(rows).select("stid", "day", "y", "pred"), digits=4)


def ridge_cv_alpha(spark, sf):
    rows = settled(obs_rows(spark, sf))
    fitted = ridge.RidgeCV().fit(rows)
    return rounded(fitted.transform(rows).select("stid", "day", "y", "pred", F.lit(fitted.alpha).alias("alpha")), digits=4)


def fit_per_station(spark, sf):
    rows = settled(obs_rows(spark, sf))
    fitted = ridge.Ridge(alpha=0.1, by=("stid",)).fit(rows)
    return rounded(fitted.transform(rows).select("stid", "day", "y", "pred"), digits=4)


def day_rows(spark, sf):
    """(day, features): daily means over all stations and the distance from midyear, shared by the stations."""
    daily = dt.obs(spark, sf).groupBy("day").agg(*[F.avg(v).alias(v) for v in OBS_VALUES])
    return features_array(daily.withColumn("center", F.abs(F.dayofyear("day").cast("double") - 182.625)), [*OBS_VALUES, "center"], ["day"])


def ridge_cv_station(spark, sf):
    """Every station's own penalty by leave-one-out errors, and its predictions of the days it has labels for."""
    rows, known = settled(day_rows(spark, sf)), settled(dt.energy(spark, sf))
    fitted = shared_ridge.StationRidge(alphas=ridge.ALPHAS).fit(rows, known)
    pred = fitted.predict_pairs(rows, known)
    return rounded(pred.select("stid", "day", "y", "pred", "alpha", F.sqrt("loo").alias("loo_rmse")), digits=4)


# ---------------------------------------------------------------- trees


def _split_rows(rows):
    """Train and test part of rows written once; the cut is a constant."""
    ready = settled(rows)
    cut = F.lit(evaluation.split_day(ready))
    return ready.where(F.col("day") < cut), ready.where(F.col("day") >= cut)


def _obs_split(spark, sf):
    return _split_rows(obs_rows(spark, sf))


def gbt_lad(spark, sf):
    train, test = _obs_split(spark, sf)
    fitted = boosting.GradientBoosting(loss="absolute", **BOOSTED).fit(train)
    return rounded(fitted.transform(test).select("stid", "day", "y", "pred"), digits=4)


def gbt_huber(spark, sf):
    """Boosted trees on Huber's loss, its cut estimated anew at every stage."""
    train, test = _obs_split(spark, sf)
    fitted = boosting.GradientBoosting(loss="huber", **BOOSTED).fit(train)
    return rounded(fitted.transform(test).select("stid", "day", "y", "pred"), digits=4)


def model_seed_blend(spark, sf):
    """Boosted trees of three seeds, each stage on a draw of the rows, averaged."""
    train, test = _obs_split(spark, sf)
    blend = models.SeedBlend(lambda seed: boosting.GradientBoosting(trees=4, depth=3, rate=0.3, max_features=3, subsample=0.6, seed=seed))
    return rounded(blend.fit(train).transform(test).select("stid", "day", "y", "pred"), digits=4)


def gbt_ls(spark, sf):
    train, test = _obs_split(spark, sf)
    fitted = trees.BoostedTrees(loss="squared", **TREES).fit(train)
    return rounded(fitted.transform(test).select("stid", "day", "y", "pred"), digits=4)


def huber(spark, sf):
    train, test = _obs_split(spark, sf)
    return rounded(trees.Huber().fit(train).transform(test).select("stid", "day", "y", "pred"), digits=4)


def staged_deviance(spark, sf):
    """Mean absolute error of the training and test rows after every stage."""
    train, test = _obs_split(spark, sf)
    fitted = boosting.GradientBoosting(loss="absolute", **BOOSTED).fit(train)
    return evaluation.stage_table(spark, fitted.staged_loss(train), fitted.staged_loss(test))


def feature_importance(spark, sf):
    """Extremely randomised trees, one random feature a node; 40 of the reference's 500 trees, which all grow together."""
    names = station_feature_names(spark, sf)
    fitted = extra_trees.ExtraTrees(trees=40, depth=6, max_features=1).fit(station_rows(spark, sf))
    return metrics.top_features(fitted.importances(names), 50)


def topk_importance(spark, sf):
    """Features by absolute ridge coefficient."""
    fitted = ridge.Ridge(alpha=1.0).fit(station_rows(spark, sf))
    coefs = evaluation.coefficient_importances(spark, station_feature_names(spark, sf), fitted.coef)
    return metrics.top_features(coefs, 50)


# ---------------------------------------------------------------- composed models


def predict_climate(spark, sf):
    energy = sampling.time_split(dt.energy(spark, sf))
    train = energy.where("split = 'train'").drop("split")
    fitted = models.ClimateModel().fit(None, train)
    return rounded(fitted.predict_for(energy.where("split = 'test'")))


def constant_models(spark, sf):
    energy = sampling.time_split(dt.energy(spark, sf))
    train, test = energy.where("split = 'train'"), energy.where("split = 'test'")
    parts = [
        models.constant_prediction(test, train, kind).withColumn("kind", F.lit(kind)) for kind in ("zero", "mean", "median")
    ]
    result = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rounded(result)


def model_baseline(spark, sf):
    return _test_predictions(spark, sf, models.BaselineModel(shared_ridge.StationRidge(alpha=1.0)))


def model_local(spark, sf):
    return rounded(_test_predictions(spark, sf, models.LocalModel(RIDGE, clip=True)), digits=4)


def model_edge(spark, sf):
    return _test_predictions(spark, sf, models.EdgeModel(RIDGE, clip=True))


def model_kriging(spark, sf):
    design = models.StationDesign(with_solar=True)
    return _test_predictions(spark, sf, models.KrigingModel(RIDGE, with_mask=True, design=design))


def model_kriging_gbt(spark, sf):
    """The flagship setting: kriging features, label mask, boosted trees on absolute loss."""
    design = models.StationDesign(with_solar=True)
    return _test_predictions(spark, sf, models.KrigingModel(boosting.GradientBoosting(**BOOSTED), with_mask=True, design=design))


def model_ensemble(spark, sf):
    return _test_predictions(spark, sf, models.EnsembleKrigingModel(RIDGE))


def model_perturbed(spark, sf):
    return _test_predictions(spark, sf, models.PerturbedKrigingModel(RIDGE))


def model_perturbed_predict(spark, sf):
    return _test_predictions(spark, sf, models.PerturbedPredictionKrigingModel(RIDGE))


def model_ensembled_regressor(spark, sf):
    return _test_predictions(spark, sf, models.EnsembledRegressor(shared_ridge.StationRidge(alpha=1.0)))


# ---------------------------------------------------------------- evaluation


def eval_train_test(spark, sf):
    model = models.KrigingModel(RIDGE, with_mask=True, design=models.StationDesign(with_solar=True))
    return rounded(evaluation.train_test(model, forecast_data(spark, sf), dt.energy_nwp(spark, sf)).scores)


def eval_cross_val(spark, sf):
    pairs = evaluation.ridge_out_of_fold(evaluation.with_folds(obs_rows(spark, sf)))
    return rounded(evaluation.score_summary(evaluation.fold_scores(pairs)))


def eval_cross_val_model(spark, sf):
    """Fold MAEs of the local model, fitted anew per fold."""
    pairs = evaluation.cross_val(models.LocalModel(RIDGE), forecast_data(spark, sf), dt.energy_nwp(spark, sf))
    return rounded(evaluation.fold_scores(pairs))


def eval_cross_val_errors(spark, sf):
    """Error breakdown of out-of-fold predictions: absolute error by month, masked labels left out."""
    pairs = evaluation.cross_val(models.LocalModel(RIDGE), forecast_data(spark, sf), dt.energy_nwp(spark, sf))
    return rounded(metrics.ae_by_month(metrics.residuals(pairs)), digits=4)


def eval_fold_scores(spark, sf):
    """Fold MAEs of the climatology."""
    return rounded(evaluation.fold_scores(evaluation.out_of_fold_climatology(dt.energy(spark, sf))))


def eval_learning_curve(spark, sf):
    train, test = _obs_split(spark, sf)
    return rounded(evaluation.ridge_learning_curve(train, test, ["stid", "day"]))


def eval_learning_curve_forest(spark, sf):
    """Learning curve of an estimator without sums: a forest on the later half of the sizes, drawn twice each."""
    train, test = _obs_split(spark, sf)
    n = train.count()
    return rounded(evaluation.learning_curve(trees.Forest(trees=10), train, test, ["stid", "day"], sizes=[n // 2, n], repetitions=2))


def submit(spark, sf):
    """Fits on the labelled days and writes the days of the later half as a wide table of all stations."""
    data, energy = forecast_data(spark, sf), dt.energy_nwp(spark, sf)
    cut = evaluation.split_day(dt.nwp(spark, sf).select("day").distinct())
    places = tables.station_places(dt.stations(spark, sf), dt.WIDE)
    return rounded(evaluation.submit_blocks(models.LocalModel(RIDGE), data, data.since(cut), energy, places, dt.WIDE, scale_labels=True), digits=4)


def eval_scaled_local_gbt(spark, sf):
    """Local design, features and labels standardised on the training days, squared loss."""
    design = models.local_table(forecast_data(spark, sf), pairs=dt.energy_nwp(spark, sf))
    names = [c for c in design.columns if c not in ("day", "stid", "y")]
    train, test = _split_rows(design)
    scale = reduce.label_moments(train)

    def rows(part):
        scaled = reduce.standardise_labels(reduce.standardise(part, train, names), scale)
        return features_array(scaled, names, ["day", "stid", "y"])

    learner = trees.BoostedTrees(loss="squared", trees=8, depth=2, rate=0.1, min_leaf=11, max_features="all", subsample=0.5)
    return rounded(metrics.scores(learner.fit(rows(train)).transform(rows(test))))


def cluster_encode(spark, sf):
    """Standardised features replaced by distances to 50 centres, then boosted trees."""
    daily = settled(daily_obs(spark, sf).join(dt.energy(spark, sf), ["stid", "day"]))
    rows = features_array(reduce.standardise(daily, daily, OBS_VALUES), OBS_VALUES, ["stid", "day"])
    coded = encode.cluster_features(rows, ["stid", "day"], 50)
    train, test = _split_rows(coded.join(daily.select("stid", "day", "y"), ["stid", "day"]))
    learner = trees.BoostedTrees(loss="squared", trees=8, depth=2, rate=0.1, min_leaf=5, max_features="all")
    return rounded(metrics.scores(learner.fit(train).transform(test)))


def climate_scores(spark, sf):
    """Label mask and climatology, scored per label group: the monthly station mean of the training days."""
    energy = sampling.time_split(dt.energy_nwp(spark, sf))
    marked = labels.mark_imputed(energy.drop("split"))
    climate = reduce.climatology(energy.where("split = 'train'").join(labels.drop_masked(marked).select("day", "stid"), ["day", "stid"]))
    tested = sampling.time_split(marked).where("split = 'test'").join(dt.stations(spark, sf).select("stid"), "stid")
    return rounded(metrics.scores_with_mask(reduce.climate_lookup(tested, climate)))


def model_scores(spark, sf):
    """Flagship: cells around every station, calendar and place features, pooled ridge, scored per label group.

    The model is fitted on the earlier half of the labelled days and predicts the later half; labels that were
    filled in are told by the mask.
    """
    marked = labels.mark_imputed(dt.energy_nwp(spark, sf))
    run = evaluation.train_test(models.LocalModel(RIDGE, clip=True), forecast_data(spark, sf), dt.energy_nwp(spark, sf))
    return rounded(metrics.scores_with_mask(metrics.scored_pairs(marked, run.labelled)), digits=4)


QUERIES = {
    f.__name__: f
    for f in (
        ridge_normalised, ridge_cv_alpha, fit_per_station, ridge_cv_station, gbt_lad, gbt_huber, model_seed_blend, gbt_ls, huber, staged_deviance, feature_importance,
        topk_importance, predict_climate, constant_models, model_baseline, model_local, model_edge, model_kriging,
        model_kriging_gbt, model_ensemble, model_perturbed, model_perturbed_predict, model_ensembled_regressor,
        eval_train_test, eval_cross_val, eval_cross_val_model, eval_cross_val_errors, eval_fold_scores, eval_learning_curve, eval_learning_curve_forest, submit, eval_scaled_local_gbt,
        cluster_encode, climate_scores, model_scores,
    )
}
