"""Predictions of the composed models and the scores made of them against plain numpy on their collected designs."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliogrid.operators import interpolate, labels, reduce, shared_ridge
from heliogrid.operators.grid import GridSpec, map_vectors
from heliogrid.plans import evaluation, models, queries_models, queries_spatial
from heliogrid.sources import driver_tables as dt
from tests.test_numeric import direct_ridge

MODELS = {
    "model_edge": lambda: models.EdgeModel(queries_models.RIDGE, clip=True),
    "model_kriging": lambda: models.KrigingModel(queries_models.RIDGE, with_mask=True, design=models.StationDesign(with_solar=True)),
    "model_ensemble": lambda: models.EnsembleKrigingModel(queries_models.RIDGE),
    "model_perturbed": lambda: models.PerturbedKrigingModel(queries_models.RIDGE),
    "model_perturbed_predict": lambda: models.PerturbedPredictionKrigingModel(queries_models.RIDGE),
    "model_local": lambda: models.LocalModel(queries_models.RIDGE, clip=True),
}


@pytest.fixture(scope="module")
def parts(spark, sf):
    data, known = queries_models.forecast_data(spark, sf), dt.energy_nwp(spark, sf)
    cut = evaluation.split_day(known)
    return data.before(cut), data.since(cut), known.where(F.col("day") < F.lit(cut)), cut


def matrix(rows):
    return np.array([[np.nan if v is None else v for v in r["features"]] for r in rows], float)


@pytest.mark.parametrize("name", sorted(MODELS))
def test_predictions_are_those_of_a_plain_ridge(spark, sf, parts, name):
    before, since, known, cut = parts
    model = MODELS[name]()
    train = model.training_rows(before, known).collect()
    x, y = matrix(train), np.array([r["y"] for r in train], float)
    whole = ~np.isnan(x).any(axis=1)
    b, w = direct_ridge(x[whole], y[whole], queries_models.RIDGE.alpha)
    sums = {}
    for r, v in zip(rows := model.predict_rows(since).collect(), b + matrix(rows) @ w):
        if not np.isnan(v):
            sums.setdefault((r["day"], r["stid"]), []).append(v)
    want = {k: np.mean(v) for k, v in sums.items()}
    if model.clip:
        lo, hi = min(r["y"] for r in known.collect()), max(r["y"] for r in known.collect())
        want = {k: min(max(v, lo), hi) for k, v in want.items()}
    got = {(r["day"], r["stid"]): r["pred"] for r in queries_models.QUERIES[name](spark, sf).collect()}
    assert {k for k, v in got.items() if v is not None} == set(want) and len(want) > 20
    assert all(v == pytest.approx(got[k], abs=2e-3, rel=1e-5) for k, v in want.items())


def test_training_labels_of_the_masked_model(spark, parts):
    """The kriging model learns from labels that weren't filled in only."""
    before, _, known, _ = parts
    used = {(r["day"], r["stid"]) for r in MODELS["model_kriging"]().training_rows(before, known).select("day", "stid").collect()}
    clean = {(r["day"], r["stid"]) for r in labels.mark_imputed(known).collect() if not r["is_masked"]}
    days = {r["day"] for r in before.cube.select("day").distinct().collect()}
    assert used == {k for k in clean if k[0] in days} and len(used) < known.count()


def test_scores_of_the_train_test_run(spark, sf, parts):
    cut = parts[3]
    known = dt.energy_nwp(spark, sf)
    pred = {(r["day"], r["stid"]): r["pred"] for r in queries_models.model_kriging(spark, sf).collect()}
    marked = labels.mark_imputed(known.where(F.col("day") >= F.lit(cut))).collect()
    pairs = [(r["y"], pred[r["day"], r["stid"]], r["is_masked"]) for r in marked if pred.get((r["day"], r["stid"])) is not None]
    for r in queries_models.eval_train_test(spark, sf).collect():
        y, p = (np.array(v) for v in zip(*[(a, b) for a, b, m in pairs if r["samples"] == "all" or not m]))
        assert r["n"] == len(y) and r["mae"] == pytest.approx(np.abs(y - p).mean(), rel=1e-6)
        assert r["rmse"] == pytest.approx(np.sqrt(((y - p) ** 2).mean()), rel=1e-6)
        assert r["r2"] == pytest.approx(1 - ((y - p) ** 2).sum() / (len(y) * y.var()), abs=1e-5)


def test_importances_by_coefficient(spark, sf):
    rows = queries_models.station_rows(spark, sf).collect()
    x, y = matrix(rows), np.array([r["y"] for r in rows], float)
    whole = ~np.isnan(x).any(axis=1)
    _, w = direct_ridge(x[whole], y[whole], 1.0)
    names = queries_models.station_feature_names(spark, sf)
    want = dict(zip(names, np.abs(w) / np.abs(w).max()))
    got = queries_models.topk_importance(spark, sf).collect()
    column = next(c for c in got[0].asDict() if c not in ("feature", "rank"))
    top = sorted(want, key=lambda n: (-want[n], n))[:50]
    assert {r["feature"] for r in got} == set(top)
    scale = max(r[column] for r in got)
    assert all(r[column] / scale == pytest.approx(want[r["feature"]], rel=1e-5, abs=1e-9) for r in got)


def test_kriged_values_and_sigmas(spark, sf):
    """Every map's own Gaussian process from the definition, with the members' spread as nugget."""
    cells = interpolate.grid_coordinates(dt.grid(spark), dt.GRID)
    z = (cells - cells.mean(axis=0)) / cells.std(axis=0)
    correlate = lambda a, b: np.exp(-(((a[:, None] - b[None]) ** 2) * np.asarray(interpolate.KRIGING_THETA)).sum(axis=2))
    stations = dt.stations(spark, sf).orderBy("stid").collect()
    near = correlate((np.array([[s["elon"], s["nlat"], s["elev"]] for s in stations]) - cells.mean(axis=0)) / cells.std(axis=0), z)
    stats = reduce.ensemble_stats(dt.nwp(spark, sf))
    maps = map_vectors(stats, ["day", "fx", "hour"], dt.GRID, ("mean", "std"), ("mean", "std")).orderBy("day", "fx", "hour").limit(8).collect()
    got = {(r["day"], r["fx"], r["hour"], r["stid"]): r for r in queries_spatial.interp_kriging(spark, sf).collect()}
    for m in maps:
        mean, std = np.array(m["mean"]), np.array(m["std"])
        a = correlate(z, z) + np.diag((std / mean) ** 2)
        inverse, ones = np.linalg.inv(a), np.ones(64)
        y = (mean - mean.mean()) / mean.std()
        beta = ones @ inverse @ y / (ones @ inverse @ ones)
        variance = (y - beta) @ inverse @ (y - beta) / 64 * mean.var()
        for s, c in zip(stations, near):
            value = mean.mean() + mean.std() * (beta + c @ inverse @ (y - beta))
            mse = variance * (1 - c @ inverse @ c + (1 - ones @ inverse @ c) ** 2 / (ones @ inverse @ ones))
            r = got[m["day"], m["fx"], m["hour"], s["stid"]]
            assert r["value"] == pytest.approx(value, rel=1e-6, abs=1e-6) and r["sigma"] == pytest.approx(np.sqrt(max(mse, 0)), rel=1e-5, abs=1e-6)


def test_blend_is_the_mean_of_its_seeds(spark):
    from heliogrid.operators.boosting import GradientBoosting
    from tests.test_boosting import problem, rows

    x, y = problem(200, 8)
    learner = lambda seed: GradientBoosting(trees=2, depth=2, rate=0.5, max_features=2, subsample=0.5, seed=seed)
    df = rows(spark, x, y)
    got = {r["id"]: r["pred"] for r in models.SeedBlend(learner, (1, 5)).fit(df).transform(df).collect()}
    each = [learner(s).fit(df).predict(x) for s in (1, 5)]
    assert not np.allclose(*each) and np.allclose([got[i] for i in range(200)], np.mean(each, axis=0))


def test_cross_validation_of_other_models(spark, sf):
    """A model that isn't made of station rows goes through the same folds."""
    data, known = queries_models.forecast_data(spark, sf), dt.energy_nwp(spark, sf)
    from heliogrid.operators.shared_ridge import StationRidge

    pairs = evaluation.cross_val(models.BaselineModel(StationRidge(alpha=1.0)), data, known, folds=2).collect()
    assert pairs and {r["fold"] for r in pairs} == {0, 1} and {"is_masked", "pred", "y"} <= set(pairs[0].asDict())


def test_member_examples_are_averaged_and_clipped(spark):
    """Year, distance from midyear and all cells of a member; the labels of the later days are far from those learned from."""
    rng = np.random.default_rng(5)
    days = [datetime.date(1999 + i % 3, 1 + i % 12, 3 + i // 12) for i in range(40)]
    cube = [(d, "f0", e, 0, i, j, float(rng.normal() + 4 * (d.year - 2000))) for d in days for e in (0, 1) for i in range(2) for j in range(2)]
    cells = {}
    for d, _, e, _, i, j, v in cube:
        cells.setdefault((d, e), {})[i, j] = v
    spec = GridSpec.of([31, 32], [-106, -105])
    table = spark.createDataFrame(cube, "day date, fx string, ens int, hour int, lat_i int, lon_i int, value double")
    data = models.ForecastData(table, None, None, spec, ("f0",), (0,))
    features = {
        (d, e): [v for _, v in sorted(c.items())] + [float(d.year), abs(d.timetuple().tm_yday - 182.625)] for (d, e), c in cells.items()
    }
    rows = {(r["day"], r["ens"]): r["features"] for r in models.member_rows(data).collect()}
    assert rows == {k: pytest.approx(v) for k, v in features.items()}
    train = sorted(days)[:25]
    known = {(s, d): float(3 * (d.year - 1999) + s * rng.normal()) for s in (1, 2) for d in train}
    labels_of = spark.createDataFrame([(s, d, y) for (s, d), y in known.items()], "stid long, day date, y double")
    fitted = models.EnsembledRegressor(shared_ridge.StationRidge(alpha=0.1)).fit(data.days(F.col("day") <= F.lit(train[-1])), labels_of)
    got = {(r["stid"], r["day"]): r["pred"] for r in fitted.predict(data).collect()}
    lo, hi = min(known.values()), max(known.values())
    raw = {}
    for s in (1, 2):
        keys = [(d, e) for d in train for e in (0, 1)]
        b, w = direct_ridge(np.array([features[k] for k in keys]), np.array([known[s, d] for d, _ in keys]), 0.1)
        raw |= {(s, d): np.mean([b + np.array(features[d, e]) @ w for e in (0, 1)]) for d in days}
    assert any(v > hi or v < lo for v in raw.values())
    assert got == {k: pytest.approx(min(max(v, lo), hi), abs=1e-6) for k, v in raw.items()}


def test_the_query_of_member_examples_is_clipped(spark, sf, parts):
    known = parts[2]
    lo, hi = known.agg(F.min("y"), F.max("y")).first()
    preds = [r["pred"] for r in queries_models.QUERIES["model_ensembled_regressor"](spark, sf).collect()]
    assert preds and all(lo <= v <= hi for v in preds)
