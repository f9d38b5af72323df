"""Operators without an SQL twin against plain numpy, and properties."""

import datetime as dtm
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliogrid.functions import solar
from heliogrid.functions.expressions import feature_op, power, ratio
from heliogrid.operators import encode, features, grid, interpolate, joins, labels, metrics, reduce, ridge, sampling, sun
from heliogrid.operators.perturb import perturb_stations
from heliogrid.plans import evaluation, models
from heliogrid.sources import driver_tables as dt

SPEC = dt.GRID
LAT, LON = np.meshgrid(SPEC.lats, SPEC.lons, indexing="ij")


def cube_of(spark, maps, day=dtm.date(1994, 1, 1)):
    """Cube with one member per given 8 x 8 array."""
    rows = [
        (day, "f0", e, 0, i, j, float(v))
        for e, m in enumerate(maps)
        for i, row in enumerate(m)
        for j, v in enumerate(row)
    ]
    return spark.createDataFrame(rows, "day date, fx string, ens int, hour int, lat_i int, lon_i int, value double")


def points_of(spark, points):
    rows = [(i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(points)]
    return spark.createDataFrame(rows, "stid bigint, nlat double, elon double, elev double")


POINTS = [(31.5, -105.5, 200.0), (34.0, -103.25, 500.0), (37.9, -99.1, 900.0), (33.3, -101.0, 120.0)]


def by_station(df, column="value"):
    return np.array([r[column] for r in df.orderBy("stid").collect()], dtype=float)


# ---------------------------------------------------------------- expressions


def test_ratio_and_power_edges(spark):
    rows = [(0.0, 0.0), (2.0, 0.0), (-2.0, 0.0), (None, 0.0), (1.0, None), (6.0, 3.0)]
    df = spark.createDataFrame(rows, "l double, r double")
    got = [r["v"] for r in df.select(ratio(F.col("l"), F.col("r")).alias("v")).collect()]
    assert got == [0.0, 1e15, 1e15, None, None, 2.0]
    got = [r["v"] for r in df.select(power(F.col("l"), 0.5).alias("v")).collect()]
    assert got[2] is None and got[1] == pytest.approx(math.sqrt(2))
    with pytest.raises(ValueError):
        feature_op(F.col("l"), "+", F.col("r"))


# ---------------------------------------------------------------- interpolation


def test_spline_weights_reproduce_cubics_and_sum_to_one():
    axis = np.array([0.0, 1.0, 2.5, 4.0, 5.0, 7.0])
    x = np.linspace(-1, 8, 37)
    w = interpolate.not_a_knot_weights(axis, x)
    inside = np.clip(x, 0, 7)
    for p in range(4):
        assert np.allclose(w @ axis**p, inside**p, atol=1e-9)
    assert np.allclose(w[np.searchsorted(x, 0.0)] @ np.eye(6)[0], 1.0)
    with pytest.raises(ValueError):
        interpolate.not_a_knot_weights(axis[:3], x)


@pytest.mark.parametrize("kind", ["spline", "bilinear", "ridge"])
def test_interpolators_reproduce_planes(spark, kind):
    plane = 2.0 + 0.5 * LAT - 0.25 * LON
    cube = cube_of(spark, [plane]).drop("ens")
    stations = points_of(spark, POINTS)
    if kind == "spline":
        out = interpolate.interpolate_spline(cube, stations, SPEC)
    elif kind == "bilinear":
        out = grid.interpolate_bilinear(cube, stations, SPEC)
    else:
        out = interpolate.interpolate_ridge(cube, stations, SPEC, dt.grid(spark), alpha=1e-10)
    want = [2.0 + 0.5 * a - 0.25 * b for a, b, _ in POINTS]
    assert np.allclose(by_station(out), want, atol=1e-6)


def test_bilinear_outside_gridline_and_missing_cells(spark):
    m = np.arange(64.0).reshape(8, 8)
    cube = cube_of(spark, [m]).drop("ens")
    stations = points_of(spark, [(31.0, -106.0, 0), (38.0, -99.0, 0), (30.9, -100.0, 0), (34.0, -103.0, 0), (38.1, -100.0, 0)])
    got = [r["value"] for r in grid.interpolate_bilinear(cube, stations, SPEC).orderBy("stid").collect()]
    assert got == [0.0, 63.0, None, 27.0, None]
    holed = cube.where("not (lat_i = 3 and lon_i = 3)")
    got = [r["value"] for r in grid.interpolate_bilinear(holed, points_of(spark, [(34.5, -102.5, 0), (31.5, -105.5, 0)]), SPEC).orderBy("stid").collect()]
    assert got == [None, 4.5]
    spline = interpolate.interpolate_spline(holed, points_of(spark, [(31.0, -106.0, 0)]), SPEC).first()["value"]
    assert spline is None or abs(spline) < 1e-9


def dense_kriging(cells, at, y, nugget, theta):
    """Ordinary kriging by one dense solve."""
    m, s = cells.mean(0), cells.std(0)
    c, p = (cells - m) / s, (at - m) / s
    corr = lambda a, b: np.exp(-((a[:, None] - b[None]) ** 2 @ np.asarray(theta)))
    ys = y.std() or 1.0
    z = (y - y.mean()) / ys
    inverse = np.linalg.inv(corr(c, c) + np.diag(nugget))
    near, one = corr(p, c), np.ones(len(c))
    beta = one @ inverse @ z / (one @ inverse @ one)
    rest = z - beta
    mean = beta + near @ inverse @ rest
    sigma2 = rest @ inverse @ rest / len(c) * ys**2
    u = near @ inverse @ one - 1
    mse = sigma2 * (1 - np.einsum("pc,cd,pd->p", near, inverse, near) + u**2 / (one @ inverse @ one))
    return y.mean() + ys * mean, np.sqrt(np.maximum(mse, 0))


def test_kriging_equals_dense_solve_on_both_paths(spark):
    rng = np.random.default_rng(0)
    maps = rng.normal(3.0, 1.0, size=(4, 8, 8))
    stations, cells = points_of(spark, POINTS), interpolate.grid_coordinates(dt.grid(spark), SPEC)
    mean, std = maps.mean(0).ravel(), maps.std(0).ravel()
    at = np.array([(b, a, c) for a, b, c in POINTS])
    want, sigma = dense_kriging(cells, at, mean, (std / mean) ** 2, interpolate.KRIGING_THETA)
    for limit in (100, 2):  # two points at most: the points meet the maps in blocks
        out = interpolate.interpolate_kriging(cube_of(spark, maps), stations, SPEC, dt.grid(spark), max_points=limit)
        assert np.allclose(by_station(out), want, atol=1e-8)
        assert np.allclose(by_station(out, "sigma"), sigma, atol=1e-8)


def test_kriging_of_constant_and_zero_mean_maps(spark):
    stations = points_of(spark, POINTS)
    out = interpolate.interpolate_kriging(cube_of(spark, [np.full((8, 8), 5.0)] * 2), stations, SPEC, dt.grid(spark))
    assert np.allclose(by_station(out), 5.0) and np.allclose(by_station(out, "sigma"), 0.0)
    opposite = cube_of(spark, [np.ones((8, 8)), -np.ones((8, 8))])
    nugget = interpolate.kriging_nugget(reduce.ensemble_stats(opposite)).select("nugget").distinct().collect()
    assert [r["nugget"] for r in nugget] == [interpolate.FLOOR_NUGGET]


def test_kriging_weights_are_exact_at_cells():
    cells = np.column_stack([LON.ravel(), LAT.ravel(), np.linspace(100, 900, 64)])
    weights = interpolate.kriging_weights(cells, (10.0, 10.0, 10.0))
    w = weights({"elon": cells[:5, 0], "nlat": cells[:5, 1], "elev": cells[:5, 2]})
    assert np.allclose(w, np.eye(64)[:5], atol=1e-6)


def test_filters_and_zoom_against_numpy(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(8, 8))
    points, w = interpolate.window_points(SPEC, interpolate.box_kernel(5), 2, 2, skip_last_col=True)
    valid = np.array([[m[i : i + 5, j : j + 5].mean() for j in range(4)] for i in range(4)])
    assert np.allclose(w @ m.ravel(), valid[::2, :-1:2].ravel())
    assert list(zip(points["row"], points["col"])) == [(0, 0), (0, 2), (2, 0), (2, 2)]
    _, w = interpolate.zoom_points(SPEC, 0.25)
    assert np.allclose(w @ m.ravel(), m[[0, 0, 7, 7], [0, 7, 0, 7]])
    w = interpolate.zoom_axis_weights(8, 0.5)
    assert w.shape == (4, 8) and np.allclose(w.sum(1), 1.0) and np.allclose(w[0], np.eye(8)[0])
    holed = cube_of(spark, [m]).drop("ens", "hour").where("not (lat_i = 0 and lon_i = 0)")
    vectors = grid.map_vectors(holed, ["day", "fx"], SPEC)
    points, w = interpolate.window_points(SPEC, interpolate.ring_kernel())
    out = interpolate.at_points(vectors, ["day", "fx"], points, ["row", "col"], interpolate.LinearKernel(w))
    got = {(r["row"], r["col"]): r["value"] for r in out.collect()}
    assert got[(0, 0)] is None and len(got) == 36
    assert got[(1, 1)] == pytest.approx((m[1:4, 1:4].sum() - m[2, 2]) / 8)


def test_perturbed_copies_are_seeded_and_copy_zero_exact(spark):
    stations = points_of(spark, POINTS)
    a = {(r["stid"], r["copy"]): r for r in perturb_stations(stations).collect()}
    b = {(r["stid"], r["copy"]): r for r in perturb_stations(stations.repartition(3)).collect()}
    assert a == b and len(a) == 16
    assert all(a[(i, 0)]["nlat"] == p[0] for i, p in enumerate(POINTS))
    assert all(a[(i, 1)]["nlat"] != p[0] for i, p in enumerate(POINTS))
    still = perturb_stations(stations, damping={"nlat": 0.0, "elon": 0.0, "elev": 0.0})
    assert still.where("copy > 0").select("nlat").distinct().count() == 4


def test_hash_normals_are_standard(spark):
    from heliogrid.functions.hashing import normal, uniform

    row = spark.range(20000).select(normal(F.col("id"), 7).alias("z"), uniform(F.col("id"), 7).alias("u"))
    got = row.agg(F.avg("z"), F.stddev_pop("z"), F.avg("u")).first()
    assert abs(got[0]) < 0.03 and abs(got[1] - 1) < 0.03 and abs(got[2] - 0.5) < 0.01


# ---------------------------------------------------------------- joins and windows


def test_both_join_paths_agree(spark, sf):
    means = reduce.reduce_axis(dt.nwp(spark, sf), "ens", "mean")
    cells = grid.corner_cells(dt.stations(spark, sf), SPEC)
    small = grid.cells_to_stations(means, cells)
    salted = grid.cells_to_stations(means, cells, max_rows=3)
    assert "_salt" not in salted.columns
    assert small.exceptAll(salted).isEmpty() and salted.exceptAll(small).isEmpty()


def test_spline_blocks_equal_small_path(spark, sf):
    cube = reduce.reduce_axis(dt.nwp(spark, sf), "ens", "mean")
    one = interpolate.interpolate_spline(cube, dt.stations(spark, sf), SPEC)
    many = interpolate.interpolate_spline(cube, dt.stations(spark, sf), SPEC, max_points=2)
    both = one.join(many.withColumnRenamed("value", "other"), ["day", "fx", "hour", "stid"])
    assert both.count() == one.count() == many.count()
    assert both.agg(F.max(F.abs(F.col("value") - F.col("other")))).first()[0] < 1e-9


def test_pair_up_is_the_whole_product(spark):
    a, b = spark.range(37).select(F.col("id").alias("x")), spark.range(11).select(F.col("id").alias("y"))
    for spread in (False, True):
        pairs = joins.pair_up(a, b, spread_left=spread)
        assert pairs.count() == 37 * 11 == pairs.distinct().count()


def series(spark, rows):
    return spark.createDataFrame([(s, dtm.date.fromisoformat(d), y) for s, d, y in rows], "stid bigint, day date, y double")


def test_imputed_labels_across_years_and_gaps(spark):
    df = series(
        spark,
        [
            (0, "1999-12-30", 100.0), (0, "1999-12-31", 200.0), (0, "2000-01-01", 200.0), (0, "2003-05-01", 200.0),
            (0, "2003-05-02", 250.0), (0, "2003-05-03", None), (0, "2003-05-04", 300.0), (1, "2001-01-01", 300.0),
        ],
    )
    got = {(r["stid"], str(r["day"])): r["is_masked"] for r in labels.mark_imputed(df).collect()}
    assert [got[k] for k in sorted(got)] == [False, False, True, True, True, True, False, False]


def test_history_keeps_first_value_and_matches_one_window(spark, sf):
    daily = dt.energy(spark, sf)
    from pyspark.sql import Window

    plain = daily.withColumn("p", F.lag("y").over(Window.partitionBy("stid").orderBy("day")))
    chunked = labels.previous_values(daily, ["stid"], ["y"])
    both = plain.join(chunked, ["stid", "day", "y"])
    assert both.count() == daily.count()
    assert both.where(~F.col("p").eqNullSafe(F.col("prev_y"))).isEmpty()
    first = labels.with_history(series(spark, [(0, "2000-01-01", 7.0)]), ["stid"], ["y"], "_t-1").first()
    assert first["y_t-1"] == 7.0


# ---------------------------------------------------------------- samples


def test_take_by_digest_is_exact_and_partition_free(spark):
    df = spark.range(5000).select("id", (F.col("id") % 3).alias("g"))
    for digits in (1, 3):
        one = sampling.take_by_digest(df, ["id"], F.lit(777), ["g"], seed=4, digits=digits)
        two = sampling.take_by_digest(df.repartition(13), ["id"], F.lit(777), ["g"], seed=4, digits=4)
        assert {r["g"]: r["count"] for r in one.groupBy("g").count().collect()} == {0: 777, 1: 777, 2: 777}
        assert one.exceptAll(two).isEmpty()
    assert sampling.subsample(df, ["id"], n=9000).count() == 5000


def test_folds_partition_days(spark, sf):
    folds = sampling.assign_folds(dt.energy(spark, sf))
    sizes = [r["count"] for r in folds.groupBy("fold").count().collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1
    assert folds.select("day").distinct().count() == folds.count()


# ---------------------------------------------------------------- linear models


@pytest.fixture(scope="module")
def problem():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 5)) * [1, 10, 0.1, 1, 1] + [0, 100, 3, 0, 0]
    x[:, 4] = 2.5  # constant feature
    y = x[:, 0] * 2 - 0.3 * x[:, 1] + rng.normal(size=200) + 7
    return x, y


def rows_of(spark, x, y, keys=None):
    keys = np.arange(len(y)) % 3 if keys is None else keys
    data = [(i, int(k), [float(v) for v in r], float(t)) for i, (k, r, t) in enumerate(zip(keys, x, y))]
    return spark.createDataFrame(data, "id int, key int, features array<double>, y double").repartition(5)


def direct_ridge(x, y, alpha, normalise=True):
    c = x - x.mean(0)
    s = np.sqrt((c**2).sum(0)) if normalise else np.ones(x.shape[1])
    s[s < 1e-9] = 1.0
    w = np.linalg.solve((c / s).T @ (c / s) + alpha * np.eye(x.shape[1]), (c / s).T @ (y - y.mean())) / s
    return y.mean() - x.mean(0) @ w, w


@pytest.mark.parametrize("normalise", [True, False])
def test_ridge_equals_normal_equations(spark, problem, normalise):
    x, y = problem
    fitted = ridge.Ridge(0.3, normalise).fit(rows_of(spark, x, y))
    b, w = direct_ridge(x, y, 0.3, normalise)
    assert fitted.intercept == pytest.approx(b, abs=1e-6) and np.allclose(fitted.coef, w, atol=1e-7)
    got = {r["id"]: r["pred"] for r in fitted.transform(rows_of(spark, x, y)).collect()}
    assert np.allclose([got[i] for i in range(len(y))], b + x @ w)


def test_ridge_per_key(spark, problem):
    x, y = problem
    keys = np.where(np.arange(200) < 150, 0, 1 + np.arange(200) % 2)  # one hot key
    fitted = ridge.Ridge(0.1, by=("key",)).fit(rows_of(spark, x, y, keys))
    for r in fitted.models.collect():
        b, w = direct_ridge(x[keys == r["key"]], y[keys == r["key"]], 0.1)
        assert r["intercept"] == pytest.approx(b, abs=1e-6) and np.allclose(r["coef"], w, atol=1e-6)


def test_ridge_with_many_keys(spark):
    rng = np.random.default_rng(3)
    n = 900
    x, keys = rng.normal(size=(n, 2)), np.arange(n) % 300
    y = x[:, 0] * keys
    models_by_key = {r["key"]: r["coef"] for r in ridge.Ridge(1e-9, by=("key",)).fit(rows_of(spark, x, y, keys)).models.collect()}
    assert len(models_by_key) == 300
    for k in (0, 7, 299):
        assert np.allclose(models_by_key[k], direct_ridge(x[keys == k], y[keys == k], 1e-9)[1], atol=1e-4)


def test_ridge_cv_picks_least_loo_error(spark, problem):
    x, y = problem
    alphas = (1e-3, 1e-1, 1.0, 100.0)
    rows = rows_of(spark, x, y)
    got = ridge.RidgeCV(alphas).scores(rows, ridge.gram_table(rows))
    c = x - x.mean(0)
    s = np.sqrt((c**2).sum(0))
    s[s < 1e-9] = 1.0
    z = c / s
    for a in alphas:
        hat = z @ np.linalg.solve(z.T @ z + a * np.eye(5), z.T)
        loo = (y - y.mean() - hat @ (y - y.mean())) / (1 - np.diag(hat))
        assert got[a] == pytest.approx((loo**2).mean(), rel=1e-6)
    assert ridge.RidgeCV(alphas).fit(rows).alpha == min(got, key=got.get)


def test_fold_models_leave_their_fold_out(spark, problem):
    x, y = problem
    folds = np.arange(200) % 5
    rows = rows_of(spark, x, y, folds).withColumnRenamed("key", "fold")
    found = evaluation.ridge_fold_models(rows, 0.2).collect()
    assert len(found) == 5
    for r in found:
        want = direct_ridge(x[folds != r["fold"]], y[folds != r["fold"]], 0.2)
        assert r["intercept"] == pytest.approx(want[0], abs=1e-6) and np.allclose(r["coef"], want[1], atol=1e-7)


def test_learning_curve_scores(spark, problem):
    x, y = problem
    rows = rows_of(spark, x, y)
    out = evaluation.ridge_learning_curve(rows, rows, ["id"], bins=2, repetitions=2, alpha=0.1).collect()
    got = {r["size_no"]: r for r in out}
    assert got[1]["n_samples"] == 200 and got[0]["n_samples"] == 100
    b, w = direct_ridge(x, y, 0.1)
    assert got[1]["test_mean"] == pytest.approx(np.abs(y - b - x @ w).mean(), rel=1e-6)
    assert got[1]["test_std"] == pytest.approx(0.0, abs=1e-9) and got[0]["test_std"] > 0


# ---------------------------------------------------------------- encoders and models


def test_kmeans_distances_point_to_the_prediction(spark, sf):
    maps = encode.one_feature(dt.nwp(spark, sf), "f0", hour_mean=True)
    vectors = encode.complete_vectors(encode.standardise_cells(maps), SPEC)
    centres = encode.fit_centres(vectors, "cells", 4)
    table = encode.centre_distances(vectors, ["day", "ens"], centres)
    got = {(r["day"], r["ens"], r["code"]): r["distance"] for r in table.collect()}
    for r in vectors.collect():
        want = np.linalg.norm(np.array(r["cells"]) - centres, axis=1)
        assert np.allclose([got[(r["day"], r["ens"], c)] for c in range(4)], want)


def test_mixture_posteriors_sum_to_one(spark, sf):
    out = encode.encode_mixture(encode.one_feature(dt.nwp(spark, sf), "f0"), SPEC, k=3, dims=2, iterations=5)
    sums = out.groupBy("day", "ens", "hour").agg(F.sum("probability").alias("s"))
    assert sums.where(F.abs(F.col("s") - 1) > 1e-6).isEmpty()


def test_models_registry_and_predictions(spark, sf):
    assert set(models.MODELS) == {
        "baseline", "local", "kriging", "kringing", "ensemble_kriging", "perturbed_kriging", "perturbed_pred_kriging", "edgelocal",
    }
    from heliogrid.plans.queries_models import RIDGE, forecast_data

    data, energy = forecast_data(spark, sf), dt.energy_nwp(spark, sf)
    model = models.LocalModel(RIDGE, clip=True)
    run = evaluation.train_test(model, data, energy)
    cut = evaluation.split_day(energy)
    assert run.predictions.where(F.col("day") < F.lit(cut)).isEmpty()
    low, high = energy.where(F.col("day") < F.lit(cut)).agg(F.min("y"), F.max("y")).first()
    assert run.predictions.where((F.col("pred") < low) | (F.col("pred") > high)).isEmpty()
    names = model.feature_names(data)
    rows = model.training_rows(data.before(cut), energy).collect()
    x, y = np.array([r["features"] for r in rows]), np.array([r["y"] for r in rows])
    b, w = direct_ridge(x, y, RIDGE.alpha)
    fitted = model.fit(data.before(cut), energy)
    assert len(names) == x.shape[1] and np.allclose(fitted.estimator.coef, w, atol=1e-5)
    pairs = run.pairs.collect()
    error = np.array([r["y"] - r["pred"] for r in pairs])
    scores = {r["samples"]: r for r in run.scores.collect()}
    assert scores["all"]["mae"] == pytest.approx(np.abs(error).mean()) and scores["all"]["n"] == len(pairs)
    clean = [r for r in pairs if not r["is_masked"]]
    assert scores["unmasked"]["n"] == len(clean)
    assert run.residuals().where("residual is null").count() == len(pairs) - len(clean)


def test_boosting_lowers_the_loss(spark, problem):
    from heliogrid.operators.trees import BoostedTrees

    x, y = problem
    rows = rows_of(spark, x, y)
    fitted = BoostedTrees(loss="absolute", trees=5, depth=3, rate=0.3, max_features="all", min_leaf=5).fit(rows)
    losses = fitted.staged_loss(rows, "absolute")
    assert len(losses) == 5 and losses[-1] < losses[0]
    gap = spark.createDataFrame([(1, [1.0, None, 1.0, 1.0, 1.0])], "id int, features array<double>")
    assert fitted.transform(gap).first()["pred"] is None


def test_edge_rows_of_missing_member(spark):
    """Member statistics use the members present."""
    cube = cube_of(spark, [np.full((8, 8), 1.0), np.full((8, 8), 3.0)]).where("not (ens = 1 and lat_i = 3 and lon_i = 3)")
    stations = points_of(spark, [(34.5, -102.5, 0)])  # corner 3 is cell (3, 3)
    out = features.edge_features(cube, stations, dt.grid(spark), SPEC, ["f0"], [0]).collect()
    got = {r["corner"]: (r["nm_mean_f0_0"], r["nm_std_f0_0"]) for r in out}
    assert got[3] == (1.0, 0.0) and got[0] == (2.0, 1.0)


def test_border_windows_give_null(spark):
    cube = cube_of(spark, [np.ones((8, 8))])
    row = features.local_features(cube, points_of(spark, [(31.5, -105.5, 0)]), SPEC, ["f0"], k=2).first()
    assert row["nm_f0_0_0"] is None and row["nm_f0_1_1"] == 1.0


# ---------------------------------------------------------------- sun


def test_sun_times(spark):
    days = spark.createDataFrame([(dtm.date(2000, 2, 29),), (dtm.date(2007, 6, 21),), (dtm.date(2007, 12, 21),)], "day date")
    out = sun.sunrise_sunset(days, points_of(spark, [(0.0, 0.0, 0), (80.0, 0.0, 0), (35.0, -98.0, 0)])).collect()
    got = {(r["day"], r["stid"]): r for r in out}
    for r in out:
        if r["sunrise"] is not None:
            assert r["sunrise"] + r["sunset"] == pytest.approx(2 * r["noon"])
            assert r["day_length"] == pytest.approx(r["sunset"] - r["sunrise"])
    assert all(abs(got[(d["day"], 0)]["day_length"] - 727) < 2 for d in days.collect())
    assert got[(dtm.date(2007, 6, 21), 1)]["sunrise"] is None and got[(dtm.date(2007, 12, 21), 1)]["sunrise"] is None
    assert got[(dtm.date(2007, 6, 21), 2)]["day_length"] > got[(dtm.date(2007, 12, 21), 2)]["day_length"] + 250


def test_julian_day(spark):
    stamps = ["2000-01-01 12:00:00", "1994-01-01 00:00:00", "2004-02-29 06:00:00", "1987-06-19 12:00:00"]
    df = spark.createDataFrame([(s,) for s in stamps], "s string").select(F.col("s").cast("timestamp").alias("ts"))
    got = [r["jd"] for r in df.select(solar.julian_day(F.col("ts")).alias("jd")).collect()]
    assert np.allclose(got, [2451545.0, 2449353.5, 2453064.75, 2446966.0], atol=1e-6)


def test_terminator_crosses_where_the_sun_is_at_the_horizon(spark):
    days = spark.createDataFrame([(dtm.date(2007, 3, 21),)], "day date")
    raster = sun.terminator_raster(days, (-60.0, 60.0), (-180.0, 180.0))
    assert raster.count() == 2500
    lines = sun.terminator(raster).collect()
    assert {r["side"] for r in lines} == {"falling", "rising"}
    # at midnight UTC of an equinox the horizon runs near 90 degrees east and west
    assert all(abs(abs(r["lon"]) - 90) < 8 for r in lines if abs(r["lat"]) < 40)


# ---------------------------------------------------------------- metrics


def test_scores_and_ties(spark):
    rows = [(10.0, 12.0), (10.0, 10.0), (10.0, 7.0), (20.0, 25.0)]
    pairs = spark.createDataFrame(rows, "y double, pred double")
    over = metrics.mae_over_under(pairs).first()
    assert over["upper_mae"] == pytest.approx(3.5) and over["lower_mae"] == pytest.approx(1.5)
    y, p = np.array(rows).T
    s = metrics.scores(pairs).first()
    assert s["r2"] == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())


def test_histogram_counts_every_value(spark):
    df = spark.range(101).select((F.col("id") / 10).alias("v"))
    out = reduce.histogram(df, "v", 10).orderBy("bin").collect()
    want, _ = np.histogram(np.arange(101) / 10, bins=10)
    assert sum(r["n"] for r in out) == 101 and [r["n"] for r in out][-1] == want[-1] == 11


def test_missing_member_two_step_means_differ(spark):
    rows = [(0, 0, 1.0), (0, 1, 2.0), (1, 0, 9.0)]
    d = dtm.date(1994, 1, 1)
    cube = spark.createDataFrame(
        [(d, "f0", e, h, 0, 0, v) for e, h, v in rows], "day date, fx string, ens int, hour int, lat_i int, lon_i int, value double"
    )
    assert reduce.hour_then_ensemble(cube, "mean", "mean").first()["value"] == pytest.approx((1.5 + 9) / 2)
    assert reduce.ensemble_then_hour_mean(cube).first()["value"] == pytest.approx((5 + 2) / 2)


def test_learning_curves_agree(spark, sf):
    """Any estimator, fitted anew for each sample, against the ridge curve from summed matrices."""
    from heliogrid.operators import ridge
    from heliogrid.plans import evaluation
    from heliogrid.plans.queries_models import _obs_split

    train, test = _obs_split(spark, sf)
    one = evaluation.ridge_learning_curve(train, test, ["stid", "day"], bins=2, repetitions=2)
    two = evaluation.learning_curve(ridge.Ridge(alpha=1.0), train, test, ["stid", "day"], bins=2, repetitions=2)
    a, b = (sorted(tuple(r[c] for c in one.columns) for r in df.collect()) for df in (one, two))
    assert np.allclose(a, b, rtol=1e-6)
