"""Hidden cells by downdating against refits on the kept cells."""

import datetime as dtm

import numpy as np
import pytest

from heliogrid.operators import holdout, interpolate
from heliogrid.operators.grid import GridSpec

SPEC = GridSpec.of([30 + i for i in range(6)], [-100 + 1.5 * j for j in range(7)])


def cells(seed=1):
    lat, lon = np.repeat(np.asarray(SPEC.lats, float), SPEC.n_lon), np.tile(np.asarray(SPEC.lons, float), SPEC.n_lat)
    return np.column_stack([lon, lat, np.random.default_rng(seed).uniform(100, 900, lat.size)])


def refit(at, values, nuggets, theta, hidden):
    """Kriging on the kept cells only, from the definition; scales are those of all cells."""
    z = (at - at.mean(axis=0)) / at.std(axis=0)
    gap = z[:, None] - z[None]
    c = np.exp(-(gap**2 * np.asarray(theta)).sum(axis=2))
    kept = np.setdiff1d(np.arange(len(at)), hidden)
    a = c[np.ix_(kept, kept)] + np.diag(nuggets[kept])
    ones = np.ones(len(kept))
    beta = ones @ np.linalg.solve(a, values[kept]) / (ones @ np.linalg.solve(a, ones))
    return beta + c[np.ix_(hidden, kept)] @ np.linalg.solve(a, values[kept] - beta)


def test_downdating_equals_refits():
    rng = np.random.default_rng(2)
    at, theta = cells(), (3.0, 2.0, 1.0)
    values, nuggets = rng.normal(5, 2, (8, len(at))), rng.uniform(0.01, 0.5, (8, len(at)))
    between = interpolate.GaussianProcess(at, theta).between
    inverse = np.linalg.inv(between + np.array([np.diag(n) for n in nuggets]))
    one = np.linalg.inv(between + 0.05 * np.eye(len(at)))
    for hidden in holdout.hidden_sets(SPEC, 7, 4):
        own, shared = holdout.predict_hidden(inverse, values, hidden), holdout.predict_hidden(one, values, hidden)
        for k in range(8):
            assert np.allclose(own[k], refit(at, values[k], nuggets[k], theta, hidden), atol=1e-8)
            assert np.allclose(shared[k], refit(at, values[k], np.full(len(at), 0.05), theta, hidden), atol=1e-8)


def test_spline_is_exact_for_cubics_along_the_lines():
    lat, lon = np.divmod(np.arange(SPEC.n_cells), SPEC.n_lon)
    cubic = 0.3 * lat**3 - lat**2 + 0.1 * lon**3 + 2.0 * lon - 4
    for hidden in holdout.hidden_sets(SPEC, 6, 5):
        weights = holdout.spline_left_weights(SPEC, hidden)
        able = ~np.isnan(weights).any(axis=1)
        assert able.any() and np.allclose(weights[able] @ cubic, cubic[hidden][able])
        assert np.allclose(weights[able][:, hidden], 0)


def test_scores_over_all_maps(spark):
    rng = np.random.default_rng(3)
    maps = {(d, e): rng.normal(4, 1, SPEC.n_cells) for d in range(5) for e in range(3)}
    maps[4, 0][3] = np.nan  # the mean of that cell is of the other members
    rows = [(dtm.date(2000, 1, 1 + d), "f", e, 0, i // SPEC.n_lon, i % SPEC.n_lon, None if np.isnan(v) else float(v)) for (d, e), m in maps.items() for i, v in enumerate(m)]
    cube = spark.createDataFrame([r for r in rows if r[-1] is not None], "day date, fx string, ens int, hour int, lat_i int, lon_i int, value double")
    at, sets = cells(), holdout.hidden_sets(SPEC, 6, 2)
    candidates = [holdout.Kriging((3.0, 2.0, 1.0)), holdout.Kriging((3.0, 2.0, 1.0), 0.1), holdout.Ridge(0.1), holdout.Spline()]
    got = {(r["candidate"], r["hidden_set"]): r for r in holdout.holdout(cube, SPEC, at, candidates, sets).collect()}
    assert len(got) == 8
    stack = np.array([[maps[d, e] for e in range(3)] for d in range(5)])
    mean, spread = np.nanmean(stack, axis=1), np.nanstd(stack, axis=1)
    for s, hidden in enumerate(sets):
        kept = np.setdiff1d(np.arange(SPEC.n_cells), hidden)
        ridge = interpolate.ridge_trend_weights(at[kept], 0.1)({"elon": at[hidden, 0], "nlat": at[hidden, 1], "elev": at[hidden, 2]})
        want = {
            candidates[0].name: [refit(at, m, (v / m) ** 2, (3.0, 2.0, 1.0), hidden) for m, v in zip(mean, spread)],
            candidates[1].name: [refit(at, m, np.full(len(at), 0.1), (3.0, 2.0, 1.0), hidden) for m in mean],
            "ridge 0.1": mean[:, kept] @ ridge.T,
            "spline": mean @ np.nan_to_num(holdout.spline_left_weights(SPEC, hidden)).T,
        }
        for name, pred in want.items():
            error = np.asarray(pred) - mean[:, hidden]
            if name == "spline":
                error = error[:, ~np.isnan(holdout.spline_left_weights(SPEC, hidden)).any(axis=1)]
            r = got[name, s]
            assert r["n"] == error.size and r["mae"] == pytest.approx(np.abs(error).mean()) and r["mse"] == pytest.approx((error**2).mean())
    both = {r["candidate"]: r for r in holdout.over_sets(holdout.holdout(cube, SPEC, at, candidates, sets)).collect()}
    assert both["ridge 0.1"]["n"] == sum(got["ridge 0.1", s]["n"] for s in (0, 1))
    assert holdout.holdout(cube.limit(0), SPEC, at, candidates, sets).where("mae is not null").count() == 0
