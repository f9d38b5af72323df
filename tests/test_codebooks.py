"""Codebooks of whole maps against plain numpy."""

import datetime as dtm

import numpy as np
import pytest

from heliogrid.operators import codebooks, encode
from heliogrid.operators.grid import GridSpec

SPEC = GridSpec.of([30, 31, 32], [-100, -99, -98, -97])


def maps_of(n, seed, groups=4, missing=0.0):
    rng = np.random.default_rng(seed)
    centre = rng.normal(0, 3, (groups, 12)) + 50
    x = centre[rng.integers(0, groups, n)] + rng.normal(0, 0.7, (n, 12))
    x[rng.random((n, 12)) < missing] = np.nan
    return x


def cube(spark, x):
    rows = [(dtm.date(2000, 1, 1) + dtm.timedelta(d), i // 4, i % 4, float(v)) for d, m in enumerate(x) for i, v in enumerate(m) if not np.isnan(v)]
    return spark.createDataFrame(rows, "day date, lat_i int, lon_i int, value double").repartition(5)


def by_day(rows, n, k, name):
    out = np.full((n, k), np.nan)
    for r in rows:
        out[(r["day"] - dtm.date(2000, 1, 1)).days, r["code"]] = np.nan if r[name] is None else r[name]
    return out


def test_scale_of_cells_with_gaps(spark):
    x = maps_of(80, 1, missing=0.2)
    x[:, 5] = 7.0
    scale = codebooks.cell_scale(codebooks.vectors_of(cube(spark, x), SPEC))
    std = np.nanstd(x, axis=0)
    assert np.allclose(scale.mean, np.nanmean(x, axis=0)) and np.allclose(scale.std, np.where(std > 0, std, 1.0))


def test_minibatch_comes_close_to_full_k_means(spark):
    x = maps_of(600, 2, groups=6)
    vectors = codebooks.vectors_of(cube(spark, x), SPEC)
    scale = codebooks.cell_scale(vectors)
    rule = codebooks.MiniBatchKMeans(k=6, batch_rows=100)
    centres, inertia = rule.fit(vectors, scale)
    z = (x - scale.mean) / scale.std
    assert inertia == pytest.approx(((z[:, None] - centres) ** 2).sum(2).min(1).sum())
    full = encode.fit_centres(encode.complete_vectors(encode.standardise_cells(cube(spark, x)), SPEC), "cells", 6)
    assert inertia <= 1.05 * ((z[:, None] - full) ** 2).sum(2).min(1).sum()


def test_distances_on_known_cells(spark):
    x = maps_of(120, 3, missing=0.15)
    got = by_day(codebooks.encode_minibatch(cube(spark, x), SPEC, codebooks.MiniBatchKMeans(k=4)).collect(), 120, 4, "distance")
    assert not np.isnan(got).any() and (got.min(axis=1) < got.max(axis=1)).all()
    vectors = codebooks.vectors_of(cube(spark, x), SPEC)
    scale = codebooks.cell_scale(vectors)
    centres, _ = codebooks.MiniBatchKMeans(k=4).fit(vectors, scale)
    z = (x - scale.mean) / scale.std
    want = np.sqrt(np.nanmean((z[:, None] - centres) ** 2, axis=2) * 12)
    assert np.allclose(got, want)


def plain_em(z, mixture, floor, steps):
    w, mu, cov = mixture.weights, mixture.means, mixture.covariances
    for _ in range(steps):
        dens = np.empty((len(z), len(w)))
        for k in range(len(w)):
            gap = z - mu[k]
            dens[:, k] = np.log(w[k]) - 0.5 * (np.einsum("ni,ij,nj->n", gap, np.linalg.inv(cov[k]), gap) + np.linalg.slogdet(2 * np.pi * cov[k])[1])
        r = np.exp(dens - dens.max(1, keepdims=True))
        r /= r.sum(1, keepdims=True)
        w = r.mean(0)
        mu = (r.T @ z) / r.sum(0)[:, None]
        cov = np.array([((z - mu[k]) * r[:, [k]]).T @ (z - mu[k]) / r[:, k].sum() + floor * np.eye(z.shape[1]) for k in range(len(w))])
    return w, mu, cov


def test_mixture_equals_plain_em(spark):
    x = maps_of(200, 4, groups=3)
    vectors = codebooks.vectors_of(cube(spark, x), SPEC)
    scale = codebooks.cell_scale(vectors)
    z = (x - scale.mean) / scale.std
    start, _ = codebooks.GaussianMixture(k=3, iterations=0).fit(vectors, scale)
    got, seen = codebooks.GaussianMixture(k=3, iterations=6, tolerance=0.0).fit(vectors, scale)
    w, mu, cov = plain_em(z, start, 1e-9, 6)
    assert np.allclose(got.weights, w) and np.allclose(got.means, mu, atol=1e-7) and np.allclose(got.covariances, cov, atol=1e-7)
    assert len(seen) == 6 and all(b >= a - 1e-9 for a, b in zip(seen, seen[1:]))


def test_posteriors_of_whole_and_incomplete_maps(spark):
    x = maps_of(150, 5, groups=3)
    x[3, [0, 7]] = np.nan
    rule = codebooks.GaussianMixture(k=3, iterations=8)
    got = by_day(codebooks.encode_whole_mixture(cube(spark, x), SPEC, rule).collect(), 150, 3, "probability")
    assert np.allclose(got.sum(axis=1), 1)
    vectors = codebooks.vectors_of(cube(spark, x), SPEC)
    scale = codebooks.cell_scale(vectors)
    mixture, _ = rule.fit(vectors, scale)
    some = ~np.isnan(x[3])
    z = ((x[3] - scale.mean) / scale.std)[some]
    logs = [np.log(w) - 0.5 * ((z - m[some]) @ np.linalg.solve(c[np.ix_(some, some)], z - m[some]) + np.linalg.slogdet(2 * np.pi * c[np.ix_(some, some)])[1]) for w, m, c in zip(mixture.weights, mixture.means, mixture.covariances)]
    want = np.exp(np.array(logs) - max(logs))
    assert np.allclose(got[3], want / want.sum(), atol=1e-6)


def test_no_maps(spark):
    with pytest.raises(ValueError):
        codebooks.cell_scale(codebooks.vectors_of(cube(spark, maps_of(2, 1)).limit(0), SPEC))
