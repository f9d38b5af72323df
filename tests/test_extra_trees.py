"""Extremely randomised trees against a plain version with the same draws, and on a planted problem."""

import numpy as np
import pytest

from heliogrid.operators import extra_trees
from tests.test_boosting import rows


def problem(n, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 6))
    return x, 4 * x[:, 1] + 2 * np.abs(x[:, 3]) + 0.1 * rng.normal(size=n)


def plain(x, y, rule):
    """Trees grown one node at a time: (predictor, gains of the features)."""
    width, predictors, shares = x.shape[1], [], []
    for t in range(rule.trees):
        gains = np.zeros(width)

        def grow(at, node, level):
            if level < rule.depth and len(at) >= 2 * rule.min_leaf and len(at) > 1:
                drawn = rule._drawn(t, node, width)
                place = np.random.default_rng([rule.seed, t, node, 1]).random(len(drawn))
                best = (1e-12 * max(1.0, ((y[at] - y[at].mean()) ** 2).sum()), None)
                for f, p in zip(drawn, place):
                    low, high = np.nanmin(x[at, f]), np.nanmax(x[at, f])
                    cut = low + p * (high - low)
                    left, right = at[x[at, f] <= cut], at[~(x[at, f] <= cut)]
                    if high > low and min(len(left), len(right)) >= rule.min_leaf:
                        gain = y[left].sum() ** 2 / len(left) + y[right].sum() ** 2 / len(right) - y[at].sum() ** 2 / len(at)
                        if gain > best[0]:
                            best = (gain, (f, cut, left, right))
                if best[1]:
                    f, cut, left, right = best[1]
                    gains[f] += best[0]
                    a, b = grow(left, 2 * node + 1, level + 1), grow(right, 2 * node + 2, level + 1)
                    return lambda v: a(v) if v[f] <= cut else b(v)
            mean = y[at].mean()
            return lambda v: mean

        predictors.append(grow(np.arange(len(x)), 0, 0))
        shares.append(gains / gains.sum())
    return lambda z: np.array([np.mean([p(v) for p in predictors]) for v in z]), np.mean(shares, axis=0)


@pytest.mark.parametrize("features", [1, 3, None])
def test_equals_plain_trees(spark, features):
    x, y = problem(150, 1)
    x[::13, 3] = np.nan
    y = np.nan_to_num(y)
    rule = extra_trees.ExtraTrees(trees=4, depth=4, min_leaf=3, max_features=features)
    model = rule.fit(rows(spark, x, y))
    predict, share = plain(x, y, rule)
    assert np.allclose(model.predict(x), predict(x)) and np.allclose(model.gains, share)


def test_planted_features_matter_most(spark):
    x, y = problem(800, 2)
    model = extra_trees.ExtraTrees(trees=20, depth=5, max_features=3).fit(rows(spark, x, y))
    table = {r["feature"]: r["importance"] for r in model.importances([f"f{i}" for i in range(6)]).collect()}
    assert sorted(table, key=table.get)[-2:] == ["f3", "f1"] and np.isclose(sum(table.values()), 1)
    test, truth = problem(300, 3)
    assert np.mean((model.predict(test) - truth) ** 2) < 0.5 * truth.var()


def test_awkward_rows(spark):
    df = spark.createDataFrame([(1, [1.0, None], 2.0), (2, [None, None], 3.0), (3, None, 4.0), (4, [2.0, None], None)], "id long, features array<double>, y double")
    model = extra_trees.ExtraTrees(trees=2, depth=2, max_features=None).fit(df)
    got = {r["id"]: r["pred"] for r in model.transform(df).collect()}
    assert got[3] is None and 2 <= got[1] <= 3 and len(got) == 4
    with pytest.raises(ValueError):
        extra_trees.ExtraTrees(trees=1).fit(df.limit(0))
