"""Boosted trees against a boosting in plain numpy, sketches against sorted values."""

import numpy as np
import pytest

from heliogrid.operators import boosting, sketches, trees


def rows(spark, x, y, parts=3):
    data = [(i, [None if np.isnan(v) else float(v) for v in a], float(b)) for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(data, "id long, features array<double>, y double").repartition(parts)


def grow(x, residual, depth, min_leaf, edges):
    """(feature, threshold, left, right) nested, or the rows of a leaf; every threshold is tried on the rows."""

    def node(at, level):
        best = (1e-12 * max(1.0, np.abs(residual[at]).sum()), None)
        for f in range(x.shape[1] if level < depth and len(at) >= 2 * min_leaf else 0):
            for t in edges[f]:
                left, right = at[x[at, f] <= t], at[~(x[at, f] <= t)]
                if min(len(left), len(right)) < min_leaf:
                    continue
                gain = residual[left].sum() ** 2 / len(left) + residual[right].sum() ** 2 / len(right) - residual[at].sum() ** 2 / len(at)
                if gain > best[0] * (1 + 1e-9):
                    best = (gain, (f, t, left, right))
        if best[1] is None:
            return at
        f, t, left, right = best[1]
        return f, t, node(left, level + 1), node(right, level + 1)

    return node(np.arange(len(x)), 0)


def boosted(x, y, test, loss, stages, depth, rate, min_leaf, alpha=0.9):
    start = y.mean() if loss == "squared" else np.median(y)
    pred, out = np.full(len(y), start), np.full(len(test), start)
    edges = [(v[:-1] + v[1:]) / 2 for v in (np.unique(c[~np.isnan(c)]) for c in x.T)]
    for _ in range(stages):
        gap = y - pred
        cut = np.percentile(np.abs(gap), 100 * alpha)
        residual = {"absolute": np.where(gap > 0, 1.0, -1.0), "squared": gap, "huber": np.clip(gap, -cut, cut)}[loss]

        def value(at):
            if loss == "squared":
                return gap[at].mean()
            median = np.median(gap[at])
            return median if loss == "absolute" else median + np.clip(gap[at] - median, -cut, cut).mean()

        def apply(tree, at, target, values):
            if isinstance(tree, np.ndarray):
                target[at] += rate * value(tree)
                return
            f, t, left, right = tree
            apply(left, at[values[at, f] <= t], target, values)
            apply(right, at[~(values[at, f] <= t)], target, values)

        tree = grow(x, residual, depth, min_leaf, edges)
        apply(tree, np.arange(len(test)), out, test)
        apply(tree, np.arange(len(y)), pred, x)
    return out


def problem(n, seed, noise=0.3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    y = 3 * np.sin(x[:, 0]) + x[:, 1] * (x[:, 2] > 0) + noise * rng.standard_t(2, n)
    return x, y


@pytest.mark.parametrize("loss", boosting.LOSSES)
def test_equals_plain_boosting(spark, loss):
    x, y = problem(200, 1)
    x[::17, 1] = np.nan
    test, _ = problem(60, 2)
    test[::7, 1] = np.nan
    model = boosting.GradientBoosting(loss=loss, trees=5, depth=3, rate=0.3, min_leaf=5, max_features=None, settle_every=2).fit(rows(spark, x, y))
    want = boosted(x, y, test, loss, 5, 3, 0.3, 5)
    assert np.allclose(model.predict(test), want, atol=1e-9)
    frame = rows(spark, test, np.zeros(60))
    got = {r["id"]: r["pred"] for r in model.transform(frame).collect()}
    assert np.allclose([got[i] for i in range(60)], want, atol=1e-9)


def test_staged_loss_ends_at_the_model(spark):
    x, y = problem(150, 3)
    df = rows(spark, x, y)
    model = boosting.GradientBoosting(trees=4, depth=2, rate=0.5, max_features=None).fit(df)
    stages = model.staged_loss(df)
    assert len(stages) == 4 and np.isclose(stages[-1], np.abs(y - model.predict(x)).mean()) and stages[-1] < stages[0]
    assert np.isclose(model.gains.sum(), 1.0) and model.gains[0] == model.gains.max()


def test_beats_the_other_trees_on_absolute_error(spark):
    x, y = problem(1500, 4, noise=1.0)
    test, truth = problem(1500, 5, noise=0.0)
    df = rows(spark, x, y)
    own = boosting.GradientBoosting(trees=12, depth=3, rate=0.3, max_features=None).fit(df)
    other = trees.BoostedTrees(loss="absolute", trees=12, depth=3, rate=0.3, max_features="all").fit(df)
    spark_pred = {r["id"]: r["pred"] for r in other.transform(rows(spark, test, truth)).select("id", "pred").collect()}
    assert np.abs(own.predict(test) - truth).mean() < np.abs([spark_pred[i] - truth[i] for i in range(1500)]).mean()


def test_draws_depend_on_seeds_not_on_partitions(spark):
    x, y = problem(300, 6)
    fit = lambda parts, seed: boosting.GradientBoosting(trees=3, depth=2, max_features=2, subsample=0.6, seed=seed).fit(rows(spark, x, y, parts)).predict(x)
    assert np.allclose(fit(1, 1), fit(5, 1)) and not np.allclose(fit(1, 1), fit(1, 2))


def test_awkward_rows(spark):
    df = spark.createDataFrame(
        [(1, [1.0, None], 2.0), (2, [None, None], 3.0), (3, None, 4.0), (4, [2.0, None], None), (5, [2.0, None], float("nan")), (6, [5.0, None], 9.0)],
        "id long, features array<double>, y double",
    )
    model = boosting.GradientBoosting(trees=2, depth=2, min_leaf=1, rate=1.0, max_features=None).fit(df)
    got = {r["id"]: r["pred"] for r in model.transform(df).collect()}
    assert got[3] is None and got[1] == 2.0 and got[4] == got[5] and len(got) == 6
    with pytest.raises(ValueError):
        boosting.GradientBoosting(trees=1).fit(df.limit(0))
    with pytest.raises(ValueError):
        boosting.GradientBoosting(loss="other")


def test_many_values_share_bins(spark):
    x, y = problem(2000, 7)
    df = rows(spark, x, y)
    edges = boosting.bin_edges(df, 16)
    assert all(len(e) == 15 for e in edges)
    shares = np.histogram(x[:, 0], [-np.inf, *edges[0], np.inf])[0] / 2000
    assert shares.min() > 0.045 and shares.max() < 0.08


@pytest.mark.parametrize("n", [1, 2, 7, 1000, 60_000])
def test_sketch_ranks(n):
    rng = np.random.default_rng(n)
    values = np.round(rng.normal(size=n), 2 if n == 7 else 9)
    parts = []
    for chunk in np.array_split(values, 3):
        sketch = sketches.Sketch(256)
        for piece in np.array_split(chunk, 11):
            sketch.add(piece)
        parts.append(sketch.points())
    points = sketches.merged(parts)
    assert np.isclose(points[1].sum(), n) and len(points[0]) <= 3 * 256 * 10
    for share in (0.05, 0.5, 0.9):
        got = sketches.quantile(points, share)
        if n <= 256:
            assert np.isclose(sketches.quantile(points, 0.5), np.median(values))
            assert np.isclose(sketches.linear_quantile(points, share), np.percentile(values, 100 * share))
        # levels / (2 size) of the rows
        assert abs((values <= got).mean() - share) <= 9 / 512 + 2 / n
