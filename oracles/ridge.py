"""Oracles: ridge regression by Gauss-Jordan elimination, written out as SQL columns."""

from __future__ import annotations

import re

import numpy as np

from oracles.base import define, drawn_rows, query, r
from oracles.models import score_row
from oracles.spatial import local_rows

WIDTH = 5  # features of the observation model

define(
    "obs_model",
    """SELECT o.stid, o.day, qty AS x1, price AS x2, disc AS x3, tax AS x4,
        abs(CAST(dayofyear(o.day) AS DOUBLE) - 182.625e0) AS x5, y
        FROM obs_daily o JOIN energy e ON e.stid = o.stid AND e.day = o.day""",
    "obs_daily", "energy",
)


def standardised(train: str, rows: str, width: int = WIDTH) -> str:
    """Rows with z = (x - mean) / norm and centred label, by the training moments of their key."""
    P = range(1, width + 1)
    means = ", ".join(f"avg(x{i}) AS m{i}" for i in P)
    norms = ", ".join(
        f"""CASE WHEN sum((x{i} - m{i}) ** 2) <= 1e-12 * sum(x{i} ** 2) THEN NULL
        ELSE sqrt(sum((x{i} - m{i}) ** 2)) END AS s{i}"""
        for i in P
    )
    firsts = ", ".join(f"any_value(m{i}) AS m{i}" for i in P)
    z = ", ".join(f"coalesce((x{i} - m{i}) / s{i}, 0) AS z{i}" for i in P)
    stats = f"""SELECT key, any_value(my) AS my, {firsts}, {norms} FROM ({train})
        JOIN (SELECT key, avg(y) AS my, {means} FROM ({train}) GROUP BY key) USING (key) GROUP BY key"""
    return f"SELECT t.*, my, y - my AS yc, {z} FROM ({rows}) t JOIN ({stats}) USING (key)"


def inverse(z: str, alphas: str, width: int = WIDTH) -> str:
    """Inverse b_i_j of Z'Z + alpha I and coefficients b_i_0, per key and alpha."""
    P = range(1, width + 1)
    grams = ", ".join(f"sum(z{i} * z{j}) + {'alpha' if i == j else '0'} AS a_{i}_{j}" for i in P for j in P)
    rights = ", ".join(f"CAST({int(i == j)} AS DOUBLE) AS b_{i}_{j}" for i in P for j in P)
    labels = ", ".join(f"sum(z{i} * yc) AS b_{i}_0" for i in P)
    sql = f"SELECT key, alpha, {grams}, {labels}, {rights} FROM ({z}) CROSS JOIN ({alphas}) GROUP BY key, alpha"
    cells = [("a", i, j) for i in P for j in P] + [("b", i, j) for i in P for j in range(width + 1)]
    for k in P:
        step = []
        for m, i, j in cells:
            pivot = f"{m}_{k}_{j} / a_{k}_{k}"
            step.append(f"{pivot if i == k else f'{m}_{i}_{j} - a_{i}_{k} * {pivot}'} AS {m}_{i}_{j}")
        sql = f"SELECT key, alpha, {', '.join(step)} FROM ({sql})"
    return sql


def weighted(width: int = WIDTH) -> str:
    return "(" + " + ".join(f"b_{i}_0 * z{i}" for i in range(1, width + 1)) + ")"


def leverage(width: int = WIDTH) -> str:
    return "(" + " + ".join(f"z{i} * b_{i}_{j} * z{j}" for i in range(1, width + 1) for j in range(1, width + 1)) + ")"


def predicted(train: str, rows: str, alpha: str, width: int = WIDTH) -> str:
    """Rows with the prediction of their key's model."""
    solved = inverse(standardised(train, train, width), f"SELECT {alpha} AS alpha", width)
    return f"""SELECT q.*, my + {weighted(width)} AS pred FROM ({standardised(train, rows, width)}) q
        JOIN ({solved}) USING (key)"""


def keyed(key: str) -> str:
    return f"SELECT {key} AS key, * FROM obs_model"


_ALL = keyed("0")
_FOLDED = "SELECT m.*, fold FROM obs_model m JOIN obs_folds USING (day)"
define(
    "obs_folds",
    """SELECT day, (row_number() OVER (ORDER BY md5(CAST(day AS VARCHAR) || '|0'), day) - 1) % 5 AS fold
        FROM (SELECT DISTINCT day FROM obs_model)""",
    "obs_model",
)
_LEFT_OUT = f"SELECT k.key, t.* FROM ({_FOLDED}) t JOIN (SELECT unnest(generate_series(0, 4)) AS key) k ON k.key <> t.fold"
_HELD = f"SELECT fold AS key, t.* FROM ({_FOLDED}) t"
_ALPHAS = "SELECT unnest([1e-4, 1e-3, 1e-2, 1e-1, 1e0, 1e1, 1e2]) AS alpha"

define("cv_rows", standardised(_ALL, _ALL), "obs_model")
define("cv_models", inverse("SELECT * FROM cv_rows", _ALPHAS), "cv_rows")
define(
    "cv_best",
    f"""SELECT alpha FROM (SELECT alpha, avg(((yc - {weighted()}) / (1 - {leverage()})) ** 2) AS mse
        FROM cv_rows JOIN cv_models USING (key) GROUP BY alpha) ORDER BY mse, alpha LIMIT 1""",
    "cv_rows", "cv_models",
)

# one model and penalty for every station, on day features scaled over all days that have a label
define(
    "shared_days",
    """SELECT day, avg(qty) AS x1, avg(price) AS x2, avg(disc) AS x3, avg(tax) AS x4, abs(CAST(dayofyear(day) AS DOUBLE) - 182.625e0) AS x5
        FROM obs WHERE day IN (SELECT day FROM energy) GROUP BY day""",
    "obs", "energy",
)
define("shared_scaled", standardised("SELECT 0 AS key, 0e0 AS y, * FROM shared_days", "SELECT 0 AS key, 0e0 AS y, * FROM shared_days"), "shared_days")
define(
    "station_rows",
    "SELECT e.stid AS key, e.stid, s.day, e.y, count(*) OVER w AS n, avg(e.y) OVER w AS my, e.y - avg(e.y) OVER w AS yc, "
    + ", ".join(f"z{i} - avg(z{i}) OVER w AS z{i}" for i in range(1, WIDTH + 1))
    + " FROM shared_scaled s JOIN energy e USING (day) WINDOW w AS (PARTITION BY e.stid)",
    "shared_scaled", "energy",
)
define("station_models", inverse("SELECT * FROM station_rows", _ALPHAS), "station_rows")
define(
    "station_best",
    f"""SELECT key, alpha, mse FROM (SELECT key, alpha, mse, row_number() OVER (PARTITION BY key ORDER BY mse, alpha) AS k FROM (
        SELECT key, alpha, avg(((yc - {weighted()}) / greatest(1 - 1e0 / n - {leverage()}, 1e-12)) ** 2) AS mse
        FROM station_rows JOIN station_models USING (key) GROUP BY key, alpha)) WHERE k = 1""",
    "station_rows", "station_models",
)

# learning curve: growing samples of the earlier days, each pair (size, repetition) shuffled anew
define("model_days", "SELECT day, row_number() OVER (ORDER BY day) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT day FROM obs_model)", "obs_model")
define("early", "SELECT * FROM obs_model WHERE day < (SELECT day FROM model_days WHERE pos = floor(n * 0.5))", "obs_model", "model_days")
define("later", "SELECT * FROM obs_model WHERE day >= (SELECT day FROM model_days WHERE pos = floor(n * 0.5))", "obs_model", "model_days")
define("curve_samples", f"SELECT *, 1000 * i + j AS key FROM ({drawn_rows('SELECT * FROM early', 'stid, day, x1, x2, x3, x4, x5, y', 10, 10)})", "early")
_SAMPLES = "SELECT * FROM curve_samples"
_TESTED = "SELECT l.*, s.key, s.size FROM later l CROSS JOIN (SELECT DISTINCT key, size FROM curve_samples) s"


def curve(rows: str, name: str) -> str:
    return f"SELECT key, size, avg(abs(y - pred)) AS {name} FROM ({predicted(_SAMPLES, rows, '1e0')}) GROUP BY key, size"


# pooled ridge on the cells around the stations
LOCAL = [f"nm_f{f}_{i}_{j}" for f in (0, 1) for i in (0, 1) for j in (0, 1)]
LOCAL += ["doy", "lat", "lon", "elev", "rel_lat", "rel_lon", "lat_idx", "lon_idx"]
define(
    "local_table",
    local_rows([(f"f{f}", f"fx = 'f{f}'") for f in (0, 1)], "n.value", "cell_mean", True, wrap=lambda e: f"({e})"),
    "cell_mean", "placed",
)
define("local_x", "SELECT day, stid, 0 AS key, " + ", ".join(f"{c} AS x{i + 1}" for i, c in enumerate(LOCAL)) + " FROM local_table", "local_table")
define("label_cut", "SELECT day AS d FROM (SELECT day, pos FROM nwp_labels) WHERE pos = (SELECT floor(count(DISTINCT day) * 0.5) FROM energy_nwp) LIMIT 1", "nwp_labels")
define("local_train", "SELECT t.*, y FROM local_x t JOIN energy_nwp e ON e.day = t.day AND e.stid = t.stid WHERE t.day < (SELECT d FROM label_cut)", "local_x", "energy_nwp", "label_cut")
define("local_test", "SELECT * FROM local_x WHERE day >= (SELECT d FROM label_cut)", "local_x", "label_cut")
_LOCAL_PRED = predicted("SELECT * FROM local_train", "SELECT *, 0e0 AS y FROM local_test", "1e0", len(LOCAL))

define(
    "local_folded",
    """SELECT t.* EXCLUDE (key), y, fold FROM local_x t JOIN energy_nwp e ON e.day = t.day AND e.stid = t.stid JOIN (
        SELECT day, CAST((row_number() OVER (ORDER BY md5(CAST(day AS VARCHAR) || '|0'), day) - 1) % 5 AS INTEGER) AS fold
        FROM (SELECT DISTINCT day FROM energy_nwp)) f ON f.day = t.day""",
    "local_x", "energy_nwp",
)
_LOCAL_FOLDS = predicted(
    "SELECT k.key, t.* FROM local_folded t JOIN (SELECT unnest(generate_series(0, 4)) AS key) k ON k.key <> t.fold",
    "SELECT fold AS key, t.* FROM local_folded t",
    "1e0",
    len(LOCAL),
)

# submission: labels standardised per station, fitted on all labelled days, later half of the cube predicted
define("label_scale", "SELECT stid, avg(y) AS ym, CASE WHEN stddev_pop(y) = 0 THEN 1 ELSE stddev_pop(y) END AS ys FROM energy_nwp GROUP BY 1", "energy_nwp")
define("scaled_rows", "SELECT t.*, (y - ym) / ys AS y FROM local_x t JOIN energy_nwp e ON e.day = t.day AND e.stid = t.stid JOIN label_scale s ON s.stid = t.stid", "local_x", "energy_nwp", "label_scale")
define(
    "later_rows",
    """SELECT *, 0e0 AS y FROM local_x WHERE day >= (SELECT day FROM (SELECT day, row_number() OVER (ORDER BY day) - 1 AS pos,
        count(*) OVER () AS n FROM (SELECT DISTINCT day FROM nwp)) WHERE pos = floor(n * 0.5))""",
    "local_x", "nwp",
)
_SUBMIT = predicted("SELECT * FROM scaled_rows", "SELECT * FROM later_rows", "1e0", len(LOCAL))

define(
    "local_scored",
    f"""SELECT m.y, m.is_masked, least(greatest(pred, lo), hi) AS pred FROM ({_LOCAL_PRED}) p JOIN nwp_marked m ON m.day = p.day AND m.stid = p.stid,
        (SELECT min(y) AS lo, max(y) AS hi FROM energy_nwp WHERE day < (SELECT d FROM label_cut))""",
    "local_train", "local_test", "nwp_marked",
)

# ridge trend on the cells that aren't hidden, of every map and set of hidden inner cells
_INNER = [8 * i + j for i in range(1, 7) for j in range(1, 7)]
_HIDDEN = ", ".join(f"({k}, {c})" for k in range(5) for c in sorted(np.random.RandomState(5 + k).permutation(_INNER)[:20]))
define("hidden_cells", f"SELECT CAST(k AS INTEGER) AS k, CAST(c AS INTEGER) AS c FROM (VALUES {_HIDDEN}) v(k, c)")
define(
    "trend_rows",
    """SELECT concat_ws('|', day, fx, hour, s.k) AS key, s.k, h.c IS NOT NULL AS hidden, lon AS x1, lat AS x2, elev AS x3, y FROM (
        SELECT day, fx, hour, lat_i, lon_i, avg(value) AS y FROM nwp GROUP BY ALL) m JOIN grid USING (lat_i, lon_i)
        CROSS JOIN (SELECT DISTINCT k FROM hidden_cells) s LEFT JOIN hidden_cells h ON h.k = s.k AND h.c = 8 * lat_i + lon_i""",
    "nwp", "grid", "hidden_cells",
)
_TREND = predicted("SELECT * FROM trend_rows WHERE NOT hidden", "SELECT * FROM trend_rows WHERE hidden", "1e-1", 3)
_RAW_TREND = re.sub(r"ELSE sqrt\(sum\(\(x\d - m\d\) \*\* 2\)\) END", "ELSE 1e0 END", _TREND)


def _trend_scores(name: str, rows: str) -> str:
    return f"""SELECT '{name}' AS candidate, k AS hidden_set, {r('avg(abs(pred - y))')} AS mae, {r('avg((pred - y) ** 2)')} AS mse,
        count(*) AS n FROM ({rows}) GROUP BY k"""


SQL = {
    "interp_holdout_ridge": query("trend_rows", _trend_scores("ridge 0.1", _TREND) + " UNION ALL " + _trend_scores("ridge 0.1 raw", _RAW_TREND)),
    "model_scores": query(
        "local_scored",
        score_row("all", "", "local_scored", 4) + " UNION ALL " + score_row("unmasked", "WHERE NOT is_masked", "local_scored", 4),
    ),
    "submit": query(
        "scaled_rows later_rows station_places",
        "SELECT strftime(day, '%Y%m%d') AS \"Date\", block, "
        + ", ".join(f"{r(f'max(CASE WHEN place = {i} THEN v END)', 4)} AS s{i}" for i in range(1, 99))
        + f""" FROM (SELECT day, block, place, pred * ys + ym AS v FROM ({_SUBMIT}) p
        JOIN label_scale s ON s.stid = p.stid JOIN station_places c ON c.stid = p.stid) GROUP BY day, block""",
    ),
    "eval_cross_val_model": query(
        "local_folded", f"SELECT fold, count(*) AS n, {r('avg(abs(y - pred))')} AS mae FROM ({_LOCAL_FOLDS}) GROUP BY fold"
    ),
    "eval_cross_val_errors": query(
        "local_folded nwp_marked",
        f"""SELECT CAST(month(day) AS INTEGER) AS month, {r('avg(ae)', 4)} AS ae FROM (
        SELECT day, coalesce(sum(CASE WHEN NOT is_masked THEN abs(p.y - pred) END), 0) AS ae FROM ({_LOCAL_FOLDS}) p
        JOIN (SELECT day, stid, is_masked FROM nwp_marked) USING (day, stid) GROUP BY day) GROUP BY 1""",
    ),
    "eval_learning_curve": query(
        "curve_samples later",
        f"""SELECT CAST(a.key // 1000 AS INTEGER) AS size_no, a.size AS n_samples, {r('avg(train)')} AS train_mean,
        {r('stddev_pop(train)')} AS train_std, {r('avg(test)')} AS test_mean, {r('stddev_pop(test)')} AS test_std
        FROM ({curve(_SAMPLES, 'train')}) a JOIN ({curve(_TESTED, 'test')}) b ON a.key = b.key GROUP BY 1, 2""",
    ),
    "model_local": query(
        "local_train local_test",
        f"""SELECT day, stid, {r('least(greatest(pred, lo), hi)', 4)} AS pred FROM ({_LOCAL_PRED}),
        (SELECT min(y) AS lo, max(y) AS hi FROM energy_nwp WHERE day < (SELECT d FROM label_cut))""",
    ),
    "ridge_normalised": query("obs_model", f"SELECT stid, day, y, {r('pred', 4)} AS pred FROM ({predicted(_ALL, _ALL, '1e-1')})"),
    "fit_per_station": query(
        "obs_model", f"SELECT stid, day, y, {r('pred', 4)} AS pred FROM ({predicted(keyed('stid'), keyed('stid'), '1e-1')})"
    ),
    "ridge_cv_alpha": query(
        "cv_rows cv_models cv_best",
        f"""SELECT stid, day, y, {r('my + ' + weighted(), 4)} AS pred, alpha FROM cv_rows JOIN cv_models USING (key)
        WHERE alpha = (SELECT alpha FROM cv_best)""",
    ),
    "ridge_cv_station": query(
        "station_rows station_models station_best",
        f"""SELECT stid, day, y, {r('my + ' + weighted(), 4)} AS pred, alpha, {r('sqrt(mse)', 4)} AS loo_rmse
        FROM station_rows JOIN station_models USING (key) JOIN station_best USING (key, alpha)""",
    ),
    "eval_cross_val": query(
        "obs_model obs_folds",
        f"""SELECT {r('avg(mae)')} AS mae, {r('2 * stddev_pop(mae)')} AS two_std FROM (
        SELECT key, avg(abs(y - pred)) AS mae FROM ({predicted(_LEFT_OUT, _HELD, '1e-5')}) GROUP BY key)""",
    ),
}
