"""Oracles: models and evaluations with an SQL meaning."""

from __future__ import annotations

import oracles.spatial  # noqa: F401  (defines the shared expressions)
from oracles.base import define, query, r

define(
    "train_climate",
    "SELECT month(day) AS mo, stid, avg(y) AS m FROM split_energy WHERE split = 'train' GROUP BY 1, 2",
    "split_energy",
)
define("nwp_labels", "SELECT *, dense_rank() OVER (ORDER BY day) - 1 AS pos FROM energy_nwp", "energy_nwp")
define(
    "nwp_marked",
    """SELECT stid, day, y, pos, pos >= (SELECT floor(count(DISTINCT day) * 0.5) FROM energy_nwp) AS late,
        (coalesce(y = before, FALSE) OR y - 100 * floor(y / 100) <> 0) AS is_masked
        FROM (SELECT *, lag(y) OVER (PARTITION BY stid ORDER BY day) AS before FROM nwp_labels)""",
    "nwp_labels",
)
define(
    "climate_tested",
    """SELECT t.*, c.m AS pred FROM nwp_marked t JOIN stations USING (stid)
        LEFT JOIN (SELECT month(day) AS mo, stid, avg(y) AS m FROM nwp_marked WHERE NOT late AND NOT is_masked GROUP BY 1, 2) c
        ON c.mo = month(t.day) AND c.stid = t.stid WHERE late AND c.m IS NOT NULL""",
    "nwp_marked", "stations",
)


def score_row(name: str, where: str = "", table: str = "climate_tested", digits: int = 6) -> str:
    return f"""SELECT '{name}' AS samples, count(*) AS n, {r('avg(abs(y - pred))', digits)} AS mae,
        {r('sqrt(avg((y - pred) * (y - pred)))', digits)} AS rmse,
        {r('1 - sum((y - pred) * (y - pred)) / (count(*) * var_pop(y))', digits)} AS r2 FROM {table} {where}"""


SQL = {
    "predict_climate": query(
        "train_climate",
        f"""SELECT e.day, e.stid, {r('c.m')} AS pred FROM split_energy e LEFT JOIN train_climate c
        ON c.mo = month(e.day) AND c.stid = e.stid WHERE split = 'test'""",
    ),
    "constant_models": query(
        "split_energy",
        f"""SELECT day, stid, kind, {r('v')} AS pred FROM (SELECT day, stid FROM split_energy WHERE split = 'test') CROSS JOIN (
        SELECT 'zero' AS kind, 0 AS v UNION ALL SELECT 'mean', avg(y) FROM split_energy WHERE split = 'train'
        UNION ALL SELECT 'median', quantile_cont(y, 0.5) FROM split_energy WHERE split = 'train')""",
    ),
    "eval_fold_scores": query(
        "energy folds",
        f"""SELECT fold, count(pred) AS n, {r('avg(abs(y - pred))')} AS mae FROM (
        SELECT a.day, a.stid, a.fold, a.y, avg(b.y) AS pred FROM (SELECT e.*, fold FROM energy e JOIN folds USING (day)) a
        LEFT JOIN (SELECT e.*, fold FROM energy e JOIN folds USING (day)) b
        ON b.stid = a.stid AND month(b.day) = month(a.day) AND b.fold <> a.fold GROUP BY 1, 2, 3, 4) GROUP BY fold""",
    ),
    "climate_scores": query("climate_tested", score_row("all") + " UNION ALL " + score_row("unmasked", "WHERE NOT is_masked")),
}
