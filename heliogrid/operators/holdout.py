"""Scores of interpolators on hidden cells of the grid, over all maps and several sets of hidden cells.

Kriging factorises the whole grid once (for every map if the nugget is that of its members, else once for all maps) and
takes each set of hidden cells out by a Schur complement: with Q the inverse over all cells, the inverse over the kept
ones is Q_KK - Q_KH Q_HH^-1 Q_HK, so a set costs a system of its own size. Cells are scaled by the whole grid, whatever is
hidden. Splines and the ridge trend are one matrix of weights for a set. A map with a missing cell takes no part.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliogrid.operators.grid import GridSpec, map_vectors
from heliogrid.operators.interpolate import FLOOR_NUGGET, KRIGING_THETA, GaussianProcess, _matrix, interior_cells, kriging_nugget, not_a_knot_weights, ridge_trend_weights
from heliogrid.operators.reduce import ensemble_stats

#: Maps whose systems are inverted together.
BATCH = 64


@dataclass(frozen=True)
class Kriging:
    """Gaussian process with a constant trend; the nugget of every cell is that of its members, or one for all cells."""

    theta: tuple[float, float, float] = KRIGING_THETA
    nugget: float | None = None

    @property
    def name(self) -> str:
        lengths = " ".join(f"{v:.6g}" for v in self.theta)
        return f"kriging {lengths}" + (" member spread" if self.nugget is None else "")


@dataclass(frozen=True)
class Ridge:
    alpha: float = 0.1
    normalise: bool = True

    @property
    def name(self) -> str:
        return f"ridge {self.alpha:g}" + ("" if self.normalise else " raw")


@dataclass(frozen=True)
class Spline:
    """Mean of the cubic splines along the cell's row and along its column, through the cells that are left."""

    name: str = "spline"


def hidden_sets(spec: GridSpec, count: int = 20, sets: int = 5, seed: int = 5) -> list[np.ndarray]:
    """Seeded choices of inner cells; the first is that of ``interior_cells``."""
    return [interior_cells(spec, count, seed + i) for i in range(sets)]


def predict_hidden(inverse: np.ndarray, values: np.ndarray, hidden: np.ndarray) -> np.ndarray:
    """Kriging predictions (maps x hidden) from the inverse over all cells (one, or one a map) and all values (maps x cells)."""
    kept = np.setdiff1d(np.arange(values.shape[1]), hidden)
    across = inverse[..., :, kept]
    ones = across.sum(axis=-1)
    by_value = np.einsum("...ck,...k->...c", across, values[:, kept])
    own = inverse[..., hidden[:, None], hidden]
    ones = np.broadcast_to(ones, by_value.shape)
    right = np.stack([ones[:, hidden], by_value[:, hidden]], axis=-1)
    solved = np.linalg.solve(np.broadcast_to(own, (len(values), *own.shape[-2:])), right)
    t_one, t_value = solved[..., 0], solved[..., 1]
    edge = ones[:, hidden]
    trend = (by_value[:, kept].sum(axis=1) - (edge * t_value).sum(axis=1)) / (ones[:, kept].sum(axis=1) - (edge * t_one).sum(axis=1))
    return trend[:, None] - (t_value - trend[:, None] * t_one)


def spline_left_weights(spec: GridSpec, hidden: np.ndarray) -> np.ndarray:
    """Weights (hidden x cells) of the mean of row and column spline; a line with fewer than four cells left takes no part."""
    gone = np.zeros((spec.n_lat, spec.n_lon), bool)
    gone.reshape(-1)[hidden] = True
    out = np.zeros((len(hidden), spec.n_lat, spec.n_lon))
    for k, (i, j) in enumerate(zip(*np.divmod(hidden, spec.n_lon))):
        row, column = np.flatnonzero(~gone[i]), np.flatnonzero(~gone[:, j])
        lines = [(row, spec.lons, j), (column, spec.lats, i)]
        able = [len(line) >= 4 for line, _, _ in lines]
        if not any(able):
            out[k] = np.nan
            continue
        for horizontal, (line, axis, at), good in zip((True, False), lines, able):
            if good:
                axis = np.asarray(axis, dtype=float)
                weights = not_a_knot_weights(axis[line], np.array([axis[at]]))[0] / sum(able)
                if horizontal:
                    out[k, i, line] += weights
                else:
                    out[k, line, j] += weights
    return out.reshape(len(hidden), -1)


def _fixed(candidate, spec: GridSpec, cells: np.ndarray, sets: list[np.ndarray]) -> list[Callable] | None:
    """Predictors of the sets that are the same for all maps; None where every map has its own."""
    n = len(cells)
    if isinstance(candidate, Spline):
        matrices = [spline_left_weights(spec, h) for h in sets]
        return [lambda values, m=m: values @ m.T for m in matrices]
    if isinstance(candidate, Ridge):
        out = []
        for h in sets:
            kept = np.setdiff1d(np.arange(n), h)
            m = ridge_trend_weights(cells[kept], candidate.alpha, candidate.normalise)({"elon": cells[h, 0], "nlat": cells[h, 1], "elev": cells[h, 2]})
            out.append(lambda values, m=m, k=kept: values[:, k] @ m.T)
        return out
    if candidate.nugget is None:
        return None
    inverse = np.linalg.inv(GaussianProcess(cells, candidate.theta).between + candidate.nugget * np.eye(n))
    # the prediction is linear in the values: its matrix is that of the unit maps
    matrices = [predict_hidden(inverse, np.eye(n), h) for h in sets]
    return [lambda values, m=m: values @ m for m in matrices]


def holdout(cube: DataFrame, spec: GridSpec, cells: np.ndarray, candidates: list, sets: list[np.ndarray]) -> DataFrame:
    """(candidate, hidden_set, mae, mse, n) over all maps of the member mean; NULL scores where no hidden cell can be told."""
    stats = kriging_nugget(ensemble_stats(cube))
    maps = map_vectors(stats, ["day", "fx", "hour"], spec, ("mean", "nugget"), ("cells", "nuggets")).select("cells", "nuggets")
    names = [c.name for c in candidates]

    def score(batches):
        total = np.zeros((len(candidates), len(sets), 3))
        known = [_fixed(c, spec, cells, sets) for c in candidates]
        between = [None if k is not None else GaussianProcess(cells, c.theta).between for c, k in zip(candidates, known)]

        def add(c: int, s: int, pred: np.ndarray, values: np.ndarray) -> None:
            error = pred - values[:, sets[s]]
            error = error[~np.isnan(error)]
            total[c, s] += np.abs(error).sum(), (error**2).sum(), error.size

        for batch in batches:
            if not batch.num_rows:
                continue
            values, nuggets = _matrix(batch.column("cells")), _matrix(batch.column("nuggets"))
            whole = ~np.isnan(values).any(axis=1)
            values, nuggets = values[whole], np.nan_to_num(nuggets[whole], nan=FLOOR_NUGGET)
            for c, predictors in enumerate(known):
                if predictors is not None:
                    for s, predict in enumerate(predictors):
                        add(c, s, predict(values), values)
                    continue
                for at in range(0, len(values), BATCH):
                    part = values[at : at + BATCH]
                    system = np.broadcast_to(between[c], (len(part), *between[c].shape)).copy()
                    diagonal = np.arange(system.shape[1])
                    system[:, diagonal, diagonal] += nuggets[at : at + BATCH]
                    inverse = np.linalg.inv(system)
                    for s, h in enumerate(sets):
                        add(c, s, predict_hidden(inverse, part, h), part)
        rows = [(names[c], s, *total[c, s]) for c in range(len(names)) for s in range(len(sets))]
        columns = list(zip(*rows)) if rows else [[]] * 5
        types = [pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([int(v) if t == pa.int64() else v for v in x], t) for x, t in zip(columns, types)], names=["candidate", "hidden_set", "a", "s", "n"])

    sums = maps.mapInArrow(score, "candidate string, hidden_set int, a double, s double, n long").groupBy("candidate", "hidden_set").agg(F.sum("a").alias("a"), F.sum("s").alias("s"), F.sum("n").alias("n"))
    some = F.col("n") > 0
    return sums.select("candidate", "hidden_set", F.when(some, F.col("a") / F.col("n")).alias("mae"), F.when(some, F.col("s") / F.col("n")).alias("mse"), "n")


def over_sets(scores: DataFrame) -> DataFrame:
    """(candidate, mae, mse, n): the scores of all sets together."""
    n = F.sum("n")
    return scores.groupBy("candidate").agg((F.sum(F.col("mae") * F.col("n")) / n).alias("mae"), (F.sum(F.col("mse") * F.col("n")) / n).alias("mse"), n.alias("n"))


def sweep(draws: int = 100, seed: int = 0) -> list:
    """Random kriging lengths and a grid of ridge penalties."""
    # Centre and spread of the drawn lengths (lon, lat, elev).
    centre, width = (8.0, 8.0, 5.0), (2.0, 2.0, 2.0)
    thetas = np.abs(np.random.RandomState(seed).normal(centre, width, size=(draws, 3)))
    ridges = [Ridge(10.0**e, normalise) for e in range(-7, 1) for normalise in (True, False)]
    return [Kriging(tuple(t), FLOOR_NUGGET) for t in thetas] + ridges
