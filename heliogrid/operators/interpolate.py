"""Interpolators that are linear in the map values, and Gaussian-process kriging.

With a fixed grid, spline, ridge trend, convolution and resampling are one weight
matrix (points x cells). Maps are bounded arrays; a task multiplies a batch of maps
by the matrix. Points travel with the task while they are proven few, and otherwise
meet the maps in blocks of bounded size.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heliogrid.operators.grid import GridSpec, map_vectors, maps_by_label
from heliogrid.operators.joins import bounded_rows, dealt, pair_up, shuffle_width

MAX_POINTS = 8_192
BLOCK_POINTS = 1_024
OUTPUT_ROWS = 200_000

# Kriging correlation lengths (lon, lat, elev), ridge penalty, and the
# nugget used where the member spread is not finite.
KRIGING_THETA = (1.0, 0.4, 1.0)
RIDGE_ALPHA = 0.1
FLOOR_NUGGET = 10.0 * 2.220446049250313e-16


# ---------------------------------------------------------------- weights


def not_a_knot_weights(axis, x) -> np.ndarray:
    """Rows of weights giving the interpolating cubic spline of axis values at x."""
    axis = np.asarray(axis, dtype=float)
    n = axis.size
    if n < 4:
        raise ValueError("a cubic spline needs at least four points per axis")
    x = np.clip(np.asarray(x, dtype=float), axis[0], axis[-1])
    h = np.diff(axis)
    system, rhs = np.zeros((n, n)), np.zeros((n, n))
    for i in range(1, n - 1):
        system[i, i - 1 : i + 2] = h[i - 1], 2.0 * (h[i - 1] + h[i]), h[i]
        rhs[i, i - 1 : i + 2] = 6.0 / h[i - 1], -6.0 / h[i - 1] - 6.0 / h[i], 6.0 / h[i]
    # the third derivative runs through the second and the last but one point
    system[0, :3] = h[1], -(h[0] + h[1]), h[0]
    system[-1, -3:] = h[-1], -(h[-2] + h[-1]), h[-2]
    curvature = np.linalg.solve(system, rhs)
    at = np.clip(np.searchsorted(axis, x, side="right") - 1, 0, n - 2)
    width = h[at]
    right, left = (axis[at + 1] - x), (x - axis[at])
    eye = np.eye(n)
    weights = (right / width)[:, None] * eye[at] + (left / width)[:, None] * eye[at + 1]
    weights += ((right**3 / width - width * right) / 6.0)[:, None] * curvature[at]
    weights += ((left**3 / width - width * left) / 6.0)[:, None] * curvature[at + 1]
    return weights


def _outer_rows(lat_w: np.ndarray, lon_w: np.ndarray) -> np.ndarray:
    return (lat_w[:, :, None] * lon_w[:, None, :]).reshape(lat_w.shape[0], -1)


def spline_weights(spec: GridSpec):
    """Bicubic spline in latitude and longitude, constant outside the grid."""

    def weights(points):
        return _outer_rows(not_a_knot_weights(spec.lats, points["nlat"]), not_a_knot_weights(spec.lons, points["elon"]))

    return weights


def ridge_trend_weights(cells: np.ndarray, alpha: float = RIDGE_ALPHA, normalise: bool = True):
    """Ridge of the value on (lon, lat, elev) of the cells, as weights on the cell values."""
    centre = cells.mean(axis=0)
    scale = np.sqrt(((cells - centre) ** 2).sum(axis=0)) if normalise else np.ones(cells.shape[1])
    scale = np.where(scale == 0, 1.0, scale)
    x = (cells - centre) / scale
    solved = np.linalg.solve(x.T @ x + alpha * np.eye(x.shape[1]), x.T)

    def weights(points):
        at = (_coordinates(points) - centre) / scale
        return 1.0 / len(cells) + at @ solved

    return weights


def kriging_weights(cells: np.ndarray, theta, nugget: float = FLOOR_NUGGET):
    """Kriging with one nugget for all cells is linear in the values."""

    def weights(points):
        model = GaussianProcess(cells, theta)
        near, _ = model.correlation(points)
        n = len(cells)
        system = model.between + nugget * np.eye(n)
        solved = np.linalg.solve(system, np.column_stack([np.ones(n), near.T]))
        ones, spread = solved[:, 0], solved[:, 1:].T
        trend = ones / ones.sum()
        return spread + (1.0 - spread.sum(axis=1))[:, None] * trend[None, :]

    return weights


def bilinear_weights(spec: GridSpec):
    """Weights of the four enclosing cells; NaN outside the hull."""

    def shares(axis, x):
        axis = np.asarray(axis, float)
        at = np.where(x == axis[0], 1, np.searchsorted(axis, x, side="left"))
        inner = (at >= 1) & (at < axis.size)
        at = np.where(inner, at, 1)
        share = (x - axis[at - 1]) / (axis[at] - axis[at - 1])
        weights = np.zeros((x.size, axis.size))
        weights[np.arange(x.size), at - 1], weights[np.arange(x.size), at] = 1.0 - share, share
        weights[~inner] = np.nan
        return weights

    return lambda points: _outer_rows(shares(spec.lats, np.asarray(points["nlat"], float)), shares(spec.lons, np.asarray(points["elon"], float)))


def zoom_axis_weights(n: int, zoom: float) -> np.ndarray:
    """Cubic B-spline resampling of n points, end points kept, mirrored at the ends."""
    m = max(int(math.floor(n * zoom + 0.5)), 1)
    at = np.arange(m) * ((n - 1) / (m - 1) if m > 1 else 0.0)
    mirror = lambda i: (n - 1) - abs((i % (2 * n - 2)) - (n - 1)) if n > 1 else 0
    samples = np.zeros((n, n))
    for i in range(n):
        for step, w in ((-1, 1 / 6), (0, 4 / 6), (1, 1 / 6)):
            samples[i, mirror(i + step)] += w
    basis = np.zeros((m, n))
    for r, x in enumerate(at):
        low = int(math.floor(x))
        for j in range(low - 1, low + 3):
            d = abs(x - j)
            w = (4 - 6 * d * d + 3 * d**3) / 6 if d < 1 else ((2 - d) ** 3 / 6 if d < 2 else 0.0)
            basis[r, mirror(j)] += w
    return basis @ np.linalg.inv(samples)


def zoom_points(spec: GridSpec, zoom: float) -> tuple[dict, np.ndarray]:
    lat_w, lon_w = zoom_axis_weights(spec.n_lat, zoom), zoom_axis_weights(spec.n_lon, zoom)
    rows, cols = np.divmod(np.arange(len(lat_w) * len(lon_w)), len(lon_w))
    return {"row": rows, "col": cols}, _outer_rows(lat_w[rows], lon_w[cols])


def window_points(spec: GridSpec, kernel: np.ndarray, row_step: int = 1, col_step: int = 1, skip_last_col: bool = False):
    """Valid-mode filter as weights: one point per kernel position inside the grid."""
    kh, kw = kernel.shape
    n_rows, n_cols = spec.n_lat - kh + 1, spec.n_lon - kw + 1
    if n_rows < 1 or n_cols < 1:
        raise ValueError("the kernel does not fit the grid")
    rows = np.arange(0, n_rows, row_step)
    cols = np.arange(0, n_cols - (1 if skip_last_col else 0), col_step)
    points = {"row": np.repeat(rows, cols.size), "col": np.tile(cols, rows.size)}
    weights = np.zeros((rows.size * cols.size, spec.n_lat, spec.n_lon))
    for p, (r, c) in enumerate(zip(points["row"], points["col"])):
        weights[p, r : r + kh, c : c + kw] = kernel
    return points, weights.reshape(len(weights), -1)


def box_kernel(k: int) -> np.ndarray:
    return np.full((k, k), 1.0 / (k * k))


def ring_kernel() -> np.ndarray:
    kernel = np.full((3, 3), 1.0 / 8.0)
    kernel[1, 1] = 0.0
    return kernel


# ---------------------------------------------------------------- kernels


def _coordinates(points) -> np.ndarray:
    return np.column_stack([points["elon"], points["nlat"], points["elev"]])


class LinearKernel:
    """Maps -> points by a weight matrix; a missing cell only spoils the points that use it."""

    outputs = ("value",)

    def __init__(self, weights):
        self.weights = weights

    def prepare(self, points):
        return self.weights(points) if callable(self.weights) else self.weights

    def run(self, prepared, maps):
        (values,) = maps
        absent = np.isnan(values)
        if not absent.any():
            return (values @ prepared.T,)
        result = np.where(absent, 0.0, values) @ prepared.T
        touched = absent.astype(float) @ (prepared != 0).astype(float).T
        return (np.where(touched > 0, np.nan, result),)


class SeparableKernel:
    """Maps -> a lattice, by weights of its rows and of its columns; a missing cell only spoils the points that use it."""

    outputs = ("value",)

    def __init__(self, by_row: np.ndarray, by_column: np.ndarray):
        self.by_row, self.by_column = by_row, by_column

    def prepare(self, points):
        return self.by_row, self.by_column

    def run(self, prepared, maps):
        (values,) = maps
        x = values.reshape(-1, self.by_row.shape[1], self.by_column.shape[1])
        absent = np.isnan(x)
        result = self.by_row @ np.where(absent, 0.0, x) @ self.by_column.T
        if absent.any():
            touched = (self.by_row != 0).astype(float) @ absent.astype(float) @ (self.by_column != 0).astype(float).T
            result = np.where(touched > 0, np.nan, result)
        return (result.reshape(len(x), -1),)


class GaussianProcess:
    """Correlation part of the kriging model, shared by all maps of a grid."""

    def __init__(self, cells: np.ndarray, theta=KRIGING_THETA):
        spread = cells.std(axis=0)
        self.centre, self.scale = cells.mean(axis=0), np.where(spread == 0, 1.0, spread)
        self.theta = np.asarray(theta, dtype=float)
        self.cells = (cells - self.centre) / self.scale
        self.between = self._correlate(self.cells)

    def _correlate(self, at):
        gap = at[:, None, :] - self.cells[None, :, :]
        return np.exp(-np.einsum("pcd,d->pc", gap * gap, self.theta))

    def correlation(self, points):
        at = (_coordinates(points) - self.centre) / self.scale
        return self._correlate(at), at


class KrigingKernel:
    """Constant-trend kriging with a nugget per cell: prediction and its standard error."""

    outputs = ("value", "sigma")
    batch = 32

    def __init__(self, cells: np.ndarray, theta=KRIGING_THETA):
        self.model = GaussianProcess(cells, theta)

    def prepare(self, points):
        return self.model.correlation(points)[0]

    def run(self, near, maps):
        values, nuggets = maps
        parts = [self._solve(near, values[i : i + self.batch], nuggets[i : i + self.batch]) for i in range(0, len(values), self.batch)]
        return tuple(np.concatenate(p) for p in zip(*parts))

    def _solve(self, near, values, nuggets):
        count, n = values.shape
        bad = np.isnan(values).any(axis=1)
        values = np.where(np.isnan(values), 0.0, values)
        mean = values.mean(axis=1, keepdims=True)
        std = values.std(axis=1, keepdims=True)
        std = np.where(std == 0, 1.0, std)
        y = (values - mean) / std
        system = np.broadcast_to(self.model.between, (count, n, n)).copy()
        diagonal = np.arange(n)
        system[:, diagonal, diagonal] = 1.0 + np.nan_to_num(nuggets, nan=FLOOR_NUGGET)
        right = np.empty((count, n, 2 + len(near)))
        right[:, :, 0], right[:, :, 1], right[:, :, 2:] = 1.0, y, near.T
        solved = np.linalg.solve(system, right)
        ones, by_value, by_near = solved[:, :, 0], solved[:, :, 1], solved[:, :, 2:]
        information = ones.sum(axis=1)
        beta = by_value.sum(axis=1) / information
        gamma = by_value - beta[:, None] * ones
        predicted = beta[:, None] + gamma @ near.T
        rho2 = np.einsum("bn,bn->b", y - beta[:, None], gamma)
        variance = rho2 / n * std[:, 0] ** 2
        explained = np.einsum("pn,bnp->bp", near, by_near)
        trend_gap = by_near.sum(axis=1) - 1.0
        mse = variance[:, None] * (1.0 - explained + trend_gap**2 / information[:, None])
        result = mean + std * predicted
        sigma = np.sqrt(np.maximum(mse, 0.0))
        result[bad], sigma[bad] = np.nan, np.nan
        return result, sigma


class SlotKernel:
    """Slots of several maps (members, hours) -> mean and, where named, spread over a slot's maps of their values at the points."""

    ragged = True  # a slot's array holds map after map, any number of them

    def __init__(self, weights, means, spreads=()):
        self.weights, self.spreads = weights, tuple(spreads)
        self.outputs = (*means, *spreads)

    def prepare(self, points):
        return self.weights(points)

    def run(self, prepared, slots):
        linear = LinearKernel(None)
        stats = [over_maps(linear.run(prepared, (values,))[0], counts) for values, counts in slots]
        return tuple(m for m, _ in stats) + (tuple(s for _, s in stats) if self.spreads else ())


def over_maps(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population spread of the known values of each row's maps (``counts`` maps a row); NaN where none is known."""
    mean, spread = np.full((2, len(counts), values.shape[1]), np.nan)
    starts = np.cumsum(counts) - counts
    for count in np.unique(counts[counts > 0]):
        at = np.flatnonzero(counts == count)
        x = values[starts[at][:, None] + np.arange(count)]
        known = ~np.isnan(x)
        n = known.sum(axis=1)
        some = np.maximum(n, 1)
        centre = np.where(known, x, 0.0).sum(axis=1) / some
        gaps = np.where(known, x - centre[:, None], 0.0)
        mean[at] = np.where(n > 0, centre, np.nan)
        spread[at] = np.where(n > 0, np.sqrt((gaps * gaps).sum(axis=1) / some), np.nan)
    return mean, spread


class CopyMeans:
    """A kernel of one output, averaged over the known values of the points of an id: one row per map and id. All points of an id are in one task."""

    def __init__(self, kernel, by: str = "stid"):
        self.kernel, self.by, self.outputs = kernel, by, kernel.outputs

    def _numbers(self, points):
        first = {}
        numbers = np.array([first.setdefault(i, len(first)) for i in points[self.by].tolist()], dtype=int)
        return numbers, np.array([*first], dtype=points[self.by].dtype)

    def seen(self, points):
        return {self.by: self._numbers(points)[1]}

    def prepare(self, points):
        numbers, ids = self._numbers(points)
        order = np.argsort(numbers, kind="stable")
        starts = np.searchsorted(numbers[order], np.arange(len(ids)))
        return self.kernel.prepare({k: v[order] for k, v in points.items()}), starts

    def run(self, prepared, maps):
        inner, starts = prepared
        (values,) = self.kernel.run(inner, maps)
        known = ~np.isnan(values)
        n = np.add.reduceat(known, starts, axis=1, dtype=float)
        total = np.add.reduceat(np.where(known, values, 0.0), starts, axis=1)
        return (np.where(n > 0, total / np.maximum(n, 1.0), np.nan),)


class KrigingSlots:
    """Kriging of one map a slot: the values of all slots, then their standard errors. Maps come as means, then nuggets."""

    def __init__(self, cells: np.ndarray, theta, values, sigmas):
        self.kernel = KrigingKernel(cells, theta)
        self.outputs = (*values, *sigmas)

    def prepare(self, points):
        return self.kernel.prepare(points)

    def run(self, prepared, maps):
        slots = len(maps) // 2
        solved = [self.kernel.run(prepared, (maps[i], maps[slots + i])) for i in range(slots)]
        return tuple(v for v, _ in solved) + tuple(s for _, s in solved)


# ---------------------------------------------------------------- jobs


def _maps_of(column: pa.Array, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """All maps of a column whose lists hold any number of maps, and their number by row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=float).reshape(-1, cells), sizes // cells


def _matrix(column: pa.Array) -> np.ndarray:
    """Equally long lists as a 2-D array, NULL as NaN."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, dtype=float).reshape(len(column), -1)


def _emit(batch, keys, ids, points, prepared, kernel, map_columns, schema):
    """Output batches for some maps at some points, bounded in rows."""
    points = kernel.seen(points) if hasattr(kernel, "seen") else points
    count = len(points[ids[0]])
    step = max(1, OUTPUT_ROWS // max(count, 1))
    for start in range(0, batch.num_rows, step):
        part = batch.slice(start, step)
        if getattr(kernel, "ragged", False):
            maps = [_maps_of(part.column(c), prepared.shape[1]) for c in map_columns]
        else:
            maps = [_matrix(part.column(c)) for c in map_columns]
        results = kernel.run(prepared, maps)
        rows = pa.array(np.repeat(np.arange(part.num_rows), count))
        columns = [part.column(k).take(rows) for k in keys]
        columns += [pa.array(np.tile(points[i], part.num_rows), type=schema.field(i).type, from_pandas=i == "y") for i in ids]
        for values in results:
            flat = values.reshape(-1)
            columns.append(pa.array(flat, mask=np.isnan(flat), type=pa.float64()))
        yield pa.RecordBatch.from_arrays(columns, schema=schema)


def at_points(maps: DataFrame, keys: list[str], points, ids: list[str], kernel, map_columns=("cells",), max_points: int = MAX_POINTS, pairs: DataFrame | None = None) -> DataFrame:
    """Runs a kernel on every map at every point: rows (keys, ids, kernel outputs).

    ``points`` is a dict of arrays (bounded by the grid), or a DataFrame of points. A
    DataFrame is collected only when proven small; a larger one is cut into blocks of
    bounded size that are paired with the maps. With ``pairs`` (day, some of the ids, a number y) a map meets the points named for
    its day only, and y comes along.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql import types as T

    map_columns, attributes = list(map_columns), ["nlat", "elon", "elev"]
    fixed = isinstance(points, dict)
    kept = maps.select(*keys, *map_columns)
    id_fields = (
        [T.StructField(i, T.IntegerType()) for i in ids] if fixed else [points.schema[i] for i in ids]
    )
    if pairs is not None:
        id_fields.append(pairs.schema["y"])
    out = T.StructType(
        [maps.schema[k] for k in keys] + id_fields + [T.StructField(o, T.DoubleType()) for o in kernel.outputs]
    )
    arrow = to_arrow_schema(out)

    if not fixed:
        wanted = points.select(*ids, *[a for a in attributes if a not in ids])
        if pairs is not None:
            return _at_pairs(kept, keys, pairs, wanted, ids, kernel, map_columns, out)
        rows = bounded_rows(wanted, max_points)
        if rows is not None:
            points = {c: np.array([r[c] for r in rows]) for c in wanted.columns}
            fixed = True
    if fixed:

        def run_all(batches):
            prepared = None
            for batch in batches:
                prepared = kernel.prepare(points) if prepared is None else prepared
                yield from _emit(batch, keys, ids, points, prepared, kernel, map_columns, arrow)

        return kept.mapInArrow(run_all, out)

    blocks = math.ceil(wanted.count() / BLOCK_POINTS)
    # by the first id, so that the copies of a station meet a map in the same task
    grouped = wanted.groupBy(F.pmod(F.xxhash64(ids[0]), F.lit(blocks)).alias("_block")).agg(
        F.collect_list(F.struct(*wanted.columns)).alias("_points")
    )
    names = wanted.columns
    split = grouped.select("_block", *[F.col("_points").getField(c).alias(f"_p_{c}") for c in names])
    paired = pair_up(kept, split)

    def run_blocks(batches):
        cached = {}
        for batch in batches:
            block_ids = batch.column("_block").to_numpy()
            for block in np.unique(block_ids):
                chosen = batch.take(pa.array(np.flatnonzero(block_ids == block)))
                if block not in cached:
                    local = {c: chosen.column(f"_p_{c}")[0].values.to_numpy(zero_copy_only=False) for c in names}
                    if len(cached) >= 8:
                        cached.clear()
                    cached[block] = (local, kernel.prepare(local))
                local, prepared_block = cached[block]
                yield from _emit(chosen, keys, ids, local, prepared_block, kernel, map_columns, arrow)

    return paired.mapInArrow(run_blocks, out)


def _at_pairs(maps, keys, pairs, points, ids, kernel, map_columns, out) -> DataFrame:
    """``at_points`` for wanted (day, point) pairs: those of a day are dealt to chunks of bounded size, which meet the day's maps."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow, known = to_arrow_schema(out), [i for i in ids if i in pairs.columns]
    most = pairs.groupBy("day").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    chunk = F.pmod(F.xxhash64(*known), F.lit(math.ceil(most / BLOCK_POINTS)))
    wanted = pairs.select("day", *known, "y").join(points, known)
    names = [*points.columns, "y"]
    chunks = wanted.groupBy("day", chunk.alias("_chunk")).agg(F.collect_list(F.struct(*names)).alias("_points"))
    met = maps.join(chunks.select("day", "_chunk", *[F.col("_points").getField(c).alias(f"_p_{c}") for c in names]), "day")
    # few rows with much work each: a given number of partitions isn't merged into one task
    met = met.repartition(shuffle_width(maps), "day", "_chunk")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                local = {c: row.column(f"_p_{c}")[0].values.to_numpy(zero_copy_only=False) for c in names}
                yield from _emit(row, keys, [*ids, "y"], local, kernel.prepare(local), kernel, map_columns, arrow)

    return met.mapInArrow(run, out)


def _map_keys(cube: DataFrame, values) -> list[str]:
    return [c for c in cube.columns if c not in ("lat_i", "lon_i", *values)]


def interpolate_linear_kernel(cube: DataFrame, points, spec: GridSpec, weights, ids=("stid",), **limits) -> DataFrame:
    """A weight-matrix interpolator on every map of a long cube."""
    keys = _map_keys(cube, ("value",))
    maps = map_vectors(cube, keys, spec)
    return at_points(maps, keys, points, list(ids), LinearKernel(weights), **limits)


def grid_coordinates(grid: DataFrame, spec: GridSpec) -> np.ndarray:
    """(lon, lat, elev) of the cells in cell order; the grid is a small fixed table."""
    rows = bounded_rows(grid.select("lat_i", "lon_i", "lon", "lat", "elev"), spec.n_cells)
    if rows is None or len(rows) != spec.n_cells:
        raise ValueError(f"the grid table must hold {spec.n_cells} cells")
    ordered = sorted(rows, key=lambda r: (r["lat_i"], r["lon_i"]))
    return np.array([[r["lon"], r["lat"], r["elev"]] for r in ordered], dtype=float)


def interpolate_spline(cube, points, spec, ids=("stid",), **limits):
    return interpolate_linear_kernel(cube, points, spec, spline_weights(spec), ids, **limits)


def regrid_spline(cube: DataFrame, spec: GridSpec, per_axis: int = 10) -> DataFrame:
    """The bicubic spline on a ``per_axis`` times finer lattice: (map keys, point, value), points row by row."""
    axes = [np.asarray(a, float) for a in (spec.lats, spec.lons)]
    fine = [a[0] + np.arange(per_axis * a.size) * ((a[-1] - a[0]) / (per_axis * a.size - 1)) for a in axes]
    kernel = SeparableKernel(*[not_a_knot_weights(a, f) for a, f in zip(axes, fine)])
    keys = _map_keys(cube, ("value",))
    points = {"point": np.arange(fine[0].size * fine[1].size, dtype=np.int32)}
    return at_points(map_vectors(cube, keys, spec), keys, points, ["point"], kernel).withColumn("point", F.col("point").cast("long"))


def copy_means(cube, copies, spec: GridSpec, **limits) -> DataFrame:
    """The mean over the copies of a station of the spline of every map: (map keys, stid, pred). Copies meet a map in one task."""
    keys = _map_keys(cube, ("value",))
    kernel = CopyMeans(LinearKernel(spline_weights(spec)))
    return at_points(map_vectors(cube, keys, spec), keys, copies, ["stid"], kernel, **limits).withColumnRenamed("value", "pred")


def interpolate_ridge(cube, points, spec, grid, alpha: float = RIDGE_ALPHA, ids=("stid",), **limits):
    weights = ridge_trend_weights(grid_coordinates(grid, spec), alpha)
    return interpolate_linear_kernel(cube, points, spec, weights, ids, **limits)


def kriging_nugget(stats: DataFrame) -> DataFrame:
    """Adds (std / mean)^2 per cell, or the floor where that is not finite."""
    ratio = F.col("std") / F.when(F.col("mean") != 0, F.col("mean"))
    return stats.withColumn("nugget", F.coalesce(ratio * ratio, F.lit(FLOOR_NUGGET)))


def interpolate_kriging(cube, points, spec, grid, theta=KRIGING_THETA, ids=("stid",), **limits) -> DataFrame:
    """Kriging of the member mean with the member spread as nugget: value and sigma.

    Members are reduced before the solve, so one system per (day, feature, hour) is left.
    """
    from heliogrid.operators.reduce import ensemble_stats

    stats = kriging_nugget(ensemble_stats(cube))
    keys = ["day", "fx", "hour"]
    maps = map_vectors(stats, keys, spec, ("mean", "nugget"), ("cells", "nuggets"))
    kernel = KrigingKernel(grid_coordinates(grid, spec), theta)
    return at_points(maps, keys, points, list(ids), kernel, ("cells", "nuggets"), **limits)


# ---------------------------------------------------------------- slots

# Columns a station design takes along with the points.
PLACE = ("nlat", "elon", "elev")


def one_place(points: DataFrame, ids) -> bool:
    """True when no id is found at two places."""
    places = points.select(*ids, *PLACE).distinct()
    return places.groupBy(*ids).agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def gathered_maps(cube: DataFrame, keys: list[str], label, names, spec: GridSpec) -> DataFrame:
    """One row per key; for each label, column s0, s1, ..., the cells of all its maps, map after map."""
    every = _map_keys(cube, ("value",))
    entry = F.struct(*[c for c in every if c not in keys], "cells")
    labelled = map_vectors(cube, every, spec).withColumns({"_k": label, "_e": entry})
    lists = labelled.groupBy(*keys).agg(*[F.sort_array(F.collect_list(F.when(F.col("_k") == n, F.col("_e")))).alias(f"s{i}") for i, n in enumerate(names)])
    return lists.select(*keys, *[F.flatten(F.transform(f"s{i}", lambda e: e.getField("cells"))).alias(f"s{i}") for i in range(len(names))])


def slot_label():
    return F.concat_ws("_", "fx", "hour")


# Prefix of the values of the day before.
BEFORE = "_before_"


def with_day_before(maps: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Adds the maps of the preceding row in day order of the same other keys, those of the row itself on the first day.

    Only keys are numbered, in one row a day; maps travel twice and meet by number.
    """
    others = [k for k in keys if k != "day"]
    numbered = maps.select(*[F.col(k).alias(f"_k_{k}") for k in keys]).distinct()
    numbered = numbered.withColumn("_n", F.row_number().over(Window.partitionBy(*[f"_k_{k}" for k in others]).orderBy("_k_day")))
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    placed = maps.join(numbered, same).select(*others, F.explode(F.array("_n", F.col("_n") + 1)).alias("_at"), "_n", F.struct("day", *columns).alias("_m"))
    own = F.first(F.when(F.col("_at") == F.col("_n"), F.col("_m")), ignorenulls=True)
    before = F.first(F.when(F.col("_at") != F.col("_n"), F.col("_m")), ignorenulls=True)
    both = placed.groupBy(*others, "_at").agg(own.alias("_own"), before.alias("_before")).where("_own is not null")
    earlier = F.coalesce("_before", "_own")
    both = both.select("_own.day", *others, *[f"_own.{c}" for c in columns], *[earlier.getField(c).alias(f"{BEFORE}{c}") for c in columns])
    return dealt(both, keys)


def slots_at_points(cube: DataFrame, points, spec: GridSpec, weights, features, hours, keys=("day",), ids=("stid",), spreads: bool = False, before: bool = False, **limits) -> DataFrame:
    """A weight-matrix interpolator of all hours of all features at once: one row per key and point, with the points' places.

    Columns are ``nm_intp_<feature>_<hour>`` and, with ``spreads``, ``nm_intp_sigma_...``: mean and spread over a slot's maps,
    those of the members unless members are keys. The rows that meet the points are wide already, so none is regrouped.
    With ``before`` the values of the day before come along, their names prefixed, from that day's maps (of the first day: its own).
    """
    slots = [f"{f}_{h}" for f in features for h in hours]
    maps = gathered_maps(cube, list(keys), slot_label(), slots, spec)
    means, sigmas = [f"nm_intp_{s}" for s in slots], [f"nm_intp_sigma_{s}" for s in slots] if spreads else []
    columns = [f"s{i}" for i in range(len(slots))]
    if not before:
        return at_points(maps, list(keys), points, [*ids, *PLACE], SlotKernel(weights, means, sigmas), columns, **limits)
    maps = with_day_before(maps, list(keys), columns)
    prefixed = lambda names: [*names, *[f"{BEFORE}{n}" for n in names]]
    # the row before that of a repeated point is the one of the same day
    points = points.withColumn("_nth", F.row_number().over(Window.partitionBy(*ids).orderBy(*ids)))
    kernel = SlotKernel(weights, prefixed(means), prefixed(sigmas))
    rows = at_points(maps, list(keys), points, [*ids, *PLACE, "_nth"], kernel, prefixed(columns), **limits)
    earlier = {f"{BEFORE}{n}": F.when(F.col("_nth") == 1, F.col(f"{BEFORE}{n}")).otherwise(F.col(n)) for n in [*means, *sigmas]}
    return rows.withColumns(earlier).drop("_nth")


def kriged_slots(cube: DataFrame, points, spec: GridSpec, grid, features, hours, theta=KRIGING_THETA, ids=("stid",), **limits) -> DataFrame:
    """``interpolate_kriging`` as one row per (day, point), in the columns of ``slots_at_points``."""
    from heliogrid.operators.reduce import ensemble_stats

    slots = [f"{f}_{h}" for f in features for h in hours]
    stats = kriging_nugget(ensemble_stats(cube))
    wide = maps_by_label(stats, ["day"], slot_label(), slots, spec, ("mean", "nugget"))
    fields = [(f"{v}{i}", F.col(f"`{s}`").getField(v)) for v in ("mean", "nugget") for i, s in enumerate(slots)]
    kernel = KrigingSlots(grid_coordinates(grid, spec), theta, [f"nm_intp_{s}" for s in slots], [f"nm_intp_sigma_{s}" for s in slots])
    maps = wide.select("day", *[c.alias(n) for n, c in fields])
    return at_points(maps, ["day"], points, [*ids, *PLACE], kernel, [n for n, _ in fields], **limits)


# ---------------------------------------------------------------- hidden cells


def interior_cells(spec: GridSpec, count: int, seed: int = 5) -> np.ndarray:
    """Seeded choice of cells away from the border to be hidden and predicted."""
    rows, cols = np.divmod(np.arange(spec.n_cells), spec.n_lon)
    inner = np.flatnonzero((rows > 0) & (rows < spec.n_lat - 1) & (cols > 0) & (cols < spec.n_lon - 1))
    return np.sort(np.random.RandomState(seed).permutation(inner)[:count])
