"""Station designs from several blocks of different rank.

A cube block (day, fx, ens, hour, cell) is reduced over hours and members, each by mean or spread, and becomes arrays in one row a day. From it
a station takes the cells around it, or every station takes the whole map after a box filter. A day block has one row a day and
is the same for all stations. All blocks of a day are one row before days meet stations, so stations multiply rows once, and no
block is taken apart into cells. Box filters are differences of prefix sums in two directions: their cost doesn't grow with the box.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce as fold

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heliogrid.functions.dates import one_hot
from heliogrid.operators import grid as g
from heliogrid.operators.features import index_rows
from heliogrid.operators.interpolate import _matrix
from heliogrid.operators.reduce import reduce_axis


@dataclass(frozen=True)
class Window:
    """The 2k x 2k cells around the station; cells off the grid are NULL."""

    k: int = 1


@dataclass(frozen=True)
class Box:
    """The means of k x k cells that lie inside the grid: every ``step``-th row and column, the last column left out."""

    k: int = 5
    step: int = 2

    def places(self, spec: g.GridSpec) -> tuple[np.ndarray, np.ndarray]:
        rows, columns = spec.n_lat - self.k + 1, spec.n_lon - self.k + 1
        if rows < 1 or columns < 1:
            raise ValueError("the box does not fit the grid")
        return np.arange(0, rows, self.step), np.arange(0, columns - 1, self.step)


@dataclass(frozen=True)
class CubeBlock:
    """``features`` of a cube; ``hour`` and ``ens`` are mean or std, ``hour`` may be None: then every hour is a feature."""

    name: str
    cube: DataFrame
    features: tuple[str, ...]
    hours: tuple[int, ...] = ()
    hour: str | None = "mean"
    ens: str = "mean"
    view: Window | Box = Window()

    def labels(self) -> list[str]:
        return list(self.features) if self.hour else [f"{f}_{h}" for f in self.features for h in self.hours]

    def maps(self, spec: g.GridSpec) -> DataFrame:
        """day, and one array of cells for each label, named ``<block>__<label>``."""
        if not self.hour and not self.hours:
            raise ValueError(f"block {self.name}: without a reduction the hours must be named")
        chosen = self.cube.where(F.col("fx").isin(*self.features))
        if self.hour:
            chosen, label = reduce_axis(chosen, "hour", self.hour), F.col("fx")
        else:
            label = F.concat_ws("_", "fx", "hour")
        chosen = reduce_axis(chosen, "ens", self.ens)
        names = self.labels()
        table = g.maps_by_label(chosen, ["day"], label, names, spec)
        table = table.select("day", *[F.col(f"`{n}`").getField("value").alias(self._array(n)) for n in names])
        return box_filtered(table, [self._array(n) for n in names], spec, self.view) if isinstance(self.view, Box) else table

    def _array(self, label: str) -> str:
        return f"{self.name}__{label}"

    def columns(self, spec: g.GridSpec, row: str = "lat_idx", column: str = "lon_idx") -> list[Column]:
        """Values of a row that holds the arrays of a day and a station's indices, named ``row`` and ``column``."""
        out = []
        for n in self.labels():
            array = F.col(f"`{self._array(n)}`")
            if isinstance(self.view, Box):
                rows, columns = self.view.places(spec)
                out += [F.get(array, F.lit(a * len(columns) + b)).alias(f"{self.name}_{n}_{i}_{j}") for a, i in enumerate(rows) for b, j in enumerate(columns)]
            else:
                k = self.view.k
                for i, j in g.window_offsets(k):
                    value = g.cell_value(array, spec, F.col(row) + i, F.col(column) + j)
                    out.append(value.alias(f"{self.name}_{n}_{i + k}_{j + k}"))
        return out


@dataclass(frozen=True)
class DayBlock:
    """Columns of a table with one row a day."""

    name: str
    table: DataFrame
    values: tuple[str, ...]

    def maps(self, spec: g.GridSpec) -> DataFrame:
        return self.table.select("day", *[F.col(f"`{v}`").cast("double").alias(f"{self.name}__{v}") for v in self.values])

    def columns(self, spec: g.GridSpec, row: str = "lat_idx", column: str = "lon_idx") -> list[Column]:
        return [F.col(f"`{self.name}__{v}`").alias(f"{self.name}_{v}") for v in self.values]


def box_sums(x: np.ndarray, k: int) -> np.ndarray:
    """Sums of all k x k boxes of maps (maps x rows x columns), by prefix sums."""
    ends = np.zeros((x.shape[0], x.shape[1] + 1, x.shape[2] + 1))
    ends[:, 1:, 1:] = x.cumsum(axis=1).cumsum(axis=2)
    return ends[:, k:, k:] - ends[:, :-k, k:] - ends[:, k:, :-k] + ends[:, :-k, :-k]


def box_means(cells: np.ndarray, spec: g.GridSpec, box: Box) -> np.ndarray:
    """Means of the boxes of maps (maps x cells), row by row; NaN where a cell of the box is missing."""
    rows, columns = box.places(spec)
    x = cells.reshape(-1, spec.n_lat, spec.n_lon)
    known = ~np.isnan(x)
    # around the map's own mean, so that differences of prefix sums lose nothing to a large level
    level = np.where(known, x, 0.0).sum(axis=(1, 2)) / np.maximum(known.sum(axis=(1, 2)), 1)
    gaps = box_sums(np.where(known, x - level[:, None, None], 0.0), box.k) / box.k**2 + level[:, None, None]
    gaps[box_sums((~known).astype(float), box.k) > 0.5] = np.nan
    return gaps[:, rows][:, :, columns].reshape(len(x), -1)


class BoxKernel:
    """The means of all k x k cells inside the grid as an operator on maps; ``ring`` leaves the middle cell out (k = 3).

    ``points`` are the first rows and columns of the boxes that are wanted.
    """

    outputs = ("value",)

    def __init__(self, spec: g.GridSpec, k: int, ring: bool = False):
        self.spec, self.k, self.ring = spec, k, ring

    def places(self) -> dict[str, np.ndarray]:
        rows, columns = self.spec.n_lat - self.k + 1, self.spec.n_lon - self.k + 1
        return {"row": np.repeat(np.arange(rows), columns), "col": np.tile(np.arange(columns), rows)}

    def prepare(self, points):
        return np.asarray(points["row"]), np.asarray(points["col"])

    def run(self, prepared, maps):
        x = maps[0].reshape(-1, self.spec.n_lat, self.spec.n_lon)
        known = ~np.isnan(x)
        filled, gaps = np.where(known, x, 0.0), (~known).astype(float)
        sums, missing = box_sums(filled, self.k), box_sums(gaps, self.k)
        if self.ring:
            sums, missing = sums - filled[:, 1:-1, 1:-1], missing - gaps[:, 1:-1, 1:-1]
        sums = sums / (self.k**2 - self.ring)
        sums[missing > 0.5] = np.nan
        rows, columns = prepared
        return (sums[:, rows, columns],)


def box_filtered(maps: DataFrame, names: list[str], spec: g.GridSpec, box: Box) -> DataFrame:
    """The named arrays of cells replaced by their box means."""
    schema, places = maps.schema, box.places(spec)
    out = T.StructType([T.StructField(f.name, T.ArrayType(T.DoubleType())) if f.name in names else f for f in schema])
    size = len(places[0]) * len(places[1])

    def run(batches):
        for batch in batches:
            columns = []
            for f in schema:
                column = batch.column(f.name)
                if f.name in names:
                    known = column.is_valid().to_numpy(zero_copy_only=False)
                    full = np.full((batch.num_rows, size), np.nan)
                    if known.any():
                        full[known] = box_means(_matrix(column.filter(pa.array(known))), spec, box)
                    flat = full.ravel()
                    column = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, max(size, 1), dtype=np.int32)[: batch.num_rows + 1]), pa.array(flat, mask=np.isnan(flat)))
                columns.append(column)
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])

    return maps.mapInArrow(run, out)


def _rounded(field: T.StructField, digits: int) -> Column:
    column = F.col(f"`{field.name}`")
    if field.dataType == T.ArrayType(T.DoubleType()):
        return F.transform(column, lambda v: F.round(v, digits)).alias(field.name)
    return F.round(column, digits).alias(field.name) if field.dataType == T.DoubleType() else column


def block_design(
    blocks, stations: DataFrame, spec: g.GridSpec, aux: bool = True, station_classes=None, digits: int | None = None, finish=lambda table: table
) -> DataFrame:
    """One row per (day, station) with the columns of all blocks; days are those of the first block, other blocks may lack some.

    ``aux`` adds the station's place and its cell, ``station_classes`` one column for each class. With ``digits`` the blocks' values are
    rounded once a day, before days meet stations. ``finish`` is applied to the values of an index and day, and to those of a station.
    """
    names = [b.name for b in blocks]
    if not blocks or len(set(names)) != len(names):
        raise ValueError("blocks must have names of their own")
    days = fold(lambda a, b: a.join(b, "day", "left"), [b.maps(spec) for b in blocks])
    if digits is not None:
        days = days.select(*[_rounded(f, digits) for f in days.schema])
    extra = one_hot(F.col("stid"), station_classes, "s") if station_classes else []
    if aux:
        extra = [
            *extra, F.col("nlat").alias("lat"), F.col("elon").alias("lon"), "elev", "rel_lat", "rel_lon",
            F.col("lat_idx").cast("double").alias("lat_idx"), F.col("lon_idx").cast("double").alias("lon_idx"),
        ]
    placed = g.cell_position(stations, spec)
    own = finish(placed.select("stid", *extra, F.col("lat_idx").alias("_i"), F.col("lon_idx").alias("_j")))
    return index_rows(own, ["_i", "_j"], days, [c for b in blocks for c in b.columns(spec, "_i", "_j")], finish)
