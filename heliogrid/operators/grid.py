"""Forecast grid geometry: station indices, windows, corners and map vectors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heliogrid.operators.joins import dealt, key_blocks, lookup_join, pair_up

# The four grid cells around a station, relative to its index.
CORNER_OFFSETS = ((0, 0), (0, -1), (-1, 0), (-1, -1))


@dataclass(frozen=True)
class GridSpec:
    """Axes of the forecast grid, ascending, longitudes in -180..180."""

    lats: tuple[float, ...]
    lons: tuple[float, ...]

    @staticmethod
    def of(lats, lons) -> GridSpec:
        shifted = sorted(float(x) - 360.0 if float(x) > 180.0 else float(x) for x in lons)
        return GridSpec(tuple(sorted(float(x) for x in lats)), tuple(shifted))

    @property
    def n_lat(self) -> int:
        return len(self.lats)

    @property
    def n_lon(self) -> int:
        return len(self.lons)

    @property
    def n_cells(self) -> int:
        return self.n_lat * self.n_lon

    def cell(self, lat_i, lon_i) -> Column:
        as_col = lambda v: F.col(v) if isinstance(v, str) else v
        return (as_col(lat_i) * self.n_lon + as_col(lon_i)).cast("int")

    def inside(self, lat_i: Column, lon_i: Column) -> Column:
        return lat_i.between(0, self.n_lat - 1) & lon_i.between(0, self.n_lon - 1)

    def lat_at(self, index: Column) -> Column:
        return F.get(_axis(self.lats), index)

    def lon_at(self, index: Column) -> Column:
        return F.get(_axis(self.lons), index)


def _axis(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def count_below(values, x: Column) -> Column:
    """Left insertion index of x in an ascending axis: how many axis values lie below it."""
    return F.size(F.filter(_axis(values), lambda v: v < x))


def lattice(spark: SparkSession, spec: GridSpec, per_axis: int = 10) -> DataFrame:
    """A ``per_axis`` times finer lattice over the grid, as points to interpolate at."""
    n_lat, n_lon = per_axis * spec.n_lat, per_axis * spec.n_lon
    step = lambda axis, n: (axis[-1] - axis[0]) / (n - 1)
    points = spark.range(n_lat * n_lon).select(
        F.col("id").alias("point"),
        F.floor(F.col("id") / n_lon).cast("int").alias("plat"),
        (F.col("id") % n_lon).cast("int").alias("plon"),
    )
    return points.select(
        "point",
        (F.lit(spec.lats[0]) + F.col("plat") * step(spec.lats, n_lat)).alias("nlat"),
        (F.lit(spec.lons[0]) + F.col("plon") * step(spec.lons, n_lon)).alias("elon"),
        F.lit(0.0).alias("elev"),
    )


def station_index(stations: DataFrame, spec: GridSpec) -> DataFrame:
    """Adds lat_idx and lon_idx: the number of axis values below the station."""
    return stations.withColumns(
        {"lat_idx": count_below(spec.lats, F.col("nlat")), "lon_idx": count_below(spec.lons, F.col("elon"))}
    )


def cell_position(stations: DataFrame, spec: GridSpec) -> DataFrame:
    """Adds the station's offset from the axis values at its index."""
    return station_index(stations, spec).withColumns(
        {
            "rel_lat": F.col("nlat") - spec.lat_at(F.col("lat_idx")),
            "rel_lon": F.col("elon") - spec.lon_at(F.col("lon_idx")),
        }
    )


def window_offsets(k: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(-k, k) for j in range(-k, k)]


def window_cells(stations: DataFrame, spec: GridSpec, k: int = 1) -> DataFrame:
    """(stid, dlat, dlon, lat_i, lon_i): the 2k x 2k cells around each station, inside the grid."""
    offsets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in window_offsets(k)])
    spread = station_index(stations, spec).withColumn("_o", F.explode(offsets))
    cells = spread.select(
        "stid",
        F.col("_o.i").alias("dlat"),
        F.col("_o.j").alias("dlon"),
        (F.col("lat_idx") + F.col("_o.i")).alias("lat_i"),
        (F.col("lon_idx") + F.col("_o.j")).alias("lon_i"),
    )
    return cells.where(spec.inside(F.col("lat_i"), F.col("lon_i")))


def corner_cells(stations: DataFrame, spec: GridSpec) -> DataFrame:
    """(stid, corner, lat_i, lon_i): the four enclosing cells of each station."""
    offsets = F.array(
        *[F.struct(F.lit(c).alias("c"), F.lit(i).alias("i"), F.lit(j).alias("j")) for c, (i, j) in enumerate(CORNER_OFFSETS)]
    )
    spread = station_index(stations, spec).withColumn("_o", F.explode(offsets))
    cells = spread.select(
        "stid",
        F.col("_o.c").alias("corner"),
        (F.col("lat_idx") + F.col("_o.i")).alias("lat_i"),
        (F.col("lon_idx") + F.col("_o.j")).alias("lon_i"),
    )
    return cells.where(spec.inside(F.col("lat_i"), F.col("lon_i")))


def cells_to_stations(values: DataFrame, station_cells: DataFrame, **size_check) -> DataFrame:
    """Grid values joined to the stations whose windows hold the cell."""
    return lookup_join(values, station_cells, ["lat_i", "lon_i"], **size_check)


# Blocks of stations of one index, of a narrow column, that may be broadcast.
NARROW_BLOCKS = 1_000


def window_names(k: int) -> list[dict[str, int]]:
    """The names of a window's cells, in the order of ``window_offsets``."""
    return [{"dlat": i, "dlon": j} for i, j in window_offsets(k)]


def corner_names() -> list[dict[str, int]]:
    return [{"corner": c} for c in range(len(CORNER_OFFSETS))]


def index_cells(spark: SparkSession, spec: GridSpec, offsets, names: list[dict[str, int]]) -> DataFrame:
    """(lat_idx, lon_idx, names, lat_i, lon_i): the cells inside the grid at some offsets from every index a station can have."""
    entries = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), *[F.lit(v).alias(n) for n, v in name.items()]) for (i, j), name in zip(offsets, names)]
    indices = spark.range((spec.n_lat + 1) * (spec.n_lon + 1)).select(
        F.floor(F.col("id") / (spec.n_lon + 1)).cast("int").alias("lat_idx"),
        (F.col("id") % (spec.n_lon + 1)).cast("int").alias("lon_idx"),
        F.explode(F.array(*entries)).alias("_o"),
    )
    cells = indices.select(
        "lat_idx", "lon_idx", *[F.col("_o").getField(n).alias(n) for n in names[0]],
        (F.col("lat_idx") + F.col("_o.i")).alias("lat_i"), (F.col("lon_idx") + F.col("_o.j")).alias("lon_i"),
    )
    return cells.where(spec.inside(F.col("lat_i"), F.col("lon_i")))


def index_values(values: DataFrame, spec: GridSpec, offsets, names: list[dict[str, int]]) -> DataFrame:
    """Grid values at every index whose cells they are: (values, lat_idx, lon_idx, names). Bounded by the grid, whatever the stations."""
    return values.join(F.broadcast(index_cells(values.sparkSession, spec, offsets, names)), ["lat_i", "lon_i"])


def at_stations(by_index: DataFrame, stations: DataFrame, spec: GridSpec, **size_check) -> DataFrame:
    """Rows of a day and index (lat_idx, lon_idx) with the stations that have it; results aren't shuffled.

    All rows of a day and index meet blocks of stations at once. Each is then repeated for the block's stations, so its values are written
    once in a run, and the same stations come again and again, which takes little room as well.
    """
    keys = ["day", "lat_idx", "lon_idx"]
    others = [c for c in by_index.columns if c not in keys]
    blocks = key_blocks(station_index(stations, spec).select("stid", "lat_idx", "lon_idx"), keys[1:], "_stations")
    blocks = blocks.select(*keys[1:], F.col("_stations.stid").alias("_stids"))
    days = by_index.groupBy(*keys).agg(F.collect_list(F.struct(*others)).alias("_rows"))
    met = lookup_join(dealt(days, keys), blocks, keys[1:], **{"max_rows": NARROW_BLOCKS, **size_check})
    rows = met.select(*keys, "_stids", F.inline("_rows").alias(*others))
    return rows.select(*keys, *others, F.explode("_stids").alias("stid"))


def _complete(cells: Column, n: int) -> Column:
    """Sorted cell structs, padded with NULL where a cell is absent; a cell that repeats is an error."""
    by_cell = F.map_from_entries(F.transform(cells, lambda c: F.struct(c.getField("cell"), c)))
    padded = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda c: F.try_element_at(by_cell, c))
    every = F.transform(cells, lambda c: c.getField("cell").cast("int")) == F.sequence(F.lit(0), F.lit(n - 1))
    return F.when(every, cells).otherwise(padded)


def map_vectors(df: DataFrame, keys: list[str], spec: GridSpec, values=("value",), names=("cells",)) -> DataFrame:
    """One row per map: arrays of the cell values in cell order.

    A map has one row per (keys, cell), so an array never exceeds the grid size.
    """
    entry = F.struct(spec.cell("lat_i", "lon_i").alias("cell"), *values)
    gathered = df.groupBy(*keys).agg(F.sort_array(F.collect_list(entry)).alias("_m"))
    full = gathered.withColumn("_m", _complete(F.col("_m"), spec.n_cells))
    return full.select(*keys, *[F.col("_m").getField(v).alias(n) for v, n in zip(values, names)])


def maps_by_label(df: DataFrame, keys: list[str], label: Column, names: list[str], spec: GridSpec, values=("value",)) -> DataFrame:
    """One row per key and, for each known label, one array of cell structs."""
    entry = F.struct(spec.cell("lat_i", "lon_i").alias("cell"), *values)
    labelled = df.withColumn("_k", label).withColumn("_e", entry)
    gathered = labelled.groupBy(*keys).agg(
        *[F.sort_array(F.collect_list(F.when(F.col("_k") == n, F.col("_e")))).alias(n) for n in names]
    )
    return gathered.select(*keys, *[_complete(F.col(f"`{n}`"), spec.n_cells).alias(n) for n in names])


def cell_value(cells: Column, spec: GridSpec, lat_i: Column, lon_i: Column) -> Column:
    """Array element of a cell; NULL outside the grid."""
    return F.when(spec.inside(lat_i, lon_i), F.get(cells, spec.cell(lat_i, lon_i)))


def bilinear_stations(stations: DataFrame, spec: GridSpec) -> DataFrame:
    """Adds the cell numbers and weights of the four enclosing cells; NULL outside the hull."""
    placed = station_index(stations, spec)
    on_edge = lambda idx, x, axis: F.when(x == axis[0], F.lit(1)).otherwise(idx)
    placed = placed.withColumns(
        {
            "_i": on_edge(F.col("lat_idx"), F.col("nlat"), spec.lats),
            "_j": on_edge(F.col("lon_idx"), F.col("elon"), spec.lons),
        }
    )
    inner = F.col("_i").between(1, spec.n_lat - 1) & F.col("_j").between(1, spec.n_lon - 1)
    share = lambda x, at, idx: (x - at(idx - 1)) / (at(idx) - at(idx - 1))
    placed = placed.withColumns(
        {
            "_u": F.when(inner, share(F.col("nlat"), spec.lat_at, F.col("_i"))),
            "_v": F.when(inner, share(F.col("elon"), spec.lon_at, F.col("_j"))),
        }
    )
    u, v = F.col("_u"), F.col("_v")
    one = F.lit(1.0)
    corners = []
    for di, wu in ((-1, one - u), (0, u)):
        for dj, wv in ((-1, one - v), (0, v)):
            cell = spec.cell(F.col("_i") + di, F.col("_j") + dj)
            corners.append(F.struct(cell.alias("cell"), (wu * wv).alias("w")))
    return placed.withColumn("corners", F.when(inner, F.array(*corners))).drop("_i", "_j", "_u", "_v")


def bilinear(cells: Column, corners) -> Column:
    """Weighted sum over the four corners (cell, weight); a corner of zero weight may be missing."""
    total = None
    for cell, weight in corners:
        term = F.when(weight == 0, 0.0).otherwise(weight * F.get(cells, cell))
        total = term if total is None else total + term
    return total


def interpolate_bilinear(cube: DataFrame, stations: DataFrame, spec: GridSpec, ids=("stid",)) -> DataFrame:
    """Piecewise bilinear values at stations for every map of a long cube.

    Each map becomes one bounded array, so pairing maps with stations yields exactly
    the output rows: no per-cell explosion and no regrouping afterwards.
    """
    keys = [c for c in cube.columns if c not in ("lat_i", "lon_i", "value")]
    maps = map_vectors(cube, keys, spec)
    # plain columns, read once a station and not taken out of an array in every pair
    flat = [F.get("corners", F.lit(c)).getField(v).alias(f"_{v}{c}") for c in range(4) for v in ("cell", "w")]
    placed = bilinear_stations(stations, spec).select(*ids, *flat)
    pairs = pair_up(dealt(maps, keys), placed)
    return pairs.select(*keys, *ids, bilinear(F.col("cells"), [(F.col(f"_cell{c}"), F.col(f"_w{c}")) for c in range(4)]).alias("value"))
