"""Design matrices: local windows, edge rows, whole maps and station forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliogrid.functions.dates import day_of_year, one_hot
from heliogrid.functions.expressions import feature_op, op_name, quoted
from heliogrid.functions.solar import sunrise_hour_angle
from heliogrid.operators import grid as g
from heliogrid.operators.interpolate import BEFORE
from heliogrid.operators.joins import BLOCK_ROWS, key_blocks, lookup_join, meet, pair_up
from heliogrid.operators.labels import with_history as add_history
from heliogrid.operators.reduce import ensemble_then_hour_mean, reduce_axis, widen_cells
from heliogrid.operators.sun import with_sun_state


def _as_is(table: DataFrame) -> DataFrame:
    return table


# ---------------------------------------------------------------- local windows


def local_features(
    cube: DataFrame,
    stations: DataFrame,
    spec: g.GridSpec,
    features,
    hours=(),
    k: int = 1,
    hour_mean: bool = True,
    hour_std: bool = False,
    ens_std: bool = False,
    aux: bool = True,
    station_classes=None,
    pairs: DataFrame | None = None,
    finish=_as_is,
) -> DataFrame:
    """One row per (day, station), or per wanted pair (day, stid, y): the 2k x 2k cells around it for every feature.

    All maps of a day become arrays in one row; pairing days with stations then picks
    cells by index, so neither the window nor the pivot multiplies rows. Cells off
    the grid are NULL. ``finish`` is applied to rows with these columns.

    All pairs are made from blocks of stations of one index, whose window is picked and finished once a day. The rows of a block
    and day follow each other, and so do the days of a block, so what they share is written once in a run, not in every row.
    """
    maps, names = _local_maps(cube, spec, features, hours, hour_mean, hour_std, ens_std)
    placed = g.cell_position(stations, spec)
    if pairs is not None:
        return finish(meet(maps, placed, pairs).select("day", "stid", "y", *_local_columns(F.col, names, spec, k, aux, station_classes)))
    own = finish(placed.select("stid", *_station_columns(F.col, aux, station_classes), F.col("lat_idx").alias("_i"), F.col("lon_idx").alias("_j")))
    at = lambda name: F.col({"lat_idx": "_i", "lon_idx": "_j"}.get(name, name))
    return index_rows(own, ["_i", "_j"], maps, [*_window_columns(at, names, spec, k), _day_column(F.col)], finish)


# Stations of one index in a row, about.
BLOCK_STATIONS = BLOCK_ROWS


def index_rows(own: DataFrame, keys: list[str], days: DataFrame, columns: list, finish=_as_is, parts: int = 32) -> DataFrame:
    """One row per day and row of ``own``: day, stid, the ``columns`` of the day and the keys, then what ``own`` has besides.

    ``keys`` of ``own`` are all of it that ``columns`` depend on, and the grid bounds them. Blocks of rows of the same keys meet days, so the columns are
    made and finished once for a block and day. Rows of a block and day follow each other. ``parts`` of the blocks level out tasks, and each repeats the days.
    """
    rows = pair_up(key_blocks(own, keys, "_stations", BLOCK_STATIONS), days, parts, 8, spread_left=True, waves=8)
    met = finish(rows.select("day", "_stations", *columns))
    of_day = [c for c in met.columns if c not in ("day", "_stations")]
    each = met.select("day", *[quoted(c) for c in of_day], F.explode("_stations").alias("_s"))
    of_station = [c for c in own.columns if c not in ("stid", *keys)]
    return each.select("day", "_s.stid", *[quoted(c) for c in of_day], *[F.col("_s").getField(c).alias(c) for c in of_station])


def local_examples(cube: DataFrame, stations: DataFrame, spec: g.GridSpec, features, hours, k: int, width: int, value) -> DataFrame:
    """``value`` of every station's features, as ``local_features`` has them, for whole blocks of stations: (day, block, values).

    ``stations`` have a block and a place, of 0 to ``width`` - 1, in it; an id has one place, and what they have besides comes along. ``value``
    is a function of the features' array and the station's struct. Places without a station are NULL.
    """
    maps, names = _local_maps(cube, spec, features, hours)
    placed = g.cell_position(stations, spec)
    entry = F.struct("place", F.struct(*[c for c in placed.columns if c not in ("block", "place")]))
    blocks = placed.groupBy("block").agg(F.map_from_entries(F.collect_list(entry)).alias("_by_place"))
    blocks = blocks.select("block", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda p: F.try_element_at("_by_place", p)).alias("_stations"))

    def of(station):
        at = lambda name: station.getField(name) if name in placed.columns else F.col(name)
        row = F.array(*[c.cast("double") for c in _local_columns(at, names, spec, k)])
        return F.when(station.isNotNull(), value(row, station))

    return meet(maps, blocks, spread_left=True).select("day", "block", F.transform("_stations", of).alias("values"))


def _local_maps(cube: DataFrame, spec: g.GridSpec, features, hours=(), hour_mean: bool = True, hour_std: bool = False, ens_std: bool = False):
    """One row per day with a map by name and the day of year, and the names."""
    reduced = cube
    if hour_mean or hour_std:
        reduced = reduce_axis(reduced, "hour", "mean" if hour_mean else "std")
        label, names = F.col("fx"), list(features)
    else:
        label, names = F.concat_ws("_", "fx", "hour"), [f"{f}_{h}" for f in features for h in hours]
    reduced = reduce_axis(reduced, "ens", "std" if ens_std else "mean")
    maps = g.maps_by_label(reduced, ["day"], label, names, spec)
    return maps.withColumn("doy", day_of_year(F.col("day"))), names


def _local_columns(at, names, spec: g.GridSpec, k: int, aux: bool = True, station_classes=None) -> list:
    """The features of a day and station; ``at`` gives a map's or a station's value by name."""
    return [*_window_columns(at, names, spec, k), _day_column(at), *_station_columns(at, aux, station_classes)]


def _window_columns(at, names, spec: g.GridSpec, k: int) -> list:
    picked = []
    for n in names:
        for i, j in g.window_offsets(k):
            value = g.cell_value(at(n), spec, at("lat_idx") + i, at("lon_idx") + j).getField("value")
            picked.append(value.alias(f"nm_{n}_{i + k}_{j + k}"))
    return picked


def _day_column(at):
    return at("doy").cast("double").alias("doy")


def _station_columns(at, aux: bool = True, station_classes=None) -> list:
    extra = one_hot(at("stid"), station_classes, "s") if station_classes else []
    position = [
        at("nlat").alias("lat"),
        at("elon").alias("lon"),
        at("elev").alias("elev"),
        at("rel_lat").alias("rel_lat"),
        at("rel_lon").alias("rel_lon"),
        at("lat_idx").cast("double").alias("lat_idx"),
        at("lon_idx").cast("double").alias("lon_idx"),
    ]
    return [*extra, *(position if aux else [])]


def global_features(cube: DataFrame, stations: DataFrame, spec: g.GridSpec, features, finish=_as_is) -> DataFrame:
    """The whole map of every feature, per day, attached to each station; ``finish`` is applied to a day's row before it meets them."""
    wide = widen_cells(ensemble_then_hour_mean(cube), ["day"], features, spec.n_lat, spec.n_lon)
    return pair_up(finish(wide), stations.select("stid"), spread_left=True)


# ---------------------------------------------------------------- edge rows


def wide_members(cube: DataFrame, features, ops=()) -> DataFrame:
    """One row per (day, ens, hour, cell) with a column per feature and per operation.

    Rows are hashed by cell and hour without the member, so the member statistics that
    follow reuse the same distribution.
    """
    placed = cube.repartition("day", "hour", "lat_i", "lon_i")
    wide = placed.groupBy("day", "ens", "hour", "lat_i", "lon_i").agg(
        *[F.first(F.when(F.col("fx") == f, F.col("value")), ignorenulls=True).alias(f) for f in features]
    )
    derived = [feature_op(quoted(a), op, b if op == "pow" else quoted(b)).alias(op_name(a, op, b)) for a, op, b in ops]
    return wide.select("*", *derived)


def edge_features(cube, stations, grid, spec: g.GridSpec, features, hours, ops=(), pairs: DataFrame | None = None, finish=_as_is) -> DataFrame:
    """One row per (day, station, corner), with ``pairs`` (day, stid, y) of these only: positions, hourly member mean and std, daily mean.

    All that a cell or a corner has of its own is made before days meet stations; ``finish`` is applied to both. All pairs are made from blocks of
    rows of one cell and corner, which share the statistics of a day.
    """
    maps, placed, columns, short, position = _edge_parts(cube, stations, grid, spec, features, hours, ops, finish)
    if pairs is None:
        at = F.get("cells", F.col("_cell"))
        rows = index_rows(placed, ["_cell", "corner"], maps, ["corner", "doy", *[at.getField(v).alias(c) for c, v in zip(columns, short)]], parts=16)
        return rows.select("day", "stid", "corner", *position, "doy", *[quoted(c) for c in columns])
    rows = meet(maps, placed, pairs)
    # one struct: the statistics of the row's cell
    rows = rows.select("day", "stid", "y", "corner", *position, "doy", F.get("cells", F.col("_cell")).alias("_at"))
    return rows.select("day", "stid", "y", "corner", *position, "doy", *[F.col("_at").getField(v).alias(c) for c, v in zip(columns, short)])


def edge_examples(cube, stations, grid, spec: g.GridSpec, features, hours, ops=()) -> DataFrame:
    """The features of ``edge_features`` in one row per (day, station): arrays _f0, _f1, ... for its corners inside the grid, NULL beyond these.

    An id has one place; repeated rows of it count once.
    """
    single = stations.select("stid", "nlat", "elon", "elev").distinct()
    maps, placed, _, short, position = _edge_parts(cube, single, grid, spec, features, hours, ops, _as_is)
    numbers = lambda columns: F.array(*[c.cast("double") for c in columns])
    days = maps.select("day", "doy", F.transform("cells", lambda c: numbers([c.getField(v) for v in short])).alias("_cells"))
    corner = F.struct("corner", "_cell", numbers([F.col(p) for p in position]).alias("_place"))
    corners = placed.groupBy("stid").agg(F.sort_array(F.collect_list(corner)).alias("_corners"))
    rows = meet(days, corners, spread_left=True)

    def example(i):
        at = F.get("_corners", F.lit(i))
        values = F.concat(at.getField("_place"), F.array("doy"), F.get("_cells", at.getField("_cell")))
        return F.when(at.isNotNull(), values).alias(f"_f{i}")

    return rows.select("day", "stid", *[example(i) for i in range(len(g.CORNER_OFFSETS))])


def _edge_parts(cube, stations, grid, spec: g.GridSpec, features, hours, ops, finish):
    """Maps of a day (structs of the named statistics by cell), corners of stations with their cell, and the names of both's columns."""
    names = [*features, *[op_name(*op) for op in ops]]
    members = wide_members(cube, features, ops)
    stats = members.groupBy("day", "hour", "lat_i", "lon_i").agg(
        *[F.avg(quoted(n)).alias(f"_m{i}") for i, n in enumerate(names)],
        *[F.stddev_pop(quoted(n)).alias(f"_s{i}") for i, n in enumerate(names)],
    )
    slots = [f"h{h}" for h in hours]
    values = [f"_{kind}{i}" for kind in "ms" for i in range(len(names))]
    # one row per cell: a struct of statistics for each hour
    label = F.concat(F.lit("h"), F.col("hour").cast("string"))
    by_hour = [F.first(F.when(label == s, F.struct(*values)), ignorenulls=True).alias(s) for s in slots]
    cells = stats.groupBy("day", "lat_i", "lon_i").agg(*by_hour)
    at = lambda slot, kind, i: F.col(slot).getField(f"_{kind}{i}")
    picked = []
    for block, members_of in (("nm", range(len(features))), ("nmft", range(len(features), len(names)))):
        for kind, title in (("m", "mean"), ("s", "std")):
            picked += [at(s, kind, i).alias(f"{block}_{title}_{names[i]}_{h}") for i in members_of for s, h in zip(slots, hours)]
        for i in members_of:
            total = sum((at(s, "m", i) for s in slots[1:]), at(slots[0], "m", i))
            picked.append((total / float(len(slots))).alias(f"{block}_{names[i]}_m"))
    finished = finish(cells.select("day", "lat_i", "lon_i", *picked))
    columns = [c for c in finished.columns if c not in ("day", "lat_i", "lon_i")]
    short = [f"v{i}" for i in range(len(columns))]
    finished = finished.select("day", "lat_i", "lon_i", *[quoted(c).alias(v) for c, v in zip(columns, short)])
    maps = g.maps_by_label(finished, ["day"], F.lit("cells"), ["cells"], spec, short)
    corners = lookup_join(g.corner_cells(stations, spec), grid, ["lat_i", "lon_i"])
    placed = corners.join(stations.withColumnRenamed("elev", "station_elev"), "stid")
    position = {
        "grid_lat": F.col("lat"), "grid_lon": F.col("lon"), "rel_lat": F.col("nlat") - F.col("lat"), "rel_lon": F.col("elon") - F.col("lon"),
        "lat": F.col("nlat"), "lon": F.col("elon"), "station_elev": F.col("station_elev"), "grid_elev": F.col("elev"),
    }
    placed = finish(placed.select("stid", "corner", spec.cell("lat_i", "lon_i").alias("_cell"), *[c.alias(n) for n, c in position.items()]))
    return maps.withColumn("doy", day_of_year(F.col("day")).cast("double")), placed, columns, short, list(position)


def edge_labels(labels: DataFrame, corners: int = 4) -> DataFrame:
    """Each label once per corner."""
    return labels.withColumn("corner", F.explode(F.sequence(F.lit(0), F.lit(corners - 1))))


# ---------------------------------------------------------------- station forecasts

BLOCKS = ("nm_intp", "nmft_intp", "nm_intp_sigma")


def widen_station_forecasts(intp: DataFrame, features, hours, ops, blocks=BLOCKS, extra_keys=()) -> DataFrame:
    """Long interpolated values to one row per (day, station): hourly columns of all blocks.

    Rows without ``fx`` are wide already (``slots_at_points``) and only get the derived columns.
    """
    keys = ["day", "stid", *extra_keys]
    slots = [(f, h) for f in features for h in hours]
    pick = lambda value, f, h: F.first(
        F.when((F.col("fx") == f) & (F.col("hour") == h), F.col(value)), ignorenulls=True
    )
    wanted = [pick("value", f, h).alias(f"nm_intp_{f}_{h}") for f, h in slots]
    if "nm_intp_sigma" in blocks:
        wanted += [pick("sigma", f, h).alias(f"nm_intp_sigma_{f}_{h}") for f, h in slots]
    wide = intp.groupBy(*keys).agg(*wanted) if "fx" in intp.columns else intp
    if "nmft_intp" in blocks:
        at = lambda t, f, h: quoted(f"{t}nm_intp_{f}_{h}")
        wide = wide.select(
            "*",
            *[
                feature_op(at(t, a, h), op, b if op == "pow" else at(t, b, h)).alias(f"{t}nmft_intp_{op_name(a, op, b)}_{h}")
                for t in _times(wide)
                for a, op, b in ops
                for h in hours
            ],
        )
    return wide


def _times(wide: DataFrame) -> tuple[str, ...]:
    """Prefixes of the day's own values and, where they came along, of the day before."""
    return ("", BEFORE) if any(c.startswith(BEFORE) for c in wide.columns) else ("",)


def block_features(block: str, features, ops) -> list[str]:
    return [op_name(*op) for op in ops] if block == "nmft_intp" else list(features)


def station_design(
    intp: DataFrame,
    stations: DataFrame,
    features,
    hours,
    ops=(),
    blocks=BLOCKS,
    with_stationinfo: bool = True,
    with_date: bool = True,
    with_solar: bool = False,
    with_history: bool = False,
    with_mean_history: bool = False,
    with_climate: bool = False,
    extra_keys=(),
    station_keys=("stid",),
) -> DataFrame:
    """Full feature table per (day, station): keys, then the features in order.

    ``station_keys`` are the key columns shared with the station table (the copy
    number as well, when stations were perturbed). A label y that came with the forecasts is kept. Where the values of the day
    before came along, history is taken from them; else it is a window by station.
    """
    intp_keys = [*[k for k in station_keys if k != "stid"], *extra_keys]
    keys = ["day", "stid", *intp_keys]
    wide = widen_station_forecasts(intp, features, hours, ops, blocks, intp_keys)
    hourly = {b: [f"{b}_{f}_{h}" for f in block_features(b, features, ops) for h in hours] for b in blocks}
    means = {}
    for b in blocks:
        for f in block_features(b, features, ops):
            means.setdefault(b, {})[f"{b}_{f}_m"] = [f"{b}_{f}_{h}" for h in hours]
    mean = lambda parts: sum(parts[1:], parts[0]) / float(len(parts))
    wide = wide.select(
        "*", *[mean([quoted(f"{t}{c}") for c in parts]).alias(f"{t}{n}") for t in _times(wide) for b in blocks for n, parts in means[b].items()]
    )
    groups = [k for k in keys if k != "day"]
    lagged = [c for b in blocks for c in hourly[b]] if with_history else []
    lagged += [n for b in blocks for n in means[b]] if with_mean_history else []
    if lagged and BEFORE in _times(wide):
        wide = wide.select("*", *[F.coalesce(quoted(f"{BEFORE}{c}"), quoted(c)).alias(f"{c}_t-1") for c in lagged])
    elif lagged:
        wide = add_history(wide, groups, lagged, "_t-1")
    if "nlat" in wide.columns:  # the places came with the forecasts
        rows = wide.where(" and ".join(f"{k} is not null" for k in station_keys))
    else:
        rows = wide.join(stations.select(*station_keys, "nlat", "elon", "elev"), list(station_keys))
    chosen = []
    if with_solar:
        from heliogrid.functions.solar import julian_day

        rows = with_sun_state(rows.withColumn("_jd", julian_day(F.col("day"))), "_jd", "_")
        chosen.append((sunrise_hour_angle(F.col("nlat"), F.col("_decl")) * 8.0).alias("delta_sunrise_sunset"))
    if with_date:
        chosen.append(day_of_year(F.col("day")).cast("double").alias("doy"))
    if with_stationinfo:
        chosen += [F.col("nlat").alias("lat"), F.col("elon").alias("lon"), F.col("elev")]
    for b in blocks:
        chosen += [quoted(c) for c in hourly[b]]
        if with_history:
            chosen += [quoted(f"{c}_t-1") for c in hourly[b]]
    for b in blocks:
        chosen += [quoted(n) for n in means[b]]
        if with_mean_history:
            chosen += [quoted(f"{n}_t-1") for n in means[b]]
    if with_climate:
        chosen += [F.month("day").cast("double").alias("month"), F.col("stid").cast("double").alias("station")]
    return rows.select(*keys, *[c for c in ("y",) if c in wide.columns], *chosen)
