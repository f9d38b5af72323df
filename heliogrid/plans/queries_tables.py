"""Queries: sources, sinks, blocks and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from heliogrid.functions.expressions import FEATURE_PRESETS, derived_columns, quoted
from heliogrid.operators import blocks, grid, labels, metrics, reduce, sampling, sun
from heliogrid.operators.joins import pair_up
from heliogrid.plans.rounding import rounded
from heliogrid.session import new_shared_path
from heliogrid.sources import driver_tables as dt
from heliogrid.sources import tables

OBS_KEYS = ["stid", "day", "hour", "ens"]
OBS_VALUES = ["qty", "price", "disc", "tax"]

# Which test columns stand for which forecast features in the preset query.
STAND_INS = {
    "uswrf_sfc": "qty", "dswrf_sfc": "price", "ulwrf_sfc": "disc", "dlwrf_sfc": "tax",
    "tcolc_eatm": "qty", "apcp_sfc": "disc", "pwat_eatm": "tax", "tmax_2m": "price",
    "tmin_2m": "qty", "tmp_2m": "tax", "tmp_sfc": "disc",
}


# ---------------------------------------------------------------- sources and sinks


def scan_nwp(spark, sf):
    """Writes one table a feature and reads them as one cube."""
    path = new_shared_path(spark, "cube")
    for fx in dt.FEATURES:
        dt.nwp(spark, sf).where(F.col("fx") == fx).drop("fx").write.parquet(f"{path}/{fx}")
    return tables.load_cube(spark, path, dt.FEATURES)


def scan_labels_unpivot(spark, sf):
    """Writes the wide label file, in rows of ``WIDE`` stations, and reads it back as (station, day) rows: every station on every day."""
    path, count = new_shared_path(spark, "labels-csv"), dt.station_count(spark, sf)
    places = spark.range(1, count + 1).select(
        F.col("id").alias("stid"), F.floor((F.col("id") - 1) / dt.WIDE).alias("block"), ((F.col("id") - 1) % dt.WIDE).cast("int").alias("place")
    )
    energy = dt.energy(spark, sf).withColumnRenamed("y", "pred")
    # one row without a value for each day and block, so that those without labels are written, too
    blank = pair_up(energy.select("day").distinct(), places.where("place = 0").select("stid")).withColumn("pred", F.lit(None).cast("double"))
    wide = tables.submission_blocks(energy.select("day", "stid", "pred").unionByName(blank.select("day", "stid", "pred")), places, dt.WIDE)
    wide.write.option("header", True).csv(path)
    long = tables.read_label_blocks(spark, path, dt.WIDE)
    station = F.col("block") * dt.WIDE + F.col("place") + 1
    return long.select("day", station.cast("bigint").alias("stid"), "y").where(F.col("stid") <= count)


def scan_stations(spark, sf):
    """Writes the station file and reads it with dense numbers."""
    path = new_shared_path(spark, "stations-csv")
    source = dt.stations(spark, sf).withColumn("stid", F.lpad(F.col("stid").cast("string"), 12, "0"))
    source.write.option("header", True).csv(path)
    return tables.read_station_csv(spark, path)


def scan_grid(spark, sf):
    return tables.grid_table(dt.grid_of_cube(spark, sf))


def sink_submission_pivot(spark, sf):
    pred = dt.energy_nwp(spark, sf).withColumnRenamed("y", "pred")
    return tables.submission_blocks(pred, tables.station_places(dt.stations(spark, sf), dt.WIDE), dt.WIDE)


def sink_tables(spark, sf):
    """Writes the split label table as partitioned Parquet and reads it back."""
    path = new_shared_path(spark, "tables")
    split = sampling.time_split(dt.energy(spark, sf))
    tables.write_tables({"labels": split}, path, "labels by split")
    return tables.read_tables(spark, path, ["labels"])["labels"].select("stid", "day", "y", "split")


# ---------------------------------------------------------------- blocks


def block_select(spark, sf):
    bundle = _obs_blocks(spark, sf)
    return bundle["prices"]


def _obs_blocks(spark, sf):
    obs = dt.obs(spark, sf)
    return blocks.Blocks(
        OBS_KEYS,
        {"amounts": obs.select(*OBS_KEYS, "qty"), "prices": obs.select(*OBS_KEYS, "price", "disc", "tax")},
        check=False,
    )


def row_slice(spark, sf):
    return blocks.row_slice(dt.energy(spark, sf), 100, 600)


def block_assign(spark, sf):
    energy = dt.energy(spark, sf)
    calendar = energy.select("stid", "day", F.dayofyear("day").alias("doy"))
    return blocks.assign_block(energy, calendar, ["stid", "day"])


def block_hstack(spark, sf):
    return _obs_blocks(spark, sf).values()


def block_drop(spark, sf):
    return _obs_blocks(spark, sf).drop("prices").values()


def feature_subset(spark, sf):
    return blocks.select_features(dt.nwp(spark, sf), ["f1"])


def expr_features(spark, sf):
    ops = (("disc", "/", "tax"), ("tax", "/", "disc"), ("price", "-", "qty"), ("disc", "pow", 0.15), ("qty", "pow", -2))
    return rounded(blocks.add_features(dt.obs(spark, sf), OBS_KEYS, ops))


def expr_presets(spark, sf):
    obs = dt.obs(spark, sf)
    source = lambda name: quoted(STAND_INS[name])
    columns = []
    for preset, ops in FEATURE_PRESETS.items():
        columns += [c.alias(f"{preset}_{i}") for i, c in enumerate(derived_columns(ops, source))]
    return rounded(obs.select(*OBS_KEYS, *columns), digits=9)


def clip_predictions(spark, sf):
    energy = sampling.time_split(dt.energy(spark, sf))
    train = energy.where("split = 'train'")
    pred = energy.where("split = 'test'").select("day", "stid", (F.col("y") * 3.0 - 4000.0).alias("pred"))
    return blocks.clip_to(pred, train.where("y between 1000 and 4000"))


def drop_masked_rows(spark, sf):
    return labels.drop_masked(labels.mark_imputed(dt.energy(spark, sf))).select("stid", "day", "y")


# ---------------------------------------------------------------- joins


def join_day_station(spark, sf):
    days = dt.nwp(spark, sf).select("day").distinct()
    return sun.days_by_stations(days, dt.stations(spark, sf).select("stid"))


def join_station_attrs(spark, sf):
    return rounded(dt.energy(spark, sf).join(dt.stations(spark, sf), "stid"))


def daily_obs(spark, sf):
    return dt.obs(spark, sf).groupBy("stid", "day").agg(*[F.avg(c).alias(c) for c in OBS_VALUES])


def join_features_labels(spark, sf):
    return rounded(daily_obs(spark, sf).join(dt.energy(spark, sf), ["stid", "day"]), digits=4)


def station_grid_index(spark, sf):
    return grid.station_index(dt.stations(spark, sf), dt.GRID).select("stid", "lat_idx", "lon_idx")


def local_window_join(spark, sf):
    """The values of the cells around every station; they meet the stations as those of an index, rounded."""
    means = rounded(reduce.hour_then_ensemble(dt.nwp(spark, sf), "mean", "mean"))
    by_index = grid.index_values(means, dt.GRID, grid.window_offsets(2), grid.window_names(2))
    joined = grid.at_stations(by_index, dt.stations(spark, sf), dt.GRID)
    return joined.select("day", "fx", "stid", "dlat", "dlon", "value")


def edge_corner_join(spark, sf):
    """The values of the four cells around every station; they meet the stations as those of an index, rounded."""
    means = rounded(reduce.reduce_axis(dt.nwp(spark, sf), "ens", "mean"))
    by_index = grid.index_values(means, dt.GRID, grid.CORNER_OFFSETS, grid.corner_names())
    joined = grid.at_stations(by_index, dt.stations(spark, sf), dt.GRID)
    return joined.select("day", "fx", "hour", "stid", "corner", "value")


def climate_lookup(spark, sf):
    energy = sampling.time_split(dt.energy(spark, sf))
    table = reduce.climatology(energy.where("split = 'train'"))
    return rounded(reduce.climate_lookup(energy.where("split = 'test'").select("day", "stid"), table))


def mask_or_external(spark, sf):
    marked = labels.mark_imputed(dt.energy(spark, sf))
    hard = dt.obs(spark, sf).groupBy("day", "stid").agg((F.max("qty") > 40).alias("hard"))
    return labels.with_external_mask(marked, hard)


def climate_pairs(spark, sf):
    """Labels with their climatology as prediction, and the label mask."""
    energy = dt.energy(spark, sf)
    pred = reduce.climate_lookup(energy.select("day", "stid"), reduce.climatology(energy))
    return metrics.scored_pairs(labels.mark_imputed(energy), pred)


def mae_by_station_geo(spark, sf):
    res = metrics.residuals(climate_pairs(spark, sf))
    return rounded(metrics.mae_by_location(dt.stations(spark, sf), res))


QUERIES = {
    f.__name__: f
    for f in (
        scan_nwp, scan_labels_unpivot, scan_stations, scan_grid, sink_submission_pivot, sink_tables,
        block_select, row_slice, block_assign, block_hstack, block_drop, feature_subset, expr_features,
        expr_presets, clip_predictions, drop_masked_rows, join_day_station, join_station_attrs,
        join_features_labels, station_grid_index, local_window_join, edge_corner_join, climate_lookup,
        mask_or_external, mae_by_station_geo,
    )
}
