"""Queries: aggregations, windows, samples, calendar and solar tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from heliogrid.functions import dates, solar
from heliogrid.operators import blocks, grid, interpolate, labels, metrics, reduce, sampling, sun
from heliogrid.operators.joins import union_all
from heliogrid.operators.perturb import perturb_stations
from heliogrid.plans.queries_tables import OBS_KEYS, OBS_VALUES, climate_pairs, daily_obs
from heliogrid.plans.rounding import r, rounded
from heliogrid.sources import driver_tables as dt
from heliogrid.sources import tables

ZONE = -6.0


# ---------------------------------------------------------------- ensemble reductions


def ens_mean(spark, sf):
    return rounded(reduce.reduce_axis(dt.nwp(spark, sf), "ens", "mean"))


def ens_std(spark, sf):
    return rounded(reduce.reduce_axis(dt.nwp(spark, sf), "ens", "std"))


def hour_mean(spark, sf):
    return rounded(reduce.reduce_axis(dt.nwp(spark, sf), "hour", "mean"))


def hour_std(spark, sf):
    return rounded(reduce.reduce_axis(dt.nwp(spark, sf), "hour", "std"))


def baseline_grid_mean(spark, sf):
    means = reduce.ensemble_then_hour_mean(dt.nwp(spark, sf))
    return rounded(reduce.widen_cells(means, ["day"], dt.FEATURES, dt.GRID.n_lat, dt.GRID.n_lon))


def ens_mean_of_hour_mean(spark, sf):
    return rounded(reduce.hour_then_ensemble(dt.nwp(spark, sf), "mean", "mean"))


def ens_std_of_hour_mean(spark, sf):
    return rounded(reduce.hour_then_ensemble(dt.nwp(spark, sf), "mean", "std"))


def ens_mean_of_hour_std(spark, sf):
    return rounded(reduce.hour_then_ensemble(dt.nwp(spark, sf), "std", "mean"))


def ens_std_of_hour_std(spark, sf):
    return rounded(reduce.hour_then_ensemble(dt.nwp(spark, sf), "std", "std"))


def member_interpolation(spark, sf):
    """Bilinear station values of every member."""
    return grid.interpolate_bilinear(dt.nwp(spark, sf), dt.stations(spark, sf), dt.GRID)


def member_slots(spark, sf):
    """``member_interpolation`` as one row per (day, member, station), with the station's place."""
    if not interpolate.one_place(dt.stations(spark, sf), ["stid"]):
        return member_interpolation(spark, sf)
    weights = interpolate.bilinear_weights(dt.GRID)
    return interpolate.slots_at_points(dt.nwp(spark, sf), dt.stations(spark, sf), dt.GRID, weights, dt.FEATURES, dt.HOURS, ("day", "ens"))


def station_slots(spark, sf, pairs=None, before: bool = False):
    """``station_forecasts`` as one row per (day, station), with the station's place; with ``pairs`` (day, stid, y) of these, with y.

    With ``before`` also the values of the day before, where an id has one place.
    """
    if not interpolate.one_place(dt.stations(spark, sf), ["stid"]):
        return station_forecasts(spark, sf)
    weights = interpolate.bilinear_weights(dt.GRID)
    return interpolate.slots_at_points(dt.nwp(spark, sf), dt.stations(spark, sf), dt.GRID, weights, dt.FEATURES, dt.HOURS, spreads=True, before=before, pairs=pairs)


def over_members(cube, stations, weights):
    """Mean (value) and spread (sigma) of the interpolated members, (day, fx, hour, stid): members of a map meet a station in one row."""
    keys = ["day", "fx", "hour"]
    maps = interpolate.gathered_maps(cube, keys, F.lit(0), [0], dt.GRID)
    points = stations.select("stid", *interpolate.PLACE).distinct()
    return interpolate.at_points(maps, keys, points, ["stid"], interpolate.SlotKernel(weights, ["value"], ["sigma"]), ["s0"])


def station_forecasts(spark, sf):
    """Member mean (value) and spread (sigma) of the interpolated members."""
    stations = dt.stations(spark, sf)
    if interpolate.one_place(stations, ["stid"]):
        return over_members(dt.nwp(spark, sf), stations, interpolate.bilinear_weights(dt.GRID))
    stats = reduce.mean_and_std(member_interpolation(spark, sf), ["day", "fx", "hour", "stid"])
    return stats.withColumnsRenamed({"mean": "value", "std": "sigma"})


def intp_ens_mean_std(spark, sf):
    return rounded(station_forecasts(spark, sf))


def daily_mean_features(spark, sf):
    means, names = reduce.reduce_axis(dt.nwp(spark, sf), "ens", "mean"), list(dt.FEATURES)
    stations = dt.stations(spark, sf)
    if interpolate.one_place(stations, ["stid"]):
        maps = interpolate.gathered_maps(means, ["day"], F.col("fx"), names, dt.GRID)
        kernel = interpolate.SlotKernel(interpolate.bilinear_weights(dt.GRID), [f"nm_intp_{n}_m" for n in names])
        points = stations.select("stid", *interpolate.PLACE).distinct()
        return rounded(interpolate.at_points(maps, ["day"], points, ["stid"], kernel, [f"s{i}" for i in range(len(names))]))
    intp = grid.interpolate_bilinear(means, stations, dt.GRID)
    by_day = intp.groupBy("day", "stid", "fx").agg(F.avg("value").alias("value"))
    wide = reduce.widen(by_day, ["day", "stid"], F.col("fx"), names, {"value": "nm_intp_"})
    return rounded(wide.withColumnsRenamed({f"nm_intp_{n}": f"nm_intp_{n}_m" for n in names}))


# ---------------------------------------------------------------- predictions and scores


def climatology(spark, sf):
    return rounded(reduce.climatology(dt.energy(spark, sf)))


def ens_mean_predictions(spark, sf):
    by_member = dt.obs(spark, sf).groupBy("day", "stid", "ens").agg(F.avg("price").alias("pred"))
    return rounded(reduce.mean_prediction(by_member), digits=5)


def corner_mean_predictions(spark, sf):
    """Means over features and corners; stations of one index share them, so they are taken before days meet stations."""
    means = reduce.hour_then_ensemble(dt.nwp(spark, sf), "mean", "mean")
    stations = dt.stations(spark, sf)
    if interpolate.one_place(stations, ["stid"]):
        by_cell = means.groupBy("day", "lat_i", "lon_i").agg(F.avg("value").alias("value"))
        corners = grid.index_values(by_cell, dt.GRID, grid.CORNER_OFFSETS, grid.corner_names()).withColumnRenamed("value", "pred")
        by_index = rounded(reduce.mean_prediction(corners, ["day", "lat_idx", "lon_idx"]))
        places = stations.select("stid", *interpolate.PLACE).distinct()
        return grid.at_stations(by_index, places, dt.GRID).select("day", "stid", "pred")
    cells = grid.corner_cells(stations, dt.GRID)
    by_corner = grid.cells_to_stations(means, cells).groupBy("day", "stid", "corner").agg(F.avg("value").alias("pred"))
    return rounded(reduce.mean_prediction(by_corner))


def perturb_mean_predictions(spark, sf):
    """What the daily map of a feature predicts at every perturbed copy of a station, averaged over the copies."""
    daily = reduce.ensemble_then_hour_mean(dt.nwp(spark, sf).where("fx = 'f0'"))
    copies = perturb_stations(dt.stations(spark, sf))
    return rounded(interpolate.copy_means(daily.drop("fx"), copies, dt.GRID), digits=5)


def seed_blend(spark, sf):
    by_seed = dt.obs(spark, sf).groupBy("day", "stid", (F.col("ens") % 3).alias("seed")).agg(F.avg("price").alias("pred"))
    return rounded(reduce.mean_prediction(by_seed), digits=5)


def metrics_mae_rmse_r2(spark, sf):
    return rounded(metrics.scores_with_mask(climate_pairs(spark, sf)))


def _residuals(spark, sf):
    return metrics.residuals(climate_pairs(spark, sf))


def mae_daily(spark, sf):
    return rounded(metrics.mae_by_day(_residuals(spark, sf)))


def ae_by_doy(spark, sf):
    return rounded(metrics.ae_by_day_of_year(_residuals(spark, sf)))


def ae_by_month(spark, sf):
    return rounded(metrics.ae_by_month(_residuals(spark, sf)))


def mae_by_station(spark, sf):
    return rounded(metrics.mae_by_station(_residuals(spark, sf)))


def mae_over_under(spark, sf):
    return rounded(metrics.mae_over_under(climate_pairs(spark, sf)))


def residual_table(spark, sf):
    return rounded(_residuals(spark, sf), digits=4)


def mask_stats(spark, sf):
    return labels.mask_counts(labels.mark_imputed(dt.energy(spark, sf)))


def feature_standardise(spark, sf):
    split = sampling.time_split(daily_obs(spark, sf))
    return rounded(reduce.standardise(split, split.where("split = 'train'"), OBS_VALUES), digits=5)


def label_standardise(spark, sf):
    train = sampling.time_split(dt.energy(spark, sf)).where("split = 'train'").select("stid", "day", "y")
    fitted = reduce.label_moments(train)
    centred = reduce.standardise_labels(train, fitted, with_std=False)
    scaled = reduce.standardise_labels(train, fitted)
    restored = reduce.restore_labels(scaled, fitted, column="y")
    parts = {"centred": centred, "scaled": scaled, "restored": restored}
    return rounded(union_all(p.withColumn("kind", F.lit(k)) for k, p in parts.items()), digits=4)


def value_histogram(spark, sf):
    cube = blocks.select_features(dt.nwp(spark, sf), [dt.FEATURES[0]])
    means = reduce.ensemble_then_hour_mean(cube)
    daily = means.groupBy("day", "lat_i").agg(F.avg("value").alias("v")).groupBy("day").agg(F.avg("v").alias("v"))
    return rounded(reduce.histogram(daily, "v", 50))


# ---------------------------------------------------------------- windows and samples


def clean_missing_labels(spark, sf):
    return labels.mark_imputed(dt.energy(spark, sf))


def history_features(spark, sf):
    hourly = dt.obs(spark, sf).groupBy("stid", "hour", "day").agg(*[F.avg(c).alias(c) for c in OBS_VALUES])
    return rounded(labels.with_history(hourly, ["stid", "hour"], OBS_VALUES, "_t-1"), digits=4)


def mean_history_features(spark, sf):
    daily = daily_obs(spark, sf).withColumnsRenamed({c: f"{c}_m" for c in OBS_VALUES})
    return rounded(labels.with_history(daily, ["stid"], [f"{c}_m" for c in OBS_VALUES], "_t-1"), digits=4)


def time_split(spark, sf):
    return sampling.time_split(dt.energy(spark, sf))


def kfold_assign(spark, sf):
    return sampling.assign_folds(dt.energy(spark, sf))


def worst_k_stations(spark, sf):
    return rounded(metrics.worst_stations(_residuals(spark, sf), 10), digits=4)


def learning_curve_sample(spark, sf):
    return sampling.learning_curve_samples(dt.energy(spark, sf), ["stid", "day"])


def subsample_rows(spark, sf):
    return rounded(sampling.subsample(dt.obs(spark, sf), OBS_KEYS), digits=4)


def stack_train_test(spark, sf):
    split = sampling.time_split(daily_obs(spark, sf))
    parts = [split.where(F.col("split") == s) for s in ("train", "test")]
    return rounded(union_all(parts), digits=4)


def ensemble_examples(spark, sf):
    by_member = reduce.reduce_axis(dt.nwp(spark, sf), "hour", "mean")
    wide = reduce.widen_cells(by_member, ["day", "ens"], dt.FEATURES, dt.GRID.n_lat, dt.GRID.n_lon)
    return rounded(wide.withColumn("center", dates.distance_from_midyear(F.col("day"))))


def ensemble_labels(spark, sf):
    members = dt.nwp(spark, sf).select("day", "ens").distinct()
    return members.join(dt.energy_nwp(spark, sf), "day")


def oof_predictions(spark, sf):
    """Climatology fitted without the day's own fold, from one pass of keyed sums."""
    from heliogrid.plans.evaluation import out_of_fold_climatology

    return rounded(out_of_fold_climatology(dt.energy(spark, sf)))


# ---------------------------------------------------------------- calendar


def date_doy(spark, sf):
    return dt.energy(spark, sf).select("stid", "day", dates.day_of_year(F.col("day")).alias("doy"))


def date_center(spark, sf):
    return dt.energy(spark, sf).select("stid", "day", dates.distance_from_midyear(F.col("day")).alias("center"))


def date_month_onehot(spark, sf):
    split = sampling.time_split(dt.energy(spark, sf))
    fitted = split.where("split = 'train'").select(F.month("day").alias("m")).distinct()
    months = sorted(row["m"] for row in fitted.collect())  # at most twelve
    test = split.where("split = 'test'")
    return test.select("stid", "day", *dates.one_hot(F.month("day"), months, "m"))


def date_year(spark, sf):
    return dt.energy(spark, sf).select("stid", "day", dates.year_number(F.col("day")).alias("year"))


def station_onehot(spark, sf):
    """Every station is one class: the block of classes it is in, and the classes of that block (all others are zero)."""
    places = tables.station_places(dt.stations(spark, sf), dt.WIDE)
    return places.select("stid", "block", *dates.one_hot(F.col("place") + 1, range(1, dt.WIDE + 1), "s"))


def cell_position(spark, sf):
    placed = grid.cell_position(dt.stations(spark, sf), dt.GRID)
    return rounded(placed.select("stid", "rel_lat", "rel_lon", "lat_idx", "lon_idx"))


# ---------------------------------------------------------------- sun


def _label_days(spark, sf):
    return dt.energy(spark, sf).select("day").distinct()


def julian_day(spark, sf):
    events = dt.table(spark, sf, "events")
    return events.select("event_id", r(solar.julian_day(F.col("ts")), 3).alias("jd"))


def _day_quantity(spark, sf, name):
    return rounded(sun.day_sun(_label_days(spark, sf)).select("day", name))


def sun_distance(spark, sf):
    return _day_quantity(spark, sf, "distance")


def sun_right_ascension(spark, sf):
    return _day_quantity(spark, sf, "right_ascension")


def sun_declination(spark, sf):
    return _day_quantity(spark, sf, "decl")


def equation_of_time(spark, sf):
    return _day_quantity(spark, sf, "eqt")


def _sun_table(spark, sf):
    return sun.sunrise_sunset(_label_days(spark, sf), dt.stations(spark, sf))


def sunrise_sunset_utc(spark, sf):
    return rounded(_sun_table(spark, sf).select("day", "stid", "sunrise", "sunset"), digits=4)


def day_length(spark, sf):
    return rounded(_sun_table(spark, sf).select("day", "stid", "day_length"), digits=4)


def solar_noon_utc(spark, sf):
    return rounded(_sun_table(spark, sf).select("day", "stid", "noon"), digits=4)


def _local_times(spark, sf):
    summer = F.month("day").between(4, 10)
    return sun.local_sun_times(_label_days(spark, sf), dt.stations(spark, sf), ZONE, summer)


def solar_noon_local(spark, sf):
    return rounded(_local_times(spark, sf).select("day", "stid", "noon_local"), digits=4)


def sunrise_sunset_local(spark, sf):
    return rounded(_local_times(spark, sf).select("day", "stid", "sunrise_local", "sunset_local"), digits=4)


def solar_azimuth_zenith(spark, sf):
    """Sun position at each observation: two-hour steps from 06:00 local time."""
    rows = dt.obs(spark, sf).select("stid", "day", "hour").distinct().join(dt.stations(spark, sf), "stid")
    minutes = (F.col("hour") * 120 + 360).cast("double")
    placed = sun.with_sun_position(sun.day_sun(rows), minutes, F.col("nlat"), F.col("elon"), ZONE)
    return rounded(placed.select("stid", "day", "hour", "azimuth", "zenith"), digits=4)


def _raster(spark, sf, before=False):
    days = dt.nwp(spark, sf).select("day").distinct()
    return sun.terminator_raster(days, (-66.0, 66.0), (-180.0, 180.0), before=before)


def terminator_grid(spark, sf):
    return rounded(_raster(spark, sf), digits=4)


def terminator_line(spark, sf):
    return rounded(sun.terminator(_raster(spark, sf, before=True)), digits=4)


QUERIES = {
    f.__name__: f
    for f in (
        ens_mean, ens_std, hour_mean, hour_std, baseline_grid_mean, ens_mean_of_hour_mean, ens_std_of_hour_mean,
        ens_mean_of_hour_std, ens_std_of_hour_std, intp_ens_mean_std, daily_mean_features, climatology,
        ens_mean_predictions, corner_mean_predictions, perturb_mean_predictions, seed_blend, metrics_mae_rmse_r2,
        mae_daily, ae_by_doy, ae_by_month, mae_by_station, mae_over_under, residual_table, mask_stats,
        feature_standardise, label_standardise, value_histogram, clean_missing_labels, history_features,
        mean_history_features, time_split, kfold_assign, worst_k_stations, learning_curve_sample, subsample_rows,
        stack_train_test, ensemble_examples, ensemble_labels, oof_predictions, date_doy, date_center,
        date_month_onehot, date_year, station_onehot, cell_position, julian_day, sun_distance, sun_right_ascension,
        sun_declination, equation_of_time, sunrise_sunset_utc, day_length, solar_noon_utc, solar_noon_local,
        sunrise_sunset_local, solar_azimuth_zenith, terminator_grid, terminator_line,
    )
}
