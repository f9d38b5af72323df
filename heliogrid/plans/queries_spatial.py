"""Queries: interpolation, convolution, neighbourhood features and encoders."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from heliogrid.operators import block_design, codebooks, encode, features, grid, holdout, interpolate, reduce, simplices
from heliogrid.operators.joins import union_all
from heliogrid.operators.perturb import perturb_stations
from heliogrid.plans.queries_reduce import member_interpolation, member_slots, over_members, station_slots
from heliogrid.plans.rounding import r, rounded
from heliogrid.sources import driver_tables as dt

OPS = (("f0", "/", "f1"), ("f0", "-", "f1"))
CODES = 8


def member_mean(spark, sf):
    return reduce.reduce_axis(dt.nwp(spark, sf), "ens", "mean")


def daily_maps(spark, sf):
    return reduce.ensemble_then_hour_mean(dt.nwp(spark, sf))


# ---------------------------------------------------------------- interpolation


def interp_bicubic_spline(spark, sf):
    return rounded(interpolate.interpolate_spline(member_mean(spark, sf), dt.stations(spark, sf), dt.GRID))


def interp_linear(spark, sf):
    return rounded(grid.interpolate_bilinear(member_mean(spark, sf), dt.stations(spark, sf), dt.GRID))


def interp_simplex(spark, sf):
    """Piecewise-linear in longitude, latitude and elevation; NULL outside the hull of the grid's cells."""
    return rounded(simplices.interpolate_simplices(member_mean(spark, sf), dt.stations(spark, sf), dt.GRID, dt.grid(spark)))


def interp_ridge_trend(spark, sf):
    values = interpolate.interpolate_ridge(member_mean(spark, sf), dt.stations(spark, sf), dt.GRID, dt.grid(spark))
    return rounded(values)


def interp_kriging(spark, sf):
    return interpolate.interpolate_kriging(dt.nwp(spark, sf), dt.stations(spark, sf), dt.GRID, dt.grid(spark))


def kriging_nugget(spark, sf):
    stats = interpolate.kriging_nugget(reduce.ensemble_stats(dt.nwp(spark, sf)))
    return stats.select("day", "fx", "hour", "lat_i", "lon_i", r("nugget", 4).alias("nugget"))


def interp_sigma_is_ens_std(spark, sf):
    stations = dt.stations(spark, sf)
    if interpolate.one_place(stations, ["stid"]):
        return rounded(over_members(dt.nwp(spark, sf), stations, interpolate.spline_weights(dt.GRID)))
    members = interpolate.interpolate_spline(dt.nwp(spark, sf), stations, dt.GRID)
    stats = reduce.mean_and_std(members, ["day", "fx", "hour", "stid"])
    return rounded(stats.withColumnsRenamed({"mean": "value", "std": "sigma"}))


def interp_per_member(spark, sf):
    return rounded(member_interpolation(spark, sf))


def perturbed_stations(spark, sf):
    return rounded(perturb_stations(dt.stations(spark, sf)))


def _holdout(spark, sf, candidates):
    cells = interpolate.grid_coordinates(dt.grid(spark), dt.GRID)
    return holdout.holdout(dt.nwp(spark, sf), dt.GRID, cells, candidates, holdout.hidden_sets(dt.GRID))


def interp_holdout(spark, sf):
    """Five sets of twenty hidden inner cells: kriging with the members' spread as nugget and without, spline, ridge."""
    candidates = [holdout.Kriging(), holdout.Kriging((10.0, 10.0, 10.0), interpolate.FLOOR_NUGGET), holdout.Spline(), holdout.Ridge()]
    return rounded(holdout.over_sets(_holdout(spark, sf, candidates)))


def interp_holdout_ridge(spark, sf):
    """Ridge trends with and without normalised columns, by set of hidden cells."""
    return rounded(_holdout(spark, sf, [holdout.Ridge(0.1), holdout.Ridge(0.1, False)]))


def interp_param_sweep(spark, sf):
    """Random kriging lengths and a grid of ridge penalties, over all sets of hidden cells."""
    return rounded(holdout.over_sets(_holdout(spark, sf, holdout.sweep()))).orderBy("mse", "candidate")


def regrid_dense(spark, sf):
    return rounded(interpolate.regrid_spline(daily_maps(spark, sf), dt.GRID))


# ---------------------------------------------------------------- convolution, resampling, vectors


def _filtered(spark, sf, points, kernel, maps=None):
    maps = daily_maps(spark, sf) if maps is None else maps
    vectors = grid.map_vectors(maps, ["day", "fx"], dt.GRID)
    return interpolate.at_points(vectors, ["day", "fx"], points, ["row", "col"], kernel)


def conv_box(spark, sf):
    rows, columns = block_design.Box(5, 2).places(dt.GRID)
    points = {"row": np.repeat(rows, len(columns)), "col": np.tile(columns, len(rows))}
    return rounded(_filtered(spark, sf, points, block_design.BoxKernel(dt.GRID, 5)))


def conv_box_station(spark, sf):
    """The filtered daily maps of all features, attached to every station."""
    box = block_design.CubeBlock("g", dt.nwp(spark, sf), dt.FEATURES, view=block_design.Box(5, 2))
    return block_design.block_design([box], dt.stations(spark, sf), dt.GRID, aux=False, digits=6)


def conv_2x2(spark, sf):
    kernel = block_design.BoxKernel(dt.GRID, 2)
    return rounded(_filtered(spark, sf, kernel.places(), kernel))


def conv_ring3(spark, sf):
    """The ring filter next to the raw map."""
    maps = daily_maps(spark, sf)
    kernel = block_design.BoxKernel(dt.GRID, 3, ring=True)
    ring = _filtered(spark, sf, kernel.places(), kernel, maps).withColumn("kind", F.lit("ring"))
    raw = maps.withColumnsRenamed({"lat_i": "row", "lon_i": "col"}).withColumn("kind", F.lit("raw"))
    return rounded(union_all([raw.select("day", "fx", "row", "col", "value", "kind"), ring]))


def resample_zoom(spark, sf):
    points, weights = interpolate.zoom_points(dt.GRID, 0.25)
    first = daily_maps(spark, sf).where(F.col("fx") == dt.FEATURES[0])
    return rounded(_filtered(spark, sf, points, interpolate.LinearKernel(weights), first))


def map_standardise(spark, sf):
    return rounded(encode.standardise_cells(encode.one_feature(dt.nwp(spark, sf), "f0")))


def map_vectors(spark, sf):
    """Map vectors per (day, member, hour), per (day, member) and per (day, hour), with their positions."""
    cube = dt.nwp(spark, sf)
    kinds = {
        "map": encode.one_feature(cube, "f0").withColumn("key", F.concat_ws("_", "ens", "hour")),
        "member": encode.one_feature(cube, "f0", hour_mean=True).withColumn("key", F.col("ens").cast("string")),
        "hour": encode.one_feature(cube, "f0", ens_mean=True).withColumn("key", F.col("hour").cast("string")),
    }
    parts = []
    for kind, maps in kinds.items():
        vectors = grid.map_vectors(maps, ["day", "key"], dt.GRID)
        parts.append(vectors.select(F.lit(kind).alias("kind"), "day", "key", F.posexplode("cells").alias("pos", "value")))
    return rounded(union_all(parts))


# ---------------------------------------------------------------- neighbourhood features


def local_features(spark, sf):
    return features.local_features(dt.nwp(spark, sf), dt.stations(spark, sf), dt.GRID, dt.FEATURES, k=1, finish=rounded)


def local_features_hourly(spark, sf):
    """The hourly member spread in the window, without averaging hours."""
    return features.local_features(
        dt.nwp(spark, sf), dt.stations(spark, sf), dt.GRID, dt.FEATURES, dt.HOURS, hour_mean=False, ens_std=True, aux=False, finish=rounded
    )


def local_features_blocks(spark, sf):
    """Means of one feature around the station, hourly means of the other, member spread of daily means, a filtered map, and calendar."""
    cube = dt.nwp(spark, sf)
    days = cube.select("day").distinct().select("day", F.abs(F.dayofyear("day") - F.lit(182.625)).alias("center"), F.year("day").alias("year"))
    blocks = [
        block_design.CubeBlock("nm", cube, ("f0",)),
        block_design.CubeBlock("hr", cube, ("f1",), dt.HOURS, hour=None),
        block_design.CubeBlock("sd", cube, dt.FEATURES, ens="std"),
        block_design.CubeBlock("hs", cube, ("f0",), hour="std"),
        block_design.CubeBlock("g", cube, ("f1",), view=block_design.Box(3, 2)),
        block_design.DayBlock("cal", days, ("center", "year")),
    ]
    return block_design.block_design(blocks, dt.stations(spark, sf), dt.GRID, finish=lambda t: rounded(t, digits=5))


def global_features(spark, sf):
    return features.global_features(dt.nwp(spark, sf), dt.stations(spark, sf), dt.GRID, dt.FEATURES, finish=rounded)


def edge_features(spark, sf):
    return features.edge_features(
        dt.nwp(spark, sf), dt.stations(spark, sf), dt.grid(spark), dt.GRID, dt.FEATURES, dt.HOURS, OPS, finish=lambda t: rounded(t, digits=4)
    )


def edge_labels(spark, sf):
    return features.edge_labels(dt.energy_nwp(spark, sf))


def kriging_design_matrix(spark, sf):
    table = features.station_design(
        station_slots(spark, sf, before=True), dt.stations(spark, sf), dt.FEATURES, dt.HOURS, OPS,
        with_solar=True, with_history=True, with_mean_history=True, with_climate=True,
    )
    return rounded(table, digits=4)


def member_design_matrix(spark, sf):
    table = features.station_design(
        member_slots(spark, sf), dt.stations(spark, sf), dt.FEATURES, dt.HOURS, OPS,
        blocks=("nm_intp", "nmft_intp"), with_solar=True, extra_keys=("ens",),
    )
    return rounded(table, digits=4)


# ---------------------------------------------------------------- encoders


def encode_kmeans(spark, sf):
    return encode.encode_kmeans(encode.one_feature(dt.nwp(spark, sf), "f0"), dt.GRID, CODES)


def encode_minibatch(spark, sf):
    """Distances to a mini-batch codebook, on the known cells of every map."""
    maps = encode.one_feature(dt.nwp(spark, sf), "f0")
    return codebooks.encode_minibatch(maps, dt.GRID, codebooks.MiniBatchKMeans(k=CODES))


def encode_gmm(spark, sf):
    """Posteriors of a mixture with full covariances over all cells; at most 30 of the default 200 steps of about a third of a second."""
    maps = encode.one_feature(dt.nwp(spark, sf), "f0")
    return codebooks.encode_whole_mixture(maps, dt.GRID, codebooks.GaussianMixture(k=CODES, iterations=30))


def encode_random_projection(spark, sf):
    return rounded(encode.encode_projection(encode.one_feature(dt.nwp(spark, sf), "f0"), dt.GRID, CODES))


def encode_daily_row(spark, sf):
    maps = encode.one_feature(dt.nwp(spark, sf), "f0")
    codes = encode.encode_projection(maps, dt.GRID, CODES)
    names = [f"{e}_{h}_{c}" for e in dt.MEMBERS for h in dt.HOURS for c in range(CODES)]
    wide = encode.daily_codes(codes, ["ens", "hour", "code"], names, "value")
    return rounded(wide.withColumnsRenamed({n: f"c_{n}" for n in names}))


QUERIES = {
    f.__name__: f
    for f in (
        interp_bicubic_spline, interp_linear, interp_simplex, interp_ridge_trend, interp_kriging, kriging_nugget,
        interp_sigma_is_ens_std, interp_per_member, interp_holdout, interp_holdout_ridge, interp_param_sweep, regrid_dense, conv_box, conv_box_station,
        conv_2x2, conv_ring3, resample_zoom, map_standardise, map_vectors, local_features, local_features_hourly, local_features_blocks,
        global_features, edge_features, edge_labels, kriging_design_matrix, member_design_matrix, encode_kmeans,
        encode_minibatch, encode_gmm, encode_random_projection, encode_daily_row,
    )
}
QUERIES["perturb_stations"] = perturbed_stations
