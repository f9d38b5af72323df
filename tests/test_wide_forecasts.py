"""Forecasts that meet stations as wide rows against the long tables they stand for, and plans that regroup nothing by station."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliogrid.operators import features, grid, interpolate, reduce
from heliogrid.plans import models, queries_models, queries_reduce, queries_spatial
from heliogrid.sources import driver_tables as dt
from tests.test_numeric import SPEC, cube_of, points_of

PLACES = [(31.0, -106.0, 0.0), (34.25, -102.5, 10.0), (38.0, -99.0, 5.0), (38.5, -100.0, 1.0)]


def holed(spark):
    """Three members on one map; a cell is unknown in one member and missing in another, and one cell in all."""
    cube = cube_of(spark, list(np.random.default_rng(3).normal(size=(3, 8, 8))))
    cube = cube.where("not (ens = 1 and lat_i = 3 and lon_i = 3) and not (lat_i = 7 and lon_i = 7)")
    return cube.withColumn("value", F.expr("if(ens = 0 and lat_i = 4 and lon_i = 4, null, value)"))


@pytest.mark.parametrize("limit", [100, 2])
def test_slots_equal_long_forecasts(spark, limit):
    cube, stations = holed(spark), points_of(spark, PLACES)
    fx, hour = cube.select("fx", "hour").first()
    members = grid.interpolate_bilinear(cube, stations, SPEC)
    want = {r["stid"]: r for r in reduce.mean_and_std(members, ["day", "fx", "hour", "stid"]).collect()}
    weights = interpolate.bilinear_weights(SPEC)
    rows = interpolate.slots_at_points(cube, stations, SPEC, weights, [fx], [hour, 99], spreads=True, max_points=limit).collect()
    assert len(rows) == len(want) == len(PLACES)
    for r in rows:
        for name, column in (("mean", "nm_intp"), ("std", "nm_intp_sigma")):
            value = want[r["stid"]][name]
            got = r[f"{column}_{fx}_{hour}"]
            assert (got is None) == (value is None) and (value is None or got == pytest.approx(value, abs=1e-12))
            assert r[f"{column}_{fx}_99"] is None


def test_labelled_rows_are_those_of_the_whole_design(spark, sf):
    data = queries_models.forecast_data(spark, sf)
    day = data.cube.agg(F.min("day")).first()[0]
    pairs = spark.createDataFrame([(day, 1, 7.0), (day, 3, None), (day, 10**6, 1.0)], "day date, stid bigint, y double")
    for model in (models.LocalModel(), models.EdgeModel(), models.KrigingModel(), models.EnsembleKrigingModel(), models.PerturbedKrigingModel()):
        whole = model.table(data).join(pairs, ["day", "stid"])
        some = model.table(data, pairs).select(whole.columns)
        order = [*model.keys]
        want, got = whole.orderBy(*order).collect(), some.orderBy(*order).collect()
        assert len(want) == len(got) > 1
        for a, b in zip(want, got):
            assert all(x == y or x == pytest.approx(y, abs=1e-9) for x, y in zip(a, b))


@pytest.mark.parametrize("query", [queries_reduce.intp_ens_mean_std, queries_reduce.daily_mean_features, queries_spatial.interp_sigma_is_ens_std, queries_spatial.member_design_matrix])
def test_nothing_is_grouped_by_station(spark, sf, query):
    plan = query(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Aggregate [" in line and "stid" in line.split("]")[0]]


def test_a_station_at_two_places_is_averaged_as_before(spark):
    twice = points_of(spark, PLACES[:2]).withColumn("stid", F.lit(1).cast("bigint"))
    assert not interpolate.one_place(twice, ["stid"])
    assert interpolate.one_place(twice.limit(1).union(twice.limit(1)), ["stid"]) and features.BLOCKS
