"""What belongs to one day and station is put together in the task that makes it: against the regrouping it replaces, and by plans."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliogrid.operators import features, interpolate, reduce, ridge
from heliogrid.plans import evaluation, models, queries_reduce, queries_spatial
from heliogrid.sources import tables
from tests.test_numeric import SPEC, points_of

PLACES = [(31.0, -106.0, 0.0), (34.25, -102.5, 10.0), (38.0, -99.0, 5.0), (38.5, -100.0, 1.0)]


def days_of(spark, days, members=2):
    rng = np.random.default_rng(7)
    rows = [
        (datetime.date(2000, 1, d), fx, e, h, i, j, None if (d, fx, i, j) == (2, "f0", 3, 3) else float(rng.normal()))
        for d in days for fx in ("f0", "f1") for e in range(members) for h in (0, 1) for i in range(8) for j in range(8)
    ]
    return spark.createDataFrame(rows, "day date, fx string, ens int, hour int, lat_i int, lon_i int, value double")


def regrouped(df):
    """Lines of the optimized plan that group or rank rows of stations and days."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [line for line in plan.splitlines() if ("Aggregate [" in line and "stid" in line.split("]")[0] and "day" in line.split("]")[0]) or ("Window [" in line and "stid" in line and "day" in line)]


def same_rows(want, got):
    key = lambda r: tuple((v is None, v) for v in r[:3])
    want, got = (sorted(map(tuple, x), key=key) for x in (want, got))
    assert len(want) == len(got) > 0
    for a, b in zip(want, got):
        assert all(x == y or (x is not None and y is not None and x == pytest.approx(y, abs=1e-9)) for x, y in zip(a, b)), (a, b)


@pytest.mark.parametrize("limit", [100, 2])
def test_copies_are_averaged_where_they_meet_a_map(spark, limit):
    daily = reduce.ensemble_then_hour_mean(days_of(spark, [1, 2, 3]))
    copies = points_of(spark, PLACES).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("nlat", F.col("nlat") + F.col("copy") / 10)
    copies = copies.unionByName(copies.where("stid = 2")).unionByName(copies.where("stid = 1 and copy = 0").withColumn("nlat", F.lit(None).cast("double")))
    each = interpolate.interpolate_spline(daily, copies, SPEC, ids=("stid", "copy")).withColumnRenamed("value", "pred")
    want = reduce.mean_prediction(each, ["day", "fx", "stid"])
    got = interpolate.copy_means(daily, copies, SPEC, max_points=limit)
    same_rows(want.collect(), got.select(want.columns).collect())


def test_copy_means_are_not_regrouped(spark, sf):
    assert not regrouped(queries_reduce.perturb_mean_predictions(spark, sf))


@pytest.mark.parametrize("limit", [100, 2])
def test_history_of_maps_is_that_of_the_rows_of_a_station(spark, limit):
    """Days with a gap, a map with an unknown cell, and a station that comes twice."""
    cube, stations = days_of(spark, [5, 1, 2, 9]), points_of(spark, PLACES)
    stations = stations.unionByName(stations.where("stid = 1"))
    weights = interpolate.bilinear_weights(SPEC)
    options = {"with_history": True, "with_mean_history": True}
    tables = []
    for before in (False, True):
        slots = interpolate.slots_at_points(cube, stations, SPEC, weights, ("f0", "f1"), (0, 1), spreads=True, before=before, max_points=limit)
        tables.append(features.station_design(slots, stations, ("f0", "f1"), (0, 1), (("f0", "/", "f1"),), **options))
    assert tables[0].columns == tables[1].columns
    numbered = [t.select("day", "stid", F.row_number().over(reduce_window()).alias("n"), *t.columns[2:]) for t in tables]
    same_rows(numbered[0].collect(), numbered[1].collect())


def reduce_window():
    from pyspark.sql import Window

    return Window.partitionBy("day", "stid").orderBy(F.col("`nm_intp_f1_0_t-1`"))


def test_the_design_matrix_ranks_no_rows_of_stations(spark, sf):
    assert not regrouped(queries_spatial.kriging_design_matrix(spark, sf))


class _Odd:
    """Scores a row by its first and last features; none where the last is unknown."""

    def transform(self, df):
        return df.withColumn("pred", F.element_at("features", 1) * 3 + F.element_at("features", -1))


def test_corners_are_averaged_in_a_row(spark):
    cube = days_of(spark, [1, 2, 3]).where("not (day = '2000-01-01' and lat_i = 3 and lon_i = 4)")
    cube = cube.withColumn("value", F.expr("if(day = '2000-01-03' and fx = 'f1', null, value)"))
    grid = spark.range(64).selectExpr("int(id div 8) lat_i", "int(id % 8) lon_i", "31.0 + id div 8 lat", "id % 8 - 106.0 lon", "double(id) elev")
    stations = points_of(spark, [*PLACES, (33.5, -102.5, 2.0), (60.0, 10.0, 2.0)])
    stations = stations.unionByName(stations.where("stid = 1"))
    data = models.ForecastData(cube, stations, grid, SPEC, ("f0", "f1"), (0, 1), (("f0", "-", "f1"),))
    fitted = models.FittedModel(models.EdgeModel(), _Odd(), None)
    rows = models.EdgeModel().predict_rows(data)
    want, got = fitted.predict_rows(rows), fitted.predict(data)
    same_rows(want.collect(), got.select(want.columns).collect())
    assert regrouped(want) and not regrouped(got)
    assert got.where("pred is null").count() > 0


@pytest.mark.parametrize("scaled", [True, False])
def test_blocks_of_stations_are_predicted_in_a_row(spark, scaled):
    """A station that comes twice, one off the grid, one without labels (and alone in its block), an unknown id, an unknown cell."""
    cube = days_of(spark, [1, 2, 3])
    stations = points_of(spark, [*PLACES, (60.0, 10.0, 2.0), (33.5, -102.5, 2.0), (35.5, -101.5, 7.0)])
    stations = stations.unionByName(stations.where("stid = 1")).unionByName(stations.where("stid = 2").withColumn("stid", F.lit(None).cast("bigint")))
    data = models.ForecastData(cube, stations, None, SPEC, ("f0", "f1"), (0, 1))
    known = [(datetime.date(2000, 1, d), s, float(d * s + s % 2)) for d in (1, 2, 3) for s in range(6)]
    labels = spark.createDataFrame(known, "day date, stid bigint, y double")
    places = tables.station_places(stations, 7)
    model = models.LocalModel(ridge.Ridge(alpha=1.0))
    want = tables.submission_blocks(evaluation.submit(model, data, data, labels, scale_labels=scaled), places, 7)
    got = evaluation.submit_blocks(model, data, data, labels, places, 7, scale_labels=scaled)
    assert got.columns == want.columns and got.count() == (3 if scaled else 6)
    same_rows(want.collect(), got.collect())
    assert regrouped(evaluation.submit(model, data, data, labels, scale_labels=scaled).groupBy("day", "stid").count())
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Aggregate [" in line and "day" in line.split("]")[0] and "block" in line.split("]")[0]]
    clipped = models.LocalModel(ridge.Ridge(alpha=1.0), clip=True)
    same_rows(tables.submission_blocks(evaluation.submit(clipped, data, data, labels), places, 7).collect(), evaluation.submit_blocks(clipped, data, data, labels, places, 7).collect())
