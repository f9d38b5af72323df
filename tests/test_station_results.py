"""Results of days x stations rows: by hand on few rows, and plans that neither regroup nor broadcast what grows with them."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliogrid.operators import grid, sun
from heliogrid.operators import shared_ridge as sr
from heliogrid.operators.joins import lookup_join
from heliogrid.plans import models, queries_models, queries_reduce, queries_spatial, queries_tables
from heliogrid.sources import driver_tables as dt
from tests.test_numeric import SPEC, points_of

PLACES = [(31.0, -106.0, 0.0), (34.25, -102.5, 10.0), (34.5, -102.25, 3.0), (38.0, -99.0, 5.0), (38.5, -98.0, 1.0)]


def _plan(df, kind="executedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


def _values(spark):
    cells = [(d, i, j, None if (i, j) == (3, 3) else float(100 * d + 10 * i + j)) for d in (1, 2) for i in range(8) for j in range(8) if (d, i, j) != (2, 4, 4)]
    return spark.createDataFrame(cells, "day int, lat_i int, lon_i int, value double")


@pytest.mark.parametrize("limit", [100, 2])
@pytest.mark.parametrize("offsets, names, cells", [
    (grid.CORNER_OFFSETS, grid.corner_names(), lambda s: grid.corner_cells(s, SPEC)),
    (grid.window_offsets(2), grid.window_names(2), lambda s: grid.window_cells(s, SPEC, 2)),
])
def test_values_by_index_are_those_of_the_cells_of_each_station(spark, offsets, names, cells, limit):
    values, stations = _values(spark), points_of(spark, PLACES)
    stations = stations.unionByName(stations.limit(1))
    columns = ["day", "stid", *names[0], "value"]
    want = grid.cells_to_stations(values, cells(stations)).select(columns).collect()
    got = grid.at_stations(grid.index_values(values, SPEC, offsets, names), stations, SPEC, max_rows=limit).select(columns).collect()
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted(want, key=key) == sorted(got, key=key) and len(got) > 20


def test_copies_of_a_large_lookup_are_not_broadcast(spark):
    facts, lookup = spark.range(20).withColumn("k", F.col("id") % 4), spark.range(8).select((F.col("id") % 4).alias("k"), "id")
    joined = lookup_join(facts, lookup.withColumnRenamed("id", "other"), ["k"], max_rows=2)
    assert "BroadcastHashJoin" not in _plan(joined) and joined.count() == 40


def test_few_maps_meet_the_stations_in_many_tasks(spark, sf):
    for query in (queries_tables.edge_corner_join, queries_tables.local_window_join):
        assert query(spark, sf).select(F.spark_partition_id()).distinct().count() > 1


def test_corner_means_are_not_regrouped_by_station(spark, sf):
    plan = _plan(queries_reduce.corner_mean_predictions(spark, sf), "optimizedPlan")
    assert not [line for line in plan.splitlines() if "Aggregate [" in line and "stid" in line.split("]")[0] and "day" in line.split("]")[0]]


def test_corner_means_by_hand(spark, tmp_path):
    vectors = [(v, [float(v * 64 + p) for p in range(64)]) for v in range(20)]
    spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(k,) for k in (1, 2, 2, 40)], "s_suppkey bigint").write.parquet(f"{tmp_path}/supplier.parquet")
    got = {r["stid"]: r["pred"] for r in queries_reduce.corner_mean_predictions(spark, str(tmp_path)).collect()}
    assert sorted(got) == [1, 2, 40]
    for k, pred in got.items():
        lat, lon = 0.5 + k * 37 % 601 / 100, 0.5 + k * 53 % 601 / 100
        i, j = (sum(a < x for a in range(8)) for x in (lat, lon))
        cells = [8 * (i + a) + j + b for a, b in grid.CORNER_OFFSETS if 0 <= i + a < 8 and 0 <= j + b < 8]
        assert pred == pytest.approx(sum(9.5 * 64 + c for c in cells) / len(cells))


def test_labels_of_more_stations_than_a_file_has_columns(spark, tmp_path):
    """25 000 stations: a CSV row holds 20 480 columns at most."""
    spark.range(1, 25_001).select(F.col("id").alias("s_suppkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    orders = [(0, 5000.0, "1995-01-01"), (0, 15000.0, "1995-01-01"), (24_999, 10000.0, "1995-01-02"), (98, None, "1995-01-02"), (None, 5000.0, "1995-01-03")]
    table = spark.createDataFrame(orders, "o_custkey bigint, o_totalprice double, day string")
    table.select("o_custkey", "o_totalprice", F.to_timestamp("day").alias("o_orderdate")).write.parquet(f"{tmp_path}/orders.parquet")
    got = queries_tables.scan_labels_unpivot(spark, str(tmp_path))
    assert got.agg(F.count("*"), F.countDistinct("stid"), F.countDistinct("day")).first() == (75_000, 25_000, 3)
    known = got.where("y is not null").select(F.dayofmonth("day"), "stid", "y").collect()
    assert sorted(known) == [(1, 1, 150.0), (2, 25_000, 100.0)]


def _ridge_tables(spark, members=("",)):
    rng = np.random.default_rng(4)
    days = [datetime.date(2000, 1, 1 + d) for d in range(20)]
    rows = [(d, m, [float(v) for v in rng.normal(size=3)]) for d in days for m in members]
    labels = [(s, d, float(rng.normal())) for s in range(7) for d in days if (s, d.day) != (3, 4)]
    return spark.createDataFrame(rows, "day date, ens string, features array<double>"), spark.createDataFrame(labels, "stid long, day date, y double")


def test_a_ridge_keeps_a_number_for_each_coordinate_and_predicts_wanted_pairs(spark):
    rows, labels = _ridge_tables(spark)
    rows = rows.drop("ens")
    fitted = sr.StationRidge(alphas=(0.1, 1.0)).fit(rows, labels)
    wanted = labels.where("stid < 3 and day(day) > 5").unionByName(spark.createDataFrame([(99, None, 1.0), (2, None, 5.0), (2, datetime.date(1999, 1, 1), 5.0)], labels.schema))
    got = fitted.predict_pairs(rows, wanted)
    whole = fitted.predict(rows).join(wanted, ["stid", "day"]).join(fitted.models.select("stid", "alpha", "loo"), "stid")
    assert sorted(got.collect()) == sorted(whole.select(got.columns).collect()) and got.count() == 3 * 15
    z = np.linalg.qr(np.random.default_rng(1).normal(size=(50, 4)))[0]
    assert sr.fit_stations(z, np.ones(4), np.random.default_rng(2).normal(size=(50, 6)), np.array([1.0])).turned.shape == (6, 4)


def test_members_are_averaged_in_the_task(spark):
    rows, labels = _ridge_tables(spark, ("a", "b"))
    fitted = sr.StationRidge(alpha=1.0).fit(rows, labels)
    hole = F.when((F.col("ens") == "a") & (F.dayofmonth("day") < 3), F.array(F.lit(None).cast("double"), F.lit(1.0), F.lit(1.0))).otherwise(F.col("features"))
    hole = F.when(F.dayofmonth("day") == 1, F.array(F.lit(None).cast("double"), F.lit(1.0), F.lit(1.0))).otherwise(hole)
    rows = rows.withColumn("features", hole)
    want = {(r["stid"], r["day"]): r["pred"] for r in fitted.predict(rows).groupBy("stid", "day").agg(F.avg("pred").alias("pred")).collect()}
    got = {(r["stid"], r["day"]): r["pred"] for r in fitted.predict(rows, "ens").collect()}
    assert want.keys() == got.keys() and all((want[k] is None and got[k] is None) or got[k] == pytest.approx(want[k]) for k in want)
    assert sum(v is None for v in got.values()) == 7


def test_blocks_of_stations_grow_with_the_stations():
    assert sr._station_blocks(60_000, 2_500, 24) <= 48 and sr._station_blocks(100, 50, 24) == 2
    assert sr.TASK_NUMBERS >= 20_000 * 360_000 / sr._station_blocks(360_000, 20_000, 24)


def test_whole_maps_and_edge_rows_are_rounded_before_they_meet_stations(spark, sf):
    """Rounding a column of the result runs once for each day and station; that of a map once for each day."""
    for query in (queries_spatial.global_features, queries_spatial.edge_features, queries_spatial.conv_box_station):
        df = query(spark, sf)
        plan = _plan(df, "optimizedPlan")
        assert "round(" in plan and "round(" not in plan.split("Join Inner", 1)[0]
        assert df.select(F.spark_partition_id()).distinct().count() > 1


def test_a_raster_with_the_points_before_needs_no_sort(spark, sf):
    days = spark.sql("select explode(sequence(date'2000-02-25', date'2000-03-05')) day")
    span = ((-66.0, 66.0), (-180.0, 180.0))
    long = sun.terminator(sun.terminator_raster(days, *span))
    with_before = sun.terminator(sun.terminator_raster(days, *span, before=True))
    assert sorted(long.collect()) == sorted(with_before.select(long.columns).collect()) and long.count() > 500
    assert "Window" not in _plan(queries_reduce.terminator_line(spark, sf), "optimizedPlan")
    assert queries_reduce.terminator_grid(spark, sf).select(F.spark_partition_id()).distinct().count() > 1


def test_the_scaled_local_design_has_labelled_pairs_only(spark, sf, monkeypatch):
    seen = []
    real = models.local_table
    monkeypatch.setattr(models, "local_table", lambda data, **options: seen.append(real(data, **options)) or seen[0])
    assert queries_models.eval_scaled_local_gbt(spark, sf).count() == 1
    data, energy = queries_models.forecast_data(spark, sf), dt.energy_nwp(spark, sf)
    want = real(data).join(energy, ["day", "stid"])
    assert seen[0].count() == want.count() and seen[0].exceptAll(want.select(seen[0].columns)).isEmpty()
