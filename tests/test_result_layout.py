"""Results of days x stations: the same rows as pair by pair, laid out so that what rows share is written once in a run."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliogrid.operators import block_design, features, grid
from heliogrid.plans.rounding import rounded
from tests.test_numeric import SPEC, points_of
from tests.test_rows_in_tasks import PLACES, days_of


def in_order(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((v is None, v) for v in r))


def many_places(spark, n):
    """Stations at places of their own, which no formula repeats."""
    rng = np.random.default_rng(3)
    places = zip(rng.uniform(30.5, 38.5, n), rng.uniform(-106.5, -98.5, n), rng.uniform(0, 1000, n))
    return points_of(spark, [tuple(float(v) for v in p) for p in places])


def bytes_a_row(table, path):
    table.write.parquet(str(path))
    return sum(f.stat().st_size for f in path.glob("*.parquet")) / table.sparkSession.read.parquet(str(path)).count()


@pytest.mark.parametrize("most", [2, 1024])
@pytest.mark.parametrize("options", [{}, {"hours": (0, 1), "hour_mean": False, "ens_std": True, "aux": False}, {"station_classes": [1, 3]}])
def test_local_features_in_blocks_are_those_of_pairs(spark, monkeypatch, most, options):
    """An unknown cell, stations off the grid, of one index, at no place, that come twice or have no id; blocks of any size."""
    monkeypatch.setattr(features, "BLOCK_STATIONS", most)
    cube, stations = days_of(spark, [1, 2, 5]), points_of(spark, [*PLACES, *[(34.1 + i / 50, -102.7, float(i)) for i in range(7)]])
    stations = stations.unionByName(stations.where("stid in (1, 2)")).unionByName(stations.where("stid = 3").withColumn("nlat", F.lit(None).cast("double")))
    pairs = cube.select("day").distinct().crossJoin(stations.select("stid").distinct()).withColumn("y", F.lit(0.0))
    want = features.local_features(cube, stations, SPEC, ("f0", "f1"), pairs=pairs, **options).drop("y")
    got = features.local_features(cube, stations, SPEC, ("f0", "f1"), **options)
    assert got.columns == want.columns and got.schema.simpleString() == want.schema.simpleString()
    assert in_order(got.collect()) == in_order(want.collect())
    early = features.local_features(cube, stations, SPEC, ("f0", "f1"), finish=rounded, **options)
    assert in_order(early.collect()) == in_order(rounded(want).collect())
    nameless = stations.where("stid = 1").limit(1).withColumn("stid", F.lit(None).cast(stations.schema["stid"].dataType))
    assert features.local_features(cube, stations.unionByName(nameless), SPEC, ("f0", "f1"), **options).where("stid is null").count() == 3


def days_with_cells(spark, days):
    cube = spark.range(days).select(F.date_add(F.lit(datetime.date(2000, 1, 1)), F.col("id").cast("int")).alias("day"))
    cells = F.explode(F.sequence(F.lit(0), F.lit(63)))
    cube = cube.crossJoin(spark.createDataFrame([("f0",), ("f1",)], "fx string")).withColumn("cell", cells)
    return cube.select("day", "fx", F.lit(0).alias("ens"), F.lit(0).alias("hour"), F.floor(F.col("cell") / 8).cast("int").alias("lat_i"), (F.col("cell") % 8).alias("lon_i"), F.randn(1).alias("value"))


def test_local_features_write_shared_values_once_in_a_run(spark, tmp_path):
    table = features.local_features(days_with_cells(spark, 400), many_places(spark, 1500), SPEC, ("f0", "f1"))
    assert bytes_a_row(rounded(table), tmp_path / "rows") < 8


@pytest.mark.parametrize("names, offsets", [(grid.corner_names(), grid.CORNER_OFFSETS), (grid.window_names(2), grid.window_offsets(2))])
def test_values_around_stations_are_written_once_in_a_run(spark, tmp_path, names, offsets):
    means = days_with_cells(spark, 30).drop("ens").withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("value", F.col("value") + F.col("hour"))
    many_places(spark, 6000).write.parquet(str(tmp_path / "places"))
    table = grid.at_stations(grid.index_values(means, SPEC, offsets, names), spark.read.parquet(str(tmp_path / "places")), SPEC)
    assert bytes_a_row(table.select("day", "fx", "hour", "stid", *names[0], "value"), tmp_path / "rows") < 1


def edge_table(spark, cube, stations, pairs=None):
    cells = spark.range(64).select(F.floor(F.col("id") / 8).cast("int").alias("lat_i"), (F.col("id") % 8).cast("int").alias("lon_i"))
    cells = cells.select("lat_i", "lon_i", (F.col("lat_i") + 31.0).alias("lat"), (F.col("lon_i") - 106.0).alias("lon"), (F.col("lat_i") * 10.0).alias("elev"))
    return features.edge_features(cube, stations, cells, SPEC, ("f0", "f1"), (0,), (("f0", "/", "f1"),), pairs, rounded)


def test_edge_rows_write_shared_values_once_in_a_run(spark, tmp_path):
    table = edge_table(spark, days_with_cells(spark, 200), many_places(spark, 3000))
    assert bytes_a_row(table, tmp_path / "rows") < 14


@pytest.mark.parametrize("most", [2, 1024])
def test_edge_rows_in_blocks_are_those_of_pairs(spark, monkeypatch, most):
    monkeypatch.setattr(features, "BLOCK_STATIONS", most)
    cube, stations = days_of(spark, [1, 2, 5]), points_of(spark, [*PLACES, *[(34.1 + i / 50, -102.7, float(i)) for i in range(7)]])
    stations = stations.unionByName(stations.where("stid in (1, 2)")).unionByName(stations.where("stid = 3").withColumn("nlat", F.col("nlat") - 1.5))
    pairs = cube.select("day").distinct().crossJoin(stations.select("stid").distinct()).withColumn("y", F.lit(0.0))
    want, got = edge_table(spark, cube, stations, pairs).drop("y"), edge_table(spark, cube, stations)
    assert got.columns == want.columns and got.schema.simpleString() == want.schema.simpleString()
    assert in_order(got.collect()) == in_order(want.collect())


def test_block_designs_write_shared_values_once_in_a_run(spark, tmp_path):
    """Values are finished for an index and a day; the rows are those finished pair by pair."""
    cube, places = days_with_cells(spark, 200), many_places(spark, 3000)
    blocks = [block_design.CubeBlock("m", cube, ("f0", "f1")), block_design.CubeBlock("g", cube, ("f0",), view=block_design.Box(3, 2))]
    some, day = places.where("stid < 40"), F.lit(datetime.date(2000, 1, 3))
    got = block_design.block_design(blocks, some, SPEC, station_classes=[1, 2], finish=lambda t: rounded(t, digits=2)).where(F.col("day") == day)
    want = rounded(block_design.block_design(blocks, some, SPEC, station_classes=[1, 2]).where(F.col("day") == day), digits=2)
    assert got.columns == want.columns and in_order(got.collect()) == in_order(want.collect())
    assert bytes_a_row(block_design.block_design(blocks, places, SPEC, finish=rounded), tmp_path / "rows") < 14


def test_bilinear_values_are_made_by_all_tasks(spark):
    table = grid.interpolate_bilinear(days_of(spark, range(1, 9)), many_places(spark, 50), SPEC)
    assert table.count() == 8 * 2 * 2 * 2 * 50
    assert table.select(F.spark_partition_id().alias("task")).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))
