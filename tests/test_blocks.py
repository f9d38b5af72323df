"""The block container, sources and sinks."""

import datetime as dtm

import pytest
from pyspark.sql import functions as F

from heliogrid.operators.blocks import BlockError, Blocks, assign_block
from heliogrid.sources import tables


@pytest.fixture()
def ten(spark):
    day = F.date_add(F.lit("2000-01-01").cast("date"), F.col("id").cast("int"))
    return spark.range(10).select(day.alias("day"), F.col("id").alias("foo"))


def values(df, column):
    return [r[column] for r in df.orderBy("day").collect()]


def test_block_access_and_missing_name(ten):
    bundle = Blocks(["day"], {"foo": ten})
    assert values(bundle["foo"], "foo") == list(range(10))
    assert values(bundle.foo, "foo") == list(range(10))
    with pytest.raises(AttributeError):
        bundle.bar  # noqa: B018


def test_metadata_is_kept_and_is_no_block(ten):
    bundle = Blocks(["day"], {"foo": ten})
    bundle.name = "forecast"
    assert bundle.name == "forecast" and "name" not in bundle.blocks
    assert bundle.rows(0).name == "forecast"
    assert bundle.rows(2, 7).name == "forecast"


def test_slices(ten):
    bundle = Blocks(["day"], {"foo": ten, "bar": ten.withColumnRenamed("foo", "bar")})
    assert values(bundle.rows(0).foo, "foo") == [0]
    cut = bundle.rows(2, 7)
    assert values(cut.foo, "foo") == [2, 3, 4, 5, 6] and values(cut.bar, "bar") == [2, 3, 4, 5, 6]


def test_values_puts_blocks_side_by_side(ten):
    wide = Blocks(["day"], {"foo": ten, "bar": ten.withColumnRenamed("foo", "bar")}).values()
    assert wide.columns == ["day", "foo", "bar"] and wide.count() == 10


def test_keys_must_agree(ten):
    bundle = Blocks(["day"], {"foo": ten})
    short = ten.where("foo < 5").withColumnRenamed("foo", "bar")
    with pytest.raises(BlockError):
        bundle["bar"] = short
    with pytest.raises(ValueError):
        Blocks(["day"], {"foo": ten, "bar": short})
    with pytest.raises(ValueError):
        assign_block(ten, short, ["day"])
    bundle["bar"] = ten.withColumnRenamed("foo", "bar")
    bundle.bar = ten.select("day", (F.col("foo") * 2).alias("bar"))
    assert values(bundle.bar, "bar") == [2 * i for i in range(10)]
    assert list(bundle.drop("foo").blocks) == ["bar"]


def test_label_csv_and_submission(spark, tmp_path):
    d = dtm.date(1994, 1, 1)
    pred = spark.createDataFrame([(d, 0, 1.5), (d, 1, None), (dtm.date(1994, 1, 2), 1, 2.0)], "day date, stid bigint, pred double")
    stations = spark.createDataFrame([(0, "ACME"), (1, "ADAX")], "stid bigint, station string")
    path = str(tmp_path / "out")
    tables.write_submission(pred, stations, path)
    raw = spark.read.option("header", True).csv(path)
    assert raw.columns == ["Date", "ACME", "ADAX"]
    assert sorted(r["Date"] for r in raw.collect()) == ["19940101", "19940102"]
    long = tables.read_label_csv(spark, path)
    got = {(r["day"], r["station"]): r["y"] for r in long.collect()}
    assert len(got) == 4 and got[(d, "ACME")] == 1.5 and got[(d, "ADAX")] is None


def test_station_csv_numbers_follow_ids(spark, tmp_path):
    path = tmp_path / "stations.csv"
    path.write_text("stid,nlat,elon,elev\nBEAV,36.8,-100.5,758\nACME,34.8,-98.0,397\nADAX,34.7,-96.6,295\n")
    rows = {r["station"]: r["stid"] for r in tables.read_station_csv(spark, str(path)).collect()}
    assert rows == {"ACME": 0, "ADAX": 1, "BEAV": 2}


def test_cube_is_stacked_from_feature_tables(spark, tmp_path):
    schema = "day date, ens int, hour int, lat_i int, lon_i int, value float"
    rows = [(dtm.date(1994, 1, 1), 0, 0, 0, 0, 1.25), (dtm.date(1994, 1, 1), 0, 0, 0, 1, float("nan"))]
    for fx in ("dswrf_sfc", "tmp_2m"):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{fx}_train"))
    cube = tables.load_cube(spark, str(tmp_path), ("dswrf_sfc", "tmp_2m"), "_train")
    got = sorted((r["fx"], r["lon_i"], r["value"]) for r in cube.where("value is not null").collect())
    assert got == [("dswrf_sfc", 0, 1.25), ("tmp_2m", 0, 1.25)] and cube.count() == 4


def test_tables_round_trip(spark, tmp_path, ten):
    tables.write_tables({"x": ten.withColumn("split", F.lit("train"))}, str(tmp_path / "t"), "ten days")
    back = tables.read_tables(spark, str(tmp_path / "t"), ["x"])["x"]
    assert values(back, "foo") == list(range(10)) and back.where("split = 'train'").count() == 10
    assert back.schema["day"].metadata["description"] == "ten days"


def test_nan_labels_are_missing(spark):
    from heliogrid.sources.tables import unpivot_labels

    wide = spark.createDataFrame([("19940101", "NaN", "5"), ("19940102", "3", None)], "Date string, A string, B string")
    assert [r.y for r in unpivot_labels(wide, "Date").orderBy("day", "station").collect()] == [None, 5.0, 3.0, None]


def test_a_repeated_cell_is_an_error_or_padded_never_shifted(spark):
    import pytest

    from heliogrid.operators import grid as g

    spec = g.GridSpec.of([0, 1], [0, 1])
    rows = [("a", 0, 0, 1.0), ("a", 0, 1, 2.0), ("a", 1, 1, 4.0)]
    df = spark.createDataFrame(rows, "k string, lat_i int, lon_i int, value double")
    assert g.map_vectors(df, ["k"], spec).first().cells == [1.0, 2.0, None, 4.0]
    twice = spark.createDataFrame([*rows, ("a", 0, 1, 9.0)], df.schema)
    with pytest.raises(Exception):
        g.map_vectors(twice, ["k"], spec).collect()


def test_more_stations_than_columns_are_written_in_blocks(spark, tmp_path):
    import csv

    ids = [3, 5, 8, 13, 21, 34, 55]
    stations = spark.createDataFrame([(i, f"N{i}") for i in ids], "stid long, station string")
    days = [dtm.date(2010, 1, 1), dtm.date(2010, 1, 2)]
    pred = spark.createDataFrame([(d, i, float(i * 10 + d.day)) for d in days for i in ids if (d.day, i) != (2, 13)], "day date, stid long, pred double")
    places = {r["stid"]: (r["block"], r["place"]) for r in tables.station_places(stations, 3).collect()}
    assert places == {i: divmod(k, 3) for k, i in enumerate(ids)}
    wide = {(r["Date"], r["block"]): tuple(r)[2:] for r in tables.submission_blocks(pred, tables.station_places(stations, 3), 3).collect()}
    assert wide["20100102", 1] == (None, 212.0, 342.0) and wide["20100101", 2] == (551.0, None, None) and len(wide) == 6
    tables.write_submission(pred, stations, f"{tmp_path}/out", max_stations=3)
    seen = {}
    for block in range(3):
        for file in (tmp_path / "out" / f"block={block}").glob("*.csv"):
            for row in csv.DictReader(open(file)):
                seen.update({(row["Date"], k): v for k, v in row.items() if k != "Date"})
    assert len(seen) == 14 and seen["20100101", "N55"] == "551.0" and seen["20100102", "N13"] == ""
