"""The forecast tables, derived from the generic test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliogrid.operators.grid import GridSpec

# Fixed values of the derivation: an 8 x 8 grid, five hours, two members, two features.
GRID = GridSpec.of([31 + i for i in range(8)], [-106 + j for j in range(8)])
HOURS = tuple(range(5))
FEATURES = ("f0", "f1")
MEMBERS = (0, 1)
WIDE = 98  # stations in a row of the wide formats; more of them make more rows
FIRST_DAY = "1994-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _day_after(days) -> F.Column:
    return F.date_add(F.lit(FIRST_DAY).cast("date"), days.cast("int"))


def nwp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecast cube: one 64-vector is one map."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "v"))
    vec = F.col("vec_id")
    return vectors.select(
        _day_after(F.floor(vec / 20)).alias("day"),
        F.concat(F.lit("f"), F.floor((vec % 20) / 10).cast("string")).alias("fx"),
        F.floor((vec % 10) / 5).cast("int").alias("ens"),
        (vec % 5).cast("int").alias("hour"),
        F.floor(F.col("pos") / 8).cast("int").alias("lat_i"),
        (F.col("pos") % 8).cast("int").alias("lon_i"),
        F.col("v").cast("double").alias("value"),
    )


def _grid_columns(lat_i, lon_i):
    return (
        (F.lit(31) + lat_i).cast("double").alias("lat"),
        (lon_i - 106).cast("double").alias("lon"),
        (F.lit(100) + (lat_i * 131 + lon_i * 57) % 900).cast("double").alias("elev"),
    )


def grid_of_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid cells present in the cube, with coordinates and elevation."""
    cells = nwp(spark, sf_dir).select("lat_i", "lon_i").distinct()
    return cells.select("lat_i", "lon_i", *_grid_columns(F.col("lat_i"), F.col("lon_i")))


def grid(spark: SparkSession) -> DataFrame:
    """The same grid from its axes, without reading the cube."""
    cells = spark.range(GRID.n_cells).select(
        F.floor(F.col("id") / GRID.n_lon).cast("int").alias("lat_i"), (F.col("id") % GRID.n_lon).cast("int").alias("lon_i")
    )
    return cells.select("lat_i", "lon_i", *_grid_columns(F.col("lat_i"), F.col("lon_i")))


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        key.alias("stid"),
        (F.lit(31.0) + ((key * 37) % 601) / F.lit(100.0) + 0.5).alias("nlat"),
        (F.lit(-106.0) + ((key * 53) % 601) / F.lit(100.0) + 0.5).alias("elon"),
        (F.lit(100) + (key * 71) % 1201).cast("double").alias("elev"),
    )


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide feature rows per (station, day, hour, member)."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(
        F.col("l_suppkey").alias("stid"),
        F.col("l_shipdate").cast("date").alias("day"),
        (F.col("l_linenumber") - 1).alias("hour"),
        (F.col("l_partkey") % 11).alias("ens"),
    ).agg(
        F.avg("l_quantity").alias("qty"),
        F.avg("l_extendedprice").alias("price"),
        F.avg("l_discount").alias("disc"),
        F.avg("l_tax").alias("tax"),
    )


def _label() -> F.Column:
    return F.max(F.floor(F.col("o_totalprice") / 5000) * F.lit(50)).cast("double").alias("y")


def station_count(spark: SparkSession, sf_dir: str) -> int:
    """Stations are numbered from 1 to this."""
    return table(spark, sf_dir, "supplier").agg(F.max("s_suppkey")).first()[0] or 1


def _label_station(spark: SparkSession, sf_dir: str) -> F.Column:
    """One of the stations there are, for a customer."""
    return (F.lit(1) + F.col("o_custkey") % F.lit(station_count(spark, sf_dir))).alias("stid")


def _label_day(spark: SparkSession, sf_dir: str) -> F.Column:
    """One of the days of the cube, for an order."""
    last = table(spark, sf_dir, "embeddings").agg(F.max("vec_id")).first()[0] or 0
    return _day_after(F.col("o_orderkey") % F.lit(last // 20 + 1)).alias("day")


def energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels per (station, day)."""
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(_label_station(spark, sf_dir), F.col("o_orderdate").cast("date").alias("day")).agg(_label())


def energy_nwp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels on the days of the cube."""
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(_label_station(spark, sf_dir), _label_day(spark, sf_dir)).agg(_label())
