"""Readers and writers of the forecast, label, station and grid tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heliogrid.operators.joins import bounded_rows, union_all
from heliogrid.session import settled

# The fifteen forecast features.
FORECAST_FEATURES = (
    "dswrf_sfc", "dlwrf_sfc", "uswrf_sfc", "ulwrf_sfc", "ulwrf_tatm", "pwat_eatm",
    "tcdc_eatm", "apcp_sfc", "pres_msl", "spfh_2m", "tcolc_eatm", "tmax_2m",
    "tmin_2m", "tmp_2m", "tmp_sfc",
)

CUBE_COLUMNS = ("day", "ens", "hour", "lat_i", "lon_i")


def load_cube(spark: SparkSession, directory: str, features=FORECAST_FEATURES, suffix: str = "") -> DataFrame:
    """Stacks one Parquet table per feature, ``<directory>/<feature><suffix>``, into a long cube.

    A filter on ``fx`` prunes whole tables, since each branch holds one constant.
    """
    return stack_features({fx: spark.read.parquet(f"{directory}/{fx}{suffix}") for fx in features})


def stack_features(tables: dict[str, DataFrame]) -> DataFrame:
    parts = []
    for fx, table in tables.items():
        value = F.col("value").cast("double")
        parts.append(
            table.select(
                F.col("day").cast("date").alias("day"),
                F.lit(fx).alias("fx"),
                *[F.col(c).cast("int").alias(c) for c in CUBE_COLUMNS[1:]],
                F.when(~F.isnan(value), value).alias("value"),
            )
        )
    return union_all(parts)


def unpivot_labels(wide: DataFrame, date: str, label: str = "y") -> DataFrame:
    """One row per (day, station) from a table with one column per station; NaN is missing."""
    stations = [c for c in wide.columns if c != date]
    day = F.to_date(F.col(f"`{date}`").cast("string"), "yyyyMMdd")
    long = wide.select(day.alias("day"), *[F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)).alias(c) for c in stations])
    return long.unpivot("day", stations, "station", label)


def read_label_csv(spark: SparkSession, path: str) -> DataFrame:
    """Label file: a header, the date as yyyymmdd, then one column per station."""
    wide = spark.read.option("header", True).csv(path)
    return unpivot_labels(wide, wide.columns[0])


def read_label_blocks(spark: SparkSession, path: str, width: int, prefix: str = "s") -> DataFrame:
    """(day, block, place, y) from label files in rows of ``width`` stations: a header, Date as yyyymmdd, block, s1, s2, ..."""
    wide = spark.read.option("header", True).csv(path)
    names = [f"{prefix}{i + 1}" for i in range(width)]
    values = F.array(*[F.nanvl(F.col(f"`{n}`").cast("double"), F.lit(None)) for n in names])
    return wide.select(F.to_date("Date", "yyyyMMdd").alias("day"), F.col("block").cast("bigint").alias("block"), F.posexplode(values).alias("place", "y"))


STATION_SCHEMA = "stid string, nlat double, elon double, elev double"


def read_station_csv(spark: SparkSession, path: str) -> DataFrame:
    """Station file with dense station numbers in file-id order."""
    return number_stations(spark.read.option("header", True).schema(STATION_SCHEMA).csv(path))


def number_stations(stations: DataFrame) -> DataFrame:
    """Dense 0-based numbers by station id."""
    return numbered_rows(stations, "stid", "_number").select(
        F.col("stid").alias("station"), F.col("_number").alias("stid"), "nlat", "elon", "elev"
    )


def numbered_rows(stations: DataFrame, key: str, name: str) -> DataFrame:
    """Adds dense 0-based numbers in the order of a key.

    The rows are sorted in range partitions and written once; a number is the rows in
    earlier partitions plus the position in its own.
    """
    ordered = settled(stations.orderBy(key).withColumn("_id", F.monotonically_increasing_id()))
    ordered = ordered.withColumns({"_part": F.shiftright("_id", 33), "_pos": F.col("_id").bitwiseAND(F.lit(2**33 - 1))})
    sizes = ordered.groupBy("_part").agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    placed = ordered.join(starts, "_part").withColumn(name, (F.col("_start") + F.col("_pos")).cast("bigint"))
    return placed.select(*stations.columns, name)


def grid_table(cells: DataFrame) -> DataFrame:
    """(lat_i, lon_i, lat, lon, elev), longitudes moved to -180..180."""
    lon = F.when(F.col("lon") > 180.0, F.col("lon") - 360.0).otherwise(F.col("lon"))
    return cells.select("lat_i", "lon_i", F.col("lat").cast("double"), lon.alias("lon"), F.col("elev").cast("double"))


def submission(pred: DataFrame, station_ids, names=None) -> DataFrame:
    """Wide table: Date as yyyymmdd and one column per station, in the given order."""
    ids = list(station_ids)
    wide = pred.groupBy("day").pivot("stid", ids).agg(F.first("pred", ignorenulls=True))
    titles = dict(zip(ids, names or [str(i) for i in ids]))
    return wide.select(
        F.date_format("day", "yyyyMMdd").alias("Date"), *[F.col(f"`{i}`").alias(titles[i]) for i in ids]
    )


def station_places(stations: DataFrame, width: int) -> DataFrame:
    """(stid, block, place): the station table's ids, dealt in their order to blocks of ``width`` columns."""
    numbers = numbered_rows(stations.select("stid").distinct(), "stid", "_n")
    return numbers.select("stid", F.floor(F.col("_n") / width).cast("bigint").alias("block"), (F.col("_n") % width).cast("int").alias("place"))


def submission_blocks(pred: DataFrame, places: DataFrame, width: int, prefix: str = "s") -> DataFrame:
    """Wide rows of any number of stations: Date, block and the block's ``width`` stations as columns s1, s2, ...

    ``places`` is that of ``station_places``; a place without a station or prediction is NULL.
    """
    placed = pred.join(places, "stid")
    wide = placed.groupBy("day", "block").pivot("place", list(range(width))).agg(F.first("pred", ignorenulls=True))
    return wide_blocks(wide, [F.col(f"`{i}`") for i in range(width)], prefix)


def wide_blocks(df: DataFrame, columns: list, prefix: str = "s") -> DataFrame:
    """Date, block, and the given columns named s1, s2, ..."""
    return df.select(F.date_format("day", "yyyyMMdd").alias("Date"), "block", *[c.alias(f"{prefix}{i + 1}") for i, c in enumerate(columns)])


def write_submission(pred: DataFrame, stations: DataFrame, path: str, max_stations: int = 10_000) -> None:
    """Writes the wide CSV with the station names of the station table as header.

    More than ``max_stations`` stations are written as several files of that many columns each, in folders block=0, block=1, ...
    """
    names = stations.select("stid", "station" if "station" in stations.columns else F.col("stid").alias("station")).distinct()
    rows = bounded_rows(names, max_stations)
    if rows is not None:
        _write_wide(pred, rows, path)
        return
    places = settled(station_places(stations, max_stations).join(names, "stid"))
    placed = settled(pred.join(places.select("stid", "block"), "stid"))
    for block in range(places.agg(F.max("block")).first()[0] + 1):
        of_block = F.col("block") == block
        _write_wide(placed.where(of_block), places.where(of_block).collect(), f"{path}/block={block}")  # max_stations rows


def _write_wide(pred: DataFrame, rows, path: str) -> None:
    rows = sorted(rows, key=lambda r: r["stid"])
    wide = submission(pred, [r["stid"] for r in rows], [str(r["station"]) for r in rows])
    wide.repartitionByRange("Date").sortWithinPartitions("Date").write.mode("error").option("header", True).csv(path)


def write_tables(tables: dict[str, DataFrame], path: str, description: str = "") -> None:
    """Each table as Parquet under ``path``; those with a ``split`` column partitioned by it."""
    for name, table in tables.items():
        writer = table.withMetadata(table.columns[0], {"description": description}).write.mode("error")
        if "split" in table.columns:
            writer = writer.partitionBy("split")
        writer.parquet(f"{path}/{name}")


def read_tables(spark: SparkSession, path: str, names) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}
