"""Solar tables: one row per date, per (date, station) or per raster point.

Quantities that depend on the date alone are computed once per date, before dates
meet stations. Each stage adds plain columns, so expressions stay small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliogrid.functions import solar
from heliogrid.operators.joins import dealt, pair_up

TERMINATOR_POINTS = 50


def with_sun_state(df: DataFrame, jd: str = "jd", prefix: str = "") -> DataFrame:
    """Adds distance, right ascension, declination and the equation of time at a Julian day.

    One projection per level of the series: each works on finished columns, so the
    generated code stays short. Quantities that are not used are pruned.
    """
    c = F.col
    staged = (
        df.withColumn("_t", solar.julian_century(c(jd)))
        .withColumns(
            {
                "_l0": solar.mean_longitude(c("_t")),
                "_m": solar.mean_anomaly(c("_t")),
                "_e": solar.eccentricity(c("_t")),
                "_node": solar.node_longitude(c("_t")),
            }
        )
        .withColumns(
            {"_c": solar.equation_of_center(c("_t"), c("_m")), "_tilt": solar.obliquity(c("_t"), c("_node"))}
        )
        .withColumns(
            {
                "_lam": solar.apparent_longitude(c("_l0"), c("_c"), c("_node")),
                "_half": solar.half_tilt_tangent(c("_tilt")),
            }
        )
    )
    quantities = {
        "distance": solar.distance(c("_m"), c("_e"), c("_c")),
        "right_ascension": solar.right_ascension(c("_tilt"), c("_lam")),
        "decl": solar.declination(c("_tilt"), c("_lam")),
        "eqt": solar.equation_of_time(c("_l0"), c("_m"), c("_e"), c("_half")),
    }
    return staged.select(*df.columns, *[q.alias(f"{prefix}{n}") for n, q in quantities.items()])


def day_sun(days: DataFrame, stamp: str = "day") -> DataFrame:
    """Julian day and the solar quantities of each date."""
    return with_sun_state(days.withColumn("jd", solar.julian_day(F.col(stamp))))


def days_by_stations(days: DataFrame, stations: DataFrame) -> DataFrame:
    """Every day with every station: the design rows of the station models."""
    return pair_up(days, stations, spread_left=True)


def sunrise_sunset(days: DataFrame, stations: DataFrame) -> DataFrame:
    """UTC minutes of sunrise, sunset, solar noon, and day length per (day, station)."""
    pairs = days_by_stations(day_sun(days), stations.select("stid", "nlat", "elon"))
    return with_rise_set(pairs)


def with_rise_set(pairs: DataFrame) -> DataFrame:
    """Adds rise and set columns to rows holding eqt, decl, nlat and elon."""
    arc = solar.sunrise_hour_angle(F.col("nlat"), F.col("decl"))
    staged = pairs.withColumns({"_arc": arc, "noon": solar.solar_noon_utc(F.col("eqt"), F.col("elon"))})
    half = F.col("_arc") * 4.0
    return staged.withColumns(
        {"sunrise": F.col("noon") - half, "sunset": F.col("noon") + half, "day_length": half * 2.0}
    ).drop("_arc")


def local_sun_times(days: DataFrame, stations: DataFrame, zone: float, dst=False) -> DataFrame:
    """Local noon, sunrise and sunset, refined once at their first estimates."""
    first = sunrise_sunset(days, stations)
    shift = solar.zone_minutes(zone, dst)
    staged = first
    for event in ("noon", "sunrise", "sunset"):
        at = F.col("jd") + F.col(event) / solar.DAY_MINUTES
        staged = with_sun_state(staged.withColumn("_jd", at), "_jd", f"{event}_")
        staged = staged.withColumn(
            f"{event}_angle", solar.sunrise_hour_angle(F.col("nlat"), F.col(f"{event}_decl")) * 4.0
        )
    noon = solar.solar_noon_utc(F.col("noon_eqt"), F.col("elon")) + shift
    rise = solar.solar_noon_utc(F.col("sunrise_eqt"), F.col("elon")) - F.col("sunrise_angle") + shift
    sunset = solar.solar_noon_utc(F.col("sunset_eqt"), F.col("elon")) + F.col("sunset_angle") + shift
    return staged.select(
        "day",
        "stid",
        noon.alias("noon_local"),
        solar.wrap_day(rise).alias("sunrise_local"),
        solar.wrap_day(sunset).alias("sunset_local"),
    )


def with_sun_position(df: DataFrame, minutes: Column, lat: Column, lon: Column, zone=0.0) -> DataFrame:
    """Adds azimuth and refraction-corrected zenith to rows holding eqt and decl."""
    staged = df.withColumn("_angle", solar.hour_angle(F.col("eqt"), minutes, lon, zone))
    staged = staged.withColumn("_zen", solar.zenith(lat, F.col("decl"), F.col("_angle")))
    staged = staged.withColumns(
        {
            "azimuth": solar.azimuth(lat, F.col("decl"), F.col("_angle"), F.col("_zen")),
            "zenith": solar.apparent_zenith(F.col("_zen")),
        }
    )
    return staged.drop("_angle", "_zen")


def terminator_raster(days: DataFrame, lats: tuple, lons: tuple, points: int = TERMINATOR_POINTS, stamp: str = "day", before: bool = False) -> DataFrame:
    """Zenith angle on a points x points raster at every date; ``before`` adds lon0 and zenith0, those of the point before in its row."""
    last = points - 1
    place = lambda span, i: F.lit(float(span[0])) + i * ((span[1] - span[0]) / last)
    few_rows = dealt(days, [stamp])
    raster = (
        day_sun(few_rows, stamp)
        .withColumn("ilat", F.explode(F.sequence(F.lit(0), F.lit(last))))
        .withColumn("ilon", F.explode(F.sequence(F.lit(0), F.lit(last))))
        .withColumns({"lat": place(lats, F.col("ilat")), "lon": place(lons, F.col("ilon"))})
    )
    # minutes since midnight UTC of the Julian day
    ut = (F.col("jd") - (F.floor(F.col("jd") - 0.5) + 0.5)) * solar.DAY_MINUTES
    staged = raster.withColumn("_ut", ut)
    placed = with_sun_position(staged, F.col("_ut"), F.col("lat"), F.col("lon"))
    if not before:
        return placed.select(stamp, "ilat", "ilon", "lat", "lon", "zenith")
    placed = placed.withColumnRenamed("zenith", "_zenith").withColumn("lon0", F.when(F.col("ilon") > 0, place(lons, F.col("ilon") - 1)))
    both = with_sun_position(placed.drop("azimuth"), F.col("_ut"), F.col("lat"), F.col("lon0"))
    return both.select(stamp, "ilat", "ilon", "lat", "lon", F.col("_zenith").alias("zenith"), "lon0", F.when(F.col("ilon") > 0, F.col("zenith")).alias("zenith0"))


def terminator(raster: DataFrame, stamp: str = "day") -> DataFrame:
    """Longitudes per latitude where the sun crosses the horizon, falling and rising.

    A raster row holds a fixed number of points, so the window per (date, latitude)
    is small; a raster that names the point before needs none, and sorts nothing. The
    crossing is interpolated linearly between its two neighbours.
    """
    row = Window.partitionBy(stamp, "ilat").orderBy("ilon")
    elevation = F.lit(90.0) - F.col("zenith")
    pairs = raster.withColumns({"a": elevation})
    if "zenith0" in raster.columns:
        pairs = pairs.withColumn("a0", F.lit(90.0) - F.col("zenith0"))
    else:
        pairs = pairs.withColumns({"a0": F.lag("a").over(row), "lon0": F.lag("lon").over(row)})
    crossing = pairs.where((F.col("a0") * F.col("a") <= 0) & (F.col("a0") != F.col("a")))
    share = F.col("a0") / (F.col("a0") - F.col("a"))
    return crossing.select(
        stamp,
        "lat",
        F.when(F.col("a") < F.col("a0"), "falling").otherwise("rising").alias("side"),
        (F.col("lon0") + share * (F.col("lon") - F.col("lon0"))).alias("lon"),
    )
