"""Solar geometry as Column expressions (angles in degrees, times in minutes).

Low-precision solar position series after Meeus. All functions take and return
Columns, so every quantity is computed inside generated JVM code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the series.
J2000 = 2451545.0
CENTURY_DAYS = 36525.0
GREGORIAN_START = 2299160.0
SUNRISE_ZENITH = 90.833
DAY_MINUTES = 1440.0


def _poly(t: Column, *coefficients: float) -> Column:
    """c0 + t*(c1 + t*(c2 + ...))."""
    total = F.lit(float(coefficients[-1]))
    for c in reversed(coefficients[:-1]):
        total = F.lit(float(c)) + t * total
    return total


def _sin(deg: Column) -> Column:
    return F.sin(F.radians(deg))


def _cos(deg: Column) -> Column:
    return F.cos(F.radians(deg))


def _tan(deg: Column) -> Column:
    return F.tan(F.radians(deg))


def julian_day(ts: Column) -> Column:
    """Julian day of a UTC timestamp or date."""
    shifted = F.month(ts) <= 2
    year = F.when(shifted, F.year(ts) - 1).otherwise(F.year(ts)).cast("double")
    month = F.when(shifted, F.month(ts) + 12).otherwise(F.month(ts)).cast("double")
    stamp = ts.cast("timestamp")
    seconds = F.unix_micros(stamp) - F.unix_micros(F.date_trunc("day", stamp))
    day = F.dayofmonth(ts) + seconds / 86400e6
    jd = (
        F.floor((year + 4716.0) * 365.25).cast("double")
        + F.floor((month + 1.0) * 30.6001).cast("double")
        + day
        - 1524.5
    )
    century = F.floor(year / 100.0).cast("double")
    correction = F.lit(2.0) - century + F.floor(century / 4.0).cast("double")
    return F.when(jd <= GREGORIAN_START, jd).otherwise(jd + correction)


def julian_century(jd: Column) -> Column:
    return (jd - J2000) / CENTURY_DAYS


def mean_longitude(t: Column) -> Column:
    return F.pmod(_poly(t, 280.46646, 36000.76983, 0.0003032), F.lit(360.0))


def mean_anomaly(t: Column) -> Column:
    return _poly(t, 357.52911, 35999.05029, -0.0001537)


def eccentricity(t: Column) -> Column:
    return _poly(t, 0.016708634, -0.000042037, -0.0000001267)


def equation_of_center(t: Column, m: Column) -> Column:
    return (
        _sin(m) * _poly(t, 1.914602, -0.004817, -0.000014)
        + _sin(m * 2.0) * _poly(t, 0.019993, -0.000101)
        + _sin(m * 3.0) * 0.000289
    )


def distance(m: Column, e: Column, center: Column) -> Column:
    """Earth-Sun distance in astronomical units; m + center is the true anomaly."""
    return (F.lit(1.0) - e * e) * 1.000001018 / (F.lit(1.0) + e * _cos(m + center))


def node_longitude(t: Column) -> Column:
    return _poly(t, 125.04, -1934.136)


def apparent_longitude(l0: Column, center: Column, node: Column) -> Column:
    """True longitude l0 + center, corrected for aberration and nutation."""
    return l0 + center - 0.00569 - _sin(node) * 0.00478


def mean_obliquity(t: Column) -> Column:
    arcsec = _poly(t, 21.448, -46.8150, -0.00059, 0.001813)
    return F.lit(23.0) + (F.lit(26.0) + arcsec / 60.0) / 60.0


def obliquity(t: Column, node: Column) -> Column:
    return mean_obliquity(t) + _cos(node) * 0.00256


def right_ascension(tilt: Column, lam: Column) -> Column:
    return F.degrees(F.atan2(_cos(tilt) * _sin(lam), _cos(lam)))


def declination(tilt: Column, lam: Column) -> Column:
    return F.degrees(F.asin(_sin(tilt) * _sin(lam)))


def equation_of_time(l0: Column, m: Column, e: Column, half_tilt_tan: Column) -> Column:
    y = half_tilt_tan * half_tilt_tan
    radians = (
        y * _sin(l0 * 2.0)
        - e * 2.0 * _sin(m)
        + e * 4.0 * y * _sin(m) * _cos(l0 * 2.0)
        - y * y * 0.5 * _sin(l0 * 4.0)
        - e * e * 1.25 * _sin(m * 2.0)
    )
    return F.degrees(radians * 4.0)


def half_tilt_tangent(tilt: Column) -> Column:
    return _tan(tilt / 2.0)


def sunrise_hour_angle(lat: Column, decl: Column) -> Column:
    """Hour angle of sunrise in degrees; NULL during polar day or night."""
    arg = F.cos(F.radians(F.lit(SUNRISE_ZENITH))) / (_cos(lat) * _cos(decl)) - _tan(lat) * _tan(decl)
    return F.when(F.abs(arg) <= 1.0, F.degrees(F.acos(arg)))


def solar_noon_utc(eqt: Column, lon: Column) -> Column:
    return F.lit(720.0) - lon * 4.0 - eqt


def rise_set_utc(eqt: Column, decl: Column, lat: Column, lon: Column) -> tuple[Column, Column]:
    half_arc = sunrise_hour_angle(lat, decl) * 4.0
    noon = solar_noon_utc(eqt, lon)
    return noon - half_arc, noon + half_arc


def zone_minutes(zone, dst=False) -> Column:
    """Offset of local clock time from UTC."""
    hours = zone if isinstance(zone, Column) else F.lit(float(zone))
    saving = dst if isinstance(dst, Column) else F.lit(bool(dst))
    return hours * 60.0 + F.when(saving, 60.0).otherwise(0.0)


def wrap_day(minutes: Column) -> Column:
    return F.pmod(minutes, F.lit(DAY_MINUTES))


def hour_angle(eqt: Column, local_minutes: Column, lon: Column, zone) -> Column:
    zone = zone if not isinstance(zone, (int, float)) else F.lit(float(zone))
    true_time = local_minutes + eqt + lon * 4.0 - zone * 60.0
    over = F.greatest(F.ceil(true_time / DAY_MINUTES - 1.0), F.lit(0)).cast("double")
    angle = (true_time - over * DAY_MINUTES) / 4.0 - 180.0
    return F.when(angle < -180.0, angle + 360.0).otherwise(angle)


def zenith(lat: Column, decl: Column, angle: Column) -> Column:
    """Geometric zenith angle."""
    cosine = _sin(lat) * _sin(decl) + _cos(lat) * _cos(decl) * _cos(angle)
    return F.degrees(F.acos(F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0))))


def azimuth(lat: Column, decl: Column, angle: Column, zen: Column) -> Column:
    denominator = _cos(lat) * _sin(zen)
    # the guarded divisor keeps ANSI division safe where the branch is not taken
    divisor = F.when(F.abs(denominator) > 0.001, denominator).otherwise(1.0)
    cosine = (_sin(lat) * _cos(zen) - _sin(decl)) / divisor
    swing = F.lit(180.0) - F.degrees(F.acos(F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0))))
    signed = F.when(angle > 0.0, -swing).otherwise(swing)
    at_pole = F.when(lat > 0.0, 180.0).otherwise(0.0)
    value = F.when(F.abs(denominator) > 0.001, signed).otherwise(at_pole)
    return F.when(value < 0.0, value + 360.0).otherwise(value)


def refraction(zen: Column) -> Column:
    """Atmospheric refraction in degrees at a geometric zenith angle."""
    elevation = F.lit(90.0) - zen
    raw = _tan(elevation)
    te = F.when(raw != 0.0, raw).otherwise(1.0)
    high = F.lit(58.1) / te - F.lit(0.07) / (te * te * te) + F.lit(0.000086) / (te * te * te * te * te)
    low = _poly(elevation, 1735.0, -518.2, 103.4, -12.79, 0.711)
    below = F.lit(-20.774) / te
    arcsec = F.when(elevation > 5.0, high).when(elevation > -0.575, low).otherwise(below)
    return F.when(elevation > 85.0, 0.0).otherwise(arcsec / 3600.0)


def apparent_zenith(zen: Column) -> Column:
    return zen - refraction(zen)
