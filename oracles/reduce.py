"""Oracles: aggregations, windows, samples, calendar and sun."""

from __future__ import annotations

import oracles.tables  # noqa: F401  (defines the shared expressions)
from oracles.base import define, drawn_rows, query, r

# ---------------------------------------------------------------- shared expressions

define(
    "member_intp",
    """SELECT n.day, n.fx, n.ens, n.hour, s.stid,
        sum(n.value * (1 - abs(s.nlat - (31 + n.lat_i))) * (1 - abs(s.elon - (n.lon_i - 106)))) AS value
        FROM nwp n JOIN stations s ON abs(s.nlat - (31 + n.lat_i)) < 1 AND abs(s.elon - (n.lon_i - 106)) < 1
        GROUP BY 1, 2, 3, 4, 5""",
    "nwp", "stations",
)
define(
    "intp",
    "SELECT day, fx, hour, stid, avg(value) AS value, stddev_pop(value) AS sigma FROM member_intp GROUP BY 1, 2, 3, 4",
    "member_intp",
)
define("obs_days", "SELECT day, row_number() OVER (ORDER BY day) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT day FROM obs)", "obs")
define("obs_cut", "SELECT day AS d FROM obs_days WHERE pos = floor(n * 0.5)", "obs_days")
define("obs_split", "SELECT *, CASE WHEN day >= (SELECT d FROM obs_cut) THEN 'test' ELSE 'train' END AS split FROM obs_daily", "obs_daily", "obs_cut")
define("folds", "SELECT day, CAST((row_number() OVER (ORDER BY md5(CAST(day AS VARCHAR) || '|0'), day) - 1) % 5 AS INTEGER) AS fold FROM (SELECT DISTINCT day FROM energy)", "energy")
define("label_days", "SELECT DISTINCT day FROM energy", "energy")

VALUES = ("qty", "price", "disc", "tax")


def _avg(names, suffix=""):
    return ", ".join(f"avg({n}) AS {n}{suffix}" for n in names)


def _round(names, digits=4, suffix=""):
    return ", ".join(f'{r(chr(34) + n + suffix + chr(34), digits)} AS "{n}{suffix}"' for n in names)


def cells(value: str, digits: int = 6) -> str:
    return ", ".join(
        f"{r(f'''max(CASE WHEN fx = 'f{f}' AND lat_i = {i} AND lon_i = {j} THEN {value} END)''', digits)} AS f{f}_{i}_{j}"
        for f in range(2) for i in range(8) for j in range(8)
    )


def two_step(first: str, second: str) -> str:
    return query(
        "nwp",
        f"""SELECT day, fx, lat_i, lon_i, {r(second + '(v)')} AS value FROM (SELECT day, fx, ens, lat_i, lon_i,
        {first}(value) AS v FROM nwp GROUP BY 1, 2, 3, 4, 5) GROUP BY 1, 2, 3, 4""",
    )


def history(keys: str, names, source: str, suffix: str = "") -> str:
    cols = [n + suffix for n in names]
    lagged = ", ".join(
        f"{r(f'''coalesce(lag({c}) OVER (PARTITION BY {keys} ORDER BY day), {c})''', 4)} AS \"{c}_t-1\"" for c in cols
    )
    own = ", ".join(f"{r(c, 4)} AS {c}" for c in cols)
    return f"SELECT {keys}, day, {own}, {lagged} FROM {source}"


# ---------------------------------------------------------------- sun


def wrap(x: str, period: float) -> str:
    return f"({x} - {period} * floor({x} / {period}))"


def sun_state(source: str, jd: str, prefix: str = "") -> str:
    """The source with t, distance, right ascension, declination and equation of time at a Julian day."""
    p = prefix
    return f"""SELECT * EXCLUDE ({p}l, {p}m, {p}e, {p}om, {p}ob, {p}lam, {p}c, {p}k),
      (1.000001018e0 * (1 - {p}e * {p}e)) / (1 + {p}e * cos(radians({p}m + {p}c))) AS {p}distance,
      degrees(atan2(cos(radians({p}ob)) * sin(radians({p}lam)), cos(radians({p}lam)))) AS {p}right_ascension,
      degrees(asin(sin(radians({p}ob)) * sin(radians({p}lam)))) AS {p}decl,
      degrees(4 * ({p}k * sin(2 * radians({p}l)) - 2 * {p}e * sin(radians({p}m))
        + 4 * {p}e * {p}k * sin(radians({p}m)) * cos(2 * radians({p}l))
        - {p}k * {p}k / 2 * sin(4 * radians({p}l)) - 1.25e0 * {p}e * {p}e * sin(2 * radians({p}m)))) AS {p}eqt
    FROM (SELECT *, tan(radians({p}ob / 2)) ** 2 AS {p}k,
        {p}l + {p}c - 0.00569e0 - 0.00478e0 * sin(radians({p}om)) AS {p}lam
      FROM (SELECT *, 125.04e0 - 1934.136e0 * {p}t AS {p}om,
          23 + 26 / 60e0 + (21.448e0 - 46.815e0 * {p}t - 0.00059e0 * {p}t ** 2 + 0.001813e0 * {p}t ** 3) / 3600
            + 0.00256e0 * cos(radians(125.04e0 - 1934.136e0 * {p}t)) AS {p}ob,
          (1.914602e0 - 0.004817e0 * {p}t - 0.000014e0 * {p}t ** 2) * sin(radians({p}m))
            + (0.019993e0 - 0.000101e0 * {p}t) * sin(2 * radians({p}m)) + 0.000289e0 * sin(3 * radians({p}m)) AS {p}c
        FROM (SELECT *, {wrap(f'(280.46646e0 + 36000.76983e0 * {p}t + 0.0003032e0 * {p}t ** 2)', 360)} AS {p}l,
            357.52911e0 + 35999.05029e0 * {p}t - 0.0001537e0 * {p}t ** 2 AS {p}m,
            0.016708634e0 - 0.000042037e0 * {p}t - 0.0000001267e0 * {p}t ** 2 AS {p}e
          FROM (SELECT *, ({jd} - 2451545) / 36525e0 AS {p}t FROM ({source})))))"""


MIDNIGHT_JD = "(datediff('day', DATE '1970-01-01', day) + 2440587.5e0)"


def hour_angle(lat: str, decl: str) -> str:
    return f"""degrees(acos(cos(radians(90.833e0)) / (cos(radians({lat})) * cos(radians({decl})))
        - tan(radians({lat})) * tan(radians({decl}))))"""


define("sun_days", sun_state(f"SELECT day, {MIDNIGHT_JD} AS jd FROM label_days", "jd"), "label_days")
define(
    "sun_pairs",
    f"""SELECT *, 720 - 4 * elon - eqt AS noon, 4 * {hour_angle('nlat', 'decl')} AS arc
        FROM sun_days CROSS JOIN (SELECT stid, nlat, elon FROM stations)""",
    "sun_days", "stations",
)


def local_time(event: str, at: str, sign: str) -> str:
    """Local time of an event, refined at its first estimate."""
    state = sun_state("SELECT day, stid, nlat, elon, jd AS jd0, noon AS noon0, arc AS arc0 FROM sun_pairs", f"(jd0 + ({at}) / 1440)")
    raw = f"(720 - 4 * elon - eqt {sign} - 360 + CASE WHEN month(day) BETWEEN 4 AND 10 THEN 60 ELSE 0 END)"
    value = raw if event == "noon" else wrap(raw, 1440)
    return f"SELECT day, stid, {value} AS {event}_local FROM ({state})"


ARC = f"4 * {hour_angle('nlat', 'decl')}"


def sun_position(source: str) -> str:
    """Azimuth and refracted zenith; the source has decl, eqt, nlat, elon, minutes and zone."""
    return f"""SELECT *, CASE WHEN abs(den) > 0.001 THEN
        CASE WHEN (CASE WHEN ha > 0 THEN -sw ELSE sw END) < 0 THEN 360 - sw ELSE sw END
        ELSE CASE WHEN nlat > 0 THEN 180 ELSE 0 END END AS azimuth,
      zen - CASE WHEN el > 85 THEN 0 WHEN el > 5 THEN (58.1e0 / te - 0.07e0 / te ** 3 + 0.000086e0 / te ** 5) / 3600
        WHEN el > -0.575 THEN (1735 - 518.2e0 * el + 103.4e0 * el ** 2 - 12.79e0 * el ** 3 + 0.711e0 * el ** 4) / 3600
        ELSE -20.774e0 / te / 3600 END AS zenith
    FROM (SELECT *, tan(radians(90 - zen)) AS te, 90 - zen AS el,
        180 - degrees(acos(least(greatest((sin(radians(nlat)) * cos(radians(zen)) - sin(radians(decl)))
          / CASE WHEN abs(den) > 0.001 THEN den ELSE 1 END, -1), 1))) AS sw
      FROM (SELECT *, cos(radians(nlat)) * sin(radians(zen)) AS den
        FROM (SELECT *, degrees(acos(least(greatest(sin(radians(nlat)) * sin(radians(decl))
            + cos(radians(nlat)) * cos(radians(decl)) * cos(radians(ha)), -1), 1))) AS zen
          FROM (SELECT *, CASE WHEN h0 < -180 THEN h0 + 360 ELSE h0 END AS ha
            FROM (SELECT *, CASE WHEN tst > 1440 THEN tst - 1440 * ceil(tst / 1440 - 1) ELSE tst END / 4 - 180 AS h0
              FROM (SELECT *, minutes + eqt + 4 * elon - 60 * zone AS tst FROM ({source})))))))"""


define(
    "raster",
    sun_position(
        """SELECT d.day, a.i AS ilat, b.i AS ilon, -66 + a.i * (132 / 49e0) AS nlat, -180 + b.i * (360 / 49e0) AS elon,
        d.decl, d.eqt, 0e0 AS minutes, 0 AS zone FROM ("""
        + sun_state(f"SELECT day, {MIDNIGHT_JD} AS jd FROM (SELECT DISTINCT day FROM nwp)", "jd")
        + """) d CROSS JOIN (SELECT unnest(generate_series(0, 49)) AS i) a CROSS JOIN (SELECT unnest(generate_series(0, 49)) AS i) b"""
    ),
    "nwp",
)

_PRED = "SELECT day, stid, {} AS pred FROM (SELECT day, stid, {} AS k, avg(price) AS p FROM obs GROUP BY 1, 2, 3) GROUP BY 1, 2"


def mean_over(key: str) -> str:
    return query("obs", _PRED.format(r("avg(p)", 5), key))


SCORES = """SELECT '{0}' AS samples, count(*) AS n, {1} AS mae, {2} AS rmse, {3} AS r2 FROM pairs {4}"""


def score_row(name: str, where: str = "") -> str:
    return SCORES.format(
        name, r("avg(abs(y - pred))"), r("sqrt(avg((y - pred) * (y - pred)))"),
        r("1 - sum((y - pred) * (y - pred)) / (count(*) * var_pop(y))"), where,
    )


SQL = {
    "ens_mean": query("nwp", f"SELECT day, fx, hour, lat_i, lon_i, {r('avg(value)')} AS value FROM nwp GROUP BY 1, 2, 3, 4, 5"),
    "ens_std": query("nwp", f"SELECT day, fx, hour, lat_i, lon_i, {r('stddev_pop(value)')} AS value FROM nwp GROUP BY 1, 2, 3, 4, 5"),
    "hour_mean": query("nwp", f"SELECT day, fx, ens, lat_i, lon_i, {r('avg(value)')} AS value FROM nwp GROUP BY 1, 2, 3, 4, 5"),
    "hour_std": query("nwp", f"SELECT day, fx, ens, lat_i, lon_i, {r('stddev_pop(value)')} AS value FROM nwp GROUP BY 1, 2, 3, 4, 5"),
    "baseline_grid_mean": query(
        "nwp",
        f"""SELECT day, {cells('v')} FROM (SELECT day, fx, lat_i, lon_i, avg(m) AS v FROM (SELECT day, fx, hour, lat_i, lon_i,
        avg(value) AS m FROM nwp GROUP BY 1, 2, 3, 4, 5) GROUP BY 1, 2, 3, 4) GROUP BY day""",
    ),
    "ens_mean_of_hour_mean": two_step("avg", "avg"),
    "ens_std_of_hour_mean": two_step("avg", "stddev_pop"),
    "ens_mean_of_hour_std": two_step("stddev_pop", "avg"),
    "ens_std_of_hour_std": two_step("stddev_pop", "stddev_pop"),
    "intp_ens_mean_std": query("intp", f"SELECT day, fx, hour, stid, {r('value')} AS value, {r('sigma')} AS sigma FROM intp"),
    "daily_mean_features": query(
        "intp",
        f"""SELECT day, stid, {r("avg(CASE WHEN fx = 'f0' THEN value END)")} AS nm_intp_f0_m,
        {r("avg(CASE WHEN fx = 'f1' THEN value END)")} AS nm_intp_f1_m FROM intp GROUP BY 1, 2""",
    ),
    "climatology": query(
        "energy", f"SELECT CAST(month(day) AS INTEGER) AS month, stid, {r('avg(y)')} AS climate FROM energy GROUP BY 1, 2"
    ),
    "ens_mean_predictions": mean_over("ens"),
    "corner_mean_predictions": query(
        "cell_mean placed",
        f"""SELECT day, stid, {r('avg(p)')} AS pred FROM (SELECT m.day, p.stid, m.lat_i, m.lon_i, avg(m.value) AS p
        FROM cell_mean m JOIN placed p ON m.lat_i IN (p.li, p.li - 1) AND m.lon_i IN (p.lj, p.lj - 1)
        GROUP BY 1, 2, 3, 4) GROUP BY 1, 2""",
    ),
    "seed_blend": mean_over("ens % 3"),
    "metrics_mae_rmse_r2": query("pairs", score_row("all") + " UNION ALL " + score_row("unmasked", "WHERE NOT is_masked")),
    "mae_daily": query("res", f"SELECT day, {r('avg(abs(residual))')} AS mae FROM res GROUP BY 1"),
    "ae_by_doy": query(
        "res",
        f"""SELECT CAST(dayofyear(day) AS INTEGER) AS doy, {r('avg(ae)')} AS ae FROM
        (SELECT day, coalesce(sum(abs(residual)), 0) AS ae FROM res GROUP BY 1) GROUP BY 1""",
    ),
    "ae_by_month": query(
        "res",
        f"""SELECT CAST(month(day) AS INTEGER) AS month, {r('avg(ae)')} AS ae FROM
        (SELECT day, coalesce(sum(abs(residual)), 0) AS ae FROM res GROUP BY 1) GROUP BY 1""",
    ),
    "mae_by_station": query("res", f"SELECT stid, {r('avg(abs(residual))')} AS mae FROM res GROUP BY 1"),
    "mae_over_under": query(
        "pairs",
        f"""SELECT {r('avg(CASE WHEN pred > y THEN pred - y END)')} AS upper_mae,
        {r('avg(CASE WHEN pred <= y THEN y - pred END)')} AS lower_mae FROM pairs""",
    ),
    "residual_table": query("res", f"SELECT day, stid, {r('residual', 4)} AS residual FROM res"),
    "mask_stats": query("marked", "SELECT count(*) AS n, count(*) FILTER (WHERE is_masked) AS n_masked FROM marked"),
    "feature_standardise": query(
        "obs_split",
        "SELECT stid, day, "
        + ", ".join(
            f"{r(f'''({v} - (SELECT avg({v}) FROM obs_split WHERE split = 'train')) / (SELECT stddev_pop({v}) FROM obs_split WHERE split = 'train')''', 5)} AS {v}"
            for v in VALUES
        )
        + ", split FROM obs_split",
    ),
    "label_standardise": query(
        "split_energy",
        f"""SELECT kind, stid, day, {r('v', 4)} AS y FROM (SELECT stid, day, y, y - avg(y) OVER w AS c,
        (y - avg(y) OVER w) / CASE WHEN stddev_pop(y) OVER w = 0 THEN 1 ELSE stddev_pop(y) OVER w END AS s
        FROM split_energy WHERE split = 'train' WINDOW w AS (PARTITION BY stid)),
        LATERAL (SELECT unnest(['centred', 'scaled', 'restored']) AS kind, unnest([c, s, y]) AS v)""",
    ),
    "value_histogram": query(
        "nwp",
        f"""SELECT CAST(b.i AS INTEGER) AS bin, {r('any_value(lo) + b.i * any_value(w)')} AS left_edge, count(v) AS n
        FROM (SELECT unnest(generate_series(0, 49)) AS i) b
        CROSS JOIN (SELECT min(v) AS lo, (max(v) - min(v)) / 50 AS w FROM (SELECT avg(value) AS v FROM nwp WHERE fx = 'f0' GROUP BY day)) s
        LEFT JOIN (SELECT avg(value) AS v FROM nwp WHERE fx = 'f0' GROUP BY day) d
        ON least(floor((d.v - s.lo) / s.w), 49) = b.i GROUP BY b.i""",
    ),
    "clean_missing_labels": query("marked", "SELECT stid, day, y, is_masked FROM marked"),
    "history_features": query(
        "obs", history("stid, hour", VALUES, f"(SELECT stid, hour, day, {_avg(VALUES)} FROM obs GROUP BY 1, 2, 3)")
    ),
    "mean_history_features": query(
        "obs", history("stid", VALUES, f"(SELECT stid, day, {_avg(VALUES, '_m')} FROM obs GROUP BY 1, 2)", "_m")
    ),
    "time_split": query("split_energy", "SELECT stid, day, y, split FROM split_energy"),
    "kfold_assign": query("folds", "SELECT day, fold FROM folds"),
    "worst_k_stations": query(
        "res",
        f"""SELECT day, stid, {r('residual', 4)} AS residual FROM res WHERE stid IN
        (SELECT stid FROM res GROUP BY 1 ORDER BY avg(abs(residual)) DESC NULLS LAST, stid LIMIT 10)""",
    ),
    "learning_curve_sample": query(
        "energy",
        "SELECT CAST(i AS INTEGER) AS size_no, CAST(j AS INTEGER) AS rep, size AS n_samples, stid, day, y FROM ("
        + drawn_rows("SELECT * FROM energy", "stid, day, y", 10, 10)
        + ")",
    ),
    "subsample_rows": query(
        "obs",
        f"""SELECT stid, day, hour, ens, {_round(VALUES)} FROM (SELECT *, row_number() OVER
        (ORDER BY md5(concat_ws('|', stid, day, hour, ens, 1)), stid, day, hour, ens) AS k FROM obs) WHERE k <= 100000""",
    ),
    "stack_train_test": query("obs_split", f"SELECT stid, day, {_round(VALUES)}, split FROM obs_split"),
    "ensemble_examples": query(
        "nwp",
        f"""SELECT day, ens, {cells('v')}, abs(CAST(dayofyear(day) AS DOUBLE) - 182.625e0) AS center FROM
        (SELECT day, fx, ens, lat_i, lon_i, avg(value) AS v FROM nwp GROUP BY 1, 2, 3, 4, 5) GROUP BY day, ens""",
    ),
    "ensemble_labels": query(
        "nwp energy_nwp", "SELECT day, ens, stid, y FROM (SELECT DISTINCT day, ens FROM nwp) JOIN energy_nwp USING (day)"
    ),
    "oof_predictions": query(
        "energy folds",
        f"""SELECT a.day, a.stid, a.fold, a.y, {r('avg(b.y)')} AS pred FROM (SELECT e.*, fold FROM energy e JOIN folds USING (day)) a
        LEFT JOIN (SELECT e.*, fold FROM energy e JOIN folds USING (day)) b
        ON b.stid = a.stid AND month(b.day) = month(a.day) AND b.fold <> a.fold GROUP BY 1, 2, 3, 4""",
    ),
    "date_doy": query("energy", "SELECT stid, day, CAST(day - date_trunc('year', day)::DATE + 1 AS INTEGER) AS doy FROM energy"),
    "date_center": query("energy", "SELECT stid, day, abs(CAST(dayofyear(day) AS DOUBLE) - 182.625e0) AS center FROM energy"),
    "date_month_onehot": query(
        "split_energy",
        "SELECT stid, day, "
        + ", ".join(
            f"CAST(CASE WHEN month(day) = {m} AND {m} IN (SELECT month(day) FROM split_energy WHERE split = 'train') THEN 1 ELSE 0 END AS DOUBLE) AS m{m}"
            for m in range(1, 13)
        )
        + " FROM split_energy WHERE split = 'test'",
    ),
    "date_year": query("energy", "SELECT stid, day, CAST(year(day) AS DOUBLE) AS year FROM energy"),
    "station_onehot": query(
        "station_places", "SELECT stid, block, " + ", ".join(f"CAST(place = {s} AS DOUBLE) AS s{s}" for s in range(1, 99)) + " FROM station_places"
    ),
    "cell_position": query(
        "placed axis_lat axis_lon",
        f"""SELECT p.stid, {r('p.nlat - a.v')} AS rel_lat, {r('p.elon - b.v')} AS rel_lon, CAST(p.li AS INTEGER) AS lat_idx,
        CAST(p.lj AS INTEGER) AS lon_idx FROM placed p LEFT JOIN axis_lat a ON a.i = p.li LEFT JOIN axis_lon b ON b.i = p.lj""",
    ),
    "julian_day": f"SELECT event_id, {r('epoch_us(ts) / 86400000000e0 + 2440587.5e0', 3)} AS jd FROM events",
    "sun_distance": query("sun_days", f"SELECT day, {r('distance')} AS distance FROM sun_days"),
    "sun_right_ascension": query("sun_days", f"SELECT day, {r('right_ascension')} AS right_ascension FROM sun_days"),
    "sun_declination": query("sun_days", f"SELECT day, {r('decl')} AS decl FROM sun_days"),
    "equation_of_time": query("sun_days", f"SELECT day, {r('eqt')} AS eqt FROM sun_days"),
    "sunrise_sunset_utc": query(
        "sun_pairs", f"SELECT day, stid, {r('noon - arc', 4)} AS sunrise, {r('noon + arc', 4)} AS sunset FROM sun_pairs"
    ),
    "day_length": query("sun_pairs", f"SELECT day, stid, {r('2 * arc', 4)} AS day_length FROM sun_pairs"),
    "solar_noon_utc": query("sun_pairs", f"SELECT day, stid, {r('noon', 4)} AS noon FROM sun_pairs"),
    "solar_noon_local": query(
        "sun_pairs", f"SELECT day, stid, {r('noon_local', 4)} AS noon_local FROM ({local_time('noon', 'noon0', '')})"
    ),
    "sunrise_sunset_local": query(
        "sun_pairs",
        f"""SELECT a.day, a.stid, {r('sunrise_local', 4)} AS sunrise_local, {r('sunset_local', 4)} AS sunset_local
        FROM ({local_time('sunrise', 'noon0 - arc0', '- ' + ARC)}) a JOIN ({local_time('sunset', 'noon0 + arc0', '+ ' + ARC)}) b
        ON a.day = b.day AND a.stid = b.stid""",
    ),
    "solar_azimuth_zenith": query(
        "obs stations",
        f"""SELECT stid, day, hour, {r('azimuth', 4)} AS azimuth, {r('zenith', 4)} AS zenith FROM ("""
        + sun_position(
            "SELECT *, CAST(360 + hour * 120 AS DOUBLE) AS minutes, -6 AS zone FROM ("
            + sun_state(
                f"SELECT o.*, nlat, elon, {MIDNIGHT_JD} AS jd FROM (SELECT DISTINCT stid, day, hour FROM obs) o JOIN stations USING (stid)",
                "jd",
            )
            + ")"
        )
        + ")",
    ),
    "terminator_grid": query(
        "raster",
        f"""SELECT day, CAST(ilat AS INTEGER) AS ilat, CAST(ilon AS INTEGER) AS ilon, {r('nlat', 4)} AS lat, {r('elon', 4)} AS lon,
        {r('zenith', 4)} AS zenith FROM raster""",
    ),
    "terminator_line": query(
        "raster",
        f"""SELECT day, {r('nlat', 4)} AS lat, CASE WHEN next_zenith > zenith THEN 'falling' ELSE 'rising' END AS side,
        {r('elon + (90 - zenith) / (next_zenith - zenith) * (next_elon - elon)', 4)} AS lon
        FROM (SELECT *, lead(zenith) OVER w AS next_zenith, lead(elon) OVER w AS next_elon FROM raster WINDOW w AS (PARTITION BY day, ilat ORDER BY ilon))
        WHERE (90 - zenith) * (90 - next_zenith) <= 0 AND zenith <> next_zenith""",
    ),
}
