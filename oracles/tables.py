"""Oracles: sources, sinks, blocks and joins."""

from __future__ import annotations

from oracles.base import define, query, r

define("axis_lat", "SELECT unnest(generate_series(0, 7)) AS i, CAST(31 + unnest(generate_series(0, 7)) AS DOUBLE) AS v")
define("axis_lon", "SELECT unnest(generate_series(0, 7)) AS i, CAST(unnest(generate_series(0, 7)) - 106 AS DOUBLE) AS v")
define(
    "placed",
    """SELECT s.*, (SELECT count(*) FROM axis_lat a WHERE a.v < s.nlat) AS li,
        (SELECT count(*) FROM axis_lon a WHERE a.v < s.elon) AS lj FROM stations s""",
    "stations", "axis_lat", "axis_lon",
)
define(
    "energy_days",
    "SELECT day, row_number() OVER (ORDER BY day) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT day FROM energy)",
    "energy",
)
define("cut", "SELECT day AS d FROM energy_days WHERE pos = floor(n * 0.5)", "energy_days")
define(
    "split_energy",
    "SELECT e.*, CASE WHEN day >= (SELECT d FROM cut) THEN 'test' ELSE 'train' END AS split FROM energy e",
    "energy", "cut",
)
define(
    "marked",
    """SELECT stid, day, y, (y IS NULL OR coalesce(y = before, FALSE) OR y - 100 * floor(y / 100) <> 0) AS is_masked
        FROM (SELECT *, lag(y) OVER (PARTITION BY stid ORDER BY day) AS before FROM energy)""",
    "energy",
)
define(
    "pairs",
    """SELECT m.*, avg(m.y) OVER (PARTITION BY month(m.day), m.stid) AS pred FROM marked m""",
    "marked",
)
define("res", "SELECT day, stid, CASE WHEN NOT is_masked THEN y - pred END AS residual FROM pairs", "pairs")
define(
    "obs_daily",
    "SELECT stid, day, avg(qty) AS qty, avg(price) AS price, avg(disc) AS disc, avg(tax) AS tax FROM obs GROUP BY 1, 2",
    "obs",
)
define(
    "cell_mean",
    """SELECT day, fx, lat_i, lon_i, avg(v) AS value FROM
        (SELECT day, fx, ens, lat_i, lon_i, avg(value) AS v FROM nwp GROUP BY 1, 2, 3, 4, 5) GROUP BY 1, 2, 3, 4""",
    "nwp",
)

SENTINEL = "CAST(1000000000000000 AS DOUBLE)"


def ratio(a: str, b: str) -> str:
    return f"(CASE WHEN {a} = 0 AND {b} = 0 THEN CAST(0 AS DOUBLE) WHEN {b} = 0 THEN {SENTINEL} ELSE {a} / nullif({b}, 0) END)"


def root(a: str, p: float) -> str:
    return f"pow({a}, CAST({p} AS DOUBLE))"


_STAND = dict(
    uswrf="qty", dswrf="price", ulwrf="disc", dlwrf="tax", tcolc="qty", apcp="disc", pwat="tax",
    tmax="price", tmin="qty", tmp2="tax", tmps="disc",
)


def _preset_columns() -> str:
    def div(a, b):
        return ratio(_STAND[a], _STAND[b])

    def sub(a, b):
        return f"{_STAND[a]} - {_STAND[b]}"

    default = [
        root(_STAND["tcolc"], 0.15), root(_STAND["apcp"], 0.15), div("uswrf", "dswrf"), div("ulwrf", "dlwrf"),
        div("ulwrf", "uswrf"), div("dlwrf", "dswrf"), sub("tmax", "tmin"), sub("tmp2", "tmps"),
        sub("apcp", "pwat"), div("apcp", "pwat"),
    ]
    baseline = [div("uswrf", "dswrf"), div("ulwrf", "dlwrf"), div("ulwrf", "uswrf"), div("dlwrf", "dswrf")]
    station = baseline + [
        sub("tmax", "tmin"), div("tmax", "tmin"), sub("tmp2", "tmps"), div("tmp2", "tmps"), sub("apcp", "pwat"),
        div("apcp", "pwat"), div("uswrf", "dlwrf"), div("ulwrf", "dswrf"),
    ]
    out = []
    for name, group in (("default", default), ("baseline", baseline), ("station", station)):
        out += [f"{r(e, 9)} AS {name}_{i}" for i, e in enumerate(group)]
    return ", ".join(out)


_WINDOW_OFFSETS = "(SELECT unnest(generate_series(-2, 1)) AS o)"

define(
    "station_places",
    "SELECT stid, (k - 1) // 98 AS block, 1 + (k - 1) % 98 AS place FROM (SELECT stid, row_number() OVER (ORDER BY stid) AS k FROM stations)",
    "stations",
)

SQL = {
    "scan_nwp": query("nwp", "SELECT * FROM nwp"),
    "scan_labels_unpivot": query(
        "energy",
        """SELECT d.day, CAST(s.stid AS BIGINT) AS stid, e.y FROM (SELECT DISTINCT day FROM energy) d
        CROSS JOIN (SELECT unnest(generate_series(1, (SELECT max(s_suppkey) FROM supplier))) AS stid) s
        LEFT JOIN energy e ON e.day = d.day AND e.stid = s.stid""",
    ),
    "scan_stations": query("stations", "SELECT lpad(CAST(stid AS VARCHAR), 12, '0') AS station, stid, nlat, elon, elev FROM stations"),
    "scan_grid": query("grid", "SELECT * FROM grid"),
    "sink_submission_pivot": query(
        "energy_nwp station_places",
        "SELECT strftime(day, '%Y%m%d') AS \"Date\", block, "
        + ", ".join(f"max(CASE WHEN place = {i} THEN y END) AS s{i}" for i in range(1, 99))
        + " FROM energy_nwp JOIN station_places USING (stid) GROUP BY day, block",
    ),
    "sink_tables": query("split_energy", "SELECT stid, day, y, split FROM split_energy"),
    "block_select": query("obs", "SELECT stid, day, hour, ens, price, disc, tax FROM obs"),
    "row_slice": query(
        "energy energy_days",
        "SELECT e.* FROM energy e JOIN energy_days d USING (day) WHERE d.pos >= 100 AND d.pos < 600",
    ),
    "block_assign": query("energy", "SELECT stid, day, y, CAST(dayofyear(day) AS INTEGER) AS doy FROM energy"),
    "block_hstack": query("obs", "SELECT stid, day, hour, ens, qty, price, disc, tax FROM obs"),
    "block_drop": query("obs", "SELECT stid, day, hour, ens, qty FROM obs"),
    "feature_subset": query("nwp", "SELECT * FROM nwp WHERE fx = 'f1'"),
    "expr_features": query(
        "obs",
        f"""SELECT stid, day, hour, ens, {r(ratio('disc', 'tax'))} AS "disc/tax", {r(ratio('tax', 'disc'))} AS "tax/disc",
        {r('price - qty')} AS "price-qty", {r(root('disc', 0.15))} AS "discpow0.15", {r('1 / (qty * qty)')} AS "qtypow-2"
        FROM obs""",
    ),
    "expr_presets": query("obs", f"SELECT stid, day, hour, ens, {_preset_columns()} FROM obs"),
    "clip_predictions": query(
        "split_energy",
        """SELECT day, stid, least(greatest(y * 3.0 - 4000.0, lo), hi) AS pred FROM split_energy,
        (SELECT min(y) AS lo, max(y) AS hi FROM split_energy WHERE split = 'train' AND y BETWEEN 1000 AND 4000)
        WHERE split = 'test'""",
    ),
    "drop_masked_rows": query("marked", "SELECT stid, day, y FROM marked WHERE NOT is_masked"),
    "join_day_station": query("nwp stations", "SELECT day, stid FROM (SELECT DISTINCT day FROM nwp) CROSS JOIN stations"),
    "join_station_attrs": query(
        "energy stations",
        f"SELECT stid, day, y, {r('nlat')} AS nlat, {r('elon')} AS elon, elev FROM energy JOIN stations USING (stid)",
    ),
    "join_features_labels": query(
        "obs_daily energy",
        f"""SELECT o.stid, o.day, {r('qty', 4)} AS qty, {r('price', 4)} AS price, {r('disc', 4)} AS disc,
        {r('tax', 4)} AS tax, y FROM obs_daily o JOIN energy e ON o.stid = e.stid AND o.day = e.day""",
    ),
    "station_grid_index": query(
        "placed", "SELECT stid, CAST(li AS INTEGER) AS lat_idx, CAST(lj AS INTEGER) AS lon_idx FROM placed"
    ),
    "local_window_join": query(
        "placed cell_mean",
        f"""SELECT m.day, m.fx, p.stid, CAST(m.lat_i - p.li AS INTEGER) AS dlat, CAST(m.lon_i - p.lj AS INTEGER) AS dlon,
        {r('m.value')} AS value FROM cell_mean m JOIN placed p
        ON m.lat_i >= p.li - 2 AND m.lat_i < p.li + 2 AND m.lon_i >= p.lj - 2 AND m.lon_i < p.lj + 2""",
    ),
    "edge_corner_join": query(
        "nwp placed",
        f"""SELECT m.day, m.fx, m.hour, p.stid, CAST(2 * (p.li - m.lat_i) + (p.lj - m.lon_i) AS INTEGER) AS corner,
        {r('m.v')} AS value FROM (SELECT day, fx, hour, lat_i, lon_i, avg(value) AS v FROM nwp GROUP BY 1, 2, 3, 4, 5) m
        JOIN placed p ON m.lat_i IN (p.li, p.li - 1) AND m.lon_i IN (p.lj, p.lj - 1)""",
    ),
    "climate_lookup": query(
        "split_energy",
        f"""SELECT e.day, e.stid, {r('c.m')} AS pred FROM (SELECT * FROM split_energy WHERE split = 'test') e LEFT JOIN
        (SELECT month(day) AS mo, stid, avg(y) AS m FROM split_energy WHERE split = 'train' GROUP BY 1, 2) c
        ON c.mo = month(e.day) AND c.stid = e.stid""",
    ),
    "mask_or_external": query(
        "marked obs",
        """SELECT m.stid, m.day, m.y, (m.is_masked OR coalesce(h.hard, FALSE)) AS is_masked FROM marked m
        LEFT JOIN (SELECT day, stid, max(qty) > 40 AS hard FROM obs GROUP BY 1, 2) h ON h.day = m.day AND h.stid = m.stid""",
    ),
    "mae_by_station_geo": query(
        "res stations",
        f"""SELECT s.stid, {r('s.nlat')} AS nlat, {r('s.elon')} AS elon, s.elev, {r('m.mae')} AS mae,
        {r('m.mae / (max(m.mae) OVER ())')} AS rel_mae FROM stations s
        LEFT JOIN (SELECT stid, avg(abs(residual)) AS mae FROM res GROUP BY 1) m ON m.stid = s.stid""",
    ),
}
