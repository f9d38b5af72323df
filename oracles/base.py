"""Common table expressions over the driver tables, and small text helpers."""

from __future__ import annotations

CTES = {
    "nwp": """SELECT DATE '1994-01-01' + CAST(vec_id // 20 AS INTEGER) AS day,
        'f' || CAST((vec_id % 20) // 10 AS VARCHAR) AS fx,
        CAST((vec_id % 10) // 5 AS INTEGER) AS ens, CAST(vec_id % 5 AS INTEGER) AS hour,
        CAST(pos // 8 AS INTEGER) AS lat_i, CAST(pos % 8 AS INTEGER) AS lon_i, CAST(v AS DOUBLE) AS value
        FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)""",
    "grid": """SELECT DISTINCT lat_i, lon_i, CAST(31 + lat_i AS DOUBLE) AS lat, CAST(lon_i - 106 AS DOUBLE) AS lon,
        CAST(100 + (lat_i * 131 + lon_i * 57) % 900 AS DOUBLE) AS elev FROM nwp""",
    "stations": """SELECT s_suppkey AS stid,
        CAST(31.0 AS DOUBLE) + CAST((s_suppkey * 37) % 601 AS DOUBLE) / 100.0 + 0.5 AS nlat,
        CAST(-106.0 AS DOUBLE) + CAST((s_suppkey * 53) % 601 AS DOUBLE) / 100.0 + 0.5 AS elon,
        CAST(100 + (s_suppkey * 71) % 1201 AS DOUBLE) AS elev FROM supplier""",
    "obs": """SELECT l_suppkey AS stid, CAST(l_shipdate AS DATE) AS day, l_linenumber - 1 AS hour, l_partkey % 11 AS ens,
        avg(l_quantity) AS qty, avg(l_extendedprice) AS price, avg(l_discount) AS disc, avg(l_tax) AS tax
        FROM lineitem GROUP BY 1, 2, 3, 4""",
    "energy": """SELECT 1 + o_custkey % (SELECT max(s_suppkey) FROM supplier) AS stid, CAST(o_orderdate AS DATE) AS day,
        CAST(max(floor(o_totalprice / 5000) * 50) AS DOUBLE) AS y FROM orders GROUP BY 1, 2""",
    "energy_nwp": """SELECT 1 + o_custkey % (SELECT max(s_suppkey) FROM supplier) AS stid,
        DATE '1994-01-01' + CAST(o_orderkey % (SELECT max(vec_id) // 20 + 1 FROM embeddings) AS INTEGER) AS day,
        CAST(max(floor(o_totalprice / 5000) * 50) AS DOUBLE) AS y FROM orders GROUP BY 1, 2""",
}

# Computed once, as they are long and read more than once.
ONCE = {"sun_days", "sun_pairs", "raster"}

# Which expressions each of them reads.
NEEDS: dict[str, tuple[str, ...]] = {"grid": ("nwp",)}


def define(name: str, sql: str, *needs: str) -> None:
    CTES[name] = sql
    NEEDS[name] = needs


def _order(names) -> list[str]:
    seen: list[str] = []

    def visit(n):
        for d in NEEDS.get(n, ()):
            visit(d)
        if n not in seen:
            seen.append(n)

    for n in names:
        visit(n)
    return seen


def query(names, body: str) -> str:
    """A WITH clause holding the named expressions and all they read, then the body."""
    names = names.split() if isinstance(names, str) else list(names)
    if not names:
        return body
    parts = ",\n".join(f"{n} AS {'MATERIALIZED ' if n in ONCE else ''}({CTES[n]})" for n in _order(names))
    return f"WITH {parts}\n{body}"


def r(expression: str, digits: int = 6) -> str:
    """Rounded double, with minus zero made zero."""
    return f"(round(CAST({expression} AS DOUBLE), {digits}) + CAST(0 AS DOUBLE))"


def _times(a: str, b: int) -> str:
    """Product of unsigned 64-bit numbers, modulo 2 ** 64."""
    return f"CAST((CAST({a} AS UHUGEINT) * CAST({b} AS UHUGEINT)) % CAST(18446744073709551616 AS UHUGEINT) AS UBIGINT)"


def drawn_rows(source: str, columns: str, bins: int, repetitions: int) -> str:
    """Rows of ``source`` (stid, day) in growing samples: i, j, size and all columns; the order of a sample mixes digest and seed."""
    place = f"""SELECT s.*, i, j, CAST(floor(n * (i + 1) / {bins}e0) AS BIGINT) AS size,
        CAST((CAST(g AS UHUGEINT) + CAST({_times('1000 * i + j + 1', 0x9E3779B97F4A7C15)} AS UHUGEINT)) % CAST(18446744073709551616 AS UHUGEINT) AS UBIGINT) AS h
        FROM (SELECT *, CAST('0x' || substr(md5(concat_ws('|', stid, day)), 1, 16) AS UBIGINT) AS g, count(*) OVER () AS n FROM ({source})) s
        CROSS JOIN (SELECT unnest(generate_series(0, {bins - 1})) AS i) CROSS JOIN (SELECT unnest(generate_series(0, {repetitions - 1})) AS j)"""
    one = f"SELECT * EXCLUDE (h), {_times('xor(h, h >> 30)', 0xBF58476D1CE4E5B9)} AS h FROM ({place})"
    two = f"SELECT * EXCLUDE (h), {_times('xor(h, h >> 27)', 0x94D049BB133111EB)} AS h FROM ({one})"
    ranked = f"SELECT *, row_number() OVER (PARTITION BY i, j ORDER BY xor(h, h >> 31)) AS k FROM ({two})"
    return f"SELECT i, j, size, {columns} FROM ({ranked}) WHERE k <= size"
