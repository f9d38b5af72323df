"""Side-by-side comparison of a Spark query with its SQL oracle."""

from __future__ import annotations

import math

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        return "NULL" if math.isnan(v) else repr(v)
    return repr(v)


def _kind(t: str) -> str:
    t = t.lower()
    return {"bigint": "int64", "long": "int64", "int": "int32", "integer": "int32", "string": "varchar"}.get(t, t)


def compare(spark_df, con, sql: str) -> str | None:
    """None when names, types, row counts and values agree; otherwise what differs."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    kinds = {d[0]: _kind(str(d[1])) for d in result.description}
    expected = result.fetchall()
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(set(names) ^ set(spark_df.columns))}"
    types = {f.name: _kind(f.dataType.simpleString()) for f in spark_df.schema}
    differing = {c: (types[c], kinds[c]) for c in names if types[c] != kinds[c]}
    order = sorted(names)
    got = [tuple(row[c] for c in order) for row in spark_df.select(*[f"`{c}`" for c in order]).collect()]
    at = [names.index(c) for c in order]
    want = [tuple(row[i] for i in at) for row in expected]
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    a = sorted(tuple(map(_cell, row)) for row in got)
    b = sorted(tuple(map(_cell, row)) for row in want)
    if a != b:
        unequal = [(x, y) for x, y in zip(a, b) if x != y]
        return f"{len(unequal)} of {len(a)} rows differ, first {order} {unequal[0]}"
    if differing:
        return f"types {differing}"
    if not got:
        return "empty"
    return None
