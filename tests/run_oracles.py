"""Compares registered queries with their oracles: python tests/run_oracles.py SF [name ...]."""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
from heliogrid.session import local_session  # noqa: E402
from tests.compare import compare, duck  # noqa: E402


def main() -> None:
    sf = f"/root/testdata/sf{sys.argv[1]}"
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    queries, sqls = entry.queries(), entry.oracle_sql()
    names = sys.argv[2:] or list(queries)
    bad = 0
    for name in names:
        began = time.time()
        try:
            df = queries[name](spark, sf)
            note = compare(df, con, sqls[name]) if name in sqls else f"no SQL, {df.count()} rows"
        except Exception as e:  # noqa: BLE001
            note = f"FAILED {type(e).__name__}: {str(e)[:1500]}"
        bad += bool(note) and not note.startswith("no SQL")
        print(f"{time.time() - began:6.2f}s {name}: {note or 'ok'}", flush=True)
    print(len(names), "queries,", bad, "bad")


if __name__ == "__main__":
    main()
