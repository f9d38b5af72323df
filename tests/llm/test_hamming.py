import random

import numpy as np
import pytest

from heliogrid.llm import hamming

VECTORS = "vec_id long, embedding array<float>, label int, id string, code int, place int, distance string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2, 3, "y") for i, v in rows], VECTORS)


def brute(rows, queries, k, dim):
    coded = sorted({(i, tuple(x is not None and x > 0 for x in v)) for i, v in rows if i is not None and v is not None and len(v) == dim})
    out = {}
    for q, c in {(i, c) for i, c in coded if i in queries}:
        near = sorted((sum(a != b for a, b in zip(c, d)), i) for i, d in coded if i != q)[:k]
        out[q] = [(i, d) for d, i in near]
    return out


@pytest.mark.parametrize("dim", [64, 24, 5])
def test_matches_brute_force(spark, dim):
    rng = random.Random(dim)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(6)]
    rows = [(i, [x + rng.gauss(0, 0.6) for x in centres[i % 6]]) for i in range(600)]
    rows += [(600 + i, list(centres[0])) for i in range(60)]
    data = vectors(spark, rows)
    rule = hamming.SearchRule(k=10, block_entries=150, query_codes=8)
    got = {}
    for r in hamming.nearest(data, data.where("vec_id % 20 = 0"), rule).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.neighbour_id, r.distance))
    assert got == brute(rows, set(range(0, 660, 20)), 10, dim)


def test_awkward_rows(spark):
    rows = [(1, [1.0, -1.0]), (1, [1.0, -1.0]), (2, None), (None, [1.0, 1.0]), (3, []), (4, [float("nan"), None]), (5, [1.0, 2.0, 3.0]), (6, [1.0, 1.0])]
    data = vectors(spark, rows)
    got = hamming.nearest(data, data).collect()
    assert sorted((r.query_id, r.rank, r.neighbour_id, r.distance) for r in got) == [
        (1, 1, 4, 1), (1, 2, 6, 1), (4, 1, 1, 1), (4, 2, 6, 2), (6, 1, 1, 1), (6, 2, 4, 2)
    ]
    assert hamming.nearest(vectors(spark, []), data).count() == 0
    assert hamming.nearest(data, vectors(spark, [])).count() == 0


def test_growth_stops_before_a_scan_and_misses_nothing():
    rng = np.random.default_rng(1)
    codes = np.unique(rng.integers(0, 2**16, (20_000, 4)).astype(np.uint16), axis=0)
    tables = hamming.SegmentTables(codes, np.ones(len(codes), int))
    for _ in range(30):
        query = codes[rng.integers(len(codes))] ^ np.array([1, 0, 4, 0], np.uint16)
        found, distance = tables.nearest(query, 1)
        every = np.bitwise_count(codes ^ query).sum(1)
        assert set(found) == set(np.flatnonzero(every <= every.min())) and (distance == every[found]).all()
    assert max(tables.masks) <= 2
