"""Box filters against sums over windows, and designs with missing cells and days."""

import datetime as dtm

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliogrid.operators import block_design as bd
from heliogrid.operators.grid import GridSpec

SPEC = GridSpec.of([30, 31, 32, 33, 34], [-100 + j for j in range(7)])


@pytest.mark.parametrize("k, step", [(1, 1), (2, 1), (3, 2), (5, 2)])
def test_box_means_by_prefix_sums(k, step):
    rng = np.random.default_rng(k)
    x = rng.normal(1e6, 1, (4, 5, 7))
    x[2, 1, 3] = np.nan
    rows, columns = bd.Box(k, step).places(SPEC)
    got = bd.box_means(x.reshape(4, -1), SPEC, bd.Box(k, step)).reshape(4, len(rows), len(columns))
    for a, i in enumerate(rows):
        for b, j in enumerate(columns):
            assert np.allclose(got[:, a, b], x[:, i : i + k, j : j + k].mean(axis=(1, 2)), rtol=0, atol=1e-8, equal_nan=True)
    assert list(rows) == list(range(0, 6 - k, step)) and list(columns) == list(range(0, 7 - k, step))


def test_boxes_must_fit():
    with pytest.raises(ValueError):
        bd.Box(6).places(SPEC)


def cube(spark, skip=()):
    rows = [
        (dtm.date(2000, 1, d), f, e, h, i, j, 100.0 * d + 10 * i + j + (e - 0.5) * 2 + h * (f == "b"))
        for d in (1, 2, 3) for f in "ab" for e in (0, 1) for h in (0, 1, 2) for i in range(5) for j in range(7) if (d, i, j) not in skip
    ]
    return spark.createDataFrame(rows, "day date, fx string, ens int, hour int, lat_i int, lon_i int, value double")


def test_blocks_of_every_rank(spark):
    stations = spark.createDataFrame([(1, 31.5, -97.5, 10.0), (2, 30.0, -100.0, 20.0)], "stid long, nlat double, elon double, elev double")
    days = spark.createDataFrame([(dtm.date(2000, 1, 1), 7, "x"), (dtm.date(2000, 1, 3), 9, "y")], "day date, v int, w string")
    data = cube(spark, skip={(2, 1, 2)})
    blocks = [
        bd.CubeBlock("m", data, ("a",)), bd.CubeBlock("h", data, ("b",), (0, 2), hour=None), bd.CubeBlock("s", data, ("a", "b"), ens="std"),
        bd.CubeBlock("t", data, ("b",), hour="std"), bd.CubeBlock("g", data, ("a",), view=bd.Box(3, 2)), bd.DayBlock("d", days, ("v",)),
    ]
    table = bd.block_design(blocks, stations, SPEC, station_classes=[1, 2])
    got = {(r["day"].day, r["stid"]): r.asDict() for r in table.collect()}
    assert len(got) == 6
    one = got[1, 1]  # cells 1..2 x 2..3
    assert [one[f"m_a_{i}_{j}"] for i in (0, 1) for j in (0, 1)] == [112.0, 113.0, 122.0, 123.0]
    assert one["h_b_2_0_0"] == 114.0 and one["h_b_0_1_1"] == 123.0 and one["s_a_0_0"] == 1.0 and one["t_b_0_0"] == pytest.approx(np.std([0, 1, 2]))
    assert one["g_a_0_0"] == pytest.approx(111.0) and one["g_a_2_2"] == pytest.approx(133.0) and one["d_v"] == 7.0
    assert (one["s1"], one["s2"]) == (1.0, 0.0) and one["rel_lat"] == pytest.approx(-0.5) and one["lat_idx"] == 2.0
    two = got[2, 1]
    assert two["m_a_0_0"] is None and two["m_a_0_1"] == 213.0 and two["d_v"] is None and two["g_a_0_0"] is None and two["g_a_2_2"] == pytest.approx(233.0)
    off = got[3, 2]  # a corner station: three of its four cells lie off the grid
    assert all(off[f"m_a_{i}_{j}"] is None for i, j in ((0, 0), (0, 1), (1, 0))) and off["m_a_1_1"] == 300.0 and off["d_v"] == 9.0


def test_wrong_blocks(spark):
    data = cube(spark)
    stations = spark.createDataFrame([(1, 31.5, -97.5, 10.0)], "stid long, nlat double, elon double, elev double")
    with pytest.raises(ValueError):
        bd.block_design([], stations, SPEC)
    with pytest.raises(ValueError):
        bd.block_design([bd.CubeBlock("m", data, ("a",)), bd.CubeBlock("m", data, ("b",))], stations, SPEC)
    with pytest.raises(ValueError):
        bd.CubeBlock("m", data, ("a",), hour=None).maps(SPEC)
    empty = bd.block_design([bd.CubeBlock("m", data.limit(0), ("a",)), bd.CubeBlock("g", data.where(F.lit(False)), ("a",), view=bd.Box(3))], stations, SPEC)
    assert empty.count() == 0


def test_kernels_on_maps_with_gaps():
    from heliogrid.operators import interpolate

    rng = np.random.default_rng(4)
    x = rng.normal(size=(3, 5, 7))
    x[1, 2, 2] = np.nan
    for k, ring in ((2, False), (3, False), (3, True)):
        kernel = bd.BoxKernel(SPEC, k, ring)
        points = kernel.places()
        (got,) = kernel.run(kernel.prepare(points), (x.reshape(3, -1),))
        weight = np.full((k, k), 1 / k**2)
        if ring:
            weight[:], weight[1, 1] = 1 / 8, 0
        for p, (i, j) in enumerate(zip(points["row"], points["col"])):
            window = x[:, i : i + k, j : j + k]
            want = (np.nan_to_num(window) * weight).sum(axis=(1, 2))
            want[(np.isnan(window) & (weight > 0)).any(axis=(1, 2))] = np.nan
            assert np.allclose(got[:, p], want, equal_nan=True)
    a, b = rng.normal(size=(4, 5)), rng.normal(size=(6, 7))
    a[0, 2] = 0
    dense = (a[:, None, :, None] * b[None, :, None, :]).reshape(24, 35)
    (one,) = interpolate.SeparableKernel(a, b).run((a, b), (x.reshape(3, -1),))
    (two,) = interpolate.LinearKernel(dense).run(dense, (x.reshape(3, -1),))
    assert np.allclose(one, two, equal_nan=True) and np.isnan(one).any() and not np.isnan(one).all()
