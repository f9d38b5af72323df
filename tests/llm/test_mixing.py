import random
from collections import Counter
from fractions import Fraction

import pytest

from heliogrid.llm import mixing
from tests.llm import common

ROWS = "doc_id long, source string, slot string, position int, number int, weight string"


def rows(spark, counts):
    data = [(i, s) for s, n in counts.items() for i in range(n)]
    random.Random(1).shuffle(data)
    return spark.createDataFrame([(k, s, "x", 1, 2, "y") for k, (_, s) in enumerate(data)], ROWS)


def one_by_one(weight: dict, slots: int) -> list:
    """The source of every slot: the released block with the earliest deadline, slot after slot. Weights are whole numbers."""
    total = sum(weight.values())
    done = dict.fromkeys(sorted(weight), 0)
    order = []
    for t in range(slots):
        # window of block n: n * total // w to -(-(n + 1) * total // w)
        ready = [(-(-(n + 1) * total // weight[s]), s) for s, n in done.items() if n * total // weight[s] <= t]
        due, s = min(ready)
        assert due > t
        done[s] += 1
        order.append(s)
    return order


def gap(order: list, weight: dict) -> Fraction:
    """Largest gap between a source's slots and its weight times all slots so far."""
    total, done, worst = sum(weight.values()), dict.fromkeys(weight, 0), 0
    for t, s in enumerate(order, 1):
        done[s] += 1
        worst = max(worst, max(abs(done[x] * total - t * w) for x, w in weight.items()))
    return Fraction(worst, total)


#: The first two were more than one block off with an earlier way to cut periods.
WEIGHTS = [
    [4, 3, 58, 97, 57, 12, 3, 3, 2, 1875, 1, 3],
    [18, 20, 3, 1, 3, 79, 1, 52],
    [500, 333, 100, 60, 6, 1],
    [1],
    [7, 7, 7],
    [1] * 40,
    [45, 45, 1, 2, 3, 4],
]


def test_one_by_one_is_less_than_a_block_off_for_any_weights():
    rng = random.Random(3)
    for _ in range(2000):
        top = rng.choice([3, 20, 300, 10**6])
        weight = {f"s{i}": rng.choice([1, rng.randrange(1, top)]) for i in range(rng.randrange(1, 14))}
        assert gap(one_by_one(weight, min(sum(weight.values()), 150)), weight) < 1


@pytest.mark.parametrize("k", range(len(WEIGHTS)))
def test_schedule_is_the_one_slot_after_slot(spark, k):
    weight = {f"s{i:02d}": w for i, w in enumerate(WEIGHTS[k])}
    table = spark.createDataFrame([(s, float(w), 1 + 1500 * w // sum(weight.values())) for s, w in weight.items()], "source string, slots double, need long")
    for period in (1, 64) if k < 2 else (37,):
        got = {r.slot: (r.source, r.nth) for r in mixing.schedule(table, mixing.Mix(period=period)).collect()}
        unit = {s: max(mixing.LEAST, round(w / sum(weight.values()) * mixing.UNIT)) for s, w in weight.items()}
        order = one_by_one(unit, max(got) + 1)
        seen = Counter()
        for t, s in enumerate(order):
            need = 1 + 1500 * weight[s] // sum(weight.values())
            assert got.pop(t, None) == ((s, seen[s]) if seen[s] < need else None)
            seen[s] += 1
        assert not got and gap(order, unit) < 1


def test_every_row_gets_one_place(spark):
    counts = {"a": 700, "b": 200, "c": 30, None: 20}
    docs = rows(spark, counts)
    for spec in (mixing.Mix(), mixing.Mix(cell_rows=5, block_rows=3)):
        got = mixing.mix(docs, spec)
        assert got.columns == ["doc_id", "source", "number", "weight", "block", "slot", "position"]
        got = got.collect()
        assert sorted(r.doc_id for r in got) == list(range(950)) and len({r.position for r in got}) == 950
        assert Counter(r.source for r in got) == counts
        blocks = Counter((r.source, r.block) for r in got)
        assert max(blocks.values()) == spec.block_rows and len({(r.source, r.block, r.slot) for r in got}) == len(blocks)


def test_targets(spark):
    targets = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("b", 1.0), ("z", 5.0)], "source string, weight double")
    counts = spark.createDataFrame([("a", 10), ("b", 10), ("c", 10)], "source string, n_rows long")
    got = {r.source: r.slots for r in mixing.weights(counts, mixing.Mix(), targets).collect()}
    assert got["c"] == 1 and sum(got.values()) == 1000 and abs(got["b"] - 749) <= 2


def test_awkward_rows(spark):
    docs = common.messy(spark)
    got = mixing.mix(docs).collect()
    assert len(got) == 12 and len({r.position for r in got}) == 12
    assert mixing.mix(common.empty(spark)).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(docs, mixing.Mix(max_sources=2))


def farthest(got, weight, counts):
    """Largest gap, in blocks of one row, between a source's rows and its weight times the slots so far, until it runs out."""
    total, worst = sum(weight.values()), 0.0
    slots = {s: sorted(r.slot for r in got if r.source == s) for s in counts}
    for s, n in counts.items():
        w = weight[s] / total
        assert len(slots[s]) == n
        # the gap is largest right before and right after a block
        for done, t in enumerate(slots[s]):
            worst = max(worst, abs(done - t * w), abs(done + 1 - (t + 1) * w))
    return worst


def test_less_than_one_block_from_the_targets_over_many_periods(spark):
    counts = {"a": 2000, **{f"s{i}": 60 + 17 * i for i in range(19)}}
    weight = {s: n**0.5 for s, n in counts.items()}
    got = mixing.mix(rows(spark, counts), mixing.Mix(block_rows=1, period=100)).collect()
    assert max(r.slot for r in got) > 50 * 100 and len({r.slot for r in got}) == sum(counts.values())
    assert farthest(got, weight, counts) < 1


def test_a_heavy_target_beside_many_small_sources(spark):
    counts = {"a": 1500, **{f"s{i}": 12 for i in range(99)}}
    weight = {"a": 0.5, **{f"s{i}": 0.5 / 99 for i in range(99)}}
    targets = spark.createDataFrame(list(weight.items()), "source string, weight double")
    got = mixing.mix(rows(spark, counts), mixing.Mix(block_rows=1), targets).collect()
    assert farthest(got, weight, counts) < 1


def test_any_number_of_sources(spark):
    counts = {f"s{i}": 2 for i in range(600)}
    got = mixing.mix(rows(spark, counts), mixing.Mix(block_rows=1)).collect()
    assert len(got) == 1200 and len({r.position for r in got}) == 1200 and Counter(r.source for r in got) == counts


def test_sql_agrees_on_unequal_sources(spark, tmp_path):
    import duckdb

    from heliogrid.llm import oracles, queries

    counts = {"a": 900, "b": 211, "c": 50, None: 17, "d": 8, "e": 1}
    rows(spark, counts).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in queries.op10_mix_sources(spark, str(tmp_path)).select("doc_id", "block", "slot", "position").collect())
    duckdb.sql(f"CREATE OR REPLACE TEMP VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = duckdb.sql(f"SELECT doc_id, block, slot, position FROM ({oracles.MIX})").fetchall()
    assert got == sorted(want)


def test_a_light_source_is_scheduled_too(spark):
    counts = {"a": 400, "b": 40, "c": 1}
    weight = {"a": 0.9, "b": 0.0999, "c": 0.0001}
    targets = spark.createDataFrame(list(weight.items()), "source string, weight double")
    got = mixing.mix(rows(spark, counts), mixing.Mix(block_rows=1, period=50), targets).collect()
    assert len(got) == 441 and farthest(got, weight, counts) < 1
