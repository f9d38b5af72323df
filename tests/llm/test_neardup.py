import random

import numpy as np
import pyarrow as pa
import pytest

from heliogrid.llm import neardup
from heliogrid.llm.graph import components
from tests.llm import common

THREE = neardup.SetSketch(words=3, percent=85, rows=5, bands=26)


def edited(text, share, seed):
    rng = random.Random(seed)
    return " ".join(f"z{rng.randrange(10**6)}" if rng.random() < share else w for w in text.split())


@pytest.mark.parametrize("spec", [THREE, neardup.SetSketch()])
def test_groups_match_brute_force(spark, spec):
    texts = [common.prose(i, 60 + i) for i in range(20)]
    texts += [edited(texts[i % 20], share, i) for i, share in enumerate([0.0, 0.01, 0.02, 0.04, 0.08, 0.2] * 10)]
    got = {r.doc_id: r for r in neardup.near_duplicates(common.table(spark, texts), spec).collect()}
    want = common.near_components(dict(enumerate(texts)), spec.words, spec.percent)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.n_shingles == len(common.word_set(texts[i], spec.words)) and r.kept == (want[i] == i) for i, r in got.items())
    assert len(set(want.values())) > 20


def test_a_large_group_and_its_outliers(spark):
    """One group of copies, chains whose ends aren't linked, texts that share a bucket but no link."""
    base = common.prose(5, 200, 10_000)
    words = base.split()
    chain = [" ".join([*words[: 200 - 4 * i], *(f"q{i}_{j}" for j in range(4 * i))]) for i in range(12)]
    texts = [base] * 60 + chain + [edited(base, 0.01, i) for i in range(80)] + [edited(base, 0.12, i) for i in range(20)]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(common.table(spark, texts), THREE).collect()}
    assert got == common.near_components(dict(enumerate(texts)), 3, 85)


def test_awkward_rows(spark):
    rows = neardup.near_duplicates(common.messy(spark), THREE).collect()
    assert len(rows) == 12
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by_id[2].component_id == 1 and not by_id[2].kept
    assert by_id[7].component_id == 6 and by_id[7].n_shingles == 1
    assert all(by_id[i].n_shingles == 0 and by_id[i].component_id == i for i in (3, 4, 5))
    assert all(r.component_id is None and r.kept for r in rows if r.doc_id is None)
    assert neardup.near_duplicates(common.empty(spark), THREE).count() == 0


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(1)
    spec = neardup.SetSketch(rows=8, bands=64)
    common_part, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (800, 100, 150))
    x, y = np.concatenate([common_part, a]), np.concatenate([common_part, b])
    rx, ry, rz = neardup.registers([x, y, np.concatenate([x, y])], spec)
    assert (neardup.merged(rx, ry) == rz).all()
    estimate = neardup.joint_similarity(rx[None], ry[None], np.array([900.0]), np.array([950.0]), spec.base)[0]
    assert abs(estimate - 800 / 1050) < 5 * np.sqrt(0.25 / spec.registers)


def test_bands_miss_hardly_any_pair_at_the_limit():
    for spec in (THREE, neardup.SetSketch()):
        j = spec.percent / 100
        assert (1 - j**spec.rows) ** spec.bands < 1e-6


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(40)] + [(rng.randint(100, 300), rng.randint(100, 300)) for _ in range(110)]
    nodes = {x for e in links for x in e}
    want = common.components(nodes, lambda a, b: (a, b) in links or (b, a) in links)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(want[n] == got.get(n, n) for n in nodes)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_links_by_differences_are_those_of_the_sets():
    rng = np.random.default_rng(4)
    base = np.unique(rng.integers(0, 2**63, 100, dtype=np.uint64))
    extra = np.unique(rng.integers(0, 2**63, 12, dtype=np.uint64))
    sets = [np.union1d(base[rng.random(len(base)) < p], extra[rng.random(len(extra)) < 0.3]) for p in [1.0, *rng.uniform(0.85, 1, 60)]]
    group = rng.integers(0, 5, len(sets))
    rows = pa.table({"rep": np.arange(len(sets)), "component": group, "n": [len(x) for x in sets], "gap": [np.setxor1d(sets[0], x).tobytes() for x in sets]})
    got = set(zip(*(neardup.links_across(rows, rows, 85)[c].to_pylist() for c in "ab")))
    want = {(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets) if group[i] != group[j] and neardup.linked(x, y, 85)}
    assert got <= want and {(i, group[j]) for i, j in got} == {(i, group[j]) for i, j in want} and 0 < len(want) < len(sets) ** 2 / 2
    assert not len(neardup.links_across(rows.slice(0, 0), rows, 85)) and not len(neardup.links_across(rows, rows.slice(0, 0), 85))


def test_unlinked_variants_of_one_text(spark, monkeypatch):
    """Variants that are no links of each other but of the base's near copies; some share their edits."""
    base = common.prose(9, 300, 10_000)
    texts = [edited(base, 0.06, i) for i in range(120)] + [edited(edited(base, 0.06, i), 0.01, 500 + i) for i in range(0, 120, 3)]
    want = common.near_components(dict(enumerate(texts)), 3, 85)
    assert len(set(want.values())) > 50
    for blocks in ((256, 4096, 2_000_000), (7, 25, 10)):
        monkeypatch.setattr(neardup, "BROADCAST_KEYS", blocks[2])
        monkeypatch.setattr(neardup, "PART_CLASSES", blocks[0])
        monkeypatch.setattr(neardup, "BLOCK_CLASSES", blocks[1])
        got = {r.doc_id: r.component_id for r in neardup.near_duplicates(common.table(spark, texts), THREE).collect()}
        assert got == want
