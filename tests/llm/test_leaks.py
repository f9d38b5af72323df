import random

import numpy as np

from heliogrid.llm import leaks
from tests.llm import common

ITEMS = "item_id long, text string, score double"


def items(spark, texts):
    return spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts)], ITEMS)


def edited(text, share, seed):
    rng = random.Random(seed)
    out = []
    for w in text.split():
        x = rng.random()
        out += [] if x < share / 3 else [f"new{rng.randrange(99)}"] if x < 2 * share / 3 else [w, "more"] if x < share else [w]
    return " ".join(out)


def test_finds_copies_and_leaves_clean_texts(spark):
    tests = [common.prose(1000 + i, 25 + i, 3000) for i in range(20)]
    clean = [common.prose(i, 300, 3000) for i in range(60)]
    around = [common.prose(500 + i, 100, 3000) for i in range(80)]
    copies = [f"{around[i]} {(t.upper, t.lower, lambda: t.replace(' ', ', '), lambda: edited(t, 0.2, i))[i % 4]()} {around[i][:200]}" for i, t in enumerate(tests * 4)]
    rows = leaks.find_leaks(common.table(spark, [*clean, *copies]), items(spark, tests)).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(60 + i, i % 20) for i in range(80)}
    for r in rows:
        assert 0.35 <= r.score <= 1 and abs(r.first_word - 100) <= 3 and abs(r.end_word - 100 - len(tests[r.item_id].split())) <= 8
    blockwise = leaks.find_leaks(common.table(spark, [*clean, *copies]), items(spark, tests), leaks.LeakRule(block_words=200)).collect()
    assert {(r.doc_id, r.item_id) for r in blockwise} == {(r.doc_id, r.item_id) for r in rows}


def test_a_frequent_passage_is_found_everywhere(spark):
    test = common.prose(7, 30, 50)
    texts = [f"{common.prose(i, 20)} {test}" for i in range(200)]
    assert leaks.find_leaks(common.table(spark, texts), items(spark, [test])).count() == 200


def test_alignment_matches_the_recurrence():
    rng, rule = np.random.default_rng(1), leaks.LeakRule()
    pairs = [(rng.integers(2, 9, rng.integers(1, 20)).astype(np.uint64), rng.integers(2, 9, rng.integers(1, 40)).astype(np.uint64)) for _ in range(60)]
    got, _ = leaks.aligned(pairs, rule)
    for (a, b), score in zip(pairs, got):
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                step = rule.match if a[i] == b[j] else rule.mismatch
                table[i + 1, j + 1] = max(0, table[i, j] + step, table[i, j + 1] + rule.gap, table[i + 1, j] + rule.gap)
        assert score == table.max()


def test_awkward_rows(spark):
    docs, long = common.messy(spark), common.messy(spark).where("doc_id = 8").first().text.split()
    tests = [None, "", "two words", " ".join(long[30_000:30_040]), "***", common.prose(1, 80), common.prose(1, 80)]
    rows = leaks.find_leaks(docs, items(spark, tests)).collect()
    found = sorted((r.doc_id or -1, r.item_id) for r in rows)
    assert found == sorted([(6, 2), (7, 2), (8, 3), *((d, i) for d in (-1, 1, 2, 2) for i in (5, 6))])
    assert leaks.find_leaks(common.empty(spark), items(spark, tests)).count() == 0
    assert leaks.find_leaks(docs, items(spark, [])).count() == 0


def test_a_part_of_a_long_item_is_found_whatever_its_share(spark):
    test = common.prose(7, 200, 3000)
    rng = random.Random(8)
    common_words = " ".join(rng.choice(["the", "of", "a", "to", "in"]) for _ in range(100))
    parts = [" ".join(x.split()[i : i + n]) for x in (test, common_words) for i, n in ((0, 12), (50, 20), (70, 30))]
    edit = test.split()[100:125]
    edit[12] = "other"
    short = " ".join(test.split()[20:31])
    texts = [f"{common.prose(500 + i, 60, 3000)} {x} {common.prose(600 + i, 60, 3000)}" for i, x in enumerate([*parts, " ".join(edit), short])]
    filler = ["the of a to in " * 200] * 20  # so that no words of the second item are rare
    rows = leaks.find_leaks(common.table(spark, [*texts, *filler]), items(spark, [test, common_words])).collect()
    found = {(r.doc_id, r.item_id): r for r in rows if r.doc_id < len(texts)}
    assert set(found) == {(0, 0), (1, 0), (2, 0), (3, 1), (4, 1), (5, 1), (6, 0)}
    assert all(r.first_word == 60 and r.end_word >= 72 for r in found.values())
