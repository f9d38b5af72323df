import zlib

import numpy as np

from heliogrid.llm import toxicity
from tests.llm import common

LABELS = "doc_id long, toxic int, score double, text string"


def labels(spark, values):
    return spark.createDataFrame([(i, v, 0.5, "x") for i, v in values], LABELS)


def marked(i, toxic):
    words = common.prose(i, 60).split()
    if toxic:
        words[i % 50 : i % 50] = [("Dunderhead", "MUMPSIMUS", "scoundrels")[i % 3]]
    return " ".join(words)


def test_held_out_texts_are_told(spark):
    texts = [marked(i, i % 5 == 2) for i in range(600)]
    got = toxicity.toxicity(common.table(spark, texts), labels(spark, [(i, int(i % 5 == 2)) for i in range(600)])).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out]
    assert len(held) > 80 and np.mean([r.predicted == (r.doc_id % 5 == 2) for r in held]) > 0.97


def test_labels_of_held_out_rows_change_nothing(spark):
    texts = [marked(i, i % 3 == 0) for i in range(120)]
    one = [(i, int(i % 3 == 0)) for i in range(120)]
    two = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in one]
    a, b = ({r.doc_id: r.score for r in toxicity.toxicity(common.table(spark, texts), labels(spark, x)).collect()} for x in (one, two))
    assert a == b


def test_awkward_rows(spark):
    docs = common.messy(spark)
    for known in ([], [(1, 1), (2, 0), (2, 1), (3, None), (None, 1), (6, 5), (8, 0)], [(8, 1)]):
        got = toxicity.toxicity(docs, labels(spark, known)).collect()
        assert len(got) == 12 and all(0 <= r.score <= 1 for r in got)
        assert all(not r.held_out for r in got if r.doc_id is None)
        assert len({r.score for r in got if r.doc_id in (3, 4, 5)}) == 1
    assert toxicity.toxicity(common.empty(spark), labels(spark, [(1, 1)])).count() == 0


def test_sample_is_bounded(spark):
    texts = [marked(i, i % 2) for i in range(100)]
    rule = toxicity.ToxicityRule(max_rows=30)
    from heliogrid.llm.common import id_text

    known = labels(spark, [(i, i % 2) for i in range(100)]).selectExpr("doc_id", "toxic as label")
    assert toxicity.training_sample(id_text(common.table(spark, texts)), known, rule).count() == 30


def test_logistic_fit_meets_its_optimum():
    rng = np.random.default_rng(1)
    rule = toxicity.ToxicityRule(penalty=1.0, steps=3000)
    dense = (rng.random((300, 12)) < 0.3) * rng.normal(0, 2, 12)
    label = (rng.random(300) < 1 / (1 + np.exp(-(dense @ rng.normal(0, 1, 12) - 1)))).astype(float)
    row, column = np.nonzero(dense)
    w, b = toxicity.fit_logistic(row, column, dense[row, column], label, 12, rule)
    error = 1 / (1 + np.exp(-(dense @ w + b))) - label
    assert np.abs(dense.T @ error + rule.penalty * w).max() < 0.05 and abs(error.sum()) < 0.05


def test_test_data(spark):
    sf = "/root/testdata/sf0.01"
    docs, known = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.toxicity(docs, known).join(known, "doc_id").where("held_out").toPandas()
    rank = got["score"].rank()
    ones = got["toxic"] == 1
    area = (rank[ones].sum() - ones.sum() * (ones.sum() + 1) / 2) / (ones.sum() * (~ones).sum())
    assert area > 0.85


def by_hand(texts, label, rule):
    """Scores of all texts from the definition: n-grams as slices, hashes in whole numbers, the optimum by Newton steps."""
    from heliogrid.llm.common import random_words

    value, factors = [int(v) for v in random_words(256, 53)], [int(f) | 1 for f in random_words(max(rule.sizes), 59)]

    def bucket(gram):
        h = sum(value[c] * factors[i] for i, c in enumerate(gram)) % 2**64
        h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 % 2**64
        h = (h ^ h >> 27) * 0x94D049BB133111EB % 2**64
        return (h ^ h >> 31) >> (64 - rule.buckets_log2)

    def grams(text):
        raw = b" " + (text or "").encode() + b" "
        plain = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in raw)
        while b"  " in plain:
            plain = plain.replace(b"  ", b" ")
        return {bucket(plain[i : i + n]) for n in rule.sizes for i in range(len(plain) - n + 1)}

    sets = [grams(t) for t in texts]
    train = [i for i in label if zlib.crc32(str(i).encode()) % 5]
    n = {c: sum(label[i] == c for i in train) for c in (0, 1)}
    held = {c: {} for c in (0, 1)}
    for i in train:
        for b in sets[i]:
            held[label[i]][b] = held[label[i]].get(b, 0) + 1
    ratio, told = {}, {}
    for b in set(held[0]) | set(held[1]):
        share = {c: (held[c].get(b, 0) + rule.alpha) / (n[c] + 2 * rule.alpha) for c in (0, 1)}
        both = sum(share[c] * n[c] for c in (0, 1)) / (n[0] + n[1])
        ratio[b] = np.log(share[1] / share[0])
        told[b] = sum(n[c] * (share[c] * np.log(share[c] / both) + (1 - share[c]) * np.log((1 - share[c]) / (1 - both))) for c in (0, 1))
    kept = sorted(told, key=lambda b: (-told[b], b))[: rule.features]
    x = np.array([[ratio[b] * (b in s) for b in kept] + [1.0] for s in sets])
    y, w = np.array([label[i] for i in train], float), np.zeros(len(kept) + 1)
    penalty = np.append(np.full(len(kept), rule.penalty), 0.0)
    for _ in range(60):
        p = 1 / (1 + np.exp(-x[train] @ w))
        w = w - np.linalg.solve((x[train] * (p * (1 - p))[:, None]).T @ x[train] + np.diag(penalty + 1e-9), x[train].T @ (p - y) + penalty * w)
    return 1 / (1 + np.exp(-x @ w))


def test_scores_equal_the_definition(spark):
    """All features are kept, so ties of their statistic decide nothing."""
    rule = toxicity.ToxicityRule(features=1 << 20, penalty=1.0, steps=4000)
    texts = [common.prose(i, 4 + i % 5, 30) + (" Dunderhead!" if i % 4 == 1 else "") for i in range(70)] + ["", None, " \t\n", "É  ü", "ab"]
    label = {i: int(i % 4 == 1) for i in range(72)}
    known = labels(spark, label.items())
    got = {r.doc_id: r for r in toxicity.toxicity(common.table(spark, texts), known, rule).collect()}
    want = by_hand(texts, label, rule)
    assert max(abs(got[i].score - want[i]) for i in got) < 2e-3 and want.max() - want.min() > 0.5
