import zlib

import numpy as np

from heliogrid.llm import quality
from heliogrid.llm.common import WordHashes, id_text
from tests.llm import common

LABELS = "doc_id long, quality int, score double, text string"


def labels(spark, values):
    return spark.createDataFrame([(i, v, 0.5, "x") for i, v in values], LABELS)


def marked(i, good):
    words = common.prose(i, 40 + i % 90).split()
    return " ".join(words if good else [w + "!!" if k % 2 else w for k, w in enumerate(words)])


def reference(rows, rule):
    """The updates from their definition, a bucket at a time. rows: (buckets, values, label)."""
    bias = 1 << rule.buckets_log2
    z, n = {}, {}

    def weight(b):
        s, limit = z.get(b, 0.0), 0.0 if b == bias else rule.l1
        if abs(s) <= limit:
            return 0.0
        return -(s - np.sign(s) * limit) / ((rule.beta + np.sqrt(n.get(b, 0.0))) / rule.alpha + rule.l2)

    for buckets, values, label in rows:
        x = [*zip(buckets, values), (bias, 1.0)]
        w = {b: weight(b) for b, _ in x}
        p = 1 / (1 + np.exp(-sum(w[b] * v for b, v in x)))
        for b, v in x:
            g = (p - label) * v
            sigma = (np.sqrt(n.get(b, 0.0) + g * g) - np.sqrt(n.get(b, 0.0))) / rule.alpha
            z[b] = z.get(b, 0.0) + g - sigma * w[b]
            n[b] = n.get(b, 0.0) + g * g
    return {b: weight(b) for b in z}


def test_updates_follow_their_definition():
    rng = np.random.default_rng(3)
    rule = quality.QualityRule(buckets_log2=6, l1=0.6)
    rows = []
    for _ in range(300):
        b = np.sort(rng.choice(64, rng.integers(0, 9), replace=False))
        rows.append((b, rng.random(len(b)), int(rng.random() < 0.3 + 0.4 * (5 in b))))
    leader = quality.Leader(rule)
    for b, v, y in rows:
        leader.learn(b, v, y)
    got = leader.weights()
    want = reference(rows, rule)
    assert np.allclose(got, [want.get(b, 0.0) for b in range(65)], atol=1e-12) and (got == 0).any() and got[5] > 0


def test_fit_is_the_sequence_of_updates(spark):
    """The whole fit equals the updates over the same rows in the same order, made here in one loop."""
    rule = quality.QualityRule(epochs=2, buckets_log2=10)
    texts = [marked(i, i % 3) for i in range(60)]
    docs, known = id_text(common.table(spark, texts)), labels(spark, [(i, int(i % 3 > 0)) for i in range(60)]).selectExpr("doc_id", "quality as label")
    got = quality.fit(docs, known, rule)
    order = spark.sql("select e, id, xxhash64(id, e) as h from (select explode(sequence(1, 2)) as e) cross join range(60)").collect()
    rows = []
    for r in sorted(order, key=lambda r: (r.e, r.h)):
        if zlib.crc32(str(r.id).encode()) % 4 != 2:
            _, b, v = quality.grams([texts[r.id].encode()], rule, WordHashes())
            rows.append((b, v, int(r.id % 3 > 0)))
    want = reference(rows, rule)
    assert np.allclose(got, [want.get(b, 0.0) for b in range(len(got))], atol=1e-9)


def test_grams_by_the_definition():
    rule = quality.QualityRule(buckets_log2=20)
    texts = ["Go go go now!! now", "", "é", "a b a b a"]
    owner, bucket, value = quality.grams([t.encode() for t in texts], rule, WordHashes())
    # Go, go, <again>, now, !!, now -> 5 distinct words and 5 pairs
    assert [int((owner == i).sum()) for i in range(4)] == [10, 0, 1, 4]
    assert np.allclose(np.bincount(owner, value**2, minlength=4), [1, 0, 1, 1])
    assert np.allclose(sorted(value[owner == 3] ** 2 * 9), [2, 2, 2, 3])
    owner, stutter, _ = quality.grams([b"x x x x", b"y y y y"], rule, WordHashes())
    assert len(stutter) == 8 and len(np.intersect1d(stutter[owner == 0], stutter[owner == 1])) == 2


def test_held_out_texts_are_told(spark):
    texts = [marked(i, i % 5 != 2) for i in range(800)]
    got = quality.quality(common.table(spark, texts), labels(spark, [(i, int(i % 5 != 2)) for i in range(800)])).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out]
    assert len(held) > 150 and np.mean([r.predicted == (r.doc_id % 5 != 2) for r in held]) > 0.97


def test_labels_of_held_out_rows_change_nothing(spark):
    texts = [marked(i, i % 3) for i in range(120)]
    one = [(i, int(i % 3 > 0)) for i in range(120)]
    two = [(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, y in one]
    a, b = ({r.doc_id: r.score for r in quality.quality(common.table(spark, texts), labels(spark, x)).collect()} for x in (one, two))
    assert a == b


def test_awkward_rows(spark):
    docs = common.messy(spark)
    for known in ([], [(1, 1), (2, 0), (2, 1), (3, None), (None, 1), (6, 5), (8, 0)], [(8, 1)]):
        got = quality.quality(docs, labels(spark, known)).collect()
        assert len(got) == 12 and all(0 <= r.score <= 1 for r in got)
        assert all(not r.held_out for r in got if r.doc_id is None)
        assert len({r.score for r in got if r.doc_id in (3, 4, 5)}) == 1
        assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    assert quality.quality(common.empty(spark), labels(spark, [(1, 1)])).count() == 0


def test_sample_is_bounded_and_partitions_change_nothing(spark):
    texts = [marked(i, i % 2) for i in range(100)]
    known = labels(spark, [(i, i % 2) for i in range(100)]).selectExpr("doc_id", "quality as label")
    docs = id_text(common.table(spark, texts))
    rule = quality.QualityRule(max_rows=30)
    assert quality.training_sample(docs, known, rule).count() == 30
    assert np.array_equal(quality.fit(docs, known, rule), quality.fit(docs.repartition(7), known, rule))


def test_test_data(spark):
    sf = "/root/testdata/sf0.1"
    docs, known = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.quality(docs, known).join(known, "doc_id").where("held_out").toPandas()
    rank = got["score"].rank()
    ones = got["quality"] == 1
    area = (rank[ones].sum() - ones.sum() * (ones.sum() + 1) / 2) / (ones.sum() * (~ones).sum())
    assert area > 0.9 and (got["predicted"] == got["quality"]).mean() > 0.9
