import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliogrid.llm import queries, resample
from tests.llm import common

ITEMS = "item_id long, text string, doc_id long, score long"


def runs_of(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return len(words), [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute(docs, items):
    """Rows of (doc_id, text) documents, from the definition."""

    def counts(texts):
        c = [0] * 10000
        for t in texts:
            for f in runs_of(t)[1]:
                c[zlib.crc32(f.encode()) % 10000] += 1
        return c

    s, t = counts([x for _, x in docs]), counts(items)
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + 10000) / ((a + 1) * (sum(t) + 10000)))) for a, b in zip(s, t)]
    rows = []
    for key, text in docs:
        n, feats = runs_of(text)
        weight = sum(gain[zlib.crc32(f.encode()) % 10000] for f in feats)
        h = int(hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        rows.append([key, len(feats), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0]))
    drawn = {id(r): i + 1 for i, r in enumerate(able[: 5 * len(able) // 100])}
    return [(*r[:4], drawn.get(id(r))) for r in rows]


def test_query_on_whole_documents(spark, tmp_path):
    rng = random.Random(1)
    texts = [common.prose(i, rng.choice([3, 19, 20, 21, 60, 200]), 300) for i in range(400)]
    texts += ["", None, "Ünïcode ÀB-c_d " * 9, "x" * 300 + " y " + "Z" * 70 + " é" * 30, "a\x00b\x7fc`d{e/f:g@h[i" * 4]
    docs = common.table(spark, texts).unionByName(common.messy(spark).selectExpr("doc_id + 5000 as doc_id", "* except (doc_id)"))
    docs.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    items = [common.prose(7, 40, 300), "", None, "two words", common.prose(8, 40, 300)]
    spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(items)], ITEMS).write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((tuple(r) for r in queries.op13_importance_resample(spark, str(tmp_path)).collect()), key=str)
    want = sorted(brute([(r.doc_id, r.text) for r in docs.collect()], items), key=str)
    assert got == want and sum(r[4] is not None for r in got) == 5 * sum(runs_of(r.text)[0] >= 20 for r in docs.collect()) // 100


def test_crc_of_appended_words():
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice("abé9") for _ in range(rng.choice([1, 3, 12, 63, 64, 65, 200]))) for _ in range(rng.randrange(30))) for _ in range(40)]
    owner, bucket, n_words = resample.features([t.encode() for t in texts], resample.ResampleRule())
    for i, t in enumerate(texts):
        assert n_words[i] == runs_of(t)[0]
        assert sorted(bucket[owner == i]) == sorted(zlib.crc32(f.encode()) % 10000 for f in runs_of(t)[1])


@pytest.mark.parametrize("spread", [2, 10**9])
@pytest.mark.parametrize("parts", [1, 13])
def test_cutoff_is_the_sorted_one(spark, spread, parts, tmp_path):
    rng = np.random.default_rng(spread)
    rows = [(int(s), int(d)) for s, d in zip(rng.integers(-spread, spread, 700), rng.integers(0, 400, 700))]
    keys = spark.createDataFrame(rows, "score long, doc_id long").repartitionByRange(parts, "score")
    keys.write.parquet(f"{tmp_path}/k")
    keys = spark.read.parquet(f"{tmp_path}/k")
    ordered = sorted(rows, key=lambda r: (-r[0], r[1]))
    for k in (1, 35, 700):
        assert resample.cutoff(keys, k) == resample.Key(*ordered[k - 1])


def test_weighted_median_leaves_a_quarter_on_both_sides():
    rng = random.Random(3)
    for _ in range(200):
        parts = [sorted(rng.randrange(50) for _ in range(rng.randrange(1, 40))) for _ in range(rng.randrange(1, 9))]
        reports = [{"n": len(p), "score": -p[(len(p) - 1) // 2], "doc_id": 0} for p in parts]
        pivot = -resample._weighted_median(reports).score
        n = sum(map(len, parts))
        assert 4 * sum(v <= pivot for p in parts for v in p) >= n and 4 * sum(v >= pivot for p in parts for v in p) >= n


def test_ties_and_repeated_rows(spark):
    text = common.prose(5, 30)
    docs = common.table(spark, [text] * 40).unionByName(common.table(spark, [text] * 40)).withColumn("text", F.lit(text))
    got = resample.resample(docs, docs.limit(1), resample.ResampleRule(percent=50)).collect()
    ranks = sorted(r["rank"] for r in got if r["rank"])
    assert ranks == list(range(1, 41))
    kept = sorted((r["rank"], -r["score"], r["doc_id"]) for r in got if r["rank"])
    assert [k[1:] for k in kept] == sorted(k[1:] for k in kept)


def test_awkward_rows(spark):
    target = spark.createDataFrame([(1, "some target text", 1, 2)], ITEMS)
    for goal in (target, target.limit(0)):
        got = resample.resample(common.messy(spark), goal, resample.ResampleRule(percent=100)).collect()
        assert len(got) == 12 and sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3, 4, 5]
        assert all(r["weight"] == 0 and r["n_features"] == 0 and r["rank"] is None for r in got if r.doc_id in (3, 4, 5))
        assert {r.doc_id for r in got if r["rank"]} == {1, 2, 8, None}
    assert resample.resample(common.empty(spark), target).count() == 0
    assert all(r["rank"] is None for r in resample.resample(common.messy(spark), target).collect())
