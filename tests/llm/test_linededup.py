import numpy as np

from heliogrid.llm import linededup
from tests.llm import common


def test_matches_brute_force(spark):
    shared = [f"line number {i} which many documents share, more or less" for i in range(30)]
    texts = []
    for i in range(60):
        lines = [common.prose(i, 9), "", "short", f"  {shared[i % 30].upper()} \t", shared[i % 7], shared[i % 7], "é" * 39, "é" * 40]
        texts.append("\n".join(lines))
    rows = linededup.dedup_lines(common.table(spark, texts)).collect()
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept) for r in rows} == common.deduped_lines(list(enumerate(texts)))
    assert sum(r.n_dropped for r in rows) > 100


def test_copies_of_hot_shards(spark, monkeypatch):
    """One line in all documents, few probes a copy: the result is the same, and the hot shard has many copies."""
    monkeypatch.setattr(linededup, "SHARD", 16)
    monkeypatch.setattr(linededup, "PROBES", 20)
    monkeypatch.setattr(linededup, "CHUNK", 300)
    hot = "this line stands in every document of the corpus, whatever it is about"
    texts = ["\n".join([hot, common.prose(i, 12), f"shared by a few: {i // 7} and so on and on and on"]) for i in range(200)]
    docs = common.table(spark, texts).repartition(6)
    rows = linededup.dedup_lines(docs).collect()
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept) for r in rows} == common.deduped_lines(list(enumerate(texts)))
    rule = linededup.LineRule()
    counted = linededup.line_hashes(docs, rule).groupBy("h").count().toDF("h", "n_docs")
    shards = -(-counted.count() // 16)
    copies = linededup._copies(counted, shards)
    h = np.array([linededup.key_hash(hot.encode(), rule)], np.uint64)
    assert copies[int(linededup._shard(h, shards)[0])] >= 10 and set(copies) <= set(range(shards))


def test_awkward_rows(spark):
    docs = common.messy(spark)
    rows = linededup.dedup_lines(docs, linededup.LineRule(min_docs=2)).collect()
    assert len(rows) == 12
    want = common.deduped_lines([(r.doc_id, r.text) for r in docs.collect()], min_docs=2)
    assert all((r.n_lines, r.n_dropped, r.kept) == want[r.doc_id] for r in rows if r.doc_id is not None)
    assert all(r.n_dropped == 0 for r in rows if r.doc_id is None)
    assert [r.n_dropped for r in rows if r.doc_id == 2] == [0, 0] and [r.n_dropped for r in rows if r.doc_id == 1] == [1]
    assert linededup.dedup_lines(common.empty(spark)).count() == 0


def test_strip_lines_keeps_columns(spark):
    docs = common.messy(spark)
    out = linededup.strip_lines(docs, linededup.LineRule(min_docs=2))
    assert out.columns == [*docs.columns, "n_dropped"] and out.count() == 12
    assert out.where("doc_id = 8").select(docs.columns).collect() == docs.where("doc_id = 8").collect()


def test_perfect_hash_is_minimal_and_rejects_strangers():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        at = linededup.PerfectHash.build(keys).index(keys)
        assert sorted(at) == list(range(len(keys)))
        index = linededup.LineIndex(keys, np.arange(len(keys)) + 1, np.arange(len(keys)) * 7)
        counts, last = index.probe(keys)
        assert (counts == np.arange(len(keys)) + 1).all() and (last == np.arange(len(keys)) * 7).all()
        strangers = rng.integers(2**63, 2**64, 5000, dtype=np.uint64)
        assert (index.probe(strangers)[0] > 0).sum() == 0


def test_keys_beyond_the_last_level():
    keys = np.arange(10, dtype=np.uint64)
    held = linededup.PerfectHash(np.empty(0, np.int64), np.empty(0, np.uint8), keys)
    assert list(held.index(keys)) == list(range(10))
