"""Every stage against a brute-force version, on test tables and on awkward rows."""

import corpus_pipeline as pipeline
import pytest

import __spark_entry__ as entry
from tests.compare import compare
from tests.llm import common

STAGE = dict(pipeline.STAGES)


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").cache()


def test_stages_in_order():
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "line_dedup", "minhash_near_dedup", "decontaminate", "mix_sources"]


def test_language_stage_keeps_clean_documents(spark, docs, sf):
    out = STAGE["language_id"](spark, docs, sf)
    assert out.columns == docs.columns and out.count() >= 0.98 * docs.count()


def test_line_stage(spark, docs, sf):
    want = common.deduped_lines([(r.doc_id, r.text) for r in docs.collect()])
    got = STAGE["line_dedup"](spark, docs, sf)
    assert got.columns == docs.columns
    got = texts(got)
    assert got == {i: kept for i, (_, dropped, kept) in want.items() if not dropped or kept.strip()}


def test_near_duplicate_stage(spark, docs, sf):
    want = common.near_components(texts(docs), 5, 80)
    assert set(texts(STAGE["minhash_near_dedup"](spark, docs, sf))) == {i for i, c in want.items() if i == c}


def test_decontamination_stage(spark, docs, sf):
    """Documents with twelve words of a test item in a row go; those without three in a row stay."""
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]

    def runs(text, n):
        words = ["".join(c for c in w.casefold() if c.isalnum()) for w in (text or "").split()]
        words = [w for w in words if w]
        return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}

    long, short = set().union(*(runs(t, 12) for t in items)), set().union(*(runs(t, 3) for t in items))
    whole = texts(docs)
    kept = set(texts(STAGE["decontaminate"](spark, docs, sf)))
    assert not any(runs(whole[i], 12) & long for i in kept)
    assert all(runs(whole[i], 3) & short for i in set(whole) - kept)


def test_mixing_stage(spark, docs, sf):
    out = STAGE["mix_sources"](spark, docs, sf)
    assert out.columns == [*docs.columns, "block", "slot", "position"]
    rows = out.collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts(docs)) and len({r.position for r in rows}) == len(rows)


@pytest.mark.parametrize("name", list(STAGE))
def test_awkward_rows_and_no_rows(spark, sf, name):
    out = STAGE[name](spark, common.messy(spark), sf)
    assert out.columns[: len(common.messy(spark).columns) - 1][:4] == ["doc_id", "text", "lang", "source"]
    ids = [r.doc_id for r in out.collect()]
    assert ids.count(None) == 2
    assert STAGE[name](spark, common.empty(spark), sf).count() == 0
    if name == "minhash_near_dedup":
        assert sorted(i for i in ids if i is not None) == [1, 3, 4, 5, 6, 8, 9]


def test_pipeline_runs(spark, sf):
    out = entry.queries()["pipeline"](spark, sf)
    assert 0 < out.count() < spark.read.parquet(f"{sf}/documents.parquet").count()


OURS = [n for n in entry.queries() if n.startswith("op") and n[2].isdigit()]


@pytest.mark.parametrize("name", sorted(set(OURS) & set(entry.oracle_sql())))
def test_query_matches_sql(spark, sf, con, name):
    assert compare(entry.queries()[name](spark, sf), con, entry.oracle_sql()[name]) is None


def test_thirteen_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in OURS) == list(range(1, 14))


def test_languages_of_pages(spark, sf):
    rows = entry.queries()["language_id_pages"](spark, sf)
    pages = spark.read.parquet(f"{sf}/pages.parquet").selectExpr("page_id", "regexp_extract(html, 'lang=.([a-z]+)', 1) as said")
    same = rows.join(pages, "page_id").where("lang = said and accepted")
    assert same.count() >= 0.95 * pages.count()
