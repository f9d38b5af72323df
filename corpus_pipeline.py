"""A training corpus from raw documents: every stage reads what the one before has written.

Every stage takes (spark, docs, sf_dir) and keeps all columns of ``docs``, whatever else they are; the last one adds the
place of every document in the mixture. Rows without a key stay through the stages that compare documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliogrid.llm import langid, leaks, linededup, mixing, neardup
from heliogrid.llm.common import written

#: Near duplicates of the corpus: five words, similarity 0.8.
NEAR = neardup.SetSketch(words=5, percent=80, rows=4, bands=32)
LANGUAGES = langid.LanguageRule()
LINES = linededup.LineRule(min_chars=40, min_docs=5)
LEAKS = leaks.LeakRule()
MIX = mixing.Mix()


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; the column lang becomes what the evidence says.

    Texts without letters and texts that fit no language go. A row's decision is found by key; rows without a key stay,
    of repeated rows with one key a decision against any holds for all.
    """
    said = langid.identify(langid.evidence(docs, "doc_id", F.col("text"), F.col("lang"), F.col("source")), LANGUAGES)
    said = said.where("doc_id is not null").groupBy("doc_id").agg(F.min("accepted").alias("__accepted"), F.min("lang").alias("__lang"))
    out = docs.join(said, "doc_id", "left").where("coalesce(__accepted, true)")
    return out.withColumn("lang", F.coalesce("__lang", "lang")).select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that are elsewhere too; n_chars follows the text. A document that loses all its lines goes.

    Null and empty texts are one empty line and stay as they are. Repeated rows of a key are one document: they lose the same lines. Rows
    without a key are neither counted nor changed. No rows give no rows.
    """
    return linededup.strip_lines(docs, LINES).where("n_dropped = 0 or length(trim(text)) > 0").withColumn(
        "n_chars", F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars"))
    ).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id; of its repeated rows, any one.

    Null, empty and blank texts are linked with nothing and stay, as do rows without a key. No rows give no rows.
    """
    gone = neardup.near_duplicates(docs, NEAR).where("not kept").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    return kept.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(kept.where("doc_id is null"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy of a test item.

    A key goes with all its repeated rows if one of them holds a copy. Null and empty texts hold none, null and empty items are no
    test, rows without a key stay. No documents give no rows, and without test items all documents stay.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    leaking = leaks.find_leaks(docs, benchmark, LEAKS).where("doc_id is not null").select("doc_id").distinct()
    return docs.join(leaking, "doc_id", "left_anti").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with block, slot and position of the mixture; reading by position interleaves the sources.

    Every row gets a place: null and empty texts, rows without a key, repeated rows, and rows without a source, which are a source of
    their own. No rows give no rows.
    """
    return mixing.mix(docs, MIX)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
]

#: Language models, alignment and verified sets have no SQL; the tests compare every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
