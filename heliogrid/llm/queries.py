"""The registered queries of the text operators, with the parameters they run with in production."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliogrid.llm import hamming, htmltext, langid, leaks, linededup, mixing, neardup, quality, resample, runs, substrings, tokencount, toxicity

NEAR = neardup.SetSketch(words=3, percent=85, rows=5, bands=26)
MIX = mixing.Mix()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), toxicity.ToxicityRule())


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(table(spark, sf_dir, "documents"), linededup.LineRule(min_chars=40, min_docs=5))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.remove_repeats(table(spark, sf_dir, "documents"), substrings.RepeatRule(length=100))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and test item that it holds a copy of."""
    return leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), leaks.LeakRule())


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"), htmltext.HtmlRule())


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest rows of every row whose id is divisible by 20."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return hamming.nearest(vectors, vectors.where("vec_id % 20 = 0"), hamming.SearchRule(k=10))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), tokencount.load())


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), NEAR)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(langid.evidence(docs, "doc_id", F.col("text"), F.col("lang"), F.col("source")), langid.LanguageRule())


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for pages: language attribute, host and suffix of the address, and the text between tags.

    Null and empty pages are rejected as 'und'; scripts and styles aren't text, a tag that isn't closed is; whole pages count, and
    repeated rows are told each.
    """
    pages = table(spark, sf_dir, "pages")
    text = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>", " ")
    declared = F.regexp_extract("html", r"(?i)<html[^>]*\blang\s*=\s*[\"']?([A-Za-z-]+)", 1)
    out = langid.identify(langid.evidence(pages, "page_id", text, declared, F.col("url")), langid.LanguageRule())
    return out.withColumnRenamed("doc_id", "page_id")


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source"), MIX)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of the documents, a tenth of which are made periodic first."""
    docs = table(spark, sf_dir, "documents").withColumn("text", runs.with_planted_period("text", "doc_id"))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    milli = F.expr("strongest.length * 1000 div strongest.period")
    return runs.periodic_runs(docs, runs.RunRule(exponent=4, min_words=6)).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "strongest.start", "strongest.length", "strongest.period", milli.alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), quality.QualityRule())


def op13_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), resample.ResampleRule())


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_line_dedup": op2_line_dedup,
    "op3_suffix_array_dedup": op3_suffix_array_dedup,
    "op4_decontaminate": op4_decontaminate,
    "op5_html_text": op5_html_text,
    "op6_exact_topk": op6_exact_topk,
    "op7_token_counts": op7_token_counts,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_language_id": op9_language_id,
    "op10_mix_sources": op10_mix_sources,
    "language_id_pages": language_id_pages,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_quality": op12_quality,
    "op13_importance_resample": op13_importance_resample,
}
