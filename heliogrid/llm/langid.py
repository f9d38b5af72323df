"""Language identification by fusing evidence: text, declared language, address suffix and host.

1. Declared languages name the classes; counts of hashed byte trigrams (letters lower-cased, all else one blank) over
   all rows that declare one of them give P(trigram | language). No row is sampled.
2. Every text gets its log-likelihood under each language and under 'und', for which all trigrams are alike.
3. Grouped counts of what the texts alone say give P(declared | language), P(language | suffix), smoothed towards
   P(language), and P(language | host), smoothed towards that of its suffix. A row's own vote is taken out of its host.
4. log P = tempered text likelihood + log P(declared | language) + log P(language | host).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliogrid.llm.common import byte_chunks, written

CHUNK = 1 << 20
UND = "und"

#: Every byte as the model reads it: letters and bytes beyond ASCII stay (A-Z lower-cased), all else is a blank.
LETTERS = np.full(256, 32, np.uint8)
LETTERS[128:] = np.arange(128, 256)
LETTERS[97:123] = LETTERS[65:91] = np.arange(97, 123)


@dataclass(frozen=True)
class LanguageRule:
    buckets_log2: int = 14
    alpha: float = 0.5  # added to every trigram count
    temper: float = 0.35  # overlapping trigrams aren't independent
    min_declared: int = 2  # rows that a declared value needs to be a language
    max_languages: int = 200  # the model is languages x buckets, whatever the data
    suffix_weight: float = 50.0  # rows that the level above counts as
    host_weight: float = 20.0
    und_prior: float = 1e-6
    min_confidence: float = 0.5
    languages: tuple[str, ...] = field(default=())  # accepted ones; empty: all

    @property
    def buckets(self) -> int:
        return 1 << self.buckets_log2


def trigrams(texts: pa.Array, rule: LanguageRule) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all trigrams of the texts, one after the other, and how many each text has (0 without letters)."""
    ends, raw = [], []
    for t in texts.to_pylist():
        raw.append(b" " + t + b" ")
        ends.append(len(raw[-1]))
    data = LETTERS[np.frombuffer(b"".join(raw), np.uint8)]
    owner = np.repeat(np.arange(len(raw)), ends)
    first = np.append(True, owner[1:] != owner[:-1])
    stay = (data != 32) | np.append(True, data[:-1] != 32) | first
    data, owner = data[stay].astype(np.uint32), owner[stay]
    if len(data) < 3:
        return np.empty(0, np.int64), np.zeros(len(raw), np.int64)
    inside = owner[2:] == owner[:-2]
    code = (data[:-2] << 16 | data[1:-1] << 8 | data[2:])[inside]
    bucket = (code * np.uint32(2654435761)) >> np.uint32(32 - rule.buckets_log2)
    return bucket.astype(np.int64), np.bincount(owner[:-2][inside], minlength=len(raw))


def primary(declared: Column) -> Column:
    """en from en-US; null and blank are ''."""
    return F.coalesce(F.lower(F.regexp_extract(F.trim(declared), r"^([A-Za-z]+)", 1)), F.lit(""))


def host_of(address: Column) -> Column:
    """Host of an address, or the address itself where it has no scheme."""
    return F.coalesce(F.lower(F.regexp_extract(address, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?#:]+)", 1)), F.lit(""))


def suffix_of(host: Column) -> Column:
    return F.regexp_extract(host, r"\.([^.]+)$", 1)


def evidence(df: DataFrame, key: str, text: Column, declared: Column, address: Column) -> DataFrame:
    """The columns that identify() reads."""
    rows = df.select(
        F.col(f"`{key}`").cast("long").alias("doc_id"), text.cast("string").alias("text"),
        primary(declared).alias("declared"), host_of(address).alias("host"),
    )
    return rows.withColumn("suffix", suffix_of(F.col("host")))


def _model(rows: DataFrame, names: list[str], rule: LanguageRule) -> np.ndarray:
    """log P(trigram | language), one row for each language and a last one for 'und'; its size is fixed by the rule."""
    place = {n: i for i, n in enumerate(names)}
    width = rule.buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(names) * width, np.int64)
        for part, texts in byte_chunks(batches, "text", CHUNK):
            bucket, n = trigrams(texts, rule)
            label = np.array([place[x] for x in part.column("declared").to_pylist()], np.int64)
            total += np.bincount(np.repeat(label, n) * width + bucket, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    counted = rows.where(F.col("declared").isin(names)).select("text", "declared").mapInArrow(run, "at long, n long")
    sums = counted.groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len(names) * width)
    counts[sums["at"].to_numpy()] = sums["n"].to_numpy()
    counts = counts.reshape(len(names), width) + rule.alpha
    known = np.log(counts / counts.sum(1, keepdims=True))
    return np.vstack([known, np.full((1, width), -np.log(width))]).astype(np.float32)


def _scored(rows: DataFrame, model: np.ndarray, rule: LanguageRule) -> DataFrame:
    """Adds fits (tempered log-likelihood by language, 'und' last) and n_trigrams, without the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in byte_chunks(batches, "text", CHUNK):
            bucket, n = trigrams(texts, rule)
            fits = np.zeros((len(n), len(model)))
            some = np.flatnonzero(n)
            if len(some):
                starts = np.concatenate([[0], np.cumsum(n[some])[:-1]])
                for i, logs in enumerate(model):
                    fits[some, i] = np.add.reduceat(logs[bucket], starts, dtype=np.float64)
            flat = pa.array((fits * rule.temper).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * len(model), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in ("doc_id", "declared", "host", "suffix")), lists, pa.array(n, pa.int64())],
                names=["doc_id", "declared", "host", "suffix", "fits", "n_trigrams"],
            )

    schema = "doc_id long, declared string, host string, suffix string, fits array<double>, n_trigrams long"
    return rows.select("doc_id", "declared", "host", "suffix", "text").mapInArrow(run, schema)


def _votes(rows: DataFrame, by: str, size: int) -> DataFrame:
    """(by, votes: how many texts each language has), for any number of groups."""
    return rows.groupBy(by).agg(F.array(*[F.sum((F.col("best") == i).cast("double")) for i in range(size)]).alias(f"{by}_votes"))


def _array(values: np.ndarray) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _log_each(values: Column) -> Column:
    return F.transform(values, lambda x: F.log(x))


def _smoothed(votes: Column, above: Column, weight: float) -> Column:
    total = F.aggregate(votes, F.lit(0.0), lambda s, x: s + x)
    return F.zip_with(votes, above, lambda n, p: (n + F.lit(weight) * p) / (total + F.lit(weight)))


def identify(rows: DataFrame, rule: LanguageRule = LanguageRule()) -> DataFrame:
    """doc_id, lang, confidence, text_lang, accepted, one row for each row of evidence().

    Rejected are texts without letters, texts that fit no language better than chance ('und'), a posterior below
    ``min_confidence``, and languages that aren't asked for. A null or blank declaration says nothing; rows
    without an address share the host ''. Repeated rows count as often as they are there. Without any declared language all rows are 'und';
    an empty table gives no rows.
    """
    declared = rows.groupBy("declared").agg(F.count("*").alias("n")).where((F.col("n") >= rule.min_declared) & (F.col("declared") != ""))
    names = sorted(r["declared"] for r in declared.orderBy(F.desc("n"), "declared").limit(rule.max_languages).collect())
    if not names:
        none = F.lit(None).cast("string")
        return rows.select("doc_id", F.lit(UND).alias("lang"), F.lit(1.0).alias("confidence"), none.alias("text_lang"), F.lit(False).alias("accepted"))
    size = len(names)
    scored = _scored(rows, _model(rows, names, rule), rule)
    known = F.slice("fits", 1, size)
    best = F.when(F.col("n_trigrams") > 0, F.array_position(known, F.array_max(known)).cast("int") - 1).otherwise(F.lit(-1))
    scored = written(scored.withColumn("best", best), "language-fits")
    voters = scored.where("best >= 0")
    # declared values are the languages, '' and others: at most (size + 2) x size counts
    said = F.when(F.col("declared").isin([*names, ""]), F.col("declared")).otherwise(F.lit("*"))
    table = {(r["said"], r["best"]): r["n"] for r in voters.groupBy(said.alias("said"), "best").agg(F.count("*").alias("n")).collect()}
    values = [*names, "", "*"]
    counts = np.array([[table.get((v, i), 0) + 1.0 for i in range(size)] for v in values])
    overall = counts.sum(0) / counts.sum()
    given = np.log(counts / counts.sum(0))
    unknown = np.log(counts.sum(1) / counts.sum())  # what 'und' texts declare: as any row does
    given[-2], unknown[-2] = 0.0, 0.0  # nothing declared says nothing
    says = F.create_map(*[x for v, g, u in zip(values, given, unknown) for x in (F.lit(v), _array(np.append(g, u)))])
    suffixes = _votes(voters, "suffix", size).withColumn("suffix_prior", _smoothed(F.col("suffix_votes"), _array(overall), rule.suffix_weight))
    hosts = _votes(voters.withColumn("host_suffix", F.struct("host", "suffix")), "host_suffix", size)
    hosts = hosts.select("host_suffix.host", "host_suffix.suffix", F.col("host_suffix_votes").alias("host_votes"))
    hosts = hosts.join(suffixes.select("suffix", "suffix_prior"), "suffix").drop("suffix")
    joined = scored.join(hosts, "host", "left")
    own = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (i == F.col("best")).cast("double"))
    others = F.zip_with(F.coalesce("host_votes", _array(np.zeros(size))), own, lambda n, o: F.greatest(n - o, F.lit(0.0)))
    prior = _smoothed(others, F.coalesce("suffix_prior", _array(overall)), rule.host_weight)
    prior = F.concat(F.transform(prior, lambda p: p * F.lit(1 - rule.und_prior)), F.array(F.lit(rule.und_prior)))
    joined = joined.withColumn("prior", prior).withColumn("says", F.element_at(says, said))
    logs = F.zip_with(F.zip_with("fits", "says", lambda a, b: a + b), _log_each(F.col("prior")), lambda a, b: a + b)
    joined = joined.withColumn("logs", logs).withColumn("top", F.array_max("logs"))
    total = F.aggregate("logs", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("top")))
    labels = F.array(*[F.lit(n) for n in [*names, UND]])
    at = F.array_position("logs", F.col("top")).cast("int")
    lang = F.when(F.col("n_trigrams") > 0, F.element_at(labels, at)).otherwise(F.lit(UND))
    out = joined.select(
        "doc_id", lang.alias("lang"), (F.lit(1.0) / total).alias("confidence"),
        F.when(F.col("best") >= 0, F.element_at(labels, F.col("best") + 1)).alias("text_lang"),
    )
    wanted = F.col("lang") != UND
    if rule.languages:
        wanted &= F.col("lang").isin(list(rule.languages))
    return out.withColumn("accepted", wanted & (F.col("confidence") >= rule.min_confidence))
