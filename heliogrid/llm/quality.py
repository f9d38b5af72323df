"""Quality of texts: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader updates.

1. At most ``max_rows`` labelled rows, those with the smallest digest of their key, are the training sample. Tasks turn each into
   hashed runs of 1 to ``sizes`` words with the square roots of their counts, scaled to length 1, so that long and short texts
   weigh alike. A word is letters and digits in a row or other characters in a row; one equal to the word before is a mark.
2. One task goes through the sample ``epochs`` times, in an order drawn anew from the keys' digests, a row at a time: every bucket
   holds the sum of its squared gradients and the leader's gradient sum; a weight is the regularised leader given these, with a
   step of its own and zero below the l1 limit. The sample's order is Spark's sort, so the task holds one row and the buckets.
3. Every text gets the logistic function of the sparse dot product of its n-grams and the weights.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliogrid.llm.common import WordHashes, byte_chunks, id_text, mixed, random_words

CHUNK = 1 << 20
#: Letters and digits in a row, or other visible characters in a row.
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x00-\x20]+")
#: Hash that a word equal to the word before it is read as, so that stuttering is one feature whatever the word.
AGAIN = np.uint64(0xA5A5A5A5A5A5A5A5)


@dataclass(frozen=True)
class QualityRule:
    sizes: int = 2
    buckets_log2: int = 18
    max_rows: int = 20_000
    epochs: int = 5
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 0.1
    l2: float = 0.1
    threshold: float = 0.7


# ---------------------------------------------------------------- features


def counted(texts: list[bytes], rule: QualityRule, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, bucket, count) of the texts' distinct n-grams, sorted."""
    found = [WORD.findall(t) for t in texts]
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    word = hashes.of([w for f in found for w in f])
    owner = np.repeat(np.arange(len(texts)), sizes)
    again = np.append(False, (word[1:] == word[:-1]) & (owner[1:] == owner[:-1])) if len(word) else np.empty(0, bool)
    word = np.where(again, AGAIN, word)
    factors = random_words(rule.sizes, 61) | np.uint64(1)
    run, codes = np.zeros(len(word), np.uint64), []
    for size in range(1, rule.sizes + 1):
        n = len(word) - size + 1
        if n <= 0:
            break
        run = run[:n] + word[size - 1 :] * factors[size - 1]
        inside = owner[size - 1 :] == owner[:n]
        bucket = (mixed(run[inside]) >> np.uint64(64 - rule.buckets_log2)).astype(np.int64)
        codes.append(owner[:n][inside] << rule.buckets_log2 | bucket)
    code, n = np.unique(np.concatenate([np.empty(0, np.int64), *codes]), return_counts=True)
    return code >> rule.buckets_log2, code & ((1 << rule.buckets_log2) - 1), n


def grams(texts: list[bytes], rule: QualityRule, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, bucket, value) of the texts' distinct n-grams, sorted; the squared values of a text add up to 1."""
    owner, bucket, n = counted(texts, rule, hashes)
    return owner, bucket, np.sqrt(n / np.bincount(owner, n, minlength=len(texts))[owner])


def held_out(key: Column) -> Column:
    """Rows that no label is learned from: CRC-32 of the key as text is 2 modulo 4."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


# ---------------------------------------------------------------- training


class Leader:
    """State of the updates: for every bucket, and for the intercept in the last place, gradient sum and squared gradients."""

    def __init__(self, rule: QualityRule):
        self.rule = rule
        width = (1 << rule.buckets_log2) + 1
        self.z, self.n = np.zeros(width), np.zeros(width)
        self.l1 = np.full(width, rule.l1)
        self.l1[-1] = 0.0

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, rule = self.z[at], self.rule
        far = np.sign(z) * np.maximum(np.abs(z) - self.l1[at], 0.0)
        return -far / ((rule.beta + np.sqrt(self.n[at])) / rule.alpha + rule.l2)

    def learn(self, bucket: np.ndarray, value: np.ndarray, label: int) -> None:
        at, x = np.append(bucket, len(self.z) - 1), np.append(value, 1.0)
        w = self.weights(at)
        gradient = (1 / (1 + np.exp(-np.clip(float(w @ x), -30, 30))) - label) * x
        n = self.n[at]
        after = n + gradient**2
        self.z[at] += gradient - (np.sqrt(after) - np.sqrt(n)) / self.rule.alpha * w
        self.n[at] = after


def training_sample(docs: DataFrame, labels: DataFrame, rule: QualityRule) -> DataFrame:
    """(doc_id, text, label) of at most ``max_rows`` labelled keys; of several labels of a key the largest counts."""
    known = labels.where("doc_id is not null and label is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rule.max_rows)
    return docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")  # max_rows rows of two numbers


def hashed(sample: DataFrame, rule: QualityRule) -> DataFrame:
    """doc_id, label, and bucket numbers and counts (int32) of every sample row, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for part, texts in byte_chunks(batches, "text", CHUNK):
            owner, bucket, n = counted(texts.to_pylist(), rule, hashes)
            cut = np.searchsorted(owner, np.arange(len(texts) + 1))
            spans = list(zip(cut[:-1], cut[1:]))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("label"),
                 pa.array([bucket[a:b].astype(np.int32).tobytes() for a, b in spans], pa.binary()),
                 pa.array([n[a:b].astype(np.int32).tobytes() for a, b in spans], pa.binary())],
                names=["doc_id", "label", "bucket", "n"],
            )

    return sample.mapInArrow(run, "doc_id long, label int, bucket binary, n binary")


def fit(docs: DataFrame, labels: DataFrame, rule: QualityRule = QualityRule()) -> np.ndarray:
    """Weight of every bucket, the intercept last. docs: doc_id, text; labels: doc_id, label (0 or 1).

    Without labels of both classes no n-gram has a weight and the intercept gives the share of label 1.
    """
    width = (1 << rule.buckets_log2) + 1
    rows = hashed(training_sample(docs, labels, rule), rule)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, seen = Leader(rule), np.zeros(2, np.int64)
        for batch in batches:
            for label, bucket, packed in zip(*(batch.column(c).to_pylist() for c in ("label", "bucket", "n"))):
                n = np.frombuffer(packed, np.int32)
                leader.learn(np.frombuffer(bucket, np.int32), np.sqrt(n / max(n.sum(), 1)), label)
                seen[label] += 1
        if not seen.all():
            w = np.zeros(width)
            w[-1] = np.log((seen[1] + 0.5) / (seen[0] + 0.5))
        else:
            w = leader.weights()
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w[at])], names=["at", "w"])

    order = ["epoch", F.xxhash64("doc_id", "epoch"), "doc_id", "label", "bucket", "n"]
    stream = rows.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(rule.epochs))))
    stream = stream.repartition(1).sortWithinPartitions(*order).select("label", "bucket", "n")
    out = np.zeros(width)
    table = stream.mapInArrow(run, "at long, w double").toArrow()  # one number for each bucket at most
    out[table["at"].to_numpy()] = table["w"].to_numpy()
    return out


# ---------------------------------------------------------------- scores


def score(docs: DataFrame, weights: np.ndarray, rule: QualityRule = QualityRule()) -> DataFrame:
    """doc_id, score in [0, 1] of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for part, texts in byte_chunks(batches, "text", CHUNK):
            owner, bucket, value = grams(texts.to_pylist(), rule, hashes)
            total = np.bincount(owner, weights[bucket] * value, minlength=len(texts)) + weights[-1]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(total, -500, 500))))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def quality(
    docs: DataFrame, labels: DataFrame, rule: QualityRule = QualityRule(), key: str = "doc_id", text: str = "text", label: str = "quality"
) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``.

    Null, empty and blank texts get the score of a text without words, the intercept's. Labels other than 0 and 1 are ignored; rows without a
    key are scored and never learned from; repeated rows are learned from and scored each. Without labels of both classes all
    scores are the share of label 1. An empty table gives no rows.
    """
    rows = id_text(docs, key, text)
    known = labels.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("label")).where("label in (0, 1)")
    out = score(rows, fit(rows, known, rule), rule)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= rule.threshold).cast("int").alias("predicted"))
