"""Toxicity by a linear classifier on character n-grams that are scaled by naive Bayes log-count ratios.

1. At most ``max_rows`` labelled rows, those with the smallest digest of their key, are the training sample; the bound
   makes the sample small enough to travel, so no text is shuffled.
2. Tasks count in how many sample texts of each class every hashed n-gram is: r = log of the ratio of its smoothed shares.
   The ``features`` n-grams that tell most about the class (likelihood ratio statistic) are kept.
3. A logistic regression is fitted to presence times r, with a ridge penalty, on the sample's kept n-grams.
4. Every text gets the logistic function of the sum of its distinct kept n-grams' weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliogrid.llm.common import byte_chunks, id_text, mixed, random_words

CHUNK = 1 << 20

#: Bytes as the model reads them: A-Z lower-cased, ASCII white space one blank.
FOLDED = np.arange(256, dtype=np.uint8)
FOLDED[65:91] = np.arange(97, 123)
FOLDED[9:14] = 32


@dataclass(frozen=True)
class ToxicityRule:
    sizes: tuple[int, ...] = (3, 4, 5, 6)
    buckets_log2: int = 20
    max_rows: int = 20_000
    features: int = 4_000
    alpha: float = 1.0
    penalty: float = 0.1
    steps: int = 300


@dataclass(frozen=True)
class Model:
    """Weight of every kept n-gram bucket, and the weight of an empty text."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: float


def grams(texts: list[bytes], rule: ToxicityRule) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, bucket) of all n-grams of the texts, one size after the other; blanks stand at both ends."""
    data = FOLDED[np.frombuffer(b"".join(b" " + t + b" " for t in texts), np.uint8)]
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), [len(t) + 2 for t in texts])
    stay = (data != 32) | np.append(True, (data[:-1] != 32) | (owner[1:] != owner[:-1]))
    data, owner = data[stay], owner[stay]
    value = random_words(256, 53)[data]
    factors = random_words(max(rule.sizes), 59) | np.uint64(1)
    run, done = np.zeros(0, np.uint64), 0
    for size in sorted(rule.sizes):
        n = len(data) - size + 1
        if n <= 0:
            return
        run = run[:n] if done else np.zeros(n, np.uint64)
        for i in range(done, size):
            run = run + value[i : i + n] * factors[i]
        done = size
        inside = owner[size - 1 :] == owner[:n]
        yield owner[:n][inside], (mixed(run[inside]) >> np.uint64(64 - rule.buckets_log2)).astype(np.int64)


def distinct_grams(texts: list[bytes], rule: ToxicityRule, kept: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text number, bucket), sorted; only the buckets that ``kept`` marks."""
    codes = []
    for owner, bucket in grams(texts, rule):
        if kept is not None:
            some = kept[bucket]
            owner, bucket = owner[some], bucket[some]
        codes.append(np.unique(owner << rule.buckets_log2 | bucket))
    code = np.unique(np.concatenate(codes)) if codes else np.empty(0, np.int64)
    return code >> rule.buckets_log2, code & ((1 << rule.buckets_log2) - 1)


def held_out(key: Column) -> Column:
    """Rows that no label is learned from: CRC-32 of the key as text divisible by 5."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, rule: ToxicityRule) -> DataFrame:
    """(text, label) of at most ``max_rows`` labelled rows; of several labels of a key the largest counts."""
    known = labels.where("doc_id is not null and label is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rule.max_rows)
    return docs.join(F.broadcast(chosen), "doc_id").select("text", "label")  # max_rows rows of two numbers


def _counted(sample: DataFrame, rule: ToxicityRule) -> tuple[np.ndarray, np.ndarray]:
    """Texts of each class that hold each bucket (2 x buckets), and texts of each class."""
    width = 1 << rule.buckets_log2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, texts_of = np.zeros(2 * width, np.int64), np.zeros(2, np.int64)
        for part, texts in byte_chunks(batches, "text", CHUNK):
            label = part.column("label").to_numpy(zero_copy_only=False).astype(np.int64)
            owner, bucket = distinct_grams(texts.to_pylist(), rule)
            total += np.bincount(label[owner] * width + bucket, minlength=2 * width)
            texts_of += np.bincount(label, minlength=2)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([at, [2 * width, 2 * width + 1]])), pa.array(np.concatenate([total[at], texts_of]))], names=["at", "n"]
        )

    # two counts for each bucket, whatever the data
    sums = sample.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(2 * width + 2)
    counts[sums["at"].to_numpy()] = sums["n"].to_numpy()
    return counts[:-2].reshape(2, width), counts[-2:]


def log_count_ratios(counts: np.ndarray, texts: np.ndarray, rule: ToxicityRule) -> tuple[np.ndarray, np.ndarray]:
    """r of every bucket, and the likelihood ratio statistic of its presence and the class."""
    share = (counts + rule.alpha) / (texts[:, None] + 2 * rule.alpha)
    r = np.log(share[1] / share[0])
    every = share * (texts[:, None] / max(texts.sum(), 1))
    both = every.sum(0)
    with np.errstate(divide="ignore", invalid="ignore"):
        told = texts[:, None] * (share * np.log(share / both) + (1 - share) * np.log((1 - share) / (1 - both)))
    return r, np.nan_to_num(told).sum(0)


def fit_logistic(row: np.ndarray, column: np.ndarray, value: np.ndarray, label: np.ndarray, width: int, rule: ToxicityRule) -> tuple[np.ndarray, float]:
    """Ridge logistic regression of sparse rows by accelerated gradient steps; the intercept has no penalty."""
    n = len(label)
    mean = np.clip(label.mean(), 1e-3, 1 - 1e-3)
    w, bias = np.zeros(width), float(np.log(mean / (1 - mean)))
    # the largest squared row norm bounds the curvature
    norm = np.bincount(row, value**2, minlength=n)
    rate_bound = 0.25 * max(float(_largest_eigenvalue(row, column, value, n, width)), 1e-9) + rule.penalty
    momentum, last, last_bias = 1.0, w.copy(), bias
    at, at_bias = w.copy(), bias
    for _ in range(rule.steps):
        score = np.bincount(row, value * at[column], minlength=n) + at_bias
        error = 1 / (1 + np.exp(-score)) - label
        w = at - (np.bincount(column, value * error[row], minlength=width) + rule.penalty * at) / rate_bound
        bias = at_bias - float(error.sum()) / max(0.25 * n, norm.size and 1.0)
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        at = w + (momentum - 1) / following * (w - last)
        at_bias = bias + (momentum - 1) / following * (bias - last_bias)
        last, last_bias, momentum = w, bias, following
    return w, bias


def _largest_eigenvalue(row: np.ndarray, column: np.ndarray, value: np.ndarray, n: int, width: int) -> float:
    v = np.ones(width) / np.sqrt(max(width, 1))
    size = 0.0
    for _ in range(20):
        u = np.bincount(column, value * np.bincount(row, value * v[column], minlength=n)[row], minlength=width)
        size = float(np.linalg.norm(u))
        if not size:
            break
        v = u / size
    return size * 1.05


def fit(docs: DataFrame, labels: DataFrame, rule: ToxicityRule = ToxicityRule()) -> Model:
    """docs: doc_id, text; labels: doc_id, label (0 or 1). Without labels of both classes no n-gram has a weight."""
    sample = training_sample(docs, labels, rule)
    counts, texts = _counted(sample, rule)
    if not texts.all():
        mean = (texts[1] + 0.5) / (texts.sum() + 1)
        return Model(np.empty(0, np.int64), np.empty(0), float(np.log(mean / (1 - mean))))
    r, told = log_count_ratios(counts, texts, rule)
    chosen = np.sort(np.argsort(-told, kind="stable")[: rule.features])
    chosen = chosen[told[chosen] > 0]
    kept = np.zeros(1 << rule.buckets_log2, bool)
    kept[chosen] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in byte_chunks(batches, "text", CHUNK):
            owner, bucket = distinct_grams(texts.to_pylist(), rule, kept)
            held = np.searchsorted(chosen, bucket).astype(np.int32)
            ends = np.cumsum(np.bincount(owner, minlength=len(texts)))
            packs = [held[s:e].tobytes() for s, e in zip(np.append(0, ends), ends)]
            yield pa.RecordBatch.from_arrays([part.column("label").cast(pa.int64()), pa.array(packs, pa.binary())], names=["label", "held"])

    rows = sample.mapInArrow(run, "label long, held binary").collect()  # max_rows rows
    rows.sort(key=lambda x: (x["label"], x["held"]))  # the sums below don't depend on the tasks' order
    held = [np.frombuffer(x["held"], np.int32) for x in rows]
    row = np.repeat(np.arange(len(held)), [len(h) for h in held])
    column = np.concatenate(held).astype(np.int64)
    label = np.array([x["label"] for x in rows], float)
    w, bias = fit_logistic(row, column, r[chosen][column], label, len(chosen), rule)
    return Model(chosen, w * r[chosen], bias)


def score(docs: DataFrame, model: Model, rule: ToxicityRule = ToxicityRule()) -> DataFrame:
    """doc_id, score in [0, 1] of every row."""
    weight = np.zeros(1 << rule.buckets_log2)
    weight[model.buckets] = model.weights
    kept = weight != 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in byte_chunks(batches, "text", CHUNK):
            owner, bucket = distinct_grams(texts.to_pylist(), rule, kept)
            total = np.bincount(owner, weight[bucket], minlength=len(texts)) + model.bias
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(total, -500, 500))))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def toxicity(
    docs: DataFrame, labels: DataFrame, rule: ToxicityRule = ToxicityRule(), key: str = "doc_id", text: str = "text", label: str = "toxic"
) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``.

    Null and empty texts get the score of a text without n-grams that count. Labels other than 0 and 1 are ignored;
    rows without a key are scored and never learned from; repeated rows are scored each. Without labels of both classes the
    score is the share of label 1. An empty table gives no rows.
    """
    rows = id_text(docs, key, text)
    known = labels.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("label")).where("label in (0, 1)")
    out = score(rows, fit(rows, known, rule), rule)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
