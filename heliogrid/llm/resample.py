"""Resampling of documents towards a target collection: importance weights, Gumbel scores, exact selection of the largest.

1. Tasks count the hashed 1- to ``sizes``-word runs of the documents and of the target texts; a bucket's gain is the scaled
   log of the ratio of its two smoothed shares. The counts are ``buckets`` numbers for each table, whatever its size.
2. A document's weight is the sum of gains over its runs, looked up in one array; its score adds Gumbel noise, a function
   of seed and key, so that the largest scores are a draw without replacement in proportion to the exponentials.
3. The cutoff score is selected, not sorted for: every task reports the median of its remaining keys and their number; the
   median of the medians, weighted by those numbers, has at least a quarter of all remaining keys on either side, so
   every round discards a quarter at least. Remaining keys are written anew when they have shrunk fourfold.
4. Only the winners are sorted: dealt by ranges, numbered in the range, and moved on by the sizes of the ranges before.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliogrid.llm.common import byte_chunks, id_text, written

CHUNK = 1 << 20
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Appended lengths with a table of their own; longer ones are rare and go one by one.
TABLES = 64
#: Place of rows without a key: after all keys.
LAST = np.iinfo(np.int64).max


@dataclass(frozen=True)
class ResampleRule:
    sizes: int = 3
    buckets: int = 10_000
    scale: int = 1_000
    seed: int = 42
    percent: int = 5
    min_words: int = 20


# ---------------------------------------------------------------- features


@cache
def _zero_tables() -> np.ndarray:
    """[length, byte place, byte]: what a CRC-32 becomes when ``length`` zero bytes follow, by its four bytes."""
    out = np.zeros((TABLES + 1, 4, 256), np.uint32)
    for length in range(1, TABLES + 1):
        zeros = bytes(length)
        none = zlib.crc32(zeros)
        for bit in range(32):
            place, low = divmod(bit, 8)
            moved = zlib.crc32(zeros, 1 << bit) ^ none
            out[length, place, 1 << low : 2 << low] = out[length, place, : 1 << low] ^ np.uint32(moved)
    return out


def _appended(crc: np.ndarray, words: np.ndarray, vocabulary: list[bytes], spaced: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of what has ``crc``, a blank and a word: CRC-32 is linear, so it is the moved one xor that of the new bytes."""
    n = length[words]
    short = np.minimum(n, TABLES)
    tables = _zero_tables()
    out = spaced[words]
    for place in range(4):
        out = out ^ tables[short, place, (crc >> np.uint32(8 * place)) & np.uint32(255)]
    for i in np.flatnonzero(n > TABLES):
        out[i] = zlib.crc32(b" " + vocabulary[words[i]], int(crc[i]))
    return out


def features(texts: list[bytes], rule: ResampleRule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, bucket) of all word runs, repeats included, and the number of words of every text."""
    numbers: dict[bytes, int] = {}
    fresh = count()
    ids, n_words = [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = WORD.findall(text.lower())
        n_words[i] = len(words)
        for word in words:
            at = numbers.get(word)
            if at is None:
                at = numbers[word] = next(fresh)
            ids.append(at)
    words = np.array(ids, np.int64)
    owner = np.repeat(np.arange(len(texts)), n_words)
    vocabulary = list(numbers)
    plain = np.fromiter(map(zlib.crc32, vocabulary), np.uint32, len(vocabulary))
    blank = zlib.crc32(b" ")
    spaced = np.fromiter((zlib.crc32(w, blank) for w in vocabulary), np.uint32, len(vocabulary))
    length = np.fromiter((len(w) + 1 for w in vocabulary), np.int64, len(vocabulary))
    owners, buckets = [], []
    crc = plain[words]
    for size in range(1, rule.sizes + 1):
        if size > 1:
            crc = _appended(crc[:-1], words[size - 1 :], vocabulary, spaced, length)
        if not len(crc):
            break
        inside = owner[size - 1 :] == owner[: len(crc)]
        owners.append(owner[: len(crc)][inside])
        buckets.append((crc[inside] % np.uint32(rule.buckets)).astype(np.int64))
    if not owners:
        return np.empty(0, np.int64), np.empty(0, np.int64), n_words
    return np.concatenate(owners), np.concatenate(buckets), n_words


def bucket_counts(texts: DataFrame, rule: ResampleRule) -> np.ndarray:
    """Word runs in every bucket, over all rows of ``texts`` (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(rule.buckets, np.int64)
        for _, part in byte_chunks(batches, "text", CHUNK):
            total += np.bincount(features(part.to_pylist(), rule)[1], minlength=rule.buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    # one number for each bucket, whatever the data
    sums = texts.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(rule.buckets, np.int64)
    out[sums["bucket"].to_numpy()] = sums["n"].to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray, rule: ResampleRule) -> np.ndarray:
    """floor(scale * ln(share of the target / share of the corpus)) of every bucket, each count one more than found."""
    up = (target + 1.0) * (float(corpus.sum()) + rule.buckets)
    down = (corpus + 1.0) * (float(target.sum()) + rule.buckets)
    return np.floor(rule.scale * np.log(up / down)).astype(np.int64)


def gumbel(key: Column, rule: ResampleRule) -> Column:
    """floor(scale * Gumbel noise) of a key; without a key that of the seed alone."""
    text = F.concat(F.lit(f"{rule.seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-float(rule.scale) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def weighted(docs: DataFrame, gain: np.ndarray, rule: ResampleRule) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in byte_chunks(batches, "text", CHUNK):
            owner, bucket, n_words = features(texts.to_pylist(), rule)
            size = np.bincount(owner, minlength=len(texts))
            # gains are whole numbers far below 2^53 in sum, so the doubles are exact
            weight = np.bincount(owner, gain[bucket], minlength=len(texts)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n_words), pa.array(size), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"]
            )

    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")
    return out.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), rule))


# ---------------------------------------------------------------- selection


@dataclass(frozen=True)
class Key:
    """Place of a row: larger scores first, ties by smaller key."""

    score: int
    doc_id: int

    def before(self, score: np.ndarray, doc_id: np.ndarray) -> np.ndarray:
        """Which keys stand before this one."""
        return (score > self.score) | ((score == self.score) & (doc_id < self.doc_id))

    def equal(self, score: np.ndarray, doc_id: np.ndarray) -> np.ndarray:
        return (score == self.score) & (doc_id == self.doc_id)

    def order(self) -> tuple[int, int]:
        return -self.score, self.doc_id


SIDES = ("before", "equal", "after")
REPORT = "side int, n long, score long, doc_id long"


def _median(score: np.ndarray, doc_id: np.ndarray) -> tuple[int, int]:
    at = np.lexsort((doc_id, -score))[(len(score) - 1) // 2]
    return int(score[at]), int(doc_id[at])


def _reports(keys: DataFrame, low: Key | None, high: Key | None, pivot: Key | None) -> list:
    """Of every task and side of ``pivot``: how many keys lie strictly between the bounds, and their median.

    Three rows a task at most. A task holds its remaining keys, 16 bytes each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores, ids = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for batch in batches:
            s = batch.column("score").to_numpy(zero_copy_only=False)
            d = batch.column("doc_id").to_numpy(zero_copy_only=False)
            stay = np.ones(len(s), bool)
            if high is not None:
                stay &= high.before(s, d)
            if low is not None:
                stay &= ~low.before(s, d) & ~low.equal(s, d)
            scores.append(s[stay])
            ids.append(d[stay])
        s, d = np.concatenate(scores), np.concatenate(ids)
        parts = [np.ones(len(s), bool)]
        if pivot is not None:
            parts = [pivot.before(s, d), pivot.equal(s, d)]
            parts.append(~parts[0] & ~parts[1])
        rows = [(i, int(p.sum()), *_median(s[p], d[p])) for i, p in enumerate(parts) if p.any()]
        yield pa.RecordBatch.from_pylist(
            [dict(zip(("side", "n", "score", "doc_id"), r)) for r in rows],
            schema=pa.schema([("side", pa.int32()), ("n", pa.int64()), ("score", pa.int64()), ("doc_id", pa.int64())]),
        )

    return keys.mapInArrow(run, REPORT).collect()


def _weighted_median(reports: list) -> Key:
    reports = sorted(reports, key=lambda r: (-r["score"], r["doc_id"]))
    half, seen = sum(r["n"] for r in reports) / 2, 0
    for r in reports:
        seen += r["n"]
        if seen >= half:
            break
    return Key(r["score"], r["doc_id"])


def cutoff(keys: DataFrame, k: int) -> Key:
    """The k-th key (from 1) of ``keys`` (score, doc_id), which has at least k rows, in the order of ``Key``."""
    low = high = None
    reports = _reports(keys, None, None, None)
    total = sum(r["n"] for r in reports)
    pivot = _weighted_median(reports)
    while True:
        reports = _reports(keys, low, high, pivot)
        sizes = [sum(r["n"] for r in reports if r["side"] == i) for i in range(len(SIDES))]
        if sizes[0] < k <= sizes[0] + sizes[1]:
            return pivot
        if k <= sizes[0]:
            side, high = 0, pivot
        else:
            side, low, k = 2, pivot, k - sizes[0] - sizes[1]
        pivot = _weighted_median([r for r in reports if r["side"] == side])
        if 4 * sizes[side] <= total:
            total = sizes[side]
            keys = written(_between(keys, low, high), "remaining")
            low = high = None


def _between(keys: DataFrame, low: Key | None, high: Key | None) -> DataFrame:
    if high is not None:
        keys = keys.where((F.col("score") > high.score) | ((F.col("score") == high.score) & (F.col("doc_id") < high.doc_id)))
    if low is not None:
        keys = keys.where((F.col("score") < low.score) | ((F.col("score") == low.score) & (F.col("doc_id") > low.doc_id)))
    return keys


def ranked(winners: DataFrame) -> DataFrame:
    """``winners`` with rank, by score (descending), key, and the other numbers for repeated keys."""
    order = [F.desc("score"), F.asc("place"), F.asc("n_features"), F.asc("weight"), F.asc("n_words")]
    sorted_rows = winners.repartitionByRange(*order).sortWithinPartitions(*order)
    names = sorted_rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            numbers = [pa.array(np.full(n, part, np.int64)), pa.array(np.arange(at + 1, at + n + 1))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *numbers], names=[*names, "range", "at"])
            at += n

    schema = ", ".join(f"{n} long" for n in [*names, "range", "at"])
    placed = written(sorted_rows.mapInArrow(run, schema), "winners")
    sizes = sorted((r["range"], r["n"]) for r in placed.groupBy("range").agg(F.count("*").alias("n")).collect())  # one row a task
    if not sizes:
        return placed.withColumn("rank", F.lit(None).cast("long"))
    offsets, seen = [], 0
    for part, n in sizes:
        offsets.append((part, seen))
        seen += n
    starts = winners.sparkSession.createDataFrame(offsets, "range long, seen long")
    return placed.join(F.broadcast(starts), "range").withColumn("rank", F.col("at") + F.col("seen"))


def resample(docs: DataFrame, target: DataFrame, rule: ResampleRule = ResampleRule(), key: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of ``docs``; rank is null for rows that aren't drawn.

    Words are runs of digits, a-z and non-ASCII characters, with A-Z lower-cased. Null and empty texts have no features and
    weight 0; with ``min_words`` above 0 they are never drawn. An empty target shares nothing: its shares are all equal. Repeated rows
    are documents of their own, next to each other in rank. Rows without a key get the noise of the seed alone and stand after all
    keys of the same score. An empty table gives no rows; a share below one row draws none.
    """
    rows = id_text(docs, key, text)
    goal = target.select(F.col(f"`{target_text}`").cast("string").alias("text"))
    gain = gains(bucket_counts(rows, rule), bucket_counts(goal, rule), rule)
    scored = written(weighted(rows, gain, rule), "weighted").withColumn("place", F.coalesce("doc_id", F.lit(int(LAST))))
    able = scored.where(F.col("n_words") >= rule.min_words)
    drawn = rule.percent * able.count() // 100
    out = ["doc_id", "n_features", "weight", "score"]
    if not drawn:
        return scored.select(*out, F.lit(None).cast("long").alias("rank"))
    last = cutoff(able.select("score", F.col("place").alias("doc_id")), drawn)
    wins = (F.col("n_words") >= rule.min_words) & ((F.col("score") > last.score) | ((F.col("score") == last.score) & (F.col("place") <= last.doc_id)))
    winners = ranked(scored.where(wins)).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return winners.select(*out, "rank").unionAll(scored.where(~wins).select(*out, F.lit(None).cast("long").alias("rank")))
