"""Small helpers of the text operators: columns, chunks of an Arrow batch, hashes, written tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliogrid.session import new_shared_path

GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def id_text(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the key (long) and the text (string) under fixed names, whatever else the table holds."""
    return df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))


def written(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """The rows, written once as Parquet to the shared checkpoint folder: a cut of the lineage that outlives executors.

    ``narrow`` rows are a few numbers for some documents, so they are written by a sixteenth of the shuffle's tasks.
    """
    path = new_shared_path(df.sparkSession, name)
    few = max(8, shuffle_partitions(df.sparkSession) // 16)
    (df.coalesce(few) if narrow else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def as_bytes(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """UTF-8 bytes of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.binary()), b"")


def offsets_and_data(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than rows) and the byte buffer of a binary column, without a copy."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return at, np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)


def byte_chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """The rows of the batches in runs of about ``limit`` bytes of text (one row at least), with their bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        text = as_bytes(batch.column(column))
        at, _ = offsets_and_data(text)
        row = 0
        while row < batch.num_rows:
            end = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
            yield batch.slice(row, end - row), text.slice(row, end - row)
            row = end


def mixed(h: np.ndarray) -> np.ndarray:
    """Final mix of 64-bit hashes (splitmix)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def random_words(n: int, seed: int) -> np.ndarray:
    """n fixed 64-bit numbers for a seed."""
    return mixed((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(1 << 20)) * GOLDEN)


class WordHashes(dict):
    """64-bit hash of a word, remembered for the words of a task; forgets all when it holds ``most``."""

    most = 1 << 18

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def words_of(text: bytes) -> list[bytes]:
    """Runs of other bytes than ASCII white space, with A-Z lower-cased."""
    return text.lower().split()


def shingles(words: list[bytes], size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words; with fewer words, of the whole sequence; empty without words."""
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=size)], np.uint64)
    h = hashes.of(words)
    n = len(words) - size + 1
    run = np.zeros(n, np.uint64)
    for i, factor in enumerate(random_words(size, 7) | np.uint64(1)):
        run += h[i : i + n] * factor
    return np.unique(mixed(run))
