"""Line deduplication by a sharded minimal perfect hash over the distinct line hashes of the corpus.

A line's key is the line without ASCII white space at both ends, with A-Z lower-cased; keys shorter than ``min_chars``
code points are ignored. Lines whose key is in at least ``min_docs`` documents go, except in the largest document id
that holds the key.

1. Spark counts, for every distinct 64-bit key hash, the documents that hold it, and the largest of their ids. A hash
   held by a third of all documents is one row a task after the map-side combine.
2. Hashes are dealt into shards by their upper bits, enough shards that each holds about ``SHARD`` keys. Every shard
   becomes a minimal perfect hash (levels of bit vectors, a key stays in the first level where it meets no other) that
   indexes compact arrays: 32-bit fingerprint, saturated 32-bit document count, 64-bit last document.
3. Documents send packed (hash, document) probes to the shards; a shard's partition streams its index first, then the
   probes, and answers only those whose lines go. No line is joined with a line, and no shard is broadcast. A shard that gets
   more than ``PROBES`` probes, as the one of a line that a third of the documents hold, is a few megabytes of index; copies of it share
   the probes.
4. Answers, gathered by document, meet the texts once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heliogrid.llm.common import byte_chunks, id_text, mixed, random_words, shuffle_partitions, written

CHUNK = 1 << 22
SHARD = 1 << 17  # keys of a shard, about
PROBES = 1 << 21  # probes of a copy of a shard, about (32 MB)
LEVELS = 24
LOAD = 2  # bits of a level for each key that reaches it
WHITE = b" \t\n\r\x0b\x0c"
POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)


@dataclass(frozen=True)
class LineRule:
    min_chars: int = 40
    min_docs: int = 5


def line_key(line: bytes) -> bytes:
    return line.strip(WHITE).lower()


def code_points(key: bytes) -> int:
    return len(key) if key.isascii() else len(key.decode("utf-8", "replace"))


def key_hash(line: bytes, rule: LineRule) -> int | None:
    """64-bit hash of a line's key; None for a key that is too short to count."""
    key = line_key(line)
    if len(key) < rule.min_chars or code_points(key) < rule.min_chars:
        return None
    return xxhash.xxh3_64_intdigest(key)


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: bit vectors by level, and the number of bits before every byte."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, rest: np.ndarray) -> None:
        self.sizes, self.bits, self.rest = sizes, bits, rest  # sizes in bytes; rest: sorted keys beyond the last level
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        self.before = np.concatenate([[0], np.cumsum(POPCOUNT[bits], dtype=np.int64)])

    @staticmethod
    def place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mixed(keys ^ random_words(1, 101 + level)[0]) % np.uint64(size * 8)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, bits = [], []
        for level in range(LEVELS):
            if not len(keys):
                break
            size = (len(keys) * LOAD + 7) // 8
            at = cls.place(keys, level, size)
            alone = np.bincount(at, minlength=size * 8) == 1
            bits.append(np.packbits(alone, bitorder="little"))
            sizes.append(size)
            keys = keys[~alone[at]]
        return cls(np.array(sizes, np.int64), np.concatenate(bits) if bits else np.empty(0, np.uint8), np.sort(keys))

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Place of every key, 0 to n - 1; for keys that weren't built in, any place or -1."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            at = self.place(keys[left], level, int(size))
            byte = self.starts[level] + (at >> 3)
            held, bit = self.bits[byte], at & 7
            hit = (held >> bit) & 1 == 1
            below = held[hit] & ((1 << bit[hit]) - 1).astype(np.uint8)
            out[left[hit]] = self.before[byte[hit]] + POPCOUNT[below]
            left = left[~hit]
        if len(left) and len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, keys[left]), len(self.rest) - 1)
            there = self.rest[at] == keys[left]
            out[left[there]] = self.before[-1] + at[there]
        return out


class LineIndex:
    """Fingerprint, count and last document of every key of a shard, addressed by its perfect hash."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, last: np.ndarray) -> None:
        self.hash = PerfectHash.build(keys)
        at = self.hash.index(keys)
        self.prints, self.counts, self.last = np.empty(len(keys), np.uint32), np.empty(len(keys), np.uint32), np.empty(len(keys), np.int64)
        self.prints[at] = self.fingerprint(keys)
        self.counts[at] = np.minimum(counts, 2**32 - 1)
        self.last[at] = last

    @staticmethod
    def fingerprint(keys: np.ndarray) -> np.ndarray:
        return (mixed(keys + np.uint64(1)) >> np.uint64(32)).astype(np.uint32)

    def probe(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Document count and last document of every key; count 0 for a key that isn't there."""
        if not len(self.prints):
            return np.zeros(len(keys), np.uint32), np.zeros(len(keys), np.int64)
        at = self.hash.index(keys)
        there = (at >= 0) & (self.prints[at] == self.fingerprint(keys))
        return np.where(there, self.counts[at], 0), self.last[at]


def _doc_hashes(texts: list[bytes], rule: LineRule) -> list[np.ndarray]:
    return [
        np.array(sorted({h for line in text.split(b"\n") if (h := key_hash(line, rule)) is not None}), np.uint64)
        if len(text) >= rule.min_chars
        else np.empty(0, np.uint64)
        for text in texts
    ]


def line_hashes(docs: DataFrame, rule: LineRule) -> DataFrame:
    """(h, doc_id): one row for each row and distinct line key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in byte_chunks(batches, "text", CHUNK):
            sets = _doc_hashes(texts.to_pylist(), rule)
            ids = rows.column("doc_id").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(sets).view(np.int64)), pa.array(np.repeat(ids, [len(s) for s in sets]), pa.int64())],
                names=["h", "doc_id"],
            )

    return docs.where("doc_id is not null").mapInArrow(run, "h long, doc_id long")


def _shard(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _copies(table: DataFrame, shards: int) -> dict[int, int]:
    """Copies of the shards that need more than one, by the probes that the counted documents will send."""
    high = F.shiftrightunsigned("h", 32)
    # the upper 32 bits times the shards stay below 2^63 for fewer than 2^31 shards
    shard = F.shiftrightunsigned(high * F.lit(shards).cast("long"), 32)
    sizes = table.groupBy(shard.alias("shard")).agg(F.ceil(F.sum("n_docs") / PROBES).cast("long").alias("copies"))
    return {r["shard"]: r["copies"] for r in sizes.where("copies > 1").collect()}  # one row a shard at most


def _packed_keys(table: DataFrame, shards: int, copies: dict[int, int]) -> DataFrame:
    """(shard, copy, kind 0, a: hashes, b: counts, c: last documents), packed by task and shard, for every copy of the shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, n, last = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("h", "n_docs", "last_doc"))
            pack = _by_shard(0, 0, shards, h.view(np.uint64), n.astype(np.int64), last)
            yield pack
            shard = pack.column("shard").to_numpy()
            for copy in range(1, max([copies.get(x, 1) for x in shard.tolist()], default=1)):
                more = pack.filter(pa.array([copies.get(x, 1) > copy for x in shard.tolist()], pa.bool_()))
                yield more.set_column(1, "copy", pa.array([copy] * more.num_rows, pa.int64()))

    return table.mapInArrow(run, PACKED)


PACKED = "shard long, copy long, kind int, a binary, b binary, c binary"


def _by_shard(kind: int, copy: int, shards: int, h: np.ndarray, *values: np.ndarray) -> pa.RecordBatch:
    shard = _shard(h, shards)
    order = np.argsort(shard, kind="stable")
    at, starts = np.unique(shard[order], return_index=True)
    ends = np.append(starts[1:], len(h))
    columns = [h[order], *(v[order] for v in values)]
    packs = [pa.array([c[s:e].tobytes() for s, e in zip(starts, ends)], pa.binary()) for c in columns]
    packs += [pa.nulls(len(at), pa.binary())] * (3 - len(packs))
    fixed = [pa.array(at), pa.array([copy] * len(at), pa.int64()), pa.array([kind] * len(at), pa.int32())]
    return pa.RecordBatch.from_arrays([*fixed, *packs], schema=PACKED_SCHEMA)


PACKED_SCHEMA = pa.schema(
    [("shard", pa.int64()), ("copy", pa.int64()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())]
)


def _packed_probes(docs: DataFrame, shards: int, copies: dict[int, int], rule: LineRule) -> DataFrame:
    """(shard, copy, kind 1, a: hashes, b: documents) of the documents' distinct keys; packs take turns at the copies of a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = TaskContext.get().partitionId()
        for rows, texts in byte_chunks(batches, "text", CHUNK * 4):
            sets = _doc_hashes(texts.to_pylist(), rule)
            ids = rows.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            pack = _by_shard(1, 0, shards, np.concatenate(sets), np.repeat(ids, [len(s) for s in sets]))
            yield pack.set_column(1, "copy", pa.array([turn % copies.get(x, 1) for x in pack.column("shard").to_pylist()], pa.int64()))
            turn += 1

    return docs.where("doc_id is not null").mapInArrow(run, PACKED)


def _answers(packed: DataFrame, rule: LineRule) -> DataFrame:
    """(doc_id, h) of keys whose lines go; a partition holds whole copies of shards, the keys before the probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, keys, index = None, [], None
        for batch in batches:
            for row in batch.to_pylist():
                if (row["shard"], row["copy"]) != shard:
                    shard, keys, index = (row["shard"], row["copy"]), [], None
                a = np.frombuffer(row["a"], np.uint64)
                b = np.frombuffer(row["b"], np.int64)
                if row["kind"] == 0:
                    keys.append((a, b, np.frombuffer(row["c"], np.int64)))
                    continue
                if index is None:
                    index = LineIndex(*(np.concatenate(x) for x in zip(*keys)))
                    keys = []
                counts, last = index.probe(a)
                go = (counts >= rule.min_docs) & (last != b)
                if go.any():
                    yield pa.RecordBatch.from_arrays([pa.array(b[go]), pa.array(a[go].view(np.int64))], names=["doc_id", "h"])

    return packed.mapInArrow(run, "doc_id long, h long")


def dropped_keys(docs: DataFrame, rule: LineRule) -> DataFrame:
    """(doc_id, drop: key hashes of its lines that go)."""
    spark = docs.sparkSession
    counted = line_hashes(docs, rule).groupBy("h").agg(F.count_distinct("doc_id").alias("n_docs"), F.max("doc_id").alias("last_doc"))
    keys = written(counted, "line-keys")
    shards = max(1, -(-keys.count() // SHARD))
    copies = _copies(keys, shards)
    packed = _packed_keys(keys, shards, copies).unionByName(_packed_probes(docs, shards, copies, rule))
    parts = min(shards + sum(copies.values()), 8 * shuffle_partitions(spark))
    dealt = packed.repartition(parts, "shard", "copy").sortWithinPartitions("shard", "copy", "kind")
    return _answers(dealt, rule).groupBy("doc_id").agg(F.collect_set("h").alias("drop"))


def _stripped(batches: Iterator[pa.RecordBatch], rule: LineRule, text: str, drop: str):
    """(part of a batch, lines of every text, lines dropped, text of the lines that stay)."""
    for part, texts in byte_chunks(batches, text, CHUNK):
        lines, dropped, kept = [], [], []
        for body, hashes in zip(texts.to_pylist(), part.column(drop).to_pylist()):
            split = body.split(b"\n")
            gone = {h % 2**64 for h in hashes or ()}
            stay = [x for x in split if key_hash(x, rule) not in gone] if gone else split
            lines.append(len(split))
            dropped.append(len(split) - len(stay))
            kept.append(b"\n".join(stay))
        yield part, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())


def dedup_lines(docs: DataFrame, rule: LineRule = LineRule(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped and kept (the lines that stay, joined by \\n), one row for each row of ``docs``.

    A null or empty text is one empty line. Rows without a key aren't counted and keep all lines. Repeated rows of a
    key are one document: they lose the same lines, and those of the largest key keep theirs. Equality of keys is
    that of their 64-bit hashes. An empty table gives no rows.
    """
    rows = id_text(docs, key, text)
    joined = rows.join(dropped_keys(rows, rule), "doc_id", "left").select("doc_id", "text", "drop")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, *columns in _stripped(batches, rule, "text", "drop"):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names=["doc_id", "n_lines", "n_dropped", "kept"])

    return joined.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept string")


def strip_lines(docs: DataFrame, rule: LineRule = LineRule(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of ``docs``, with the text of the lines that stay, and n_dropped; rows as in dedup_lines()."""
    names = [c for c in docs.columns if c != "n_dropped"]
    drops = dropped_keys(id_text(docs, key, text), rule).toDF("__key", "__drop")
    joined = docs.select(names).join(drops, F.col(f"`{key}`") == F.col("__key"), "left").select(*[f"`{c}`" for c in names], "__drop")
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in joined.schema if f.name != "__drop"), T.StructField("n_dropped", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, dropped, kept in _stripped(batches, rule, text, "__drop"):
            columns = [kept if c == text else part.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, dropped], names=[*names, "n_dropped"])

    return joined.mapInArrow(run, schema)
