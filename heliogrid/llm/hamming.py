"""Exact nearest neighbours of binary codes in Hamming distance, by incremental multi-index hashing.

1. A vector's code has one bit for each component, set where it is positive. Rows with one code are one entry that
   keeps its k + 1 smallest ids: no search can return more of them, and a hot code is k + 1 rows a task.
2. Entries are dealt into blocks. A block has a table for every segment of 16 bits: entries by segment value.
3. A task searches its block for every query code: segment by segment, radius by radius, it visits the values at that
   radius from the query's segment and verifies full distances. After radius r in the first a segments and r - 1 in
   the others, every code nearer than s * (r - 1) + s + a is known (s segments), so the search ends once the kth
   verified distance is below that. Where a radius has more values than the block has entries, the rest is verified at once.
4. The blocks' nearest entries are merged for each query code and handed to all its queries.

Query codes travel in blocks of a bounded number; the index is read once for each of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heliogrid.llm.common import written

SEGMENT = 16


@dataclass(frozen=True)
class SearchRule:
    k: int = 10
    block_entries: int = 32_768
    query_codes: int = 65_536


def codes(vectors: DataFrame, dim: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, code) of rows with a key and a vector of ``dim`` components; null and NaN components are not positive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = -(-dim // SEGMENT) * SEGMENT
        for batch in batches:
            flat = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
            bits = np.zeros((len(flat), width), bool)
            bits[:, :dim] = flat > 0
            packed = np.packbits(bits, axis=1, bitorder="little")
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([row.tobytes() for row in packed], pa.binary())], names=["id", "code"])

    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    return rows.where((F.col("id").isNotNull()) & (F.size("v") == dim)).mapInArrow(run, "id long, code binary").distinct()


def masks(bits: int, radius: int) -> np.ndarray:
    """All numbers of ``bits`` bits with ``radius`` bits set."""
    return np.array([sum(1 << b for b in c) for c in combinations(range(bits), radius)], np.int64)


class SegmentTables:
    """A block of distinct codes (rows of 16-bit segments) with one table for each segment."""

    def __init__(self, segments: np.ndarray, counts: np.ndarray) -> None:
        self.segments, self.counts = segments, counts
        self.order = [np.argsort(column, kind="stable") for column in segments.T]
        self.starts = [np.concatenate([[0], np.cumsum(np.bincount(column, minlength=1 << SEGMENT))]) for column in segments.T]
        self.masks: dict[int, np.ndarray] = {}

    def _distances(self, entries: np.ndarray, query: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.segments[entries] ^ query).sum(1, dtype=np.int64)

    def _at_radius(self, segment: int, value: int, radius: int) -> np.ndarray:
        if radius not in self.masks:
            self.masks[radius] = masks(SEGMENT, radius)
        values = value ^ self.masks[radius]
        first = self.starts[segment][values]
        count = self.starts[segment][values + 1] - first
        some = count > 0
        first, count = first[some], count[some]
        at = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
        return self.order[segment][at]

    def nearest(self, query: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
        """Entries that can be among the ``wanted`` nearest rows, with their distances: all up to the kth distance."""
        n, s = self.segments.shape
        seen = np.zeros(n, bool)
        rows_at = np.zeros(s * SEGMENT + 1, np.int64)  # rows known at each distance
        entries, distances = [np.empty(0, np.int64)], [np.empty(0, np.int64)]

        def verify(new: np.ndarray) -> None:
            new = np.unique(new[~seen[new]])
            seen[new] = True
            d = self._distances(new, query)
            np.add.at(rows_at, d, self.counts[new])
            entries.append(new)
            distances.append(d)

        def kth() -> int:
            known = np.cumsum(rows_at)
            return int(np.searchsorted(known, wanted)) if known[-1] >= wanted else s * SEGMENT + 1

        done = False
        for radius in range(SEGMENT + 1):
            if math.comb(SEGMENT, radius) > n:
                verify(np.flatnonzero(~seen))
                break
            for segment in range(s):
                verify(self._at_radius(segment, int(query[segment]), radius))
                if kth() <= s * radius + segment:  # all up to this distance are known
                    done = True
                    break
            if done:
                break
        entries, distances = np.concatenate(entries), np.concatenate(distances)
        near = distances <= kth()
        return entries[near], distances[near]


def _block_results(entries: DataFrame, queries: list[bytes], wanted: int) -> DataFrame:
    """(query, id, distance): the ``wanted`` nearest rows of every block for every query code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids = [], []
        for batch in batches:
            held += batch.column("code").to_pylist()
            ids += batch.column("ids").to_pylist()
        if not held:
            return
        segments = np.frombuffer(b"".join(held), np.uint16).reshape(len(held), -1)
        tables = SegmentTables(segments, np.array([len(x) for x in ids]))
        for at in range(0, len(queries), 512):
            q_out, id_out, d_out = [], [], []
            for q in queries[at : at + 512]:
                found, distance = tables.nearest(np.frombuffer(q, np.uint16), wanted)
                rows = sorted((int(d), i) for e, d in zip(found, distance) for i in ids[e])[:wanted]
                q_out += [q] * len(rows)
                id_out += [i for _, i in rows]
                d_out += [d for d, _ in rows]
            yield pa.RecordBatch.from_arrays([pa.array(q_out, pa.binary()), pa.array(id_out, pa.int64()), pa.array(d_out, pa.int64())], names=["query", "id", "distance"])

    return entries.mapInArrow(run, "query binary, id long, distance long")


def _first(rows: DataFrame, by: str, order: list[str], n: int) -> DataFrame:
    """The first n rows of every group; tasks keep n of each group before the shuffle."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return rows.withColumn("place", place).where(F.col("place") <= n).drop("place")


def nearest(
    vectors: DataFrame, queries: DataFrame, rule: SearchRule = SearchRule(), key: str = "vec_id", vector: str = "embedding", dim: int | None = None
) -> DataFrame:
    """query_id, rank, neighbour_id, distance: the k nearest other rows of every query, ties by the smaller id.

    Rows without a key or vector, and vectors of another length than ``dim`` (the most frequent length, if not given),
    are neither found nor asked for. A repeated row is one; a key with several vectors is several rows of that key,
    none of which is its own neighbour. With fewer than k other rows, all are returned; empty tables give no rows.
    """
    size = F.size(F.col(f"`{vector}`").cast("array<double>"))
    if dim is None:
        common = vectors.where(size > 0).groupBy(size.alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
        dim = common["n"] if common else 1
    wanted = rule.k + 1
    few = _first(codes(vectors, dim, key, vector), "code", ["id"], wanted)
    entries = written(few.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")), "codes")
    asked = written(codes(queries, dim, key, vector).toDF("query_id", "query"), "query-codes")
    asked_codes = asked.select("query").distinct()
    blocks = max(1, -(-entries.count() // rule.block_entries))
    parts = max(1, -(-asked_codes.count() // rule.query_codes))
    found = None
    for part in range(parts):
        held = [bytes(r["query"]) for r in asked_codes.where(F.pmod(F.xxhash64("query"), F.lit(parts)) == part).collect()]
        blockwise = _block_results(entries.repartition(blocks, "code"), sorted(held), wanted)
        found = blockwise if found is None else found.unionAll(blockwise)
    # one more than k, as the query itself is among them
    best = _first(found, "query", ["distance", "id"], wanted).groupBy("query")
    best = best.agg(F.sort_array(F.collect_list(F.struct("distance", "id"))).alias("best"))
    others = F.slice(F.filter("best", lambda x: x["id"] != F.col("query_id")), 1, rule.k)
    out = asked.join(best, "query").select("query_id", F.posexplode(others).alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias("neighbour_id"), F.col("x.distance").alias("distance"))
