"""Near-duplicate groups by SetSketch registers, banded, estimated jointly, and confirmed on full sets.

A text's set holds its distinct runs of ``words`` words (lower-cased A-Z, split at ASCII white space); with fewer
words, the whole sequence is the one element; without words the set is empty and the row is linked with nothing.

1. Every task turns a text into registers: the smallest of the set's exponential draws, on a scale of exponential
   steps, cut off at both ends. Registers of a union are the larger of the two, so they merge.
2. Rows of the same set become one class, by a 128-bit digest of the whole set.
3. Classes that agree on all registers of a band share a bucket, and the smallest class of a bucket is its leader. Every
   class is compared with its leaders, and linked classes form components.
4. Two linked classes share a bucket, so a leader. Where a leader's classes lie in several components, each of those outside
   the largest one is compared with all of the leader's classes. For this a class is its difference from the leader's set, a few elements
   for an edited copy: sizes and the elements that two differences share give the similarity of the sets exactly. The shared ones are
   counted through postings of the differences, in blocks of bounded size, and a block names one link for each
   component, so neither pairs nor texts are rows, and a group of copies of one component costs nothing.
5. A pair's similarity is estimated by maximum likelihood from how many registers are larger, smaller and equal; pairs of class and
   leader that lie 6 standard errors below the limit go. The others are confirmed on the full sets of both texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliogrid.llm.common import WordHashes, as_bytes, byte_chunks, id_text, mixed, random_words, shingles, words_of, written
from heliogrid.llm.graph import components

CHUNK = 1 << 20
#: Classes that meet a copy of their leader's text in one task, and what a block of differences holds.
PART_CLASSES = 256
BLOCK_CLASSES, BLOCK_BYTES = 4096, 8 << 20
#: Keys that are broadcast after a count proved them to be no more (16 MB); more of them are joined by shuffles.
BROADCAST_KEYS = 2_000_000


@dataclass(frozen=True)
class SetSketch:
    """Parameters of the registers and bands; base, rate and steps are those the literature proposes for 16 bits."""

    words: int = 5
    percent: int = 80  # 100 * |A & B| >= percent * |A | B|
    rows: int = 4
    bands: int = 32
    base: float = 1.001
    rate: float = 20.0
    steps: int = 65534

    @property
    def registers(self) -> int:
        return self.rows * self.bands

    @property
    def margin(self) -> float:
        j = self.percent / 100
        return 6 * float(np.sqrt(j * (1 - j) / self.registers))


def registers(sets: list[np.ndarray], spec: SetSketch) -> np.ndarray:
    """One row of registers (uint16) for each non-empty set of element hashes."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    least = np.empty((spec.registers, len(sets)), np.uint64)
    draws = np.empty_like(flat)
    factors, shifts = random_words(spec.registers, 11) | np.uint64(1), random_words(spec.registers, 13)
    for i in range(spec.registers):  # a fixed order of draws: minimum of the uniform draw is minimum of the exponential one
        np.multiply(flat, factors[i], out=draws)
        np.add(draws, shifts[i], out=draws)
        least[i] = np.minimum.reduceat(draws, starts)
    uniform = (least.astype(np.float64) + 0.5) / 2.0**64
    draw = -np.log1p(-np.minimum(uniform, 1 - 1e-16)) / spec.rate
    return np.clip(np.floor(1 - np.log(draw) / np.log(spec.base)), 0, spec.steps + 1).astype(np.uint16).T


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of the two sets."""
    return np.maximum(a, b)


def band_keys(regs: np.ndarray, spec: SetSketch) -> np.ndarray:
    """One 64-bit key for each row and band."""
    parts = regs.reshape(len(regs), spec.bands, spec.rows).astype(np.uint64)
    keys = np.broadcast_to(random_words(spec.bands, 17), parts.shape[:2]).copy()
    for i in range(spec.rows):
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i] + np.uint64(1))
    return keys


def joint_similarity(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, base: float) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of row pairs, from counts of larger, smaller and equal registers."""
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - more - less
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    top = np.minimum(u / v, v / u)
    grid = np.linspace(0, 1, 201)[None, :] * top

    def prob(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (base - 1) / base) / np.log(base)

    p_more, p_less = prob(u - v * grid), prob(v - u * grid)
    tiny = 1e-12
    fit = (
        more[:, None] * np.log(np.maximum(p_more, tiny))
        + less[:, None] * np.log(np.maximum(p_less, tiny))
        + same[:, None] * np.log(np.maximum(1 - p_more - p_less, tiny))
    )
    return grid[np.arange(len(grid)), fit.argmax(1)]


def sketch(docs: DataFrame, spec: SetSketch = SetSketch(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, set_key (null: empty set), registers of every row; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for rows, texts in byte_chunks(batches, "text", CHUNK):
            sets = [shingles(words_of(t), spec.words, hashes) for t in texts.to_pylist()]
            full = [s for s in sets if len(s)]
            regs = iter(registers(full, spec)) if full else iter(())
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array([next(regs).tobytes() if len(s) else None for s in sets], pa.binary()),
                ],
                names=["doc_id", "n_shingles", "set_key", "registers"],
            )

    return id_text(docs, key, text).mapInArrow(run, "doc_id long, n_shingles long, set_key binary, registers binary")


def _buckets(classes: DataFrame, spec: SetSketch) -> DataFrame:
    """(bucket, rep): one row for each class and band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            regs = np.frombuffer(b"".join(batch.column("registers").to_pylist()), np.uint16)
            keys = band_keys(regs.reshape(batch.num_rows, spec.registers), spec).view(np.int64)
            reps = np.repeat(batch.column("rep").to_numpy(zero_copy_only=False), spec.bands)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(reps)], names=["bucket", "rep"])

    return classes.select("rep", "registers").mapInArrow(run, "bucket long, rep long")


def _only(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose key is in a written table of keys; few keys spare the rows a shuffle."""
    few = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    keys = keys.toDF(key)
    return rows.join(F.broadcast(keys) if few else keys, key, "left_semi")


def _likely(pairs: DataFrame, classes: DataFrame, keys: DataFrame, spec: SetSketch) -> DataFrame:
    """Pairs whose estimated similarity isn't clearly below the limit; ``keys`` are those of the pairs."""
    side = _only(classes.select("rep", "n_shingles", "registers"), keys, "rep")
    both = pairs.join(side.toDF("a", "n_a", "regs_a"), "a").join(side.toDF("b", "n_b", "regs_b"), "b")
    least = spec.percent / 100 - spec.margin

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                a, b = (
                    np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, spec.registers)
                    for c in ("regs_a", "regs_b")
                )
                n_a, n_b = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("n_a", "n_b"))
                # sizes alone bound the similarity by the smaller over the larger one
                keep = (100 * np.minimum(n_a, n_b) >= spec.percent * np.maximum(n_a, n_b)) & (
                    joint_similarity(a, b, n_a, n_b, spec.base) >= least
                )
                yield batch.select(["a", "b"]).filter(pa.array(keep))

    return both.select("a", "b", "n_a", "n_b", "regs_a", "regs_b").mapInArrow(run, "a long, b long")


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    union = len(x) + len(y) - common
    return bool(union) and 100 * common >= percent * union


def _beside_leaders(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, part, id, text) of the pairs (a, b): the leader's text first (id = a), then the texts of some of its classes.

    A leader's text is repeated once for every ``PART_CLASSES`` of its classes, not for each.
    """
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PART_CLASSES).cast("long").alias("parts"))
    own = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), "parts").alias("part"), F.col("b").alias("id"))
    leaders = parts.select("a", F.explode(F.expr("sequence(0L, parts - 1)")).alias("part"), F.col("a").alias("id"))
    rows = own.unionAll(leaders).join(texts.toDF("id", "text"), "id").select("a", "part", "id", "text")
    return rows.repartition("a", "part").sortWithinPartitions("a", "part", F.col("id") != F.col("a"), "id")


def _leader_sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """(leader, part, class, set of the leader, set of the class), the leader itself among the classes."""
    hashes, leader = WordHashes(), np.empty(0, np.uint64)
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("a", "part", "id")]
        for a, part, key, text in zip(*columns, as_bytes(batch.column("text")).to_pylist()):
            own = shingles(words_of(text), size, hashes)
            if key == a:
                leader = own
            yield a, part, key, leader, own


def _confirmed(pairs: DataFrame, texts: DataFrame, spec: SetSketch) -> DataFrame:
    """Pairs that meet the limit on the full sets of both texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(a, key) for a, _, key, x, y in _leader_sets(batches, spec.words) if key != a and linked(x, y, spec.percent)]
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return _beside_leaders(pairs, texts).mapInArrow(run, "a long, b long")


def _differences(pairs: DataFrame, texts: DataFrame, spec: SetSketch) -> DataFrame:
    """(bucket, rep, n, gap): of the leader and every class its number of elements and those in which it differs from the leader."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        names, types = ["bucket", "rep", "n", "gap"], [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for a, part, key, leader, own in _leader_sets(batches, spec.words):
            if key != a or part == 0:
                rows.append((a, key, len(own), np.setxor1d(leader, own, assume_unique=True).tobytes()))
                held += len(rows[-1][3]) + 32
            if held > CHUNK:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return _beside_leaders(pairs, texts).mapInArrow(run, "bucket long, rep long, n long, gap binary")


def links_across(outside: pa.Table, members: pa.Table, percent: int) -> pa.Table:
    """(a, b): each row of ``outside`` with one linked row of ``members`` for each other component. Columns: rep, component, n, gap."""
    gaps = [np.frombuffer(g, np.uint64) for g in members["gap"].to_pylist()]
    sizes = np.fromiter(map(len, gaps), np.int64, len(gaps))
    elements = np.concatenate([np.empty(0, np.uint64), *gaps])
    order = np.argsort(elements, kind="stable")
    elements, owner = elements[order], np.repeat(np.arange(len(gaps)), sizes)[order]
    n, component, reps = (members[c].to_numpy() for c in ("n", "component", "rep"))
    found = []
    for rep, own, m, gap in zip(*(outside[c].to_pylist() for c in ("rep", "component", "n", "gap"))):
        gap = np.frombuffer(gap, np.uint64)
        first, last = np.searchsorted(elements, gap, "left"), np.searchsorted(elements, gap, "right")
        runs = last - first
        at = np.repeat(first - np.cumsum(runs) + runs, runs) + np.arange(runs.sum())
        apart = len(gap) + sizes - 2 * np.bincount(owner[at], minlength=len(sizes))
        # twice the union and twice the intersection
        near = np.flatnonzero((100 * (m + n - apart) >= percent * (m + n + apart)) & (component != own))
        if len(near):
            found += [(rep, int(reps[near[k]])) for k in np.unique(component[near], return_index=True)[1]]
    return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})


def _blocks(condition: str) -> Column:
    """Blocks that the rows of a group fall into."""
    rows, size = F.count(F.expr(f"case when {condition} then 1 end")), F.sum(F.expr(f"case when {condition} then length(gap) + 64 end"))
    return F.greatest(F.lit(1), F.ceil(rows / BLOCK_CLASSES), F.ceil(size / BLOCK_BYTES)).cast("long")


def _across(groups: DataFrame, spec: SetSketch) -> DataFrame:
    """Links between components of the groups (bucket, rep, component, largest, n, gap): all outside the largest one against all."""
    counts = groups.groupBy("bucket").agg(_blocks("component <> largest").alias("ni"), _blocks("true").alias("nj"))
    rows = groups.join(counts, "bucket").select("bucket", "rep", "component", "n", "gap", "largest", "ni", "nj")
    every = lambda n: F.explode(F.expr(f"sequence(0L, {n} - 1)"))
    outside = rows.where("component <> largest").withColumn("i", F.pmod(F.xxhash64("rep"), "ni")).withColumn("j", every("nj"))
    members = rows.withColumn("j", F.pmod(F.xxhash64("rep", F.lit(1)), "nj")).withColumn("i", every("ni"))
    keys, columns = ["bucket", "i", "j"], ["bucket", "i", "j", "rep", "component", "n", "gap"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return links_across(left, right, spec.percent)

    members = members.select(*columns).toDF(*columns)  # columns of their own, as both sides are the same rows
    return outside.select(*columns).groupBy(*keys).cogroup(members.groupBy(*keys)).applyInArrow(run, "a long, b long")


def _live(table: DataFrame, component: DataFrame) -> DataFrame:
    """(bucket, rep, component, largest) of the buckets whose classes are of several components."""
    own = table.join(component, F.col("rep") == F.col("node"), "left")
    own = own.select("bucket", "rep", F.coalesce("component", "rep").alias("component"))
    sizes = own.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("bucket").agg(F.max(F.struct("n", "component")).alias("top"), F.count("*").alias("parts")).where("parts > 1")
    return own.join(largest.select("bucket", F.col("top.component").alias("largest")), "bucket")


def _merged(component: DataFrame, links: DataFrame) -> DataFrame:
    """The components after more links: only components are linked anew, not their members."""
    names = component.select("node", "component")
    ends = links.join(names.toDF("a", "p"), "a", "left").join(names.toDF("b", "q"), "b", "left")
    moves = components(ends.select(F.coalesce("p", "a").alias("a"), F.coalesce("q", "b").alias("b"))).toDF("from", "to")
    old = names.join(moves, F.col("component") == F.col("from"), "left").select("node", F.coalesce("to", "component").alias("component"))
    new = moves.join(names, F.col("from") == F.col("node"), "left_anti").select(F.col("from").alias("node"), F.col("to").alias("component"))
    return written(old.unionAll(new), "components", narrow=True)


def near_duplicates(docs: DataFrame, spec: SetSketch = SetSketch(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest key reachable over links), kept, one row for each row of ``docs``.

    Repeated rows of one key count as copies of each other; of rows with one key but different texts, a class takes
    the text of any. A row without a key has component_id null and kept true. An empty table gives no rows.
    """
    rows = id_text(docs, key, text)
    sketches = written(sketch(rows, spec), "sketches")
    classes = written(
        sketches.where("set_key is not null and doc_id is not null")
        .groupBy("set_key")
        .agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers")),
        "classes",
    )
    bands = _buckets(classes, spec).repartition("bucket")  # one shuffle for the leaders and their classes
    shared = bands.groupBy("bucket").agg(F.min("rep").alias("a"), F.max("rep").alias("last")).where("a < last")
    led = bands.join(shared.select("bucket", "a"), "bucket").where("rep <> a")
    led = written(led.select("a", F.col("rep").alias("b")).distinct(), "led", narrow=True)
    ids = written(led.select("a").unionAll(led.select("b")).distinct(), "keys", narrow=True)
    texts = written(_only(rows, ids, "doc_id").dropDuplicates(["doc_id"]), "texts")
    links = written(_confirmed(written(_likely(led, classes, ids, spec), "pairs"), texts, spec), "links")
    component = components(links)
    own = led.unionAll(led.select("a", F.col("a").alias("b")).distinct())
    live = written(_live(own.toDF("bucket", "rep"), component), "live", narrow=True)
    if live.limit(1).count():
        meet = live.where("bucket <> rep").select(F.col("bucket").alias("a"), F.col("rep").alias("b"))
        groups = written(_differences(meet, texts, spec).join(live, ["bucket", "rep"]), "differences")
        more = written(_across(groups, spec), "links", narrow=True)
        if more.limit(1).count():
            component = _merged(component, more)
    classes = classes.select("set_key", "rep").join(component, F.col("rep") == F.col("node"), "left")
    classes = classes.select("set_key", F.coalesce("component", "rep").alias("reached"))
    out = sketches.select("doc_id", "n_shingles", "set_key").join(classes, "set_key", "left")
    found = F.when(F.col("doc_id").isNotNull(), F.coalesce("reached", "doc_id"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return out.select("doc_id", "n_shingles", found.alias("component_id")).withColumn("kept", kept)
