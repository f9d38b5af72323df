"""Benchmark decontamination: rare word n-grams seed pairs of text passages and test items, Smith-Waterman scores them.

Test items are taken in blocks of a bounded number of words; a block travels with the tasks, and the documents are read
once to count its words and once to find its copies. No document is shuffled.

1. A pass counts the block's words over all documents. A seed is a run of ``gram`` words of an item whose surprisal
   under these counts is at least ``min_bits``: rare whatever the corpus size, and also where a leaked passage itself
   is frequent. An item's ``min_seeds`` rarest runs count in any case, so no item is without seeds.
2. Every seed found in a text opens the passage around it, as long as the item and half as much on both sides;
   overlapping passages of one item are one.
3. Local alignment by words (match, mismatch, gap) scores every passage against the item, in batches. The score is a
   fraction of that of a verbatim copy, so edited and paraphrased copies keep most of it.
4. A part of a longer item counts whatever its share: ``run_words`` words in a row, or more with few changes, by an
   alignment that allows little else. Runs of that many words without a rare seed are seeds themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliogrid.llm.common import byte_chunks, id_text, mixed, random_words
from heliogrid.llm.suffixes import HashedBytes

CHUNK = 1 << 20
FILTER_BITS = 20
SHIFT = np.uint64(64 - FILTER_BITS)
CELLS = 1 << 21  # of one batch of alignments
PENDING = 50_000  # words of passages aligned at once


@dataclass(frozen=True)
class LeakRule:
    gram: int = 3
    min_bits: float = 24.0
    min_seeds: int = 10
    match: int = 2
    mismatch: int = -1
    gap: int = -1
    min_score: float = 0.35
    min_words: int = 8  # matches that an alignment needs at least, or all words of a shorter item
    run_words: int = 12  # matches of a part that counts by itself
    run_cost: int = -4  # of a mismatch or gap in it, so more than two thirds of its words match
    block_words: int = 200_000


@dataclass
class Items:
    """One block of test items: word hashes of each, and its seeds sorted by hash."""

    ids: np.ndarray
    words: list[np.ndarray]
    seed: np.ndarray
    item: np.ndarray
    place: np.ndarray
    bits: np.ndarray  # which upper bits a seed can have
    sizes: np.ndarray  # words of a seed


#: What a byte is to a word: 0 left out (ASCII signs), 1 white space, 2 part of it (letters, digits, beyond ASCII).
PARTS = np.zeros(256, np.uint8)
PARTS[[9, 10, 11, 12, 13, 32]] = 1
PARTS[48:58] = PARTS[65:91] = PARTS[97:123] = PARTS[128:] = 2


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, one after the other, without ASCII signs and whatever their case; and the words up to each text's end."""
    folded = [t.decode("utf-8", "replace").casefold().encode() for t in texts]
    data = np.frombuffer(b"\n".join(folded) + b"\n", np.uint8)
    part = PARTS[data]
    stay = part > 0
    ends = np.cumsum([len(t) + 1 for t in folded])
    ends = np.cumsum(stay)[ends - 1]
    data, inside = data[stay], part[stay] == 2
    starts = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    starts = np.append(0, starts) if inside[0] else starts
    sizes = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1 - starts
    return mixed(HashedBytes(data, 43).of(starts, sizes)), np.searchsorted(starts, ends)


def marked(hashes: np.ndarray) -> np.ndarray:
    """Which upper bits some of the hashes have: a quick test before a search."""
    bits = np.zeros(1 << FILTER_BITS, bool)
    bits[hashes >> SHIFT] = True
    return bits


def gram_hashes(h: np.ndarray, size: int) -> np.ndarray:
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    run = np.zeros(n, np.uint64)
    for i, factor in enumerate(random_words(size, 41) | np.uint64(1)):
        run += h[i : i + n] * factor
    return mixed(run)


def word_counts(docs: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """How often every word (sorted hashes) is in the texts, and the number of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total = np.zeros(len(vocabulary), np.int64), 0
        bits = marked(vocabulary)
        for _, texts in byte_chunks(batches, "text", CHUNK):
            h, _ = word_hashes(texts.to_pylist())
            total += len(h)
            h = h[bits[h >> SHIFT]]
            if len(h):
                at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
                counts += np.bincount(at[vocabulary[at] == h], minlength=len(vocabulary))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(counts[some], total))], names=["at", "n"])

    sums = docs.select("text").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    found = dict(zip(sums["at"].to_pylist(), sums["n"].to_pylist()))
    return np.array([found.get(i, 0) for i in range(len(vocabulary))], np.int64), int(found.get(-1, 0))


def prepared(block: list[tuple[int, bytes]], docs: DataFrame, rule: LeakRule) -> Items:
    """The seeds of a block of items, with surprisals counted over all documents."""
    block = [(i, h) for i, text in block if len(h := word_hashes([text])[0])]
    words = [h for _, h in block]
    vocabulary = np.unique(np.concatenate(words)) if words else np.empty(0, np.uint64)
    counts, total = word_counts(docs, vocabulary)
    surprisal = -np.log2((counts + 1) / (total + len(counts) + 1))
    seed, item, place, sizes = [], [], [], set()
    for k, w in enumerate(words):
        size = min(rule.gram, len(w))
        bits = np.convolve(surprisal[np.searchsorted(vocabulary, w)], np.ones(size), "valid")
        rare = bits >= rule.min_bits
        rare[np.argsort(-bits, kind="stable")[: rule.min_seeds]] = True
        at = np.flatnonzero(rare)
        seed.append(gram_hashes(w, size)[at])
        item.append(np.full(len(at), k))
        place.append(at)
        sizes.add(size)
        if len(w) >= rule.run_words > size:
            grams = np.convolve(rare, np.ones(rule.run_words - size + 1), "valid")  # seeds inside every run
            at = np.flatnonzero(grams < 0.5)
            if len(at):
                seed.append(gram_hashes(w, rule.run_words)[at])
                item.append(np.full(len(at), k))
                place.append(at)
                sizes.add(rule.run_words)
    seed, item, place = (np.concatenate(x) if x else np.empty(0, t) for x, t in ((seed, np.uint64), (item, np.int64), (place, np.int64)))
    order = np.argsort(seed, kind="stable")
    return Items(np.array([i for i, _ in block], np.int64), words, seed[order], item[order].astype(np.int64), place[order].astype(np.int64), marked(seed), np.array(sorted(sizes), np.int64))


def align(items: list[np.ndarray], passages: list[np.ndarray], rule: LeakRule) -> tuple[np.ndarray, np.ndarray]:
    """Best local score of every item in its passage, and the passage's word behind its end.

    Rows of the score tables are computed for all pairs at once; a gap along a row is a running maximum.
    """
    n, m = max(map(len, items)), max(map(len, passages))
    a, b = np.zeros((len(items), n), np.uint64), np.full((len(items), m), np.uint64(1))
    for k, (x, y) in enumerate(zip(items, passages)):
        a[k, : len(x)], b[k, : len(y)] = x, y
    lengths = np.array([len(x) for x in items])
    valid = np.arange(m)[None, :] < np.array([len(y) for y in passages])[:, None]
    slope = np.arange(m, dtype=np.int32)[None, :] * -rule.gap
    table = np.zeros((len(items), m + 1), np.int32)
    best, end = np.zeros(len(items), np.int32), np.zeros(len(items), np.int64)
    for i in range(n):
        step = np.where((a[:, i : i + 1] == b) & valid, rule.match, rule.mismatch).astype(np.int32)
        row = np.maximum(np.maximum(table[:, :-1] + step, table[:, 1:] + rule.gap), 0)
        row = np.maximum.accumulate(row + slope, axis=1) - slope
        row[i >= lengths] = 0
        table[:, 1:] = row
        at = row.argmax(1)
        top = row[np.arange(len(row)), at]
        more = top > best
        best[more], end[more] = top[more], at[more] + 1
    return best, end


def aligned(pairs: list[tuple[np.ndarray, np.ndarray]], rule: LeakRule) -> tuple[np.ndarray, np.ndarray]:
    """align() in batches of about equal sizes."""
    order = sorted(range(len(pairs)), key=lambda k: (len(pairs[k][0]), len(pairs[k][1])))
    best, end = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
    while order:
        size = max(1, min(len(order), CELLS // 8 // max(1, len(pairs[order[-1]][1]))))
        part, order = order[-size:], order[:-size]
        best[part], end[part] = align([pairs[k][0] for k in part], [pairs[k][1] for k in part], rule)
    return best, end


def passages(h: np.ndarray, at: list[np.ndarray], grams: list[np.ndarray], items: Items) -> list[tuple[int, int, int]]:
    """(item, first word, word behind the last) around a text's seeds: words they begin at, and their hashes, by size."""
    found = []
    for where, seeds in zip(at, grams):
        first = np.searchsorted(items.seed, seeds, "left")
        count = np.searchsorted(items.seed, seeds, "right") - first
        hit = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        for k, j, p in zip(items.item[hit], np.repeat(where, count), items.place[hit]):
            length = len(items.words[k])
            slack = length // 2 + 1
            found.append((int(k), max(0, int(j - p) - slack), min(len(h), int(j - p) + length + slack)))
    found.sort()
    merged: list[tuple[int, int, int]] = []
    for k, lo, hi in found:
        if merged and merged[-1][0] == k and lo <= merged[-1][2]:
            merged[-1] = (k, merged[-1][1], max(hi, merged[-1][2]))
        else:
            merged.append((k, lo, hi))
    return merged


def _found(docs: DataFrame, items: Items, rule: LeakRule) -> DataFrame:
    strict = replace(rule, mismatch=rule.run_cost, gap=rule.run_cost)

    def scored(pending: list) -> pa.RecordBatch:
        pairs = [(items.words[k], h) for _, k, _, h in pending]
        best, end = aligned(pairs, rule)
        full = np.array([rule.match * len(a) for a, _ in pairs])
        least = np.minimum(rule.match * rule.min_words, full)
        whole = (best >= rule.min_score * full) & (best >= least)
        rows = {}

        def add(good: np.ndarray, best: np.ndarray, end: np.ndarray, rule: LeakRule) -> None:
            # the alignment's start is its end in the reversed passage
            back = [(pairs[k][0][::-1], pairs[k][1][: e][::-1]) for k, e in zip(good, end)]
            _, start = aligned(back, rule)
            for k, b, e, s in zip(good, best, end, start):
                doc, item, lo, _ = pending[k]
                hit = (float(b / full[k]), lo + int(e - s), lo + int(e))
                if (doc, item) not in rows or hit[0] > rows[doc, item][0]:
                    rows[doc, item] = hit

        good = np.flatnonzero(whole)
        add(good, best[good], end[good], rule)
        # the strict score is never above the other
        part = np.flatnonzero(~whole & (best >= rule.match * rule.run_words))
        own, end = aligned([pairs[k] for k in part], strict)
        runs = own >= rule.match * rule.run_words
        add(part[runs], own[runs], end[runs], strict)
        columns = [[d[1] for d, _ in rows], [int(items.ids[i]) for _, i in rows], *([v[c] for v in rows.values()] for c in range(3))]
        types = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "item_id", "score", "first_word", "end_word"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending, words, row = [], 0, 0
        for rows, texts in byte_chunks(batches, "text", CHUNK):
            h, ends = word_hashes(texts.to_pylist())
            starts = np.append(0, ends[:-1])
            at, grams = [], []
            for size in items.sizes:  # seeds anywhere in the chunk; those that cross texts go
                g = gram_hashes(h, int(size))
                where = np.flatnonzero(items.bits[g >> SHIFT])
                where = where[where + size <= ends[np.searchsorted(ends, where, "right")]]
                at.append(where)
                grams.append(g[where])
            docs_hit = np.unique(np.searchsorted(ends, np.concatenate(at), "right")) if at else []
            for d in docs_hit:
                lo, hi = starts[d], ends[d]
                inside = [slice(*np.searchsorted(w, (lo, hi))) for w in at]
                own = h[lo:hi]
                for k, begin, end in passages(own, [w[s] - lo for w, s in zip(at, inside)], [g[s] for g, s in zip(grams, inside)], items):
                    pending.append(((row + int(d), rows.column("doc_id")[int(d)].as_py()), k, begin, own[begin:end].copy()))
                    words += end - begin
            row += rows.num_rows
            if words >= PENDING:
                yield scored(pending)
                pending, words = [], 0
        if pending:
            yield scored(pending)

    return docs.mapInArrow(run, "doc_id long, item_id long, score double, first_word long, end_word long")


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, rule: LeakRule = LeakRule(), key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """doc_id, item_id, score, first_word, end_word of every row of ``docs`` and item it holds a copy of.

    Words are compared without ASCII signs, whatever their case; places count words that have anything else.
    Of several copies of an item in a text, the best. Null and empty texts and items have no copies; an item without a
    key is left out; rows without a key are reported with null. Repeated rows are reported each, repeated items once.
    A part of an item counts from ``run_words`` words in a row on; its score is its share of the item.
    Items shorter than a seed are found as a whole. Either table may be empty.
    """
    rows = id_text(docs, key, text)
    tests = id_text(benchmark, item, item_text).where("doc_id is not null and text is not null").distinct()
    size = F.size(F.split("text", r"[\x20\x09-\x0D]+")).cast("long")
    blocks = max(1, -(-(tests.agg(F.sum(size)).first()[0] or 0) // rule.block_words))
    out = None
    for block in range(blocks):
        part = tests.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)) == block)
        held = [(r["doc_id"], (r["text"] or "").encode()) for r in part.collect()]
        found = _found(rows, prepared(held, rows, rule), rule)
        out = found if out is None else out.unionAll(found)
    return out
