"""Periodic runs of words by string synchronising sets.

A run is a stretch of words with smallest period q and at least ``exponent`` periods that no neighbouring word extends. Texts of a
chunk are one sequence of word numbers, worked on in numpy at once; nothing crosses the end of a text.

1. Runs of the smallest periods (below ``FIRST``) are found by comparing every word with the one q places on.
2. Scale t = 4, 8, 16, ... proposes the periods from t to 2t - 1. A fragment of t words has a hash, doubled from scale to scale.
   Position i is synchronising if the least hash among the fragments at i to i + t stands at i or at i + t. Fragments of
   period t / exponent and below don't take part: regions made of them hold no synchronising position, and their runs
   are known from the finer scales. Whether i is synchronising depends on the 2t words from i only, and any t places
   in a row hold such a position unless all their fragments lie in such a region.
3. A run of period q in [t, 2t) is 4q words long at least, so its first t places hold a synchronising i, i + q is one too, and the
   2t words at both are equal. So neighbours among equal contexts, t to 2t - 1 apart, propose every period.
4. Proposals are compared word by word and extended to both sides; stretches of enough periods are the runs. Hashes only
   propose: no run rests on one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliogrid.llm.common import byte_chunks, id_text, mixed, random_words

CHUNK = 1 << 20
FIRST = 4
#: Order of a fragment that takes no part.
NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
OUT = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, strongest struct<start:long,length:long,period:long>, collapsed string"


@dataclass(frozen=True)
class RunRule:
    """``exponent`` (4 at least) periods and ``min_words`` words make a run."""

    exponent: int = 4
    min_words: int = 6

    def __post_init__(self):
        if self.exponent < 4:
            raise ValueError("the scales find every run of four periods and more, not of fewer")


def _direct(words: np.ndarray, end: np.ndarray, period: int, exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest stretches in which words ``period`` apart are equal, of enough periods."""
    n = len(words) - period
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    same = (words[:n] == words[period:]) & (np.arange(n) + period < end[:n])
    edge = np.diff(np.concatenate([[False], same, [False]]).astype(np.int8))
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + period
    enough = stop - start >= exponent * period
    return start[enough], stop[enough]


def _extended(words: np.ndarray, first: int, last: int, period: int, low: int, high: int) -> tuple[int, int] | None:
    """The stretch of ``period`` around words[first:last] within low and high; None if that isn't one."""
    if not np.array_equal(words[first : last - period], words[first + period : last]):
        return None
    step = 64
    while first > low:  # words before the stretch, in growing steps
        lo = max(low, first - step)
        other = np.flatnonzero(words[lo:first] != words[lo + period : first + period])
        if len(other):
            first = lo + int(other[-1]) + 1
            break
        first, step = lo, 2 * step
    step = 64
    while last < high:
        hi = min(high, last + step)
        other = np.flatnonzero(words[last:hi] != words[last - period : hi - period])
        if len(other):
            last = last + int(other[0])
            break
        last, step = hi, 2 * step
    return first, last


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` values in a row (a power of two, and one more), by doubling."""
    size, out = 1, values
    while 2 * size <= width:
        out = np.minimum(out[: len(out) - size], out[size:])
        size *= 2
    rest = width - size
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def find_runs(words: np.ndarray, bounds: np.ndarray, rule: RunRule = RunRule()) -> np.ndarray:
    """(start, end, period) of all runs in texts that are ``words[bounds[k]:bounds[k + 1]]``, by start and period.

    Starts and ends are places in ``words``.
    """
    found: list[tuple[int, int, int]] = []  # all stretches of enough periods, also those below min_words
    size = np.diff(bounds)
    end, held = np.repeat(bounds[1:], size), np.repeat(size, size)
    for q in range(1, FIRST):
        known = {p: _direct(words, end, p, rule.exponent) for p in range(1, q)} if q > 1 else {}
        start, stop = _direct(words, end, q, rule.exponent)
        for p, (a, b) in known.items():
            if q % p == 0 and len(a):  # of a smaller period if one of its stretches holds all of it
                at = np.maximum(np.searchsorted(a, start, "right") - 1, 0)
                own = ~((a[at] <= start) & (b[at] >= stop))
                start, stop = start[own], stop[own]
        found.extend(zip(start.tolist(), stop.tolist(), [q] * len(start)))

    # places still in play: those of texts that are long enough for the scale's periods
    place = np.arange(len(words))
    value = mixed(words.astype(np.uint64) + np.uint64(1))
    factors = random_words(2, 83) | np.uint64(1)
    scale = 1
    while True:
        if scale >= FIRST:
            alive = held[place] >= rule.exponent * scale
            if not alive.all():
                place, value = place[alive], value[alive]
            if not len(place):
                break
            found.extend(_at_scale(words, bounds, end, place, value, scale, factors, found, rule))
        if len(place) <= scale:
            break
        # fragments twice as long; those that pass the end of a text are never looked at
        value = mixed(value * factors[0] + np.append(value[scale:], np.zeros(scale, np.uint64)) * factors[1])
        scale *= 2
    out = np.array(sorted(r for r in found if r[1] - r[0] >= rule.min_words), np.int64).reshape(-1, 3)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def _at_scale(words, bounds, end, place, value, scale, factors, found, rule) -> list[tuple[int, int, int]]:
    """The stretches of periods from ``scale`` to twice that less one."""
    n = len(place)
    if n < 2 * scale:
        return []
    # kept texts lie one after the other, so a fragment inside its text is in a row in ``place`` too
    order = value.copy()
    order[order == NEVER] = NEVER - np.uint64(1)
    if found:
        low_period = [(a, b) for a, b, q in found if rule.exponent * q <= scale <= b - a]
        if low_period:
            mark = np.zeros(len(words) + 1, np.int64)
            a, b = np.array(low_period).T
            np.add.at(mark, a, 1)
            np.add.at(mark, b - scale + 1, -1)
            order[np.cumsum(mark)[place] > 0] = NEVER
    least = _least(order, scale + 1)
    at = np.arange(len(least))
    chosen = (least != NEVER) & ((order[at] == least) | (order[at + scale] == least)) & (place[at] + 2 * scale <= end[place[at]])
    at = at[chosen]
    if not len(at):
        return []
    context = value[at] * factors[0] + value[at + scale] * factors[1]
    rank = np.argsort(context, kind="stable")
    here, following = at[rank[:-1]], at[rank[1:]]
    gap = following - here
    pairs = (context[rank[:-1]] == context[rank[1:]]) & (gap >= scale) & (gap < 2 * scale)
    if not pairs.any():
        return []
    first, period = place[here[pairs]], gap[pairs]
    by = np.lexsort((first, period))
    first, period = first[by], period[by]
    last = first + period + 2 * scale
    # proposals of one period that overlap by it are one stretch
    fresh = np.append(True, (period[1:] != period[:-1]) | (first[1:] > last[:-1] - period[1:]))
    heads = np.flatnonzero(fresh)
    tails = np.append(heads[1:], len(first)) - 1
    out, reach = [], {}
    for h, t in zip(heads.tolist(), tails.tolist()):
        q, a = int(period[h]), int(first[h])
        if reach.get(q, -1) >= a + 2 * q:
            continue  # part of the stretch before
        text = int(np.searchsorted(bounds, a, "right")) - 1
        stretch = _extended(words, a, int(last[t]), q, int(bounds[text]), int(bounds[text + 1]))
        if stretch:
            reach[q] = stretch[1]
            if stretch[1] - stretch[0] >= rule.exponent * q:
                out.append((*stretch, q))
    return out


def numbered_words(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """All words of the texts, their numbers (equal words have equal ones), and where each text begins and ends."""
    numbers: dict[bytes, int] = {}
    words, ids, bounds = [], [], [0]
    for text in texts:
        some = WORD.findall(text)
        words.extend(some)
        for word in some:
            ids.append(numbers.setdefault(word, len(numbers)))
        bounds.append(len(words))
    return words, np.array(ids, np.int64), np.array(bounds, np.int64)


def _strongest(runs: list[dict]) -> dict | None:
    """The run of most periods, compared as whole numbers; ties go to the first start, then the smaller period."""
    best = None
    for r in runs:
        if best is None or r["length"] * best["period"] > best["length"] * r["period"]:
            best = r
    return best


def _rows(texts: list[bytes], rule: RunRule) -> tuple[list, list, list, list]:
    words, ids, bounds = numbered_words(texts)
    found = find_runs(ids, bounds, rule)
    mark = np.zeros(len(words) + 1, np.int64)
    np.add.at(mark, found[:, 0] + found[:, 2], 1)
    np.add.at(mark, found[:, 1], -1)
    dropped = np.cumsum(mark)[:-1] > 0
    text_of = np.searchsorted(bounds, found[:, 0], "right") - 1
    cut = np.searchsorted(text_of, np.arange(len(texts) + 1))
    n_words, runs, strongest, collapsed = [], [], [], []
    for k in range(len(texts)):
        b, e = int(bounds[k]), int(bounds[k + 1])
        own = [{"start": int(a - b), "length": int(z - a), "period": int(q)} for a, z, q in found[cut[k] : cut[k + 1]]]
        n_words.append(e - b)
        runs.append(own)
        strongest.append(_strongest(own))
        kept = words[b:e] if not own else [w for w, gone in zip(words[b:e], dropped[b:e].tolist()) if not gone]
        collapsed.append(b" ".join(kept))
    return n_words, runs, strongest, collapsed


def periodic_runs(docs: DataFrame, rule: RunRule = RunRule(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period), strongest run, collapsed text of every row.

    ``collapsed`` keeps of every run its first period: the words that are in no run after its first period, joined by one blank.
    Words are runs of other characters than ASCII white space, compared exactly. Null, empty and blank texts have no words, no runs, no
    strongest run and an empty collapsed text. Rows are independent: repeated rows give repeated results, rows without a key keep
    theirs; other columns of ``docs`` aren't read. An empty table gives no rows.
    """
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(OUT)
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in byte_chunks(batches, "text", CHUNK):
            n_words, runs, strongest, collapsed = _rows(texts.to_pylist(), rule)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(runs, pa.list_(run_type)), pa.array(strongest, run_type),
                 pa.array(collapsed, pa.binary()).cast(pa.string())],
                names=schema.names,
            )

    return id_text(docs, key, text).mapInArrow(run, schema)


def with_planted_period(text: str = "text", key: str = "doc_id") -> Column:
    """The text whose words from a on repeat with period p, where the key's CRC-32 is divisible by 10; else the text.

    With h = crc32(decimal key), g = floor(h / 10) and n words: a = g % n, p = 1 + floor((n - a) / (3 + g % 8)), and word
    i >= a becomes word a + (i - a) % p. Null keys and texts without words stay as they are.
    """
    h = f"crc32(cast(cast(`{key}` as string) as binary))"
    words = f"filter(split(`{text}`, '[ \\\\x09-\\\\x0D]+'), w -> w <> '')"
    shape = f"transform(array({words}), w -> named_struct('w', w, 'a', ({h} div 10) % size(w)))"
    shape = f"transform({shape}, x -> named_struct('w', x.w, 'a', x.a, 'p', 1 + (size(x.w) - x.a) div (3 + ({h} div 10) % 8)))"
    grown = f"""transform({shape}, x -> array_join(transform(sequence(0, size(x.w) - 1),
      i -> x.w[cast(if(i < x.a, i, x.a + (i - x.a) % x.p) as int)]), ' '))[0]"""
    some = f"`{key}` is not null and `{text}` is not null and {h} % 10 = 0 and `{text}` rlike '[^ \\\\x09-\\\\x0D]'"
    return F.expr(f"case when {some} then {grown} else `{text}` end")
