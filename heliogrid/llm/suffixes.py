"""Hash-compared suffix sort of positions in a byte buffer.

Prefix polynomial hashes give the hash of any piece in constant time, so the common extension of two suffixes is found
by binary search over lengths, and a comparison costs a logarithm of the depth. The mergesort runs bottom up on numpy
arrays: every element finds its place in the other run by binary search.
"""

from __future__ import annotations

import numpy as np

from heliogrid.llm.common import mixed, random_words

BASE = np.uint64(0x5851F42D4C957F2D)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1 of the base and of its inverse modulo 2^64."""
    if len(_powers["up"]) < n:
        for name, base in (("up", BASE), ("down", INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


class HashedBytes:
    """Prefix polynomial hashes of a byte buffer; ``seed`` picks the numbers that stand for the 256 bytes."""

    def __init__(self, data: np.ndarray, seed: int) -> None:
        up, self.down = powers(len(data) + 1)
        self.data = data
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(random_words(256, seed)[data] * up[:-1], out=self.prefix[1:])

    def of(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return (self.prefix[start + size] - self.prefix[start]) * self.down[start]

    def sliding(self, size: int) -> np.ndarray:
        """Mixed hash of every piece of ``size`` bytes."""
        return mixed((self.prefix[size:] - self.prefix[:-size]) * self.down[: len(self.prefix) - size])


def common_extension(text: HashedBytes, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and b, up to ``depth``, by binary search on hashes."""
    length = np.where(text.of(a, depth) == text.of(b, depth), depth, 0)
    open_ = np.flatnonzero(length == 0)
    a, b, known = a[open_], b[open_], length[open_]
    step = 1 << (depth.bit_length() - 1)
    while step:
        tried = known + step
        fits = np.flatnonzero(tried < depth)
        same = text.of(a[fits], tried[fits]) == text.of(b[fits], tried[fits])
        known[fits[same]] = tried[fits[same]]
        step >>= 1
    length[open_] = known
    return length


def _precedes(text: HashedBytes, a: np.ndarray, b: np.ndarray, depth: int, or_equal: np.ndarray) -> np.ndarray:
    length = common_extension(text, a, b, depth)
    at = np.minimum(length, depth - 1)
    return np.where(length >= depth, or_equal, text.data[a + at] < text.data[b + at])


def _first_bytes(text: HashedBytes, starts: np.ndarray) -> np.ndarray:
    key = np.zeros(len(starts), np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | text.data[starts + i].astype(np.uint64)
    return key


def suffix_sort(text: HashedBytes, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at ``starts`` by their first ``depth`` (8 at least) bytes, and whether each equals the one before.

    Every suffix must have ``depth`` bytes. Suffixes that agree on 8 bytes form the groups that are merge-sorted;
    runs that are in order already, as those of equal suffixes, aren't merged.
    Neighbours that the hashes call equal are compared byte by byte; after a collision the bytes themselves are sorted.
    """
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, bool)
    head = _first_bytes(text, starts)
    order = np.argsort(head, kind="stable")
    new = np.append(True, head[order][1:] != head[order][:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    sizes = np.bincount(first, minlength=len(order))[first]
    width, most = 1, int(sizes.max())
    while width < most:
        at = np.flatnonzero(sizes > width)
        # the second runs of all pairs, and whether their first elements come before the last ones of the first runs
        second = at[(at - first[at]) % (2 * width) == width]
        wrong = ~_precedes(text, starts[order[second - 1]], starts[order[second]], depth, np.ones(len(second), bool))
        if not wrong.any():
            width *= 2
            continue
        unsorted = np.zeros(len(order), bool)
        unsorted[second[wrong] - width] = True
        pair_start = first[at] + (at - first[at]) // (2 * width) * (2 * width)
        at = at[unsorted[pair_start]]
        inside, begin, end = at - first[at], first[at], first[at] + sizes[at]
        run = inside // width
        left = run % 2 == 0
        lo = np.minimum(begin + np.where(left, run + 1, run - 1) * width, end)
        hi = np.minimum(lo + width, end)
        other = lo.copy()
        mine = starts[order[at]]
        for _ in range(width.bit_length()):
            open_ = np.flatnonzero(lo < hi)
            mid = (lo[open_] + hi[open_]) >> 1
            # an element of the right run goes behind equal ones of the left run
            before = _precedes(text, starts[order[mid]], mine[open_], depth, ~left[open_])
            lo[open_[before]] = mid[before] + 1
            hi[open_[~before]] = mid[~before]
        pair = begin + (run // 2) * 2 * width
        to = pair + (inside - run * width) + (lo - other)
        moved = order.copy()
        moved[to] = order[at]
        order = moved
        width *= 2
    a, b = starts[order[:-1]], starts[order[1:]]
    same = np.append(False, common_extension(text, a, b, depth) >= depth)
    if not _verified(text.data, starts[order], same, depth):
        pieces = [text.data[s : s + depth].tobytes() for s in starts]
        order = np.array(sorted(range(len(starts)), key=pieces.__getitem__), np.int64)
        same = np.array([False] + [pieces[x] == pieces[y] for x, y in zip(order[:-1], order[1:])])
    return order, same


def _verified(data: np.ndarray, starts: np.ndarray, same: np.ndarray, depth: int) -> bool:
    equal = np.flatnonzero(same)
    for part in np.array_split(equal, len(equal) // 20_000 + 1):
        for i in range(depth):
            if (data[starts[part] + i] != data[starts[part - 1] + i]).any():
                return False
    return True
