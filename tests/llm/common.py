"""Tables with every awkward case, and brute-force versions of what the operators compute."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, drop string, rank int, h double, component_id string, slot int, kind int"


def prose(seed: int, words: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" if i % 12 else f"w{rng.randrange(vocabulary)}." for i in range(words))


def table(spark, texts, extra=("x", 1, 0.5, "y", 2, 3), first_id=0):
    """Documents with columns that clash with names inside the operators."""
    rows = [(first_id + i, t, "en", f"src{i % 3}", len(t or ""), *extra) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def messy(spark):
    """Nulls in every column, empty and blank texts, repeated rows, ties, a very long text."""
    base = prose(1, 80)
    long = " ".join(prose(100 + i, 1000, 5000) for i in range(60))
    rows = [
        (1, base, "en", "src0", len(base), "x", 1, 0.5, "y", 2, 3),
        (2, base, "en", "src0", len(base), "x", 1, 0.5, "y", 2, 3),
        (2, base, "en", "src0", len(base), "x", 1, 0.5, "y", 2, 3),
        (3, None, None, None, None, None, None, None, None, None, None),
        (None, base, "en", "src1", None, "x", None, None, "y", None, 3),
        (None, None, None, None, None, None, None, None, None, None, None),
        (4, "", "", "", 0, "", 0, 0.0, "", 0, 0),
        (5, " \n\t \n", "de", "src1", 5, "x", 1, 0.5, "y", 2, 3),
        (6, "two words", "de", "src1", 9, "x", 1, 0.5, "y", 2, 3),
        (7, "TWO\twords", "de", "src1", 9, "x", 1, 0.5, "y", 2, 3),
        (8, long, "fr", "src2", len(long), "x", 1, 0.5, "y", 2, 3),
        (9, "ÀÉ ñandú 漢字 \U0001f600 !!! ***", "es", "src2", 20, "x", 1, 0.5, "y", 2, 3),
    ]
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def word_set(text, size):
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    return {tuple(words)} if len(words) < size else {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def components(ids, linked):
    """Smallest member of each id's component, for a test of pairs."""
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(ids)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if linked(a, b):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def near_components(texts: dict, size: int, percent: int) -> dict:
    sets = {i: word_set(t, size) for i, t in texts.items()}

    def linked(a, b):
        x, y = sets[a], sets[b]
        return bool(x and y) and 100 * len(x & y) >= percent * len(x | y)

    return components(sets, linked)


def deduped_lines(docs: list[tuple], min_chars: int = 40, min_docs: int = 5) -> dict:
    """(lines, dropped, kept) of (id, text) rows."""
    white = " \t\n\x0b\x0c\r"
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

    def key(line):
        k = line.strip(white).translate(lower)
        return k if len(k) >= min_chars else None

    held = {}
    for i, text in docs:
        for line in (text or "").split("\n"):
            if i is not None and key(line):
                held.setdefault(key(line), set()).add(i)
    gone = {k: max(v) for k, v in held.items() if len(v) >= min_docs}
    out = {}
    for i, text in docs:
        lines = (text or "").split("\n")
        stay = [x for x in lines if i is None or key(x) not in gone or gone[key(x)] == i]
        out[i] = (len(lines), len(lines) - len(stay), "\n".join(stay))
    return out


def without_repeats(docs: dict, length: int = 100) -> dict:
    """(bytes, removed, spans, kept) of texts by id."""
    seen, out = set(), {}
    for i in sorted(docs):
        data = (docs[i] or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            window = data[p : p + length]
            if window in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(window)
        kept = bytes(c for c, g in zip(data, gone) if not g)
        spans = sum(1 for p, g in enumerate(gone) if g and (p == 0 or not gone[p - 1]))
        out[i] = (len(data), sum(gone), spans, kept)
    return out
