import hashlib
import random
import zlib

import numpy as np
import pytest

from heliogrid.llm import queries, runs
from tests.llm import common


def brute(words, exponent=4, least=6):
    """(start, length, period) of all runs, by the definition: every period, every stretch."""
    n, out = len(words), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, exponent * q):
                stretch = words[i : j + q]
                if not any(stretch[p:] == stretch[:-p] for p in range(1, q)):
                    out.append((i, j + q - i, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def found(texts):
    ids, bounds, numbers = [], [0], {}
    for words in texts:
        ids += [numbers.setdefault(w, len(numbers)) for w in words]
        bounds.append(len(ids))
    got = runs.find_runs(np.array(ids, np.int64), np.array(bounds, np.int64))
    out = [[] for _ in texts]
    for a, z, q in got.tolist():
        k = int(np.searchsorted(bounds, a, "right")) - 1
        out[k].append((a - bounds[k], z - a, q))
    return out


def periodic(rng, n, alphabet):
    """Random words with stretches of random periods in them, some inside others, some with a flaw."""
    words = [rng.randrange(alphabet) for _ in range(n)]
    for _ in range(rng.randrange(4)):
        p = rng.randrange(1, max(2, n // 4))
        a = rng.randrange(n)
        e = min(n, a + rng.randrange(3 * p, 9 * p + 2))
        for i in range(a, e):
            words[i] = words[a + (i - a) % p]
        if rng.random() < 0.3:
            words[rng.randrange(n)] = -1
    return words


@pytest.mark.parametrize("alphabet", [1, 2, 3, 50])
def test_runs_of_random_texts(alphabet):
    rng = random.Random(alphabet)
    texts = [periodic(rng, rng.choice([0, 1, 5, 6, 7, 8, 20, 33, 64, 150, 400]) or 1, alphabet) for _ in range(250)]
    texts += [[], [1], [1] * 5, [1] * 6, [1, 2] * 4, ([1] * 8 + [2]) * 5, ([1, 2, 3, 4] * 5 + [9]) * 6, [1, 2] * 3]
    assert found(texts) == [brute(t) for t in texts]


def test_runs_in_runs():
    rng = random.Random(9)
    word = [0]
    for _ in range(5):  # every level repeats the one below
        word = word * rng.randrange(4, 6) + [rng.randrange(3)]
    assert found([word[:1500]]) == [brute(word[:1500])]
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 800:
        fib.append(fib[-1] + fib[-2])
    assert found([fib[-1], fib[-1] * 4]) == [brute(fib[-1]), brute(fib[-1] * 4)]


def test_exponent_below_four_is_refused():
    with pytest.raises(ValueError):
        runs.RunRule(exponent=3)


def expected(doc_id, text, plant=True):
    words = [w.decode() for w in runs.WORD.findall((text or "").encode())]
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if plant and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    got = brute(words)
    gone = {i for a, m, q in got for i in range(a + q, a + m)}
    best = None
    for r in got:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    digest = sha("".join(f"{a},{m},{q}\n" for a, m, q in got)), sha(" ".join(w for i, w in enumerate(words) if i not in gone))
    return (doc_id, len(got), *(best or (None,) * 3), best and 1000 * best[1] // best[2], *digest)


def test_query_on_whole_documents(spark, tmp_path):
    rng = random.Random(4)
    texts = [" ".join(map(str, periodic(rng, rng.randrange(1, 200), rng.choice([2, 5, 400])))) for _ in range(120)]
    texts += ["", None, " \n\t ", "a", "A a A a a A a", "x x\x1fx x x x x", "\x0b".join("é漢" * 1 for _ in range(9)), " \x0cz z z z z z"]
    docs = common.table(spark, texts).unionByName(common.messy(spark).selectExpr("doc_id + 5000 as doc_id", "* except (doc_id)"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    want = sorted((expected(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()), key=str)
    assert got == want and any(r[1] > 1 for r in got) and sum(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in got) > 5


def test_awkward_rows(spark):
    rows = runs.periodic_runs(common.messy(spark)).collect()
    assert len(rows) == 12 and all(r.strongest is None and r.runs == [] and r.collapsed == "" for r in rows if r.n_words == 0)
    assert sorted(r.doc_id for r in rows if r.n_words == 0 and r.doc_id) == [3, 4, 5]
    assert runs.periodic_runs(common.empty(spark)).count() == 0


def test_collapsed_text_keeps_the_first_period(spark):
    (row,) = runs.periodic_runs(common.table(spark, ["say it:\nla  la la la\tla la la. one two one two one two one two end"])).collect()
    assert row.collapsed == "say it: la la. one two end"
    assert [tuple(r) for r in row.runs] == [(2, 6, 1), (9, 8, 2)] and tuple(row.strongest) == (2, 6, 1)
