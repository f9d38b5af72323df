import random

from heliogrid.llm import tokencount
from tests.llm import common


def brute(word, v):
    word = tokencount.MARK + word
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        size = len(word[end - 1].encode())
        ways = [(best[end - 1][0] + size * v.byte_score, -best[end - 1][1] - size)]
        ways += [(best[b][0] + v.scores[word[b:end]], -best[b][1] - 1) for b in range(end) if word[b:end] in v.scores]
        score, n = max(ways)
        best.append((score, -n))
    return best[-1][1]


SMALL = tokencount.Vocabulary({"▁": -1.0, "▁ab": -1.5, "a": -2.0, "b": -2.0, "ab": -2.5, "abc": -3.0, "c": -2.0, "bc": -2.2, "é": -4.0}, -15.0)


def test_trie_matches_dynamic_programming_by_word():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcé漢") for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    for most in (400_000, 50):
        trie = tokencount.TokenTrie(SMALL, most)
        assert [trie[w] for w in words] == [brute(w, SMALL) for w in words]


def test_public_vocabulary(spark):
    v = tokencount.load()
    texts = [common.prose(i, 50) + " The quick brown fox übermäßig 漢字 \U0001f600 #@!" for i in range(10)]
    for r in tokencount.token_counts(common.table(spark, texts), v).collect():
        words = texts[r.doc_id].split()
        assert (r.n_pretokens, r.n_tokens) == (len(words), sum(brute(w, v) for w in words))


def test_awkward_rows(spark):
    rows = tokencount.token_counts(common.messy(spark), SMALL).collect()
    assert len(rows) == 12 and all(r.n_tokens == 0 for r in rows if r.doc_id in (3, 4, 5))
    assert next(r for r in rows if r.doc_id == 8).n_pretokens == 60_000
    assert tokencount.token_counts(common.empty(spark), SMALL).count() == 0
