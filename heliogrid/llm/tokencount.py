"""Token counts of texts under a unigram segmentation, by dynamic programming that is shared over a trie of pre-tokens.

A text's pre-tokens are its runs without white space, each with the mark of a word's beginning. Every task inserts its
distinct pre-tokens into a trie; a node holds the best score of any segmentation of the prefix that leads to it
and its number of tokens, computed once from the nodes above, so pre-tokens with a common beginning share that work.
A text's count is the sum of its pre-tokens' terminal counts.

The vocabulary is read from a public file by the driver and travels with the tasks (its size is fixed by the file). A
piece's score is the logarithm of a Zipf share of its rank; characters that no piece covers cost their UTF-8 bytes.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from heliogrid.llm.common import byte_chunks, id_text

CHUNK = 1 << 20
MARK = "▁"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


@dataclass(frozen=True)
class Vocabulary:
    scores: dict[str, float]
    byte_score: float

    def tails(self) -> dict[str, float | None]:
        """Every ending of a piece: the score of those that are pieces themselves, None for the others."""
        out: dict[str, float | None] = {}
        for piece in self.scores:
            for begin in range(1, len(piece)):
                out.setdefault(piece[begin:], None)
        return {**out, **self.scores}


def load(path: str = PIECES, shift: float = 10.0) -> Vocabulary:
    """Pieces of a sentencepiece file, in the order of their ranks, with scores -log(rank + shift)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    normal = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    normal.sort(key=lambda i: (-model.get_score(i), i))
    scores = {model.id_to_piece(i): -math.log(rank + shift) for rank, i in enumerate(normal)}
    return Vocabulary(scores, -math.log(len(scores) + shift) - 10.0)


class TokenTrie:
    """Forward scores and token counts of all prefixes of the inserted pre-tokens; forgets all beyond ``most`` nodes."""

    def __init__(self, vocabulary: Vocabulary, most: int = 400_000) -> None:
        self.tails, self.byte_score, self.most = vocabulary.tails(), vocabulary.byte_score, most
        self.clear()

    def clear(self) -> None:
        self.children: dict[int, int] = {}  # node and code point to node
        self.score, self.count = array("d", [0.0]), array("l", [0])
        self.terminal: dict[str, int] = {}

    def __getitem__(self, word: str) -> int:
        """Tokens of a pre-token (without its mark)."""
        known = self.terminal.get(word)
        if known is None:
            if len(self.score) > self.most:
                self.clear()
            known = self.terminal[word] = self.count[self.insert(MARK + word)]
        return known

    def insert(self, word: str) -> int:
        """Node of a word; nodes that aren't there yet get their values from the path above.

        A node's value is the best score of any segmentation, of equal ones that with the fewest tokens. Pieces that end
        at a character are looked for from short to long, and no further than some piece has that ending.
        """
        children, scores, counts, tails = self.children, self.score, self.count, self.tails
        node, path, known = 0, [0], True
        for c in word:
            key = node << 21 | ord(c)
            node = children.get(key, -1) if known else -1
            if node < 0:
                known = False
                node = children[key] = len(scores)
                end = len(path)
                size = 1 if c < "\x80" else len(c.encode("utf-8", "surrogatepass"))
                best, count = scores[path[-1]] + size * self.byte_score, counts[path[-1]] + size
                for begin in range(end - 1, -1, -1):
                    piece = tails.get(word[begin:end], 0)
                    if piece == 0:
                        break
                    if piece is not None:
                        above = path[begin]
                        score = scores[above] + piece
                        if score >= best and (score > best or counts[above] + 1 < count):
                            best, count = score, counts[above] + 1
                scores.append(best)
                counts.append(count)
            path.append(node)
        return node


def token_counts(docs: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_pretokens, n_tokens of every row of ``docs``; null and empty texts have none. Rows keep their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = TokenTrie(vocabulary)
        for part, texts in byte_chunks(batches, "text", CHUNK):
            words = [t.decode("utf-8", "replace").split() for t in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(map(len, words), pa.int64()), pa.array([sum(map(trie.__getitem__, w)) for w in words], pa.int64())],
                names=["doc_id", "n_pretokens", "n_tokens"],
            )

    return id_text(docs, key, text).mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long")
