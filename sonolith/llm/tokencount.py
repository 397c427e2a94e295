"""Token counts under a unigram model, with the dynamic programme shared along a trie.

Distinct pre-tokens (words with a leading mark) go into a trie. A node holds the forward score of its
prefix, the best sum of piece scores that spells it, and the number of pieces of that best spelling.
A prefix that many pre-tokens share is scored once; a pre-token's count stands at its terminal node.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from operator import mul

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Marks the start of a word, as the vocabulary does.
MARK = "▁"
#: Nodes and bytes of pre-tokens that a worker's trie holds: memory bounds that change no result.
NODES, BYTES = 400_000, 96 << 20
#: Score of one byte of a character that no piece spells.
BYTE_SCORE = -20.0


@lru_cache(maxsize=2)
def pieces(vocabulary: str) -> dict[str, float]:
    """Pieces with log probabilities by Zipf's law of their rank in the vocabulary (an ordered list)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
    normal = [
        model.id_to_piece(i) for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    ]
    total = math.log(sum(1 / (r + 1) for r in range(len(normal))))
    return {p: -math.log(r + 1) - total for r, p in enumerate(normal)}


class _Terminal(dict):
    """Counts of the pre-tokens seen, by their UTF-8; what is missing is scored along the trie."""

    def __init__(self, trie: Trie):
        self.trie = trie

    def __missing__(self, word: bytes) -> int:
        self[word] = n = self.trie.insert(MARK + word.decode("utf-8", "replace"), len(word))
        return n


class Trie:
    """Forward scores of all prefixes seen, in at most ``limit`` nodes and ``most_bytes`` of pre-tokens.

    A prefix beyond the last node that fits is scored alike, along the word, but not kept for others. When
    nodes run out, the next word starts the nodes anew, when bytes do, the stored counts; both are memory
    bounds that change no result.
    """

    def __init__(self, scores: dict[str, float], limit: int = NODES, most_bytes: int = BYTES):
        self.limit, self.most_bytes = limit, most_bytes
        # Every tail of every piece, with the score of those that are pieces: what is no tail ends the search.
        self.tails: dict[str, float | None] = {p[i:]: None for p in scores for i in range(len(p))} | scores
        self.longest = max(map(len, scores), default=1)
        self.terminal, self.held = _Terminal(self), 0
        self._clear()

    def _clear(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.score, self.pieces = [0.0], [0]

    def count(self, word: str) -> int:
        """Pieces of the best spelling of a word; of equal scores the one with fewer pieces."""
        return self.terminal[word.encode("utf-8", "replace")]

    def total(self, words: Counter) -> int:
        """Pieces of all words, given by their UTF-8."""
        return sum(map(mul, words.values(), map(self.terminal.__getitem__, words)))

    def insert(self, word: str, size: int) -> int:
        if len(self.score) >= self.limit:
            self._clear()
        if self.held > self.most_bytes:
            self.terminal.clear()
            self.held = 0
        self.held += size + 100
        child, score, count, tails, limit = self.child, self.score, self.pieces, self.tails, self.limit
        scores, counts, node, start = [0.0], [0], 0, 0  # of the prefixes of start, start + 1, ... characters
        for j, c in enumerate(word, 1):
            key = (node, c)
            node = child.get(key)
            if node is None:
                size = len(c.encode("utf-8", "surrogatepass"))
                best, fewest = scores[-1] + size * BYTE_SCORE, counts[-1] + size
                for i in range(j - 1, start - 1, -1):
                    own = tails.get(word[i:j], 1.0)  # log probabilities are never positive
                    if own is None:
                        continue
                    if own > 0:
                        break
                    if (total := scores[i - start] + own) >= best:
                        n = counts[i - start] + 1
                        fewest = n if total > best else min(n, fewest)
                        best = total
                if key[0] is not None and len(score) < limit:
                    node = child[key] = len(score)
                    score.append(best)
                    count.append(fewest)
            else:
                best, fewest = score[node], count[node]
            scores.append(best)
            counts.append(fewest)
            if len(scores) > 65_536:
                start = j - self.longest
                del scores[: -self.longest - 1], counts[: -self.longest - 1]
        return counts[-1]


@lru_cache(maxsize=2)
def worker_trie(vocabulary: str) -> Trie:
    """One trie for all tasks of a worker."""
    return Trie(pieces(vocabulary))


def vocabulary_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_words, n_tokens) for each row of ``docs``; a narrow pass, nothing is shuffled.

    Null, empty and blank texts count 0. Words of any length are scored alike, very long texts whole, in
    memory bounded by the text. Repeated rows and null ids are kept; other columns are ignored; an empty
    table gives an empty result.
    ``vocabulary`` is a sentencepiece file on every executor; by default the installed one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = worker_trie(vocabulary or vocabulary_path())
        for batch in batches:
            words, tokens = [], []
            for text in batch.column(1):
                found = Counter((text.as_py() or b"").split())  # cuts at exactly x20 and x09-x0D
                words.append(found.total())
                tokens.append(trie.total(found))
            yield pa.record_batch([batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_tokens long")
