"""Token counts under a unigram model by dynamic programming over a trie of pre-tokens.

The best segmentation of a prefix is a property of the prefix alone, so each node of a trie
of distinct pre-tokens keeps the forward score of its prefix and the number of tokens of its
best segmentation; a pre-token costs work only for the nodes that no earlier one made, and
its count stands at its terminal node.  Pre-tokens are the independent parts of pretokens.

No public vocabulary file here is a unigram model and none may be trained, so the pieces of
a byte-fallback vocabulary get log-probabilities by a fixed rule from their rank (Zipf's
law); the rule's two numbers are parameters.  A character outside the vocabulary counts a
token for each of its UTF-8 bytes and scores far below every piece.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from sentencepiece import SentencePieceProcessor

from lodestone.llm.common import ready
from lodestone.llm.piece_codec import public_model
from lodestone.llm.pretokens import LONG_KEY, SPACE, Memo, split_pieces

ZIPF_SHIFT, ZIPF_POWER, UNKNOWN_PENALTY = 2.7, 1.0, 10.0
#: Nodes that a worker's trie holds at most, some 100 MB, and bytes of its terminal counts.
NODES, TERMINAL_BYTES = 500_000, 160 << 20


def unigram_scores(path: str, shift: float = ZIPF_SHIFT, power: float = ZIPF_POWER) -> dict[str, float]:
    """Log-probabilities of the ordinary pieces in the order of their ids."""
    p = SentencePieceProcessor(model_file=path)
    pieces = [p.id_to_piece(i) for i in range(p.get_piece_size()) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i))]
    weights = [(rank + shift) ** -power for rank in range(1, len(pieces) + 1)]
    total = math.log(sum(weights))
    return {x: math.log(w) - total for x, w in zip(pieces, weights, strict=True)}


class CountTrie:
    """Counts tokens of pre-tokens; nodes are numbers, edges a dictionary by node and character."""

    def __init__(self, scores: dict[str, float], most: int = NODES):
        self.scores, self.most = scores, most
        self.longest = max(map(len, scores), default=1)
        self.unknown = min(scores.values(), default=0.0) - UNKNOWN_PENALTY
        self.clear()
        self.terminal = Memo(self.count_of, TERMINAL_BYTES)
        self.count = self.terminal.__getitem__

    def clear(self) -> None:
        self.edges: dict[int, int] = {}
        self.forward, self.tokens = [0.0], [0]

    def count_of(self, pretoken: str) -> int:
        return self.insert(pretoken) if len(pretoken) <= LONG_KEY else self.unshared(pretoken)

    def unshared(self, pretoken: str) -> int:
        """The same scores for a pre-token so long that no other shares much of it: they leave the trie as it is."""
        text, scores, longest = SPACE + pretoken, self.scores, self.longest
        forward, tokens = [0.0] * (longest + 1), [0] * (longest + 1)  # of the last places, by place modulo their number
        for end, char in enumerate(text, 1):
            best, n = -math.inf, 0
            for start in range(max(0, end - longest), end):
                score = scores.get(text[start:end])
                if score is not None and forward[start % (longest + 1)] + score > best:
                    best, n = forward[start % (longest + 1)] + score, tokens[start % (longest + 1)] + 1
            last = (end - 1) % (longest + 1)
            if char not in scores and forward[last] + self.unknown > best:
                best, n = forward[last] + self.unknown, tokens[last] + len(char.encode("utf-8", "surrogatepass"))
            forward[end % (longest + 1)], tokens[end % (longest + 1)] = best, n
        return tokens[len(text) % (longest + 1)]

    def insert(self, pretoken: str) -> int:
        """Tokens of the space mark and the pre-token, whose path the trie gains."""
        if len(self.forward) >= self.most:
            self.clear()
        text, path, node = SPACE + pretoken, [0], 0
        edges, forward, tokens, scores = self.edges, self.forward, self.tokens, self.scores
        for end, char in enumerate(text, 1):
            edge = node << 21 | ord(char)
            child = edges.get(edge)
            if child is None:
                best, n = -math.inf, 0
                for start in range(max(0, end - self.longest), end):  # longest piece first, as ties go
                    score = scores.get(text[start:end])
                    if score is not None and forward[path[start]] + score > best:
                        best, n = forward[path[start]] + score, tokens[path[start]] + 1
                if char not in scores and forward[node] + self.unknown > best:
                    best, n = forward[node] + self.unknown, tokens[node] + len(char.encode("utf-8", "surrogatepass"))
                child = edges[edge] = len(forward)
                forward.append(best)
                tokens.append(n)
            node = child
            path.append(node)
        return tokens[node]


@cache
def trie(path: str, shift: float, power: float) -> CountTrie:
    return CountTrie(unigram_scores(path, shift, power))


def token_counts(docs: DataFrame, model: str | None = None, shift: float = ZIPF_SHIFT, power: float = ZIPF_POWER) -> DataFrame:
    """doc_id, n_pretokens and n_tokens of each whole text.

    Null and empty texts have no pre-tokens.  A text of any length is counted whole; a stretch
    without spaces of more than LONG_KEY characters is scored by itself, and memory stays
    bounded in bytes.  Texts that tie in score take the longest first piece.  Rows are independent: repeated rows repeat,
    null doc_ids stay, an empty table gives an empty result, other columns of docs are left out.
    """
    ready(docs.sparkSession)
    path = model or public_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = trie(path, shift, power)
        for batch in batches:
            parts, totals = [], []
            for text in batch.column(1).to_pylist():
                words = split_pieces(text or "")
                parts.append(len(words))
                totals.append(sum(map(counter.count, words)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(parts, pa.int64()), pa.array(totals, pa.int64())], ["doc_id", "n_pretokens", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_pretokens long, n_tokens long")
