"""SentencePiece (merge-type) encoding by backtracking, and decoding.

A sequence of tokens is what the merges give if, and only if, every two neighbours are
compatible: merging the joined text of the two gives the same two tokens back.  So the text
is read from the left with the longest match of an Aho-Corasick automaton; a token that is
not compatible with the one before it gives way to its next shorter prefix; when none is
left, the token before is taken back.  A bit for each position keeps where all of that has
already failed, so no position is tried twice with the same outcome.  Compatibility is found
by re-merging the pair and kept.

Characters outside the vocabulary split the text, as no merge holds them; they become byte
tokens.  Space marks start a new independent part after any other character (see
pretokens), and parts repeat, so each is encoded once a worker while it is remembered.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from sentencepiece import SentencePieceProcessor

from lodestone.llm.common import ready
from lodestone.llm.pretokens import ENTRY_BYTES, SPACE, Memo, split_pieces

MODEL = "piece_bpe_32k.model"
#: Bytes of parts, and pairs (some 150 bytes each), that a worker remembers.
PART_BYTES, PAIRS = 160 << 20, 200_000


def public_model(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceEncoder:
    """Encodes and decodes with the pieces and scores of a byte-fallback BPE model file."""

    def __init__(self, path: str):
        self.processor = p = SentencePieceProcessor(model_file=path)
        ids = range(p.get_piece_size())
        self.byte_ids = [p.piece_to_id(f"<0x{i:02X}>") for i in range(256)]
        self.bos, self.eos = p.bos_id(), p.eos_id()
        self.pieces = {p.id_to_piece(i): i for i in ids if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i))}
        self.text = {i: x for x, i in self.pieces.items()}
        self.score = {x: p.get_score(i) for x, i in self.pieces.items()}
        self.automaton = ahocorasick.Automaton()
        for x, i in self.pieces.items():
            if self.merged(x) == [i]:  # a piece that merging never makes can't be a token
                self.automaton.add_word(x, (len(x), i))
        self.automaton.make_automaton()
        self.fits = Memo(lambda pair: self.merged(self.text[pair[0]] + self.text[pair[1]]) == list(pair), PAIRS * ENTRY_BYTES)
        self.parts = Memo(lambda part: np.array(self.encode_part(SPACE + part), "<u4").tobytes(), PART_BYTES)

    def merged(self, text: str) -> list[int]:
        """Plain merging: the best-scored adjacent pair first, the leftmost of equals."""
        symbols, score = list(text), self.score
        after, before = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < len(symbols) and (s := score.get(x := symbols[i] + symbols[j])) is not None:
                heapq.heappush(heap, (-s, i, x))

        for i in range(len(symbols) - 1):
            offer(i, i + 1)
        while heap:
            _, i, x = heapq.heappop(heap)
            j = after[i]
            if not symbols[i] or j >= len(symbols) or symbols[i] + symbols[j] != x:
                continue
            symbols[i], symbols[j], after[i] = x, "", after[j]
            if after[j] < len(symbols):
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [self.pieces.get(x, -1) for x in symbols if x]

    def encode_part(self, part: str) -> list[int]:
        """Ids of one independent part."""
        if (i := self.pieces.get(part)) is not None and self.fits_alone(part):
            return [i]
        matches: list[list[tuple[int, int]]] = [[] for _ in part]
        for end, match in self.automaton.iter(part):
            matches[end - match[0] + 1].append(match)  # of growing length
        out, start = [], 0
        for at, found in enumerate(matches):
            if not found:  # outside the vocabulary
                out += self.backtrack(matches, start, at)
                out += [self.byte_ids[b] for b in part[at].encode("utf-8", "surrogatepass")]
                start = at + 1
        return out + self.backtrack(matches, start, len(part))

    def fits_alone(self, part: str) -> bool:
        return self.automaton.exists(part)

    def backtrack(self, matches: list[list[tuple[int, int]]], start: int, end: int) -> list[int]:
        """Tokens of the characters from start to end, all of the vocabulary."""
        out: list[int] = []
        choice: list[int] = []  # which match was taken at each step
        failed, at, fits = 0, start, self.fits
        k = len(matches[at]) - 1 if start < end else -1
        while at < end:
            here = matches[at]
            while k >= 0:
                length, token = here[k]
                if not failed >> (at + length) & 1 and at + length <= end and (not out or fits[out[-1], token]):
                    break
                k -= 1
            if k >= 0:
                out.append(token)
                choice.append(k)
                at += length
                k = len(matches[at]) - 1 if at < end else -1
            else:
                failed |= 1 << at
                k = choice.pop()
                at -= len(self.text[out.pop()])
                k -= 1
        return out

    def ids(self, text: str | None) -> bytes:
        """Ids of a whole text, with begin and end, as little-endian unsigned 32-bit integers."""
        parts = b"".join(map(self.parts.__getitem__, split_pieces(text or "")))
        return b"".join((self.bos.to_bytes(4, "little"), parts, self.eos.to_bytes(4, "little")))

    def decoded(self, ids: bytes) -> str:
        return self.processor.decode(np.frombuffer(ids, "<u4").tolist())


@cache
def encoder(path: str) -> PieceEncoder:
    """One encoder a worker."""
    return PieceEncoder(path)


def encode_decode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit, with begin and end) and the text decoded from them.

    Null texts count as empty: begin and end only, decoded to an empty text.  Each row is
    worked on by itself, so repeated rows repeat, null doc_ids stay and an empty table gives
    an empty result; the longest text needs memory in proportion to itself alone.  Other columns
    of docs are left out, so none can clash.
    """
    ready(docs.sparkSession)
    path = model or public_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            ids = [e.ids(x) for x in batch.column(1).to_pylist()]
            texts = [e.decoded(x) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids binary, decoded string")
