"""How the tokens of two tokenizers cover the same bytes, and how often their ids meet in a corpus.

A text, with a space before it, is cut by both tokenizers.  Byte offsets where tokens of both end cut
the tokens into groups; every token of the first in a group is linked with every one of the second.
A pair's count is the number of documents that hold it linked.

Texts are taken in blocks of bounded size.  A block keeps, for each pair of ids, which of its documents
hold it and how often: a posting.  Postings are summed to counts by pair before they are shuffled, and
counts to the highest by id of the first tokenizer.  Then postings and counts are cogrouped by the
pair's ids in a sort-merge join, whose sorted streams spill; each task turns its postings into
contributions to documents and adds up what it holds of each document, and all are summed by
document, a block at a time.  Rows of a pair are at most as many as blocks, so no id is hot.

Both tokenizers part at a single space between two characters that aren't white space: the first's
pattern starts a new match there, and no piece of the second holds a space after another character.
Such units repeat, so a block cuts each of its distinct units once, many in one call.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import cache, cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from lodestone.llm.common import give_back, ready, stored, thrifty

FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Characters of text and documents of a block at most (a longer text is a block of its own), occurrences of pairs of a block that
#: are dealt with at a time, and entries of cogrouped postings that a task adds up at a time.
BLOCK_CHARS, BLOCK_DOCS, OCCURRENCES, ENTRIES = 1 << 20, 60_000, 500_000, 2_000_000
#: Characters that one call gets, and from which a unit goes to the library whose work doesn't grow with its square.
CALL_CHARS, LONG_UNIT = 1 << 12, 500
#: Rows of an Arrow batch of postings.
POSTING_ROWS = 20_000
_CUT = re.compile(r"(?<=\S) (?=\S)")


def public_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[str, int]:
    """The letters of byte-level vocabularies: printable bytes of Latin-1 stand for themselves, others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class TokenBytes:
    """Both tokenizers, and the bytes of each id."""

    def __init__(self, first: str, second: str):
        import public_tokenizers

        with open(first, encoding="utf-8") as f:
            spec = json.load(f)
        letters, special = _byte_letters(), {x["content"] for x in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in x): i for x, i in spec["model"]["vocab"].items() if x not in special}
        self.first = tiktoken.Encoding("first", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.file = first
        self.second = p = SentencePieceProcessor(model_file=second)
        size = max(ranks.values()) + 1
        self.first_bytes: list[bytes] = [b""] * size
        for x, i in ranks.items():
            self.first_bytes[i] = x
        self.second_bytes = []
        for i in range(p.get_piece_size()):
            piece = p.id_to_piece(i)
            self.second_bytes.append(bytes([int(piece[3:5], 16)]) if p.is_byte(i) else b"" if p.is_control(i) or p.is_unknown(i) else piece.replace("▁", " ").encode())
        self.first_sizes = np.array([len(x) for x in self.first_bytes], np.int64)
        self.second_sizes = np.array([len(x) for x in self.second_bytes], np.int64)
        ids = [(range(size), ","), (range(size), "|"), (range(len(self.second_bytes)), ","), (range(len(self.second_bytes)), ";")]
        self.names = np.array([f"{i}{end}" for own, end in ids for i in own], object)

    @cached_property
    def first_of_long(self) -> Tokenizer:
        out = Tokenizer.from_file(self.file)
        out.encode_special_tokens = True  # their strings in texts are plain text
        return out

    def cut(self, text: str, long: bool = False) -> tuple[list[int], list[int]] | None:
        """Ids of both for a text that starts with a space; None if the bytes of either differ from it."""
        a = self.first_of_long.encode(text, add_special_tokens=False).ids if long else self.first.encode_ordinary(text)
        b = self.second.encode(text[1:])
        raw = text.encode()
        same = b"".join(map(self.first_bytes.__getitem__, a)) == raw and b"".join(map(self.second_bytes.__getitem__, b)) == raw
        return (a, b) if same else None

    def cut_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of both for all units in order, and the bytes of each unit, 0 for one without tokens."""
        a: list[int] = []
        b: list[int] = []
        chars = np.fromiter(map(len, units), np.int64, len(units))
        sizes = np.fromiter((len(x) if x.isascii() else len(x.encode()) for x in units), np.int64, len(units))

        def take(low: int, high: int) -> None:
            if low < high:
                found = self.cut("".join(units[low:high]), bool(high == low + 1 and chars[low] > LONG_UNIT))
                if found:
                    a.extend(found[0])
                    b.extend(found[1])
                elif high == low + 1:
                    sizes[low] = 0
                else:
                    for i in range(low, high):
                        take(i, i + 1)

        # what follows would change how white space at the end of a unit is cut
        apart = [i for i, x in enumerate(units) if x[-1].isspace() or len(x) > LONG_UNIT]
        ends, start = np.cumsum(chars), 0
        for stop in [*apart, len(units)]:
            while start < stop:
                done = ends[start - 1] if start else 0
                high = min(stop, max(start + 1, int(np.searchsorted(ends, done + CALL_CHARS, "right"))))
                take(start, high)
                start = high
            if stop < len(units):
                take(stop, stop + 1)
                start = stop + 1
        return np.array(a, np.int64), np.array(b, np.int64), sizes


@cache
def token_bytes(first: str, second: str) -> TokenBytes:
    """One pair of tokenizers a worker."""
    return TokenBytes(first, second)


def units_of(texts: list[str | None]) -> tuple[list[str], list[list[int]]]:
    """Distinct units, parts that both tokenizers cut by themselves, each with the space before it; and the units of each text.

    A text is parted at its spaces.  Where that leaves a part that is empty or has white space at an
    end, the text is parted anew, only at spaces between characters that aren't white space.  Texts
    that can't be given back have no units.
    """
    number: defaultdict[str, int] = defaultdict()
    number.default_factory = number.__len__
    of = number.__getitem__
    held = [[] if not x or "▁" in x else list(map(of, x.split(" "))) for x in texts]
    odd = {i for x, i in number.items() if not x or x[0].isspace() or x[-1].isspace()}
    for i in [i for i, x in enumerate(held) if odd and not odd.isdisjoint(x)]:
        held[i] = list(map(of, _CUT.split(texts[i])))
    number.default_factory = None  # which holds number, so it would stay in memory for long
    return [f" {x}" for x in number], held


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(keys, return_counts=True)


def _repeated(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each of counts, one after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts - starts, counts)


class Block:
    """Groups and pairs of the texts of one block."""

    def __init__(self, texts: list[str | None], tokens: TokenBytes):
        self.units, held = units_of(texts)
        self.docs = len(texts)
        a, b, sizes = tokens.cut_units(self.units)
        spoiled = set(np.flatnonzero(sizes == 0).tolist())
        self.held = [[] if spoiled and not spoiled.isdisjoint(x) else x for x in held]
        a_end, b_end = np.cumsum(tokens.first_sizes[a]), np.cumsum(tokens.second_sizes[b])
        common = np.intersect1d(a_end, b_end, assume_unique=True)
        a_group, b_group = np.searchsorted(common, a_end), np.searchsorted(common, b_end)
        self.a_in, self.b_in = np.bincount(a_group, minlength=len(common)), np.bincount(b_group, minlength=len(common))
        ends = np.cumsum(sizes)
        cut = np.searchsorted(common, ends, "right")  # groups of a unit: from the one before's cut to its own
        self.cut = np.r_[0, cut]
        key, self.a_times = _distinct(a_group << 32 | a)
        self.a_group, self.a_id = key >> 32, key & 0xFFFFFFFF
        key, self.b_times = _distinct(b_group << 32 | b)
        self.b_id, b_starts = key & 0xFFFFFFFF, np.searchsorted(key >> 32, np.arange(len(common) + 1))
        self.b_start, self.b_many = b_starts[:-1], np.diff(b_starts)
        self.unit_of_group = np.repeat(np.arange(len(self.units)), np.diff(self.cut))
        flat = np.array(list(chain.from_iterable(self.held)), np.int64)
        key, self.times = _distinct(np.repeat(np.arange(self.docs), [len(x) for x in self.held]) * max(1, len(self.units)) + flat)
        self.doc, self.unit = np.divmod(key, max(1, len(self.units)))
        self.names = self._names(a, b, tokens)

    def _names(self, a: np.ndarray, b: np.ndarray, tokens: TokenBytes) -> list[str]:
        """`a1,a2|b1;a3|b2` of each unit."""
        a_ends, b_ends = np.cumsum(self.a_in), np.cumsum(self.b_in)
        named = np.empty(len(a) + len(b), np.int64)  # ids in the order in which they are put down, by what follows them
        a_last, b_last = np.zeros(len(a), bool), np.zeros(len(b), bool)
        a_last[a_ends - 1] = b_last[b_ends - 1] = True
        most_a, most_b = len(tokens.first_bytes), len(tokens.second_bytes)
        named[np.arange(len(a)) + np.repeat(b_ends - self.b_in, self.a_in)] = a + most_a * a_last
        named[np.arange(len(b)) + np.repeat(a_ends, self.b_in)] = 2 * most_a + b + most_b * b_last
        pieces = tokens.names[named].tolist()
        cut = np.r_[0, a_ends + b_ends][self.cut].tolist()
        return ["".join(pieces[x:y])[:-1] for x, y in zip(cut, cut[1:], strict=False)]

    def documents(self) -> tuple[np.ndarray, ...]:
        """Tokens of the first, of the second, groups and links of each text."""
        before = [np.r_[0, np.cumsum(x)] for x in (self.a_in, self.b_in, np.ones(len(self.a_in), np.int64), self.a_in * self.b_in)]
        each = [x[self.cut[1:]] - x[self.cut[:-1]] for x in before]
        out = [np.zeros(self.docs, np.int64) for _ in each]
        for total, unit in zip(out, each, strict=True):
            np.add.at(total, self.doc, unit[self.unit] * self.times)
        return tuple(out)

    def groups(self) -> Iterator[str]:
        for units in self.held:
            yield ";".join(map(self.names.__getitem__, units))

    def postings(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pair (ids of the first and the second in 32 bits each), text and times, by pair, then text.

        Where a block has many occurrences, ids of the first are gone through in several stretches.
        """
        many = self.b_many[self.a_group]  # pairs that an id of a group makes
        unit = self.unit_of_group[self.a_group]
        docs_of_unit = np.bincount(self.unit, minlength=len(self.units))
        by_id = np.bincount(self.a_id, weights=many * docs_of_unit[unit]).cumsum() if len(self.a_id) else np.zeros(0)
        turn = (by_id / OCCURRENCES).astype(np.int64)[self.a_id]
        order = np.argsort(self.unit, kind="stable")
        doc, times, starts = self.doc[order], self.times[order], np.r_[0, np.cumsum(docs_of_unit)]
        for now in range(int(turn.max(initial=-1)) + 1):
            row = np.flatnonzero(turn == now)
            count = many[row]
            row = np.repeat(row, count)
            at = _repeated(self.b_start[self.a_group[np.flatnonzero(turn == now)]], count)
            pair, each, of = self.a_id[row] << 32 | self.b_id[at], self.a_times[row] * self.b_times[at], unit[row]
            count = docs_of_unit[of]
            at = _repeated(starts[of], count)
            row = np.repeat(np.arange(len(pair)), count)
            yield from _added_up(pair[row], doc[at], each[row] * times[at])


def _added_up(pair: np.ndarray, doc: np.ndarray, times: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Each pair and text once, in order, with the sum of its times; nothing if there is none."""
    if not len(pair):
        return
    if times.max() > 0xFFFF or doc.max() > 0xFFFF or (pair >> 32).max() > 0xFFFF or (pair & 0xFFFFFFFF).max() > 0x7FFF:
        by = np.lexsort((doc, pair))
        pair, doc, times = pair[by], doc[by], times[by]
    else:  # all three in one number, which sorts in place
        key = (pair >> 32) << 47 | (pair & 0x7FFF) << 32 | doc << 16 | times
        key.view(np.uint64).sort()
        own = key.view(np.uint64)
        pair = (own >> np.uint64(47)).astype(np.int64) << 32 | (own >> np.uint64(32) & np.uint64(0x7FFF)).astype(np.int64)
        doc, times = (own >> np.uint64(16) & np.uint64(0xFFFF)).astype(np.int64), (own & np.uint64(0xFFFF)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, (np.diff(pair) != 0) | (np.diff(doc) != 0)])
    yield pair[first], doc[first], np.add.reduceat(times, first)


def packed_postings(pair: np.ndarray, doc: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each pair once, its number of documents, the offsets of its bytes, and all bytes.

    An entry takes three bytes: how far its document lies after the one before (at first: after -1),
    in two, and how often; times over 255 go on in entries that lie 0 after the one before.
    """
    first = np.r_[True, np.diff(pair) != 0]
    step = np.where(first, doc + 1, np.diff(doc, prepend=0))
    starts = np.flatnonzero(first)
    entries = (times + 254) // 255
    step = np.repeat(step, entries)
    step[_after_first(entries)] = 0
    left = np.repeat(times, entries) - 255 * _repeated(np.zeros(len(entries), np.int64), entries)
    data = np.empty((len(step), 3), np.uint8)
    data[:, 0], data[:, 1], data[:, 2] = step & 255, step >> 8, np.minimum(left, 255)
    ends = np.r_[0, np.cumsum(entries)]
    return pair[starts], np.diff(np.r_[starts, len(pair)]), 3 * ends[np.r_[starts, len(pair)]], data.ravel()


def _after_first(entries: np.ndarray) -> np.ndarray:
    return np.flatnonzero(_repeated(np.zeros(len(entries), np.int64), entries) > 0)


def unpacked_postings(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, text and times of each entry of packed postings."""
    entries = data[offsets[0] : offsets[-1]].reshape(-1, 3).astype(np.int64)
    counts = np.diff(offsets) // 3
    row, total = np.repeat(np.arange(len(counts)), counts), np.cumsum(entries[:, 0] | entries[:, 1] << 8)
    before = np.r_[0, total][np.r_[0, np.cumsum(counts)][:-1]]
    return row, total - before[row] - 1, entries[:, 2]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array, list[str | None]]]:
    """First row number, doc_ids and texts of stretches of rows of bounded size."""
    ids: list[pa.Array] = []
    texts: list[str | None] = []
    first, size = 0, 0
    for batch in batches:
        numbers, own = batch.column(0), batch.column(2).to_pylist()
        low = 0
        for i, text in enumerate(own):
            n = len(text or "")
            if texts and (size + n > BLOCK_CHARS or len(texts) >= BLOCK_DOCS):
                yield first, pa.concat_arrays([*ids, batch.column(1).slice(low, i - low)]), texts
                ids, texts, size, low = [], [], 0, i
            if not texts:
                first = numbers[i].as_py()
            texts.append(text)
            size += n
        ids.append(batch.column(1).slice(low))
    if texts:
        yield first, pa.concat_arrays(ids), texts


def _stretch(name: str, values: pa.Array, schema: pa.Schema, **others: pa.Array) -> pa.RecordBatch:
    """A record batch that has these columns and nulls elsewhere."""
    given = {name: values, **others}
    return pa.RecordBatch.from_arrays([given[f.name].cast(f.type) if f.name in given else pa.nulls(len(values), f.type) for f in schema], schema=schema)


def contributions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """base and given: what cogrouped postings (base, data, count, best) add to documents of a block, added up as far as memory goes.

    given holds, for n documents of the block, their numbers in it (two bytes each), links of the
    highest count, and sums of counts (eight bytes each).
    """
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def summed() -> pa.RecordBatch:
        bases, docs, best, total = (np.concatenate(x) for x in zip(*held, strict=True))
        by = np.argsort(bases + docs, kind="stable")  # blocks don't overlap
        bases, docs, best, total = bases[by], docs[by], best[by], total[by]
        first = np.flatnonzero(np.r_[True, np.diff(bases + docs) != 0])
        bases, docs, best, total = bases[first], docs[first].astype("<u2"), np.add.reduceat(best, first), np.add.reduceat(total, first)
        cut = [*np.flatnonzero(np.r_[True, np.diff(bases) != 0]).tolist(), len(bases)]
        given = [docs[x:y].tobytes() + best[x:y].tobytes() + total[x:y].tobytes() for x, y in zip(cut, cut[1:], strict=False)]
        return pa.RecordBatch.from_arrays([pa.array(bases[cut[:-1]]), pa.array(given, pa.binary())], ["base", "given"])

    for batch in batches:
        if not len(batch):
            continue
        base, data, count, best = batch.columns
        buffers = data.buffers()
        offsets = np.frombuffer(buffers[1], np.int32)[data.offset : data.offset + len(data) + 1]
        row, doc, times = unpacked_postings(offsets.astype(np.int64), np.frombuffer(buffers[2], np.uint8))
        held.append((base.to_numpy()[row], doc, times * best.to_numpy(zero_copy_only=False)[row], times * count.to_numpy()[row]))
        size += len(row)
        if size > ENTRIES:
            yield summed()
            held, size = [], 0
    if held:
        yield summed()


def added_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row, n_best and count_sum of the documents of each block, from its contributions, which come one after another."""
    now, sums = None, np.zeros((2, BLOCK_DOCS), np.int64)

    def whole() -> pa.RecordBatch:
        docs = np.flatnonzero(sums[1])  # every link has a count
        out = pa.RecordBatch.from_arrays([pa.array(now + docs), pa.array(sums[0, docs]), pa.array(sums[1, docs])], ["row", "n_best", "count_sum"])
        sums[:] = 0
        return out

    for batch in batches:
        for base, given in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if base != now:
                if now is not None:
                    yield whole()
                now = base
            n = len(given) // 18
            docs = np.frombuffer(given, "<u2", n)
            sums[:, docs] += np.frombuffer(given[2 * n :], "<i8").reshape(2, n)
    if now is not None:
        yield whole()


def aligned(docs: DataFrame, first: str | None = None, second: str | None = None, with_groups: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each whole text.

    n_links: pairs of tokens that share a group; n_best: those whose count is the highest of their
    first id; count_sum: the sum of their counts.  groups_sha256 is of `a1,a2|b1;a3|b2`, which
    with_groups gives too, as groups.

    Null and empty texts, and texts whose tokens don't give back a space and the text (those with
    U+2581), have no tokens: zeros and an empty groups_sha256.  Every row counts as a document,
    also where doc_ids repeat or are null; ties for the highest count all count.  An empty table gives an
    empty result; other columns of docs are left out.  A text of any length is cut whole; memory is in
    proportion to a block or the longest text, whichever is more.
    """
    spark = docs.sparkSession
    ready(spark)
    a_path, b_path = first or public_file(FIRST), second or public_file(SECOND)
    kind = docs.schema["doc_id"].dataType
    shape = f"row long, doc_id {kind.simpleString()}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, a int, b int, base long, n int, data binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = token_bytes(a_path, b_path)
        for base, ids, texts in _blocks(batches):
            block = Block(texts, tokens)
            named = [("row", pa.int64()), ("doc_id", ids.type), *[(x, pa.int64()) for x in ("n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", pa.string()), ("groups", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("base", pa.int64()), ("n", pa.int32()), ("data", pa.binary())]
            schema = pa.schema(named)
            groups = list(block.groups()) if with_groups else None
            digests = [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in groups or block.groups()]
            numbers = dict(zip(("n_a", "n_b", "n_groups", "n_links"), map(pa.array, block.documents()), strict=True))
            shown = {"groups": pa.array(groups, pa.string())} if with_groups else {}
            yield _stretch("row", pa.array(base + np.arange(len(texts))), schema, doc_id=ids, groups_sha256=pa.array(digests, pa.string()), **numbers, **shown)
            for pair, doc, times in block.postings():
                pairs, n, offsets, data = packed_postings(pair, doc, times)
                for low in range(0, len(pairs), POSTING_ROWS):
                    high = min(low + POSTING_ROWS, len(pairs))
                    own = offsets[low : high + 1]
                    blobs = pa.BinaryArray.from_buffers(pa.binary(), high - low, [None, pa.py_buffer((own - own[0]).astype(np.int32).tobytes()), pa.py_buffer(data[own[0] : own[-1]].tobytes())])
                    yield _stretch("data", blobs, schema, a=pa.array(pairs[low:high] >> 32), b=pa.array(pairs[low:high] & 0xFFFFFFFF), base=pa.array(np.full(high - low, base)), n=pa.array(n[low:high]))
            del block, groups, digests, texts  # before the next block's are made
            give_back()

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    made, _ = stored(numbered.mapInArrow(thrifty(cut), shape), "alignment")
    postings = made.filter(F.col("a").isNotNull())
    counts = postings.groupBy("a", "b").agg(F.sum("n").alias("count"))
    highest = counts.groupBy("a").agg(F.max("count").alias("_most"))
    counts, _ = stored(counts.join(highest, "a").select("a", "b", "count", (F.col("count") == F.col("_most")).alias("best")), "pair-counts")
    met = postings.select("a", "b", "base", "data").join(counts.hint("merge"), ["a", "b"]).select("base", "data", "count", "best")
    given = met.mapInArrow(thrifty(contributions), "base long, given binary").repartition("base").sortWithinPartitions("base")
    summed = given.mapInArrow(added_up, "row long, n_best long, count_sum long")
    rows = made.filter(F.col("a").isNull()).join(summed, "row", "left")
    zero = [F.coalesce(x, F.lit(0).cast("long")).alias(x) for x in ("n_best", "count_sum")]
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *zero, "groups_sha256", *["groups"] * with_groups)
