"""All runs (maximal periodicities) of each text's words, and texts with repeated periods collapsed.

The words of a text are numbered; prefix doubling sorts their suffixes and leaves, for each power
of two, an array in which equal numbers mean equal stretches.  From the suffix array and the
lengths of common prefixes comes the longest previous factor of each place, with a place of it,
and from these the text's Lempel-Ziv blocks.  A run either touches the start or end of a block or
lies strictly inside one.  The first kind is found by Main's extensions: at each boundary and
for each period up to the blocks beside it, how far a stretch and its copy a period away
agree to the left and to the right.  The second kind is copied from the earlier place of its
block, through buckets of runs by their start.

Why the periods suffice, for a run [i, j) of period q that touches a boundary.  A block that
starts in [i+q, j) reaches j at least, as the run repeats from there.  If a boundary b lies in
[i+q, j], take the first: the block before it starts left of i+q and the one after it reaches j, so
together they have more than q words, and the copy at b-q agrees with b over q words in all.
If none does, the block that holds that stretch starts at a boundary b in [i, i+q) and ends
after j, so it has more than q words, and the copy at b+q is compared.

Texts without any stretch of SIX words that comes twice have no run of 12 words and more (such a
run agrees with itself a period on over 6 words or more) and skip all of that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm.common import ready, thrifty

#: Words that a run has at least, and words in a row that must come twice in a text with such a run.
LEAST, SIX = 12, 6
#: Words of texts that are worked on together at most (one text may have more), and extensions that are looked up at a time.
TOGETHER, AT_ONCE = 200_000, 500_000
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


class Stretches:
    """Suffixes of a sequence of numbers in order, and how far any two places agree.

    The sequence holds several texts with numbers of their own, each followed by a number that
    comes once, so nothing that is equal reaches over the end of a text.
    """

    def __init__(self, values: np.ndarray):
        n = len(values)
        order = np.argsort(values, kind="stable")
        first = np.r_[True, np.diff(values[order]) != 0]
        slots = np.arange(n)
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(first, slots, 0))
        self.levels, width = [rank.astype(np.int32)], 1
        alone = first & np.r_[first[1:], True]
        slots = np.flatnonzero(~alone)
        while len(slots):
            places = order[slots]
            key = rank[places] * n + rank[places + width]
            by = np.argsort(key, kind="stable")
            places, key = places[by], key[by]
            order[slots] = places
            first = np.r_[True, np.diff(key) != 0]
            rank[places] = np.maximum.accumulate(np.where(first, slots, 0))
            self.levels.append(rank.astype(np.int32))
            slots = slots[~(first & np.r_[first[1:], True])]
            width *= 2
        self.order = order

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Values that agree from a and b on."""
        a, b, start = a.copy(), b.copy(), a
        for k in range(len(self.levels) - 1, -1, -1):
            step = (self.levels[k][a] == self.levels[k][b]).astype(np.int64) << k
            a += step
            b += step
        return a - start

    def behind(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Values that agree before a and b."""
        a, b, start = a.copy(), b.copy(), a
        for k in range(len(self.levels) - 1, -1, -1):
            x, y = a - (1 << k), b - (1 << k)
            fits = (x >= 0) & (y >= 0)
            step = (fits & (self.levels[k][np.maximum(x, 0)] == self.levels[k][np.maximum(y, 0)])).astype(np.int64) << k
            a -= step
            b -= step
        return start - a

    def previous_factors(self) -> tuple[list[int], list[int]]:
        """For each place the length of its longest factor that also starts earlier, and where."""
        order = self.order.tolist()
        common = [0, *self.ahead(self.order[:-1], self.order[1:]).tolist(), 0]
        length, source = [0] * len(order), [0] * len(order)
        stack, shared = [-1], [0]
        for place, now in zip([*order, -1], common, strict=True):
            while stack[-1] > place:
                top, held = stack.pop(), shared.pop()
                length[top], source[top] = (held, stack[-1]) if held >= now else (now, place)
                now = min(now, held)
            stack.append(place)
            shared.append(now)
        return length, source


def _queries(most: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index and period, from 1 to most of each index, in pieces of bounded size."""
    total = np.r_[0, np.cumsum(most)]
    for low in range(0, int(total[-1]), AT_ONCE):
        each = np.arange(low, min(low + AT_ONCE, int(total[-1])))
        index = np.searchsorted(total, each, "right") - 1
        yield index, each - total[index] + 1


def _extended(found: Stretches, left: np.ndarray, period: np.ndarray) -> np.ndarray:
    """start, end, period of the runs around stretches that start at left and are compared a period on."""
    right = left + period
    two = found.levels[min(1, len(found.levels) - 1)]
    near = two[left] == two[right]
    back = left >= 2
    near |= back & (two[np.maximum(left - 2, 0)] == two[np.maximum(right - 2, 0)])  # of 6 words or more in all, 3 lie on one side
    left, right, period = left[near], right[near], period[near]
    before, after = found.behind(left, right), found.ahead(left, right)
    keep = (before + after >= period) & (before + after + period >= LEAST)
    return np.stack([(left - before)[keep], (right + after)[keep], period[keep]], axis=1)


def runs_of(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """start, end, period, by start and period, of all runs of the texts values[start:end], each followed by a value of its own."""
    found = Stretches(values)
    length, source = found.previous_factors()
    blocks: list[tuple[int, int]] = []
    before, at, after, first, last = [], [], [], [], []
    for start, end in zip(starts.tolist(), ends.tolist(), strict=True):
        place, size = start, 0
        while place < end:
            step = length[place] or 1
            before.append(size)
            at.append(place)
            after.append(step)
            first.append(start)
            last.append(end)
            if step > LEAST:
                blocks.append((place, step))
            place, size = place + step, step
        before.append(size)
        at.append(end)
        after.append(0)
        first.append(start)
        last.append(end)
    before, at, after, first, last = (np.array(x, np.int64) for x in (before, at, after, first, last))
    pieces = [np.empty((0, 3), np.int64)]
    for index, period in _queries(np.minimum(before + after, at - first)):
        pieces.append(_extended(found, at[index] - period, period))
    for index, period in _queries(np.minimum(after, last - at)):
        pieces.append(_extended(found, at[index], period))
    runs = np.concatenate(pieces)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    least = np.r_[True, (np.diff(runs[:, 0]) != 0) | (np.diff(runs[:, 1]) != 0)][: len(runs)]  # multiples of a run's period give the same stretch
    buckets: dict[int, list[tuple[int, int]]] = {}
    for start, end, period in runs[least].tolist():
        buckets.setdefault(start, []).append((end - start, period))
    for place, size in blocks:
        source_of, end = source[place], source[place] + size
        for start in range(source_of + 1, end - LEAST):
            for run in list(buckets.get(start, ())):
                if start + run[0] < end:
                    buckets.setdefault(start + place - source_of, []).append(run)
    out = np.array([(start, start + n, q) for start, held in buckets.items() for n, q in held], np.int64).reshape(-1, 3)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def _repeats(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether each text has SIX values in a row twice; now and then true of one that hasn't, by a hash."""
    out = np.zeros(len(ends), bool)
    if len(values) >= SIX:
        mixed = (values.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        count = len(values) - SIX + 1
        total = np.zeros(count, np.uint64)
        for i in range(SIX):
            total = total * np.uint64(0xD6E8FEB86659FD93) + mixed[i : i + count]
        order = np.argsort(total, kind="stable")
        twice = order[1:][np.diff(total[order]) == 0]
        out[np.searchsorted(ends, twice, "right")] = True
    return out


def text_runs(texts: list[str | None]) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Words and runs (start, end, period) of each text."""
    words = [(x or "").encode("utf-8", "surrogatepass").split() for x in texts]  # of bytes: parts at ASCII white space alone
    values: list[int] = []
    sizes, used = np.array([len(x) for x in words], np.int64), 0
    for own in words:
        numbers: dict[bytes, int] = {}
        values += [numbers.setdefault(w, used + len(numbers)) for w in own]
        values.append(used := used + len(numbers))  # ends the text
        used += 1
    all_values = np.array(values, np.int64)
    stops = np.cumsum(sizes + 1)  # after the value that ends each text
    out = [np.empty((0, 3), np.int64)] * len(words)
    group: list[int] = []
    held = 0

    def work() -> None:
        own = np.concatenate([all_values[stops[i] - sizes[i] - 1 : stops[i]] for i in group])
        ends = np.cumsum(sizes[group] + 1) - 1
        starts = ends - sizes[group]
        runs = runs_of(own, starts, ends)
        of = np.searchsorted(ends, runs[:, 0], "right")
        cut = np.searchsorted(of, np.arange(len(group) + 1))
        for k, i in enumerate(group):
            out[i] = runs[cut[k] : cut[k + 1]] - np.array([starts[k], starts[k], 0])

    for i in np.flatnonzero(_repeats(all_values, stops) & (sizes >= LEAST)).tolist():
        if group and held + sizes[i] > TOGETHER:
            work()
            group, held = [], 0
        group.append(i)
        held += sizes[i]
    if group:
        work()
    return zip(words, out, strict=True)


def collapsed(words: list[bytes], runs: np.ndarray) -> str:
    """The words that no run holds after its first period, joined by a space."""
    if len(runs):
        steps = np.zeros(len(words) + 1, np.int64)
        np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
        np.add.at(steps, runs[:, 1], -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(steps[:-1]) == 0).tolist()]
    return b" ".join(words).decode("utf-8", "surrogatepass")


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, runs and collapsed of each whole text.

    runs: start, length and period, in words, of every run of LEAST words and twice its period or
    more, by start, then period.  collapsed: the words that no run holds after its first period.
    Words are what is not white space of ASCII.  Null and empty texts have no words: no runs, an
    empty text.  Rows are independent: repeated rows repeat, null doc_ids stay, an empty table gives an
    empty result, other columns of docs are left out.  A text of any length is worked on whole, in
    memory in proportion to it and the logarithm of its longest repeat.
    """
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found = [], []
            for words, runs in text_runs(batch.column(1).to_pylist()):
                texts.append(collapsed(words, runs))
                found.append(runs)
            flat = np.concatenate([np.empty((0, 3), np.int64), *found])
            fields = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1] - flat[:, 0]), pa.array(flat[:, 2])], ["start", "length", "period"])
            offsets = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, fields).cast(RUNS), pa.array(texts, pa.string())], ["doc_id", "runs", "collapsed"])

    shape = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    return docs.select("doc_id", "text").mapInArrow(thrifty(run), shape)
