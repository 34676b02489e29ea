"""Language identification by rank-order profiles.

A profile lists a language's most frequent character n-grams in order.  A text is given the
language whose profile is least out of place: for each of the text's most frequent n-grams,
how far its rank is from its rank in the profile, or the profile's length if it isn't there.

Profiles count the n-grams of all texts that may be learnt from.  Counts are summed per task
before anything is shuffled, so a language that most rows have costs no more than others.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import discard, ready, stored

GRAMS, LENGTH = (1, 2, 3), 300
#: Bytes of words that a worker gathers before it hands their n-grams on.
GATHERED = 16 << 20
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters; numerals other than decimal digits, such as a half or a circled one, end a run as digits do."""
    words = _WORD.findall((text or "").lower())
    if "".join(words).isalpha():
        return words
    return [x for w in words for x in ([w] if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split())]


def grams_of(word: str) -> list[str]:
    """Character n-grams of a word between blanks; the blank alone doesn't count.  gram_ids depends on GRAMS as they are."""
    marked = f" {word} "
    return [marked[i : i + n] for n in GRAMS for i in range(len(marked) - n + 1) if n > 1 or marked[i] != " "]


def gram_counts(docs: DataFrame) -> DataFrame:
    """lang, gram, n over the whole texts of rows with a lang."""
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        held = 0

        def handed_on() -> pa.RecordBatch:
            out: list[tuple[str, str, int]] = []
            for lang, counts in words.items():
                grams: Counter = Counter()
                for word, n in counts.items():
                    for g in grams_of(word):
                        grams[g] += n
                out += [(lang, g, n) for g, n in grams.items()]
            words.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.string()), pa.array([x[2] for x in out], pa.int64())], ["lang", "gram", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts = words.setdefault(lang, Counter())
                found = Counter(words_of(text))
                held += sum(100 + 4 * len(w) for w in found if w not in counts)
                counts.update(found)
                if held > GATHERED:
                    yield handed_on()
                    held = 0
        yield handed_on()

    parts = docs.filter(F.col("lang").isNotNull()).select("lang", "text").mapInArrow(run, "lang string, gram string, n long")
    return parts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, length: int = LENGTH) -> dict[str, list[str]]:
    """The profile of each language: its `length` most frequent n-grams, ties in order of the n-gram."""
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    spark = docs.sparkSession
    top, path = stored(gram_counts(docs).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= length).select("lang", "gram", "rank"), "language-profiles")
    profiles: dict[str, list[str]] = {}
    for row in top.orderBy("lang", "rank").toLocalIterator():  # `length` short rows a language, which every worker needs
        profiles.setdefault(row["lang"], []).append(row["gram"])
    discard(spark, path)
    return profiles


def gram_id(gram: str) -> int:
    """The code points of an n-gram, 21 bits each, in one integer."""
    out = 0
    for char in gram:
        out = out << 21 | ord(char)
    return out


def gram_ids(words: list[str]) -> np.ndarray:
    """Ids of all n-grams of the words, as grams_of gives them, from one array of code points."""
    codes = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letter = codes != 32
    pairs = codes[:-1] << 21 | codes[1:]
    return np.concatenate([codes[letter], pairs, (pairs[:-1] << 21 | codes[2:])[letter[1:-1]]])


class Profiles:
    """Out-of-place distances of a text to every profile at once."""

    def __init__(self, profiles: dict[str, list[str]], length: int = LENGTH):
        self.names, self.length = sorted(profiles), length
        ids = {n: [gram_id(g) for g in profiles[n]] for n in self.names}
        self.known = np.unique(np.array([i for x in ids.values() for i in x], np.int64))
        self.ranks = np.full((len(self.known) + 1, len(self.names)), -1, np.int64)
        for k, n in enumerate(self.names):
            self.ranks[np.searchsorted(self.known, np.array(ids[n], np.int64)), k] = np.arange(len(ids[n]))

    def language(self, text: str | None) -> tuple[str, float]:
        """The nearest language, the first by name of equals, and 1 less its distance as a share of the farthest possible."""
        words = words_of(text)
        if not words or not len(self.known):
            return UNKNOWN, 0.0
        grams, n = np.unique(gram_ids(words), return_counts=True)
        top = grams[np.argsort(-n, kind="stable")[: self.length]]  # ties in order of the id
        place = np.minimum(np.searchsorted(self.known, top), len(self.known) - 1)
        ranks = self.ranks[np.where(self.known[place] == top, place, len(self.known))]
        off = np.where(ranks < 0, self.length, np.abs(ranks - np.arange(len(top))[:, None]))
        distance = off.sum(axis=0) / (self.length * len(top))
        k = int(distance.argmin())
        return self.names[k], float(1 - distance[k])


def identify(docs: DataFrame, learnt_from: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, lang_pred and score of each text of docs, by the profiles of learnt_from (text and lang).

    Whole texts are read, however long; one needs memory in proportion to itself.  A text that is null or has no letter is `und` with score 0, and so is every text if
    nothing could be learnt.  Rows of learnt_from without lang are left out, null texts there
    count as empty.  Rows that repeat repeat; an empty table gives an empty result.
    """
    ready(docs.sparkSession)
    profiles = learn(learnt_from, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Profiles(profiles, length)
        for batch in batches:
            found = [known.language(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")
