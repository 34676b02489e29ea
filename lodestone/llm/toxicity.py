"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams, its ends marked, and its vector their mean; a
text is the mean of its words' vectors, where frequent words weigh less (a smooth inverse
frequency), and a linear softmax over that mean tells its class.  Embeddings and softmax
start at random and are trained jointly in numpy, by minibatches, so the n-grams of a stem
carry what the stem means into words that were never seen: other endings, misspellings.
Every n-gram of the training texts is learnt, however rare; what keeps chance small is the
size of its gradient, which grows with the share of texts that hold it.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import ready, thrifty
from lodestone.llm.pretokens import ManyMemo

#: Labelled texts of each class that the driver trains on at most, those whose hash is least, and bytes of text of each class.
TRAIN_TOXIC, TRAIN_CLEAN, TRAIN_BYTES = 1200, 2400, 16 << 20
#: N-gram lengths; size of vectors; buckets that n-grams are hashed to (a power of two).
GRAMS, SIZE, BUCKETS = (3, 4, 5, 6), 8, 1 << 20
#: Texts that an n-gram must be in for half its gradient to count: what few texts hold is learnt less readily.
TRUST = 10.0
#: Words without a say that every text counts besides its own, so that a word or two decide nothing.
CALM = 40
#: Parts of the sample: a model is trained without each, which sets the point of even chances.
FOLDS = 3
#: Clean texts that may be flagged to find one toxic text more: with it nine of ten toxic training texts are found by models that haven't seen them.
MISSED = 3
#: Share of all words at which a word weighs half.
RARE = 4e-4
#: Passes over the training texts, steps that all passes have together at least, texts of a minibatch, first step of the gradient (of embeddings, of the softmax), and seed.
PASSES, STEPS, BATCH, RATES, SEED = 10, 400, 64, (60_000.0, 0.5), 7
#: Bytes that a worker's memory of words' values may take.
WORD_BYTES = 48 << 20
#: Words whose n-grams are hashed together.
SPELLED = 1 << 13
_WORD = re.compile(r"\w+")
_PRIME, _MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _buckets(hashes: np.ndarray) -> np.ndarray:
    mixed = (hashes ^ hashes >> np.uint64(29)) * _MIX
    return (mixed >> np.uint64(32)).astype(np.int64) & (BUCKETS - 1)


def spelled(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of the character n-grams of words with their ends marked, and of the words
    themselves; stretch by stretch, as what it takes to hash them is many times what comes out."""
    parts = [(np.zeros(0, np.int32), np.zeros(0, np.int32))]
    for at in range(0, len(words), SPELLED):
        owner, bucket = _spelled(words[at : at + SPELLED])
        parts.append(((owner + at).astype(np.int32), bucket.astype(np.int32)))
    owners, buckets = zip(*parts, strict=True)
    return np.concatenate(owners), np.concatenate(buckets)


def buckets_of(word: str) -> np.ndarray:
    """Buckets of one word."""
    return spelled([word])[1]


def _spelled(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    codes = np.frombuffer(f"<{'><'.join(words)}>".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(sizes)
    word = np.repeat(np.arange(len(words)), sizes)
    left = ends[word] - np.arange(len(codes))  # characters from here to the word's end
    whole = np.add.reduceat((codes * _PRIME + left.astype(np.uint64)) * _MIX ^ codes, ends - sizes)
    owners, buckets = [np.arange(len(words))], [_buckets(whole)]
    rolling = codes
    for k in range(2, max(GRAMS) + 1):
        if len(codes) < k:
            break
        rolling = rolling[: len(codes) - k + 1] * _PRIME + codes[k - 1 :]
        if k in GRAMS:
            here = np.flatnonzero(left[: len(rolling)] >= k)
            owners.append(word[here])
            buckets.append(_buckets(rolling[here] + np.uint64(k)))
    return np.concatenate(owners), np.concatenate(buckets)


@dataclass
class Model:
    """value: what each bucket's vector adds to the margin of the toxic class."""

    value: np.ndarray
    bias: float
    weight: dict[str, float]

    def words(self, words: list[str]) -> list[float]:
        """What each word adds: the mean of its buckets by its weight."""
        out: list[float] = []
        for at in range(0, len(words), SPELLED):
            part = words[at : at + SPELLED]
            owner, bucket = _spelled(part)
            means = np.bincount(owner, self.value[bucket], len(part)) / np.maximum(1, np.bincount(owner, minlength=len(part)))
            out += (means * np.fromiter((self.weight.get(w, 1.0) for w in part), np.float64, len(part))).tolist()
        return out

    def word(self, word: str) -> float:
        return self.words([word])[0]

    def score(self, values: list[float]) -> float:
        """From the values of all words of a text."""
        margin = math.fsum(values) / (len(values) + CALM) + self.bias
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, margin))))


def constant(bias: float) -> Model:
    return Model(np.zeros(BUCKETS, np.float32), bias, {})


class Bags:
    """Texts as weighted bags of buckets, kept by word: a text's words, and each word's buckets, numbered by themselves."""

    def __init__(self, texts: list[str]):
        index: dict[str, int] = {}
        total, own, times, ends = Counter(), array("i"), array("f"), [0]
        for text in texts:
            found = Counter(words_of(text))
            total.update(found)
            n = found.total()
            for word, k in found.items():
                own.append(index.setdefault(word, len(index)))
                times.append(k / (n + CALM))
            ends.append(len(own))
        every = max(1, total.total())
        self.weight = {w: RARE / (RARE + n / every) for w, n in total.items()}
        rare = np.fromiter((self.weight[w] for w in index), np.float32, len(index))
        owner, bucket = spelled(list(index))
        self.buckets, number = np.unique(bucket, return_inverse=True)
        self.spelled = number[np.argsort(owner, kind="stable")].astype(np.int32)
        self.sizes = np.bincount(owner, minlength=len(index))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.own = np.array(own, np.int32)
        self.times = np.array(times, np.float32) * (rare / np.maximum(1, self.sizes))[self.own].astype(np.float32)
        self.ends = np.array(ends, np.int64)

    def words(self, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Place of the text, place of the word and weight of every word of some texts; the words in question."""
        rows = np.concatenate([np.zeros(0, np.int64), *[np.arange(self.ends[t], self.ends[t + 1]) for t in texts]])
        words, at = np.unique(self.own[rows], return_inverse=True)
        return np.repeat(np.arange(len(texts)), self.ends[texts + 1] - self.ends[texts]), at, self.times[rows], words

    def entries(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of some words, word by word, and where each word's begin."""
        sizes = self.sizes[words]
        first = np.cumsum(sizes) - sizes
        return self.spelled[np.arange(sizes.sum()) + np.repeat(self.starts[words] - first, sizes)], first

    def margins(self, texts: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Sums over some texts of what their buckets add."""
        place, at, times, words = self.words(texts)
        bucket, first = self.entries(words)
        sums = np.add.reduceat(value[bucket], first) if len(first) else np.zeros(0)
        return np.bincount(place, sums[at] * times, len(texts))


def descend(bags: Bags, rows: np.ndarray, label: np.ndarray, passes: int = PASSES) -> tuple[np.ndarray, float]:
    """What each bucket adds and the bias, by minibatch descent on the class-balanced cross-entropy
    of the softmax over some of the texts, jointly with the embeddings.

    The step shrinks to nothing over the passes.  The gradient of an n-gram's vector is its
    weight in each text times the text's error times what the softmax makes of a vector, so
    one number a bucket and one vector a batch are all that a step has to work out.
    """
    rng = np.random.default_rng(SEED)
    grams = rng.normal(0, 1 / SIZE, (len(bags.buckets), SIZE)).astype(np.float32)
    softmax = rng.normal(0, 1 / SIZE, (SIZE, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    held = np.zeros(len(bags.buckets))
    for t in rows:
        held[np.unique(bags.entries(bags.words(np.array([t]))[3])[0])] += 1
    trust = held / (held + TRUST)
    toxic = (label[rows] == 1).mean()
    balance = np.where(label == 1, 0.5 / toxic, 0.5 / (1 - toxic))
    batches = np.array_split(rng.permutation(rows), -(-len(rows) // BATCH))
    passes = passes and max(passes, -(-STEPS // len(batches)))
    steps, step = passes * len(batches), 0
    for _ in range(passes):
        for k in rng.permutation(len(batches)):
            batch, left = batches[k], 1 - step / steps
            step += 1
            place, at, times, words = bags.words(batch)
            if not len(words):
                continue
            bucket, first = bags.entries(words)
            vectors = np.add.reduceat(grams.take(bucket, axis=0), first, axis=0)
            here, begin = np.unique(place, return_index=True)
            means = np.zeros((len(batch), SIZE), np.float32)
            means[here] = np.add.reduceat(vectors.take(at, axis=0) * times[:, None], begin, axis=0)
            logits = means @ softmax + bias
            chance = 1 / (1 + np.exp(-np.clip(logits[:, 1] - logits[:, 0], -60, 60)))
            error = (chance - label[batch]) * balance[batch] / len(batch)
            both = np.stack([-error, error], axis=1)
            pull = softmax[:, 1] - softmax[:, 0]
            by_word = np.bincount(at, times * error[place], len(words))
            amount = np.bincount(bucket, np.repeat(by_word, bags.sizes[words]), len(bags.buckets))
            moved = np.flatnonzero(amount)
            change = (RATES[0] * left * amount[moved] * trust[moved]).astype(np.float32)
            grams[moved] = grams.take(moved, axis=0) - change[:, None] * pull
            softmax -= (RATES[1] * left * (means.T @ both)).astype(np.float32)
            bias -= (RATES[1] * left * both.sum(axis=0)).astype(np.float32)
    value = grams @ (softmax[:, 1] - softmax[:, 0])
    value[held == 0] = 0  # what no fitted text held was not trained
    return value, float(bias[1] - bias[0])


def _model(bags: Bags, value: np.ndarray, bias: float) -> Model:
    every = np.zeros(BUCKETS, np.float32)
    every[bags.buckets] = value
    return Model(every, bias, {w: x for w, x in bags.weight.items() if x < 0.95})


def fit(texts: list[str], labels: list[int], passes: int = PASSES) -> Model:
    """Trained on all of the texts; no passes: the random start."""
    if not texts or len(set(labels)) < 2:
        return constant(5.0 if labels and all(labels) else -5.0)
    bags = Bags(texts)
    return _model(bags, *descend(bags, np.arange(len(texts)), np.array(labels, np.int64), passes))


def cut_margin(margins: np.ndarray, label: np.ndarray, stands_for: tuple[float, float] = (1.0, 1.0)) -> float:
    """The margin that errs least on these texts, each of which stands for so many of its class and a
    missed toxic one for MISSED clean ones; the middle one of several such, halfway between its neighbours."""
    order = np.argsort(margins, kind="stable")
    margins, label = margins[order], label[order]
    missed = MISSED * stands_for[1] * np.concatenate(([0], np.cumsum(label)))
    flagged = stands_for[0] * np.concatenate(([0], np.cumsum(label[::-1] == 0)))[::-1]
    errors = missed + flagged
    best = np.flatnonzero(errors <= errors.min() * (1 + 1e-9))
    k = int(best[len(best) // 2])
    return float(margins[0] - 1 if k == 0 else margins[-1] + 1 if k == len(margins) else (margins[k - 1] + margins[k]) / 2)


def train(texts: list[str], labels: list[int], stands_for: tuple[float, float] = (1.0, 1.0)) -> Model:
    """The mean of models that are each trained without one of FOLDS parts of the texts; the point of even
    chances is set on all texts, each with the margin of the model that hasn't seen it."""
    label, part = np.array(labels, np.int64), np.arange(len(texts)) % FOLDS
    if any(len(set(label[side])) < 2 for k in range(FOLDS) for side in (part != k, part == k)):
        return fit(texts, labels)
    bags = Bags(texts)
    values, margins = np.zeros(len(bags.buckets), np.float32), np.zeros(len(texts))
    for k in range(FOLDS):
        value, _ = descend(bags, np.flatnonzero(part != k), label)
        values += value / FOLDS
        margins[part == k] = bags.margins(np.flatnonzero(part == k), value)
    return _model(bags, values, -cut_margin(margins, label, stands_for))


def folded(folds: int) -> Column:
    """Which of `folds` a row belongs to, by its doc_id as text; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string")) % folds


def training_rows(docs: DataFrame, labels: DataFrame, most: tuple[int, int] = (TRAIN_CLEAN, TRAIN_TOXIC), most_bytes: int = TRAIN_BYTES) -> tuple[list[str], list[int], tuple[float, float]]:
    """Texts and labels of the labelled rows that may be learnt from: of each class those of
    least hash, whole texts, up to its bounds in rows and bytes; and how many labelled rows
    one of the chosen clean and toxic ones stands for.

    A text of more than the bound in bytes can't be learnt from; one of more than a 64th of it only
    where room is left after the others, so no long text keeps others of its class out.
    """
    known = labels.filter(F.col("toxic").isin(0, 1) & (folded(5) != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = None
    for y, n in enumerate(most):
        part = known.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        chosen = part if chosen is None else chosen.union(part)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    rows = rows.withColumn("_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).filter(F.col("_bytes") <= most_bytes)
    order = Window.partitionBy("toxic").orderBy(F.col("_bytes") > most_bytes // 64, F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_upto", F.sum("_bytes").over(order)).filter(F.col("_upto") <= most_bytes)
    found = rows.orderBy(F.xxhash64("doc_id"), "doc_id").select("text", "toxic").toArrow()  # sum(most) rows of 2 * most_bytes at most
    label = found.column(1).to_pylist()
    there = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}  # two rows
    clean, toxic = (max(1.0, there.get(y, 0) / max(1, label.count(y))) for y in (0, 1))
    return [x or "" for x in found.column(0).to_pylist()], label, (clean, toxic)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs with `score`, the chance of the toxic class, from the text alone."""
    ready(docs.sparkSession)
    own = [c for c in docs.columns if c != "score"]
    schema = docs.select(*[F.col(f"`{c}`") for c in own]).schema.add("score", "double")
    place = own.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = ManyMemo(model.words, WORD_BYTES)
        for batch in batches:
            scores = []
            for at in range(0, batch.num_rows, 256):
                cut = [words_of(x) for x in batch.column(place).slice(at, 256).to_pylist()]
                value = values.of(set().union(*cut))
                scores += [model.score(list(map(value.__getitem__, x))) for x in cut]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*own, "score"])

    return docs.select(*[F.col(f"`{c}`") for c in own]).mapInArrow(thrifty(run), schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with score (0 to 1, higher: likelier toxic), learnt from labels of rows whose crc32(doc_id) mod 5 is not 0.

    Null and empty texts have the score of no evidence; a very long text is scored whole, by
    all its words.  Labels other than 0 and 1, or without a doc_id, aren't learnt from; a
    doc_id labelled twice counts as toxic if either label does.  Without labels of both
    classes every text gets one score.  Rows that repeat repeat; an empty table gives an
    empty result; a column `score` of docs gives way.
    """
    return scored(docs, train(*training_rows(docs, labels)))
