"""Token ids in binary files of directly addressable codes.

A file holds segments one after another, each followed by a line feed.  A segment holds the
ids of documents in ascending order.  Every id is cut into chunks of 8 bits, low chunk
first.  Level 0 has the low chunk of every id; level k + 1 has the next chunk of those ids
whose continuation bit at level k is set, and no others.  Every level has a rank directory
(set bits before each block of 512), so the place of an id's next chunk is a rank query and
any token is read in as many steps as it has chunks, with nothing around it decoded.

Segment, little-endian:
  magic "LSDC1\\0\\0\\0", total bytes u64, part u32, number in the part u32, documents u64,
  tokens u64, levels u64; then for the documents: ids i64 each, null flags u8 each, ends u64
  each (tokens up to and with the document); then for each level: chunks u64, the chunks u8
  each, continuation bits (low bit first) padded to 64 bits, ranks u64 a block; at last the
  CRC-32 u32 of everything before it.

The files are written by Spark's own committing writer: a text file of one column puts its
bytes down as they are.  So they can be in any store that Spark reaches, an attempt that is
lost leaves nothing behind, and binaryFile reads them back.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import cache
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import new_path, ready, stored
from lodestone.llm.pretokens import LONG_KEY

TOKENIZER, END_ID = "word_bpe_49k.json", 1
MAGIC = b"LSDC1\0\0\0"
HEAD = struct.Struct("<8sQIIQQQ")
BLOCK = 512
#: Tokens after which a segment is closed, and segments of a file at most: some 100 MB, however large a range of documents is.
SEGMENT, FILE_SEGMENTS = 1 << 20, 48
#: Bytes of words that a worker remembers, and what one takes beside its characters; bytes of texts that are encoded together.
WORD_BYTES, WORD_COST, TOGETHER = 192 << 20, 150, 2 << 20
#: Documents asked for up to which their places are sent to every executor.
SENT_ROWS = 100_000
#: Latin letters below U+0130.
_EVEN, _STOPS = r"^[\x00-\x{12f}]*$", r"([a-z\x{df}-\x{f6}\x{f8}-\x{ff}])([.,;:!?]+)([ \n\t])"
_LATIN = "^[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f]+$"


def public_tokenizer(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it prints, else the next from 256 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(others)}


def gathered(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """pool[start : start + length] of every pair, one after another."""
    last = np.cumsum(lengths, dtype=np.int64)
    size = int(last[-1]) if len(last) else 0
    whole = np.int32 if size < 1 << 31 and len(pool) < 1 << 31 else np.int64  # half the memory to move
    return pool[np.repeat((starts - last + lengths).astype(whole), lengths) + np.arange(size, dtype=whole)]


def strings(values: pa.Array) -> list[str]:
    return values.to_numpy(zero_copy_only=False).tolist()


class Known:
    """Ids of words: the place of each word's ids in one growing array."""

    def __init__(self):
        self.place: dict[str, int] = {}
        self.ids, self.ends, self.bytes = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), 0

    def add(self, words: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        n = len(self.place)
        used = int(self.ends[n])
        if used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[:used], np.zeros(max(used, len(ids)) + len(ids), np.uint32)])
        if n + len(words) >= len(self.ends):
            self.ends = np.concatenate([self.ends[: n + 1], np.zeros(max(n, len(words)) + len(words), np.int64)])
        self.ids[used : used + len(ids)] = ids
        self.ends[n + 1 : n + 1 + len(words)] = used + np.cumsum(lengths)
        self.place.update(zip(words, range(n, n + len(words)), strict=True))
        self.bytes += WORD_COST * len(words) + 6 * sum(map(len, words))

    def of(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and lengths."""
        return self.ends[places], self.ends[places + 1] - self.ends[places]


class WordEncoder:
    """Ids of texts with a tokenizer file whose pre-tokenizer never joins across white space.

    The stretches between white space of many texts are made distinct as one Arrow array, and
    each is encoded by the library once while it is remembered; its normalizer works on
    characters and what combines with them, never over a space.  A stretch of Latin letters,
    alone or before ASCII punctuation, is one pre-token whose normal form is its small
    letters; many of those at once go to the library's model, and the mark that ends a word's
    last token parts their ids again.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        self.suffix = spec["model"].get("end_of_word_suffix")
        self.model = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": None, "added_tokens": []}))
        self.final = np.zeros(self.tokenizer.get_vocab_size(), bool)
        if self.suffix:
            self.final[[i for x, i in self.tokenizer.get_vocab().items() if x.endswith(self.suffix)]] = True
        self.bytes = {b: c for b, c in byte_characters().items() if b != ord("\n")}
        self.known, self.older = Known(), Known()
        self.tails: dict[str, np.ndarray] = {}

    def by_library(self, words: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _letters(self, cores: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their numbers of words of Latin letters; below U+0130 letters have one-letter small forms."""
        text = "\n".join(cores).lower()
        if not text.isascii():
            text = text.encode().decode("latin-1").translate(self.bytes)
        ids = np.array(self.model.encode_batch_fast([text.split("\n")], is_pretokenized=True, add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.final[ids]) + 1
        if len(ends) != len(cores):
            raise ValueError("a word of the vocabulary ends without its mark")
        return ids, np.diff(ends, prepend=0)

    def encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of stretches one after another, and how many each has."""
        given = pa.array(words, pa.string())
        cores = pc.utf8_rtrim(given, characters=punctuation)
        plain = pc.match_substring_regex(cores, _LATIN).to_numpy(zero_copy_only=False) if self.suffix else np.zeros(len(words), bool)
        parts, numbers = [np.zeros(0, np.uint32)], np.zeros((len(words), 2), np.int64)  # ids of a stretch's letters, and of the rest
        starts = np.zeros((len(words), 2), np.int64)
        at = np.flatnonzero(plain)
        size = 0
        if len(at):
            ids, lengths = self._letters(strings(cores.filter(pa.array(plain))))
            numbers[at, 0], starts[at, 0] = lengths, np.cumsum(lengths) - lengths
            parts.append(ids)
            size = len(ids)
        cut = (pc.utf8_length(given).to_numpy(zero_copy_only=False) - pc.utf8_length(cores).to_numpy(zero_copy_only=False)) * plain
        seen: dict[str, int] = {}
        for k in np.flatnonzero(cut).tolist():
            tail = words[k][-int(cut[k]) :]
            if tail not in self.tails:
                self.tails[tail] = self.by_library([tail])[0]
            ids = self.tails[tail]
            if tail not in seen:
                seen[tail] = size
                parts.append(ids)
                size += len(ids)
            starts[k, 1], numbers[k, 1] = seen[tail], len(ids)
        others = np.flatnonzero(~plain)
        if len(others):
            found = self.by_library([words[k] for k in others.tolist()])
            lengths = np.fromiter(map(len, found), np.int64, len(found))
            numbers[others, 0], starts[others, 0] = lengths, size + np.cumsum(lengths) - lengths
            parts += found
        return gathered(np.concatenate(parts), starts.ravel(), numbers.ravel()), numbers.sum(axis=1)

    def evened(self, texts: pa.Array) -> pa.Array:
        """Texts of Latin letters alone in small letters, and with a space between a letter and the
        full stops, commas and the like that end its stretch: the ids are the same, as those are
        pre-tokens of their own, and far fewer stretches differ.  A text that may spell out a
        special token stays as it is."""
        if not self.suffix:
            return texts
        plain = pc.and_not(pc.match_substring_regex(texts, _EVEN), pc.match_substring(texts, "<|"))
        even = pc.replace_substring_regex(pc.utf8_lower(texts), _STOPS, r"\1 \2\3")
        return pc.if_else(plain, even, texts)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts one after another, without an end, and how many each has."""
        if self.known.bytes > WORD_BYTES // 2:
            self.known, self.older = Known(), self.known
            self.tails.clear()
        cut = pc.ascii_split_whitespace(self.evened(pc.fill_null(texts, "")))
        sizes = pc.list_value_length(cut).to_numpy(zero_copy_only=False)
        coded = cut.flatten().dictionary_encode()
        words, known = strings(coded.dictionary), self.known
        places = list(map(known.place.get, words))
        long: list[str] = []
        if None in places:
            at = [i for i, k in enumerate(places) if k is None]
            missing = [words[i] for i in at]
            before = list(map(self.older.place.get, missing))
            old = [w for w, k in zip(missing, before, strict=True) if k is not None]
            new = [w for w, k in zip(missing, before, strict=True) if k is None and len(w) <= LONG_KEY]
            if old:
                starts, lengths = self.older.of(np.array([k for k in before if k is not None]))
                known.add(old, gathered(self.older.ids, starts, lengths), lengths)
            if new:
                known.add(new, *self.encoded(new))
            for i, w in zip(at, missing, strict=True):
                places[i] = known.place.get(w)
                if places[i] is None:
                    places[i] = -1 - len(long)
                    long.append(w)
        of_word = np.array(places, np.int64)
        pool = known.ids
        starts, lengths = known.of(np.maximum(of_word, 0))
        if long:
            ids, own = self.encoded(long)
            far = np.flatnonzero(of_word < 0)
            k = -1 - of_word[far]
            starts[far], lengths[far] = len(pool) + (np.cumsum(own) - own)[k], own[k]
            pool = np.concatenate([pool, ids])
        index = coded.indices.to_numpy(zero_copy_only=False)
        each = lengths.astype(np.int32)[index]
        upto = np.concatenate(([0], np.cumsum(each, dtype=np.int64)))
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        return gathered(pool, starts.astype(np.int32)[index] if len(pool) < 1 << 31 else starts[index], each), upto[bounds[1:]] - upto[bounds[:-1]]


@cache
def encoder(path: str) -> WordEncoder:
    """One encoder a worker."""
    return WordEncoder(path)


def pack_levels(ids: np.ndarray) -> list[bytes]:
    """The levels of a segment from uint32 ids."""
    out, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little").tobytes()
        bits += bytes(-len(bits) % 8)
        blocks = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.uint64) if len(more) else np.zeros(0, np.uint64)
        ranks = np.concatenate(([0], np.cumsum(blocks)[:-1])).astype("<u8") if len(blocks) else blocks
        out.append(struct.pack("<Q", len(rest)) + rest.astype(np.uint8).tobytes() + bits + ranks.tobytes())
        if not more.any():
            return out
        rest = rest[more] >> 8


def pack_segment(part: int, number: int, doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    levels = pack_levels(ids)
    docs = np.array([x or 0 for x in doc_ids], "<i8").tobytes() + bytes(x is None for x in doc_ids) + np.cumsum(np.array(lengths, "<u8"), dtype="<u8").tobytes()
    body = docs + b"".join(levels)
    head = HEAD.pack(MAGIC, HEAD.size + len(body) + 4, part, number, len(doc_ids), len(ids), len(levels))
    return head + body + struct.pack("<I", zlib.crc32(body, zlib.crc32(head)))


class Segment:
    """Reads one segment; token() and document() touch only what they need."""

    def __init__(self, data: bytes | memoryview, at: int = 0):
        magic, self.size, self.part, self.number, n, self.tokens, levels = HEAD.unpack_from(data, at)
        if magic != MAGIC:
            raise ValueError("not a segment of directly addressable codes")
        self.data, self.at = data, at
        at += HEAD.size
        self.doc_ids = np.frombuffer(data, "<i8", n, at)
        self.nulls = np.frombuffer(data, np.uint8, n, at + 8 * n)
        self.ends = np.frombuffer(data, "<u8", n, at + 9 * n).astype(np.int64)
        at += 17 * n
        self.levels = []
        for _ in range(levels):
            (count,) = struct.unpack_from("<Q", data, at)
            wide, blocks = -(-count // 64) * 8, -(-count // BLOCK)
            chunks = np.frombuffer(data, np.uint8, count, at + 8)
            bits = np.frombuffer(data, np.uint8, wide, at + 8 + count)
            ranks = np.frombuffer(data, "<u8", blocks, at + 8 + count + wide)
            self.levels.append((chunks, bits, ranks))
            at += 8 + count + wide + 8 * blocks
        self.end = at

    def check(self) -> None:
        (crc,) = struct.unpack_from("<I", self.data, self.end)
        if zlib.crc32(memoryview(self.data)[self.at : self.end]) != crc:
            raise ValueError(f"segment {self.number} of part {self.part} is damaged")

    def token(self, i: int) -> int:
        """The id at position i, by one rank query for each further chunk."""
        value = 0
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << 8 * k
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            first = i // BLOCK * BLOCK
            inside = np.unpackbits(bits[first >> 3 : (i >> 3) + 1], bitorder="little")[: i - first]
            i = int(ranks[i // BLOCK]) + int(inside.sum())
        return value

    def all(self) -> np.ndarray:
        """Every id."""
        out, where = np.zeros(self.tokens, np.uint32), None
        for k, (chunks, bits, _) in enumerate(self.levels):
            wide = chunks.astype(np.uint32) << np.uint32(8 * k)
            if where is None:
                out, where = wide, np.arange(0)
                more = np.flatnonzero(np.unpackbits(bits, bitorder="little"))
            else:
                out[where] |= wide
                more = where[np.flatnonzero(np.unpackbits(bits, bitorder="little"))]
            where = more
        return out

    def document(self, k: int) -> list[int]:
        """The ids of the k-th document, each read by itself."""
        return [self.token(i) for i in range(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))]


def segments(data: bytes) -> Iterator[Segment]:
    at = 0
    while at < len(data):
        segment = Segment(data, at)
        segment.check()
        yield segment
        at += segment.size + 1  # and the line feed


def with_ends(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of texts with end_id after each text, and how many each has then."""
    sizes = counts + 1
    out = np.full(len(ids) + len(counts), end_id, np.uint32)
    own = np.ones(len(out), bool)
    own[np.cumsum(sizes) - 1] = False
    out[own] = ids
    return out, sizes


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, parts: int | None = None, end_id: int = END_ID) -> None:
    """Encode every whole text, append end_id, and write the ids in ascending doc_id order.

    Documents are dealt out by ranges of (doc_id, hash of the text, place in the input), so
    part k holds only documents before those of part k + 1, and neither a doc_id that repeats
    nor equal rows can fill one range.  A part goes on in a new file after FILE_SEGMENTS
    segments, so files don't grow with the input.  Null doc_ids come first; null texts count
    as empty and have the end id alone.
    """
    spark = docs.sparkSession
    ready(spark)
    model = tokenizer or public_tokenizer()
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, part, number = encoder(model), TaskContext.get().partitionId(), 0
        doc_ids, lengths, pieces, total = [], [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal doc_ids, lengths, pieces, total, number
            data = pack_segment(part, number, doc_ids, lengths, np.concatenate(pieces))
            doc_ids, lengths, pieces, total, number = [], [], [], 0, number + 1
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["segment"])

        for batch in batches:
            step = max(1, batch.num_rows * TOGETHER // max(1, batch.nbytes))
            for at in range(0, batch.num_rows, step):
                rows = batch.slice(at, step)
                own = rows.column(0).to_pylist()
                ids, sizes = with_ends(*e.encode(rows.column(1)), end_id)
                upto = np.concatenate(([0], np.cumsum(sizes)))
                first = 0
                while first < len(own):
                    last = min(len(own), int(np.searchsorted(upto, upto[first] + SEGMENT - total)))
                    doc_ids += own[first:last]
                    lengths += sizes[first:last].tolist()
                    pieces.append(ids[upto[first] : upto[last]])
                    total += int(upto[last] - upto[first])
                    first = last
                    if total >= SEGMENT:
                        yield close()
        if doc_ids:
            yield close()

    order = [F.col("doc_id").asc_nulls_first(), F.col("_text"), F.col("_place")]
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_text"), F.monotonically_increasing_id().alias("_place"))
    ranged = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")
    ranged.mapInArrow(run, "segment binary").select(F.col("segment").cast("string")).write.option("maxRecordsPerFile", FILE_SEGMENTS).text(path)


def _files(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(paths).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row a document from the files: file, at (byte of its segment there), k (its number in
    the segment), part, number, doc_id, place (tokens before it in its segment), n_tokens, ids_crc32.

    Every segment is checked against its own CRC-32 before it is used.
    """
    ready(spark)
    names = ["file", "at", "k", "part", "number", "doc_id", "place", "n_tokens", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for s in segments(value.as_buffer().to_pybytes()):
                    ids = memoryview(s.all().astype("<u4").tobytes())
                    places = np.concatenate(([0], s.ends[:-1])).astype(np.int64)
                    crcs = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(places.tolist(), s.ends.tolist(), strict=True)]
                    n = len(s.doc_ids)
                    doc_ids = pa.array(s.doc_ids, pa.int64(), mask=s.nulls.astype(bool))
                    columns = [pa.array([file] * n, pa.string()), pa.array(np.full(n, s.at)), pa.array(np.arange(n)), pa.array(np.full(n, s.part)), pa.array(np.full(n, s.number)), doc_ids, pa.array(places), pa.array(s.ends - places), pa.array(crcs, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names)

    return _files(spark, [path]).mapInArrow(run, "file string, at long, k long, part long, number long, doc_id long, place long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str | None = None, parts: int | None = None) -> tuple[DataFrame, str]:
    """Write the files and read them back: doc_id, start, n_tokens, ids_crc32, and the files' folder.

    start counts the ids of all documents before, end ids included.  Rows that repeat follow
    each other in no defined order, which changes nothing as they are equal.  A text of any
    length is encoded whole and stays in one segment.  An empty table gives files without
    documents and an empty result; other columns of docs are left out.  What was read back
    stays in the folder as the table _documents, the index that read_tokens uses.
    """
    spark, path = docs.sparkSession, new_path(docs.sparkSession, "token-files")
    write_token_files(docs, path, tokenizer, parts)
    read_token_files(spark, path).write.parquet(f"{path}/_documents")
    rows = spark.read.parquet(f"{path}/_documents")
    totals = rows.groupBy("part", "number").agg(F.sum("n_tokens").alias("tokens"))
    within = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    parts_before = totals.groupBy("part").agg(F.sum("tokens").alias("tokens")).select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("part_start"))
    starts = totals.select("part", "number", F.coalesce(F.sum("tokens").over(within), F.lit(0)).alias("segment_start")).join(parts_before, "part")
    placed = rows.join(starts, ["part", "number"])
    return placed.select("doc_id", (F.col("part_start") + F.col("segment_start") + F.col("place")).alias("start"), "n_tokens", "ids_crc32"), path


def read_tokens(spark: SparkSession, path: str, doc_ids: DataFrame, most_rows: int = SENT_ROWS) -> DataFrame:
    """doc_id and ids (with the end id) of the documents asked for, out of the folder of token_files.

    The index gives file, segment and place; only files that hold an asked document are read,
    and in them only its own chunks, by rank queries from its first token on.
    """
    ready(spark)
    asked = spark.read.parquet(f"{path}/_documents").join(doc_ids.select("doc_id").distinct(), "doc_id").select("file", "at", "k", "doc_id")
    asked, asked_path = stored(asked, "asked-documents")
    names = [f"{path}/{r['file']}" for r in asked.select("file").distinct().toLocalIterator()]  # names alone, to read no other file
    if not names:
        return asked.select("doc_id", F.array().cast("array<long>").alias("ids"))
    wanted = asked.groupBy("file").agg(F.collect_list(F.struct("at", "k", "doc_id")).alias("asked"))  # documents of one file, whose size is bounded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value, places in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                data, found = value.as_buffer(), {}
                for x in places:
                    segment = found.get(x["at"]) or found.setdefault(x["at"], Segment(data, x["at"]))
                    yield pa.RecordBatch.from_arrays([pa.array([x["doc_id"]], pa.int64()), pa.array([segment.document(x["k"])], pa.list_(pa.int64()))], ["doc_id", "ids"])

    rows = _files(spark, names).join(F.broadcast(wanted) if asked.count() <= most_rows else wanted, "file")
    return rows.select("content", "asked").mapInArrow(run, "doc_id long, ids array<long>")
