"""Benchmark decontamination by a prefix-filtered set join, with DataFrame operations only.

A window is 13 consecutive words of an item (a shorter item is one window); a document must
not hold any window.  Windows and documents are sets of word shingles.  Containment of a
window needs all of its shingles, so a prefix of one shingle suffices as a filter, and the
rarest over all documents filters most.  The join goes

  item shingles       x  documents  -> how often each occurs: the order by rarity
  rarest of a window  x  documents  -> (text, item, diagonal, block)

Both keep documents where they lie while the item side is small enough to be sent to all
executors; beyond that both sides are shuffled.  An item's shingles are a row a place, and of
windows of the same words the first alone is looked for, so an item that repeats itself asks
for little.  A diagonal is document place minus item place.  Items are cut into blocks of
places; what a document shares with an item is bounded by the windows that a met shingle
stands for, within the block that it lies in.  Only that stretch of the document leaves it,
and there the words themselves are compared one by one, so collisions of shingles change
nothing.  Equal runs as long as a window are the hit places.  A document of n equal words
against an item of m costs n stretches of one window, and not n * m.

Texts are keyed by two 64-bit hashes, so that copies share their candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import attach, discard, packed, stored, text_key, unpacked
from lodestone.llm.spans import let, regex_spans

WINDOW, SHINGLE = 13, 3
#: Places of an item that are compared together.
BLOCK = 64
#: Item shingles that are sent to every executor at most (some 40 bytes each), hit texts up to whose number their table is.
SENT_SHINGLES, SENT_CANDIDATES = 1_000_000, 30_000
#: Bytes of words up to which items are sent to every executor; beyond, candidates are shuffled to them.
SENT_BYTES = 16 << 20
_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words of a whole text: A-Z in small letters, cut at ASCII characters that are neither letter nor digit."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(low, _BREAKS, -1), "")


def shingles_of(words: Column, size: int) -> Column:
    """A hash of the `size` words from each place on; towards the end of as many as there are."""
    return F.transform(words, lambda w, i: F.xxhash64(w, *[F.get(words, i + j) for j in range(1, size)]))


def item_words(benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """item (a number), item_id, words, long (words of its windows) and size (words of its shingles) of each distinct item with words."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("words")).filter(F.size("words") > 0).distinct()
    return items.select(F.monotonically_increasing_id().alias("item"), "item_id", "words", F.least(F.size("words"), F.lit(window)).alias("long"), F.least(F.size("words"), F.lit(shingle)).alias("size"))


def item_shingles(items: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """item, long, size, n (words of the item), place, shingle and window: a row a place at which a shingle
    starts, with a digest of the words of the window that starts there, if one does."""
    hashed = F.lit(None).cast("array<bigint>")
    for k in range(1, shingle + 1):
        hashed = F.when(F.col("size") == k, F.slice(shingles_of(F.col("words"), k), F.lit(1), F.size("words") - F.lit(k - 1))).otherwise(hashed)
    both = F.transform(hashed, lambda h, i: F.struct(h.alias("shingle"), F.when(i <= F.size("words") - F.col("long"), F.md5(F.array_join(F.slice("words", i + 1, F.col("long")), " ").cast("binary"))).alias("window")))
    return items.select("item", "long", "size", F.size("words").alias("n"), F.posexplode(both).alias("place", "x")).select("item", "long", "size", "n", "place", "x.*")


def item_blocks(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """item, item_id, long, block, start and words: the words around each BLOCK of places, as far as windows reach that hold one of them."""
    start = lambda i: F.greatest(F.lit(0), i * BLOCK - F.lit(window - 1))
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("words") - 1) / BLOCK).cast("int")), lambda i: F.struct(i.alias("block"), start(i).alias("start"), F.slice("words", start(i) + 1, F.lit(BLOCK + window - 1) + i * BLOCK - start(i)).alias("words")))
    return items.select("item", "item_id", "long", F.explode(cut).alias("x")).select("item", "item_id", "long", "x.*")


def rarest_of_windows(shingles: DataFrame, seen: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """item, size, shingle and place of the rarest shingle of each window of which every shingle was seen, and
    low and high: the item's places from the start of the first to the end of the last window that it stands for.

    A frame holds the shingles of the window that starts at its first row; a shorter item is
    one window, and its only full frame is the first.  Of windows of the same words in an item the first stays.
    """
    ranked = shingles.join(seen, ["size", "shingle"], "left")
    frame = Window.partitionBy("item").orderBy("place").rowsBetween(0, max(0, window - shingle))
    rarest = F.min(F.when(F.col("seen").isNotNull(), F.struct("seen", "shingle", "place"))).over(frame)
    framed = ranked.select("item", "size", "long", "window", F.col("place").alias("first"), (F.col("long") - F.col("size") + 1).alias("needed"), F.count("seen").over(frame).alias("there"), rarest.alias("x"))
    whole = framed.filter("there = needed and window is not null")
    firsts = whole.groupBy("item", "window").agg(F.min(F.struct("first", "size", "long", "x")).alias("w")).select("item", "w.*")
    return firsts.groupBy("item", "size", "x.shingle", "x.place").agg(F.min("first").alias("low"), F.max(F.col("first") + F.col("long")).alias("high"))


def meetings(docs: DataFrame, wanted: DataFrame, most: int = SENT_SHINGLES) -> DataFrame:
    """_key_a, _key_b, at and wanted's columns wherever a document has one of its shingles (size, shingle).

    Documents stay where they are if wanted, a stored table, has no more than `most` rows of a
    size of shingles and is sent to all executors; beyond that one shuffled join meets them.
    """
    sizes = {r["size"]: r["n"] for r in wanted.groupBy("size").agg(F.count("*").alias("n")).collect()}  # a row a size of shingles
    cut = docs.select(*text_key(), words_of(F.col("text")).alias("_words"))  # a step of its own, so that words are cut once a text
    found = None
    for size, rows in sizes.items():
        placed = cut.select("_key_a", "_key_b", F.posexplode(shingles_of(F.col("_words"), size)).alias("at", "shingle"))
        own = wanted.filter(F.col("size") == size)
        part = placed.join(F.broadcast(own) if rows <= most else own, "shingle")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = docs.select(*text_key(), F.lit(0).alias("at")).crossJoin(wanted.limit(0)).limit(0)
    return found


def overlap(part: Column, words: Column, first: Column, begin: Column, long: Column, window: int) -> Column:
    """Stretches (start, end) of document places where windows of an item stand on one diagonal;
    part is the document's stretch from place `begin` on, which is to equal words from place `first` on."""
    kind = "array<struct<start:bigint,end:bigint>>"
    same = F.zip_with(F.slice(words, first + 1, F.size(part)), part, lambda a, b: F.when(a == b, "1").otherwise("0"))
    begin = begin.cast("long")

    def stretches(whole: Column) -> Column:
        runs = F.transform(regex_spans(whole, f"1{{{window},}}"), lambda x: F.struct((x["start"] + begin).alias("start"), (x["end"] + begin).alias("end")))
        short = F.array(F.struct(begin.alias("start"), (begin + long).cast("long").alias("end")))
        return F.when(long >= window, runs).when(whole == F.repeat(F.lit("1"), long), short).otherwise(F.array().cast(kind))

    return F.when(F.size(part) < long, F.array().cast(kind)).otherwise(let(F.array_join(same, ""), stretches))


def covered(stretches: Column) -> Column:
    """Places that sorted stretches cover together."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto"))

    def step(acc: Column, x: Column) -> Column:
        fresh = F.greatest(F.lit(0).cast("long"), x["end"] - F.greatest(x["start"], acc["upto"]))
        return F.struct((acc["n"] + fresh).alias("n"), F.greatest(acc["upto"], x["end"]).alias("upto"))

    return F.aggregate(stretches, start, step, lambda acc: acc["n"])


def candidates(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, most_shingles: int = SENT_SHINGLES) -> DataFrame:
    """_key_a, _key_b and _hits: (item, diagonal, block, low, high) of each text that holds the rarest shingle of some window."""
    spark = docs.sparkSession
    shingles, shingles_path = stored(item_shingles(items, shingle), "item-shingles")
    asked, asked_path = stored(shingles.select("size", "shingle").distinct(), "asked-shingles")
    seen, seen_path = stored(meetings(docs, asked, most_shingles).groupBy("size", "shingle").agg(F.count("*").alias("seen")), "seen-shingles")
    prefix, prefix_path = stored(rarest_of_windows(shingles, seen, window, shingle), "window-prefixes")
    met = meetings(docs, prefix, most_shingles).select("_key_a", "_key_b", "item", (F.col("at") - F.col("place")).alias("diagonal"), F.floor(F.col("place") / BLOCK).cast("int").alias("block"), "low", "high")
    each = met.groupBy("_key_a", "_key_b", "item", "diagonal", "block").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    found, _ = stored(each.groupBy("_key_a", "_key_b").agg(F.collect_list(F.struct("item", "diagonal", "block", "low", "high")).alias("_hits")), "window-hits")
    for path in (shingles_path, asked_path, seen_path, prefix_path):
        discard(spark, path)
    return found


def occurring(docs: DataFrame, items: DataFrame, hits: DataFrame, window: int = WINDOW, most_candidates: int = SENT_CANDIDATES, most_bytes: int = SENT_BYTES) -> DataFrame:
    """_key_a, _key_b, n_hit and items of the texts in which windows occur: candidates whose words are equal."""
    total = hits.agg(F.sum(F.size("_hits")).alias("n")).first()["n"] or 0
    size = items.agg(F.sum(F.aggregate("words", F.lit(0).cast("long"), lambda n, w: n + 40 + F.octet_length(w))).alias("n")).first()["n"] or 0
    side = F.broadcast(hits) if total <= most_candidates else hits
    texts = docs.select(*text_key(), "text").join(side, ["_key_a", "_key_b"]).select("_key_a", "_key_b", "_hits", words_of(F.col("text")).alias("_words"))
    first = lambda h: F.greatest(h["low"], -h["diagonal"])
    shared = lambda h: F.greatest(F.lit(0), F.least(h["high"] - first(h), F.size("_words") - first(h) - h["diagonal"]))
    cut = F.transform("_hits", lambda h: F.struct(h["item"].alias("item"), h["block"].alias("block"), first(h).alias("first"), (first(h) + h["diagonal"]).alias("begin"), F.slice("_words", first(h) + h["diagonal"] + 1, shared(h)).alias("part")))
    parts = texts.select("_key_a", "_key_b", F.explode(cut).alias("x")).select("_key_a", "_key_b", "x.*")
    blocks = item_blocks(items, window)
    whole = parts.join(F.broadcast(blocks) if size <= most_bytes else blocks, ["item", "block"])
    at = whole.select("_key_a", "_key_b", "item_id", overlap(F.col("part"), F.col("words"), F.col("first") - F.col("start"), F.col("begin"), F.col("long"), window).alias("at")).filter(F.size("at") > 0)
    of_text = at.groupBy("_key_a", "_key_b").agg(F.array_sort(F.flatten(F.collect_set("at"))).alias("at"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("_items"))
    return of_text.select("_key_a", "_key_b", covered(F.col("at")).alias("_n_hit"), "_items")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, most_shingles: int = SENT_SHINGLES, most_candidates: int = SENT_CANDIDATES, most_bytes: int = SENT_BYTES) -> DataFrame:
    """docs with n_words, n_hit (words inside an occurring window) and items (ids of items with one, as sorted strings).

    Null and empty texts have no words; texts and items of any length are read whole.  Items
    without words have no window; an item without an id marks words but is not listed.  Items
    that repeat count once by id, rows of docs each by itself.  Columns n_words, n_hit and
    items of docs give way, other names can't clash.  Without documents or items nothing is hit.
    """
    spark = docs.sparkSession
    items, items_path = stored(item_words(benchmark, window, shingle), "item-words")
    hits = candidates(docs, items, window, shingle, most_shingles)
    found, _ = stored(occurring(docs, items, hits, window, most_candidates, most_bytes), "contaminated")
    discard(spark, items_path)
    size = found.agg(F.sum(F.size("_items") + 1).alias("n")).first()["n"] or 0
    keyed = packed(docs).select("_row", "text", *text_key())
    marked = attach(keyed, found, ["_key_a", "_key_b"], size, most_candidates)
    return marked.select(
        *unpacked(docs, ("n_words", "n_hit", "items")),
        F.size(words_of(F.col("text"))).cast("long").alias("n_words"),
        F.coalesce("_n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("_items", F.array().cast("array<string>")).alias("items"),
    )


def contaminated() -> Column:
    """The rule: at least a twentieth of the words is hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
