"""Sharding by balanced label propagation.

Documents with equal texts are linked.  Groups of more than a quarter of a shard are placed
first, largest first, each in the fullest shard that takes it whole, or in as few as it needs.
Every other document starts in a shard that its id gives, in proportion to the room left;
then, round by round, documents move towards the shard that holds most of their neighbours,
under quotas that keep the shards' row counts at most one apart.  Links are cliques and
documents of a group are alike, so a round works on counts by (group, shard), never on pairs
or documents: a group finds its fullest shard that still has room, its documents elsewhere
ask to move there, and a running total over the requests admits as many as fit.  Documents
without a link have no wish of their own and fill what is left, which is what lets linked
ones move without disturbing the balance.  Where that leaves groups apart for want of room,
more rounds go on under quotas an eighth larger, and what is over the true ones then moves
whole to the free places, which splits groups only at the edges of shards; this second result
counts if groups are in fewer parts.  Either way rounds end when nothing moves, or after
`ROUNDS`; shards are even then too, but groups may be apart that more rounds would unite.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import discard, running_total, stored, text_key

SHARDS, ROUNDS = 40, 40
#: A group above this part of a shard is placed first; by how much quotas grow where room lacks.
LARGE, SLACK = 4, 8
#: Hash buckets within which ranks are counted: of one group or shard, and of all rows.
GROUP_BUCKETS, ALL_BUCKETS = 512, 4096


def quotas(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def _at(values: list[int], index: Column) -> Column:
    return F.get(F.array(*[F.lit(v).cast("long") for v in values]), index.cast("int"))


def _starts(amounts: list[int]) -> list[int]:
    out, total = [], 0
    for x in amounts:
        out.append(total)
        total += x
    return out


def _loads(state: DataFrame, shards: int) -> list[int]:
    found = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # a row a shard
    return [found.get(s, 0) for s in range(shards)]


def place_large(sizes: list[int], quota: list[int]) -> list[dict[int, int]]:
    """Rows by shard of each group, given largest first: whole in the fullest shard that takes it, else in the emptiest ones."""
    room, places = list(quota), []
    for n in sizes:
        place: dict[int, int] = {}
        fits = [s for s, r in enumerate(room) if r >= n]
        while n:
            s = min(fits, key=lambda s: room[s]) if fits else max(range(len(room)), key=lambda s: room[s])
            place[s] = min(n, room[s])
            n, room[s] = n - place[s], room[s] - place[s]
        places.append(place)
    return places


def _shard_of(place: Column, first: list[int]) -> Column:
    """The shard in whose stretch of places, from its entry in `first` on, a place lies."""
    return F.size(F.filter(F.array(*[F.lit(x).cast("long") for x in first]), lambda x: x <= place)) - 1


def _moved(state: DataFrame, moves: DataFrame) -> DataFrame:
    """The state after moves (key, shard, target, n)."""
    gone = moves.select("_key_a", "_key_b", "shard", (-F.col("n")).alias("n"))
    come = moves.select("_key_a", "_key_b", F.col("target").alias("shard"), "n")
    return state.union(gone).union(come).groupBy("_key_a", "_key_b", "shard").agg(F.sum("n").alias("n")).filter("n > 0")


def _best(state: DataFrame) -> DataFrame:
    """target and there, the shard that holds most of a group; which of equals, its hash says, so that no shard draws all ties."""
    tie = F.xxhash64("_key_a", "_key_b", "shard")
    return state.groupBy("_key_a", "_key_b").agg(F.max(F.struct("n", tie.alias("h"), "shard")).alias("x")).select("_key_a", "_key_b", F.col("x.shard").alias("target"), F.col("x.n").alias("there"))


def _whole_groups(state: DataFrame, room: list[int]) -> DataFrame:
    """Moves that unite groups in their fullest shard with room for all of them; a group is admitted whole or not at all."""
    key = ["_key_a", "_key_b"]
    sized = state.join(state.groupBy(*key).agg(F.sum("n").alias("all")), key)
    apart = sized.filter(F.col("n") < F.col("all"))
    best = _best(apart.filter(_at(room, F.col("shard")) >= F.col("all") - F.col("n")))
    need = best.join(state.groupBy(*key).agg(F.sum("n").alias("all")), key).select(*key, "target", (F.col("all") - F.col("there")).alias("need"))
    ranked = running_total(need, ["target"], key, "need", "before", GROUP_BUCKETS)
    admitted = ranked.filter(F.col("before") + F.col("need") <= _at(room, F.col("target"))).select(*key, "target")
    return state.join(admitted, key).filter(F.col("shard") != F.col("target")).select(*key, "shard", "target", "n")


def _parts_of_groups(state: DataFrame, room: list[int]) -> DataFrame:
    """Moves of as many documents as fit to the fullest shard of their group that has any room."""
    key = ["_key_a", "_key_b"]
    asked = state.join(_best(state.filter(_at(room, F.col("shard")) > 0)), key)
    mine, its = F.xxhash64(*key, "shard"), F.xxhash64(*key, "target")
    asked = asked.filter((F.col("n") < F.col("there")) | ((F.col("n") == F.col("there")) & (mine < its)))
    ranked = running_total(asked, ["target"], [*key, "shard"], "n", "before", GROUP_BUCKETS)
    fits = F.least(F.col("n"), F.greatest(F.lit(0).cast("long"), _at(room, F.col("target")) - F.col("before")))
    return ranked.select(*key, "shard", "target", fits.alias("n")).filter("n > 0")


def _settled(state: DataFrame, path: str, quota: list[int], rounds: int) -> tuple[DataFrame, str]:
    """Rounds until nothing moves, a stored table and its path; the one given stays."""
    spark, given = state.sparkSession, path
    for _ in range(rounds):
        room = [q - n for q, n in zip(quota, _loads(state, len(quota)), strict=True)]
        for wishes in (_whole_groups, _parts_of_groups):
            moves, moves_path = stored(wishes(state, room), "shard-moves")
            done = moves.isEmpty()
            if not done:
                after, after_path = stored(_moved(state, moves), "shard-counts")
                if path != given:
                    discard(spark, path)
                state, path = after, after_path
            discard(spark, moves_path)
            if not done:
                break
        if done:
            break
    return state, path


def _levelled(state: DataFrame, quota: list[int]) -> DataFrame:
    """What is over a quota moves to the free places in order."""
    shards, key = len(quota), ["_key_a", "_key_b"]
    load = _loads(state, shards)
    over, room = [max(0, n - q) for q, n in zip(quota, load, strict=True)], [max(0, q - n) for q, n in zip(quota, load, strict=True)]
    if not any(over):
        return state
    ranked = running_total(state.filter(_at(over, F.col("shard")) > 0), ["shard"], key, "n", "before", GROUP_BUCKETS)
    low = _at(_starts(over), F.col("shard")) + F.col("before")
    spare = ranked.select(*key, "shard", low.alias("low"), (low + F.least(F.col("n"), _at(over, F.col("shard")) - F.col("before"))).alias("high")).filter("high > low")
    first = _starts(room)
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("high"), _at(first, F.col("target")) + _at(room, F.col("target"))) - F.greatest(F.col("low"), _at(first, F.col("target"))))
    moves = spare.withColumn("target", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).select(*key, "shard", "target", part.alias("n")).filter("n > 0")
    return stored(_moved(state, moves), "shard-counts")[0]


def propagate(state: DataFrame, quota: list[int], rounds: int = ROUNDS) -> DataFrame:
    """Rounds of balanced label propagation over (_key_a, _key_b, shard, n); at the end no shard is over its quota."""
    start, start_path = stored(state, "shard-counts")
    strict, strict_path = _settled(start, start_path, quota, rounds)
    level = _levelled(strict, quota)
    parts, groups = level.count(), level.select("_key_a", "_key_b").distinct().count()
    if parts == groups:
        return level
    loose, _ = _settled(strict, strict_path, [q + -(-q // SLACK) for q in quota], rounds)
    other = _levelled(loose, quota)
    return other if other.count() < parts else level


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text plus 16), text_crc32, shard and slot of each row.

    Row counts of shards are at most one apart and slots have no gaps.  Null texts have no
    bytes, the CRC-32 of an empty text and no links; empty texts are linked like other equal
    texts.  Rows that repeat are rows of their own.  A text of any
    length is read for its size and hashes alone.  An empty table gives an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.col("text").isNotNull().alias("_whole"), *text_key())
    base, _ = stored(base, "shard-documents")
    key = ["_key_a", "_key_b"]
    # Stored, and so shuffled for the join alone: a join on top of the grouping's own partitions could not split a hot group.
    groups, _ = stored(base.filter("_whole").groupBy(*key).agg(F.count("*").alias("_n")).filter("_n > 1"), "shard-groups")
    marked, _ = stored(base.join(groups.withColumn("_linked", F.lit(True)), key, "left").withColumn("_linked", F.col("_whole") & F.coalesce("_linked", F.lit(False))), "shard-linked")
    linked, single = marked.filter("_linked"), marked.filter("not _linked")
    quota = quotas(marked.count(), shards)
    # At most 8 * LARGE groups a shard and their counts, as each fills a part of it.
    large = groups.filter(F.col("_n") * LARGE > quota[-1]).orderBy(F.desc("_n"), *key).collect()
    places = place_large([r["_n"] for r in large], quota)
    put = [(r["_key_a"], r["_key_b"], s, n) for r, place in zip(large, places, strict=True) for s, n in place.items()]
    fixed = base.sparkSession.createDataFrame(put, "_key_a long, _key_b long, shard int, n long")
    taken = _loads(fixed, shards)
    rest = [q - n for q, n in zip(quota, taken, strict=True)]
    small = linked.join(F.broadcast(fixed.select(*key).distinct()), key, "left_anti")
    place = F.pmod(F.xxhash64("doc_id"), F.lit(max(1, sum(rest))))
    start = small.groupBy(*key, _shard_of(place, _starts(rest)).alias("shard")).agg(F.count("*").alias("n"))
    state = fixed.union(propagate(start, rest, rounds))
    load = _loads(state, shards)

    slots = running_total(state, ["shard"], key, "n", "slot", GROUP_BUCKETS)
    places, _ = stored(slots.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("shard", "n", "slot"))).alias("places")), "shard-places")  # a place a shard at most
    ranked = running_total(linked.withColumn("one", F.lit(1).cast("long")), key, ["doc_id"], "one", "rank", GROUP_BUCKETS)
    begin = F.struct(F.col("rank").alias("left"), F.lit(None).cast("int").alias("shard"), F.lit(None).cast("long").alias("slot"))

    def take(acc: Column, x: Column) -> Column:
        here = acc["shard"].isNull() & (acc["left"] < x["n"])
        return F.struct((acc["left"] - F.when(acc["shard"].isNull() & ~here, x["n"]).otherwise(0)).alias("left"), F.when(here, x["shard"]).otherwise(acc["shard"]).alias("shard"), F.when(here, x["slot"] + acc["left"]).otherwise(acc["slot"]).alias("slot"))

    put = ranked.join(places, key).withColumn("_put", F.aggregate("places", begin, take))
    put = put.select("doc_id", "size", "text_crc32", F.col("_put.shard").alias("shard"), F.col("_put.slot").alias("slot"))

    room = [q - n for q, n in zip(quota, load, strict=True)]
    first = _starts(room)
    rest = running_total(single.withColumn("one", F.lit(1).cast("long")), [], ["doc_id", "text_crc32", *key], "one", "rank", ALL_BUCKETS)
    rest = rest.select("doc_id", "size", "text_crc32", _shard_of(F.col("rank"), first).alias("shard"), "rank")
    rest = rest.select("doc_id", "size", "text_crc32", "shard", (_at(load, F.col("shard")) + F.col("rank") - _at(first, F.col("shard"))).alias("slot"))
    return put.unionByName(rest)
