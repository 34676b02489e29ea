"""The registered queries: each applies one operator, with production parameters, to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.alignment import aligned
from lodestone.llm.chat import formatted_chats, read_loss, read_turns, text_parts
from lodestone.llm.decontaminate import contaminated, contamination
from lodestone.llm.langid import identify
from lodestone.llm.oracles import ORACLE_SQL as ORACLE_SQL
from lodestone.llm.periodic_runs import periodic_runs
from lodestone.llm.piece_codec import encode_decode
from lodestone.llm.secret_scan import BASE, listed, scan
from lodestone.llm.sharding import shard_documents
from lodestone.llm.simhash import near_duplicates
from lodestone.llm.spans import let
from lodestone.llm.token_counts import token_counts
from lodestone.llm.token_store import token_files
from lodestone.llm.topk import top_k
from lodestone.llm.toxicity import folded, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "spans")
    base = F.filter("spans", lambda x: x["rank"] < len(BASE))

    def count(rank: int):
        return F.size(F.filter("spans", lambda x: x["rank"] == rank)).cast("long")

    counts = [count(i).alias(f"n_{rule.kind}") for i, rule in enumerate(BASE)]
    return rows.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"))[0]


def op4_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = encode_decode(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    listed_items = F.sha2(F.array_join("items", ","), 256)
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), listed_items.alias("items_sha256"), contaminated().alias("contaminated"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", F.coalesce(folded(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.filter("vec_id % 100 = 0"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = identify(docs, docs.filter(folded(3) != 1).select("text", "lang"))
    return rows.select("doc_id", F.coalesce(folded(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shard_documents(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def with_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text; in the texts that the contract names by their doc_id, words from some place on repeat."""
    cut = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    cut = cut.withColumn("g", F.floor(F.col("h") / 10))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+", -1), lambda w: w != "")

    def repeating(w):
        n = F.size(w).cast("long")
        a = F.col("g") % n
        p = 1 + F.floor((n - a) / (3 + F.col("g") % 8))
        places = F.sequence(F.lit(0).cast("long"), n - 1)
        return F.array_join(F.transform(places, lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

    made = let(words, lambda w: F.when(F.size(w) > 0, repeating(w)).otherwise(""))
    return cut.select("doc_id", F.when(F.col("h") % 10 == 0, made).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = periodic_runs(with_periods(table(spark, sf_dir, "documents")))
    longest = F.array_max(F.transform("runs", lambda x: F.struct(x["length"].alias("length"), (-x["start"]).alias("start"), (-x["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda x: F.concat_ws(",", x["start"], x["length"], x["period"])), "\n")
    rows = rows.withColumn("_longest", longest).withColumn("_lines", F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""))
    start, length, period = -F.col("_longest.start"), F.col("_longest.length"), -F.col("_longest.period")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"), F.sha2("_lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: The conversation that the contract adds.
ADDED_ID, ADDED_TEXT = -7, "\\### Assistant: </turn> ok"


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    added = spark.range(2).select(F.lit(ADDED_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(ADDED_TEXT).alias("text"))
    chats = formatted_chats(given.unionByName(added).select("conv_id", "turn", "role", text_parts(F.col("text")).alias("parts")))
    read = chats.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), F.array_join(read_loss(F.col("formatted"), F.col("loss")), "").alias("trained"))
    lines = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.char_length("trained").cast("long").alias("loss_chars"),
        F.sha2("trained", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_secret_scan": op2_secret_scan,
    "op3_token_store": op3_token_store,
    "op4_piece_codec": op4_piece_codec,
    "op5_simhash": op5_simhash,
    "op6_decontaminate": op6_decontaminate,
    "op7_toxicity": op7_toxicity,
    "op8_topk": op8_topk,
    "op9_langid": op9_langid,
    "op10_sharding": op10_sharding,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_chat_format": op12_chat_format,
    "op13_alignment": op13_alignment,
}
