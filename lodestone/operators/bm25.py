"""BM25 term weights and sparse search over postings (id, term, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import tokens
from lodestone.operators.ranking import ranked

# Fixed values.
K1, B, PLACES = 1.5, 0.75, 6
#: Distinct terms of queries (some 40 bytes each) that are sent to every executor at most.
SENT_TERMS = 500_000


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, term, tf and dl (tokens of the text): one pass over the texts.

    A text's own tokens are sorted and runs of them counted, so nothing is shuffled but ids, which
    tell those that several rows have: of these rows alone the counts are added up.
    """
    cut = docs.select(F.col(id_col).alias("id"), F.sort_array(tokens(F.col(text_col))).alias("_tokens"))
    starts = F.filter(F.transform("_tokens", lambda t, i: F.when((i == 0) | (t != F.get("_tokens", i - 1)), i)), lambda i: i.isNotNull())
    cut = cut.select("id", "_tokens", F.size("_tokens").cast("long").alias("dl"), starts.alias("_starts"))
    runs = F.transform("_starts", lambda at, j: F.struct(F.get("_tokens", at).alias("term"), (F.coalesce(F.get("_starts", j + 1), F.col("dl")) - at).cast("long").alias("tf")))
    # The outer form, as for the inner one Spark would work out the runs twice, once to see if there are any.
    rows = cut.select("id", "dl", F.explode_outer(runs).alias("_run")).select("id", "_run.term", "_run.tf", "dl").filter("term is not null")
    again = docs.groupBy(F.col(id_col).alias("_id")).count().filter("count > 1").select("_id")
    if again.isEmpty():
        return rows
    same = F.col("id").eqNullSafe(F.col("_id"))
    several = rows.join(again, same, "left_semi").groupBy("id", "term").agg(F.sum("tf").alias("tf"), F.first("dl").alias("dl"))
    return rows.join(again, same, "left_anti").unionByName(several)


def asked_postings(docs: DataFrame, id_col: str, text_col: str, asked: DataFrame) -> DataFrame:
    """The same of the terms of `asked` (term, ...) alone, and a row of term null with the tf of all others.

    corpus_size can be told from it, so texts are cut once; what is shuffled is the texts, by id.
    """
    cut = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text")).repartition("id").select("id", tokens(F.col("_text")).alias("_tokens"))
    rows = cut.select("id", F.size("_tokens").cast("long").alias("dl"), F.explode_outer("_tokens").alias("_token"))
    terms = asked.select(F.col("term").alias("_token"), F.col("term")).distinct()
    met = rows.join(sent(terms), "_token", "left")
    return met.groupBy("id", "term").agg(F.count("_token").alias("tf"), F.first("dl").alias("dl"))


def text_size(docs: DataFrame, text_col: str) -> DataFrame:
    """What corpus_size says, from the texts themselves: nothing is shuffled but sums."""
    total = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size(tokens(F.col(text_col)))), F.lit(0)).alias("_tokens"))
    return _averaged(total)


def _averaged(total: DataFrame) -> DataFrame:
    return total.select("n", F.coalesce(F.nullif(F.col("_tokens") / F.nullif(F.col("n"), F.lit(0)), F.lit(0.0)), F.lit(1.0)).alias("avgdl"))


def corpus_size(docs: DataFrame, found: DataFrame) -> DataFrame:
    """One row: n texts and avgdl, 1 where no text has a token; from the postings, so texts are cut once."""
    total = found.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("_tokens"))
    return _averaged(docs.agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)))


def idf_table(found: DataFrame, size: DataFrame) -> DataFrame:
    """term, df and idf; the one-row size is sent to every task."""
    return idf_of(found.groupBy("term").agg(F.count("*").alias("df")), size)


def idf_of(counted: DataFrame, size: DataFrame) -> DataFrame:
    """The same from terms that are counted already (term, df)."""
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    return counted.crossJoin(F.broadcast(size.select("n"))).select("term", "df", idf.alias("idf"))


def document_weights(found: DataFrame, idf: DataFrame, size: DataFrame) -> DataFrame:
    """id, term, tf and w; weights that round to nothing stay, those not over 0 go."""
    rows = found.join(idf.select("term", "idf"), "term").crossJoin(F.broadcast(size.select("avgdl")))
    long = F.greatest(F.col("dl"), F.lit(1))
    w = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * long / F.col("avgdl")))
    return rows.select("id", "term", "tf", w.alias("w")).filter("w > 0").withColumn("w", F.round("w", PLACES))


def query_weights(queries: DataFrame, id_col: str, text_col: str, idf: DataFrame) -> DataFrame:
    """qid, term, w: like document weights at average length; terms that no text has are dropped."""
    found = postings(queries, id_col, text_col).withColumnRenamed("id", "qid")
    w = F.round(F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1), PLACES)
    return found.join(idf.select("term", "idf"), "term").select("qid", "term", w.alias("w"))


def sent(side: DataFrame, most_rows: int = SENT_TERMS) -> DataFrame:
    """A small kept side (term, ...), sent to all executors if its counted rows allow it."""
    return F.broadcast(side) if side.limit(most_rows + 1).count() <= most_rows else side


def asked_only(rows: DataFrame, queries: DataFrame, most_terms: int = SENT_TERMS) -> DataFrame:
    """Rows (id, term, ...) of terms that some query (qid, term, ...) has."""
    return rows.join(sent(queries.select("term").distinct(), most_terms), "term", "left_semi")


def sparse_vectors(weights: DataFrame) -> DataFrame:
    """id and its map of term to weight."""
    return weights.groupBy("id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("term", "w")))).alias("sparse_vector"))


def sparse_search(queries: DataFrame, documents: DataFrame, k: int = 5, threshold: float | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """qid, id, score, rank: inner products over shared terms; `allowed` ids are kept before the cut, the threshold applies after it.

    Only postings of the queries' terms reach the shuffles: the queries' terms meet them where they
    lie if they are few enough to be sent out, and sums are made before the shuffle by (qid, id).
    There is no such shuffle if the rows are dealt by id.
    """
    if allowed is not None:
        documents = documents.join(allowed.select("id").distinct(), "id", "left_semi")
    asked = queries.select("qid", "term", F.col("w").alias("_qw"))
    few = asked.limit(SENT_TERMS + 1).count() <= SENT_TERMS
    rows = documents if few else asked_only(documents, queries)
    rows = rows.select("id", "term", F.col("w").alias("_dw")).join(F.broadcast(asked) if few else asked, "term")
    scores = rows.groupBy("qid", "id").agg(F.round(F.sum(F.col("_dw") * F.col("_qw")), PLACES).alias("score"))
    return ranked(scores, k, threshold)
