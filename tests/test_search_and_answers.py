"""Ranking, fusion, filters, BM25, index, embedding, answers."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.functions.text import TOKEN_BREAKS, tokens
from lodestone.operators.ann import IVFIndex, cells
from lodestone.operators.blockmax import BlockedPostings, blocked
from lodestone.operators.bm25 import asked_postings, corpus_size, document_weights, idf_table, postings, query_weights, sparse_search, sparse_vectors, text_size
from lodestone.operators.embedding import EmbeddingError, embed_cached, embedded, hashing_embedder, with_retries
from lodestone.operators.fusion import rrf
from lodestone.operators.predicates import FilterError, matching, to_sql
from lodestone.operators.search import dense_search
from lodestone.plans import rag

DOCS = ["heart attack pain chest pain", "diabetes blood sugar", "chest x ray", "症状", "blood pressure heart"]


def bm25(spark):
    docs = spark.createDataFrame(list(enumerate(DOCS)), "id int, text string")
    found = postings(docs, "id", "text")
    size = corpus_size(docs, found)
    idf = idf_table(found, size)
    return document_weights(found, idf, size), idf


def test_bm25_equals_a_plain_loop(spark):
    toks = [[] if d == "症状" else d.split() for d in DOCS]
    avgdl, df = sum(map(len, toks)) / len(toks), Counter(t for d in toks for t in set(d))
    idf = {t: math.log((len(DOCS) - n + 0.5) / (n + 0.5) + 1) for t, n in df.items()}
    wanted = {(i, t): round(idf[t] * n * 2.5 / (n + 1.5 * (0.25 + 0.75 * max(len(d), 1) / avgdl)), 6) for i, d in enumerate(toks) for t, n in Counter(d).items()}
    weights, terms = bm25(spark)
    assert {(r["id"], r["term"]): r["w"] for r in weights.collect()} == pytest.approx(wanted)
    asked = query_weights(spark.createDataFrame([(0, "chest pain pain unknown"), (1, "症状")], "qid int, question string"), "qid", "question", terms)
    assert {r["term"]: r["w"] for r in asked.collect()} == pytest.approx({"chest": round(idf["chest"], 6), "pain": round(idf["pain"] * 2 * 2.5 / 3.5, 6)})
    hits = sparse_search(asked, weights, 1).collect()
    assert [(r["qid"], r["id"], r["rank"]) for r in hits] == [(0, 0, 1)]
    assert len(sparse_vectors(weights).collect()) == 4


def test_postings_shuffle_no_terms_and_add_up_repeated_ids(spark):
    rows = [(1, "a b a"), (2, "b"), (None, "c c"), (None, "c d"), (3, ""), (4, None), (2, "b e")]
    docs = spark.createDataFrame(rows, "id int, text string")
    want = {(1, "a"): 2, (1, "b"): 1, (2, "b"): 2, (2, "e"): 1, (None, "c"): 3, (None, "d"): 1}
    assert {(r["id"], r["term"]): r["tf"] for r in postings(docs, "id", "text").collect()} == want
    once = postings(docs.filter("id = 1 or text = ''"), "id", "text")
    assert "Exchange" not in once._jdf.queryExecution().executedPlan().toString()
    part = asked_postings(docs, "id", "text", spark.createDataFrame([("b",), ("c",), ("z",)], "term string"))
    assert {(r["id"], r["term"]): r["tf"] for r in part.filter("term is not null").collect()} == {k: n for k, n in want.items() if k[1] in "bc"}
    assert corpus_size(docs, part).collect() == corpus_size(docs, postings(docs, "id", "text")).collect() == text_size(docs, "text").collect()


def test_tokens_break_where_the_whole_class_does(spark):
    odd = "".join(map(chr, [*range(0x3100), *range(0x4DFE, 0x4E05), *range(0x9FFA, 0xA003), *range(0xFF00, 0xFF20)]))
    texts = ["a".join(odd), odd, "A 'b  c\x1f\x00d\x7f ", "一" * 50_000 + "é" + " " * 50_000 + "x", "", None]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    plain = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), TOKEN_BREAKS, -1), lambda t: t != "")
    assert docs.filter(~tokens(F.col("text")).eqNullSafe(plain)).count() == 0


def test_sparse_search_filters_before_the_cut(spark):
    weights, terms = bm25(spark)
    asked = query_weights(spark.createDataFrame([(0, "heart")], "qid int, question string"), "qid", "question", terms)
    allowed = spark.createDataFrame([(4,)], "id int")
    assert [r["id"] for r in sparse_search(asked, weights, 1, allowed=allowed).collect()] == [4]
    assert sparse_search(asked, weights, 5, threshold=100.0).count() == 0


def test_blocks_give_what_all_postings_give(spark, tmp_path):
    rng = random.Random(6)
    words = [f"w{min(int(rng.paretovariate(0.6)), 400)}" for _ in range(6000)]
    docs = spark.createDataFrame([(i, " ".join(words[9 * i % 5900 : 9 * i % 5900 + 3 + i % 40])) for i in range(700)] + [(900 + i, words[0]) for i in range(30)], "id long, text string")
    found = postings(docs, "id", "text")
    size = corpus_size(docs, found)
    idf = idf_table(found, size)
    weights = document_weights(found, idf, size)
    asked = query_weights(spark.createDataFrame([(i, " ".join(rng.choices(words, k=1 + i % 6))) for i in range(40)] + [(99, "none of these")], "qid int, question string"), "qid", "question", idf)
    BlockedPostings(weights, 4).save(str(tmp_path))
    blocked = BlockedPostings.load(spark, str(tmp_path))
    allowed = docs.filter("id % 3 = 0").select("id")
    for options in ({}, {"threshold": 4.0}, {"allowed": allowed}):
        wanted = sorted(map(tuple, sparse_search(asked, weights, 4, **options).collect()))
        assert sorted(map(tuple, blocked.search(asked, 4, **options).collect())) == wanted and wanted
    assert 0 < blocked.share_read() < 0.9
    assert blocked.search(asked.limit(0), 4).count() == 0
    assert BlockedPostings(weights.limit(0)).search(asked, 4).count() == 0


def test_blocked_query_indexes_the_terms_that_are_asked(spark, monkeypatch):
    """Postings that no question can meet aren't dealt, and those that are go through one shuffle."""
    from lodestone import queries

    given = []
    monkeypatch.setattr(queries, "BlockedPostings", lambda weights, **options: given.append(weights) or BlockedPostings(weights, **options))
    sf = "/root/testdata/sf0.001"
    found = queries.bm25_blockmax(spark, sf)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, queries.bm25_search(spark, sf).collect()))
    questions = postings(queries.text_queries(spark, sf), "qid", "question").select("term")
    assert given[0].join(questions, "term", "left_anti").count() == 0 < given[0].count()
    stored = spark.createDataFrame([(1, "a", 1.0), (2, "a", 2.0), (2, "b", 0.5)], "id long, term string, w double")
    index = BlockedPostings(stored)
    assert sorted(map(tuple, index.weights().collect())) == [(1, "a", 1.0), (2, "a", 2.0), (2, "b", 0.5)]
    plan = blocked(stored, texts=2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


VECTORS = [(1, [1.0, 0.0], "a"), (2, [0.0, 1.0], "b"), (3, [1.0, 0.0], "b"), (4, [0.5, 0.5], "a")]


@pytest.mark.parametrize("block", [1, 100])
def test_dense_search(spark, block):
    rows = spark.createDataFrame(VECTORS, "id int, vector array<float>, lang string")
    asked = spark.createDataFrame([(10, [1.0, 0.0]), (11, [0.0, 2.0])], "qid int, vector array<float>")

    def found(**options):
        return sorted((r["qid"], r["rank"], r["id"]) for r in dense_search(asked, rows, 2, query_bytes=16 * block, **options).collect())

    assert found() == [(10, 1, 1), (10, 2, 3), (11, 1, 2), (11, 2, 4)]
    assert found(metric="l2") == [(10, 1, 1), (10, 2, 3), (11, 1, 2), (11, 2, 4)]
    assert found(expr='lang == "b"') == [(10, 1, 3), (10, 2, 2), (11, 1, 2), (11, 2, 3)]
    assert found(threshold=0.9) == [(10, 1, 1), (10, 2, 3), (11, 1, 2), (11, 2, 4)]
    assert found(metric="L2", threshold=0.2, literal_threshold=False) == [(10, 1, 1), (10, 2, 3)]
    with pytest.raises(ValueError, match="metric"):
        found(metric="jaccard")


def test_predicates(spark, tmp_path):
    assert to_sql('metadata["k"] == "it\'s" && x in [1, 2] || y like "a%"') == "`metadata`.`k` = 'it\\'s' AND `x` IN ( 1 , 2 ) OR `y` LIKE 'a%'"
    for bad in ("x in (select 1)", "exists (select 1)", "upper(y) == 'A'", "x == 1; drop", "x in [1, 2", "x == 1)", "a b", "x in [1)", 'y == "open', "x -- c\n== 1 y"):
        with pytest.raises(FilterError):
            to_sql(bad)
    with pytest.raises(FilterError, match="at 5"):
        to_sql("x == $1")
    spark.createDataFrame([(i, f"t{i}") for i in range(50)], "x int, y string").write.parquet(str(tmp_path / "rows"))
    some = matching(spark.read.parquet(str(tmp_path / "rows")), 'x >= 40 && !(y == "t41") and x + 1 != 43')
    assert sorted(r["x"] for r in some.collect()) == [40, *range(43, 50)]
    assert "GreaterThanOrEqual(x,40)" in some._jdf.queryExecution().toString().split("PushedFilters", 1)[1]
    rows = spark.createDataFrame([(1, "it's"), (2, "a && b")], "x int, y string")
    assert [r["x"] for r in matching(rows, 'y == "a && b"').collect()] == [2]
    assert [r["x"] for r in matching(rows, 'y == "it\'s" && x in [1]').collect()] == [1]
    assert matching(rows, None).count() == 2


def test_fusion_order_and_scores(spark):
    dense = spark.createDataFrame([(0, 1, 0.9, 1), (0, 2, 0.8, 2)], "qid int, id int, score double, rank int")
    sparse = spark.createDataFrame([(0, 3, 7.0, 1), (0, 2, 6.0, 2)], "qid int, id int, score double, rank int")
    rows = rrf(dense, sparse).orderBy("rank").collect()
    assert [(r["id"], r["score"]) for r in rows] == [(2, 0.8), (1, 0.9), (3, 7.0)]
    assert rows[0]["rrf_score"] == pytest.approx(2 / 62)
    assert [r["id"] for r in rrf(dense, sparse, threshold=1 / 61 + 0.001).collect()] == [2]


def test_inverted_file(spark):
    assert (cells(100, 64), cells(10**6, 1536), cells(10**6, 8)) == (100, 6144, 128)
    data = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    asked = data.filter("id < 20").select(F.col("id").alias("qid"), "vector")
    index, exact = IVFIndex(data, nlist=16), {(r["qid"], r["id"]) for r in dense_search(asked, data).collect()}
    everything = {(r["qid"], r["id"]) for r in index.search(asked, nprobe=16).collect()}
    part = {(r["qid"], r["id"]) for r in index.search(asked, nprobe=8).collect()}
    assert everything == exact
    assert len(part & exact) / len(exact) > 0.5


def test_embedding_retries_and_cache(spark):
    calls = []

    def flaky(texts):
        calls.append(texts)
        if len(calls) < 3:
            raise EmbeddingError("busy")
        return [[1.0]] * len(texts)

    assert with_retries(flaky, first_wait=0)(["a"]) == [[1.0]]
    with pytest.raises(EmbeddingError):
        with_retries(lambda t: (_ for _ in ()).throw(EmbeddingError("no")), first_wait=0)(["a"])
    rows = spark.createDataFrame([(1, "a b"), (2, "c"), (3, "a b")], "id int, text string")
    embed = hashing_embedder(8)
    assert [r["vector"] for r in embedded(rows, "text", embed, 8).orderBy("id").collect()][0] == pytest.approx(embed(["a b"])[0])
    cache = spark.createDataFrame([], "text_hash string, model string, vector array<float>, ts timestamp")
    out, gained = embed_cached(rows, "text", embed, 8, cache, "m")
    assert gained.count() == 2 and out.filter("vector is null").count() == 0
    again, more = embed_cached(rows, "text", embed, 8, gained, "m")
    assert more.count() == 0 and again.count() == 3
    assert embed_cached(rows, "text", embed, 8, gained, "m", skip_cache=True)[1].count() == 2


def test_answers(spark):
    asked = spark.createDataFrame([(0, "why?"), (1, "how?")], "qid int, question string")
    hits = spark.createDataFrame([(0, 2, "second", ("s", 1), 0.88), (0, 1, "x" * 250, ("t", 2), 0.95)], "qid int, rank int, text string, metadata struct<source:string,page:int>, score double")
    rows = {r["qid"]: r for r in rag.answers(asked, hits).collect()}
    assert rows[0]["context"] == f"[文档1]\n{'x' * 250}\n\n---\n\n[文档2]\nsecond"
    assert [s["text"] for s in rows[0]["sources"]] == ["x" * 200 + "...", "second"]
    assert rows[0]["answer"] == "x" * 250
    assert "证据" in rows[1]["answer"] and rows[1]["sources"] == [] and rows[1]["context"] == ""
    seen = spark.sparkContext.accumulator(0)

    def counting(prompts):
        seen.add(len(prompts))
        return ["ok"] * len(prompts)

    assert rag.answers(asked, hits, counting).count() == 2 and seen.value <= 1


def test_events_and_frames(spark):
    rows = spark.createDataFrame([(0, "two words", [("t",)])], "qid int, answer string, sources array<struct<text:string>>")
    events = rag.events(rows).orderBy("seq").collect()
    assert [e["event"] for e in events] == ["sources", "token", "token", "done"]
    frames = rag.events(rows).orderBy("seq").select(rag.framed(F.col("event"), F.col("data")).alias("f")).collect()
    text = "".join(r["f"] for r in frames)
    back = spark.createDataFrame([(text,)], "f string").select(rag.parsed(F.col("f")).alias("p")).first()["p"]
    assert [(p["event"], p["data"]) for p in back] == [(e["event"], e["data"]) for e in events]


def test_question_validation(spark):
    rows = spark.createDataFrame([("", 5), ("a", None), ("x" * 2000, 1), ("x" * 2001, 1), ("a", 0), ("a", 50), ("a", 51), (None, 3)], "question string, top_k int")
    good, bad = rag.valid_questions(rows)
    assert (good.count(), bad.count()) == (3, 5)
