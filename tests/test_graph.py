"""The small-world graph against the exact search."""

from pyspark.sql import functions as F

from lodestone.operators.graph import GraphIndex
from lodestone.operators.search import dense_search
from lodestone.plans.collection import Collection
from lodestone.queries import QUERIES, collection, vector_queries

SF = "/root/testdata/sf0.01"
SHAPE = "id long, vector array<float>"


def pairs(rows):
    return {(r["qid"], r["id"]) for r in rows.collect()}


def test_recall_and_distances(spark, tmp_path):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    asked = vectors.filter("id % 100 = 0").select(F.col("id").alias("qid"), "vector")
    GraphIndex(vectors).save(str(tmp_path))
    graph = GraphIndex.load(spark, str(tmp_path))
    found, exact = pairs(graph.search(asked, 5, 32)), pairs(dense_search(asked, vectors))
    assert len(found) == len(exact) and len(found & exact) / len(exact) >= 0.9
    assert graph.compared < 0.8 * vectors.count() * asked.count()


def test_registered_query(spark):
    exact, found = pairs(dense_search(vector_queries(spark, SF), collection(spark, SF))), pairs(QUERIES["graph_topk"](spark, SF))
    assert len(found & exact) / len(exact) >= 0.9


def test_odd_rows_ties_and_small_tables(spark, metric="L2"):
    rows = [(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(90)] + [(900, None), (901, [1.0]), (902, [float("nan"), 1.0, 1.0])]
    table = spark.createDataFrame(rows, SHAPE)
    asked = spark.createDataFrame([(1, [0.0, 1.0, 0.0]), (2, [6.0, 1.0, 2.0])], "qid long, vector array<float>")
    assert pairs(GraphIndex(table, metric).search(asked, 3)) == pairs(dense_search(asked, table, 3, metric))
    few = table.filter(F.col("id") < 2)
    assert pairs(GraphIndex(few, metric).search(asked, 3)) == pairs(dense_search(asked, few, 3, metric))
    assert GraphIndex(table.limit(0), metric).search(asked).count() == 0
    assert GraphIndex(table, metric).search(asked.limit(0)).count() == 0


def test_collection_uses_its_indexes(spark, tmp_path):
    made = Collection(spark, str(tmp_path / "c"), 64)
    made.create()
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    made.insert(rows.select(F.concat(F.lit("t"), "vec_id").alias("text"), F.struct(F.col("vec_id").alias("n")).alias("metadata"), F.col("embedding").alias("vector")))
    asked = rows.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
    exact = pairs(made.search(asked))
    made.build_index()
    made.build_index(graph=True)
    assert made._covered("index") and made._covered("graph-index")
    assert pairs(made.search(asked)) == exact
    assert len(pairs(made.approximate_search(asked, beam=64)) & exact) >= 0.9 * len(exact)
    made.insert(rows.limit(1).select(F.lit("new").alias("text"), F.struct(F.lit(1).cast("long").alias("n")).alias("metadata"), F.col("embedding").alias("vector")))
    assert not made._covered("index") and len(pairs(made.search(asked))) == len(exact)


def test_rounds_write_beams_and_what_is_new(spark, monkeypatch):
    """No table of a search but that of a round's new ids is longer than the beams, and no pair is met twice."""
    from lodestone.operators import graph as module

    written, keep = [], module.kept_at

    def counted(rows, tag):
        made = keep(rows, tag)
        written.append((tag, made[0].count()))
        return made

    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    asked = vectors.filter("id % 100 = 0").select(F.col("id").alias("qid"), "vector")
    index = GraphIndex(vectors, links=4)
    monkeypatch.setattr(module, "kept_at", counted)
    found = pairs(index.search(asked, 5, 8))
    assert found and max(n for tag, n in written if tag != "graph-met") <= 8 * asked.count()
    assert 0 < sum(n for tag, n in written if tag == "graph-met") <= asked.count() * sum(layer.count() for layer in index.layers)
