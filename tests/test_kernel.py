"""Blocked dense search and the inverted file against scores folded one by one."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions.text import shown_score
from lodestone.operators import ann
from lodestone.operators.ann import IVFIndex, bounds
from lodestone.operators.kernel import Best
from lodestone.operators.search import dense_search

NAN, INF = float("nan"), float("inf")


def plain(metric, q, v):
    total = 0.0
    if metric == "L2":
        for a, b in zip(q, v, strict=True):
            total += (a - b) * (a - b)
        return total
    for a, b in zip(q, v, strict=True):
        total += a * b
    if metric == "IP":
        return total
    na = nb = 0.0
    for a in q:
        na += a * a
    for b in v:
        nb += b * b
    return total / (math.sqrt(na) * math.sqrt(nb)) if na and nb else None


def plain_best(metric, queries, rows, k):
    out = set()
    for qid, q in queries:
        found = [(plain(metric, q, v), i) for i, v in rows]
        found = sorted(((s if metric == "L2" else -s, i, s) for s, i in found if s is not None))[:k]
        out |= {(qid, i, s, r) for r, (_, i, s) in enumerate(found, 1)}
    return out


def data(seed, n=300, d=7):
    rng = random.Random(seed)
    f32 = lambda x: float(np.float32(x))
    rows = [(i, [f32(rng.gauss(0, 1) + 3 * (i % 5)) for _ in range(d)]) for i in range(n)]
    rows += [(n + i, rows[rng.randrange(40)][1]) for i in range(60)]  # ties
    rows.append((9999, [0.0] * d))
    queries = [(100 + i, [f32(rng.gauss(0, 1)) for _ in range(d)]) for i in range(9)] + [(7, rows[3][1])]
    return rows, queries


SHAPE = "array<float>"
ODD = [(5000, None), (5001, [1.0, None, 1.0, 1.0, 1.0, 1.0, 1.0]), (5002, [NAN] * 7), (5003, [INF] * 7), (5004, [1.0]), (5005, [])]


def found(rows):
    return {(r["qid"], r["id"], r["score"], r["rank"]) for r in rows.collect()}


@pytest.mark.parametrize("metric", ["IP", "L2", "COSINE"])
def test_search_and_inverted_file_equal_the_fold(spark, metric):
    rows, queries = data(3)
    table = spark.createDataFrame(rows + ODD, f"id long, vector {SHAPE}").repartition(5)
    asked = spark.createDataFrame(queries + [(1, None), (2, [NAN] * 7)], f"qid int, vector {SHAPE}")
    wanted = plain_best(metric, queries, rows, 6)
    exact = dense_search(asked, table, 6, metric)
    assert found(exact) == wanted
    assert found(dense_search(asked, table, 6, metric, query_bytes=8 * 7 * 3)) == wanted
    plan = exact._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    index = IVFIndex(table, nlist=20)
    assert found(index.search(asked, 6, metric=metric)) == wanted
    assert 0 < index.share_read() <= 1
    assert {x[:2] for x in found(index.search(asked, 6, nprobe=20, metric=metric))} == {x[:2] for x in wanted}
    assert index.search(asked, 2, nprobe=1, metric=metric).count() <= 2 * len(queries)


def test_bounds_hold_and_leave_cells_out(spark, tmp_path):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 8)) * 20
    vectors = (centres[rng.integers(0, 12, 1500)] + rng.normal(size=(1500, 8))).astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], f"id long, vector {SHAPE}")
    asked = table.filter("id % 100 = 0").select(F.col("id").alias("qid"), "vector")
    IVFIndex(table, nlist=24).save(str(tmp_path / "index"))
    for metric in ("L2", "IP", "COSINE"):
        index = IVFIndex.load(spark, str(tmp_path / "index"))
        assert found(index.search(asked, 5, metric=metric)) == found(dense_search(asked, table, 5, metric))
        assert index.share_read() < 0.6, metric
        summary = index._summary()
        queries = vectors[::100].astype(float)
        most = bounds(metric, queries, summary)
        for r in index.placed.sample(0.2, 1).collect():
            column = np.flatnonzero(summary["cell"] == r["cell"])[0]
            for i, q in enumerate(queries):
                s = plain(metric, q.tolist(), [float(x) for x in r["vector"]])
                assert (-s if metric == "L2" else s) <= most[i, column]


def test_many_small_pieces(monkeypatch):
    monkeypatch.setattr("lodestone.operators.kernel.PAIRS", 50)
    rows, queries = data(9, 120)
    best = Best("IP", np.array([q for _, q in queries]), 4)
    for low in range(0, len(rows), 50):
        best.add(np.array([i for i, _ in rows[low : low + 50]]), np.array([v for _, v in rows[low : low + 50]]))
    got = {(queries[q][0], int(i), s) for q, i, s in zip(best.query, best.ids, best.scores(), strict=True)}
    assert got == {x[:3] for x in plain_best("IP", queries, rows, 4)}


def test_empty_tables(spark):
    none = spark.createDataFrame([], f"id long, vector {SHAPE}")
    asked = spark.createDataFrame([(1, [1.0, 2.0])], f"qid long, vector {SHAPE}")
    assert dense_search(asked, none).count() == 0
    assert dense_search(asked.limit(0), asked.withColumnRenamed("qid", "id")).columns == ["qid", "id", "score", "rank"]
    assert IVFIndex(none).search(asked).count() == 0
    assert IVFIndex(asked.withColumnRenamed("qid", "id")).search(asked).count() == 1
    names = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0])], f"id string, vector {SHAPE}")
    assert [r["id"] for r in dense_search(asked, names, 1).collect()] == ["a"]


def test_shown_scores_round_the_double(spark):
    rng = random.Random(2)
    values = [0.28125, 0.33335, 0.00005, 0.00015, 0.12345, 0.0, -0.0, -0.00001, 1.5, -2.5, 0.99995, 123456.78905, 1e9, 4e15 + 0.5, NAN, INF, -INF, 0.03125, 0.09375]
    values += [rng.uniform(-2, 2) for _ in range(3000)] + [k / 100000 for k in range(5, 30000, 10)] + [rng.randrange(-99999, 99999) / 2**k for k in range(5, 22) for _ in range(40)]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", shown_score(F.col("v")).alias("s")).collect()
    assert {r["i"]: r["s"] for r in rows} == {i: f"{v:.4f}" for i, v in enumerate(values)}
    assert ann.cells(3, 2) == 3
