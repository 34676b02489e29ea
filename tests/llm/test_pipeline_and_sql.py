"""The pipeline's stages, and the queries that have SQL."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import piece_codec, queries
from lodestone.llm.common import stored
from tests.compare import DATA, rows_of_duckdb, rows_of_spark
from tests.llm import brute

SF = f"{DATA}/sf0.001"
STAGE = dict(corpus_pipeline.STAGES)


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_sql(spark, name):
    found, names = rows_of_spark(queries.QUERIES[name](spark, SF))
    wanted, wanted_names = rows_of_duckdb(queries.ORACLE_SQL[name], SF)
    assert names == wanted_names
    assert found == wanted


def test_stages(spark, mixed):
    docs = mixed.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.char_length("text").cast("long"), "score": F.lit(1), "spans": F.lit("x"), "items": F.lit("y")})
    docs, _ = stored(docs, "test")
    given = docs.toPandas()

    one = STAGE["near_dedup"](spark, docs, SF)
    assert one.schema.simpleString() == docs.schema.simpleString()
    order = given.assign(no_id=given.doc_id.isna()).sort_values(["no_id", "doc_id"])
    firsts = brute.firsts_of_near_copies(list(order.text))  # five words, similarity 0.8
    assert sorted(x or "" for x in one.toPandas().text) == sorted(order.text.iloc[c] or "" for c in firsts)

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = STAGE["decontamination"](spark, docs, SF)
    clean = [t for t in given.text for n, h, _ in [brute.contamination(t, items)] if not (h > 0 and 20 * h >= n)]
    assert sorted(x or "" for x in left.toPandas().text) == sorted(x or "" for x in clean)
    assert len(clean) < len(given)

    hidden = STAGE["secret_scan"](spark, docs, SF).toPandas()
    assert len(hidden) == len(given)
    assert all(not brute.secrets(t, brute.BASE) for t in hidden.text)
    assert all(n == len(t) for n, t in zip(hidden.n_chars, hidden.text, strict=True) if t is not None)

    kept = STAGE["toxicity"](spark, docs, SF)
    assert kept.columns == docs.columns and 0 < kept.count() <= docs.count()

    coded = STAGE["encoding"](spark, docs, SF).toPandas()
    e = piece_codec.encoder(piece_codec.public_model())
    wanted = sorted(len(e.processor.encode(t or "", add_bos=True, add_eos=True)) for t in given.text)
    assert sorted(coded.n_tokens) == wanted
    for stage in STAGE.values():
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF).toPandas()
    assert rows.doc_id.is_unique and 0 < len(rows) < 200
    e = piece_codec.encoder(piece_codec.public_model())
    for ids, digest in zip(rows.ids, rows.decoded_sha256, strict=True):
        assert digest == brute.sha(e.processor.decode(np.frombuffer(ids, "<u4").tolist()))
