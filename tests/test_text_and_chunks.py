"""Tokens, splitting, chunk ids."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions.text import filled, preview, shortened, shown_score, tokens
from lodestone.operators.chunks import ChunkSettings, chunk_statistics, exploded_chunks, split_documents, with_dense_ids
from lodestone.operators.splitting import greedy_split, recursive_split, windows


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("急性心肌梗死（AMI）的典型症状", ["ami"]),
        ("空腹血糖≥7.0 mmol/L，或OGTT 2h血糖≥11.1 mmol/L。", ["≥7.0", "mmol/l", "ogtt", "2h", "≥11.1", "mmol/l"]),
        ("don't say \"hi\", OK.", ["don", "t", "say", '"hi",', "ok."]),
        ("症状描述", []),
        ("a b c　d", ["a", "b", "c", "d"]),
        (None, []),
    ],
)
def test_tokens(spark, text, wanted):
    assert one(spark, tokens(F.lit(text).cast("string"))) == wanted


def test_display(spark):
    assert one(spark, shortened(F.lit("x" * 201))) == "x" * 200 + "..."
    assert one(spark, shortened(F.lit("x" * 200))) == "x" * 200
    assert one(spark, preview(F.lit("a\nb"))) == "a b"
    assert one(spark, shown_score(F.lit(None).cast("double"))) == "N/A"
    assert one(spark, shown_score(F.lit(0.12345))) == "0.1235"
    assert one(spark, filled("<{context}|{question}>", context=F.lit("{question}"), question=F.lit("q"))) == "<{question}|q>"


def test_recursive_split_overlaps_by_pieces():
    text = "\n".join(f"line {i} with some words" for i in range(60))
    chunks = recursive_split(text, 100, 30)
    assert all(len(c) <= 100 for c in chunks)
    assert all(a.split("\n")[-1] == b.split("\n")[0] for a, b in zip(chunks, chunks[1:], strict=False))
    assert recursive_split("x " * 240) == [("x " * 240).strip()]


def test_recursive_split_prefers_paragraphs():
    one_paragraph, heading = "心" * 300, "### 体征"
    text = f"{one_paragraph}\n\n{heading}\n\n{one_paragraph}"
    first, second = recursive_split(text, 320, 50)
    assert first.endswith(heading) and second.startswith(heading)


def test_greedy_split_falls_to_windows():
    text = "x " * 240
    assert [len(c) for c in greedy_split(text)] == [480, 30]
    assert greedy_split("") == []


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n。，；é", max_size=400), st.integers(5, 60), st.integers(0, 4))
def test_split_properties(text, size, overlap):
    for split in (recursive_split, greedy_split):
        for chunk in split(text, size, overlap):
            assert len(chunk) <= size and chunk in text


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=200), st.integers(1, 50), st.integers(0, 60))
def test_windows_cover(text, size, overlap):
    step = size - overlap if size > overlap else size
    cut = windows(text, size, overlap)
    assert all(w == text[i * step : i * step + size] for i, w in enumerate(cut))
    assert "".join(w[:step] for w in cut) == text


def test_fixed_windows_equal_plain(spark):
    texts = ["", None, "a", "x" * 450, "y" * 451, "中" * 1203, "z" * 950]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows = exploded_chunks(docs, "text", ChunkSettings(min_chunk_length=0), "fixed").collect()
    wanted = sorted((i, k, w) for i, t in enumerate(texts) for k, w in enumerate(windows(t or "")))
    assert sorted((r["doc_id"], r["chunk_index"], r["chunk"]) for r in rows) == wanted


def test_ids_are_dense_and_indices_keep_gaps(spark):
    meta = "struct<source:string,page:int,file_type:string,doc_name:string>"
    text = "first long enough line\n\nno\n\nanother line that is long"
    docs = spark.createDataFrame([(text, (f"d/{i}.txt", 1, "txt", f"{i}.txt")) for i in (2, 0, 1)], f"page_content string, metadata {meta}")
    rows = split_documents(docs, ChunkSettings(24, 0, 5)).orderBy("metadata.chunk_id").collect()
    assert [r["metadata"]["chunk_id"] for r in rows] == list(range(len(rows)))
    assert [(r["metadata"]["doc_name"], r["metadata"]["chunk_index"]) for r in rows][:2] == [("0.txt", 0), ("0.txt", 2)]
    assert with_dense_ids(spark.range(0).toDF("x"), ["x"]).count() == 0


def test_settings_and_statistics(spark):
    assert ChunkSettings.of({"chunk_size": 300, "other": 1}, chunk_overlap=7) == ChunkSettings(300, 7)
    chunks = spark.createDataFrame([("a",), ("a",), ("b",)], "source string")
    row = chunk_statistics(chunks, "source", 2, ChunkSettings()).first()
    assert (row["files_processed"], row["chunks_generated"], row["avg_chunks_per_file"]) == (2, 3, 1.5)
    assert chunk_statistics(chunks.limit(0), "source", 0, ChunkSettings()).first()["avg_chunks_per_file"] == 0


@pytest.mark.parametrize("greedy", [False, True])
def test_a_batch_is_split_a_few_texts_at_a_time(monkeypatch, greedy):
    import pyarrow as pa

    from lodestone.operators import chunks
    from lodestone.operators.splitting import greedy_split, recursive_split

    monkeypatch.setattr(chunks, "TOGETHER", 4000)
    texts = ["word " * (3 * i) for i in range(60)] + [None, "", "x" * 3000]
    batch = pa.RecordBatch.from_pydict({"k": list(range(len(texts))), "text": texts})
    out = list(chunks.split_batches(chunks.ChunkSettings(), greedy)(iter([batch])))
    assert len(out) > 5 and max(x.nbytes for x in out) < batch.nbytes / 2
    split = greedy_split if greedy else recursive_split
    want = [(k, i, c) for k, t in enumerate(texts) for i, c in enumerate(split(t) if t else [])]
    assert [(r["k"], r["chunk_index"], r["chunk"]) for x in out for r in x.to_pylist()] == want
