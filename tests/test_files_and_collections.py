"""Sources, sinks, settings, collections, jobs, streaming."""

import io
import json
import shutil
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lodestone.config import ConfigError, load_config, section, substitute
from lodestone.operators.chunks import ChunkSettings
from lodestone.operators.embedding import hashing_embedder
from lodestone.plans.ask import ask, ask_events, asked_lines, converse
from lodestone.plans.collection import Collection, CollectionExistsError
from lodestone.plans.ingest import build_collection, chunk_directory
from lodestone.sources.chunk_files import read_chunks, write_chunk_array, write_chunks
from lodestone.sources.documents import load_directory, load_document
from lodestone.streaming.ingest import ingest_stream


@pytest.fixture
def folder(tmp_path):
    docs = tmp_path / "docs"
    (docs / "sub").mkdir(parents=True)
    (docs / "doc1.txt").write_text("这是第一段。\r\n\r\n这是第二段，足够长的一段文字。", encoding="utf-8", newline="")
    (docs / "sub" / "B.MD").write_text("# 标题\n\n正文内容。" * 3, encoding="utf-8")
    (docs / "bad.txt").write_bytes(b"\xff\xfe\xfa")
    (docs / "doc.docx").write_text("no")
    (docs / "two.pdf").write_bytes(b"page one\fpage two\f  ")
    return docs


def pages(content):
    return content.decode().split("\f")


def test_directory(spark, folder):
    found, failed = load_directory(spark, str(folder), pages=pages)
    rows = {(r["metadata"]["doc_name"], r["metadata"]["page"]): r for r in found.collect()}
    assert set(rows) == {("doc1.txt", 1), ("B.MD", 1), ("two.pdf", 1), ("two.pdf", 2)}
    assert rows["doc1.txt", 1]["page_content"].startswith("这是第一段。\n\n这是")
    assert rows["B.MD", 1]["metadata"]["file_type"] == "md"
    assert [r["path"].rsplit("/", 1)[-1] for r in failed.collect()] == ["bad.txt"]
    assert load_directory(spark, str(folder), recursive=False, pages=pages)[0].filter("metadata.doc_name = 'B.MD'").count() == 0
    with pytest.raises(NotADirectoryError):
        load_directory(spark, str(folder / "doc1.txt"))


def test_documents(spark, folder):
    assert load_document(spark, str(folder / "doc1.txt")).count() == 1
    assert load_document(spark, str(folder / "two.pdf"), pages).count() == 2
    kept = load_document(spark, str(folder / "two.pdf"), pages, first_page=0, keep_blank=True)
    assert sorted(r["metadata"]["page"] for r in kept.collect()) == [0, 1, 2]
    with pytest.raises(FileNotFoundError):
        load_document(spark, str(folder / "none.txt"))
    with pytest.raises(ValueError, match="unsupported"):
        load_document(spark, str(folder / "doc.docx"))
    with pytest.raises(RuntimeError):
        load_document(spark, str(folder / "two.pdf"))
    with pytest.raises(PySparkException):
        load_document(spark, str(folder / "bad.txt")).collect()


def test_chunk_files(spark, folder, tmp_path):
    chunks, failed, stats = chunk_directory(spark, str(folder), ChunkSettings(50, 10, 5), pages=pages)
    target = tmp_path / "out" / "chunks.json"
    write_chunk_array(chunks, str(target))
    stored = json.loads(target.read_text(encoding="utf-8"))
    assert [c["metadata"]["chunk_id"] for c in stored] == list(range(len(stored)))
    back = read_chunks(spark, str(target)).orderBy("metadata.chunk_id").collect()
    assert [r["text"] for r in back] == [c["text"] for c in stored]
    write_chunks(chunks, str(tmp_path / "lines"))
    assert read_chunks(spark, str(tmp_path / "lines")).count() == len(stored)
    row = stats.first()
    assert row["files_processed"] == 3 and row["chunks_generated"] == len(stored)
    (tmp_path / "object.json").write_text("{}")
    with pytest.raises(ValueError, match="list"):
        read_chunks(spark, str(tmp_path / "object.json"))
    with pytest.raises(FileNotFoundError):
        read_chunks(spark, str(tmp_path / "nothing.json"))


def test_settings(tmp_path):
    env = {"A": "1", "EMPTY": ""}
    assert substitute({"x": ["${A}", "${B:-d}", "${EMPTY:-e}", "${NONE}", 5]}, env) == {"x": ["1", "d", "e", "${NONE}", 5]}
    path = tmp_path / "c.yml"
    path.write_text("store:\n  port: ${NO_SUCH_PORT:-19530}\n")
    assert section(load_config(path), "store") == {"port": "19530"}
    for text in ("", "a: [", "x: 1"):
        path.write_text(text)
        with pytest.raises(ConfigError):
            section(load_config(path), "store")
    with pytest.raises(ConfigError):
        load_config(tmp_path / "missing.yml")


TEXTS = ["heart attack chest pain", "diabetes blood sugar", "pneumonia cough fever"]


def rows_of(spark, texts, embed):
    return spark.createDataFrame([(t, ("s", i), [float(x) for x in embed([t])[0]]) for i, t in enumerate(texts)], "text string, metadata struct<source:string,page:int>, vector array<float>")


def test_collection(spark, tmp_path):
    embed = hashing_embedder(16)
    c = Collection(spark, str(tmp_path / "c"), 16)
    assert not c.exists() and c.count() == -1
    c.drop()
    c.create()
    with pytest.raises(CollectionExistsError, match="已存在"):
        c.create()
    assert c.count() == 0
    assert sorted(r["id"] for r in c.insert(rows_of(spark, TEXTS, embed)).collect()) == [1, 2, 3]
    c.build_terms()
    asked = spark.createDataFrame([(0, TEXTS[1], [float(x) for x in embed([TEXTS[1]])[0]]), (1, "症状", [0.0] * 16)], "qid int, question string, vector array<float>")
    assert c.search(asked.filter("qid = 0"), 3).count() == 3
    best = c.search(asked.filter("qid = 0"), 1).first()
    assert best["text"] == TEXTS[1] and best["score"] == pytest.approx(1)
    assert [r["text"] for r in c.keyword_search(asked).collect()] == [TEXTS[1]]
    assert c.hybrid_search(asked.filter("qid = 0"), 2).filter("rank = 1").first()["text"] == TEXTS[1]
    assert c.search(asked.filter("qid = 0"), 3, threshold=0.99).count() == 1
    assert c.search(asked.filter("qid = 0"), 3, expr='metadata["page"] == 2').first()["text"] == TEXTS[2]
    c.insert(rows_of(spark, ["one more"], embed))
    c.build_terms()
    assert c.count() == 4 and c.sparse_vectors().count() == 4
    with pytest.raises(PySparkException):
        c.insert(spark.createDataFrame([("t", ("s", 1), [1.0])], "text string, metadata struct<source:string,page:int>, vector array<float>"))
    c.drop()
    assert not c.exists()


def test_statistics_of_appended_batches(spark, tmp_path):
    """Without weighing all rows again, searches after appends are those of a collection filled at once."""
    embed = hashing_embedder(16)
    asked = spark.createDataFrame([(0, "blood pain fever"), (1, "sugar cough sugar"), (2, "nothing known")], "qid int, question string")
    more = ["blood in the cough", "", "pain pain pain", "sugar"]
    whole, grown = Collection(spark, str(tmp_path / "whole"), 16), Collection(spark, str(tmp_path / "grown"), 16)
    for c in (whole, grown):
        c.create()
    assert grown.version() == 0
    whole.insert(rows_of(spark, [*TEXTS, *more], embed))
    whole.build_terms()
    for texts in (TEXTS, more[:1], more[1:]):
        grown.insert(rows_of(spark, texts, embed))
    hits = [{(r["qid"], r["text"], r["score"]) for r in c.keyword_search(asked, 10).collect()} for c in (whole, grown)]
    assert hits[0] == hits[1] and len(hits[0]) > 5
    assert not (tmp_path / "grown" / "weights").exists()
    grown.build_terms()
    assert {(r["qid"], r["text"], r["score"]) for r in grown.keyword_search(asked, 10).collect()} == hits[0]
    vectors = [{(r["text"], tuple(sorted(r["sparse_vector"].items()))) for r in c.rows().join(c.sparse_vectors(), "id").collect()} for c in (whole, grown)]
    assert vectors[0] == vectors[1]


def test_commits(spark, tmp_path):
    """Writers at once share no id, a lost write leaves nothing, a pinned reader sees no later row."""
    embed = hashing_embedder(16)
    c = Collection(spark, str(tmp_path / "c"), 16)
    c.create()
    c.insert(rows_of(spark, TEXTS, embed))
    then = c.at(c.version())
    with ThreadPoolExecutor(4) as pool:
        written = list(pool.map(lambda i: [r["id"] for r in Collection(spark, c.path, 16).insert(rows_of(spark, [f"text {i} {j}" for j in range(i + 1)], embed)).collect()], range(4)))
    ids = sorted(x for part in written for x in part)
    assert ids == list(range(4, 14)) and sorted(r["id"] for r in c.rows().collect()) == list(range(1, 14))
    assert c.version() == 5 and c.count() == 13
    assert then.count() == 3 and then.rows().count() == 3 and {r["text"] for r in then.rows().collect()} == set(TEXTS)
    assert then.keyword_search(spark.createDataFrame([(0, "text cough")], "qid int, question string"), 9).count() == 1
    with pytest.raises(ValueError, match="version"):
        then.insert(rows_of(spark, ["x"], embed))
    with pytest.raises(PySparkException):
        c.insert(rows_of(spark, ["x" * 70_000], embed))
    assert len(list((tmp_path / "c" / "rows").glob("batch=*"))) == 5
    # A writer that was lost before its commit: its files are there, and no one sees them.
    shutil.copytree(next((tmp_path / "c" / "rows").glob("batch=*")), tmp_path / "c" / "rows" / "batch=lost")
    assert c.rows().count() == 13
    assert c.insert(rows_of(spark, ["once"], embed), source="a").count() == 1
    assert c.insert(rows_of(spark, ["once"], embed), source="a").count() == 0 and c.count() == 14
    assert c.log.commit("late", 1, 1, source="a") is None and c.version() == 6


def test_build_and_stream(spark, tmp_path):
    meta = "struct<source:string,page:int,file_type:string,doc_name:string,chunk_id:bigint,chunk_index:int>"
    chunks = spark.createDataFrame([(t, ("s", 1, "txt", "d", i, i)) for i, t in enumerate(TEXTS)], f"text string, metadata {meta}")
    c = Collection(spark, str(tmp_path / "c"), 8)
    assert build_collection(chunks.limit(0), c) == {"rows": 0}
    assert build_collection(chunks, c)["rows"] == 3
    assert build_collection(chunks, c)["rows"] == 6
    assert build_collection(chunks, c, rebuild=True)["rows"] == 3
    live = Collection(spark, str(tmp_path / "live"), 8)
    chunks.write.json(str(tmp_path / "in"))
    ingest_stream(spark, str(tmp_path / "in"), live, hashing_embedder(8), str(tmp_path / "at")).awaitTermination()
    chunks.filter(F.col("metadata.chunk_id") == 0).write.mode("append").json(str(tmp_path / "in"))
    ingest_stream(spark, str(tmp_path / "in"), live, hashing_embedder(8), str(tmp_path / "at")).awaitTermination()
    assert live.count() == 4


def test_questions(spark, tmp_path):
    embed = hashing_embedder(32)
    c = Collection(spark, str(tmp_path / "c"), 32)
    c.create()
    c.insert(rows_of(spark, TEXTS, embed))
    c.build_terms()
    asked = spark.createDataFrame([(0, "blood sugar"), (1, "chest pain")], "qid int, question string")
    for hybrid in (False, True):
        rows = {r["qid"]: r for r in ask(c, asked, embed, k=1, hybrid=hybrid).collect()}
        assert rows[0]["answer"] == TEXTS[1] and rows[1]["sources"][0]["text"] == TEXTS[0]
    nothing = ask(c, asked, embed, threshold=2.0).first()
    assert "证据" in nothing["answer"] and nothing["sources"] == []
    assert ask_events(c, asked, embed, k=1).filter("event = 'done'").count() == 2
    assert list(asked_lines(["", " a ", "QUIT", "b"])) == ["a"]
    out = io.StringIO()
    converse(c, embed, ["blood sugar\n", "exit\n"], out, k=1)
    assert out.getvalue().startswith(TEXTS[1]) and "[1] s p.1" in out.getvalue()


def test_hidden_names_are_read(spark, tmp_path):
    (tmp_path / "_part").mkdir()
    for name in ("plain.txt", "_name.md", ".name.txt", ".txt", "_part/deep one.TXT", "_part/_x.csv", "_a=b.md"):
        (tmp_path / name).write_text(f"text of {name}", encoding="utf-8")
    found, failed = load_directory(spark, str(tmp_path))
    rows = sorted((r["metadata"]["doc_name"], r["page_content"]) for r in found.collect())
    names = {".name.txt": ".name.txt", "_a=b.md": "_a=b.md", "_name.md": "_name.md", "deep one.TXT": "_part/deep one.TXT", "plain.txt": "plain.txt"}
    assert rows == sorted((k, f"text of {v}") for k, v in names.items()) and failed.count() == 0
    flat = load_directory(spark, str(tmp_path), recursive=False)[0]
    assert {r["metadata"]["doc_name"] for r in flat.collect()} == {".name.txt", "_a=b.md", "_name.md", "plain.txt"}
    assert [r["page_content"] for r in load_document(spark, str(tmp_path / "_name.md")).collect()] == ["text of _name.md"]
    with pytest.raises(ValueError):
        load_document(spark, str(tmp_path / ".txt"))


def test_sparse_vectors_come_from_the_blocks_that_cover_all_rows(spark, tmp_path):
    c = Collection(spark, str(tmp_path / "c"), 2)
    c.create()
    rows = spark.createDataFrame([("heart pain pain", {"n": "1"}, [1.0, 0.0]), ("heart", {"n": "2"}, [0.0, 1.0]), ("", {"n": "3"}, [0.0, 0.0])], "text string, metadata map<string,string>, vector array<float>")
    rows = rows.withColumn("metadata", F.struct(F.col("metadata")["n"].alias("n")))
    c.insert(rows)
    before = sorted((r["id"], sorted(r["sparse_vector"].items())) for r in c.sparse_vectors().collect())
    c.build_terms()
    read = c.sparse_vectors().inputFiles()
    assert any("/blocks/" in x for x in read) and not any("/counts/" in x for x in read)
    assert sorted((r["id"], sorted(r["sparse_vector"].items())) for r in c.sparse_vectors().collect()) == before and before
    c.insert(rows)
    assert any("/counts/" in x for x in c.sparse_vectors().inputFiles()) and c.sparse_vectors().count() == 6
