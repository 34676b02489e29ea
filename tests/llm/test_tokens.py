"""Token counts, token files and SentencePiece ids against the libraries."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

from lodestone.llm import piece_codec, token_counts, token_store
from lodestone.llm.pretokens import SPACE, split_pieces


@pytest.fixture(scope="module")
def pieces():
    return piece_codec.PieceEncoder(piece_codec.public_model())


def test_piece_ids_equal_the_library(pieces):
    rng = random.Random(3)
    pool, chars = list(pieces.pieces), " ▁\n\tabcdeth é☃中\x00'ſñ😀"
    for _ in range(4000):
        text = "".join(rng.choice(chars) if rng.random() < 0.5 else rng.choice(pool) for _ in range(rng.randrange(14)))
        assert np.frombuffer(pieces.ids(text), "<u4").tolist() == pieces.processor.encode(text, add_bos=True, add_eos=True), repr(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_piece_ids_of_any_text(text):
    e = piece_codec.encoder(piece_codec.public_model())
    text = text.encode("utf-8", "ignore").decode()
    assert np.frombuffer(e.ids(text), "<u4").tolist() == e.processor.encode(text, add_bos=True, add_eos=True)


def test_backtracking_takes_tokens_back(pieces):
    """Longest match first is wrong somewhere, so the search must have gone back there."""
    words = [w for w in ("unbelievably", "onoutheding", "thereinafter", "antidisestablishment", "xylophonist") if len(pieces.encode_part(SPACE + w)) > 1]
    assert words and all(pieces.encode_part(SPACE + w) == pieces.merged(SPACE + w) for w in words)


def test_encode_decode_rows(spark, mixed, odd):
    e = piece_codec.encoder(piece_codec.public_model())
    for docs in (mixed, odd):
        rows = piece_codec.encode_decode(docs).collect()
        wanted = sorted((r["doc_id"] or 0, len(i), e.processor.decode(i)) for r in docs.select("doc_id", "text").collect() for i in [e.processor.encode(r["text"] or "", add_bos=True, add_eos=True)])
        assert sorted((r["doc_id"] or 0, r["n_tokens"], r["decoded"]) for r in rows) == wanted
        assert all(len(r["ids"]) == 4 * r["n_tokens"] for r in rows)
    assert piece_codec.encode_decode(mixed.limit(0)).count() == 0


def test_token_counts_equal_the_unigram_library(mixed, odd):
    scores = token_counts.unigram_scores(token_counts.public_model())
    unigram = Tokenizer(models.Unigram([("<unk>", -1000.0), *scores.items()], 0, False))
    known = set("".join(scores))

    def count(text):
        total = 0
        for part in split_pieces(text or ""):
            whole = SPACE + part
            if set(whole) <= known:
                total += len(unigram.encode(whole).ids)
            else:
                best = [(0.0, 0)]
                for end in range(1, len(whole) + 1):
                    c = whole[end - 1]
                    options = [(best[i][0] + scores[whole[i:end]], best[i][1] + 1) for i in range(end) if whole[i:end] in scores]
                    options += [] if c in scores else [(best[end - 1][0] + min(scores.values()) - 10, best[end - 1][1] + len(c.encode()))]
                    best.append(max(options, key=lambda x: x[0]))
                total += best[-1][1]
        return total

    for docs in (mixed, odd):
        texts = {r["text"] for r in docs.collect()}
        wanted = {t: count(t) for t in texts}
        joined = token_counts.token_counts(docs.withColumn("doc_id", docs["text"])).collect()
        assert len(joined) == docs.count()
        assert all(r["n_tokens"] == wanted[r["doc_id"]] for r in joined)
    assert token_counts.token_counts(mixed.limit(0)).count() == 0


def test_trie_starts_anew_without_changing_counts():
    scores = token_counts.unigram_scores(token_counts.public_model())
    small, large = token_counts.CountTrie(scores, most=50), token_counts.CountTrie(scores)
    words = [f"word{i}ing{i * i}" for i in range(300)]
    assert [small.count(w) for w in words] == [large.count(w) for w in words]
    assert len(small.forward) < 100 < len(large.forward)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=1500))
def test_codes_round_trip(ids):
    n = len(ids) // 3
    segment = token_store.Segment(token_store.pack_segment(1, 2, [7, None], [n, len(ids) - n], np.array(ids, np.uint32)))
    segment.check()
    assert segment.all().tolist() == ids
    assert segment.document(0) + segment.document(1) == ids
    assert segment.nulls.tolist() == [0, 1]


def test_damage_is_seen():
    data = bytearray(token_store.pack_segment(0, 0, [1], [3], np.array([5, 70000, 9], np.uint32)))
    data[-9] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        list(token_store.segments(bytes(data) + b"\n"))


def test_word_encoder_equals_the_library(monkeypatch):
    t, e = Tokenizer.from_file(token_store.public_tokenizer()), token_store.WordEncoder(token_store.public_tokenizer())
    rng = random.Random(5)
    chars = " \n\t\x1c\x85'<|>ABcd éÉΣ1２é́̀中😀.,İıĿ"
    texts = ["".join(rng.choice(chars) for _ in range(rng.randrange(24))) + rng.choice(["", "<|endoftext|>", "<|ENDOFTEXT|>", "Σ ́", " ab.", f" {'x' * 300}!!"]) for _ in range(4000)]
    texts += ["".join(rng.choice("abAB.,;!? \n\té'sÀ1") for _ in range(rng.randrange(30))) for _ in range(4000)]
    monkeypatch.setattr(token_store, "WORD_BYTES", 1 << 18)  # so that words are forgotten and come again
    for at in range(0, len(texts), 500):
        ids, counts = e.encode(pa.array([*texts[at : at + 500], None]))
        wanted = [x.ids for x in t.encode_batch(texts[at : at + 500], add_special_tokens=False)]
        assert counts.tolist() == [*map(len, wanted), 0]
        assert ids.tolist() == [i for x in wanted for i in x]


@pytest.mark.parametrize("segment", [token_store.SEGMENT, 50])
def test_token_files(spark, mixed, monkeypatch, segment):
    monkeypatch.setattr(token_store, "SEGMENT", segment)
    t = Tokenizer.from_file(token_store.public_tokenizer())
    rows, path = token_store.token_files(mixed, parts=5)
    found = rows.orderBy("start").collect()
    wanted = {}
    for r in mixed.collect():
        ids = [*t.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        wanted.setdefault(r["doc_id"], []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert [r["doc_id"] or -1 for r in found] == sorted(r["doc_id"] or -1 for r in mixed.collect())
    at, seen = 0, {}
    for r in found:
        assert r["start"] == at
        at += r["n_tokens"]
        seen.setdefault(r["doc_id"], []).append((r["n_tokens"], r["ids_crc32"]))
    assert {k: sorted(v) for k, v in seen.items()} == {k: sorted(v) for k, v in wanted.items()}
    assert token_store.token_files(mixed.limit(0))[0].count() == 0
    # Single documents out of the files.
    texts = {r["doc_id"]: r["text"] for r in mixed.collect()}
    asked = spark.createDataFrame([(i,) for i in (9001, 9005, 9007, 1, 7, 123456)], "doc_id long")
    got = {r["doc_id"]: r["ids"] for r in token_store.read_tokens(spark, path, asked).collect()}
    assert got == {i: [*t.encode(texts[i] or "", add_special_tokens=False).ids, 1] for i in (9001, 9005, 9007, 1, 7)}
    assert token_store.read_tokens(spark, path, asked.limit(0), 0).count() == 0


def test_equal_rows_and_large_parts_are_dealt_out(spark, monkeypatch):
    """A third of all rows is one row, and files end after a bounded number of segments."""
    monkeypatch.setattr(token_store, "SEGMENT", 200)
    monkeypatch.setattr(token_store, "FILE_SEGMENTS", 3)
    docs = spark.range(3000).selectExpr("if(id % 3 = 0, null, id) as doc_id", "if(id % 3 = 0, null, 'some words here') as text", "id as start", "id as n_tokens")
    rows, path = token_store.token_files(docs, parts=6)
    found = sorted((r["start"], r["n_tokens"]) for r in rows.collect())
    assert len(found) == 3000 and all(a + n == b for (a, n), (b, _) in zip(found, found[1:], strict=False))
    held = token_store.read_token_files(spark, path).groupBy("file").agg(F.count_distinct("at").alias("n"), F.min("part").alias("part")).collect()
    assert max(r["n"] for r in held) <= 3 and len(held) > 6
    assert token_store.read_token_files(spark, path).filter("doc_id is null").select("part").distinct().count() >= 2


def test_memories_are_bounded_in_bytes():
    """Texts without spaces, as of Chinese, are one long part each and aren't kept."""
    from lodestone.llm.pretokens import ENTRY_BYTES, ManyMemo, Memo

    kept, many = Memo(len, 1 << 20), ManyMemo(lambda keys: list(map(len, keys)), 1 << 20)
    for i in range(100_000):
        assert kept[f"{i}字" * 2] and kept["中" * 3000 + str(i)]
    for i in range(0, 100_000, 1000):
        keys = {f"{j}字" * 2 for j in range(i, i + 1000)} | {"中" * 3000 + str(i)}
        found = many.of(keys)
        assert all(found[k] == len(k) for k in keys)
    for young, old in ((kept, kept.old), (many.young, many.old)):
        assert max(map(len, young)) < 300 and (len(young) + len(old)) * ENTRY_BYTES < (1 << 20) + 2000 * ENTRY_BYTES


def test_long_pretokens_count_as_in_the_trie():
    counter = token_counts.CountTrie(token_counts.unigram_scores(token_counts.public_model()))
    rng = random.Random(1)
    for n in (1, 9, 300, 1500):
        word = "".join(rng.choice("abcdefthing中文😀é") for _ in range(n))
        assert counter.insert(word) == counter.unshared(word) == counter.count(word)
