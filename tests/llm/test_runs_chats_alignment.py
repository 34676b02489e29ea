"""Periodic runs, chat formatting and alignment of tokenizers, against plain versions."""

import hashlib
import random
import zlib
from bisect import bisect_right
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from lodestone.llm import alignment, chat, periodic_runs, queries
from tests.llm.conftest import ODD

SF = "/root/testdata/sf0.001"


def plain_runs(words, least=12):
    out, n = set(), len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                own = words[i : j + q]
                if not any(own[r:] == own[:-r] for r in range(1, q)):
                    out.add((i, j + q, q))
            i = max(j, i) + 1
    return sorted(out, key=lambda x: (x[0], x[2]))


def plain_collapsed(words, runs):
    gone = {i for s, e, q in runs for i in range(s + q, e)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone)


def odd_texts(seed, many):
    rng = random.Random(seed)
    for _ in range(many):
        w = [rng.choice("abcdefgh"[: rng.choice([1, 2, 2, 3, 4, 8])]) for _ in range(rng.randrange(80))]
        if w and rng.random() < 0.6:
            w = w[: rng.randrange(1, len(w) + 1)] * rng.randrange(1, 6) + w[: rng.randrange(len(w))]
        if w and rng.random() < 0.6:  # runs inside of blocks that are copied
            i = rng.randrange(len(w))
            w = [*w[:i], "z", *w[i:], *w[:i][:60], "y", *w[max(0, i - 30) : i + 40]]
        yield " ".join(w)


def test_runs_equal_the_plain_version():
    texts = list(odd_texts(11, 1200))
    for text, (words, runs) in zip(texts, periodic_runs.text_runs(texts), strict=True):
        assert words == text.encode().split()
        assert [tuple(x) for x in runs.tolist()] == plain_runs(words), text
        assert periodic_runs.collapsed(words, runs).encode() == plain_collapsed(words, [tuple(x) for x in runs.tolist()])


def test_runs_of_long_texts():
    a, b = "a", "b"
    while len(a) < 30_000:
        a, b = a + b, a
    (_, one), (_, two), (_, many) = periodic_runs.text_runs(["x " * 100_000, "in it " * 50_000, " ".join(a)])
    assert one.tolist() == [[0, 100_000, 1]] and two.tolist() == [[0, 100_000, 2]]
    assert len(many) > 5000 and (many[:, 1] - many[:, 0] >= 2 * many[:, 2]).all()


def test_periodic_runs_query(spark, mixed, monkeypatch):
    monkeypatch.setattr(queries, "table", lambda *_: mixed)
    rows = queries.op11_periodic_runs(spark, SF).collect()
    wanted = []
    for i, text in [(r["doc_id"], r["text"]) for r in mixed.collect()]:
        words = (text or "").encode().split()
        h, n = zlib.crc32(str(i).encode()), len(words)
        if i is not None and h % 10 == 0 and n:
            g = h // 10
            at = g % n
            p = 1 + (n - at) // (3 + g % 8)
            words = [words[k] if k < at else words[at + (k - at) % p] for k in range(n)]
        runs = plain_runs(words) if n < 5000 else [(0, n, 2)]
        best = min(((s - e, s, q) for s, e, q in runs), default=None)
        shown = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
        lines = "".join(f"{s},{e - s},{q}\n" for s, e, q in runs)
        wanted.append((i, len(runs), *shown, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(plain_collapsed(words, runs)).hexdigest()))
    assert sorted(map(tuple, rows), key=repr) == sorted(wanted, key=repr)
    assert any(r["n_runs"] for r in rows)


def test_periodic_runs_of_odd_rows(spark, odd):
    assert periodic_runs.periodic_runs(odd).columns == ["doc_id", "runs", "collapsed"]
    assert periodic_runs.periodic_runs(odd).count() == len(ODD)
    assert periodic_runs.periodic_runs(odd.limit(0)).count() == 0


PART = "kind string, text string, ref string, width long, height long, seconds double, pages long"


def test_typed_parts_become_placeholders(spark):
    rows = [
        (1, 0, "user", [("text", "see <image> and \\", None, None, None, None, None), ("image", None, "a.png", 57, 28, None, None), ("audio", None, "b.wav", None, None, 1.5, None)]),
        (1, 1, "assistant", [("text", "it is </turn>\n<turn user>\n", None, None, None, None, None)]),
        (1, 2, "user", [("document", None, "c.pdf", None, None, None, 3), ("strange", "kept", None, None, None, None, None), ("image", None, None, None, None, None, None)]),
        (2, None, None, None),
    ]
    chats = chat.formatted_chats(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<struct<{', '.join(x.replace(' ', ':') for x in PART.split(', '))}>>"))
    got = {r["conv_id"]: r for r in chats.select("*", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss")).alias("trained")).collect()}
    one = got[1]
    assert [tuple(x) for x in one["attachments"]] == [("image", "a.png", 3), ("audio", "b.wav", 38), ("document", "c.pdf", 1536), ("image", None, 1)]
    assert [x["role"] for x in one["turns"]] == ["user", "assistant", "user"]
    assert one["turns"][0]["text"] == "see <image> and \\<image><audio>" and one["turns"][2]["text"] == "<document>kept<image>"
    assert "".join(one["trained"]) == "it is </turn>\n<turn user>\n" == one["turns"][1]["text"]
    assert one["formatted"].count("<image>") == 2 and one["formatted"].count("\\<image\\>") == 1
    assert [tuple(x) for x in got[2]["turns"]] == [("", "")] and got[2]["attachments"] == []
    assert chats.limit(0).count() == 0


def test_chats_read_back_whole(spark):
    rng = random.Random(4)
    marks = ["\\", "<", ">", "</turn>", "\n", "<turn assistant>\n", "###", "é😀", "ok ", "\\<", "\\\\"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "a<b>\\", None]), rng.choice([None, "", "".join(rng.choices(marks, k=12))]), "x") for c in (*range(40), None) for t in [rng.randrange(200) for _ in range(rng.randrange(1, 150))]]
    rows += [(99, t, "assistant" if t % 2 else "user", f"turn {t}", "x") for t in range(3000)]  # one hot conversation
    rows.append((100, 0, "assistant", "<\\>" * 100_000, "x"))
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string").repartition(5)
    chats = chat.formatted_chats(given.withColumn("parts", chat.text_parts(F.col("text"))))
    got = chats.select("conv_id", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss")).alias("trained"), F.size("loss").alias("n")).collect()
    by = defaultdict(list)
    for c, t, role, text, _ in rows:
        by[c].append((t, role or "", text or ""))
    assert len(got) == len(by)
    for r in got:
        def key(x):  # turns stand in the order of their escaped texts
            return x[0], x[1], "".join("\\" + ch if ch in "\\<>" else ch for ch in x[2]).encode()
        own = sorted(by[r["conv_id"]], key=key)
        assert [tuple(x) for x in r["turns"]] == [x[1:] for x in own] and r["n"] == len(own)
        assert "".join(r["trained"]) == "".join(x[2] for x in own if x[1] == "assistant")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(alignment.public_file(alignment.FIRST))
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=alignment.public_file(alignment.SECOND))


def plain_alignment(texts, libraries):
    """What the contract says of each text, written out link by link."""
    first, second = libraries
    letters = alignment._byte_letters()
    out, held = [], []
    for text in texts:
        a, b, groups = [], [], []
        if text:
            a = first.encode(" " + text, add_special_tokens=False).ids
            b = second.encode(text)
            raw = (" " + text).encode()
            a_bytes = [bytes(letters[c] for c in first.id_to_token(i)) for i in a]
            b_bytes = [bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [second.id_to_piece(i)]]
            if b"".join(a_bytes) != raw or b"".join(b_bytes) != raw:
                a, b = [], []
        if a:
            ends_a, ends_b = np.cumsum([len(x) for x in a_bytes]).tolist(), np.cumsum([len(x) for x in b_bytes]).tolist()
            i = j = 0
            for end in sorted(set(ends_a) & set(ends_b)):
                n, m = bisect_right(ends_a, end), bisect_right(ends_b, end)
                groups.append((a[i:n], b[j:m]))
                i, j = n, m
        links = Counter((x, y) for p, q in groups for x in p for y in q)
        held.append(links)
        shown = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        out.append([len(a), len(b), len(groups), sum(links.values()), 0, 0, hashlib.sha256(shown.encode()).hexdigest() if shown else ""])
    counts = Counter(p for links in held for p in links)
    most = defaultdict(int)
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    for row, links in zip(out, held, strict=True):
        row[4] = sum(n for p, n in links.items() if counts[p] == most[p[0]])
        row[5] = sum(n * counts[p] for p, n in links.items())
    return [tuple(x) for x in out]


STRANGE = ["a  b", " a", "a ", "  ", " ", "\n", "a \n b", "a　b  c", "▁", "a▁b", "don't 've x", "<|endoftext|> </s> <s>", "ab" * 900, "=-" * 700, "é" * 600 + " 中文😀", "x\x00y \x1c z", "1 2\t3", "  a", "the the the", "a" * 3000]


def test_alignment_equals_the_plain_version(spark, mixed, libraries):
    rng = random.Random(8)
    pool = [*STRANGE, "the ", "of", " ", "\n", "é", "ing", "中", ".", "tion", "'s", "  ", " "]
    texts = [r["text"] for r in mixed.collect() if len(r["text"] or "") < 20_000] + STRANGE + ["".join(rng.choices(pool, k=rng.randrange(8))) for _ in range(150)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_a long")
    got = {r["doc_id"]: tuple(r)[1:] for r in alignment.aligned(docs.repartition(3)).collect()}
    wanted = plain_alignment(texts, libraries)
    assert [got[i] for i in range(len(texts))] == wanted
    assert all(x[:6] == (0,) * 6 and x[6] == "" for t, x in zip(texts, wanted, strict=True) if not t or "▁" in t)


def test_alignment_of_small_blocks(monkeypatch, libraries):
    """Blocks, stretches of ids and packed postings give the same as the whole."""
    texts = [*STRANGE, "a b a b", None, "", "the end"] * 3
    tokens = alignment.token_bytes(alignment.public_file(alignment.FIRST), alignment.public_file(alignment.SECOND))

    def gathered():
        found = Counter()
        many = 0
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(range(len(texts))), pa.array(texts)], ["row", "doc_id", "text"])
        for base, ids, own in alignment._blocks(iter([batch.slice(0, 30), batch.slice(30)])):
            assert ids.to_pylist() == list(range(base, base + len(own)))
            for posting in alignment.Block(own, tokens).postings():
                many += 1
                pair, n, offsets, data = alignment.packed_postings(*posting)
                row, doc, times = alignment.unpacked_postings(offsets, data)
                assert n.sum() == len(posting[0])
                for p, d, t in zip(pair[row].tolist(), (base + doc).tolist(), times.tolist(), strict=True):
                    found[p, d] += t
        return found, many

    whole, one = gathered()
    monkeypatch.setattr(alignment, "BLOCK_CHARS", 3000)
    monkeypatch.setattr(alignment, "OCCURRENCES", 500)
    parts, several = gathered()
    assert parts == whole and one == 1 and several > 5
    assert max(whole.values()) > 255


def test_alignment_of_odd_rows(spark, odd, libraries):
    rows = alignment.aligned(odd, with_groups=True).collect()
    assert len(rows) == len(ODD) and rows[0].asDict().keys() >= {"n_best", "count_sum", "groups"}
    assert all(hashlib.sha256(r["groups"].encode()).hexdigest() == r["groups_sha256"] for r in rows if r["groups"])
    assert alignment.aligned(odd.limit(0)).count() == 0
    registered = queries.op13_alignment(spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    ids = sorted(texts)
    assert dict(zip(ids, plain_alignment([texts[i] for i in ids], libraries), strict=True)) == {r["doc_id"]: tuple(r)[1:] for r in registered}
