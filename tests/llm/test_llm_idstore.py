"""Shards and index against the tokenizers library and plain lookups."""

import random
import zlib

import numpy as np
import pytest

from scorelake.llm import idstore
from scorelake.llm.common import table, tokenizer
from scorelake.session import scratch_path

SCHEMA = "doc_id long, text string, key long, h long, row long"
PATH = tokenizer("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 5, 6, 7) for i, t in rows], SCHEMA)


def by_force(rows, library, end=2):
    """(doc_id, start, n, crc) in ascending order; ties of a key are compared as sets below."""
    out, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library(t), end]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


ODD = ["", None, "  \n ", "Ünïcödé ΣΑΣ σς İstanbul ẞ", "a<|endoftext|>b <|startoftext|> <|x|>", "it's I'LL we've 'd'", "tab\x1cgroup\x1d!\x1e?\x1f", "nbsp x y　z\x85w",
       "é e ́x", "日本語テキスト１２３", "</w> w</w>", "😀😃 emoji👍🏽", "x" * 3000, "1234567890" * 40, "\u0000\u0001 control", "ﬁ ǆ Ǆ", "</w", "Í" * 50 + "̇"]


def test_encoder_equals_library(library):
    spec = idstore.json.load(open(PATH, encoding="utf-8"))
    r = random.Random(3)
    texts = [t or "" for t in ODD] + [" ".join(r.choices([t or "" for t in ODD], k=6)) for _ in range(60)]
    texts += ["".join(chr(r.choice([r.randrange(1, 0x250), r.randrange(0x300, 0x600), r.randrange(0x1E00, 0x2100), r.randrange(0x1F300, 0x1F700)])) for _ in range(80)) for _ in range(300)]
    for stretch, held in ((4_000_000, 24_000_000), (50, 100)):
        encode = idstore.StretchEncoder(spec, "<u2", stretch, held)
        got = [np.frombuffer(b"".join(bits), "<u2").tolist() for bits in encode(texts)]
        for text, ids in zip(texts, got, strict=True):
            assert ids == library(text), text


def test_documents_equal_library(spark, library, sf_dir):
    docs = table(spark, sf_dir, "documents")
    store = idstore.write(docs, PATH, scratch_path(spark, "ids"), 2, shard_ids=20_000, bucket_keys=16)
    got = sorted(map(tuple, store.checks(docs).collect()))
    assert got == by_force([(r["doc_id"], r["text"]) for r in docs.collect()], library)
    assert len(store.manifest["shards"]) > 4 and store.manifest["dtype"] == "<u2"
    again = idstore.IdStore.open(store.folder)
    one = got[17]
    assert len(again.get(one[0])) == 1 and zlib.crc32(again.get(one[0])[0].astype("<u4").tobytes()) == one[3]
    assert again.get(10**12) == [] and again.get(None) == []
    some = docs.where("doc_id % 9 = 0").unionByName(spark.createDataFrame([(10**12, "no such key", "", "", 0)], docs.schema))
    read = {r["doc_id"]: (r["start"], r["ids"][:-1]) for r in again.documents(some).collect()}
    assert read == {r["doc_id"]: (dict((g[0], g[1]) for g in got)[r["doc_id"]], library(r["text"])) for r in docs.where("doc_id % 9 = 0").collect()}


def test_hot_and_odd_keys(spark, library):
    r = random.Random(8)
    words = ["some", "words", "of", "a", "text"]
    rows = [(i, " ".join(r.choices(words, k=r.randint(0, 9)))) for i in range(60)] + list(zip([-5, -6, 2**63 - 1, None, None] + [300 + i for i in range(len(ODD))], [*words, *ODD]))
    rows += [(7, f"copy {i}") for i in range(40)] + [(None, "the same")] * 10
    r.shuffle(rows)
    docs = frame(spark, rows)
    store = idstore.write(docs, PATH, scratch_path(spark, "ids"), 2, shard_docs=9)
    got, want = store.checks(docs).collect(), by_force(rows, library)
    assert len(got) == len(rows)
    assert sorted((str(g[0]), g[2], g[3]) for g in got) == sorted((str(w[0]), w[2], w[3]) for w in want)
    # Starts run through the files without a gap, in the order of keys.
    in_order = sorted(map(tuple, got), key=lambda g: g[1])
    assert [g[0] for g in in_order] == [w[0] for w in want]
    assert [g[1] for g in in_order] == [sum(x[2] for x in in_order[:i]) for i in range(len(rows))]
    unique = {w[0]: w for w in want if sum(1 for i, _ in rows if i == w[0]) == 1}
    assert {g[0]: tuple(g) for g in got if g[0] in unique} == unique
    assert sorted(len(x) for x in store.get(7)) == sorted(w[2] for w in want if w[0] == 7)
    assert len(store.get(None)) == 12


def test_empty_table(spark):
    store = idstore.write(frame(spark, []), PATH, scratch_path(spark, "ids"), 2)
    assert store.checks(frame(spark, [(1, "x")])).collect() == [] and store.get(1) == []


def test_long_document_is_read_in_pieces(spark, library, monkeypatch):
    text = "a few words more " * 40_000
    monkeypatch.setattr(idstore, "READ_BYTES", 1000)
    docs = frame(spark, [(1, text), (2, "short")])
    store = idstore.write(docs, PATH, scratch_path(spark, "ids"), 2)
    assert sorted(map(tuple, store.checks(docs).collect())) == by_force([(1, text), (2, "short")], library)


def test_perfect_hash_is_minimal():
    r = random.Random(5)
    for n in (0, 1, 2, 500, 20_000):
        keys = np.array([r.randrange(-(2**63), 2**63) for _ in range(n)], np.int64)
        perfect = idstore.PerfectHash.build(keys)
        assert sorted(perfect.slots(keys).tolist()) == list(range(n)) and perfect.n == n
        read, entries = idstore.PerfectHash.from_bytes(perfect.to_bytes(np.zeros(n, idstore._ENTRY)))
        assert read.slots(keys).tolist() == perfect.slots(keys).tolist() and len(entries) == n
        if n == 20_000:
            assert sum(64 * len(w) for w in perfect.levels) < 4 * n
    with pytest.raises(ValueError):
        idstore.PerfectHash.build(np.array([1, 1], np.int64))


def test_unknown_keys_are_told_by_fingerprints():
    keys = np.arange(5000, dtype=np.int64)
    perfect = idstore.PerfectHash.build(keys)
    prints = np.zeros(5000, np.uint32)
    prints[perfect.slots(keys)] = idstore.key_prints(keys)
    others = np.arange(10**6, 10**6 + 100_000, dtype=np.int64)
    slot = perfect.slots(others)
    assert ((slot >= 0) & (prints[np.maximum(slot, 0)] == idstore.key_prints(others))).sum() == 0


def test_each_character_is_looked_up_once_for_all_pieces(monkeypatch):
    import unicodedata
    asked = []
    category = unicodedata.category
    monkeypatch.setattr(unicodedata, "category", lambda c: asked.append(c) or category(c))
    pieces = {"é" * n for n in range(1, 50)} | {"plain", "<s>", "a\u0378b"}
    assert sorted(idstore.StretchEncoder._odd(pieces)) == ["<s>", "a\u0378b"]
    assert len(asked) == len(set(asked)) and idstore.StretchEncoder._odd({"é", "a"}) == []
