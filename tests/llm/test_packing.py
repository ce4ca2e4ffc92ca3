import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from hushframe.llm import packing as P

PATH = public_tokenizers.path("word_bpe_49k.json")


def texts():
    r = random.Random(3)
    alphabet = "abcdefgh ijkÉéßñ0123²½ .,'!<|>\n\t\x85\xa0\x1c\x00ªµ"
    out = ["".join(r.choice(alphabet) for _ in range(r.randrange(60))) for _ in range(300)]
    return out + ["", "it's I'LL we'd''s", "<|endoftext|> x", "é café", "İstanbul ΣΑΣ", "日本語 text", "ﬁ x", "😀 a", "AKIA'S 'S"]


def test_word_ids_equal_the_tokenizer():
    t = Tokenizer.from_file(PATH)
    coder = P.WordIds(open(PATH, encoding="utf-8").read())
    coder.MOST = 500
    for k in range(0, 309, 40):
        part = texts()[k : k + 40]
        assert coder.encode(part) == [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in part]


def valid(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in by.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_pack_round_trip(spark):
    r = random.Random(4)
    docs = [(i, " ".join(r.choice(["the", "cat", "runs", "é"]) for _ in range(r.choice([0, 3, 20, 90, 300]))), 5) for i in range(500)] + [(900, None, 1), (901, "", 1), (901, "", 1)]
    got = P.pack(P.token_pieces(spark.createDataFrame(docs, "doc_id long, text string, length int"), PATH, 100), 100).collect()
    t = Tokenizer.from_file(PATH)
    want = []
    for i, text, _ in docs:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        want += [(i, k, a, len(ids[a : a + 100]), zlib.crc32(np.array(ids[a : a + 100], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 100))]
    assert sorted(tuple(x)[:5] for x in got) == sorted(want)
    n = valid(got, 100)
    assert n <= P.best_fit(np.array([x.length for x in got]), 100).max() + 2


@pytest.mark.parametrize("sizes", [[60] * 700, [1] * 1000, []])
def test_ties_and_items_that_cannot_share(spark, monkeypatch, sizes):
    monkeypatch.setattr(P, "GROUP", 16)
    monkeypatch.setattr(P, "MOST_UNITS", 64)
    rows = spark.createDataFrame([(i, 0, 0, s, 0) for i, s in enumerate(sizes)], P._PIECE)
    got = P.pack(rows, 100).collect()
    assert len(got) == len(sizes)
    assert valid(got, 100) <= (700 if 60 in sizes else 1.2 * sum(sizes) / 100)


def test_words_of_one_hash_and_long_texts(monkeypatch):
    t = Tokenizer.from_file(PATH)
    want = lambda x: np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes()
    spec = open(PATH, encoding="utf-8").read()
    monkeypatch.setattr(P, "mix", lambda h: h & np.uint64(7))  # most words share a hash
    part = ["cat runs far", "dog sits here", "cat sits", "a" * 100 + " b " + "é" * 40]
    assert P.WordIds(spec).encode(part) == P.WordIds(spec).encode(part[::-1])[::-1] == [want(x) for x in part]
    monkeypatch.undo()
    long = " ".join(f"word{i % 5000} x" for i in range(60_000))
    assert len(long) > P.WordIds.BATCH and P.WordIds(spec).encode([long]) == [want(long)]
