import random

import public_tokenizers
import sentencepiece

from hushframe.llm import token_counts as T

PATH = public_tokenizers.path("piece_bpe_32k.model")


def texts():
    r = random.Random(5)
    alphabet = "ab  ▁éß日本語😀\n\t<s>01 thein\x00　﻿"
    out = ["".join(r.choice(alphabet) for _ in range(r.randrange(40))) for _ in range(3000)]
    return out + ["", " ", "▁", "<unk><s></s><0x41>", " " * 5000, "a" * 5000, "日本" * 3000, "".join(map(chr, range(32, 0x3000)))]


def test_counts_equal_the_library():
    counter = T.Counter(open(PATH, "rb").read())
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    assert [counter.count(x) for x in texts()] == [len(x) for x in library.encode(texts())]


def test_words_remembered_are_bounded():
    counter = T.Counter(open(PATH, "rb").read())
    counter.MOST = 100
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    many = [" ".join(f"w{i * 7 + k}" for k in range(7)) for i in range(100)] * 2
    assert [counter.count(x) for x in many] == [len(x) for x in library.encode(many)]
    assert len(counter.known) <= 107 and len(counter.older) <= 107


def test_rows(spark):
    """Nulls, repeated rows, clashing columns, a very long text and an empty table."""
    rows = [(1, None, 5), (2, "", 5), (3, "the cat", 5), (3, "the cat", 5), (None, "é", 5), (4, "the cat " * 50_000, 5)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, n_tokens int")
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    n = lambda t: len(library.encode(t))
    got = T.over_limit(T.counted(docs, PATH)).collect()
    want = [(i, len((t or "").encode()), n(t or ""), n(t or "") > 4096) for i, t, _ in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert T.counted(docs.limit(0), PATH).count() == 0
