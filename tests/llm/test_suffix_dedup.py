import random
from collections import Counter

import pytest

from hushframe.llm import suffix_dedup as S


def brute(rows, length):
    raws = [(t or "").encode() for _, t in rows]
    times = Counter(r[a : a + length] for r in raws for a in range(len(r) - length + 1))
    out = []
    for (i, _), r in zip(rows, raws, strict=True):
        gone = bytearray(len(r))
        for a in range(len(r) - length + 1):
            if times[r[a : a + length]] > 1:
                gone[a : a + length] = b"\1" * length
        spans = sum(1 for j in range(len(r)) if gone[j] and (not j or not gone[j - 1]))
        out.append((i, len(r), sum(gone), spans, bytes(c for c, g in zip(r, gone, strict=True) if not g)))
    return sorted(out)


def corpus(seed, length):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abéd ") for _ in range(6))
    make = lambda n: " ".join(word() for _ in range(n // 7 + 1))[:n]
    passages = [make(length - 20), make(length), make(length + 50), make(2 * length), "x" * (3 * length), "ab " * length]
    rows = []
    for i in range(60):
        text = make(r.randrange(0, 3 * length))
        for _ in range(r.randrange(3)):
            p = r.choice(passages)
            if r.random() < 0.4:
                p = p[r.randrange(40) :]
            if r.random() < 0.4:
                j = r.randrange(len(p))
                p = p[:j] + "#" + p[j + 1 :]
            at = r.randrange(len(text) + 1)
            text = text[:at] + p + text[at:]
        rows.append((i, text))
    return rows + [(100, None), (101, ""), (102, rows[3][1]), (103, rows[3][1]), (3, rows[3][1]), (3, make(2 * length))]


@pytest.mark.parametrize(("seed", "chunk", "length"), [(1, 1 << 19, 120), (2, 512, 120), (3, 1 << 19, 400)])
def test_equals_brute_force(spark, monkeypatch, seed, chunk, length):
    monkeypatch.setattr(S, "_CHUNK", chunk)
    rows = corpus(seed, length)
    got = S.remove_repeats(spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, lo int"), length).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in got) == brute(rows, length)
    assert all(r.text == bytes(r.kept).decode("utf-8", "ignore") for r in got)


def test_rows_without_a_doc_id(spark):
    r = random.Random(4)
    make = lambda n: "".join(r.choice("abéd ") for _ in range(n))
    passage = make(700)
    edited = passage[:350] + "#" + passage[351:]
    rows = [(None, make(90) + passage), (None, passage + make(40)), (None, edited), (7, edited + make(30)), (None, make(600)), (None, None), (0, make(50) + passage[200:])]
    got = S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 120).collect()
    none = lambda i: -1 if i is None else i
    assert sorted((none(r.doc_id), r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in got) == brute([(none(i), t) for i, t in rows], 120)
    assert sum(r.n_removed > 0 for r in got) == 5


def test_empty_table(spark):
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
