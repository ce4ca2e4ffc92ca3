import random
import zlib

import numpy as np

from hushframe.llm import quality_knn as Q


def corpus(n=300):
    r = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(r.choice("aeéinst") for _ in range(r.randrange(2, 8))) for _ in range(r.choice([5, 40, 200]))]
        bad = i % 4 == 0
        text = " ".join(w.upper() + "!!" for w in words) if bad and i % 8 else " ".join([words[0]] * len(words)) if bad else " ".join(words)
        rows.append((i, text, i % 3, "x"))
        if i % 2 == 0 or i % 5 == 1:
            labels.append((i, 0 if bad else 1, 0))
    return rows, labels + [(0, None, 1), (None, 1, 1), (9999, 1, 0)]


def test_held_out_accuracy_and_edges(spark):
    rows, labels = corpus()
    long = "long text " * 300_000
    docs = spark.createDataFrame(rows + [(900, None, 1, "x"), (901, "", 1, "x"), (902, long, 1, "x"), (1, rows[1][1], 1, "x")], "doc_id long, text string, score int, label string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = Q.fit(docs, known)
    out = Q.scored(docs, model).collect()
    assert len(out) == len(rows) + 4
    score = {r.doc_id: r.score for r in out}
    assert score[900] == score[901] == model.prior and all(0 <= s <= 1 for s in score.values())
    held = [(i, q) for i, q, _ in labels if q is not None and i is not None and i < 900 and zlib.crc32(str(i).encode()) % 5 == 0]
    right = sum((score[i] >= Q.THRESHOLD) == bool(q) for i, q in held)
    assert len(held) > 20 and right / len(held) > 0.9
    kept = Q.keep_good(docs, known)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in out if r.score >= Q.THRESHOLD)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    known = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert Q.scored(docs, Q.fit(docs, known)).count() == 0
    one = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    assert Q.scored(one, Q.fit(one, known)).first().score == 0.5


def brute(model, texts, k):
    """The vote of all sample rows as near as the k-th, by plain loops over a text's shares."""
    out = []
    for text in texts:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        shares = Q.term_shares(raw, np.array([0, len(raw)]))[0]
        v = shares * model.idf / max(np.linalg.norm(shares * model.idf), 1e-12)
        v = v @ model.axes
        v /= max(np.linalg.norm(v), 1e-12)
        near = [round(float(v @ x), 5) for x in model.vectors]
        last = sorted(near)[-k]
        votes = [(max(c, 0) ** Q.POWER, y) for c, y in zip(near, model.labels, strict=True) if c >= last]
        total = sum(w for w, _ in votes)
        out.append(sum(w * y for w, y in votes) / total if total and shares.any() else model.prior)
    return out


def test_votes_equal_brute_force_and_axes_span_the_sample(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int, label string")
    model = Q.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r.score for r in Q.scored(docs, model).collect()}
    want = brute(model, [r[1] for r in rows[:60]], Q.NEIGHBOURS)
    assert np.allclose([got[i] for i in range(60)], want, atol=0.02)
    # the axes hold as much of the sample as the best ones of their number, nearly
    taken = [i for i, q, _ in labels if q is not None and i is not None and i < 300 and zlib.crc32(str(i).encode()) % 5]
    shares = np.array([Q.term_shares(np.frombuffer(rows[i][1].encode(), np.uint8), np.array([0, len(rows[i][1].encode())]))[0] for i in dict.fromkeys(taken)])
    weighted = model.weighted(shares)
    best = (np.linalg.svd(weighted, compute_uv=False)[: Q.RANK] ** 2).sum()
    assert (np.linalg.norm(weighted @ model.axes) ** 2) > 0.97 * best
