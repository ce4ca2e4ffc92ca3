import random

import numpy as np

from hushframe.llm import mixing as M


def corpus(n=400):
    r = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(r.choice("aeinst") for _ in range(4)) for _ in range(r.choice([10, 30, 100]))]
        kind = i % 10
        if kind == 0:
            words = [w.upper() + "!!" for w in words]
        if kind == 1:
            words[3] = words[7] = "badword"
        rows.append((i, " ".join(words), 3, "z"))
        if r.random() < 0.6:
            labels.append((i, int(kind != 0), int(kind == 1)))
    return rows, labels + [(0, None, None), (None, 1, 0)]


SCHEMA = "doc_id long, text string, rate int, p string"


def test_rates_meet_the_targets_and_equal_brute_force(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows + [(900, None, 1, ""), (901, "", 1, ""), (902, "word " * 200_000, 1, ""), (5, rows[5][1], 1, "")], SCHEMA)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out, said = M.mixed(docs, known, {"clean": 0.5, "low": 0.3, "toxic": 0.2})
    got = out.collect()
    assert len(got) == len(rows) + 4
    p = np.array([r.p for r in got])
    n = np.array([r.tokens for r in got], float)
    assert np.allclose(p.sum(axis=1), 1)
    reached = ((np.array([r.rate for r in got]) * n)[:, None] * p).sum(axis=0)
    assert np.abs(reached / n.sum() - [0.5, 0.3, 0.2]).max() < 1e-3
    rate = np.ones(len(n))
    for step in said["steps"]:
        rate = np.maximum(0, rate - p @ np.array(step))
    assert np.allclose(rate, [r.rate for r in got])
    kinds = {r.doc_id: int(np.argmax(r.p)) for r in got if r.doc_id < 400}
    assert sum(k == {0: 1, 1: 2}.get(i % 10, 0) for i, k in kinds.items()) > 0.9 * len(kinds)


def test_copies_and_empty(spark):
    rows, labels = corpus(100)
    docs = spark.createDataFrame(rows + [(None, "x y", 1, "")], SCHEMA)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = {r.doc_id: r.copies for r in M.mixed(docs, known)[0].collect()}
    out = M.repeat_by_rate(docs, known)
    assert out.columns == docs.columns
    got = {}
    for r in out.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {k: v for k, v in want.items() if v}
    none = spark.createDataFrame([], SCHEMA)
    assert M.mixed(none, known)[0].count() == 0
    assert M.mixed(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))[0].count() == 101


def test_targets_out_of_reach_end_near_the_best(spark):
    r = np.random.default_rng(4)
    p = r.dirichlet([2, 1, 1], 80)
    n = r.integers(1, 90, 80)
    rows = spark.createDataFrame([(i, i, int(n[i]), p[i].tolist()) for i in range(80)], "doc_id long, uid long, tokens long, p array<double>")
    for targets, thin in (({"clean": 1.0}, False), ({"clean": 0.98, "low": 0.01, "toxic": 0.01}, True), ({"clean": 0.2, "low": 0.7, "toxic": 0.1}, False)):
        out, said = M.fit_rates(rows, targets, thin)
        wanted = np.array(list(said["wanted"].values()))
        got = out.collect()
        reached = sum(x.rate * x.tokens * np.array(x.p) for x in got)
        assert np.allclose(reached, list(said["reached"].values())) and min(x.rate for x in got) >= 0
        rate, a = np.ones(80), p * n[:, None]  # plain projected gradient, very many steps
        for _ in range(40_000):
            rate = np.maximum(0, rate - a @ (rate @ a - wanted) / np.linalg.norm(a, 2) ** 2)
        best = np.linalg.norm(rate @ a - wanted)
        assert said["met"] == bool(np.abs(reached - wanted).max() <= M.TOLERANCE * (p * n[:, None]).sum())
        assert said["met"] or np.linalg.norm(reached - wanted) <= 1.25 * best + 0.01 * n.sum()
        assert best > 1e-3 * n.sum() or said["met"]
