import math

import numpy as np
import pytest

from hushframe.llm import ann_tree, exact_topk, vectors

SCHEMA = "vec_id long, embedding array<float>, query_id string, score string"


def table(spark, seed, n=400, same=False):
    r = np.random.default_rng(seed)
    v = r.normal(size=(n, 8)) * (1 if same else r.lognormal(size=(n, 1)))
    v[n // 2 : n // 2 + 80] = v[3]
    v[7] = v[8] = 0
    rows = [(i, x.astype(np.float32).tolist(), "q", "s") for i, x in enumerate(v)]
    odd = [(n, None, "", ""), (n + 50, [None] * 8, "", ""), (n + 100, [float("nan")] * 8, "", ""), (n + 101, [float("inf")] + [0.0] * 7, "", ""), (n + 102, [1.0, 2.0], "", ""), (n + 103, [], "", "")]
    return rows, spark.createDataFrame(rows + odd, SCHEMA)


@pytest.mark.parametrize("cosine", [0.0, 0.8, 2.0])
def test_exact_top_k(spark, monkeypatch, cosine):
    monkeypatch.setattr(exact_topk, "COSINE", cosine)
    monkeypatch.setattr(exact_topk, "SEED", 50)
    rows, df = table(spark, 1)
    v = np.floor(256 * np.array([np.array(x[1], np.float32).astype(float) for x in rows] + [[1.0, 2.0] + [0.0] * 6])).astype(int)
    ids = [*range(len(rows)), len(rows) + 102]  # the short vector is a candidate too
    want = []
    for q in range(0, len(rows), 50):
        s = dict(zip(ids, (v @ v[q]).tolist(), strict=True))
        want += [(q, k + 1, i, s[i]) for k, i in enumerate(sorted((i for i in ids if i != q), key=lambda i: (-s[i], i))[:5])]
    assert sorted(map(tuple, exact_topk.integer_top_k(df).collect())) == want


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], "", ""), (1, [0.5, 0.5], "", ""), (50, [-1.0, 0.0], "", "")], SCHEMA)
    assert sorted(map(tuple, exact_topk.integer_top_k(df).collect())) == [(0, 1, 1, 256 * 128), (0, 2, 50, -(256**2)), (50, 1, 1, -256 * 128), (50, 2, 0, -(256**2))]
    got, _ = ann_tree.cosine_neighbours(df)
    assert [(r.query_id, r.rank, r.vec_id) for r in got.orderBy("query_id", "rank").collect()] == [(0, 1, 1), (0, 2, 50), (50, 1, 1), (50, 2, 0)]
    empty = spark.createDataFrame([], SCHEMA)
    assert exact_topk.integer_top_k(empty).count() == 0
    assert ann_tree.cosine_neighbours(empty)[0].count() == 0


def test_recall_and_scores(spark):
    rows, df = table(spark, 2, 1500, True)
    v = np.array([np.array(x[1], np.float32).astype(float) for x in rows])
    v = np.vstack([v, np.zeros((103, 8))])
    v[len(rows) + 102] = [1.0, 2.0] + [0.0] * 6
    live = [i for i in range(len(v)) if v[i].any()]
    got, said = ann_tree.cosine_neighbours(df)
    found = {}
    for r in got.collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = total = 0
    assert said["visits"] < said["leaves"]
    for q in (i for i in live if i % 50 == 0):
        cos = {i: float((v[i] * v[q]).sum() / (np.sqrt((v[q] ** 2).sum()) * np.sqrt((v[i] ** 2).sum()))) for i in live if i != q}
        want = sorted(cos, key=lambda i: (-round(cos[i], 12), i))[:5]
        mine = sorted(found[q])
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5] and all(abs(cos[i] - s) < 1e-12 for _, i, s in mine)
        hits += len({m[1] for m in mine} & set(want))
        total += 5
    assert hits >= 0.9 * total


def test_outlying_query_still_gets_k(spark):
    r = np.random.default_rng(5)
    centres = r.normal(size=(25, 8)) * [1, 1, 1, 1, 1, 1, 1, 0]
    v = np.repeat(centres, 40, axis=0) + r.normal(size=(1000, 8)) * 1e-4
    v[0] = [0, 0, 0, 0, 0, 0, 0, 9]  # alone
    rows = [(i, x.astype(np.float32).tolist(), "q", "s") for i, x in enumerate(v)] + [(0, [0.0] * 7 + [8.0], "q", "s")] * 6
    got, said = ann_tree.cosine_neighbours(spark.createDataFrame(rows, SCHEMA), recall=0.1)
    found = {}
    for x in got.collect():
        found.setdefault(x.query_id, []).append(x.vec_id)
    assert said["visits"] == 1
    assert {q: len(x) for q, x in found.items()} == {q: 5 for q in range(0, 1000, 50)}


def test_products_beyond_exact_doubles(spark):
    big = 2.0**44
    rows = [(0, [big, 1.0], "", ""), (1, [big, 0.0], "", ""), (2, [big, 1.0], "", ""), (3, [big, 2.0], "", "")]
    got = [r for r in sorted(map(tuple, exact_topk.integer_top_k(spark.createDataFrame(rows, SCHEMA.replace("float", "double"))).collect())) if r[0] == 0]
    assert got == [(0, i + 1, x, 2**63 - 1) for i, x in enumerate((1, 2, 3))]
    exact = [(0, [2.0**22, 1.0], "", ""), (1, [2.0**22, 0.0], "", ""), (2, [2.0**22, 2.0**-8], "", ""), (3, [2.0**22 - 2.0**-8, 1.0], "", "")]
    v = {i: [math.floor(256 * x) for x in row] for i, row, *_ in exact}
    score = {i: sum(a * b for a, b in zip(v[0], v[i], strict=True)) for i in (1, 2, 3)}
    want = [(0, n + 1, i, score[i]) for n, i in enumerate(sorted(score, key=lambda i: (-score[i], i)))]
    assert sorted(map(tuple, exact_topk.integer_top_k(spark.createDataFrame(exact, SCHEMA.replace("float", "double"))).collect())) == want


def test_repeated_ids_and_several_cells(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CELL_LEAST", 64)
    rows, df = table(spark, 3, 600)
    wide = exact_topk.integer_top_k(df)
    monkeypatch.undo()
    assert sorted(map(tuple, wide.collect())) == sorted(map(tuple, exact_topk.integer_top_k(df).collect()))
    twice = df.union(df)
    monkeypatch.setattr(vectors, "CELL_LEAST", 64)
    got, said = ann_tree.cosine_neighbours(twice)
    assert said["measured"] >= 0.85 and got.groupBy("query_id").count().filter("count <> 5").count() == 0
    assert {r.query_id for r in got.collect()} == set(range(0, 600, 50))
