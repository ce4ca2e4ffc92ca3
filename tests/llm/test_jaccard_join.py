import random
import re

import pytest

from hushframe.llm import jaccard_join as J

SCHEMA = "doc_id long, text string, node string"


def brute(rows, k, s):
    sets = {}
    for i, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= s * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed, n=120):
    r = random.Random(seed)
    vocab = [f"w{j}" for j in range(400)]
    base = [[r.choice(vocab) for _ in range(r.choice([3, 12, 60, 200]))] for _ in range(n // 6)]
    common = [r.choice(vocab) for _ in range(30)]
    rows = []
    for i in range(n):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 4, 8])):
            w[r.randrange(len(w))] = r.choice(vocab)
        if r.random() < 0.3:
            w += common
        sep = r.choice([" ", "\n", "  ", "\t"])
        rows.append((i, sep.join(w).upper() if r.random() < 0.2 else sep.join(w)))
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "Ünï CODE"), (n + 4, "Ünï code")]


def test_components_equal_brute_force(spark):
    for seed, (k, s) in enumerate([(4, 85), (5, 80)]):
        rows = corpus(seed)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.similar_texts(spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA), k, s)["documents"].collect()}
        assert got == brute(rows, k, s)


def test_small_tiles_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(J, "TILE", 4)
    monkeypatch.setattr(J, "EARLIER", 2)
    rows = corpus(7, 90)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.similar_texts(spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA), 4, 85)["documents"].collect()}
    assert got == brute(rows, 4, 85)


def test_empty_table_and_kept_rows(spark):
    assert J.similar_texts(spark.createDataFrame([], SCHEMA))["documents"].count() == 0
    long = " ".join(f"v{i % 977}" for i in range(30000))
    rows = [(1, long, "a"), (2, long + " end", "b"), (3, "one two three four five six", "c"), (4, None, "d"), (3, "one two three four five six", "c")]
    kept = J.keep_one(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "node"]
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]


def brute_links(rows, k, s):
    """How many other shingle sets each row's set links with."""
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset({tuple(w)} if w else ())
    nodes = {x for x in sets.values() if x}
    return {i: sum(100 * len(x & y) >= s * len(x | y) for y in nodes if x != y) if x else 0 for i, x in sets.items()}


@pytest.mark.parametrize("tile", [1024, 4])
def test_every_link_of_a_component(spark, monkeypatch, tile):
    monkeypatch.setattr(J, "TILE", tile)
    words = [f"v{j}" for j in range(120)]
    near = [(1000 + i, " ".join(words[:i] + [f"x{i}"] + words[i + 1 :])) for i in range(0, 30)]
    chain = [(2000 + i, " ".join(f"c{j}" for j in range(4 * i, 4 * i + 100))) for i in range(12)]
    rows = corpus(3, 60) + near + chain
    out = J.similar_texts(spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA), 4, 85)
    want = brute_links(rows, 4, 85)
    assert {r.doc_id: r.n_links for r in out["documents"].collect()} == want
    assert want[1000] == 29 and 0 < want[2000] < want[2006] < 11
    links = [(r.a, r.b) for r in out["links"].collect()]
    node = {r.doc_id: r.node for r in out["documents"].collect()}
    assert len(links) == len(set(links)) == sum({node[i]: n for i, n in want.items() if node[i] is not None}.values()) // 2
    assert all(a < b for a, b in links)


def test_null_repeated_and_int_doc_ids(spark):
    import corpus_pipeline

    texts = corpus(11, 60)[:60]
    words = [f"n{j}" for j in range(60)]
    near = lambda i: " ".join(words[:i] + ["odd"] + words[i + 1 :])
    other, alone = " ".join(f"o{j}" for j in range(40)), " ".join(f"a{j}" for j in range(40))
    rows = texts + [(None, near(3)), (500, near(3)), (501, near(4)), (501, near(5)), (None, other), (None, other + " end"), (None, alone), (None, None), (None, ""), (600, " "), (600, " "), (601, None), (601, "")]
    out = J.similar_texts(spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA.replace("long", "int")), 5, 80)["documents"].collect()
    assert {r.component_id for r in out if r.doc_id in (500, 501)} == {500} and {r.n_links for r in out if r.doc_id in (500, 501)} == {2}

    # brute force: rows numbered so that null doc_ids come last
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    found = brute([(at, rows[i][1]) for at, i in enumerate(order)], 5, 80)
    want = sorted(str(rows[order[at]][0]) for at, (_, root) in found.items() if at == root)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA.replace("long", "int"))
    kept = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted(str(r.doc_id) for r in kept) == want
    assert {(r.doc_id, r.text) for r in kept} <= set(rows)


def test_long_words_of_a_kind_do_not_link(spark):
    a, b = "a", "b"
    for _ in range(10):
        a, b = a + b, b + a
    rows = [(1, a), (2, b), (3, a)]
    got = {r.doc_id: r.component_id for r in J.similar_texts(spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA), 4, 85)["documents"].collect()}
    assert got == {1: 1, 2: 2, 3: 1}
