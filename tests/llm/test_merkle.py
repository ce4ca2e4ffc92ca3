import hashlib
from collections import defaultdict

import pyspark.sql.functions as F
import pytest

from hushframe.llm import merkle as M


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def path(tree, at):
    out = []
    for nodes in tree[:-1]:
        a = at // 16 * 16
        out.append(("".join(nodes[a:at]), "".join(nodes[at + 1 : a + 16])))
        at //= 16
    return out


def brute(rows):
    parts = defaultdict(list)
    for r in rows:
        parts[r[1]].append(r)
    order = lambda r: (r[0] is not None, r[0] or 0, leaf(r))
    names = sorted(parts, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([leaf(r) for r in sorted(parts[s], key=order)]) for s in names}
    top = levels([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        out += [(r[0], leaf(r), trees[s][-1][0], path(trees[s], i) + path(top, k)) for i, r in enumerate(sorted(parts[s], key=order))]
    return out, top[-1][0]


SCHEMA = "doc_id long, source string, lang string, n_chars int, text string, part int, node int"


def proofs(spark, rows):
    manifest = M.build(spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA))
    got = M.proofs(manifest).withColumn("fold", M.folded(F.col("row.node"), F.col("path")))
    return [(r.row.at, r.row.node, r.subroot, [tuple(p) for p in r.path], r.fold) for r in got.collect()], manifest.root


def row(i, source):
    return (i, source, None if i % 3 else "én", i, f"text {i} é" if i % 5 else None)


@pytest.mark.parametrize(
    "rows",
    [
        [row(i, "a") for i in range(1)],
        [row(i, "a") for i in range(16)] + [row(100, None), row(7, "")],
        [row(i * 3, "hot") for i in range(700)] + [row(i, f"s{i}") for i in range(300)] + [row(9, None)] * 20 + [(None, "hot", None, None, None)],
    ],
    ids=["one leaf", "full run, null and empty source", "three levels, many sources, repeated rows, null ids"],
)
def test_proofs_equal_brute_force(spark, rows):
    got, root = proofs(spark, rows)
    want, want_root = brute(rows)
    assert root == want_root
    assert sorted(g[:4] for g in got if g[0] is not None) == sorted(w for w in want if w[0] is not None)
    assert sorted(g[1:4] for g in got) == sorted(w[1:4] for w in want)
    assert {g[4] for g in got} == {root}


def test_groups_are_bounded(spark):
    docs = spark.range(1500).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit(None).cast("string").alias("lang"), F.lit(1).alias("n_chars"), F.lit("t").alias("text"))
    tree = M.build(docs).tree
    assert [t.agg(F.max(F.size("nodes"))).first()[0] for t in tree.levels] == [256, 6, 1]


def test_empty_table_and_a_very_long_text(spark):
    empty = spark.createDataFrame([], SCHEMA)
    manifest = M.build(empty)
    assert manifest.root is None and M.proofs(manifest).count() == 0
    rows = [(1, "a", "en", 1, "x" * 5_000_000), (2, "a", "en", 1, "")]
    got, root = proofs(spark, rows)
    assert root == brute(rows)[1] and len(got) == 2
