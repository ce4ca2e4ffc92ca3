"""A Merkle manifest of a dataset: one root over all rows, and for each row a proof that holds it to the root.

Leaves are digests of a row's columns. Rows with one value of the `part` column (a source) form a tree: leaves ascend by the
`order` column, and while there are several nodes, every ARITY consecutive ones become the digest of their digests; the last
run may be shorter. The trees' own roots, in the order of their parts (null first, then by UTF-8 bytes), form the last tree.

Checkpoint and recompute: only every STRIDE-th level is stored. Its nodes are gathered in aligned subtrees of ARITY ** STRIDE
nodes of the stored level below, so no group is ever larger, however many rows a part has. Proofs go down the stored levels: each
aligned subtree regenerates the nodes between from the stored ones below it, gives out the siblings of each on the path and
drops the rest; what lies above a subtree is one path, handed down once for the whole subtree. All work is DataFrame functions;
texts are hashed where they are read and never shuffled.

Null columns are told apart from all values. Rows of one part and order (also repeated rows) are ordered by leaf, so their trees
are the same in every run. Extra columns are not part of a leaf. Null order values come first. An empty table has no root and gives
no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from .common import materialize

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Nodes of a run; levels from one stored level to the next.
ARITY, STRIDE = 16, 2
_PATH = "array<struct<left:string,right:string>>"


def joined_digest(parts: Column) -> Column:
    """Lowercase hex digest of an array of texts, concatenated."""
    return F.sha2(F.array_join(parts, "").cast("binary"), 256)


def leaf(columns: dict[str, Column]) -> Column:
    """The digest of the columns: `-` for null, else the number of UTF-8 bytes, a colon and the value."""
    texts = [c.cast("string") for c in columns.values()]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)).cast("binary"), 256)


@dataclass
class Tree:
    """levels: (part, grp, n, nodes) by stored level, a row for each aligned subtree; nodes are structs with `node` and, in the
    lowest level, the leaf's row. roots: (part, node)."""

    levels: list[DataFrame]
    roots: DataFrame


def _ranked(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with pos, the place among the rows of their part, and n, how many the part has. Rows are dealt by range over part and
    order and numbered within their task; what lies before a task is a sum over a row for each task and part."""
    dealt = rows.repartitionByRange("part", *order).sortWithinPartitions("part", *order)
    dealt = materialize(dealt.withColumns({"task": F.spark_partition_id(), "row": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), name)
    runs = dealt.groupBy("part", "task").agg(F.min("row").alias("first"), F.count("*").alias("rows"))
    all_ = Window.partitionBy("part")
    runs = runs.select("part", "task", (F.sum("rows").over(all_.orderBy("task")) - F.col("rows") - F.col("first")).alias("shift"), F.sum("rows").over(all_).alias("n"))
    return dealt.join(runs, ["part", "task"]).withColumn("pos", F.col("row") + F.col("shift")).drop("task", "row", "shift")


def _gathered(rows: DataFrame, node: Column) -> DataFrame:
    """rows (part, pos, n, ..) as aligned subtrees: (part, grp, n, nodes in order)."""
    size = ARITY**STRIDE
    held = F.struct("pos", *(c for c in rows.columns if c not in ("part", "pos", "n")))
    out = rows.groupBy("part", F.expr(f"pos div {size}").alias("grp"), "n").agg(F.array_sort(F.collect_list(held)).alias("nodes"))
    return out


def _runs(nodes: Column) -> Column:
    """The digests of every ARITY consecutive ones."""
    starts = F.sequence(F.lit(1), F.size(nodes), F.lit(ARITY))
    return F.transform(starts, lambda at: joined_digest(F.slice(nodes, at, ARITY)))


def _left(level: int) -> Column:
    """How many of the next STRIDE levels a part with n leaves still has above this level."""
    return sum((F.when(F.col("n") > ARITY ** (level + k), 1).otherwise(0) for k in range(STRIDE)), F.lit(0))


def _stored(nodes: Column) -> list[Column]:
    """The levels of an aligned subtree from its stored nodes up."""
    out = [F.transform(nodes, lambda x: x["node"])]
    for _ in range(STRIDE):
        out.append(_runs(out[-1]))
    return out


def grow(rows: DataFrame, order: list[str], name: str) -> Tree:
    """The trees over rows (part, order.., node, ..), one for each part."""
    low = materialize(_gathered(_ranked(rows, order, f"{name}-dealt"), F.col("node")), f"{name}-0")
    levels, level = [low], 0
    largest = low.agg(F.max("n")).first()[0] or 0
    while largest > ARITY**level:
        levels_up = _stored(F.col("nodes"))
        top = levels_up[0]
        for k in range(1, STRIDE + 1):
            top = F.when(_left(level) >= k, levels_up[k]).otherwise(top)
        level += STRIDE
        rows = levels[-1].select("part", F.col("grp").alias("pos"), "n", F.element_at(top, 1).alias("node"))
        levels.append(materialize(_gathered(rows, F.col("node")), f"{name}-{level}"))
    return Tree(levels, levels[-1].select("part", F.col("nodes")[0]["node"].alias("node")))


def _siblings(nodes: Column, at: Column) -> Column:
    """The digests of the run beside place `at`, those before and those after."""
    start = F.floor(at / ARITY).cast("int") * ARITY
    own = F.slice(nodes, start + 1, ARITY)
    place = at - start
    return F.struct(F.array_join(F.slice(own, F.lit(1), place), "").alias("left"), F.array_join(F.slice(own, place + 2, ARITY), "").alias("right"))


def paths(tree: Tree, above: DataFrame) -> DataFrame:
    """(part, row, path) of every leaf: row is its struct, path the siblings level by level up to its part's root and on along
    `above` (part, path)."""
    tail = above
    for k in range(len(tree.levels) - 1, -1, -1):
        low = tree.levels[k]
        join = low.join(tail, ["part", "grp"] if "grp" in tail.columns else ["part"])
        stored = _stored(F.col("nodes"))[:STRIDE]
        # levels are computed once a subtree, before its nodes are taken apart
        join = join.select("part", "grp", "nodes", "path", *(s.alias(f"up{i}") for i, s in enumerate(stored)), _left(k * STRIDE).alias("left"))

        def of(x, i):
            own = F.array(*(_siblings(F.col(f"up{j}"), F.floor(i / ARITY**j).cast("int")) for j in range(STRIDE)))
            return F.struct(x.alias("row"), F.concat(F.slice(own, F.lit(1), F.col("left")), F.col("path")).cast(_PATH).alias("path"))

        each = join.select("part", F.inline(F.transform("nodes", of)))
        tail = each.select("part", F.col("row.pos").alias("grp"), "path") if k else each
    return tail


def proof_digest(path: Column) -> Column:
    return joined_digest(F.transform(path, lambda x: F.concat(x["left"], x["right"])))


def folded(node: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, node, lambda acc, x: F.sha2(F.concat(x["left"], acc, x["right"]).cast("binary"), 256))


@dataclass
class Manifest:
    """tree: of the parts; top: of the parts' roots; roots: (part, node), of which part is '-' or '+' and the value; root."""

    tree: Tree
    top: Tree
    root: str | None


def build(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, part: str = "source", order: str = "doc_id", carry: dict[str, Column] | None = None) -> Manifest:
    """The manifest of docs. `carry` are columns of docs kept beside each leaf."""
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("+"), F.col(part).cast("string")), F.lit("")).alias("part"),
        F.col(order).alias("at"),
        leaf({c: F.col(c) for c in columns}).alias("node"),
        *(c.alias(name) for name, c in (carry or {}).items()),
    )
    tree = grow(materialize(leaves, "leaves"), ["at", "node"], "parts")
    top = grow(tree.roots.select(F.lit("").alias("part"), F.col("part").alias("at"), "node"), ["at"], "top")
    row = top.roots.first()
    return Manifest(tree, top, row[1] if row else None)


def proofs(manifest: Manifest) -> DataFrame:
    """(row, path, subroot) of every leaf, where row has at, node and the carried columns."""
    start = manifest.top.roots.select("part", F.array().cast(_PATH).alias("path"))
    above = paths(manifest.top, start).select(F.col("row.at").alias("part"), F.col("row.node").alias("subroot"), "path")
    above = materialize(above, "above")
    return paths(manifest.tree, above.select("part", "path")).join(above.select("part", "subroot"), "part")
