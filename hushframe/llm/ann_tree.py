"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first traversal.

A tree of spherical k-means splits is fitted on a bounded sample of unit vectors and indexes every row by its leaf. A
query walks the tree through a priority queue of nodes by cosine, taking leaves best first. How many leaves it takes is
calibrated: for a bounded number of the queries the exact neighbours over all rows are found by blocked products, and
visits are widened until they hold the wanted share of them; a query goes on until its leaves hold k other rows. Leaves
are stored in cells of bounded size; a query is sent once to each cell that holds leaves it visits, and only rows of
those leaves are compared, by exact cosine in double precision. The recall that comes out is measured on other queries.

Vectors without clusters leave a search little to skip: then the calibrated visits take a large part of the leaves.

Null, zero and non-finite vectors and rows without an id take no part; between vectors of different dimension missing
components count as zero. Repeated rows are candidates each; of rows that repeat a query's id the least vector asks.
Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from .common import materialize
from .vectors import best, by_width, cell_rows, dealt, matrix, query_rows, search, top_of, usable

#: Rows that the tree is fitted on, children of a node, leaves at most, sampled rows of a leaf at least, queries that calibrate
#: and as many that measure.
SAMPLE, BRANCHES, LEAVES, LEAF, CALIBRATE = 40_000, 64, 4096, 4, 200
#: Share of exact neighbours that calibrated visits must hold.
RECALL = 0.93

_HITS = "query_id long, vec_id long, score double, leaf int"


class Tree:
    """Unit centroids: children[i] are the places of node i's children, leaf[i] its leaf number or -1."""

    def __init__(self, sample: np.ndarray, leaf_rows: float, seed: int = 0):
        random = np.random.default_rng(seed)
        self.centre, self.children, self.leaf = [sample.mean(axis=0)], [[]], [-1]
        waiting, self.leaves = [(0, sample)], 0
        while waiting:
            node, rows = waiting.pop()
            parts = self._split(rows, leaf_rows, random) if len(rows) > max(leaf_rows, LEAF) else []
            if len(parts) < 2:
                self.leaf[node] = self.leaves
                self.leaves += 1
                continue
            for centre, own in parts:
                self.children[node].append(len(self.centre))
                self.centre.append(centre)
                self.children.append([])
                self.leaf.append(-1)
                waiting.append((len(self.centre) - 1, own))
        self.centre = np.array(self.centre)
        self.kids = [np.array(x, np.int64) for x in self.children]

    @staticmethod
    def _split(rows: np.ndarray, leaf_rows: float, random) -> list:
        different = np.unique(rows, axis=0)
        if len(different) < 2:
            return []
        n = min(BRANCHES, len(different), max(2, math.ceil(len(rows) / leaf_rows)))
        centres = different[random.choice(len(different), n, replace=False)]
        for _ in range(10):
            near = np.argmax(rows @ centres.T, axis=1)
            sums = np.array([rows[near == i].sum(axis=0) if (near == i).any() else centres[i] for i in range(n)])
            length = np.linalg.norm(sums, axis=1, keepdims=True)
            centres = np.where(length > 0, sums / np.maximum(length, 1e-300), centres)
        near = np.argmax(rows @ centres.T, axis=1)
        return [(centres[i], rows[near == i]) for i in range(n) if (near == i).any()]

    def assign(self, rows: np.ndarray) -> np.ndarray:
        """The leaf that each row reaches by its nearest child at every node."""
        out = np.empty(len(rows), np.int64)
        waiting = [(0, np.arange(len(rows)))]
        while waiting:
            node, held = waiting.pop()
            kids = self.kids[node]
            if not len(kids):
                out[held] = self.leaf[node]
                continue
            near = np.argmax(rows[held] @ self.centre[kids].T, axis=1)
            waiting += [(kid, held[near == i]) for i, kid in enumerate(kids.tolist()) if (near == i).any()]
        return out

    def walk(self, row: np.ndarray, visits: int, counts: np.ndarray | None = None, least: int = 0) -> list[int]:
        """The first leaves of a best-bin-first traversal, more than visits until they hold least rows by counts."""
        away = (-(self.centre @ row)).tolist()
        queue, out, held = [(0.0, 0)], [], 0
        while queue and (len(out) < visits or held < least):
            _, node = heapq.heappop(queue)
            if not self.children[node]:
                out.append(self.leaf[node])
                held += int(counts[self.leaf[node]]) if counts is not None else 0
            for kid in self.children[node]:
                heapq.heappush(queue, (away[kid], kid))
        return out


def _units(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)


def _finder(k: int):
    def find(own: pa.Table, asking: pa.RecordBatch):
        """Each query's k largest cosines among the rows of the leaves it visits, ties to the smaller id."""
        leaf, ids, c = own["leaf"].to_numpy(), own["vec_id"].to_numpy(), matrix(own["v"])
        order = np.argsort(leaf, kind="stable")
        leaf, ids, c = leaf[order], ids[order], c[order]
        norms, units = np.sqrt((c * c).sum(axis=1)), _units(c)
        leaves = np.unique(leaf)
        begin, end = np.searchsorted(leaf, leaves), np.searchsorted(leaf, leaves, "right")
        q_ids, visited = asking.column("query_id").to_numpy(), asking.column("leaves")
        flat, whose = visited.flatten().to_numpy(), np.repeat(np.arange(len(asking)), visited.value_lengths().to_numpy())
        found = []
        for at, q in by_width(asking.column("v")):
            width = min(q.shape[1], c.shape[1])
            unit, near = _units(q)[:, :width], np.full((len(at), len(c)), -np.inf)
            place = np.full(len(asking), -1)
            place[at] = np.arange(len(at))
            for number, a, b in zip(leaves.tolist(), begin.tolist(), end.tolist(), strict=True):
                who = place[whose[flat == number]]
                who = who[who >= 0]
                near[who, a:b] = unit[who] @ units[a:b, :width].T
            near[q_ids[at][:, None] == ids[None, :]] = -np.inf
            kth = np.partition(near, -k, axis=1)[:, -k] if near.shape[1] > k else np.full(len(at), -np.inf)
            q_norms = np.sqrt((q * q).sum(axis=1))
            for i in range(len(at)):
                places = np.flatnonzero((near[i] >= kth[i] - 1e-9) & (near[i] > -np.inf))
                scores = (c[places, :width] * q[i, :width]).sum(axis=1) / (q_norms[i] * norms[places])  # the same sum for equal vectors, wherever they stand
                found += [(int(q_ids[at[i]]), int(ids[places[j]]), float(scores[j]), int(leaf[places[j]])) for j in top_of(scores, ids[places], k).tolist()]
        columns = list(zip(*found, strict=True)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.int32()), strict=True)], ["query_id", "vec_id", "score", "leaf"])

    return find


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, recall: float = RECALL) -> tuple[DataFrame, dict]:
    """(query_id, rank, vec_id, score) for queries (query_id, v) over vectors (vec_id, v), and what calibration found:
    visits, leaves, recall (of the queries that calibrate) and measured (of others; the same where there are too few)."""
    spark = vectors.sparkSession
    vectors = materialize(vectors, "vectors")
    widths = vectors.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not widths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double"), {"visits": 0, "leaves": 0, "recall": 1.0, "measured": 1.0}
    width = widths[0].n  # the tree looks at as many components as most vectors have
    sample = matrix(vectors.filter(F.size("v") == width).orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(SAMPLE).select("v").toArrow()["v"])
    n = vectors.count()
    wanted = min(LEAVES, max(1, int(4 * math.sqrt(n))))
    tree = Tree(_units(sample), max(LEAF, 1.6 * len(sample) / wanted))
    held = spark.sparkContext.broadcast(tree)

    def place(batches):
        for batch in batches:
            leaf = held.value.assign(_units(matrix(batch.column("v"), width))) if len(batch) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(leaf.astype(np.int32))], ["vec_id", "v", "leaf"])

    index = materialize(vectors.mapInArrow(place, "vec_id long, v array<double>, leaf int"), "index")
    own = index.join(queries.select(F.col("query_id").alias("vec_id")), "vec_id", "left_semi").groupBy(F.col("vec_id").alias("query_id")).agg(F.count("*").alias("own"))
    asked = materialize(queries.join(own, "query_id", "left").select("query_id", "v", F.coalesce("own", F.lit(0)).cast("long").alias("own")), "asked")

    # a row for each leaf and dimension; cells hold leaves that the tree numbers next to each other
    groups = index.groupBy("leaf", F.size("v").alias("width")).count().orderBy("width", "leaf").collect()
    counts, cells = np.zeros(tree.leaves, np.int64), {}
    first = 0
    for w in dict.fromkeys(g.width for g in groups):
        mine = [g for g in groups if g.width == w]
        own_cells, used = dealt([((g.leaf, w), g["count"]) for g in mine], cell_rows(n))
        cells |= {key: (first + cell, chunks) for key, (cell, chunks) in own_cells.items()}
        first += used
        for g in mine:
            counts[g.leaf] += g["count"]
    listed = F.broadcast(spark.createDataFrame([(leaf, w, cell, chunks) for (leaf, w), (cell, chunks) in cells.items()], "leaf int, width int, first int, chunks int"))
    cell = (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("chunks"))).cast("int")
    candidates = index.withColumn("width", F.size("v")).join(listed, ["leaf", "width"]).select(cell.alias("cell"), "leaf", "vec_id", "v")
    of_leaf: dict[int, list[int]] = {}
    for (leaf, _), (cell, chunks) in cells.items():
        of_leaf.setdefault(leaf, []).extend(range(cell, cell + chunks))
    sent = spark.sparkContext.broadcast((counts, of_leaf))

    def found(some: DataFrame, visits: int) -> DataFrame:
        def walked(batches):
            counts, of_leaf = sent.value
            for batch in batches:
                for at in range(0, len(batch), 64):
                    part = batch.slice(at, 64)
                    rows, number, leaves = [], [], []
                    units = _units(matrix(part.column("v"), width))
                    for i, own in enumerate(part.column("own").to_pylist()):
                        taken: dict[int, list[int]] = {}
                        for leaf in held.value.walk(units[i], visits, counts, k + own):
                            for c in of_leaf.get(leaf, ()):
                                taken.setdefault(c, []).append(leaf)
                        rows += [i] * len(taken)
                        number += taken
                        leaves += taken.values()
                    take = pa.array(rows, pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), part.column("query_id").take(take), part.column("v").take(take), pa.array(leaves, pa.list_(pa.int32()))], ["cell", "query_id", "v", "leaves"])

        visit = some.mapInArrow(walked, "cell int, query_id long, v array<double>, leaves array<int>")
        return best(search(candidates, visit, _finder(k), _HITS), k)

    # calibration: the exact neighbours of some queries, and after how many leaves a walk has them
    some = asked.orderBy(F.xxhash64("query_id"), "query_id").limit(2 * CALIBRATE)
    truth = found(some, tree.leaves).select("query_id", "leaf").collect()  # at most 2 * CALIBRATE * k
    ranks: dict[int, list[int]] = {}
    table = some.select("query_id", "v").toArrow()
    units = _units(matrix(table["v"], width))
    walks = {q: {leaf: i + 1 for i, leaf in enumerate(tree.walk(u, tree.leaves))} for q, u in zip(table["query_id"].to_pylist(), units, strict=True)}
    for r in truth:
        ranks.setdefault(r.query_id, []).append(walks[r.query_id][r.leaf])
    each = [x for _, x in sorted(ranks.items())]
    tuned, rest = each[::2], each[1::2] or each
    flat = np.sort(np.concatenate(tuned)) if tuned else np.array([1])
    visits = int(flat[min(len(flat) - 1, math.ceil(recall * len(flat)) - 1)])
    measured = float((np.concatenate(rest) <= visits).mean()) if rest else 1.0
    said = {"visits": visits, "leaves": tree.leaves, "recall": float((flat <= visits).mean()), "measured": measured}
    return found(asked, visits).select("query_id", "rank", "vec_id", "score"), said


def cosine_neighbours(embeddings: DataFrame, every: int = 50, k: int = 5, recall: float = RECALL) -> tuple[DataFrame, dict]:
    """The search among embeddings (vec_id, embedding); queries are the rows whose vec_id is divisible by `every`."""
    rows = usable(embeddings, nonzero=True)
    return nearest(rows, query_rows(rows, every), k, recall)
