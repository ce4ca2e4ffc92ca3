"""Exact top-k by inner product through norm buckets.

Candidates are grouped by length (geometric buckets; small neighbours share a cell, large ones are dealt into several).
Every query gets a threshold from the longest candidates, its k-th best product among them, and visits a cell only if its
length times the cell's greatest length can reach it. In a bucket the local cosine threshold (threshold over both
lengths) decides: a high one prunes by the ranges that the query's largest coordinates leave, a low one by each
candidate's length; what is left is verified by its product. A bound that equals the threshold never prunes, so ties
are kept.

Vectors that are null or hold null or non-finite components take no part, nor do rows without an id; between vectors of
different dimension missing components count as zero. Repeated rows are candidates each; of rows that repeat a query's
id the least vector asks. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from .common import materialize
from .vectors import best, by_width, cell_rows, dealt, matrix, query_rows, search, top_of, usable

#: Lengths within a bucket differ by this factor.
STEP = 1.05
#: Local cosine threshold from which coordinates prune better than lengths; coordinates looked at.
COSINE, FOCUS = 0.8, 4
#: Longest candidates that give the thresholds; they are sent to every task, and only those of at most this many components.
SEED, SEED_WIDTH = 2048, 4096
#: Sums of doubles that are integers are exact below this.
_EXACT = 2.0**53


def _products(c: np.ndarray, q: np.ndarray, integral: bool) -> np.ndarray:
    """Products of candidates with one query; integral: of whole numbers, exactly, at most 2**63 - 1 in size."""
    if integral and len(c) and np.abs(c).max(initial=0) * np.abs(q).sum() >= _EXACT:
        whole = [sum(int(a) * int(b) for a, b in zip(row.tolist(), q.tolist(), strict=True)) for row in c]
        return np.array([min(2**63 - 1, max(1 - 2**63, x)) for x in whole], np.int64)
    return (c * q).sum(axis=1)


def bucket_hits(q_ids, q, threshold, c_ids, c, k: int, integral: bool = False) -> list[tuple]:
    """For each query its k best of one bucket that reach its threshold. Vectors of both sides have one dimension."""
    lengths = np.linalg.norm(c, axis=1)
    order = np.argsort(-lengths, kind="stable")
    c, c_ids, lengths = c[order], c_ids[order], lengths[order]
    q_lengths = np.linalg.norm(q, axis=1)
    longest = lengths[0] if len(lengths) else 0.0
    slack = 1e-9 * (1 + q_lengths * longest)
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where(q_lengths * longest > 0, (threshold - slack) / (q_lengths * longest), np.where(threshold <= slack, -np.inf, np.inf))
    out = []

    def verify(i, places, scores):
        keep = (c_ids[places] != q_ids[i]) & (scores >= threshold[i] - slack[i])
        places, scores = places[keep], scores[keep]
        for j in top_of(scores, c_ids[places], k).tolist():
            out.append((int(q_ids[i]), int(c_ids[places[j]]), scores[j].item()))

    by_length, unit = [], None
    for i in np.flatnonzero(local <= 1).tolist():
        if local[i] < COSINE and not (integral and q_lengths[i] * longest >= _EXACT):
            by_length.append(i)
            continue
        if local[i] < COSINE:
            verify(i, np.arange(len(c)), _products(c, q[i], True))
            continue
        if unit is None:
            unit = np.divide(c, lengths[:, None], out=np.zeros_like(c), where=lengths[:, None] > 0)
        own = q[i] / q_lengths[i]
        focus = np.argsort(-np.abs(own))[:FOCUS]
        angle, at = np.arccos(min(1.0, local[i])), np.arccos(np.clip(own[focus], -1, 1))
        low = np.where(at + angle >= np.pi, -1.0, np.cos(np.minimum(at + angle, np.pi))) - 1e-9
        high = np.where(at <= angle, 1.0, np.cos(np.maximum(at - angle, 0))) + 1e-9
        near = unit[:, focus]
        places = np.flatnonzero(((near >= low) & (near <= high)).all(axis=1) | (lengths == 0))
        verify(i, places, _products(c[places], q[i], integral))
    if by_length:
        with np.errstate(divide="ignore", invalid="ignore"):
            least = np.where(q_lengths[by_length] > 0, (threshold[by_length] - slack[by_length]) / q_lengths[by_length], -np.inf)
        stops = np.searchsorted(-lengths, -least, "right")
        scores = q[by_length] @ c[: stops.max(initial=0)].T
        for i, stop, row in zip(by_length, stops.tolist(), scores, strict=True):
            verify(i, np.arange(stop), row[:stop])
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, integral: bool = False) -> DataFrame:
    """(query_id, rank, vec_id, score) for queries (query_id, v) against vectors (vec_id, v); a query's own id is no candidate.

    integral: components are whole numbers and scores are longs, exact also where doubles aren't (at most 2**63 - 1 in size)."""
    spark = vectors.sparkSession
    hits = "query_id long, vec_id long, score " + ("long" if integral else "double")
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    bucket = F.when(F.col("length") > 0, F.floor(F.log("length") / float(np.log(STEP)))).otherwise(-100_000).cast("int")
    held = materialize(vectors.withColumn("length", length).withColumn("bucket", bucket).withColumn("width", F.size("v")), "vectors")
    # buckets are as few as the steps between the shortest and the longest vector, for each dimension
    groups = held.groupBy("width", "bucket").agg(F.count("*").alias("n"), F.max("length").alias("longest")).orderBy("width", F.desc("bucket")).collect()
    if not groups:
        return spark.createDataFrame([], hits).select("query_id", F.lit(1).alias("rank"), "vec_id", "score")
    rows = cell_rows(sum(g.n for g in groups))
    places: dict = {}
    first = 0
    for width in dict.fromkeys(g.width for g in groups):
        own, n = dealt([((width, g.bucket), g.n) for g in groups if g.width == width], rows)
        places |= {key: (first + cell, chunks) for key, (cell, chunks) in own.items()}
        first += n
    longest = np.zeros(first)
    for g in groups:
        cell, chunks = places[g.width, g.bucket]
        longest[cell : cell + chunks] = np.maximum(longest[cell : cell + chunks], g.longest)
    listed = F.broadcast(spark.createDataFrame([(*key, *value) for key, value in places.items()], "width int, bucket int, first int, chunks int"))
    cell = (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("chunks"))).cast("int")
    candidates = held.join(listed, ["width", "bucket"]).select(cell.alias("cell"), "bucket", "vec_id", "v")

    seed = held.filter(F.col("width") <= SEED_WIDTH).orderBy(F.desc("length"), "vec_id").limit(SEED).select("vec_id", "v").toArrow()
    sent = spark.sparkContext.broadcast((seed["vec_id"].to_numpy(), matrix(seed["v"]), longest))

    def visits(batches):
        ids, c, longest = sent.value
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                q_ids = part.column("query_id").to_numpy()
                threshold, lengths = np.full(len(part), -np.inf), np.zeros(len(part))
                for own, q in by_width(part.column("v")):
                    lengths[own] = np.linalg.norm(q, axis=1)
                    width = min(q.shape[1], c.shape[1])
                    scores = q[:, :width] @ c[:, :width].T
                    scores[q_ids[own][:, None] == ids[None, :]] = -np.inf
                    if scores.shape[1] >= k:
                        threshold[own] = np.partition(scores, -k, axis=1)[:, -k]
                # what rounding may have added to a threshold prunes nothing
                reach = lengths[:, None] * longest[None, :]
                asking, cells = np.nonzero(reach * (1 + 1e-9) + 1e-9 >= threshold[:, None])
                take = pa.array(asking)
                yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), part.column("query_id").take(take), part.column("v").take(take), pa.array(threshold[asking])], ["cell", "query_id", "v", "threshold"])

    asked = queries.select("query_id", "v").mapInArrow(visits, "cell int, query_id long, v array<double>, threshold double")

    def find(own: pa.Table, asking: pa.RecordBatch):
        bucket, ids, c = own["bucket"].to_numpy(), own["vec_id"].to_numpy(), matrix(own["v"])
        q_ids, threshold = asking.column("query_id").to_numpy(), asking.column("threshold").to_numpy()
        found = []
        for at, q in by_width(asking.column("v")):
            width = min(q.shape[1], c.shape[1])
            for b in np.unique(bucket).tolist():
                mine = bucket == b
                found += bucket_hits(q_ids[at], q[:, :width], threshold[at], ids[mine], c[mine][:, :width], k, integral)
        columns = list(zip(*found, strict=True)) or [[], [], []]
        score = pa.array([int(x) for x in columns[2]], pa.int64()) if integral else pa.array(columns[2], pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), score], ["query_id", "vec_id", "score"])

    return best(search(candidates, asked, find, hits), k).select("query_id", "rank", "vec_id", "score")


def integer_top_k(embeddings: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """The search over floor(256 * x) of each component; queries are the rows whose vec_id is divisible by `every`."""
    rows = usable(embeddings, nonzero=False).withColumn("v", F.transform("v", lambda x: F.floor(256 * x).cast("double")))
    return top_k(rows, query_rows(rows, every), k, integral=True)
