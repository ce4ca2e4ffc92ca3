"""What both vector searches share: usable rows, cells of bounded size, and a streamed search within cells.

Candidates are dealt into cells of at most about CELL_MOST rows and are never copied. Queries are sent to the cells they
need. A task holds one cell's candidates and lets its queries pass by in batches, so neither side has to fit as a whole.
Products of vectors of different dimension count missing components as zero.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

#: Rows of a cell: a 64th of all rows within these bounds. Only the dealing out depends on it, never a result.
CELL_LEAST, CELL_MOST = 4096, 65_536
#: Products that a task computes at once.
AT_ONCE = 1 << 22


def usable(embeddings: DataFrame, nonzero: bool) -> DataFrame:
    """(vec_id, v array<double>) without null ids or vectors, null or non-finite components or, if asked, zero vectors."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    if nonzero:
        good = good & F.exists("v", lambda x: x != 0)
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter("v is not null and vec_id is not null and size(v) > 0")
    return rows.filter(good)


def query_rows(rows: DataFrame, every: int) -> DataFrame:
    """(query_id, v) of the ids divisible by `every`; of rows that repeat an id, the least vector asks."""
    return rows.filter(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v"))


def cell_rows(n: int) -> int:
    return min(CELL_MOST, max(CELL_LEAST, n // 64))


def matrix(column, width: int | None = None) -> np.ndarray:
    """An Arrow list<double> column as rows of a matrix, padded with zeros or cut to width (default: the longest)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)
    width = (int(sizes.max()) if len(sizes) else 1) if width is None else width
    if (sizes == width).all():
        return flat.reshape(len(column), width)
    out = np.zeros((len(column), width))
    begin = np.concatenate(([0], np.cumsum(sizes)))
    for i, size in enumerate(sizes.tolist()):
        take = min(size, width)
        out[i, :take] = flat[begin[i] : begin[i] + take]
    return out


def by_width(column) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) for each dimension among the vectors."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    for width in np.unique(sizes).tolist():
        places = np.flatnonzero(sizes == width)
        yield places, matrix(column.take(pa.array(places)), width)


def dealt(counts: list[tuple], rows: int) -> tuple[dict, int]:
    """{group: (first cell, cells)} for (group, its rows) in order: small neighbours share a cell, large groups have several."""
    out, cell, held = {}, 0, 0
    for group, n in counts:
        chunks = -(-n // rows)
        if held and (chunks > 1 or held + n > rows):
            cell, held = cell + 1, 0
        out[group] = (cell, max(1, chunks))
        if chunks > 1:
            cell += chunks
        else:
            held += n
    return out, cell + (1 if held else 0)


def search(candidates: DataFrame, queries: DataFrame, find: Callable, hits: str) -> DataFrame:
    """Run find(candidates, queries) on every cell: Arrow tables of one cell's candidates and of some of its queries.

    Both frames have a column cell; what find returns has the columns of hits."""
    own, asked = candidates.columns, queries.columns
    empty = lambda df, names: [F.lit(None).cast(df.schema[c].dataType).alias(c) for c in names]
    q = queries.select("cell", F.lit(1).alias("kind"), *empty(candidates, [c for c in own if c != "cell"]), *(F.col(c).alias(f"q_{c}") for c in asked if c != "cell"))
    c = candidates.select("cell", F.lit(0).alias("kind"), *(c for c in own if c != "cell"), *(x.alias(f"q_{n}") for n, x in zip([n for n in asked if n != "cell"], empty(queries, [n for n in asked if n != "cell"]), strict=True)))
    names = [x.split()[0] for x in hits.split(", ")]

    def run(batches):
        cell, held, built = None, [], None
        for batch in batches:
            key = np.stack([batch.column("cell").to_numpy(), batch.column("kind").to_numpy()], axis=1)
            if not len(key):
                continue
            starts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
            for begin, end in zip(starts, starts[1:]):
                if key[begin, 0] != cell:
                    cell, held, built = key[begin, 0], [], None
                part = batch.slice(begin, end - begin)
                if key[begin, 1] == 0:
                    held.append(part.select([n for n in own if n != "cell"]))
                    continue
                if not held:
                    continue
                if built is None:
                    built = pa.Table.from_batches(held).combine_chunks()
                    held = [None]
                step = max(1, AT_ONCE // len(built))
                asking = part.select([f"q_{n}" for n in asked if n != "cell"]).rename_columns([n for n in asked if n != "cell"])
                for at in range(0, len(asking), step):
                    yield from (b.select(names) for b in find(built, asking.slice(at, step)))

    return c.unionByName(q).repartition("cell").sortWithinPartitions("cell", "kind").mapInArrow(run, hits)


def best(hits: DataFrame, k: int, score: Column | str = "score") -> DataFrame:
    """The k highest of each query, ties to the smaller vec_id."""
    w = Window.partitionBy("query_id").orderBy(F.desc(score), "vec_id")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def top_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        keep = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep]))[:k]]
