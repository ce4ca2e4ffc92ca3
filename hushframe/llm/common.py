"""Helpers that several operators share: tables cut from their lineage, row identity, id bitmaps, components."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import uuid

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

from ..tables import shared_dir


#: Shuffle files of a finished execution go at once instead of when the driver happens to collect its garbage.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Rows sent to Python at once.
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def materialize(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: a lost executor never costs more than one step.

    The step's shuffle files are dropped after it, as nothing reads them again; while it runs they are kept for retries.
    batch_rows: how many rows the step sends to Python at once, where they are wide.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/hushframe/{uuid.uuid4().hex}-{name}"
    wanted = {DROP_SHUFFLES: "true"} | ({BATCH_ROWS: str(batch_rows)} if batch_rows else {})
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out.hushframe_path = path
    _WRITTEN[path] = out
    return out


#: What materialize wrote in this process and nobody has deleted yet, in order.
_WRITTEN: dict[str, DataFrame] = {}


def drop(*tables: DataFrame) -> None:
    """Delete tables that materialize wrote and that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.hushframe_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        _WRITTEN.pop(table.hushframe_path, None)


@contextlib.contextmanager
def scratch(*kept: DataFrame):
    """Within: an operator's tables are written; after: all that were written within are deleted, but for those that `keep` was
    called with. For callers that have read or written an operator's result::

        with scratch() as keep:
            keep(materialize(operator(docs), "result"))
    """
    before, names = set(_WRITTEN), {t.hushframe_path for t in kept}

    def keep(table: DataFrame) -> DataFrame:
        names.add(table.hushframe_path)
        return table

    yield keep
    drop(*(t for path, t in list(_WRITTEN.items()) if path not in before and path not in names))


def keeps_columns(stage):
    """For stages that give out the columns of their first argument: whatever its columns are called, they don't meet those that the
    stage makes, whose names begin with an underscore."""

    @functools.wraps(stage)
    def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
        names = [f"own{i}{c}" if c.startswith("_") else c for i, c in enumerate(docs.columns)]
        return stage(docs.toDF(*names), *args, **kwargs).toDF(*docs.columns)

    return run


def text_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, uid, text): null text as empty; uid tells apart rows that repeat a doc_id with other text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), F.xxhash64(doc_id, text).alias("uid"), text.alias("text"))


def id_bitmap(ids: DataFrame, column: str, bits: int = 1 << 23) -> np.ndarray:
    """Bits set for every value of a long column, gathered as OR-ed words: at most bits/8 bytes reach the driver.

    A filter by this bitmap only saves work: it lets every listed value through, and false hits are dropped by the
    join that follows.
    """
    h = F.pmod(F.xxhash64(column), F.lit(bits))
    words = (
        ids.select(h.alias("h"))
        .groupBy(F.expr("cast(h div 64 as int)").alias("w"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(h % 64 as int)))").alias("v"))
        .toPandas()
    )
    out = np.zeros(bits // 64, np.uint64)
    out[words["w"].to_numpy(np.int64)] = words["v"].to_numpy(np.int64).view(np.uint64)
    return out


def in_bitmap(spark: SparkSession, bitmap: np.ndarray, column: str) -> Column:
    """True where the long column's bit is set."""
    held = spark.sparkContext.broadcast(bitmap)
    bits = len(bitmap) * 64

    @F.pandas_udf("boolean")
    def hit(h: pd.Series) -> pd.Series:
        h = h.to_numpy(np.int64)
        return pd.Series((held.value[h >> 6] >> (h & 63).astype(np.uint64)) & np.uint64(1) == 1)

    return hit(F.pmod(F.xxhash64(column), F.lit(bits)))


def utf8_batch(column) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow string column's bytes and its n + 1 offsets, without a copy per row."""
    import pyarrow as pa

    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def give_back() -> None:
    """Return freed memory to the system at the end of a task: Python workers live on for tasks of other steps."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not on every platform
        ctypes.CDLL(None).malloc_trim(0)


def freeing(run):
    """A function over a task's batches that gives memory back when it is through."""

    @functools.wraps(run)
    def freed(batches):
        yield from run(batches)
        give_back()

    return freed


def slices(batches, rows: int = 128):
    """Arrow batches in parts of a few rows, so that what is computed from the bytes stays small."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, root): the smallest node reachable from each node of the undirected edges (a, b).

    Alternating large-star and small-star rounds over the edge list; each round is written to the shared folder, and
    the last is the one that leaves only stars. Edges are read twice, so they should come from a table. Nothing is
    gathered per node: minima are aggregated and joined back.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            both = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        joined = both.join(low, "a")
        if large:
            out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        return out.filter("a <> b").distinct()

    e = edges.select("a", "b").filter("a <> b")
    for turn in range(max_rounds):
        old, e = e, materialize(star(star(e, True), False), "star")
        if turn:
            drop(old)
        # settled: each node has one edge, and none that a node points to has an edge of its own
        ends = e.select(F.col("a").alias("node"), F.lit(1).alias("own"), F.lit(0).alias("met")).unionByName(e.select(F.col("b").alias("node"), F.lit(0).alias("own"), F.lit(1).alias("met")))
        if not ends.groupBy("node").agg(F.sum("own").alias("own"), F.max("met").alias("met")).filter("own + met > 1").count():
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
