"""Sinks for what leaves: outbound requests, audit lines, counters. Only listed columns are ever written, and each request once.

A batch is one folder, written over when the batch is replayed; requests that an earlier batch holds are left out, so that a new
checkpoint, or a source that gives rows again, doesn't send them twice. Both need only what is in the folder."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions.spans import let
from ..functions.text import TOKEN

#: Fixed lists of what may leave.
OUTBOUND = ("request_id", "scope_id", "text")
AUDIT = ("request_id", "item_id", "rule_id", "entity_type", "source", "confidence", "span_length", "fingerprint", "action", "reason_code")


def _there(folder: str, spark) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def write_once(rows: DataFrame, folder: str, batch_id: int, columns: tuple[str, ...] = OUTBOUND, key: tuple[str, ...] = ("request_id",)) -> None:
    """rows' listed columns as folder/batch=<batch_id>. Of rows with one key one is written, unless an earlier batch has it."""
    missing = [c for c in (*columns, *key) if c not in rows.columns]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    spark = rows.sparkSession
    new = rows.select(*columns).dropDuplicates([*key])
    if _there(folder, spark):
        schema = StructType([rows.schema[c] for c in columns]).add("batch", "long")
        before = spark.read.schema(schema).parquet(folder).filter(F.col("batch") != batch_id).select(*key).distinct()
        new = new.join(before, [*key], "left_anti")
    new.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")


def deliver(stream: DataFrame, folder: str, checkpoint: str, columns: tuple[str, ...] = OUTBOUND, key: tuple[str, ...] = ("request_id",)) -> StreamingQuery:
    """A started query that writes each micro-batch once, for all that its source holds now."""
    return stream.writeStream.foreachBatch(lambda batch, number: write_once(batch, folder, number, columns, key)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def delivered(spark, folder: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(folder)


def echoed(text: Column) -> Column:
    """A provider for tests: its reply names every token of the request once, in order."""
    return let(F.array_distinct(F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1))), lambda t: F.when(F.size(t) > 0, F.concat(F.lit("About "), F.array_join(t, ", "), F.lit("."))).otherwise("Nothing."))
