"""Requests as folders of files: <folder>/request_id=<id>/part=<name>/<any file>; the part `manifest` is the request's JSON.

Spark's own reader of binary files lists and reads them, from any store. The request's id is a partition of the folder: a filter on
it leaves other requests unlisted in the scan. Files are many and small: tasks list many requests' folders and read many files each."""

from __future__ import annotations

import os
import re
import shutil
import uuid
import zlib
from collections.abc import Iterator
from itertools import groupby
from urllib.parse import unquote, urlsplit

import pyarrow as pa
import pyspark.sql.functions as F
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from ..operators.requests import MOST_MANIFEST, normalized, parsed_manifest
from ..tables import deleted

_INFER = "spark.sql.sources.partitionColumnTypeInference.enabled"
#: Tasks that list folders, at most: Spark's default is one for each folder, up to 10,000.
_LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
MANIFEST = "manifest"


def _tasks(spark: SparkSession) -> int:
    """Tasks for work on many small files: Spark counts each as 4 MB, which makes a task of a few of them."""
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def parts(spark: SparkSession, folder: str) -> DataFrame:
    """(request_id, part, length, content); ids stay text, also those that look like numbers."""
    tasks = _tasks(spark)
    before = {k: spark.conf.get(k) for k in (_INFER, _LISTING)}
    spark.conf.set(_INFER, "false")
    spark.conf.set(_LISTING, str(min(tasks, int(before[_LISTING]))))
    try:
        rows = spark.read.format("binaryFile").option("basePath", folder).load(folder)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return rows.select("request_id", "part", "length", "content").coalesce(tasks)


def requests(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(manifests, files) of parts: request_id with parsed_manifest's columns, and (request_id, file_field, data). A manifest that is
    too long isn't parsed, one of several files of a request's manifest is an error, never a choice."""
    raw = F.when(F.col("length") <= MOST_MANIFEST, F.col("content").cast("string")).otherwise(F.repeat(F.lit(" "), MOST_MANIFEST + 1))
    found = rows.filter(F.col("part") == MANIFEST).groupBy("request_id").agg(F.count("*").alias("_n"), F.min(raw).alias("_raw"))
    said = found.select("request_id", "_n", parsed_manifest(F.col("_raw")).alias("m"))
    several = F.col("_n") > 1
    kept = [F.when(~several, F.col(f"m.{c}")).alias(c) for c in ("purpose", "model", "messages")]
    manifests = said.select("request_id", *kept, F.col("m.fields").alias("fields"), F.when(several, "manifest_twice").otherwise(F.col("m.error_code")).alias("error_code"))
    return manifests, rows.filter(F.col("part") != MANIFEST).select("request_id", F.col("part").alias("file_field"), F.col("content").alias("data"))


def items(manifests: DataFrame) -> DataFrame:
    """The items of good manifests."""
    return normalized(manifests.filter("error_code is null").select("request_id", "messages"))


def write_texts(rows: DataFrame, folder: str) -> None:
    """rows (request_id, part, value string) as such files; each ends with a newline.

    In a file system that executors see as theirs, tasks write the files themselves: Spark's writer starts processes for each file's
    permissions there, and moves all files one by one at the end. A file gets its name when it is whole, and a task that runs again
    writes the same names; a job that ends early may leave some of its files."""
    to, job = _local(folder), uuid.uuid4().hex
    if to is None:
        rows.write.partitionBy("request_id", "part").mode("append").text(folder)
        return
    os.makedirs(to, exist_ok=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"part-{TaskContext.get().partitionId():05d}-{job}.txt"
        cells = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for (request, part), lines in groupby(cells, lambda row: row[:2]):
            at = f"{to}/request_id={_escaped(request)}/part={_escaped(part)}"
            os.makedirs(at, exist_ok=True)
            hidden = f"{at}/.{name}-{uuid.uuid4().hex}"
            with open(hidden, "wb") as f:
                f.writelines((line[2] or "").encode() + b"\n" for line in lines)
            os.replace(hidden, f"{at}/{name}")
        yield from ()

    rows.select("request_id", "part", "value").sortWithinPartitions("request_id", "part").mapInArrow(run, "done int").write.format("noop").mode("overwrite").save()


def delete(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of requests; where executors see it as theirs, tasks delete the requests' folders."""
    to, n = _local(folder), _tasks(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = {i for batch in batches for i in batch.column(0).to_pylist()}
        for name in os.listdir(to):
            if zlib.crc32(name.encode("utf-8", "surrogateescape")) % n in mine:
                shutil.rmtree(f"{to}/{name}", ignore_errors=True)  # what is left, the driver deletes
        yield from ()

    if to is not None:
        spark.range(0, n, 1, n).mapInArrow(run, "done int").write.format("noop").mode("overwrite").save()
    deleted(spark, folder)


def _local(folder: str) -> str | None:
    """The path of a folder in a file system of the machines' own; null for other stores."""
    place = urlsplit(folder)
    return unquote(place.path) if place.scheme == "file" else folder if not place.scheme else None


def _escaped(value: str | None) -> str:
    """A partition's value as Spark writes it in a path."""
    return re.sub(r"[\x01-\x1f\"#%'*/:=?\\\x7f{\[\]^]", lambda m: f"%{ord(m[0]):02X}", value) if value else "__HIVE_DEFAULT_PARTITION__"
