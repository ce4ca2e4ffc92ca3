"""Scope lifecycle in batch: one fold over a scope's turns in order. The streaming form is in hushframe.streaming."""

from __future__ import annotations

import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from ..plans.vocabulary import LIMITS


ADMITTED = "scope_id string, turn_count long, file_count long, cumulative_bytes long, cumulative_pages long, refused long, first_limit string"


def admitted(turns: DataFrame, limits: dict[str, int] = LIMITS) -> DataFrame:
    """turns (scope_id, at, turn_id, files, bytes, pages) per scope: a refused turn adds nothing, so the fold depends on order.

    Turns pass by in order of their scope and time; a task keeps one scope's counters and never its turns. Nulls count as 0."""
    number = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c)
    rows = turns.select(F.col("scope_id").cast("string").alias("scope_id"), "at", "turn_id", number("files"), number("bytes"), number("pages"))
    names = [x.split()[0] for x in ADMITTED.split(", ")]
    most = [limits[k] for k in ("turns", "files", "bytes", "pages")]

    def run(batches):
        scope, had, refused, first = None, False, 0, None
        sums = [0, 0, 0, 0]

        def said():
            return (scope, *sums, refused, first)

        for batch in batches:
            out = []
            for own, files, size, pages in zip(*(batch.column(c).to_pylist() for c in ("scope_id", "files", "bytes", "pages")), strict=True):
                if not had or own != scope:
                    if had:
                        out.append(said())
                    scope, had, refused, first, sums = own, True, 0, None, [0, 0, 0, 0]
                then = [sums[0] + 1, sums[1] + files, sums[2] + size, sums[3] + pages]
                over = next((name for name, x, limit in zip(("turns", "files", "bytes", "pages"), then, most, strict=True) if x > limit), None)
                if over:
                    refused, first = refused + 1, first or over
                else:
                    sums = then
            yield _batch(out, names)
        if had:
            yield _batch([said()], names)

    return rows.repartition("scope_id").sortWithinPartitions("scope_id", "at", "turn_id").mapInArrow(run, ADMITTED)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    types = [pa.string(), *[pa.int64()] * 5, pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


def expires(last: Column, created: Column, idle_seconds: int, absolute_seconds: int) -> Column:
    """The earlier of the idle and the absolute deadline; a scope is over at that instant."""
    return F.least(last + F.make_dt_interval(secs=F.lit(idle_seconds)), created + F.make_dt_interval(secs=F.lit(absolute_seconds)))
