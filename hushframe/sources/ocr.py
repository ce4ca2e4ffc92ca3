"""Answers of text recognition, in either of two layouts, as one: lines in order with their confidence.

An answer is JSON: an object of parallel `txts` and `scores`, or rows [place, text, score], alone or followed by the time they
took; no rows at all may be null. An object may say `"complete": false`. It is read as VARIANT, by the shape that it has."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column

from ..functions.spans import let

LINES = "array<struct<text:string,confidence:double>>"


def _listed(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _is_list(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("")).startswith("ARRAY")


def _parallel(v: Column) -> Column:
    """As many lines as the shorter list has; without scores all are 0."""
    line = lambda t, s: F.struct(t.alias("text"), F.coalesce(s, F.lit(0.0)).alias("confidence"))
    texts = F.coalesce(F.try_variant_get(v, "$.txts", "array<string>"), F.array().cast("array<string>"))
    scores = F.coalesce(F.try_variant_get(v, "$.scores", "array<double>"), F.array().cast("array<double>"))
    both = let(texts, lambda t: let(scores, lambda s: F.zip_with(F.slice(t, F.lit(1), F.when(F.size(s) == 0, F.size(t)).otherwise(F.least(F.size(t), F.size(s)))), F.slice(s, F.lit(1), F.size(t)), line)))
    return both.cast(LINES)


def _rowwise(v: Column) -> Column:
    """Rows of at least three cells; a list of rows may stand first in a pair."""

    def rows(cells):
        timed = (F.size(cells) == 2) & ~_is_list(F.try_element_at(cells, F.lit(2)))
        return F.coalesce(F.when(timed, _listed(cells[0])).otherwise(cells), F.array().cast("array<variant>"))

    def line(row):
        return let(F.coalesce(_listed(row), F.array().cast("array<variant>")), lambda c: F.when(F.size(c) >= 3, F.array(F.struct(F.try_variant_get(F.try_element_at(c, F.lit(2)), "$", "string").alias("text"), F.coalesce(F.try_variant_get(F.try_element_at(c, F.lit(3)), "$", "double"), F.lit(0.0)).alias("confidence")))).otherwise(F.array()).cast(LINES))

    return let(F.coalesce(_listed(v), F.array().cast("array<variant>")), lambda cells: F.flatten(F.transform(rows(cells), line))).cast(LINES)


def recognized(answer: Column) -> Column:
    """struct<lines, text, mean_confidence, complete, error_code>: text is the lines below each other, the mean is 0 without any. What
    isn't an answer is `ocr_unreadable` and incomplete, never an empty text; so is null, as `ocr_unavailable`."""

    def of(v):
        shape = F.coalesce(F.schema_of_variant(v), F.lit(""))
        lines = F.when(shape.startswith("OBJECT"), _parallel(v)).otherwise(_rowwise(v))
        known = shape.startswith("ARRAY") | shape.startswith("OBJECT") | (shape == "VOID")
        error = F.when(answer.isNull(), "ocr_unavailable").when(v.isNull() | ~known, "ocr_unreadable")
        said = F.coalesce(F.try_variant_get(v, "$.complete", "boolean"), F.lit(True))
        mean = lambda x: F.when(F.size(x) == 0, F.lit(0.0)).otherwise(F.aggregate(x, F.lit(0.0), lambda a, y: a + y["confidence"]) / F.size(x))
        return let(F.when(error.isNull(), lines), lambda x: F.struct(x.alias("lines"), F.array_join(x["text"], "\n").alias("text"), F.when(error.isNull(), mean(x)).alias("mean_confidence"), (error.isNull() & said).alias("complete"), error.alias("error_code")))

    return let(F.try_parse_json(answer), of)
