"""Matches with code point positions, and arrays of spans. Spark gives no find-all with offsets: matches are marked, then split."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column

_MARK = "\x01"
SPAN = "array<struct<start:int,end:int>>"


def find_all(text: Column, pattern: str | Column, groups_before: int = 0) -> Column:
    """array<struct<start, end>> of every match. With groups_before = n the pattern is (1)..(n)(value) and spans are the value's.

    The pattern must not take U+0001 or U+0002; the former stands for the latter in the copy that is searched.
    """
    return placed(marked_parts(text, pattern, groups_before))


def marked_parts(text: Column, pattern: str | Column, groups_before: int = 0) -> Column:
    """text split at the ends of matches: every second part is one."""
    before = "".join(f"${i + 1}" for i in range(groups_before))
    value = f"${groups_before + 1}" if groups_before else "$0"
    clean = F.when(F.contains(text, F.lit(_MARK)), F.translate(text, _MARK, "\x02")).otherwise(text)
    return F.split(F.regexp_replace(clean, pattern, f"{before}{_MARK}{value}{_MARK}"), _MARK)


def placed(parts: Column) -> Column:
    """Spans of every second of the parts of a text."""
    sizes = F.transform(parts, lambda p: F.length(p))
    return let(sizes, lambda n: F.when(F.size(n) <= BLOCK, _placed(n, F.lit(0))).otherwise(_placed_by_blocks(n)))


#: Parts of a marked text that are placed together; an even number, so that every block begins outside a match.
BLOCK = 512


def let(value: Column, use) -> Column:
    """use(value) with the value computed once, also where use has it within a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _placed(sizes: Column, at: Column) -> Column:
    """Spans of every second of the sizes, from a place on."""
    start = F.struct(at.alias("at"), F.lit(False).alias("hit"), F.array().cast(SPAN).alias("found"))

    def step(acc, n):
        span = F.struct(acc["at"].alias("start"), (acc["at"] + n).alias("end"))
        found = F.when(acc["hit"], F.concat(acc["found"], F.array(span))).otherwise(acc["found"])
        return F.struct((acc["at"] + n).alias("at"), (~acc["hit"]).alias("hit"), found.cast(SPAN).alias("found"))

    return F.aggregate(sizes, start, step, lambda acc: acc["found"])


def _placed_by_blocks(sizes: Column) -> Column:
    """The same for many sizes: blocks get their places first, so that no long array is copied for each match."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / BLOCK).cast("int")), lambda i: F.slice(sizes, i * BLOCK + 1, F.lit(BLOCK)))

    def add(acc, block):
        whole = F.aggregate(block, F.lit(0), lambda a, n: a + n)
        return F.struct((acc["at"] + whole).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts"))

    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    return let(blocks, lambda b: F.flatten(F.zip_with(b, F.aggregate(b, none, add, lambda acc: acc["starts"]), _placed)).cast(SPAN))


def occurrences(text: Column, needle: Column, most: int = 20) -> Column:
    """Every place, overlapping ones too, where the needle stands: at most `most` spans."""
    n = F.length(needle)
    # zero-width matches before each occurrence: one pass, and overlapping ones are all seen
    quoted = F.concat(F.lit(r"(?=\Q"), F.replace(needle, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E)"))
    starts = F.slice(find_all(text, quoted), 1, most)
    return F.when(F.contains(text, needle) & (n > 0), F.transform(starts, lambda s: F.struct(s["start"].alias("start"), (s["start"] + n).alias("end")))).otherwise(F.array().cast(SPAN))


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


#: Edits that are put in place within one piece of the text: long texts aren't walked through from the front for each edit.
EDITS = 64


def apply_edits(text: Column, edits: Column) -> Column:
    """text with disjoint edits (start, end, replacement), in order of start, put in place."""

    def piece(e, i):
        """The text from the end of the edits before to the end of this block's, with the block's edits made."""
        block = F.slice(e, i * EDITS + 1, F.lit(EDITS))
        begin = F.when(i == 0, F.lit(0)).otherwise(F.try_element_at(e, i * EDITS)["end"])

        def made(b):
            own = _cut(text, begin, F.element_at(b, -1)["end"])
            return let(own, lambda seg: F.array_join(F.transform(b, lambda x, k: F.concat(_cut(seg, F.when(k == 0, F.lit(0)).otherwise(F.try_element_at(b, k)["end"] - begin), x["start"] - begin), x["replacement"])), ""))

        return let(block, made)

    def put(e):
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(e) - 1) / EDITS).cast("int")), lambda i: piece(e, i))
        last = F.try_element_at(e, F.lit(-1))["end"]
        return F.when(F.size(e) == 0, text).otherwise(F.concat(F.array_join(blocks, ""), F.substring(text, last + 1, F.length(text))))

    return let(edits, put)


def _cut(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, end - start)


def edits_error(text: Column, edits: Column) -> Column:
    """'span_conflict' if an edit lies outside the text, is empty or overlaps the one before; else null."""
    bad = lambda e: F.exists(F.transform(e, lambda x, i: (x["start"] < 0) | (x["end"] > F.length(text)) | (x["start"] >= x["end"]) | ((i > 0) & (F.coalesce(F.try_element_at(e, i)["end"], F.lit(0)) > x["start"]))), lambda b: b)
    return F.when(let(edits, bad), "span_conflict")


def span_error(start: Column, end: Column) -> Column:
    """A span has both ends or neither, begins at 0 or later and is not empty; else 'span_incoherent'."""
    return F.when(start.isNull() != end.isNull(), "span_incoherent").when((start < 0) | (end <= start), "span_incoherent")
