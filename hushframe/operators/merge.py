"""Evidence merge: findings of one item to disjoint ones, strongest first. One row is one item, so nothing is shuffled.

A sweep over the findings by start cuts them into clusters: a cluster ends where nothing before reaches the next start. Findings
of different clusters can't overlap, so the greedy fold runs inside each cluster only, and an item of many findings costs about
as much for each as one of few.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column

from ..functions.spans import let, overlaps
from .detect import FINDING

#: Findings that the sweep takes together: what it gathers is copied for each finding within a block, never for the whole item.
BLOCK = 256


def _clusters(findings: Column) -> Column:
    """Findings with a span as array<array<FINDING>>: by start, cut where no earlier one reaches the next."""

    def blocks(s):
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / BLOCK).cast("int")), lambda i: F.slice(s, i * BLOCK + 1, F.lit(BLOCK)))

    def reaches(b):
        """How far all blocks before each one reach."""
        tops = F.transform(b, lambda x: F.array_max(F.transform(x, lambda f: f["end"])))
        start = F.struct(F.lit(0).alias("reach"), F.array().cast("array<int>").alias("before"))
        return F.aggregate(tops, start, lambda acc, top: F.struct(F.greatest(acc["reach"], top).alias("reach"), F.concat(acc["before"], F.array(acc["reach"])).alias("before")), lambda acc: acc["before"])

    def breaks(block, reach, number):
        """Places, from 1, of the findings of a block that begin a cluster."""
        start = F.struct((number * BLOCK + 1).cast("int").alias("at"), reach.alias("reach"), F.array().cast("array<int>").alias("found"))

        def step(acc, f):
            found = F.when(f["start"] >= acc["reach"], F.concat(acc["found"], F.array(acc["at"]))).otherwise(acc["found"])
            return F.struct((acc["at"] + 1).alias("at"), F.greatest(acc["reach"], f["end"]).alias("reach"), found.alias("found"))

        return F.aggregate(block, start, step, lambda acc: acc["found"])

    def cut(s):
        each = let(blocks(s), lambda b: let(reaches(b), lambda r: F.flatten(F.transform(b, lambda x, i: breaks(x, F.element_at(r, i + 1), i)))))
        return let(each, lambda at: F.transform(at, lambda a, i: F.slice(s, a, F.coalesce(F.try_element_at(at, i + 2), F.size(s) + 1) - a)))

    # the sort key comes first, so that no comparison is interpreted
    by_start = F.transform(F.array_sort(F.transform(findings, lambda f: F.struct(f["start"].alias("start"), f.alias("f")))), lambda x: x["f"])
    return let(by_start, lambda s: F.when(F.size(s) > 0, cut(s)))


def _folded(cluster: Column) -> Column:
    """The greedy fold, in order of evidence; the kept ones in order of place."""
    none = F.array().cast(f"array<{FINDING}>")

    def step(kept, c):
        def absorb(k, i, at):
            stricter = c["severity"] < k["severity"]
            out = k.withField("trail", F.concat(k["trail"], c["trail"]))
            out = out.withField("entity_type", F.when(stricter, c["entity_type"]).otherwise(k["entity_type"]))
            out = out.withField("confidence", F.when(stricter, F.greatest(k["confidence"], c["confidence"])).otherwise(k["confidence"]))
            out = out.withField("severity", F.least(k["severity"], c["severity"]))
            return F.when(i + 1 == at, out).otherwise(k)

        at = F.array_position(F.transform(kept, lambda k: overlaps(k, c)), True)
        return let(at, lambda at: F.when(at == 0, F.concat(kept, F.array(c))).otherwise(F.transform(kept, lambda k, i: absorb(k, i, at)))).cast(f"array<{FINDING}>")

    kept = F.aggregate(F.array_sort(cluster), none, step)
    placed = F.transform(F.array_sort(F.transform(kept, lambda k: F.struct(k["start"].alias("start"), k.alias("k")))), lambda x: x["k"])
    return F.when(F.size(cluster) == 1, cluster).otherwise(placed)


def merged(findings: Column) -> Column:
    """Greedy in order of evidence. A finding that overlaps a kept one is absorbed by the first such: it adds to its trail, and
    gives it type and greater confidence if it is more severe. The kept span stays. The result is in order of place; findings of the
    whole item, without a span, take no part and follow as they came. Findings are computed once."""

    def of(all_):
        spanless = lambda f: f["start"].isNull() | f["end"].isNull()
        placed = F.flatten(F.transform(_clusters(F.filter(all_, lambda f: ~spanless(f))), _folded))
        return F.when(F.size(all_) == 0, all_).otherwise(F.concat(F.coalesce(placed, F.array().cast(f"array<{FINDING}>")), F.filter(all_, spanless)))

    return let(findings, of)


def disjoint_edits(edits: Column) -> Column:
    """Edits (action_rank, source_rank, start, end, replacement) without overlaps: stricter, then stronger, longer, earlier first."""
    kind = "array<struct<strict:int,source_rank:int,shorter:int,start:int,end:int,replacement:string>>"
    keyed = F.transform(edits, lambda e: F.struct((-e["action_rank"]).cast("int").alias("strict"), e["source_rank"].cast("int").alias("source_rank"), (e["start"] - e["end"]).cast("int").alias("shorter"), e["start"].cast("int").alias("start"), e["end"].cast("int").alias("end"), e["replacement"].alias("replacement")))
    kept = F.aggregate(F.array_sort(keyed), F.array().cast(kind), lambda k, e: F.when(F.exists(k, lambda x: overlaps(x, e)), k).otherwise(F.concat(k, F.array(e))).cast(kind))
    return F.array_sort(kept, lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0))
