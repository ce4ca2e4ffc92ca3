"""Chat formatting by perspective rotation, in DataFrame functions only.

For every participant of a conversation the dialogue is rendered with that speaker as the assistant, all others as named
users, and a mask of the spans (code points) that the assistant says. A system turn is rendered as such for everyone and
takes no part. Long conversations are rendered in parts of at most PART turns by their number, each with the place where
it begins in the whole. Texts are only ever grouped and joined by conversation and part; what is summed along a whole
conversation are the lengths of its parts.

Turns are ordered by number, then speaker, then text; rows that repeat are rendered once. Null text is empty; a null
speaker is the participant 'unknown', one with those named so; texts are taken as they are, also where they hold the marks
of a turn; rows without a conversation or turn number are left out. Extra columns are ignored.
An empty table gives an empty result.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, Window

#: Turn numbers in a part.
PART = 64
SYSTEM = "system"
_ROLE, _NAMED, _END = "<|im_start|>{}\n", "<|im_start|>user name=\n", "<|im_end|>\n"


def rotate(conversations: DataFrame, speaker: str = "role", part: int = PART) -> DataFrame:
    """(conv_id, speaker, part, start, text, mask): mask is 'from:to' of the speaker's own words within the part, comma-joined."""
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col(speaker), F.lit("unknown")).alias("who"), F.coalesce("text", F.lit("")).alias("text")
    ).filter("conv_id is not null and turn is not null")
    turns = turns.withColumn("part", F.floor(F.col("turn") / part))
    # the only shuffle of texts; what follows from lengths reads it again
    parts = turns.groupBy("conv_id", "part").agg(F.array_sort(F.collect_set(F.struct("turn", "who", "text"))).alias("turns"))
    said = parts.select("conv_id", "part", F.explode(F.transform("turns", lambda t: F.struct(t["who"].alias("who"), F.length(t["text"]).alias("length")))).alias("t")).select("conv_id", "part", "t.who", "t.length")
    people = said.filter(F.col("who") != SYSTEM).select("conv_id", F.col("who").alias("speaker")).distinct()

    # where each part begins, from lengths alone: as if all were named users, less what the speaker's own turns save
    named = F.when(F.col("who") == SYSTEM, len(_ROLE.format("system"))).otherwise(F.length("who") + len(_NAMED))
    sizes = said.groupBy("conv_id", "part", "who").agg(F.count("*").alias("n"), F.sum(F.col("length") + named + len(_END)).alias("size"))
    whole = sizes.groupBy("conv_id", "part").agg(F.sum("size").alias("whole"))
    own = sizes.filter(F.col("who") != SYSTEM).select("conv_id", "part", F.col("who").alias("speaker"), (F.col("n") * (F.length("who") + len(_NAMED) - len(_ROLE.format("assistant")))).alias("saved"))
    w = Window.partitionBy("conv_id", "speaker").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = whole.join(people, "conv_id").join(own, ["conv_id", "part", "speaker"], "left").withColumn("size", F.col("whole") - F.coalesce("saved", F.lit(0)))
    placed = placed.select("conv_id", "part", "speaker", F.coalesce(F.sum("size").over(w), F.lit(0)).alias("start"))

    def head(who):
        return F.when(who == F.col("speaker"), F.lit(_ROLE.format("assistant"))).when(who == SYSTEM, F.lit(_ROLE.format("system"))).otherwise(F.concat(F.lit(_NAMED[:-1]), who, F.lit("\n")))

    begin = F.struct(F.lit("").alias("text"), F.array().cast("array<string>").alias("mask"))

    def add(acc, t):
        at = F.length(acc["text"]) + F.length(head(t["who"]))
        span = F.concat_ws(":", at.cast("string"), (at + F.length(t["text"])).cast("string"))
        return F.struct(
            F.concat(acc["text"], head(t["who"]), t["text"], F.lit(_END)).alias("text"),
            F.when(t["who"] == F.col("speaker"), F.concat(acc["mask"], F.array(span))).otherwise(acc["mask"]).alias("mask"),
        )

    rendered = parts.join(placed, ["conv_id", "part"]).withColumn("r", F.aggregate("turns", begin, add))
    return rendered.select("conv_id", "speaker", "part", "start", F.col("r.text").alias("text"), F.array_join("r.mask", ",").alias("mask"))
