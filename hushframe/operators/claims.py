"""A model's claims about a text, checked against the text itself: only what stands there counts, wherever the model said it stood."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column

from ..functions.spans import let, occurrences
from ..functions.text import strip
from ..plans.vocabulary import MODEL_TYPES, SEVERITY, SOURCES
from .detect import FINDING

#: Fixed limits of a claim: characters at most and (stripped) at least, places that are marked.
MOST_CLAIM, LEAST_CLAIM, MOST_PLACES = 512, 2, 20
MODEL_RULE = "local_model_v1"


def verified(text: Column, claims: Column) -> Column:
    """struct<spans, rejected, relocated> for claims array<struct<start, end, text, type, confidence>>.

    A claim counts if its type is one that models may give, its text is neither long nor short and stands in the text; all its
    places are marked, each once for each type. relocated: claims whose own offsets were wrong; of spans: not where the claim pointed."""
    cut = lambda a, b: F.substring(text, a + 1, b - a)

    def judge(c, i):
        good = c["type"].isin(*MODEL_TYPES) & (F.length(c["text"]) <= MOST_CLAIM) & (F.length(strip(c["text"])) >= LEAST_CLAIM)
        places = F.when(F.coalesce(good, F.lit(False)), occurrences(text, c["text"], MOST_PLACES)).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
        pointed = (c["start"] >= 0) & (c["end"] > c["start"]) & (c["end"] <= F.length(text)) & (cut(c["start"], c["end"]) == c["text"])
        return F.struct(i.alias("claim"), c["start"].alias("said"), c["type"].alias("type"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), c["confidence"])).alias("confidence"), F.coalesce(pointed, F.lit(False)).alias("pointed"), places.alias("places"))

    def result(judged):
        flat = F.flatten(F.transform(judged, lambda j: F.transform(j["places"], lambda p: F.struct(
            p["start"].alias("start"), (-p["end"]).alias("back"), j["type"].alias("type"), j["claim"].alias("claim"), j["confidence"].alias("confidence"), (~(j["pointed"] & (p["start"] == j["said"]))).alias("relocated"),
        ))))
        place = lambda x: F.struct(x["start"], x["back"], x["type"])
        first = let(F.array_sort(flat), lambda s: F.filter(s, lambda x, i: (i == 0) | (place(x) != place(F.try_element_at(s, i)))))
        # in order of place, longer first, then as they were claimed
        ordered = F.array_sort(F.transform(first, lambda x: F.struct(x["start"].alias("start"), x["back"].alias("back"), x["claim"].alias("claim"), x["type"].alias("type"), x["confidence"].alias("confidence"), x["relocated"].alias("relocated"))))
        spans = F.transform(ordered, lambda x: F.struct(x["start"].alias("start"), (-x["back"]).alias("end"), x["type"].alias("type"), x["confidence"].alias("confidence"), x["relocated"].alias("relocated"), cut(x["start"], -x["back"]).alias("raw")))
        found = F.filter(judged, lambda j: F.size(j["places"]) > 0)
        return F.struct(spans.alias("spans"), (F.size(judged) - F.size(found)).alias("rejected"), F.size(F.filter(found, lambda j: ~j["pointed"])).alias("relocated"))

    return let(F.transform(claims, judge), result)


def model_findings(spans: Column) -> Column:
    """Verified spans as findings, to be joined with those of the rules before the merge."""

    def one(s):
        severity = F.coalesce(F.nullif(F.array_position(F.array(*(F.lit(x) for x in SEVERITY)), s["type"]), F.lit(0)) - 1, F.lit(len(SEVERITY)))
        return F.struct(
            F.lit(SOURCES.index("local_model")).alias("source_rank"), severity.cast("int").alias("severity"), (s["start"] - s["end"]).alias("shorter"), (-s["confidence"]).alias("doubt"), s["start"].alias("start"), s["end"].alias("end"),
            F.lit(MODEL_RULE).alias("rule_id"), s["type"].alias("entity_type"), F.lit("local_model").alias("source"), s["confidence"].alias("confidence"), s["raw"].alias("raw"), F.array(F.lit(f"local_model:{MODEL_RULE}")).alias("trail"),
        ).cast(FINDING)

    return F.transform(spans, one)


def rendered(template: str, text: Column, document_type: Column) -> Column:
    """struct<system_prompt, user_prompt> of a template 'SYSTEM: .. USER: ..' with {{document_type}} and {{normalized_text}}."""
    system, _, user = template.partition("USER:")
    filled = F.replace(F.replace(F.lit(user), F.lit("{{document_type}}"), document_type), F.lit("{{normalized_text}}"), text)
    return F.struct(F.lit(system.replace("SYSTEM:", "", 1).strip()).alias("system_prompt"), strip(filled).alias("user_prompt"))
