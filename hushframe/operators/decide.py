"""Policy: one decision for each finding, image class and item; then the strictest for the item."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

from ..plans.vocabulary import ACTIONS, POLICY, checked_policy


def action_rank(action: Column) -> Column:
    return F.array_position(F.array(*(F.lit(a) for a in ACTIONS)), action).cast("int") - 1


def rules_table(spark: SparkSession, policy: dict = POLICY) -> DataFrame:
    """(purpose, entity_type, action, least, rule, reason): general rules have a null purpose. As long as the policy."""
    policy = checked_policy(policy)
    rows = [(None, e, a, c, f"entities.{e}", "entity_rule") for e, (a, c) in policy["entities"].items()]
    rows += [(p, e, a, c, f"purpose_overrides.{p}.{e}", "purpose_override") for p, x in policy.get("purpose_overrides", {}).items() for e, (a, c) in x.items()]
    return spark.createDataFrame(rows, "purpose string, entity_type string, action string, least double, rule string, reason string")


def decide(findings: DataFrame, purpose: Column, policy: dict = POLICY) -> DataFrame:
    """findings (.., entity_type, confidence) with action, policy_rule_id and reason_code: override, then entity rule, then the
    default for unknown types; below a rule's confidence the default for doubt. Both tables are broadcast: they are the policy."""
    spark = findings.sparkSession
    rules = rules_table(spark, policy)
    general = rules.filter("purpose is null").select("entity_type", *(F.col(c).alias(f"g_{c}") for c in ("action", "least", "rule", "reason")))
    special = rules.filter("purpose is not null").select("entity_type", F.col("purpose").alias("_purpose"), *(F.col(c).alias(f"s_{c}") for c in ("action", "least", "rule", "reason")))
    rows = findings.withColumn("_purpose", purpose).join(F.broadcast(general), "entity_type", "left").join(F.broadcast(special), ["entity_type", "_purpose"], "left")
    pick = lambda c: F.coalesce(F.col(f"s_{c}"), F.col(f"g_{c}"))
    low = F.col("confidence") < F.coalesce(pick("least"), F.lit(0.0))
    defaults = policy["defaults"]
    return rows.select(
        *findings.columns,
        F.when(low, defaults["low_confidence"]).otherwise(F.coalesce(pick("action"), F.lit(defaults["unknown_entity"]))).alias("action"),
        F.when(low, "defaults.low_confidence").otherwise(F.coalesce(pick("rule"), F.lit("defaults.unknown_entity"))).alias("policy_rule_id"),
        F.when(low, "low_confidence").otherwise(F.coalesce(pick("reason"), F.lit("unknown_entity"))).alias("reason_code"),
    )


def decided(findings: Column, purpose: Column, policy: dict = POLICY) -> Column:
    """The same for an array of findings within its item's row: each gets action, policy_rule_id and reason_code. The policy is
    a literal, as small as the policy; nothing is joined."""
    policy = checked_policy(policy)
    rule = lambda name, reason, a, c: F.struct(F.lit(a).alias("action"), F.lit(float(c)).alias("least"), F.lit(name).alias("rule"), F.lit(reason).alias("reason"))
    general = F.create_map(*(x for e, (a, c) in policy["entities"].items() for x in (F.lit(e), rule(f"entities.{e}", "entity_rule", a, c))))
    special = [(p, e, a, c) for p, rules in policy.get("purpose_overrides", {}).items() for e, (a, c) in rules.items()]
    overrides = F.create_map(*(x for p, e, a, c in special for x in (F.lit(f"{p}\x1f{e}"), rule(f"purpose_overrides.{p}.{e}", "purpose_override", a, c)))) if special else None
    defaults = policy["defaults"]

    def one(f):
        own = F.try_element_at(general, f["entity_type"])
        if overrides is not None:
            own = F.coalesce(F.try_element_at(overrides, F.concat_ws("\x1f", purpose, f["entity_type"])), own)
        own = F.coalesce(own, rule("defaults.unknown_entity", "unknown_entity", defaults["unknown_entity"], 0.0))
        own = F.when(f["confidence"] < own["least"], rule("defaults.low_confidence", "low_confidence", defaults["low_confidence"], 0.0)).otherwise(own)
        return f.withField("action", own["action"]).withField("policy_rule_id", own["rule"]).withField("reason_code", own["reason"])

    return F.transform(findings, one)


def class_action(image_class: Column, policy: dict = POLICY) -> Column:
    """The action for an image's class; a class the policy doesn't know is unsupported content. Null for items without a class."""
    known = F.create_map(*(F.lit(x) for pair in policy["content_classes"].items() for x in pair))
    return F.when(image_class.isNotNull(), F.coalesce(F.try_element_at(known, image_class), F.lit(policy["defaults"]["unsupported_content"])))


def effective(decided: Column, inspected: Column, image_class: Column | None = None, policy: dict = POLICY) -> Column:
    """struct<action, reasons> of an item: the strictest of its findings' actions and its class's; no findings pass, an item
    whose inspection failed or is missing (null) never does."""
    failed = ~F.coalesce(inspected, F.lit(False))
    ranks = F.transform(decided, lambda f: action_rank(f["action"]))
    of_class = F.lit(None).cast("string") if image_class is None else class_action(image_class, policy)
    rank = F.greatest(F.coalesce(F.array_max(ranks), F.lit(0)), F.coalesce(action_rank(of_class), F.lit(0)))
    reasons = F.concat(F.transform(decided, lambda f: f["reason_code"]), F.when(of_class.isNotNull(), F.array(F.lit("content_class"))).otherwise(F.array().cast("array<string>")))
    reasons = F.array_sort(F.array_distinct(reasons))
    return F.struct(
        F.when(failed, policy["defaults"]["detector_error"]).otherwise(F.element_at(F.array(*(F.lit(a) for a in ACTIONS)), rank + 1)).alias("action"),
        F.when(failed, F.array(F.lit("inspection_incomplete"))).when(F.size(reasons) == 0, F.array(F.lit("no_findings"))).otherwise(reasons).alias("reasons"),
    )


#: Actions whose items never leave.
WITHHOLDING = ("LOCAL_ONLY", "BLOCK")


def bundle(items: DataFrame, *keys: str) -> DataFrame:
    """items (keys, ordinal, item_id, action, reasons) as one decision for each request: strictest action, the reasons of the items
    that have it, counts by action, withheld ids sorted, forwardable ids in order, whether any item blocks, whether all pass."""
    rows = items.withColumn("_rank", action_rank(F.col("action")))
    held = F.col("action").isin(*WITHHOLDING)
    out = rows.groupBy(*keys).agg(
        F.max("_rank").alias("_rank"),
        F.collect_set(F.struct("_rank", "reasons")).alias("_reasons"),
        *(F.count_if(F.col("action") == a).alias(f"n_{a.lower()}") for a in ACTIONS),
        F.array_sort(F.collect_list(F.when(held, F.col("item_id")))).alias("withheld_ids"),
        F.array_sort(F.collect_list(F.when(~held, F.struct("ordinal", "item_id")))).alias("_forward"),
        F.bool_or(F.col("action") == "BLOCK").alias("any_block"),
        F.bool_and(F.col("action") == "PASS").alias("all_pass"),
    )
    top = F.filter("_reasons", lambda r: r["_rank"] == F.col("_rank"))
    return out.select(
        *keys,
        F.element_at(F.array(*(F.lit(a) for a in ACTIONS)), F.col("_rank") + 1).alias("effective_action"),
        F.array_sort(F.array_distinct(F.flatten(top["reasons"]))).alias("reason_codes"),
        *(f"n_{a.lower()}" for a in ACTIONS), "withheld_ids", F.col("_forward.item_id").alias("forwardable_ids"), "any_block", "all_pass",
    )


def stricter(a: Column, b: Column, order: tuple[str, ...]) -> Column:
    """The one that stands later in the order; the first on ties."""
    rank = lambda x: F.array_position(F.array(*(F.lit(o) for o in order)), x)
    return F.when(rank(b) > rank(a), b).otherwise(a)


def uncovered(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """Items that no decision names: must be empty."""
    return items.join(decisions.select("item_id").distinct(), "item_id", "left_anti")


def leaks(outbound: DataFrame, decisions: DataFrame) -> DataFrame:
    """Outbound items (item_id) that must not be there, with why: withheld by decision, or without any."""
    known = decisions.groupBy("item_id").agg(F.bool_or(F.col("action").isin(*WITHHOLDING)).alias("held"))
    return outbound.join(known, "item_id", "left").filter("held is null or held").select("item_id", F.when(F.col("held"), "withheld_in_outbound").otherwise("no_decision").alias("error_code"))


def item_decisions(items: DataFrame, decisions: DataFrame, inspected: Column, policy: dict = POLICY) -> DataFrame:
    """A row for each item (item_id, ..): strictest action and reasons; no findings pass, a failed inspection never does."""
    per = decisions.groupBy("item_id").agg(F.max(action_rank(F.col("action"))).alias("rank"), F.array_sort(F.collect_set("reason_code")).alias("reasons"), F.count("*").alias("n"))
    failed = ~inspected
    rank = F.when(failed, ACTIONS.index(policy["defaults"]["detector_error"])).otherwise(F.coalesce("rank", F.lit(0)))
    return items.join(per, "item_id", "left").select(
        *items.columns,
        F.element_at(F.array(*(F.lit(a) for a in ACTIONS)), rank + 1).alias("effective_action"),
        F.when(failed, F.array(F.lit("inspection_incomplete"))).otherwise(F.coalesce("reasons", F.array(F.lit("no_findings")))).alias("reason_codes"),
        F.coalesce("n", F.lit(0)).alias("n_findings"),
    )


def image_class(gps: Column, fields: Column, decoded: Column, ocr_ok: Column, ocr_text: Column, keywords: str, least: int = 12) -> Column:
    """The ordered rules of the deterministic image classifier."""
    return (
        F.when(~decoded, "UNKNOWN_IMAGE")
        .when(gps | (fields > 0), "SENSITIVE_IMAGE")
        .when(~ocr_ok, "UNKNOWN_IMAGE")
        .when(ocr_text.rlike(f"(?iu){keywords}"), "ID_DOCUMENT_IMAGE")
        .when(F.length(F.trim(ocr_text)) >= least, "SENSITIVE_IMAGE")
        .otherwise("ORDINARY_IMAGE")
    )


def strictest(decisions: DataFrame, *keys: str) -> DataFrame:
    return decisions.groupBy(*keys).agg(F.max_by("action", action_rank(F.col("action"))).alias("effective_action"))
