"""A policy read from where Spark's readers reach: one JSON or YAML document, checked before anything is decided by it."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from ..plans.vocabulary import checked_policy


def _document(text: str, path: str):
    if path.endswith((".yaml", ".yml")):
        import yaml  # only policies in this form need it

        try:
            return yaml.safe_load(text)
        except yaml.YAMLError as e:
            raise ValueError("policy: not YAML") from e
    try:
        return json.loads(text)
    except json.JSONDecodeError as e:
        raise ValueError(f"policy: not JSON: {e.msg}") from e


def _rule(name: str, rule) -> tuple[str, float]:
    """[action, least] or {action, minimum_confidence}, of which the latter may be missing; nothing else."""
    if isinstance(rule, dict) and "action" in rule and set(rule) <= {"action", "minimum_confidence"}:
        rule = [rule["action"], rule.get("minimum_confidence", 0.0)]
    if not isinstance(rule, list) or len(rule) != 2 or isinstance(rule[1], bool) or not isinstance(rule[1], (int, float)):
        raise ValueError(f"policy: rule {name}")
    return str(rule[0]), float(rule[1])


def loaded(spark: SparkSession, path: str) -> dict:
    """The policy in a file of the form {version, defaults, entities: {type: rule}, content_classes: {class: action or {action}},
    purpose_overrides: {purpose: {type: rule}}}, where a rule is [action, least] or {action, minimum_confidence}; a ValueError names
    what is wrong with it, an unknown key included."""
    policy = _document(spark.read.text(path, wholetext=True).first().value, path)
    if not isinstance(policy, dict):
        raise ValueError("policy: not a table of keys")
    pairs = lambda rules: {k: _rule(k, v) for k, v in (rules or {}).items()}
    policy["entities"] = pairs(policy.get("entities"))
    policy["purpose_overrides"] = {p: pairs(rules) for p, rules in (policy.get("purpose_overrides") or {}).items()}
    policy["content_classes"] = {k: v["action"] if isinstance(v, dict) and set(v) == {"action"} else v for k, v in (policy.get("content_classes") or {}).items()}
    return checked_policy(policy)
