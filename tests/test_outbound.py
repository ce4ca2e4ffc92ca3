"""Cases of claims, the guard, routing, the vault and scopes that tables seldom hold."""

import datetime

import pyspark.sql.functions as F
import pytest

from hushframe.operators import claims, decide, outbound, vault
from hushframe.plans.vocabulary import IMAGE_CLASSES

CLAIM = "array<struct<start:int,end:int,text:string,type:string,confidence:double>>"


def test_claims_count_only_where_they_stand(spark):
    said = [
        (0, 3, "Wei", "PERSON", 0.9),  # right, and there are two more places
        (9, 12, "Wei", "PERSON", 0.2),  # the same places again
        (0, 3, "Wei", "ORGANIZATION", 7.0),
        (5, 9, "nobody", "PERSON", 0.9), (0, 3, "Wei", "PHONE", 0.9), (0, 1, "W", "PERSON", 0.9), (0, 1, " W ", "PERSON", 0.9), (0, 600, "x" * 513, "PERSON", 0.9), (None, None, None, None, None),
    ]
    df = spark.createDataFrame([("Wei WeiWei 😀aaa", said), ("", []), (None, said[:1])], f"text string, claims {CLAIM}")
    got = [r.v for r in df.select(claims.verified(F.col("text"), F.col("claims")).alias("v")).collect()]
    assert [(s.start, s.end, s.type, s.confidence, s.relocated, s.raw) for s in got[0].spans] == [(a, a + 3, t, c, not (a == 0), "Wei") for a in (0, 4, 7) for t, c in (("PERSON", 0.9), ("ORGANIZATION", 1.0))]
    assert (got[0].rejected, got[0].relocated) == (6, 1)
    assert (got[1].spans, got[1].rejected) == ([], 0) and got[2].rejected == 1
    over = spark.createDataFrame([("ab" * 30, [(0, 2, "ab", "PERSON", 0.5), (0, 3, "bab", "PERSON", 0.5)])], f"text string, claims {CLAIM}")
    v = over.select(claims.verified(F.col("text"), F.col("claims")).alias("v")).first().v
    assert len(v.spans) == 40 and v.relocated == 1 and v.spans[1].start == 1
    found = over.select(claims.model_findings(claims.verified(F.col("text"), F.col("claims"))["spans"]).alias("f")).first().f
    assert {(f.source, f.rule_id, f.severity) for f in found} == {("local_model", "local_model_v1", 7)}


def test_guard_names_every_blocker_in_order(spark):
    schema = "request_id string, ordinal int, item_id string, inspected boolean, complete boolean, failure string, parsed boolean, fully boolean, findings int, action string, kind string, forwardable boolean, blocks boolean"
    rows = [
        ("r", 0, "a", True, True, None, True, True, 0, "PASS", "text", None, None),
        ("bad", 0, "a", None, True, None, True, True, 3, "PASS", "text", None, None),
        ("bad", 1, "b", True, None, "ocr", None, True, 0, "PASS", "text", None, None),
        ("bad", 2, "c", True, True, None, True, False, 2, None, "image", None, None),
        ("bad", 3, "d", True, True, None, True, True, 0, "BLOCK", "image", None, False),
        ("bad", 4, "e", True, True, None, True, True, 0, "PASS", "document", True, True),
    ]
    items = spark.createDataFrame(rows, schema)
    said = outbound.item_blockers(*(F.col(c) for c in ("item_id", "inspected", "complete", "failure", "parsed", "fully", "findings", "action", "kind", "forwardable", "blocks")))
    asked = spark.createDataFrame([("r", "CLEAN", True, "m", "p"), ("bad", "SANITIZED_LOCKED", False, "n", None), ("none", None, None, "m", "p")], "request_id string, privacy_mode string, usable boolean, model string, purpose string")
    got = {r.request_id: (r.allowed, r.blockers) for r in outbound.fast_path(asked, items.select("request_id", "ordinal", said.alias("blockers")), ["m"], ["p"]).collect()}
    assert got["r"] == (True, [])
    assert got["bad"] == (False, ["scope_sanitized_locked", "scope_not_usable", "missing_inspection:a", "incomplete_inspection:b", "inspection_error:b", "missing_parse:b", "partial_parse:c", "findings_present:c", "missing_decision:c", "non_pass_action:d", "bytes_not_forwardable:d", "bytes_not_forwardable:e", "model_not_allowed", "purpose_not_allowed"])
    assert got["none"] == (False, ["scope_sanitized_locked", "scope_not_usable"])  # nothing known about its scope


def test_routes(spark):
    rows = [
        ("block", "BLOCK", "text", "x", "y", None, False, False, False, False),
        ("pass", "PASS", "text", "[[PGW_x]] é", "y", None, False, False, False, False),
        ("token", "TOKENIZE", "text", "x", "y", None, False, False, False, False),
        ("conflict", "TOKENIZE", "text", "x", None, "span_conflict", False, False, False, False),
        ("image", "PASS", "image", "", "", None, True, True, True, False),
        ("dirty", "PASS", "image", "", "", None, True, False, True, False),
        ("doc", "PASS", "document", "t", "y", None, True, False, True, False),
        ("media", "PASS", "document", "t", "y", None, True, False, True, True),
        ("blank", "LOCAL_ANALYZE_TO_SANITIZED_TEXT", "image", " ", " \n", None, True, False, True, False),
        ("local", "LOCAL_ANALYZE_TO_SANITIZED_TEXT", "image", "w", "w", None, True, False, True, False),
        ("none", None, "text", "x", "y", None, False, False, False, False),
    ]
    df = spark.createDataFrame(rows, "id string, action string, kind string, text string, clean string, error string, data boolean, forwardable boolean, fully boolean, blocks boolean")
    r = outbound.routed(F.col("action"), F.col("kind"), F.col("text"), F.struct(F.col("clean").alias("text"), F.col("error").alias("error_code")), F.col("data"), F.col("forwardable"), F.col("fully"), F.col("blocks"))
    got = {x.id: (x.r.part, x.r.text, x.r.error_code) for x in df.select("id", r.alias("r")).collect()}
    assert got == {
        "block": (None, None, None), "pass": ("text", "((PGW_x)) é", None), "token": ("text", "y", None), "conflict": (None, None, "span_conflict"), "image": ("bytes", None, None), "dirty": (None, None, "bytes_not_forwardable"),
        "doc": ("bytes", None, None), "media": ("text", "t", None), "blank": (None, None, None), "local": ("text", "w", None), "none": (None, None, None),
    }
    parts = spark.createDataFrame([("r", 0, 1, "b", "text", "2"), ("r", 0, 0, "a", "bytes", None), ("r", 0, 2, "c", None, None)], "request_id string, message_index int, position int, item_id string, part string, text string")
    out = outbound.rebuilt(spark.createDataFrame([("r", 0, "user"), ("r", 1, "user")], "request_id string, message_index int, role string"), parts)
    seen = {x.message_index: [(p.item_id, p.kind, p.text, p.bytes) for p in x.v] for x in out.select("message_index", outbound.preview(F.col("parts"), F.create_map(F.lit("a"), F.lit(9))).alias("v")).collect()}
    assert seen == {0: [("a", "bytes", None, 9), ("b", "text", "2", None)], 1: []}


def test_decisions_of_classes_and_missing_inspections(spark):
    df = spark.createDataFrame([("ORDINARY_IMAGE", True), ("ID_DOCUMENT_IMAGE", True), ("CAT", True), (None, True), (None, None)], "c string, ok boolean")
    empty = F.array().cast("array<struct<action:string,reason_code:string>>")
    got = [(r.e.action, r.e.reasons) for r in df.select(decide.effective(empty, F.col("ok"), F.col("c")).alias("e")).collect()]
    assert got == [("PASS", ["content_class"]), ("LOCAL_ANALYZE_TO_SANITIZED_TEXT", ["content_class"]), ("BLOCK", ["content_class"]), ("PASS", ["no_findings"]), ("BLOCK", ["inspection_incomplete"])]
    order = ("ORDINARY_IMAGE", "SENSITIVE_IMAGE", "ID_DOCUMENT_IMAGE", "UNKNOWN_IMAGE")
    assert set(order) == set(IMAGE_CLASSES)
    pick = lambda a, b: spark.range(1).select(decide.stricter(F.lit(a), F.lit(b), order)).first()[0]
    assert pick("SENSITIVE_IMAGE", "ORDINARY_IMAGE") == "SENSITIVE_IMAGE" and pick("SENSITIVE_IMAGE", "UNKNOWN_IMAGE") == "UNKNOWN_IMAGE"


def test_vault_locks_once_and_refuses_whole_scopes(spark):
    at = lambda h: F.lit(datetime.datetime(2026, 1, 1, h))
    asked = spark.createDataFrame([("t", "a"), ("t", "b")], "tenant_id string, scope_id string").withColumn("policy_version", F.lit("v"))
    scopes = vault.created(asked, at(0), 7200, 36000).cache()
    schema = "tenant_id string, scope_id string, request_id string, entity_type string, digest string, token string, original string, policy_version string"
    pending = spark.createDataFrame([("t", "a", "r", "PHONE", "d1", "k1", "1", "v"), ("t", "a", "r", "PHONE", "d1", "k1", "1", "v"), ("t", "b", "r", "PHONE", "d1", "k2", "1", "v"), ("t", "b", "r", "PHONE", "d2", "k3", "2", "v"), ("u", "a", "r", "PHONE", "d1", "k4", "1", "v")], schema)
    empty = spark.createDataFrame([], "tenant_id string, scope_id string, request_id string, entity_type string, digest string, token string, sealed binary, policy_version string, created_at timestamp, expires_at timestamp")
    key = b"\1" * 32
    new, after, refused = vault.put_all_and_lock(empty, scopes, pending, at(1), 3600, key, {"mappings": 1})
    new = new.cache()
    assert [(r.scope_id, r.token) for r in new.collect()] == [("a", "k1")]
    assert {(r.tenant_id, r.scope_id): r.error_code for r in refused.collect()} == {("t", "b"): "scope_mapping_limit", ("u", "a"): "scope_not_found"}
    assert {r.scope_id: (r.privacy_mode, r.mapping_count) for r in after.collect()} == {"a": ("SANITIZED_LOCKED", 1), "b": ("CLEAN", 0)}
    again, later, _ = vault.put_all_and_lock(new, after, pending.filter("scope_id = 'a' and tenant_id = 't'"), at(1), 3600, key, {"mappings": 1})
    assert again.count() == 0 and {r.scope_id: r.mapping_count for r in later.collect()} == {"a": 1, "b": 0}
    wanted = spark.createDataFrame([("t", "a", "k1"), ("t", "a", "k9"), ("u", "a", "k1")], "tenant_id string, scope_id string, token string")
    open_at = lambda h, held=new, s=after, k=key: {(r.tenant_id, r.token): (r.original, r.error_code) for r in vault.resolve(held, s, wanted, at(h), k).collect()}
    assert open_at(1) == {("t", "k1"): ("1", None), ("t", "k9"): (None, None), ("u", "k1"): (None, None)}
    assert open_at(2)["t", "k1"] == (None, None)  # the mapping's time, and the scope's idle deadline
    assert open_at(1, k=b"\2" * 32)["t", "k1"] == (None, "decrypt_failed")
    said, state = vault.require_active(wanted.select("tenant_id", "scope_id").distinct(), after, at(3))
    assert {r.tenant_id: r.error_code for r in said.collect()} == {"t": "scope_expired", "u": "scope_not_found"} and {r.scope_id: r.status for r in state.collect()} == {"a": "EXPIRED", "b": "ACTIVE"}
    ended, left = vault.closed(state, new, wanted.select("tenant_id", "scope_id"))
    assert {r.scope_id: r.status for r in ended.collect()} == {"a": "CLOSED", "b": "ACTIVE"} and left.count() == 0
    assert vault.purged(new, at(1)).count() == 1 and vault.purged(new, at(2)).count() == 0
    ids = spark.range(3).select(vault.new_scope_id().alias("i")).collect()
    assert all(r.i.startswith("scp_") and len(r.i) == 36 for r in ids)


def test_policy_files(spark, tmp_path):
    import json

    import pytest

    from hushframe.plans.vocabulary import POLICY
    from hushframe.sources.policy import loaded

    good = tmp_path / "policy.json"
    good.write_text(json.dumps(POLICY))
    assert loaded(spark, str(good)) == POLICY
    for name, text, word in (("a", json.dumps({**POLICY, "extra": 1}), "key extra"), ("b", json.dumps({**POLICY, "entities": {"CAT": ["PASS", 0.5]}}), "entity CAT"), ("c", "{", "not JSON")):
        (tmp_path / name).write_text(text)
        with pytest.raises(ValueError, match=word):
            loaded(spark, str(tmp_path / name))


def test_leaks_and_uncovered_items(spark):
    items = spark.createDataFrame([("a",), ("b",), ("c",)], "item_id string")
    decisions = spark.createDataFrame([("a", "PASS"), ("b", "LOCAL_ONLY")], "item_id string, action string")
    assert {r.item_id: r.error_code for r in decide.leaks(items, decisions).collect()} == {"b": "withheld_in_outbound", "c": "no_decision"}
    assert [r.item_id for r in decide.uncovered(items, decisions).collect()] == ["c"]


def test_policies_in_yaml_say_the_same(spark, tmp_path):
    from hushframe.plans.vocabulary import POLICY
    from hushframe.sources.policy import loaded

    yaml = pytest.importorskip("yaml")
    rules = lambda x: {k: {"action": a, "minimum_confidence": c} if c else {"action": a} for k, (a, c) in x.items()}
    document = {
        "version": POLICY["version"], "defaults": POLICY["defaults"], "entities": rules(POLICY["entities"]), "content_classes": {k: {"action": a} for k, a in POLICY["content_classes"].items()},
        "purpose_overrides": {p: rules(x) for p, x in POLICY["purpose_overrides"].items()},
    }
    path = tmp_path / "policy.yaml"
    path.write_text(yaml.safe_dump(document))
    assert loaded(spark, str(path)) == POLICY
    for key, broken in (("PHONE", {"action": "PASS", "minimum": 1}), ("PHONE", "PASS"), ("PHONE", {"action": "FORGET"}), ("PHONE", {"action": "PASS", "minimum_confidence": True})):
        path.write_text(yaml.safe_dump(document | {"entities": rules(POLICY["entities"]) | {key: broken}}))
        with pytest.raises(ValueError, match="policy"):
            loaded(spark, str(path))
    for text in ("a: [", "- a", "version: !!python/object/apply:os.getcwd []"):
        path.write_text(text)
        with pytest.raises(ValueError, match="policy"):
            loaded(spark, str(path))
