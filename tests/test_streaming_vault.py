"""The vault as a stream against the vault as tables, over the same events, with a restart in between."""

import tempfile

import pyspark.sql.functions as F

from hushframe.functions.keyed import seal, unseal
from hushframe.operators import vault
from hushframe.streaming.vault import vault_stream
from hushframe.tables import ran

KEY = b"\x01" * 32
IDLE, WHOLE, TTL, LIMITS = 6 * 3600, 24 * 3600, 2 * 3600, {"mappings": 3}
S = "tenant_id string, scope_id string, at string, seq long, kind string, request_id string, entity_type string, digest string, token string, value string"


def event(scope, at, seq, kind, digest=None, request=None):
    return ("t", scope, f"2026-01-01 {at}", seq, kind, request, "EMAIL" if digest else None, digest, digest and f"T-{scope}-{digest}", digest and f"value {digest}")


def frame(spark, rows):
    bound = ("tenant_id", "scope_id", "token", "entity_type", "policy_version")
    df = spark.createDataFrame(rows, S).withColumn("at", F.col("at").cast("timestamp")).withColumn("policy_version", F.lit("v1"))
    sealed = F.when(F.col("kind") == "put", seal(F.col("value"), KEY, *(F.col(c) for c in bound)))
    return df.withColumn("sealed", sealed).drop("value")


def said(out):
    bound = ("tenant_id", "scope_id", "token", "entity_type", "policy_version")
    rows = out.withColumn("original", unseal(F.col("sealed"), KEY, *(F.col(c) for c in bound)))
    return {(r.scope_id, r.seq, r.digest if r.kind == "put" else r.token): r for r in rows.collect()}


def test_stream_equals_tables_across_a_restart(spark):
    scopes = [f"s{i}" for i in range(6)]  # s5 is never opened
    digests = {s: [f"d{j}" for j in range(i + 1)] for i, s in enumerate(scopes)}
    first = [event(s, "00:00:00", 0, "open") for s in scopes[:5]] + [event(s, "01:00:00", 1, "put", d, "r") for s in scopes for d in digests[s]]
    asked = [event(s, at, seq, "resolve", d) for at, seq in (("02:00:00", 5), ("02:45:00", 7), ("03:00:00", 8)) for s in scopes for d in digests[s]]
    then = asked + [event("s1", "02:30:00", 6, "close"), event("nobody", "02:30:00", 6, "close")]
    folder = "file://" + tempfile.mkdtemp(prefix="spark-")
    for rows in (first, then):
        frame(spark, rows).coalesce(1).write.mode("append").parquet(f"{folder}/events")
        events = spark.readStream.schema(frame(spark, first).schema).parquet(f"{folder}/events")
        out = ran(vault_stream(events, IDLE, WHOLE, TTL, LIMITS), f"{folder}/vault")
    got = said(out)

    time = lambda x: F.lit(f"2026-01-01 {x}").cast("timestamp")
    made = vault.created(spark.createDataFrame([("t", s, "v1") for s in scopes[:5]], "tenant_id string, scope_id string, policy_version string"), time("00:00:00"), IDLE, WHOLE)
    pending = spark.createDataFrame([("t", s, "r", "EMAIL", d, f"T-{s}-{d}", f"value {d}", "v1") for s in scopes for d in digests[s]], "tenant_id string, scope_id string, request_id string, entity_type string, digest string, token string, original string, policy_version string")
    empty = pending.limit(0).withColumns({"sealed": F.lit(b""), "created_at": time("00:00:00"), "expires_at": time("00:00:00")}).drop("original")
    held, after, refused = vault.put_all_and_lock(empty, made, pending, time("01:00:00"), TTL, KEY, LIMITS)
    held = held.cache()  # a nonce is drawn once
    assert {(r.scope_id, r.error_code) for r in refused.collect()} == {(k[0], r.error_code) for k, r in got.items() if r.kind == "put" and r.error_code}
    closed, left = vault.closed(after, held, spark.createDataFrame([("t", "s1"), ("t", "nobody")], "tenant_id string, scope_id string"))
    wanted = pending.select("tenant_id", "scope_id", "token")
    for at, seq, tables in (("02:00:00", 5, (held, after)), ("02:45:00", 7, (left, closed)), ("03:00:00", 8, (left, closed))):
        for r in vault.resolve(*tables, wanted, time(at), KEY).collect():
            assert got[r.scope_id, seq, r.token].original == r.original, (at, r)
    for r in closed.collect():
        mine = [x for k, x in got.items() if k[0] == r.scope_id and k[1] == 8][0]
        assert (mine.status, mine.privacy_mode, mine.mapping_count) == (r.status, r.privacy_mode, r.mapping_count)
    assert got["s5", 1, "d0"].error_code == "scope_not_found" and got["s4", 1, "d0"].error_code == "scope_mapping_limit"


def test_timers_expire_scopes_and_mappings(spark):
    """A scope that nothing meets again is ended by its timer once the watermark has passed, and says so; another's event moves it."""
    folder = "file://" + tempfile.mkdtemp(prefix="spark-")
    parts = [
        [event("a", "00:00:00", 0, "open"), event("a", "01:00:00", 1, "put", "d", "r"), event("b", "05:00:00", 2, "open"), event(None, "05:00:00", 2, None)],
        [event("b", "07:00:00", 3, "touch")],
        [event("b", "07:30:00", 4, "touch"), event("a", "07:30:00", 5, "put", "d", "r2"), event("a", "07:40:00", 6, "resolve", "d"), event("a", "07:50:00", 7, "touch"), event("a", "07:55:00", 8, "open")],
    ]
    for rows in parts:
        frame(spark, rows).coalesce(1).write.mode("append").parquet(f"{folder}/events")
        events = spark.readStream.schema(frame(spark, rows).schema).parquet(f"{folder}/events")
        out = ran(vault_stream(events, IDLE, WHOLE, TTL, LIMITS), f"{folder}/vault")
    rows = {(r.scope_id, r.kind, r.seq): r for r in out.collect()}
    ended = rows["a", "expired", -1]
    assert (ended.status, ended.privacy_mode, ended.mapping_count) == ("EXPIRED", "SANITIZED_LOCKED", 1)
    assert rows["b", "touch", 4].status == "ACTIVE" and rows[None, None, 2].error_code == "unknown_event"
    assert rows["a", "resolve", 6].sealed is None and rows["a", "touch", 7].error_code == "scope_expired" and rows["a", "open", 8].status == "EXPIRED"
