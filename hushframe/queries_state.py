"""Registered queries of the vault and of scopes as tables; restoration of tool calls; spans that hold together."""

from __future__ import annotations

import uuid

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, Window

from .functions import keyed
from .functions.spans import span_error
from .operators import tokens, vault
from .queries import _DECIDED_SQL, _VAULT_SQL, SEAL_KEY, TENANT, _query, _table, tokened_claims
from .streaming.vault import vault_stream as stream_vault
from .tables import ran, shared_dir, written

# ---- scopes from events: a user's scope is made at the first event and used at each --------------------------------
_IDLE, _WHOLE = 6 * 3600, 20 * 86400
_SCOPES_SQL = f"(select user_id::varchar as scope_id, min(ts) as created_at, max(ts) as last_at, least(max(ts) + interval {_IDLE} seconds, min(ts) + interval {_WHOLE} seconds) as idle, min(ts) + interval {_WHOLE} seconds as whole, count(*) as n from events group by user_id)"
_LAST_SQL = "(select max(ts) - interval 2 hours from events)"


def scopes(spark, sf_dir) -> DataFrame:
    """A scope for each user, as it stands after the user's last event; those of users with few events are closed."""
    users = _table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("scope_id")).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n"))
    new = vault.created(users.select(F.lit(TENANT).alias("tenant_id"), "scope_id", F.lit("v1").alias("policy_version"), "first"), F.col("first"), _IDLE, _WHOLE)
    used = new.join(users, "scope_id").withColumn("idle_expires_at", vault.touched(F.col("last"), F.col("absolute_expires_at"), _IDLE))
    return used.withColumn("status", F.when(F.col("n") < 5, "CLOSED").otherwise(F.col("status"))).select(*new.columns)


def _now(spark, sf_dir):
    """Two hours before the last event, as a value: the state is asked for as of then."""
    return F.lit(_table(spark, sf_dir, "events").agg((F.max("ts") - F.expr("interval 2 hours")).alias("at")).first()["at"])


_query("scope_touch", f"select scope_id, created_at, idle as idle_expires_at, whole as absolute_expires_at from {_SCOPES_SQL}")(lambda s, d: scopes(s, d).select("scope_id", "created_at", "idle_expires_at", "absolute_expires_at"))


@_query("scope_require_active", f"""select c_custkey::varchar as scope_id, case when n is null then 'scope_not_found' when n < 5 then 'scope_closed' when idle <= {_LAST_SQL} then 'scope_expired' end as error_code
    from customer left join {_SCOPES_SQL} on scope_id = c_custkey::varchar""")
def scope_require_active(spark, sf_dir):
    """Every customer asks for the scope of the user with that number."""
    asked = _table(spark, sf_dir, "customer").select(F.lit(TENANT).alias("tenant_id"), F.col("c_custkey").cast("string").alias("scope_id"))
    return vault.require_active(asked, scopes(spark, sf_dir), _now(spark, sf_dir))[0].select("scope_id", "error_code")


@_query("scope_expire", f"select scope_id, case when n < 5 then 'CLOSED' when c_custkey is not null and idle <= {_LAST_SQL} then 'EXPIRED' else 'ACTIVE' end as status from {_SCOPES_SQL} left join customer on scope_id = c_custkey::varchar")
def scope_expire(spark, sf_dir):
    asked = _table(spark, sf_dir, "customer").select(F.lit(TENANT).alias("tenant_id"), F.col("c_custkey").cast("string").alias("scope_id"))
    return vault.require_active(asked, scopes(spark, sf_dir), _now(spark, sf_dir))[1].select("scope_id", "status")


_query("scope_public_view", f"select scope_id, case when n < 5 then 'closed' else 'active' end as status, 'clean' as privacy_mode, strftime(idle, '%Y-%m-%dT%H:%M:%S') || '+00:00' as idle_expires_at, strftime(whole, '%Y-%m-%dT%H:%M:%S') || '+00:00' as absolute_expires_at from {_SCOPES_SQL}")(
    lambda s, d: vault.public_view(scopes(s, d))
)

# ---- the vault: claims' values put into the scopes of nations -------------------------------------------------------
_MOST = 180
#: A nation's scope; one that is closed, one that has no scope row, two that expire early.
_NATION_SCOPES = """(select n_nationkey::varchar as scope_id, case when n_nationkey = 3 then 'CLOSED' else 'ACTIVE' end as status, 'CLEAN' as privacy_mode, 0::bigint as mapping_count, timestamp '2026-01-01 00:00:00' as created_at,
    timestamp '2026-01-01 00:00:00' + to_hours((n_nationkey * 2)::int) as idle, timestamp '2026-01-03 00:00:00' as whole from nation where n_nationkey <> 7)"""
_PUT_SQL = f"(select v.*, count(*) over (partition by scope_id) as m from ({_VAULT_SQL}) v)"


def nation_scopes(spark, sf_dir) -> DataFrame:
    made = F.lit("2026-01-01 00:00:00").cast("timestamp")
    return _table(spark, sf_dir, "nation").filter("n_nationkey <> 7").select(
        F.lit(TENANT).alias("tenant_id"), F.col("n_nationkey").cast("string").alias("scope_id"), F.when(F.col("n_nationkey") == 3, "CLOSED").otherwise("ACTIVE").alias("status"), F.lit("CLEAN").alias("privacy_mode"), F.lit(0).cast("long").alias("mapping_count"),
        made.alias("created_at"), made.alias("last_active_at"), (made + F.make_dt_interval(hours=(F.col("n_nationkey") * 2).cast("int"))).alias("idle_expires_at"), F.lit("2026-01-03 00:00:00").cast("timestamp").alias("absolute_expires_at"),
    )


def put(spark, sf_dir):
    """(mappings, scopes, refused, pending) after the claims' values were put at 2026-01-01 01:00 with a life of a day."""
    pending = written(tokens.mappings(tokened_claims(spark, sf_dir), "f").select(F.lit(TENANT).alias("tenant_id"), "scope_id", F.lit("r").alias("request_id"), "entity_type", "digest", "token", "original", F.lit("v1").alias("policy_version")), "pending")
    held = nation_scopes(spark, sf_dir)
    empty = pending.limit(0).select("tenant_id", "scope_id", "request_id", "entity_type", "digest", "token", F.lit(b"").alias("sealed"), "policy_version", F.lit(None).cast("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("expires_at"))
    new, after, refused = vault.put_all_and_lock(empty, held, pending, F.lit("2026-01-01 01:00:00").cast("timestamp"), 86400, SEAL_KEY, {"mappings": _MOST})
    return written(new, "mappings"), after, refused, pending


_query("vault_put_all", f"select scope_id, entity_type, digest, token from {_PUT_SQL} where m <= {_MOST} and scope_id <> '7'")(lambda s, d: put(s, d)[0].select("scope_id", "entity_type", "digest", "token"))
_query("vault_lock_scopes", f"select s.scope_id, case when m <= {_MOST} then 'SANITIZED_LOCKED' else 'CLEAN' end as privacy_mode, case when m <= {_MOST} then m else 0 end::bigint as mapping_count from {_NATION_SCOPES} s left join (select distinct scope_id, m from {_PUT_SQL}) p on s.scope_id = p.scope_id")(
    lambda s, d: put(s, d)[1].select("scope_id", "privacy_mode", "mapping_count")
)
_query("vault_capacity", f"select distinct scope_id, case when scope_id = '7' then 'scope_not_found' else 'scope_mapping_limit' end as error_code from {_PUT_SQL} where scope_id = '7' or m > {_MOST}")(lambda s, d: put(s, d)[2].select("scope_id", "error_code"))


@_query("vault_resolve_join", f"""select v.scope_id, token, case when m <= {_MOST} and s.status = 'ACTIVE' and s.idle > timestamp '2026-01-01 12:00:00' then original end as original, null::varchar as error_code
    from {_PUT_SQL} v left join {_NATION_SCOPES} s on v.scope_id = s.scope_id""")
def vault_resolve_join(spark, sf_dir):
    """All tokens asked for at noon: mapping and scope must be live, or the token stays unknown."""
    held, after, _, pending = put(spark, sf_dir)
    return vault.resolve(held, after, pending.select("tenant_id", "scope_id", "token"), F.lit("2026-01-01 12:00:00").cast("timestamp"), SEAL_KEY).select("scope_id", "token", "original", "error_code")


@_query("vault_find_by_digest", f"select scope_id, digest, case when m <= {_MOST} and scope_id <> '7' then token end as token from {_PUT_SQL}")
def vault_find_by_digest(spark, sf_dir):
    held, _, _, pending = put(spark, sf_dir)
    return vault.find_by_digest(held, pending.select("tenant_id", "scope_id", "entity_type", "digest"), F.lit("2026-01-01 12:00:00").cast("timestamp")).select("scope_id", "digest", "token")


@_query("vault_close_and_purge", f"select scope_id, digest from {_PUT_SQL} where m <= {_MOST} and scope_id not in ('7', '3', '4', '5')")
def vault_close_and_purge(spark, sf_dir):
    """After closing three scopes; nothing has reached its time an hour before it, everything at it."""
    held, after, _, _ = put(spark, sf_dir)
    ended = after.filter("scope_id in ('3', '4', '5')").select("tenant_id", "scope_id")
    _, left = vault.closed(after, held, ended)
    at = lambda x: F.lit(f"2026-01-02 {x}:00").cast("timestamp")
    return vault.purged(left, at("00:00")).select("scope_id", "digest").unionByName(vault.purged(left, at("01:00")).select("scope_id", "digest"))


# ---- the same vault as a stream -------------------------------------------------------------------------------------
def _events(rows: DataFrame, at: str, seq: int, kind: str, **columns) -> DataFrame:
    """Events of one kind at one time of the day; what isn't given is null."""
    types = {"request_id": "string", "entity_type": "string", "digest": "string", "token": "string", "sealed": "binary", "policy_version": "string"}
    more = [columns.get(c, F.lit(None)).cast(t).alias(c) for c, t in types.items()]
    return rows.select(F.lit(TENANT).alias("tenant_id"), "scope_id", F.lit(f"2026-01-01 {at}").cast("timestamp").alias("at"), F.lit(seq).cast("long").alias("seq"), F.lit(kind).alias("kind"), *more)


@_query("vault_stream", f"""select hour, scope_id, token, case when hour = 10 and m <= {_MOST} and scope_id::int % 2 = 0 then original end as original,
    case when scope_id = '3' then 'CLOSED' when scope_id <> '7' then case when hour = 10 and scope_id::int % 2 = 0 then 'ACTIVE' else 'EXPIRED' end end as status, case when scope_id <> '7' then case when m <= {_MOST} then 'SANITIZED_LOCKED' else 'CLEAN' end end as privacy_mode
    from {_PUT_SQL}, (values (10), (12)) h(hour)""")
def vault_stream(spark, sf_dir):
    """The claims' values put into nations' scopes and asked for by a stream that is stopped and started in between: idle after six
    hours, some touched at five, one closed, one never opened."""
    pending = written(tokens.mappings(tokened_claims(spark, sf_dir), "f"), "pending")
    nations = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("scope_id"))
    version = F.lit("v1")
    bound = (F.lit(TENANT), F.col("scope_id"), F.col("token"), F.col("entity_type"), version)
    put_events = _events(pending, "01:00:00", 1, "put", request_id=F.lit("r"), entity_type=F.col("entity_type"), digest=F.col("digest"), token=F.col("token"), sealed=keyed.seal(F.col("original"), SEAL_KEY, *bound), policy_version=version)
    first = _events(nations.filter("scope_id <> '7'"), "00:00:00", 0, "open").unionByName(put_events)
    asked = [_events(pending, f"{hour}:00:00", seq, "resolve", token=F.col("token")) for hour, seq in ((10, 4), (12, 5))]
    then = _events(nations.filter("scope_id % 2 = 0"), "05:00:00", 2, "touch").unionByName(_events(nations.filter("scope_id = '3'"), "05:30:00", 3, "close")).unionByName(asked[0]).unionByName(asked[1])
    folder = f"{shared_dir(spark)}/hushframe/{uuid.uuid4().hex}-vault-stream"
    for rows in (first, then):
        rows.write.mode("append").parquet(f"{folder}/events")
        events = spark.readStream.schema(first.schema).parquet(f"{folder}/events")
        out = ran(stream_vault(events, 6 * 3600, 86400, 86400, {"mappings": _MOST}), f"{folder}/vault")
    said = (F.lit(TENANT), F.col("scope_id"), F.col("token"), F.col("entity_type"), F.col("policy_version"))
    return out.filter("kind = 'resolve'").select(F.hour("at").alias("hour"), "scope_id", "token", keyed.unseal(F.col("sealed"), SEAL_KEY, *said).alias("original"), "status", "privacy_mode")


# ---- restoration of calls and of replies that name nobody -----------------------------------------------------------
@_query("restore_calls", f"""select item_id as reply_id, count(*) filter (where action = 'TOKENIZE') as restored, not bool_or(action = 'REDACT') as same from ({_DECIDED_SQL}) group by item_id""")
def restore_calls(spark, sf_dir):
    """The sanitized claims come back as arguments of a call."""
    rows = written(tokened_claims(spark, sf_dir), "tokened")
    calls = rows.select(F.col("item_id").alias("reply_id"), "scope_id", F.lit("c1").alias("call_id"), F.lit("find").alias("name"), tokens.sanitized(F.col("text"), F.col("f"))["text"].alias("arguments"))
    out = tokens.restored_calls(calls, tokens.mappings(rows, "f"))
    return out.join(rows.select(F.col("item_id").alias("reply_id"), "text"), "reply_id").select("reply_id", "restored", (F.col("arguments") == F.col("text")).alias("same"))


_query("unattributed_reply", f"select item_id, count(*) filter (where action = 'TOKENIZE') > 0 and item_id % 3 = 0 as unattributed from ({_DECIDED_SQL}) group by item_id")(
    lambda s, d: tokened_claims(s, d).select("item_id", tokens.unattributed(F.filter("f", lambda f: f["action"] == "TOKENIZE"), F.when(F.col("item_id") % 3 == 0, 0).otherwise(1)).alias("unattributed"))
)
_query("span_coherence", "select l_orderkey, l_linenumber, case when l_quantity::int <= l_linenumber * 4 then 'span_incoherent' end as error_code from lineitem")(
    lambda s, d: _table(s, d, "lineitem").select("l_orderkey", "l_linenumber", span_error(F.col("l_linenumber") * 4, F.col("l_quantity").cast("int")).alias("error_code"))
)
