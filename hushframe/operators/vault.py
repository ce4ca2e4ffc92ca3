"""The vault and the scopes as tables: mappings are put, found, resolved and purged by joins and filters; scopes lock once.

mappings: tenant_id, scope_id, request_id, entity_type, digest, token, sealed, policy_version, created_at, expires_at.
scopes: tenant_id, scope_id, status, privacy_mode, mapping_count, created_at, last_active_at, idle_expires_at, absolute_expires_at.
Each function gives out the new state of its tables; a job writes them in the order scopes, mappings, outbound text.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from ..functions.keyed import seal, unseal
from ..plans.vocabulary import LIMITS

SCOPE, VALUE = ["tenant_id", "scope_id"], ["tenant_id", "scope_id", "entity_type", "digest"]
_BOUND = ("tenant_id", "scope_id", "token", "entity_type", "policy_version")


def put_all_and_lock(vault: DataFrame, scopes: DataFrame, pending: DataFrame, at: Column, ttl_seconds: int, key: bytes, limits: dict[str, int] = LIMITS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new mappings, scopes, refused) for pending (tenant_id, scope_id, request_id, entity_type, digest, token, original, policy_version).

    A digest that the vault has is not put again. Scopes with pending values become SANITIZED_LOCKED and count what is new; one
    that would pass its capacity, or doesn't exist, takes nothing: it is listed in refused (tenant_id, scope_id, error_code)."""
    one = pending.groupBy(*VALUE).agg(F.min(F.struct("request_id", "token", "original", "policy_version")).alias("p")).select(*VALUE, "p.*")
    new = one.join(vault.select(*VALUE), VALUE, "left_anti")
    asked = pending.select(*SCOPE).distinct()
    counts = new.groupBy(*SCOPE).agg(F.count("*").alias("_new"))
    sized = asked.join(counts, SCOPE, "left").join(scopes.select(*SCOPE, "mapping_count"), SCOPE, "left")
    added = F.coalesce("_new", F.lit(0))
    error = F.when(F.col("mapping_count").isNull(), "scope_not_found").when(F.col("mapping_count") + added > limits["mappings"], "scope_mapping_limit")
    judged = sized.select(*SCOPE, added.cast("long").alias("_new"), error.alias("error_code"))
    good = judged.filter("error_code is null")
    rows = new.join(good.select(*SCOPE), SCOPE, "left_semi").withColumn("created_at", at).withColumn("expires_at", at + F.make_dt_interval(secs=F.lit(ttl_seconds)))
    rows = rows.withColumn("sealed", seal(F.col("original"), key, *(F.col(c) for c in _BOUND)))
    locked = F.col("_new").isNotNull()
    after = scopes.join(good, SCOPE, "left").select(
        *(c for c in scopes.columns if c not in ("privacy_mode", "mapping_count", "last_active_at")),
        F.when(locked, "SANITIZED_LOCKED").otherwise(F.col("privacy_mode")).alias("privacy_mode"),
        (F.col("mapping_count") + F.coalesce("_new", F.lit(0))).alias("mapping_count"),
        F.when(locked, at).otherwise(F.col("last_active_at")).alias("last_active_at"),
    )
    columns = ["tenant_id", "scope_id", "request_id", "entity_type", "digest", "token", "sealed", "policy_version", "created_at", "expires_at"]
    return rows.select(*columns), after, judged.filter("error_code is not null").select(*SCOPE, "error_code")


def find_by_digest(vault: DataFrame, wanted: DataFrame, at: Column) -> DataFrame:
    """wanted (tenant_id, scope_id, entity_type, digest, ..) with the token of an unexpired mapping, or null."""
    return wanted.join(vault.filter(F.col("expires_at") > at).select(*VALUE, "token"), VALUE, "left")


def usable(at: Column) -> Column:
    """A scope's status and both deadlines allow use; it is over at the instant of a deadline."""
    return (F.col("status") == "ACTIVE") & (F.col("idle_expires_at") > at) & (F.col("absolute_expires_at") > at)


def resolve(vault: DataFrame, scopes: DataFrame, wanted: DataFrame, at: Column, key: bytes) -> DataFrame:
    """wanted (tenant_id, scope_id, token, ..) with original: null unless mapping and scope are live at that time.

    error_code is 'decrypt_failed' where a live mapping can't be opened: it is never skipped."""
    live = vault.filter(F.col("expires_at") > at).join(scopes.filter(usable(at)).select(*SCOPE), SCOPE, "left_semi")
    opened = live.select(*SCOPE, "token", F.lit(True).alias("_live"), unseal(F.col("sealed"), key, *(F.col(c) for c in _BOUND)).alias("original"))
    out = wanted.join(opened, [*SCOPE, "token"], "left")
    return out.withColumn("error_code", F.when(F.col("_live") & F.col("original").isNull(), "decrypt_failed")).drop("_live")


def purged(vault: DataFrame, at: Column) -> DataFrame:
    """Without mappings past their time."""
    return vault.filter(F.col("expires_at") > at)


def without_scopes(vault: DataFrame, ended: DataFrame) -> DataFrame:
    """Without the mappings of ended scopes (tenant_id, scope_id)."""
    return vault.join(ended.select(*SCOPE).distinct(), SCOPE, "left_anti")


def created(requests: DataFrame, at: Column, idle_seconds: int, absolute_seconds: int) -> DataFrame:
    """New scopes for requests (tenant_id, scope_id, policy_version): active, clean, both deadlines set, policy version pinned."""
    after = lambda n: at + F.make_dt_interval(secs=F.lit(n))
    none = F.lit(0).cast("long")
    return requests.select(
        *SCOPE, "policy_version", F.lit("ACTIVE").alias("status"), F.lit("CLEAN").alias("privacy_mode"), none.alias("mapping_count"), at.alias("created_at"), at.alias("last_active_at"),
        after(idle_seconds).alias("idle_expires_at"), after(absolute_seconds).alias("absolute_expires_at"),
    )


def new_scope_id() -> Column:
    """scp_ and 32 random hex digits; write it once, as it differs in every evaluation."""
    return F.concat(F.lit("scp_"), F.replace(F.uuid(), F.lit("-"), F.lit("")))


def touched(last: Column, absolute: Column, idle_seconds: int) -> Column:
    """The idle deadline after use: it never passes the absolute one."""
    return F.least(last + F.make_dt_interval(secs=F.lit(idle_seconds)), absolute)


def require_active(requests: DataFrame, scopes: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """(requests with error_code, scopes): not found (also where another tenant's), closed, or expired; a scope met past its deadline
    becomes EXPIRED. Drop the mappings of scopes that aren't ACTIVE with without_scopes."""
    state = scopes.select(*SCOPE, "status", usable(at).alias("_usable"))
    judged = requests.join(state, SCOPE, "left")
    error = F.when(F.col("status").isNull(), "scope_not_found").when(F.col("status") != "ACTIVE", "scope_closed").when(~F.col("_usable"), "scope_expired")
    met = requests.select(*SCOPE).distinct().withColumn("_met", F.lit(True))
    expired = F.col("_met") & (F.col("status") == "ACTIVE") & ~usable(at)
    after = scopes.join(met, SCOPE, "left").withColumn("status", F.when(expired, "EXPIRED").otherwise(F.col("status"))).select(*scopes.columns)
    return judged.select(*requests.columns, error.alias("error_code")), after


def closed(scopes: DataFrame, vault: DataFrame, closing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scopes, vault) after closing (tenant_id, scope_id): closed whatever they were, mappings gone at once; unknown ones do nothing."""
    ended = closing.select(*SCOPE).distinct()
    after = scopes.join(ended.withColumn("_end", F.lit(True)), SCOPE, "left").withColumn("status", F.when(F.col("_end"), "CLOSED").otherwise(F.col("status"))).select(*scopes.columns)
    return after, without_scopes(vault, ended)


def public_view(scopes: DataFrame) -> DataFrame:
    """What callers see of a scope: lower-case states, ISO times."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ssxxx").alias(c)
    return scopes.select("scope_id", F.lower("status").alias("status"), F.lower("privacy_mode").alias("privacy_mode"), iso("idle_expires_at"), iso("absolute_expires_at"))


def confirmed(vault: DataFrame, pending: DataFrame) -> DataFrame:
    """pending (tenant_id, scope_id, entity_type, digest, token, ..) with error_code after the write: null where the vault as it now is
    has exactly this token for the value; `mapping_lost` where it has none, or another job's was first. Text that shows such a
    token must not leave. Of several mappings of a value, the earliest counts, then the least token."""
    first = vault.groupBy(*VALUE).agg(F.min(F.struct("created_at", "token")).getField("token").alias("_held"))
    return pending.join(first, VALUE, "left").withColumn("error_code", F.when(~F.col("token").eqNullSafe(F.col("_held")), "mapping_lost")).drop("_held")


def settled(vault: DataFrame) -> DataFrame:
    """The vault with one mapping of each value, the one that confirmed() takes: for jobs that wrote at the same time."""
    order = Window.partitionBy(*VALUE).orderBy("created_at", "token")
    return vault.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def uniqueness_errors(vault: DataFrame, scopes: DataFrame) -> DataFrame:
    """(error_code, tenant_id, scope_id, n): what breaks a rule of uniqueness: a scope, a value of a scope, a token of a scope; and
    mappings whose scope doesn't exist. Empty if all hold."""
    twice = lambda rows, keys, code: rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").select(F.lit(code).alias("error_code"), *SCOPE, "n")
    orphans = vault.join(scopes.select(*SCOPE), SCOPE, "left_anti").groupBy(*SCOPE).agg(F.count("*").alias("n")).select(F.lit("mapping_without_scope").alias("error_code"), *SCOPE, "n")
    return twice(scopes, SCOPE, "scope_twice").unionByName(twice(vault, VALUE, "value_twice")).unionByName(twice(vault, [*SCOPE, "token"], "token_twice")).unionByName(orphans)
