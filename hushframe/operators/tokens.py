"""Consistent tokens: one for each distinct value of a scope, kept in a vault table; and exact restoration.

A token's suffix is a keyed digest of its value's digest, so an item is sanitized in its own row, without a join, and every
job gives one value of a scope one token. The vault is what restoration needs; write it before any text that shows the tokens."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from ..functions.keyed import hmac_sha256, value_digest
from ..functions.spans import apply_edits, edits_error, find_all, marked_parts
from ..functions.text import TOKEN, canonical, canonical_of_normal, escape_token_like, keyed_token, nfkc_each
from .merge import disjoint_edits
from ..plans.vocabulary import ACTIONS

REDACTED = "[REDACTED]"
#: Fixed limits of a reply: characters, and substitutions.
MOST_OUTPUT, MOST_SUBSTITUTIONS = 500_000, 5_000


def minted(entity_type: Column, digest: Column, key: bytes) -> Column:
    return keyed_token(entity_type, hmac_sha256(F.concat(F.lit("token\x1f"), digest), key))


def with_tokens(items: DataFrame, findings: str, tenant: str, key: bytes) -> DataFrame:
    """items (scope_id, findings array with entity_type and raw): each finding also gets the digest of its value and its token."""
    normal = items.withColumn("_normal", nfkc_each(F.col(f"{findings}.raw")))

    def one(f, x):
        digest = value_digest(F.lit(tenant), F.col("scope_id"), f["entity_type"], canonical_of_normal(x, f["entity_type"]), key)
        return f.withField("digest", digest)

    named = normal.withColumn(findings, F.zip_with(findings, "_normal", one)).drop("_normal")
    return named.withColumn(findings, F.transform(findings, lambda f: f.withField("token", minted(f["entity_type"], f["digest"], key))))


def mappings(items: DataFrame, findings: str) -> DataFrame:
    """(scope_id, entity_type, digest, token, original) for each distinct TOKENIZE value; the original is its least spelling."""
    each = items.select("scope_id", F.explode(F.filter(findings, lambda f: f["action"] == "TOKENIZE")).alias("f"))
    return each.groupBy("scope_id", F.col("f.entity_type").alias("entity_type"), F.col("f.digest").alias("digest")).agg(F.min("f.token").alias("token"), F.min("f.raw").alias("original"))


def allocate(findings: DataFrame, tenant: str, key: bytes, vault: DataFrame | None = None) -> DataFrame:
    """New mappings (scope_id, entity_type, digest, token, original) for findings (scope_id, entity_type, raw): one for each digest
    that the vault lacks."""
    digest = value_digest(F.lit(tenant), F.col("scope_id"), F.col("entity_type"), canonical(F.col("raw"), F.col("entity_type")), key)
    distinct = findings.withColumn("digest", digest).groupBy("scope_id", "entity_type", "digest").agg(F.min("raw").alias("original"))
    if vault is not None:
        distinct = distinct.join(vault.select("scope_id", "entity_type", "digest"), ["scope_id", "entity_type", "digest"], "left_anti")
    return distinct.withColumn("token", minted(F.col("entity_type"), F.col("digest"), key))


def edits(findings: Column) -> Column:
    """Disjoint edits of TOKENIZE and REDACT findings: stricter, stronger, longer, earlier first."""
    rank = lambda f: F.array_position(F.array(*(F.lit(a) for a in ACTIONS)), f["action"]).cast("int") - 1
    made = F.transform(
        F.filter(findings, lambda f: f["action"].isin("TOKENIZE", "REDACT") & f["start"].isNotNull()),
        lambda f: F.struct(rank(f).alias("action_rank"), f["source_rank"].alias("source_rank"), f["start"].alias("start"), f["end"].alias("end"), F.when(f["action"] == "TOKENIZE", f["token"]).otherwise(REDACTED).alias("replacement")),
    )
    return disjoint_edits(made)


def sanitized(text: Column, findings: Column) -> Column:
    """struct<text, error_code>: what looks like a token is escaped first (its length stays), then spans are replaced. A span
    outside the text is an error; the text is null then."""
    made, escaped = edits(findings), escape_token_like(text)
    error = edits_error(text, made)
    return F.struct(F.when(error.isNull(), apply_edits(escaped, made)).alias("text"), error.alias("error_code"))


def restored(replies: DataFrame, vault: DataFrame) -> DataFrame:
    """replies (reply_id, scope_id, text) with restored_text, seen, restored, unknown and error_code: tokens the scope's vault holds
    become their originals; others stay as they are. Texts over MOST_OUTPUT or MOST_SUBSTITUTIONS are errors without text."""
    long = F.length("text") > MOST_OUTPUT
    # every second part is a token; only tokens and their numbers leave the row
    parts = F.when(long, F.array(F.lit(""))).otherwise(marked_parts(F.col("text"), TOKEN))
    listed = F.filter(F.transform(parts, lambda p, i: F.struct(i.alias("i"), p.alias("token"))), lambda x: x["i"] % 2 == 1)
    each = replies.select("reply_id", "scope_id", F.explode(listed).alias("t")).select("reply_id", "scope_id", "t.i", "t.token")
    found = each.join(vault.select("scope_id", "token", "original"), ["scope_id", "token"], "left")
    made = found.groupBy("reply_id").agg(
        F.count("*").alias("seen"), F.count("original").alias("restored"), F.array_sort(F.collect_list(F.struct("i", F.coalesce("original", "token").alias("said"))))["said"].alias("_said"),
    )
    none = F.lit(0).cast("long")
    error = F.when(long, "reply_too_long").when(F.col("restored") > MOST_SUBSTITUTIONS, "too_many_substitutions")
    out = replies.join(made, "reply_id", "left")
    put = F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 1, F.try_element_at("_said", (F.floor(i / 2) + 1).cast("int"))).otherwise(p)), "")
    # the parts' marks stand for themselves in such a text: its spans are cut one by one
    spans = F.zip_with(find_all(F.col("text"), TOKEN), "_said", lambda s, x: F.struct(s["start"], s["end"], x.alias("replacement")))
    whole = F.when(F.contains("text", F.lit("\x01")), apply_edits(F.col("text"), spans)).otherwise(put)
    return out.select(
        *replies.columns, F.when(error.isNull(), F.when(F.col("_said").isNull(), F.col("text")).otherwise(whole)).alias("restored_text"),
        F.coalesce("seen", none).alias("seen"), F.coalesce("restored", none).alias("restored"), (F.coalesce("seen", none) - F.coalesce("restored", none)).alias("unknown"), error.alias("error_code"),
    )


def restored_calls(calls: DataFrame, vault: DataFrame) -> DataFrame:
    """Tool calls (reply_id, scope_id, call_id, name, arguments) restored like texts: tokens in arguments are values for a function."""
    key = F.concat_ws("\x1f", F.col("reply_id").cast("string"), "call_id")
    rows = calls.select(key.alias("reply_id"), "scope_id", F.col("arguments").alias("text"), F.col("reply_id").alias("_reply"), "call_id", "name")
    return restored(rows, vault).select(F.col("_reply").alias("reply_id"), "call_id", "name", F.col("restored_text").alias("arguments"), "seen", "restored", "unknown", "error_code")


def unattributed(issued: Column, seen: Column) -> Column:
    """Tokens went out and none came back: nothing in the reply can be told to be about anyone."""
    return (F.size(issued) > 0) & (seen == 0)
