"""Requests and replies: manifests flattened to items, model payloads and provider replies parsed strictly. Errors are a column."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from ..sources.binary import mime_error, sniffed

#: The keys of a claimed entity, claims in a payload at most, characters of a reply at most.
CLAIM_KEYS = ("confidence", "end", "start", "text", "type")
MOST_CLAIMS, MOST_REPLY = 200, 500_000


def normalized(manifests: DataFrame) -> DataFrame:
    """manifests (request_id, messages array<struct<role, content array<struct<type, item_id, text, file_field>>>>) -> a row for
    each item: request_id, message_index, position, role, type, item_id, text, file_field, byte_size, error_code."""
    messages = manifests.select("request_id", F.posexplode("messages").alias("message_index", "m"))
    rows = messages.select("request_id", "message_index", F.col("m.role").alias("role"), F.posexplode("m.content").alias("position", "item")).select("request_id", "message_index", "position", "role", "item.*")
    error = (
        F.when(F.count("*").over(Window.partitionBy("request_id", "item_id")) > 1, "duplicate_item_id")
        .when(~F.coalesce("item_id", F.lit("")).rlike(r"^[A-Za-z0-9._:\-]{1,128}\z"), "invalid_item_id")
        .when((F.col("type") == "text") & (F.coalesce("text", F.lit("")) == ""), "text_required")
        .when((F.col("type") != "text") & F.col("file_field").isNull(), "file_required")
    )
    return rows.withColumn("byte_size", F.octet_length("text")).withColumn("error_code", error)


def parsed_claims(payload: Column) -> Column:
    """struct<claims, error_code> of a model's payload: one object whose only key is entities, of members with CLAIM_KEYS and no
    other; a code fence around it is dropped. Anything else is an error, never an empty result."""
    bare = F.regexp_replace(F.trim(payload), r"^```(?:json)?\s*|\s*```\z", "")
    keys = F.json_object_keys(bare)
    members = F.from_json(bare, "struct<entities:array<map<string,string>>>")["entities"]
    claim = lambda m: F.struct(
        m["start"].try_cast("int").alias("start"), m["end"].try_cast("int").alias("end"), m["text"].alias("text"), m["type"].alias("type"), m["confidence"].try_cast("double").alias("confidence")
    )
    claims = F.transform(members, claim)
    named = F.forall(members, lambda m: F.array_sort(F.map_keys(m)) == F.array(*(F.lit(k) for k in CLAIM_KEYS)))
    typed = F.forall(claims, lambda c: c["start"].isNotNull() & c["end"].isNotNull() & c["text"].isNotNull() & c["type"].isNotNull() & c["confidence"].isNotNull())
    error = (
        F.when(F.coalesce(F.trim(payload), F.lit("")) == "", "model_no_payload")
        .when(keys.isNull() | (keys != F.array(F.lit("entities"))) | members.isNull(), "model_bad_payload")
        .when(F.size(members) > MOST_CLAIMS, "model_too_many")
        .when(~F.coalesce(named & typed, F.lit(False)), "model_bad_claim")
    )
    return F.struct(F.when(error.isNull(), claims).alias("claims"), error.alias("error_code"))


def parsed_reply(body: Column) -> Column:
    """struct<text, n_tool_calls, finish_reason, error_code> of a provider's reply: content is a string or parts of text; a reply
    without text is an error unless it calls tools."""
    reply = F.try_parse_json(body)
    at = lambda path, kind: F.try_variant_get(reply, f"$.choices[0].{path}", kind)
    parts = F.array_join(F.transform(at("message.content", "array<struct<text:string>>"), lambda p: p["text"]), "")
    text = F.coalesce(parts, at("message.content", "string"))
    calls = F.coalesce(F.size(at("message.tool_calls", "array<variant>")), F.lit(0))
    n_calls = F.greatest(calls, F.lit(0))
    error = (
        F.when(at("message", "variant").isNull(), "reply_malformed")
        .when((F.trim(F.coalesce(text, F.lit(""))) == "") & (n_calls == 0), "reply_empty")
        .when(F.length(text) > MOST_REPLY, "reply_too_long")
    )
    return F.struct(text.alias("text"), n_calls.alias("n_tool_calls"), at("finish_reason", "string").alias("finish_reason"), error.alias("error_code"))


#: Fixed values of manifests: keys, kinds of items, sizes, and error fields that are told at most.
MANIFEST_KEYS = ("purpose", "model", "messages", "options", "client_conversation_id", "tools", "tool_choice")
MESSAGE_KEYS, ITEM_KEYS = ("role", "content", "tool_call_id"), ("type", "item_id", "text", "file_field", "filename", "declared_mime")
KINDS = ("text", "file", "image")
MOST_MANIFEST, MOST_FIELDS, MOST_FILE, MOST_REQUEST = 256 << 10, 20, 20_971_520, 52_428_800


def parsed_manifest(raw: Column) -> Column:
    """struct<purpose, model, messages, fields, error_code> of a manifest's JSON. fields: where it breaks the model (unknown, missing
    or ill-formed keys), by location only and at most MOST_FIELDS; then the rest is null. messages is what normalized() takes."""
    top = F.from_json(raw, "map<string,string>")
    messages = F.from_json(top["messages"], "array<map<string,string>>")
    at = lambda *parts: F.concat_ws(".", *(p if isinstance(p, Column) else F.lit(p) for p in parts))
    unknown = lambda m, keys, *where: F.transform(F.filter(F.map_keys(m), lambda k: ~k.isin(*keys)), lambda k: at(*where, k))
    bad = lambda value, pattern, *where: F.when(~F.coalesce(value.rlike(pattern), F.lit(False)), at(*where))
    none = F.array().cast("array<string>")

    def item_fields(c, i, j):
        where = ("messages", i.cast("string"), "content", j.cast("string"))
        return F.concat(unknown(c, ITEM_KEYS, *where), F.array(bad(c["type"], f"^({'|'.join(KINDS)})\\z", *where, "type"), bad(c["item_id"], r"^[A-Za-z0-9._:\-]{1,128}\z", *where, "item_id")))

    def message_fields(m, i):
        content = F.from_json(m["content"], "array<map<string,string>>")
        where = ("messages", i.cast("string"))
        short = F.when(F.coalesce(F.size(content), F.lit(0)) < 1, at(*where, "content"))
        items = F.coalesce(F.flatten(F.transform(content, lambda c, j: item_fields(c, i, j))), none)
        return F.concat(unknown(m, MESSAGE_KEYS, *where), F.array(bad(m["role"], r"^(system|user|assistant|tool)\z", *where, "role"), short), items)

    own = F.array(bad(top["purpose"], r"^[a-z0-9_]{1,64}\z", "purpose"), bad(top["model"], r"^(?s).{1,128}\z", "model"), F.when(F.coalesce(F.size(messages), F.lit(0)) < 1, F.lit("messages")))
    found = F.concat(unknown(top, MANIFEST_KEYS), own, F.coalesce(F.flatten(F.transform(messages, message_fields)), none))
    fields = F.slice(F.filter(found, lambda x: x.isNotNull()), 1, MOST_FIELDS)
    error = F.when(F.octet_length(raw) > MOST_MANIFEST, "manifest_too_large").when(top.isNull() | F.json_object_keys(raw).isNull(), "manifest_not_json").when(F.size(fields) > 0, "manifest_invalid")
    good = error.isNull()
    typed = F.from_json(top["messages"], "array<struct<role:string,content:array<struct<type:string,item_id:string,text:string,file_field:string>>>>")
    return F.struct(
        F.when(good, top["purpose"]).alias("purpose"), F.when(good, top["model"]).alias("model"), F.when(good, typed).alias("messages"), F.when(error == "manifest_invalid", fields).otherwise(none).alias("fields"), error.alias("error_code")
    )


def with_files(items: DataFrame, files: DataFrame) -> DataFrame:
    """normalized items with detected_mime and byte_size of their files (request_id, file_field, data): missing, too large and
    unsupported ones are errors, and so is what takes a request over its bytes, in the request's order. Which office format an
    archive is, its reader says."""
    said = files.select("request_id", "file_field", F.octet_length("data").alias("_size"), sniffed(F.col("data")).alias("_mime"), F.lit(True).alias("_there"))
    rows = items.join(said, ["request_id", "file_field"], "left")
    file = F.col("type") != "text"
    size = F.when(file, F.coalesce("_size", F.lit(0))).otherwise(F.coalesce("byte_size", F.lit(0)))
    sofar = F.sum(size).over(Window.partitionBy("request_id").orderBy("message_index", "position").rowsBetween(Window.unboundedPreceding, 0))
    mime = F.when(file, F.col("_mime")).otherwise(F.lit("text/plain"))
    error = (
        F.when(F.col("error_code").isNotNull(), F.col("error_code")).when(file & F.col("_there").isNull(), "file_missing").when(file & (F.col("_size") > MOST_FILE), "file_too_large")
        .when(file & ~F.coalesce(mime == "application/zip", F.lit(False)), mime_error(mime)).when(sofar > MOST_REQUEST, "request_too_large")
    )
    return rows.withColumns({"error_code": error, "detected_mime": mime, "byte_size": size}).drop("_size", "_mime", "_there")


def unreferenced(files: DataFrame, items: DataFrame) -> DataFrame:
    """Uploads (request_id, file_field) that no item points at: they would never be inspected."""
    return files.select("request_id", "file_field").join(items.select("request_id", "file_field"), ["request_id", "file_field"], "left_anti")


#: Bytes of a local model's answer at most.
MOST_ANSWER = 256_000


def parsed_answer(body: Column) -> Column:
    """struct<claims, error_code> of a local model's whole answer: too long, cut off, without content or of another form is an error,
    as a partial list would hide what was not listed."""
    reply = F.try_parse_json(body)
    at = lambda path, kind: F.try_variant_get(reply, f"$.choices[0].{path}", kind)
    claims = parsed_claims(at("message.content", "string"))
    error = (
        F.when(F.octet_length(body) > MOST_ANSWER, "model_answer_too_long").when(at("message", "variant").isNull(), "model_bad_envelope").when(at("finish_reason", "string") == "length", "model_truncated")
        .when(at("message.content", "string").isNull(), "model_no_payload").otherwise(claims["error_code"])
    )
    return F.struct(F.when(error.isNull(), claims["claims"]).alias("claims"), error.alias("error_code"))
