"""Registered queries of sources and sinks: uploads in folders, a model that fails, requests sent once, races, percentiles."""

from __future__ import annotations

import json
import re
import uuid

import pyspark.sql.functions as F

from .operators import reports, requests, tokens, vault
from .queries import _DIGEST_SQL, _VAULT_SQL, TENANT, _query, _table, tokened_claims
from .queries_outbound import _FILE_SQL
from .sources import model, uploads
from .streaming import sinks
from .tables import deleted, shared_dir, written


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/hushframe/{uuid.uuid4().hex}-{name}"


# ---- uploads: a folder for each page, with a manifest and the page's html as a file ------------------------------------
#: Requests whose folders stand at once: each takes blocks of the disk for its files and folders, and the driver holds their names.
WAVE = 16_384


@_query("upload_folder", f"""select request_id, 't' as item_id, 'text/plain' as detected_mime, coalesce(octet_length(encode(url)), 0)::int as byte_size, case when coalesce(url, '') = '' then 'text_required' end as error_code from {_FILE_SQL}
    union all select request_id, 'i', m, case when n <= 1500 then n + 1 else 0 end, case when n is null or n > 1500 then 'file_missing' when m <> 'text/plain' then 'unsupported_media_type' end from (select *, case when n > 1500 or n is null then null when
      regexp_matches(h, '^(..)*(0[0-8EF]|1[0-9A-F])') then 'application/octet-stream' else 'text/plain' end as m from {_FILE_SQL})""")
def upload_folder(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("request_id"), "url", "html")
    item = lambda kind, name, **more: F.struct(F.lit(kind).alias("type"), F.lit(name).alias("item_id"), *(v.alias(k) for k, v in more.items()))
    none = F.lit(None).cast("string")
    content = F.array(item("text", "t", text=F.col("url"), file_field=none), item("file", "i", text=none, file_field=F.lit("f")))
    body = F.struct(F.lit("general").alias("purpose"), F.lit("m").alias("model"), F.array(F.struct(F.lit("user").alias("role"), content.alias("content"))).alias("messages"))
    manifests = pages.select("request_id", F.lit(uploads.MANIFEST).alias("part"), F.to_json(body).alias("value"))
    files = pages.filter("html is not null").select("request_id", F.when(F.octet_length("html") > 1500, "g").otherwise("f").alias("part"), F.col("html").alias("value"))
    wave = F.pmod(F.xxhash64("request_id"), F.lit(max(1, -(-pages.count() // WAVE)))).cast("int")
    sent, out = _folder(spark, "uploads-sent"), _folder(spark, "uploads-items")
    manifests.unionByName(files).withColumn("wave", wave).write.partitionBy("wave").parquet(sent)
    rows = spark.read.schema("request_id string, part string, value string, wave int").parquet(sent)
    items = spark.createDataFrame([], "request_id string, item_id string, detected_mime string, byte_size int, error_code string")
    items.write.parquet(out)
    for r in rows.select("wave").distinct().collect():
        folder = _folder(spark, "uploads")
        uploads.write_texts(rows.filter(F.col("wave") == r.wave).drop("wave"), folder)
        found, data = uploads.requests(uploads.parts(spark, folder))
        requests.with_files(uploads.items(found), data).select("request_id", "item_id", "detected_mime", F.col("byte_size").cast("int").alias("byte_size"), "error_code").write.mode("append").parquet(out)
        uploads.delete(spark, folder)
    deleted(spark, sent)
    return spark.read.schema(items.schema).parquet(out)


# ---- a model that answers, fails, cuts off and is late, by customer --------------------------------------------------------
def _client():
    """Stands for a model: what it does with a text goes by the number in it."""

    def ask(text: str, attempt: int, left: float) -> tuple[int, str | None]:
        name = re.search(r"Customer#\d+", text)[0]
        kind = int(name[9:]) % 7
        if kind == 5:
            raise TimeoutError
        if kind == 2 or kind == 3 or kind == 1 and attempt == 1:
            return {1: 500, 2: 400, 3: 503}[kind], None
        claims = json.dumps({"entities": [{"start": 5, "end": 5 + len(name), "text": name, "type": "PERSON", "confidence": 0.9}, {"start": 0, "end": 4, "text": "not there", "type": "PERSON", "confidence": 0.9}]})
        message = {"content": None if kind == 6 else claims}
        return 200, json.dumps({"choices": [{"finish_reason": "length" if kind == 4 else "stop", "message": message}]})

    return ask


@_query("model_source", """select c_custkey::varchar as item_id, case k when 0 then 1 when 1 then 2 when 2 then 1 when 3 then 3 when 5 then 3 else 1 end as attempts, case when k < 2 then 1 end as n_spans, case when k < 2 then 1 end as rejected, case when k < 2 then c_name end as raw,
    case k when 2 then 'model_refused' when 3 then 'model_unavailable' when 4 then 'model_truncated' when 5 then 'model_deadline' when 6 then 'model_no_payload' end as error_code from (select *, c_custkey % 7 as k from customer)""")
def model_source(spark, sf_dir):
    """Every customer's letter put to the model; only whole answers become findings, each verified in its text."""
    letters = _table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("item_id"), F.concat(F.lit("Dear "), "c_name", F.lit(",")).alias("text"))
    answers = written(model.answered(letters, _client, pause=0.0), "answers")
    out = model.claims_of(answers, letters).join(answers.select("item_id", "attempts"), "item_id")
    return out.select("item_id", "attempts", F.when(F.col("spans").isNotNull(), F.size("spans")).alias("n_spans"), "rejected", F.try_element_at("spans", F.lit(1))["raw"].alias("raw"), "error_code")


# ---- out and back: sanitized claims sent once by a stream that is started anew, echoed, restored ---------------------------
@_query("external_round_trip", f"""select c_custkey::varchar as request_id, 1::bigint as copies, coalesce('About ' || said || '.', 'Nothing.') as reply from customer left join (
    select item_id, string_agg(original, ', ' order by first) as said from (select item_id, original, min(start) as first from ({_DIGEST_SQL}) d join ({_VAULT_SQL}) v using (scope_id, entity_type, digest) where action = 'TOKENIZE' group by item_id, entity_type, digest, original) group by item_id) on c_custkey = item_id""")
def external_round_trip(spark, sf_dir):
    """Two queries with checkpoints of their own read the same requests; the folder holds each once."""
    rows = written(tokened_claims(spark, sf_dir), "tokened")
    folder = _folder(spark, "external")
    sent = rows.select(F.col("item_id").cast("string").alias("request_id"), "scope_id", tokens.sanitized(F.col("text"), F.col("f"))["text"].alias("text"), F.col("text").alias("raw_text"))
    sent.write.parquet(f"{folder}/requests")
    for turn in (1, 2):
        stream = spark.readStream.schema(sent.schema).option("maxFilesPerTrigger", 4).parquet(f"{folder}/requests")
        sinks.deliver(stream, f"{folder}/sent", f"{folder}/checkpoint-{turn}").awaitTermination()
    there = sinks.delivered(spark, f"{folder}/sent", "request_id string, scope_id string, text string, batch long")
    copies = there.groupBy("request_id").agg(F.count("*").alias("copies"))
    replies = there.select(F.col("request_id").alias("reply_id"), "scope_id", sinks.echoed(F.col("text")).alias("text"))
    back = tokens.restored(replies, tokens.mappings(rows, "f")).select(F.col("reply_id").alias("request_id"), F.col("restored_text").alias("reply"))
    return copies.join(back, "request_id")


# ---- two jobs that mint for the same values ---------------------------------------------------------------------------------
@_query("vault_race", f"""select job, scope_id, digest, case when (job = 'a') = (digest < '4') then 'mapping_lost' end as error_code from ({_VAULT_SQL}), (values ('a'), ('b')) j(job) where job = 'a' or digest < '8'""")
def vault_race(spark, sf_dir):
    """Job b mints other tokens for half of the values, some of them earlier; whoever was later learns it before its text leaves."""
    at = lambda x: F.lit(f"2026-01-01 {x}").cast("timestamp")
    own = written(tokens.mappings(tokened_claims(spark, sf_dir), "f").withColumn("tenant_id", F.lit(TENANT)), "minted")
    a = own.select(F.lit("a").alias("job"), "tenant_id", "scope_id", "entity_type", "digest", "token", at("01:00:00").alias("created_at"))
    other = F.translate("token", "ABCDEFGH", "HGFEDCBA")
    b = own.filter("digest < '8'").select(F.lit("b").alias("job"), "tenant_id", "scope_id", "entity_type", "digest", other.alias("token"), F.when(F.col("digest") < "4", at("00:59:00")).otherwise(at("01:01:00")).alias("created_at"))
    both = a.unionByName(b)
    return vault.confirmed(vault.settled(both), both).select("job", "scope_id", "digest", "error_code")


# ---- percentiles from sketches by day ------------------------------------------------------------------------------------------
@_query("latency_percentiles", "select event_type, count(value) as n, true as p50_near, true as p95_near, true as p99_near from events group by event_type")
def latency_percentiles(spark, sf_dir):
    """Days' sketches are written and merged by type; each percentile's rank among the values is looked up and near what was asked for."""
    events = _table(spark, sf_dir, "events")
    daily = written(reports.sketched(events.withColumn("day", F.to_date("ts")), "value", "event_type", "day"), "daily")
    found = reports.percentiles(daily, "event_type")
    asked = {"p50": 0.50, "p95": 0.95, "p99": 0.99}
    counts = [F.count_if(F.col("value") < F.col(p)).alias(f"below_{p}") for p in asked] + [F.count_if(F.col("value") <= F.col(p)).alias(f"upto_{p}") for p in asked]
    ranks = events.join(F.broadcast(found), "event_type").groupBy("event_type").agg(F.count("value").alias("n"), *counts)
    near = lambda p, r: (F.col(f"below_{p}") / F.col("n") <= r + 0.02) & (F.col(f"upto_{p}") / F.col("n") >= r - 0.02)
    return ranks.select("event_type", "n", *(near(p, r).alias(f"{p}_near") for p, r in asked.items()))
