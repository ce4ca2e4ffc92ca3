"""Registered queries of claims, decisions of whole requests, the guard, routing and requests put together again."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from .operators import claims, decide, outbound, requests, tokens
from .plans.vocabulary import ACTIONS, IMAGE_CLASSES, POLICY
from .queries import _DOC_DECIDED_SQL, RECIPES, _query, _table, document_findings, exploded, items, items_sql, tokened
from .sources import binary

_RANKS = "list_position(['" + "', '".join(ACTIONS) + "'], action)"
#: Documents in a request.
SIZE = 8

# ---- claims of a model ---------------------------------------------------------------------------------------------
#: Claims made from each document: its second word as said, the third at a wrong place, an invented one, a type that models must
#: not give, one too short, one too long, the second word again.
_CLAIMED = [
    ("instr(text, word2) - 1", "instr(text, word2) - 1 + length(word2)", "word2", "PERSON", "0.9"),
    ("3", "7", "word3", "ORGANIZATION", "1.5"),
    ("0", "4", "word2 || '~' || word3", "PERSON", "0.8"),
    ("0", "4", "word2", "ID_CARD", "0.8"),
    ("0", "1", "left(word2, 1)", "PERSON", "0.8"),
    ("0", "600", "left(text, 600)", "PERSON", "0.8"),
    ("0", "2", "word2", "PERSON", "0.3"),
]


def claimed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").selectExpr("doc_id as item_id", "text", "split_part(text, ' ', 2) as word2", "split_part(text, ' ', 3) as word3")
    made = F.array(*(F.expr(f"named_struct('start', cast({a} as int), 'end', cast({b} as int), 'text', {t}, 'type', '{k}', 'confidence', cast({c} as double))") for a, b, t, k, c in _CLAIMED))
    return rows.withColumn("v", claims.verified(F.col("text"), made))


_CLAIMS_SQL = ", ".join(f"{{n: {n}, s: ({a})::int, e: ({b})::int, t: {t.replace('instr', 'strpos')}, k: '{k}', c: {c}::double}}" for n, (a, b, t, k, c) in enumerate(_CLAIMED)).replace("instr(", "strpos(")
_VERIFIED_SQL = f"""select *, {{n: 0}} as pad from (select item_id, text, x.n as n, x.s as s, x.e as e, x.t as t, x.k as k, x.c as c,
    case when x.k in ('PERSON', 'ADDRESS_DETAILED', 'ORGANIZATION', 'MEDICAL_DATA', 'UNKNOWN_SENSITIVE') and length(x.t) <= 512 and length(trim(x.t)) >= 2
      and contains(text, x.t)
      then list_filter(range(0, length(text) - length(x.t) + 1), lambda i: substr(text, i + 1, length(x.t)) = x.t)[1:20] else [] end as places,
    coalesce(x.s >= 0 and x.e > x.s and x.e <= length(text) and substr(text, x.s + 1, x.e - x.s) = x.t, false) as pointed
    from (select item_id, text, unnest([{_CLAIMS_SQL}]) as x from (select doc_id as item_id, text, split_part(text, ' ', 2) as word2, split_part(text, ' ', 3) as word3 from documents where text is not null)))"""
_query("model_verify_spans", f"select item_id, count(*) filter (where len(places) = 0) as rejected, count(*) filter (where len(places) > 0 and not pointed) as relocated from ({_VERIFIED_SQL}) group by item_id")(
    lambda s, d: claimed(s, d).filter("text is not null").select("item_id", F.col("v.rejected").cast("long").alias("rejected"), F.col("v.relocated").cast("long").alias("relocated"))
)
_query("model_detect", f"""select item_id, p::int as start, (p + length(t))::int as "end", k as entity_type, 'local_model' as source, 'local_model_v1' as rule_id, least(1.0::double, c) as confidence, t as raw
    from (select *, row_number() over (partition by item_id, p, length(t), k order by n) as first from (select item_id, n, t, k, c, unnest(places) as p from ({_VERIFIED_SQL}))) where first = 1""")(
    lambda s, d: exploded(claimed(s, d), claims.model_findings(F.col("v.spans"))).select("item_id", "start", "end", "entity_type", "source", "rule_id", "confidence", "raw")
)
_query("prompt_render", "select conv_id, turn, 'Read.' as system_prompt, trim('kind ' || role || ': ' || coalesce(text, '')) as user_prompt from conversations where text is null or not regexp_matches(text, '^\\s|\\s$')")(
    lambda s, d: _table(s, d, "conversations").filter(F.col("text").isNull() | ~F.col("text").rlike(r"^\s|\s\z"))
    .withColumn("p", claims.rendered("SYSTEM: Read. USER: kind {{document_type}}: {{normalized_text}}", F.coalesce("text", F.lit("")), F.col("role"))).select("conv_id", "turn", "p.system_prompt", "p.user_prompt")
)

# ---- decisions of requests -----------------------------------------------------------------------------------------
_LABELLED = "(select doc_id, min(quality) as quality, max(toxic) as toxic from labels where doc_id is not null group by doc_id)"
_FOUND_SQL = f"(select item_id, count(*) as n, arg_max(action, {_RANKS}) as action, string_agg(distinct reason, ',' order by reason) as reasons from ({_DOC_DECIDED_SQL}) group by item_id)"
_HEX = "hex(encode(text))[1:8192]"
_PLAIN_SQL = f"not regexp_matches({_HEX}, '^(..)*(0[0-8EF]|1[0-9A-F])') and not regexp_matches({_HEX}, '^(..)*([CD].|E.|E.[89AB].|F.|F.[89AB].|F.[89AB].[89AB].)$')"
#: Documents as items of requests: inspected if labelled, completely if good, in error if toxic; read if they look like text.
_ITEMS_SQL = f"""(select d.doc_id as item_id, d.doc_id // {SIZE} as request_id, d.doc_id % {SIZE} as ordinal, d.text, d.lang, d.source, quality is not null as inspected, coalesce(quality = 1, false) as complete, coalesce(toxic = 1, false) as failed,
    {_PLAIN_SQL.replace('text', 'd.text')} as plain, coalesce(n, 0) as n, case when not coalesce(quality = 1, false) then 'BLOCK' else coalesce(f.action, 'PASS') end as action,
    case when not coalesce(quality = 1, false) then 'inspection_incomplete' else coalesce(f.reasons, 'no_findings') end as reasons
    from documents d left join {_LABELLED} l on d.doc_id = l.doc_id left join {_FOUND_SQL} f on d.doc_id = f.item_id where d.doc_id is not null and d.text is not null)"""


def request_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(request_id, ordinal, item_id, text, lang, source, inspected, complete, failure, plain, f, said): f the findings with decisions."""
    labels = _table(spark, sf_dir, "labels").filter("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    docs = _table(spark, sf_dir, "documents").filter("doc_id is not null and text is not null").join(labels, "doc_id", "left")
    rows = docs.select(
        F.col("doc_id").alias("item_id"), F.expr(f"doc_id div {SIZE}").alias("request_id"), (F.col("doc_id") % SIZE).alias("ordinal"), "text", "lang", "source", F.col("source").alias("scope_id"),
        F.col("quality").isNotNull().alias("inspected"), F.coalesce(F.col("quality") == 1, F.lit(False)).alias("complete"), F.when(F.col("toxic") == 1, "detector").alias("failure"), (binary.sniffed(F.col("text").cast("binary")) == "text/plain").alias("plain"),
    )
    rows = tokened(rows, document_findings())
    return rows.withColumn("said", decide.effective(F.col("f"), F.col("complete")))


@_query("decision_bundle", f"""select request_id, effective_action, array_to_string(list_sort(list_distinct(flatten(list(string_split(reasons, ',')) filter (where action = effective_action)))), ',') as reason_codes,
      count(*) filter (where action = 'PASS') as n_pass, count(*) filter (where action = 'TOKENIZE') as n_tokenize, count(*) filter (where action = 'REDACT') as n_redact, count(*) filter (where action = 'BLOCK') as n_block,
      coalesce(string_agg(item_id::varchar, ',' order by item_id) filter (where action in ('BLOCK', 'LOCAL_ONLY')), '') as withheld, coalesce(string_agg(item_id::varchar, ',' order by ordinal) filter (where action not in ('BLOCK', 'LOCAL_ONLY')), '') as forwardable,
      bool_or(action = 'BLOCK') as any_block, bool_and(action = 'PASS') as all_pass
    from (select *, first_value(action) over (partition by request_id order by {_RANKS} desc) as effective_action from {_ITEMS_SQL}) group by request_id, effective_action""")
def decision_bundle(spark, sf_dir):
    rows = request_items(spark, sf_dir).select("request_id", "ordinal", "item_id", "said.action", "said.reasons")
    listed = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c.replace("_ids", ""))
    return decide.bundle(rows, "request_id").select("request_id", "effective_action", F.array_join("reason_codes", ",").alias("reason_codes"), "n_pass", "n_tokenize", "n_redact", "n_block", listed("withheld_ids"), listed("forwardable_ids"), "any_block", "all_pass")


@_query("outbound_leaks", f"select item_id, case when action is null then 'no_decision' else 'withheld_in_outbound' end as error_code from (select d.doc_id as item_id, action from documents d left join {_ITEMS_SQL} i on d.doc_id = i.item_id and i.inspected) where action is null or action in ('BLOCK', 'LOCAL_ONLY')")
def outbound_leaks(spark, sf_dir):
    """As if every document went out, while decisions exist for inspected ones only."""
    decisions = request_items(spark, sf_dir).filter("inspected").select("item_id", "said.action")
    return decide.leaks(_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id")), decisions)


_MODELS, _PURPOSES = [f"model-src{i}" for i in range(6)], ["en", "fr", "es"]


@_query("fast_path_guard", f"""with i as (select request_id, ordinal, list_filter([case when not inspected then 'missing_inspection' end, case when inspected and not complete then 'incomplete_inspection' end, case when inspected and failed then 'inspection_error' end,
      case when inspected and not plain then 'partial_parse' end, case when inspected and n > 0 then 'findings_present' end, case when inspected and action <> 'PASS' then 'non_pass_action' end], lambda x: x is not null) as w, item_id, lang, source from {_ITEMS_SQL}),
    r as (select request_id, min(source) as source, min(lang) as lang, count(*) as m, flatten(list(list_transform(w, lambda x: x || ':' || item_id) order by ordinal)) as w from i group by request_id),
    b as (select request_id, list_filter([case when lang = 'de' then 'scope_sanitized_locked' end, case when m < {SIZE} then 'scope_not_usable' end], lambda x: x is not null) || w
      || list_filter([case when 'model-' || source not in ({', '.join(f"'{m}'" for m in _MODELS)}) then 'model_not_allowed' end, case when lang not in ({', '.join(f"'{p}'" for p in _PURPOSES)}) then 'purpose_not_allowed' end], lambda x: x is not null) as w from r)
    select request_id, len(w) = 0 as allowed, array_to_string(w, ',') as blockers from b""")
def fast_path_guard(spark, sf_dir):
    """Requests of eight documents: their scope is locked where one is German, and not usable where some are missing."""
    rows = request_items(spark, sf_dir)
    yes, none = F.lit(True), F.lit(False)
    said = outbound.item_blockers(F.col("item_id"), F.col("inspected"), F.col("complete"), F.col("failure"), yes, F.col("plain"), F.size("f"), F.col("said.action"), F.lit("text"), none, none)
    requests = rows.groupBy("request_id").agg(F.when(F.min("lang") == "de", "SANITIZED_LOCKED").otherwise("CLEAN").alias("privacy_mode"), (F.count("*") >= SIZE).alias("usable"), F.concat(F.lit("model-"), F.min("source")).alias("model"), F.min("lang").alias("purpose"))
    out = outbound.fast_path(requests, rows.select("request_id", "ordinal", said.alias("blockers")), _MODELS, _PURPOSES)
    return out.select("request_id", "allowed", F.array_join("blockers", ",").alias("blockers"))


@_query("route_items", f"""select item_id, case when action in ('BLOCK', 'LOCAL_ONLY') or failed and action = 'PASS' and not plain then null when failed and action = 'PASS' then 'bytes' else 'text' end as part,
    case when failed and action = 'PASS' and not plain and source <> 'src0' then null end as error_code, case when action in ('BLOCK', 'LOCAL_ONLY') or failed and action = 'PASS' then null
      else length(text) - coalesce(gone, 0) + coalesce(put, 0) end as length_after
    from (select i.*, gone, put from {_ITEMS_SQL} i left join (select item_id, sum("end" - start) as gone, sum(case when action = 'REDACT' then 10 else 24 + length(entity_type) end) as put from ({_DOC_DECIDED_SQL}) group by item_id) e on i.item_id = e.item_id) where not failed or plain""")
def route_items(spark, sf_dir):
    """Toxic documents stand for files with bytes, all others for texts."""
    rows = request_items(spark, sf_dir).filter("failure is null or plain")
    kind = F.when(F.col("failure").isNotNull(), "document").otherwise("text")
    out = outbound.routed(F.col("said.action"), kind, F.col("text"), tokens.sanitized(F.col("text"), F.col("f")), F.lit(True), F.lit(False), F.col("plain"), F.lit(False))
    return rows.withColumn("r", out).select("item_id", "r.part", "r.error_code", F.length("r.text").cast("long").alias("length_after"))


@_query("rebuilt_messages", f"""select request_id, ordinal as message_index, case when action = 'BLOCK' then 0 else 1 end as n_parts, case when action = 'BLOCK' then null else item_id::varchar end as first_item from {_ITEMS_SQL}""")
def rebuilt_messages(spark, sf_dir):
    rows = request_items(spark, sf_dir).withColumn("message_index", F.col("ordinal"))
    part = F.when(~F.col("said.action").isin(*decide.WITHHOLDING), "text")
    parts = rows.select("request_id", "message_index", F.lit(0).alias("position"), F.col("item_id").cast("string").alias("item_id"), part.alias("part"), "text")
    out = outbound.rebuilt(rows.select("request_id", "message_index"), parts)
    return out.select("request_id", "message_index", F.size("parts").alias("n_parts"), F.try_element_at("parts", F.lit(1))["item_id"].alias("first_item"))


def _lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


@_query("system_prompt", f"""select request_id, sha256({_lit(outbound.UNTRUSTED)} || chr(10) || chr(10) || {_lit(outbound.MATERIALS[0])} || chr(10) || string_agg('- M' || rn || '：' || case when failed then 'document（' || case when plain then 'text/plain' else '未知类型' end || '）' else '文本' end, chr(10) order by rn)
      || chr(10) || chr(10) || {_lit(outbound.MATERIALS[1])} || case when bool_or(action = 'TOKENIZE') then chr(10) || chr(10) || {_lit(outbound.MARKERS)} else '' end) as prompt_sha256
    from (select *, row_number() over (partition by request_id order by ordinal) as rn from {_ITEMS_SQL}) group by request_id""")
def system_prompt(spark, sf_dir):
    rows = request_items(spark, sf_dir).withColumn("message_index", F.lit(0)).withColumn("position", F.col("ordinal"))
    kind = F.when(F.col("failure").isNotNull(), "document").otherwise("text")
    said = outbound.described(kind, F.when(F.col("plain"), "text/plain"))
    listed = outbound.refs(rows).groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "ref", said.alias("description")))).alias("m"), F.bool_or(F.col("said.action") == "TOKENIZE").alias("tokens"))
    return listed.select("request_id", F.sha2(outbound.system_prompt(F.col("m"), F.col("tokens")).cast("binary"), 256).alias("prompt_sha256"))


_query("issued_tokens", f"select request_id, count(distinct source || entity_type || raw) as n from (select i.request_id, i.source, f.entity_type, f.raw from (select item_id, action, entity_type, raw from ({_DOC_DECIDED_SQL})) f join {_ITEMS_SQL} i on f.item_id = i.item_id where f.action = 'TOKENIZE' and regexp_matches(raw, '^[0-9a-z@.]*$')) group by request_id")(
    lambda s, d: outbound.issued(request_items(s, d).select("request_id", F.transform(F.filter("f", lambda f: (f["action"] == "TOKENIZE") & f["raw"].rlike(r"^[0-9a-z@.]*\z")), lambda f: f["token"]).alias("tokens")), "request_id").select("request_id", F.size("issued_tokens").cast("long").alias("n"))
)
_query("request_totals", f"select request_id, sum(octet_length(encode(text)))::bigint as total_bytes, count(*) filter (where failed) as file_count from {_ITEMS_SQL} group by request_id")(
    lambda s, d: outbound.request_totals(request_items(s, d).select("request_id", F.when(F.col("failure").isNotNull(), "document").otherwise("text").alias("kind"), F.octet_length("text").alias("byte_size")), "request_id")
)
_query("content_class_actions", f"""select event_id, image_class, case when action is null then '{POLICY['defaults']['unsupported_content']}' else action end as action from (select event_id, upper(event_type) || '_IMAGE' as image_class from events) left join
    (values {', '.join(f"('{c}', '{POLICY['content_classes'][c]}')" for c in IMAGE_CLASSES)}) p(name, action) on image_class = name""")(
    lambda s, d: _table(s, d, "events").select("event_id", F.concat(F.upper("event_type"), F.lit("_IMAGE")).alias("image_class")).withColumn("action", decide.class_action(F.col("image_class")))
)
_query("image_class_stricter", "select a.event_id, case when b > a then 'UNKNOWN_IMAGE' else 'SENSITIVE_IMAGE' end as image_class from (select event_id, 1 as a, case when value > 50 then 3 else 0 end as b from events) a")(
    lambda s, d: _table(s, d, "events").select("event_id", decide.stricter(F.lit("SENSITIVE_IMAGE"), F.when(F.col("value") > 50, "UNKNOWN_IMAGE").otherwise("ORDINARY_IMAGE"), IMAGE_CLASSES[:2] + ("ID_DOCUMENT_IMAGE", "UNKNOWN_IMAGE")).alias("image_class"))
)
RECIPES["tools"] = ("customer", "c_custkey", """'[{"name": "find", "description": "call ' || case when k % 3 = 0 then '138' || lpad(cast(k % 10000000 as string), 7, '0') else '138' || lpad(cast(k as string), 8, '0') end || ' or ' || case when k % 2 = 0 then 'a@b' else 'a' || cast(k as string) || '@example.com' end || '"}]'""")
_query("tool_gate", f"select item_id, case when item_id % 3 <> 0 and item_id % 2 = 0 then 'tools_blocked:PHONE' when item_id % 3 <> 0 then 'tools_blocked:EMAIL,PHONE' when item_id % 2 = 1 then 'tools_blocked:EMAIL' end as error_code from {items_sql('tools')}")(
    lambda s, d: items(s, d, "tools").select("item_id", outbound.tools_error(F.col("text")).alias("error_code"))
)
_query("caller_allowed", "select c_custkey, case when c_mktsegment not in ('BUILDING', 'AUTOMOBILE', 'MACHINERY') then 'purpose_not_allowed' when n_name not like '%A%' then 'model_not_allowed' end as error_code from customer join nation on c_nationkey = n_nationkey")(
    lambda s, d: _table(s, d, "customer").join(F.broadcast(_table(s, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    .select("c_custkey", outbound.allowed(F.col("c_mktsegment"), F.when(F.contains("n_name", F.lit("A")), "small").otherwise("large"), F.array(*(F.lit(x) for x in ("BUILDING", "AUTOMOBILE", "MACHINERY"))), F.array(F.lit("small"))).alias("error_code"))
)
_query("log_allow_list", "select l_orderkey::varchar as request_id, l_quantity as duration_ms, l_linestatus as status from lineitem")(
    lambda s, d: outbound.log_lines(_table(s, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("request_id"), F.col("l_linestatus").alias("status"), F.col("l_quantity").alias("duration_ms"), F.col("l_returnflag").alias("raw_text")))
)

# ---- manifests and their files -------------------------------------------------------------------------------------
#: A manifest for each turn; short texts give an unknown key, system turns another, long ones a bad id; some are cut off.
_RAW = """'{"purpose": "p' || cast(conv_id as string) || '", "model": "m", "messages": [{"role": "' || role || '", "content": [{"type": "text", "item_id": "' || case when length(text) > 120 then 'a b' else 'a' end || '", "text": "x"'
  || case when length(text) < 60 then ', "note": {"a": 1}' else '' end || '}]}]' || case when role = 'system' then ', "extra": [1]' else '' end || case when turn % 11 = 10 then '' else '}' end"""
_query("manifest_parse", """select conv_id, turn, case when turn % 11 = 10 then 'manifest_not_json' when f <> '' then 'manifest_invalid' end as error_code, case when turn % 11 = 10 then '' else f end as fields from (select conv_id, turn,
    concat_ws(',', case when role = 'system' then 'extra' end, case when role not in ('system', 'user', 'assistant', 'tool') then 'messages.0.role' end, case when length(text) < 60 then 'messages.0.content.0.note' end, case when length(text) > 120 then 'messages.0.content.0.item_id' end) as f
    from conversations where text is not null and role is not null)""")(
    lambda s, d: _table(s, d, "conversations").filter("text is not null and role is not null").withColumn("p", requests.parsed_manifest(F.expr(_RAW))).select("conv_id", "turn", "p.error_code", F.array_join("p.fields", ",").alias("fields"))
)


def uploads(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(items, files): a request for each page with a text and a file; the file is its html, under another name where that is long."""
    pages = _table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("request_id"), "url", F.col("html").cast("binary").alias("data"))
    content = F.expr("array(named_struct('type', 'text', 'item_id', 't', 'text', url, 'file_field', cast(null as string)), named_struct('type', 'image', 'item_id', 'i', 'text', cast(null as string), 'file_field', 'f'))")
    rows = requests.normalized(pages.select("request_id", F.array(F.struct(F.lit("user").alias("role"), content.alias("content"))).alias("messages")))
    return rows, pages.select("request_id", F.when(F.length("data") > 1500, "g").otherwise("f").alias("file_field"), "data")


_FILE_SQL = "(select page_id::varchar as request_id, url, html, octet_length(encode(html)) as n, hex(encode(html))[1:8192] as h from pages)"
_query("manifest_files", f"""select request_id, 't' as item_id, 'text/plain' as detected_mime, coalesce(octet_length(encode(url)), 0)::int as byte_size, case when coalesce(url, '') = '' then 'text_required' end as error_code from {_FILE_SQL}
    union all select request_id, 'i', m, case when n <= 1500 then n else 0 end, case when n is null or n > 1500 then 'file_missing' when m is null or m <> 'text/plain' then 'unsupported_media_type' end from (select *, case when n > 1500 or n = 0 or n is null then null when
      regexp_matches(h, '^(..)*(0[0-8EF]|1[0-9A-F])') then 'application/octet-stream' else 'text/plain' end as m from {_FILE_SQL})""")(
    lambda s, d: requests.with_files(*uploads(s, d)).select("request_id", "item_id", "detected_mime", F.col("byte_size").cast("int").alias("byte_size"), "error_code")
)
_query("unreferenced_uploads", f"select request_id, 'g' as file_field from {_FILE_SQL} where n > 1500")(lambda s, d: requests.unreferenced(*uploads(s, d)[::-1]))
RECIPES["answer"] = ("customer", "c_custkey", """'{"choices": [{"finish_reason": "' || case when k % 4 = 1 then 'length' else 'stop' end || '", "message": {"content": ' || case when k % 4 = 2 then 'null' else '"{\\"entities\\": []}"' end || '}}' || case when k % 4 = 3 then '' else ']}' end""")
_query("model_answer", f"select item_id, case item_id % 4 when 1 then 'model_truncated' when 2 then 'model_no_payload' when 3 then 'model_bad_envelope' end as error_code, case when item_id % 4 = 0 then 0 end as n from {items_sql('answer')}")(
    lambda s, d: items(s, d, "answer").withColumn("p", requests.parsed_answer(F.col("text"))).select("item_id", "p.error_code", F.when(F.col("p.claims").isNotNull(), F.size("p.claims")).alias("n"))
)
