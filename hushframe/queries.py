"""Registered queries of the inspection dataflow, and the SQL that gives the same rows.

The tables hold few values that the rules look for, so most inputs are texts derived from table columns by one SQL
expression, which both engines evaluate; every third row is a near miss.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession, Window

from .functions import checks, keyed, text
from .functions.spans import apply_edits, edits_error
from .operators import decide, detect, merge, reports, requests, scopes, tokens
from .plans.vocabulary import ACTIONS, DURATION_BUCKETS, IMAGE_CLASSES, POLICY, SEVERITY
from .sources import binary, made
from .tables import written

KEY = b"\x02" * 32
SEAL_KEY = b"\x01" * 32
TENANT = "tenant-a"

# ---- derived inputs: (table, key, text); k is the key -----------------------------------------------------------
_NEAR = "k % 3 = 0"


def _digits(k: str, n: int) -> str:
    return f"lpad(cast({k} as string), {n}, '0')"


RECIPES = {
    "mobile": ("customer", "c_custkey", f"'电话: 138' || case when {_NEAR} then {_digits('k % 10000000', 7)} else {_digits('k', 8)} end || '。'"),
    "landline": ("supplier", "s_suppkey", f"'座机 0512' || case when {_NEAR} then '' else '-' end || {_digits('k', 8)}"),
    "e164": ("customer", "c_custkey", f"'call ' || case when {_NEAR} then '' else '+' end || '44 ' || {_digits('k', 10)}"),
    "id18": ("orders", "o_orderkey", f"'身份证号 110101' || replace(substr(cast(cast(o_orderdate as date) as string), 1, 10), '-', '') || {_digits('k % 1000', 3)} || case when {_NEAR} then 'X' else cast(k % 10 as string) end"),
    "id15": ("orders", "o_orderkey", f"'证件号 320502' || substr(replace(cast(cast(o_orderdate as date) as string), '-', ''), 3, 6) || {_digits('k % 1000', 3)} || case when {_NEAR} then '1' else '' end"),
    "travel": ("part", "p_partkey", f"'护照 E' || {_digits('k', 8)} || case when {_NEAR} then 'Z' else '' end"),
    "uscc": ("supplier", "s_suppkey", f"'统一社会信用代码 91350100M' || {_digits('k', 8)} || substr('{checks.ORG_ALPHABET}', cast(k % 31 as int) + 1, 1) || case when {_NEAR} then '0' else '' end"),
    "card": ("customer", "c_custkey", f"'卡号 4539 5787 ' || {_digits('k % 10000', 4)} || ' ' || {_digits('k * 7 % 10000', 4)} || case when {_NEAR} then '99999' else '' end"),
    "email": ("customer", "c_custkey", f"'邮箱: user' || cast(k as string) || case when {_NEAR} then '@x' else '@example.invalid' end || ' 。'"),
    "plate": ("part", "p_partkey", f"'车牌 京A' || {_digits('k % 100000', 5)} || case when {_NEAR} then '0Q' else '' end"),
    "address": ("supplier", "s_suppkey", f"case when {_NEAR} then '住址：江苏省苏州市' else '住址：在江苏省苏州市星海街' || cast(k as string) || '号' end"),
    "person": ("customer", "c_custkey", f"'患者: ' || c_name || case when {_NEAR} then '   Age' else ' | Age' end || ': 40'"),
    "organization": ("nation", "n_nationkey", "'医院 ' || n_name || '，ok'"),
    "record": ("orders", "o_orderkey", "'病历号 ZY-' || cast(k as string)"),
    "fullwidth": ("customer", "c_custkey", f"'电话: ' || translate('138' || {_digits('k', 8)}, '0123456789', '０１２３４５６７８９')"),
    "nonbmp": ("customer", "c_custkey", f"'😀😀 Tel: 139' || {_digits('k', 8)}"),
    "claim": ("customer", "c_custkey", f"'患者: ' || c_name || ' | 电话: 138' || case when {_NEAR} then {_digits('k % 10000000', 7)} else {_digits('k', 8)} end || ' | 卡号: 4539 5787 ' || {_digits('k % 10000', 4)} || ' ' || {_digits('k * 7 % 10000', 4)} || ' | 病历号: ' || case when k % 5 = 0 then 'ZY' || cast(k as string) else '' end"),
    "tokens": ("customer", "c_custkey", f"'see ' || case when {_NEAR} then '[[PGW_V1_PERSON_ABCDEFGHJKLM]] and [[ PGWx ]]' else '[[NOT]] [[A_B1234567]]' end || ' [[NAME_' || {_digits('k', 8)} || ']]'"),
    "log": ("customer", "c_custkey", f"'api_key= s' || cast(k as string) || ' card 4539' || {_digits('k', 10)} || ' to u' || cast(k as string) || '@example.com ok'"),
    "payload": ("customer", "c_custkey", """case when k % 5 = 1 then '```json' || chr(10) else '' end || '{"entities": [{"start": 0, "end": 4, "text": "' || c_name || '", "type": "PERSON"' || case when k % 5 = 3 then '' else ', "confidence": 0.9' end || '}]' || case when k % 5 = 2 then ', "note": 1' else '' end || case when k % 5 = 4 then '' else '}' end || case when k % 5 = 1 then chr(10) || '```' else '' end"""),
    "reply": ("customer", "c_custkey", """'{"choices": [' || case when k % 5 = 4 then '' else '{"message": {"content": ' || case k % 5 when 0 then '"Dear ' || c_name || '"' when 1 then '[{"type": "text", "text": "Dear "}, {"type": "text", "text": "' || c_name || '"}]' when 2 then 'null, "tool_calls": [{"id": "a", "function": {"name": "f", "arguments": "{}"}}]' else '"  "' end || '}, "finish_reason": "stop"}' end || ']}'"""),
    "file": ("part", "p_partkey", "case when k % 3 = 0 then 'C:\\scans\\' else '/in/' end || p_name || '/' || p_brand || cast(k as string) || '.docx'"),
}


def items(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, key, expr = RECIPES[name]
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet").withColumn("k", F.col(key))
    return rows.select(F.col("k").alias("item_id"), F.expr(expr.replace("\\", "\\\\")).alias("text"))


def items_sql(name: str) -> str:
    table, key, expr = RECIPES[name]
    return f"(select k as item_id, {expr} as text from (select *, {key} as k from {table}))"


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# ---- detection -----------------------------------------------------------------------------------------------
_FOUND = ("item_id", "start", "end", "rule_id", "entity_type", "source", "confidence", "raw")


def exploded(df: DataFrame, findings) -> DataFrame:
    return df.withColumn("f", F.explode(findings)).select("item_id", *(F.col(f"f.{c}").alias(c) for c in _FOUND[1:]))


def _folded_sql(x: str) -> str:
    return f"translate({x}, '{text._WIDE}', '{text._NARROW}')"


def _luhn_sql(x: str) -> str:
    d = f"reverse(regexp_replace({x}, '[^0-9]', '', 'g'))"
    digit = f"cast(substr({d}, i, 1) as int)"
    return f"(length({d}) between 12 and 19 and list_sum(list_transform(range(1, length({d}) + 1), lambda i: case when i % 2 = 0 then {digit} * 2 - case when {digit} > 4 then 9 else 0 end else {digit} end)) % 10 = 0)"


def _weights_sql(x: str, alphabet: str, weights) -> str:
    return "(" + " + ".join(f"{w} * (strpos('{alphabet}', substr({x}, {i + 1}, 1)) - 1)" for i, w in enumerate(weights)) + ")"


def _id_sql(x: str) -> str:
    return f"(regexp_matches({x}, '^[0-9]{{17}}.$') and upper(substr({x}, 18, 1)) = substr('{checks.ID_CHECK}', cast({_weights_sql(x, '0123456789', checks.ID_WEIGHTS)} % 11 as int) + 1, 1))"


def _org_sql(x: str) -> str:
    return f"(substr({x}, 18, 1) = substr('{checks.ORG_ALPHABET}', cast((31 - {_weights_sql(x, checks.ORG_ALPHABET, checks.ORG_WEIGHTS)} % 31) % 31 as int) + 1, 1))"


def _date_sql(x: str) -> str:
    return f"(cast(substr({x}, 7, 4) as int) between 1900 and 2100 and cast(substr({x}, 11, 2) as int) between 1 and 12 and cast(substr({x}, 13, 2) as int) between 1 and 31)"


def _marked_sql(source: str, searched: str, pattern: str) -> str:
    """(item_id, text, start, end, part): the second group's matches, marked and split; the third group is what ends them."""
    pattern = pattern.replace("'", "''")
    return f"""select item_id, text, start, start + length(p) as "end", p as part from (
      select item_id, text, i, p, coalesce(sum(length(p)) over (partition by item_id order by i rows between unbounded preceding and 1 preceding), 0)::int as start from (
        select item_id, text, unnest(parts) as p, generate_subscripts(parts, 1) as i from (
          select item_id, text, string_split(regexp_replace({searched}, '{pattern}', '\\1' || chr(1) || '\\2' || chr(1) || '\\3', 'g'), chr(1)) as parts from {source}))) where i % 2 = 0"""


def shape_sql(rule: detect.Shape, source: str, adjacent: bool = False) -> str:
    """RE2 has no lookahead: what follows a match is either taken by the pattern or, where matches may stand one
    character apart (adjacent), looked at afterwards."""
    before = f"(^|[^{rule.before}])" if rule.before else "()"
    after = f"([^{rule.after}]|$)" if rule.after and not adjacent else "()"
    rows = _marked_sql(source, _folded_sql("text"), before + f"({rule.core})" + after)
    if rule.after and adjacent:
        rows = f"""select * from ({rows}) where not regexp_matches(substr(text, "end"::int + 1, 1), '[{rule.after}]')"""
    if rule.rule_id == "cn_detailed_address":
        lead = f"length(regexp_extract(part, '^[{detect.ADDRESS_LEAD}]*'))"
        rows = f'select item_id, text, start + {lead} as start, "end", substr(part, {lead} + 1) as part from ({rows})'
    valid = {"cn_id_card_18": _id_sql("part"), "cn_uscc": _org_sql("part"), "bank_card_luhn": _luhn_sql("part")}.get(rule.rule_id, "false")
    keep = _date_sql("part") if rule.rule_id == "cn_id_card_18" else "true"
    return f"""select item_id, start::int as start, "end"::int as "end", '{rule.rule_id}' as rule_id, '{rule.entity_type}' as entity_type, case when {valid} then 'checksum' else 'regex' end as source,
        case when {valid} then {detect.VALIDATED}::double else {rule.confidence}::double end as confidence, substr(text, start::int + 1, ("end" - start)::int) as raw from ({rows}) where {keep}"""


#: White space for RE2, which knows ASCII's only, and as characters to trim.
_SPACES = r"\t-\r \x85\xA0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_SPACE_SQL = " || ".join(f"chr({c})" for c in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))


def label_sql(rule: detect.Label, source: str) -> str:
    pattern = f"(?i)((?:{detect.label_words(rule)}){detect.LABEL_SEPARATOR})([^{detect.STOP}]{{1,64}}?)({detect.GAP}|[{detect.STOP}]|$)"
    pattern = pattern.replace("\\s", _SPACES)
    rows = f"select *, ltrim(part, {_SPACE_SQL}) as l, trim(part, {_SPACE_SQL}) as v from ({_marked_sql(source, 'text', pattern)})"
    return f"""select item_id, (start + length(part) - length(l))::int as start, (start + length(part) - length(l) + length(v))::int as "end", '{rule.rule_id}' as rule_id, '{rule.entity_type}' as entity_type, 'keyword' as source,
        {rule.confidence}::double as confidence, v as raw from ({rows}) where v <> ''"""


_SHAPE_INPUT = {"cn_id_card_18": "id18", "cn_id_card_15": "id15", "cn_travel_document": "travel", "cn_uscc": "uscc", "cn_landline": "landline", "cn_detailed_address": "address", "cn_phone_mobile": "mobile", "e164_phone": "e164", "bank_card_luhn": "card", "email_address": "email", "cn_vehicle_plate": "plate"}
_LABEL_INPUT = {"label_person": "person", "label_id_card": "id18", "label_phone": "mobile", "label_address": "address", "label_bank_card": "card", "label_email": "email", "label_plate": "plate", "label_organization": "organization", "label_org_id": "uscc", "label_medical_record": "record"}
_SHAPES = {r.rule_id: r for r in detect.SHAPES}
_LABELS = {r.rule_id: r for r in detect.LABELS}

for _rule, _input in _SHAPE_INPUT.items():
    _query(f"regex_{_rule}", shape_sql(_SHAPES[_rule], items_sql(_input)))(lambda s, d, r=_SHAPES[_rule], i=_input: exploded(x := items(s, d, i), detect.shape_findings(x["text"], r)))
for _rule, _input in _LABEL_INPUT.items():
    _query(_rule, label_sql(_LABELS[_rule], items_sql(_input)))(lambda s, d, r=_LABELS[_rule], i=_input: exploded(x := items(s, d, i), detect.label_findings(x["text"], r)))
for _input in ("fullwidth", "nonbmp"):
    _query(f"spans_{_input}", shape_sql(_SHAPES["cn_phone_mobile"], items_sql(_input)))(lambda s, d, i=_input: exploded(x := items(s, d, i), detect.shape_findings(x["text"], _SHAPES["cn_phone_mobile"])))


def _docs(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "text", F.col("source").alias("scope_id"))


_DOCS = "(select doc_id as item_id, text from documents)"
for _rule in ("bank_card_luhn", "email_address"):
    _query(f"documents_{_rule}", shape_sql(_SHAPES[_rule], _DOCS, True))(lambda s, d, r=_SHAPES[_rule]: exploded(x := _docs(s, d), detect.shape_findings(x["text"], r)))
    _query(f"pages_{_rule}", shape_sql(_SHAPES[_rule], "(select page_id as item_id, html as text from pages)", True))(
        lambda s, d, r=_SHAPES[_rule]: exploded(x := _table(s, d, "pages").select(F.col("page_id").alias("item_id"), F.col("html").alias("text")), detect.shape_findings(x["text"], r))
    )

# ---- boost, merge, policy on claims ------------------------------------------------------------------------------
_CLAIM_SHAPES = [_SHAPES["cn_phone_mobile"], _SHAPES["bank_card_luhn"]]
_CLAIM_LABELS = [_LABELS[x] for x in ("label_person", "label_phone", "label_bank_card", "label_medical_record")]
_CLAIM_SQL = " union all ".join([*(shape_sql(r, items_sql("claim")) for r in _CLAIM_SHAPES), *(label_sql(r, items_sql("claim")) for r in _CLAIM_LABELS)])
# every pattern finding of a claim stands behind a label of its type
_BOOSTED_SQL = f"select * exclude (confidence), case when source in ('regex', 'checksum') then least(1.0::double, confidence + 0.10::double) else confidence end as confidence from ({_CLAIM_SQL})"
_ORDER = "case source when 'checksum' then 0 when 'regex' then 1 else 2 end"
# findings of a claim overlap only when they have the same place
_MERGED_SQL = f"""select * exclude (n), from (select *, row_number() over w as n, string_agg(source || ':' || rule_id, ',') over (partition by item_id, start order by {_ORDER} rows between unbounded preceding and unbounded following) as trail
    from ({_BOOSTED_SQL}) window w as (partition by item_id, start order by {_ORDER})) where n = 1"""


def claims(spark, sf_dir) -> DataFrame:
    table, key, expr = RECIPES["claim"]
    return _table(spark, sf_dir, table).withColumn("k", F.col(key)).select(F.col("k").alias("item_id"), F.expr(expr).alias("text"), F.col("c_nationkey").cast("string").alias("scope_id"))


def _claim_findings(df):
    return detect.boosted(F.col("text"), detect.all_findings(F.col("text"), _CLAIM_SHAPES, _CLAIM_LABELS))


_query("context_boost", _BOOSTED_SQL)(lambda s, d: exploded(x := items(s, d, "claim"), _claim_findings(x)))


@_query("merge_findings", _MERGED_SQL)
def merge_findings(spark, sf_dir):
    rows = items(spark, sf_dir, "claim").withColumn("f", F.explode(merge.merged(_claim_findings(None))))
    return rows.select("item_id", *(F.col(f"f.{c}").alias(c) for c in _FOUND[1:]), F.array_join("f.trail", ",").alias("trail"))


def merged_claims(spark, sf_dir, rows=None):
    rows = claims(spark, sf_dir) if rows is None else rows
    return exploded(rows, merge.merged(_claim_findings(None)))


_ENTITY_SQL = ", ".join(f"('{e}', '{a}', {c}::double)" for e, (a, c) in POLICY["entities"].items())
_DECIDED_SQL = f"""select f.* exclude (trail), case when confidence < least_c then 'REDACT' else action end as action, case when confidence < least_c then 'defaults.low_confidence' else 'entities.' || f.entity_type end as policy_rule_id,
    case when confidence < least_c then 'low_confidence' else 'entity_rule' end as reason_code from ({_MERGED_SQL}) f join (values {_ENTITY_SQL}) p(entity_type, action, least_c) on f.entity_type = p.entity_type"""


def decided_claims(spark, sf_dir):
    return decide.decide(merged_claims(spark, sf_dir), F.lit("general"))


_query("policy_decisions", _DECIDED_SQL)(decided_claims)
_RANK_SQL = "list_position(['" + "', '".join(ACTIONS) + "'], action)"
_query("item_effective_action", f"""select i.item_id, coalesce(arg_max(action, {_RANK_SQL}), 'PASS') as effective_action, coalesce(string_agg(distinct reason_code, ',' order by reason_code), 'no_findings') as reasons, count(action) as n_findings
    from {items_sql("claim")} i left join ({_DECIDED_SQL}) d on i.item_id = d.item_id group by i.item_id""")(
    lambda s, d: decide.item_decisions(items(s, d, "claim").select("item_id"), decided_claims(s, d), F.lit(True)).select("item_id", "effective_action", F.array_join("reason_codes", ",").alias("reasons"), "n_findings")
)
_query("action_counts", f"select action, reason_code, count(*) as n from ({_DECIDED_SQL}) group by all")(lambda s, d: decided_claims(s, d).groupBy("action", "reason_code").agg(F.count("*").alias("n")))
_query("metrics_grouping_sets", f"select entity_type, source, action, count(*) as n, grouping(entity_type, source, action) as level from ({_DECIDED_SQL}) group by grouping sets ((entity_type, source), (action), ())")(
    lambda s, d: decided_claims(s, d).groupingSets([[F.col("entity_type"), F.col("source")], [F.col("action")], []], "entity_type", "source", "action").agg(F.count("*").alias("n"), F.grouping_id("entity_type", "source", "action").alias("level"))
)


def _hmac_sql(message: str, key: bytes = KEY) -> str:
    inner, outer = (bytes(b ^ x for b in key.ljust(64, bytes(1))).hex() for x in (0x36, 0x5C))
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({message}))))"


_query("audit_findings", f"""select item_id, rule_id, entity_type, source, round(confidence, 3) as confidence, "end" - start as span_length, {_hmac_sql("raw")} as fingerprint from ({_MERGED_SQL})""")(lambda s, d: reports.audit(merged_claims(s, d), KEY))
_query("metrics_counters", f"select entity_type, source, action, reason_code, count(*) as n from ({_DECIDED_SQL}) group by grouping sets ((entity_type, source), (action, reason_code), (entity_type), ())")(lambda s, d: reports.counters(decided_claims(s, d)))
_query("entity_counts", f"select item_id, count(*) as finding_count, (select string_agg(e || ':' || m, ',' order by e) from (select unnest(list_distinct(list(entity_type))) as e, 1 as m)) as types from ({_MERGED_SQL}) group by item_id")(
    lambda s, d: reports.entity_counts(merged_claims(s, d), "item_id").select("item_id", "finding_count", F.array_join(F.transform(F.map_keys("entity_counts"), lambda k: F.concat(k, F.lit(":1"))), ",").alias("types"))
)


_PURPOSE_SQL = "case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'medical_report_analysis' else 'general' end"
_ENTITY_OF_SQL = "case o_orderstatus when 'F' then 'MEDICAL_DATA' when 'O' then 'PERSON' else 'STARSIGN' end"


@_query("policy_purpose_override", f"""select item_id, case when t = 'STARSIGN' then 'BLOCK' when t = 'MEDICAL_DATA' and p = 'general' then 'BLOCK' when t = 'MEDICAL_DATA' then 'PASS' when c < 0.75 then 'REDACT' else 'TOKENIZE' end as action,
    case when t = 'STARSIGN' then 'defaults.unknown_entity' when t = 'MEDICAL_DATA' and p = 'general' then 'entities.MEDICAL_DATA' when t = 'MEDICAL_DATA' then 'purpose_overrides.medical_report_analysis.MEDICAL_DATA' when c < 0.75 then 'defaults.low_confidence' else 'entities.PERSON' end as policy_rule_id
    from (select o_orderkey as item_id, {_PURPOSE_SQL} as p, {_ENTITY_OF_SQL} as t, (o_orderkey % 100) / 100.0::double as c from orders)""")
def policy_purpose_override(spark, sf_dir):
    """Override before entity rule before default, and a floor of confidence: both forms of the policy must say the same."""
    rows = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id"), F.expr(_ENTITY_OF_SQL).alias("entity_type"), ((F.col("o_orderkey") % 100) / 100.0).alias("confidence"), F.expr(_PURPOSE_SQL).alias("purpose"))
    f = F.array(F.struct("entity_type", "confidence"))
    row_wise = rows.withColumn("f", decide.decided(f, F.col("purpose"))[0]).select("item_id", "f.action", "f.policy_rule_id")
    joined = decide.decide(rows, F.col("purpose")).select("item_id", F.col("action").alias("_action"))
    return row_wise.join(joined, "item_id").filter("action = _action").select("item_id", "action", "policy_rule_id")


# ---- sanitize, restore -------------------------------------------------------------------------------------------
_ALPHA = text.TOKEN_ALPHABET


def _token_sql(digest: str) -> str:
    """The token that the first 60 bits of a keyed digest of the value's digest spell."""
    number = f"('0x' || left({_hmac_sql(f"concat('token', chr(31), {digest})")}, 15))::bigint"
    return "'[[PGW_V1_' || entity_type || '_' || " + " || ".join(f"substr('{_ALPHA}', ((({number}) >> {5 * i}) & 31)::int + 1, 1)" for i in reversed(range(12))) + " || ']]'"


_CANON_SQL = "case when entity_type in ('PHONE', 'BANK_CARD', 'ID_CARD') then upper(regexp_replace(raw, '[\\s\\-().]', '', 'g')) else regexp_replace(raw, '\\s+', ' ', 'g') end"
_SCOPED_SQL = f"select d.*, cast(c_nationkey as varchar) as scope_id, {_CANON_SQL} as canon from ({_DECIDED_SQL}) d join customer on c_custkey = item_id"
_DIGEST_SQL = f"select *, {_hmac_sql(f'concat_ws(chr(31), {chr(39)}{TENANT}{chr(39)}, scope_id, entity_type, canon)')} as digest from ({_SCOPED_SQL})"
_VAULT_SQL = f"select scope_id, entity_type, digest, original, {_token_sql('digest')} as token from (select scope_id, entity_type, digest, min(raw) as original from ({_DIGEST_SQL}) where action = 'TOKENIZE' group by all)"
_EDITS_SQL = f"""select item_id, start, "end", case when action = 'TOKENIZE' then token else '[REDACTED]' end as repl from ({_DIGEST_SQL}) d left join ({_VAULT_SQL}) v using (scope_id, entity_type, digest) where action in ('TOKENIZE', 'REDACT')"""
_SANITIZED_SQL = f"""select i.item_id, coalesce(head || substr(text, tail + 1), text) as sanitized_text from {items_sql("claim")} i left join (
    select item_id, string_agg(substr(text, prev + 1, start - prev) || repl, '' order by start) as head, max("end") as tail from (
      select e.*, text, coalesce(lag("end") over (partition by e.item_id order by start), 0) as prev from ({_EDITS_SQL}) e join {items_sql("claim")} t on e.item_id = t.item_id) group by item_id) x on i.item_id = x.item_id"""


def tokened(rows: DataFrame, findings) -> DataFrame:
    """rows (item_id, scope_id, text) with f: merged findings with their decisions, digests and tokens. No shuffle."""
    decided = decide.decided(merge.merged(findings), F.lit("general"))
    return tokens.with_tokens(rows.withColumn("f", decided), "f", TENANT, KEY)


def tokened_claims(spark, sf_dir) -> DataFrame:
    return tokened(claims(spark, sf_dir), _claim_findings(None))


_query("token_dedup", _VAULT_SQL)(lambda s, d: tokens.mappings(tokened_claims(s, d), "f").select("scope_id", "entity_type", "digest", "original", "token"))
_query("canonical_hmac", f"select item_id, entity_type, digest from ({_DIGEST_SQL})")(lambda s, d: tokened_claims(s, d).select("item_id", F.explode("f").alias("f")).select("item_id", "f.entity_type", "f.digest"))
_query("tokenize_placeholder", _SANITIZED_SQL)(lambda s, d: tokened_claims(s, d).select("item_id", tokens.sanitized(F.col("text"), F.col("f"))["text"].alias("sanitized_text")))


@_query("restore_text", f"""select item_id as reply_id, not bool_or(action = 'REDACT') as same, count(*) filter (where action = 'TOKENIZE') as seen, count(*) filter (where action = 'TOKENIZE') as restored, 0::bigint as unknown
    from ({_DECIDED_SQL}) group by item_id""")
def restore_text(spark, sf_dir):
    """same: restoring gives the text that was sanitized, but for redacted places (numbers of one value have one spelling here)."""
    rows = written(tokened_claims(spark, sf_dir), "tokened")  # read for the texts and for the vault
    sent = rows.select(F.col("item_id").alias("reply_id"), "scope_id", F.col("text").alias("was"), tokens.sanitized(F.col("text"), F.col("f"))["text"].alias("text"))
    out = tokens.restored(sent, tokens.mappings(rows, "f"))
    return out.select("reply_id", (F.col("restored_text") == F.col("was")).alias("same"), "seen", "restored", "unknown")


@_query("vault_encrypt_roundtrip", f"select digest, original, octet_length(encode(original)) + 28 as sealed_length, true as foreign_scope_fails from ({_VAULT_SQL})")
def vault_encrypt_roundtrip(spark, sf_dir):
    rows = tokens.mappings(tokened_claims(spark, sf_dir), "f")
    bound = lambda scope: (F.lit(TENANT), scope, F.col("entity_type"), F.col("digest"), F.col("token"))
    sealed = written(rows.withColumn("sealed", keyed.seal(F.col("original"), SEAL_KEY, *bound(F.col("scope_id")))), "sealed")  # a nonce is drawn once
    opened, foreign = keyed.unseal(F.col("sealed"), SEAL_KEY, *bound(F.col("scope_id"))), keyed.unseal(F.col("sealed"), SEAL_KEY, *bound(F.lit("other")))
    return sealed.select("digest", opened.alias("original"), F.length("sealed").cast("long").alias("sealed_length"), foreign.isNull().alias("foreign_scope_fails"))


def document_findings():
    """All rules."""
    return detect.boosted(F.col("text"), detect.all_findings(F.col("text")))


def merged_sql(source: str) -> str:
    """Findings of all rules in (item_id, text), boosted and merged: the greedy fold as a recursion over an item's findings."""
    found = " union all ".join([*(shape_sql(r, source, True) for r in detect.SHAPES), *(label_sql(r, source) for r in detect.LABELS)])
    words: dict[str, list[str]] = {}
    for r in detect.LABELS:
        words.setdefault(r.entity_type, []).extend(r.labels)
    listed = lambda x: "[" + ", ".join(f"'{w}'" for w in x) + "]"
    near = " ".join(f"when '{t}' then {listed(w)}" for t, w in words.items())
    before = f'greatest(start - {detect.CONTEXT}, 0)'
    return f"""select item_id, k.a as start, k.b as "end", k.r as rule_id, k.t as entity_type, k.src as source, k.c as confidence, k.raw as raw from (
      with recursive f as ({found}),
      b as (select f.* exclude (confidence), case when source <> 'keyword' and len(list_filter(case entity_type {near} else []::varchar[] end, lambda w: contains(lower(substr(text, {before} + 1, start - {before})), w))) > 0
            then least(1.0::double, confidence + {detect.BONUS}::double) else confidence end as confidence from f join {source} x on f.item_id = x.item_id),
      o as (select item_id, start as a, "end" as b, rule_id as r, entity_type as t, list_position({listed(SEVERITY)}, entity_type) as s, source as src, confidence as c, raw,
            row_number() over (partition by item_id order by list_position(['checksum', 'regex', 'keyword'], source), list_position({listed(SEVERITY)}, entity_type), start - "end", -confidence, start, "end", rule_id) as n from b),
      m(item_id, n, kept) as (select item_id, 0::bigint, []::struct(a int, b int, r varchar, t varchar, s int, src varchar, c double, raw varchar)[] from o group by item_id
        union all select item_id, n, case when hit is null then list_append(kept, {{a: a, b: b, r: r, t: t, s: s, src: src, c: c, raw: raw}}) else
            list_transform(kept, lambda k, i: case when i = hit and s < k.s then {{a: k.a, b: k.b, r: k.r, t: t, s: s, src: k.src, c: greatest(k.c, c), raw: k.raw}} else k end) end
          from (select o.*, kept, list_position(list_transform(kept, lambda k: k.a < o.b and o.a < k.b), true) as hit from m join o on o.item_id = m.item_id and o.n = m.n + 1))
      select item_id, unnest(arg_max(kept, n)) as k from m group by item_id)"""


def decided_sql(source: str) -> str:
    return f"""select f.*, case when confidence < least_c then 'REDACT' else p.action end as action, case when confidence < least_c then 'low_confidence' else 'entity_rule' end as reason
      from ({merged_sql(source)}) f join (values {_ENTITY_SQL}) p(entity_type, action, least_c) on f.entity_type = p.entity_type"""


_CJK_SPACE = "([㐀-鿿豈-﫿])[" + _SPACES + "]+([㐀-鿿豈-﫿])"
_VALUE_SQL = f"trim(nfc_normalize(raw), {_SPACE_SQL})"
_VALUE_SQL = f"regexp_replace(regexp_replace({_VALUE_SQL}, '{_CJK_SPACE}', '\\1\\2', 'g'), '{_CJK_SPACE}', '\\1\\2', 'g')"
_CANON_ALL_SQL = f"""case when entity_type in ('PHONE', 'BANK_CARD', 'ID_CARD') then upper(regexp_replace({_VALUE_SQL}, '[{_SPACES}\\x1c-\\x1f\\-‐-―().]', '', 'g')) when entity_type = 'EMAIL' then lower({_VALUE_SQL})
  when entity_type = 'VEHICLE_PLATE' then upper(regexp_replace({_VALUE_SQL}, '[{_SPACES}\\x1c-\\x1f·\\-]', '', 'g')) else regexp_replace({_VALUE_SQL}, '[{_SPACES}\\x1c-\\x1f]+', ' ', 'g') end"""


def sanitized_sql(source: str) -> str:
    """(item_id, effective_action, reason_codes, n_findings, text_sha256) of (item_id, scope_id, text): the digest is of the whole sanitized text."""
    digest = _hmac_sql(f"concat_ws(chr(31), '{TENANT}', scope_id, entity_type, {_CANON_ALL_SQL})")
    like = text.TOKEN_LIKE.replace("'", "''")
    return f"""with x as materialized (select *, regexp_replace(text, '{like}', '((\1))', 'g') as escaped from {source}),
      d as (select d.*, scope_id, escaped from ({decided_sql(source)}) d join x on d.item_id = x.item_id), t as (select *, {digest} as digest from d),
      e as (select item_id, start, "end", escaped, case when action = 'TOKENIZE' then {_token_sql('digest')} else '[REDACTED]' end as repl, coalesce(lag("end") over (partition by item_id order by start), 0) as prev from t where action in ('TOKENIZE', 'REDACT')),
      h as (select item_id, string_agg(substr(escaped, prev + 1, start - prev) || repl, '' order by start) as head, max("end") as tail from e group by item_id),
      g as (select item_id, arg_max(action, {_RANK_SQL}) as action, string_agg(distinct reason, ',' order by reason) as reasons, count(*) as n from d group by item_id)
      select x.item_id, coalesce(g.action, 'PASS') as effective_action, coalesce(reasons, 'no_findings') as reason_codes, coalesce(n, 0) as n_findings, sha256(coalesce(head || substr(escaped, tail + 1), escaped)) as text_sha256
      from x left join h on x.item_id = h.item_id left join g on x.item_id = g.item_id"""


def sanitized_rows(rows: DataFrame) -> DataFrame:
    """rows (item_id, scope_id, text) through all rules: doubtful findings redacted, sure ones replaced by tokens of their scope.

    One pass over the texts, without a shuffle."""
    rows = tokened(rows, document_findings())
    said = decide.effective(F.col("f"), F.lit(True))
    out = tokens.sanitized(F.col("text"), F.col("f"))
    return rows.select("item_id", out["text"].alias("sanitized_text"), said["action"].alias("effective_action"), F.array_join(said["reasons"], ",").alias("reason_codes"), F.size("f").cast("long").alias("n_findings"))


def sanitize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents, by all rules, with tokens of their source."""
    return sanitized_rows(_docs(spark, sf_dir))


def _digested(df: DataFrame) -> DataFrame:
    return df.select("item_id", "effective_action", "reason_codes", "n_findings", F.sha2("sanitized_text", 256).alias("text_sha256"))


_SCOPED_DOCS = "(select doc_id as item_id, source as scope_id, text from documents)"
_query("sanitize_documents", sanitized_sql(_SCOPED_DOCS))(lambda s, d: _digested(sanitize_documents(s, d)))
_query("sanitize_pages", sanitized_sql("(select page_id as item_id, 'web' as scope_id, html as text from pages)"))(
    lambda s, d: _digested(sanitized_rows(_table(s, d, "pages").select(F.col("page_id").alias("item_id"), F.lit("web").alias("scope_id"), F.col("html").alias("text"))))
)

# a form in front of each whole document: labels with values, some spaced oddly, values that overlap a shape's in part, and near misses
_FORM = """case k % 4 when 0 then '' else '姓名: 王' || cast(k as string) || ' 小明，年龄: 40' || chr(10) end || '联系电话:  138' || lpad(cast(k as string), 8, '0') || '（办）' || chr(10) || 'id number: 110101' || cast(1950 + k % 70 as string) || lpad(cast(k % 14 as string), 2, '0') || '15' || lpad(cast(k % 1000 as string), 3, '0') || cast(k % 10 as string) || chr(10)
 || '账号 4539 5787-' || lpad(cast(k * 7919 % 100000000 as string), 8, '0') || chr(10) || case k % 3 when 0 then '病历号: MR' || cast(k as string) || chr(10) when 1 then '车牌: 京A·' || lpad(cast(k as string), 5, '0') || '，' else 'Email: U' || cast(k as string) || '@Example.org' || chr(10) end || '单位: 朝阳医院 地址：北京市朝阳区建国路' || cast(k % 90 as string) || '号楼' || chr(10)"""
_RECORDS = f"(select k as item_id, source as scope_id, {_FORM} || coalesce(text, '') as text from (select *, doc_id as k from documents))"


def record_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("k", F.col("doc_id"))
    return docs.select(F.col("k").alias("item_id"), F.col("source").alias("scope_id"), F.concat(F.expr(_FORM), F.coalesce("text", F.lit(""))).alias("text"))


_query("sanitize_records", sanitized_sql(_RECORDS))(lambda s, d: _digested(sanitized_rows(record_rows(s, d))))
_query("merge_records", merged_sql(_RECORDS))(lambda s, d: exploded(record_rows(s, d), merge.merged(document_findings())))
_DOC_DECIDED_SQL = decided_sql(_DOCS)


# ---- scalar functions --------------------------------------------------------------------------------------------
_query("fold_fullwidth", f"select item_id, {_folded_sql('text')} as folded from {items_sql('fullwidth')}")(lambda s, d: items(s, d, "fullwidth").select("item_id", text.fold_fullwidth(F.col("text")).alias("folded")))
_query("nfc_newlines", "select c_custkey as item_id, replace(replace(nfc_normalize('e' || chr(769) || c_name || chr(13) || chr(10) || 'x' || chr(13)), chr(13) || chr(10), chr(10)), chr(13), chr(10)) as normal from customer")(
    lambda s, d: _table(s, d, "customer").select(F.col("c_custkey").alias("item_id"), text.nfc_newlines(F.concat(F.lit("e\u0301"), F.col("c_name"), F.lit("\r\nx\r"))).alias("normal"))
)
_query("safe_filename", f"select item_id, left(regexp_replace(replace(text, '\\', '/'), '^.*/', ''), 128) as name from {items_sql('file')}")(lambda s, d: items(s, d, "file").select("item_id", text.safe_filename(F.col("text")).alias("name")))
_query("escape_token_like", f"select item_id, regexp_replace(text, '\\[\\[(\\s*PGW[_A-Za-z0-9]*\\s*|[A-Z_]+_[A-Z0-9]{{8,}})\\]\\]', '((\\1))', 'g') as escaped, len(regexp_extract_all(text, '\\[\\[(\\s*PGW[_A-Za-z0-9]*\\s*|[A-Z_]+_[A-Z0-9]{{8,}})\\]\\]'))::int as n from {items_sql('tokens')}")(
    lambda s, d: items(s, d, "tokens").select("item_id", text.escape_token_like(F.col("text")).alias("escaped"), text.count_token_like(F.col("text")).alias("n"))
)
_LOG_SQL = "text"
for _p in text.LOG_SECRETS:
    _LOG_SQL = f"regexp_replace({_LOG_SQL}, '{_p}', '[REDACTED]', 'g')"
_query("log_redaction", f"select item_id, {_LOG_SQL} as message from {items_sql('log')}")(lambda s, d: items(s, d, "log").select("item_id", text.redact_log(F.col("text")).alias("message")))
_query("luhn_check", f"select c_custkey as item_id, {_luhn_sql('v')} as ok from (select c_custkey, '4539 5787-' || lpad(cast(c_custkey * 7919 % 100000000 as varchar), 8, '0') as v from customer)")(
    lambda s, d: _table(s, d, "customer").select(F.col("c_custkey").alias("item_id"), checks.luhn_ok(F.expr("'4539 5787-' || lpad(cast(c_custkey * 7919 % 100000000 as string), 8, '0')")).alias("ok"))
)
_query("pseudonyms", f"select c_custkey as item_id, left({_hmac_sql('c_name')}, 16) as pseudonym from customer")(lambda s, d: _table(s, d, "customer").select(F.col("c_custkey").alias("item_id"), keyed.pseudonym(F.col("c_name"), KEY).alias("pseudonym")))
_query("canonicalize", f"select item_id, upper(regexp_replace(text, '[\\s\\-().]', '', 'g')) as phone, lower(text) as mail, upper(regexp_replace(text, '[\\s·\\-]', '', 'g')) as plate from (select k as item_id, '138-' || cast(k as string) || ' (9)' as text from (select c_custkey as k from customer))")(
    lambda s, d: (x := _table(s, d, "customer").selectExpr("c_custkey as item_id", "'138-' || cast(c_custkey as string) || ' (9)' as text")).select("item_id", text.canonical(x["text"], F.lit("PHONE")).alias("phone"), text.canonical(x["text"], F.lit("EMAIL")).alias("mail"), text.canonical(x["text"], F.lit("VEHICLE_PLATE")).alias("plate"))
)

# ---- requests: manifests, payloads, replies, messages, references, uploads, guard ------------------------------------
@_query("manifest_normalize", """with m as (select cast(conv_id as varchar) || '-' || cast(turn as varchar) as request_id, role, text, turn from conversations),
    i as (select request_id, role, 0 as position, 'a' as item_id, text, null as file_field from m
      union all select request_id, role, 1, case when turn % 3 = 0 then 'a' else 'b' end, null, case when turn % 4 = 0 then null else 'f' end from m)
    select request_id, 0 as message_index, position, role, item_id, octet_length(encode(text)) as byte_size, case when count(*) over (partition by request_id, item_id) > 1 then 'duplicate_item_id'
      when position = 0 and coalesce(text, '') = '' then 'text_required' when position = 1 and file_field is null then 'file_required' end as error_code from i""")
def manifest_normalize(spark, sf_dir):
    """A manifest for each turn: its text, and an upload that sometimes repeats the text's id or lacks its file."""
    item = lambda kind, item_id, value, field: F.struct(F.lit(kind).alias("type"), item_id.alias("item_id"), value.alias("text"), field.alias("file_field"))
    none = F.lit(None).cast("string")
    content = F.array(item("text", F.lit("a"), F.col("text"), none), item("image", F.when(F.col("turn") % 3 == 0, "a").otherwise("b"), none, F.when(F.col("turn") % 4 != 0, "f")))
    manifests = _table(spark, sf_dir, "conversations").select(F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("request_id"), F.array(F.struct("role", content.alias("content"))).alias("messages"))
    return requests.normalized(manifests).drop("type", "text", "file_field")


_query("model_payload_parse", "select k as item_id, case when k % 5 in (2, 4) then 'model_bad_payload' when k % 5 = 3 then 'model_bad_claim' end as error_code, case when k % 5 < 2 then c_name end as claimed, case when k % 5 < 2 then 0.9::double end as confidence from (select *, c_custkey as k from customer)")(
    lambda s, d: items(s, d, "payload").withColumn("p", requests.parsed_claims(F.col("text"))).select("item_id", "p.error_code", F.col("p.claims")[0]["text"].alias("claimed"), F.col("p.claims")[0]["confidence"].alias("confidence"))
)
_query("reply_parse", "select k as item_id, case when k % 5 < 2 then 'Dear ' || c_name when k % 5 = 3 then '  ' end as text, (k % 5 = 2)::int as n_tool_calls, case k % 5 when 3 then 'reply_empty' when 4 then 'reply_malformed' end as error_code from (select *, c_custkey as k from customer)")(
    lambda s, d: items(s, d, "reply").withColumn("p", requests.parsed_reply(F.col("text"))).select("item_id", "p.text", "p.n_tool_calls", "p.error_code")
)
_query("material_refs", "select conv_id, turn, 'M' || row_number() over (partition by conv_id order by turn) as ref from conversations")(
    lambda s, d: _table(s, d, "conversations").select("conv_id", "turn", F.concat(F.lit("M"), F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("string")).alias("ref"))
)
_query("message_assembly", "select conv_id, count(*) as messages, string_agg(role, ',' order by turn) as roles, sum(octet_length(encode(text)))::bigint as bytes from conversations group by conv_id")(
    lambda s, d: _table(s, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.octet_length("text").alias("n")))).alias("m")).select("conv_id", F.size("m").cast("long").alias("messages"), F.array_join("m.role", ",").alias("roles"), F.expr("aggregate(m, 0L, (a, x) -> a + x.n)").alias("bytes"))
)
_query("coverage_anti_join", f"select doc_id from documents where doc_id not in (select item_id from ({shape_sql(_SHAPES['email_address'], _DOCS)}))")(
    lambda s, d: _table(s, d, "documents").select("doc_id").join(exploded(x := _docs(s, d), detect.shape_findings(x["text"], _SHAPES["email_address"])).select(F.col("item_id").alias("doc_id")), "doc_id", "left_anti")
)
_query("withheld_semi_join", f"select item_id from {items_sql('claim')} where item_id in (select item_id from ({_DECIDED_SQL}) where action in ('BLOCK', 'LOCAL_ONLY'))")(
    lambda s, d: items(s, d, "claim").select("item_id").join(decided_claims(s, d).filter(F.col("action").isin("BLOCK", "LOCAL_ONLY")), "item_id", "left_semi")
)
@_query("resolve_overlaps", """with recursive e as (select conv_id, turn, len, row_number() over (partition by conv_id order by turn % 3 desc, len % 60 desc, turn) as n, (turn * 40)::int as a, (turn * 40 + 20 + len % 60)::int as b from (select conv_id, turn, length(text) as len from conversations)),
    r(conv_id, n, kept) as (select conv_id, 0::bigint, []::struct(a int, b int)[] from e group by conv_id
      union all select e.conv_id, e.n, case when len(list_filter(kept, lambda k: k.a < e.b and e.a < k.b)) > 0 then kept else list_append(kept, {a: e.a, b: e.b}) end from r join e on e.conv_id = r.conv_id and e.n = r.n + 1)
    select conv_id, array_to_string(list_transform(list_sort(arg_max(kept, n)), lambda k: k.a || ':' || k.b), ',') as kept from r group by conv_id""")
def resolve_overlaps(spark, sf_dir):
    edit = F.struct((F.col("turn") % 3).alias("action_rank"), F.lit(0).alias("source_rank"), (F.col("turn") * 40).alias("start"), (F.col("turn") * 40 + 20 + F.length("text") % 60).alias("end"), F.lit("").alias("replacement"))
    rows = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(edit).alias("edits"))
    kept = F.transform(merge.disjoint_edits(F.col("edits")), lambda e: F.concat_ws(":", e["start"].cast("string"), e["end"].cast("string")))
    return rows.select("conv_id", F.array_join(kept, ",").alias("kept"))


_query("redact_text", "select conv_id, turn, case when length(text) >= 12 then substr(text, 1, 3) || '[REDACTED]' || substr(text, 8, 3) || '[REDACTED]' || substr(text, 13) end as text from conversations")(
    lambda s, d: _table(s, d, "conversations").withColumn("e", F.expr("array(named_struct('start', 3, 'end', 7, 'replacement', '[REDACTED]'), named_struct('start', 10, 'end', 12, 'replacement', '[REDACTED]'))"))
    .select("conv_id", "turn", F.when(edits_error(F.col("text"), F.col("e")).isNull(), apply_edits(F.col("text"), F.col("e"))).alias("text"))
)

# ---- images, archives, bytes ---------------------------------------------------------------------------------------
_query("image_class", "select event_id, case when event_id % 7 = 0 then 'UNKNOWN_IMAGE' when event_id % 5 = 0 or event_id % 3 = 1 then 'SENSITIVE_IMAGE' when event_id % 11 = 0 then 'UNKNOWN_IMAGE' when event_type = 'view' then 'ID_DOCUMENT_IMAGE' when length(trim(props)) >= 12 then 'SENSITIVE_IMAGE' else 'ORDINARY_IMAGE' end as image_class from events")(
    lambda s, d: _table(s, d, "events").select("event_id", decide.image_class(F.col("event_id") % 5 == 0, (F.col("event_id") % 3 == 1).cast("int"), F.col("event_id") % 7 != 0, F.col("event_id") % 11 != 0, F.when(F.col("event_type") == "view", "My PassPort").otherwise(F.col("props")), "passport|identity card").alias("image_class"))
)
_HEX = "hex(encode(text))"
_BAD_SQL = "regexp_matches(h, '^(..)*(0[0-8EF]|1[0-9A-F])') or regexp_matches(h, '^(..)*([CD].|E.|E.[89AB].|F.|F.[89AB].|F.[89AB].[89AB].)$')"
_query("mime_sniff", f"""select doc_id, case when octet_length(encode(text)) = 0 and doc_id % 5 > 1 then null when doc_id % 5 = 0 then 'image/png' when {_BAD_SQL} then 'application/octet-stream' else 'text/plain' end as mime
    from (select doc_id, text, ({_HEX} || case when doc_id % 5 = 1 then '00' else '' end)[1:8192] as h from documents where text is not null)""")(
    lambda s, d: _table(s, d, "documents").filter("text is not null").select("doc_id", binary.sniffed(F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit(binary.PNG), F.col("text").cast("binary"))).when(F.col("doc_id") % 5 == 1, F.concat(F.col("text").cast("binary"), F.lit(b"\0"))).otherwise(F.col("text").cast("binary"))).alias("mime"))
)

_CLEAN_SQL = "regexp_replace(coalesce({}, ''), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g')"
_LINES_SQL = "replace(replace(nfc_normalize({}), chr(13) || chr(10), chr(10)), chr(13), chr(10))"
_query("docx_parse", f"""select item_id, sha256('[DOCUMENT]' || chr(10) || '[PROPERTIES]' || chr(10) || 'creator: Ann' || chr(10) || '[/PROPERTIES]' || chr(10) || case when trim(t, ' ' || chr(9) || chr(10) || chr(13)) = '' then '' else '[BODY]' || chr(10) || {_LINES_SQL.format('t')} || chr(10) || '[/BODY]' || chr(10) end || '[/DOCUMENT]') as text_sha256,
    not starts_with(t, 'Th') as fully_inspected, starts_with(t, 'Th')::int as media, null::varchar as error_code from (select cast(doc_id as varchar) as item_id, {_CLEAN_SQL.format('text')} as t from documents where text is not null)""")(
    lambda s, d: binary.parsed(_table(s, d, "documents").filter("text is not null").select(F.col("doc_id").cast("string").alias("item_id"), made.archived(F.col("text")).alias("data"))).select("item_id", F.sha2("text", 256).alias("text_sha256"), "fully_inspected", "media", "error_code")
)
_query("xlsx_parse", f"""select conv_id::varchar as item_id, sha256('[DOCUMENT]' || chr(10) || case when min(role) = '' then '' else '[COMMENTS]' || chr(10) || min(role) || chr(10) || '[/COMMENTS]' || chr(10) end || '[DEFINED_NAMES]' || chr(10) || 'n: a!A1' || chr(10) || '[/DEFINED_NAMES]' || chr(10) || '[SHEET]' || chr(10)
      || {_LINES_SQL.format("string_agg(case n % 3 when 2 then '7 [=' || t || ']' else t end || ' | ' || n, chr(10) order by n)")} || chr(10) || '[/SHEET]' || chr(10) || '[SHEET]' || chr(10) || '2' || chr(10) || '[/SHEET]' || chr(10) || '[/DOCUMENT]') as text_sha256, 1 as hidden, true as fully_inspected
    from (select conv_id, role, {_CLEAN_SQL.format('text')} as t, row_number() over (partition by conv_id, part order by turn) - 1 as n, part from (select *, turn // 64 as part from conversations)) where part = 0 group by conv_id""")(
    lambda s, d: xlsx_parse(s, d)
)


def xlsx_parse(spark, sf_dir):
    """A workbook for each conversation: its first 64 turn numbers as rows, the least role as a comment."""
    clean = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
    rows = _table(spark, sf_dir, "conversations").filter("turn div 64 = 0").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", clean.alias("t")))).alias("m"), F.min("role").alias("role"))
    data = rows.select(F.col("conv_id").cast("string").alias("item_id"), made.archived_workbook(F.col("m.t"), F.col("role")).alias("data"))
    return binary.parsed(data).select("item_id", F.sha2("text", 256).alias("text_sha256"), "hidden", "fully_inspected")


# ---- scopes, reports -----------------------------------------------------------------------------------------------
_SCOPE_LIMITS = {"turns": 50, "files": 20, "bytes": 3000, "pages": 200}
_query("scope_admission", """with recursive t as (select user_id, row_number() over (partition by user_id order by ts, event_id) as n, (event_type = 'purchase')::int as files, octet_length(encode(props)) as bytes, event_id % 3 as pages from events),
    r as (select user_id, 0::bigint as n, 0::bigint as tc, 0::bigint as fc, 0::bigint as bc, 0::bigint as pc, 0::bigint as refused, null::varchar as first_limit from t group by user_id
      union all select user_id, n, tc + ok, fc + ok * files, bc + ok * bytes, pc + ok * pages, refused + 1 - ok, coalesce(first_limit, lim) from (
        select *, (lim is null)::int as ok from (select t.user_id, t.n, r.tc, r.fc, r.bc, r.pc, r.refused, r.first_limit, t.files, t.bytes, t.pages,
          case when tc + 1 > 50 then 'turns' when fc + t.files > 20 then 'files' when bc + t.bytes > 3000 then 'bytes' when pc + t.pages > 200 then 'pages' end as lim from r join t on t.user_id = r.user_id and t.n = r.n + 1)))
    select cast(user_id as varchar) as scope_id, tc as turn_count, fc as file_count, bc as cumulative_bytes, pc as cumulative_pages, refused, first_limit from (select *, row_number() over (partition by user_id order by n desc) as last from r) where last = 1""")(
    lambda s, d: scopes.admitted(_table(s, d, "events").select(F.col("user_id").cast("string").alias("scope_id"), F.col("ts").alias("at"), F.col("event_id").alias("turn_id"), (F.col("event_type") == "purchase").cast("int").alias("files"), F.octet_length("props").alias("bytes"), (F.col("event_id") % 3).alias("pages")), _SCOPE_LIMITS)
)
_query("scope_idle_sessions", "select user_id, count(*) as n, min(ts) as opened, max(ts) as last from (select *, sum(new) over (partition by user_id order by ts, event_id) as s from (select *, case when ts >= lag(ts) over (partition by user_id order by ts, event_id) + interval 2 hours then 1 else 0 end as new from events)) group by user_id, s")(
    lambda s, d: _table(s, d, "events").groupBy("user_id", F.session_window("ts", "2 hours")).agg(F.count("*").alias("n"), F.min("ts").alias("opened"), F.max("ts").alias("last")).select("user_id", "n", "opened", "last")
)
_query("scope_expiry", "select user_id, least(max(ts) + interval 1 hour, min(ts) + interval 10 days) as expires_at from events group by user_id")(
    lambda s, d: _table(s, d, "events").groupBy("user_id").agg(F.max("ts").alias("last"), F.min("ts").alias("first")).select("user_id", scopes.expires(F.col("last"), F.col("first"), 3600, 864000).alias("expires_at"))
)
_BUCKETS = ", ".join(f"({b}::double)" for b in DURATION_BUCKETS)
_query("duration_histogram", f"select event_type, le, count(*) filter (where value <= le) as n from events, (values {_BUCKETS}) b(le) group by all")(lambda s, d: reports.durations(_table(s, d, "events"), "value", "event_type"))
_query("severity_counts", f"select entity_type, list_position(['{(chr(39) + ', ' + chr(39)).join(SEVERITY)}'], entity_type)::int - 1 as severity, count(*) as n, round(avg(confidence), 6) as mean_confidence from ({_MERGED_SQL}) group by all")(
    lambda s, d: merged_claims(s, d).groupBy("entity_type").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence")).select("entity_type", (F.array_position(F.array(*(F.lit(x) for x in SEVERITY)), F.col("entity_type")).cast("int") - 1).alias("severity"), "n", "mean_confidence")
)
