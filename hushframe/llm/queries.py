"""The registered queries of this subpackage: each operator over its whole table, with the digest columns asked for."""

from __future__ import annotations

import public_tokenizers
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from . import alignment, ann_tree, bloom_cascade, exact_topk, jaccard_join, merkle, mixing, packing, perspectives, quality_knn, secret_ledger, suffix_dedup, token_counts

URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.integer_top_k(_table(spark, sf_dir, "embeddings"))


def op2_ann_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, said = ann_tree.cosine_neighbours(_table(spark, sf_dir, "embeddings"))
    return out.withColumns({"measured_recall": F.lit(float(said["measured"])), "visited_leaves": F.lit(said["visits"]), "leaves": F.lit(said["leaves"])})


def op3_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives.rotate(_table(spark, sf_dir, "conversations"))


def op4_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = quality_knn.scored(docs, quality_knn.fit(docs, _table(spark, sf_dir, "labels")))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= quality_knn.THRESHOLD).cast("int").alias("predicted"))


def op5_bloom_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return bloom_cascade.judge(_table(spark, sf_dir, "pages"), rules).drop("url")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, said = mixing.mixed(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    domains = [F.element_at("p", i + 1).alias(f"p_{name}") for i, name in enumerate(mixing.DOMAINS)]
    # what was reached against what was wanted, as shares of all expected tokens
    whole = max(sum(said["wanted"].values()), 1.0)
    reached = [F.lit(float(said["reached"][name] / whole)).alias(f"reached_{name}") for name in mixing.DOMAINS]
    return out.select("doc_id", "tokens", *domains, "rate", "copies", *reached, F.lit(said["met"]).alias("met"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "text")


def op8_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = secret_ledger.scan(_table(spark, sf_dir, "documents"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")
    base = F.filter("findings", lambda f: f["kind"].isin(*secret_ledger.BASE_RULES))
    count = lambda kind: F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *(count(k) for k in secret_ledger.BASE_RULES), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("findings")).alias("spans"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.token_pieces(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard_join.similar_texts(_table(spark, sf_dir, "documents"), k=4, similarity=85)["documents"]
    return out.select("doc_id", "n_shingles", "component_id", "n_links")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    columns = {c: F.col(c) for c in merkle.COLUMNS}
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    manifest = merkle.build(docs, carry={"tampered": F.when(hit, merkle.leaf(columns | {"text": lower}))})
    out = merkle.proofs(manifest).select(F.col("row.at").alias("doc_id"), F.col("row.node").alias("leaf"), "subroot", F.lit(manifest.root).alias("root"), merkle.proof_digest(F.col("path")).alias("proof_sha256"), merkle.folded(F.coalesce("row.tampered", "row.node"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.link_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.over_limit(token_counts.counted(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")))


QUERIES = {f.__name__: f for f in (op1_exact_topk, op2_ann_tree, op3_perspectives, op4_quality_knn, op5_bloom_cascade, op6_mixing, op7_suffix_dedup, op8_secret_ledger, op9_packing, op10_jaccard_join, op11_merkle_manifest, op12_alignment, op13_token_counts)}

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _spans(kind: str, rank: int) -> str:
    """A SELECT of (doc_id, start, rank, kind, stop) of one kind's matches: marked by one replacement, then split at the marks."""
    pattern, least, group, _ = secret_ledger.RULES[kind]
    quoted = pattern.replace("'", "''")
    length = f"length(regexp_extract(p, '{quoted}', {group}))" if group else "length(p)"
    return f"""
    select doc_id, start, {rank} as rank, '{kind}' as kind, start + length(p) as stop
    from (select doc_id, i, p, coalesce(sum(length(p)) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0)::bigint as start
          from (select doc_id, unnest(parts) as p, generate_subscripts(parts, 1) as i
                from (select doc_id, string_split(regexp_replace(translate(coalesce(text, ''), chr(1), chr(2)), '({quoted})', chr(1) || '\\1' || chr(1), 'g'), chr(1)) as parts from documents)))
    where i % 2 = 0 and {length} >= {least}"""


def _secrets_sql() -> str:
    found = " union all ".join(_spans(kind, rank) for rank, kind in enumerate(secret_ledger.RULES))
    base = ", ".join(f"'{k}'" for k in secret_ledger.BASE_RULES)
    counts = ", ".join(f"count(*) filter (where kind = '{k}') as n_{k}" for k in secret_ledger.BASE_RULES)
    text = "kind || ':' || start || ':' || stop"
    return f"""with found as ({found})
    select documents.doc_id, {counts},
           sha256(coalesce(string_agg({text}, ',' order by start, rank) filter (where kind in ({base})), '')) as base_sha256,
           coalesce(string_agg({text}, ',' order by start, rank) filter (where kind is not null), '') as spans
    from documents left join found on documents.doc_id = found.doc_id group by documents.doc_id"""


def _urls_sql() -> str:
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
    return f"""with rules(h, p, v) as (values {rules}),
    rest as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as r from pages),
    parts as (select page_id, translate(regexp_extract(r, '^[^/?#]*'), {_AZ}) as host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) as path from rest),
    fit as (select page_id, host, path, h || p as rule, v, row_number() over (partition by page_id order by length(h || p) desc, length(h) desc) as n
            from parts left join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p))
    select page_id, host, path, rule, coalesce(v, 'allow') as verdict from fit where n = 1"""


def _merkle_sql() -> str:
    leaf = lambda text: "sha256(" + " || ".join(f"coalesce(strlen({c}::varchar) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    bits = "list_reduce([xor(c, b)] || range(8), lambda x, i: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)"
    crc = f"xor(list_reduce([4294967295::bigint] || list_transform(string_split(doc_id::varchar, ''), lambda d: ascii(d)::bigint), lambda c, b: {bits}), 4294967295)"
    up = lambda t: f"select part, level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(node, '' order by pos)) from {t} where n > 1 group by part, level, n, pos // 16"
    beside = lambda t: f"""select part, level, pos, coalesce(string_agg(node, '') over (w rows between unbounded preceding and 1 preceding), '') as l,
        coalesce(string_agg(node, '') over (w rows between 1 following and unbounded following), '') as r from {t} where n > 1 window w as (partition by part, level, pos // 16 order by pos)"""  # noqa: E731
    fold = lambda f, b: f"select {f}.part, row, {f}.level + 1, {f}.pos // 16, sha256(l || acc || r), proof || l || r from {f} join {b} using (part, level, pos)"
    last = "qualify row_number() over (partition by row order by level desc) = 1"
    return f"""with recursive d as (select coalesce('+' || source, '') as part, doc_id, {leaf('text')} as leaf, {leaf(f"translate(text, {_AZ})")} as lower_leaf, coalesce({crc} % 5 = 0, false) as hit from documents),
    e as (select *, row_number() over (partition by part order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by part) as n, row_number() over () as row from d),
    t(part, level, pos, n, node) as (select part, 0, pos, n, leaf from e union all {up('t')}),
    s as (select part as own, node as subroot, row_number() over (order by encode(part)) - 1 as pos, count(*) over () as n from t where n = 1),
    u(part, level, pos, n, node) as (select '', 0, pos, n, subroot from s union all {up('u')}),
    tb as ({beside('t')}), ub as ({beside('u')}),
    f(part, row, level, pos, acc, proof) as (select part, row, 0, pos, case when hit then lower_leaf else leaf end, '' from e union all {fold('f', 'tb')}),
    g(part, row, level, pos, acc, proof) as (select '', row, 0, s.pos, acc, proof from (select * from f {last}) f join s on f.part = s.own union all {fold('g', 'ub')})
    select doc_id, leaf, subroot, node as root, sha256(proof) as proof_sha256, acc as folded_root, acc = node as verified
    from e join (select * from g {last}) g using (row) join s on e.part = s.own cross join (select node from u where n = 1)"""


ORACLES = {
    "op1_exact_topk": """with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
        where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    s as (select a.vec_id as query_id, b.vec_id, list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2]))::bigint as score
          from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id)
    select query_id, rank::integer as rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 5""",
    "op3_perspectives": """with t as (select distinct conv_id, turn, coalesce(role, 'unknown') as who, coalesce(text, '') as text, turn // 64 as part from conversations where conv_id is not null and turn is not null),
    p as (select distinct conv_id, who as speaker from t where who <> 'system'),
    r as (select conv_id, speaker, part, turn, who, text, case when who = speaker then '<|im_start|>assistant' when who = 'system' then '<|im_start|>system' else '<|im_start|>user name=' || who end || chr(10) as head from t join p using (conv_id)),
    m as (select *, coalesce(sum(length(head) + length(text) + 11) over (partition by conv_id, speaker, part order by turn, who, text rows between unbounded preceding and 1 preceding), 0)::bigint + length(head) as a from r),
    g as (select conv_id, speaker, part, string_agg(head || text || '<|im_end|>' || chr(10), '' order by turn, who, text) as text,
                 coalesce(string_agg(a || ':' || (a + length(m.text)), ',' order by turn, who, m.text) filter (where who = speaker), '') as mask from m group by conv_id, speaker, part)
    select conv_id, speaker, part, coalesce(sum(length(text)) over (partition by conv_id, speaker order by part rows between unbounded preceding and 1 preceding), 0)::bigint as start, text, mask from g""",
    "op5_bloom_cascade": _urls_sql(),
    "op7_suffix_dedup": """with h as (select doc_id, row_number() over () as r, hex(encode(coalesce(text, ''))) as x from documents),
    w as (select r, i, md5_number(x[2 * i + 1 : 2 * i + 800]) as m from (select r, x, unnest(range(0, length(x) // 2 - 399)) as i from h)),
    c as (select r, i from (select r, i, count(*) over (partition by m) as n from w) where n > 1),
    s as (select r, lo, max(i) + 400 as hi from (select r, i, max(new) over (partition by r order by i) as lo from (
        select r, i, case when i <= lag(i) over (partition by r order by i) + 400 then null else i end as new from c)) group by r, lo),
    k as (select r, coalesce(lag(hi) over (partition by r order by lo), 0) as a, lo as b, hi from s),
    p as (select r, string_agg(x[2 * a + 1 : 2 * b], '' order by a) as head, max(hi) as hi, sum(hi - b)::bigint as n_removed, count(*) as n_spans from k join h using (r) group by r),
    o as (select doc_id, length(x) // 2 as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, case when hi is null then x else coalesce(head, '') || x[2 * hi + 1 :] end as y from h left join p using (r))
    select doc_id, n_bytes, n_removed, n_spans, sha256(unhex(y)) as kept_sha256,
      decode(unhex(regexp_replace(y, '([0-7].|[CD].[89AB].|E.[89AB].[89AB].|F.[89AB].[89AB].[89AB].)|..', '\\1', 'g'))) as text from o""",
    "op8_secret_ledger": _secrets_sql(),
    "op11_merkle_manifest": _merkle_sql(),
    "op10_jaccard_join": f"""with recursive w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), {_AZ}), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
    l as (select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')) end) as l from w),
    s as (select doc_id, unnest(l) as sh from l),
    o as (select a.doc_id as x, b.doc_id as y, count(*) as i from s a join s b on a.sh = b.sh and a.doc_id <> b.doc_id group by all),
    e as (select x, y, list_sort(q.l) as other, list_sort(p.l) <> list_sort(q.l) as new from o join l p on x = p.doc_id join l q on y = q.doc_id where 100 * i >= 85 * (len(p.l) + len(q.l) - i)),
    r(x, y) as (select doc_id, doc_id from l union select r.x, e.y from r join e on r.y = e.x),
    k as (select x, count(distinct other) as n_links from e where new group by x)
    select l.doc_id, any_value(len(l.l))::bigint as n_shingles, min(r.y) as component_id, coalesce(any_value(k.n_links), 0) as n_links from l join r on l.doc_id = r.x left join k on l.doc_id = k.x group by l.doc_id""",
}
