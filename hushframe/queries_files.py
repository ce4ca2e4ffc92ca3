"""Registered queries of files: PDFs, pictures with what recognition and a vision model say about them, findings by page."""

from __future__ import annotations

import re

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from .operators import detect, vision
from .plans.vocabulary import DOCUMENT_KEYWORDS, IMAGE_CLASSES, VISION
from .queries import _LINES_SQL, _SPACE_SQL, _query, _table
from .sources import binary, made, ocr
from .sources.pdf import LEAST_TEXT, MOST_PAGES

KEYWORDS = "(?:" + "|".join(re.escape(k) for k in DOCUMENT_KEYWORDS) + ")"

# ---- a PDF for each document: its text on pages of 150 characters, lines of 50 -----------------------------------------
_PER_PAGE, _LINE = 150, 50
_CLEAN = "regexp_replace(coalesce(text, ''), '[\\x00-\\x1f\\x7f-\\x9f]', ' '{})"


def pdf_files(spark, sf_dir) -> DataFrame:
    """Every third with packed objects; the source as a note, the language as author. Null texts give null files."""
    docs = _table(spark, sf_dir, "documents").withColumn("clean", F.when(F.col("text").isNotNull(), F.expr(_CLEAN.replace("\\", "\\\\").format(""))))
    cut = lambda text, size: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length(text) - 1) / size).cast("int"))), lambda i: F.substring(text, i * size + 1, F.lit(size)))
    pages = F.transform(cut(F.col("clean"), _PER_PAGE), lambda p: F.array_join(cut(p, _LINE), "\n"))
    return made.paged(docs.select(F.col("doc_id").cast("string").alias("item_id"), F.when(F.col("clean").isNotNull(), pages).alias("pages"), F.col("source").alias("note"), F.col("lang").alias("author"), (F.col("doc_id") % 3 == 0).alias("packed")))


_PAGES_SQL = f"""(select *, generate_subscripts(pages, 1) as n, unnest(pages) as page from (select doc_id, source, lang, text is null as gone, list_transform(range(0, greatest(1, (length(c) + {_PER_PAGE} - 1) // {_PER_PAGE})), lambda i:
    array_to_string(list_transform(range(0, greatest(1, (length(c[i * {_PER_PAGE} + 1 : (i + 1) * {_PER_PAGE}]) + {_LINE} - 1) // {_LINE})), lambda j: c[i * {_PER_PAGE} + j * {_LINE} + 1 : least((i + 1) * {_PER_PAGE}, i * {_PER_PAGE} + (j + 1) * {_LINE})]), chr(10))) as pages
    from (select *, {_CLEAN.format(", 'g'")} as c from documents)))"""
_GOOD_SQL = f"length(trim(page, {_SPACE_SQL})) >= {LEAST_TEXT}"
_PDF_SQL = f"""select doc_id::varchar as item_id, case when ok then sha256('[DOCUMENT]' || chr(10) || body || case when source = '' or source is null then '' else '[ANNOTATIONS]' || chr(10) || source || chr(10) || '[/ANNOTATIONS]' || chr(10) end
      || case when lang = '' or lang is null then '' else '[PROPERTIES]' || chr(10) || 'Author: ' || lang || chr(10) || '[/PROPERTIES]' || chr(10) end || '[/DOCUMENT]') end as text_sha256,
    case when ok then pages else 0 end as pages, case when ok then missing else 0 end as pages_missing, ok and missing = 0 as fully_inspected, case when gone then 'empty' when pages > {MOST_PAGES} then 'pdf_too_many_pages' end as error_code
    from (select doc_id, any_value(source) as source, any_value(lang) as lang, any_value(gone) as gone, count(*)::int as pages, count(*) filter (where not {_GOOD_SQL})::int as missing, not any_value(gone) and count(*) <= {MOST_PAGES} as ok,
      coalesce(string_agg('[PAGE ' || n || ']' || chr(10) || {_LINES_SQL.format("page")} || chr(10) || '[/PAGE]' || chr(10), '' order by n) filter (where {_GOOD_SQL}), '') as body from {_PAGES_SQL} group by doc_id)"""
_query("pdf_parse", _PDF_SQL)(lambda s, d: binary.parsed(pdf_files(s, d)).select("item_id", F.sha2("text", 256).alias("text_sha256"), "pages", "pages_missing", "fully_inspected", "error_code"))
_query("pdf_segments", f"""select doc_id::varchar as item_id, 'PAGE' as label, n::int as page, length({_LINES_SQL.format("page")})::int as size, sha256({_LINES_SQL.format("page")}) as text_sha256
    from {_PAGES_SQL} where not gone and len(pages) <= {MOST_PAGES} and {_GOOD_SQL}""")(
    lambda s, d: binary.parsed(pdf_files(s, d)).select("item_id", "text", F.explode("segments").alias("s")).filter("s.label = 'PAGE'")
    .select("item_id", "s.label", "s.page", (F.col("s.end") - F.col("s.start")).alias("size"), F.sha2(F.expr("substring(text, s.start + 1, s.end - s.start)"), 256).alias("text_sha256"))
)
_MAIL = next(r for r in detect.SHAPES if r.rule_id == "email_address")
_query("pdf_findings", f"""select doc_id::varchar as item_id, n::int as page, count(*) as n from (select *, unnest(regexp_extract_all(page, '(^|[^A-Za-z0-9._%+\\-])({_MAIL.core})', 2)) from {_PAGES_SQL} where not gone and len(pages) <= {MOST_PAGES} and {_GOOD_SQL}) group by all""")(
    lambda s, d: binary.parsed(pdf_files(s, d)).select("item_id", F.explode(binary.located(detect.all_findings(F.col("text"), [_MAIL], []), F.col("segments"))).alias("f")).filter("f.label = 'PAGE'").groupBy("item_id", "f.page").agg(F.count("*").alias("n"))
)

# ---- a picture for each page of the web: real bytes; recognition in both layouts; verdicts by content --------------------
_SHAPE = ("page_id % 50 as w", "1 + length(url) % 40 as h", "case when page_id % 2 = 0 then 'png' else 'jpeg' end as kind", "case page_id % 5 when 0 then null when 1 then 'gps' when 2 then 'Author' end as said", "page_id % 11 = 0 as cut")
_SEEN = "case page_id % 6 when 0 then 'My PassPort No ' || cast(page_id as string) when 2 then ' ok ' when 3 then substr(url, 1, 40) when 4 then '护照 ' || substr(url, 1, 9) end"


def pictures(spark, sf_dir) -> DataFrame:
    """(item_id, data, answer, verdict): what recognition said about each (nothing, for some; broken, for some), as JSON."""
    rows = _table(spark, sf_dir, "pages").selectExpr("page_id", *_SHAPE, f"{_SEEN} as seen")
    quoted = F.regexp_extract(F.to_json(F.array("seen")), r"^\[(.*)\]$", 1)
    rowwise = F.concat(F.lit("[[[[0,0],"), quoted, F.lit(",0.5],[[1,1],\"x\",0.25],[1]],0.1]"))
    parallel = F.concat(F.lit('{"txts":['), quoted, F.lit(',"x"],"scores":[0.5,0.25],"complete":'), (F.col("page_id") % 7 != 0).cast("string"), F.lit("}"))
    answer = F.when(F.col("page_id") % 13 == 0, None).when(F.col("page_id") % 17 == 0, "{broken").when(F.col("seen").isNull(), F.when(F.col("page_id") % 4 == 1, "[null, 0.1]").otherwise('{"txts":[],"scores":null}')).when(F.col("page_id") % 4 < 2, rowwise).otherwise(parallel)
    categories = F.array(*(F.lit(f'{{"category": "{c}", "reason": "r"}}') for c in VISION), F.lit('{"category": "ordinary"}'))
    data = made.pictured(F.col("w").cast("int"), F.col("h").cast("int"), F.col("kind"), F.col("said"), F.col("cut"))
    return rows.select(F.col("page_id").cast("string").alias("item_id"), data.alias("data"), answer.alias("answer"), F.element_at(categories, ((F.col("w") + F.col("h")) % 5 + 1).cast("int")).alias("verdict"))


_ANSWER_SQL = f"""(select *, page_id % 13 = 0 as absent, page_id % 13 <> 0 and page_id % 17 = 0 as broken, case when seen is null then '' else seen || chr(10) || 'x' end as ocr_text, seen is null or page_id % 4 < 2 or page_id % 7 <> 0 as complete
    from (select page_id, {', '.join(_SHAPE)}, {_SEEN} as seen from pages))"""
_query("ocr_lines", f"""select page_id::varchar as item_id, case when not (absent or broken) then ocr_text end as text, case when not (absent or broken) then case when seen is null then 0 else 0.375 end::double end as mean_confidence, case when not (absent or broken) then case when seen is null then 0 else 2 end end as n_lines,
    not absent and not broken and complete as complete, case when absent then 'ocr_unavailable' when broken then 'ocr_unreadable' end as error_code from {_ANSWER_SQL}""")(
    lambda s, d: pictures(s, d).select("item_id", ocr.recognized(F.col("answer")).alias("o")).select("item_id", "o.text", "o.mean_confidence", F.when(F.col("o.lines").isNotNull(), F.size("o.lines")).alias("n_lines"), "o.complete", "o.error_code")
)


@_query("image_inspection", f"""with a as (select *, (said = 'gps') is true as gps, case when kind = 'png' and said is not null then 'png:' || said when kind = 'jpeg' and said = 'Author' then 'jpeg:comment' end as field, w = 0 as sizeless from {_ANSWER_SQL}),
    c as (select *, case when sizeless or cut then 'UNKNOWN_IMAGE' when gps or field is not null then 'SENSITIVE_IMAGE' when absent or broken or not complete then 'UNKNOWN_IMAGE' when contains(lower(ocr_text), 'passport') or contains(ocr_text, '护照') then 'ID_DOCUMENT_IMAGE' when length(trim(ocr_text)) >= 12 then 'SENSITIVE_IMAGE' else 'ORDINARY_IMAGE' end as heuristic,
      case (w + h) % 5 when 0 then 'ID_DOCUMENT_IMAGE' when 2 then 'ORDINARY_IMAGE' when 4 then 'ORDINARY_IMAGE' else 'SENSITIVE_IMAGE' end as verdict from a)
    select page_id::varchar as item_id, 'image/' || kind as mime, case when sizeless then 0 else w end::int as width, case when sizeless then 0 else h end::int as height, not sizeless and gps as has_gps, case when sizeless then '' else coalesce(field, '') end as fields, case when sizeless then 'image_size' when cut then 'image_truncated' end as error_code,
      case when list_position({list(IMAGE_CLASSES)}, verdict) > list_position({list(IMAGE_CLASSES)}, heuristic) then verdict else heuristic end as image_class from c""")
def image_inspection(spark, sf_dir):
    """Pictures from bytes to class: metadata, recognized text, the rules, then the verdicts on the same content."""
    rows = pictures(spark, sf_dir)
    seen = rows.select("item_id", ocr.recognized(F.col("answer")).alias("o"), "data")
    read = binary.parsed(rows).join(seen, "item_id")
    classed = binary.classified(read, F.coalesce("o.text", F.lit("")), F.col("o.complete"), KEYWORDS)
    verdicts = rows.select(F.sha2("data", 256).alias("sha256"), F.col("verdict").alias("answer")).distinct()
    return vision.tightened(classed, verdicts).select("item_id", "mime", "width", "height", "has_gps", F.array_join("fields", ",").alias("fields"), "error_code", "image_class")
