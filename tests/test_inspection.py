"""Unit vectors and properties of the inspection dataflow; SQL comparisons of all queries are in test_queries.py."""

import hashlib
import hmac
import io
import random
import re
import struct
import zipfile
import zlib

import pyspark.sql.functions as F
import pytest

from hushframe.functions import checks, keyed, text
from hushframe.functions import spans as span_functions
from hushframe.functions.spans import occurrences
from hushframe.operators import decide, detect, merge, scopes, tokens
from hushframe.plans.vocabulary import POLICY, checked_policy
from hushframe.sources import binary


def one(spark, column, value=None):
    return spark.createDataFrame([(value,)], "text string").select(column.alias("x")).first().x


def spans(spark, value, rule):
    found = detect.shape_findings(F.col("text"), next(r for r in detect.SHAPES if r.rule_id == rule))
    return [(f.start, f.raw, f.source, round(f.confidence, 6)) for f in one(spark, found, value)]


@pytest.mark.parametrize(
    ("value", "rule", "want"),
    [
        ("id 110101199003079999x", "cn_id_card_18", [(3, "110101199003079999", "checksum", 0.99)]),
        ("110101 19900307 123X", "cn_id_card_18", None),
        ("110101199913079999", "cn_id_card_18", []),
        ("320502900307999", "cn_id_card_15", [(0, "320502900307999", "regex", 0.7)]),
        ("320502991307999", "cn_id_card_15", []),
        ("0512-87654321 (010) 88886666", "cn_landline", [(0, "0512-87654321", "regex", 0.65), (14, "(010) 88886666", "regex", 0.65)]),
        ("051287654321", "cn_landline", []),
        ("卡 4539578763621486.", "bank_card_luhn", [(2, "4539578763621486", "checksum", 0.99)]),
        ("4539578763621487", "bank_card_luhn", [(0, "4539578763621487", "regex", 0.55)]),
        ("苏E·12345 京A12345", "cn_vehicle_plate", [(0, "苏E·12345", "regex", 0.85), (9, "京A12345", "regex", 0.85)]),
        ("91350100M000100Y43", "cn_uscc", [(0, "91350100M000100Y43", "checksum", 0.99)]),
        ("😀１３８-1234-5678", "cn_phone_mobile", [(1, "１３８-1234-5678", "regex", 0.85)]),
        ("wei.zhang@example.invalid,", "email_address", [(0, "wei.zhang@example.invalid", "regex", 0.92)]),
        ("E12345678 P1234567", "cn_travel_document", [(0, "E12345678", "regex", 0.6), (10, "P1234567", "regex", 0.6)]),
        (None, "email_address", None),
    ],
)
def test_pattern_vectors(spark, value, rule, want):
    if value is None:
        assert one(spark, detect.shape_findings(F.col("text"), detect.SHAPES[0]), None) is None
    elif want is None:
        assert [s[1] for s in spans(spark, value, rule)] == [value]
    else:
        assert spans(spark, value, rule) == want


def test_labels_stop_at_columns_and_signs(spark):
    rule = {r.rule_id: r for r in detect.LABELS}
    got = lambda value, name: [(f.start, f.raw) for f in one(spark, detect.label_findings(F.col("text"), rule[name]), value)]
    assert got("被保险人  张伟          身份证号 3205", "label_person") == [(6, "张伟")]
    assert got("Name: Wei Zhang | Age", "label_person") == [(6, "Wei Zhang")]
    assert got("hotel 12", "label_phone") == [(6, "12")]
    assert got("姓名：\n", "label_person") == []


def test_merge_keeps_span_and_takes_the_stricter_type(spark):
    make = lambda rule, kind, source, conf, a, b: detect.finding(rule, kind, F.lit(source), F.lit(conf), F.lit(a), F.lit(b), F.lit("v"))
    found = F.array(make("a", "ORGANIZATION", "regex", 0.5, 5, 15), make("b", "ID_CARD", "keyword", 0.8, 10, 30), make("c", "EMAIL", "keyword", 0.7, 40, 45), make("d", "EMAIL", "local_model", 0.9, 16, 20))
    got = one(spark, merge.merged(found))
    assert [(f.start, f.end, f.entity_type, f.confidence, f.trail) for f in got] == [(5, 15, "ID_CARD", 0.8, ["regex:a", "keyword:b"]), (16, 20, "EMAIL", 0.9, ["local_model:d"]), (40, 45, "EMAIL", 0.7, ["keyword:c"])]


def test_merged_findings_are_disjoint(spark):
    r = random.Random(8)
    rows = [(i, [(r.randrange(80), r.randrange(1, 20), r.randrange(3)) for _ in range(r.randrange(12))]) for i in range(100)]
    df = spark.createDataFrame(rows, "id int, s array<struct<a:int,n:int,k:int>>")
    make = F.transform("s", lambda s: F.when(s["k"] == 0, detect.finding("r", "EMAIL", F.lit("regex"), F.lit(0.5), s["a"], s["a"] + s["n"], F.lit(""))).otherwise(detect.finding("q", "PHONE", F.lit("keyword"), F.lit(0.6), s["a"], s["a"] + s["n"], F.lit(""))))
    for row in df.select("s", merge.merged(make).alias("m")).collect():
        places = [(f.start, f.end) for f in row.m]
        assert all(a[1] <= b[0] for a, b in zip(places, places[1:]))
        assert sum(len(f.trail) for f in row.m) == len(row.s)


def test_checks_digests_and_canonical_forms(spark):
    assert one(spark, checks.id_ok(F.col("text")), "11010119900307999" + "10X98765432"[sum(int(c) * w for c, w in zip("11010119900307999", checks.ID_WEIGHTS)) % 11])
    assert not one(spark, checks.luhn_ok(F.col("text")), "42")
    assert one(spark, keyed.hmac_sha256(F.col("text"), b"k" * 32), "é") == hmac.new(b"k" * 32, "é".encode(), hashlib.sha256).hexdigest()
    canon = lambda v, t: one(spark, text.canonical(F.col("text"), F.lit(t)), v)
    assert canon("138-1234 5678", "PHONE") == canon("１３８１２３４５６７８", "PHONE") == "13812345678"
    assert canon("+86 138", "PHONE") == "+86138"
    assert canon(" 张 伟 ", "PERSON") == "张伟" and canon("Wei  Zhang", "PERSON") == "Wei Zhang"
    assert canon("A@B.C", "EMAIL") == "a@b.c" and canon("苏e·1-2", "VEHICLE_PLATE") == "苏E12"
    sealed = keyed.unseal(keyed.seal(F.col("text"), b"\1" * 32, F.lit("t")), b"\1" * 32, F.lit("t"))
    assert one(spark, sealed, "x") == "x"
    assert [(s.start, s.end) for s in one(spark, occurrences(F.col("text"), F.lit("aa")), "😀aaab\\Eaa")] == [(1, 3), (2, 4), (7, 9)]


def test_tokens_round_trip(spark):
    rows = [(1, "s", "Tel: 13812345678 and card 4539578763621486 [[PGW_V1_PERSON_ABCDEFGHJKLM]]"), (2, "s", "１３８１２３４５６７８, Tel: 138-1234-5678"), (3, "t", "Tel: 13812345678"), (4, "t", None)]
    items = spark.createDataFrame(rows, "item_id long, scope_id string, text string")
    shapes = [r for r in detect.SHAPES if r.rule_id in ("cn_phone_mobile", "bank_card_luhn")]
    found = merge.merged(detect.boosted(F.col("text"), detect.all_findings(F.col("text"), shapes, [])))
    rows = tokens.with_tokens(items.withColumn("f", decide.decided(found, F.lit("general"))), "f", "t", b"k" * 32).cache()
    vault = tokens.mappings(rows, "f").cache()
    assert vault.count() == 3 and vault.select("token").distinct().count() == 3  # one spelling of a number is one value of a scope
    assert all(re.fullmatch(text.TOKEN, r.token) for r in vault.collect())
    sent = rows.select(F.col("item_id").alias("reply_id"), "scope_id", tokens.sanitized(F.col("text"), F.col("f"))["text"].alias("text"))
    texts = {r.reply_id: r.text for r in sent.collect()}
    assert "((PGW_V1_PERSON_ABCDEFGHJKLM))" in texts[1] and "138" not in texts[2] and texts[4] is None
    back = {r.reply_id: r for r in tokens.restored(sent, vault).collect()}
    assert back[1].restored_text == "Tel: 138-1234-5678 and card 4539578763621486 ((PGW_V1_PERSON_ABCDEFGHJKLM))" and back[1].seen == back[1].restored == 2
    assert back[2].seen == 2 and len(set(re.findall(text.TOKEN, texts[2]))) == 1
    other = tokens.restored(spark.createDataFrame([(1, "elsewhere", texts[1])], "reply_id long, scope_id string, text string"), vault).first()
    assert other.restored == 0 and other.unknown == 2 and other.restored_text == texts[1]
    pending = rows.select("scope_id", F.explode("f").alias("f")).select("scope_id", "f.entity_type", "f.raw")
    assert tokens.allocate(pending, "t", b"k" * 32, vault).count() == 0
    assert {r.token for r in tokens.allocate(pending, "t", b"k" * 32).collect()} == {r.token for r in vault.collect()}
    long = spark.createDataFrame([(1, "s", "x" * 500_001), (2, "s", texts[3] * 5_001)], "reply_id long, scope_id string, text string")
    limits = {r.reply_id: (r.error_code, r.restored_text) for r in tokens.restored(long, vault.withColumn("scope_id", F.lit("s"))).collect()}
    assert limits == {1: ("reply_too_long", None), 2: ("too_many_substitutions", None)}


def test_many_spans_and_edits(spark):
    line = "😀 a1 " * 3000
    df = spark.createDataFrame([(line,), ("none",), (None,)], "t string")
    got = [r.s for r in df.select(span_functions.find_all(F.col("t"), "a1").alias("s")).collect()]
    assert [(s.start, s.end) for s in got[0]] == [(i * 5 + 2, i * 5 + 4) for i in range(3000)] and got[1] == [] and got[2] is None
    edit = "array_sort(transform(sequence(0, 2999), i -> named_struct('start', cast(i * 5 + 2 as int), 'end', cast(i * 5 + 4 as int), 'replacement', 'b')))"
    out = df.limit(1).withColumn("e", F.expr(edit)).select(span_functions.apply_edits(F.col("t"), F.col("e")).alias("x"), span_functions.edits_error(F.col("t"), F.col("e")).alias("bad"), span_functions.edits_error(F.lit("short"), F.col("e")).alias("worse")).first()
    assert out.x == "😀 b " * 3000 and out.bad is None and out.worse == "span_conflict"


def test_policy_is_checked(spark):
    assert checked_policy(POLICY)
    for broken in ({**POLICY, "entitys": {}}, {**POLICY, "defaults": {}}, {**POLICY, "entities": {"NOBODY": ("PASS", 0.5)}}, {**POLICY, "entities": {"PHONE": ("ALLOW", 0.5)}}):
        with pytest.raises(ValueError):
            checked_policy(broken)


def test_failed_inspection_never_passes(spark):
    items = spark.createDataFrame([("a", True), ("b", False)], "item_id string, ok boolean")
    none = spark.createDataFrame([], "item_id string, action string, reason_code string")
    got = {r.item_id: (r.effective_action, r.reason_codes) for r in decide.item_decisions(items, none, F.col("ok")).collect()}
    assert got == {"a": ("PASS", ["no_findings"]), "b": ("BLOCK", ["inspection_incomplete"])}


def _png(*chunks):
    make = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return binary.PNG + make(b"IHDR", struct.pack(">IIBBBBB", 3, 2, 8, 2, 0, 0, 0)) + b"".join(make(*c) for c in chunks) + make(b"IEND", b"")


def _archive(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(name.replace("__", "/").replace("_", "."), body)
    return out.getvalue()


def test_binary_items(spark):
    word = "<w:d xmlns:w='u'><w:p><w:t>Wei </w:t><w:t>Zhang</w:t></w:p></w:d>"
    rows = [
        ("docx", _archive(word__document_xml=word, word__media__a_png=b"x")),
        ("whole", _archive(word__document_xml=word)),
        ("doctype", _archive(word__document_xml="<!DOCTYPE a [<!ENTITY b 'c'>]><a/>")),
        ("bomb", _archive(word__document_xml="<a>" + "0" * 3_000_000 + "</a>")),
        ("png", _png((b"tEXt", b"Author\0Wei"))),
        ("cut", _png()[:-8]),
        ("plain", "tëxt".encode()),
        ("broken", b"\xff\xfe\x00"),
        ("none", None),
    ]
    sheet = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    book = {
        "xl__workbook_xml": f"<workbook {sheet}><sheets><sheet name='a'/><sheet name='b' state='veryHidden'/></sheets><definedNames><definedName name='Ann'>a!A1</definedName></definedNames></workbook>",
        "xl__sharedStrings_xml": f"<sst {sheet}><si><t>Wei</t></si><si><r><t>Zh</t></r><r><t>ang</t></r></si></sst>",
        "xl__worksheets__sheet1_xml": f"<worksheet {sheet}><row><c t='s'><v>1</v></c><c><v>4539</v></c><c><v>5787</v></c><c t='s'><v>9</v></c></row><row><c><f>A1&amp;B1</f><v>x</v></c><c><f>A2</f></c></row><row><c/></row></worksheet>",
        "xl__worksheets__sheet2_xml": f"<worksheet {sheet}><row><c><is><t>hid</t><t>den</t></is></c></row></worksheet>",
        "xl__comments1_xml": f"<comments {sheet}><t> see Ann </t></comments>",
        "docProps__core_xml": "<p xmlns:d='u'><d:creator>Ann</d:creator></p>",
        "xl__externalLinks__e1_xml": "<a/>",
    }
    rows += [("book", _archive(**book)), ("macro", _archive(word__document_xml=word, word__vbaProject_bin="m")), ("named", _archive(word__document_xml=word, docProps__app_xml="<p xmlns:d='u'><d:Company> Acme </d:Company></p>", word__header1_xml=word)), ("zip", _archive(a_txt="x"))]
    df = spark.createDataFrame([(i, bytearray(b) if b is not None else None) for i, b in rows], "item_id string, data binary")
    got = {r.item_id: r for r in binary.parsed(df).collect()}
    body = "[DOCUMENT]\n[BODY]\nWei Zhang\n[/BODY]\n[/DOCUMENT]"
    assert got["docx"].text == body and not got["docx"].fully_inspected and got["docx"].media == 1 and got["docx"].blocks_original
    assert got["whole"].text == body and got["whole"].fully_inspected and got["whole"].mime == binary.DOCX
    assert got["named"].text == "[DOCUMENT]\n[PROPERTIES]\nCompany: Acme\n[/PROPERTIES]\n[BODY]\nWei Zhang\n[/BODY]\n[HEADER]\nWei Zhang\n[/HEADER]\n[/DOCUMENT]"
    assert got["doctype"].error_code == "xml_doctype" and got["bomb"].error_code == "archive_ratio" and got["cut"].error_code == "image_truncated"
    assert got["png"].fields == ["png:Author"] and (got["png"].width, got["png"].height) == (3, 2) and got["plain"].text == "tëxt" and got["broken"].error_code == "unsupported_media_type" and got["broken"].text is None
    assert got["none"].error_code == "empty" and got["macro"].error_code == "macros_not_accepted" and got["zip"].error_code == "unsupported_media_type"
    assert got["book"].text == "[DOCUMENT]\n[PROPERTIES]\nAnn\n[/PROPERTIES]\n[COMMENTS]\nsee Ann\n[/COMMENTS]\n[DEFINED_NAMES]\nAnn: a!A1\n[/DEFINED_NAMES]\n[SHEET]\nZhang | 4539 | 5787 | \nx [=A1&B1] | [=A2]\n[/SHEET]\n[SHEET]\nhidden\n[/SHEET]\n[/DOCUMENT]"
    assert (got["book"].hidden, got["book"].external, got["book"].fully_inspected, got["book"].blocks_original) == (1, 1, True, True)
    kinds = {r.item_id: r.m for r in df.select("item_id", binary.sniffed(F.col("data")).alias("m")).collect()}
    assert kinds["docx"] == "application/zip" and kinds["png"] == "image/png" and kinds["plain"] == "text/plain" and kinds["broken"] == "application/octet-stream" and kinds["none"] is None
    errors = {r.m: r.e for r in spark.createDataFrame([(m,) for m in ("text/plain", "image/gif", binary.MACROS[2])], "m string").select("m", binary.mime_error(F.col("m")).alias("e")).collect()}
    assert errors == {"text/plain": None, "image/gif": "unsupported_media_type", binary.MACROS[2]: "macros_not_accepted"}


def test_stream_agrees_with_the_batch_fold(spark, tmp_path):
    from hushframe.streaming.scopes import scope_stream

    rows = [(f"s{i % 4}", 1_700_000_000 + i * 60, 100 + i) for i in range(40)]
    df = spark.createDataFrame(rows, "scope_id string, sec long, bytes long").select("scope_id", F.timestamp_seconds("sec").alias("at"), (F.col("sec") % 2).alias("files"), "bytes", F.lit(1).cast("long").alias("pages"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    limits = {"turns": 7, "files": 9, "bytes": 900, "pages": 9}
    out = scope_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), 10**9, 10**10, limits)
    q = out.writeStream.format("memory").queryName("scopes_out").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.scope_id: (r.turn_count, r.file_count, r.cumulative_bytes, r.cumulative_pages, r.refused) for r in spark.table("scopes_out").filter("status = 'ACTIVE' and turn_count > 0").collect()}
    batch = scopes.admitted(df.select("scope_id", "at", F.lit(0).alias("turn_id"), "files", "bytes", "pages"), limits)
    assert got == {r.scope_id: (r.turn_count, r.file_count, r.cumulative_bytes, r.cumulative_pages, r.refused) for r in batch.collect()}
