"""Unit vectors of manifests, model payloads, provider replies and JPEG metadata."""

import re
import struct

import pyspark.sql.functions as F

from hushframe.operators import requests
from hushframe.sources import binary, made

CLAIM = '{"start": 0, "end": 2, "text": "ab", "type": "PERSON", "confidence": 0.5}'


def parsed(spark, column, values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, text string")
    return [r.p for r in df.select("i", column(F.col("text")).alias("p")).orderBy("i").collect()]


def test_claims_are_parsed_strictly(spark):
    good = f'{{"entities": [{CLAIM}]}}'
    cases = [
        (good, None),
        (f"```json\n{good}\n```", None),
        ('{"entities": []}', None),
        ('{"entities": [], "note": 1}', "model_bad_payload"),
        ("[]", "model_bad_payload"),
        (good[:-1], "model_bad_payload"),
        (good.replace('"end": 2, ', ""), "model_bad_claim"),
        (good.replace("0.5", '"high"'), "model_bad_claim"),
        (good.replace('"end": 2', '"end": 2, "why": "x"'), "model_bad_claim"),
        (f'{{"entities": [{",".join([CLAIM] * 201)}]}}', "model_too_many"),
        (None, "model_no_payload"),
        (" ", "model_no_payload"),
    ]
    got = parsed(spark, requests.parsed_claims, [c[0] for c in cases])
    assert [g.error_code for g in got] == [c[1] for c in cases]
    assert [(c.start, c.end, c.text, c.type, c.confidence) for c in got[1].claims] == [(0, 2, "ab", "PERSON", 0.5)]
    assert all((g.claims is None) == (g.error_code is not None) for g in got)


def test_replies(spark):
    message = lambda content, more="": f'{{"choices": [{{"message": {{"content": {content}{more}}}, "finish_reason": "stop"}}]}}'
    cases = [
        (message('"hi"'), ("hi", 0, None)),
        (message('"[1]"'), ("[1]", 0, None)),
        (message('[{"type": "text", "text": "h"}, {"type": "text", "text": "i"}]'), ("hi", 0, None)),
        (message("null", ', "tool_calls": [{"id": "a"}, {"id": "b"}]'), (None, 2, None)),
        (message("null"), (None, 0, "reply_empty")),
        (message('"' + "x" * 500_001 + '"'), ("x" * 500_001, 0, "reply_too_long")),
        ('{"choices": []}', (None, 0, "reply_malformed")),
        ("not json", (None, 0, "reply_malformed")),
        (None, (None, 0, "reply_malformed")),
    ]
    got = parsed(spark, requests.parsed_reply, [c[0] for c in cases])
    assert [(g.text, g.n_tool_calls, g.error_code) for g in got] == [c[1] for c in cases]


def test_manifest_errors(spark):
    rows = [("r", [("user", [("text", "a", "x", None), ("text", "b", "", None), ("image", "c", None, None)]), ("user", [("image", "a", None, "f"), ("text", "d e", "é", None), ("text", "ok", "é", None)])]), ("none", [])]
    df = spark.createDataFrame(rows, "request_id string, messages array<struct<role:string,content:array<struct<type:string,item_id:string,text:string,file_field:string>>>>")
    got = [(r.message_index, r.position, r.error_code, r.byte_size) for r in requests.normalized(df).orderBy("message_index", "position").collect()]
    assert got == [(0, 0, "duplicate_item_id", 1), (0, 1, "text_required", 0), (0, 2, "file_required", None), (1, 0, "duplicate_item_id", None), (1, 1, "invalid_item_id", 2), (1, 2, None, 2)]


def test_jpeg_metadata_and_archives(spark):
    part = lambda kind, body: bytes([0xFF, kind]) + struct.pack(">H", len(body) + 2) + body
    frame = part(0xC0, struct.pack(">BHHB", 8, 2, 3, 0))
    tiff = b"II*\0" + struct.pack("<IH", 8, 2) + struct.pack("<HHII", 0x8825, 4, 1, 0) + struct.pack("<HHI4s", 0x013B, 2, 4, b"Wei\0")
    scan = b"\xff\xda\0\2\1\2\xff\xd9"
    rows = [("plain", b"\xff\xd8" + frame + scan), ("exif", b"\xff\xd8" + part(0xE1, b"Exif\0\0" + tiff) + frame + part(0xFE, b"note") + scan + b"\0"), ("cut", b"\xff\xd8" + frame + scan[:-1]), ("sizeless", b"\xff\xd8" + scan)]
    got = {r.item_id: r for r in binary.parsed(spark.createDataFrame([(i, bytearray(b)) for i, b in rows], "item_id string, data binary")).collect()}
    assert (got["plain"].width, got["plain"].height, got["plain"].fields, got["plain"].blocks_original) == (3, 2, [], False)
    assert got["exif"].has_gps and got["exif"].fields == ["exif:Artist", "jpeg:comment"] and got["exif"].blocks_original
    assert got["cut"].error_code == "image_truncated" and got["sizeless"].error_code == "image_size"
    seen = binary.classified(binary.parsed(spark.createDataFrame([(i, bytearray(b)) for i, b in rows], "item_id string, data binary")), F.lit("a cat"), F.lit(True), "passport")
    assert {r.item_id: (r.image_class, r.forwardable) for r in seen.collect()} == {"plain": ("ORDINARY_IMAGE", True), "exif": ("SENSITIVE_IMAGE", False), "cut": ("UNKNOWN_IMAGE", False), "sizeless": ("UNKNOWN_IMAGE", False)}
    texts = spark.createDataFrame([("a", "x <&> \r\n\ty\x00é"), ("b", None)], "item_id string, text string")
    back = {r.item_id: r.text for r in binary.parsed(texts.select("item_id", made.archived(F.col("text")).alias("data"))).collect()}
    assert {k: re.search(r"\[BODY\]\n(.*)\n\[/BODY\]", v or "", re.DOTALL) for k, v in back.items()}["a"][1] == "x <&> \n\tyé" and back["b"] is None


def test_manifests_name_where_they_break(spark):
    item = '{"type": "text", "item_id": "a", "text": "x"}'
    good = f'{{"purpose": "p_1", "model": "m", "messages": [{{"role": "user", "content": [{item}]}}], "options": {{"temperature": 0.1}}}}'
    cases = [
        (good, None, []),
        (good.replace('"p_1"', '"P 1"').replace('"m"', '""'), "manifest_invalid", ["purpose", "model"]),
        (good.replace('"role": "user"', '"role": "boss", "extra": {"text": "secret"}'), "manifest_invalid", ["messages.0.extra", "messages.0.role"]),
        (good.replace(item, f'{item}, {{"type": "film", "item_id": "b c", "why": 1}}'), "manifest_invalid", ["messages.0.content.1.why", "messages.0.content.1.type", "messages.0.content.1.item_id"]),
        (good.replace(f"[{item}]", "[]"), "manifest_invalid", ["messages.0.content"]),
        ('{"purpose": "p", "model": "m", "messages": []}', "manifest_invalid", ["messages"]),
        ("[1]", "manifest_not_json", []),
        (good[:-1], "manifest_not_json", []),
        (None, "manifest_not_json", []),
        (good.replace('"x"', '"' + "x" * 300_000 + '"'), "manifest_too_large", []),
        ('{"messages": [], ' + ", ".join(f'"k{i:02}": 1' for i in range(40)) + "}", "manifest_invalid", [f"k{i:02}" for i in range(20)]),
    ]
    got = parsed(spark, requests.parsed_manifest, [c[0] for c in cases])
    assert [(g.error_code, g.fields) for g in got] == [(c[1], c[2]) for c in cases]
    assert got[0].messages[0].content[0].item_id == "a" and all((g.messages is None) == (g.error_code is not None) for g in got)


def test_files_of_requests(spark):
    rows = [("r", [("user", [("text", "a", "x" * 30, None), ("file", "b", None, "f1"), ("file", "c", None, "f2"), ("image", "d", None, "f3"), ("file", "e", None, "f4")])])]
    items = requests.normalized(spark.createDataFrame(rows, "request_id string, messages array<struct<role:string,content:array<struct<type:string,item_id:string,text:string,file_field:string>>>>"))
    files = spark.createDataFrame([("r", "f1", bytearray(b"plain")), ("r", "f2", bytearray(b"GIF89a...")), ("r", "f4", bytearray(b"")), ("r", "other", bytearray(b"x"))], "request_id string, file_field string, data binary")
    got = {r.item_id: (r.error_code, r.detected_mime, r.byte_size) for r in requests.with_files(items, files).collect()}
    assert got == {"a": (None, "text/plain", 30), "b": (None, "text/plain", 5), "c": ("unsupported_media_type", "image/gif", 9), "d": ("file_missing", None, 0), "e": ("unsupported_media_type", None, 0)}
    assert [r.file_field for r in requests.unreferenced(files, items).collect()] == ["other"]


def test_answers_that_hide_something_are_errors(spark):
    body = lambda content, reason="stop": f'{{"choices": [{{"finish_reason": "{reason}", "message": {{"content": {content}}}}}]}}'
    payload = '"{\\"entities\\": []}"'
    cases = [(body(payload), None), (body(payload, "length"), "model_truncated"), (body("null"), "model_no_payload"), ('{"choices": []}', "model_bad_envelope"), ("x", "model_bad_envelope"), (None, "model_bad_envelope"), (body('"' + "x" * 256_001 + '"'), "model_answer_too_long"), (body('"[]"'), "model_bad_payload")]
    got = parsed(spark, requests.parsed_answer, [c[0] for c in cases])
    assert [g.error_code for g in got] == [c[1] for c in cases] and got[0].claims == []
