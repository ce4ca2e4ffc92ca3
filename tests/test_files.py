"""Hostile archives, pictures cut anywhere, recognition's layouts, and verdicts by content."""

import io
import struct
import zipfile

import pyspark.sql.functions as F
import pytest

from hushframe.operators import vision
from hushframe.sources import archives, binary, images, made, ocr

WORD = "<w:d xmlns:w='u'><w:t>Wei Zhang</w:t></w:d>"


def archive(parts, **more):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", more.get("how", zipfile.ZIP_DEFLATED)) as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def flagged(raw: bytes) -> bytes:
    """The archive with every part said to be encrypted."""
    out = bytearray(raw)
    for mark, at in ((b"PK\x03\x04", 6), (b"PK\x01\x02", 8)):
        i = out.find(mark)
        while i >= 0:
            out[i + at] |= 1
            i = out.find(mark, i + 4)
    return bytes(out)


def test_no_archive_ends_the_job(spark):
    good = archive({"[Content_Types].xml": "<T/>", "word/document.xml": WORD, "word/header1.xml": WORD})
    parts = {"[Content_Types].xml": "<T/>", "word/document.xml": WORD}
    cases = {
        "good": (good, None),
        "encrypted": (flagged(good), "archive_limits"),
        "types bomb": (archive(parts | {"[Content_Types].xml": " " * (40 << 20)}), "archive_ratio"),
        "many": (archive(parts | {f"word/x{i}.bin": "" for i in range(2001)}), "archive_limits"),
        "deep": (archive(parts | {"word/document.xml": "<a>" * 5000 + "</a>" * 5000}), "xml_depth"),
        "entities": (archive(parts | {"word/document.xml": "<!DOCTYPE a [<!ENTITY b 'c'>]><a>&b;</a>"}), "xml_doctype"),
        "unclosed": (archive(parts | {"word/document.xml": "<a><b></a>"}), "unreadable"),
        "macro type": (archive(parts | {"[Content_Types].xml": "<T ContentType='application/vnd.ms-word.document.macroEnabled.main+xml'/>"}), "macros_not_accepted"),
        "macro part": (archive({"xl/workbook.xml": "<a/>", "xl/vbaProject.bin": "m"}), "macros_not_accepted"),
        "method": (good.replace(struct.pack("<H", 8), struct.pack("<H", 77)), "unreadable"),
        "shared": (archive({"xl/workbook.xml": "<a/>", "xl/worksheets/sheet1.xml": f"<w xmlns='{archives.SHEET[1:-1]}'><row><c t='s'><v>x</v></c></row></w>"}), "unreadable"),
    }
    cut = {f"cut {i}": good[:i] for i in range(4, len(good), 31)} | {f"hole {i}": good[:i] + b"\0" * 9 + good[i + 9 :] for i in range(4, len(good), 23)}
    rows = [(k, bytearray(v)) for k, v in {**{k: v for k, (v, _) in cases.items()}, **cut}.items()]
    got = {r.item_id: r for r in binary.parsed(spark.createDataFrame(rows, "item_id string, data binary")).collect()}
    assert len(got) == len(rows)
    assert {k: got[k].error_code for k in cases} == {k: e for k, (_, e) in cases.items()}
    assert all(r.error_code is None or r.text is None and r.blocks_original for r in got.values())


def test_readers_may_be_added(spark):
    own = binary.READERS | {"application/octet-stream": lambda raw: {"text": raw.hex(), "segments": [], "fully_inspected": True, "blocks_original": False}}
    df = spark.createDataFrame([("a", bytearray(b"\0\1"))], "item_id string, data binary")
    assert binary.parsed(df, own).first().text == "0001" and binary.parsed(df).first().error_code == "unsupported_media_type"


@pytest.mark.parametrize("raw", [made.png_of(7, 5, "Author"), made.jpeg_of(7, 5, 0x8825, "note"), made.jpeg_of(7, 5, 0x010F, None)])
def test_pictures_cut_anywhere_are_described_or_refused(raw):
    whole = images.described(raw)
    assert (whole.width, whole.height, whole.complete) == (7, 5, True)
    for i in range(len(raw)):
        try:
            assert not images.described(raw[:i]).complete
        except ValueError as e:
            assert str(e) == "image_size"


def test_directories_that_lead_in_circles_are_read_once():
    entry = struct.pack(">HHI4s", 0x010F, 2, 4, b"Ann\0")
    ring = b"MM\0*" + struct.pack(">IH", 8, 1) + entry + struct.pack(">I", 26) + struct.pack(">H", 1) + entry + struct.pack(">I", 8)
    assert list(images.tags(ring)) == [0x010F, 0x010F]
    assert list(images.tags(b"II*\0" + struct.pack("<I", 1 << 31))) == [] and list(images.tags(b"XX")) == []
    assert len(list(images.tags(b"MM\0*" + struct.pack(">IH", 8, 65535) + entry * 600))) == images.MOST_TAGS


def test_recognition_in_both_layouts(spark):
    cases = [
        ('{"txts": ["a", "b"], "scores": [0.5, 1]}', [("a", 0.5), ("b", 1.0)], 0.75, True, None),
        ('{"txts": ["a", "b", "c"], "scores": [0.5]}', [("a", 0.5)], 0.5, True, None),
        ('{"txts": ["a"], "scores": null, "complete": false}', [("a", 0.0)], 0.0, False, None),
        ('{"txts": null}', [], 0.0, True, None),
        ('[[[[0,0],"x y",0.5],[[1,1],"é",0.25],[1,"short"]], 0.1]', [("x y", 0.5), ("é", 0.25)], 0.375, True, None),
        ('[[[0,0],"x",1],[[0,0],"y",1],[[0,0],"z",1]]', [("x", 1.0), ("y", 1.0), ("z", 1.0)], 1.0, True, None),
        ("[null, 0.1]", [], 0.0, True, None),
        ("null", [], 0.0, True, None),
        ("{broken", None, None, False, "ocr_unreadable"),
        ('"text"', None, None, False, "ocr_unreadable"),
        (None, None, None, False, "ocr_unavailable"),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, answer string").select("i", ocr.recognized(F.col("answer")).alias("o"))
    for r in df.collect():
        _, lines, mean, complete, error = cases[r.i]
        assert (r.o.lines and [tuple(x) for x in r.o.lines] or r.o.lines, r.o.mean_confidence, r.o.complete, r.o.error_code) == (lines, mean, complete, error), cases[r.i]
        assert r.o.text == (None if lines is None else "\n".join(t for t, _ in lines))


def test_verdicts_only_tighten_and_errors_change_nothing(spark):
    pictures = [("a", b"1", "ORDINARY_IMAGE"), ("b", b"1", "ID_DOCUMENT_IMAGE"), ("c", b"2", "SENSITIVE_IMAGE"), ("d", b"3", "ORDINARY_IMAGE"), ("e", b"4", "UNKNOWN_IMAGE"), ("f", None, None)]
    df = spark.createDataFrame([(i, bytearray(x) if x else None, c) for i, x, c in pictures], "item_id string, data binary, image_class string")
    sha = {x: F.sha2(F.lit(x), 256) for x in (b"1", b"2", b"3", b"4")}
    answers = {b"1": '{"category": "unclear", "reason": "r"}', b"2": '{"category": "ordinary", "reason": "r"}', b"3": '{"category": "identity_document", "reason": "r", "x": 1}', b"4": "no"}
    verdicts = None
    for x, answer in answers.items():
        row = spark.range(1).select(sha[x].alias("sha256"), F.lit(answer).alias("answer"))
        verdicts = row if verdicts is None else verdicts.union(row)
    got = {r.item_id: r.image_class for r in vision.tightened(df, verdicts).collect()}
    assert got == {"a": "SENSITIVE_IMAGE", "b": "ID_DOCUMENT_IMAGE", "c": "SENSITIVE_IMAGE", "d": "ORDINARY_IMAGE", "e": "UNKNOWN_IMAGE", "f": None}
    assert vision.asked(df, verdicts.limit(0)).count() == 4 and vision.asked(df, verdicts).count() == 0
