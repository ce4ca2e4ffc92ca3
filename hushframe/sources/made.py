"""Files made from columns, for queries and tests: archives, workbooks, PDFs and pictures that hold given text."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from xml.sax.saxutils import escape

import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from .archives import SHEET
from .images import PNG


def archived(text: Column) -> Column:
    """A word-processing archive whose body holds the text, without the characters that XML can't hold; with an author, and with a
    picture where the text begins with Th."""

    @F.pandas_udf("binary")
    def run(texts: pd.Series) -> pd.Series:
        def one(x: str) -> bytes:
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr("word/media/a.png", b"") if x.startswith("Th") else None
                z.writestr("docProps/core.xml", "<p:c xmlns:p='u'><p:creator>Ann</p:creator></p:c>")
                z.writestr("word/document.xml", f'<w:d xmlns:w="u"><w:t>{escape(x, {chr(13): "&#13;"})}</w:t></w:d>')
            return out.getvalue()

        return texts.map(one, na_action="ignore")

    return run(F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]", ""))


def archived_workbook(cells: Column, comment: Column) -> Column:
    """A workbook whose sheets hold the strings of an array, one row each in turn as shared, inline and formula cells, the second
    sheet hidden, and a comment."""

    @F.pandas_udf("binary")
    def run(rows: pd.Series, comments: pd.Series) -> pd.Series:
        def one(values, said) -> bytes:
            clean = [escape(x, {chr(13): "&#13;"}) for x in values]
            kinds = ['<c t="s"><v>{n}</v></c>', "<c><is><t>{x}</t></is></c>", "<c><f>{x}</f><v>7</v></c>"]
            body = "".join(f"<row>{kinds[n % 3].format(n=n, x=x)}<c><v>{n}</v></c></row>" for n, x in enumerate(clean))
            ns = f'xmlns="{SHEET[1:-1]}"'
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="a"/><sheet name="b" state="veryHidden"/></sheets><definedNames><definedName name="n">a!A1</definedName></definedNames></workbook>')
                z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><t>{x}</t></si>" for x in clean) + "</sst>")
                z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")
                z.writestr("xl/worksheets/sheet2.xml", f"<worksheet {ns}><sheetData><row><c><v>2</v></c></row></sheetData></worksheet>")
                z.writestr("xl/comments1.xml", f"<comments {ns}><t>{escape(said)}</t></comments>")
            return out.getvalue()

        return pd.Series([None if v is None else one(v, c or "") for v, c in zip(rows, comments, strict=True)])

    return run(cells, comment)


def _numbered(objects: list[bytes], packed: bool, info: int) -> bytes:
    """A PDF of the objects 1, 2, ..: 1 is the root. packed: objects that aren't streams lie in an object stream, and the
    cross-reference is a stream too, whose rows hold differences from the row above."""
    out, places = bytearray(b"%PDF-1.7\n"), {}
    inner = [i for i, o in enumerate(objects, 1) if packed and b"stream\n" not in o]
    for i, o in enumerate(objects, 1):
        if i not in inner:
            places[i] = (1, len(out), 0)
            out += b"%d 0 obj\n%s\nendobj\n" % (i, o)
    if not packed:
        start = len(out)
        rows = b"".join(b"%010d 00000 n \n" % places[i][1] for i in range(1, len(objects) + 1))
        out += b"xref\n0 %d\n0000000000 65535 f \n%strailer\n<</Size %d/Root 1 0 R/Info %d 0 R>>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, rows, len(objects) + 1, info, start)
        return bytes(out)
    holder = len(objects) + 1
    bodies, head = b"", b""
    for k, i in enumerate(inner):
        places[i] = (2, holder, k)
        head += b"%d %d " % (i, len(bodies))
        bodies += objects[i - 1] + b"\n"
    data = zlib.compress(head + bodies)
    places[holder] = (1, len(out), 0)
    out += b"%d 0 obj\n<</Type/ObjStm/N %d/First %d/Length %d/Filter/FlateDecode>>stream\n%s\nendstream\nendobj\n" % (holder, len(inner), len(head), len(data), data)
    places[holder + 1] = (1, len(out), 0)
    rows = [bytes(7)] + [struct.pack(">BIH", *places[i]) for i in range(1, holder + 2)]
    table = zlib.compress(b"".join(b"\x02" + bytes((x - y) & 255 for x, y in zip(row, above)) for above, row in zip([bytes(7), *rows], rows)))
    start = len(out)
    out += b"%d 0 obj\n<</Type/XRef/Size %d/W[1 4 2]/Root 1 0 R/Info %d 0 R/Length %d/Filter/FlateDecode/DecodeParms<</Predictor 12/Columns 7>>>>stream\n%s\nendstream\nendobj\nstartxref\n%d\n%%%%EOF\n" % (holder + 1, holder + 2, info, len(table), table, start)
    return bytes(out)


def pdf_of(pages: list[str], note: str | None = None, author: str | None = None, packed: bool = False) -> bytes:
    """A PDF whose pages show the lines of the given texts, with a note on the first page and an author."""
    cmap = b"1 begincodespacerange<0000><FFFF>endcodespacerange 1 beginbfrange<0000><FFFF><0000>endbfrange"
    text = lambda x: b"<" + (b"\xfe\xff" + x.encode("utf-16-be", "replace")).hex().encode() + b">"
    stream = lambda data, more=b"": b"<<%s/Length %d/Filter/FlateDecode>>stream\n%s\nendstream" % (more, len(z := zlib.compress(data)), z)
    first = 7
    kids = b" ".join(b"%d 0 R" % (first + 2 * i) for i in range(len(pages)))
    objects = [
        b"<</Type/Catalog/Pages 2 0 R>>",
        b"<</Type/Pages/Count %d/Kids[%s]/Resources<</Font<</F1 3 0 R>>>>>>" % (len(pages), kids),
        b"<</Type/Font/Subtype/Type0/Encoding/Identity-H/ToUnicode 4 0 R>>",
        stream(cmap),
        b"<</Type/Annot/Subtype/Text/Contents %s>>" % (text(note or "")),
        b"<<%s>>" % (b"/Author " + text(author) if author else b""),
    ]
    for i, page in enumerate(pages):
        lines = b"".join(b"<%s>Tj 0 -12 Td " % x.encode("utf-16-be", "replace").hex().encode() for x in page.split("\n"))
        objects += [b"<</Type/Page/Parent 2 0 R/Contents %d 0 R%s>>" % (first + 2 * i + 1, b"/Annots[5 0 R]" if note and not i else b""), stream(b"BT /F1 12 Tf " + lines + b"ET")]
    return _numbered(objects, packed, 6)


def paged(rows: DataFrame) -> DataFrame:
    """rows (item_id string, pages array<string>, note, author, packed boolean) as (item_id, data): a PDF of each row's pages, null for null."""

    def run(batches):
        for batch in batches:
            made = [None if p is None else pdf_of(list(p), n, a, bool(x)) for p, n, a, x in zip(batch["pages"], batch["note"], batch["author"], batch["packed"], strict=True)]
            yield pd.DataFrame({"item_id": batch["item_id"], "data": pd.Series(made, dtype=object)})

    return rows.mapInPandas(run, "item_id string, data binary")


def png_of(width: int, height: int, keyword: str | None) -> bytes:
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    text = chunk(b"tEXt", keyword.encode("latin-1", "replace") + b"\0x") if keyword else b""
    return PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + text + chunk(b"IEND", b"")


def jpeg_of(width: int, height: int, tag: int | None, comment: str | None) -> bytes:
    part = lambda kind, body: bytes([0xFF, kind]) + struct.pack(">H", len(body) + 2) + body
    tiff = b"MM\0*" + struct.pack(">IH", 8, 1) + struct.pack(">HHI4s", tag, 2, 4, b"Ann\0") if tag is not None else None
    exif = part(0xE1, b"Exif\0\0" + tiff) if tiff else b""
    said = part(0xFE, comment.encode()[:60000]) if comment else b""
    return b"\xff\xd8" + exif + said + part(0xC0, struct.pack(">BHHB", 8, height, width, 0)) + b"\xff\xda\0\2\1\xff\0\2\xff\xd9"


def pictured(width: Column, height: Column, kind: Column, text: Column, cut: Column) -> Column:
    """A picture of a size: kind 'png' or 'jpeg', with a keyword or comment, the last bytes missing where cut."""

    @F.pandas_udf("binary")
    def run(widths: pd.Series, heights: pd.Series, kinds: pd.Series, texts: pd.Series, cuts: pd.Series) -> pd.Series:
        def one(w, h, kind, text, cut):
            raw = png_of(w, h, text) if kind == "png" else jpeg_of(w, h, 0x8825 if text == "gps" else None, None if text == "gps" else text)
            return raw[:-3] if cut else raw

        return pd.Series([one(*x) for x in zip(widths, heights, kinds, texts, cuts, strict=True)])

    return run.asNondeterministic()(width, height, kind, text, cut)
