"""Office archives: which format, and the text of their parts. An archive is looked at as a whole before any part is unpacked."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from .segments import Read

#: Limits of archives, formats, suffixes of parts without text of their own, and labels by the beginning of a part's name.
MOST_ENTRIES, MOST_BYTES, MOST_RATIO, RATIO_FROM = 2000, 200 << 20, 200, 1 << 20
DOCX, XLSX = "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"
MACROS = ("application/vnd.ms-word.document.macroEnabled.12", "application/vnd.ms-excel.sheet.macroEnabled.12", "application/vnd.ms-excel.sheet.binary.macroEnabled.12")
IGNORED = (".rels", ".png", ".jpeg", ".jpg", ".gif", ".bmp", ".emf", ".wmf", ".bin", ".xlsb", ".ttf", ".otf")
WORD_LABELS = {
    "word/document.xml": "BODY", "word/header": "HEADER", "word/footer": "FOOTER", "word/comments": "COMMENTS", "word/endnotes": "ENDNOTES", "word/footnotes": "FOOTNOTES",
    "word/glossary/": "GLOSSARY", "docProps/core.xml": "PROPERTIES", "docProps/app.xml": "PROPERTIES", "docProps/custom.xml": "PROPERTIES",
}
SHEET_LABELS = {"xl/worksheets/sheet": "SHEET", "xl/workbook.xml": "DEFINED_NAMES", "xl/comments": "COMMENTS", "xl/threadedComments": "COMMENTS", "docProps/": "PROPERTIES"}
SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
MOST_DEPTH = 2000


class Archive:
    """A zip archive within the limits. Its directory says how large parts are, and no more than that is ever unpacked of one."""

    def __init__(self, raw: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(raw))
        self.parts = {i.filename: i for i in self.zip.infolist() if not i.is_dir()}
        sizes = [(i.file_size, i.compress_size) for i in self.zip.infolist()]
        if len(sizes) > MOST_ENTRIES or sum(s for s, _ in sizes) > MOST_BYTES or any(i.flag_bits & 1 for i in self.zip.infolist()):
            raise ValueError("archive_limits")
        if any(s > RATIO_FROM and s > MOST_RATIO * max(1, packed) for s, packed in sizes):
            raise ValueError("archive_ratio")

    def read(self, name: str) -> bytes:
        with self.zip.open(self.parts[name]) as f:
            return f.read(self.parts[name].file_size)

    def named(self, *starts: str) -> list[str]:
        return [n for n in self.parts if n.startswith(starts)]

    def format(self) -> str:
        """By the parts that only one format has. Macros show as a declared type or as a project of their own."""
        declared = set(re.findall(r'ContentType\s*=\s*["\']([^"\']*)', self.read("[Content_Types].xml").decode("utf-8", "replace"))) if "[Content_Types].xml" in self.parts else set()
        for kind, home, main in ((0, "word/", DOCX), (1, "xl/", XLSX)):
            if f"{home}vbaProject.bin" in self.parts or any("macroenabled" in t.lower() and ("word" in t) == (kind == 0) for t in declared):
                return MACROS[kind]
        return DOCX if "word/document.xml" in self.parts else XLSX if "xl/workbook.xml" in self.parts else "application/zip"


def elements(part: bytes) -> Iterator[ElementTree.Element]:
    """A part's elements as they end, children before their parents. Entities are refused, and so is absurd nesting."""
    if re.search(rb"<!(DOCTYPE|ENTITY)", part[:4096], re.IGNORECASE):
        raise ValueError("xml_doctype")
    depth = 0
    for event, e in ElementTree.iterparse(io.BytesIO(part), ("start", "end")):
        if event == "end":
            depth -= 1
            yield e
        elif (depth := depth + 1) > MOST_DEPTH:
            raise ValueError("xml_depth")


def _local(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _label(name: str, labels: dict[str, str]) -> str:
    return next((label for start, label in labels.items() if name.startswith(start)), "OTHER")


def _sorted_parts(archive: Archive, out: Read, own: dict[str, str]) -> Iterator[str]:
    """Names of XML parts in order. `own`: beginnings of names that are counted under a note instead; what nobody can read makes the
    reading partial."""
    out.notes |= dict.fromkeys(own.values(), 0)
    for name in sorted(archive.parts):
        note = next((n for start, n in own.items() if name.startswith(start)), None)
        if note:
            out.notes[note] += 1
        elif name.endswith(".xml"):
            yield name
        elif not name.endswith(IGNORED):
            out.whole = False
    out.whole &= not out.notes["media"]


def word_text(archive: Archive) -> Read:
    """Text of every XML part, deleted and instruction text too."""
    out = Read()
    for name in _sorted_parts(archive, out, {"word/media/": "media"}):
        label = _label(name, WORD_LABELS)
        if label == "PROPERTIES":
            said = [f"{_local(e)}: {e.text.strip()}" for e in elements(archive.read(name)) if e.text and e.text.strip()]
            out.add(label, name, "\n".join(said))
        else:
            out.add(label, name, "".join(e.text or "" for e in elements(archive.read(name)) if "}" in e.tag and _local(e) in ("t", "delText", "instrText")))
    return out


def _cell(cell: ElementTree.Element, shared: list[str]) -> str:
    """A cell by its type: a number into the shared strings, text of its own, or what it shows; then its formula."""
    inner = {_local(x): x for x in cell}
    shown = inner["v"].text or "" if "v" in inner else ""
    if cell.get("t") == "s" and shown:
        shown = shared[int(shown)] if int(shown) in range(len(shared)) else ""
    elif "is" in inner:
        shown = "".join(inner["is"].itertext())
    formula = inner["f"].text if "f" in inner else None
    return " ".join(x for x in (shown, f"[={formula}]" if formula else "") if x)


def sheet_text(archive: Archive) -> Read:
    """Every sheet, hidden ones too, comments, names and properties; links to other files are counted, never followed."""
    out = Read()
    strings = "xl/sharedStrings.xml"
    shared = ["".join(e.itertext()) for e in elements(archive.read(strings)) if e.tag == f"{SHEET}si"] if strings in archive.parts else []
    for name in _sorted_parts(archive, out, {"xl/media/": "media", "xl/externalLinks/": "external"}):
        if name == strings:
            continue
        label, found = _label(name, SHEET_LABELS), elements(archive.read(name))
        if label == "SHEET":
            rows = ([_cell(c, shared) for c in e if c.tag == f"{SHEET}c"] for e in found if e.tag == f"{SHEET}row")
            out.add(label, name, "\n".join(" | ".join(cells) for cells in rows if any(c.strip() for c in cells)))
        elif label == "DEFINED_NAMES":
            book = list(found)
            out.notes["hidden"] = sum(e.get("state", "visible") != "visible" for e in book if e.tag == f"{SHEET}sheet")
            out.add(label, name, "\n".join(f"{e.get('name', '')}: {e.text or ''}" for e in book if e.tag == f"{SHEET}definedName"))
        else:
            *_, root = found
            out.add(label, name, "\n".join(x.strip() for x in root.itertext() if x.strip()))
    return out
