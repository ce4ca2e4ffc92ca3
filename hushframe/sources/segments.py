"""Labelled pieces of an item's text, and the text they make together. Every reader of binary items gives out the same."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field

#: Fixed limit of an item's text.
MOST_TEXT = 2_000_000
SEGMENTS = "array<struct<label:string,origin:string,page:int,start:int,end:int>>"


def normal(text: str) -> str:
    return unicodedata.normalize("NFC", text).replace("\r\n", "\n").replace("\r", "\n")


@dataclass
class Read:
    """What a reader found. Text comes in pieces (label, origin, page, text); `notes` are columns of the result."""

    pieces: list[tuple[str, str, int | None, str]] = field(default_factory=list)
    whole: bool = True
    notes: dict = field(default_factory=dict)

    def add(self, label: str, origin: str, text: str, page: int | None = None) -> None:
        if text.strip():
            self.pieces.append((label, origin, page, normal(text)))

    def rendered(self) -> tuple[str, list[dict]]:
        """The pieces between marks, in one text, and where each piece stands in it (code points). The file's name is no part of it."""
        lines, at, placed = ["[DOCUMENT]"], len("[DOCUMENT]") + 1, []
        for label, origin, page, text in self.pieces:
            head, tail = f"[{label} {page}]" if page else f"[{label}]", f"[/{label}]"
            at += len(head) + 1
            placed.append({"label": label, "origin": origin, "page": page, "start": at, "end": at + len(text)})
            at += len(text) + len(tail) + 2
            lines += [head, text, tail]
        return "\n".join([*lines, "[/DOCUMENT]"]), placed
