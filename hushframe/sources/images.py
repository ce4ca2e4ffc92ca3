"""PNG and JPEG as sequences of named bodies, and what each body says: size, descriptions, a position. Pixels aren't looked at."""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

#: Signatures, the most pixels, EXIF's descriptive tags, the tag that leads to a position, entries read of a directory.
PNG, JPEG = b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff"
MOST_PIXELS = 40_000_000
EXIF_TAGS = {0x010E: "ImageDescription", 0x010F: "Make", 0x0110: "Model", 0x0131: "Software", 0x0132: "DateTime", 0x013B: "Artist", 0x8298: "Copyright"}
EXIF_GPS, MOST_TAGS = 0x8825, 512


@dataclass
class Image:
    width: int = 0
    height: int = 0
    gps: bool = False
    fields: list[str] = field(default_factory=list)
    complete: bool = False


def tags(tiff: bytes) -> Iterator[int]:
    """Tags of all directories that hang together, each directory once."""
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2], "")
    ahead, seen = (list(struct.unpack_from(order + "I", tiff, 4)) if order and len(tiff) >= 8 else []), {0}
    while ahead:
        at = ahead.pop()
        if at in seen or at + 2 > len(tiff):
            continue
        seen.add(at)
        count = struct.unpack_from(order + "H", tiff, at)[0]
        table = tiff[at + 2 : at + 2 + 12 * min(count, MOST_TAGS)]
        yield from (tag for tag, *_ in struct.iter_unpack(order + "HHI4s", table[: len(table) // 12 * 12]))
        link = tiff[at + 2 + 12 * min(count, MOST_TAGS) :][:4]
        if len(link) == 4:
            ahead += struct.unpack(order + "I", link)


def _exif(image: Image, tiff: bytes) -> None:
    for tag in tags(tiff):
        if tag == EXIF_GPS:
            image.gps = True
        elif tag in EXIF_TAGS:
            image.fields.append(f"exif:{EXIF_TAGS[tag]}")


# ---- PNG ----
def chunks(raw: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(kind, body) of every whole chunk, the last one IEND if nothing is cut off."""
    rest = memoryview(raw)[len(PNG) :]
    while len(rest) >= 12:
        size, kind = struct.unpack_from(">I4s", rest)
        if len(rest) < size + 12:
            return
        yield kind, bytes(rest[8 : 8 + size])
        if kind == b"IEND":
            return
        rest = rest[size + 12 :]


def _png_size(image: Image, body: bytes) -> None:
    image.width, image.height = struct.unpack_from(">II", body)


def _png_text(image: Image, body: bytes) -> None:
    keyword = body.partition(b"\0")[0].decode("latin-1")
    image.fields.append(f"png:{keyword}")
    image.gps |= any(x in keyword.lower() for x in ("gps", "location"))


def _png_end(image: Image, body: bytes) -> None:
    image.complete = True


_PNG: dict[bytes, Callable[[Image, bytes], None]] = {b"IHDR": _png_size, b"tEXt": _png_text, b"iTXt": _png_text, b"zTXt": _png_text, b"eXIf": _exif, b"IEND": _png_end}


# ---- JPEG ----
#: A marker: fill bytes, then a code. FF 00 is a byte of the picture, not a marker.
_MARKER = re.compile(rb"\xff+([\x01-\xfe])", re.DOTALL)


def segments(raw: bytes) -> Iterator[tuple[int, bytes]]:
    """(code, body) of the segments before the end marker."""
    at = 2
    while (m := _MARKER.search(raw, at)) and m[1] != b"\xd9":
        at, code = m.end(), m[1][0]
        if code == 0x01 or 0xD0 <= code <= 0xD8:
            continue  # no body
        size = int.from_bytes(raw[at : at + 2])
        if size < 2 or at + size > len(raw):
            return
        yield code, raw[at + 2 : at + size]
        at += size


def _jpeg_size(image: Image, body: bytes) -> None:
    image.height, image.width = struct.unpack_from(">HH", body, 1)


def _jpeg_app1(image: Image, body: bytes) -> None:
    if body.startswith(b"Exif\0\0"):
        _exif(image, body[6:])
    elif b"adobe.com/xap" in body[:64]:
        image.fields.append("xmp")


def _named(name: str) -> Callable[[Image, bytes], None]:
    return lambda image, body: image.fields.append(name)


_JPEG = {code: _jpeg_size for code in range(0xC0, 0xD0) if code not in (0xC4, 0xC8, 0xCC)} | {0xE1: _jpeg_app1, 0xEE: _named("jpeg:adobe"), 0xFE: _named("jpeg:comment")}


def described(raw: bytes) -> Image:
    """What the picture's bodies say. A body too short for its kind says nothing."""
    image = Image()
    for kind, body in chunks(raw) if raw.startswith(PNG) else segments(raw):
        try:
            (_PNG if raw.startswith(PNG) else _JPEG).get(kind, lambda *_: None)(image, body)
        except struct.error:
            continue
    if not raw.startswith(PNG):
        image.complete = raw.rstrip(b"\0").endswith(b"\xff\xd9")
    if image.width <= 0 or image.height <= 0:
        raise ValueError("image_size")
    if image.width * image.height > MOST_PIXELS:
        raise ValueError("image_too_large")
    return image
