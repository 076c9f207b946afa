"""Where the boxes of a HEIC file keep its Exif block.

Only box headers, the meta box and the block itself are read, each by its range. Items
are listed in ``iinf``; ``iloc`` says where the bytes of each lie, in the file or in the
``idat`` box, in one extent or several.

Defined results: a file without an Exif item has none; boxes that end beyond the file or
beyond what holds them, extents of no use, and a file without a meta box are damage and
raise ValueError.
"""

from __future__ import annotations

import struct
from typing import BinaryIO


class Damaged(ValueError):
    """Boxes that don't fit what holds them."""


def _boxes(file: BinaryIO, start: int, end: int):
    """(kind, first byte of the content, end) of each box in a range."""
    while start < end:
        file.seek(start)
        head = file.read(min(16, end - start))
        if len(head) < 8:
            raise Damaged("a box header is cut short")
        size, kind, body = *struct.unpack(">I4s", head[:8]), 8
        if size == 1:
            if len(head) < 16:
                raise Damaged("a box header is cut short")
            size, body = struct.unpack(">Q", head[8:])[0], 16
        elif size == 0:
            size = end - start
        if size < body or start + size > end:
            raise Damaged(f"box {kind!r} ends outside")
        yield kind, start + body, start + size
        start += size


class _Fields:
    """Reads unsigned numbers of the widths that a box declares."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def number(self, width: int) -> int:
        if self.at + width > len(self.data):
            raise Damaged("a box is cut short")
        self.at += width
        return int.from_bytes(self.data[self.at - width : self.at], "big")


def _exif_item(file: BinaryIO, start: int, end: int) -> int | None:
    """The number of the item of kind Exif."""
    file.seek(start)
    version = file.read(1)[0]
    for kind, first, last in _boxes(file, start + (6 if version == 0 else 8), end):
        if kind == b"infe":
            file.seek(first)
            data = file.read(last - first)
            width = 2 if data[:1] == b"\x02" else 4
            if data[:1] in (b"\x02", b"\x03") and data[6 + width : 10 + width] == b"Exif":
                return int.from_bytes(data[4 : 4 + width], "big")
    return None


def _extents(data: bytes, item: int) -> tuple[int, list[tuple[int, int]]]:
    """How an item's bytes are held (0: in the file, 1: in idat) and their (offset, length)."""
    box = _Fields(data)
    version = box.number(1)
    box.number(3)
    sizes, more = box.number(1), box.number(1)
    wide = 4 if version == 2 else 2
    for _ in range(box.number(wide)):
        number = box.number(wide)
        method = box.number(2) & 15 if version else 0
        box.number(2)
        base = box.number(more >> 4)
        found = []
        for _ in range(box.number(2)):
            box.number(more & 15 if version else 0)
            offset = base + box.number(sizes >> 4)
            found.append((offset, box.number(sizes & 15)))
        if number == item:
            return method, found
    raise Damaged("the Exif item lies nowhere")


def exif_tiff(file: BinaryIO, size: int) -> bytes | None:
    """The TIFF block of a HEIC file's Exif item; None where it has none."""
    try:
        meta = next(((a, b) for kind, a, b in _boxes(file, 0, size) if kind == b"meta"), None)
        if meta is None:
            raise Damaged("no meta box")
        parts = {kind: (a, b) for kind, a, b in _boxes(file, meta[0] + 4, meta[1])}
        item = _exif_item(file, *parts[b"iinf"]) if b"iinf" in parts else None
        if item is None:
            return None
        first, last = parts[b"iloc"]
        file.seek(first)
        method, extents = _extents(file.read(last - first), item)
        start, end = {0: (0, size), 1: parts.get(b"idat", (0, 0))}.get(method, (0, 0))
        block = b""
        for offset, length in extents:
            length = length or end - start - offset  # none given: all that follows
            if length <= 0 or start + offset + length > end:
                raise Damaged("an extent lies outside")
            file.seek(start + offset)
            block += file.read(length)
        at = 4 + int.from_bytes(block[:4], "big")
        if block[at : at + 2] not in (b"II", b"MM"):
            raise Damaged("no TIFF header")
        return block[at:]
    except (KeyError, IndexError, struct.error) as cause:
        raise Damaged(str(cause)) from None
