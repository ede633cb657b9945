"""Scans as documents: an image is a document of one page that an image covers. Only headers are read."""

from __future__ import annotations

import struct

from pagewright.sources.files import Page

_DPI = 72.0


def image_size(content: bytes) -> tuple[int, int]:
    """Width and height in pixels of a PNG, GIF, BMP or JPEG."""
    if content[:8] == b"\x89PNG\r\n\x1a\n" and len(content) >= 24:
        return struct.unpack(">II", content[16:24])
    if content[:6] in (b"GIF87a", b"GIF89a") and len(content) >= 10:
        return struct.unpack("<HH", content[6:10])
    if content[:2] == b"BM" and len(content) >= 26:
        width, height = struct.unpack("<ii", content[18:26])
        return width, abs(height)
    if content[:2] == b"\xff\xd8":
        at = 2
        while at + 9 <= len(content) and content[at] == 0xFF:
            marker, length = content[at + 1], struct.unpack(">H", content[at + 2 : at + 4])[0]
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                height, width = struct.unpack(">HH", content[at + 5 : at + 9])
                return width, height
            at += 2 + length
    raise ValueError("no PNG, GIF, BMP or JPEG header")


def decode_image(path: str, content: bytes, dpi: float = _DPI) -> list[Page]:
    width, height = (72.0 * n / dpi for n in image_size(content))
    return [Page(width, height, objects=[("image", 0.0, 0.0, width, height)])]
