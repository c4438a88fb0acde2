"""Images of every kind with given tags, built from their formats."""

import struct
import zlib

PIXELS = b"picture data"


def tiff(order, primary, exif=(), gps=(), second=(), picture=b""):
    """A TIFF block: directories of (tag, type, count, bytes), those behind pointers, and a chained one."""
    out = bytearray((b"II*\0" if order == "<" else b"MM\0*") + bytes(4) + picture + b"\0" * (len(picture) % 2))

    def directory(entries, chained=False):
        placed = []
        for tag, kind, n, raw in sorted(entries):
            if len(raw) > 4:
                place = len(out)
                out.extend(raw + b"\0" * (len(raw) % 2))
                raw = struct.pack(order + "I", place)
            placed.append(struct.pack(order + "HHI", tag, kind, n) + raw.ljust(4, b"\0"))
        at = len(out)
        out.extend(struct.pack(order + "H", len(placed)) + b"".join(placed) + (bytes(4) if chained else b""))
        return at

    pointers = [(tag, 4, 1, struct.pack(order + "I", directory(entries))) for tag, entries in ((0x8769, exif), (0x8825, gps)) if entries]
    first = directory([*primary, *pointers], True)
    struct.pack_into(order + "I", out, 4, first)
    if second:
        struct.pack_into(order + "I", out, len(out) - 4, directory(second, True))
    return bytes(out)


def text(tag, value):
    raw = value.encode() + b"\0"
    return tag, 2, len(raw), raw


def short(order, tag, value):
    return tag, 3, 1, struct.pack(order + "H", value)


def chunk(name, body):
    return struct.pack(">I4s", len(body), name) + body + struct.pack(">I", zlib.crc32(name + body))


def png(exif=None, xmp=None):
    extra = (chunk(b"eXIf", exif) if exif else b"") + (chunk(b"iTXt", b"XML:com.adobe.xmp\0\0\0\0\0" + xmp) if xmp else b"")
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bytes(13)) + extra + chunk(b"IDAT", PIXELS) + chunk(b"IEND", b"")


def jpeg(exif=None, xmp=None):
    segment = lambda m, body: b"\xff" + bytes([m]) + struct.pack(">H", len(body) + 2) + body
    extra = (segment(0xE1, b"Exif\0\0" + exif) if exif else b"") + (segment(0xE1, b"http://ns.adobe.com/xap/1.0/\0" + xmp) if xmp else b"")
    return b"\xff\xd8" + segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + extra + segment(0xDB, bytes(65)) + b"\xff\xda" + PIXELS + b"\xff\xd9"


def webp(exif=None, xmp=None):
    part = lambda name, body: name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
    flags = (8 if exif else 0) | (4 if xmp else 0)
    body = part(b"VP8X", bytes([flags]) + bytes(9)) + part(b"VP8L", PIXELS + b"!") + (part(b"EXIF", exif) if exif else b"") + (part(b"XMP ", xmp) if xmp else b"")
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WEBP" + body


XMP = b'<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF><rdf:Description><dc:title><rdf:Alt><rdf:li xml:lang="x-default">A &amp; B</rdf:li></rdf:Alt></dc:title><dc:creator><rdf:Seq><rdf:li>Someone</rdf:li></rdf:Seq></dc:creator></rdf:Description></rdf:RDF></x:xmpmeta>'
