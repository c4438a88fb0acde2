"""Metadata of JPEG, TIFF, PNG and WebP images: directories of tags in either byte order, chained and nested, and XMP packets."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame

from ..functions.batches import mapped

# Names of tags by number, pointers to further directories, sizes of the value types, and what is no metadata in a TIFF.
TAGS = {
    0x0100: "ImageWidth", 0x0101: "ImageLength", 0x010E: "ImageDescription", 0x010F: "Make", 0x0110: "Model", 0x0112: "Orientation", 0x011A: "XResolution", 0x011B: "YResolution", 0x0128: "ResolutionUnit", 0x0131: "Software",
    0x0132: "DateTime", 0x013B: "Artist", 0x8298: "Copyright", 0x829A: "ExposureTime", 0x829D: "FNumber", 0x8827: "PhotographicSensitivity", 0x9000: "ExifVersion", 0x9003: "DateTimeOriginal", 0x9004: "DateTimeDigitized",
    0x920A: "FocalLength", 0x9286: "UserComment", 0xA002: "PixelXDimension", 0xA003: "PixelYDimension", 0xA433: "LensMake", 0xA434: "LensModel",
}
GPS_TAGS = {0: "GPSVersionID", 1: "GPSLatitudeRef", 2: "GPSLatitude", 3: "GPSLongitudeRef", 4: "GPSLongitude", 5: "GPSAltitudeRef", 6: "GPSAltitude", 7: "GPSTimeStamp", 29: "GPSDateStamp"}
POINTERS = {0x8769: "exif", 0x8825: "gps", 0xA005: "interoperability"}
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
TIFF_METADATA = frozenset((0x010E, 0x010F, 0x0110, 0x0131, 0x0132, 0x013B, 0x013C, 0x8298, 0x02BC, 0x83BB, 0x8649, 0x8769, 0x8825, 0xA005, 0x9286))
FORMATS = ("jpeg", "tiff", "png", "webp")
XMP_SEGMENT, EXIF_SEGMENT, PNG = b"http://ns.adobe.com/xap/1.0/\0", b"Exif\0\0", b"\x89PNG\r\n\x1a\n"
DUBLIN_CORE = ("title", "creator", "rights")


class Entry(NamedTuple):
    """A tag with its values, the directory it is in, and where its entry and its values lie."""

    group: str
    tag: int
    values: str | tuple
    place: int
    data: tuple[int, int]


def _value(kind: int, raw: bytes, n: int, order: str) -> str | tuple:
    if kind in (2, 7):
        return raw.split(b"\0\0")[0].rstrip(b"\0").decode("utf-8", "replace") if kind == 2 else raw.decode("latin-1")
    if kind in (5, 10):
        pairs = struct.unpack(f"{order}{2 * n}{'I' if kind == 5 else 'i'}", raw)
        return tuple(f"{a}/{b}" for a, b in zip(pairs[::2], pairs[1::2], strict=True))
    return struct.unpack(f"{order}{n}{ {1: 'B', 3: 'H', 4: 'I', 6: 'b', 8: 'h', 9: 'i', 11: 'f', 12: 'd'}[kind]}", raw)


def directories(tiff: bytes) -> list[Entry]:
    """All entries of a TIFF block: of its chained directories and of those they point to. Loops, offsets beyond the end and unknown orders are refused."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(tiff[:4])
    if order is None:
        raise ValueError("unreadable_metadata")
    out: list[Entry] = []
    seen: set[int] = set()
    todo = [("primary", struct.unpack(order + "I", tiff[4:8])[0])] if len(tiff) >= 8 else []
    while todo:
        group, at = todo.pop(0)
        if at in seen or at < 8 or at + 2 > len(tiff):
            raise ValueError("unreadable_metadata")
        seen.add(at)
        count = struct.unpack_from(order + "H", tiff, at)[0]
        if at + 2 + 12 * count + (4 if group in ("primary", "thumbnail") else 0) > len(tiff):
            raise ValueError("unreadable_metadata")
        for place in range(at + 2, at + 2 + 12 * count, 12):
            tag, kind, n = struct.unpack_from(order + "HHI", tiff, place)
            if kind not in SIZES:
                continue
            size = SIZES[kind] * n
            start = place + 8 if size <= 4 else struct.unpack_from(order + "I", tiff, place + 8)[0]
            if start + size > len(tiff):
                raise ValueError("unreadable_metadata")
            out.append(Entry(group, tag, _value(kind, tiff[start : start + size], n, order), place, (start, start + size)))
            if tag in POINTERS and kind == 4 and n == 1:
                todo.append((POINTERS[tag], out[-1].values[0]))
        if group in ("primary", "thumbnail"):
            after = struct.unpack_from(order + "I", tiff, at + 2 + 12 * count)[0]
            if after:
                todo.append(("thumbnail", after))
    return out


def segments(data: bytes) -> Iterator[tuple[int, int, int]]:
    """(marker, start, end) of the segments of a JPEG before its image data."""
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("unreadable_metadata")
        if data[at + 1] in (0xDA, 0xD9):
            return
        size = struct.unpack_from(">H", data, at + 2)[0]
        if size < 2 or at + 2 + size > len(data):
            raise ValueError("unreadable_metadata")
        yield data[at + 1], at, at + 2 + size
        at += 2 + size
    raise ValueError("unreadable_metadata")


def chunks(data: bytes, kind: str) -> Iterator[tuple[bytes, int, int, int]]:
    """(name, start, start of the body, end of the body) of the chunks of a PNG or a WebP."""
    at, size_first = (8, True) if kind == "png" else (12, False)
    if not size_first and struct.unpack_from("<I", data, 4)[0] + 8 > len(data):
        raise ValueError("unreadable_metadata")
    name = b""
    while at + 8 <= len(data):
        name, size = (data[at + 4 : at + 8], struct.unpack_from(">I", data, at)[0]) if size_first else (data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0])
        if at + 8 + size > len(data):
            raise ValueError("unreadable_metadata")
        yield name, at, at + 8, at + 8 + size
        at += 8 + size + (4 if size_first else size % 2)
    if size_first and name != b"IEND":
        raise ValueError("unreadable_metadata")


def kind_of(data: bytes) -> str:
    if data[:2] == b"\xff\xd8":
        return "jpeg"
    if data.startswith(PNG):
        return "png"
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return "webp"
    if data[:4] in (b"II*\0", b"MM\0*"):
        return "tiff"
    raise ValueError("no_image_metadata")


def exif_block(data: bytes, kind: str) -> bytes | None:
    """The TIFF block that holds an image's tags."""
    if kind == "tiff":
        return data
    if kind == "jpeg":
        return next((data[a + 10 : b] for m, a, b in segments(data) if m == 0xE1 and data[a + 4 : a + 10] == EXIF_SEGMENT), None)
    block = next((data[a:b] for name, _, a, b in chunks(data, kind) if name == (b"eXIf" if kind == "png" else b"EXIF")), None)
    return block.removeprefix(EXIF_SEGMENT) if block is not None else None


def xmp_packet(data: bytes) -> str | None:
    """The packet's XML, wherever in the file it stands."""
    found = re.search(rb"<x:xmpmeta\b.*?</x:xmpmeta>|<rdf:RDF\b.*?</rdf:RDF>", data, re.S)
    return found[0].decode("utf-8", "replace") if found else None


def read(data: bytes) -> dict:
    """What an image tells of itself; ValueError names what can't be read."""
    import html

    kind = kind_of(data)
    block = exif_block(data, kind)
    entries = directories(block) if block is not None else []
    shown = lambda v: v if isinstance(v, str) else ", ".join(map(str, v))
    named = [((GPS_TAGS if e.group == "gps" else TAGS).get(e.tag, f"Tag0x{e.tag:04X}"), shown(e.values)) for e in entries if e.tag not in POINTERS]
    first = {}
    for e in entries:
        if e.group in ("primary", "exif"):
            first.setdefault(TAGS.get(e.tag), shown(e.values).strip().strip("\0").strip())
    xml = xmp_packet(data)
    core = {}
    for name in DUBLIN_CORE:
        found = re.search(rf"<dc:{name}\b[^>]*>(?:.*?<rdf:li[^>]*>)?([^<]*)<", xml or "", re.S)
        core[name] = html.unescape(found[1]).strip() or None if found else None
    return {
        "format": kind, "has_exif": bool(entries) if kind == "tiff" else block is not None, "make": first.get("Make") or None, "model": first.get("Model") or None, "software": first.get("Software") or None,
        "taken": first.get("DateTimeOriginal") or None, "orientation": first.get("Orientation") or None, "width": first.get("PixelXDimension") or first.get("ImageWidth") or None,
        "height": first.get("PixelYDimension") or first.get("ImageLength") or None, "gps_present": any(e.group == "gps" for e in entries), "tags": named, "xmp": xml, **core,
    }


def stripped(data: bytes) -> bytes:
    """The image without metadata; its picture data stay as they are."""
    kind = kind_of(data)
    if kind == "jpeg":
        gone = [(a, b) for m, a, b in segments(data) if m in (0xE1, 0xED, 0xFE)]
        out, at = b"", 0
        for a, b in gone:
            out, at = out + data[at:a], b
        return out + data[at:]
    if kind == "png":
        meta = (b"tEXt", b"zTXt", b"iTXt", b"eXIf", b"tIME")
        return PNG + b"".join(data[a : end + 4] for name, a, _, end in chunks(data, kind) if name not in meta)
    if kind == "webp":
        body = b""
        for name, a, start, end in chunks(data, kind):
            part = data[a : end + (end - start) % 2]
            if name == b"VP8X":
                # The flags that tell of the two chunks.
                part = part[:8] + bytes([part[8] & ~0x0C]) + part[9:]
            body += part if name not in (b"EXIF", b"XMP ") else b""
        return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WEBP" + body
    return _bare_tiff(data)


def _bare_tiff(data: bytes) -> bytes:
    """A TIFF with its metadata entries taken out of its directories, and their values overwritten; what stays lies where it lay."""
    order = "<" if data[:2] == b"II" else ">"
    entries, out = directories(data), bytearray(data)
    pointed = {e.values[0] for e in entries if e.tag in POINTERS}
    for e in entries:
        if e.group not in ("primary", "thumbnail") or e.tag in TIFF_METADATA:
            out[e.data[0] : e.data[1]] = bytes(e.data[1] - e.data[0])
    at = struct.unpack_from(order + "I", data, 4)[0]
    while at:
        count = struct.unpack_from(order + "H", data, at)[0]
        kept = [data[p : p + 12] for p in range(at + 2, at + 2 + 12 * count, 12) if struct.unpack_from(order + "H", data, p)[0] not in TIFF_METADATA]
        after = data[at + 2 + 12 * count : at + 6 + 12 * count]
        new = struct.pack(order + "H", len(kept)) + b"".join(kept) + after
        out[at : at + 6 + 12 * count] = new + bytes(6 + 12 * count - len(new))
        at = struct.unpack(order + "I", after)[0]
    for at in pointed:
        size = 2 + 12 * struct.unpack_from(order + "H", data, at)[0]
        out[at : at + size] = bytes(size)
    return bytes(out)


SCHEMA = (
    "path string, refusal string, format string, has_exif boolean, make string, model string, software string, taken string, orientation string, width string, height string, gps_present boolean, "
    "tags array<struct<name:string,value:string>>, xmp string, title string, creator string, rights string"
)


def tables(files: DataFrame) -> DataFrame:
    """path, refusal and what each image tells of itself, of files (path, content). Row by row; bytes that are no image, cut off or
    in a loop are refused by name."""
    names = [f.split()[0] for f in re.sub(r"<[^>]*>+", "", SCHEMA).split(", ")]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        texts = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
        kinds = {"has_exif": pa.bool_(), "gps_present": pa.bool_(), "tags": texts}
        for batch in batches:
            rows = []
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    found = read(data or b"")
                    rows.append({"path": path, **found, "tags": [{"name": n, "value": v} for n, v in found["tags"]]})
                except (ValueError, struct.error) as why:
                    rows.append({"path": path, "refusal": str(why) if isinstance(why, ValueError) else "unreadable_metadata"})
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kinds.get(n, pa.string())) for n in names], names=names)

    return mapped(files.select("path", "content"), run, SCHEMA)
