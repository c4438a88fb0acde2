"""Image metadata of every container, in both byte orders, and images without it."""

import struct

import images as made
import pytest

from inkledger.sources import images

ORDERS = ("<", ">")


def block(order, picture=b""):
    gps = [(1, 2, 2, b"N\0"), (2, 5, 3, struct.pack(order + "6I", 52, 1, 30, 1, 0, 1))]
    exif = [made.text(0x9003, "2020:01:02 03:04:05"), (0xA002, 4, 1, struct.pack(order + "I", 800)), made.short(order, 0xA003, 600)]
    primary = [made.text(0x010F, "Maker"), made.text(0x0110, "M1"), made.short(order, 0x0112, 6), made.text(0x0131, "é soft"), made.short(order, 0x0100, 8), (0x0111, 4, 1, struct.pack(order + "I", 8))]
    return made.tiff(order, primary, exif, gps, [made.short(order, 0x0100, 4), made.text(0x010E, "small one")], picture)


def all_of(order):
    return {"tiff": block(order, made.PIXELS), "jpeg": made.jpeg(block(order), made.XMP), "png": made.png(block(order), made.XMP), "webp": made.webp(block(order), made.XMP)}


@pytest.mark.parametrize("order", ORDERS)
@pytest.mark.parametrize("kind", images.FORMATS)
def test_read_and_strip(order, kind):
    data = all_of(order)[kind]
    got = images.read(data)
    assert (got["format"], got["has_exif"], got["make"], got["model"], got["software"], got["taken"]) == (kind, True, "Maker", "M1", "é soft", "2020:01:02 03:04:05")
    assert (got["orientation"], got["width"], got["height"], got["gps_present"]) == ("6", "800", "600", True)
    assert ("GPSLatitude", "52/1, 30/1, 0/1") in got["tags"] and ("ImageDescription", "small one") in got["tags"]
    assert (got["title"], got["creator"], got["rights"]) == (("A & B", "Someone", None) if kind != "tiff" else (None, None, None))
    bare = images.stripped(data)
    left = images.read(bare)
    assert made.PIXELS in bare and not any(x in bare for x in (b"Maker", b"small one", b"Someone", b"2020:"))
    assert not left["gps_present"] and left["make"] is left["title"] is left["xmp"] is None
    if kind == "tiff":
        # What the picture needs stays where it was.
        assert left["tags"] == [("ImageWidth", "8"), ("Tag0x0111", "8"), ("Orientation", "6"), ("ImageWidth", "4")]
        assert bare[8 : 8 + len(made.PIXELS)] == made.PIXELS and len(bare) == len(data)
    else:
        assert not left["has_exif"] and left["tags"] == []
    if kind == "webp":
        assert bare[20] == 0 and struct.unpack("<I", bare[4:8])[0] == len(bare) - 8
    assert images.stripped(bare) == bare


@pytest.mark.parametrize("order", ORDERS)
def test_loops_and_cut_files_are_refused(order):
    data = bytearray(block(order))
    first = struct.unpack_from(order + "I", data, 4)[0]
    count = struct.unpack_from(order + "H", data, first)[0]
    struct.pack_into(order + "I", data, first + 2 + 12 * count, first)
    with pytest.raises(ValueError, match="unreadable_metadata"):
        images.read(bytes(data))
    for kind, whole in all_of(order).items():
        with pytest.raises(ValueError, match="unreadable_metadata"):
            images.read(whole[: len(whole) // 2 if kind == "tiff" else 60])
    for other in (b"", b"GIF89a", b"plain"):
        with pytest.raises(ValueError, match="no_image_metadata"):
            images.read(other)


def test_images_without_metadata():
    for data in (made.jpeg(), made.png(), made.webp()):
        got = images.read(data)
        assert not got["has_exif"] and got["tags"] == [] and got["xmp"] is None
        assert images.stripped(data) == data


def test_table_of_images(spark):
    rows = [(f"{kind}{order}", bytearray(data)) for order in ORDERS for kind, data in all_of(order).items()] + [("x.txt", bytearray(b"text")), ("cut", bytearray(made.webp(block("<"))[:40])), ("null", None)]
    got = {r.path: r for r in images.tables(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert len(got) == len(rows)
    assert (got["x.txt"].refusal, got["cut"].refusal, got["null"].refusal) == ("no_image_metadata", "unreadable_metadata", "no_image_metadata")
    assert got["webp>"].make == "Maker" and got["jpeg<"].title == "A & B" and ("Make", "Maker") in [tuple(t) for t in got["tiff>"].tags]
