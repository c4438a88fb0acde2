"""Content credentials: built manifests, broken hashes and signatures told apart."""

import hashlib
import struct

import images as made
import pytest

from inkledger.functions import crypto
from inkledger.sources import credentials as cr

SEED = bytes(range(32))


def dumps(v):
    head = cr._written
    if isinstance(v, bool):
        return b"\xf5" if v else b"\xf4"
    if v is None:
        return b"\xf6"
    if isinstance(v, int):
        return head(0, v) if v >= 0 else head(1, -1 - v)
    if isinstance(v, bytes):
        return head(2, len(v)) + v
    if isinstance(v, str):
        return head(3, len(v.encode())) + v.encode()
    if isinstance(v, list):
        return head(4, len(v)) + b"".join(map(dumps, v))
    return head(5, len(v)) + b"".join(dumps(k) + dumps(x) for k, x in v.items())


def box(kind, body):
    return struct.pack(">I4s", 8 + len(body), kind) + body


def superbox(label, *inside):
    return box(b"jumb", box(b"jumd", bytes(16) + b"\x03" + label.encode() + b"\0") + b"".join(inside))


def manifest(file_hash, start, length, seed=SEED, algorithm=-8, change=None, source="http://cv.iptc.org/newscodes/digitalsourcetype/trainedAlgorithmicMedia"):
    """A store with one manifest whose data binding leaves out a part of the file."""
    values = {"c2pa.actions": {"actions": [{"action": "c2pa.created", "digitalSourceType": source}]}, "c2pa.hash.data": {"exclusions": [{"start": start, "length": length}], "alg": "sha256", "hash": file_hash}}
    made_ = {k: superbox(k, box(b"cbor", dumps(v))) for k, v in values.items()}
    claim = dumps({"dc:title": "A picture", "claim_generator": "tool/1", "alg": "sha256", "assertions": [{"url": f"self#jumbf=c2pa.assertions/{k}", "hash": hashlib.sha256(v[8:]).digest()} for k, v in made_.items()]})
    if change == "assertion":
        made_["c2pa.actions"] = made_["c2pa.actions"].replace(b"created", b"cropped")
    protected = dumps({1: algorithm, 33: b"certificate" + cr.KEY_PREFIX + crypto.public_key(SEED) + b"..."})
    mark = crypto.sign(seed, cr.signed_bytes(protected, claim))
    if change == "claim":
        claim = claim.replace(b"A picture", b"B picture")
    signature = b"\xd2" + dumps([protected, {}, None, mark])
    inside = superbox("urn:uuid:1", superbox("c2pa.assertions", *made_.values()), superbox("c2pa.claim", box(b"cbor", claim)), superbox("c2pa.signature", box(b"cbor", signature)))
    return superbox("c2pa", inside)


def with_store(kind, store):
    """An image that holds a store, and where that lies."""
    if kind == "png":
        plain, part = made.png(), made.chunk(b"caBX", store)
        at = plain.index(b"IDAT") - 4
        return plain[:at] + part + plain[at:], at, len(part)
    if kind == "webp":
        part = b"C2PA" + struct.pack("<I", len(store)) + store + b"\0" * (len(store) % 2)
        body = made.webp()[12:] + part
        return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WEBP" + body, 12 + len(body) - len(part), len(part)
    # Two segments, each behind the header of the box.
    half, plain = len(store) // 2, made.jpeg()
    parts = b""
    for number, piece in ((1, store[:half]), (2, store[:8] + store[half:])):
        body = b"JP" + struct.pack(">HI", 1, number) + piece
        parts += b"\xff\xeb" + struct.pack(">H", len(body) + 2) + body
    return plain[:2] + parts + plain[2:], 2, len(parts)


def image(kind, **options):
    """An image with its credential; the binding's hash has a fixed size, so a first pass tells where the store will lie."""
    _, start, length = with_store(kind, manifest(bytes(32), 10_000, 10_000, **options))
    for _ in range(3):
        data, start, length = with_store(kind, manifest(bytes(32), start, length, **options))
    digest = hashlib.sha256(data[:start] + data[start + length :]).digest()
    return with_store(kind, manifest(digest, start, length, **options))[0]


@pytest.mark.parametrize("kind", ["png", "webp", "jpeg"])
def test_sound_credentials(kind):
    got = cr.inspect(image(kind))
    assert (got["present"], got["verdict"], got["failures"]) == (True, "signature_valid", [])
    assert (got["title"], got["generator"], got["generated"]) == ("A picture", "tool/1", True)
    assert not cr.inspect(image(kind, source="http://cv.iptc.org/newscodes/digitalsourcetype/digitalCapture"))["generated"]


@pytest.mark.parametrize("kind", ["png", "webp", "jpeg"])
def test_what_is_broken_is_named(kind):
    assert cr.inspect(image(kind, change="assertion"))["failures"] == ["assertion.hashedURI.mismatch:c2pa.actions"]
    assert cr.inspect(image(kind, change="claim"))["failures"] == ["claimSignature.mismatch"]
    assert cr.inspect(image(kind, seed=bytes(32)))["failures"] == ["claimSignature.mismatch"]
    other = cr.inspect(image(kind, algorithm=-7))
    assert (other["verdict"], other["failures"]) == ("unverified", ["algorithm.unsupported:claimSignature"])
    sound = image(kind)
    damaged = cr.inspect(sound.replace(made.PIXELS, made.PIXELS.upper()))
    assert (damaged["verdict"], damaged["failures"]) == ("invalid", ["assertion.dataHash.mismatch"])
    torn = cr.inspect(with_store(kind, superbox("c2pa", superbox("urn:uuid:1", box(b"cbor", b"\x9f"))))[0])
    assert (torn["present"], torn["verdict"], torn["failures"]) == (True, "invalid", ["claim.missing"])


def test_absent_and_other_files(spark):
    for data in (made.png(), made.jpeg(), made.webp()):
        assert cr.inspect(data) | {} == {"present": False, "verdict": "absent", "failures": [], "title": None, "generator": None, "source_types": [], "generated": False}
    with pytest.raises(ValueError, match="no_image_metadata"):
        cr.inspect(b"text")
    files = [("a", bytearray(image("png"))), ("b", bytearray(made.jpeg())), ("c", bytearray(b"text")), ("d", None)]
    got = {r.path: (r.refusal, r.verdict) for r in cr.inspected(spark.createDataFrame(files, "path string, content binary")).collect()}
    assert got == {"a": (None, "signature_valid"), "b": (None, "absent"), "c": ("no_image_metadata", None), "d": ("no_image_metadata", None)}


def test_cbor():
    values = [0, 23, 24, 65536, -1, -500, b"x" * 300, "é", [1, [2, {"a": None}]], {"k": True, 3: False}]
    for v in values:
        assert cr.cbor(dumps(v)) == v
    assert cr.cbor(bytes.fromhex("9f018202039f0405ffff")) == [1, [2, 3], [4, 5]] and cr.cbor(bytes.fromhex("f93c00")) == 1.0
    for bad in (b"", b"\x5a\x00", b"\x9f\x01", b"\xff", b"\x1f"):
        with pytest.raises(ValueError):
            cr.cbor(bad)
