"""Content credentials of JPEG, PNG and WebP files: nested boxes, CBOR, hash links and an Ed25519 signature.

A file without a credential is `absent`. A credential is `signature_valid` if every assertion that its claim names hashes to what the claim says, the file
hashes to what the data binding says, and the signature over the claim holds; a certificate is not traced to any list of trusted ones. It is `unverified` if
all hashes hold but its signature is of another algorithm, and `invalid` else, with the names of what failed.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from typing import Any, NamedTuple

from pyspark.sql import DataFrame

from ..functions import crypto
from ..functions.batches import mapped
from . import images

# Names of parts and failures, the header numbers of a signature, the beginning of an Ed25519 key in a certificate, and what kinds
# of source tell of a generating model.
CLAIMS, SIGNATURE, ASSERTIONS, BINDING = ("c2pa.claim", "c2pa.claim.v2"), "c2pa.signature", "c2pa.assertions", "c2pa.hash.data"
ALGORITHM, CHAIN, EDDSA = 1, 33, -8
KEY_PREFIX = bytes.fromhex("302a300506032b6570032100")
GENERATED = ("trainedAlgorithmicMedia", "trainedAlgorithmicData", "compositeWithTrainedAlgorithmicMedia")
HASHES = {"sha256": hashlib.sha256, "sha384": hashlib.sha384, "sha512": hashlib.sha512}


class Box(NamedTuple):
    """A box: its type, label if it has one, bytes behind its header, and the boxes in it."""

    kind: bytes
    label: str
    body: bytes
    inside: tuple[Box, ...]


def boxes(data: bytes, depth: int = 0) -> tuple[Box, ...]:
    out, at = [], 0
    if depth > 32:
        raise ValueError("claim.malformed")
    while at < len(data):
        if at + 8 > len(data):
            raise ValueError("claim.malformed")
        size, kind = struct.unpack_from(">I4s", data, at)
        start = at + 8
        if size == 1 and at + 16 <= len(data):
            size, start = struct.unpack_from(">Q", data, at + 8)[0], at + 16
        end = len(data) if size == 0 else at + size
        if end > len(data) or end < start:
            raise ValueError("claim.malformed")
        body = data[start:end]
        inside = boxes(body, depth + 1) if kind == b"jumb" else ()
        label = ""
        if inside and inside[0].kind == b"jumd" and len(inside[0].body) > 17 and inside[0].body[16] & 2:
            label = inside[0].body[17:].split(b"\0")[0].decode("utf-8", "replace")
        out.append(Box(kind, label, body, inside))
        at = end
    return tuple(out)


class Cbor:
    """Reads one value of RFC 8949; tags are looked through."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ValueError("claim.cbor.invalid")
        self.at += n
        return self.data[self.at - n : self.at]

    def value(self, depth: int = 0) -> Any:
        if depth > 64:
            raise ValueError("claim.cbor.invalid")
        first = self.take(1)[0]
        major, low = first >> 5, first & 31
        if low == 31 and major in (2, 3, 4, 5):
            return self.open_ended(major, depth)
        if major == 7 and low >= 25 and low <= 27:
            return struct.unpack({25: ">e", 26: ">f", 27: ">d"}[low], self.take(1 << (low - 24)))[0]
        if low > 27:
            raise ValueError("claim.cbor.invalid")
        n = low if low < 24 else int.from_bytes(self.take(1 << (low - 24)), "big")
        if major in (0, 1):
            return n if major == 0 else -1 - n
        if major in (2, 3):
            raw = self.take(n)
            return raw if major == 2 else raw.decode()
        if major == 4:
            return [self.value(depth + 1) for _ in range(n)]
        if major == 5:
            return {self.key(depth): self.value(depth + 1) for _ in range(n)}
        if major == 6:
            return self.value(depth + 1)
        return {20: False, 21: True}.get(n)

    def key(self, depth: int):
        found = self.value(depth + 1)
        return found if isinstance(found, (str, int, bytes)) else repr(found)

    def open_ended(self, major: int, depth: int):
        parts: list = []
        while self.data[self.at : self.at + 1] != b"\xff":
            parts.append(self.value(depth + 1))
        self.at += 1
        if major in (2, 3):
            return (b"" if major == 2 else "").join(parts)
        return parts if major == 4 else dict(zip(parts[::2], parts[1::2], strict=True))


def cbor(data: bytes) -> Any:
    try:
        return Cbor(data).value()
    except (UnicodeDecodeError, IndexError, TypeError):
        raise ValueError("claim.cbor.invalid") from None


def store(data: bytes, kind: str) -> bytes | None:
    """The bytes of the box that holds a file's manifests."""
    if kind == "png":
        return next((data[a:b] for name, _, a, b in images.chunks(data, kind) if name == b"caBX"), None)
    if kind == "webp":
        return next((data[a:b] for name, _, a, b in images.chunks(data, kind) if name == b"C2PA"), None)
    if kind != "jpeg":
        return None
    parts: dict[int, dict[int, bytes]] = {}
    for marker, a, b in images.segments(data):
        body = data[a + 4 : b]
        if marker == 0xEB and body[:2] == b"JP" and len(body) > 16:
            number, packet = struct.unpack_from(">HI", body, 2)
            # Each segment repeats the header of the box that it is a part of.
            parts.setdefault(number, {})[packet] = body[8:] if packet == 1 else body[16:]
    found = [b"".join(p[k] for k in sorted(p)) for p in parts.values()]
    return next((x for x in found if b"c2pa" in x[:80]), None)


def _first(inside: tuple[Box, ...], *labels: str) -> Box | None:
    return next((b for b in inside if b.label in labels), None)


def _content(box: Box) -> bytes:
    return next((b.body for b in box.inside if b.kind in (b"cbor", b"json")), b"")


def _value(box: Box) -> Any:
    import json

    kind = next((b.kind for b in box.inside if b.kind in (b"cbor", b"json")), b"")
    return json.loads(_content(box)) if kind == b"json" else cbor(_content(box)) if kind else None


def _links(claim: dict, assertions: tuple[Box, ...], algorithm: str) -> Iterator[str]:
    """What fails among the assertions that a claim names."""
    named = [*(claim.get("assertions") or []), *(claim.get("created_assertions") or []), *(claim.get("gathered_assertions") or [])]
    for link in named:
        label = str(link.get("url", "")).rsplit("/", 1)[-1]
        box, maker = _first(assertions, label), HASHES.get(link.get("alg") or algorithm)
        if box is None:
            yield f"assertion.missing:{label}"
        elif maker is None:
            yield f"algorithm.unsupported:{label}"
        elif maker(box.body).digest() != link.get("hash"):
            yield f"assertion.hashedURI.mismatch:{label}"
    if not named:
        yield "claim.malformed"
    known = {str(link.get("url", "")).rsplit("/", 1)[-1] for link in named}
    yield from (f"assertion.undeclared:{b.label}" for b in assertions if b.label and b.label not in known)


def _bound(data: bytes, assertions: tuple[Box, ...], algorithm: str) -> Iterator[str]:
    """What fails of the binding to the file's bytes, but for those that hold the credential itself."""
    box = _first(assertions, BINDING)
    if box is None:
        yield "claim.hardBindings.missing"
        return
    said = _value(box)
    maker = HASHES.get(said.get("alg") or algorithm)
    if maker is None:
        yield "algorithm.unsupported:" + BINDING
        return
    digest, at = maker(), 0
    for gap in sorted(said.get("exclusions") or [], key=lambda g: g["start"]):
        digest.update(data[at : gap["start"]])
        at = max(at, gap["start"] + gap["length"])
    digest.update(data[at:])
    if digest.digest() != said.get("hash"):
        yield "assertion.dataHash.mismatch"


def _written(major: int, n: int) -> bytes:
    for low, size in ((24, 1), (25, 2), (26, 4), (27, 8)):
        if n < 24:
            return bytes([major << 5 | n])
        if n < 1 << 8 * size:
            return bytes([major << 5 | low]) + n.to_bytes(size, "big")
    raise ValueError("claim.cbor.invalid")


def signed_bytes(protected: bytes, claim: bytes) -> bytes:
    """What is signed: a context, the protected header, nothing, and the claim."""
    text = b"Signature1"
    return b"\x84" + _written(3, len(text)) + text + _written(2, len(protected)) + protected + b"\x40" + _written(2, len(claim)) + claim


def _signature(box: Box, claim: bytes) -> str | None:
    """None if the signature holds, else what it fails for."""
    parts = cbor(_content(box))
    if not isinstance(parts, list) or len(parts) != 4 or not isinstance(parts[0], bytes) or not isinstance(parts[3], bytes):
        return "claimSignature.malformed"
    protected, header = parts[0], cbor(parts[0]) if parts[0] else {}
    chain = header.get(CHAIN) or (parts[1] or {}).get(CHAIN)
    leaf = chain[0] if isinstance(chain, list) and chain else chain
    if header.get(ALGORITHM) != EDDSA:
        return "algorithm.unsupported:claimSignature"
    at = leaf.find(KEY_PREFIX) if isinstance(leaf, bytes) else -1
    if at < 0 or len(parts[3]) != 64:
        return "signingCredential.invalid"
    key = leaf[at + len(KEY_PREFIX) : at + len(KEY_PREFIX) + 32]
    try:
        sound = crypto.verify(key, signed_bytes(protected, claim), parts[3])
    except ValueError:
        sound = False
    return None if sound else "claimSignature.mismatch"


def _sources(assertions: tuple[Box, ...]) -> list[str]:
    out = []
    for box in assertions:
        if box.label.startswith("c2pa.actions"):
            for action in (_value(box) or {}).get("actions") or []:
                said = str(action.get("digitalSourceType") or "")
                out += [said] if said else []
    return out


def inspect(data: bytes) -> dict:
    """present, verdict, failures, title, generator, source types and whether one tells of a generating model. ValueError: no such file."""
    kind = images.kind_of(data)
    held = store(data, kind)
    out = {"present": held is not None, "verdict": "absent", "failures": [], "title": None, "generator": None, "source_types": [], "generated": False}
    if held is None:
        return out
    try:
        top = _first(boxes(held), "c2pa")
        manifests = [b for b in top.inside if b.kind == b"jumb"] if top else []
        if not manifests:
            raise ValueError("claim.missing")
        # The last manifest is the active one.
        active = manifests[-1].inside
        claim_box, signature, listed = _first(active, *CLAIMS), _first(active, SIGNATURE), _first(active, ASSERTIONS)
        if claim_box is None:
            raise ValueError("claim.missing")
        claim = _value(claim_box)
        if not isinstance(claim, dict):
            raise ValueError("claim.malformed")
        assertions = tuple(b for b in listed.inside if b.kind == b"jumb") if listed else ()
        algorithm = claim.get("alg") or "sha256"
        failures = [*_links(claim, assertions, algorithm), *_bound(data, assertions, algorithm)]
        failures += [f for f in [_signature(signature, _content(claim_box)) if signature else "claimSignature.missing"] if f]
        sources = _sources(assertions)
        out |= {"title": claim.get("dc:title"), "generator": claim.get("claim_generator"), "source_types": sources, "generated": any(s.endswith(GENERATED) for s in sources)}
    except (ValueError, KeyError, AttributeError, TypeError) as why:
        failures = [str(why) if isinstance(why, ValueError) and "." in str(why) else "claim.malformed"]
    out["failures"] = failures
    out["verdict"] = "signature_valid" if not failures else "unverified" if failures == ["algorithm.unsupported:claimSignature"] else "invalid"
    return out


SCHEMA = "path string, refusal string, present boolean, verdict string, failures array<string>, title string, generator string, source_types array<string>, generated boolean"


def inspected(files: DataFrame) -> DataFrame:
    """path and what the credential of each file (path, content) says and holds; bytes that are no image are refused by name. Row by row."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = {"present": pa.bool_(), "generated": pa.bool_(), "failures": pa.list_(pa.string()), "source_types": pa.list_(pa.string())}
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        for batch in batches:
            rows = []
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows.append({"path": path, **inspect(data or b"")})
                except (ValueError, struct.error) as why:
                    rows.append({"path": path, "refusal": str(why) if isinstance(why, ValueError) else "unreadable_metadata"})
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kinds.get(n, pa.string())) for n in names], names=names)

    return mapped(files.select("path", "content"), run, SCHEMA)
