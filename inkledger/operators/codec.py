"""Sequential codecs in Arrow batches: checksums, frames, envelopes, placement, protected regions."""

from __future__ import annotations

import binascii
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
from pyspark.sql import DataFrame

from ..functions import charsets as cs
from ..functions.batches import mapped

# The frame's magic, its versions, and flag bits that must be 0.
MAGIC, PLAIN, SALTED, RESERVED = 0x5348, 3, 4, 0xF0
ENVELOPE_VERSION = 2
#: Bits of the largest frame: its head with a salt and checksum, and a payload of 65,535 bits.
LARGEST = 8 * (22 + 2) + 0xFFFF


def crc16(data: bytes) -> int:
    """CRC-16 with polynomial 0x1021 and start 0xFFFF."""
    return binascii.crc_hqx(data, 0xFFFF)


def checksums(docs: DataFrame) -> DataFrame:
    """doc_id, crc32_hex, crc16_hex of every whole text."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            data = [t.encode() for t in batch.column(1).to_pylist()]
            columns = [pa.array([f"{binascii.crc32(d):08x}" for d in data], pa.string()), pa.array([f"{crc16(d):04x}" for d in data], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "crc32_hex", "crc16_hex"])

    return mapped(docs.select("doc_id", "text"), run, "doc_id long, crc32_hex string, crc16_hex string")


def to_bits(data: bytes) -> str:
    return f"{int.from_bytes(data, 'big'):0{8 * len(data)}b}" if data else ""


def to_bytes(bits: str) -> bytes:
    size = len(bits) // 8
    return int(bits[: 8 * size], 2).to_bytes(size, "big") if size else b""


def frame(payload: bytes, flags: int = 0, salt: bytes | None = None) -> bytes:
    """magic, version, flags, payload bits, [salt], CRC of all before, payload."""
    if not payload:
        raise ValueError("empty_payload")
    if 8 * len(payload) > 0xFFFF:
        raise ValueError("payload_too_long")
    head = MAGIC.to_bytes(2, "big") + bytes((SALTED if salt else PLAIN, flags)) + (8 * len(payload)).to_bytes(2, "big") + (salt or b"")
    return head + crc16(head).to_bytes(2, "big") + payload


def unframe(bits: str) -> tuple[int, bytes | None, bytes]:
    """flags, salt and payload of a frame at the start of a bit string; what is wrong is said by name."""
    data = to_bytes(bits)
    if len(data) < 8:
        raise ValueError("too_short")
    if int.from_bytes(data[:2], "big") != MAGIC:
        raise ValueError("no_magic")
    if data[2] not in (PLAIN, SALTED):
        raise ValueError("unknown_version")
    end = 22 if data[2] == SALTED else 6
    if len(data) < end + 2:
        raise ValueError("too_short")
    if data[3] & RESERVED:
        raise ValueError("reserved_flags")
    if crc16(data[:end]) != int.from_bytes(data[end : end + 2], "big"):
        raise ValueError("bad_checksum")
    size = int.from_bytes(data[4:6], "big")
    if size % 8:
        raise ValueError("partial_byte")
    if len(data) < end + 2 + size // 8:
        raise ValueError("payload_cut")
    return data[3], data[6:22] if end == 22 else None, data[end + 2 : end + 2 + size // 8]


def scan(bits: str) -> tuple[int, bytes | None, bytes] | None:
    """The first whole frame at any bit."""
    magic, at = f"{MAGIC:016b}", -1
    while (at := bits.find(magic, at + 1)) >= 0:
        try:
            return unframe(bits[at : at + LARGEST])
        except ValueError:
            continue
    return None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes((*out, n))


def envelope(chain: list[tuple[str, bytes]], payload: bytes) -> bytes:
    """Version, steps as name and state, payload; each length in 7-bit groups."""
    part = lambda b: _varint(len(b)) + b
    return bytes((ENVELOPE_VERSION,)) + _varint(len(chain)) + b"".join(part(i.encode()) + part(s) for i, s in chain) + part(payload)


def open_envelope(data: bytes) -> tuple[list[tuple[str, bytes]], bytes]:
    at = 1

    def number() -> int:
        nonlocal at
        n = shift = 0
        while True:
            b = data[at]
            at += 1
            n |= (b & 0x7F) << shift
            if b < 0x80:
                return n
            shift += 7

    def part() -> bytes:
        nonlocal at
        n = number()
        if at + n > len(data):
            raise ValueError("envelope_cut")
        at += n
        return data[at - n : at]

    if not data or data[0] != ENVELOPE_VERSION:
        raise ValueError("unknown_envelope")
    chain = [(part().decode(), part()) for _ in range(number())]
    return chain, part()


# ---- protected regions -------------------------------------------------------------------------------------------


_OPENER, _TICKS = re.compile(r"[`~\\$]"), re.compile("`+")


def protected(text: str) -> list[tuple[int, int, str]]:
    """(from, to, kind) of fenced blocks, code spans on one line, and maths; an unclosed fence runs to the end."""
    out, at, n = [], 0, len(text)
    while found := _OPENER.search(text, at):
        at = found.start()
        c = text[at]
        if c in "`~" and text.startswith(c * 3, at) and (at == 0 or text[text.rfind("\n", 0, at) + 1 : at].strip(" ") == ""):
            close = text.find("\n" + c * 3, at + 3)
            end = n if close < 0 else close + 4
            out.append((at, end, "fence"))
        elif c == "`":
            run = _TICKS.match(text, at).end() - at
            close = text.find("`" * run, at + run)
            if close < 0 or "\n" in text[at:close]:
                at += run
                continue
            end = close + run
            out.append((at, end, "code"))
        elif c == "\\" and text[at + 1 : at + 2] in ("[", "("):
            close = text.find("\\]" if text[at + 1] == "[" else "\\)", at + 2)
            if close < 0:
                at += 1
                continue
            end = close + 2
            out.append((at, end, "maths"))
        elif c == "$":
            double = text.startswith("$$", at)
            width = 2 if double else 1
            close = text.find("$" * width, at + width)
            inner = text[at + width : close] if close > 0 else ""
            if not inner or (not double and (inner[0].isspace() or inner[-1].isspace() or "\n\n" in inner)):
                at += width
                continue
            end = close + width
            out.append((at, end, "maths"))
        else:
            at += 1
            continue
        at = end
    return out


@cache
def _word_codes() -> np.ndarray:
    """Which code points are part of a word."""
    word = np.fromiter((chr(c).isalnum() for c in range(0x110000)), dtype=bool, count=0x110000)
    word[ord("_")] = True
    return word


@cache
def _letter_codes() -> tuple[np.ndarray, np.ndarray]:
    """By code point: 1 for a Latin look-alike, 2 for a Cyrillic one; and the Cyrillic twin of each Latin one."""
    kinds, twins = np.zeros(0x110000, dtype=np.uint8), np.zeros(0x110000, dtype=np.uint32)
    for a, b in zip(cs.LATIN_LOOKALIKES, cs.CYRILLIC_LOOKALIKES, strict=True):
        kinds[ord(a)], kinds[ord(b)], twins[ord(a)] = 1, 2, ord(b)
    return kinds, twins


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _text(codes: np.ndarray) -> str:
    return codes.tobytes().decode("utf-32-le", "surrogatepass")


def _gaps(codes: np.ndarray, text: str) -> np.ndarray:
    word = _word_codes()[codes]
    free = np.ones(len(codes) + 1, dtype=bool)
    free[1:-1] = ~(word[:-1] & word[1:])
    for low, high, _ in protected(text):
        free[low : high + 1] = False
    return np.flatnonzero(free)


def slots(text: str) -> list[int]:
    """Gaps where a character may be inserted: not inside a word, and not in or at a protected region."""
    return _gaps(_codes(text), text).tolist()


def write_bits(text: str, bits: str, carrier: str) -> str:
    """The text with a carrier's characters for the bits; an occupied or too small cover is refused by name."""
    zero, one, end, _ = cs.CARRIERS[carrier]
    if any(c in text for c in zero + one + end):
        raise ValueError("occupied")
    marks = bits.translate({ord("0"): zero, ord("1"): one})
    if end:
        marks = end.join(marks[k : k + 8] for k in range(0, len(marks), 8))
    codes = _codes(text)
    free = _gaps(codes, text)
    if len(marks) > len(free) and carrier != "zero_width":
        raise ValueError("too_small")
    free = free[: len(marks)]
    return _text(np.insert(codes, free, _codes(marks[: len(free)]))) + marks[len(free) :]


def _letters(codes: np.ndarray, text: str) -> np.ndarray:
    """The kind of each character, 0 for other letters than look-alikes and in code and maths."""
    kinds = _letter_codes()[0][codes]
    for low, high, _ in protected(text):
        kinds[low:high] = 0
    return kinds


def write_letters(text: str, bits: str) -> str:
    """The text with the bits in its look-alike letters outside code and maths."""
    if any(c in text for c in cs.CYRILLIC_LOOKALIKES):
        raise ValueError("occupied")
    codes = _codes(text).copy()
    places = np.flatnonzero(_letters(codes, text))
    if len(places) < len(bits):
        raise ValueError("too_small")
    ones = places[: len(bits)][np.frombuffer(bits.encode(), dtype=np.uint8) == ord("1")]
    codes[ones] = _letter_codes()[1][codes[ones]]
    return _text(codes)


def read_bits(text: str, carrier: str) -> str:
    if carrier == "homoglyph":
        kinds = _letters(_codes(text), text)
        return (kinds[kinds > 0] + (ord("0") - 1)).tobytes().decode()
    zero, one, *_ = cs.CARRIERS[carrier]
    if zero not in text and one not in text:
        return ""
    return "".join(re.findall(f"[{zero}{one}]", text)).translate({ord(zero): "0", ord(one): "1"})


#: What a cover or payload is refused for before anything is written. Any other error is a failure.
REFUSALS = frozenset(("occupied", "too_small", "empty_payload", "payload_too_long"))


def refusal(why: ValueError) -> str | None:
    return str(why) if str(why) in REFUSALS else None


#: Shares of positions a concealed payload may fill, and carriers in the order they are written.
CARRIERS = ("zero_width", "whitespace_var", "bidi", "homoglyph")


def encode(text: str, secret: bytes, carriers: tuple[str, ...], repeat: bool = False) -> str:
    """The text with the secret's frame in each carrier, read back before it is returned; with repeat, as often as there is room."""
    for carrier in sorted(carriers, key=CARRIERS.index):
        bits = to_bits(frame(envelope([("crc32", b"")], secret + _crc32(secret))))
        if repeat and carrier != "zero_width":
            room = len(slots(text)) * 8 // 9 if carrier != "homoglyph" else len(read_bits(text, carrier))
            bits *= max(1, room // len(bits))
        text = write_letters(text, bits) if carrier == "homoglyph" else write_bits(text, bits, carrier)
        if not read_bits(text, carrier).startswith(bits):
            raise ValueError("read_back_differs")
    return text


def _crc32(data: bytes) -> bytes:
    import zlib

    return zlib.crc32(data).to_bytes(4, "little")


def decode(text: str, carriers: tuple[str, ...] = CARRIERS) -> tuple[bytes, list[str]]:
    """The secret and the carriers that hold it; all of them must agree."""
    found: list[tuple[str, bytes]] = []
    for carrier in carriers:
        got = scan(read_bits(text, carrier))
        if got is not None:
            found.append((carrier, got[2]))
    if not found:
        raise ValueError("no_frame")
    if len({payload for _, payload in found}) > 1:
        raise ValueError("layers_differ")
    chain, payload = open_envelope(found[0][1])
    for name, _ in reversed(chain):
        if name == "crc32":
            payload, check = payload[:-4], payload[-4:]
            if _crc32(payload) != check:
                raise ValueError("payload_damaged")
        else:
            raise ValueError(f"unknown_step:{name}")
    return payload, [c for c, _ in found]


def round_trips(docs: DataFrame) -> DataFrame:
    """doc_id, carrier, refusal, ok, stripped_ok: every document through every carrier and back, with a secret of its own. A secret
    that can't be read back is not ok, and no refusal."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["doc_id", "carrier", "refusal", "ok", "stripped_ok"]
        kinds = (pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.bool_())
        strip = {c: str.maketrans("", "", v[3]) for c, v in cs.CARRIERS.items()}
        strip["homoglyph"] = str.maketrans(cs.CYRILLIC_LOOKALIKES, cs.LATIN_LOOKALIKES)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                secret = f"s{doc_id}".encode()
                for carrier in CARRIERS:
                    try:
                        marked = encode(text, secret, (carrier,))
                    except ValueError as why:
                        no = refusal(why)
                        out.append((doc_id, carrier, no, None, None) if no else (doc_id, carrier, None, False, False))
                        continue
                    try:
                        ok = decode(marked)[0] == secret
                    except (ValueError, IndexError):
                        ok = False
                    out.append((doc_id, carrier, None, ok, marked.translate(strip[carrier]) == text))
            columns = zip(*out, strict=True) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return mapped(docs.select("doc_id", "cover"), run, "doc_id long, carrier string, refusal string, ok boolean, stripped_ok boolean")


def excerpts(docs: DataFrame) -> DataFrame:
    """doc_id, carrier, copies, ok: a saturated text, its first third cut away, still gives the secret back if two frames' bits are left.

    Of look-alike letters, cuts that open or close a protected region aren't judged: other letters are read then.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = (pa.int64(), pa.string(), pa.int64(), pa.bool_())
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                secret = f"s{doc_id}".encode()
                size = len(to_bits(frame(envelope([("crc32", b"")], secret + _crc32(secret)))))
                for carrier in ("whitespace_var", "bidi", "homoglyph"):
                    try:
                        marked = encode(text, secret, (carrier,), repeat=True)
                    except ValueError as why:
                        out.append((doc_id, carrier, 0, None if refusal(why) else False))
                        continue
                    cut = len(marked) // 3
                    whole, gone, rest = (read_bits(t, carrier) for t in (marked, marked[:cut], marked[cut:]))
                    copies = len(whole) // size
                    left = copies * size - len(gone)
                    if left < 2 * size or (carrier == "homoglyph" and gone + rest != whole):
                        out.append((doc_id, carrier, copies, None))
                        continue
                    try:
                        ok = decode(marked[cut:], (carrier,))[0] == secret
                    except ValueError:
                        ok = False
                    out.append((doc_id, carrier, copies, ok))
            columns = zip(*out, strict=True) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "carrier", "copies", "ok"])

    return mapped(docs.select("doc_id", "cover"), run, "doc_id long, carrier string, copies long, ok boolean")


def regions(docs: DataFrame) -> DataFrame:
    """doc_id, regions as (start, end, kind), and marks in code: controls of the copy inside fences and code spans."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = [protected(t) for t in texts]
            inside = [sum(c in cs.CONTROL for low, high, k in f if k != "maths" for c in t[low:high]) for t, f in zip(texts, found, strict=True)]
            columns = [pa.array([[{"start": a, "end": b, "kind": k} for a, b, k in f] for f in found], kind), pa.array(inside, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "regions", "marks_in_code"])

    return mapped(docs.select("doc_id", "marked"), run, "doc_id long, regions array<struct<start:int,end:int,kind:string>>, marks_in_code long")
