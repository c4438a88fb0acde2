"""The recoverable frame: a preamble at both ends, markers between, and the payload in the gaps."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame

from ..functions.batches import mapped
from . import codec

# Version, preamble bytes, marker bits, least and most marker spacing, highest marker number.
VERSION, PREAMBLE, MARKER, LEAST_SPACING, MOST_SPACING, HIGHEST = 2, 24, 32, 64, 512, 1024
EDGE = 8 * PREAMBLE


class Preamble(NamedTuple):
    flags: int
    salt: bytes
    payload_bits: int

    def bits(self) -> str:
        head = codec.MAGIC.to_bytes(2, "big") + bytes((VERSION, self.flags)) + self.salt + self.payload_bits.to_bytes(2, "big")
        return codec.to_bits(head + codec.crc16(head).to_bytes(2, "big"))


def preamble(bits: str) -> Preamble:
    data = codec.to_bytes(bits[:EDGE])
    if len(data) < PREAMBLE:
        raise ValueError("too_short")
    if int.from_bytes(data[:2], "big") != codec.MAGIC:
        raise ValueError("no_magic")
    if codec.crc16(data[:22]) != int.from_bytes(data[22:], "big"):
        raise ValueError("bad_checksum")
    if data[2] != VERSION:
        raise ValueError("unknown_version")
    if data[3] & codec.RESERVED:
        raise ValueError("reserved_flags")
    return Preamble(data[3], data[4:20], int.from_bytes(data[20:22], "big"))


def spacing(positions: int) -> int:
    return min(max(positions // 8, LEAST_SPACING), MOST_SPACING)


def layout(positions: int) -> tuple[int, list[int], list[int]]:
    """Bits written, where markers start, and the places of payload bits; refused where the frame has no room."""
    size = positions // 8 * 8
    if size < 2 * EDGE + 8:
        raise ValueError("too_small")
    step, end = spacing(positions), size - EDGE
    markers = [at for at in range(step, end - MARKER + 1, step) if at >= EDGE]
    taken = {at + k for at in markers for k in range(MARKER)}
    return size, markers, [at for at in range(EDGE, end) if at not in taken]


def build(positions: int, payload: bytes, salt: bytes = bytes(16), flags: int = 0) -> str:
    """The frame's bits for a cover of so many positions."""
    size, markers, free = layout(positions)
    if not payload:
        raise ValueError("empty_payload")
    if 8 * len(payload) > min(len(free), 0xFFFF):
        raise ValueError("payload_too_long")
    head = Preamble(flags, salt, 8 * len(payload)).bits()
    out = ["0"] * size
    out[:EDGE], out[size - EDGE :] = head, head[::-1]
    for at in markers:
        out[at : at + MARKER] = f"{codec.MAGIC:016b}{at // spacing(positions):016b}"
    for at, bit in zip(free, codec.to_bits(payload), strict=False):
        out[at] = bit
    return "".join(out)


def read(bits: str) -> tuple[Preamble, bytes]:
    """Preamble and payload of a whole document's bits; both replicas must be there and agree."""
    size, _, free = layout(len(bits))
    head = preamble(bits)
    if preamble(bits[size - EDGE : size][::-1]) != head:
        raise ValueError("replicas_disagree")
    if head.payload_bits % 8:
        raise ValueError("partial_byte")
    if head.payload_bits > len(free):
        raise ValueError("payload_cut")
    return head, codec.to_bytes("".join(bits[at] for at in free[: head.payload_bits]))


def locate(bits: str) -> tuple[Preamble, str]:
    """The preamble at the head, else the reversed one at the tail, of which up to 7 bits may be missing."""
    for source, part in [("head", bits[:EDGE])] + [("tail", bits[max(0, len(bits) - k - EDGE) : len(bits) - k][::-1]) for k in range(8)]:
        try:
            return preamble(part), source
        except ValueError:
            continue
    raise ValueError("no_preamble")


def markers(bits: str) -> list[tuple[int, int]]:
    """(bit, number) of the markers of an excerpt, wherever it starts."""
    magic, out, at = f"{codec.MAGIC:016b}", [], 0
    while (at := bits.find(magic, at)) >= 0 and at + MARKER <= len(bits):
        try:
            preamble(bits[at:])
            at += EDGE
            continue
        except ValueError:
            pass
        number = int(bits[at + 16 : at + MARKER], 2)
        if 1 <= number <= HIGHEST:
            out.append((at, number))
            at += MARKER
        else:
            at += 1
    return out


def round_trips(docs: DataFrame) -> DataFrame:
    """doc_id, refusal, ok, tail_found, markers_found: the frame in every document's look-alike letters, read whole, without its head, and from its middle.
    A frame that can't be read back is not ok, and no refusal."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                secret = f"s{doc_id}".encode()
                try:
                    positions = len(codec.read_bits(text, "homoglyph"))
                    marked = codec.write_letters(text, build(positions, secret))
                except ValueError as why:
                    no = codec.refusal(why)
                    out.append((doc_id, no, None, None, None) if no else (doc_id, None, False, False, False))
                    continue
                try:
                    bits = codec.read_bits(marked, "homoglyph")
                    _, at, _ = layout(positions)
                    found = dict(markers(bits[positions // 3 :]))
                    want = {a - positions // 3: a // spacing(positions) for a in at if a >= positions // 3}
                    out.append((doc_id, None, read(bits)[1] == secret, locate("0" + bits[EDGE:])[1] == "tail", want.items() <= found.items()))
                except ValueError:
                    out.append((doc_id, None, False, False, False))
            columns = zip(*out, strict=True) if out else [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "refusal", "ok", "tail_found", "markers_found"])

    return mapped(docs.select("doc_id", "cover"), run, "doc_id long, refusal string, ok boolean, tail_found boolean, markers_found boolean")
