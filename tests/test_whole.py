"""Operators take whole texts, not a part of them."""

import zlib

from inkledger.functions import crypto
from inkledger.operators import codec, heavy, sealing

TEXT = "first line\n" + "a later line of the text, ünïcode too\n" * 5000


class Rows:
    """Stands for a table: the Arrow function runs here, where its calls can be watched."""

    def __init__(self, *columns):
        self.columns = columns

    def select(self, *_):
        return self

    def mapInArrow(self, run, schema):  # noqa: N802
        import pyarrow as pa

        return [r for b in run(iter([pa.RecordBatch.from_arrays([pa.array(c) for c in self.columns], names=[str(k) for k in range(len(self.columns))])])) for r in b.to_pylist()]


def test_payload_codecs_take_the_whole_text(monkeypatch):
    texts, seen = ["", "\n", TEXT, "x" * 64, "one\ntwo"], {"poly": [], "zlib": [], "xor": []}
    poly, pack, xor = crypto._poly1305, zlib.compress, crypto.xor
    monkeypatch.setattr(crypto, "_poly1305", lambda k, m: seen["poly"].append(len(m)) or poly(k, m))
    monkeypatch.setattr(sealing.zlib, "compress", lambda d, level: seen["zlib"].append(d) or pack(d, level))
    monkeypatch.setattr(crypto, "xor", lambda d, p: seen["xor"].append(d) or xor(d, p))
    got = sealing.payload_round_trips(Rows(list(range(len(texts))), texts))
    assert [r["doc_id"] for r in got] == list(range(len(texts)))
    assert all(r["chacha_ok"] and r["damage_refused"] and r["xor_ok"] and r["zlib_ok"] for r in got)
    whole = [t.encode() for t in texts]
    assert seen["zlib"] == whole and seen["xor"][::2] == whole
    sizes = [len(w) + -len(w) % 16 + 16 for w in whole]
    assert sorted(seen["poly"]) == sorted(sizes * 3)


def test_many_blocks_equal_one_by_one():
    key, nonce = bytes(range(32)), bytes(range(12))
    for size in (0, 1, 63, 64, 65, 5000 * 64 + 7):
        data = bytes(k * 7 % 251 for k in range(size))
        stream = b"".join(crypto._block(key, 1 + k, nonce) for k in range(-(-size // 64)))
        assert crypto.chacha20(key, nonce, data) == bytes(a ^ b for a, b in zip(data, stream, strict=False))


COVER = "Once upon a time there was a small house near the wood, and its people kept a book of letters. " * 12


def test_a_lost_secret_is_a_failure_and_no_refusal(monkeypatch):
    docs = Rows([1, 2], [COVER, "no"])
    assert [r["refusal"] for r in codec.round_trips(docs) if r["carrier"] == "homoglyph"] == [None, "too_small"]
    for name in ("no_frame", "payload_damaged", "layers_differ"):
        monkeypatch.setattr(codec, "decode", lambda *_, why=name: (_ for _ in ()).throw(ValueError(why)))
        got = [r for r in codec.round_trips(docs) if r["doc_id"] == 1]
        assert all(r["refusal"] is None and r["ok"] is False and r["stripped_ok"] for r in got)
    monkeypatch.setattr(codec, "read_bits", lambda *_: "")
    got = [r for r in codec.round_trips(docs) if r["doc_id"] == 1]
    assert all(r["refusal"] is None and r["ok"] is False for r in got)


def test_a_lost_frame_is_a_failure_and_no_refusal(monkeypatch):
    docs = Rows([1, 2], [COVER * 2, "no"])
    assert [(r["refusal"], r["ok"]) for r in heavy.round_trips(docs)] == [(None, True), ("too_small", None)]
    monkeypatch.setattr(heavy, "preamble", lambda _: (_ for _ in ()).throw(ValueError("bad_checksum")))
    assert [(r["refusal"], r["ok"]) for r in heavy.round_trips(docs)] == [(None, False), ("too_small", None)]


def test_checksums_of_whole_texts():
    texts = ["", "123456789", TEXT]
    got = codec.checksums(Rows([1, 2, 3], texts))
    assert [(r["crc32_hex"], r["crc16_hex"]) for r in got] == [(f"{zlib.crc32(t.encode()):08x}", f"{codec.crc16(t.encode()):04x}") for t in texts]
    assert got[1]["crc32_hex"] == "cbf43926" and got[1]["crc16_hex"] == "29b1"
